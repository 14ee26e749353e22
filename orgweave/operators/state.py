"""Caches, checkpoints, budgets, rate limits and circuits over event tables (batch forms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from orgweave.operators.records import last_wins
from orgweave.sources.shared import Scratch, written


def cache_lookup(requests: DataFrame, entries: DataFrame, keys: list[str], version: int, ttl_s: int, now: Column, created: str = "created_at", stale_ok: bool = False) -> DataFrame:
    """requests with the newest entry of their key that has the version and age: columns of entries, null on a miss."""
    valid = entries.where(F.col("schema_version") == version)
    if not stale_ok:
        valid = valid.where(F.unix_timestamp(now) - F.unix_timestamp(F.col(created)) <= ttl_s)
    return requests.join(last_wins(valid, keys, [F.col(created), F.col("entry_id")]), keys, "left")


def prefix_lookup(requests: DataFrame, entries: DataFrame, prefix_length: int, richness: Column, tie: Column) -> DataFrame:
    """The richest entry among those that share a request's prefix; joined on the prefix, not by comparing all pairs."""
    best = entries.groupBy(F.substring("key", 1, prefix_length).alias("prefix")).agg(F.max_by(F.col("key"), F.struct(richness, tie)).alias("best_key"), F.max(richness).alias("richness"))
    return requests.withColumn("prefix", F.substring("key", 1, prefix_length)).join(best, "prefix", "left")


def manifest(rows: DataFrame, group: list[str], order: str, payload: Column, width: int = 1000, levels: int = 3) -> DataFrame:
    """For each group a SHA-256 tree over its rows in the order of a whole number.

    A row's hash is that of its payload. A level's hash is that of the hashes of up to `width`
    neighbours in order, so no task holds more than that of a group below the top level.
    """
    level = rows.select(*group, F.col(order).alias("__o"), F.sha2(payload, 256).alias("__h"), F.lit(1).alias("__n"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__o", "__h"))), lambda x: x["__h"]), "\n"), 256)
    for _ in range(levels - 1):
        bucket = F.floor(F.col("__o") / width).alias("__b")
        level = level.groupBy(*group, bucket).agg(joined.alias("__h"), F.sum("__n").alias("__n")).withColumnRenamed("__b", "__o")
    return level.groupBy(*group).agg(F.sum("__n").alias("n"), joined.alias("sha256"))


def contiguous_prefix(rows: DataFrame, run: str, index: str) -> DataFrame:
    """How many items from 0 on are complete in each run, whatever came later."""
    place = F.row_number().over(Win.partitionBy(run).orderBy(index)) - 1
    return rows.select(run, index).distinct().withColumn("__p", place).groupBy(run).agg(F.count_if(F.col("__p") == F.col(index)).alias("n_prefix"), F.count(F.lit(1)).alias("n_done"))


def admit(calls: DataFrame, provider: str, order: list[str], budget: Column, zero_is_unlimited: bool = False) -> DataFrame:
    """calls with admitted: the first `budget` ones of each provider. A budget of 0 admits none, or all if it means unlimited."""
    nth = F.row_number().over(Win.partitionBy(provider).orderBy(*order))
    ok = nth <= budget
    if zero_is_unlimited:
        ok = ok | (budget == 0)
    return calls.withColumn("admitted", ok)


def admitted_counts(calls: DataFrame, provider: str, budget: Column) -> DataFrame:
    """(provider, n_admitted, n_blocked) under a budget, from counts alone: no provider's calls meet in one task."""
    n = calls.groupBy(provider).agg(F.count(F.lit(1)).alias("__n"))
    return n.select(provider, F.least("__n", budget).alias("n_admitted"), F.greatest(F.col("__n") - budget, F.lit(0)).alias("n_blocked"))


class Ordered:
    """Rows in the order of a key and further columns, cut into ranges of about equal size, for running values over keys of any size.

    A key's rows may lie in several ranges: what a range adds for a key is summed first, carried from range to range
    (as many rows a key as it has ranges), and added to the running value within the range. The order must be total.
    """

    def __init__(self, rows: DataFrame, key: str, order: list[str], scratch: Scratch) -> None:
        self.key, self.order, self.scratch = key, order, scratch
        self.rows = scratch.written(rows.repartitionByRange(F.col(key), *order).withColumn("__range", F.spark_partition_id()), "ordered")

    def running(self, function, start, join, **values: Column) -> None:
        """Adds a running aggregate of each value, up to and with its row; `join` puts a carried value and an own one together."""
        own = {f"__v_{k}": v for k, v in values.items()}
        valued = self.rows.withColumns(own)
        each = valued.groupBy(self.key, "__range").agg(*[function(v).alias(f"__s_{k}") for k, v in zip(values, own)])
        earlier = Win.partitionBy(self.key).orderBy("__range").rowsBetween(Win.unboundedPreceding, -1)
        carried = each.select(F.col(self.key).alias("__k"), F.col("__range").alias("__r"), *[F.coalesce(function(f"__s_{k}").over(earlier), F.lit(start)).alias(f"__c_{k}") for k in values])
        within = Win.partitionBy(self.key, "__range").orderBy(*self.order).rowsBetween(Win.unboundedPreceding, 0)
        met = valued.join(carried, F.col(self.key).eqNullSafe(F.col("__k")) & (F.col("__range") == F.col("__r")))
        done = met.withColumns({k: join(F.col(f"__c_{k}"), function(f"__v_{k}").over(within)) for k in values})
        self.rows = self.scratch.written(done.drop("__k", "__r", *own, *[f"__c_{k}" for k in values]), "ordered")

    def sums(self, **values: Column) -> None:
        self.running(F.sum, 0, lambda a, b: a + b, **values)

    def maxima(self, **values: Column) -> None:
        self.running(F.max, float("-inf"), lambda a, b: F.greatest(a, b), **values)


def schedule(calls: DataFrame, provider: str, order: list[str], seconds: Column, rate: float) -> DataFrame:
    """calls with start_s: no two starts of a provider closer than 1 / rate, in the closed form of the sequential limiter."""
    with Scratch(calls.sparkSession) as scratch:
        own = Ordered(calls.withColumn("__t", seconds), provider, order, scratch)
        own.sums(__n=F.lit(1))
        own.maxima(__slack=F.col("__t") - (F.col("__n") - 1).cast("double") / rate)
        start = F.col("__slack") + (F.col("__n") - 1).cast("double") / rate
        return written(own.rows.withColumn("start_s", start).select(*calls.columns, "start_s"), "scheduled")


def failure_runs(calls: DataFrame, provider: str, order: list[str], success: Column, threshold: int) -> DataFrame:
    """Runs of failures between successes: provider, run, first and last call, length, opens (at the threshold)."""
    with Scratch(calls.sparkSession) as scratch:
        own = Ordered(calls.withColumn("__ok", success), provider, order, scratch)
        own.sums(run=F.col("__ok").cast("int"))
        runs = own.rows.where(~F.col("__ok")).groupBy(provider, "run").agg(F.min(order[-1]).alias("first_call"), F.max(order[-1]).alias("last_call"), F.count(F.lit(1)).alias("n_failures"))
        return written(runs.withColumn("opens", F.col("n_failures") >= threshold), "failure-runs")


def scaled_budget(n: Column, ratio: float, cap: int) -> Column:
    return F.least(F.lit(cap), F.ceil(n * ratio)).cast("int")
