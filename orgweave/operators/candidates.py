"""Candidate aggregation, ranking and selection within a company (or another group)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from orgweave.functions import words as W


def consensus(observations: DataFrame, keys: list[str], query: str, base: str, flags: list[str], order: str) -> DataFrame:
    """One row for each candidate: its best base score with up to 8 for further distinct queries, capped at 92.

    Flags take their maximum; the shown observation is that of the best base, the later one on ties.
    """
    extra = F.least(4 * (F.count_distinct(query) - 1), F.lit(8))
    return observations.groupBy(*keys).agg(
        F.least(F.lit(W.SCORE_CAP), F.max(base) + extra).cast("long").alias("score"),
        F.count_distinct(query).alias("n_queries"),
        F.max_by(F.col(order), F.struct(base, order)).alias("shown"),
        *[F.max(f).alias(f) for f in flags],
    )


def rank_within(rows: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Win.partitionBy(*group).orderBy(*order)))


def top_k(rows: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return rank_within(rows, group, order, name).where(F.col(name) <= k)


def top_k_pivot(rows: DataFrame, group: list[str], order: list[Column], k: int, columns: list[str]) -> DataFrame:
    """The best k of each group side by side, as candidate_1_*, candidate_2_* and so on."""
    best = top_k(rows, group, order, k)
    aggs = [F.max(F.when(F.col("rank") == i, F.col(c))).alias(f"candidate_{i}_{c}") for i in range(1, k + 1) for c in columns]
    return best.groupBy(*group).agg(*aggs)


def score_gap(rows: DataFrame, group: list[str], score: str, tie: list[Column], gap: float = W.SCORE_GAP, limit: int = W.MAX_CANDIDATES) -> DataFrame:
    """Rows within `gap` of their group's best score, `limit` at most (the selection itself is the feature)."""
    best = F.max(score).over(Win.partitionBy(*group))
    near = rows.withColumn("__best", best).where(F.col(score) >= F.col("__best") - gap).drop("__best")
    return top_k(near, group, [F.desc(score), *tie], limit)


def skyline(rows: DataFrame, group: list[str], dimensions: list[str], family: str | None = None) -> DataFrame:
    """Rows that no rival of their group dominates: as good in every dimension and better in one.

    Equal rows stay; rivals of one family never eliminate each other. One anti-join on the
    group over the rows as given: a group is a company's candidates, tens at most, and rivals
    that agree in family and all dimensions are held as one.
    """
    rival = rows.select(*[F.col(c).alias(f"__r_{c}") for c in dict.fromkeys([*group, *dimensions, *([family] if family else [])])]).distinct()
    same = [F.col(g) == F.col(f"__r_{g}") for g in group]
    no_worse = [F.col(f"__r_{d}") >= F.col(d) for d in dimensions]
    better = F.lit(False)
    for d in dimensions:
        better = better | (F.col(f"__r_{d}") > F.col(d))
    condition = better
    for c in [*same, *no_worse]:
        condition = condition & c
    if family:
        condition = condition & (F.col(family) != F.col(f"__r_{family}"))
    return rows.join(rival, condition, "left_anti")


def resolve(rows: DataFrame, group: list[str], key: list[str], family: str, ready: str) -> DataFrame:
    """resolved, ambiguous (the best key is shared by several families) or unresolved (none ready), for each group."""
    place = F.rank().over(Win.partitionBy(*group).orderBy(F.desc(ready), *[F.desc(k) for k in key]))
    best = rows.withColumn("__rank", place).where("__rank = 1")
    found = best.groupBy(*group).agg(F.max(ready).alias("__ready"), F.count_distinct(family).alias("n_families"), F.min(family).alias("family"))
    status = F.when(~F.col("__ready"), "unresolved").when(F.col("n_families") > 1, "ambiguous").otherwise("resolved")
    return found.select(*group, status.alias("status"), F.when(status == "resolved", F.col("family")).alias("family"))


def balanced_pick(rows: DataFrame, group: list[str], kind: str, order: list[Column], limit: int) -> DataFrame:
    """First one of each kind, then the rest, in the given order, `limit` for each group."""
    rounds = F.row_number().over(Win.partitionBy(*group, kind).orderBy(*order))
    again = F.when(rounds > 1, 1).otherwise(0)
    return top_k(rows.withColumn("__again", again), group, [F.col("__again").asc(), *order], limit, "pick").drop("__again")


def best_pass(rows: DataFrame, key: list[str], quality: list[str], ordinal: str) -> DataFrame:
    """The better of several passes; on ties the later one."""
    place = F.row_number().over(Win.partitionBy(*key).orderBy(*[F.desc(q) for q in quality], F.desc(ordinal)))
    return rows.withColumn("__rn", place).where("__rn = 1").drop("__rn")
