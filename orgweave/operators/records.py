"""Merging, comparing and auditing record tables.

Order is never taken from partitions: every first or last is by a column given as `order`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F


def filled(c: str) -> Column:
    """Null for what is blank."""
    return F.when(F.trim(F.col(c).cast("string")) != "", F.col(c))


def joined_values(rows: DataFrame, key: str, value: str, order: str, separator: str = ";") -> DataFrame:
    """(key, value): each key's distinct filled values in the order of their first appearance.

    Rows are reduced to one for each distinct value before any list is made.
    """
    first = rows.where(filled(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("__o"))
    listed = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__o", F.col(value).cast("string").alias("v")))).alias("__l"))
    return listed.select(key, F.array_join(F.transform("__l", lambda p: p["v"]), separator).alias(value))


def dedupe(records: DataFrame, key: Column, order: str, columns: list[str], joined: str | None = None) -> DataFrame:
    """One row for each key: the first filled value of each column, all values of `joined`, and the row count."""
    keyed = records.withColumn("key", key)
    first = [F.min_by(F.col(c), F.when(filled(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    merged = keyed.groupBy("key").agg(*first, F.count(F.lit(1)).alias("n_rows"))
    return merged.join(joined_values(keyed, "key", joined, order), "key", "left") if joined else merged


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return _one(rows, keys, [o.desc() for o in order])


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return _one(rows, keys, [o.asc() for o in order])


def _one(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    place = F.row_number().over(Win.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rn", place).where("__rn = 1").drop("__rn")


def union_sources(**sources: DataFrame) -> DataFrame:
    """All rows of the sources with their name and priority, missing columns null."""
    out = None
    for i, (name, df) in enumerate(sources.items()):
        own = df.withColumn("source", F.lit(name)).withColumn("source_priority", F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def compare(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """old with the new run's values beside its own, as old_* and new_*."""
    left = old.select(key, *[F.col(c).alias(f"old_{c}") for c in columns])
    right = new.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    return left.join(right, key, "left")


def needs_decision(compared: DataFrame, column: str) -> DataFrame:
    old, new = F.col(f"old_{column}"), F.col(f"new_{column}")
    return compared.where(new.isNotNull() & (old.isNull() | (old != new)))


def suggest(old: dict[str, Column], new: dict[str, Column], tokens: Column, same: Column) -> Column:
    """(decision, reason): old, new or review, by the first of twelve rules that holds.

    old and new: present, bad (the site is one of an excluded kind), hits (of the name's `tokens`
    words in the domain), contacts (0 to 2), national (a domain of the country) and score.
    """
    strength = lambda x: x["hits"] * 3 + x["contacts"] * 2 + x["national"].cast("int")
    whole = lambda x: x["hits"] == tokens
    far = F.abs(new["score"] - old["score"]) >= 25
    much = F.abs(strength(new) - strength(old)) >= 3
    rules = (
        (~old["present"] & new["present"] & ~new["bad"], "new", "old_empty_new_found"),
        (old["bad"] & ~new["bad"], "new", "old_bad_domain"),
        (new["bad"] & ~old["bad"], "old", "new_bad_domain"),
        (whole(old) & (new["hits"] < tokens), "old", "old_full_token_match"),
        (whole(new) & (old["hits"] < tokens), "new", "new_full_token_match"),
        ((new["contacts"] > old["contacts"]) & (new["hits"] >= old["hits"]) & ~new["bad"], "new", "new_more_contact_evidence"),
        ((old["contacts"] > new["contacts"]) & (old["hits"] >= new["hits"]) & ~old["bad"], "old", "old_more_contact_evidence"),
        (same, "old", "same_domain_keep_old"),
        (far & (new["score"] > old["score"]) & ~new["bad"], "new", "new_score_much_higher"),
        (far & (old["score"] > new["score"]) & ~old["bad"], "old", "old_score_much_higher"),
        (much & (strength(new) > strength(old)) & ~new["bad"], "new", "new_stronger_evidence"),
        (much & (strength(old) > strength(new)) & ~old["bad"], "old", "old_stronger_evidence"),
    )
    out = F.struct(F.lit("review").alias("decision"), F.lit("unclear").alias("reason"))
    for holds, decision, reason in reversed(rules):
        out = F.when(holds, F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def apply_decisions(base: DataFrame, decisions: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the new run's values where the decision says new and the new run has the row."""
    given = new.select(key, F.lit(True).alias("__has"), *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = base.join(decisions.select(key, "decision"), key, "left").join(given, key, "left")
    use = (F.col("decision") == "new") & F.col("__has")
    changed = [F.when(use, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns]
    outcome = F.when(F.col("decision").isNull(), "undecided").when(use, "replaced").when(F.col("decision") == "new", "missing").otherwise("kept")
    return joined.select(*changed, outcome.alias("outcome"))


def merge_runs(base: DataFrame, retry: DataFrame, key: str, status: str, good: tuple[str, ...], auto_replace: bool = True) -> DataFrame:
    """base rows with a route: replace where the retry is good, review where it differs otherwise, keep."""
    other = retry.select(key, F.col(status).alias("retry_status"))
    joined = base.join(other, key, "left")
    is_good = F.col("retry_status").isin(*good)
    route = F.when(F.col("retry_status").isNull(), "keep").when(is_good & F.lit(auto_replace), "replace").when(F.col("retry_status") != F.col(status), "review").otherwise("keep")
    return joined.select(*base.columns, "retry_status", route.alias("route"))


def overlaps(members: DataFrame, key: str, role: str) -> DataFrame:
    """Pairs of roles with keys in both, and how many; only the few distinct roles of one key are paired."""
    own = members.select(key, role).distinct()
    a, b = own.withColumnRenamed(role, "role_a"), own.withColumnRenamed(role, "role_b")
    return a.join(b, key).where("role_a < role_b").groupBy("role_a", "role_b").agg(F.count(F.lit(1)).alias("n_shared"))


def suffix_anti_join(rows: DataFrame, host: str, domains: DataFrame) -> DataFrame:
    """Rows whose host is none of the domains nor below one. domains: a column `domain`."""
    from orgweave.functions.url import suffixes

    hosts = rows.select(host).distinct().withColumn("domain", F.explode(suffixes(F.col(host))))
    listed = hosts.join(domains.select("domain").distinct(), "domain", "left_semi").select(host).distinct()
    return rows.join(listed, host, "left_anti")


def invariant_audit(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule, in one pass."""
    return rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])


def reasons(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules]))
