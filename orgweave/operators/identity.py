"""Identity evidence: sub-scores, assessment, fingerprints, semantic types, evidence gaps and bounded rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.sources.shared import written
from orgweave.functions import text as T
from orgweave.operators.policy import clamp


def page_identity(ratio: Column, brand_pages: Column, partial_pages: Column, any_hit: Column) -> Column:
    """Points for a company's words on a site's pages: their share, and pages that repeat the brand."""
    return (
        F.when(ratio >= 0.75, 14).when(ratio >= 0.5, 8).when(brand_pages >= 2, 14).when(partial_pages >= 2, 8).when(any_hit, 3).otherwise(-20)
    )


def legal_name_points(ownership: Column, full_phrase: Column, n_tokens: Column, phrase: Column) -> Column:
    return F.when(ownership, 20).when(full_phrase & (n_tokens >= 3), 19).when(phrase, 16).otherwise(-8)


def country_points(local_tld: Column, local_phone: Column, marker: Column) -> Column:
    return F.when(local_tld | local_phone, 8).when(marker, 5).otherwise(-10)


def context_points(name_context: Column, metadata_context: Column, other_occurrences: Column) -> Column:
    """Support by the name's or the record's context; other contexts count against it if they recur."""
    return F.when(name_context, 4).when(metadata_context, 8).when(other_occurrences >= 2, -20).otherwise(0)


def final_score(candidate: Column, points: list[Column], ambiguous: Column, resolved: Column) -> Column:
    total = candidate
    for p in points:
        total = total + p
    return F.when(ambiguous & ~resolved, F.least(clamp(total), F.lit(60))).otherwise(clamp(total))


def assess(signals: DataFrame, group: list[str]) -> DataFrame:
    """Support and conflicts of each candidate from signals (polarity, independence_key, kind, value, strong).

    Signals of one independence key count once, so that a site's own pages do not confirm each
    other. Two values of one strong kind are a conflict.
    """
    strong = (
        signals.where("strong").groupBy(*group, "kind").agg(F.count_distinct("value").alias("n")).where("n > 1").select(*group).distinct().withColumn("two_values", F.lit(True))
    )
    counted = signals.groupBy(*group).agg(
        F.count_distinct(F.when(F.col("polarity") == "support", F.col("independence_key"))).alias("n_support"),
        F.count_if(F.col("polarity") == "conflict").alias("n_conflicts"),
        F.count_distinct(F.when((F.col("polarity") == "support") & F.col("strong"), F.col("kind"))).alias("bundle"),
    )
    joined = counted.join(strong, group, "left").withColumn("n_conflicts", F.col("n_conflicts") + F.coalesce(F.col("two_values"), F.lit(False)).cast("long"))
    return joined.drop("two_values").withColumn("publishable", (F.col("n_support") >= 2) & (F.col("n_conflicts") == 0))


def bundle_needed(brand: Column, partial_activity: Column) -> Column:
    """Independent strong facts that a name needs: more for one short brand word."""
    return F.when(((F.size(brand) == 1) & (F.length(F.get(brand, F.lit(0))) < 7)) | partial_activity, 3).otherwise(2)


def semantic_types(texts: DataFrame, keys: list[str], text: str, markers: dict[str, tuple[str, ...]]) -> DataFrame:
    """How many distinct markers of each type stand in a text as words: a row for each type found."""
    padded = F.concat(F.lit(" "), F.array_join(T.tokens(text), " "), F.lit(" "))

    def counts(p: Column) -> Column:
        found = lambda words: sum((F.contains(p, F.lit(f" {w} ")).cast("int") for w in words), F.lit(0))
        return F.array(*[F.struct(F.lit(name).alias("type"), found(words).alias("n_markers")) for name, words in markers.items()])

    # a text is taken apart once, not for each marker
    return texts.select(*keys, F.explode(T.let(padded, counts)).alias("t")).select(*keys, "t.*").where("n_markers > 0")


def semantic_conflict(expected: Column, found: Column, incompatible: dict[str, tuple[str, ...]]) -> Column:
    """match, conflict or unknown for arrays of types; a match outweighs a conflict."""
    against = F.lit(False)
    for name, others in incompatible.items():
        against = against | (F.array_contains(expected, name) & F.arrays_overlap(found, F.array(*map(F.lit, others))))
    return F.when(F.arrays_overlap(expected, found), "match").when(against, "conflict").otherwise("unknown")


def evidence_gaps(has: dict[str, Column]) -> Column:
    """Names of the kinds of evidence that a candidate lacks, in their order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in has.items()]))


def rounds(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], open_rows: Callable[[DataFrame], DataFrame], limit: int) -> tuple[DataFrame, int]:
    """Apply step at most `limit` times, until no row is open or a round leaves as many open as before.

    Each round's result is written in the shared folder, so a round is not computed again.
    """
    left = open_rows(state).count()
    for i in range(limit):
        if not left:
            return state, i
        state = written(step(state, i))
        before, left = left, open_rows(state).count()
        if left >= before:
            return state, i + 1
    return state, limit


def discover(companies: DataFrame, plan: Callable[[int], DataFrame], results: DataFrame, limit: int, stop_score: int) -> DataFrame:
    """Bounded discovery on recorded results: each round runs a query for each company still below stop_score.

    companies: company. plan(i): (company, query). results: (company, query, domain, score). The
    round's queries that ran before are left out; what is found is written, so a round's plan does
    not hold the ones before. Gives (company, domain, score, round).
    """
    found = results.select("company", "domain", "score", "query", F.lit(0).alias("round")).limit(0)
    for i in range(limit):
        done = found.groupBy("company").agg(F.max("score").alias("best")).where(F.col("best") >= stop_score).select("company")
        todo = plan(i).join(companies, "company", "left_semi").join(done, "company", "left_anti").join(found.select("company", "query").distinct(), ["company", "query"], "left_anti")
        found = written(found.unionByName(todo.join(results, ["company", "query"]).select("company", "domain", "score", "query", F.lit(i).alias("round"))), "discovered")
    return found.groupBy("company", "domain").agg(F.max("score").alias("score"), F.min("round").alias("round"))
