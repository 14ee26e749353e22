"""Arbitration of candidates that leave a company's choice open, round after round, by recorded verdicts.

A round asks only for candidates that a rule names: those of a close pair among the four best
plausible ones, and the best one whose context speaks against an identity that is otherwise
proved. Verdicts are joined; a match may prove the site, a mismatch rejects it and lets the next
worthy candidate of the company in. Rounds end when nobody is left to be asked, or at the limit.
Each round's state is written in the shared folder, so no round is computed again.

Defined cases: a candidate without a verdict is asked once and stays as it is; null verdicts and
unknown ones are uncertain; a company without candidates in the pool is not in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from orgweave.functions import url as U
from orgweave.operators import discovery, registries
from orgweave.operators.evaluation import _starts
from orgweave.operators.fingerprint import resolve_candidates
from orgweave.sources.shared import Scratch, written

# Why a candidate is asked for, and queries whose results are not compared.
CLOSE, CONTEXT = "close_identity_margin_conflict", "sector_context_conflict_with_identity_evidence"
AUTHORITATIVE = ("verified_entity", "verified_alias", "input_website")
PROOFS = ("structured_identity_medium:", "structured_identity_strong:", "legal_name_phrase_match:", "legal_name_full_match:", "legal_name_ownership_match:", "email_domain_match")
UNSETTLED = ("metadata_context_not_observed:", "metadata_context_missing:", "metadata_context_conflict_overridden_by_exact_compound_identity", "context_match:")
ROUNDS = 2


def _reason(*prefixes: str) -> Column:
    return F.exists("reasons", lambda r: _starts(r, *prefixes))


def hard_context_failure() -> Column:
    """discovery.hard_context_failure of an evaluation."""
    return discovery.hard_context_failure(
        {
            "failed": F.col("context_failed"), "arbiter_match": F.col("arbiter"), "conflict": _reason("context_conflict:", "metadata_context_conflict:"), "compound": F.col("exact_compound"),
            "exact_brand": F.col("exact_compound"), "legal_proof": _reason(*PROOFS[:5]), "strong_bundle": F.col("strong_bundle"), "discovery_only": _reason("metadata_context_missing:", "metadata_context_not_observed:"),
        }
    )


def context_conflict() -> Column:
    """Whether identity is proved and the context speaks against it, or does not settle an ambiguous name."""
    unsettled = (F.trim(F.coalesce("about", F.lit(""))) != "") & F.col("ambiguous") & _reason(*UNSETTLED)
    return F.col("reachable") & _reason(*PROOFS) & (hard_context_failure() | unsettled)


def worthy() -> Column:
    """Whether a candidate may take a rejected one's place."""
    c = F.col
    named = (c("public_brand") & ((c("page") >= 2) | ((c("page") >= 1) & (c("query") >= 3)))) | c("exact_domain") | c("exact_brand") | (c("legal") >= 1)
    return c("reachable") & (c("publishable") | (c("eligible") & c("conflict_free") & c("canonical") & named))


def triggers(evaluations: DataFrame) -> DataFrame:
    """company, node and the sorted triggers of every candidate that a round asks for.

    evaluations: of operators.evaluation, with place (from 1, the company's order) and, if they are there, active and rejected.
    """
    rows = evaluations
    for flag, default in (("active", True), ("rejected", False)):
        rows = rows if flag in rows.columns else rows.withColumn(flag, F.lit(default))
    open_ = rows.where("active and not rejected and reachable").withColumn("family", U.registrable(F.col("host")))
    plausible = open_.where("publishable").select("company", "node", "place", "family", "final_score", F.size("supports").alias("support"), (F.col("query_source").isin(*AUTHORITATIVE) | (F.size("conflicts") > 0)).alias("settled"))
    pairs = registries.close_pairs(plausible, ["company"], "node", "final_score", "support", "family", order="place", settled="settled")
    close = pairs.select("company", F.explode(F.array("first", "second")).alias("node")).withColumn("trigger", F.lit(CLOSE))
    first = F.row_number().over(Win.partitionBy("company").orderBy("place", "node"))
    against = open_.where(context_conflict()).select("company", "node", first.alias("n")).where("n = 1").select("company", "node", F.lit(CONTEXT).alias("trigger"))
    return close.unionByName(against).groupBy("company", "node").agg(F.array_sort(F.collect_set("trigger")).alias("triggers"))


def arbitrate(evaluations: DataFrame, verdicts: DataFrame, active: int, limit: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(candidates with round, triggers, verdict, active and rejected; resolutions of all companies).

    evaluations: as in triggers; the first `active` places of a company are in the pool at the start.
    verdicts: company, node, verdict (match, no_match, else uncertain), recorded; one row a candidate.
    """
    spark = evaluations.sparkSession
    start = evaluations.withColumns(
        {"worthy": worthy(), "active": F.col("place") <= active, "rejected": F.lit(False), "round": F.lit(None).cast("int"), "triggers": F.array().cast("array<string>"), "decision": F.lit(None).cast("string")}
    )
    with Scratch(spark) as scratch:
        state = scratch.written(start, "round-0")
        for i in range(1, limit + 1):
            asked = scratch.written(triggers(state).join(state.where("round is null").select("company", "node"), ["company", "node"]), f"asked-{i}")
            if asked.isEmpty():
                break
            state = scratch.written(_judged(state, asked.join(verdicts.select("company", "node", "verdict"), ["company", "node"], "left"), i), f"round-{i}")
        found = written(state, "arbitrated")
        pool = found.where("active").withColumn("family", U.registrable(F.col("host")))
        none = found.select("company").distinct().join(pool.select("company").distinct(), "company", "left_anti")
        resolved = resolve_candidates(pool, "company", "node", "family")
        return found, resolved.unionByName(none.select("company", F.lit("unresolved").alias("status"), F.lit(None).cast("long").alias("selected"), F.lit(None).cast("string").alias("resolved_by")))


def _judged(state: DataFrame, answers: DataFrame, i: int) -> DataFrame:
    """The state after a round: verdicts taken, and as many worthy candidates let in as were rejected."""
    said = F.when(F.col("new").isin("match", "no_match"), F.col("new")).otherwise("uncertain")
    new = answers.select("company", "node", F.col("verdict").alias("new"), F.col("triggers").alias("why"))
    met = state.join(new, ["company", "node"], "left").withColumn("new", F.when(F.col("why").isNotNull(), said))
    after = met.withColumns(
        {
            "round": F.when(F.col("why").isNotNull(), F.lit(i)).otherwise(F.col("round")), "triggers": F.coalesce("why", "triggers"), "decision": F.coalesce("new", "decision"),
            "arbiter": F.coalesce(F.col("new") == "match", F.lit(False)) | F.col("arbiter"), "rejected": F.coalesce(F.col("new") == "no_match", F.lit(False)) | F.col("rejected"),
        }
    )
    of = Win.partitionBy("company")
    waiting = F.col("worthy") & ~F.col("active")
    lost = F.coalesce(F.count_if(F.col("new") == "no_match").over(of), F.lit(0))
    turn = F.row_number().over(Win.partitionBy("company", waiting).orderBy("place", "node"))
    return after.withColumn("active", F.col("active") | (waiting & (turn <= lost))).select(state.columns)
