"""What a run leaves behind: all artifacts in one write, its report and its audit, each in one pass over the rows.

Result rows have company, status, reason, score, website, email, phone, email_verification, email_source_url, phone_source_url,
publication_eligible, publication_blockers, publication_policy_action, publication_risk_tier, conflicts, terminal_reason, gaps
(array), candidates (array of domain and score), edges (array of kind and target). Nulls count as empty, false or 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from orgweave.functions import text as T
from orgweave.functions import url as U
from orgweave.functions import words as W

# Statuses that publish, that wait, and the version of the audit.
OK_STATUSES = ("OK_HIGH_CONFIDENCE", "OK_MEDIUM_CONFIDENCE")
WAITING = ("REVIEW_NEEDED", "WEBSITE_AMBIGUOUS")
UNPROVED = "no_candidate_proved_target_fingerprint"
POLICY_VERSION = "autonomous-quality-v1"
CONTACT_FIELDS = ("company", "website", "email", "phone", "status", "score", "website_status", "contact_status")
#: Counters of the run that the report quotes, by its own names.
COUNTERS = {
    "brightdata_requests": "api.brightdata.requests", "linkedin_company_requests": "api.linkedin_company.requests", "linkedin_company_matches": "api.linkedin_company.matches",
    "llm_arbiter_requests": "api.llm_arbiter.requests", "llm_arbiter_blocked": "api.llm_arbiter.budget_blocked", "places_requests": "api.google_places.requests", "crawler_requests": "http.crawler.requests",
    "source_5xx": "source_profile.http_5xx", "source_skips": "source_profile.circuit_skips", "static_attempts": "recovery.static_attempts", "static_successes": "recovery.static_successes",
    "snapshot_loaded": "snapshot.entries_loaded",
}


def _said(c: str) -> Column:
    return T.text_or_empty(c) != ""


def with_statuses(rows: DataFrame) -> DataFrame:
    """rows with website_status and contact_status."""
    ok = F.coalesce(F.col("status").startswith("OK_"), F.lit(False))
    website = F.when(_said("website") & ok, "verified").when(_said("website") | (T.text_or_empty("status") == "WEBSITE_AMBIGUOUS"), "review").otherwise("not_found")
    contact = F.when(_said("email") & _said("phone"), "complete").when(_said("email") | _said("phone"), "partial").otherwise("missing")
    return rows.withColumns({"website_status": website, "contact_status": contact})


def report_counts() -> dict[str, Column]:
    """The report's numbers as aggregates of the result rows."""
    status, ok = T.text_or_empty("status"), F.coalesce(F.col("status").isin(*OK_STATUSES), F.lit(False))
    complete = _said("website") & _said("email") & _said("phone")
    is_ = lambda c, v: T.text_or_empty(c) == v
    counted = {
        "websites": _said("website"), "emails": _said("email"), "verified_emails": is_("email_verification", "verified"), "phones": _said("phone"), "complete": complete, "published": ok,
        "publication_eligible": F.coalesce("publication_eligible", F.lit(False)), "complete_held": complete & ~ok, "verified_websites": ok & _said("website"), "verified_complete": ok & complete,
        "high_confidence": status == OK_STATUSES[0], "medium_confidence": status == OK_STATUSES[1], "review": status.isin(*WAITING), "ambiguous": status == WAITING[1], "withheld": ~ok,
        "policy_downgrades": is_("publication_policy_action", "downgrade_to_review"), "low_risk": ok & is_("publication_risk_tier", "low"), "controlled_risk": ok & is_("publication_risk_tier", "controlled"),
        "identity_unproved": is_("publication_blockers", UNPROVED) | is_("reason", UNPROVED), "fetch_failed": status == "WEBSITE_FETCH_FAILED", "not_found": status == "WEBSITE_NOT_FOUND",
        "email_allowed": is_("email_publication_status", "allowed"), "email_suppressed": is_("email_publication_status", "suppressed"), "phone_allowed": is_("phone_publication_status", "allowed"),
        "phone_suppressed": is_("phone_publication_status", "suppressed"), "gaps_open": F.size(F.coalesce("gaps", F.array().cast("array<string>"))) > 0,
    }
    out = {"companies": F.count(F.lit(1))} | {k: F.count_if(c) for k, c in counted.items()}
    return out | {"candidates": F.coalesce(F.sum(F.size(F.coalesce("candidates", F.array().cast("array<struct<domain:string,score:int>>")))), F.lit(0)), "score_sum": F.coalesce(F.sum(F.coalesce("score", F.lit(0))), F.lit(0))}


def run_report(rows: DataFrame) -> DataFrame:
    """One row of the report's numbers."""
    return rows.agg(*[c.alias(k) for k, c in report_counts().items()])


def report_lines(counts: dict[str, int], counters: dict[str, int]) -> list[str]:
    """The report as `name: count (share of companies)`, then the run's counters."""
    total = counts["companies"]
    share = lambda n: f"{n / total * 100:.1f}%" if total else "0.0%"
    own = [f"{k}: {n} ({share(n)})" for k, n in counts.items() if k not in ("score_sum", "candidates", "companies")]
    average = counts["score_sum"] / total if total else 0.0
    per_company = counts["candidates"] / total if total else 0.0
    return [f"companies: {total}", *own, f"average_score: {average:.1f}", f"candidates_per_company: {per_company:.1f}", *(f"{k}: {int(counters.get(v, 0))}" for k, v in COUNTERS.items())]


def audit(rows: DataFrame) -> DataFrame:
    """(kind, name, n): rows by status and terminal reason, open gaps, and publications that should not be."""
    ok = F.coalesce(F.col("status").startswith("OK_"), F.lit(False))
    site = U.host(T.text_or_empty("website"))
    same = lambda c: F.coalesce((U.host(T.text_or_empty(c)) != "") & (U.registrable(U.host(T.text_or_empty(c))) == U.registrable(site)), F.lit(False))
    excluded = F.exists(U.suffixes(site), lambda s: F.array_contains(F.array(*map(F.lit, W.EXCLUDED_DOMAINS)), s))
    pair = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    found = F.array(
        pair("status", T.text_or_empty("status")), F.when(_said("terminal_reason"), pair("terminal_reason", F.col("terminal_reason"))), F.when(ok, pair("published", F.lit(""))),
        F.when(ok & excluded, pair("invalid_publication", F.lit("published_excluded_third_party_domain"))),
        F.when(ok & ~((site != "") & (same("email_source_url") | same("phone_source_url"))), pair("invalid_publication", F.lit("published_without_same_site_contact_source"))),
        F.when(ok & F.coalesce(F.col("conflicts") > 0, F.lit(False)), pair("invalid_publication", F.lit("published_with_identity_conflict"))),
    )
    gaps = F.transform(F.coalesce("gaps", F.array().cast("array<string>")), lambda g: F.struct(F.lit("gap").alias("kind"), g.alias("name")))
    return rows.select(F.explode(F.concat(F.array_compact(found), gaps)).alias("x")).groupBy("x.kind", "x.name").agg(F.count(F.lit(1)).alias("n"))


def artifact_rows(rows: DataFrame) -> DataFrame:
    """artifact and value (a JSON line): every row once for each artifact that it belongs to, in one pass."""
    r = with_statuses(rows)
    ok = F.coalesce(F.col("status").isin(*OK_STATUSES), F.lit(False))
    contact = F.to_json(F.struct(*CONTACT_FIELDS), {"ignoreNullFields": "false"})
    line = lambda name, value: F.struct(F.lit(name).alias("artifact"), value.alias("value"))
    failed = F.to_json(F.struct(*[T.text_or_empty(c).alias(c) for c in ("company", "status", "reason")]))
    evidence = F.to_json(F.struct("company", "status", "website", "email_source_url", "phone_source_url", "gaps", "conflicts"), {"ignoreNullFields": "false"})
    single = F.array(
        F.when(ok, line("contacts", contact)), F.when(ok, line("verified_contacts", contact)), F.when(~ok, line("review_queue", contact)), F.when(~ok, line("failed", failed)), line("evidence", evidence),
        line("discovery_coverage", F.to_json(F.struct("company", ok.alias("published"), F.size(F.coalesce("gaps", F.array().cast("array<string>"))).alias("open_gaps")))),
        F.when(ok & _said("website"), line("entity_memory", F.to_json(F.struct("company", U.host("website").alias("domain"), F.col("terminal_reason").alias("resolution"))))),
        F.when(F.coalesce(F.col("conflicts") > 0, F.lit(False)) & ok, line("invalid_publications", F.to_json(F.struct("company", "conflicts")))),
    )
    company = F.col("company")
    listed = F.transform(F.coalesce("candidates", F.array().cast("array<struct<domain:string,score:int>>")), lambda c, i: F.struct(F.lit("website_candidates").alias("artifact"), F.to_json(F.struct(company.alias("company"), (i + 1).alias("place"), c["domain"].alias("domain"), c["score"].alias("score"))).alias("value")))
    edges = F.transform(F.coalesce("edges", F.array().cast("array<struct<kind:string,target:string>>")), lambda e: F.struct(F.lit("entity_relationships").alias("artifact"), F.to_json(F.struct(company.alias("company"), e["kind"].alias("kind"), e["target"].alias("target"))).alias("value")))
    gaps = F.transform(F.coalesce("gaps", F.array().cast("array<string>")), lambda g: F.struct(F.lit("acquisition_plan").alias("artifact"), F.to_json(F.struct(company.alias("company"), g.alias("gap"))).alias("value")))
    status = F.array(F.struct(F.lit("status_log").alias("artifact"), F.to_json(F.struct("company", "status", "website_status", "contact_status")).alias("value")))
    return r.select(F.explode(F.concat(F.array_compact(single), listed, edges, gaps, status)).alias("a")).select("a.*")


ARTIFACTS = (
    "contacts", "verified_contacts", "review_queue", "failed", "evidence", "discovery_coverage", "entity_memory", "invalid_publications", "website_candidates", "entity_relationships", "acquisition_plan", "status_log",
)


def write_artifacts(rows: DataFrame, folder: str) -> dict[str, int]:
    """All artifacts below `folder`, a partition each, as compressed lines, and the report's numbers, in one scan of the rows."""
    seen = Observation("report")
    observed = rows.observe(seen, *[c.alias(k) for k, c in report_counts().items()])
    artifact_rows(observed).write.partitionBy("artifact").mode("overwrite").text(folder, compression="gzip")
    return seen.get


def read_artifact(spark, folder: str, artifact: str) -> DataFrame:
    return spark.read.text(f"{folder}/artifact={artifact}")
