"""What evidence a company still lacks, where on the sites it may stand, and which searches may find it.

Gaps are judged against one coherent candidate of the company, its best viable one: what an unrelated
candidate shows fills no gap of another.

Defined cases: a company without candidates is given by `companies` and lacks candidates; a resolved company with
contacts lacks nothing; null names plan no searches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions import text as T
from orgweave.operators import fingerprint as P

# Gaps in order, the pages that may fill each, and where planning ends.
GAPS = (
    "missing_legal_identity", "missing_relationship", "missing_identity_coherence", "ambiguous_candidates", "missing_context", "missing_country", "missing_contact", "unreachable_candidates", "no_candidates",
)
SCOPES = {
    "missing_legal_identity": ("legal", "privacy", "about", "terms", "catalog"), "missing_relationship": ("about", "legal", "distributors", "catalog"),
    "missing_context": ("about", "catalog", "distributors", "locations"), "missing_country": ("locations", "contact", "legal"), "missing_contact": ("contact", "locations", "legal"),
    "unreachable_candidates": ("legal", "contact", "about", "privacy"), "ambiguous_candidates": ("legal", "about", "locations", "catalog"), "missing_identity_coherence": ("legal", "about", "contact", "catalog"),
}
COMPLETE, REQUIRED, NOTHING = "identity_and_contact_complete", "bounded_evidence_acquisition_required", "no_candidate_discovered"


def searches(name: Column, sector: Column, address: Column, gaps: Column, limit: int) -> Column:
    """At most `limit` searches for the gaps."""
    full = F.regexp_replace(F.regexp_replace(T.text_or_empty(name), r"\s+", " "), r"^[ \t\r\n-]+|[ \t\r\n-]+$", "")
    quoted = F.concat(F.lit('"'), full, F.lit('"'))
    lacks = lambda *names: F.arrays_overlap(gaps, F.array(*map(F.lit, names)))
    said, place = F.trim(T.text_or_empty(sector)), F.trim(T.text_or_empty(address))
    planned = F.array(
        F.concat(quoted, F.lit(" official website")), F.when(lacks("missing_legal_identity", "missing_identity_coherence", "ambiguous_candidates"), F.concat(quoted, F.lit(" ticari unvan KVKK"))),
        F.when((said != "") & lacks("missing_context", "ambiguous_candidates"), F.concat(quoted, F.lit(" "), said, F.lit(" Turkiye"))),
        F.when((place != "") & lacks("missing_country", "ambiguous_candidates"), F.concat(quoted, F.lit(" "), place)), F.when(lacks("missing_contact", "unreachable_candidates"), F.concat(quoted, F.lit(" iletisim"))),
    )
    return F.when(full == "", F.array().cast("array<string>")).otherwise(F.slice(F.array_distinct(F.array_compact(planned)), 1, limit))


def analyse(companies: DataFrame, evaluations: DataFrame, limit: int = 3) -> DataFrame:
    """company, gaps, scopes, searches and terminal of every company.

    companies: company, name, sector, address and status (of its resolution). evaluations: company and the fingerprints' columns.
    """
    e = P.columns()
    known = evaluations.select("company", *e, P.candidate_ready(e).alias("ready"))
    c = F.col
    viable = c("reachable") & c("eligible") & c("conflict_free") & c("canonical")
    order = F.struct(
        c("ready"), c("publishable"), c("first_party"), c("exact_domain"), c("legal"), (c("public_brand") & (c("page") >= 2)).alias("brand"), c("page"), c("structured"), c("country"), c("context_count"),
        (c("same_site_contact") & c("has_contact")).alias("contact"),
    )
    per = known.groupBy("company").agg(F.count(F.lit(1)).alias("n"), F.max("reachable").alias("any"), F.count_if("ready").alias("n_ready"), F.max(c("ready") & c("has_contact")).alias("done"), F.max(F.when(viable, order)).alias("t"))
    rows = companies.join(per, "company", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    resolved = F.coalesce(c("status") == "resolved", F.lit(False))
    has = c("t").isNotNull()
    lacking = {
        "missing_legal_identity": has & (c("t.legal") < 2), "missing_relationship": has & ~c("t.first_party"), "missing_context": has & (c("t.context_count") <= 0), "missing_country": has & ~c("t.country"),
        "missing_contact": has & ~c("t.contact"), "no_candidates": c("n") == 0, "unreachable_candidates": (c("n") > 0) & ~c("any"),
    }
    open_ = F.lit(False)
    for k in ("missing_legal_identity", "missing_relationship", "missing_context", "missing_country", "missing_contact"):
        open_ = open_ | F.coalesce(lacking[k], F.lit(False))
    lacking["missing_identity_coherence"] = F.when(has, ~resolved & ~c("t.ready") & ~open_).otherwise((c("n") > 0) & c("any"))
    lacking["ambiguous_candidates"] = (c("status") == "ambiguous") | (c("n_ready") > 1)
    complete = resolved & F.coalesce(c("done"), F.lit(False))
    found = F.array_compact(F.array(*[F.when(F.coalesce(lacking[g], F.lit(False)) & ~complete, F.lit(g)) for g in GAPS]))
    scopes = F.create_map(*[x for k, v in SCOPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    judged = rows.withColumn("gaps", found)
    pages = F.array_distinct(F.flatten(F.transform("gaps", lambda g: F.coalesce(F.try_element_at(scopes, g), F.array().cast("array<string>")))))
    terminal = F.when(complete, COMPLETE).when((F.size("gaps") == 1) & F.array_contains("gaps", "no_candidates"), NOTHING).otherwise(REQUIRED)
    asked = F.when(complete, F.array().cast("array<string>")).otherwise(searches(c("name"), c("sector"), c("address"), c("gaps"), limit))
    return judged.select("company", "gaps", pages.alias("scopes"), asked.alias("searches"), terminal.alias("terminal"))


def should_continue(before: Column | None, gaps: Column, steps: Column, round_: int, rounds: int) -> Column:
    """Whether a further round may help: gaps are open, the last round closed one, rounds and steps (pages or searches) are left."""
    progress = F.lit(True) if before is None else (before.isNull() | (F.size(F.array_except(before, gaps)) > 0))
    return (F.size(gaps) > 0) & F.lit(round_ < rounds) & progress & (steps > 0)
