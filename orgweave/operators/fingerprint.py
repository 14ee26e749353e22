"""What a candidate's evidence proves: verified identity, safe routes, specificity, ranking keys, and a company's resolution.

Evidence is a dict of typed columns, by the names in FLAGS (boolean) and STRENGTHS (whole numbers).
Keys are arrays of whole numbers, compared from the left.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from orgweave.sources.shared import Scratch, written

FLAGS = (
    "reachable", "eligible", "conflict_free", "publishable", "first_party", "country", "country_phone_only", "exact_domain", "exact_brand",
    "public_brand", "primary_exact", "short_exact", "primary_contextual", "primary_anchored", "same_site_contact", "canonical", "has_contact",
    "intrinsic", "semantic_match", "semantic_conflict", "direct", "relationship", "places_phone", "places_business", "business_name",
    "linkedin", "arbiter",
)
STRENGTHS = ("legal", "legal_count", "context_count", "page", "structured", "query")
ROUTES = (
    "exact_domain", "exact_website", "public_contact", "legal_uniqueness", "places_contact", "structured_brand", "structured_uniqueness",
    "exact_primary_structured", "short_brand_context", "verified_first_party", "linkedin_corroborated", "llm_arbiter_corroborated",
)


def columns() -> dict[str, Column]:
    """The evidence as columns of their own names."""
    return {c: F.col(c) for c in (*FLAGS, *STRENGTHS)}


def _all(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _any(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _site(e: Mapping[str, Column]) -> Column:
    """The site's own contacts, under its own name."""
    return _all(e["same_site_contact"], e["canonical"], e["has_contact"])


def _clear(e: Mapping[str, Column]) -> Column:
    return _all(e["reachable"], e["eligible"], e["conflict_free"], e["country"])


def verified_identity(e: Mapping[str, Column]) -> Column:
    return _all(_clear(e), e["publishable"], e["first_party"])


def routes(e: Mapping[str, Column]) -> dict[str, Column]:
    """Each route by which a candidate is safe, in order of strength."""
    clear, site, page, query = _clear(e), _site(e), e["page"], e["query"]
    places = e["places_phone"] | e["places_business"]
    structured = e["structured"] >= 2
    brand = _any(
        e["exact_brand"] & (page >= 1), e["public_brand"] & (page >= 2), e["primary_exact"] & (page >= 2), e["primary_anchored"] & (page >= 1) & (query >= 3)
    )
    domain = _any(e["public_brand"], e["primary_exact"], e["primary_contextual"], e["business_name"] & structured)
    support = _any(structured, e["legal"] >= 2, e["same_site_contact"], places, e["business_name"], e["linkedin"])
    found = (
        _all(clear, site, e["exact_domain"]),
        _all(clear, e["exact_domain"], e["canonical"], page >= 1, query >= 1),
        _all(clear, site, brand, query >= 2),
        _all(clear, site, e["first_party"], e["legal"] >= 3, page >= 3, query >= 4),
        _all(clear, site, e["publishable"], places, page >= 2, e["places_phone"] | (query >= 2)),
        _all(clear, site, e["publishable"], e["business_name"], page >= 2, structured, query >= 2),
        _all(clear, site, e["business_name"], page >= 3, structured, query >= 4),
        _all(clear, site, e["publishable"], e["primary_exact"], page >= 2, structured, query >= 1),
        _all(clear, site, e["publishable"], e["short_exact"], page >= 3, e["context_count"] >= 1, query >= 4),
        _all(verified_identity(e), site, domain, page >= 2),
        _all(clear, e["canonical"], e["linkedin"]),
        # the arbiter may overrule a conflict, with support of another kind
        _all(e["reachable"], e["eligible"], e["country"], e["canonical"], e["arbiter"], support),
    )
    return dict(zip(ROUTES, found, strict=True))


def domain_specificity(e: Mapping[str, Column]) -> Column:
    """3 to 0: how closely the domain names the company itself and not a sibling."""
    return F.when(e["exact_domain"], 3).when(e["exact_brand"] | e["primary_contextual"], 2).when(e["primary_exact"], 1).otherwise(0)


def _intrinsic_bundle(e: Mapping[str, Column]) -> Column:
    return _all(e["public_brand"], e["page"] >= 2, _site(e))


def anchor_ready(e: Mapping[str, Column], found: Mapping[str, Column] | None = None) -> Column:
    """Whether a candidate that a profile names proves itself on its own site. found: its routes, where they are columns already."""
    r = found or routes(e)
    legal = (e["legal"] >= 3) | ((e["legal"] == 2) & (e["legal_count"] >= 2))
    proved = _all(verified_identity(e), e["has_contact"], legal | _intrinsic_bundle(e))
    return _any(r["exact_domain"], r["exact_website"], r["verified_first_party"], proved)


def candidate_ready(e: Mapping[str, Column], found: Mapping[str, Column] | None = None) -> Column:
    """Whether a candidate of the search has identity enough; a national telephone number alone is not. found: as in anchor_ready."""
    r = found or routes(e)
    saved = _any(e["exact_domain"], *[r[k] for k in ("places_contact", "verified_first_party", "linkedin_corroborated", "llm_arbiter_corroborated")])
    homonym = _all(e["country_phone_only"], e["legal"] == 0, e["query"] < 2, ~saved)
    return ~homonym & _any(*r.values(), verified_identity(e) & ((e["legal"] >= 2) | _intrinsic_bundle(e)))


def identity_key(e: Mapping[str, Column], found: Mapping[str, Column] | None = None) -> Column:
    """29 numbers, the greater the better: the routes, then identity, then the strengths of the evidence. found: as in anchor_ready."""
    number = lambda c: c.cast("int")
    return F.array(
        *[number(r) for r in (found or routes(e)).values()], domain_specificity(e), number(verified_identity(e)), number(e["direct"]), -number(e["relationship"]),
        e["legal"], e["legal_count"], e["context_count"], e["structured"], e["page"], number(e["public_brand"]), number(e["exact_brand"]), number(e["intrinsic"]),
        number(e["linkedin"]), number(e["has_contact"]), number(e["semantic_match"]), -number(e["semantic_conflict"]), e["query"],
    )


def dominates(a: Mapping[str, Column], b: Mapping[str, Column]) -> Column:
    """Whether a eliminates b: by a decisive difference, or as good in all dimensions and better in one.

    Besides the evidence a and b hold `specificity`, `verified` and `safe_exact`.
    """
    both = (
        [(a[k], b[k]) for k in ("legal", "legal_count", "context_count", "structured", "page")]
        + [(a[k].cast("int"), b[k].cast("int")) for k in ("semantic_match", "intrinsic", "has_contact")]
        + [(a["query"], b["query"])]
    )
    pareto = _all(*[x >= y for x, y in both]) & _any(*[x > y for x, y in both])
    proved = lambda s: _all(s["verified"], s["page"] >= 1, s["country"], s["has_contact"], ~s["semantic_conflict"])
    more, less = a["specificity"] > b["specificity"], a["specificity"] < b["specificity"]
    return (
        F.when(a["semantic_conflict"] != b["semantic_conflict"], ~a["semantic_conflict"])
        .when(a["direct"] != b["direct"], a["direct"])
        .when(more & proved(a), True)
        .when(less & proved(b), False)
        .when(a["safe_exact"] != b["safe_exact"], a["safe_exact"])
        .otherwise(pareto)
    )


# Why a company has a site, by the first of these routes that holds, and why it has none.
RESOLVED = {
    "exact_domain": "candidate_resolved_by_exact_full_name_domain", "exact_website": "candidate_resolved_by_exact_full_name_domain",
    "linkedin_corroborated": "candidate_resolved_by_linkedin_website_match", "llm_arbiter_corroborated": "candidate_resolved_by_llm_arbiter_match",
}
RESOLVED_OTHERWISE = "candidate_resolved_by_target_fingerprint"
UNRESOLVED, AMBIGUOUS = "no_candidate_proved_target_fingerprint", "multiple_candidates_proved_equal_target_fingerprint"


def proved(candidates: DataFrame, company: str, node: str, family: str) -> DataFrame:
    """candidates with their evidence and what it proves: ready, verified, specificity, safe_exact, key and resolved_by."""
    e = columns()
    found = F.struct(*[r.alias(k) for k, r in routes(e).items()])
    # the routes are one struct first: all that follows reads it
    known = candidates.select(company, node, family, *e, found.alias("route"))
    route = {k: F.col(f"route.{k}") for k in ROUTES}
    by = F.lit(RESOLVED_OTHERWISE)
    for k, reason in reversed(RESOLVED.items()):
        by = F.when(route[k], reason).otherwise(by)
    return known.select(
        company, node, family, *e, candidate_ready(e, route).alias("ready"), verified_identity(e).alias("verified"), domain_specificity(e).alias("specificity"),
        route["exact_domain"].alias("safe_exact"), identity_key(e, route).alias("key"), by.alias("resolved_by"),
    )


def resolve_candidates(candidates: DataFrame, company: str, node: str, family: str) -> DataFrame:
    """(company, status, selected, resolved_by) of every company: resolved, ambiguous or unresolved; resolved_by is the reason of any of them.

    candidates: the evidence, `node` (also the order on ties), `family` (sites of one owner do
    not eliminate each other) and, if it is there, `rejected`, which an arbitration sets. A company's own
    candidates, tens at most, meet each other once.
    """
    e = columns()
    with Scratch(candidates.sparkSession) as scratch:
        open_ = candidates.where(~F.coalesce("rejected", F.lit(False))) if "rejected" in candidates.columns else candidates
        # written once: the rules are long, and the comparison of pairs would repeat them
        ready = scratch.written(proved(open_, company, node, family), "fingerprints").where("ready")
        rival = ready.select(*[F.col(c).alias(f"r_{c}") for c in ready.columns])
        side = lambda prefix: {c: F.col(prefix + c) for c in (*e, "verified", "specificity", "safe_exact")}
        beaten = (F.col(company) == F.col(f"r_{company}")) & (F.col(node) != F.col(f"r_{node}")) & (F.col(family) != F.col(f"r_{family}")) & dominates(side("r_"), side(""))
        left = ready.join(rival, beaten, "left_anti")
        best = Win.partitionBy(company).orderBy(F.desc("key"), F.asc(node))
        chosen = left.withColumn("first", F.row_number().over(best) == 1)
        top = Win.partitionBy(company)
        head = lambda c: F.max(F.when(F.col("first"), F.col(c))).over(top)
        against = chosen.withColumn("rivals", F.count_if((F.col("key") == head("key")) & (F.col(family) != head(family))).over(top)).where("first")
        found = candidates.select(company).distinct().join(against.select(company, F.col(node).alias("n"), "rivals", "resolved_by"), company, "left")
        status = F.when(F.col("n").isNull(), "unresolved").when(F.col("rivals") > 0, "ambiguous").otherwise("resolved")
        why = F.when(status == "resolved", F.col("resolved_by")).when(status == "ambiguous", AMBIGUOUS).otherwise(UNRESOLVED)
        return written(found.select(company, status.alias("status"), F.when(status == "resolved", F.col("n")).alias("selected"), why.alias("resolved_by")), "resolutions")


# Roles that only lead to a company, and roles that are never one.
DISCOVERY_ONLY = ("directory", "fair_profile", "news", "marketplace", "public_body", "shared_listing")
EXCLUDED_ROLES = ("directory", "fair_profile", "news", "marketplace", "shared_listing", "public_body")


def discovery_key(c: Mapping[str, Column], control: bool = False) -> Column:
    """11 numbers by which candidates are crawled in order; 10 without the rarity of their words, to control the search.

    c: role, discovery_only, score, bridge, pdf (the outbound link's source), ownership, exact_brand,
    public_brand, domain_hits, legal_name, rare, context_matches, official_query, query_trust.
    """
    number = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    company = c["role"] == "company_candidate"
    outbound = company & (c["score"] >= 65) & (c["bridge"] | c["pdf"])
    brand = c["exact_brand"] | c["public_brand"]
    return F.array(
        number(~c["role"].isin(*DISCOVERY_ONLY)), number(~c["discovery_only"] | outbound), c["ownership"], number(company | brand), number(brand | (c["domain_hits"] > 0)),
        c["legal_name"], c["score"], *([] if control else [c["rare"]]), c["context_matches"], c["official_query"], c["query_trust"],
    )


RERANK = (
    "eligible_role", "owner_consistent", "provisionally_publishable", "hard_context_clear", "authoritative_registry", "explicit_relationship", "direct_candidate",
    "conflict_free", "independent_support_count", "strong_first_party_bundle", "first_party_bundle_components", "page_scope_diversity", "context_strength",
    "company_candidate_role", "page_identity_strength", "structured_identity_strength", "legal_full_strength", "legal_phrase_strength", "intrinsic_domain_evidence",
    "official_query_evidence", "metadata_context_matches", "has_contact", "email_gate_clear", "final_score",
)


def evidence_vector(c: Mapping[str, Column]) -> dict[str, Column]:
    """The 24 numbers of RERANK from a crawled candidate.

    c: role, excluded_domain, unmatched_owner, ownership_match, declared_relationship, full_name,
    phrase, publishable, context_failure, origin (the query that found it), discovery_only, conflicts,
    support, strong_bundle, bundle, page_scopes, context, page, structured, full, phrase_strength,
    intrinsic, official_query, context_matches, has_contact, email_failed and score.
    """
    number = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    relation = F.when(c["ownership_match"] | c["declared_relationship"], 4).when(c["full_name"], 3).when(c["phrase"], 2).otherwise(0)
    values = (
        number(~c["role"].isin(*EXCLUDED_ROLES) & ~c["excluded_domain"]), number(~c["unmatched_owner"] | c["ownership_match"]), number(c["publishable"]), number(~c["context_failure"]),
        number(c["origin"].isin("verified_entity", "verified_alias")), relation, number(~c["discovery_only"]), number(c["conflicts"] == 0), c["support"], number(c["strong_bundle"]), c["bundle"],
        F.least(c["page_scopes"], F.lit(4)), c["context"], number(c["role"] == "company_candidate"), c["page"], c["structured"], c["full"], c["phrase_strength"], number(c["intrinsic"]),
        c["official_query"], c["context_matches"], number(c["has_contact"]), number(~c["email_failed"]), c["score"],
    )
    return dict(zip(RERANK, values, strict=True))


def rerank_key(c: Mapping[str, Column], with_score: bool = True) -> Column:
    vector = evidence_vector(c)
    return F.array(*[v.cast("long") for k, v in vector.items() if with_score or k != "final_score"])
