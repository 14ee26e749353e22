"""Fingerprints, routes, ranking keys and resolutions as queries, each with SQL of its own.

Orders of a customer stand for a company's candidates. Their evidence is dealt by arithmetic on
the keys, so that every route and every part of a key decides some rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orgweave.operators import fingerprint as P
from orgweave.plans.catalogue import query, read
from orgweave.sources.shared import spread, written

#: evidence: (x * factor + offset) % modulus < below; strengths: (x // divisor + offset) % modulus
FLAGS = {
    "reachable": (3, 1, 13, 12), "eligible": (5, 2, 17, 16), "conflict_free": (7, 3, 11, 10), "publishable": (11, 1, 3, 2), "first_party": (13, 2, 4, 3),
    "country": (17, 3, 9, 8), "country_phone_only": (19, 1, 3, 1), "exact_domain": (23, 4, 29, 2), "exact_brand": (29, 1, 7, 1), "public_brand": (31, 2, 5, 1),
    "primary_exact": (37, 3, 6, 1), "short_exact": (41, 2, 5, 2), "primary_contextual": (43, 1, 8, 1), "primary_anchored": (47, 2, 5, 2),
    "same_site_contact": (53, 1, 6, 5), "canonical": (59, 3, 7, 6), "has_contact": (61, 2, 5, 4), "intrinsic": (89, 1, 2, 1), "semantic_match": (97, 2, 3, 1),
    "semantic_conflict": (101, 3, 8, 1), "direct": (103, 1, 19, 1), "relationship": (107, 2, 7, 1), "places_phone": (67, 1, 8, 1), "places_business": (71, 2, 7, 1),
    "business_name": (73, 3, 3, 1), "linkedin": (79, 1, 23, 1), "arbiter": (83, 2, 31, 1),
}
STRENGTHS = {"legal": (3, 1, 4), "legal_count": (5, 2, 3), "context_count": (17, 1, 3), "page": (7, 3, 4), "structured": (11, 1, 4), "query": (13, 2, 6)}
_X = "o_orderkey * 7919 // 16 + o_custkey * 31"
_EVIDENCE = (
    f"x0 as (select o_custkey, o_orderkey, o_orderkey % 3 as family, {_X} as x from orders), e as (select o_custkey, o_orderkey, family, x, "
    + ", ".join(f"(x * {f} + {o}) % {m} < {b} as {k}" for k, (f, o, m, b) in FLAGS.items()) + ", "
    + ", ".join(f"((x // {f} + {o}) % {m})::int as {k}" for k, (f, o, m) in STRENGTHS.items()) + " from x0)"
)
# the rules in the SQL's own words
_RULES = """c as (select *, reachable and eligible and conflict_free and country as clear, same_site_contact and canonical and has_contact as site from e),
v as (select *, clear and publishable and first_party as verified, case when exact_domain then 3 when exact_brand or primary_contextual then 2 when primary_exact then 1 else 0 end as specificity from c),
r as (select *, clear and exact_domain and site as r1, clear and exact_domain and canonical and page >= 1 and query >= 1 as r2,
 clear and site and query >= 2 and ((exact_brand and page >= 1) or (public_brand and page >= 2) or (primary_exact and page >= 2) or (primary_anchored and page >= 1 and query >= 3)) as r3,
 clear and first_party and legal >= 3 and page >= 3 and query >= 4 and site as r4, clear and publishable and (places_phone or places_business) and page >= 2 and (places_phone or query >= 2) and site as r5,
 clear and publishable and business_name and page >= 2 and structured >= 2 and query >= 2 and site as r6, clear and business_name and page >= 3 and structured >= 2 and query >= 4 and site as r7,
 clear and publishable and primary_exact and page >= 2 and structured >= 2 and query >= 1 and site as r8, clear and publishable and short_exact and page >= 3 and context_count >= 1 and query >= 4 and site as r9,
 verified and (public_brand or primary_exact or primary_contextual or (business_name and structured >= 2)) and page >= 2 and site as r10, clear and canonical and linkedin as r11,
 reachable and eligible and country and canonical and arbiter and (structured >= 2 or legal >= 2 or same_site_contact or places_phone or places_business or business_name or linkedin) as r12 from v),
s as (select *, not (country_phone_only and legal = 0 and query < 2 and not exact_domain and not r5 and not r10 and not r11 and not r12)
 and (r1 or r2 or r3 or r4 or r5 or r6 or r7 or r8 or r9 or r10 or r11 or r12 or (verified and (legal >= 2 or (public_brand and page >= 2 and site)))) as ready,
 r1 or r2 or r10 or (verified and has_contact and (legal >= 3 or (legal = 2 and legal_count >= 2) or (public_brand and page >= 2 and site))) as anchor_ready,
 [r1::int, r2::int, r3::int, r4::int, r5::int, r6::int, r7::int, r8::int, r9::int, r10::int, r11::int, r12::int, specificity, verified::int, direct::int, -(relationship::int), legal, legal_count, context_count, structured, page,
  public_brand::int, exact_brand::int, intrinsic::int, linkedin::int, has_contact::int, semantic_match::int, -(semantic_conflict::int), query] as key from r)"""


def evidence(spark, d):
    orders = read(spark, d, "orders")
    x = F.floor(F.col("o_orderkey") * 7919 / 16).cast("long") + F.col("o_custkey") * 31
    dealt = orders.select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 3).alias("family"), x.alias("x"))
    flags = [((F.col("x") * f + o) % m < b).alias(k) for k, (f, o, m, b) in FLAGS.items()]
    strengths = [((F.floor(F.col("x") / f) + o) % m).cast("int").alias(k) for k, (f, o, m) in STRENGTHS.items()]
    return dealt.select("o_custkey", "o_orderkey", "family", *flags, *strengths)


_NAMES = ", ".join(f"case when r{i} then '{n}' end" for i, n in enumerate(P.ROUTES, 1))


@query(f"""with {_EVIDENCE}, {_RULES} select o_custkey, o_orderkey, array_to_string(list_filter([{_NAMES}], lambda x: x is not null), ',') as routes from s""")
def safe_routes(spark, d):
    named = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in P.routes(P.columns()).items()]))
    return evidence(spark, d).select("o_custkey", "o_orderkey", F.array_join(named, ",").alias("routes"))


@query(f"""with {_EVIDENCE}, {_RULES} select o_custkey, o_orderkey, verified, specificity, anchor_ready, ready from s""")
def fingerprint_readiness(spark, d):
    e = P.columns()
    return evidence(spark, d).select(
        "o_custkey", "o_orderkey", P.verified_identity(e).alias("verified"), P.domain_specificity(e).alias("specificity"), P.anchor_ready(e).alias("anchor_ready"), P.candidate_ready(e).alias("ready")
    )


@query(f"""with {_EVIDENCE}, {_RULES} select o_custkey, o_orderkey, array_to_string(key, ',') as key, row_number() over (partition by o_custkey order by key desc, o_orderkey) as rank from s""")
def identity_key_rank(spark, d):
    from orgweave.operators import candidates

    keyed = evidence(spark, d).select("o_custkey", "o_orderkey", P.identity_key(P.columns()).alias("key"))
    ranked = candidates.rank_within(keyed, ["o_custkey"], [F.desc("key"), F.asc("o_orderkey")])
    return ranked.select("o_custkey", "o_orderkey", F.array_join("key", ",").alias("key"), F.col("rank").cast("long").alias("rank"))


_PROVED = lambda x: f"({x}.verified and {x}.page >= 1 and {x}.country and {x}.has_contact and not {x}.semantic_conflict)"
_DIMENSIONS = ("legal", "legal_count", "context_count", "structured", "page", "semantic_match", "intrinsic", "has_contact", "query")
_BEATS = (
    "case when a.semantic_conflict <> b.semantic_conflict then not a.semantic_conflict when a.direct <> b.direct then a.direct "
    f"when a.specificity > b.specificity and {_PROVED('a')} then true when a.specificity < b.specificity and {_PROVED('b')} then false when a.r1 <> b.r1 then a.r1 else "
    + " and ".join(f"a.{k} >= b.{k}" for k in _DIMENSIONS) + " and (" + " or ".join(f"a.{k} > b.{k}" for k in _DIMENSIONS) + ") end"
)


@query(f"""with {_EVIDENCE}, {_RULES}, y as (select * from s where ready),
k as (select * from y b where not exists (select 1 from y a where a.o_custkey = b.o_custkey and a.o_orderkey <> b.o_orderkey and a.family <> b.family and {_BEATS})),
f as (select o_custkey, arg_max(family, [key, [-o_orderkey]]) as family, max(key) as best from k group by 1),
g as (select k.o_custkey, count(*) filter (where key = best and k.family <> f.family) as rivals, min(case when key = best and k.family = f.family then o_orderkey end) as n from k join f using (o_custkey) group by 1),
h as (select g.*, case when r1 or r2 then 'candidate_resolved_by_exact_full_name_domain' when r11 then 'candidate_resolved_by_linkedin_website_match' when r12 then 'candidate_resolved_by_llm_arbiter_match' else 'candidate_resolved_by_target_fingerprint' end as why from g join s on g.o_custkey = s.o_custkey and g.n = s.o_orderkey)
select o.o_custkey, case when h.n is null then 'unresolved' when rivals > 0 then 'ambiguous' else 'resolved' end as status, case when rivals = 0 then h.n end as selected,
 case when h.n is null then 'no_candidate_proved_target_fingerprint' when rivals > 0 then 'multiple_candidates_proved_equal_target_fingerprint' else why end as resolved_by
from (select distinct o_custkey from orders) o left join h using (o_custkey)""")
def candidate_resolution(spark, d):
    return P.resolve_candidates(evidence(spark, d), "o_custkey", "o_orderkey", "family")


@query(f"""with {_EVIDENCE}, {_RULES}, q as (select * from s where direct or relationship or places_phone), a as (select * from q where anchor_ready), f as (select o_custkey, max(key) as best from a group by 1),
g as (select o_custkey, arg_min(family, o_orderkey) as family, min(o_orderkey) as n from a join f using (o_custkey) where key = best group by 1),
h as (select o_custkey, g.n, count(*) filter (where a.family <> g.family) as rivals from a join f using (o_custkey) join g using (o_custkey) where key = best group by 1, 2)
select o.o_custkey, case when h.n is null then 'unresolved' when rivals > 0 then 'ambiguous' else 'resolved' end as status, case when rivals = 0 then h.n end as selected from (select distinct o_custkey from q) o left join h using (o_custkey)""")
def profile_anchor_resolution(spark, d):
    """Candidates that profiles name: the best key decides, other owners' equal keys make it ambiguous."""
    e = P.columns()
    named = evidence(spark, d).where(F.col("direct") | F.col("relationship") | F.col("places_phone"))
    keyed = named.select("o_custkey", "o_orderkey", "family", P.anchor_ready(e).alias("ready"), P.identity_key(e).alias("key"))
    keyed = written(keyed, "anchors")  # the rules are long, and what follows reads them twice
    best = keyed.where("ready").groupBy("o_custkey").agg(F.max("key").alias("key"))
    top = keyed.where("ready").join(best, ["o_custkey", "key"]).groupBy("o_custkey").agg(F.min("o_orderkey").alias("n"), F.count_distinct("family").alias("families"))
    status = F.when(F.col("n").isNull(), "unresolved").when(F.col("families") > 1, "ambiguous").otherwise("resolved")
    return named.select("o_custkey").distinct().join(top, "o_custkey", "left").select("o_custkey", status.alias("status"), F.when(status == "resolved", F.col("n")).alias("selected"))


_ROLES = ("company_candidate", "unknown", "directory", "fair_profile", "news", "marketplace", "shared_listing", "public_body")
_ROLE_SQL = "[" + ", ".join(f"'{r}'" for r in _ROLES) + "][((x * 11 + 1) % 8 + 1)::int]"


def _roles(spark, d):
    # dealt by company before the long keys are made: narrow rows travel, and a task sorts no more than its share
    return spread(evidence_x(spark, d), "o_custkey").withColumn("role", F.element_at(F.array(*map(F.lit, _ROLES)), ((F.col("x") * 11 + 1) % 8 + 1).cast("int")))


def evidence_x(spark, d):
    x = F.floor(F.col("o_orderkey") * 7919 / 16).cast("long") + F.col("o_custkey") * 31
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", x.alias("x"))


@query(f"""with x0 as (select o_custkey, o_orderkey, {_X} as x from orders), c as (select *, {_ROLE_SQL} as role, x * 3 % 5 = 0 as discovery_only, (x * 7 % 60 + 40) as score, x * 13 % 4 = 0 as bridge, x * 17 % 5 = 0 as pdf, x * 19 % 2 as ownership,
 x * 23 % 4 = 0 as exact_brand, x * 29 % 3 = 0 as public_brand, x * 31 % 3 as domain_hits, x * 37 % 2 as legal_name, x * 41 % 3 * 4 as rare, x * 43 % 3 as context_matches, x * 47 % 4 as official_query, x * 53 % 3 * 5 as query_trust from x0),
k as (select o_custkey, o_orderkey, [(role in ('company_candidate', 'unknown'))::int, (not discovery_only or (role = 'company_candidate' and score >= 65 and (bridge or pdf)))::int, ownership, (role = 'company_candidate' or exact_brand or public_brand)::int,
 (exact_brand or public_brand or domain_hits > 0)::int, legal_name, score, rare, context_matches, official_query, query_trust]::bigint[] as key from c)
select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by key desc, o_orderkey) as rank, row_number() over (partition by o_custkey order by list_concat(key[1:7], key[9:]) desc, o_orderkey) as control_rank from k""")
def candidate_rank(spark, d):
    from orgweave.operators import candidates

    of = lambda f, m: F.col("x") * f % m
    evidence = {
        "role": F.col("role"), "discovery_only": of(3, 5) == 0, "score": of(7, 60) + 40, "bridge": of(13, 4) == 0, "pdf": of(17, 5) == 0, "ownership": of(19, 2), "exact_brand": of(23, 4) == 0,
        "public_brand": of(29, 3) == 0, "domain_hits": of(31, 3), "legal_name": of(37, 2), "rare": of(41, 3) * 4, "context_matches": of(43, 3), "official_query": of(47, 4), "query_trust": of(53, 3) * 5,
    }
    keyed = _roles(spark, d).select("o_custkey", "o_orderkey", P.discovery_key(evidence).alias("key"), P.discovery_key(evidence, control=True).alias("control"))
    ranked = candidates.rank_within(candidates.rank_within(keyed, ["o_custkey"], [F.desc("key"), F.asc("o_orderkey")]), ["o_custkey"], [F.desc("control"), F.asc("o_orderkey")], "control_rank")
    return ranked.select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"), F.col("control_rank").cast("long").alias("control_rank"))


@query(f"""with x0 as (select o_custkey, o_orderkey, {_X} as x from orders), k as (select o_custkey, o_orderkey, [(({_ROLE_SQL}) in ('company_candidate', 'unknown') and x * 3 % 7 <> 0)::int, (x * 5 % 3 <> 0 or x * 7 % 4 = 0)::int, (x * 11 % 2 = 0)::int, (x * 13 % 5 <> 0)::int,
 (x * 17 % 6 in (0, 1))::int, case when x * 7 % 4 = 0 or x * 19 % 9 = 0 then 4 when x * 23 % 4 = 0 then 3 when x * 29 % 3 = 0 then 2 else 0 end, (x * 31 % 4 <> 0)::int, (x * 37 % 3 = 0)::int, x * 41 % 4, (x * 43 % 2 = 0)::int, x * 47 % 5, least(x * 53 % 7, 4), x * 59 % 4,
 (({_ROLE_SQL}) = 'company_candidate')::int, x * 61 % 4, x * 67 % 4, x * 71 % 4, x * 73 % 4, (x * 79 % 2 = 0)::int, x * 83 % 3, x * 89 % 3, (x * 97 % 2 = 0)::int, (x * 101 % 4 <> 0)::int, x * 103 % 101]::bigint[] as key from x0)
select o_custkey, o_orderkey, array_to_string(key, ',') as key, row_number() over (partition by o_custkey order by key desc, o_orderkey) as rank, row_number() over (partition by o_custkey order by key[1:23] desc, o_orderkey) as non_score_rank from k""")
def rerank_lexicographic(spark, d):
    from orgweave.operators import candidates

    of = lambda f, m: F.col("x") * f % m
    zero = lambda f, m: of(f, m) == 0
    origin = F.element_at(F.array(*map(F.lit, ("verified_entity", "verified_alias", "search", "profile", "hint", "guess"))), (of(17, 6) + 1).cast("int"))
    evidence = {
        "role": F.col("role"), "excluded_domain": zero(3, 7), "unmatched_owner": zero(5, 3), "ownership_match": zero(7, 4), "declared_relationship": zero(19, 9), "full_name": zero(23, 4), "phrase": zero(29, 3),
        "publishable": zero(11, 2), "context_failure": zero(13, 5), "origin": origin, "discovery_only": zero(31, 4), "conflicts": of(37, 3), "support": of(41, 4), "strong_bundle": zero(43, 2), "bundle": of(47, 5),
        "page_scopes": of(53, 7), "context": of(59, 4), "page": of(61, 4), "structured": of(67, 4), "full": of(71, 4), "phrase_strength": of(73, 4), "intrinsic": zero(79, 2), "official_query": of(83, 3),
        "context_matches": of(89, 3), "has_contact": zero(97, 2), "email_failed": zero(101, 4), "score": of(103, 101),
    }
    keyed = _roles(spark, d).select("o_custkey", "o_orderkey", P.rerank_key(evidence).alias("key"), P.rerank_key(evidence, with_score=False).alias("bare"))
    ranked = candidates.rank_within(candidates.rank_within(keyed, ["o_custkey"], [F.desc("key"), F.asc("o_orderkey")]), ["o_custkey"], [F.desc("bare"), F.asc("o_orderkey")], "non_score_rank")
    return ranked.select("o_custkey", "o_orderkey", F.array_join("key", ",").alias("key"), F.col("rank").cast("long").alias("rank"), F.col("non_score_rank").cast("long").alias("non_score_rank"))
