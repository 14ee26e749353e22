"""Discovery's gaps, ends, selections, guards, sources and caches as queries with SQL of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from orgweave.operators import discovery as D
from orgweave.plans.name_queries import _ALL, _CASES, _FOLD, _L, _MARKERS, _PHRASE, _cases, _customers
from orgweave.plans.catalogue import query, read
from orgweave.plans.registry_queries import _S

_ROLES = ("company_candidate", "unknown", "directory", "news")
_ROLE = "['company_candidate', 'unknown', 'directory', 'news'][(o_orderkey % 4 + 1)::int]"
_k = lambda: F.col("o_orderkey")


def _role():
    return F.element_at(F.array(*map(F.lit, _ROLES)), (_k() % 4 + 1).cast("int"))


@query(f"""with c as (select o_custkey, o_orderkey, {_ROLE} as role, o_orderkey % 7 = 0 as excluded, o_orderkey // 5 % 60 + 40 as score, o_orderkey % 6 = 1 as intrinsic, o_orderkey % 8 = 1 as legal, o_orderkey % 10 = 1 as local, o_custkey % 5 = 0 as short_brand, o_custkey % 7 = 0 as hints from orders),
f as (select *, role in ('company_candidate', 'unknown') and not excluded as fit from c), r as (select *, row_number() over (partition by o_custkey order by fit desc, score desc, o_orderkey) as n from f),
g as (select o_custkey, count(*) filter (where fit) as n, max(score) filter (where n = 1 and fit) as s1, max(score) filter (where n = 2 and fit) as s2, bool_or(short_brand) as short, bool_or(fit and intrinsic) as i, bool_or(fit and legal) as l, bool_or(fit and local) as o, bool_or(hints) as h from r group by 1)
select o_custkey, array_to_string(list_filter([case when n = 0 then 'no_candidates' end, case when coalesce(abs(s1 - s2) <= 5, false) or (short and n > 0) then 'ambiguous_candidates' end, case when not i then 'missing_intrinsic_domain' end, case when not l then 'missing_legal_name' end,
 case when not o then 'missing_local_signal' end, case when h then 'relationship_hint' end], lambda x: x is not null), ',') as gaps from g""")
def discovery_gaps(spark, d):
    c = read(spark, d, "orders").select(
        "o_custkey", "o_orderkey", _role().alias("role"), (_k() % 7 == 0).alias("excluded"), (F.floor(_k() / 5) % 60 + 40).alias("score"), (_k() % 6 == 1).alias("intrinsic"), (_k() % 8 == 1).alias("legal"),
        (_k() % 10 == 1).alias("local"), (F.col("o_custkey") % 5 == 0).alias("short_brand"), (F.col("o_custkey") % 7 == 0).alias("hints"),
    )
    return D.gaps(c, "o_custkey", [F.desc("score"), F.asc("o_orderkey")]).select("o_custkey", F.array_join("gaps", ",").alias("gaps"))


@query(f"""with c as (select o_orderkey, ['verified_alias', 'verified_entity', 'source_profile', 'search', 'search', 'search', 'search'][(o_orderkey // 4 % 7 + 1)::int] as origin, {_ROLE} as role, o_orderkey % 3 = 0 as ident, o_orderkey // 3 % 4 as official, o_orderkey // 7 % 3 = 0 as exact_brand, 1 + o_orderkey // 11 % 2 as words,
 1 + o_orderkey // 13 % 3 as legal_words, o_orderkey // 17 % 2 = 0 as contexts, o_orderkey // 19 % 2 as matches, o_orderkey // 23 % 2 = 0 as legal from orders)
select o_orderkey, case when origin in ('verified_alias', 'verified_entity') then true when origin = 'source_profile' then false else (role = 'company_candidate' or ident) and official > 0 and (exact_brand or official >= 2) and not (words = 1 and ((contexts and matches = 0) or (legal_words > 1 and not legal))) end as stop,
 role not in ('directory', 'news') and (60 + o_orderkey % 9 >= 65 or (role = 'company_candidate' and official >= 3 and exact_brand)) as selectable from c""")
def early_stop_and_selection(spark, d):
    part = lambda n, m: F.floor(_k() / n) % m
    origin = F.element_at(F.array(*map(F.lit, ("verified_alias", "verified_entity", "source_profile", "search", "search", "search", "search"))), (part(4, 7) + 1).cast("int"))
    c = {
        "origin": origin, "role": _role(), "identity": _k() % 3 == 0, "official": part(3, 4), "exact_brand": part(7, 3) == 0, "brand_words": 1 + part(11, 2), "legal_words": 1 + part(13, 3),
        "has_contexts": part(17, 2) == 0, "context_matches": part(19, 2), "legal": part(23, 2) == 0,
    }
    return read(spark, d, "orders").select("o_orderkey", D.can_stop(c).alias("stop"), D.selectable(_role(), 60 + _k() % 9, c["official"], c["exact_brand"]).alias("selectable"))


@query("""with c as (select o_orderkey, o_orderkey % 3 <> 0 as failed, o_orderkey // 3 % 7 = 0 as arbiter, o_orderkey // 5 % 2 = 0 as conflict, o_orderkey // 7 % 2 + 1 as words, o_orderkey // 11 % 2 = 0 as exact_brand, o_orderkey // 13 % 3 <> 0 as legal, o_orderkey // 17 % 4 = 0 as bundle, o_orderkey // 19 % 4 = 0 as listed, o_orderkey // 23 % 4 = 0 as trusted,
 o_orderkey // 29 % 2 = 0 as explicit from orders), h as (select *, case when not failed or arbiter then false when conflict then not (words = 2 and exact_brand and legal) when bundle or listed then false else true end as hard from c)
select o_orderkey, hard, hard and not trusted and (not exact_brand or (words = 1 and explicit)) as unsafe from h""")
def context_guards(spark, d):
    part = lambda n, m: F.floor(_k() / n) % m
    words = part(7, 2) + 1
    c = {
        "failed": _k() % 3 != 0, "arbiter_match": part(3, 7) == 0, "conflict": part(5, 2) == 0, "compound": words == 2, "exact_brand": part(11, 2) == 0, "legal_proof": part(13, 3) != 0, "strong_bundle": part(17, 4) == 0,
        "discovery_only": part(19, 4) == 0, "trusted": part(23, 4) == 0, "brand_words": words, "explicit_context": part(29, 2) == 0,
    }
    return read(spark, d, "orders").select("o_orderkey", D.hard_context_failure(c).alias("hard"), D.unsafe_context(c).alias("unsafe"))


_OWNED = f"len(legal) > 0 and len(list_filter({_L(_MARKERS)}, lambda m: contains(words, m) and contains(substr(words, greatest(instr(words, m) - 241, 0) + 1, instr(words, m) + 239 - greatest(instr(words, m) - 241, 0)), array_to_string(legal[1:4], ' ')))) > 0"


@query(f"""with {_CASES}, a as (select *, coalesce(business, '') || ' ' || coalesce(body, '') as said, {_FOLD("coalesce(business, '') || ' ' || coalesce(body, '')")} as folded, regexp_split_to_array({_FOLD('business')}, '\\s+') as title_words, regexp_split_to_array({_FOLD('title')}, '\\s+') as path_words from t3),
b as (select *, regexp_extract_all(folded, '[a-z0-9]+') as said_raw from a), c as (select *, array_to_string(said_raw, ' ') as words, list_filter(said_raw, lambda t: length(t) > 1 and not list_contains({_L('ltd sti san sanayi tic ticaret anonim limited as co inc gmbh ve and sirket sirketi'.split())}, t)) as said_legal,
 len(prim) > 0 and (len(prim) >= 2 or length(prim[1]) >= 5) as enough from b),
r as (select k, ({_OWNED}) or (({_PHRASE('b_legal', 'legal[1:4]')} or (enough and (len(list_filter(prim, lambda t: list_contains(title_words, t))) = len(prim) or len(list_filter(prim, lambda t: list_contains(path_words, t))) = len(prim))))
 and ({_PHRASE('said_legal', 'legal[1:4]')} or (enough and len(list_filter(prim, lambda t: contains(' ' || folded || ' ', ' ' || t || ' '))) = len(prim)))) as supported from c)
select c_custkey, supported from {_ALL}""")
def bridge_identity(spark, d):
    return _customers(spark, d, _cases(spark, d).select("k", D.bridge_supported("company", "business", "body", "title").alias("supported")))


@query("""with u as (select o_custkey, o_orderkey % 40 as domain, 'alias' || (o_orderkey % 9) as reason, 70 as score, 0 as p from orders where o_orderkey % 5 = 0 union all select o_custkey, o_orderkey % 40, 'search' || (o_orderkey % 9), 40 + o_orderkey % 50, 1 from orders where o_orderkey % 2 = 0
union all select o_custkey, o_orderkey % 40, 'guess', 30, 2 from orders) select o_custkey, domain, (min([p::varchar, reason]))[2] as reason, max(score) as score, min(p) as source, count(distinct p) as n_sources from u group by 1, 2""")
def discovery_source_union(spark, d):
    o = read(spark, d, "orders")
    of = lambda where, reason, score: o.where(where).select("o_custkey", (_k() % 40).alias("domain"), reason.alias("reason"), score.cast("long").alias("score"))
    sources = [of(_k() % 5 == 0, _S("alias", _k() % 9), F.lit(70)), of(_k() % 2 == 0, _S("search", _k() % 9), 40 + _k() % 50), of(F.lit(True), F.lit("guess"), F.lit(30))]
    return D.meet_sources(sources, ["o_custkey", "domain"], "score", "reason")


@query("""with r as (select c_custkey, c_name, case when c_custkey % 2 = 0 then 'old' else '' end as phone from customer), e as (select c_custkey as k, case when c_custkey % 3 = 0 then upper(replace(c_name, '#', ' - ')) when c_custkey % 3 = 1 then 'Other ' || c_custkey else null end as name, case when c_custkey % 4 = 0 then null when c_custkey % 4 = 1 then '' else 'tel' || c_custkey end as phone from customer where c_custkey % 5 <> 0)
select c_custkey, case when k % 3 = 0 and e.phone <> '' then e.phone else r.phone end as phone from r left join e on c_custkey = k""")
def profile_enrichment(spark, d):
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    rows = c.select("c_custkey", F.col("c_name").alias("company"), F.when(k % 2 == 0, "old").otherwise("").alias("phone"))
    name = F.when(k % 3 == 0, F.upper(F.regexp_replace("c_name", "#", " - "))).when(k % 3 == 1, _S("Other ", k))
    details = c.where(k % 5 != 0).select("c_custkey", name.alias("company"), F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "").otherwise(_S("tel", k)).alias("phone"))
    return D.enrich(rows, details, "c_custkey", "company", ["phone"]).select("c_custkey", "phone")


@query("""with q as (select o_orderkey, 'site' || (o_custkey % 300) || '/p' as key from orders), e as (select event_id as entry_id, 'site' || (user_id % 250) || case when event_id % 4 = 0 then '/q' else '/p' end as key, event_id % 3 = 0 as legacy, event_id % 5 as version from events),
x as (select key, entry_id, case when not legacy and version = 4 then 0 when legacy and version = 4 then 1 else 2 end as step, version from e), b as (select key, min([step, -version, -entry_id]) as b from x group by 1), n as (select substr(key, 1, 7) as p, max(entry_id) as near from e group by 1)
select o_orderkey, coalesce(b[1], case when near is not null then 3 end) as step, coalesce(-b[3], near) as entry_id from q left join b using (key) left join n on substr(q.key, 1, 7) = n.p""")
def crawl_source_cascade(spark, d):
    requests = read(spark, d, "orders").select("o_orderkey", _S("site", F.col("o_custkey") % 300, "/p").alias("key"))
    e = F.col("event_id")
    entries = read(spark, d, "events").select(F.concat(_S("site", F.col("user_id") % 250), F.when(e % 4 == 0, "/q").otherwise("/p")).alias("key"), (e % 3 == 0).alias("legacy"), (e % 5).cast("int").alias("version"), e.alias("entry_id"))
    return D.cached_source(requests, entries, "key", 4, 7).select("o_orderkey", "step", "entry_id")


@query("""with p as (select o_custkey, max(o_orderkey) as best from orders where o_totalprice > 100000 group by 1) select c_custkey, case when c_custkey % 4 = 0 then 'https://known' || c_custkey || '.com' else 'order' || best end as website, case when c_custkey % 4 = 0 then 'known_website' when best is null then 'not_found' else 'searched' end as route
from customer left join p on c_custkey = o_custkey""")
def known_website_fast_path(spark, d):
    """Companies with a known site take it and never meet the search; the others are joined with what the search found."""
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    known = c.where(k % 4 == 0).select("c_custkey", _S("https://known", k, ".com").alias("website"), F.lit("known_website").alias("route"))
    found = read(spark, d, "orders").where("o_totalprice > 100000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("best"))
    rest = c.where(k % 4 != 0).select("c_custkey").join(found, "c_custkey", "left")
    return known.unionByName(rest.select("c_custkey", F.concat(F.lit("order"), F.col("best").cast("string")).alias("website"), F.when(F.col("best").isNull(), "not_found").otherwise("searched").alias("route")))
