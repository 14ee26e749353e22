"""Registries, resolvers, memory, relationships, selections and evidence as queries, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from orgweave.functions import evidence as E
from orgweave.functions import text as T
from orgweave.functions import url as U
from orgweave.operators import graph
from orgweave.operators import registries as R
from orgweave.operators import state
from orgweave.plans.name_queries import _FOLD, _LETTERS, _SPELT, _TEXT, own_word, spelt
from orgweave.plans.catalogue import query, read

_HOST_OF = lambda x: f"regexp_replace(regexp_extract(lower(trim(coalesce({x}, ''))), '^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]+)', 1), '^www\\.', '')"
_S = lambda *parts: F.concat(*[F.lit(p) if not hasattr(p, "cast") else p.cast("string") for p in parts])


@query(f"""with r as (select s_suppkey as k, s_name as n1, null as n2, 'https://www.a' || s_suppkey || '.example' as url, s_suppkey % 3 <> 0 as ok, 'company_aliases' as source, 'official' as relationship, 0 as place from supplier
union all select s_suppkey, s_name, 'Alias ' || s_suppkey, case when s_suppkey % 2 = 0 then 'http://A' || s_suppkey || '.EXAMPLE/x' else 'e' || s_suppkey || '.example' end, s_suppkey % 5 <> 0, 'entity_registry', 'brand', 1 from supplier
union all select s_suppkey, s_name, null, case when s_suppkey % 4 = 0 then 'o' || s_suppkey || '.gov.example' else '' end, s_suppkey % 8 <> 0, 'official_government_registry', 'official_registry_identity', 2 from supplier),
n as (select trim(lower(name)) as key, {_HOST_OF('url')} as domain, source, relationship, place from (select unnest([n1, n2]) as name, * from r where ok) where name is not null),
c as (select distinct case when s_suppkey % 7 = 0 then 'ALIAS ' || s_suppkey else ' ' || upper(s_name) end as company from supplier)
select company, domain, arg_max(source, place) as source, arg_max(relationship, place) as relationship from c join n on trim(lower(company)) = key where domain <> '' group by 1, 2""")
def registry_websites(spark, d):
    """Suppliers asked by name or alias in three registries: hand-made aliases, entities, official ones."""
    s, k = read(spark, d, "supplier"), F.col("s_suppkey")
    form = lambda names, url, ok, source, relation: s.select(names.alias("names"), url.alias("url"), ok.alias("verified"), F.lit(source).alias("source"), F.lit(relation).alias("relationship"))
    aliases = form(F.array("s_name"), _S("https://www.a", k, ".example"), k % 3 != 0, "company_aliases", "official")
    entities = form(F.array(F.col("s_name"), _S("Alias ", k)), F.when(k % 2 == 0, _S("http://A", k, ".EXAMPLE/x")).otherwise(_S("e", k, ".example")), k % 5 != 0, "entity_registry", "brand")
    official = form(F.array("s_name"), F.when(k % 4 == 0, _S("o", k, ".gov.example")).otherwise(""), k % 8 != 0, R.OFFICIAL_CLASSES[0], "official_registry_identity")
    companies = s.select(F.when(k % 7 == 0, _S("ALIAS ", k)).otherwise(_S(" ", F.upper("s_name"))).alias("company"))
    return R.verified_websites(companies, "company", [aliases, entities, official])


@query("""with o as (select 'Customer ' || (o_custkey % 200) as company, 'https://www.c' || (o_custkey % 50) || '.com.tr/x' as website, case when o_orderstatus = 'F' then 'OK_HIGH' when o_orderstatus = 'O' then 'OK_MEDIUM' else 'REVIEW_NEEDED' end as status,
 case o_orderkey % 3 when 0 then 'candidate_resolved_by_x' when 1 then 'profile_route_resolved_by_y' else 'manual' end as resolution, (o_orderkey % 5 = 0)::int as conflicts, case when o_orderkey % 2 = 0 then 'http://shop.c' || (o_custkey % 50) || '.com.tr/contact' else 'http://other.com' end as email_source,
 case when o_orderkey % 7 = 0 then 'https://c' || (o_custkey % 50) || '.com.tr/tel' end as phone_source, o_orderkey as seen_at from orders),
f as (select company, 'c' || substr(website, 14, length(website) - 22) || '.com.tr' as domain, resolution, seen_at, 1 as fresh from o where status like 'OK_%' and resolution <> 'manual' and conflicts = 0 and (email_source like 'http://shop%' or phone_source is not null)),
m as (select upper('customer ' || (c_custkey % 300)) as company, 'c' || (c_custkey % 50) || '.com.tr' as domain, 'remembered' as resolution, c_custkey as seen_at, 0 as fresh from customer), b as (select * from m union all select * from f),
r as (select *, row_number() over (partition by lower(company), domain order by fresh desc, seen_at desc, company desc, resolution desc) as n from b) select company, domain, resolution, seen_at from r where n = 1""")
def entity_memory_upsert(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    site, k = F.col("o_custkey") % 50, F.col("o_orderkey")
    rows = o.select(
        _S("Customer ", F.col("o_custkey") % 200).alias("company"), _S("https://www.c", site, ".com.tr/x").alias("website"),
        F.when(F.col("o_orderstatus") == "F", "OK_HIGH").when(F.col("o_orderstatus") == "O", "OK_MEDIUM").otherwise("REVIEW_NEEDED").alias("status"),
        F.when(k % 3 == 0, "candidate_resolved_by_x").when(k % 3 == 1, "profile_route_resolved_by_y").otherwise("manual").alias("resolution"), (k % 5 == 0).cast("int").alias("conflicts"),
        F.when(k % 2 == 0, _S("http://shop.c", site, ".com.tr/contact")).otherwise("http://other.com").alias("email_source"), F.when(k % 7 == 0, _S("https://c", site, ".com.tr/tel")).alias("phone_source"), k.alias("seen_at"),
    )
    memory = c.select(F.upper(_S("customer ", F.col("c_custkey") % 300)).alias("company"), _S("c", F.col("c_custkey") % 50, ".com.tr").alias("domain"), F.lit("remembered").alias("resolution"), F.col("c_custkey").alias("seen_at"))
    return R.remember(memory, rows)


_BAD = "list_contains(['linkedin.com', 'facebook.com'], domain) or ends_with(domain, '.linkedin.com') or ends_with(domain, '.de') or not contains(domain, '.') or ends_with(domain, '.php')"


@query(f"""with a as (select o_custkey as company, case when o_orderkey % 2 = 0 then 'brand_api' else 'mail_api' end as provider, {_HOST_OF("case o_orderkey % 9 when 0 then 'https://www.linkedin.com/x' when 1 then 'tr.linkedin.com' when 2 then 'shop.de' when 3 then 'index.php' when 4 then 'nodot' else 'HTTPS://www.d' || (o_orderkey % 23) || '.com/a' end")} as domain,
 (o_orderkey % 100)::int as rank, o_orderkey % 6 = 0 as claimed, o_orderkey % 5 <> 0 as compatible from orders), c as (select * from a where not ({_BAD})),
f as (select company, provider, domain, min([rank, claimed::int, compatible::int]) as f from c group by all), k as (select *, row_number() over (partition by company, provider order by f[1], domain) as n from f)
select company, domain, array_to_string(list_sort(list(distinct provider)), ',') as providers, max(f[2]) = 1 as claimed, min(f[1]) as rank from k where n <= 3 and f[3] = 1 group by 1, 2""")
def resolver_provider_union(spark, d):
    k = F.col("o_orderkey")
    hosts = ("https://www.linkedin.com/x", "tr.linkedin.com", "shop.de", "index.php", "nodot")
    domain = _S("HTTPS://www.d", k % 23, ".com/a")
    for i, h in reversed(list(enumerate(hosts))):
        domain = F.when(k % 9 == i, h).otherwise(domain)
    answers = read(spark, d, "orders").select(F.col("o_custkey").alias("company"), F.when(k % 2 == 0, "brand_api").otherwise("mail_api").alias("provider"), domain.alias("domain"), (k % 100).cast("int").alias("rank"), (k % 6 == 0).alias("claimed"), (k % 5 != 0).alias("compatible"))
    return R.resolver_union(answers, "company", 3)


_KINDS = ("brand", "parentOrganization", "employee", "branchOf", "memberOf", "distributor", "sameAs")
_CLAIMS = f"""c as (select 's' || l_suppkey || case when l_suppkey % 3 = 0 then '.com.tr' else '.com' end as domain, [{', '.join(f"'{k}'" for k in _KINDS)}][(l_orderkey % 7 + 1)::int] as kind, case when l_linenumber % 5 = 0 then '' else 'p' || (l_partkey % 40) || '.com' end as target from lineitem),
e as (select distinct least(domain, target) as a, greatest(domain, target) as b, 'first_party_' || kind as kind from c where target <> '' and kind not in ('employee', 'sameAs') and domain <> target)"""


def _claims(spark, d):
    l = read(spark, d, "lineitem")  # noqa: E741
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("l_orderkey") % 7 + 1).cast("int"))
    domain = _S("https://www.s", F.col("l_suppkey"), F.when(F.col("l_suppkey") % 3 == 0, ".com.tr").otherwise(".com"))
    return l.select(domain.alias("domain"), kind.alias("kind"), F.when(F.col("l_linenumber") % 5 == 0, "").otherwise(_S("P", F.col("l_partkey") % 40, ".com/about")).alias("url"))


@query(f"with {_CLAIMS} select * from e")
def relationship_edges(spark, d):
    return R.typed_edges(_claims(spark, d))


@query("""with l as (select distinct 'x.s' || (l_suppkey % 11) || '.com' as a, 'p' || (l_partkey % 13) || '.com' as b, l_suppkey % 11 = l_partkey % 13 as linked from lineitem),
p as (select a, b, linked from l union select distinct a, substr(a, 3), true from l union select distinct substr(a, 3), b, false from l union select distinct b, 'shop.' || b, true from l) select a, b, bool_or(linked) as same from p group by 1, 2""")
def official_family(spark, d):
    """Pairs of sites that lines bring together: one family by registrable domain, or by a component of those that are joined."""
    n, m = F.col("l_suppkey") % 11, F.col("l_partkey") % 13
    lines = read(spark, d, "lineitem").select(_S("x.s", n, ".com").alias("a"), _S("p", m, ".com").alias("b"), (n == m).alias("linked")).distinct()
    short = F.expr("substr(a, 3)")
    pairs = lines.select("a", "b").union(lines.select("a", short)).union(lines.select(short, "b")).union(lines.select("b", _S("shop.", F.col("b")))).distinct()
    return R.same_family(pairs, graph.components(lines.where("linked").select("a", "b")))


_CLASS = "['official_government_registry', 'government_company_registry', 'chamber', 'directory'][(s_suppkey % 4 + 1)::int]"


@query(f"""with r as (select *, {_CLASS} as cls, case when s_suppkey % 5 = 0 then 'pending' else 'verified' end as state from supplier), n as (select s_suppkey, unnest([s_name, 'Alias ' || (s_suppkey % 40)]) as name from r where cls in ('official_government_registry', 'government_company_registry') and state = 'verified')
select c.company, n.s_suppkey as record, 'r' || n.s_suppkey || '.com.tr' as domain, 'mersis:' || n.s_suppkey as identifiers from (select distinct upper('alias ' || (c_custkey % 60)) as company from customer union select s_name from supplier) c join (select distinct s_suppkey, lower(trim(name)) as k from n) n on lower(trim(c.company)) = n.k""")
def official_registry_records(spark, d):
    """Records of official registries by exact names; other classes of sources and unverified records say nothing."""
    k = F.col("s_suppkey")
    classes = F.array(*map(F.lit, (*R.OFFICIAL_CLASSES, "chamber", "directory")))
    records = read(spark, d, "supplier").select(
        k.alias("record"), F.element_at(classes, (k % 4 + 1).cast("int")).alias("source_class"), F.when(k % 5 == 0, "pending").otherwise("verified").alias("verification_status"), F.col("s_name").alias("legal_name"),
        F.array(_S("Alias ", k % 40)).alias("aliases"), _S("https://www.r", k, ".com.tr/kurumsal").alias("official_domain"), F.array(_S("mersis:", k)).alias("identifiers"),
    )
    companies = read(spark, d, "customer").select(F.upper(_S("alias ", F.col("c_custkey") % 60)).alias("company")).union(read(spark, d, "supplier").select("s_name")).distinct()
    found = R.official_records(companies, records)
    return found.select("company", "record", "domain", F.array_join("identifiers", ",").alias("identifiers"))


@query("""with s as (select user_id, event_id, ts, case event_type when 'purchase' then 'available' when 'error' then 'server_error' when 'view' then 'circuit_open' else 'not_found' end as st from events),
r as (select *, sum((st <> 'circuit_open')::int) over w as attempts, sum((st = 'available')::int) over w as successes from s window w as (partition by user_id order by ts, event_id rows unbounded preceding)),
e as (select *, sum((st = 'server_error')::int) over (partition by user_id, successes order by ts, event_id rows unbounded preceding) as errors from r)
select event_id, attempts::bigint as attempts, successes::bigint as successes, errors::bigint as server_errors, errors >= 2 as circuit_open, case when errors >= 2 and st = 'server_error' then 'degraded' else st end as health from e""")
def source_health_circuit(spark, d):
    t = F.col("event_type")
    status = F.when(t == "purchase", "available").when(t == "error", "server_error").when(t == "view", "circuit_open").otherwise("not_found")
    out = R.source_health(read(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"], status)
    return out.select("event_id", "attempts", "successes", "server_errors", "circuit_open", "health")


@query("""with r as (select case when c_custkey % 10 = 0 then '  ' else upper(c_mktsegment) || (c_custkey % 70) end as company, c_custkey, case c_custkey % 4 when 0 then 'REVIEW_NEEDED' when 1 then 'WEBSITE_NOT_FOUND' when 2 then 'OK_HIGH' else 'WEBSITE_AMBIGUOUS' end as status from customer union all
 select lower(c_mktsegment) || (c_custkey % 70), c_custkey + 1000000, 'REVIEW_NEEDED' from customer where c_custkey % 3 = 0),
w as (select *, row_number() over (partition by lower(trim(company)) order by c_custkey) as n from r where trim(company) <> '' and status in ('REVIEW_NEEDED', 'WEBSITE_NOT_FOUND'))
select trim(company) as company, 'retry_' || lower(status) as source, '' as website from w where n = 1""")
def retry_input(spark, d):
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    status = F.when(k % 4 == 0, "REVIEW_NEEDED").when(k % 4 == 1, "WEBSITE_NOT_FOUND").when(k % 4 == 2, "OK_HIGH").otherwise("WEBSITE_AMBIGUOUS")
    first = c.select(F.when(k % 10 == 0, "  ").otherwise(_S(F.upper("c_mktsegment"), k % 70)).alias("company"), k.alias("n"), status.alias("status"))
    again = c.where(k % 3 == 0).select(_S(F.lower("c_mktsegment"), k % 70).alias("company"), (k + 1000000).alias("n"), F.lit("REVIEW_NEEDED").alias("status"))
    return R.retry_rows(first.unionByName(again), ("REVIEW_NEEDED", "WEBSITE_NOT_FOUND"), False, [F.asc("n")])


@query("""with p as (select distinct lower(o_orderpriority || (o_custkey % 97)) as k, case when o_totalprice > 250000 then 'OK_HIGH' else 'review_needed' end as s from orders where o_orderstatus <> 'F')
select c_custkey from customer where lower(c_mktsegment) in ('building', 'machinery', 'automobile') and exists (select 1 from p where k = lower('1-Urgent' || (c_custkey % 97)) and s in ('ok_high', 'OK_HIGH'))""")
def company_selection(spark, d):
    """Companies by name and by the status of the run before; neither cares for case."""
    c = read(spark, d, "customer").withColumn("company", F.col("c_mktsegment"))
    named = R.select_companies(c, names=spark.createDataFrame([("Building",), ("MACHINERY",), ("automobile",)], "company string"))
    status = F.when(F.col("o_totalprice") > 250000, "OK_HIGH").otherwise("review_needed")
    previous = read(spark, d, "orders").where("o_orderstatus <> 'F'").select(_S(F.col("o_orderpriority"), F.col("o_custkey") % 97).alias("company"), status.alias("status"))
    keyed = named.withColumn("company", _S("1-Urgent", F.col("c_custkey") % 97))
    return R.select_companies(keyed, previous=previous, statuses=("ok_HIGH",)).select("c_custkey")


@query("""select o_orderkey from orders where not coalesce(o_orderkey % 11 = 0, false) and (case o_orderkey % 5 when 0 then 'REVIEW_NEEDED' when 1 then 'WEBSITE_AMBIGUOUS' when 2 then 'OK_HIGH' when 3 then 'OK_LOW' end in ('REVIEW_NEEDED', 'WEBSITE_NOT_FOUND', 'WEBSITE_AMBIGUOUS', 'WEBSITE_FETCH_FAILED') or o_orderpriority = '5-LOW')""")
def paid_escalation(spark, d):
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 0, "REVIEW_NEEDED").when(k % 5 == 1, "WEBSITE_AMBIGUOUS").when(k % 5 == 2, "OK_HIGH").when(k % 5 == 3, "OK_LOW")
    reason = F.when(F.col("o_orderpriority") == "5-LOW", "no_candidate_proved_target_fingerprint").otherwise("other")
    return read(spark, d, "orders").where(R.needs_paid_search(status, reason, k % 11 == 0)).select("o_orderkey")


@query("""with e as (select o_custkey, o_orderkey, o_orderkey % 3 <> 0 as publishable, o_orderkey % 4 = 0 as profile, (o_orderkey % 5) as legal from orders), p as (select * from e where publishable),
g as (select o_custkey, count(*) filter (where profile) as n, max(o_orderkey) filter (where profile) as o_orderkey, max(legal) filter (where profile) as own, max(legal) filter (where not profile) as rival from p group by 1)
select o_custkey, o_orderkey from g where n = 1 and own >= 2 and (rival is null or own > rival)""")
def preferred_discovery_route(spark, d):
    k = F.col("o_orderkey")
    e = read(spark, d, "orders").select("o_custkey", "o_orderkey", (k % 3 != 0).alias("publishable"), (k % 4 == 0).alias("from_profile"), (k % 5).alias("legal"))
    return R.preferred_route(e, "o_custkey", "o_orderkey")


_TLDS = ["com", "com.tr", "net", "org"]


@query("""with e as (select o_custkey, o_orderkey, 'acme' || (o_orderkey % 4) || '.' || ['com', 'com.tr', 'net', 'org'][(o_orderkey // 4 % 4 + 1)::int] as domain, 'acme' || (o_orderkey % 4) as core, o_orderkey % 3 = 0 as reachable, o_orderkey % 5 <> 0 as ident, case when o_orderkey % 7 <> 0 then 'company_candidate' else 'news' end as role, 60 + o_orderkey % 40 as score from orders),
s as (select o_custkey, arg_max(domain, [score, o_orderkey]) as domain, arg_max(core, [score, o_orderkey]) as core, max([score, o_orderkey])[2] % 6 = 0 as settled from e where reachable group by 1)
select s.o_custkey, s.domain, min(e.domain) as other from s join e on s.o_custkey = e.o_custkey and s.core = e.core and s.domain <> e.domain where not settled and not reachable and ident and role = 'company_candidate' and score >= 75 group by 1, 2""")
def unreachable_homonyms(spark, d):
    k = F.col("o_orderkey")
    tld = F.element_at(F.array(*map(F.lit, _TLDS)), (F.floor(k / 4) % 4 + 1).cast("int"))
    e = read(spark, d, "orders").select("o_custkey", "o_orderkey", _S("acme", k % 4, ".", tld).alias("domain"), (k % 3 == 0).alias("reachable"), (k % 5 != 0).alias("identity"), F.when(k % 7 != 0, "company_candidate").otherwise("news").alias("role"), (60 + k % 40).alias("score"))
    best = F.max(F.struct("score", "o_orderkey", "domain"))
    selected = e.where("reachable").groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.domain", (F.col("b.o_orderkey") % 6 == 0).alias("settled"))
    return R.unreachable_homonyms(selected, e, "o_custkey")


@query("""with s as (select o_custkey, o_orderkey, floor(o_totalprice / 20000)::bigint as score, o_orderkey % 2 as support, o_orderkey % 3 as domain, o_orderkey % 5 as family, o_orderkey % 7 = 0 or o_orderkey % 11 = 0 as settled from orders),
p as (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from s), q as (select * from p where n <= 4)
select a.o_custkey, a.o_orderkey as first, b.o_orderkey as second from q a join q b on a.o_custkey = b.o_custkey and a.n < b.n and a.support = b.support and a.domain <> b.domain and abs(a.score - b.score) <= 5
where a.family <> b.family and not a.settled and not b.settled""")
def close_margin_pairs(spark, d):
    """All pairs of a customer's first four orders whose scores leave the choice open: of two families, neither by an authoritative query nor in conflict."""
    k = F.col("o_orderkey")
    s = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 20000).alias("score"), (k % 2).alias("support"), (k % 3).alias("domain"), (k % 5).alias("family"), ((k % 7 == 0) | (k % 11 == 0)).alias("settled"))
    return R.close_pairs(s, ["o_custkey"], "o_orderkey", "score", "support", "domain", family="family", settled="settled")


@query("""with e as (select o_custkey, o_orderkey, case when o_orderkey % 4 = 0 then null when o_orderkey % 9 = 0 then '' else 'sales@c' || (o_orderkey % 6) || '.com' end as v from orders), s as (select * from e where v <> ''), b as (select o_custkey, arg_min(v, o_orderkey) as "primary" from s group by 1),
o as (select distinct s.o_custkey, v from s join b on s.o_custkey = b.o_custkey and v <> "primary"), l as (select o_custkey, string_agg(v, ',' order by v) as alternatives from o group by 1)
select b.o_custkey, "primary", coalesce(alternatives, '') as alternatives from b left join l using (o_custkey)""")
def family_contact_merge(spark, d):
    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(k % 4 == 0, F.lit(None)).when(k % 9 == 0, "").otherwise(_S("sales@c", k % 6, ".com")).alias("email"))
    return R.merge_family_contacts(rows, ["o_custkey"], [F.asc("o_orderkey")], "email")


@query("""with l as (select l_suppkey, 'q' || (l_partkey % 60) || '.com' as domain from lineitem where l_partkey % 5 <> 0), k as (select distinct l_suppkey, 'q' || (l_orderkey % 60) || '.com' as domain from lineitem where l_returnflag = 'R'), n as (select l_suppkey, domain, count(*) as n from l group by 1, 2),
f as (select * from n where not exists (select 1 from k where k.l_suppkey = n.l_suppkey and k.domain = n.domain)), r as (select *, row_number() over (partition by l_suppkey order by n desc, domain) as place from f) select * from r where place <= 3""")
def first_party_aliases(spark, d):
    """Domains that a supplier's lines link to, without those that are candidates already: three at most, as the reference's operator has it."""
    l = read(spark, d, "lineitem")  # noqa: E741
    links = l.select("l_suppkey", F.when(F.col("l_partkey") % 5 != 0, _S("https://Q", F.col("l_partkey") % 60, ".com/x")).otherwise("https://x.linkedin.com").alias("url"))
    known = l.where("l_returnflag = 'R'").select("l_suppkey", _S("q", F.col("l_orderkey") % 60, ".com").alias("domain"))
    return R.alias_candidates(links, known, "l_suppkey", 3).withColumn("place", F.col("place").cast("long"))


@query("""with r as (select o_orderstatus as g, count(*) as n from orders group by 1), a as (select g, case when g = 'P' then 'count_mismatch' when g = 'O' then 'hash_mismatch' else 'ok' end as state from r) select g as o_orderstatus, state from a union all select 'gone', 'missing'""")
def snapshot_verification(spark, d):
    """A snapshot whose manifest was spoilt in three ways: another count, another hash, a group that is gone."""
    rows = read(spark, d, "orders")
    actual = state.manifest(rows, ["o_orderstatus"], "o_orderkey", F.concat_ws("|", "o_orderkey", "o_custkey"))
    spoilt = actual.select("o_orderstatus", F.when(F.col("o_orderstatus") == "P", F.col("n") + 1).otherwise(F.col("n")).alias("n"), F.when(F.col("o_orderstatus") == "O", F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    gone = spark.createDataFrame([("gone", 1, "0")], "o_orderstatus string, n long, sha256 string")
    return R.verify_snapshot(rows, spoilt.unionByName(gone.select(*spoilt.columns)), actual, "o_orderstatus")


def _patterned(spark, d, patterns, fields):
    """Every customer with the fields of its pattern, in its own word and two digits of its number."""
    k = F.col("c_custkey")
    own = spark.createDataFrame([(i, *r) for i, r in enumerate(patterns)], "i long, " + ", ".join(f"{f} string" for f in fields))
    rows = read(spark, d, "customer").select("c_custkey", (k % len(patterns)).alias("i"), own_word(k).alias("word"), (k % 90 + 10).cast("string").alias("digits"))
    return rows.join(F.broadcast(own), "i").select("c_custkey", *[F.replace(spelt(F.col(f), F.col("word")), F.lit("{d}"), F.col("digits")).alias(f) for f in fields])


#: expected and found cells of golden tables, by the row's number, with a word and digits of the row
GOLDEN = (
    ("https://www.{W}.com/x; beta.com.tr", "{w}.com", "Info@{W}.com", "info@{w}.com, x@y.com", "0212 555 {d} 12 - 13", "+90 212 555 {d} 13"),
    ("{w}.com", "other.com", "a@{w}.com", "c@d.com", "444 1 2{d}", "44412{d}"), ("", "{w}.com", "", "", "53212345{d}", "0532 123 45 {d}"),
    (None, None, "x", "x@x", "21255510{d}", "0212 555 10 {d}"), ("{w}.com|beta.com", "BETA.com", "A@B.COM\nC@{U}.com", "c@{w}.com", "123{d}", "123{d}"), ("{w}.net", "www.{W}.net", "mail: q@r.org", "q@r.org", "", "0212 555 10 12"),
)
_GOLDEN_SQL = ", ".join(f"({i}, {', '.join(map(_TEXT, r))})" for i, r in enumerate(GOLDEN)).replace("\n", "' || chr(10) || '")
_CELLS = lambda x: f"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '[\\n;,|]+'), lambda p: trim(p)), lambda p: p <> '')"
_HOST_LIST = lambda x: f"list_filter(list_transform({_CELLS(x)}, lambda p: {_HOST_OF('p')}), lambda h: h <> '')"
_MAIL_LIST = lambda x: f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}')"
_RANGE = "'^(.+\\b\\d{1,2})\\s*-\\s*(\\d{1,2})$'"
_PHONE_PARTS = lambda x: f"flatten(list_transform({_CELLS(x)}, lambda p: case when length(regexp_replace(regexp_extract(p, {_RANGE}, 1), '[^0-9]', '', 'g')) >= 10 then [regexp_extract(p, {_RANGE}, 1), regexp_replace(regexp_extract(p, {_RANGE}, 1), '\\d{{1,2}}\\s*$', '') || regexp_extract(p, {_RANGE}, 2)] else [p] end))"
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_NATIONAL = f"regexp_replace(case when regexp_matches({_DIGITS}, '^(00)?90[2-58][0-9]{{9}}$') then right({_DIGITS}, 10) else {_DIGITS} end, '^0', '')"
_PHONE_LIST = lambda x: f"list_filter(list_transform({_PHONE_PARTS(x)}, lambda v: case when regexp_matches({_NATIONAL}, '^444[0-9]{{4}}$') then {_NATIONAL} when regexp_matches({_NATIONAL}, '^[2-58][0-9]{{9}}$') then '0' || {_NATIONAL} when length({_DIGITS}) = 10 then '0' || {_DIGITS} when {_DIGITS} <> '' then {_DIGITS} end), lambda v: v is not null)"


_CELL = lambda c: f"replace({_SPELT(c, 'word')}, '{{d}}', (c_custkey % 90 + 10)::varchar) as {c}"


@query(f"""with c0(i, w1, w2, e1, e2, p1, p2) as (values {_GOLDEN_SQL}), g as (select c_custkey, {', '.join(map(_CELL, ('w1', 'w2', 'e1', 'e2', 'p1', 'p2')))} from (select c_custkey, {_LETTERS('c_custkey')} as word from customer) join c0 on c_custkey % {len(GOLDEN)} = i), r as (select c_custkey, list_has_any({_HOST_LIST('w1')}, {_HOST_LIST('w2')}) as website, list_has_any({_MAIL_LIST('e1')}, {_MAIL_LIST('e2')}) as email, list_has_any({_PHONE_LIST('p1')}, {_PHONE_LIST('p2')}) as phone,
 array_to_string({_PHONE_LIST('p1')}, ',') as phones from g) select * from r""")
def golden_value_match(spark, d):
    """Cells of expected and found values agree if they share one: hosts, addresses, numbers and their ranges."""
    rows = _patterned(spark, d, GOLDEN, ("w1", "w2", "e1", "e2", "p1", "p2"))
    both = lambda f, a, b: F.arrays_overlap(f(F.col(a)), f(F.col(b)))
    return rows.select("c_custkey", both(E.golden_hosts, "w1", "w2").alias("website"), both(E.golden_emails, "e1", "e2").alias("email"), both(E.golden_phones, "p1", "p2").alias("phone"), F.array_join(E.golden_phones(F.col("p1")), ",").alias("phones"))


@query("""with g as (select c_custkey, case when c_custkey % 3 = 0 then '' else lower(c_mktsegment) end as website, substr(c_name, 10) as email from customer), a as (select c_custkey, c_mktsegment || ' Site' as website, case when c_custkey % 4 = 0 then null else c_name end as email from customer)
select g.c_custkey, array_to_string(list_filter([case when g.website <> '' and not contains(lower(coalesce(a.website, '')), g.website) then 'website' end, case when g.email <> '' and not contains(lower(coalesce(a.email, '')), lower(g.email)) then 'email' end], lambda x: x is not null), ',') as failures from g left join a using (c_custkey)""")
def golden_substring_match(spark, d):
    """Fields whose expected value does not stand in the found one, without regard to case."""
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    golden = c.select("c_custkey", F.when(k % 3 == 0, "").otherwise(F.lower("c_mktsegment")).alias("website"), F.expr("substr(c_name, 10)").alias("email"))
    actual = c.select("c_custkey", _S(F.col("c_mktsegment"), " Site").alias("f_website"), F.when(k % 4 == 0, F.lit(None)).otherwise(F.col("c_name")).alias("f_email"))
    lost = [F.when((F.col(f) != "") & ~F.contains(F.lower(T.text_or_empty(f"f_{f}")), F.lower(f)), F.lit(f)) for f in ("website", "email")]
    return golden.join(actual, "c_custkey", "left").select("c_custkey", F.array_join(F.array_compact(F.array(*lost)), ",").alias("failures"))


@query("""with c as (select page_id, url, case page_id % 4 when 0 then 'phone' when 1 then 'email' when 2 then 'kep' else 'legal_name' end as field, case page_id % 4 when 0 then ' +90 (212) 555-10-' || page_id when 1 then 'Info@ACME' || page_id || '.com' when 2 then 'KEP@X.tr ' else 'Zümrüt İŞ ' || page_id end as value, html from pages),
h as (select *, """ + _HOST_OF("url") + """ as host from c)
select page_id, field, trim(value) as value, case when field = 'phone' then regexp_replace(value, '[^0-9]', '', 'g') when field in ('email', 'kep') then lower(trim(value)) else """ + _FOLD("trim(value)") + """ end as normalized_value, host as source_domain, 'first_party_domain:' || host as independence_key, sha256(html) as source_content_sha256 from h""")
def claim_build(spark, d):
    k = F.col("page_id")
    field = F.when(k % 4 == 0, "phone").when(k % 4 == 1, "email").when(k % 4 == 2, "kep").otherwise("legal_name")
    value = F.when(k % 4 == 0, _S(" +90 (212) 555-10-", k)).when(k % 4 == 1, _S("Info@ACME", k, ".com")).when(k % 4 == 2, "KEP@X.tr ").otherwise(_S("Zümrüt İŞ ", k))
    made = read(spark, d, "pages").select("page_id", E.claim(field, value, F.col("url"), F.lit("html"), F.col("html")).alias("c"))
    return made.select("page_id", *[F.col(f"c.{x}").alias(x) for x in ("field", "value", "normalized_value", "source_domain", "independence_key", "source_content_sha256")])


#: company, listed website, brands of the listing, brands of the profile, company of the profile
LISTED = (
    ("{W} Plastik", "https://www.{w}plastik.com", "", "", "{W} Plastik"), ("Anadolu Cam {W}", "ancazo.com", "", "", None), ("Mavi Deniz", "{w}.com.tr", "{W}; Bar", "", None), ("{W} Gida", "zeta.com", "", "Zeta", "{U} GIDA"),
    ("{W} Gida", "zeta.com", "", "Zeta", "Other"), ("{W} Rota", "example.net", "", "", "{W}-Rota"), ("{W}", "", "", "", "{W}"), ("Ege {W}", "egzo.com", "", "", None),
)
_STOP_ACRONYM = ("ve", "and")


def _fold_words(name):
    return F.filter(T.tokens(name), lambda t: ~t.isin(*_STOP_ACRONYM))


_LISTED_FIELDS = ("company", "site", "brands", "p_brands", "p_company")


@query()
def listed_site_proofs(spark, d):
    """Whether a customer's listed site is proved by a word of the company, of a brand, by an acronym or by its own profile.

    SQL would repeat the name functions of `domain_identity_match`; tests hold it against brute force.
    """
    rows = _patterned(spark, d, LISTED, _LISTED_FIELDS)
    aligned = F.coalesce(T.company_key("p_company") == T.company_key("company"), F.lit(False)) & F.col("p_company").isNotNull()
    own = F.when(aligned & (F.col("p_brands") != ""), F.col("p_brands")).otherwise(F.col("brands"))
    core = U.compact_core(U.host("site"))
    token = F.coalesce(E.domain_token(E.identity_values(F.col("company"), own), lambda v: T.brand_tokens(v), core), F.nullif(E.acronym(_fold_words("company"), core), F.lit("")))
    proof = F.when(token.isNotNull(), "meaningful_identity_token").when(aligned, "profile_local_website").otherwise("unproven")
    return rows.where("site <> ''").select("c_custkey", proof.alias("proof"))

