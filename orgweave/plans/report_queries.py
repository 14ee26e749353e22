"""Reports, artifacts, snapshots, corroboration, related names and kinds of business as queries.

An order stands for a company's result, an event for a recorded entry, a part for a search result; what
they lack is made of their own columns, row by row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.functions import names as N
from orgweave.functions import text as T
from orgweave.functions import words as W
from orgweave.operators import corroboration, evaluation, reports, snapshots
from orgweave.plans.catalogue import query, read
from orgweave.plans.name_queries import _FOLD, _RAW
from orgweave.plans.registry_queries import _S
from orgweave.sources.shared import shared_dir, spread, written

_STATUSES = ("OK_HIGH_CONFIDENCE", "OK_MEDIUM_CONFIDENCE", "REVIEW_NEEDED", "WEBSITE_AMBIGUOUS", "WEBSITE_FETCH_FAILED", "WEBSITE_NOT_FOUND")
_STATUS_LIST = "[" + ", ".join(f"'{s}'" for s in _STATUSES) + "]"
_ROWS = f"""r as (select o_orderkey as k, 'Customer ' || o_custkey as company, {_STATUS_LIST}[(o_orderkey % 7 + 1)::int] as status, case when o_orderkey % 5 = 0 then 'no_candidate_proved_target_fingerprint' else o_orderstatus end as reason,
 floor(o_totalprice / 5000)::int as score, case when o_orderkey % 11 = 0 then 'https://tr.linkedin.com/x' when o_orderkey % 3 <> 2 then 'https://www.s' || (o_custkey % 50) || '.com.tr' else '' end as website,
 case when o_orderkey % 4 <> 1 then 'info@s' || (o_custkey % 50) || '.com.tr' end as email, case when o_orderkey % 5 < 3 then '0212555' || lpad((o_orderkey % 10000)::varchar, 4, '0') end as phone, case when o_orderkey % 2 = 0 then 'verified' else 'unknown' end as email_verification,
 case when o_orderkey % 6 < 4 then 'http://shop.s' || (o_custkey % 50) || '.com.tr/contact' else 'http://other.com' end as email_source_url, case when o_orderkey % 9 = 0 then 'https://s' || (o_custkey % 50) || '.com.tr/tel' end as phone_source_url,
 o_orderkey % 3 = 0 as publication_eligible, case when o_orderkey % 13 = 0 then 'no_candidate_proved_target_fingerprint' end as publication_blockers, case when o_orderkey % 8 = 0 then 'downgrade_to_review' end as publication_policy_action,
 ['low', 'controlled', 'high'][(o_orderkey % 3 + 1)::int] as publication_risk_tier, (o_orderkey % 10 = 0)::int as conflicts, case when o_orderkey % 4 = 0 then 'candidate_resolved_by_target_fingerprint' when o_orderkey % 4 = 1 then 'website_not_found' else '' end as terminal_reason,
 case when o_orderkey % 6 = 0 then ['missing_phone', 'missing_email'] when o_orderkey % 6 = 1 then ['missing_email'] else [] end as gaps, (o_orderkey % 4)::int as n_candidates, o_orderkey % 7 = 2 as has_edge,
 case o_orderkey % 3 when 0 then 'allowed' when 1 then 'suppressed' end as email_publication_status, case o_orderkey % 4 when 0 then 'allowed' when 1 then 'suppressed' end as phone_publication_status from orders),
x as (select *, coalesce(status in ('OK_HIGH_CONFIDENCE', 'OK_MEDIUM_CONFIDENCE'), false) as ok, website <> '' and email is not null and phone is not null as complete from r)"""


def results(spark, d: str, dealt: bool = False) -> DataFrame:
    """dealt: to all cores, while the rows are still narrow."""
    k, s = F.col("o_orderkey"), F.col("o_custkey") % 50
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (k % 7).cast("int"))
    some = lambda *xs: F.array(*map(F.lit, xs))
    numbers = F.when(k % 4 > 0, F.sequence(F.lit(1), (k % 4).cast("int"))).otherwise(F.array().cast("array<int>"))
    orders = read(spark, d, "orders")
    return (spread(orders, "o_orderkey") if dealt else orders).select(
        k.alias("k"), _S("Customer ", F.col("o_custkey")).alias("company"), pick([*_STATUSES, None]).alias("status"), F.when(k % 5 == 0, reports.UNPROVED).otherwise(F.col("o_orderstatus")).alias("reason"),
        F.floor(F.col("o_totalprice") / 5000).cast("int").alias("score"), F.when(k % 11 == 0, "https://tr.linkedin.com/x").when(k % 3 != 2, _S("https://www.s", s, ".com.tr")).otherwise("").alias("website"),
        F.when(k % 4 != 1, _S("info@s", s, ".com.tr")).alias("email"), F.when(k % 5 < 3, F.concat(F.lit("0212555"), F.lpad((k % 10000).cast("string"), 4, "0"))).alias("phone"), F.when(k % 2 == 0, "verified").otherwise("unknown").alias("email_verification"),
        F.when(k % 6 < 4, _S("http://shop.s", s, ".com.tr/contact")).otherwise("http://other.com").alias("email_source_url"), F.when(k % 9 == 0, _S("https://s", s, ".com.tr/tel")).alias("phone_source_url"),
        (k % 3 == 0).alias("publication_eligible"), F.when(k % 13 == 0, reports.UNPROVED).alias("publication_blockers"), F.when(k % 8 == 0, "downgrade_to_review").alias("publication_policy_action"),
        F.element_at(some("low", "controlled", "high"), (k % 3 + 1).cast("int")).alias("publication_risk_tier"), (k % 10 == 0).cast("int").alias("conflicts"),
        F.when(k % 4 == 0, "candidate_resolved_by_target_fingerprint").when(k % 4 == 1, "website_not_found").otherwise("").alias("terminal_reason"),
        F.when(k % 6 == 0, some("missing_phone", "missing_email")).when(k % 6 == 1, some("missing_email")).otherwise(F.array().cast("array<string>")).alias("gaps"),
        F.transform(numbers, lambda i: F.struct(_S("d", i, ".com").alias("domain"), (i + 50).alias("score"))).alias("candidates"),
        F.when(k % 7 == 2, F.array(F.struct(F.lit("brand_of").alias("kind"), _S("t", k % 30).alias("target")))).alias("edges"),
        F.when(k % 3 == 0, "allowed").when(k % 3 == 1, "suppressed").alias("email_publication_status"), F.when(k % 4 == 0, "allowed").when(k % 4 == 1, "suppressed").alias("phone_publication_status"),
    )


_N = lambda c: f"count(*) filter (where {c})"


@query(f"""with {_ROWS} select count(*) as companies, {_N("website <> ''")} as websites, {_N("email is not null")} as emails, {_N("email_verification = 'verified'")} as verified_emails, {_N("phone is not null")} as phones, {_N("complete")} as complete, {_N("ok")} as published,
{_N("publication_eligible")} as publication_eligible, {_N("complete and not ok")} as complete_held, {_N("ok and website <> ''")} as verified_websites, {_N("ok and complete")} as verified_complete, {_N("status = 'OK_HIGH_CONFIDENCE'")} as high_confidence,
{_N("status = 'OK_MEDIUM_CONFIDENCE'")} as medium_confidence, {_N("status in ('REVIEW_NEEDED', 'WEBSITE_AMBIGUOUS')")} as review, {_N("status = 'WEBSITE_AMBIGUOUS'")} as ambiguous, {_N("not ok")} as withheld, {_N("publication_policy_action = 'downgrade_to_review'")} as policy_downgrades,
{_N("ok and publication_risk_tier = 'low'")} as low_risk, {_N("ok and publication_risk_tier = 'controlled'")} as controlled_risk, {_N("publication_blockers is not null or reason = 'no_candidate_proved_target_fingerprint'")} as identity_unproved,
{_N("status = 'WEBSITE_FETCH_FAILED'")} as fetch_failed, {_N("status = 'WEBSITE_NOT_FOUND'")} as not_found, {_N("email_publication_status = 'allowed'")} as email_allowed, {_N("email_publication_status = 'suppressed'")} as email_suppressed,
{_N("phone_publication_status = 'allowed'")} as phone_allowed, {_N("phone_publication_status = 'suppressed'")} as phone_suppressed, {_N("len(gaps) > 0")} as gaps_open, sum(n_candidates)::bigint as candidates, sum(score)::bigint as score_sum from x""")
def run_report_counts(spark, d):
    """The report's numbers over all results, in one pass."""
    return reports.run_report(results(spark, d))


_SAME = lambda u: f"coalesce(regexp_extract({u}, '://(?:[a-z]+\\.)?(s[0-9]+\\.com\\.tr)', 1) = site and site <> '', false)"


@query(f"""with {_ROWS}, s as (select *, regexp_extract(website, '(s[0-9]+\\.com\\.tr)$', 1) as site from x), p as (
select 'status' as kind, coalesce(status, '') as name from s union all select 'terminal_reason', terminal_reason from s where terminal_reason <> '' union all select 'published', '' from s where ok
union all select 'invalid_publication', 'published_excluded_third_party_domain' from s where ok and website like '%linkedin%' union all select 'invalid_publication', 'published_without_same_site_contact_source' from s where ok and not ({_SAME("email_source_url")} or {_SAME("phone_source_url")})
union all select 'invalid_publication', 'published_with_identity_conflict' from s where ok and conflicts > 0 union all select 'gap', unnest(gaps) from s) select kind, name, count(*) as n from p group by 1, 2""")
def quality_audit_counts(spark, d):
    """Statuses, reasons, open gaps and invalid publications, in one pass."""
    return reports.audit(results(spark, d))


@query(f"""with {_ROWS}, a as (select unnest(['contacts', 'verified_contacts']) as artifact, company from x where ok union all select unnest(['review_queue', 'failed']), company from x where not ok union all select unnest(['evidence', 'discovery_coverage', 'status_log']), company from x
union all select 'entity_memory', company from x where ok and website <> '' union all select 'invalid_publications', company from x where ok and conflicts > 0 union all select 'website_candidates', company from (select company, unnest(range(0, n_candidates)) from x)
union all select 'entity_relationships', company from x where has_edge union all select 'acquisition_plan', company from (select company, unnest(gaps) from x)) select artifact, count(*) as n, count(distinct company) as n_companies from a group by 1""")
def written_artifacts(spark, d):
    """Twelve artifacts from one write, read back."""
    folder = f"{shared_dir(spark)}/orgweave/artifacts-{uuid.uuid4().hex}"
    reports.write_artifacts(results(spark, d, dealt=True), folder)
    return spark.read.text(folder).groupBy("artifact").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.get_json_object("value", "$.company")).alias("n_companies"))


def recorded_entries(spark, d: str, later: bool = False) -> DataFrame:
    """Events as cache entries; later: some changed, some gone, some new."""
    k, at = F.col("event_id"), F.lit(2 if later else 1)
    value = F.concat(F.lit('{"props": '), F.col("props"), F.lit(', "api_key": "x", "pages": ['), F.when(F.lit(later) & (k % 97 == 0), "1").otherwise(""), F.lit("]}"))
    first = read(spark, d, "events").select(F.lit("crawl_cache").alias("store"), F.col("event_type").alias("namespace"), k.cast("string").alias("key"), F.lit(3).alias("schema_version"), value.alias("value"), at.alias("at"))
    if not later:
        return first.where(k % 89 != 5)
    return first.where(k % 101 != 7)


@query("""with e as (select event_type as namespace, event_id from events), c as (select *, event_id % 89 <> 5 as before, event_id % 101 <> 7 as later from e)
select 'crawl_cache' as store, namespace, event_id::varchar as key, 3::bigint as schema_version, case when not before then 'added' when not later then 'removed' else 'changed' end as change from c where (before or later) and (before <> later or event_id % 97 = 0)""")
def snapshot_changes(spark, d):
    """What differs between two recorded snapshots, found by going down their trees."""
    first, second = (snapshots.record(recorded_entries(spark, d, x), "at") for x in (False, True))
    return snapshots.changes(first, second)


_PROFILE = "case c_custkey % 5 when 0 then null when 1 then 'Other Works' else 'Acme ' || c_custkey || ' Metal' end"


@query(f"""with a as (select distinct 'acme ' || o_custkey || ' metal' as company_key, 'c' || (o_custkey * 3 + o_orderkey % 2) || '.com.tr' as domain, o_custkey, o_orderkey % 2 as odd from orders where o_orderkey % 7 <> 3),
b as (select company_key, domain, o_custkey, odd, min(case when exists (select 1 from orders o where o.o_custkey = a.o_custkey and o.o_orderkey % 2 = odd and o.o_orderkey % 7 <> 3 and o.o_orderkey % 3 = 0) then 1 else 2 end) as batch from a group by all),
p as (select c_custkey, {_PROFILE} as name, case when c_custkey % 2 = 0 then 'https://www.c' || (c_custkey * 3) || '.com.tr/about' else 'https://short.link/' || c_custkey end as website, case when c_custkey % 2 = 1 then 'http://shop.c' || (c_custkey * 3 + 1) || '.com.tr' end as resolved from customer where c_custkey % 4 <> 3)
select company_key, domain, name, coalesce(resolved, website) as website, coalesce((c_custkey % 2 = 0 and odd = 0) or (c_custkey % 2 = 1 and odd = 1), false) as website_match, coalesce(name like 'Acme%', false) as name_match,
 coalesce(((c_custkey % 2 = 0 and odd = 0) or (c_custkey % 2 = 1 and odd = 1)) and name like 'Acme%', false) as verified, batch::int as batch from b left join p on c_custkey = o_custkey""")
def network_corroboration(spark, d):
    """Two batches against recorded profiles: the second asks only for what the first did not."""
    o, c = F.col("o_custkey"), F.col("c_custkey")
    asked = read(spark, d, "orders").where("o_orderkey % 7 <> 3").select("o_orderkey", _S("Acme ", o, " Metal").alias("company"), _S("https://www.c", o * 3 + F.col("o_orderkey") % 2, ".com.tr/x").alias("url"))
    profiles = read(spark, d, "customer").where("c_custkey % 4 <> 3").select(
        _S("ACME ", c, " metal").alias("company"), F.when(c % 5 == 0, F.lit(None)).when(c % 5 == 1, "Other Works").otherwise(_S("Acme ", c, " Metal")).alias("name"),
        F.when(c % 2 == 0, _S("https://www.c", c * 3, ".com.tr/about")).otherwise(_S("https://short.link/", c)).alias("website"), F.when(c % 2 == 1, _S("http://shop.c", c * 3 + 1, ".com.tr")).alias("resolved"),
    )
    memory = spark.createDataFrame([], corroboration.MEMORY)
    for batch, rows in ((1, asked.where("o_orderkey % 3 = 0")), (2, asked)):
        answers, _ = corroboration.corroborate(rows, profiles, memory, batch)
        memory = written(corroboration.remember(memory, answers), "corroborated")
    return memory


_ESTATE = r"((?:[A-ZÇĞİÖŞÜ][A-ZÇĞİÖŞÜ0-9-]{1,}[ \t]+){1,4}[A-ZÇĞİÖŞÜ][A-ZÇĞİÖŞÜ0-9-]{1,})[ \t]+S[İI]T(?:ES[İI])?\.?"
_SNIPPET = """p_name || ' firmasi ' || case p_partkey % 6 when 0 then 'Adres: ' || upper(p_name) || ' ORNEK-SAN SİTESİ No 5' when 1 then upper(p_name) || ' SİT. ve ' || upper(p_type) || ' ' || upper(p_name) || ' SITESI'
 when 2 then 'ORGANIZE SANAYI SİTESİ' when 3 then 'YENI ' || upper(p_type) || ' ' || upper(p_name) || ' BUYUK TESIS SİTESİ x' when 4 then upper(p_name) || ' MAHALLESI ' || upper(p_brand) || ' SİTESİ' else '' end"""
_PLACES = "ltd sti san sanayi tic ticaret anonim limited as co inc gmbh mahalle mahallesi cadde caddesi sokak bulvar organize sitesi site".split()


@query(f"""with p as (select p_partkey, p_name, {_RAW('p_name')} as own, {_SNIPPET} as s, p_partkey % 10 <> 9 as named from part), m as (select *, unnest(regexp_extract_all(s, '{_ESTATE}', 1)) as raw, unnest(range(0, len(regexp_extract_all(s, '{_ESTATE}', 1)))) as i from p where named),
w as (select p_partkey, own, i, list_filter({_RAW("replace(raw, '-', '')")}, lambda t: not list_contains([{', '.join(f"'{x}'" for x in _PLACES)}], t) and length(t) > 2) as ws from m),
h as (select p_partkey, array_to_string(ws, ' ') as hint, min(i) as i from w where len(ws) between 2 and 4 and len(list_filter(ws, lambda t: length(t) >= 4 and list_contains(own, t))) > 0 and len(list_filter(ws, lambda t: length(t) >= 4 and not list_contains(own, t))) > 0 group by 1, 2)
select p_partkey, string_agg(hint, '; ' order by i) as hints from (select *, row_number() over (partition by p_partkey order by i) as n from h) where n <= 2 group by 1""")
def related_name_hints(spark, d):
    """Names that a company's own search results give to an industrial estate."""
    k, name, up = F.col("p_partkey"), F.col("p_name"), lambda c: F.upper(c)
    said = (
        F.when(k % 6 == 0, _S("Adres: ", up("p_name"), " ORNEK-SAN SİTESİ No 5")).when(k % 6 == 1, _S(up("p_name"), " SİT. ve ", up("p_type"), " ", up("p_name"), " SITESI")).when(k % 6 == 2, "ORGANIZE SANAYI SİTESİ")
        .when(k % 6 == 3, _S("YENI ", up("p_type"), " ", up("p_name"), " BUYUK TESIS SİTESİ x")).when(k % 6 == 4, _S(up("p_name"), " MAHALLESI ", up("p_brand"), " SİTESİ")).otherwise("")
    )
    company = F.when(k % 10 != 9, name).otherwise("Baska Bir Firma")
    found = read(spark, d, "part").select("p_partkey", N.related_names(company, name, F.concat(F.lit("firmasi "), said)).alias("hints"))
    return found.where(F.size("hints") > 0).select("p_partkey", F.array_join("hints", "; ").alias("hints"))


_SHOWN = "regexp_replace(p_name, '[^a-z]', ' ', 'g') || case p_partkey % 5 when 0 then ' Çelik, PROFİL ve makine; travel agency' when 1 then ' otel-konaklama / metal bankası e ticaret' when 2 then ' Kimya Boya lojistik Nakliye' when 3 then ' chemicals steel foundry travel  agency' else '' end"
_HAS = lambda m: f"contains(t, ' {m} ')"
_COUNT = {kind: " + ".join(f"{_HAS(m)}::int" for m in markers) for kind, markers in W.TAXONOMY.items()}


@query(f"""with p as (select p_partkey, ' ' || array_to_string(regexp_extract_all({_FOLD(_SHOWN)}, '[a-z0-9]+|  +'), ' ') || ' ' as t from part), c as (select p_partkey, [{', '.join(f"case when {n} > 0 then '{k}=' || ({n}) end" for k, n in _COUNT.items())}] as found from p)
select p_partkey, array_to_string(list_filter(found, lambda x: x is not null), ',') as kinds from c""")
def business_kinds(spark, d):
    """Kinds of business that a text says, with how many of their markers, by one look-up of its words and pairs of words."""
    k = F.col("p_partkey")
    shown = F.concat(
        F.regexp_replace("p_name", "[^a-z]", " "),
        F.when(k % 5 == 0, " Çelik, PROFİL ve makine; travel agency").when(k % 5 == 1, " otel-konaklama / metal bankası e ticaret").when(k % 5 == 2, " Kimya Boya lojistik Nakliye").when(k % 5 == 3, " chemicals steel foundry travel  agency").otherwise(""),
    )
    markers = T.let(T.normalize(shown), lambda x: evaluation.business_markers(x, T.tokens(x)))
    rows = read(spark, d, "part").select("p_partkey", markers.alias("m"))
    counted = [F.struct(F.lit(kind).alias("k"), F.size(F.array_intersect("m", N._listed(own))).alias("n")) for kind, own in W.TAXONOMY.items()]
    said = F.transform(F.filter(F.array(*counted), lambda x: x["n"] > 0), lambda x: F.concat_ws("=", x["k"], x["n"].cast("string")))
    return rows.select("p_partkey", F.array_join(said, ",").alias("kinds"))
