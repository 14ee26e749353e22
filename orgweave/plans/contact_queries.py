"""Contacts in order, roles of search results and open evidence as queries.

An order is one sighting of a contact of its customer: value, page and label are made of its own numbers and
its customer's word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.functions import names as N
from orgweave.functions import roles
from orgweave.operators import acquisition, contacts, evaluation
from orgweave.plans import evaluation_queries as Q
from orgweave.plans.catalogue import query, read
from orgweave.plans.name_queries import _FOLD, _LETTERS, _SPELT, _TEXT, own_word, spelt
from orgweave.sources.shared import written

#: values of e-mail and telephone sightings, pages and labels, by the order's number; {w} is the customer's word, {d} four digits
MAILS = ("info@{w}gida.com.tr", "SALES.tr@{w}gida.com", "{w}@gmail.com", "export-team@shop.{w}gida.com", "noreply@{w}gida.com.tr", "informatics@{w}gida.com.tr", "a@b.org", "x@example.com", "no mail", "Office@{U}GIDA.com.tr", None)
NUMBERS = ("+90 (212) 555 {d}", "0212 556 {d}", "0532 111 {d}", "444 {d}", "0850 222 {d}", "0312-333-{d}", "12345", None)
PATHS = ("/iletisim", "/tr/hakkimizda", "/kvkk", "", "/x", "/en/sube/1", "/gizlilik", "/katalog.pdf", "/turkiye")
LABELS = ("general", "sales", "fax", "headquarters", "branch", "privacy", None)
METHODS = ("http", "render", None)
_LIST = lambda xs: "[" + ", ".join(map(_TEXT, xs)) + "]"
_AT = lambda xs, key: f"{_LIST(xs)}[(({key}) % {len(xs)} + 1)::int]"
_SIGHTINGS = f"""o as (select o_orderkey as k, o_custkey, {_LETTERS('(o_custkey % 120)')} as word, lpad((o_custkey * 7 % 50 + o_orderkey % 3)::varchar, 4, '0') as d from orders),
s as (select k, 'Firma ' || upper(left(word, 1)) || substr(word, 2) || ' Gıda Ltd. Şti.' as company, 'https://www.' || word || 'gida.com.tr' as website, word, replace({_SPELT(_AT(MAILS, 'k'), 'word')}, '{{d}}', d) as mail, replace({_AT(NUMBERS, 'k // 3')}, '{{d}}', d) as number,
 case when k % 17 = 0 then null else 'https://www.' || word || 'gida.com.tr' || {_AT(PATHS, 'k // 2')} end as url, {_AT(PATHS, 'k // 2')} as path, coalesce({_AT(LABELS, 'k // 5')}, 'general') as label, coalesce({_AT(METHODS, 'k // 7')}, 'http') as method from o),
p as (select *, case when url is null or path = '' then 'homepage' when path = '/iletisim' then 'contact' when path = '/tr/hakkimizda' then 'about' when path = '/kvkk' then 'legal' when path = '/gizlilik' then 'privacy' when path = '/en/sube/1' then 'locations' when path = '/katalog.pdf' then 'document' else 'other' end as scope from s),
q as (select *, case scope when 'contact' then 6 when 'locations' then 5 when 'document' then 4 when 'about' then 3 when 'homepage' then 2 when 'privacy' then 0 else 1 end as page from p)"""


def sightings(spark, d: str) -> DataFrame:
    k, word = F.col("o_orderkey"), own_word(F.col("o_custkey") % 120)
    pick = lambda xs, key: F.get(F.array(*map(F.lit, xs)), (F.floor(key) % len(xs)).cast("int"))
    digits = F.lpad((F.col("o_custkey") * 7 % 50 + k % 3).cast("string"), 4, "0")
    site = F.concat(F.lit("https://www."), word, F.lit("gida.com.tr"))
    return read(spark, d, "orders").select(
        k.alias("k"), spelt(F.lit("Firma {W} Gıda Ltd. Şti."), word).alias("company"), site.alias("website"), F.replace(spelt(pick(MAILS, k), word), F.lit("{d}"), digits).alias("mail"), F.replace(pick(NUMBERS, k / 3), F.lit("{d}"), digits).alias("number"),
        F.when(k % 17 != 0, F.concat(site, pick(PATHS, k / 2))).alias("source_url"), pick(LABELS, k / 5).alias("label"), pick(METHODS, k / 7).alias("method"),
    )


_BEST = "max([page::varchar, (method = 'http')::int::varchar, coalesce(url, ''), label, method, scope]) as b, count(distinct url) as observations"


@query(f"""with {_SIGHTINGS}, n0 as (select *, regexp_replace(coalesce(number, ''), '[^0-9]', '', 'g') as digits from q), n1 as (select *, regexp_replace(regexp_replace(digits, '^90', ''), '^0', '') as nat from n0),
v as (select *, case when nat like '444%' and length(nat) = 7 then nat when length(nat) = 10 then '0' || nat end as value from n1), g as (select company, value, {_BEST} from v where value is not null group by 1, 2),
r as (select *, case b[4] when 'headquarters' then 100 when 'general' then 90 when 'sales' then 82 when 'branch' then 60 else 0 end as role, case when value like '444%' or value like '0850%' then 3 when value[1:2] in ('02', '03', '04') then 2 when value like '05%' then 1 else 0 end as kind from g where b[4] <> 'fax')
select company, value, b[3] as source_url, b[4] as label, observations, 'role=' || b[4] || ';scope=' || b[6] || ';observations=' || observations as reason, row_number() over (partition by company order by role desc, kind desc, b[1] desc, observations desc, b[2] desc, value desc) as place from r""")
def ranked_phones(spark, d):
    """Each company's national numbers in order."""
    return contacts.rank_phones(sightings(spark, d).withColumn("value", F.col("number")))


_CORE_OF = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(domain, '\\.com\\.tr$', ''), '\\.(com|org)$', ''), '[^a-z0-9]', '', 'g'), 'x', 'x')"


@query(f"""with {_SIGHTINGS}, m as (select *, lower(trim(mail)) as value from q where mail like '%@%' and mail not like '%example.com' and mail not like 'noreply@%'), g as (select company, word, value, {_BEST} from m group by 1, 2, 3),
a as (select *, split_part(value, '@', 1) as local, split_part(value, '@', 2) as domain from g), c as (select *, {_CORE_OF} as core, word || 'gida' as site from a),
f as (select *, contains(core, site) or contains(site, core) as family, {_FOLD("local || ' ' || core")} as said from c),
h as (select *, case when family then 80 else 0 end + case when contains(said, word) or contains(said, 'firma') or contains(said, 'gida') then 35 else 0 end + case when domain like '%.tr' then 5 else 0 end as affinity,
 case when b[3] like '%/tr/%' or b[3] like '%/turkiye' then 2 else 0 end + case when local like '%.tr' then 1 else 0 end as here, case regexp_extract(local, '^([^.-]*)', 1) when 'sales' then 0 when 'export' then 1 when 'office' then 2 when 'info' then 3 when 'marketing' then 4 else 5 end as prefix,
 case b[4] when 'sales' then 6 when 'headquarters' then 5 when 'general' then 4 when 'branch' then 2 when 'privacy' then -10 else 0 end as role from f)
select company, value, b[3] as source_url, b[4] as label, observations, affinity, 'domain_family=' || family::int || ';scope=' || b[6] || ';role=' || b[4] || ';observations=' || observations as reason,
 row_number() over (partition by company order by family desc, affinity desc, b[1] desc, role desc, here desc, observations desc, prefix, value desc) as place from h where affinity >= 15""")
def ranked_emails(spark, d):
    """Each company's usable addresses in order, by whose they are first."""
    return contacts.rank_emails(sightings(spark, d).withColumn("value", F.col("mail")))


#: url, title, snippet of search results; a customer's own word takes the place of {w}
RESULTS = (
    ("https://{w}.com.tr/iletisim", "{W}", ""), ("https://kayseri.bel.tr/firma/{w}", "{W}", "x"), ("https://list.org/firma/0a1b2c3d-1111-4222-8333-123456789abc", "{W}", ""), ("https://cnrexpo.com/exhibitor/{w}", "{W} katilimci", "hall 3"),
    ("https://sektorhaber.net/{w}", "x", ""), ("https://rehber.org/x?company={w}", "x", ""), ("https://a.org/firma_profil/{w}", "x", ""), ("https://a.org/firma-12/{w}", "x", ""), ("https://{w}.com/press%20release/1", "Basin", ""), ("https://blog.org/haber/{w}", "x", ""),
    ("https://supplier-list.example", "Company directory", "Supplier profile exporters"), ("https://b2bportal.org/company/{w}", "directory", ""), ("https://b2bportal.org/brand/{w}", "x", ""), ("https://firmalar.org/detail/{w}", "expo", ""), ("https://z.org/list", "Trade fair", "exhibitor"),
    ("https://z.org/katilimci/{w}", "Fuar", ""), ("https://z.org/company/x", "products of supplier", ""), ("https://z.org/x", "news haber", ""), ("https://shared.org/member/{w}", "x", ""), ("https://shared.org/other", "x", ""), (None, None, None), ("https://z.org/%zz+a", "{W}", None),
)


def results(spark, d: str) -> DataFrame:
    """c_custkey, company, url, title and snippet of one result a customer."""
    k = F.col("c_custkey")
    own = spark.createDataFrame([(i, *r) for i, r in enumerate(RESULTS)], "i long, url string, title string, snippet string")
    rows = read(spark, d, "customer").select("c_custkey", (k % len(RESULTS)).alias("i"), own_word(k).alias("word")).join(F.broadcast(own), "i")
    return rows.select("c_custkey", spelt(F.lit("{W} Makine"), F.col("word")).alias("company"), *[spelt(F.col(c), F.col("word")).alias(c) for c in ("url", "title", "snippet")])


@query()
def candidate_roles(spark, d):
    """The role of every result, by all rules; tests/test_contacts.py holds them against plain Python."""
    known = evaluation.with_ratios(results(spark, d).withColumnRenamed("company", "name"))
    per_host = known.groupBy("host").agg(F.count_distinct("name").alias("companies"))
    own = N.domain_identity(F.col("name"), F.col("host"), F.col("prefix_ratio"), F.col("whole_ratio"))["ok"]
    judged = written(known.join(per_host, "host").select("c_custkey", "url", "title", "snippet", "companies", own.alias("own")), "results")
    return judged.select("c_custkey", roles.candidate_role(F.col("url"), "title", "snippet", F.col("own"), F.col("companies")).alias("role"))


@query()
def evidence_acquisition(spark, d):
    """What evidence each company of the pages still lacks, where it may stand and which searches may find it; held against plain Python."""
    judged = Q.evaluations(spark, d)
    known = Q.page_resolution(spark, d).select("company", "status")
    named = judged.groupBy("company").agg(F.min("name").alias("name"), F.max("about").alias("sector"))
    companies = named.join(known, "company").select("company", "name", "sector", F.when(F.col("company") % 3 == 0, "Izmir").otherwise("").alias("address"), "status")
    found = acquisition.analyse(companies, judged)
    listed = lambda c: F.array_join(c, "; ").alias(c)
    return found.select("company", listed("gaps"), listed("scopes"), listed("searches"), "terminal")


_SOURCE = """case when url is null then 'missing_first_party_source_url' when k % 13 = 1 then 'non_http_first_party_source' when k % 13 = 2 and k % 4 <> 0 then 'source_outside_verified_official_family'
 when k % 11 = 3 then 'unsupported_retrieval_method:ftp' when k % 13 = 2 then 'verified_official_family_source' else 'verified_first_party_source' end"""
_JOINED = lambda xs: f"array_to_string(list_filter([{', '.join(xs)}], lambda x: x is not null), ';')"


@query(f"""with {_SIGHTINGS}, c as (select *, {_SOURCE} as source, coalesce(mail, '') as m, ['verified', 'valid', 'invalid_domain', 'not_checked'][(k % 5 + 1)::int] as dns, k % 6 = 0 as own, coalesce(lower(mail) like '%@' || word || 'gida.com.tr', false) as same_mail from q),
d as (select *, source like 'verified%' as ok, coalesce(dns, 'not_checked') as state, regexp_replace(regexp_replace(regexp_replace(coalesce(number, ''), '[^0-9]', '', 'g'), '^90', ''), '^0', '') as nat from c),
b as (select *, {_JOINED(["case when not contains(m, '@') then 'invalid_email_syntax' end", "case when not ok then source end", "case when state = 'invalid_domain' then 'email_domain_invalid' end",
 "case when not same_mail and state not in ('verified', 'valid') and not (ok and own and state <> 'invalid_domain') then 'cross_domain_email_dns_unverified' end"])} as mail_blockers,
 {_JOINED(["case when not (length(nat) = 10 or (length(nat) = 7 and nat like '444%')) then 'invalid_phone' end", "case when label = 'fax' then 'fax_not_company_phone' end", "case when not ok then source end"])} as phone_blockers from d)
select k, mail_blockers = '' as email_eligible, case when mail_blockers <> '' then mail_blockers when same_mail then source when own then 'first_party_cross_domain_company_identity' else 'verified_cross_domain_email_from_first_party_source' end as email_reason,
 phone_blockers = '' as phone_eligible, case when phone_blockers <> '' then phone_blockers else source end as phone_reason from b""")
def contact_gates(spark, d):
    """Which sightings may be published, by their source, their DNS and whose they are."""
    k = F.col("k")
    url = F.when(F.col("source_url").isNull(), F.lit(None)).when(k % 13 == 1, "ftp://x/y").when(k % 13 == 2, "https://other.example/contact").otherwise(F.col("source_url"))
    dns = F.get(F.array(*map(F.lit, ("verified", "valid", "invalid_domain", "not_checked", None))), (k % 5).cast("int"))
    method, family = F.when(k % 11 == 3, "ftp").otherwise(F.when(k % 2 == 0, "http")), k % 4 == 0
    mail = contacts.gate_email(F.col("website"), F.col("mail"), url, method, dns, k % 6 == 0, family)
    phone = contacts.gate_phone(F.col("website"), F.col("number"), F.col("label"), url, method, family)
    gated = sightings(spark, d).select("k", mail.alias("m"), phone.alias("p"))
    return gated.select("k", F.col("m.eligible").alias("email_eligible"), F.col("m.reason").alias("email_reason"), F.col("p.eligible").alias("phone_eligible"), F.col("p.reason").alias("phone_reason"))
