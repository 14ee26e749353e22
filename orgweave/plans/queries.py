"""The operators as queries over the test tables, each with the DuckDB SQL of the same result.

customer, supplier and part stand for company records, orders and lineitem for candidate
observations, events for query and API logs, pages for crawled pages, documents for page
texts, labels for calibration labels and benchmark for names to look for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.functions import contact as C
from orgweave.functions import html
from orgweave.functions import names as N
from orgweave.functions import text as T
from orgweave.functions import url as U
from orgweave.functions import words as W
from orgweave.operators import calibration, candidates, graph, identity, pairs, policy, records, state
from orgweave.plans.catalogue import ORACLE_SQL, QUERIES, query, read  # noqa: F401
from orgweave.sources import tables

# ---- SQL parts that several queries share
_FOLD = f"lower(translate(coalesce({{0}}, ''), '{W.FOLD_FROM}', '{W.FOLD_TO}'))"
_TOKENS = f"regexp_extract_all({_FOLD}, '[a-z0-9]+')"
_HOST = "regexp_replace(regexp_extract(lower(trim(coalesce(url, ''))), '^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]+)', 1), '^www\\.', '')"
_LAST2 = "array_to_string(string_split({0}, '.')[-2:], '.')"
_LAST3 = "array_to_string(string_split({0}, '.')[-3:], '.')"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in sorted(set(xs))) + "]"
_PATH = "regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_SCOPE = (
    f"case when regexp_replace({_PATH}, '[ /]+', '', 'g') = '' then 'homepage' when regexp_matches({_PATH}, 'kvkk|legal|ticari bilgi|sirket bilgi|imprint') then 'legal' when regexp_matches({_PATH}, 'privacy|gizlilik|veri koruma|data protection') then 'privacy'"
    f" when regexp_matches({_PATH}, 'contact|iletisim|bize ulas') then 'contact' when regexp_matches({_PATH}, 'location|lokasyon|sube|branch|factory|fabrika') then 'locations' when regexp_matches({_PATH}, 'about|hakkimizda|kurumsal|corporate') then 'about'"
    f" when regexp_matches({_PATH}, 'pdf|catalog|catalogue|katalog|brochure|brosur') then 'document' else 'other' end"
)
_EMAILS = "regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\\\u0040', '@', 'g'), '(?i)\\s*[\\[(]\\s*at\\s*[\\])]\\s*', '@', 'g'), '(?i)\\s*[\\[(]\\s*(dot|nokta)\\s*[\\])]\\s*', '.', 'g'), '" + C.EMAIL + "')"
_EMAIL_ROWS = f"select doc_id, lower(e) as email, n from (select doc_id, unnest({_EMAILS}) as e, generate_subscripts({_EMAILS}, 1) as n from documents)"
_WILSON = f"(c / a + {W.WILSON_Z} * {W.WILSON_Z} / (2 * a) - {W.WILSON_Z} * sqrt((c / a * (1 - c / a) + {W.WILSON_Z} * {W.WILSON_Z} / (4 * a)) / a)) / (1 + {W.WILSON_Z} * {W.WILSON_Z} / a)"
_RECORDS = "select d.doc_id, (d.n_chars % 101)::int as score, l.quality = 1 as correct, case d.lang when 'en' then 'calibration' when 'fr' then 'validation' else 'holdout' end as role from documents d join labels l using (doc_id)"
_CURVE = f"""
with r as ({_RECORDS}), g as (select score as threshold, count(*) as n, count(*) filter (where correct) as k from r group by 1),
s as (select threshold, sum(n) over w as a, sum(k) over w as c, sum(n) over () as total from g window w as (order by threshold desc rows unbounded preceding))
select threshold, a::bigint as accepted, c::bigint as correct, a / total as coverage, c / a as "precision", 1 - c / a as risk, round({_WILSON}, 9) as wilson_lower from s"""


def _records(spark, d) -> DataFrame:
    both = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    role = F.when(F.col("lang") == "en", "calibration").when(F.col("lang") == "fr", "validation").otherwise("holdout")
    return both.select("doc_id", (F.col("n_chars") % 101).alias("score"), (F.col("quality") == 1).alias("correct"), role.alias("role"))


@query(_CURVE)
def risk_coverage_curve(spark, d):
    return calibration.curve(_records(spark, d)).withColumn("wilson_lower", F.round("wilson_lower", 9))


@query(f"""with c as ({_CURVE}) select threshold, accepted, coverage, wilson_lower >= 0.8 as deployable from c where accepted >= 20 and "precision" >= 0.8
order by coverage desc, threshold limit 1""")
def recommend_threshold(spark, d):
    return calibration.recommend(calibration.curve(_records(spark, d)), 0.8, 20)


@query(f"with r as ({_RECORDS}) select role, count(*) as n from r where correct is not null and role not in ('calibration', 'validation') group by role")
def calibration_leakage_report(spark, d):
    return calibration.leakage(_records(spark, d))


@query(f"with t as (select doc_id, {_TOKENS.format('text')} as w from documents) select doc_id, len(w) as n_tokens, len(list_distinct(w)) as n_distinct, w[1] as first_token from t")
def normalize_text_tokens(spark, d):
    docs = read(spark, d, "documents").select("doc_id", T.tokens("text").alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.get("w", F.lit(0)).alias("first_token"))


@query("select doc_id, length(c) as n_chars, md5(c) as digest from (select doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '\\s+', ' ', 'g')) as c from documents)")
def clean_whitespace(spark, d):
    docs = read(spark, d, "documents").select("doc_id", T.clean("text").alias("c"))
    return docs.select("doc_id", F.length("c").cast("long").alias("n_chars"), F.md5(F.col("c").cast("binary")).alias("digest"))


@query(f"""with p as (select page_id, {_HOST} as host from pages)
select page_id, host, case when {_LAST2.format('host')} in {_IN(W.MULTI_PART_SUFFIXES)} then {_LAST3.format('host')} else {_LAST2.format('host')} end as registrable,
regexp_replace(regexp_replace(host, '\\.[a-z]{{2,}}$', ''), '[^a-z0-9]', '', 'g') as core,
string_split(host, '.')[-1] in {_IN(W.FOREIGN_TLDS)} as is_foreign from p""")
def host_normalize(spark, d):
    pages = read(spark, d, "pages").select("page_id", U.host("url").alias("host"))
    h = F.col("host")
    return pages.select("page_id", "host", U.registrable(h).alias("registrable"), U.compact_core(h).alias("core"), U.is_foreign(h).alias("is_foreign"))


@query(f"""with p as (select page_id, {_HOST} as host from pages), x as (select unnest({_LIST((*W.EXCLUDED_DOMAINS, 'example.org'))}) as domain)
select page_id, host from p where not exists (select 1 from x where host = domain or ends_with(host, '.' || domain))""")
def excluded_domain_anti_join(spark, d):
    pages = read(spark, d, "pages").select("page_id", U.host("url").alias("host"))
    listed = spark.createDataFrame([(x,) for x in (*W.EXCLUDED_DOMAINS, "example.org")], "domain string")
    return records.suffix_anti_join(pages, "host", listed).select("page_id", "host")


@query(f"select page_id, {_SCOPE} as scope from pages")
def page_scope_classify(spark, d):
    return read(spark, d, "pages").select("page_id", U.page_scope("url").alias("scope"))


@query(f"with t as (select doc_id, unnest(list_distinct({_TOKENS.format('text')})) as token from documents) select token, count(*) as n_docs from t group by token")
def token_document_frequency(spark, d):
    tokens = read(spark, d, "documents").select(F.explode(F.array_distinct(T.tokens("text"))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"))


@query("""with s as (select s_suppkey, list_filter(regexp_extract_all(lower(s_name), '[a-z0-9]+'), lambda t: length(t) > 1 and t not in ('ltd', 'sti', 'san', 'sanayi', 'tic', 'ticaret', 'anonim', 'limited', 'as', 'co', 'inc', 'gmbh', 've', 'and', 'sirket', 'sirketi')) as w from supplier),
f as (select token, count(*) as n from (select s_suppkey, unnest(list_distinct(w)) as token from s) group by 1), t as (select count(*) as n from supplier),
e as (select p_partkey, p_partkey % t.n as k, ' ' || lower(p_name || ' sold by supplier ' || lpad((p_partkey % (2 * t.n))::varchar, 9, '0')) || ' ' as e from part, t),
x as (select p_partkey, count(distinct token) as n from e join (select s_suppkey, unnest(list_distinct(w)) as token from s) on s_suppkey = k join f using (token), t where length(token) >= 4 and f.n <= greatest(1, t.n // 10) and (contains(e, ' ' || token || ' ') or contains(regexp_replace(e, '[^a-z0-9]', '', 'g'), token)) group by 1)
select p_partkey, least(8, 4 * n)::bigint as bonus from x""")
def rare_token_bonus(spark, d):
    """Suppliers' names against what parts say of their seller, half of which name another: all meaningful words, whole texts."""
    suppliers = read(spark, d, "supplier").select("s_suppkey", "s_name", F.array_distinct(T.legal_tokens("s_name")).alias("w"))
    each = suppliers.select("s_suppkey", F.explode("w").alias("token"))
    total = suppliers.agg(F.count(F.lit(1)).alias("total"))
    frequencies = each.groupBy("token").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total))
    rare = frequencies.where((F.length("token") >= 4) & (F.col("n") <= F.greatest(F.lit(1), F.floor(F.col("total") / 10)))).select("token")
    of_name = each.join(rare, "token").groupBy("s_suppkey").agg(F.collect_set("token").alias("rare"))
    parts = read(spark, d, "part").join(F.broadcast(total))
    evidence = F.concat_ws(" ", "p_name", F.lit("sold by supplier"), F.lpad((F.col("p_partkey") % (2 * F.col("total"))).cast("string"), 9, "0"))
    said = parts.select("p_partkey", (F.col("p_partkey") % F.col("total")).alias("s_suppkey"), evidence.alias("e"))
    found = said.join(of_name, "s_suppkey").join(suppliers.select("s_suppkey", "s_name"), "s_suppkey").select("p_partkey", F.size(N.rare_words("s_name", "e", F.col("rare"))).alias("n"))
    return found.where("n > 0").select("p_partkey", F.least(4 * F.col("n"), F.lit(8)).cast("long").alias("bonus"))


@query(f"""with i as (select item_id, array_to_string({_TOKENS.format('text')}[1:4], ' ') as phrase from benchmark where len({_TOKENS.format('text')}) >= 4),
d as (select doc_id, {_TOKENS.format('text')} as w from documents), g as (select doc_id, unnest([array_to_string(w[k:k + 3], ' ') for k in range(1, len(w) - 2)]) as phrase from d)
select distinct doc_id, item_id from g join i using (phrase)""")
def phrase_match(spark, d):
    """Documents with the first four words of an item: a join on the words, not a comparison of all pairs."""
    items = read(spark, d, "benchmark").select("item_id", T.tokens("text").alias("w")).where(F.size("w") >= 4)
    items = items.select("item_id", F.array_join(F.slice("w", 1, 4), " ").alias("phrase"))
    docs = read(spark, d, "documents").select("doc_id", T.tokens("text").alias("w")).where(F.size("w") >= 4)
    grams = docs.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda k: F.array_join(F.slice("w", k, 4), " "))).alias("phrase"))
    return grams.join(items, "phrase").select("doc_id", "item_id").distinct()


@query(f"select doc_id, email, min(n) as place from ({_EMAIL_ROWS}) group by 1, 2")
def email_extract(spark, d):
    found = F.transform(F.regexp_extract_all(C.clear_text("text"), F.lit(C.EMAIL), F.lit(0)), lambda e: F.lower(e))
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(found).alias("n", "email"))
    return rows.groupBy("doc_id", "email").agg((F.min("n") + 1).cast("long").alias("place"))


_PREFIX = "case " + " ".join(f"when regexp_extract(email, '^([^.@-]*)', 1) = '{p}' then {i}" for i, p in enumerate(W.EMAIL_PREFIXES)) + f" else {len(W.EMAIL_PREFIXES)} end"


@query(f"""with e as ({_EMAIL_ROWS}), o as (select email, count(*) as n_seen, count(distinct doc_id) as n_docs, min(doc_id) as first_doc, {_PREFIX} as prefix from e group by email),
r as (select string_split(email, '@')[2] as domain, email, n_seen, n_docs, row_number() over (partition by string_split(email, '@')[2] order by n_docs desc, n_seen desc, prefix, email) as place from o)
select domain, email, n_seen, n_docs, place from r""")
def email_rank(spark, d):
    """The addresses of each domain in order: documents, then sightings, then the preferred prefix."""
    found = read(spark, d, "documents").select("doc_id", F.explode(F.transform(F.regexp_extract_all(C.clear_text("text"), F.lit(C.EMAIL), F.lit(0)), lambda e: F.lower(e))).alias("email"))
    seen = found.groupBy("email").agg(F.count(F.lit(1)).alias("n_seen"), F.count_distinct("doc_id").alias("n_docs"))
    ranked = seen.select(C.email_domain(F.col("email")).alias("domain"), "*", C.prefix_rank(F.col("email")).alias("prefix"))
    best = candidates.rank_within(ranked, ["domain"], [F.desc("n_docs"), F.desc("n_seen"), F.asc("prefix"), F.asc("email")], "place")
    return best.select("domain", "email", "n_seen", "n_docs", F.col("place").cast("long").alias("place"))


_PHONE_ROWS = f"select doc_id, regexp_replace(p, '[^0-9]', '', 'g') as digits from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{C.PHONE}')) as p from documents)"


@query(f"select doc_id, digits, count(*) as n from ({_PHONE_ROWS}) where length(digits) between 10 and 15 group by 1, 2")
def phone_extract(spark, d):
    found = F.transform(F.regexp_extract_all(T.text_or_empty("text"), F.lit(C.PHONE), F.lit(0)), C.digits)
    rows = read(spark, d, "documents").select("doc_id", F.explode(found).alias("digits")).where(F.length("digits").between(10, 15))
    return rows.groupBy("doc_id", "digits").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with e as (select email, doc_id, d.source from ({_EMAIL_ROWS}) join documents d using (doc_id)), o as (select email, count(*) as n_seen, count(distinct source) as n_sources from e group by email),
b as (select email, source as best_source, row_number() over (partition by email order by length(source) desc, source desc, doc_id desc) as rn from e)
select email, n_seen, n_sources, best_source from o join b using (email) where rn = 1""")
def contact_aggregate_best_source(spark, d):
    docs = read(spark, d, "documents")
    rows = docs.select("doc_id", "source", F.explode(F.transform(F.regexp_extract_all(C.clear_text("text"), F.lit(C.EMAIL), F.lit(0)), lambda e: F.lower(e))).alias("email"))
    best = F.max_by("source", F.struct(F.length("source"), "source", "doc_id"))
    return rows.groupBy("email").agg(F.count(F.lit(1)).alias("n_seen"), F.count_distinct("source").alias("n_sources"), best.alias("best_source"))


@query(f"""with e as (select distinct email from ({_EMAIL_ROWS})), f as (select email, ends_with(email, 'example.com') as placeholder, length(split_part(email, '@', 1)) % 2 = 0 as same from e)
select email, array_to_string(list_filter([case when placeholder then 'dns_invalid' end, case when not same then 'cross_domain_unverified' end], lambda x: x is not null), ',') as blockers, not placeholder and same as publishable from f""")
def contact_publication_gate(spark, d):
    """The stand-ins: a placeholder domain counts as invalid DNS, an even local part as the site's own domain."""
    found = read(spark, d, "documents").select(F.explode(C.emails("text")).alias("email")).distinct()
    dns = F.when(C.is_placeholder(F.col("email")), "invalid").otherwise("unknown")
    same = F.length(F.substring_index("email", "@", 1)) % 2 == 0
    gated = found.select("email", policy.email_blockers(F.col("email"), F.lit(True), dns, same).alias("b"))
    return gated.select("email", F.array_join("b", ",").alias("blockers"), (F.size("b") == 0).alias("publishable"))


@query("""with l as (select page_id, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) as link from pages), g as (select page_id, link, count(*) as n from l group by 1, 2)
select page_id, link, n, place from (select *, row_number() over (partition by page_id order by n desc, length(link), link) as place from g) where place <= 5""")
def html_links_topk(spark, d):
    links = read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a[^>]*href="([^"]*)"'), F.lit(1))).alias("link"))
    counted = links.groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))
    best = candidates.top_k(counted, ["page_id"], [F.desc("n"), F.length("link").asc(), F.asc("link")], 5, "place")
    return best.withColumn("place", F.col("place").cast("long"))


@query("""with v as (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as t from pages)
select page_id, length(t) as n_chars, md5(t) as digest from v""")
def html_visible_text(spark, d):
    no_code = F.regexp_replace(T.text_or_empty("html"), r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(no_code, "<[^>]*>", " "), r"\s+", " "))
    return read(spark, d, "pages").select("page_id", text.alias("t")).select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query("""with p as (select p_partkey, p_brand || '|' || p_size as k, p_name, p_type, case when p_size > 25 then p_name end as maybe from part),
t as (select k, p_type, min(p_partkey) as o from p group by 1, 2)
select lower(p.k) as key, arg_min(p_name, p_partkey) as p_name, arg_min(maybe, p_partkey) filter (where maybe is not null) as maybe, any_value(j.types) as p_type, count(*) as n_rows
from p join (select k, string_agg(p_type, ';' order by o) as types from t group by k) j using (k) group by lower(p.k)""")
def dedupe_merge_records(spark, d):
    part = read(spark, d, "part").withColumn("maybe", F.when(F.col("p_size") > 25, F.col("p_name")))
    key = T.fold_key(F.concat_ws("|", "p_brand", F.col("p_size").cast("string")))
    return records.dedupe(part, key, "p_partkey", ["p_name", "maybe"], "p_type")


@query("""with u as (select 'customer' as source, 0 as o, right(c_name, 4) as k, c_nationkey as nation, c_custkey as id from customer union all
select 'supplier', 1, right(s_name, 4), s_nationkey, s_suppkey from supplier)
select k as key, arg_min(nation, o * 1000000000 + id) as nation, string_agg(distinct source, ';' order by source) as sources, count(*) as n_rows from u group by k""")
def union_sources_dedupe(spark, d):
    customer = read(spark, d, "customer").select(F.expr("right(c_name, 4)").alias("k"), F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"))
    supplier = read(spark, d, "supplier").select(F.expr("right(s_name, 4)").alias("k"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    both = records.union_sources(customer=customer, supplier=supplier).withColumn("o", F.col("source_priority").cast("long") * 1_000_000_000 + F.col("id"))
    return records.dedupe(both, F.col("k"), "o", ["nation"], "source").withColumnRenamed("source", "sources")


@query("""with m as (select c_custkey as k, 'holdout' as r from customer where c_acctbal > 5000 union all select c_custkey, 'validation' from customer where c_mktsegment = 'BUILDING'
union all select c_custkey, 'calibration' from customer where c_nationkey < 12)
select a.r as role_a, b.r as role_b, count(*) as n_shared from m a join m b on a.k = b.k and a.r < b.r group by 1, 2""")
def split_overlap(spark, d):
    member = {"holdout": F.col("c_acctbal") > 5000, "validation": F.col("c_mktsegment") == "BUILDING", "calibration": F.col("c_nationkey") < 12}
    roles = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in member.items()]))
    return records.overlaps(read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.explode(roles).alias("r")), "k", "r")


# two runs over the orders: the new one lacks some, and has other statuses and scores
_RUNS = """with old as (select o_orderkey as k, o_orderstatus as status, (o_totalprice % 100)::double as score from orders where o_orderpriority <> '5-LOW'),
new as (select o_orderkey as k, case when o_orderpriority = '2-HIGH' then 'F' else o_orderstatus end as status, (o_totalprice * 7 % 100)::double as score from orders where o_orderpriority <> '1-URGENT')"""
# evidence of both runs by arithmetic on the key, so that each of the twelve rules decides some rows
_EVIDENCE_OF = "c as (select old.k, old.status as old_status, new.status as new_status, coalesce(old.score, 0) as old_score, coalesce(new.score, 0) as new_score, old.k % 9 <> 0 as op, new.status is not null as np, old.k % 11 = 0 as ob, old.k % 13 = 0 as nb, old.k % 3 as oh, old.k // 3 % 3 as nh, old.k // 9 % 3 as oc, old.k // 27 % 3 as nc, old.k % 2 = 0 as ot, old.k % 4 = 0 as nt, old.k % 5 = 0 as same, 2 + old.k % 2 as n from old left join new using (k)), e as (select *, oh * 3 + oc * 2 + ot::int as os, nh * 3 + nc * 2 + nt::int as ns from c)"
_SUGGEST = """case when not op and np and not nb then 'new:old_empty_new_found' when ob and not nb then 'new:old_bad_domain' when nb and not ob then 'old:new_bad_domain' when oh = n and nh < n then 'old:old_full_token_match' when nh = n and oh < n then 'new:new_full_token_match'
when nc > oc and nh >= oh and not nb then 'new:new_more_contact_evidence' when oc > nc and oh >= nh and not ob then 'old:old_more_contact_evidence' when same then 'old:same_domain_keep_old' when abs(new_score - old_score) >= 25 and new_score > old_score and not nb then 'new:new_score_much_higher'
when abs(new_score - old_score) >= 25 and old_score > new_score and not ob then 'old:old_score_much_higher' when abs(ns - os) >= 3 and ns > os and not nb then 'new:new_stronger_evidence' when abs(ns - os) >= 3 and os > ns and not ob then 'old:old_stronger_evidence' else 'review:unclear' end"""


def _runs(spark, d) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, d, "orders")
    key = F.col("o_orderkey").alias("k")
    old = orders.where("o_orderpriority <> '5-LOW'").select(key, F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") % 100).alias("score"))
    new = orders.where("o_orderpriority <> '1-URGENT'").select(key, F.when(F.col("o_orderpriority") == "2-HIGH", "F").otherwise(F.col("o_orderstatus")).alias("status"), (F.col("o_totalprice") * 7 % 100).alias("score"))
    return old, new


def _suggested(compared: DataFrame) -> DataFrame:
    k, score = F.col("k"), lambda c: F.coalesce(F.col(c), F.lit(0.0))
    part = lambda n: F.floor(k / n) % 3
    old = {"present": k % 9 != 0, "bad": k % 11 == 0, "hits": k % 3, "contacts": part(9), "national": k % 2 == 0, "score": score("old_score")}
    new = {"present": F.col("new_status").isNotNull(), "bad": k % 13 == 0, "hits": part(3), "contacts": part(27), "national": k % 4 == 0, "score": score("new_score")}
    return compared.withColumn("s", records.suggest(old, new, 2 + k % 2, k % 5 == 0)).select(*compared.columns, "s.*")


@query(_RUNS + " select k, old.status as old_status, round(old.score, 6) as old_score, new.status as new_status, round(new.score, 6) as new_score from old left join new using (k)")
def compare_runs(spark, d):
    return records.compare(*_runs(spark, d), "k", ["status", "score"]).withColumns({c: F.round(c, 6) for c in ("old_score", "new_score")})


@query(_RUNS + " select k, old.status as old_status, new.status as new_status from old left join new using (k) where new.status is not null and (old.status is null or old.status <> new.status)")
def filter_decisions(spark, d):
    return records.needs_decision(records.compare(*_runs(spark, d), "k", ["status"]), "status")


@query(_RUNS + f", {_EVIDENCE_OF} select split_part(d, ':', 1) as decision, split_part(d, ':', 2) as reason, count(*) as n from (select {_SUGGEST} as d from e) group by 1, 2")
def suggest_decisions(spark, d):
    return _suggested(records.compare(*_runs(spark, d), "k", ["status", "score"])).groupBy("decision", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(_RUNS + f""", {_EVIDENCE_OF}, s as (select *, split_part({_SUGGEST}, ':', 1) as decision from e)
select k, case when decision = 'new' and new_status is not null then new_status else old_status end as status, case when decision = 'new' and new_status is not null then 'replaced' when decision = 'new' then 'missing' else 'kept' end as outcome from s""")
def apply_decisions(spark, d):
    old, new = _runs(spark, d)
    decided = _suggested(records.compare(old, new, "k", ["status", "score"])).select("k", "decision")
    return records.apply_decisions(old.select("k", "status"), decided, new, "k", ["status"])


@query(_RUNS + " select k, old.status as status, new.status as retry_status, case when new.status is null then 'keep' when new.status in ('F', 'O') then 'replace' when new.status <> old.status then 'review' else 'keep' end as route from old left join new using (k)")
def merge_runs(spark, d):
    old, new = _runs(spark, d)
    return records.merge_runs(old.select("k", "status"), new, "k", "status", ("F", "O"))


@query("""select o_orderkey, array_to_string(list_filter([case when o_totalprice > 300000 then 'price' end, case when c_acctbal < 0 then 'negative_balance' end, case when o_orderstatus = 'P' then 'pending' end], lambda x: x is not null), ';') as reasons
from orders join customer on o_custkey = c_custkey where o_totalprice > 300000 or c_acctbal < 0 or o_orderstatus = 'P'""")
def suspicious_audit(spark, d):
    both = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    why = records.reasons([("price", F.col("o_totalprice") > 300000), ("negative_balance", F.col("c_acctbal") < 0), ("pending", F.col("o_orderstatus") == "P")])
    return both.select("o_orderkey", why.alias("w")).where(F.size("w") > 0).select("o_orderkey", F.array_join("w", ";").alias("reasons"))


@query("""with b as (select l_suppkey, l_partkey, l_orderkey * 10 + l_linenumber as o, l_orderkey as q, l_quantity::bigint as base, (l_returnflag = 'R')::int as returned from lineitem)
select l_suppkey, l_partkey, least(92, max(base) + least(4 * (count(distinct q) - 1), 8))::bigint as score, count(distinct q) as n_queries, arg_max(o, base * 1000000000000 + o) as shown, max(returned) as returned from b group by 1, 2""")
def candidate_consensus(spark, d):
    line = read(spark, d, "lineitem").select(
        "l_suppkey", "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), F.col("l_orderkey").alias("q"),
        F.col("l_quantity").cast("long").alias("base"), (F.col("l_returnflag") == "R").cast("int").alias("returned"),
    )
    return candidates.consensus(line, ["l_suppkey", "l_partkey"], "q", "base", ["returned"], "o")


@query(f"""with p as (select page_id, {_HOST} as host, {_SCOPE} as scope from pages), h as (select host, count(*) as n from p group by host)
select page_id, n as n_shared, case when ends_with(host, '.gov') or ends_with(host, '.edu') then 'public_body' when string_split(host, '.')[-1] in {_IN(W.FOREIGN_TLDS)} then 'foreign'
when n >= 5 then 'shared_host' when scope = 'contact' then 'contact_page' else 'company_site' end as role from p join h using (host)""")
def candidate_role_case(spark, d):
    pages = read(spark, d, "pages").select("page_id", U.host("url").alias("host"), U.page_scope("url").alias("scope"))
    shared = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n_shared"))
    h = F.col("host")
    role = F.when(U.is_public_body(h), "public_body").when(U.is_foreign(h), "foreign").when(F.col("n_shared") >= 5, "shared_host").when(F.col("scope") == "contact", "contact_page").otherwise("company_site")
    return pages.join(shared, "host").select("page_id", "n_shared", role.alias("role"))


@query("""with r as (select o_custkey, o_orderkey, o_orderstatus, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders)
select o_custkey, """ + ", ".join(f"max(case when rn = {i} then {c} end) as candidate_{i}_{c}" for i in (1, 2, 3) for c in ("o_orderkey", "o_orderstatus")) + " from r where rn <= 3 group by o_custkey")
def candidate_topk_pivot(spark, d):
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    return candidates.top_k_pivot(read(spark, d, "orders"), ["o_custkey"], order, 3, ["o_orderkey", "o_orderstatus"])


@query("""with s as (select o_custkey, o_orderkey, (o_totalprice / 5000)::double as score from orders), b as (select *, max(score) over (partition by o_custkey) as best from s),
r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by score desc, o_orderkey) as rank from b where score >= best - 24) select * from r where rank <= 8""")
def score_gap_filter(spark, d):
    scored = read(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 5000).alias("score"))
    return candidates.score_gap(scored, ["o_custkey"], "score", [F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("""with k as (select o_custkey, o_orderstatus as family, o_totalprice > 50000 as ready, (o_totalprice / 50000)::bigint as a, (o_orderpriority = '1-URGENT')::int as b from
(select o_custkey, o_orderstatus, o_orderpriority, o_totalprice - o_totalprice % 50000 as o_totalprice from orders)),
r as (select *, rank() over (partition by o_custkey order by ready desc, a desc, b desc) as rk from k), g as (select o_custkey, max(ready) as ready, count(distinct family) as n, min(family) as family from r where rk = 1 group by 1)
select o_custkey, case when not ready then 'unresolved' when n > 1 then 'ambiguous' else 'resolved' end as status, case when ready and n = 1 then family end as family from g""")
def identity_resolution_status(spark, d):
    price = F.col("o_totalprice") - F.col("o_totalprice") % 50000
    keyed = read(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("family"), (price > 50000).alias("ready"), F.round(price / 50000).cast("long").alias("a"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("b"))
    return candidates.resolve(keyed, ["o_custkey"], ["a", "b"], "family", "ready")


@query("""select p_partkey from part a where not exists (select 1 from part b where a.p_brand = b.p_brand and b.p_size >= a.p_size and b.p_retailprice >= a.p_retailprice
and (b.p_size > a.p_size or b.p_retailprice > a.p_retailprice) and a.p_type <> b.p_type)""")
def skyline_tournament(spark, d):
    part = read(spark, d, "part")
    return candidates.skyline(part, ["p_brand"], ["p_size", "p_retailprice"], "p_type").select("p_partkey")


# labels passed along twelve times: more than the longest way in the graph of all lines, where almost every node is a few steps from any other
_LABELS = ", ".join(f"l{i} as (select e.a as n, least(min(x.m), min(y.m)) as m from e join l{i - 1} x on x.n = e.b join l{i - 1} y on y.n = e.a group by 1)" for i in range(1, 13))


@query(f"""with s as (select distinct l_suppkey * 2 as a, l_partkey * 2 + 1 as b from lineitem), e as (select a, b from s union select b, a from s), l0 as (select distinct a as n, a as m from e), {_LABELS} select n as node, m as component from l12""")
def domain_components(spark, d):
    """Suppliers and parts that lines join."""
    edges = read(spark, d, "lineitem").select((F.col("l_suppkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")).distinct()
    return graph.components(edges)


@query("""with r as (select user_id, event_id, event_type, ts, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events),
p as (select user_id, event_id, row_number() over (partition by user_id order by (n > 1)::int, ts, event_id) as pick from r) select * from p where pick <= 4""")
def diverse_pick(spark, d):
    picked = candidates.balanced_pick(read(spark, d, "events"), ["user_id"], "event_type", [F.asc("ts"), F.asc("event_id")], 4)
    return picked.select("user_id", "event_id", F.col("pick").cast("long").alias("pick"))


@query("""with u as (select user_id from events group by user_id having count(*) filter (where event_type = 'purchase' and value > 180) = 0), e as (select user_id, event_id, event_type, case event_type when 'error' then 100 when 'click' then 90 when 'view' then 80 else 60 end as priority from events semi join u using (user_id)),
f as (select *, row_number() over (partition by user_id, event_type order by event_id) as n from e), k as (select user_id, event_id, priority, row_number() over (partition by user_id order by priority desc, event_id) as place from f where n = 1) select * from k where place <= 3""")
def acquisition_plan(spark, d):
    """For users without a large purchase (the unresolved): the first event of each type by the type's priority, three at most."""
    events = read(spark, d, "events")
    resolved = events.where("event_type = 'purchase' and value > 180").select("user_id").distinct()
    priority = F.when(F.col("event_type") == "error", 100).when(F.col("event_type") == "click", 90).when(F.col("event_type") == "view", 80).otherwise(60)
    left = events.join(resolved, "user_id", "left_anti").withColumn("priority", priority)
    first = records.first_wins(left, ["user_id", "event_type"], [F.col("event_id")])
    plan = candidates.top_k(first, ["user_id"], [F.desc("priority"), F.asc("event_id")], 3, "place")
    return plan.select("user_id", "event_id", "priority", F.col("place").cast("long").alias("place"))


@query("select count(*) as n_events, count(distinct user_id) as n_users, count(*) filter (where event_type = 'error') as n_errors, count(*) filter (where value is null) as n_empty, round(100.0 * count(*) filter (where event_type = 'error') / count(*), 1) as error_percent from events")
def coverage_summary(spark, d):
    n, bad = F.count(F.lit(1)), F.count_if(F.col("event_type") == "error")
    return read(spark, d, "events").agg(n.alias("n_events"), F.count_distinct("user_id").alias("n_users"), bad.alias("n_errors"), F.count_if(F.col("value").isNull()).alias("n_empty"), F.round(100.0 * bad / n, 1).cast("double").alias("error_percent"))


@query("select o_orderstatus as status, count(*) as n, count(*) filter (where o_totalprice > 200000) as n_large, round(avg(o_totalprice), 4) as mean_price from orders group by 1")
def status_report(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("n_large"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query("select count(*) filter (where not l_quantity > 0) as quantity_positive, count(*) filter (where not l_discount <= 0.05) as discount_small, count(*) filter (where not coalesce(o.o_orderkey is not null, false)) as has_order from lineitem left join orders o on l_orderkey = o_orderkey")
def quality_audit(spark, d):
    both = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return records.invariant_audit(both, {"quantity_positive": F.col("l_quantity") > 0, "discount_small": F.col("l_discount") <= 0.05, "has_order": F.col("o_orderkey").isNotNull()})


@query("select event_type as name, count(*) as n, round(count(*) / (select count(distinct user_id) from events), 3) as per_user from events group by 1")
def telemetry_per_key(spark, d):
    events = read(spark, d, "events")
    users = events.agg(F.count_distinct("user_id")).first()[0]
    counted = events.groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("name", "n", F.round(F.try_divide("n", F.lit(users)), 3).alias("per_user"))


_GOLDEN = """with g as (select l.doc_id, case quality when 1 then 'present' else 'absent' end as state, d.n_chars % 5 <> 0 as published, d.n_chars % 7 <> 0 as equal, d.source = 'src0' as unknown from labels l join documents d using (doc_id)),
a as (select * from g where not unknown)"""


def _golden(spark, d) -> DataFrame:
    both = read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id")
    return both.select("doc_id", F.when(F.col("quality") == 1, "present").otherwise("absent").alias("state"), (F.col("n_chars") % 5 != 0).alias("published"), (F.col("n_chars") % 7 != 0).alias("equal"), (F.col("source") == "src0").alias("unknown"))


@query(_GOLDEN + """, c as (select count(*) filter (where state = 'present' and published and equal) as tp, count(*) filter (where published and not (state = 'present' and equal)) as fp, count(*) filter (where state = 'present' and not (published and equal)) as fn from a)
select tp, fp, fn, round(tp / (tp + fp), 4) as "precision", round(tp / (tp + fn), 4) as recall from c""")
def golden_prf(spark, d):
    asserted = _golden(spark, d).where("not unknown")
    hit = (F.col("state") == "present") & F.col("published") & F.col("equal")
    counted = asserted.agg(F.count_if(hit).alias("tp"), F.count_if(F.col("published") & ~((F.col("state") == "present") & F.col("equal"))).alias("fp"), F.count_if((F.col("state") == "present") & ~(F.col("published") & F.col("equal"))).alias("fn"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, F.col(a) + F.col(b)), F.lit(0.0)), 4)
    return counted.select("tp", "fp", "fn", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"))


@query(_GOLDEN + " select case when unknown then 'unknown' else state end as state, count(*) as n, count(*) filter (where published) as n_published from g group by 1")
def assertion_coverage(spark, d):
    state = F.when(F.col("unknown"), "unknown").otherwise(F.col("state"))
    return _golden(spark, d).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.count_if("published").alias("n_published"))


@query("select coalesce(c_mktsegment, 'all') as tier, count(*) as n, count(*) filter (where c_acctbal > 0) as n_positive from customer group by rollup (c_mktsegment)")
def tier_rollup(spark, d):
    return read(spark, d, "customer").rollup("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("n_positive")).select(F.coalesce("c_mktsegment", F.lit("all")).alias("tier"), "n", "n_positive")


@query("""with f as (select o_orderkey, o_orderstatus = 'F' as ok, o_orderkey % 4 as support, o_orderkey % 5 as bundle, c_acctbal > 5000 as publishable, o_orderkey % 3 as conflicts, c_acctbal < 0 as excluded from orders join customer on o_custkey = c_custkey),
s as (select *, greatest(0, least(100, 25 + 18 * least(support, 3) + 8 * least(bundle, 4) + 10 * publishable::int + 7 + 5 * publishable::int - 35 * least(conflicts, 2) - 40 * excluded::int)) as safety, excluded or conflicts > 1 as blocked from f)
select o_orderkey, safety::bigint as safety, case when blocked then 'blocked' when safety >= 90 then 'low' when safety >= 75 then 'controlled' else 'elevated' end as tier,
case when not ok then 'retain_legacy_abstention' when not blocked and safety >= 75 then 'allow' else 'downgrade_to_review' end as action from s""")
def publication_policy(spark, d):
    both = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    no, rich, bad = F.lit(False), F.col("c_acctbal") > 5000, F.col("c_acctbal") < 0
    conflicts = F.col("o_orderkey") % 3
    safety = policy.safety_score(F.col("o_orderkey") % 4, F.col("o_orderkey") % 5, no, rich, F.lit(True), rich, no, no, no, no, conflicts, no, bad)
    blockers = records.reasons([("excluded", bad), ("conflict", conflicts > 1)])
    tier, action = policy.risk_tier(safety, blockers), policy.policy_action(F.col("o_orderstatus") == "F", safety, blockers)
    return both.select("o_orderkey", safety.cast("long").alias("safety"), tier.alias("tier"), action.alias("action"))


@query(_RUNS + """, u as (select k, status, score, 1 as pass from old union all select k, status, score, 2 from new)
select k, status, pass from (select *, row_number() over (partition by k order by (status = 'F')::int desc, floor(score / 10) desc, pass desc) as rn from u) where rn = 1""")
def best_of_two_passes(spark, d):
    old, new = _runs(spark, d)
    both = old.withColumn("pass", F.lit(1)).unionByName(new.withColumn("pass", F.lit(2)))
    both = both.withColumn("good", (F.col("status") == "F").cast("int")).withColumn("level", F.floor(F.col("score") / 10))
    return candidates.best_pass(both, ["k"], ["good", "level"], "pass").select("k", "status", "pass")


@query("""with e as (select event_type, user_id, event_id, ts as created_at, case when value > 20 then 1 else 2 end as v from events), ok as (select * from e where v = 1 and epoch(timestamp '2024-12-31') - epoch(created_at) <= 350 * 86400),
l as (select *, row_number() over (partition by user_id, event_type order by created_at desc, event_id desc) as rn from ok), r as (select distinct user_id, event_type from events)
select r.user_id, r.event_type, l.event_id as entry_id from r left join l on r.user_id = l.user_id and r.event_type = l.event_type and l.rn = 1""")
def cache_ttl_lookup(spark, d):
    events = read(spark, d, "events")
    entries = events.select("user_id", "event_type", F.col("event_id").alias("entry_id"), F.col("ts").cast("timestamp").alias("created_at"), F.when(F.col("value") > 20, 1).otherwise(2).alias("schema_version"))
    now = F.lit("2024-12-31 00:00:00").cast("timestamp")
    return state.cache_lookup(events.select("user_id", "event_type").distinct(), entries, ["user_id", "event_type"], 1, 350 * 86400, now).select("user_id", "event_type", "entry_id")


@query(f"""with p as (select url as key, length(html) as n, page_id from pages), b as (select left(key, 14) as prefix, max(n) as richness, arg_max(key, n * 1000000000 + page_id) as best_key from p group by 1)
select page_id, best_key, richness from p join b on left(key, 14) = prefix""")
def cache_prefix_richest(spark, d):
    pages = read(spark, d, "pages").select(F.col("url").alias("key"), F.length("html").cast("long").alias("n"), "page_id")
    return state.prefix_lookup(pages, pages, 14, F.col("n"), F.col("page_id")).select("page_id", "best_key", "richness")


@query("""with h as (select event_type, event_id as o, sha256(event_id::varchar || '|' || props) as h from events),
a as (select event_type, o // 1000 as o, sha256(string_agg(h, chr(10) order by h.o)) as h, count(*) as n from h group by event_type, h.o // 1000),
b as (select event_type, o // 1000 as o, sha256(string_agg(h, chr(10) order by a.o)) as h, sum(n) as n from a group by event_type, a.o // 1000)
select event_type, sum(n)::bigint as n, sha256(string_agg(h, chr(10) order by o)) as sha256 from b group by 1""")
def snapshot_manifest_sha256(spark, d):
    return state.manifest(read(spark, d, "events"), ["event_type"], "event_id", F.concat_ws("|", F.col("event_id").cast("string"), "props"))


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) where rn = 1")
def checkpoint_last_wins(spark, d):
    return records.last_wins(read(spark, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("""with p as (select distinct l_orderkey as run, l_linenumber - 1 as i from lineitem where l_quantity > 10), r as (select run, i, row_number() over (partition by run order by i) - 1 as n from p)
select run, count(*) filter (where i = n) as n_prefix, count(*) as n_done from r group by run""")
def contiguous_prefix(spark, d):
    done = read(spark, d, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("run"), (F.col("l_linenumber") - 1).alias("i"))
    return state.contiguous_prefix(done, "run", "i")


@query("select event_type, count(*) filter (where n <= 50) as n_admitted, count(*) filter (where n > 50) as n_blocked from (select event_type, row_number() over (partition by event_type order by ts, event_id) as n from events) group by 1")
def budget_admission(spark, d):
    return state.admitted_counts(read(spark, d, "events"), "event_type", F.lit(50))


@query("""with n as (select event_id, user_id, epoch(ts)::double as s, row_number() over (partition by user_id order by ts, event_id) - 1 as n from events)
select event_id, round(max(s - n / 0.001) over (partition by user_id order by n rows unbounded preceding) + n / 0.001, 3) as start_s from n""")
def rate_limiter_schedule(spark, d):
    events = read(spark, d, "events").withColumn("s", F.col("ts").cast("timestamp").cast("double"))
    return state.schedule(events, "user_id", ["ts", "event_id"], F.col("s"), 0.001).select("event_id", F.round("start_s", 3).alias("start_s"))


@query("""with m as (select user_id, event_id, event_type = 'purchase' as ok, sum((event_type = 'purchase')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from events)
select user_id, run::bigint as run, count(*) as n_failures, count(*) >= 3 as opens from m where not ok group by 1, 2""")
def circuit_breaker_runs(spark, d):
    runs = state.failure_runs(read(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", W.CIRCUIT_FAILURES)
    return runs.select("user_id", "run", "n_failures", "opens")


@query(f"""with t as (select doc_id, ' ' || array_to_string({_TOKENS.format('text')}, ' ') || ' ' as p from documents) select doc_id, ((length(p) - length(replace(p, ' the ', ''))) // 5)::bigint as n from t""")
def context_occurrences(spark, d):
    return read(spark, d, "documents").select("doc_id", T.phrase_count(F.array_join(T.tokens("text"), " "), F.lit("the")).cast("long").alias("n"))


@query()
def fuzzy_ratio(spark, d):
    """Ratios of each supplier's name with the customers of the same last two digits: a keyed comparison."""
    names = lambda table, c: read(spark, d, table).select(F.expr(f"right({c}, 2)").alias("key"), F.col(c).alias("name"))
    return pairs.fuzzy_pairs(names("supplier", "s_name"), names("customer", "c_name")).withColumnsRenamed({"l_name": "s_name", "r_name": "c_name"})


_STOP = {"legal": (*W.LEGAL_WORDS, *W.JOINING_WORDS), "narrow": (*W.LEGAL_WORDS, *W.SECTOR_WORDS, *W.BUSINESS_WORDS), "wide": W.LEGAL_WORDS}
_KEEP = lambda xs: f"list_filter({_TOKENS.format('p_name')}, lambda t: not list_contains({_LIST(xs)}, t) and length(t) > 1)"


@query(f"""with t as (select p_partkey, {_KEEP(_STOP['legal'])} as l, {_KEEP(_STOP['narrow'])} as n, {_KEEP(_STOP['wide'])} as w from part)
select p_partkey, array_to_string(l, ' ') as legal, array_to_string(case when len(n) > 0 then n else w end, ' ') as distinctive from t""")
def name_tokens(spark, d):
    part = read(spark, d, "part")
    return part.select("p_partkey", F.array_join(T.legal_tokens("p_name"), " ").alias("legal"), F.array_join(T.distinctive_tokens("p_name"), " ").alias("distinctive"))


@query("select page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(url, ''), '#.*$', ''), '(utm_[a-z]+|gclid|fbclid|ref)=[^&]*&?', '', 'g'), '[?&]$', '') as url from pages")
def url_without_tracking(spark, d):
    return read(spark, d, "pages").select("page_id", U.strip_tracking("url").alias("url"))


_MARKERS = {"english": ("the", "of", "and"), "french": ("le", "la", "les"), "german": ("der", "die", "und"), "spanish": ("el", "los", "que")}
_TYPES = f"""t as (select doc_id, lang, ' ' || array_to_string({_TOKENS.format('text')}, ' ') || ' ' as p from documents), m as (""" + " union all ".join(
    f"select doc_id, lang, '{n}' as type, " + " + ".join(f"contains(p, ' {w} ')::int" for w in ws) + " as n_markers from t" for n, ws in _MARKERS.items()
) + "), s as (select * from m where n_markers > 0)"


@query(f"with {_TYPES} select doc_id, type, n_markers from s")
def semantic_taxonomy(spark, d):
    return identity.semantic_types(read(spark, d, "documents"), ["doc_id"], "text", _MARKERS)


@query(f"""with {_TYPES}, a as (select doc_id, any_value(lang) as lang, list(type) as found from s where n_markers >= 2 group by doc_id),
e as (select doc_id, found, [case lang when 'en' then 'english' when 'fr' then 'french' when 'de' then 'german' else 'spanish' end] as expected from a)
select doc_id, case when list_has_any(expected, found) then 'match' when list_has_any(expected, ['english']) and list_has_any(found, ['french', 'german', 'spanish']) then 'conflict' else 'unknown' end as verdict from e""")
def semantic_taxonomy_conflict(spark, d):
    docs = read(spark, d, "documents")
    types = identity.semantic_types(docs, ["doc_id", "lang"], "text", _MARKERS).where("n_markers >= 2").groupBy("doc_id").agg(F.collect_set("type").alias("found"), F.any_value("lang", ignoreNulls=F.lit(True)).alias("lang"))
    expected = F.array(F.when(F.col("lang") == "en", "english").when(F.col("lang") == "fr", "french").when(F.col("lang") == "de", "german").otherwise("spanish"))
    verdict = identity.semantic_conflict(expected, F.col("found"), {"english": ("french", "german", "spanish")})
    return types.select("doc_id", verdict.alias("verdict"))


@query("""with s as (select user_id, case when event_type = 'error' then 'conflict' else 'support' end as polarity, event_type as independence_key, event_type as kind, props as value, value > 200 as strong from events),
t as (select distinct user_id from (select user_id, kind from s where strong group by 1, 2 having count(distinct value) > 1)),
c as (select user_id, count(distinct case when polarity = 'support' then independence_key end) as n_support, count(*) filter (where polarity = 'conflict') as n_conflicts, count(distinct case when polarity = 'support' and strong then kind end) as bundle from s group by 1)
select c.user_id, n_support, n_conflicts + (t.user_id is not null)::int as n_conflicts, bundle, n_support >= 2 and n_conflicts + (t.user_id is not null)::int = 0 as publishable from c left join t using (user_id)""")
def identity_assessment(spark, d):
    polarity = F.when(F.col("event_type") == "error", "conflict").otherwise("support")
    signals = read(spark, d, "events").select("user_id", polarity.alias("polarity"), F.col("event_type").alias("independence_key"), F.col("event_type").alias("kind"), F.col("props").alias("value"), (F.col("value") > 200).alias("strong"))
    return identity.assess(signals, ["user_id"])


@query("""with f as (select l_orderkey, l_linenumber, l_quantity / 50 as ratio, l_linenumber as pages, l_discount >= 0.05 as hit, l_returnflag = 'R' as own, l_returnflag = 'A' as phrase, l_linestatus = 'F' as local, l_tax > 0.04 as marker from lineitem),
p as (select *, case when ratio >= 0.75 then 14 when ratio >= 0.5 then 8 when pages >= 5 then 14 when pages >= 4 then 8 when hit then 3 else -20 end as a, case when own then 20 when phrase then 16 else -8 end as b, case when local then 8 when marker then 5 else -10 end as c from f)
select l_orderkey, l_linenumber, (case when hit then least(60, greatest(0, least(100, 40 + a + b + c))) else greatest(0, least(100, 40 + a + b + c)) end)::bigint as score from p""")
def page_sub_scores(spark, d):
    own, hit, pages = F.col("l_returnflag") == "R", F.col("l_discount") >= 0.05, F.col("l_linenumber")
    points = [
        identity.page_identity(F.col("l_quantity") / 50, pages - 3, pages - 2, hit),
        identity.legal_name_points(own, F.lit(False), F.lit(0), F.col("l_returnflag") == "A"),
        identity.country_points(F.col("l_linestatus") == "F", F.lit(False), F.col("l_tax") > 0.04),
    ]
    score = identity.final_score(F.lit(40), points, hit, F.lit(False))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", score.cast("long").alias("score"))


@query("""with r as (select o_custkey, o_orderkey, o_orderstatus, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders), s as (select c_custkey, c_acctbal > 0 as present from customer),
m as (select c_custkey, present, max(case when rank = 1 and o_orderstatus = 'F' then 1 else 0 end) as at1, max(case when rank <= 3 and o_orderstatus = 'F' then 1 else 0 end) as at3, max(case when rank = 1 then 1 else 0 end) as selected from s left join r on c_custkey = o_custkey group by 1, 2)
select count(*) filter (where present) as n_present, round(sum(at1) filter (where present) / count(*) filter (where present), 4) as recall_at_1, round(sum(at3) filter (where present) / count(*) filter (where present), 4) as recall_at_3,
round(count(*) filter (where selected = 0) / count(*), 4) as abstention from m""")
def golden_stage_metrics(spark, d):
    ranked = candidates.rank_within(read(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])
    good = F.col("o_orderstatus") == "F"
    per = ranked.groupBy("o_custkey").agg(F.max((F.col("rank") == 1) & good).alias("at1"), F.max((F.col("rank") <= 3) & good).alias("at3"))
    golden = read(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("present"))
    both = golden.join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    n = F.count_if("present")
    share = lambda c: F.round(F.try_divide(F.count_if(c), n), 4)
    return both.agg(
        n.alias("n_present"), share(F.col("present") & F.col("at1")).alias("recall_at_1"), share(F.col("present") & F.col("at3")).alias("recall_at_3"),
        F.round(F.count_if(F.col("o_custkey").isNull()) / F.count(F.lit(1)), 4).alias("abstention"),
    )


@query("""with p as (select user_id, min(case event_type when 'purchase' then 1 when 'click' then 2 when 'view' then 3 end) as best from events where event_type in ('purchase', 'click', 'view') group by 1)
select event_id, user_id from events join p using (user_id) where best = case event_type when 'purchase' then 1 when 'click' then 2 when 'view' then 3 end""")
def provider_fallback(spark, d):
    results = read(spark, d, "events").withColumnRenamed("event_type", "provider")
    return tables.by_provider(results, "user_id", ["purchase", "click", "view"]).select("event_id", "user_id")


@query("select o_orderkey, case o_orderstatus when 'F' then 'published' when 'O' then 'review' else 'failed' end as part from orders")
def output_artifacts(spark, d):
    orders = read(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "HIGH").when(F.col("o_orderstatus") == "O", "REVIEW"))
    out = None
    for name, df in tables.artifacts(orders, "status", ("HIGH", "MEDIUM")).items():
        own = df.select("o_orderkey", F.lit(name).alias("part"))
        out = own if out is None else out.unionByName(own)
    return out


@query("select c_custkey, array_to_string(list_filter([case when c_acctbal <= 0 then 'contact' end, case when c_nationkey >= 12 then 'country' end, case when c_mktsegment <> 'BUILDING' then 'structured' end], lambda x: x is not null), ',') as gaps from customer")
def evidence_gaps(spark, d):
    has = {"contact": F.col("c_acctbal") > 0, "country": F.col("c_nationkey") < 12, "structured": F.col("c_mktsegment") == "BUILDING"}
    return read(spark, d, "customer").select("c_custkey", F.array_join(identity.evidence_gaps(has), ",").alias("gaps"))


@query("""with r as (select o_custkey as company, o_orderpriority as query, o_orderkey as domain, o_totalprice as score from orders), a as (select company, max(score) as best from r where query = '1-URGENT' group by 1),
f as (select r.*, 0 as round from r where query = '1-URGENT' union all select r.*, 1 from r left join a using (company) where query = '2-HIGH' and coalesce(a.best, 0) < 200000)
select company, domain, max(score) as score, min(round) as round from f group by 1, 2""")
def adaptive_discovery(spark, d):
    """Two rounds of recorded queries; the second only for companies without a result of 200000."""
    results = read(spark, d, "orders").select(F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("query"), F.col("o_orderkey").alias("domain"), F.col("o_totalprice").alias("score"))
    companies = results.select("company").distinct()
    return identity.discover(companies, lambda i: companies.withColumn("query", F.lit(("1-URGENT", "2-HIGH")[i])), results, 2, 200000)


# the other parts of the catalogue add their queries
from orgweave.plans import contact_queries, discovery_queries, evaluation_queries, listing_queries, name_queries, page_queries, registry_queries, report_queries, resolution_queries  # noqa: E402, F401
