"""Listings, profiles and recorded answers as queries: what they point to, their cards, and the library's names in SQL text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.functions import registered
from orgweave.functions import text as T
from orgweave.functions import url as U
from orgweave.operators import outbound
from orgweave.plans.catalogue import query, read
from orgweave.plans.registry_queries import _S
from orgweave.sources import recorded
from orgweave.sources.shared import shared_dir


def _neighbours(spark, d: str) -> DataFrame:
    """Pages with the host of the page after next, as a listing's page names another company's site."""
    pages = read(spark, d, "pages").where("url is not null")
    other = pages.select((F.col("page_id") - 2).alias("page_id"), U.host("url").alias("other"))
    return pages.join(other, "page_id", "left").withColumn("title", F.regexp_extract(T.text_or_empty("html"), "<title>([^<]*)", 1))


def snippets(spark, d: str) -> DataFrame:
    """page_id, source and snippet of search results: the page's own title with labelled, bare and excluded addresses."""
    k, o = F.col("page_id"), F.coalesce("other", F.lit("none.example.org"))
    source = F.when(k % 3 == 0, _S("https://list", k, ".com/files/members.pdf")).otherwise(F.col("url"))
    said = (
        F.when(k % 5 == 0, _S("Web sitesi: https://", o, "/x?y=1). Tel")).when(k % 5 == 1, _S("website www.", o, ", e-mail: info@", o, "; also firm", k, ".com.tr/a."))
        .when(k % 5 == 2, _S("bare firm", k, ".com and linkedin.com, sub.list", k, ".com")).when(k % 5 == 3, _S("Web Site - http://tr.linkedin.com/x website: www.shop", k, ".de website: www.a", k, ".net.tr")).otherwise("")
    )
    return _neighbours(spark, d).select("page_id", source.alias("source"), F.concat("title", F.lit(" "), said).alias("snippet"))


@query()
def snippet_outbound_websites(spark, d):
    """Sites that search results name, for results that name any; tests/test_outbound.py holds them against plain Python."""
    found = snippets(spark, d).select("page_id", outbound.snippet_websites("snippet", F.col("source")).alias("sites"))
    return found.where(F.size("sites") > 0).select("page_id", F.array_join("sites", " ").alias("sites"))


def profiles(spark, d: str) -> DataFrame:
    """profile, url, html: the pages' own html with a block of links to another page's site, some plain, some labelled."""
    k, o = F.col("page_id"), F.coalesce("other", F.lit("none.example.org"))
    link = (
        F.when(k % 6 == 0, _S('<div>Web sitesi <a href="//www.', o, '/x">', F.col("title"), "</a></div>")).when(k % 6 == 1, _S('<p><a href="https://firm', k, '.com/brochure.pdf">x</a> <a href="https://firm', k, '.com" title="Official site">y</a></p>'))
        .when(k % 6 == 2, _S("<p>resmi site www.firm", k, ".com.tr/a, yazin: info@mail", k, ".com</p>")).when(k % 6 == 3, _S('<ul><li><a href="http://linkedin.com/x">in</a><li><a href="http://z', k, '.net">z</a><li><a href="http://a', k, '.org">a</a> http://b', k, ".tr</ul>"))
        .when(k % 6 == 4, _S('<a href="/p', k, '/detail">more</a> <a href="mailto:a@b.com">m</a> <a href="#x">t</a>')).otherwise("")
    )
    return _neighbours(spark, d).select(F.col("url").alias("profile"), "url", F.concat(T.text_or_empty("html"), link).alias("html"))


def details(spark, d: str) -> DataFrame:
    """url and html of pages of details; those of every fifth profile were not recorded."""
    k = F.col("page_id")
    base = F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]+)", 1)
    return read(spark, d, "pages").where((k % 6 == 4) & (k % 5 != 0)).select(F.concat(base, _S("/p", k, "/detail")).alias("url"), _S('<dl><dt>Website</dt><dd>Website: <a href="https://own', k, '.com.tr/tr">home</a></dd></dl>').alias("html"))


def health(spark, d: str) -> DataFrame:
    host = U.host("url")
    return read(spark, d, "pages").where("url is not null").select(host.alias("host")).distinct().withColumn("circuit_open", F.pmod(F.length("host"), 9) == 0)


@query()
def profile_outbound_websites(spark, d):
    """Sites that profiles point to, with their label and where it stands; tests/test_outbound.py holds them against plain Python."""
    pages = outbound.with_details(profiles(spark, d), details(spark, d))
    return outbound.profile_websites(pages, health(spark, d))


def card_pages(spark, d: str) -> DataFrame:
    """page, base and html of an exhibitor list: twenty parts a page, two layouts."""
    k, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size")
    brand = _S('<a class="brand-link big" href="brand/', k, '"><h2 class="brand-name"> ', name, "  ", k, ' A.Ş.</h2><p class="brand-country">TR</p><div class="brand-location-info"><div class="location-item"><span>Salon: ', size, '</span></div><div class="location-item">STANT: ', size, "-A</div></div>", '<h3 class="brand-desc-title">Markalar</h3>', F.col("p_brand"), "<br>", F.col("p_type"), ";<br><b></b></a>")
    stand = _S('<a href="', F.when(k % 7 == 1, "https://www.linkedin.com/x").otherwise(_S("www.firm", k, ".com")), '"><div class="katilimci-text"><span class="text">', name, " ", k, '</span><i class="text">HALL ', size, " / B-", k, "</i></div></a>")
    card = F.when(k % 2 == 0, brand).otherwise(stand)
    listed = F.array_sort(F.collect_list(F.struct("p_partkey", card.alias("card"))))
    pages = read(spark, d, "part").withColumn("page", F.floor(k / 20)).groupBy("page").agg(listed.alias("cards"))
    return pages.select("page", _S("https://fair.example/list/", F.col("page")).alias("base"), F.concat(F.lit("<html><body><nav><a href='?page=2'>2</a></nav>"), F.array_join(F.transform("cards", lambda c: c["card"]), "\n"), F.lit("</body></html>")).alias("html"))


@query("""select p_partkey // 20 as page, p_name || ' ' || p_partkey || case when p_partkey % 2 = 0 then ' A.Ş.' else '' end as company, case when p_partkey % 2 = 0 or p_partkey % 7 = 1 then '' else 'https://www.firm' || p_partkey || '.com' end as listed_website,
case when p_partkey % 2 = 0 then 'TR' else '' end as country, case when p_partkey % 2 = 0 then 'https://fair.example/list/brand/' || p_partkey else '' end as profile_url, p_size::varchar as hall,
case when p_partkey % 2 = 0 then p_size || '-A' else 'B-' || p_partkey end as stand, case when p_partkey % 2 = 0 then p_brand || '; ' || p_type else '' end as brands, lower(p_name) || p_partkey || case when p_partkey % 2 = 0 then ' as' else '' end as loose from part""")
def listed_cards(spark, d):
    """An exhibitor list read by SQL text: a table function by LATERAL, and functions of the library on what it gives."""
    registered.register_functions(spark)
    return spark.sql(
        "select p.page, c.*, concat(array_join(slice(name_tokens(c.company), 1, 2), ' '), regexp_extract(c.company, '[0-9]+', 0), if(c.company like '%Ş.', ' as', '')) as loose from {pages} p, lateral list_cards(p.html, p.base) c",
        pages=card_pages(spark, d),
    )


@query("""with l as (select page_id, url, len(regexp_extract_all(coalesce(html, ''), '<a [^>]*href="[^"]+"')) as n_links from pages where url like 'http%'),
h as (select *, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '^www\\.', '') as host from l)
select page_id, host, list_element(string_split(host, '.'), -2) || '.' || list_element(string_split(host, '.'), -1) as domain, n_links::bigint as n_links, n_links::bigint as own_links, regexp_replace(host, '[^a-z0-9]', '', 'g') as key from h where n_links > 0""")
def sql_functions(spark, d):
    """Scalar and table functions in one SQL text."""
    registered.register_functions(spark)
    return spark.sql(
        """select page_id, url_host(url) as host, registrable_domain(url_host(url)) as domain, count(*) as n_links, count_if(same_site(l.target, url)) as own_links, company_key(url_host(url)) as key
        from {pages} p, lateral page_links(p.html, p.url) l where url like 'http%' group by page_id, url""",
        pages=read(spark, d, "pages"),
    )


def recorded_folder(spark, d: str) -> str:
    """Events as recorded answers of providers, a folder each."""
    path = f"{shared_dir(spark)}/orgweave/answers-{uuid.uuid4().hex}"
    answers = read(spark, d, "events").select(F.col("event_type").alias("provider"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("payload"), F.unix_timestamp(F.date_trunc("second", "ts").cast("timestamp")).alias("fetched_at"))
    answers.write.partitionBy("provider").json(path)
    return path


#: 2024-01-03, the oldest answer that a cache still takes
SINCE = 1704240000


@query(f"""with a as (select event_type as provider, user_id::varchar as key, props as payload, epoch(date_trunc('second', ts))::bigint as fetched_at from events)
select provider, key, count(*) as n, max(fetched_at) as last, max(payload) as payload from a where provider in ('click', 'view') and fetched_at >= {SINCE} group by 1, 2""")
def recorded_provider_answers(spark, d):
    """Fresh answers of two providers; the data source leaves the others' files unread."""
    recorded.register_sources(spark)
    answers = spark.read.format(recorded.NAME).load(recorded_folder(spark, d))
    fresh = answers.where(F.col("provider").isin("click", "view") & (F.col("fetched_at") >= SINCE))
    return fresh.groupBy("provider", "key").agg(F.count(F.lit(1)).alias("n"), F.max("fetched_at").alias("last"), F.max("payload").alias("payload"))
