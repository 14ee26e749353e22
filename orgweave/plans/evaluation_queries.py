"""Candidates evaluated by the pages' own html: reasons, scores, fingerprints, routes and resolutions.

Three pages in a row are what was read of a candidate's site, three candidates in a row are a
company's. A company's name is made of its first page's host and title, so it stands on its own
pages and in its own host and in others only by chance; every other host is a national one. What a
search, a business listing or an arbitration would add is given by the candidate's number.
tests/test_evaluation.py holds all of it against plain Python, page by page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orgweave.functions import html as H
from orgweave.functions import text as T
from orgweave.functions import url as U
from orgweave.operators import arbitration as A
from orgweave.operators import discovery as D
from orgweave.operators import evaluation as V
from orgweave.operators import fingerprint as P
from orgweave.plans.catalogue import query, read

PAGES_A_SITE, SITES_A_COMPANY = 3, 3
_ROLES = ("company_candidate", "company_candidate", "unknown", "company_candidate", "directory", "company_candidate", "news")
_QUERIES = ("search", "search", "verified_entity", "search", "input_website")


def _capital(word):
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1000))


def sites(spark, d: str) -> DataFrame:
    """Pages with node, place, the company's number, its name, and the host under which they are taken to lie."""
    k, per = F.col("page_id"), PAGES_A_SITE * SITES_A_COMPANY
    pages = read(spark, d, "pages").select("page_id", "url", "html", F.floor(k / per).alias("company"), (k - k % PAGES_A_SITE).alias("node"), (k % PAGES_A_SITE).cast("int").alias("place"))
    label = F.regexp_extract(T.text_or_empty("url"), r"([a-z0-9-]+)\.example\.", 1)
    words = F.regexp_extract_all(F.lower(F.regexp_extract(T.text_or_empty("html"), "<title>([^<]*)", 1)), F.lit("[a-z]{4,}"), F.lit(0))
    first, second = (F.coalesce(F.get(words, F.lit(i)), F.lit("")) for i in range(2))
    c = F.col("company")
    name = (
        F.when(c % 5 == 0, F.concat(_capital(label), F.lit(" Example Ltd. Şti.")))
        .when(c % 5 == 1, F.concat(_capital(label), F.lit(" "), _capital(first), F.lit(" Makine A.Ş.")))
        .when(c % 5 == 2, F.concat(_capital(first), F.lit(" "), _capital(second), F.lit(" Gıda San. ve Tic. Ltd. Şti.")))
        .when(c % 5 == 3, F.concat(_capital(label), F.lit(" Limited Şirketi")))
        .otherwise(F.concat(_capital(label), F.lit(" Example Metal "), _capital(first)))
    )
    companies = pages.where(k % per == 0).select("company", F.trim(name).alias("name"))
    host, n = U.host(T.text_or_empty("url")), F.floor(F.col("node") / PAGES_A_SITE)
    own = F.when(n % 4 == 2, F.concat(label, F.lit(".com.tr"))).when(n % 4 == 0, F.concat(host, F.lit(".tr"))).otherwise(host)
    return pages.join(companies, "company").withColumn("host", own)


def candidates(spark, d: str) -> DataFrame:
    k = F.floor(F.col("node") / PAGES_A_SITE)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    url, mail = F.concat(F.lit("https://"), F.col("host"), F.lit("/")), F.concat(F.lit("info@"), F.when(k % 4 == 1, "post.example").otherwise(F.col("host")))
    number = F.concat(F.lit("0212555"), F.lpad((k % 10000).cast("string"), 4, "0"))
    return sites(spark, d).where("place = 0").select(
        "company", "node", "name", F.when(k % 3 == 0, "food and beverage").when(k % 3 == 1, "steel, metal profil").otherwise("").alias("about"), url.alias("url"), pick(_ROLES).alias("role"), pick(_QUERIES).alias("query"),
        (k * 7 % 55 + 30).cast("int").alias("score"), F.when(k % 4 == 0, "domain_hits:1/2").when(k % 4 == 2, "search_text_identity:1/2").otherwise("").alias("reason"), (k % 6).cast("int").alias("official_query"),
        F.when(k % 9 == 4, F.concat(F.lit("https://elsewhere"), F.col("node").cast("string"), F.lit(".com.tr/"))).otherwise(url).alias("final_url"),
        F.when(k % 3 != 1, mail).otherwise("").alias("email"), F.when(k % 3 != 1, url).otherwise("").alias("email_url"), F.when(k % 5 == 1, number).otherwise("").alias("phone"), F.when(k % 5 == 1, url).otherwise("").alias("phone_url"),
        F.when(k % 4 == 1, F.array(F.struct(F.col("name").alias("name"), F.when(k % 8 == 1, url).otherwise("https://other.com.tr").alias("website")))).alias("places"),
        F.when(k % 4 == 1, F.concat(F.lit("+90 "), F.substring(number, 2, 10))).otherwise("").alias("listed_phone"), (k % 17 == 3).alias("website_proof"), F.when(k % 19 == 5, "match").when(k % 19 == 6, "no_match").alias("verdict"),
    )


def site_html(spark, d: str) -> DataFrame:
    """node, place, page_id, host and html: the pages' own, on every fourth with an organisation's data in front."""
    k = F.col("page_id")
    owner = F.when(k % 8 == 0, F.col("name")).when(k % 16 == 4, F.lit("Other Holding Anonim Sirketi")).otherwise(F.regexp_replace(F.regexp_extract(T.text_or_empty("html"), "<title>([^<]*)", 1), r"[^a-zA-Z ]", " "))
    data = F.concat(F.lit('<script type="application/ld+json">{"@type":"Organization","name":"'), owner, F.lit('","telephone":"0212 555 10 10"'), F.when(k % 24 == 0, F.concat(F.lit(',"legalName":"'), F.col("name"), F.lit('"'))).otherwise(""), F.lit("}</script>"))
    number = F.when(k % 12 == 0, F.concat(F.lit("<p>Mersis No: "), F.lpad((F.col("node") * 31 % 1000000).cast("string"), 16, "1"), F.lit("</p>"))).otherwise("")
    said = F.when(k % 20 == 0, "<p>Celik, profil ve hadde, makine</p>").when(k % 20 == 4, "<p>Otel ve konaklama, resort</p>").when(k % 20 == 8, F.concat(F.lit("<p>A brand of "), F.col("name"), F.lit("</p>"))).when(k % 20 == 12, "<p>Istanbul, food, drink</p>").otherwise("<p>Tel: 0312 555 20 30, gida</p>")
    front = F.concat(data, number, said, T.text_or_empty("html"))
    return sites(spark, d).select("node", "place", "page_id", F.concat(F.lit("https://"), F.col("host"), F.lit("/")).alias("url"), F.when(k % 4 == 0, front).otherwise(F.col("html")).alias("html"))


def evaluations(spark, d: str, arbitrated: bool = True) -> DataFrame:
    """arbitrated: with the verdicts that the candidates carry."""
    pages, known = site_html(spark, d), candidates(spark, d)
    known = known if arbitrated else known.withColumn("verdict", F.lit(None).cast("string"))
    found = H.organization_claims(pages.select("page_id", "url", "html"))
    claims = found.select((F.col("page_id") - F.col("page_id") % PAGES_A_SITE).alias("node"), F.col("page_id").alias("page"), "field", "value")
    return V.evaluate(known, pages, claims)


@query()
def candidate_evaluation(spark, d):
    """Score, reasons and assessment of every candidate."""
    listed = lambda c: F.array_join(c, "; ").alias(c)
    return evaluations(spark, d).select("company", "node", "final_score", listed("reasons"), "has_contact", "context_failed", "email_failed", listed("supports"), listed("conflicts"), "independent", "strong_bundle")


@query()
def page_fingerprints(spark, d):
    """The columns that the routes read."""
    return evaluations(spark, d).select("company", "node", "host", *P.FLAGS, *P.STRENGTHS)


@query()
def page_routes(spark, d):
    """The safe routes of every candidate by what its pages show."""
    named = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in P.routes(P.columns()).items()]))
    e = P.columns()
    return evaluations(spark, d).select("company", "node", F.array_join(named, ",").alias("routes"), P.verified_identity(e).alias("verified"), P.candidate_ready(e).alias("ready"))


@query()
def page_resolution(spark, d):
    """The site of every company, or why there is none; sites of one registrable domain are one owner's."""
    judged = evaluations(spark, d).withColumn("family", U.registrable(F.col("host")))
    return P.resolve_candidates(judged, "company", "node", "family")


def placed(spark, d: str) -> DataFrame:
    """Evaluations before any arbitration, with the places of a company's candidates by score."""
    judged = evaluations(spark, d, arbitrated=False)
    order = Window.partitionBy("company").orderBy(F.desc("final_score"), F.asc("node"))
    return judged.withColumn("place", F.row_number().over(order))


def verdicts(spark, d: str) -> DataFrame:
    """Recorded verdicts by the candidate's number; some were never recorded."""
    k = F.floor(F.col("node") / PAGES_A_SITE)
    turn = (k + F.col("company")) % 3
    return candidates(spark, d).select("company", "node", F.when(turn == 0, "match").when(turn == 1, "no_match").otherwise("uncertain").alias("verdict")).where(k % 7 != 5)


@query()
def arbiter_triggers(spark, d):
    """Candidates that an arbitration is asked for, and why."""
    return A.triggers(placed(spark, d)).select("company", "node", F.array_join("triggers", ",").alias("triggers"))


@query()
def arbiter_rounds(spark, d):
    """Candidates after all rounds: which round asked, the verdict, who is in the pool and who is out."""
    found, _ = A.arbitrate(placed(spark, d), verdicts(spark, d), 2)
    return found.select("company", "node", "place", "round", F.array_join("triggers", ",").alias("triggers"), "decision", "active", "rejected")


@query()
def arbitrated_resolution(spark, d):
    return A.arbitrate(placed(spark, d), verdicts(spark, d), 2)[1]


@query()
def identity_guards(spark, d):
    """Candidates that nothing but a search speaks for, that contradict a listed site, or whose name is only in the search; tests/test_arbitration.py holds them against plain Python."""
    judged, k = evaluations(spark, d), F.floor(F.col("node") / PAGES_A_SITE)
    known = page_resolution(spark, d).select("company", F.col("selected").alias("node"), F.col("resolved_by").alias("resolution")).where("node is not null")
    rows = judged.join(known, ["company", "node"], "left").withColumn("listed", F.when(k % 3 == 0, F.concat(F.lit("https://"), F.col("host"))).when(k % 3 == 1, "https://listed.com.tr"))
    c = {
        "host": F.col("host"), "excluded": ~F.col("eligible"), "query": F.col("query_source"), "exact_brand": F.col("exact_compound"), "official_query": F.col("query"), "score": F.col("final_score"),
        "resolution": F.col("resolution"), "role": F.col("role"), "reasons": F.col("reasons"), "intrinsic": F.col("intrinsic"),
    }
    return rows.select("company", "node", D.unsupported_search_text(c).alias("unsupported"), D.listed_conflict(F.col("name"), F.col("host"), F.col("listed"), F.col("reasons")).alias("listed_conflict"), D.weak_search_identity(c, F.col("name")).alias("weak"))
