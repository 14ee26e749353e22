"""Robots files and sitemaps of sites, expanded level by level over a recorded table of documents.

What a client would fetch is joined: documents (url, content). All sites go forward together; a
level is one join of the sitemaps that are next with the documents, an anti-join with those that
were read, and an exact budget of each site by the order in which a queue would have taken them.
Each level's tables are written in the shared folder and deleted when the result is.

Defined cases: a sitemap without a document counts against the budget and gives nothing; malformed
XML is searched for addresses; addresses of other registrable domains, and malformed ones, are left out;
null and empty contents give nothing; a url with several documents has the first content by order.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from orgweave.functions import text as T
from orgweave.functions import url as U
from orgweave.sources.shared import Scratch, written

# Budgets of a site, and words of addresses that lead to contact data.
MAX_SITEMAPS, MAX_URLS = 4, 2500
CONTACT_WORDS = (
    "contact", "iletisim", "iletişim", "bize-ulas", "about", "hakkimizda", "hakkımızda", "kurumsal", "corporate", "kvkk", "legal", "privacy",
    "gizlilik", "office", "sube", "şube", "whatsapp", "whats-app", "terms", "kullanim", "location", "lokasyon", "distributor", "bayi", "dealer",
    "catalog", "catalogue", "katalog", "brochure", "brosur",
)


def contact_like(url: Column) -> Column:
    """Whether an address's own words promise contact data."""
    plain = F.lower(F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url))
    return T.has_any(plain, CONTACT_WORDS) | plain.endswith(".vcf") | plain.endswith(".vcard")


def same_site(url: Column, host: Column) -> Column:
    own = U.registrable(U.host(url))
    return F.coalesce((own != "") & (own == U.registrable(host)), F.lit(False))


def _lines(content: Column) -> Column:
    return F.transform(F.split(T.text_or_empty(content), r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))


def listed_sitemaps(root: Column, content: Column, limit: int = MAX_SITEMAPS) -> Column:
    """The sitemaps that a robots file names, in order, and the usual one behind them."""
    base = F.regexp_replace(root, "/+$", "")
    raw = F.split(T.text_or_empty(content), r"\r\n|\r|\n")
    named = F.transform(F.filter(raw, lambda x: F.lower(x).startswith("sitemap:")), lambda x: F.trim(F.substring(x, 9, 100_000)))
    return F.slice(F.array_distinct(F.filter(F.concat(named, F.array(F.concat(base, F.lit("/sitemap.xml")))), lambda u: u != "")), 1, limit)


def robots_rules(content: Column, agent: str) -> Column:
    """(path, allow) of the group for `agent`, else of the group for all, in order. An empty Disallow allows everything."""
    rule = "struct<path:string,allow:boolean>"
    start = F.struct(F.lit("").alias("of"), F.lit(False).alias("open"), F.lit(False).alias("own"), F.array().cast(f"array<{rule}>").alias("mine"), F.array().cast(f"array<{rule}>").alias("all"))

    def step(s: Column, line: Column) -> Column:
        key, value = F.lower(F.trim(F.substring_index(line, ":", 1))), F.trim(F.regexp_replace(line, "^[^:]*:", ""))
        name = F.lower(F.substring_index(value, "/", 1))
        kind = F.when(value == "*", "all").when((name != "") & F.contains(F.lit(agent.lower()), name), "mine").otherwise("")
        is_agent, is_rule = key == "user-agent", key.isin("disallow", "allow") & F.contains(line, F.lit(":"))
        # agents that follow each other share the rules behind them
        of = F.when(is_agent, F.when(s["open"], F.concat_ws(",", s["of"], kind)).otherwise(kind)).when(line == "", F.when(s["open"], s["of"]).otherwise("")).otherwise(s["of"])
        made = F.array(F.struct(F.when((key == "disallow") & (value == ""), "").otherwise(value).alias("path"), ((key == "allow") | (value == "")).alias("allow")))
        add = lambda k: F.when(is_rule & F.contains(s["of"], F.lit(k)), F.concat(s[k], made)).otherwise(s[k]).alias(k)
        return F.struct(of.alias("of"), F.when(is_agent, True).when(is_rule, False).otherwise(s["open"]).alias("open"), (s["own"] | (is_agent & (kind == "mine"))).alias("own"), add("mine"), add("all"))

    return F.aggregate(_lines(content), start, step, lambda s: F.when(s["own"], s["mine"]).otherwise(s["all"]))


def allowed(rules: Column, url: Column) -> Column:
    """Whether the first rule that fits an address's path lets it be read; without one it may."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    fit = F.filter(rules, lambda r: (r["path"] == "*") | path.startswith(r["path"]))
    return F.coalesce(F.get(fit, F.lit(0))["allow"], F.lit(True))


@F.pandas_udf(ArrayType(StringType()))
def locations(content: pd.Series) -> pd.Series:
    """Texts of all elements whose name ends in `loc`; of malformed XML, all addresses."""

    def found(x: str | None) -> list[str]:
        if not x:
            return []
        try:
            return [(n.text or "").strip() for n in ElementTree.fromstring(x).iter() if isinstance(n.tag, str) and n.tag.casefold().endswith("loc") and (n.text or "").strip()]
        except (ElementTree.ParseError, ValueError):
            return re.findall(r"https?://[^\s<>'\"]+", x)

    return content.map(found)


def expand(roots: DataFrame, documents: DataFrame, max_sitemaps: int = MAX_SITEMAPS, max_urls: int = MAX_URLS) -> DataFrame:
    """(root, url, place): addresses of contact pages that a site's sitemaps list, in the order in which they are found.

    roots: root, sitemaps (in order). documents: url, content. A site reads max_sitemaps sitemaps and looks at max_urls
    addresses, both limits of the feature.
    """
    with Scratch(roots.sparkSession) as scratch:
        contents = documents.where("url is not null").groupBy("url").agg(F.min("content").alias("content"))
        hosts = roots.select("root", U.host("root").alias("host"))
        queue = scratch.written(roots.select("root", F.posexplode("sitemaps").alias("place", "sitemap")).select("root", "sitemap", F.array(F.col("place").cast("long")).alias("place")), "queue-0")
        read, found = queue.select("root", "sitemap").limit(0), None
        used = roots.select("root", F.lit(0).cast("long").alias("n_sitemaps"), F.lit(0).cast("long").alias("n_urls"))
        # every level reads a sitemap of each site that goes on, so the budget bounds the levels
        for level in range(max_sitemaps):
            of, before = Win.partitionBy("root").orderBy("place"), Win.partitionBy("root").orderBy("place").rowsBetween(Win.unboundedPreceding, -1)
            once = queue.join(hosts, "root").where(same_site(F.col("sitemap"), F.col("host"))).join(read, ["root", "sitemap"], "left_anti").groupBy("root", "sitemap").agg(F.min("place").alias("place"))
            taken = once.join(used, "root").withColumn("turn", F.col("n_sitemaps") + F.row_number().over(of)).where(F.col("turn") <= max_sitemaps)
            texts = taken.join(contents.withColumnRenamed("url", "sitemap"), ["sitemap"], "left").select("root", "sitemap", "place", "n_sitemaps", "n_urls", "content")
            listed = texts.withColumn("listed", locations("content")).drop("content")
            # a queue stops taking sitemaps when the addresses before them use the budget up
            counted = listed.withColumn("seen", F.col("n_urls") + F.coalesce(F.sum(F.size("listed")).over(before), F.lit(0))).where(F.col("seen") < max_urls)
            step = scratch.written(counted, f"level-{level}")
            each = step.select("root", "place", "seen", F.posexplode("listed").alias("at", "url")).where(F.col("seen") + F.col("at") < max_urls)
            each = scratch.written(each.join(hosts, "root").where(same_site(F.col("url"), F.col("host"))).select("root", "url", F.concat("place", F.array(F.col("at").cast("long"))).alias("place")), f"listed-{level}")
            is_sitemap = F.lower("url").endswith(".xml") | F.lower("url").endswith(".xml.gz")
            hits = each.where(~is_sitemap & contact_like(F.col("url"))).select("root", "url", F.lit(level).alias("level"), "place")
            found = hits if found is None else found.unionByName(hits)
            queue = scratch.written(each.where(is_sitemap).select("root", F.col("url").alias("sitemap"), "place"), f"queue-{level + 1}")
            if queue.isEmpty():
                break
            read = read.unionByName(step.select("root", "sitemap"))
            spent = step.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.least(F.lit(max_urls), F.max("n_urls") + F.sum(F.size("listed"))).alias("k"))
            used = scratch.written(used.join(spent, "root", "left").select("root", (F.col("n_sitemaps") + F.coalesce("m", F.lit(0))).alias("n_sitemaps"), F.coalesce("k", "n_urls").alias("n_urls")), f"used-{level}")
        if found is None:
            return roots.select("root", F.lit("").alias("url"), F.lit(0).cast("long").alias("place")).limit(0)
        first = found.groupBy("root", "url").agg(F.min(F.struct("level", "place")).alias("first"))
        order = Win.partitionBy("root").orderBy("first")
        return written(first.select("root", "url", F.row_number().over(order).cast("long").alias("place")), "contact-urls")


def contact_pages(roots: DataFrame, documents: DataFrame, agent: str, max_sitemaps: int = MAX_SITEMAPS, max_urls: int = MAX_URLS) -> DataFrame:
    """(root, url, place, allowed) from robots files and sitemaps.

    roots: root (scheme and host). documents: url, content. A robots file is the document `<root>/robots.txt`.
    """
    robots = documents.select(F.regexp_replace("url", "/robots[.]txt$", "").alias("base"), "content").where(F.col("url").endswith("/robots.txt"))
    known = roots.select("root", F.regexp_replace("root", "/+$", "").alias("base")).distinct().join(robots.groupBy("base").agg(F.min("content").alias("content")), "base", "left")
    known = known.select("root", listed_sitemaps(F.col("root"), F.col("content"), max_sitemaps).alias("sitemaps"), robots_rules(F.col("content"), agent).alias("rules"))
    found = expand(known.select("root", "sitemaps"), documents, max_sitemaps, max_urls)
    return found.join(known.select("root", "rules"), "root").select("root", "url", "place", allowed(F.col("rules"), F.col("url")).alias("allowed"))
