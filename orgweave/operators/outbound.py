"""Websites that listings, profiles and documents point to: links with what stands around them, and addresses in text.

They lead to candidates only; nothing here proves a site. Profiles of hosts whose circuit is open
are not read. A profile's page of details, on its own host, is read with it.

Defined cases: null and empty pages and snippets give nothing; the same site counts once a profile, at its
first place; a profile without pages has no row.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orgweave.functions import markup
from orgweave.functions import text as T
from orgweave.functions import url as U
from orgweave.functions import words as W

# Patterns of labelled and bare addresses, words that label a website, files that are none, links kept a profile.
LABELLED = r"(?i)(?:web\s*sitesi|web\s*site|website)\s*[:\-–—,]?\s*((?:https?://|www\.)[a-z0-9][a-z0-9._~:/?#\[\]@!$&'()*+,;=%-]*)"
BARE = (
    r"(?i)(?<![@\w.-])((?:https?://|www\.)?[a-z0-9](?:[a-z0-9-]{0,62}\.)+"
    r"(?:com\.tr|net\.tr|org\.tr|biz\.tr|info\.tr|web\.tr|gen\.tr|com|net|org|tr)(?:/[a-z0-9._~:/?#\[\]@!$&'()*+,;=%-]*)?)"
)
PLAIN = re.compile(r"(?i)(?<![@\w.-])(?:https?://|www\.)?[a-z0-9][a-z0-9.-]+\.(?:com\.tr|com|net\.tr|net|org\.tr|org|tr|cc)(?:/[^\s<>'\"]*)?")
MARKERS = ("website", "web site", "web sitesi", "internet sitesi", "resmi site", "official site", "web")
FILES = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".rar")
CONTEXT_CHARS, NEAR_CHARS, MAX_WEBSITES = 500, 100, 5


def _excluded(host: Column) -> Column:
    return F.exists(U.suffixes(host), lambda s: F.array_contains(F.array(*map(F.lit, W.EXCLUDED_DOMAINS)), s)) | U.is_foreign(host)


def _site(url: Column) -> Column:
    """Scheme and host as they are written."""
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)


def snippet_websites(snippet: Column | str, source: Column) -> Column:
    """Sites that a search result's text names, in order: after a label, and in documents (.pdf) also bare ones."""
    text = T.text_or_empty(snippet)
    is_document = F.lower(U.path(source)).endswith(".pdf")
    bare = F.when(is_document, F.regexp_extract_all(text, F.lit(BARE), F.lit(1))).otherwise(F.array().cast("array<string>"))
    found = F.concat(F.regexp_extract_all(text, F.lit(LABELLED), F.lit(1)), bare)
    own = U.host(source)

    def address(raw: Column) -> Column:
        cut = F.regexp_replace(raw, r'[.,;:)\]}"]+$', "")
        return F.when(cut.rlike("^https?://"), cut).otherwise(F.concat(F.lit("https://"), cut))

    def fits(u: Column) -> Column:
        return T.let(U.host(u), lambda h: U.is_valid_host(h) & (h != own) & (U.registrable(h) != U.registrable(own)) & ~_excluded(h))

    kept = F.filter(F.transform(found, address), fits)
    return F.array_distinct(F.filter(F.transform(kept, _site), lambda s: s != ""))


def _links(url: str | None, html: str | None) -> list[tuple[str, str, str, bool]]:
    """(address, label, context, whether it is a link) of a page's links, and then of addresses in its text."""
    root = markup.tree(html)
    out = []
    for x in root.walk():
        if x.tag == "a" and "href" in x.attributes:
            label = " ".join(filter(None, [x.text(), x.attributes.get("title", ""), x.attributes.get("aria-label", "")]))
            out.append((x.attributes["href"], label, x.parent.text(CONTEXT_CHARS) if x.parent else "", True))
    text = root.text()
    return out + [(m[0], m[0], text[max(0, m.start() - NEAR_CHARS) : m.end() + NEAR_CHARS], False) for m in PLAIN.finditer(text)]


def links_in_context(pages: DataFrame, *keep: str) -> DataFrame:
    """row (the columns `keep`), n (from 0 on a page), address, label, context and is_link. pages: url and html."""
    source = pages.select(F.struct(*[pages[c] for c in keep]).alias("row"), "url", "html")
    names = ["row", "n", "address", "label", "context", "is_link"]
    schema = StructType([source.schema["row"]]).add("n", "long").add("address", "string").add("label", "string").add("context", "string").add("is_link", "boolean")

    def run(batches):
        for batch in batches:
            found = [(i, n, *x) for i, (u, h) in enumerate(zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)) for n, x in enumerate(_links(u, h))]
            columns = [pa.array([r[k] for r in found], t) for k, t in ((1, pa.int64()), (2, pa.string()), (3, pa.string()), (4, pa.string()), (5, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array([r[0] for r in found], pa.int64())), *columns], names=names)

    return source.mapInArrow(run, schema)


def with_details(profiles: DataFrame, documents: DataFrame) -> DataFrame:
    """profile, place, url and html: the profiles' pages, and behind them the recorded pages `.../detail` of the same host that they link to.

    profiles: profile (its url), url, html. documents: url, html.
    """
    first = profiles.select("profile", F.lit(0).cast("long").alias("place"), "url", "html")
    links = F.regexp_extract_all(T.text_or_empty("html"), F.lit(r"""(?i)<a\s[^>]*href\s*=\s*["']([^"']+)["']"""), F.lit(1))
    found = profiles.select("profile", "url", F.posexplode(links).alias("n", "href"))
    base = F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]+)", 1)
    target = F.when(F.col("href").rlike("^[a-zA-Z]+://"), F.col("href")).when(F.col("href").startswith("//"), F.concat(F.lit("https:"), F.col("href"))).when(F.col("href").startswith("/"), F.concat(base, F.col("href")))
    target = F.coalesce(target, F.concat(F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]+(?:/[^?#]*/|/)?)", 1), F.col("href")))
    named = found.withColumn("target", target).where((U.host("target") == U.host("profile")) & F.regexp_replace(U.path("target"), "/+$", "").endswith("/detail"))
    wanted = named.where(F.regexp_replace("target", "/+$", "") != F.regexp_replace("url", "/+$", "")).groupBy("profile", "target").agg((F.min("n") + 1).alias("place"))
    once = documents.where("url is not null").groupBy("url").agg(F.min("html").alias("html"))
    return first.unionByName(wanted.join(once.withColumnRenamed("url", "target"), "target").select("profile", "place", F.col("target").alias("url"), "html"))


def profile_websites(pages: DataFrame, health: DataFrame | None = None, limit: int = MAX_WEBSITES) -> DataFrame:
    """(profile, url, label, explicit, source_url, place): the sites that profiles point to, labelled ones first, `limit` at most (a ranking).

    pages: profile, place, url, html. health: host and circuit_open; profiles of hosts with an open circuit are left out.
    """
    if health is not None:
        open_ = health.where("circuit_open").select(F.col("host").alias("closed")).distinct()
        pages = pages.withColumn("closed", U.host("profile")).join(open_, "closed", "left_anti").drop("closed")
    found = links_in_context(pages, "profile", "place", "url").select("row.*", "n", "address", "label", "context", "is_link")
    raw = F.trim("address")
    normal = (
        F.when((raw == "") | raw.rlike("^(?:mailto:|tel:|javascript:|#)"), None).when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).when(F.contains(raw, F.lit("://")), raw)
        .when(raw.startswith("www.") | (F.contains(raw, F.lit(".")) & ~raw.startswith("/")), F.concat(F.lit("https://"), raw))
    )
    marked = lambda c: T.has_any(T.normalize(c), MARKERS)
    explicit = F.when(F.col("is_link"), marked("label") | marked("context")).otherwise(marked("context"))
    known = found.withColumns({"target": normal, "explicit": explicit}).where("target is not null").withColumns({"host": U.host("target"), "own": U.host("profile")})
    apart = (F.col("host") != "") & (F.col("host") != F.col("own")) & ~F.col("host").endswith(F.concat(F.lit("."), F.col("own")))
    kept = known.where(apart & ~_excluded(F.col("host")) & ~F.lower(U.path("target")).rlike(r"\.(?:" + "|".join(x[1:] for x in FILES) + ")$")).withColumn("site", _site(F.col("target"))).where("site <> ''")
    order = F.struct("place", "n")
    first = kept.groupBy("profile", "site").agg(F.min(F.struct(order.alias("at"), "label", "explicit", F.col("url").alias("source_url"))).alias("f"))
    rank = F.row_number().over(Win.partitionBy("profile").orderBy(F.desc("f.explicit"), "f.at"))
    best = first.withColumn("rank", rank).where(F.col("rank") <= limit)
    return best.select("profile", F.col("site").alias("url"), "f.label", "f.explicit", "f.source_url", F.col("rank").cast("long").alias("place"))
