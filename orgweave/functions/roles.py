"""What a search result's page is: a company's own site, a directory, a fair's profile, news, a marketplace, a shared listing or none of these."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orgweave.functions import text as T
from orgweave.functions import url as U
from orgweave.functions import words as W

# Markers of each role, in a result's text, its host and its path.
DIRECTORY = (
    "directory", "firma rehberi", "company profile", "companies list", "supplier profile", "exporters", "marketplace", "yellow pages", "firmalar", "firma listesi", "company directory",
)
FAIR = ("exhibitor", "katilimci", "trade fair", "expo profile")
FAIR_PAGE = ("katilimci", "exhibitor", "trade fair", "fuari", "salon", "stant", "hall", "booth")
FAIR_HOST = ("expo", "fuar", "exhibition")
FAIR_WORDS = ("fair", "fuar", "expo", "exhibition")
MARKETPLACE = ("marketplace", "urunleri", "products", "supplier", "satici", "magaza")
NEWS = ("haber", "news", "basin bulteni", "press release")
NEWS_HOST = ("haber", "gazete", "news", "medya", "insesi")
NEWS_PATH = ("basin odasi", "basin bulteni", "press room", "press release", "news", "haber")
PROFILE_PATH = ("company", "companies", "firma", "firmalar", "profile", "supplier", "exhibitor", "katilimci", "listing", "member", "detail")
SHARED_COMPANIES = 2
RECORD = r"/(?:company|firma|member|exhibitor)/[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}(?:/|$)"
ENTITY_QUERY = r"(?:^|&)(?:slug|company|companyid|company_id|firma|member|supplier|exhibitor)="
DETAIL = r"/(?:company|firma|girisim|girişim|supplier|member|exhibitor)[-_]?(?:profile|profil|detail|detay)(?:/|$)"
NUMBERED = r"/(?:firma|company|member)[-_]\d+(?:[-_/]|$)"
ENTITY_PATH = r"/(?:company|companies|firma|firmalar|supplier|exhibitor|katilimci|member)/(?:view/)?[^/]+"
BRAND_PATH = r"/(?:brand|detail)/[^/]+"


def _decoded(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))), part)


def _count(text: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for m in markers:
        out = out + F.contains(text, F.lit(m)).cast("int")
    return out


def candidate_role(url: Column, title: Column | str, snippet: Column | str, own_domain: Column, companies: Column) -> Column:
    """The role of a result. own_domain: its host names the company; companies: for how many companies its host was found."""
    whole = T.text_or_empty(url)
    host = U.host(whole)
    raw_path = F.lower(_decoded(F.regexp_extract(whole, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)))
    raw_query = F.lower(_decoded(F.regexp_extract(whole, r"^[^?#]*\?([^#]*)", 1)))

    def read(p: Column) -> Column:
        path = T.normalize(F.replace(p["raw_path"], F.lit("/"), F.lit(" ")))
        text = T.normalize(F.concat_ws(" ", p["host"], path, T.text_or_empty(title), T.text_or_empty(snippet)))
        return F.struct(p["host"].alias("host"), p["raw_path"].alias("raw"), p["raw_query"].alias("query"), path.alias("path"), text.alias("text"))

    def judged(p: Column) -> Column:
        h, raw, path, text = (p[k] for k in ("host", "raw", "path", "text"))
        directory = _count(text, DIRECTORY)
        generic = T.has_any(h, W.GENERIC_KEYWORDS)
        profile = F.arrays_overlap(F.split(path, r"\s+"), F.array(*map(F.lit, PROFILE_PATH)))
        fair = T.has_any(text, FAIR_WORDS)
        rules = (
            (U.is_public_body(h), "public_body"), (raw.rlike(RECORD), "directory"), (T.has_any(h, FAIR_HOST) & T.has_any(text, FAIR_PAGE), "fair_profile"), (T.has_any(h, NEWS_HOST), "news"),
            (p["query"].rlike(ENTITY_QUERY) | raw.rlike(DETAIL) | raw.rlike(NUMBERED), "directory"), (own_domain, "company_candidate"), (T.has_any(path, NEWS_PATH), "news"),
            ((directory >= 2) | ((directory > 0) & generic), "directory"), (raw.rlike(ENTITY_PATH) & (directory > 0), "directory"), (generic & raw.rlike(BRAND_PATH) & fair, "fair_profile"),
            (generic & raw.rlike(BRAND_PATH), "directory"), (_count(text, FAIR) >= 2, "fair_profile"), (T.has_any(path, ("exhibitor", "katilimci")) & fair, "fair_profile"),
            ((_count(text, MARKETPLACE) >= 2) & (profile | generic), "marketplace"), (_count(text, NEWS) >= 2, "news"),
            ((companies >= SHARED_COMPANIES) & (profile | generic | (directory > 0)), "shared_listing"),
        )
        out = F.lit("unknown")
        for condition, role in reversed(rules):
            out = F.when(F.coalesce(condition, F.lit(False)), F.lit(role)).otherwise(out)
        return out

    parts = F.struct(host.alias("host"), raw_path.alias("raw_path"), raw_query.alias("raw_query"))
    return T.let(T.let(parts, read), judged)
