"""Contacts of companies in order: what was seen of each value, put together, and ranked by ownership, page, role and more.

Records: company, website, value, source_url, label (contact role) and method (http, render, ...). Values are
put together by company before they are ranked, so a value seen on many pages is one row.

Defined cases: null and empty values, and those that are no number or no usable address, are left out;
a record without source counts as no observation; null labels are general, null methods http.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from orgweave.functions import contact as C
from orgweave.functions import text as T
from orgweave.functions import url as U
from orgweave.sources.shared import written

# Priorities of pages, of telephone roles and of e-mail roles, and the least affinity of an address.
PAGES = {"contact": 6, "locations": 5, "document": 4, "about": 3, "homepage": 2, "legal": 1, "privacy": 0, "other": 1}
PHONE_ROLES = {
    "headquarters": 100, "general": 90, "specialist": 85, "sales": 82, "export": 82, "istanbul": 78, "izmir": 78, "ankara": 78, "whatsapp": 75, "factory": 65,
    "branch": 60, "marketing": 45, "owner": 40, "fax": -100,
}
EMAIL_ROLES = {"sales": 6, "export": 6, "office": 5, "headquarters": 5, "general": 4, "specialist": 3, "factory": 2, "branch": 2, "marketing": 0, "privacy": -10}
MIN_AFFINITY = 15


def priority(key: Column, table: dict[str, int]) -> Column:
    """The table's number for a key, 0 for others."""
    numbers = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(numbers, key), F.lit(0))


def together(records: DataFrame, value: Column) -> DataFrame:
    """company, website, value, source_url, label, method of the best source, scope and observations of each value.

    The best source has the best page, then plain http, then the last address.
    """
    url, method = T.text_or_empty("source_url"), F.coalesce("method", F.lit("http"))
    # Equal records change neither a maximum nor a distinct count, so each is read once. Both steps are written: conditions
    # on a value and on what follows from it would else be computed for every record, with all that the record is made of.
    once = records.select("company", "website", "value", "source_url", "label", "method").distinct()
    valued = once.select("company", "website", value.alias("value"), url.alias("source_url"), F.coalesce("label", F.lit("general")).alias("label"), method.alias("method"))
    known = written(valued, "valued").where("value <> ''")
    scoped = known.withColumn("scope", U.page_scope("source_url"))
    best = F.max(F.struct(priority(F.col("scope"), PAGES).alias("p"), (F.col("method") == "http").cast("int").alias("h"), "source_url", "label", "method", "scope")).alias("b")
    seen = F.count_distinct(F.when(F.col("source_url") != "", F.col("source_url"))).alias("observations")
    grouped = scoped.groupBy("company", "website", "value").agg(best, seen)
    return written(grouped.select("company", "website", "value", "b.source_url", "b.label", "b.method", "b.scope", "observations"), "together")


def _ranked(rows: DataFrame, keys: list[Column]) -> DataFrame:
    order = F.row_number().over(Win.partitionBy("company").orderBy(F.desc("rank")))
    reason = F.concat(F.lit("role="), F.col("label"), F.lit(";scope="), F.col("scope"), F.lit(";observations="), F.col("observations").cast("string"))
    return rows.withColumn("rank", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])).withColumns({"place": order.cast("long"), "reason": reason})


def rank_phones(records: DataFrame) -> DataFrame:
    """company, value, source_url, label, observations, reason and place of national numbers but faxes, by six keys."""
    rows = together(records, C.normalize_phone(T.text_or_empty("value"))).where("label <> 'fax'")
    c = F.col
    keys = [priority(c("label"), PHONE_ROLES), C.phone_type_rank(c("value")), priority(c("scope"), PAGES), c("observations"), (c("method") == "http").cast("int"), c("value")]
    return _ranked(rows, keys).select("company", "value", "source_url", "label", "observations", "reason", "place")


def same_family(a: Column, b: Column) -> Column:
    """Whether one of two domain cores is the other or within it."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def rank_emails(records: DataFrame) -> DataFrame:
    """company, value, source_url, label, observations, affinity, reason and place of usable addresses, by eight keys.

    The site's own family of domains first, then affinity (the family, a word of the name, a national domain), page,
    role, a localised page or mailbox, observations and the preferred first parts. Addresses with little affinity are left out.
    """
    value = F.lower(F.trim(T.text_or_empty("value")))
    usable = F.when(value.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$") & ~C.is_placeholder(value) & ~C.is_blocked(value), value)
    c = F.col
    rows = together(records, usable).withColumns({"local": F.substring_index("value", "@", 1), "domain": T.normalize(F.regexp_replace(F.substring_index("value", "@", -1), "^www\\.", ""))})
    rows = rows.withColumns({"root": U.compact_core(c("domain")), "site": U.compact_core(U.host("website"))})
    rows = rows.withColumns({"family": same_family(c("root"), c("site")), "said": T.normalize(F.concat_ws(" ", "local", "root"))})
    named = F.exists(T.distinctive_tokens("company"), lambda t: F.contains(c("said"), t))
    affinity = F.when(c("family"), 80).otherwise(0) + F.when(named, 35).otherwise(0) + F.when(c("domain").rlike(r"\.tr$"), 5).otherwise(0)
    path = F.lower(F.regexp_extract("source_url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    local = F.when(path.rlike(r"(?:^|/)(?:tr|tr-tr|tr_tr|turkiye|turkey)(?:/|$)"), 2).otherwise(0) + F.when(c("local").rlike(r"(?:^|[._-])(?:tr|turkiye|turkey)(?:[._-]|$)"), 1).otherwise(0)
    rows = rows.withColumn("affinity", affinity).where(F.col("affinity") >= MIN_AFFINITY)
    keys = [c("family").cast("int"), c("affinity"), priority(c("scope"), PAGES), priority(c("label"), EMAIL_ROLES), local, c("observations"), -C.prefix_rank(c("value")), c("value")]
    own = F.concat(F.lit("domain_family="), c("family").cast("int").cast("string"), F.lit(";scope="), c("scope"), F.lit(";role="), c("label"), F.lit(";observations="), c("observations").cast("string"))
    return _ranked(rows, keys).withColumn("reason", own).select("company", "value", "source_url", "label", "observations", "affinity", "reason", "place")


# States of a mail domain's DNS, and ways of reading a page that may be published from.
DNS_ACCEPTED, DNS_REJECTED = ("verified", "valid"), ("invalid_domain",)
SAFE_METHODS = ("http", "http_tls_unverified", "browser_render", "pdf_text", "pdf_ocr", "official_link_reference", "unknown")


def _same_site(a: Column, b: Column) -> Column:
    own = U.registrable(U.host(a))
    return F.coalesce((U.host(a) != "") & (own == U.registrable(U.host(b))), F.lit(False))


def source_decision(website: Column, source_url: Column, method: Column, family: Column) -> Column:
    """(ok, reason): whether a contact's page is the verified site's own, or of its verified family, and was read in a safe way."""
    url, how = T.text_or_empty(source_url), F.coalesce(F.nullif(method, F.lit("")), F.lit("unknown"))
    same = _same_site(url, website)
    reason = (
        F.when(url == "", "missing_first_party_source_url").when(~F.lower(url).rlike("^https?://"), "non_http_first_party_source")
        .when(~same & ~F.coalesce(family, F.lit(False)), "source_outside_verified_official_family").when(~how.isin(*SAFE_METHODS), F.concat(F.lit("unsupported_retrieval_method:"), how))
        .when(same, "verified_first_party_source").otherwise("verified_official_family_source")
    )
    return T.let(reason, lambda r: F.struct(r.startswith("verified_").alias("ok"), r.alias("reason")))


def _decision(blockers: Column, allowed: Column) -> Column:
    return T.let(F.array_distinct(F.array_compact(blockers)), lambda b: F.struct((F.size(b) == 0).alias("eligible"), F.when(F.size(b) == 0, allowed).otherwise(F.array_join(b, ";")).alias("reason")))


def gate_email(website: Column, value: Column, source_url: Column, method: Column, dns: Column, company_domain: Column, family: Column) -> Column:
    """(eligible, reason) of an address: its source, its DNS, and for other domains a proof that they are the company's."""
    v, state, own = F.lower(F.trim(T.text_or_empty(value))), F.coalesce(dns, F.lit("not_checked")), F.coalesce(company_domain, F.lit(False))

    def judged(s: Column) -> Column:
        same = F.contains(v, F.lit("@")) & _same_site(F.substring_index(v, "@", -1), website)
        blockers = F.array(
            F.when((v == "") | ~F.contains(v, F.lit("@")), "invalid_email_syntax"), F.when(~s["ok"], s["reason"]), F.when(state.isin(*DNS_REJECTED), "email_domain_invalid"),
            F.when(~same & ~state.isin(*DNS_ACCEPTED) & ~(s["ok"] & own & ~state.isin(*DNS_REJECTED)), "cross_domain_email_dns_unverified"),
        )
        allowed = F.when(same, s["reason"]).when(own, "first_party_cross_domain_company_identity").otherwise("verified_cross_domain_email_from_first_party_source")
        return _decision(blockers, allowed)

    return T.let(source_decision(website, source_url, method, family), judged)


def gate_phone(website: Column, value: Column, label: Column, source_url: Column, method: Column, family: Column) -> Column:
    """(eligible, reason) of a number: valid, no fax, from the site itself or its family."""

    def judged(s: Column) -> Column:
        blockers = F.array(F.when(C.normalize_phone(T.text_or_empty(value)).isNull(), "invalid_phone"), F.when(F.lower(T.text_or_empty(label)) == "fax", "fax_not_company_phone"), F.when(~s["ok"], s["reason"]))
        return _decision(blockers, s["reason"])

    return T.let(source_decision(website, source_url, method, family), judged)
