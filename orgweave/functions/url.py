"""URL, host and domain functions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orgweave.functions import words as W
from orgweave.functions.text import first_of, normalize, text_or_empty


def host(c: Column | str) -> Column:
    """The host of a URL or bare domain, without user, port and a leading www."""
    found = F.regexp_extract(F.lower(F.trim(text_or_empty(c))), r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]+)", 1)
    return normalize(F.regexp_replace(found, r"^www\.", ""))


def is_valid_host(h: Column) -> Column:
    labels = F.split(h, r"\.")
    last = F.element_at(labels, -1)
    each = F.forall(labels, lambda x: x.rlike("^[a-z0-9]([a-z0-9-]*[a-z0-9])?$") & (F.length(x) <= 63))
    return (F.length(h) <= 253) & F.contains(h, F.lit(".")) & each & last.rlike("^[a-z]{2,}$") & ~last.isin("asp", "aspx", "php", "html", "htm", "jsp")


def registrable(h: Column) -> Column:
    """The last two labels, three below a public suffix of two."""
    return F.when(F.substring_index(h, ".", -2).isin(*W.MULTI_PART_SUFFIXES), F.substring_index(h, ".", -3)).otherwise(F.substring_index(h, ".", -2))


def core(h: Column) -> Column:
    shorter = F.regexp_replace(h, r"(\.com\.tr|\.net\.tr|\.org\.tr|\.co\.uk)$", "")
    return F.when(shorter != h, shorter).otherwise(F.regexp_replace(h, r"\.[a-z]{2,}$", ""))


def compact_core(h: Column) -> Column:
    return F.regexp_replace(core(h), "[^a-z0-9]", "")


def suffixes(h: Column) -> Column:
    """The host and all its parent domains, to join with a list of domains."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def is_public_body(h: Column) -> Column:
    out = F.lit(False)
    for s in W.PUBLIC_BODY_SUFFIXES:
        out = out | h.endswith(s)
    return out


def is_foreign(h: Column) -> Column:
    return F.contains(h, F.lit(".")) & F.substring_index(h, ".", -1).isin(*W.FOREIGN_TLDS)


def tld_bonus(h: Column) -> Column:
    return F.when(h.endswith(".com.tr"), 8).when(h.endswith(".tr"), 5).otherwise(0)


def path(c: Column | str) -> Column:
    return F.regexp_extract(F.lower(text_or_empty(c)), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def canonical_site(c: Column | str) -> Column:
    scheme = F.regexp_extract(F.lower(text_or_empty(c)), r"^(https?)://", 1)
    return F.concat(F.when(scheme == "", F.lit("https")).otherwise(scheme), F.lit("://"), host(c))


def strip_tracking(c: Column | str) -> Column:
    """The URL without campaign and click parameters and without its fragment."""
    no_fragment = F.regexp_replace(text_or_empty(c), "#.*$", "")
    less = F.regexp_replace(no_fragment, r"(utm_[a-z]+|gclid|fbclid|ref)=[^&]*&?", "")
    return F.regexp_replace(less, r"[?&]$", "")


# What a page is for by the words of its path, first match wins.
SCOPES = (
    ("legal", ("kvkk", "legal", "ticari bilgi", "sirket bilgi", "imprint")),
    ("privacy", ("privacy", "gizlilik", "veri koruma", "data protection")),
    ("contact", ("contact", "iletisim", "bize ulas")),
    ("locations", ("location", "lokasyon", "sube", "branch", "factory", "fabrika")),
    ("about", ("about", "hakkimizda", "kurumsal", "corporate")),
    ("document", ("pdf", "catalog", "catalogue", "katalog", "brochure", "brosur")),
)


def page_scope(c: Column | str) -> Column:
    p = normalize(path(c))
    return F.when(F.regexp_replace(p, "[ /]+", "") == "", F.lit("homepage")).otherwise(first_of(p, SCOPES, "other"))


def scope_priority(scope: Column) -> Column:
    order = ("contact", "locations", "about", "homepage", "legal", "privacy", "document", "other")
    out = F.lit(0)
    for i, name in enumerate(order):
        out = F.when(scope == name, F.lit(len(order) - i)).otherwise(out)
    return out
