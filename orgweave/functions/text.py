"""Text and name functions: Column in, Column out."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from orgweave.functions import words as W


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row however often body uses it, and once in the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize(c: Column | str) -> Column:
    """Letters folded, then lower case; the dotted capital I is folded first, as lower() makes two characters of it."""
    return F.lower(F.translate(text_or_empty(c), W.FOLD_FROM, W.FOLD_TO))


@pandas_udf(StringType())
def fold_unicode(values: pd.Series) -> pd.Series:
    """Compatibility forms taken apart, case folded, marks dropped, the dotless i as i; null as empty text."""

    def fold(x: str | None) -> str:
        apart = unicodedata.normalize("NFKD", x or "").casefold()
        return "".join(c for c in unicodedata.normalize("NFKD", apart) if not unicodedata.combining(c)).replace("ı", "i")

    return values.map(fold)


@pandas_udf(StringType())
def unescape(values: pd.Series) -> pd.Series:
    """Character references of HTML decoded; null as empty text."""
    return values.map(lambda x: html.unescape(x or ""))


def clean(c: Column | str) -> Column:
    """Without control characters, white space runs as one space."""
    no_control = F.regexp_replace(text_or_empty(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.trim(F.regexp_replace(no_control, r"\s+", " "))


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(normalize(c), F.lit("[a-z0-9]+"), F.lit(0))


def _without(of: Column, stop: tuple[str, ...]) -> Column:
    listed = F.array(*map(F.lit, sorted(set(stop))))
    return F.filter(of, lambda t: ~F.array_contains(listed, t) & (F.length(t) > 1))


def legal_tokens(c: Column | str) -> Column:
    """Words of a legal name without its legal form."""
    return _without(tokens(c), W.LEGAL_WORDS + W.JOINING_WORDS)


def distinctive_tokens(c: Column | str) -> Column:
    """Words that are no form, sector or trade; all but the form if none is left."""
    stop = W.LEGAL_WORDS + W.SECTOR_WORDS + W.BUSINESS_WORDS
    return let(tokens(c), lambda t: let(_without(t, stop), lambda n: F.when(F.size(n) > 0, n).otherwise(_without(t, W.LEGAL_WORDS))))


def brand_tokens(c: Column | str, limit: int | None = None) -> Column:
    own = let(distinctive_tokens(c), lambda t: let(_without(t, W.BRAND_GENERIC_WORDS), lambda n: F.when(F.size(n) > 0, n).otherwise(t)))
    return F.slice(own, 1, limit) if limit else own


def brand_compound(c: Column | str, limit: int = 2) -> Column:
    return F.array_join(brand_tokens(c, limit), "")


def has_phrase(haystack: Column, needle: Column) -> Column:
    """Whether the needle's words stand together in the haystack's; false for an empty needle."""
    padded = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return (F.size(needle) > 0) & F.contains(padded(haystack), padded(needle))


def phrase_count(text: Column, phrase: Column) -> Column:
    """How often the phrase stands in the text between spaces; neighbours share the space between them."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    needle = F.concat(F.lit(" "), phrase, F.lit(" "))
    return F.floor((F.length(padded) - F.length(F.replace(padded, needle, F.lit("")))) / F.length(needle))


def company_key(c: Column | str) -> Column:
    """The normalised name's letters and digits alone."""
    return F.regexp_replace(normalize(c), "[^a-z0-9]+", "")


def fold_key(c: Column | str) -> Column:
    return F.lower(F.trim(text_or_empty(c)))


def contexts(c: Column | str) -> Column:
    """Contexts of which any alias stands in the text as words."""
    padded = F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))
    tagged = []
    for name, aliases in W.CONTEXTS.items():
        any_alias = F.lit(False)
        for alias in aliases:
            any_alias = any_alias | F.contains(padded, F.lit(f" {alias} "))
        tagged.append(F.when(any_alias, F.lit(name)))
    return F.array_compact(F.array(*tagged))


# What a contact's label says and what a query is for, first match wins, and the intents' priorities.
LABELS = (
    ("fax", ("fax", "faks")), ("whatsapp", ("whatsapp", "whats app", "wa.me")),
    ("headquarters", ("headquarters", "genel merkez", "merkez ofis", "merkez")), ("specialist", ("specialist", "uzman")),
    ("owner", ("owner", "sahibi", "yetkili")), ("marketing", ("marketing", "pazarlama")), ("sales", ("sales", "satis", "satış")),
    ("export", ("export", "ihracat")), ("istanbul", ("istanbul",)), ("izmir", ("izmir",)), ("ankara", ("ankara",)),
    ("factory", ("factory", "fabrika")), ("branch", ("branch", "sube", "şube")),
)
INTENT_PRIORITY = {"relationship": 100, "legal_identity": 95, "contact": 90, "country_official": 80, "official": 70, "context": 60}


def has_any(text: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


def first_of(text: Column, rules: tuple[tuple[str, tuple[str, ...]], ...], default: str) -> Column:
    """The first rule one of whose markers stands in the text."""
    out = F.lit(default)
    for name, markers in reversed(rules):
        out = F.when(has_any(text, markers), F.lit(name)).otherwise(out)
    return out


def contact_label(c: Column | str) -> Column:
    return first_of(F.lower(F.regexp_replace(text_or_empty(c), r"\s+", " ")), LABELS, "general")


def query_intent(c: Column | str) -> Column:
    text = normalize(c)
    official = F.contains(text, F.lit("official website"))
    return (
        F.when(has_any(text, ("distributor", "temsilci", "marka resmi")), "relationship")
        .when(has_any(text, ("kvkk", "ticari unvan")), "legal_identity")
        .when(has_any(text, ("contact", "iletisim")), "contact")
        .when(official & F.contains(text, F.lit("turkiye")), "country_official")
        .when(official | has_any(text, ("resmi sitesi", "web sitesi")), "official")
        .otherwise("context")
    )


def intent_priority(intent: Column) -> Column:
    out = F.lit(0)
    for name, value in INTENT_PRIORITY.items():
        out = F.when(intent == name, F.lit(value)).otherwise(out)
    return out


def initials(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda t: F.substring(t, 1, 1)), "")


def abbreviation_match(names: Column, compact: Column) -> Column:
    """Of two words or more: their initials, the first word with the others' initials (4 letters or more), or joined prefixes of 3 or 4 letters."""
    merged = lambda n: F.array_join(F.transform(F.filter(names, lambda t: F.length(t) >= n), lambda t: F.substring(t, 1, n)), "")
    head = F.concat(F.get(names, F.lit(0)), initials(F.slice(names, 2, 1000)))
    found = F.contains(compact, initials(names))
    for part in (head, merged(3), merged(4)):
        found = found | ((F.length(part) >= 4) & F.contains(compact, part))
    return F.coalesce((F.size(names) >= 2) & found, F.lit(False))


def split_hints(c: Column | str, limit: int = 3) -> Column:
    """Parts of a list in one cell, trimmed, without empty ones."""
    parts = F.transform(F.split(text_or_empty(c), r"[;,/|]"), lambda p: F.trim(p))
    return F.slice(F.array_distinct(F.filter(parts, lambda p: F.length(p) > 1)), 1, limit)
