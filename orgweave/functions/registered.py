"""Functions by name for SQL text: `register_functions(spark)`, then `select company_key(name) ...` or `lateral list_cards(html, url)`.

Scalar ones are SQL functions, so a query stays in the JVM and the optimiser sees through them. Table functions
read markup in Python, a page at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from orgweave.functions import html as H
from orgweave.functions import listings
from orgweave.functions import words as W

_QUOTED = lambda words: ", ".join(f"'{w}'" for w in words)
_LABELS = lambda h, n: f"substring_index({h}, '.', -{n})"
#: name -> (parameters, type, body); later ones use those before them
SCALARS = {
    "normalize_name": ("value string", "string", f"lower(translate(coalesce(value, ''), '{W.FOLD_FROM}', '{W.FOLD_TO}'))"),
    "name_tokens": ("value string", "array<string>", "regexp_extract_all(normalize_name(value), '[a-z0-9]+', 0)"),
    "legal_name_tokens": ("value string", "array<string>", f"filter(name_tokens(value), t -> t not in ({_QUOTED(sorted({*W.LEGAL_WORDS, *W.JOINING_WORDS}))}) and length(t) > 1)"),
    "company_key": ("value string", "string", "regexp_replace(normalize_name(value), '[^a-z0-9]+', '')"),
    "url_host": ("url string", "string", r"normalize_name(regexp_replace(regexp_extract(lower(trim(coalesce(url, ''))), '^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]+)', 1), '^www[.]', ''))"),
    "registrable_domain": ("host string", "string", f"if({_LABELS('host', 2)} in ({_QUOTED(W.MULTI_PART_SUFFIXES)}), {_LABELS('host', 3)}, {_LABELS('host', 2)})"),
    "same_site": ("a string, b string", "boolean", "registrable_domain(url_host(a)) <> '' and registrable_domain(url_host(a)) = registrable_domain(url_host(b))"),
}


@udtf(returnType=", ".join(f"{f} string" for f in listings.FIELDS))
class ListCards:
    """Cards of an exhibitor list."""

    def eval(self, html: str, base: str) -> Iterator[tuple[str, ...]]:
        yield from listings.cards(html, base)


@udtf(returnType="target string, label string, score int, same_site boolean, is_document boolean")
class PageLinks:
    """Links of a page, scored as ways to contact data."""

    def eval(self, html: str, url: str) -> Iterator[tuple[str, str, int, bool, bool]]:
        yield from H._links(url, html)


TABLES = {"list_cards": ListCards, "page_links": PageLinks}


def register_functions(spark: SparkSession) -> list[str]:
    """Makes all functions known to the session's SQL; their names. Doing it again changes nothing."""
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")
    for name, function in TABLES.items():
        spark.udtf.register(name, function)
    return [*SCALARS, *TABLES]
