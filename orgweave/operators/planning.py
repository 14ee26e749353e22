"""Search plans: the queries that a company's open gaps ask for. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orgweave.functions import names as N
from orgweave.functions import text as T

# Corporate words that are no part of a brand to search by.
CORPORATE = ("anonim", "limited", "sirket", "sirketi", "sanayi", "ticaret")


def queries(
    company: Column, gaps: dict[str, Column], related: Column, brands: Column, representations: Column, city: Column, context: Column, sector: Column
) -> Column:
    """Queries in order of worth. gaps: no_candidates, ambiguous_candidates, missing_intrinsic_domain, missing_legal_name,
    missing_local_signal and relationship_hint; related, brands and representations: arrays of names; the rest may be null or empty.
    """
    full = F.trim(F.regexp_replace(company, r"\s+", " "))
    words = F.filter(N.primary_brand(company), lambda t: ~t.isin(*CORPORATE))
    joined = T.let(F.array_join(words, " "), lambda w: F.nullif(w, F.lit("")))
    named = T.let(full, lambda f: F.struct(f.alias("full"), F.coalesce(joined, f).alias("brand")))
    return T.let(named, lambda n: _planned(n["full"], n["brand"], gaps, related, brands, representations, city, context, sector))


def _planned(full, brand, gaps, related, brands, representations, city, context, sector) -> Column:
    quoted = lambda x, rest: F.concat(F.lit('"'), x, F.lit('"'), F.lit(rest))

    def when(*names: str) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | gaps[n]
        return out

    def one(condition: Column, query: Column) -> Column:
        return F.when(condition, F.array(query)).otherwise(F.array().cast("array<string>"))

    def each(condition: Column, names: Column, rest: str) -> Column:
        return F.when(condition, F.transform(names, lambda x: quoted(x, rest))).otherwise(F.array().cast("array<string>"))

    said = lambda x: F.coalesce(x, F.lit("")) != ""
    domain = when("no_candidates", "ambiguous_candidates", "missing_intrinsic_domain")
    relation = when("no_candidates", "missing_intrinsic_domain", "relationship_hint")
    local = when("ambiguous_candidates", "missing_local_signal")
    planned = F.concat(
        each(when("relationship_hint"), related, " Turkiye official website"),
        one(domain, quoted(brand, " Turkiye resmi sitesi")),
        one(domain & (full != brand), quoted(full, " web sitesi")),
        one(when("no_candidates", "missing_legal_name"), quoted(brand, " kvkk")),
        one(when("missing_legal_name"), quoted(full, " ticari unvan")),
        each(relation, representations, " Turkiye distributor temsilci"),
        each(relation, brands, " Turkiye marka resmi sitesi"),
        one(local & said(city), F.concat(quoted(full, " "), quoted(city, ""))),
        one(local & said(context), F.concat(quoted(brand, " "), context, F.lit(" Turkiye"))),
        one(local & said(sector), F.concat(quoted(brand, " "), quoted(sector, ""))),
        one(when("no_candidates", "missing_local_signal"), quoted(brand, " iletisim Turkiye")),
    )
    return F.when(brand == "", F.array().cast("array<string>")).otherwise(planned)


def query_key(q: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(q, r"\s+", " ")))


def without(planned: Column, done: Column, limit: int) -> Column:
    """The planned queries that have not run, each once, `limit` at most; case and white space make no difference."""

    def first(x: Column) -> Column:
        fresh = lambda q, i: T.let(F.get(x["keys"], i), lambda k: (F.array_position(x["keys"], k) == i + 1) & ~F.array_contains(x["ran"], k))
        return F.slice(F.filter(x["planned"], fresh), 1, limit)

    # plans and keys once a row: a lambda computes what it does not get by a variable anew for every query
    keyed = T.let(planned, lambda p: F.struct(p.alias("planned"), F.transform(p, query_key).alias("keys"), F.transform(done, query_key).alias("ran")))
    return T.let(keyed, first)
