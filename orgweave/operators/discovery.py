"""What discovery still lacks, when it may stop, what is selectable, and how its sources meet. DataFrame or Column in and out."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from orgweave.functions import names as N
from orgweave.functions import text as T
from orgweave.functions import url as U
from orgweave.functions import words as W
from orgweave.operators.fingerprint import DISCOVERY_ONLY, EXCLUDED_ROLES


def gaps(candidates: DataFrame, company: str, order: list[Column], margin: int = W.AMBIGUITY_MARGIN) -> DataFrame:
    """(company, gaps): what a company's candidates leave open, in a fixed order.

    candidates: role, excluded, score, intrinsic (the domain names the company), legal (a legal name
    or ownership is seen), local (a national domain or context), short_brand and hints (related names
    are known). order: the ranking of a company's candidates. Every company has a row.
    """
    fit = ~F.col("role").isin(*DISCOVERY_ONLY) & ~F.col("excluded")
    place = F.row_number().over(Win.partitionBy(company).orderBy(fit.desc(), *order))
    ranked = candidates.withColumn("__fit", fit).withColumn("__n", place)
    has = lambda c: F.max(F.when(F.col("__fit"), F.col(c)).otherwise(False))
    at = lambda n: F.max(F.when((F.col("__n") == n) & F.col("__fit"), F.col("score")))
    per = ranked.groupBy(company).agg(
        F.count_if("__fit").alias("n"), at(1).alias("s1"), at(2).alias("s2"), F.max("short_brand").alias("short"), has("intrinsic").alias("i"), has("legal").alias("l"), has("local").alias("o"), F.max("hints").alias("h"),
    )
    close = F.coalesce(F.abs(F.col("s1") - F.col("s2")) <= margin, F.lit(False))
    found = (
        ("no_candidates", F.col("n") == 0), ("ambiguous_candidates", close | (F.col("short") & (F.col("n") > 0))), ("missing_intrinsic_domain", ~F.col("i")),
        ("missing_legal_name", ~F.col("l")), ("missing_local_signal", ~F.col("o")), ("relationship_hint", F.col("h")),
    )
    return per.select(company, F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in found])).alias("gaps"))


def can_stop(c: Mapping[str, Column]) -> Column:
    """Whether one candidate is proof enough to end the search.

    c: origin, role, identity, official, exact_brand, brand_words, legal_words, has_contexts,
    context_matches and legal.
    """
    single = c["brand_words"] == 1
    homonym = single & ((c["has_contexts"] & (c["context_matches"] == 0)) | ((c["legal_words"] > 1) & ~c["legal"]))
    proved = ((c["role"] == "company_candidate") | c["identity"]) & (c["official"] > 0) & (c["exact_brand"] | (c["official"] >= 2)) & ~homonym
    return F.when(c["origin"].isin("verified_alias", "verified_entity"), True).when(c["origin"] == "source_profile", False).otherwise(proved)


def selectable(role: Column, score: Column, official: Column, public_brand: Column, minimum: int = W.MIN_ACCEPT) -> Column:
    near = (score >= minimum - 5) & (role == "company_candidate") & (official >= 3) & public_brand
    return ~role.isin(*EXCLUDED_ROLES) & ((score >= minimum) | near)


def hard_context_failure(c: Mapping[str, Column]) -> Column:
    """Whether a failed context rules a candidate out.

    c: failed, arbiter_match, conflict (stated by the site), compound (two brand words or more), exact_brand,
    legal_proof, strong_bundle and discovery_only (listing data that the site just does not repeat).
    """
    excused = c["compound"] & c["exact_brand"] & c["legal_proof"]
    return F.when(~c["failed"] | c["arbiter_match"], False).when(c["conflict"], ~excused).when(c["strong_bundle"] | c["discovery_only"], False).otherwise(True)


def unsafe_context(c: Mapping[str, Column]) -> Column:
    """A hard failure without trusted evidence, unless the domain is exactly the brand. Further: trusted, brand_words, explicit_context."""
    return hard_context_failure(c) & ~c["trusted"] & (~c["exact_brand"] | ((c["brand_words"] == 1) & c["explicit_context"]))


def bridge_supported(company: Column | str, title: Column | str, snippet: Column | str, path: Column | str) -> Column:
    """Whether a search result's own title or address is the company's profile, and its text names the company."""
    said = F.concat_ws(" ", T.text_or_empty(title), T.text_or_empty(snippet))
    words = N.primary_brand(company)
    split = lambda c: F.split(T.normalize(c), r"\s+")
    every = lambda found: F.forall(words, lambda t: F.array_contains(found, t))
    long = F.coalesce(F.length(F.get(words, F.lit(0))) >= 5, F.lit(False))
    named = (F.size(words) > 0) & ((F.size(words) >= 2) | long) & (every(split(title)) | every(split(path)))
    anchored = N.legal_phrase(company, title) | named
    text = F.concat(F.lit(" "), T.normalize(said), F.lit(" "))
    hits = F.forall(words, lambda t: F.contains(text, F.concat(F.lit(" "), t, F.lit(" ")))) & (F.size(words) > 0) & ((F.size(words) >= 2) | long)
    return N.ownership_statement(company, said) | (anchored & (N.legal_phrase(company, said) | hits))


def meet_sources(sources: list[DataFrame], keys: list[str], score: str, shown: str) -> DataFrame:
    """One row for each key: sources from the strongest to the weakest; the strongest one's row is shown, scores take their maximum."""
    placed = [s.withColumn("__p", F.lit(i)) for i, s in enumerate(sources)]
    union = placed[0]
    for other in placed[1:]:
        union = union.unionByName(other)
    best = F.min_by(F.col(shown), F.struct("__p", F.col(shown)))
    return union.groupBy(*keys).agg(best.alias(shown), F.max(score).alias(score), F.min("__p").alias("source"), F.count_distinct("__p").alias("n_sources"))


def enrich(rows: DataFrame, details: DataFrame, on: str, company: str, fields: list[str]) -> DataFrame:
    """rows with the fields of the detail page of the same address, but only where both name the same company."""
    other = details.select(on, T.company_key(company).alias("__k"), *[F.col(f).alias(f"__{f}") for f in fields])
    joined = rows.join(other, on, "left")
    same = F.coalesce((F.col("__k") == T.company_key(company)) & (F.col("__k") != ""), F.lit(False))
    value = lambda f: F.when(same & F.col(f"__{f}").isNotNull() & (F.col(f"__{f}") != ""), F.col(f"__{f}")).otherwise(F.col(f)).alias(f)
    return joined.select(*[value(c) if c in fields else F.col(c) for c in rows.columns])


def cached_source(requests: DataFrame, entries: DataFrame, key: str, version: int, prefix: int) -> DataFrame:
    """requests with the best cached entry: own key and version, a legacy key, an older version, one of the same prefix.

    entries: key, legacy (boolean), version, entry_id. Later entries win within a step; the prefix step is a join of its own.
    """
    exact = requests.select(key).distinct().join(entries.withColumnRenamed("key", key), key)
    step = F.when(~F.col("legacy") & (F.col("version") == version), 0).when(F.col("legacy") & (F.col("version") == version), 1).otherwise(2)
    best = exact.groupBy(key).agg(F.min(F.struct(step.alias("step"), -F.col("version"), -F.col("entry_id"), F.col("entry_id"))).alias("b")).select(key, "b.step", F.col("b.entry_id").alias("entry_id"))
    near = entries.groupBy(F.substring("key", 1, prefix).alias("__p")).agg(F.max("entry_id").alias("__near"))
    joined = requests.join(best, key, "left").withColumn("__p", F.substring(key, 1, prefix)).join(near, "__p", "left").drop("__p")
    return joined.select(*requests.columns, F.coalesce("step", F.when(F.col("__near").isNotNull(), 3)).alias("step"), F.coalesce("entry_id", "__near").alias("entry_id"))


# Queries whose candidates need no identity in the search text, and roles that never carry one.
KNOWN_QUERIES = ("fair_listed_website", "verified_alias", "verified_entity")
NO_IDENTITY_ROLES = ("directory", "fair_profile", "news")


def _said(reasons: Column, *prefixes: str) -> Column:
    return F.exists(reasons, lambda r: reduce(lambda a, b: a | b, [r.startswith(p) for p in prefixes]))


def reviewable_authority(c: Mapping[str, Column]) -> Column:
    """Whether a candidate that cannot be read may wait for review: a registry's, or the exact brand by several official searches. c: host, excluded, query, exact_brand, official_query and score."""
    exact = c["exact_brand"] & (c["official_query"] >= 2) & (c["score"] >= W.MEDIUM_SCORE)
    return (c["host"] != "") & ~c["excluded"] & (c["query"].isin("verified_alias", "verified_entity") | exact)


def unsupported_search_text(c: Mapping[str, Column]) -> Column:
    """Whether nothing but the search's text speaks for a candidate. c: as in reviewable_authority, and resolution, role, reasons and intrinsic."""
    other_owner = _said(c["reasons"], "structured_identity_unmatched:") & ~_said(c["reasons"], "legal_name_ownership_match:")
    bare = _said(c["reasons"], "page_identity_missing:") & _said(c["reasons"], "structured_identity_absent", "structured_identity_unmatched:")
    return (
        F.when(T.text_or_empty(c["resolution"]).startswith("candidate_resolved_by_"), False).when(T.text_or_empty(c["role"]).isin(*NO_IDENTITY_ROLES) | other_owner, True)
        .when((T.text_or_empty(c["role"]) == "company_candidate") | reviewable_authority(c) | c["intrinsic"], False).otherwise(bare)
    )


def listed_conflict(name: Column, host: Column, listed: Column, reasons: Column) -> Column:
    """Whether a candidate's domain contradicts the one that a listing gives, without a legal name that settles it."""
    site, other = U.host(T.text_or_empty(listed)), (U.registrable(U.host(T.text_or_empty(listed))) != U.registrable(host))
    settled = _said(reasons, "legal_name_full_match:", "legal_name_ownership_match:") | (_said(reasons, "legal_name_phrase_match:") & (F.size(T.legal_tokens(name)) >= 2))
    return (site != "") & (host != "") & other & ~settled


def weak_search_identity(c: Mapping[str, Column], name: Column) -> Column:
    """Whether a name of several words is neither on the site nor its domain, and no context stands for it."""
    legal = _said(c["reasons"], "legal_name_full_match:", "legal_name_phrase_match:", "legal_name_ownership_match:")
    weak = (F.size(T.legal_tokens(name)) >= 2) & F.array_contains(c["reasons"], "no_context_tokens") & _said(c["reasons"], "legal_name_phrase_missing:") & ~c["exact_brand"]
    known = T.text_or_empty(c["resolution"]).startswith("candidate_resolved_by_") | T.text_or_empty(c["query"]).isin(*KNOWN_QUERIES)
    return F.when(known | legal, False).otherwise(weak)
