"""Registries of names and sites, resolvers' answers, entity memory, relationships and selections: DataFrame in, DataFrame out.

Names are compared as normalised, trimmed text. Only verified records are authoritative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from orgweave.functions import evidence as E
from orgweave.functions import text as T
from orgweave.functions import url as U
from orgweave.functions import words as W
from orgweave.operators.records import last_wins
from orgweave.operators.state import Ordered
from orgweave.sources.shared import Scratch, written

# Classes of official registries, kinds of relationships between sites.
OFFICIAL_CLASSES = ("official_government_registry", "government_company_registry")
RELATIONSHIPS = ("brand", "parentOrganization", "subOrganization", "branchOf", "department", "memberOf", "distributor", "productDivision")
RETRIED = ("REVIEW_NEEDED", "WEBSITE_NOT_FOUND", "WEBSITE_AMBIGUOUS", "WEBSITE_FETCH_FAILED")


def name_key(c: Column | str) -> Column:
    return F.trim(T.normalize(c))


def by_name(registry: DataFrame, names: Column, record: str) -> DataFrame:
    """(key, record) for each distinct normalised name of a registry's records."""
    each = registry.select(F.explode(names).alias("__n"), F.col(record).alias("record")).where("__n is not null and trim(__n) <> ''")
    return each.select(name_key("__n").alias("key"), "record").distinct()


def official_records(companies: DataFrame, records: DataFrame) -> DataFrame:
    """(company, record, domain, identifiers) of the official registries' verified records with a company's exact name.

    records: record, source_class, verification_status, legal_name, aliases, official_domain, identifiers. Contact values of
    registries are never read.
    """
    official = records.where(F.col("source_class").isin(*OFFICIAL_CLASSES) & (F.col("verification_status") == "verified"))
    names = F.concat(F.array("legal_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    keys = by_name(official, names, "record")
    asked = companies.select("company").distinct().withColumn("key", name_key("company"))
    sites = official.select("record", U.host("official_domain").alias("domain"), "identifiers")
    return asked.join(keys, "key").join(sites, "record").select("company", "record", "domain", "identifiers")


def verified_websites(companies: DataFrame, company: str, registries: list[DataFrame]) -> DataFrame:
    """(company, domain, source, relationship) of the verified sites of the companies' exact names.

    registries: (names array, url, verified boolean, source, relationship), from the weakest to the
    strongest; a domain that several name is the last one's.
    """
    asked = companies.select(company).distinct().withColumn("key", name_key(company))
    found = []
    for place, registry in enumerate(registries):
        sites = registry.where("verified").select(F.explode("names").alias("n"), U.host("url").alias("domain"), "source", "relationship")
        found.append(sites.where("domain <> '' and n is not null").select(name_key("n").alias("key"), "domain", "source", "relationship", F.lit(place).alias("place")))
    union = found[0]
    for other in found[1:]:
        union = union.unionByName(other)
    each = asked.join(union, "key")
    return last_wins(each, [company, "domain"], [F.col("place"), F.col("source"), F.col("relationship")]).select(company, "domain", "source", "relationship")


def remember(memory: DataFrame, rows: DataFrame) -> DataFrame:
    """The memory with the rows that may be remembered: published, resolved, free of conflicts, with a contact of the same site.

    memory: company, domain, resolution, seen_at. rows: company, website, status, resolution, conflicts,
    email_source, phone_source, seen_at. The later row of a company and domain stays.
    """
    domain = U.host("website")
    same = lambda c: F.coalesce((U.host(c) != "") & (U.registrable(U.host(c)) == U.registrable(domain)), F.lit(False))
    fit = F.col("status").startswith("OK_") & F.col("resolution").rlike("^(candidate_resolved_|profile_route_resolved_)") & (F.col("conflicts") == 0) & (domain != "") & (same("email_source") | same("phone_source"))
    new = rows.where(fit).select("company", domain.alias("domain"), "resolution", "seen_at", F.lit(1).alias("fresh"))
    both = memory.select("company", "domain", "resolution", "seen_at", F.lit(0).alias("fresh")).unionByName(new).withColumn("key", name_key("company"))
    return last_wins(both, ["key", "domain"], [F.col("fresh"), F.col("seen_at"), F.col("company"), F.col("resolution")]).select("company", "domain", "resolution", "seen_at")


def resolver_union(answers: DataFrame, company: str, limit: int) -> DataFrame:
    """(company, domain, providers, claimed, rank) of the resolvers' usable answers.

    answers: company, provider, domain, rank, claimed and compatible (whether the answered name is
    the company's). A provider gives its first `limit` usable domains for a company.
    """
    clean = answers.withColumn("domain", U.host("domain")).where(E.is_usable_host(F.col("domain"), W.EXCLUDED_DOMAINS))
    first = clean.groupBy(company, "provider", "domain").agg(F.min(F.struct("rank", "claimed", "compatible")).alias("f")).select(company, "provider", "domain", "f.*")
    kept = first.withColumn("n", F.row_number().over(Win.partitionBy(company, "provider").orderBy("rank", "domain"))).where(F.col("n") <= limit).where("compatible")
    return kept.groupBy(company, "domain").agg(F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"), F.max("claimed").alias("claimed"), F.min("rank").alias("rank"))


def typed_edges(claims: DataFrame) -> DataFrame:
    """(a, b, kind) of explicit relationships between two sites. claims: domain, kind, url."""
    a, b = U.host("domain"), U.host("url")
    known = claims.where(F.col("kind").isin(*RELATIONSHIPS)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.concat(F.lit("first_party_"), F.col("kind")).alias("kind"))
    return known.where("a <> '' and a <> b").distinct()


def same_family(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """pairs(a, b) with same: one registrable domain, or one component (node, component)."""
    of = lambda side: components.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    near = (F.col("a") != "") & (F.col("b") != "") & (U.registrable(F.col("a")) == U.registrable(F.col("b")))
    return both.select("a", "b", (near | F.coalesce(F.col("c_a") == F.col("c_b"), F.lit(False))).alias("same"))


def source_health(calls: DataFrame, host: str, order: list[str], status: Column, limit: int = 2) -> DataFrame:
    """calls with each host's state after them: attempts, successes, server errors since the last success, circuit and status."""
    is_ = lambda *states: F.col("__s").isin(*states).cast("int")
    with Scratch(calls.sparkSession) as scratch:
        own = Ordered(calls.withColumn("__s", status), host, order, scratch)
        own.sums(attempts=1 - is_("circuit_open"), successes=is_("available"), __errors=is_("server_error"))
        # errors never fall, so the last success saw the most of them
        own.maxima(__before=F.when(F.col("__s") == "available", F.col("__errors").cast("double")))
        errors = (F.col("__errors") - F.greatest(F.col("__before"), F.lit(0.0))).cast("long")
        state = own.rows.select(*calls.columns, "attempts", "successes", errors.alias("server_errors"), "__s")
        open_ = F.col("server_errors") >= limit
        judged = state.withColumn("circuit_open", open_).withColumn("health", F.when(open_ & (F.col("__s") == "server_error"), "degraded").otherwise(F.col("__s"))).drop("__s")
        return written(judged, "source-health")


def retry_rows(results: DataFrame, statuses: tuple[str, ...], include_all: bool, order: list[Column]) -> DataFrame:
    """(company, source) of the results to try again: by status, the first row of a name, without regard to case."""
    named = results.where("trim(coalesce(company, '')) <> ''").withColumn("company", F.trim("company"))
    wanted = named if include_all else named.where(F.col("status").isin(*statuses))
    first = wanted.withColumn("__n", F.row_number().over(Win.partitionBy(F.lower("company")).orderBy(*order))).where("__n = 1")
    return first.select("company", F.concat(F.lit("retry_"), F.lower("status")).alias("source"), F.lit("").alias("website"))


def select_companies(records: DataFrame, names: DataFrame | None = None, previous: DataFrame | None = None, statuses: tuple[str, ...] = ()) -> DataFrame:
    """Records of the names given, or of those whose previous status is allowed; without regard to case."""
    out = records.withColumn("__k", F.lower("company"))
    if names is not None:
        out = out.join(names.select(F.lower("company").alias("__k")).distinct(), "__k", "left_semi")
    if statuses:
        allowed = previous.where(F.lower("status").isin(*[s.lower() for s in statuses])).select(F.lower("company").alias("__k")).distinct()
        out = out.join(allowed, "__k", "left_semi")
    return out.drop("__k")


def needs_paid_search(status: Column, reason: Column, done: Column) -> Column:
    return ~F.coalesce(done, F.lit(False)) & F.coalesce(status.isin(*RETRIED) | (reason == "no_candidate_proved_target_fingerprint"), F.lit(False))


def preferred_route(candidates: DataFrame, company: str, node: str) -> DataFrame:
    """(company, node): the only publishable candidate that a profile names, if its legal identity is 2 or more and beats all others.

    candidates: publishable (and without conflicts), from_profile, legal.
    """
    fit = candidates.where("publishable")
    per = fit.groupBy(company).agg(
        F.count_if("from_profile").alias("n"), F.max(F.when(F.col("from_profile"), F.col(node))).alias(node),
        F.max(F.when(F.col("from_profile"), F.col("legal"))).alias("own"), F.max(F.when(~F.col("from_profile"), F.col("legal"))).alias("rival"),
    )
    return per.where("n = 1 and own >= 2 and (rival is null or own > rival)").select(company, node)


def unreachable_homonyms(selected: DataFrame, evaluated: DataFrame, company: str, minimum: int = W.MEDIUM_SCORE) -> DataFrame:
    """(company, domain, other): a domain of the same core that could not be read, against the selected one; the first by name.

    selected: company, domain, settled (proved by its own profile). evaluated: company, domain,
    reachable, identity, role, score.
    """
    open_ = selected.where("not settled").select(company, "domain", U.compact_core(F.col("domain")).alias("core")).where("core <> ''")
    rival = evaluated.where("not reachable and identity and role = 'company_candidate'").where(F.col("score") >= minimum)
    rival = rival.select(company, F.col("domain").alias("other"), U.compact_core(F.col("domain")).alias("core"))
    return open_.join(rival, [company, "core"]).where("domain <> other").groupBy(company, "domain").agg(F.min("other").alias("other"))


def close_pairs(
    rows: DataFrame, group: list[str], node: str, score: str, support: str, domain: str, order: str | None = None, family: str | None = None, settled: str | None = None, first: int = 4, margin: int = W.AMBIGUITY_MARGIN
) -> DataFrame:
    """All pairs among the first four plausible candidates of a group, by `order` (else the node), that leave the choice open.

    Equal support, other registrable domains, scores within the margin. No pair is close within one `family` of sites, or
    with a candidate that is `settled`: from an authoritative query, or with conflicts of its own.
    """
    placed = rows.withColumn("__n", F.row_number().over(Win.partitionBy(*group).orderBy(order or node, node))).where(F.col("__n") <= first)
    kept = {"score": F.col(score), "support": F.col(support), "domain": F.col(domain), "family": F.col(family or domain), "settled": F.coalesce(F.col(settled), F.lit(False)) if settled else F.lit(False)}
    listed = placed.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("__n", F.col(node).alias("node"), *[c.alias(k) for k, c in kept.items()]))).alias("c"))
    at = lambda i: F.get("c", F.lit(i))

    def pair(i: int, j: int) -> Column:
        apart = (at(i)["domain"] != at(j)["domain"]) & (at(i)["family"] != at(j)["family"]) & ~at(i)["settled"] & ~at(j)["settled"]
        close = (at(i)["support"] == at(j)["support"]) & apart & (F.abs(at(i)["score"] - at(j)["score"]) <= margin)
        return F.struct(at(i)["node"].alias("first"), at(j)["node"].alias("second"), close.alias("close"))

    pairs = F.filter(F.array(*[pair(i, j) for i in range(first) for j in range(i + 1, first)]), lambda p: F.coalesce(p["close"], F.lit(False)))
    return listed.select(*group, F.explode(pairs).alias("p")).select(*group, "p.first", "p.second")


def merge_family_contacts(rows: DataFrame, family: list[str], order: list[Column], value: str) -> DataFrame:
    """(family, primary, alternatives): the first value that is there, and all other distinct ones of the family's sites, sorted."""
    seen = rows.where(F.col(value).isNotNull() & (F.col(value) != ""))
    best = seen.withColumn("__n", F.row_number().over(Win.partitionBy(*family).orderBy(*order))).where("__n = 1").select(*family, F.col(value).alias("primary"))
    others = seen.select(*family, F.col(value).alias("v")).distinct().join(best, family).where("v <> primary")
    listed = others.groupBy(*family).agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias("alternatives"))
    return best.join(listed, family, "left").select(*family, "primary", F.coalesce("alternatives", F.lit("")).alias("alternatives"))


def alias_candidates(links: DataFrame, known: DataFrame, company: str, limit: int) -> DataFrame:
    """(company, domain, place): domains that a company's own pages link to and that are not candidates yet, the most linked first."""
    # equal links are counted and written before their addresses are read: the conditions would else be computed for every link
    counted = written(links.groupBy(company, "url").agg(F.count(F.lit(1)).alias("n")), "links")
    usable = counted.withColumn("domain", U.host("url")).where(E.is_usable_host(F.col("domain"), W.EXCLUDED_DOMAINS))
    fresh = usable.groupBy(company, "domain").agg(F.sum("n").alias("n")).join(known.select(company, "domain").distinct(), [company, "domain"], "left_anti")
    place = F.row_number().over(Win.partitionBy(company).orderBy(F.desc("n"), "domain"))
    return fresh.withColumn("place", place).where(F.col("place") <= limit).select(company, "domain", "n", "place")


def verify_snapshot(rows: DataFrame, manifest: DataFrame, actual: DataFrame, group: str) -> DataFrame:
    """Per group of a snapshot whether it is whole: rows and hash agree with the manifest. actual: (group, n, sha256), made of rows."""
    expected = manifest.select(group, F.col("n").alias("n_expected"), F.col("sha256").alias("sha_expected"))
    both = expected.join(actual.select(group, "n", "sha256"), group, "full")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n_expected").isNull(), "unexpected").when(F.col("n") != F.col("n_expected"), "count_mismatch").when(F.col("sha256") != F.col("sha_expected"), "hash_mismatch").otherwise("ok")
    return both.select(group, state.alias("state"))
