"""URL verdicts from host rules and from the reputation that labelled pages give their hosts.

A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the
rule's; the longest rule decides. Other urls are judged by their host. Outcomes of labelled pages
are counted for each host, and the rate of bad pages is shrunk level by level: the rate of a suffix
towards that of all pages, of a registered domain towards its suffix, of a host towards its domain.
How far, says the data: at each level a beta-binomial's concentration is estimated from how much more
the rates of a parent's members differ than chance would have it. A host is blocked if its posterior
has a bad rate above MAX_BAD with probability CONFIDENCE, so a host with few outcomes is blocked only
where its domain and suffix are bad too, and a url without any evidence is allowed.

Pages meet hosts in a join: the few hosts with over a 1/HEAVY share of all pages are broadcast (at
most HEAVY rows), all others are shuffled, none of them large. The same serves domains and suffixes.

Defined cases: a null url, or one without `://`, has an empty host and path, which no rule fits, and
is judged like any other host; a page with several label rows is bad if one is; labels without page,
null labels and null ids say nothing; repeated pages count and are returned each; a rule given with
both verdicts blocks; rules with an empty host are ignored; empty tables give none. The input's
columns come back in the struct `row`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions.url import registrable
from orgweave.llm.common import materialise, read
from orgweave.sources.shared import Scratch

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Rate of bad pages that a host may have, and how sure it must be that it has more.
MAX_BAD = 0.5
CONFIDENCE = 0.95
#: Limits of a prior's weight in pages, and the weight where no two members of a parent show their difference.
LEAST, MOST, UNKNOWN = 1.0, 1000.0, 10.0
HEAVY = 1000
MAX_BROADCAST_RULES = 50_000

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), *_LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def join_weighted(left: DataFrame, right: DataFrame, key: str, weight: str = "weight") -> DataFrame:
    """left with the columns of right, whose `weight` is the number of rows of left that a key has.

    Keys with over a 1/HEAVY share of left, so under HEAVY of them, are broadcast; no other key is large.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * HEAVY > total
    hot = F.broadcast(right.where(heavy).drop(weight).withColumn("is_heavy", F.lit(True)))
    met = left.join(hot, key, "left")
    rest = met.where("is_heavy is null").select(left.columns).join(right.where(~heavy).drop(weight), key)
    return met.where("is_heavy").drop("is_heavy").unionByName(rest)


def _strength(members: DataFrame, key: str) -> float:
    """How many pages the parents' rates weigh against their members' own.

    members: n and k, the parent's `key`, and own, the parent's rate.
    """
    seen = members.where("n > 0").withColumn("p", F.col("k") / F.col("n"))
    each = seen.groupBy(key, "own").agg(
        F.sum("n").alias("total"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.count(F.lit(1)).alias("m"), F.sum(F.col("n") * (F.col("p") - F.col("own")) ** 2).alias("spread")
    )
    chance = F.col("own") * (1 - F.col("own"))
    sums = each.agg(F.sum(F.col("spread") - chance * (F.col("m") - 1)).alias("excess"), F.sum(chance * (F.col("total") - F.col("squares") / F.col("total") - F.col("m") + 1)).alias("room")).first()
    return concentration(sums.excess, sums.room)


def concentration(excess: float | None, room: float | None) -> float:
    """The weight of a beta-binomial's prior by moments: excess of the members' spread over chance, and how much it would be if they had nothing in common."""
    if not room or room <= 0:
        return UNKNOWN
    share = min(max(excess / room, 0.0), 1.0)
    return MOST if share <= 0 else min(max(1 / share - 1, LEAST), MOST)


def beta_above(a: np.ndarray, b: np.ndarray, x: float) -> np.ndarray:
    """P(X > x) for X ~ Beta(a, b), by the continued fraction of the incomplete beta function."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    swap = x > (a + 1) / (a + b + 2)  # the fraction converges fast on the other side
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    lgamma = np.frompyfunc(math.lgamma, 1, 1)
    front = np.exp((lgamma(p + q) - lgamma(p) - lgamma(q)).astype(float) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones_like(p), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 2000):
        for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-13):
            break
    below = np.where(swap, 1 - front * h, front * h)
    return np.clip(1 - below, 0.0, 1.0)


def outcomes(labels: DataFrame) -> DataFrame:
    """page_id and bad (1 if a label row says low quality or toxic) of every labelled page."""
    bad = F.when(F.col("quality") == 0, 1).when(F.col("toxic") == 1, 1).when(F.col("quality").isNull() & F.col("toxic").isNull(), None).otherwise(0)
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad")).where("bad is not null")


def count_hosts(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """host, domain, suffix, weight (its pages), n labelled and k bad pages.

    pages: page_id and host. Rows of one id and host are combined before they meet the labels.
    """
    each = pages.groupBy("page_id", "host").agg(F.count(F.lit(1)).alias("pages"))
    met = each.join(labelled.select("page_id", "bad"), "page_id", "left")
    of = lambda c: F.sum(F.when(c, F.col("pages")).otherwise(F.lit(0)))
    counted = met.groupBy("host").agg(F.sum("pages").alias("weight"), of(F.col("bad").isNotNull()).alias("n"), of(F.col("bad") == 1).alias("k"))
    domain = registrable(F.col("host"))
    return counted.withColumn("domain", domain).withColumn("suffix", F.when(F.contains("domain", F.lit(".")), F.regexp_replace("domain", r"^[^.]*\.", "")).otherwise(F.col("domain")))


def reputation(hosts: DataFrame, max_bad: float = MAX_BAD, confidence: float = CONFIDENCE, written: Callable = materialise) -> DataFrame:
    """host, weight, n, k, bad_rate (posterior mean), bad_probability (that its rate is above max_bad) and is_bad."""
    counts = [F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("weight")]
    domains = written(hosts.groupBy("domain", "suffix").agg(*counts), "domains")
    suffixes = written(domains.groupBy("suffix").agg(*counts), "suffixes")
    rate = lambda c: F.when(F.col("n") > 0, F.col("k") / F.col("n")).alias(c)
    root = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    n, k = root.n or 0, root.k or 0
    # the one parent of all suffixes is two numbers; every other level meets its parents in a join
    met, key = suffixes.select("*", F.lit("").alias("world"), F.lit((k + 0.5) / (n + 1)).alias("prior"), F.lit(k / n if n else 0.0).alias("own")), "world"
    for name, below in (("suffix", domains), ("domain", hosts), ("host", None)):
        strength = _strength(met, key)
        a, b = F.col("k") + strength * F.col("prior"), F.col("n") - F.col("k") + strength * (1 - F.col("prior"))
        done = written(met.withColumn("a", a).withColumn("b", b), f"reputation-{name}")
        if below is not None:
            parents = done.select(name, (F.col("a") / (F.col("a") + F.col("b"))).alias("prior"), rate("own"), F.col("weight").alias("members"))
            met, key = join_weighted(below, parents, name, "members"), name

    @F.pandas_udf("double")
    def above(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(beta_above(a.to_numpy(), b.to_numpy(), max_bad))

    return done.select("host", "weight", "n", "k", (F.col("a") / (F.col("a") + F.col("b"))).alias("bad_rate"), above("a", "b").alias("bad_probability")).withColumn("is_bad", F.col("bad_probability") >= confidence)


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host and the rules that fit it (longest first, ties: the longer host), for hosts that any rule fits.

    Parents of a host are looked up as far as rules have labels, so long hosts cost no more.
    """
    known = rules.where("host != ''").groupBy(F.col("host").alias("rule_host"), "path").agg(F.max("verdict").alias("verdict"))
    size = known.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("rule_host", r"\."))).alias("labels")).first()
    if size.n <= MAX_BROADCAST_RULES:
        known = F.broadcast(known)
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(size.labels or 1))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    rank = F.struct((-F.length("rule_host") - F.length("path")).alias("size"), (-F.length("rule_host")).alias("host_size"), "path", F.concat("rule_host", "path").alias("rule"), "verdict")
    met = hosts.select("host", F.explode(parents).alias("rule_host")).join(known, "rule_host")
    return met.groupBy("host").agg(F.sort_array(F.collect_list(rank)).alias("rules"))


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", max_bad: float = MAX_BAD, confidence: float = CONFIDENCE) -> DataFrame:
    """Per page: row (the input's columns), host, path, rule, verdict, and n_labelled, bad_rate and bad_probability of its host.

    labelled: page_id and bad. rules: host, path and verdict (allow or block).
    """
    host = url_host(F.col(url_col))
    with Scratch(pages.sparkSession) as scratch:
        hosts = scratch.written(count_hosts(pages.select(F.col(id_col).alias("page_id"), host.alias("host")), labelled), "hosts")
        known = reputation(hosts, max_bad, confidence, scratch.written).join(rules_of_hosts(hosts, rules), "host", "left")
        judged = materialise(known.select("host", "weight", F.col("n").alias("n_labelled"), "bad_rate", "bad_probability", "is_bad", "rules"), "judged-hosts")
    source = pages.select(host.alias("host"), url_path(F.col(url_col)).alias("path"), F.struct(*[pages[c] for c in pages.columns]).alias("row"))
    met = join_weighted(source, judged, "host")
    longest = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["path"])), F.lit(0))
    met = met.withColumn("longest", longest)
    verdict = F.coalesce(F.col("longest.verdict"), F.when(F.col("is_bad"), "block").otherwise("allow"))
    return met.select("row", "host", "path", F.col("longest.rule").alias("rule"), verdict.alias("verdict"), "n_labelled", "bad_rate", "bad_probability")


def op13(spark, sf_dir: str) -> DataFrame:
    """Outcomes of pages are the rows of `labels` with their id."""
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    found = filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"), outcomes(read(spark, sf_dir, "labels")), rules)
    return found.select("row.page_id", "host", "path", "rule", "verdict", "n_labelled", "bad_rate", "bad_probability")
