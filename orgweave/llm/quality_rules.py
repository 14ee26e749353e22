"""Quality rules whose cutoffs are certified on labelled holdouts (DataFrame functions only).

Five text statistics are computed for every document. PATH is a fixed sequence of cutoff
vectors, each at least as strict as the one before; a document's level is the first vector one
of whose cutoffs it exceeds, so what a vector rejects, all later ones do. For each stratum (a
language) the vectors are tried in order. One is certified if the exact binomial tail
P(Bin(n, RISK) <= k) is at most CONFIDENCE / strata, where n good labelled documents of the
stratum were seen and k of them would be rejected: the Clopper-Pearson upper bound of the
false-rejection rate of all rules together then lies below RISK. A sequence that is tested in
fixed order up to its first failure needs no correction, so the whole risk is one test's, and
only the strata need the Bonferroni correction. The strictest certified vector is applied; a
stratum with none (under ln(CONFIDENCE / strata) / ln(1 - RISK) good labels, 217 for four
strata) rejects nothing but the base failures, as nothing can be guaranteed there.

The base rule is given by contract and outside the guarantee, which holds for good documents
that pass it.

Defined cases: null or empty text has no words (base failure); null language is the
stratum "unknown"; repeated rows are judged each by itself; a document with several label
rows counts with its highest label; empty tables give empty results; other columns of the
input are ignored by the metrics and passed through by `filter_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.llm.common import let, materialise, read

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Limit of good documents that the method rejects in a stratum, and the chance that any stratum's limit fails.
RISK = 0.02
CONFIDENCE = 0.05
RULES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "mean_word_chars")
#: Cutoffs of the rules, from loosest to strictest. A document is rejected above a cutoff. All rules are
#: tightened together to where prose seldom lies, then one after the other.
PATH: tuple[tuple[float, ...], ...] = (
    (0.5, 0.9, 0.9, 0.9, 60.0),
    (0.4, 0.8, 0.8, 0.8, 40.0),
    (0.3, 0.7, 0.7, 0.7, 30.0),
    (0.25, 0.6, 0.6, 0.6, 25.0),
    (0.2, 0.5, 0.5, 0.5, 20.0),
    (0.15, 0.45, 0.45, 0.4, 18.0),
    (0.12, 0.4, 0.4, 0.35, 16.0),
    (0.1, 0.35, 0.35, 0.3, 15.0),
    (0.08, 0.3, 0.3, 0.25, 14.0),
    (0.06, 0.3, 0.3, 0.25, 14.0),
    (0.05, 0.3, 0.3, 0.25, 14.0),
    (0.04, 0.3, 0.3, 0.25, 14.0),
    (0.03, 0.3, 0.3, 0.25, 14.0),
    (0.03, 0.25, 0.25, 0.25, 14.0),
    (0.03, 0.2, 0.25, 0.25, 14.0),
    (0.03, 0.2, 0.2, 0.2, 13.0),
    (0.02, 0.2, 0.2, 0.2, 13.0),
    (0.02, 0.15, 0.15, 0.2, 12.0),
    (0.02, 0.1, 0.1, 0.15, 12.0),
)
MAX_BROADCAST_STRATA = 10_000
MAX_BROADCAST_IDS = 1 << 20


def _only(text: Column, characters: str) -> Column:
    """How many characters of the class the text has."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def _repeated(words: Column) -> Column:
    """Words that lie in windows of WINDOW words found twice or more.

    Hashes of 2, 4 and 8 words are made from two of half the length each.
    """
    pairs = lambda step: lambda h: F.transform(
        F.slice(h, 1, F.greatest(F.size(h) - step, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + step))
    )
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        hashes = let(hashes, pairs(step))

    def covered(starts: Column) -> Column:
        def reach(p: Column, k: Column) -> Column:
            following = F.get(starts, k + 1)
            return F.when(following.isNull(), F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), following - p))

        return F.aggregate(F.transform(starts, reach), F.lit(0), lambda total, x: total + x)

    def twice(ordered: Column) -> Column:
        same = F.filter(ordered, lambda v, k: (F.get(ordered, k - 1)["h"] == v["h"]) | (F.get(ordered, k + 1)["h"] == v["h"]))
        return F.sort_array(F.transform(same, lambda v: v["p"]))

    def all_windows(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(ordered, twice), covered))

    return let(hashes, all_windows)


def _metrics(text: Column) -> Column:
    """The statistics of a whole text, as one struct that is computed once however often it is used."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = F.struct(
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("c"), _repeated(w).cast("long").alias("r"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("l"),
        _only(text, "#*$%&|<>").alias("s"),
        _only(text, "A-Z").alias("u"),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def named(x: Column) -> Column:
        n, c, r = x["w"]["n"], x["w"]["c"], x["w"]["r"]
        failed = (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)
        ratios = (share(x["s"], c), share(x["l"]["d"], x["l"]["n"]), share(r, n), share(x["u"], c), share(c, n))
        return F.struct(
            n.alias("n_words"), c.alias("word_chars"), x["s"].alias("n_symbols"), x["l"]["d"].alias("n_dup_lines"), r.alias("n_repeat_words"),
            *[v.alias(k) for k, v in zip(RULES, ratios, strict=True)], failed.alias("base_failed"),
        )

    return let(counts, lambda x: let(named(x), lambda m: F.struct(*[m[k].alias(k) for k in _NAMES], _level(m).alias("level"))))


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *RULES, "base_failed")


def _level(m: Column) -> Column:
    """The first vector of PATH that rejects; their number if none does."""
    out = F.lit(len(PATH))
    for i, cutoffs in reversed(list(enumerate(PATH))):
        beyond = F.lit(False)
        for rule, cutoff in zip(RULES, cutoffs, strict=True):
            beyond = beyond | (m[rule] > cutoff)
        out = F.when(beyond, F.lit(i)).otherwise(out)
    return out


def text_metrics(docs: DataFrame, *keep: Column | str, text_col: str = "text") -> DataFrame:
    """The columns `keep` and the statistics of every whole text."""
    counted = docs.select(*keep, _metrics(F.col(text_col)).alias("__m"))
    return counted.select(*[c for c in counted.columns if c != "__m"], "__m.*")


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact to rounding: the pmf at k in logarithms, then ratios downwards.

    Sound for k <= n * p, where the ratios fall; larger k give 1, as such a cutoff is never certified.
    """
    steps = F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int"))
    choose = F.when(k == 0, F.lit(0.0)).otherwise(
        F.aggregate(steps, F.lit(0.0), lambda total, i: total + F.log((n - k + i).cast("double") / i.cast("double")))
    )
    log_at_k = choose + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    odds = (1 - p) / p
    # the term j below k is the one above it times (k - j + 1) / (n - k + j) * odds
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def lower(state: Column, j: Column) -> Column:
        term = state["term"] * (k - j + 1).cast("double") / (n - k + j).cast("double") * odds
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    ratios = F.when(k == 0, F.lit(1.0)).otherwise(F.aggregate(steps, start, lower, lambda s: s["total"]))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log_at_k) * ratios))


def _good(labels: DataFrame) -> DataFrame:
    """doc_id of the documents whose highest label is 1."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("__q")).where("__q = 1").select("doc_id")


def calibrate(good: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """One row for each stratum: __stratum, n_good and applied, the place of its strictest certified vector (null: none).

    good: stratum, base_failed and level of every good labelled document.
    """
    hit = [F.count(F.when(F.col("level") <= i, 1)).alias(f"k{i}") for i in range(len(PATH))]
    counts = materialise(good.where("not base_failed").groupBy("stratum").agg(F.count(F.lit(1)).alias("n_good"), *hit), "quality-counts")
    limit = confidence / max(1, counts.count())
    tests = counts.select("stratum", "n_good", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"k{i}").alias("k")) for i in range(len(PATH))])).alias("t"))
    # the tail grows along the path, so the certified vectors are the first ones
    passed = F.when(binomial_tail(F.col("n_good"), F.col("t.k"), risk) <= limit, F.col("t.i"))
    return tests.select(F.col("stratum").alias("__stratum"), "n_good", passed.alias("i")).groupBy("__stratum", "n_good").agg(F.max("i").alias("applied"))


def _judged(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """rows with __applied, the place of their stratum's vector; -1 for none."""
    cutoffs = cutoffs.select("__stratum", "applied")
    if cutoffs.count() <= MAX_BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    joined = rows.join(cutoffs, F.col("stratum") == F.col("__stratum"), "left")
    return joined.withColumn("__applied", F.coalesce("applied", F.lit(-1)))


def _stratum(docs: DataFrame) -> Column:
    return F.coalesce(docs["lang"], F.lit("unknown")).alias("stratum")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, the counts, base_failed and kept. The statistics are computed once and kept as a narrow table."""
    metrics = materialise(text_metrics(docs, "doc_id", _stratum(docs)), "quality-metrics")
    cutoffs = materialise(calibrate(metrics.join(_good(labels), "doc_id", "left_semi")), "quality-cutoffs")
    judged = _judged(metrics, cutoffs).withColumn("kept", ~F.col("base_failed") & (F.col("level") > F.col("__applied")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", *RULES)


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    The cutoffs come from the good labelled documents alone; then each row is judged in place, in one pass.
    """
    good = materialise(_good(labels), "quality-labelled")
    texts = docs.select("doc_id", "text", _stratum(docs))
    if good.count() <= MAX_BROADCAST_IDS:
        labelled = text_metrics(texts.join(F.broadcast(good), "doc_id", "left_semi"), "stratum")
    else:  # texts stay where they are: their statistics meet the ids
        labelled = text_metrics(texts, "doc_id", "stratum").join(good, "doc_id", "left_semi")
    cutoffs = materialise(calibrate(labelled), "quality-cutoffs")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("__row")
    judged = _judged(docs.select(row, _stratum(docs)), cutoffs)
    passes = let(_metrics(F.col("__row")["text"]), lambda m: ~m["base_failed"] & (m["level"] > F.col("__applied")))
    return judged.where(passes).select("__row.*")


def op8(spark, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
