"""Quality classifier: hashed word n-gram logistic regression, FTRL-proximal updates.

Tokens are runs of letters, digits and non-ASCII bytes, or runs of one other character
class, lower-cased for their hash. Four families of n-grams are hashed into one weight
vector of 2**BITS places: words, word pairs, triples of word shapes (letter case, class
and length), and 5-grams by whether the text had them before. In each family a feature's
value is the square root of its share of the family, so a family has length one whatever
the text's length. A score is the sparse dot product of these values with the weights,
put through the logistic function.

Training uses a bounded sample: the TRAIN_ROWS labelled documents that come first by a
hash of their id, dealt to groups of about SHARD_ROWS that each run epochs of follow-the-regularised-
leader updates (at least EPOCHS, more for small samples); the weights are the mean of the
groups'. The texts are read whole.

Defined cases: null and empty texts have no feature and get the score of the intercept;
null labels and ids are not learned from; a document with several label rows counts with
its highest label; without any label the score is 0.5; repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.llm.common import LOWER, doc_crc, mix, read, span_hashes, spans, text_slices

BITS = 18
TRAIN_ROWS = 12_000
SHARD_ROWS = 3_000
EPOCHS = 3
UPDATES = 12_000
MAX_EPOCHS = 40
THRESHOLD = 0.3
HELD_OUT = (5, 0)
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.002, 0.02

# byte classes: 0 white space, 1 lower case and non-ASCII, 2 upper case, 3 digit, 4 other
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[list(range(ord("a"), ord("z") + 1)) + list(range(128, 256))] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3


def _counted(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of one family from its n-grams."""
    if not len(row):
        return row, row, np.zeros(0)
    place = (h & np.uint64((1 << BITS) - 1)).astype(np.int64)
    key, count = np.unique((row.astype(np.int64) << BITS) | place, return_counts=True)
    row = key >> BITS
    total = np.bincount(row, weights=count, minlength=rows)
    return row, key & ((1 << BITS) - 1), np.sqrt(count / total[row])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of all features of the rows."""
    rows = len(offsets) - 1
    kind = _CLASS[data]
    wordlike = (kind >= 1) & (kind <= 3)
    breaks = np.zeros(len(data), bool)
    breaks[1:] = wordlike[1:] != wordlike[:-1]
    start, end, row = spans(kind > 0, offsets, breaks)
    if not len(start):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, float))
    h = span_hashes(LOWER[data], start, end)
    upper = np.concatenate([[0], np.cumsum(kind == 2)])
    ups = upper[end] - upper[start]
    length = np.minimum(end - start, 31)
    case = np.where(ups == 0, 0, np.where(ups == end - start, 1, np.where((ups == 1) & (kind[start] == 2), 2, 3)))
    shape = np.where(wordlike[start], case * 64 + kind[start] * 8 + np.minimum(length // 4, 7), 4096 + data[start].astype(np.int64) * 32 + length)
    shape = mix(shape.astype(np.uint64) + np.uint64(77))

    def grams(of: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        inside = row[n - 1 :] == row[: len(row) - n + 1]
        total = np.full(len(of) - n + 1 if len(of) >= n else 0, salt, np.uint64)
        for i in range(n):
            total = mix(total * np.uint64(31) + of[i : i + len(total)])
        return row[: len(total)][inside[: len(total)]], total[inside[: len(total)]]

    families = [(row, mix(h + np.uint64(1))), grams(h, 2, 2), grams(shape, 3, 3)]
    at, five = grams(h, 5, 4)
    order = np.lexsort((five, at))
    again = np.zeros(len(five), bool)
    if len(five):
        again[order[1:]] = (five[order][1:] == five[order][:-1]) & (at[order][1:] == at[order][:-1])
    families.append((at, mix(again.astype(np.uint64) + np.uint64(5))))
    parts = [_counted(r, x, rows) for r, x in families]
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 0) -> np.ndarray:
    """Weights from (places, values, label) triples; the last place is the intercept."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    order = np.random.default_rng(seed)

    def weights(at) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    epochs = min(MAX_EPOCHS, max(EPOCHS, UPDATES // max(1, len(samples))))
    for _ in range(epochs):
        for k in order.permutation(len(samples)):
            place, value, label = samples[k]
            place, value = np.append(place, 1 << BITS), np.append(value, 1.0)
            w = weights(place)
            gradient = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - label) * value
            sigma = (np.sqrt(n[place] + gradient**2) - np.sqrt(n[place])) / ALPHA
            # a place can be met by two families at once
            np.add.at(z, place, gradient - sigma * w)
            np.add.at(n, place, gradient**2)
    return weights(np.arange((1 << BITS) + 1)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, allowed, target: str = "quality") -> np.ndarray:
    """Weights learned from the labelled documents for which the condition `allowed` holds on doc_id."""
    chosen = (
        labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & allowed)
        .groupBy("doc_id").agg(F.max(target).alias("__label"))
        .orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(TRAIN_ROWS)
    )
    shards = max(1, chosen.count() // SHARD_ROWS)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def extract(batches):
        for batch in batches:
            ids, label = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("__label").to_numpy(zero_copy_only=False)
            for first, end, data, offsets in text_slices(batch.column("text")):
                row, place, value = features(data, offsets)
                order = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[order], np.arange(1, end - first))
                places, values = np.split(place[order].astype(np.int32), cuts), np.split(value[order].astype(np.float32), cuts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((ids[first:end] % shards).astype(np.int32)),
                        pa.array(ids[first:end].astype(np.int64)),
                        pa.array(label[first:end].astype(np.int32)),
                        pa.array([x.tobytes() for x in places], pa.binary()),
                        pa.array([x.tobytes() for x in values], pa.binary()),
                    ],
                    names=["shard", "doc_id", "label", "places", "values"],
                )

    def train_shard(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        rows = zip(table["places"].to_pylist(), table["values"].to_pylist(), table["label"].to_pylist(), strict=True)
        w = train([(np.frombuffer(p, np.int32), np.frombuffer(v, np.float32).astype(float), y) for p, v, y in rows])
        return pa.table({"weights": pa.array([w.tobytes()], pa.binary())})

    trained = (
        texts.mapInArrow(extract, "shard int, doc_id long, label int, places binary, values binary")
        .groupBy("shard").applyInArrow(train_shard, "weights binary").collect()
    )
    if not trained:
        return np.zeros((1 << BITS) + 1, np.float32)
    return np.mean([np.frombuffer(r.weights, np.float32) for r in trained], axis=0)


def score(docs: DataFrame, weights: np.ndarray, *keep) -> DataFrame:
    """The columns `keep` and the score of every row of docs, from its whole text."""
    kept = docs.select(*keep, F.col("text").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for batch in batches:
            out = np.empty(batch.num_rows)
            for first, end, data, offsets in text_slices(batch.column("__text")):
                row, place, value = features(data, offsets)
                logit = np.bincount(row, weights=w[place] * value, minlength=end - first) + w[-1]
                out[first:end] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(out)], names=[*names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{fields}, score double")


def op1(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    base, remainder = HELD_OUT
    weights = fit(docs, labels, doc_crc("doc_id") % base != remainder)
    held_out = F.coalesce(doc_crc("doc_id") % base == remainder, F.lit(False)).alias("held_out")
    return score(docs, weights, "doc_id", held_out).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
