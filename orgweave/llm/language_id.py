"""Language identification with a byte convolutional network, trained in numpy.

A text's bytes (A-Z lower-cased) are cut into windows of WINDOW bytes that cover the whole
text. Each byte has a learned embedding; filters of several widths run over a window, the
maximum of each over the positions goes through a rectifier, and a linear layer with
softmax gives the classes' probabilities. A text's prediction is the class with the
highest mean log-probability over its windows, each weighted by the bytes it holds; its
score is that class's share after normalising the means.

Training uses a bounded sample: about TRAIN_DOCS labelled documents, the same number for
each language, chosen by a hash of the id, and WINDOWS_PER_DOC windows spread over each
whole text. The windows (TRAIN_DOCS * WINDOWS_PER_DOC * WINDOW bytes at most, three times
that if the hashes are unlucky) are fitted on the driver.

Defined cases: a null text, or one without any letter, is `und` with score 0; null
languages and ids are not learned from; without any labelled text all are `und`; repeated
rows are predicted each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.llm.common import LOWER, doc_crc, read, text_slices

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
TRAIN_DOCS = 6_000
WINDOWS_PER_DOC = 4
EPOCHS, MIN_STEPS, BATCH, RATE = 4, 250, 128, 0.01
HELD_OUT = (4, 2)
_WIDE = max(WIDTHS)


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, row of each, bytes in each): every byte of every row lies in one window; the rest is zero."""
    length = np.diff(offsets)
    count = -(-length // WINDOW)
    row = np.repeat(np.arange(len(length)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][row] + nth * WINDOW
    held = np.minimum(WINDOW, offsets[1:][row] - start)
    padded = np.concatenate([LOWER[data], np.zeros(WINDOW, np.uint8)])
    windows = sliding_window_view(padded, WINDOW)[start]
    windows = np.where(np.arange(WINDOW) < held[:, None], windows, 0).astype(np.uint8)
    return windows, row, held


class Network:
    """Embedding, filters of all widths in one matrix (zero rows beyond a filter's width), linear layer."""

    def __init__(self, classes: int, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        total = FILTERS * len(WIDTHS)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.mask = np.zeros((_WIDE, EMBED, total), np.float32)
        for i, width in enumerate(WIDTHS):
            self.mask[:width, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(_WIDE * EMBED, total)
        self.filters = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(total, np.float32)
        self.out = rng.normal(0, 0.1, (total, classes)).astype(np.float32)
        self.out_bias = np.zeros(classes, np.float32)

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """(windows, positions, width * embedding)"""
        embedded = self.embed[windows]
        view = sliding_window_view(embedded, _WIDE, axis=1)  # window, position, embedding, width
        return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(len(windows), WINDOW - _WIDE + 1, -1)

    def log_softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def predict(self, windows: np.ndarray, block: int = 256) -> np.ndarray:
        parts = [self.log_softmax((self.columns(windows[i : i + block]) @ self.filters).max(1)) for i in range(0, len(windows), block)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.out_bias)), np.float32)

    def gradients(self, windows: np.ndarray, classes: np.ndarray) -> list[np.ndarray]:
        n = len(windows)
        x = self.columns(windows)
        response = x @ self.filters
        at = response.argmax(1)
        pooled = np.take_along_axis(response, at[:, None, :], 1)[:, 0]
        hidden = np.maximum(pooled + self.bias, 0)
        error = np.exp(self.log_softmax(pooled))
        error[np.arange(n), classes] -= 1
        error /= n
        back = (error @ self.out.T) * (hidden > 0)
        chosen = np.take_along_axis(x, at[:, :, None], 1)  # window, filter, column
        d_filters = np.einsum("nf,nfc->cf", back, chosen) * self.mask
        d_column = (back[:, :, None] * self.filters.T[None]).reshape(n, -1, _WIDE, EMBED)
        byte_at = np.take_along_axis(windows[:, None, :].repeat(at.shape[1], 1), at[:, :, None] + np.arange(_WIDE), 2)
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, byte_at.ravel(), d_column.reshape(-1, EMBED))
        return [d_embed, d_filters, back.sum(0), hidden.T @ error, error.sum(0)]

    def fit(self, windows: np.ndarray, classes: np.ndarray, seed: int = 0) -> Network:
        """Adam over shuffled batches; small samples get more epochs."""
        rng = np.random.default_rng(seed)
        weights = [self.embed, self.filters, self.bias, self.out, self.out_bias]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        epochs = max(EPOCHS, -(-MIN_STEPS * BATCH // max(1, len(windows))))
        for _ in range(epochs if len(windows) else 0):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), BATCH):
                step += 1
                part = order[i : i + BATCH]
                for w, m, v, g in zip(weights, first, second, self.gradients(windows[part], classes[part]), strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def fit(docs: DataFrame, allowed) -> tuple[list[str], Network | None]:
    """Languages and network learned from the documents for which the condition `allowed` holds on doc_id."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & allowed).select("doc_id", "lang", "text")
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return [], None
    scale = 1 << 30
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(scale, int(scale * TRAIN_DOCS / len(counts) / n)))])
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(scale)) < share[F.col("lang")])

    def pick(batches):
        for batch in batches:
            ids, langs = batch.column("doc_id").to_numpy(zero_copy_only=False), np.array(batch.column("lang").to_pylist())
            for first, end, data, offsets in text_slices(batch.column("text")):
                windows, row, _ = cut_windows(data, offsets)
                count = np.bincount(row, minlength=end - first)
                begin = np.cumsum(count) - count
                # spread evenly, at a start that depends on the id
                k = np.arange(WINDOWS_PER_DOC)
                shift = (ids[first:end].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(float) / 2**24
                at = np.floor((k + shift[:, None]) / WINDOWS_PER_DOC * count[:, None]).astype(int)
                use = (count[:, None] > at) & (np.diff(at, prepend=-1) != 0)
                picked = (begin[:, None] + at)[use]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(ids[first:end], use.sum(1))),
                        pa.array(np.repeat(langs[first:end], use.sum(1)), pa.string()),
                        pa.array([w.tobytes() for w in windows[picked]], pa.binary()),
                    ],
                    names=["doc_id", "lang", "window"],
                )

    rows = sample.mapInArrow(pick, "doc_id long, lang string, window binary").limit(3 * TRAIN_DOCS * WINDOWS_PER_DOC).toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("window", "ascending")])
    langs = sorted(counts)
    place = {k: i for i, k in enumerate(langs)}
    windows = np.frombuffer(b"".join(rows["window"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    return langs, Network(len(langs)).fit(windows, np.array([place[x] for x in rows["lang"].to_pylist()], int))


def predict(docs: DataFrame, langs: list[str], network: Network | None, *keep) -> DataFrame:
    """The columns `keep`, lang_pred and score of every row of docs."""
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if network is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    kept = docs.select(*keep, has_letter.alias("__letter"), F.col("text").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        net = shared.value
        names = np.array(langs, object)
        for batch in batches:
            best, score = np.empty(batch.num_rows, object), np.empty(batch.num_rows)
            for first, end, data, offsets in text_slices(batch.column("__text")):
                windows, row, held = cut_windows(data, offsets)
                logs = net.predict(windows)
                mean = np.stack([np.bincount(row, weights=c * held, minlength=end - first) for c in logs.T], 1)
                mean /= np.maximum(1, np.bincount(row, weights=held, minlength=end - first))[:, None]
                share = np.exp(mean - mean.max(1, keepdims=True))
                share /= share.sum(1, keepdims=True)
                best[first:end], score[first:end] = names[share.argmax(1)], share.max(1)
            letter = batch.column("__letter").to_numpy(zero_copy_only=False).astype(bool)
            best[~letter], score[~letter] = "und", 0.0
            own = batch.schema.names[:-2]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in own], pa.array(best, pa.string()), pa.array(score)], names=[*own, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-2])
    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    base, remainder = HELD_OUT
    langs, network = fit(docs, doc_crc("doc_id") % base != remainder)
    held_out = F.coalesce(doc_crc("doc_id") % base == remainder, F.lit(False)).alias("held_out")
    return predict(docs, langs, network, "doc_id", held_out)
