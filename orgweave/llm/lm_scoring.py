"""Language-model scores from a trigram model of all words, pairs and triples, as an Elias-Fano trie in shards.

Tokens are hashed words and an end token. Every word, pair and triple of the training
documents counts; there are no thresholds, so the model grows with the corpus. It is never in
one place: words are dealt to shards by their hash, triples by the hash of their context (the
pair before the third word), so a shard has all followers of its contexts. Triples are
interpolated by absolute discounting over pairs, pairs by a Dirichlet prior over words, words
by add-one shares; each distribution sums to one but for the codes' rounding.

A task that reads texts cuts them into slices and sends each shard, in one block, the slice's
distinct words and triples with their training counts. The shard adds the counts up, makes its
part of the trie (`elias_fano.Trie`: monotone pointers and quantised smoothed probabilities in
memory-mapped levels) and answers each block from it, in the block's order, by context-relative
successor search; words are answered with their exact counts, which the base score needs. A
second pass over the texts says where in a slice the distinct ones stand, and meets the answers.
A slice sends a word or triple once, so frequent ones skew no task; the number of shards is that
of the shuffle partitions, which a session sets in proportion to its input. Both passes have to
cut the same slices: the sums of the keys are compared, and a difference is an error.

Defined cases: null and empty texts are the end token alone; a null doc_id is scored, with
held_out false, and not learned from; repeated rows are scored each; without training
documents all counts are 0; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.llm.elias_fano import NONE, Trie, masses, shares
from orgweave.llm.common import LOWER, doc_crc, mix, read, span_hashes, text_slices, word_spans

HELD_OUT = (7, 2)
DISCOUNT = 0.5
#: Weight of the add-one shares among a word's followers, in tokens.
PRIOR = 64.0
_END, _BEGIN, _NONE, _PAD = (np.uint64(x) for x in (0x5EED0E0D, 0x5EED0B19, 0x5EED0909, 0x5EED0BAD))
_SLICE = 6 << 20
_BATCH = 1 << 23
_BLOCKS = "slice long, shard int, wanted int, total long, body binary"


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all tokens in order, each row ended by the end token."""
    low = LOWER[data]
    start, end, row = word_spans(low, offsets)
    rows = len(offsets) - 1
    out_row, out = np.empty(len(row) + rows, np.int64), np.full(len(row) + rows, _END)
    at = np.arange(len(row)) + row
    out_row[at], out[at] = row, span_hashes(low, start, end)
    ends = np.cumsum(np.bincount(row, minlength=rows)) + np.arange(rows)
    out_row[ends] = np.arange(rows)
    return out_row, out


class Model:
    """The training texts. The shards are made while scoring."""

    def __init__(self, texts: DataFrame) -> None:
        self.texts = texts


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, index): places of the distinct keys' first occurrences in order, and each key's number among them."""
    _, first, place = np.unique(keys, return_index=True, return_inverse=True)
    order = np.argsort(first)
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return first[order], number[place]


class _Slice:
    """Words and triples of some rows; a closing triple of each row has the row's last pair as its context."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, shards: int) -> None:
        self.row, h = tokens(data, offsets)
        rows, n = len(offsets) - 1, len(h)
        self.at = np.arange(n) + self.row
        self.long_row = np.empty(n + rows, np.int64)
        c = np.full(n + rows, _PAD)
        close = np.flatnonzero(h == _END) + np.arange(1, rows + 1)
        c[self.at], self.long_row[self.at], self.long_row[close] = h, self.row, np.arange(rows)
        first = np.ones(len(c), bool)
        first[1:] = self.long_row[1:] != self.long_row[:-1]
        b = np.where(first, _BEGIN, np.roll(c, 1))
        a = np.where(first, _NONE, np.roll(b, 1))
        pair = mix(mix(a + _PAD) + b)
        self.words, self.word_index = _distinct(h)
        self.triples, self.triple_index = _distinct(mix(pair + c * _END))
        self.word, self.pair, self.third = h[self.words], pair[self.triples], c[self.triples]
        self.word_shard = (self.word % np.uint64(shards)).astype(np.int64)
        self.triple_shard = (self.pair % np.uint64(shards)).astype(np.int64)
        self.total = int((self.word.sum() ^ self.pair.sum() ^ self.third.sum()).view(np.int64)) if n else 0

    def by_shard(self, shards: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(its words, its triples), each in order, of every shard."""
        parts = []
        for of in (self.word_shard, self.triple_shard):
            order = np.argsort(of, kind="stable")
            parts.append(np.split(order, np.cumsum(np.bincount(of, minlength=shards))[:-1]))
        return list(zip(*parts, strict=True))


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays in one block, each compressed."""
    out = []
    for x in arrays:
        body = pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True) if len(x) else b""
        out += [np.array([len(x), len(body)], np.int64).tobytes(), body]
    return b"".join(out)


def _unpack(block: bytes, kinds: list[str]) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n, size = np.frombuffer(block, np.int64, 2, at)
        at += 16
        size_of = int(n) * np.dtype(kind).itemsize
        out.append(np.frombuffer(pa.decompress(block[at : at + size], size_of, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind))
        at += size
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """Eight bytes a number, the lowest of all numbers first, which packs well."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.ravel()


def _wide(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(8, -1).T).view("<i8").ravel()


def _index(index: np.ndarray) -> list[np.ndarray]:
    """A numbering by first occurrence: a bit for each new number, and the numbers of the others."""
    new = np.zeros(len(index), bool)
    if len(index):
        new[0], new[1:] = True, index[1:] > np.maximum.accumulate(index)[:-1]
    return [np.packbits(new), _narrow(index[~new])]


def _indexed(n: int, bits: np.ndarray, others: np.ndarray) -> np.ndarray:
    new = np.unpackbits(bits, count=n).astype(bool)
    out = np.cumsum(new) - 1
    out[~new] = _wide(others)
    return out


def _top(keys: np.ndarray, size: int) -> np.ndarray:
    """The highest `size` bytes of each key; the lowest bits say little beside the shard."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - size :].ravel()


def _keys(tops: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(tops) // size, 8), np.uint8)
    out[:, :size] = tops.reshape(-1, size)
    return out.view("<u8").ravel()


def _joint(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of numbers as the distinct rows, most frequent first, and each row's place among them."""
    key = np.zeros(len(columns[0]), np.uint64)
    for x in columns:
        key = mix(key + x.astype(np.uint64) + np.uint64(1))
    _, first, place, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return [*(_narrow(x[first[order]]) for x in columns), _narrow(rank[place])]


#: Bytes kept of the hash of a word, of a context (beside its shard) and of the word after it (beside its context).
_WORD, _CONTEXT, _THIRD = 6, 5, 4
_QUERY = ["u1"] * 5
_ANSWER = ["u1"] * 5 + ["<i8"]
_WHERE = ["u1"] * 4 + ["<u2", "<u2", "<i8", "<i8", "u1"]


def _sliced(batches, shards: int):
    """(slice, its number in the task, Slice, doc_id, held_out, learn, ask) of the texts of a task."""
    number = 0
    for batch in batches:
        learn, ask = (batch.column(x).to_numpy(zero_copy_only=False).astype(bool) for x in ("learn", "ask"))
        for first, end, data, offsets in text_slices(batch.column("text"), _SLICE):
            ids, held = batch.column("doc_id").slice(first, end - first), batch.column("held_out").slice(first, end - first)
            yield batch.column("part")[0].as_py() << 32 | number, _Slice(data, offsets, shards), ids, held, learn[first:end], ask[first:end]
            number += 1


class _Out:
    """Rows of blocks, handed over in batches of bounded bytes."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, *row) -> bool:
        self.rows.append(row)
        self.size += len(row[-1])
        return self.size > _BATCH

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [()] * 5
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["slice", "shard", "wanted", "total", "body"])


def _ask(shards: int):
    """Texts to blocks for the shards: distinct words and triples with their training counts."""

    def run(batches):
        out = _Out()
        for name, s, _, _, learn, ask in _sliced(batches, shards):
            words = np.bincount(s.word_index, weights=learn[s.row], minlength=len(s.word)).astype(np.int64)
            triples = np.bincount(s.triple_index, weights=learn[s.long_row], minlength=len(s.pair)).astype(np.int64)
            for shard, (w, t) in enumerate(s.by_shard(shards)):
                body = _pack([_top(s.word[w], _WORD), _narrow(words[w]), _top(s.pair[t], _CONTEXT), _top(s.third[t], _THIRD), _narrow(triples[t])])
                if out.add(name, shard, int(ask.any()), s.total, body):
                    yield out.take()
        yield out.take()

    return run


def _answer(batches):
    """All blocks of a shard to blocks of answers: counts of the words; codes of the triples and their contexts; counts of all the shard's tokens and words."""
    heads, parts = [], []
    for batch in batches:
        for name, shard, wanted, total, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            heads.append((name, shard, wanted, total))
            parts.append(_unpack(body, _QUERY))
    if not heads:
        return
    word, key, third = (_keys(np.concatenate([p[i] for p in parts]), size) for i, size in ((0, _WORD), (2, _CONTEXT), (3, _THIRD)))
    word_count, count = (np.concatenate([_wide(p[i]) for p in parts]) for i in (1, 4))
    cuts = [np.cumsum([0] + [len(p[i]) // size for p in parts]) for i, size in ((0, _WORD), (2, _CONTEXT))]
    del parts
    _, place = np.unique(word, return_inverse=True)
    sums = np.bincount(place, weights=word_count).astype(np.int64)
    n1, totals = sums[place], np.array([sums.sum(), (sums > 0).sum()])
    order = np.lexsort((third, key))
    key, third = key[order], third[order]
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (third[1:] != third[:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    sums = np.add.reduceat(count[order], np.flatnonzero(new)) if len(order) else count
    key, third = key[new], third[new]
    learned = sums > 0
    trie = Trie.build(*np.unique(key[learned], return_inverse=True), third[learned], sums[learned], DISCOUNT).mapped()
    # the shard's distinct triples are searched once; a block's answers are those of its own
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    codes = trie.look_up(key[first], np.cumsum(first) - 1, third)
    del order, new, sums, learned, key, third, first, count
    out = _Out()
    for k, (name, shard, wanted, total) in enumerate(heads):
        if wanted:
            w, t = slice(cuts[0][k], cuts[0][k + 1]), slice(cuts[1][k], cuts[1][k + 1])
            if out.add(name, shard, wanted, total, _pack([_narrow(n1[w]), *_joint([x[place[t]] for x in codes]), totals])):
                yield out.take()
    yield out.take()


def _where(shards: int):
    """Texts to one block a slice (shard -1): where its words and triples stand, and its rows."""

    def run(batches):
        out = _Out()
        for name, s, ids, held, _, ask in _sliced(batches, shards):
            if not ask.any():
                continue
            known = np.flatnonzero(ask) if ids.null_count == 0 else np.flatnonzero(ask & ids.is_valid().to_numpy(zero_copy_only=False))
            lengths = np.bincount(s.row, minlength=len(ask))
            # a row's flags: 1 asked, 2 held out, 4 has an id
            flags = ask + 2 * held.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            flags[known] += 4
            body = _pack([
                *_index(s.word_index), *_index(s.triple_index), s.word_shard.astype("<u2"), s.triple_shard.astype("<u2"),
                lengths, ids.fill_null(0).to_numpy(), flags.astype(np.uint8),
            ])
            if out.add(name, -1, 1, s.total, body):
                yield out.take()
        yield out.take()

    return run


def _joined(shards: int):
    """Blocks of the slices to a row for each document."""

    def scores(where: bytes, answers: dict[int, bytes]) -> pa.RecordBatch:
        *indexes, word_shard, triple_shard, lengths, ids, flags = _unpack(where, _WHERE)
        counts = [np.zeros(len(word_shard), np.int64), *(np.zeros(len(triple_shard), np.int64) for _ in range(3))]
        order = [np.argsort(x, kind="stable") for x in (word_shard, triple_shard)]
        begin, train, distinct = [0, 0], 0, 0
        for shard in range(shards):
            *parts, totals = _unpack(answers[shard], _ANSWER)
            of_word, *rows_of, place = map(_wide, parts)
            of_triple = [x[place] for x in rows_of]
            train, distinct = train + int(totals[0]), distinct + int(totals[1])
            counts[0][order[0][begin[0] : begin[0] + len(of_word)]] = of_word
            at = order[1][begin[1] : begin[1] + len(of_triple[0])]
            for kept, x in zip(counts[1:], of_triple, strict=True):
                kept[at] = x
            begin = [begin[0] + len(of_word), begin[1] + len(at)]
        rows, n = len(lengths), int(lengths.sum())
        row = np.repeat(np.arange(rows), lengths)
        n1 = counts[0][_indexed(n, *indexes[:2])]
        long = _indexed(n + rows, *indexes[2:])
        at = np.arange(n) + row
        share3, back, mass = (x[long[at]] for x in counts[1:])
        # the pair that ends here is the context of the next triple
        pair = masses(counts[3][long[at + 1]])
        first = np.ones(n, bool)
        first[1:] = row[1:] != row[:-1]
        before = np.roll(n1, 1)
        before[first] = n1[np.cumsum(lengths) - 1]  # as many texts begin as end
        share = (n1 + 1) / (train + distinct + 1)
        p = (pair + PRIOR * share) / (before + PRIOR)
        p = np.where(mass != NONE, shares(share3) + shares(back) * p, p)
        add = lambda x: np.bincount(row, weights=x, minlength=rows)
        asked = np.flatnonzero(flags & 1)
        columns = [
            pa.array(ids, mask=flags & 4 == 0), pa.array(flags & 2 > 0), pa.array(lengths), pa.array(add(n1 > 0).astype(np.int64)),
            pa.array(np.full(rows, train)), pa.array(add(np.log10(share))), pa.array(np.minimum(add(np.log10(p)), 0.0)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]).take(pa.array(asked))

    def run(batches):
        held: dict[int, dict[int, bytes]] = {}
        expected: dict[int, int] = {}
        for batch in batches:
            for name, shard, wanted, total, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if expected.setdefault(name, total) != total:
                    raise RuntimeError("the two passes over the texts cut different slices")
                own = held.setdefault(name, {})
                own[shard] = body
                if len(own) == shards + 1:
                    del held[name]
                    yield scores(own.pop(-1), own)
        if held:
            raise RuntimeError("the two passes over the texts cut different slices")

    return run


def _scored(texts: DataFrame) -> DataFrame:
    """texts: doc_id, held_out, text, learn (counts in the model) and ask (is returned)."""
    # not the task's own number, which differs where one pass shares its stage with others
    texts = texts.withColumn("part", F.spark_partition_id().cast("long"))
    shards = min(max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1 << 16)
    asked = texts.mapInArrow(_ask(shards), _BLOCKS).repartitionById(shards, F.col("shard"))
    answers = asked.mapInArrow(_answer, _BLOCKS)
    where = texts.mapInArrow(_where(shards), _BLOCKS)
    # slices of one task go to tasks in turn
    to = F.pmod(F.col("slice") % (1 << 32) + F.shiftright("slice", 32) * 7919, F.lit(shards)).cast("int")
    met = answers.union(where).repartitionById(shards, to)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return met.mapInArrow(_joined(shards), schema)


def _texts(docs: DataFrame, held_out: Column, learn: Column, ask: bool) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text", learn.alias("learn"), F.lit(ask).alias("ask"))


def score(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    none = F.lit(None).cast("long").alias("doc_id")
    learned = _texts(model.texts.select(none, "text"), F.lit(False), F.lit(True), False)
    return _scored(learned.union(_texts(docs, held_out, F.lit(False), True)))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    base, remainder = HELD_OUT
    held_out = F.coalesce(doc_crc("doc_id") % base == remainder, F.lit(False))
    training = F.col("doc_id").isNotNull() & ~held_out
    # one pass serves both: a training document is counted and scored
    return _scored(_texts(docs, held_out, training, True))
