"""Vector bin packing of token sequences by the dot-product heuristic.

Examples are placed under three limits at once: tokens, segments and loss-bearing tokens of
a sequence. A bin is filled by taking, of all examples that still fit, the one whose demand
vector has the largest dot product with the bin's free room, both as shares of the limits.
When none fits and at least MIN_PIECE tokens and one segment are free, the head of the
longest example is cut off to fill the bin; its tail stays to be placed. Examples longer
than a sequence give whole sequences first.

Every task packs the rows it reads, without a shuffle: it holds POOL examples at most, and
writes full bins while more than half of them remain, so that a choice stays to the end. The
last sequence of a task, shorter than the limit, is cut at powers of two. A sequence's id
is made of the number of the task's partition and a count, so a repeated task gives the same
ids; the input should be files or another source that keeps its partitions.

Defined cases: a null text counts as empty and is its end token alone; repeated rows are
packed each; an empty table gives no piece; other columns are ignored. For conversations,
null ids form one conversation, and null turns or roles come first and bear no loss.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.llm.common import LOWER, empties_cache, read, span_hashes, spans, text_slices

LIMIT = 4096
SEGMENTS = 512
POOL = 2048
MIN_PIECE = 16
END_ID = 2


@dataclass
class Example:
    """ids or only a length; loss: cumulative loss-bearing tokens before each place, none if all bear loss."""

    key: object
    size: int
    ids: np.ndarray | None = None
    loss: np.ndarray | None = None
    start: int = 0

    def loss_of(self, length: int) -> int:
        return length if self.loss is None else int(self.loss[self.start + length] - self.loss[self.start])


@dataclass
class Piece:
    example: Example
    start: int
    length: int
    sequence: int
    offset: int


@dataclass
class Packer:
    limit: int = LIMIT
    segments: int = SEGMENTS
    loss_limit: int = LIMIT
    pool_size: int = POOL
    pool: list[Example] = field(default_factory=list)
    made: int = 0

    def _emit(self, taken: list[tuple[Example, int, int]]) -> Iterator[Piece]:
        offset = 0
        for example, start, length in taken:
            yield Piece(example, start, length, self.made, offset)
            offset += length
        self.made += 1

    def add(self, example: Example) -> Iterator[Piece]:
        while example.size - example.start >= self.limit and example.loss_of(self.limit) <= self.loss_limit:
            yield from self._emit([(example, example.start, self.limit)])
            example.start += self.limit
        if example.start < example.size:
            self.pool.append(example)
        if len(self.pool) >= self.pool_size:
            yield from self._pack(self.pool_size // 2)

    def finish(self) -> Iterator[Piece]:
        yield from self._pack(0)

    def _pack(self, keep: int) -> Iterator[Piece]:
        """Fill bins until at most `keep` examples remain."""
        pool = self.pool
        sizes = np.array([e.size - e.start for e in pool], float)
        losses = np.array([e.loss_of(e.size - e.start) for e in pool], float)
        left = len(pool)
        while left > keep:
            free, room, loss_room, taken = self.limit, self.segments, self.loss_limit, []
            while room and free and left:
                fits = (sizes > 0) & (sizes <= free) & (losses <= loss_room)
                if fits.any():
                    dot = sizes * (free / self.limit**2) + losses * (loss_room / max(1, self.loss_limit) ** 2) + room / self.segments**2
                    k = int(np.argmax(np.where(fits, dot, -1)))
                    length = int(sizes[k])
                elif free >= min(MIN_PIECE, self.limit) or not taken:
                    k = int(sizes.argmax())
                    length = min(free, int(sizes[k]))
                    while length > 1 and pool[k].loss_of(length) > loss_room:
                        length //= 2
                    if pool[k].loss_of(length) > loss_room and taken:
                        break
                else:
                    break
                example = pool[k]
                taken.append((example, example.start, length))
                free, room, loss_room = free - length, room - 1, loss_room - example.loss_of(length)
                example.start += length
                sizes[k] -= length
                losses[k] = example.loss_of(int(sizes[k]))
                left -= sizes[k] == 0
            if not left and free:
                for part in self._cut_at_powers(taken):
                    yield from self._emit(part)
            else:
                yield from self._emit(taken)
        self.pool = [e for e, n in zip(pool, sizes, strict=True) if n > 0]

    def _cut_at_powers(self, taken: list[tuple[Example, int, int]]) -> Iterator[list[tuple[Example, int, int]]]:
        """The last bin as sequences whose lengths are powers of two."""
        rest = sum(length for _, _, length in taken)
        todo = list(reversed(taken))
        while rest:
            size = 1 << (rest.bit_length() - 1)
            rest -= size
            part = []
            while size:
                example, start, length = todo.pop()
                use = min(size, length)
                part.append((example, start, use))
                if use < length:
                    todo.append((example, start + use, length - use))
                size -= use
            yield part


class Pieces:
    """Ids of pieces of text by their 64-bit hashes: an open-addressing table in arrays, emptied when it is full."""

    BITS, FULL = 22, 1_400_000

    def __init__(self) -> None:
        size = 1 << self.BITS
        self.keys, self.begin, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.ids, self.used, self.count = np.zeros(1 << 20, np.uint32), 0, 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 for unknown ones."""
        slot, found = self._slots(h), np.full(len(h), -1, np.int64)
        open_ = np.arange(len(h))
        while len(open_):
            at = slot[open_]
            there = self.keys[at]
            hit = there == h[open_]
            found[open_[hit]] = at[hit]
            open_ = open_[~hit & (there != 0)]
            slot[open_] = (slot[open_] + 1) & ((1 << self.BITS) - 1)
        return found

    def add(self, h: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """New hashes, each once, with their ids one after another."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(self.ids), 2 * len(ids)), np.uint32)])
        begins = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + len(ids)] = ids
        self.used, self.count = self.used + len(ids), self.count + len(h)
        slot, open_ = self._slots(h), np.arange(len(h))
        while len(open_):
            at = slot[open_]
            free = self.keys[at] == 0
            self.keys[at[free]] = h[open_[free]]
            mine = self.keys[at] == h[open_]
            self.begin[at[mine]], self.length[at[mine]] = begins[open_[mine]], lengths[open_[mine]]
            open_ = open_[~mine]
            slot[open_] = (slot[open_] + 1) & ((1 << self.BITS) - 1)


class Encoder:
    """Token ids of texts.

    White space separates tokens here, and so does the place between a Latin letter and the punctuation that ends a word,
    so ids are remembered by piece, for ASCII letters in lower case, as the tokenizer puts them. All new runs of letters of a
    slice of texts are encoded in one call, other new pieces one by one. Whether a tokenizer allows this is tried on
    PROBE when it is loaded; with one that does not, whole texts are encoded.
    """

    PROBE = "The quick  Brown fox, jumps! over 12 lazy dogs.\nÜber Straße;\tça va? naïve façade #tag $5 a.b x** don't. end... 'S. É,. \n\n a_b_, ŁÓDŹ! “x”. é– end"
    _SPACE, _TAIL, _LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
    _SPACE[[0x20, 0x09, 0x0A]] = True
    _TAIL[[ord(c) for c in ".,*#$%&!|;:?"]] = True
    _LETTER[ord("a") : ord("z") + 1] = True

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.by_piece = Tokenizer.from_file(path), Pieces(), True
        self.by_piece = self.many([self.PROBE])[0].tobytes() == self._one(self.PROBE).tobytes()

    @staticmethod
    @lru_cache(2)
    def of(path: str) -> Encoder:
        """The encoder of this process."""
        return Encoder(path)

    def _one(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learned(self, pieces: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(an order of the pieces, their ids one after another, how many each has)."""
        runs, others = [], []
        for k, w in enumerate(pieces):
            (runs if w.isalpha() else others).append(k)
        parts, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        if runs:
            found = self.tokenizer.encode(" ".join([pieces[k] for k in runs]), add_special_tokens=False)
            ids, of_word = np.array(found.ids, np.uint32), np.array(found.word_ids, np.int64)
            cuts = np.searchsorted(of_word, np.arange(len(runs) + 1))
            if len(of_word) and of_word[-1] == len(runs) - 1 and (np.diff(cuts) > 0).all():
                parts.append(ids)
                lengths.append(np.diff(cuts))
            else:  # a letter that the tokenizer's normal form takes apart
                runs, others = [], [*runs, *others]
        each = [self._one(pieces[k]) for k in others]
        lengths.append(np.array([len(x) for x in each], np.int64))
        return [*runs, *others], np.concatenate([*parts, *each]), np.concatenate(lengths)

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces: what lies between white space, the punctuation at its end by itself."""
        starts, ends, _ = spans(~self._SPACE[data], offsets)
        if not len(starts):
            return starts, ends
        last = np.maximum.accumulate(np.where(self._TAIL[data], -1, np.arange(len(data))))
        tail = last[ends - 1] + 1  # behind the last byte that is no punctuation
        before, two = data[np.maximum(tail - 1, 0)], data[np.maximum(tail - 2, 0)]
        latin = (two == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (tail - 2 >= starts)
        cut = (tail > starts) & (tail < ends) & (self._LETTER[before] | latin)
        at = np.flatnonzero(cut) + 1
        return np.insert(starts, at, tail[cut]), np.insert(ends, at - 1, tail[cut])

    def column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text of a column; null counts as empty."""
        if not self.by_piece:
            yield from (self._one(t or "") for t in column.to_pylist())
            return
        for _, _, data, offsets in text_slices(column):
            data = LOWER[data]
            starts, ends = self._pieces(data, offsets)
            h = span_hashes(data, starts, ends)
            h[h == 0] = 1
            slots = self.known.find(h)
            if (slots < 0).any():
                if self.known.count > self.known.FULL:
                    self.known = Pieces()
                    slots[:] = -1
                new, first = np.unique(h[slots < 0], return_index=True)
                first = np.flatnonzero(slots < 0)[first]
                raw = data.tobytes()
                order, ids, lengths = self._learned([raw[s:e].decode() for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
                self.known.add(new[order], ids, lengths)
                slots = self.known.find(h)
            begin, length = self.known.begin[slots].astype(np.int64), self.known.length[slots].astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(length)])
            every = self.known.ids[np.repeat(begin - upto[:-1], length) + np.arange(upto[-1])]
            cuts = upto[np.searchsorted(starts, offsets)]
            for i, j in pairwise(cuts.tolist()):
                yield every[i:j]

    def many(self, texts: list[str]) -> list[np.ndarray]:
        return list(self.column(pa.array(texts, pa.large_string())))


empties_cache(Encoder.of.cache_clear)


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TYPES = [pa.int64()] * 7


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, limit: int = LIMIT, segments: int = SEGMENTS, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. All tokens bear loss."""
    path = tokenizer_path or _vocabulary()
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def run(batches):
        first = TaskContext.get().partitionId() << 33
        encode, packer = Encoder.of(path), Packer(limit, segments, limit)
        rows: list[tuple] = []

        def note(pieces: Iterator[Piece]) -> None:
            for p in pieces:
                crc = zlib.crc32(p.example.ids[p.start : p.start + p.length].astype("<u4").tobytes())
                rows.append((p.example.key, p.start, p.length, crc, p.example.size, first + p.sequence, p.offset))

        def written() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=names)
            rows.clear()
            return out

        for batch in batches:
            for key, own in zip(batch.column("doc_id").to_pylist(), encode.column(batch.column("text")), strict=True):
                ids = np.append(own, np.uint32(end_id))
                note(packer.add(Example(key, len(ids), ids)))
                if len(rows) >= 10_000:
                    yield written()
        note(packer.finish())
        yield written()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def pack_conversations(
    conversations: DataFrame, tokenizer_path: str | None = None, limit: int = LIMIT, segments: int = 64, loss_limit: int = LIMIT, loss_role: str = "assistant"
) -> DataFrame:
    """One row for each piece of a conversation: conv_id, start, length, n_loss, sequence_id, offset.

    A conversation is its turns in order, each followed by the end token; the turns of loss_role bear loss.
    """
    path = tokenizer_path or _vocabulary()

    def count(batches):
        encode = Encoder.of(path)
        for batch in batches:
            n = [len(x) + 1 for x in encode.column(batch.column("text"))]
            own = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], pa.array(n, pa.int64())], names=[*own, "n"])

    bears = F.coalesce(F.col("role") == loss_role, F.lit(False))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), bears.alias("bears"), "text")
    counted = turns.mapInArrow(count, "conv_id long, turn long, bears boolean, n long")
    joined = counted.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "n", "bears"))).alias("turns"))
    names = ["conv_id", "start", "length", "n_loss", "sequence_id", "offset"]

    def pack(batches):
        first, packer = TaskContext.get().partitionId() << 33, Packer(limit, segments, loss_limit)

        def rows(pieces: Iterator[Piece]) -> pa.RecordBatch:
            out = [(p.example.key, p.start, p.length, int(p.example.loss[p.start + p.length] - p.example.loss[p.start]), first + p.sequence, p.offset) for p in pieces]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(6)], names=names)

        for batch in batches:
            for key, parts in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
                bearing = np.concatenate([np.full(p["n"], p["bears"]) for p in parts])
                loss = np.concatenate([[0], np.cumsum(bearing)])
                yield rows(packer.add(Example(key, len(bearing), None, loss)))
        yield rows(packer.finish())

    return joined.mapInArrow(pack, "conv_id long, start long, length long, n_loss long, sequence_id long, offset long")


def op9(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
