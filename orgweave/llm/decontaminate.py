"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are compared as UTF-8 bytes with A-Z lower-cased and each run of
white space as one space. An item of m bytes may differ from a passage by k = RATE * m edits
(less for items too short for the lemma). A passage within k edits shares at least
m - Q + 1 - k * Q q-grams with the item, and their diagonals (place in the text less place in
the item) lie within k of each other. Diagonals are counted in overlapping bands of 2(k + 1)
at a step of k + 1, so each such passage lies in one band wholly. Bands that reach the bound
are verified by banded alignment, as many candidates at once as their cells allow. An item over LONG
bytes is first tried by the longest chain of its q-grams in the band, of which only the gaps are aligned:
what the chain proves is found, with the chain's edits, in time that follows the length; only what
it leaves open is aligned over the whole band.

The benchmark is a stated query set: it is indexed in blocks of about BLOCK_BYTES, each one
broadcast and held against every document, so its memory is bounded however large it is.

Defined cases: null and empty texts match nothing; null and empty items, and items under Q
bytes, which are in most texts, match nothing; repeated items are found each; repeated documents are
searched each; empty tables give empty results; other columns are passed through.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.llm.common import LOWER, empty_caches, read, text_slices

Q = 8
RATE = 0.1
#: Places of q-grams in items that are looked at at once.
AT_ONCE = 1 << 21
BLOCK_BYTES = 4 << 20
#: Items of more bytes are first tried by chains of exact matches; cells that are aligned at once.
LONG = 2000
CELLS = 1 << 24
_BITS = 20
_FOLD = LOWER.copy()
_FOLD[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, their offsets, place of each in data); runs of white space keep their first byte."""
    out = _FOLD[data]
    space = out == 0x20
    drop = np.zeros(len(out), bool)
    drop[1:] = space[1:] & space[:-1]
    drop[offsets[:-1][offsets[:-1] < len(out)]] = False
    at = np.flatnonzero(~drop)
    return out[at], np.searchsorted(at, offsets), at


def grams(data: np.ndarray) -> np.ndarray:
    """The Q = 8 bytes from each place as one number."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    return np.ndarray((len(data) - Q + 1,), "<u8", data, strides=(1,))


def _slot(g: np.ndarray) -> np.ndarray:
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)


def _blocks(text: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, place, length) of the longest chain in which the q-grams at these places follow each other in both."""
    ends: list[int] = []
    last: list[int] = []
    before = np.full(len(place), -1, np.int64)
    for k, p in enumerate(place.tolist()):
        n = bisect_left(ends, p)
        if n:
            before[k] = last[n - 1]
        if n == len(ends):
            ends.append(p)
            last.append(k)
        else:
            ends[n], last[n] = p, k
    chain, k = [], last[-1] if last else -1
    while k >= 0:
        chain.append(k)
        k = int(before[k])
    out: list[tuple[int, int, int]] = []
    for k in reversed(chain):
        a, p, n = int(text[k]), int(place[k]), Q
        if out:
            a0, p0, n0 = out[-1]
            if a - p == a0 - p0 and a <= a0 + n0:
                out[-1] = (a0, p0, a + Q - a0)
                continue
            cut = max(0, a0 + n0 - a, p0 + n0 - p)  # neighbours on other diagonals may not overlap
            a, p, n = a + cut, p + cut, n - cut
        if n > 0:
            out.append((a, p, n))
    return out


def _edits(pattern: np.ndarray, text: np.ndarray, most: int, whole: bool = False) -> tuple[int, int]:
    """(edits, bytes of the text) of a piece of an item: against the whole text, or the beginning of it that costs least; most + 1 if it takes more."""
    if whole and not len(pattern):
        return len(text), len(text)
    if whole and abs(len(pattern) - len(text)) > most:
        return most + 1, len(text)
    steps = np.arange(len(text) + 1)
    cost = steps.copy()
    for i, c in enumerate(pattern, 1):
        new = np.empty_like(cost)
        new[0] = i
        new[1:] = np.minimum(cost[:-1] + (text != c), cost[1:] + 1)
        cost = np.minimum.accumulate(new - steps) + steps
        if cost.min() > most:
            return most + 1, 0
    used = len(text) if whole else int(cost.argmin())
    return int(cost[used]), used


@dataclass
class Index:
    """Postings of a block's q-grams. items: (item_id, folded bytes)."""

    ids: list
    texts: list[np.ndarray]
    edits: np.ndarray
    need: np.ndarray
    seen: np.ndarray
    keys: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    place: np.ndarray
    #: of long items that were met: their q-grams that occur once, and where
    single: dict = field(default_factory=dict)

    @staticmethod
    def build(rows: list[tuple], rate: float = RATE) -> Index:
        ids, texts = [], []
        for item_id, text in rows:
            raw = np.frombuffer((text or "").strip().encode(), np.uint8)
            folded = fold(raw, np.array([0, len(raw)]))[0]
            if len(folded) >= Q:
                ids.append(item_id)
                texts.append(folded)
        m = np.array([len(t) for t in texts], np.int64)
        edits = np.minimum((rate * m).astype(np.int64), (m - Q) // Q)
        all_grams = [grams(t).copy() for t in texts]
        gram = np.concatenate(all_grams) if texts else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(texts)), [len(g) for g in all_grams])
        place = np.concatenate([np.arange(len(g)) for g in all_grams]) if texts else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        keys, begin = np.unique(gram[order], return_index=True)
        seen = np.zeros(1 << _BITS, bool)
        seen[_slot(keys)] = True
        return Index(ids, texts, edits, m - Q + 1 - edits * Q, seen, keys, np.append(begin, len(gram)), item[order], place[order])

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item number, start, end, edits) of all passages in folded text; overlapping ones of an item count once."""
        if not self.ids or len(data) < Q:
            return []
        g = grams(data)
        at = np.flatnonzero(self.seen[_slot(g)])
        key = np.searchsorted(self.keys, g[at])
        key[key == len(self.keys)] = 0
        hit = self.keys[key] == g[at]
        at, key = at[hit], key[hit]
        row = np.searchsorted(offsets, at, side="right") - 1
        inside = at + Q <= offsets[row + 1]
        at, key, row = at[inside], key[inside], row[inside]
        far = max(map(len, self.texts))  # keeps every diagonal above 0
        bands = len(data) + 2 * far + 2
        many = self.begin[key + 1] - self.begin[key]
        code, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # a gram that many items hold is taken in parts, so memory is bounded by AT_ONCE and the bands that are met
        ends = np.cumsum(many)
        first = 0
        while first < len(at):
            end = max(first + 1, int(np.searchsorted(ends, ends[first] - many[first] + AT_ONCE, side="right")))
            own, part = slice(first, end), many[first:end]
            post = np.repeat(self.begin[key[own]] - (np.cumsum(part) - part), part) + np.arange(part.sum())
            item = self.item[post]
            band = (np.repeat(at[own], part) - self.place[post] + far) // (self.edits[item] + 1)
            pair = (np.repeat(row[own], part) * len(self.ids) + item) * bands + band
            new, times = np.unique(np.concatenate([pair, pair - 1]), return_counts=True)
            code, place = np.unique(np.concatenate([code, new]), return_inverse=True)
            count = np.bincount(place, weights=np.concatenate([count, times])).astype(np.int64)
            first = end
        pair, band = code // bands, code % bands
        item, row = pair % len(self.ids), pair // len(self.ids)
        good = count >= self.need[item]
        item, row, start = item[good], row[good], band[good] * (self.edits[item[good]] + 1) - far
        found: list[tuple[int, int, int, int, int]] = []
        size = np.array([len(t) for t in self.texts])[item]
        short = size <= LONG
        for k in np.flatnonzero(~short):
            chained = self._chain(data, offsets, int(row[k]), int(item[k]), int(start[k]))
            if chained:
                found.append(chained)
            else:
                found += self._verify(data, offsets, row[k : k + 1], item[k : k + 1], start[k : k + 1])
        row, item, start, size = row[short], item[short], start[short], size[short]
        # as many at once as their cells allow, items of about one length together
        order = np.argsort(size, kind="stable")
        cells = np.cumsum((size + 2 * (self.edits[item] + 1))[order])
        first = 0
        while first < len(order):
            end = max(first + 1, int(np.searchsorted(cells, cells[first] + CELLS, side="right")))
            some = order[first:end]
            found += self._verify(data, offsets, row[some], item[some], start[some])
            first = end
        best: dict[tuple[int, int], list] = {}
        for r, i, s, e, edits in sorted(found, key=lambda x: x[4]):
            mine = best.setdefault((r, i), [])
            if all(e <= s2 or s >= e2 for s2, e2, _ in mine):
                mine.append((s, e, edits))
        return [(r, i, s, e, edits) for (r, i), places in best.items() for s, e, edits in places]

    def _chain(self, data: np.ndarray, offsets: np.ndarray, row: int, item: int, start: int) -> tuple[int, int, int, int, int] | None:
        """A long item's passage by the longest chain of its own q-grams in the band, only the gaps between them aligned.

        None if the chain needs more edits than the item may have; the whole band decides then.
        """
        pattern, most = self.texts[item], int(self.edits[item])
        low, high = max(start, int(offsets[row])), min(start + len(pattern) + 2 * (most + 1), int(offsets[row + 1]))
        text = data[low:high]
        if item not in self.single:
            keys, first, times = np.unique(grams(pattern), return_index=True, return_counts=True)
            self.single[item] = keys[times == 1], first[times == 1]
        keys, first = self.single[item]
        seen = grams(text)
        if not len(keys) or not len(seen):
            return None
        at = np.searchsorted(keys, seen)
        at[at == len(keys)] = 0
        hit = np.flatnonzero(keys[at] == seen)
        blocks = _blocks(hit, first[at[hit]])
        if not blocks:
            return None
        a, p, _ = blocks[0]
        edits, used = _edits(pattern[:p][::-1], text[max(0, a - p - most) : a][::-1], most)
        begin, end_a, end_p = a - used, a, p
        for a, p, n in blocks:
            if edits > most or (p - end_p) * (a - end_a) > CELLS:
                return None
            edits += _edits(pattern[end_p:p], text[end_a:a], most - edits, whole=True)[0]
            end_a, end_p = a + n, p + n
        if edits > most:
            return None
        last, used = _edits(pattern[end_p:], text[end_a : end_a + len(pattern) - end_p + most], most - edits)
        edits += last
        return (row, item, low + begin, low + end_a + used, edits) if edits <= most else None

    def _verify(self, data: np.ndarray, offsets: np.ndarray, row: np.ndarray, item: np.ndarray, start: np.ndarray) -> list[tuple]:
        """Banded alignment: d counts the diagonals of the band, free at both ends of the text."""
        m = np.array([len(self.texts[i]) for i in item])
        rows_m, width = int(m.max()), int(2 * (self.edits[item].max() + 1))
        pattern = np.zeros((len(item), rows_m), np.uint8)
        for c, i in enumerate(item):
            pattern[c, : m[c]] = self.texts[i]
        column = start[:, None] + np.arange(rows_m + width)
        inside = (column >= offsets[row][:, None]) & (column < offsets[row + 1][:, None])
        text = np.where(inside, data[np.clip(column, 0, len(data) - 1)], 0)
        own = np.arange(width) < 2 * (self.edits[item] + 1)[:, None]
        far = np.int32(1 << 20)
        steps = np.arange(width, dtype=np.int32)
        cost = np.where(own, 0, far).astype(np.int32)
        # where the alignment in a cell began, carried along
        begin = np.broadcast_to(steps, cost.shape).copy()
        last_cost, last_begin = cost.copy(), begin.copy()
        for i in range(rows_m):
            aligned = cost + (pattern[:, i, None] != text[:, i : i + width])
            skipped = np.concatenate([cost[:, 1:] + 1, np.full((len(cost), 1), far, np.int32)], 1)
            use = skipped < aligned
            new = np.where(use, skipped, aligned)
            new_begin = np.where(use, np.concatenate([begin[:, 1:], begin[:, :1]], 1), begin)
            # extra text bytes: the cheapest cell to the left, plus the distance to it
            shifted = (new - steps) * width + steps
            lowest = np.minimum.accumulate(shifted, axis=1)
            source = lowest % width
            cost = np.where(own, lowest // width + steps, far).astype(np.int32)
            begin = np.take_along_axis(new_begin, source, 1)
            ending = m == i + 1
            last_cost[ending], last_begin[ending] = cost[ending], begin[ending]
        d = last_cost.argmin(1)
        edits = last_cost[np.arange(len(d)), d]
        found = []
        for c in np.flatnonzero(edits <= self.edits[item]):
            begin_at = max(int(start[c] + last_begin[c, d[c]]), int(offsets[row[c]]))
            end_at = min(int(start[c] + m[c] + d[c]), int(offsets[row[c] + 1]))
            found.append((int(row[c]), int(item[c]), begin_at, end_at, int(edits[c])))
        return found


def indexes(benchmark: DataFrame, rate: float = RATE):
    """The benchmark's index, block after block."""
    known = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = known.agg(F.sum(F.length(F.encode("text", "UTF-8")))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    for b in range(blocks):
        own = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else known
        yield Index.build([(r.item_id, r.text) for r in own.orderBy("item_id", "text").collect()], rate)


_FOUND = "array<struct<item_id:bigint,start:bigint,length:bigint,edits:int>>"


def find_passages(docs: DataFrame, index: Index, column: str, *keep, text_col: str = "text") -> DataFrame:
    """The columns `keep` and `column`: the item, start and length in characters and edits of every passage found."""
    kept = docs.select(*keep, docs[text_col].alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("edits", pa.int32())]))

    def run(batches):
        empty_caches()
        own = shared.value
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for first, _, data, offsets in text_slices(batch.column("__text")):
                folded, cuts, at = fold(data, offsets)
                for row, item, start, end, edits in own.matches(folded, cuts):
                    a, b = at[start], at[end - 1] + 1
                    characters = np.concatenate([[0], np.cumsum((data[offsets[row] : b] & 0xC0) != 0x80)])
                    begin = int(characters[a - offsets[row]])
                    found[first + row].append({"item_id": own.ids[item], "start": begin, "length": int(characters[-1]) - begin, "edits": edits})
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(found, kind)], names=[*names, column])

    from pyspark.sql import types as T

    fields = T.StructType(kept.schema.fields[:-1]).add(column, T._parse_datatype_string(_FOUND))
    return kept.mapInArrow(run, fields)


def contaminated_passages(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """One row for each passage: doc_id, item_id, start, length (characters), edits. Documents without one have no row."""
    out = None
    for index in indexes(benchmark, rate):
        part = find_passages(docs, index, "__found", "doc_id").select("doc_id", F.explode("__found").alias("f")).select("doc_id", "f.*")
        out = part if out is None else out.unionByName(part)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs without any benchmark passage, with all their columns."""
    columns = docs.columns
    for index in indexes(benchmark, rate):
        row = F.struct(*[docs[c] for c in columns]).alias("__row")
        docs = find_passages(docs, index, "__found", row).where(F.size("__found") == 0).select("__row.*")
    return docs


def op4(spark, sf_dir: str) -> DataFrame:
    return contaminated_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
