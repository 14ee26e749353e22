"""Elias-Fano sequences and a shard of an n-gram trie made of them, in one memory-mapped block.

All queries are vectorised over numpy arrays. A sequence keeps each value's low bits packed
and its high bits in unary. A shard of the trie has the contexts (pairs of words) whose hashes
fall to it, all their followers, monotone pointers from a context to its followers' range, and
for each node smoothed probabilities as 16-bit codes. A follower's id is its place in the
shard's vocabulary plus the last id of the range before, which makes the ids of the whole level
monotone; it is found by a successor search within its context's range, relative to that id.
"""

from __future__ import annotations

import tempfile

import numpy as np

_POP8 = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_SELECT8 = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    for _nth, _bit in enumerate([b for b in range(8) if _byte >> b & 1]):
        _SELECT8[_byte, _nth] = _bit
#: Codes for a factor of 2, so a value is off by 0.14 % at most; the code of no value.
STEPS = 256
NONE = 0xFFFF


def quantise(values: np.ndarray) -> np.ndarray:
    """16-bit codes of positive numbers: their logarithm's distance from 0, so all are at most 1 or all at least 1."""
    return np.minimum(np.rint(np.abs(np.log2(np.maximum(values, 1e-300))) * STEPS), NONE - 1).astype(np.uint16)


def shares(codes: np.ndarray) -> np.ndarray:
    """The numbers up to 1 that codes stand for; 0 for none."""
    return np.where(codes == NONE, 0.0, np.exp2(codes / -STEPS))


def masses(codes: np.ndarray) -> np.ndarray:
    """The numbers from 1 on that codes stand for; 0 for none."""
    return np.where(codes == NONE, 0.0, np.exp2(codes / STEPS))


class EliasFano:
    """A non-decreasing sequence. arrays: low, high and ranks; bits: low bits of a value."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray) -> None:
        self.n, self.bits, self.low, self.high, self.ranks = n, bits, low, high, ranks

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits + 7) // 8 + 8, np.uint8)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            each = ((part[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            packed = np.packbits(each.ravel(), bitorder="little")
            low[: len(packed)] = packed
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        # a zero behind the last one, for searches up to the end
        size = (int(ones[-1]) + 2 if n else 1) // 64 + 1
        marks = np.zeros(size * 64, np.uint8)
        marks[ones] = 1
        high = np.packbits(marks, bitorder="little")
        ranks = np.cumsum(_POP8[high].reshape(-1, 8).sum(1)).astype(np.uint32)
        return EliasFano(n, bits, low, high, ranks)

    def _select(self, i: np.ndarray, flip: int) -> np.ndarray:
        """Where in the unary part the i-th one stands, or the i-th zero if flip is 255."""
        ranks = self.ranks if not flip else (np.arange(1, len(self.ranks) + 1) * 64 - self.ranks)
        word = np.searchsorted(ranks, i, side="right")
        left = i - np.where(word > 0, ranks[np.maximum(word - 1, 0)].astype(np.int64), 0)
        at = word * 8
        for _ in range(7):
            here = _POP8[self.high[at] ^ flip]
            skip = left >= here
            left -= np.where(skip, here, 0)
            at += skip
            if not skip.any():
                break
        return at * 8 + _SELECT8[self.high[at] ^ flip, left]

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at the places i."""
        i = np.asarray(i, np.int64)
        out = (self._select(i, 0) - i).astype(np.uint64)
        if self.bits:
            start = i * self.bits
            view = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))
            low = (view[start >> 3] >> (start & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)
            out = (out << np.uint64(self.bits)) | low
        return out.astype(np.int64)


    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value; -1 where the sequence, without repeats, has none."""
        values = np.asarray(values, np.int64)
        found = np.full(len(values), -1, np.int64)
        if not self.n:
            return found
        high = values >> self.bits
        inside = np.flatnonzero(high <= int(self[np.array([self.n - 1])][0]) >> self.bits)
        high = high[inside]
        # as many values have a smaller high part as there are ones before the zero that opens it
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), 255) - np.maximum(high - 1, 0), 0)
        end = self._select(high, 255) - high
        place = self.successor(begin, end, values[inside])
        hit = np.flatnonzero(place < end)
        hit = hit[self[place[hit]] == values[inside[hit]]]
        found[inside[hit]] = place[hit]
        return found

    def successor(self, begin: np.ndarray, end: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """The first place from begin on, below end, whose value is the target or more; end if there is none."""
        low, high = begin.copy(), end.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) >> 1
            less = self[middle] < targets[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]


def _arrays(x) -> list[np.ndarray]:
    return [x.low, x.high, x.ranks] if isinstance(x, EliasFano) else [x]


class Trie:
    """A shard: contexts, words and ids and pointers as Elias-Fano sequences, and codes of probabilities.

    share: a follower's discounted share of its context; back: what the context leaves to
    shorter ones; mass: how often the context occurs.
    """

    FIELDS = ("contexts", "words", "pointers", "ids", "share", "back", "mass")

    def __init__(self, **parts) -> None:
        self.parts = parts

    @staticmethod
    def build(contexts: np.ndarray, parent: np.ndarray, words: np.ndarray, counts: np.ndarray, discount: float) -> Trie:
        """contexts: sorted and distinct; parent (place of the context), word and count of each follower, ordered by parent and word."""
        vocabulary, symbol = np.unique(words, return_inverse=True)
        last = np.flatnonzero(np.append(parent[1:] != parent[:-1], True)) if len(parent) else np.zeros(0, np.int64)
        before = np.concatenate([[0], np.cumsum(symbol[last])])
        mass = np.bincount(parent, weights=counts, minlength=len(contexts))
        followers = np.bincount(parent, minlength=len(contexts))
        return Trie(
            contexts=EliasFano.build(contexts),
            words=EliasFano.build(vocabulary),
            pointers=EliasFano.build(np.concatenate([[0], np.cumsum(followers)])),
            ids=EliasFano.build(symbol + before[parent]),
            share=quantise((counts - discount) / mass[parent]),
            back=quantise(discount * followers / mass),
            mass=quantise(mass),
        )

    def look_up(self, contexts: np.ndarray, parent: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes (share, back, mass) of words after contexts; NONE where the trie has no node.

        contexts: distinct ones; parent: for each word the place of its context among them.
        """
        p, n = self.parts, len(words)
        share, back, mass = (np.full(n, NONE, np.uint16) for _ in range(3))
        node = p["contexts"].find(contexts)[parent]
        known = np.flatnonzero(node >= 0)
        back[known], mass[known] = p["back"][node[known]], p["mass"][node[known]]
        distinct, place = np.unique(words, return_inverse=True)
        symbol = p["words"].find(distinct)[place][known]
        known, symbol = known[symbol >= 0], symbol[symbol >= 0]
        if not len(known):
            return share, back, mass
        own, at = np.unique(node[known], return_inverse=True)
        ends = p["pointers"][own + 1]
        begins = p["pointers"][own]
        before = np.where(begins > 0, p["ids"][np.maximum(begins - 1, 0)], 0)
        begin, end, target = begins[at], ends[at], before[at] + symbol
        place = p["ids"].successor(begin, end, target)
        hit = np.flatnonzero(place < end)
        hit = hit[p["ids"][place[hit]] == target[hit]]
        share[known[hit]] = p["share"][place[hit]]
        return share, back, mass

    def mapped(self) -> Trie:
        """The same over one memory-mapped block. Its file has no name, lies in the task's own temporary folder and goes with it."""
        arrays = [x for f in self.FIELDS for x in _arrays(self.parts[f])]
        with tempfile.TemporaryFile() as file:
            for x in arrays:
                file.write(np.ascontiguousarray(x).tobytes() + b"\0" * (-x.nbytes % 8))
            file.write(b"\0" * 8)
            file.flush()
            data = np.memmap(file, np.uint8, "r")
        views, at = [], 0
        for x in arrays:
            views.append(np.frombuffer(data, x.dtype, len(x), at))
            at += x.nbytes + -x.nbytes % 8
        parts, views = {}, iter(views)
        for f in self.FIELDS:
            x = self.parts[f]
            parts[f] = EliasFano(x.n, x.bits, next(views), next(views), next(views)) if isinstance(x, EliasFano) else next(views)
        return Trie(**parts)
