"""Indel similarity ratios (0 to 100), as Arrow-batched functions: Spark's levenshtein counts replacements as one edit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each place of a."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio_of(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * _common(a, b) / (len(a) + len(b))


def partial_of(a: str, b: str) -> float:
    """The best ratio of the shorter text with any stretch of the longer one of its length, or a shorter one at the ends."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n = len(short)
    if not n:
        return 100.0 if not long else 0.0
    stretches = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    return max(ratio_of(short, s) for s in stretches)


def token_set_of(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    only = [" ".join(sorted(s)) for s in (x - y, y - x)]
    if both and not all(only):
        return 100.0
    joined = [f"{both} {o}".strip() for o in only]
    best = ratio_of(*joined)
    return max([best, *[ratio_of(both, j) for j in joined]]) if both else best


# Batches: the same numbers for many pairs at once, a word of 64 bits for each; longer texts go one by one.
BITS = 63


def _runs(masks: np.ndarray, full: int):
    """Lengths of the longest common subsequences after each place of the second texts; masks: where each of its letters stands in the first."""
    row = np.full(len(masks), full, np.uint64)
    for j in range(masks.shape[1]):
        hit = row & masks[:, j]
        row = ((row + hit) | (row - hit)) & np.uint64(full)
        yield np.bitwise_count(~row & np.uint64(full)).astype(np.int64)


def _masks(same: np.ndarray) -> np.ndarray:
    packed = np.packbits(same, axis=2, bitorder="little")
    out = np.zeros((*same.shape[:2], 8), np.uint8)
    out[:, :, : packed.shape[2]] = packed
    return out.view("<u8")[:, :, 0]


def _letters(texts: list[str], n: int) -> np.ndarray:
    return np.array(texts, f"<U{n}").view(np.uint32).reshape(len(texts), n)


def _whole(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    for common in _runs(_masks(b[:, :, None] == a[:, None, :]), (1 << a.shape[1]) - 1):
        pass
    return 200.0 * common / (a.shape[1] + b.shape[1])


def _part(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    n, m = short.shape[1], long.shape[1]
    same, full = long[:, :, None] == short[:, None, :], (1 << n) - 1
    masks, best = _masks(same), np.zeros(len(same))
    # stretches at the start and, read backwards, at the end; one run has all their lengths
    for m_ in (masks, _masks(same[:, ::-1, ::-1])):
        for j, common in enumerate(_runs(m_[:, :n], full), 1):
            np.maximum(best, 200.0 * common / (n + j), out=best)
    for i in range(1, m - n):
        for common in _runs(masks[:, i : i + n], full):
            pass
        np.maximum(best, 200.0 * common / (n + n), out=best)
    return best


def _many(one, many, pairs: list[tuple[str, str]], ordered: bool = False) -> np.ndarray:
    """one's numbers for the pairs, by `many` for all pairs of the same lengths. ordered: the shorter text first."""
    if ordered:
        pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    out, sizes = np.zeros(len(pairs)), np.array([(len(a), len(b)) for a, b in pairs], np.int64).reshape(-1, 2)
    alike, of = np.unique(sizes, axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    for (n, m), at in zip(alike.tolist(), np.split(order, np.cumsum(np.bincount(of.ravel()))[:-1]), strict=False):
        if not n or not m or max(n, m) > BITS or len(at) < 4:
            out[at] = [one(*pairs[i]) for i in at]
            continue
        for k in range(0, len(at), 1024):  # few at a time: what is compared stays in the cache
            some = at[k : k + 1024]
            out[some] = many(_letters([pairs[i][0] for i in some], n), _letters([pairs[i][1] for i in some], m))
    return out


def ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    return _many(ratio_of, _whole, pairs)


def partial_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    return _many(partial_of, _part, pairs, ordered=True)


def token_set_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    out, asked, rows = np.zeros(len(pairs)), [], []
    words: dict[str, frozenset] = {}
    for i, (a, b) in enumerate(pairs):
        x, y = (words.get(t) or words.setdefault(t, frozenset(t.split())) for t in (a, b))
        if len(x) == len(y) == 1 and x != y:
            asked.append((*x, *y))
            rows.append(i)
        else:
            out[i] = token_set_of(a, b)
    out[rows] = ratios(asked)
    return out


# Grids: every text of one list against every one of another. A start that several texts share is run once for all of them.
STEP = 1 << 16


def _starts(letters: np.ndarray, kinds: int) -> tuple[list[tuple], np.ndarray]:
    """The different starts of the texts, a letter longer each time: for each the place of its own start (None: as before) and its letter; where each text ends."""
    at, n, out = np.zeros(len(letters), np.int64), 1, []
    for j in range(letters.shape[1]):
        found, at = np.unique(at * kinds + letters[:, j], return_inverse=True)
        code = found % kinds
        out.append((None if len(found) == n else found // kinds, code[:1] if (code == code[0]).all() else code))
        n = len(found)
    return out, at


def _places(letters: np.ndarray, kinds: int) -> np.ndarray:
    """Where each letter stands in each text, a bit for each place; carries beyond the last place are never read."""
    word = np.uint32 if letters.shape[1] < 32 else np.uint64
    out, rows = np.zeros((len(letters), kinds), word), np.arange(len(letters))
    for i in range(letters.shape[1]):
        out[rows, letters[:, i]] |= word(1 << i)
    return out


def _along(places: np.ndarray, starts: list[tuple], n: int, scored: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the common subsequences with the whole texts, and the best ratio of a start of up to `scored` letters."""
    full = places.dtype.type((1 << n) - 1)
    row, best = np.full((len(places), 1), full), np.zeros((len(places), 1))
    for j, (parent, code) in enumerate(starts, 1):
        if parent is not None:
            row = row.take(parent, axis=1)
            best = best.take(parent, axis=1) if scored else best
        hit = row & places.take(code, axis=1)
        rest = row - hit
        row += hit
        row |= rest
        if j <= scored:
            np.maximum(best, 200.0 * np.bitwise_count(~row & full) / (n + j), out=best)
    return np.bitwise_count(~row & full), best


def _grid(short: np.ndarray, long: np.ndarray, kinds: int):
    """(places of the short texts, ratios, partial ratios), some short texts with all long ones at a time; all short texts have one length, all long ones another."""
    n, m = short.shape[1], long.shape[1]
    (ahead, end), (back, first) = _starts(long, kinds), _starts(long[:, ::-1][:, :n], kinds)
    inner = [_starts(long[:, i : i + n], kinds) for i in range(1, m - n)]
    forth, reverse = _places(short, kinds), _places(short[:, ::-1], kinds)
    step = max(1, STEP // len(long))
    for k in range(0, len(short), step):
        some = slice(k, k + step)
        common, part = _along(forth[some], ahead, n, n)
        part = np.maximum(part.take(end, axis=1), _along(reverse[some], back, n, n)[1].take(first, axis=1))
        for starts, at in inner:
            np.maximum(part, (200.0 * _along(forth[some], starts, n)[0] / (n + n)).take(at, axis=1), out=part)
        yield np.arange(len(short))[some], (200.0 * common / (n + m)).take(end, axis=1), part


def grids(a: list[str], b: list[str]):
    """Every text of a with every one of b, bounded parts at a time: places in a, places in b, and matrices of ratios, partial ratios and token set ratios."""
    by_length = lambda texts: {n: np.flatnonzero(sizes == n) for sizes in [np.array([len(t) for t in texts], np.int64)] for n in np.unique(sizes).tolist()}
    whole_word = lambda texts: np.array([t.split() == [t] for t in texts], bool)
    sides, words = (by_length(a), by_length(b)), (whole_word(a), whole_word(b))
    for n, i in sides[0].items():
        for m, j in sides[1].items():
            if not n or not m or max(n, m) > BITS:
                parts = _one_by_one(a, b, i, j)
            else:
                x, y = _letters([a[k] for k in i], n), _letters([b[k] for k in j], m)
                kinds, codes = np.unique(np.concatenate([x.ravel(), y.ravel()]), return_inverse=True)
                x, y = codes[: x.size].reshape(x.shape), codes[x.size :].reshape(y.shape)
                parts = ((i[k], j, whole, part) for k, whole, part in _grid(x, y, len(kinds))) if n <= m else ((i, j[k], whole.T, part.T) for k, whole, part in _grid(y, x, len(kinds)))
            for rows, columns, whole, part in parts:
                sets = whole.copy()  # of two single words the whole ratio
                for r, c in np.argwhere(~(words[0][rows][:, None] & words[1][columns][None, :])):
                    sets[r, c] = token_set_of(a[rows[r]], b[columns[c]])
                yield rows, columns, whole, part, sets


def _one_by_one(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray):
    step = max(1, STEP // len(j))
    for k in range(0, len(i), step):
        some = i[k : k + step]
        pairs = [(a[r], b[c]) for r in some for c in j]
        yield some, j, *(np.array([f(*p) for p in pairs]).reshape(len(some), len(j)) for f in (ratio_of, partial_of))


def _batched(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(f(list(zip(a.fillna(""), b.fillna(""), strict=True))))

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return pandas_udf(run, DoubleType())


ratio, partial_ratio, token_set_ratio = _batched(ratios), _batched(partial_ratios), _batched(token_set_ratios)
