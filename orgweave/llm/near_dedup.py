"""Near-duplicate documents: banded MinHash, odd sketches, exact confirmation, components.

A document's set is its distinct shingles of SHINGLE words (A-Z lower-cased). Documents with
equal sets are one node. MinHash samples of a node's set make bands of ROWS samples; their
number is chosen so that two sets at the threshold share no band with a chance of MISS at
most. Nodes that share a band with another one get an odd sketch as well: SAMPLES further
MinHash samples folded into a parity bitmap of SKETCH_BITS bits. The population count of two
sketches' XOR tells the number of differing samples; pairs whose count is more than the
threshold allows, with a margin of MARGIN standard deviations, are dropped before the sets are
compared.

Links are found in up to STARS turns and a full search. In a turn each node is held against one
node only: of the first nodes of its buckets (a band's values) the one with the most company in
its buckets, as an original has more in common with its variants than these have among
themselves. So n variants make n pairs. Confirmed links give components, and buckets of one
component are done. What is left is searched completely, but for pairs that are in one component
already: buckets of up to SMALL nodes as pairs of rows, larger ones in blocks of BLOCK nodes
whose pairs go to tasks of their own and leave them only if their sketches allow, so that no
task or row holds a bucket. Every pair that passes its sketch is confirmed on the full sets.

Bands, sketches and sets are written once, in scratch tables that are deleted when the result is
written; shuffles carry ids and sketches, and sets only of pairs to be confirmed.

Defined cases: null and empty texts have an empty set and are linked with nothing; fewer than
SHINGLE words are one shingle; rows with a null doc_id have no result row, as in the SQL, and
`drop_near_duplicates` keeps them without a comparison; repeated rows are in one component, all
with kept = (doc_id = component_id); extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.llm.common import LOWER, empty_caches, mix, read, span_hashes, text_slices, word_spans
from orgweave.operators.graph import components
from orgweave.sources.shared import Scratch, written

SHINGLE = 5
PERCENT = 85
ROWS = 8
MISS = 1e-5
SAMPLES = 4096
SKETCH_BITS = 4096
MARGIN = 4.0
STARS = 2
SMALL = 4
#: Tables of up to so many narrow rows (ids or pairs of ids) are broadcast; larger ones are joined by a shuffle.
MAX_BROADCAST_ROWS = 1 << 20
BLOCK = 2048
#: Rows whose samples are made at once, which bounds a task's memory whatever the texts' lengths.
_AT_ONCE = 512
_RNG = np.random.default_rng(5)
_FACTORS = _RNG.integers(0, 2**64, SHINGLE, dtype=np.uint64) | np.uint64(1)


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def max_bits(percent: int) -> int:
    """The largest XOR population count that a pair at the threshold should have."""
    t = percent / 100
    low = t - MARGIN * math.sqrt(t * (1 - t) / SAMPLES)
    bits = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * SAMPLES * (1 - low)))
    return math.ceil(bits + math.sqrt(SKETCH_BITS) / 2)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, ordered by both."""
    low = LOWER[data]
    start, end, row = word_spans(low, offsets)
    h = span_hashes(low, start, end)
    n = max(0, len(h) - SHINGLE + 1)
    total = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        total += h[i : i + n] * _FACTORS[i]
    full = row[:n] == row[SHINGLE - 1 :] if n else np.zeros(0, bool)
    shingles, rows = mix(total[full]), row[:n][full]
    # texts of fewer words: the whole sequence
    count = np.bincount(row, minlength=len(offsets) - 1)
    short = (count < SHINGLE)[row]
    if short.any():
        first = np.cumsum(count) - count
        place = np.arange(len(row)) - first[row]
        part = h[short] * _FACTORS[place[short]]
        own = np.flatnonzero((count > 0) & (count < SHINGLE))
        begin = np.searchsorted(row[short], own)
        shingles = np.concatenate([shingles, mix(np.add.reduceat(part, begin) + count[own].astype(np.uint64))])
        rows = np.concatenate([rows, own])
    order = np.lexsort((shingles, rows))
    rows, shingles = rows[order], shingles[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (shingles[1:] != shingles[:-1])
    return rows[fresh], shingles[fresh]


def minima(rows: np.ndarray, shingles: np.ndarray, samples: int, seed: int):
    """(rows with a set, their least hashes by sample), in runs of rows."""
    rng = np.random.default_rng(seed)
    flip = rng.integers(0, 2**32, samples, dtype=np.uint32)
    times = rng.integers(0, 2**32, samples, dtype=np.uint32) | np.uint32(1)
    own, begin = np.unique(rows, return_index=True)
    cuts = np.append(begin, len(rows))
    for i in range(0, len(own), _AT_ONCE):
        part = slice(i, min(i + _AT_ONCE, len(own)))
        low = (shingles[cuts[i] : cuts[part.stop]] >> np.uint64(32)).astype(np.uint32)
        value, least = np.empty_like(low), np.empty((samples, part.stop - i), np.uint32)
        for j in range(samples):
            np.bitwise_xor(low, flip[j], out=value)
            np.multiply(value, times[j], out=value)
            np.minimum.reduceat(value, begin[part] - cuts[i], out=least[j])
        yield own[part], least


def band_values(least: np.ndarray, bands: int) -> np.ndarray:
    values = np.empty((least.shape[1], bands), np.uint64)
    for b in range(bands):
        total = np.full(least.shape[1], b + 1, np.uint64)
        for j in range(b * ROWS, (b + 1) * ROWS):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + least[j])
        values[:, b] = total
    return values


def odd_sketches(least: np.ndarray) -> np.ndarray:
    """A bitmap for each column: bit i is the parity of the samples that fall on it."""
    samples, n = least.shape
    odd = np.zeros((n, SKETCH_BITS), np.uint8)
    for j in range(0, samples, 256):
        number = np.arange(j, min(j + 256, samples), dtype=np.uint64) << np.uint64(32)
        place = (mix(number[:, None] + least[j : j + 256]) % np.uint64(SKETCH_BITS)).astype(np.int64) + np.arange(n) * SKETCH_BITS
        odd ^= (np.bincount(place.ravel(), minlength=n * SKETCH_BITS) & 1).astype(np.uint8).reshape(odd.shape)
    return np.packbits(odd, axis=1)


def _sets(batch: pa.RecordBatch):
    """(ids, row and shingle columns, number of rows) of runs of a batch's texts."""
    ids = batch.column("doc_id")
    for first, end, data, offsets in text_slices(batch.column("text")):
        yield ids.slice(first, end - first), *shingle_sets(data, offsets), end - first


def _set_keys(rows: np.ndarray, shingles: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each row's set; 0 for an empty one."""
    own, begin = np.unique(rows, return_index=True)
    keys = [np.zeros(size, np.uint64), np.zeros(size, np.uint64)]
    if len(own):
        for s, key in enumerate(keys, 1):
            key[own] = np.add.reduceat(mix(shingles + np.uint64(s)), begin)
    return keys[0].view(np.int64), keys[1].view(np.int64)


def signatures(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, two keys of the set and band values of every row with a doc_id."""
    bands = bands_for(percent)

    def run(batches):
        empty_caches()
        for batch in batches:
            for ids, rows, shingles, size in _sets(batch):
                hi, lo = _set_keys(rows, shingles, size)
                values = np.zeros((size, bands), np.uint64)
                for own, least in minima(rows, shingles, bands * ROWS, 11):
                    values[own] = band_values(least, bands)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, bands, dtype=np.int32)), pa.array(values.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.bincount(rows, minlength=size)), pa.array(hi), pa.array(lo), listed], names=["doc_id", "n", "hi", "lo", "bands"])

    return _texts(docs).mapInArrow(run, "doc_id long, n long, hi long, lo long, bands array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")


def _bounded(df: DataFrame) -> DataFrame:
    """df, a table already written, to be broadcast if it is small and joined by a shuffle if not."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df.hint("merge")


def _details(docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of the nodes named: node, n, odd sketch, band marks (32 bits of each band's value) and full set, as sorted 64-bit hashes."""
    bands = bands_for(percent)

    def run(batches):
        empty_caches()
        for batch in batches:
            for ids, rows, shingles, size in _sets(batch):
                cuts = np.searchsorted(rows, np.arange(size + 1))
                sets = pa.array([shingles[cuts[i] : cuts[i + 1]].tobytes() for i in range(size)], pa.binary())
                marks, bits = np.zeros((size, bands), np.uint32), np.zeros((size, SKETCH_BITS // 8), np.uint8)
                for own, least in minima(rows, shingles, bands * ROWS, 11):
                    marks[own] = band_values(least, bands).astype(np.uint32)
                for own, least in minima(rows, shingles, SAMPLES, 12):
                    bits[own] = odd_sketches(least)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.bincount(rows, minlength=size)), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array([x.tobytes() for x in marks], pa.binary()), sets],
                    names=["node", "n", "sketch", "marks", "set"],
                )

    own = _texts(docs).join(_bounded(nodes.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi")
    return own.mapInArrow(run, "node long, n long, sketch binary, marks binary, set binary")


def _close(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and odd sketches (rows of 64-bit words) of pairs allow the threshold."""
    sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return sizes & (np.bitwise_count(a ^ b).sum(1) <= max_bits(percent))


def _words(column: pa.Array, kind=np.uint64) -> np.ndarray:
    """Rows of equally long binaries as an array."""
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1) if n else np.zeros((0, 1), kind)


def _plausible(pairs: DataFrame, details: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the threshold."""
    side = lambda x: details.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n = [batch.column(c).to_numpy() for c in ("n_a", "n_b")]
                mask = pa.array(_close(_words(batch.column("s_a")), _words(batch.column("s_b")), *n, percent))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, details: DataFrame, percent: int) -> DataFrame:
    """Pairs, a table already written, whose full sets reach the threshold."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(p) + len(q) - len(np.union1d(p, q))
                good.append(shared > 0 and 100 * shared >= percent * (len(p) + len(q) - shared))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    side = lambda node, s: details.select(F.col("node").alias(node), F.col("set").alias(s))
    return side("a", "x").join(_bounded(pairs), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _block_pairs(rows: DataFrame, details: DataFrame, percent: int) -> DataFrame:
    """Plausible pairs of different components within large buckets, from pairs of blocks.

    rows: bucket, node, component, size. Each block of a bucket meets each other in a task of its own.
    A pair is given by the first band that it shares; if that one's bucket is small or done, no pair is lost there.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = (
        rows.join(details.select("node", "n", "sketch", "marks"), "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "n", "sketch", "marks")
    )

    def meet(table: pa.Table) -> pa.Table:
        node, component, n, block = (table[c].to_numpy() for c in ("node", "component", "n", "block"))
        i, j, own = table["i"][0].as_py(), table["j"][0].as_py(), np.int64(table["bucket"][0].as_py()).astype(np.uint32)
        bits, marks = _words(table["sketch"]), _words(table["marks"], np.uint32)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in left:
            against = right[right > k] if i == j else right
            against = against[component[against] != component[k]]
            against = against[_close(bits[against], bits[k], n[against], n[k], percent)]
            if len(against):
                same = marks[against] == marks[k]
                against = against[marks[k][same.argmax(1)] == own]
            a.append(np.full(len(against), node[k]))
            b.append(node[against])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(meet, "a long, b long")


def _star_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Each node with one other: of its buckets' first nodes, if they are of another component, the first one.

    First comes who has the most company in its buckets; later turns weigh that company by chance, so that others come first.
    """
    company = rows.groupBy("node").agg(F.sum(F.col("size") - 1).alias("w"))
    if turn:
        company = company.withColumn("w", (F.col("w") * (F.pmod(F.xxhash64("node", F.lit(turn)), 1000) + 1)).cast("long"))
    placed = rows.join(company, "node")
    firsts = placed.groupBy("bucket").agg(F.max(F.struct("w", F.xxhash64("node").alias("h"), F.col("node").alias("end"), F.col("component").alias("c"))).alias("f"))
    met = placed.join(firsts, "bucket").where("component <> f.c").groupBy("node").agg(F.max("f").alias("f"))
    return met.select(F.greatest("node", "f.end").alias("a"), F.least("node", "f.end").alias("b")).distinct()


def _rest_pairs(rows: DataFrame, details: DataFrame, percent: int) -> DataFrame:
    """All plausible pairs of different components in the buckets."""
    few = rows.where(F.col("size") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("node", "component"))).alias("m"))
    pair = lambda i, j: F.struct(F.get("m", F.lit(j))["node"].alias("a"), F.get("m", F.lit(i))["node"].alias("b"), (F.get("m", F.lit(i))["component"] != F.get("m", F.lit(j))["component"]).alias("apart"))
    each = F.filter(F.array(*[pair(i, j) for j in range(1, SMALL) for i in range(j)]), lambda p: p["apart"])
    near = few.select(F.explode(each).alias("p")).select("p.a", "p.b").distinct()
    far = _block_pairs(rows.where(F.col("size") > SMALL), details, percent)
    return _plausible(near, details, percent).unionByName(far).distinct()


def _shared_buckets(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, node, size) of the buckets that hold two nodes or more."""
    buckets = nodes.select(F.explode("bands").alias("bucket"), "node")
    ends = buckets.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("size"))
    shared = scratch.written(ends.where("size > 1"), "shared-buckets")
    twos = shared.where("size = 2").select("bucket", F.explode(F.array("low", "high")).alias("node"), "size")
    larger = shared.where("size > 2").select("bucket", "size")
    return scratch.written(twos.unionByName(buckets.join(_bounded(larger), "bucket").select("bucket", "node", "size")), "buckets")


def _found(docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    signed = scratch.written(signatures(docs, percent), "signatures")
    with_set = signed.where("n > 0")
    # equal sets become one node; the copies are merged before the shuffle
    nodes = scratch.written(with_set.groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "nodes")
    # at first every node is a component
    rows = _shared_buckets(nodes, scratch).withColumn("component", F.col("node"))
    named = scratch.written(rows.select("node").distinct(), "shared-nodes")
    details = scratch.written(_details(docs, named, percent), "details")
    if details.count() > named.count():  # rows repeat an id
        details = scratch.written(details.dropDuplicates(["node", "set"]), "details")

    links: DataFrame | None = None
    parts: DataFrame | None = None
    for turn in range(STARS + 1):
        tried = _rest_pairs(rows, details, percent) if turn == STARS else _plausible(_star_pairs(rows, turn), details, percent)
        found = scratch.written(_confirmed(scratch.written(tried, "pairs"), details, percent), "found")
        if found.isEmpty():
            continue
        links = found if links is None else scratch.written(links.unionByName(found), "links")
        parts = components(links)
        if turn < STARS:
            placed = rows.drop("component").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
            mixed = placed.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("bucket")
            rows = scratch.written(placed.join(mixed, "bucket", "left_semi"), "buckets")

    # the smallest doc_id of a node is the node itself, so the smallest node is the smallest document
    member = with_set.select("doc_id", "hi", "lo", "n").join(nodes.select("hi", "lo", "n", "node"), ["hi", "lo", "n"])
    joined = member.withColumn("component", F.col("node")) if parts is None else member.join(parts, "node", "left")
    joined = joined.select("doc_id", "n", F.coalesce("component", "node").alias("component_id"))
    alone = signed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    both = joined.unionByName(alone)
    return both.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id and kept."""
    with Scratch(docs.sparkSession) as scratch:
        return written(_found(docs, percent, scratch), "near-duplicates")


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs that are the first of their component, with all their columns; rows with a null id stay.

    Rows that repeat an id and a text stay once; ids that occur once, all as a rule, need no shuffle for that.
    """
    found = near_duplicates(docs, percent).select("doc_id", "kept")
    gone = written(found.where("not kept").select(F.col("doc_id").alias("other")).distinct(), "duplicate-ids")
    # rows travel as structs, so that no column's name can meet another
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), docs["text"].alias("text"))
    kept = rows.join(_bounded(gone), F.col("id") == F.col("other"), "left_anti")
    repeated = found.groupBy(F.col("doc_id").alias("other")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("other")
    if not repeated.isEmpty():
        once = kept.join(repeated, F.col("id") == F.col("other"), "left_semi").dropDuplicates(["id", "text"])
        kept = kept.join(repeated, F.col("id") == F.col("other"), "left_anti").unionByName(once)
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op6(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
