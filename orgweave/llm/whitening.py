"""Whitening of embeddings from an exact integer scatter.

Entries become integers, floor(SCALE * entry) + SHIFT. A first pass subtracts the shift and
accumulates sums and cross-products exactly: integers are cut into balanced digits of 20 bits, so
that a product of float matrices over 4,096 rows is exact, and these are added up as integers of
any size. A task returns one row for each pair of dimensions, its total in limbs of 30 bits; Spark
adds the limbs, so what meets at the driver is one row a pair, by the number of dimensions and
whatever the number of vectors. There n * X'X - SS' is formed exactly and only then converted to
floats and decomposed by eigh. A second pass centres every row as n * x - S in integers, sums its
squares exactly, and projects it; the covariance of what it returns is measured against the identity.

Defined cases: vectors that are null or empty, hold null, NaN or infinite entries, or differ in
length from the most frequent length (ties: the longer) are dropped; entries beyond 2^62 / SCALE
count as that bound; repeated rows and null ids count as rows of their own; components without
variance (under 1e-12 of the largest eigenvalue) are left out, so equal vectors give no rows;
an empty table gives none. The kept columns come back in the struct `row`. More than
MAX_DIMENSIONS dimensions are refused, as the scatter of that many no longer fits a driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from orgweave.llm.common import materialise, read
from orgweave.sources.shared import Scratch

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
MAX_DIMENSIONS = 2048
ROWS = 4096
_DIGIT = 20
_LIMB, _LIMBS = 30, 7
_LARGEST = 2.0**62
_FLAT = 1e-12
_SUMS = "length int, i int, j int, " + ", ".join(f"l{k} long" for k in range(_LIMBS))


def vectors(column: pa.Array, rows: int = ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of their entries) for the sound vectors of a list column, a bounded number of rows of one length at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    offsets = np.asarray(column.offsets, np.int64)
    flat = column.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    unsound = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    starts, ends = offsets[:-1], offsets[1:]
    lengths = np.where(np.asarray(column.is_valid()) & (unsound[ends] == unsound[starts]), ends - starts, 0)
    for length in np.unique(lengths[lengths > 0]):
        found = np.flatnonzero(lengths == length)
        for k in range(0, len(found), rows):
            some = found[k : k + rows]
            yield some, flat[starts[some][:, None] + np.arange(length)]


def integers(matrix: np.ndarray) -> np.ndarray:
    """The integers without their shift."""
    return np.clip(np.floor(matrix * SCALE), -_LARGEST, _LARGEST).astype(np.int64)


def digits(y: np.ndarray) -> list[np.ndarray]:
    """Balanced digits of 20 bits, the lowest first, as floats; y is their sum, each shifted by its place."""
    out, half = [], 1 << (_DIGIT - 1)
    while not out or y.any():
        low = ((y + half) & ((1 << _DIGIT) - 1)) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> _DIGIT
    return out


class Scatter:
    """Exact cross-products of rows led by a one: their number, sums and products in one matrix."""

    def __init__(self, length: int) -> None:
        self.places: dict[int, np.ndarray] = {}  # place -> integers under 2^62
        self.total = np.zeros((length + 1, length + 1), object)
        self.pending = 0

    def add(self, y: np.ndarray) -> None:
        parts = digits(np.column_stack([np.ones(len(y), np.int64), y]))
        for a, x in enumerate(parts):
            for b, z in enumerate(parts):
                product = (x.T @ z).astype(np.int64)  # under 2^50, so exact
                self.places[a + b] = self.places[a + b] + product if a + b in self.places else product
        self.pending += 1
        if self.pending == 512:
            self.fold()

    def fold(self) -> np.ndarray:
        for place, sums in self.places.items():
            self.total = self.total + sums.astype(object) * (1 << (_DIGIT * place))
        self.places, self.pending = {}, 0
        return self.total


def limbs(total: int) -> list[int]:
    """Limbs of 30 bits, the lowest first, all of the total's sign."""
    sign, rest = (-1 if total < 0 else 1), abs(total)
    return [sign * (rest >> (_LIMB * k) & ((1 << _LIMB) - 1)) for k in range(_LIMBS)]


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, Scatter] = {}
    for batch in batches:
        for _, matrix in vectors(batch.column("vector")):
            length = matrix.shape[1]
            found.setdefault(length, Scatter(length)).add(integers(matrix))
    for length, scatter in found.items():
        total = scatter.fold()
        i, j = np.triu_indices(length + 1)
        parts = np.array([limbs(t) for t in total[i, j]], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), length, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(parts[:, k]) for k in range(_LIMBS))], names=_names(_SUMS))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


class Fit:
    """What all rows together say: n, the sums S, unit eigenvectors by falling eigenvalue, eigenvalues and their shares."""

    def __init__(self, n: int, sums: list[int], products: np.ndarray, components: int) -> None:
        d = len(sums)
        self.n, self.sums = n, sums
        s = np.array(sums, object)
        scatter = products * n - s[:, None] * s[None, :]
        trace = sum(scatter[k, k] for k in range(d)) / n**2
        covariance = np.array([[scatter[i, j] / n**2 for j in range(d)] for i in range(d)], np.float64)
        values, basis = np.linalg.eigh(covariance)
        order = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > _FLAT * max(values.max(), 0)]
        self.values, self.basis = values[order], basis[:, order]
        self.basis = self.basis * np.where(self.basis[np.abs(self.basis).argmax(0), range(len(order))] < 0, -1, 1) if order else self.basis
        self.explained = [float(e / trace) for e in self.values]


def fit(table: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Fit | None:
    """The fit over all sound vectors of the most frequent length; None if there is none."""
    partial = table.select(F.col(vector_col).alias("vector")).mapInArrow(_partial_sums, _SUMS)
    with Scratch(table.sparkSession) as scratch:
        sums = scratch.written(partial.groupBy("length", "i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(_LIMBS)]), "scatter")
        # the number of rows is the first cell; a length's rows never exceed 2^62
        count = sum((F.col(f"l{k}") * (1 << (_LIMB * k)) for k in (1, 2)), F.col("l0"))
        commonest = sums.where("i = 0 and j = 0").orderBy(count.desc(), F.col("length").desc()).first()
        if commonest is None:
            return None
        length = commonest.length
        if length > MAX_DIMENSIONS:
            raise ValueError(f"vectors of {length} entries; at most {MAX_DIMENSIONS} are decomposed")
        cells = sums.where(F.col("length") == length).toArrow()
    i, j = (cells.column(c).to_numpy() for c in "ij")
    total = sum(cells.column(f"l{k}").to_numpy().astype(object) * (1 << (_LIMB * k)) for k in range(_LIMBS))
    matrix = np.zeros((length + 1, length + 1), object)
    matrix[i, j] = matrix[j, i] = total
    return Fit(int(matrix[0, 0]), [int(x) for x in matrix[0, 1:]], matrix[1:, 1:], components)


def centred(y: np.ndarray, n: int, sums: list[int]) -> tuple[list[str], np.ndarray]:
    """Per row the exact sum of (n * y - S)^2, as digits, and (n * y - S) / n as floats."""
    largest = n * int(np.abs(y).max()) + max(abs(s) for s in sums)
    if len(sums) * largest**2 < 2**63:
        away = y * n - np.array(sums, np.int64)
        return [str(x) for x in (away * away).sum(1)], away / n
    away = y.astype(object) * n - np.array(sums, object)
    return [str(sum(x * x for x in row)) for row in away], (away / n).astype(np.float64)


def whitened(table: DataFrame, model: Fit, *keep: str, vector_col: str = "embedding") -> DataFrame:
    """row (the columns `keep`), deviation (digits of the exact sum of (n * x - S)^2) and the whitened components."""
    n, sums, project = model.n, model.sums, model.basis / np.sqrt(model.values)
    source = table.select(F.struct(*[table[c] for c in keep]).alias("row"), F.col(vector_col).alias("vector"))
    schema = StructType([source.schema["row"], StructField("deviation", StringType()), StructField("whitened", ArrayType(DoubleType()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in vectors(batch.column("vector")):
                if matrix.shape[1] != len(sums):
                    continue
                deviation, away = centred(integers(matrix), n, sums)
                found = away @ project
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(rows)), pa.array(deviation), lists], names=["row", "deviation", "whitened"])

    return source.mapInArrow(apply, schema)


def identity_error(rows: DataFrame, components: int) -> float:
    """The largest absolute entry of the covariance of `whitened` minus the identity; Spark centres before it multiplies."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    found = rows.select(*[F.covar_pop(F.get("whitened", F.lit(i)), F.get("whitened", F.lit(j))) for i, j in pairs]).first()
    return float(max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True)))


def whiten(table: DataFrame, *keep: str, vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per sound row and component: row, component, n, deviation, whitened, explained and identity_error."""
    model = fit(table, vector_col, components)
    shape = F.col("row"), F.col("component")
    if model is None or not len(model.values):
        none = table.select(F.struct(*[table[c] for c in keep]).alias("row"), F.lit(0).alias("component"), F.lit("").alias("deviation"), F.lit(0.0).alias("whitened")).where(F.lit(False))
        return none.select(*shape, F.lit(0).cast("long").alias("n"), "deviation", "whitened", F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    rows = materialise(whitened(table, model, *keep, vector_col=vector_col), "whitened")
    error = identity_error(rows, len(model.values))
    long = rows.select("row", "deviation", F.posexplode("whitened").alias("pos", "whitened")).withColumn("component", F.col("pos") + 1)
    explained = F.get(F.array(*[F.lit(e) for e in model.explained]), F.col("pos"))
    return long.select(*shape, F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op12(spark, sf_dir: str) -> DataFrame:
    """The deviation is null where it is beyond a long; `deviation_digits` has it whatever its size."""
    found = whiten(read(spark, sf_dir, "embeddings"), "vec_id")
    return found.select("row.vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_digits"))
