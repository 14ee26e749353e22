"""Every pair of two tables' names under equal keys, with its fuzzy ratios.

The rows grow with the product of the tables, so what meets in a task is a block of one table's
names with a block of the other's, of bounded size whatever a key holds. A block's names are
neighbours in order, so that they share their starts. A name is compared once however many rows
have it; rows are made of bounded lists at the end.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.functions import fuzzy
from orgweave.sources.shared import spread, written

#: Names of a block, about, on the left and on the right.
LEFT, RIGHT = 1024, 4096
#: Pairs of blocks in a task, about.
BLOCKS_A_TASK = 16
#: Rows made of one row of lists, and right ones among them, at most: Spark holds these rows together.
LISTED, WIDE = 1 << 16, 4096
_NUMBERS = ("ratio", "partial", "token_set")
_PLACED = "array<struct<name string, at int>>"
_SCHEMA = f"left {_PLACED}, right {_PLACED}, width int, " + ", ".join(f"{c} array<double>" for c in _NUMBERS)


def _blocks(names: DataFrame, side: str, size: int) -> DataFrame:
    """key, the block's number and a list of names, each with its number of rows."""
    once = written(names.where("key is not null and name is not null").groupBy("key", "name").agg(F.count(F.lit(1)).alias("rows")), f"{side}-names")
    dealt = once.repartitionByRange(max(1, math.ceil(once.count() / size)), "key", "name").withColumn(f"{side}_block", F.spark_partition_id())
    return written(dealt.groupBy("key", f"{side}_block").agg(F.collect_list(F.struct("name", "rows")).alias(side)), f"{side}-blocks")


def _repeated(rows: np.ndarray, size: int):
    """Places, each as often as it has rows, `size` at a time."""
    ends = np.cumsum(rows)
    for k in range(0, int(ends[-1]), size):
        yield np.searchsorted(ends, np.arange(k, min(k + size, ends[-1])), side="right")


def _compared(batches):
    """A row for some left rows with some right ones: their names, each with its place in the matrices of numbers."""
    listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    placed = lambda names, at: listed(pa.StructArray.from_arrays([names.take(pa.array(at)), pa.array((at - at[0]).astype(np.int32))], ["name", "at"]))
    for batch in batches:
        for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
            (a, a_rows), (b, b_rows) = left.values.flatten(), right.values.flatten()
            a_rows, b_rows = a_rows.to_numpy(), b_rows.to_numpy()
            for i, j, *numbers in fuzzy.grids(a.to_pylist(), b.to_pylist()):
                wide = min(WIDE, int(b_rows[j].sum()))
                for r in _repeated(b_rows[j], wide):
                    b_list, columns = placed(b.take(pa.array(j)), r), slice(r[0], r[-1] + 1)
                    for l in _repeated(a_rows[i], max(1, LISTED // wide)):  # noqa: E741
                        lists = [listed(pa.array(x[l[0] : l[-1] + 1, columns].ravel())) for x in numbers]
                        width = pa.array([columns.stop - columns.start], pa.int32())
                        yield pa.RecordBatch.from_arrays([placed(a.take(pa.array(i)), l), b_list, width, *lists], ["left", "right", "width", *_NUMBERS])


def fuzzy_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """left and right: key, name. l_name, r_name, ratio, partial and token_set, a row for each pair of rows with one key; null names and keys have none."""
    a, b = _blocks(left, "left", LEFT), _blocks(right, "right", RIGHT)
    tasks = math.ceil(a.select("key").join(b.select("key"), "key").count() / BLOCKS_A_TASK)
    found = spread(a.join(b, "key"), "key", "left_block", "right_block", least=tasks).select("left", "right").mapInArrow(_compared, _SCHEMA)
    each = found.select(F.explode("left").alias("l"), "right", "width", *_NUMBERS).select("l", F.explode("right").alias("r"), "width", *_NUMBERS)
    at = F.col("l.at") * F.col("width") + F.col("r.at")
    return each.select(F.col("l.name").alias("l_name"), F.col("r.name").alias("r_name"), *[F.get(c, at).alias(c) for c in _NUMBERS])
