"""Snapshots of cache entries: canonical JSON, a hash tree whose depth follows the number of entries, and their comparison.

An entry's place in the tree is given by the hash of its marker, sixteen branches a level, so leaves
stay near WIDTH entries at any size and a change touches one branch. Comparing two recorded
snapshots goes down from the root, and reads of each level only the children of nodes that differ,
and of the entries only those of leaves that differ.

Defined cases: null values are JSON null; values that are no JSON count as strings; of several entries with
one marker the last by `order` stays; keys that name secrets are left out of values; an empty table has a root of no
entries.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from orgweave.operators.records import last_wins
from orgweave.sources.shared import Scratch, written

FORMAT_VERSION = 1
WIDTH = 256
MARKER = ("store", "namespace", "key", "schema_version")
#: Entries, in bytes, up to which the hash of the whole canonical list is made in one task.
SMALL_BYTES = 1 << 24
# Keys never recorded.
SECRETS = ("api_key", "apikey", "access_token", "authorization", "password", "_secret")
_MAX_DEPTH = 12


@F.pandas_udf(StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """JSON with sorted keys and no spaces, without keys that name secrets."""

    def safe(x):
        if isinstance(x, dict):
            return {k: safe(v) for k, v in x.items() if k.casefold() not in SECRETS}
        return [safe(v) for v in x] if isinstance(x, list) else x

    def one(x: str | None) -> str:
        try:
            value = None if x is None else json.loads(x)
        except ValueError:
            value = x
        return json.dumps(safe(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    return values.map(one)


def _quoted(c: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def entries(rows: DataFrame, order: str) -> DataFrame:
    """store, namespace, key, schema_version, value, entry (canonical JSON), marker (its place) and sha256, one row a marker.

    rows: the marker, value (JSON text) and `order`.
    """
    known = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in MARKER[:3]], F.coalesce(F.col("schema_version").cast("long"), F.lit(0)).alias("schema_version"), "value", F.col(order).alias("__order"))
    last = last_wins(known, list(MARKER), [F.col("__order")]).drop("__order").withColumn("value", canonical_json("value"))
    text = F.concat(
        F.lit('{"key":'), _quoted(F.col("key")), F.lit(',"namespace":'), _quoted(F.col("namespace")), F.lit(',"schema_version":'), F.col("schema_version").cast("string"),
        F.lit(',"store":'), _quoted(F.col("store")), F.lit(',"value":'), F.col("value"), F.lit("}"),
    )
    place = F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in MARKER]), 256)
    return last.withColumns({"entry": text, "marker": place}).withColumn("sha256", F.sha2("entry", 256))


def depth_of(count: int, width: int = WIDTH) -> int:
    """Levels below the root, so that a leaf holds about `width` entries."""
    depth = 0
    while depth < _MAX_DEPTH and width * 16**depth < count:
        depth += 1
    return depth


def tree(known: DataFrame, count: int, width: int = WIDTH) -> DataFrame:
    """path (hash digits; the root's is empty), level, n and sha256 of every node.

    A leaf's hash is that of its entries' hashes in order of their places, a node's that of its children's in order.
    """
    depth = depth_of(count, width)
    joined = lambda of: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(of, "sha256"))), lambda x: x["sha256"]), "\n"), 256)
    nodes = known.groupBy(F.substring("marker", 1, depth).alias("path")).agg(F.count(F.lit(1)).alias("n"), joined("marker").alias("sha256"))
    levels = [nodes.withColumn("level", F.lit(depth))]
    for level in range(depth - 1, -1, -1):
        nodes = nodes.groupBy(F.substring("path", 1, level).alias("up")).agg(F.sum("n").alias("n"), joined("path").alias("sha256")).withColumnRenamed("up", "path")
        levels.append(nodes.withColumn("level", F.lit(level)))
    out = levels[0].select("path", "level", "n", "sha256")
    for x in levels[1:]:
        out = out.unionByName(x.select("path", "level", "n", "sha256"))
    return out


def entries_sha256(known: DataFrame) -> str | None:
    """The hash of the whole canonical list in the order of the markers; None beyond SMALL_BYTES."""
    size = known.agg(F.sum(F.octet_length("entry"))).first()[0] or 0
    if size > SMALL_BYTES:
        return None
    listed = known.agg(F.transform(F.array_sort(F.collect_list(F.struct(*MARKER, "entry"))), lambda x: x["entry"]).alias("e"))
    return listed.select(F.sha2(F.concat(F.lit("["), F.array_join("e", ","), F.lit("]")), 256)).first()[0]


class Snapshot:
    """A recorded snapshot: entries (partitioned by the first digit of their place), nodes (by level) and the manifest's numbers."""

    def __init__(self, entries: DataFrame, nodes: DataFrame, count: int, sha256: str | None) -> None:
        self.entries, self.nodes, self.count, self.sha256 = entries, nodes, count, sha256

    @property
    def root(self) -> str:
        found = self.nodes.where("level = 0").first()
        return found.sha256 if found else ""


def record(rows: DataFrame, order: str, width: int = WIDTH) -> Snapshot:
    known = entries(rows, order).withColumn("branch", F.substring("marker", 1, 1)).repartition("branch")
    known = written(known, "snapshot-entries", by=("branch",))
    count = known.count()
    nodes = written(tree(known, count, width), "snapshot-nodes")
    return Snapshot(known, nodes, count, entries_sha256(known))


def verify(snapshot: Snapshot, count: int, root: str) -> None:
    """Raises ValueError if a snapshot isn't the one that a manifest names."""
    if snapshot.count != count:
        raise ValueError(f"the snapshot has {snapshot.count} entries, its manifest {count}")
    if snapshot.root != root:
        raise ValueError("the snapshot's integrity check failed")


def differing_leaves(a: Snapshot, b: Snapshot) -> DataFrame:
    """path of the branches in which two snapshots differ, as deep as both trees go; each level reads only below nodes that differ."""
    spark = a.nodes.sparkSession
    with Scratch(spark) as scratch:
        open_ = spark.createDataFrame([("",)], "path string")
        level = 0
        while True:
            side = lambda s, h: s.nodes.where(F.col("level") == level).select("path", F.col("sha256").alias(h))  # noqa: B023, E731
            of = lambda d, h: d.join(open_.select(F.col("path").alias("up")), F.substring("path", 1, max(level - 1, 0)) == F.col("up"), "left_semi").select("path", h)  # noqa: B023, E731
            mine, other = side(a, "x"), side(b, "y")
            if level and (mine.isEmpty() or other.isEmpty()):
                break
            open_ = scratch.written(of(mine, "x").join(of(other, "y"), "path", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("path"), f"open-{level}")
            if open_.isEmpty():
                break
            level += 1
        return written(open_, "differing")


def changes(a: Snapshot, b: Snapshot) -> DataFrame:
    """The marker and what happened to it from a to b: added, removed or changed."""
    leaves = differing_leaves(a, b)
    first = leaves.first()
    depth = len(first.path) if first else 0
    branches = [r.branch for r in leaves.select(F.substring("path", 1, 1).alias("branch")).distinct().collect()]  # sixteen at most
    own = lambda s: s.entries.where(F.col("branch").isin(*branches)) if depth else s.entries
    inside = lambda s, h: own(s).join(leaves, F.substring("marker", 1, depth) == F.col("path"), "left_semi").select(*MARKER, F.col("sha256").alias(h))
    met = inside(a, "x").join(inside(b, "y"), list(MARKER), "full").where(~F.col("x").eqNullSafe(F.col("y")))
    return met.select(*MARKER, F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("changed").alias("change"))
