"""Relationship edges and families of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.sources.shared import Scratch, written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of edges(a, b): the smallest node that can be reached, by alternating large and small stars.

    Each round ties every node's neighbours to the smallest one it knows of. Nothing is
    collected per node: minima are pre-aggregated, and joins may be split where a node has
    very many edges. Null ends are ignored, a loop makes its node known; an empty table gives an
    empty result. The rounds' tables are deleted at the end.
    """
    known = edges.select("a", "b").where("a is not null and b is not null")
    with Scratch(edges.sparkSession) as scratch:
        tied = scratch.written(known.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        for _ in range(max_rounds):
            both = tied.unionByName(tied.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
            large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            # every edge now points from a node to a smaller one
            least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
            met = large.join(least, F.col("u") == F.col("k"))
            small = met.select("v", "m").union(met.select("u", "m")).toDF("u", "v")
            tied = scratch.written(small.where("u <> v").distinct(), "edges")
            # settled: each node has one edge and no end of an edge has an edge of its own
            out = tied.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into"))
            into = tied.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into"))
            open_ends = out.union(into).groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out > 0 and into > 0)")
            if open_ends.isEmpty():
                break
        else:
            raise RuntimeError(f"edges did not settle in {max_rounds} rounds")
        roots = tied.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        loops = known.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
        found = tied.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).unionByName(loops)
        return written(found.groupBy("node").agg(F.min("component").alias("component")), "components")
