"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count("*"), F.sum((F.xxhash64("u", "v") % (1 << 30)).cast("long"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that can be reached, for all nodes of edges (a, b) of longs.

    Each round brings nodes nearer to their label; the rounds grow with the
    logarithm of a component's length.  Only counts come to the driver.  The
    table of minima is written first, so that Spark can split a node with very
    many neighbours when it joins.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialise(e)
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large)
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = materialise(small.where("u <> v").distinct())
        before, state = state, _state(e)
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
