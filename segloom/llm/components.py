"""Connected components of an edge table, as joins and minima over the cluster.

Alternates two steps until no edge changes: every node sends its larger
neighbours to its least one (large star), then its smaller neighbours and itself
(small star). What is left is a star around each component's least node. Both
steps are a minimum by node and a join, so a node with many edges is summed
before the shuffle and its rows are split by adaptive skew joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.llm.common import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(pmod(xxhash64(v, u), 1000003) as long))")).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges(u long, v long): root is the least node it reaches, itself included.

    Direction, loops and repeats of edges don't matter; null ends are not edges.
    """
    e = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = materialize(e.distinct())
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        old = e
        e = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        e = materialize(e, old)
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        stars = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(stars, e)
        if (now := _state(e)) == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
