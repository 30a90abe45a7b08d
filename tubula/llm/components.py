"""Connected components by alternating large-star and small-star rounds, each a join and an aggregation by node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, lookup_join


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _stars(rows: DataFrame, total: int) -> DataFrame:
    least = cut(rows.groupBy("u").agg(F.min("v").alias("v_min"), F.count("*").alias("n")), "least")
    return lookup_join(rows, least, ["u"], "n", total).withColumn("m", F.least("u", "v_min"))


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of comparable ids -> (node, component), for every node with an edge; component is its smallest node.

    A round keeps connectivity and brings nodes closer to their least neighbour, so the number of rounds grows with the
    logarithm of the longest path. Nodes of very many edges are no hot keys: see lookup_join.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_stars(both, 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        n = large.count()
        small = _stars(large, n)
        links = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = cut(small.select(F.explode(links).alias("e")).select("e.*").where("u <> v").distinct(), "small")
        before, state = state, _state(small)
        drop(now, large)
        now = small
        if before == state:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
