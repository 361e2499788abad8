"""Connected components by alternating large and small stars, on Spark.

Each round is written to the shared folder and read again, which cuts lineage
and survives lost executors. The joined minima are read from there too, so that
adaptive execution can split the partition of a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseledger.session import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node sends its neighbours (greater ones if ``large``, else smaller
    ones and itself) to the least node it knows."""
    sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))  # u > v
    if large:
        sides = sides.unionByName(sides.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    joined = sides.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return r[0], r[1]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; the component is its
    least node. Loops, repeated links and either direction are fine."""
    edges = materialize(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                        .where(F.col("a") != F.col("b")).distinct())
    state = _state(edges)
    while state[0]:
        edges = materialize(_stars(materialize(_stars(edges, True)), False))
        new = _state(edges)
        if new == state:
            break
        state = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
