"""Connected components of an edge table, in DataFrame operations only.

Alternating stars: every vertex hooks its larger neighbours, then its smaller ones, to the smallest
vertex it sees, until each component is a star around its smallest vertex (a number of rounds that
grows with the logarithm of a component's diameter in practice). A hub's neighbours meet only in a
partial minimum and in a join that a skew join splits. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskline.llm.common import discard, staged


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least_neighbour(edges)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, root) of every vertex with an edge; the root is the component's smallest vertex.

    Vertices are longs; null ends, loops and repeated edges count for nothing."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}").distinct()
    e, state = staged(e, "edges"), None
    while True:
        new = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == state:
            break
        state = new
        if not new[0]:
            break
        before, e = e, staged(_small_star(_large_star(e)), "edges")
        discard(before)
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
