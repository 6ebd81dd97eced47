"""Connected components of an edge table, on DataFrames: alternating large and small stars.

Every round points vertices at smaller ones of their component until only stars are left. Minima are
aggregated before they are joined back, and the join splits the edges of a hub over several tasks;
each half round is cut off by a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checkpoint, spread_join


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """pairs (u, v), each edge from the sides the star looks at; the result points at the least vertex around u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = spread_join(pairs, least, "u")
    if small:
        edges = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        edges = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return edges.filter("u <> v").distinct()


def _open(edges: DataFrame) -> bool:
    """Whether a vertex points at two others, or at one that points on."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("x").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return bool(ends.agg(F.bool_or((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0)))).first()[0])


def connected_components(edges: DataFrame) -> DataFrame:
    """vertex, root (the least vertex of its component) of every vertex that has an edge (u, v); loops are ignored."""
    edges = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    while _open(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        half = checkpoint(_star(both, small=False))
        edges = checkpoint(_star(half, small=True))
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
