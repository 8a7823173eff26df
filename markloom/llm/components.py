"""Connected components of an edge table, by alternating large and small stars.

Every step is a group-by with map-side minimum and a join back that AQE can split, so a
vertex with very many edges needs no task of its own. Nothing is collected but a count
and a checksum a round. Components come out labelled by their smallest vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.llm._io import materialise


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (id, component) for every vertex of an edge; component is the smallest id reachable."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = materialise(e, "cc")
    seen = _checksum(e)
    while seen[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        roots = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(roots, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialise(moved.unionAll(roots.select("a", F.col("m").alias("b"))).distinct(), "cc")
        now = _checksum(e)
        if now == seen:
            break
        seen = now
    stars = e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return stars.unionAll(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
