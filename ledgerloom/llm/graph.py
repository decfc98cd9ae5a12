"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One round; edges (a, b) with a > b. Minima are pre-aggregated, so a vertex with many neighbours costs no more than its edges."""
    if small:
        out = edges
    else:
        out = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = out.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
    met = out.join(least, out.a == least.v)
    if small:  # lower neighbours and the vertex itself hang on the lowest
        moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
    else:  # higher neighbours hang on the lowest
        moved = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) long → (id, component): every vertex that has a link, and the smallest vertex it reaches."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") > F.col("b")).distinct())
    # No sum can tell two edge sets apart for sure; an exact 128-bit content sum does so but for chance.
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a", F.lit(1)).cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        edges = stored(_star(_star(edges, small=False), small=True))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select("b", "b").distinct().toDF("id", "component"))
