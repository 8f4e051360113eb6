"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .textkit import stored

SALTS = 32


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each vertex's neighbours (the larger ones, or those not larger and itself) linked to the least of all of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # minima in two steps, so that a vertex with many edges is not one task's; dealt anew, so that the join can split it too
    part = both.groupBy("a", F.pmod(F.hash("b"), F.lit(SALTS)).alias("salt")).agg(F.min("b").alias("m"))
    least = part.groupBy("a").agg(F.min("m").alias("m")).select("a", F.least("a", "m").alias("m")).repartition(F.xxhash64("a"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every vertex of edges (a, b); root is the least vertex of its component.

    Needs a number of rounds that grows with the logarithm of the vertices, and goes on until nothing changes; every
    round is stored, so that neither its lineage nor a lost executor leads back beyond it.
    """
    edges = stored(edges.select("a", "b").filter("a <> b").distinct())
    seen, now = None, ()
    while now != seen:
        edges = stored(_star(_star(edges, True), False))
        seen, now = now, tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    roots = edges.select(F.col("b").alias("a"), "b").distinct()
    return edges.unionByName(roots).select(F.col("a").alias("node"), F.col("b").alias("root"))
