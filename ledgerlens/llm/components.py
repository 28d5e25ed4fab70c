"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import written

#: The stars converge in a number of rounds that grows with the logarithm of the vertices; more than this is an error, not a result.
MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation. Every vertex' larger (large) or smaller (small) neighbours go to the smallest of its neighbourhood."""
    if large:
        around = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = around.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, u: str, v: str) -> DataFrame:
    """(vertex, root) for every vertex that links hold; root is the smallest vertex of its component. Self links and nulls are ignored.

    Every round is written to the shared folder. A vertex with very many edges is split by the engine's skew join; its minimum is
    taken by a two-step aggregate.
    """
    a, b = F.col(u), F.col(v)
    edges = written(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        edges = written(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(
                edges.select(F.col("v"), F.col("v")).distinct()
            )
        before = now
    raise RuntimeError(f"no components after {MOST_ROUNDS} rounds")
