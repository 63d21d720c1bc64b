"""Connected components of an edge table by alternating stars, with every step on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import stage_rows


def _star(arcs: DataFrame, large: bool) -> DataFrame:
    """Relink neighbours of a node to the smallest node of its neighbourhood. Arcs are ``(u, v)``; minima
    are aggregated (partial sums first) and joined back, so no neighbourhood is gathered anywhere."""
    both = arcs.unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else arcs
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _mark(arcs: DataFrame) -> tuple:
    return tuple(arcs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000000007), F.sum(F.xxhash64("v", "u") % 998244353)).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", rows: int = 1 << 24) -> DataFrame:
    """``(node, root)`` for every node of the edges but the roots: root is the smallest node reachable.

    Every round halves distances in the way of alternating large and small stars, so the number of rounds
    grows with the logarithm of the size; each round is written to the shared folder, which cuts the
    lineage. Self loops and repeated edges are harmless; no edges give no rows. ``rows``: about how many
    edges there may be, for the number of files only."""
    arcs = stage_rows(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "stars", rows)
    mark = _mark(arcs)
    while mark[0]:
        arcs = stage_rows(_star(_star(arcs, True), False), "stars", mark[0])
        was, mark = mark, _mark(arcs)
        if was == mark:
            break
    return arcs.select(F.col("u").alias("node"), F.col("v").alias("root"))
