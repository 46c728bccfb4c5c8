"""Connected components by alternating large-star and small-star steps, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workdir import discard, materialize


def _with_least(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges(a, b) with m, the least of a and its neighbours nodes(a, b), and the table to discard.

    The least neighbours are a table of their own, so both sides of the join have an
    exchange and a node with very many edges can be split by adaptive execution.
    """
    least = materialize(nodes.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return edges.join(least, "a"), least


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u is linked with the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met, least = _with_least(both.where("b > a"), both)
    out = materialize(met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
    discard(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its neighbours below it are linked with the least of them (edges run from the larger end)."""
    met, least = _with_least(edges, edges)
    below = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = materialize(below.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    discard(least)
    return out


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for each node of an edge, the smallest node that it reaches.

    Each step's tables are written to the shared folder, so a lost executor repeats
    one step at most.
    """
    now = materialize(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges"
    )
    mark = _fingerprint(now)
    while mark[0]:
        wide = _large_star(now)
        after = _small_star(wide)
        new = _fingerprint(after)
        discard(now, wide)
        now = after
        if new == mark:
            break
        mark = new
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _fingerprint(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]
