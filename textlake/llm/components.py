"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.runtime import discard, materialize

#: Nodes of so many neighbours that their rows would crowd one task: at most this many, so they are broadcast.
HUBS = 50_000


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _beside_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges`` (u, v) with ``m``, the value that ``least`` (_u, m, c: number of u's edges) holds for u.

    Nodes with over total / HUBS edges are HUBS at most, whatever the table: they are joined where their edges
    lie. All others have too few edges to crowd a task of the shuffled join.
    """
    most = max(8, 2 * total // HUBS)
    hubs = F.broadcast(least.where(F.col("c") > most).select("_u", "m"))
    others = least.where(F.col("c") <= most).select("_u", "m")
    same = F.col("u") == F.col("_u")
    return edges.join(hubs, same).unionByName(edges.join(hubs, same, "left_anti").join(others, same)).drop("_u")


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) for every node that is not its component's smallest: v is that smallest node.

    ``edges``: (a, b) of one orderable type; loops and repeats don't matter; nodes without an edge to another
    node don't appear. Each round links every node's larger neighbours to its smallest one, then its smaller
    ones, so paths shrink and hubs end at the smallest node. All state is in written tables, and a node's
    neighbours are never gathered in one row or task: minima are aggregates, hubs are joined map-side.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e)
    last = _checksum(e)
    if last[0] == 0:
        return e
    for _ in range(rounds):
        total = 2 * last[0]
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"), "c")
        large = _beside_least(both, least, total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).withColumnRenamed("u", "_u")
        moved = _beside_least(large, least, total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, materialize(moved.unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v"))).distinct())
        discard(old)
        now = _checksum(e)
        if now == last:
            return e
        last = now
    raise RuntimeError(f"components: no end after {rounds} rounds")
