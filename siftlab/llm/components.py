"""Connected components as Spark joins: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siftlab.session import materialize


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 24))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node's neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        both.where("b > a").join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) of every node of the edges (a, b) that is not itself a root.

    The root is the smallest id reachable. Neighbourhoods are reduced by combinable minima and
    joins, so a node with very many neighbours is never held in one task. Each round is written
    to the shared folder, which cuts the lineage and survives lost executors. An empty frame and
    loops give no rows; null ids are ignored.
    """
    current = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    current = current.where("a is not null and b is not null and a <> b")
    current = current.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = materialize(current, "edges")
    before = _signature(current)
    for _ in range(rounds):
        if not before[0]:
            break
        current = materialize(_small_star(_large_star(current)), "stars")
        after = _signature(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return current.select(F.col("a").alias("id"), F.col("b").alias("root"))
