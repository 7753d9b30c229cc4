"""Connected components by alternating large-star and small-star, each step an aggregation and an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace, unless_few


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every node joins its larger neighbours to the smallest node it knows (itself included)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(unless_few(least, 2 * rows), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every node joins its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(unless_few(least, rows), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def star_rounds(edges: DataFrame, ws: Workspace, most: int) -> tuple[DataFrame, bool, int]:
    """Edges (u > v) after so many rounds at most, each node's smallest among them, whether the last one changed nothing, and how many they are.
    They join what the given edges join. Each round is written to the shared folder; the driver sees only two numbers
    of it, which come with the writing."""

    def saved(df: DataFrame):
        out, seen = ws.measured(df.distinct(), "edges", x=F.bit_xor(F.xxhash64("u", "v")))
        return out, (seen["n"], seen["x"])

    now, mark = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    same = mark[0] == 0
    for _ in range(most):
        if same:
            break
        after, after_mark = saved(_small_star(_large_star(now, mark[0]), mark[0]))
        ws.drop(now)
        now, same, mark = after, after_mark == mark, after_mark
    return now, same, mark[0]


def components(edges: DataFrame, ws: Workspace, max_rounds: int = 60) -> DataFrame:
    """(u, v) undirected edges of longs -> (node, root) for every node with an edge, root the smallest reachable.

    Self-loops, repeated edges and rows with a null end add nothing; an empty table gives an empty one.
    Stops when a round leaves the edges as they were: then every node hangs on its root.
    """
    now, same, _ = star_rounds(edges, ws, max_rounds)
    if not same:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
