"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node on an edge; a component is named by its least node.

    `edges` has the columns `a` and `b`, of one type. Contraction: every node moves to the
    first of itself and its neighbours, edges follow their ends, and so on until none is
    left. "First" is the least node in the first round, which settles stars around their
    least node at once, and the least hash afterwards, under which any graph, long chains
    too, loses a constant share of its nodes per round. Each round is a written table. A
    crowded node meets only partial aggregates and joins against one row per node.
    """
    edges = staged(edges.select("a", "b").filter("a < b or a > b").distinct(), "edges")
    moved = None
    turn = 0
    while not edges.isEmpty():
        rank = (lambda c: F.col(c)) if turn == 0 else (lambda c, t=turn: F.xxhash64(F.lit(t), c))
        both = edges.union(edges.select("b", "a"))
        nearest = both.groupBy("a").agg(
            F.min(F.struct(rank("b").alias("rank"), F.col("b").alias("node"))).alias("to")
        )
        moves = staged(
            nearest.select(
                F.col("a").alias("node"),
                F.when(rank("a") < F.col("to.rank"), F.col("a")).otherwise(F.col("to.node")).alias("to"),
            ),
            "moves",
        )
        left = moves.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        right = moves.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        edges = staged(
            edges.join(left, "a")
            .join(right, "b")
            .select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
            .filter("a < b or a > b")
            .distinct(),
            "edges",
        )
        if moved is None:
            moved = moves
        else:
            step = moves.select(F.col("node").alias("to"), F.col("to").alias("next"))
            moved = staged(
                moved.join(step, "to", "left").select("node", F.coalesce("next", "to").alias("to")),
                "moved",
            )
        turn += 1
    if moved is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    names = moved.groupBy("to").agg(F.min("node").alias("component"))
    return moved.join(names, "to").select("node", "component")
