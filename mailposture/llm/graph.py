"""Connected components of very large graphs, by contraction in rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailposture.session import discard, store


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge in ``edges`` (a, b); the root is the smallest node of the component.

    In every round the nodes of the contracted graph get new labels by hash, each node moves to that of itself and its neighbours with the least label, and edges are
    rewritten to where their ends went.  The labels have nothing to do with the numbers of the nodes, so about half of the nodes of any path go in a round, also
    of one with rising numbers: rounds grow with the logarithm of the longest path.  The maps of the rounds are chained from the last to the first, and the smallest node is taken at the
    end.  Nothing goes to the driver but whether edges are left.  Joins read written tables on both sides, so adaptive execution can split a node to which a
    large share of all others moved; minima are taken before the shuffle.  Null ends, loops and repeated edges have no effect; without edges there are no rows.
    Tables of rounds that are past are deleted.
    """
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = store(ordered.filter(F.col("a") < F.col("b")).distinct())
    moves: list[DataFrame] = []
    while not left.isEmpty():
        label = lambda node: F.xxhash64(node, F.lit(len(moves)))
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(label("b").alias("label"), F.col("b").alias("node"))).alias("least"))
        own = F.struct(label("a").alias("label"), F.col("a").alias("node"))
        goal = store(least.select(F.col("a").alias("node"), F.least("least", own)["node"].alias("goal")))
        moves.append(goal)
        moved = (
            left.join(goal.select(F.col("node").alias("a"), F.col("goal").alias("to_a")), "a")
            .join(goal.select(F.col("node").alias("b"), F.col("goal").alias("to_b")), "b")
            .filter(F.col("to_a") != F.col("to_b"))
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        )
        past, left = left, store(moved.distinct())
        discard(past)
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    chained = moves[-1]
    for move in reversed(moves[:-1]):
        later = chained.select(F.col("node").alias("goal"), F.col("goal").alias("to"))
        past, chained = chained, store(move.join(later, "goal", "left").select("node", F.coalesce("to", "goal").alias("goal")))
        discard(past, move)
    smallest = store(chained.groupBy("goal").agg(F.min("node").alias("root")))
    return chained.join(smallest, "goal").select("node", "root")
