"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.session import materialise

# Rounds in which nodes go to their smallest neighbour; in later ones the order is drawn anew each time.
PLAIN_ROUNDS = 3


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it reaches, for each node of ``edges`` (a, b).

    In each round every node goes to the least of its neighbours and itself, and the
    edges are redrawn between the nodes gone to, until none is left. Stars whose centre
    is their smallest node vanish in one round; with an order drawn anew in each round
    the rounds grow with the logarithm of a component's size whatever its form. Minima
    are taken before the shuffle, and a node with very many neighbours meets them in a
    join that can be split. What each round makes is written, so a lost executor costs a
    re-read. Self-loops and repeated edges do no harm.
    """
    left = materialise(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    moves: list[DataFrame] = []
    while left.take(1):
        rank = _rank(len(moves))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min_by("b", rank("b")).alias("least"))
        move = F.when(rank("least") < rank("a"), F.col("least")).otherwise(F.col("a"))
        moved = materialise(least.select(F.col("a").alias("node"), move.alias("root")), "moves")
        first = moved.select(F.col("node").alias("a"), F.col("root").alias("c"))
        second = moved.select(F.col("node").alias("b"), F.col("root").alias("d"))
        redrawn = left.join(first, "a").join(second, "b").filter("c <> d")
        left = materialise(redrawn.select(F.col("c").alias("a"), F.col("d").alias("b")).distinct(), "edges")
        moves.append(moved)
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = moves[0]
    for moved in moves[1:]:
        later = moved.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = found.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    if len(moves) <= PLAIN_ROUNDS:
        return found
    smallest = found.groupBy("root").agg(F.min("node").alias("smallest"))
    return found.join(smallest, "root").select("node", F.col("smallest").alias("root"))


def _rank(number: int):
    def rank(column: str) -> Column:
        if number < PLAIN_ROUNDS:
            return F.col(column)
        return F.struct(F.xxhash64(F.col(column), F.lit(number)), F.col(column))

    return rank
