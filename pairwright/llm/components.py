"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp for every node of an edge (loops aside); ``comp`` is the least node of its component.

    Each round every node moves to the least of itself and its neighbours, in even rounds by id, which ends stars whose
    centre is their least node at once, in odd ones by a hash that is new each time, so that whatever the ids a
    constant share of the nodes goes, a long chain's as well. Edges are carried over to where their ends moved, until
    none is left; the moves, which shrink round by round, are then followed back. Nothing is collected. Least
    neighbours are taken before the shuffle, and moves are joined by unique keys, so a hub of many edges is split by
    the adaptive skew join.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    left = written(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    moves = []
    while not moves or not left.isEmpty():
        placed = lambda c: F.struct((F.xxhash64(F.lit(len(moves)), c) if len(moves) % 2 else F.lit(0)).alias("h"), F.col(c).alias("to"))  # noqa: E731, B023
        least = left.groupBy("u").agg(F.min(placed("v")).alias("near")).withColumn("to", F.least("near", placed("u"))["to"])
        move = written(least.select("u", "to"))
        moves.append(move)
        here = left.join(move, "u").select(F.col("to").alias("x"), "v")
        there = here.join(move.withColumnsRenamed({"u": "v", "to": "y"}), "v").filter("x <> y")
        left = written(there.select(F.col("x").alias("u"), F.col("y").alias("v")).distinct())
    root = moves[-1].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for move in reversed(moves[:-1]):
        on = move.join(root.withColumnRenamed("node", "to"), "to", "left")
        root = written(on.select(F.col("u").alias("node"), F.coalesce("root", "to").alias("root")))
    names = root.groupBy("root").agg(F.min("node").alias("comp"))
    return written(root.join(names, "root").select("node", "comp"))
