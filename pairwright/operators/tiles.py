"""Scores of all pairs of two sides as packed tiles, for matrices that are wanted whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a side that make a tile's edge.
EDGE = 128


def _edges(df: DataFrame, group: list[str], index: str, edge: int, at: str, rows: str) -> DataFrame:
    """A row for each ``edge`` consecutive indexes of a group: the rows as an array in the order of the index."""
    own = F.struct(F.col(index).cast("bigint").alias(index), *[c for c in df.columns if c not in (*group, index)])
    return df.filter(F.col(index).isNotNull()).select(*group, F.floor(F.col(index) / edge).alias(at), own.alias("__r")).groupBy(*group, at).agg(F.sort_array(F.collect_list("__r")).alias(rows))


def score_tiles(left: DataFrame, right: DataFrame, group: list[str], index: str, scores: dict[str, Callable[[Column, Column], Column]], edge: int = EDGE, done: DataFrame | None = None) -> DataFrame:
    """The group, tile_i, tile_j, rows_i, rows_j (indexes) and for each score an array by rows_i, then rows_j.

    A tile is one record of at most ``edge`` x ``edge`` pairs: rows are packed before the sides meet, and no pair is a row
    of its own. Tiles are dealt evenly whatever a group's size, and those that ``done`` holds (group, tile_i, tile_j) are not made
    again, so a run that was lost goes on where it ended. Each index should stand once in its side of a group; rows without
    an index or with a null group are in no tile.
    """
    a, b = _edges(left, group, index, edge, "tile_i", "__a"), _edges(right, group, index, edge, "tile_j", "__b")
    open_ = a.select(*group, "tile_i").join(b.select(*group, "tile_j"), group)
    if done is not None:
        open_ = open_.join(done.select(*group, "tile_i", "tile_j"), [*group, "tile_i", "tile_j"], "left_anti")
    met = open_.join(a, [*group, "tile_i"]).join(b, [*group, "tile_j"]).repartition(*group, "tile_i", "tile_j")
    score = lambda f: F.flatten(F.transform("__a", lambda x: F.transform("__b", lambda y: f(x, y))))
    return met.select(*group, "tile_i", "tile_j", F.transform("__a", lambda x: x[index]).alias("rows_i"), F.transform("__b", lambda x: x[index]).alias("rows_j"), *[score(f).alias(name) for name, f in scores.items()])


def pairs_of(made: DataFrame, group: list[str], scores: list[str]) -> DataFrame:
    """The group, i, j and the scores: a row for each pair of the tiles."""
    n = F.size("rows_j")
    each = F.posexplode(F.arrays_zip(*scores)).alias("__at", "__s")
    out = made.select(*group, "rows_i", "rows_j", n.alias("__n"), each)
    i, j = F.get("rows_i", F.floor(F.col("__at") / F.col("__n")).cast("int")), F.get("rows_j", (F.col("__at") % F.col("__n")).cast("int"))
    return out.select(*group, i.alias("i"), j.alias("j"), *[F.col("__s")[s].alias(s) for s in scores])
