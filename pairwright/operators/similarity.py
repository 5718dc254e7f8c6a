"""Similarity join of two labelled sides within groups: exact, by any of several rules.

``brute_force`` joins on the group and filters. ``similarity_join`` works on the distinct values of the rules' columns,
so repeated rows cost one. It finds candidates by equi-joins that lose no pair (prefixes with positions for sets and
bitmaps, segments for edit distance), verifies them by the same whole-number predicates, and joins the rows of both
values to each pair that is left; the two agree row by row. Keys that many rows hold are dealt to a grid of cells
(``meet``), so one huge group or one fragment that all rows share makes many tasks and not one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..schemas import cut
from . import cells

#: Rows of either side that meet in one cell of a heavy key, and rows of a table that may be broadcast after its size is counted.
CELL, SMALL = 512, 100_000
#: Rows of a value that travel together, and pairs of rows that a task spreads out.
PACK, TASK = 512, 500_000
#: Tenths under which the prefixes of bitmaps hold most of their bits, so that blocks of bitmaps are compared outright.
LOW = 8


@dataclass(frozen=True)
class SetRule:
    """Tanimoto of two array columns at tenths / 10 or above."""

    column: str
    tenths: int = 9

    def holds(self, a: str, b: str) -> Column:
        return T.set_tanimoto_at_least(F.col(f"{a}.{self.column}"), F.col(f"{b}.{self.column}"), self.tenths)


@dataclass(frozen=True)
class BitRule:
    """Tanimoto of two bitmaps (arrays of words) at tenths / 10 or above; a missing or empty one matches nothing."""

    column: str
    tenths: int = 9

    def holds(self, a: str, b: str) -> Column:
        c, u = T.bitmap_counts(F.col(f"{a}.{self.column}"), F.col(f"{b}.{self.column}"))
        return F.coalesce((u > 0) & (10 * c >= self.tenths * u), F.lit(False))


@dataclass(frozen=True)
class EditRule:
    """Distance of two texts of at most a tenth of the longer one's length."""

    column: str

    def holds(self, a: str, b: str) -> Column:
        return F.coalesce(T.edit_similar(F.col(f"{a}.{self.column}"), F.col(f"{b}.{self.column}")), F.lit(False))


Rule = SetRule | BitRule | EditRule


def any_rule(rules: list[Rule], a: str = "l", b: str = "r") -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | rule.holds(a, b)
    return out


def brute_force(left: DataFrame, right: DataFrame, group: list[str], rules: list[Rule]) -> DataFrame:
    """Rows (l struct, r struct) of pairs in one group that a rule accepts. Reference form; its cost is the product of a group's sides."""
    a, b = left.select(*group, F.struct(*left.columns).alias("l")), right.select(*group, F.struct(*right.columns).alias("r"))
    return a.join(b, group).filter(any_rule(rules)).select("l", "r")


def _sized(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast where a count finds it small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def meet(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, cell: int = CELL) -> DataFrame:
    """Inner join on ``on`` in which a key with more than ``cell`` rows on a side is dealt to a grid of i x j cells.

    A row goes by the hash of its id to one of the key's blocks on its own side, once for each block of the other side,
    so each pair of rows meets in exactly one cell. Both sides are read twice: give tables that are written or cheap.
    """
    each = [df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / cell).alias(n)).filter(F.col(n) > 1) for df, n in ((left, "__bl"), (right, "__br"))]
    heavy = cut(each[0].join(each[1], on, "full").select(*on, F.coalesce("__bl", F.lit(1)).alias("__bl"), F.coalesce("__br", F.lit(1)).alias("__br")))
    if heavy.isEmpty():
        return left.join(right, on)
    heavy = _sized(heavy)

    def dealt(df: DataFrame, own_id: str, own: str, other: str, i: str, j: str) -> DataFrame:
        known = df.join(heavy, on, "left")
        block = F.pmod(F.xxhash64(F.col(own_id)), F.coalesce(own, F.lit(1)))
        return known.withColumn(i, block).withColumn(j, F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(other, F.lit(1)) - 1))).drop("__bl", "__br")

    a, b = dealt(left, left_id, "__bl", "__br", "__i", "__j"), dealt(right, right_id, "__br", "__bl", "__j", "__i")
    return a.join(b, [*on, "__i", "__j"]).drop("__i", "__j")


def _prefixes(left: DataFrame, right: DataFrame, group: list[str], items: Column, tenths: int) -> tuple[DataFrame, DataFrame]:
    """(group, __key, __pos, __pre, __n, __id) of the rarest items of each set.

    A set of n items shares one of its n - ceil(t n) + 1 rarest with any set at least t like it. Items are ordered by
    (frequency in the group, hash); a row is one of these items with its position and the items of the prefix.
    """

    def exploded(df: DataFrame) -> DataFrame:
        distinct = F.array_distinct(F.filter(items, lambda x: x.isNotNull()))
        return df.select(*group, "__id", distinct.alias("__s")).filter(F.size("__s") > 0).select(*group, "__id", F.size("__s").alias("__n"), F.explode("__s").alias("__x")).select(*group, "__id", "__n", F.xxhash64(F.col("__x").cast("string")).alias("__h"))

    a, b = exploded(left), exploded(right)
    counts = a.unionByName(b).groupBy(*group, "__h").agg(F.count(F.lit(1)).alias("__f"))

    def prefix(df: DataFrame) -> DataFrame:
        ranked = df.join(counts, [*group, "__h"]).groupBy(*group, "__id", "__n").agg(F.sort_array(F.collect_list(F.struct("__f", "__h"))).alias("__r"))
        keep = F.col("__n") - F.floor((F.col("__n") * tenths + 9) / 10) + 1
        pre = ranked.withColumn("__pre", F.transform(F.slice("__r", F.lit(1), keep.cast("int")), lambda x: x["__h"]))
        return pre.select(*group, "__id", "__n", "__pre", F.explode(F.array_distinct("__pre")).alias("__key")).withColumn("__pos", F.array_position("__pre", F.col("__key")) - 1)

    return cut(prefix(a)), cut(prefix(b))


def set_candidates(left: DataFrame, right: DataFrame, group: list[str], items: Column, tenths: int) -> DataFrame:
    """(lid, rid) of the pairs of sets that may reach ``tenths`` / 10, each once.

    A pair belongs to the first item that both prefixes hold, so no later ``distinct`` is needed. What is ahead of that
    item can't be shared, so the pair's overlap is at most the shorter rest from that item on; a pair whose sizes ask for
    more is never made.
    """
    a, b = _prefixes(left, right, group, items, tenths)
    names = ("__id", "__n", "__pre", "__pos")
    pairs = meet(a, b.withColumnsRenamed({c: f"{c}r" for c in names}), [*group, "__key"], "__id", "__idr")
    reach = F.least(F.col("__n") - F.col("__pos"), F.col("__nr") - F.col("__posr"))
    sizes = tenths * F.greatest("__n", "__nr") <= 10 * F.least("__n", "__nr")
    first = ~F.arrays_overlap(F.slice("__pre", F.lit(1), F.col("__pos").cast("int")), F.slice("__prer", F.lit(1), F.col("__posr").cast("int")))
    return pairs.filter(sizes & ((10 + tenths) * reach >= tenths * (F.col("__n") + F.col("__nr"))) & first).select(F.col("__id").alias("lid"), F.col("__idr").alias("rid"))


def _segments(df: DataFrame, group: list[str], column: str, probe: bool, shorter: bool = False) -> DataFrame:
    """(__id, __m, __k, __key) of texts for one layout a length m.

    A pair whose longer text has m characters may be d = floor(m / 10) edits apart; of d + 2 segments of that text at
    least two stand in the other one as they are. With s the shift of such a segment and e the difference of lengths,
    |s| + |e - s| edits at least are spent before and behind it, so s lies within (e - d) / 2 and (e + d) / 2. The indexed
    side gives its segments; the probing side, for each m that a longer partner may have, the substrings in reach.
    Under 10 characters the whole text is the one segment.
    """
    base = df.select(*group, "__id", F.col(column).alias("__t"), F.length(F.col(column)).alias("__l")).filter(F.col("__t").isNotNull())
    start = F.col("__l") + (1 if shorter else 0)
    lengths = F.sequence(start, F.greatest(start, F.floor(F.col("__l") * 10 / 9).cast("int"))) if probe else F.array("__l")
    each = base.withColumn("__m", F.explode(lengths)).withColumn("__d", F.floor(F.col("__m") / 10).cast("int"))
    each = each.withColumn("__e", F.col("__m") - F.col("__l")).filter(F.col("__e") <= F.col("__d"))
    parts = F.when(F.col("__d") > 0, F.col("__d") + 2).otherwise(1)
    at = lambda k: F.floor(F.col("__m") * k / parts).cast("int")
    key = lambda k, from_: F.struct(k.alias("k"), F.xxhash64(*group, "__m", k, F.substring(F.col("__t"), from_ + 1, at(k + 1) - at(k))).alias("key"))
    ks = F.sequence(F.lit(0), parts - 1)
    if probe:
        shifts = F.sequence(-F.floor((F.col("__d") - F.col("__e")) / 2).cast("int"), F.floor((F.col("__d") + F.col("__e")) / 2).cast("int"))
        fits = lambda k, s: (at(k) - s >= 0) & (at(k + 1) - s <= F.col("__l"))
        keys = F.array_distinct(F.flatten(F.transform(ks, lambda k: F.transform(F.filter(shifts, lambda s: fits(k, s)), lambda s: key(k, at(k) - s)))))
    else:
        keys = F.transform(ks, lambda k: key(k, at(k)))
    return each.select("__id", "__m", F.explode(keys).alias("__x")).select("__id", "__m", F.col("__x.k").alias("__k"), F.col("__x.key").alias("__key"))


def edit_candidates(left: DataFrame, right: DataFrame, group: list[str], column: str, cell: int = CELL) -> DataFrame:
    """(lid, rid) of a superset of the pairs within a tenth of the longer text, each once.

    The longer text's segments are the index: once with the left side as the longer or equal one, once with the
    right side as the longer. A segment that more than ``cell`` indexed texts hold is heavy. As two segments of a pair
    are whole, either one of them is light, and the pair meets there, or both are heavy, and it meets on the two
    together; so a prefix that all texts share never makes all pairs.
    """

    def arm(longer: DataFrame, other: DataFrame, strict: bool) -> DataFrame:
        index, probe = _segments(longer, group, column, False), _segments(other, group, column, True, strict).withColumnRenamed("__id", "__idr")
        heavy = cut(index.groupBy("__key").agg(F.count(F.lit(1)).alias("__c")).filter(F.col("__c") > cell).select("__key"))
        if heavy.isEmpty():
            return index.join(probe.select("__idr", "__key"), "__key").select("__id", "__idr").distinct()
        heavy = _sized(heavy)
        light = index.join(heavy, "__key", "left_anti").join(probe.select("__idr", "__key"), "__key").select("__id", "__idr")

        def doubled(rows: DataFrame, own: str) -> DataFrame:
            held = rows.join(heavy, "__key", "left_semi").groupBy(own, "__m").agg(F.sort_array(F.collect_list(F.struct(F.col("__k").alias("k"), F.col("__key").alias("key")))).alias("__s"))
            behind = lambda x: F.transform(F.filter("__s", lambda y: y["k"] > x["k"]), lambda y: F.xxhash64(x["key"], y["key"]))
            both = F.when(F.col("__m") < 10, F.transform("__s", lambda x: x["key"])).otherwise(F.flatten(F.transform("__s", behind)))
            return cut(held.select(own, F.explode(F.array_distinct(both)).alias("__two")))

        return light.unionByName(meet(doubled(index, "__id"), doubled(probe, "__idr"), ["__two"], "__id", "__idr", cell).select("__id", "__idr")).distinct()

    one = arm(left, right, False).select(F.col("__id").alias("lid"), F.col("__idr").alias("rid"))
    return one.unionByName(arm(right, left, True).select(F.col("__idr").alias("lid"), F.col("__id").alias("rid")))


def bit_candidates(left: DataFrame, right: DataFrame, group: list[str], column: str, tenths: int) -> DataFrame:
    """(lid, rid) of the pairs of bitmaps that reach ``tenths`` / 10, each once, compared block by block of either side; nothing but the bitmaps is shuffled."""

    def words(table: pa.Table, width: int) -> np.ndarray:
        made = np.zeros((width, table.num_rows), dtype=np.uint64)
        for k, row in enumerate(table["words"].to_pylist()):
            made[: len(row), k] = [(w or 0) & (1 << 64) - 1 for w in row]
        return made

    def cell(a: pa.Table, b: pa.Table) -> Iterator[dict]:
        width = max(len(row) for t in (a, b) for row in t["words"])
        x, y = words(a, width), words(b, width)
        p, q = (np.bitwise_count(w).sum(axis=0, dtype=np.int32) for w in (x, y))
        ids = [t["id"].to_numpy() for t in (a, b)]
        for at in range(0, a.num_rows, 128):  # a strip of the block, so that what a task holds is small
            common = sum(np.bitwise_count(v[at : at + 128, None] & w[None, :]).astype(np.int32) for v, w in zip(x, y, strict=True))
            i, j = np.nonzero((common > 0) & (10 * common >= tenths * (p[at : at + 128, None] + q[None, :] - common)))
            yield {"lid": ids[0][at + i], "rid": ids[1][j]}

    some = F.size(F.col(column)) > 0
    sides = [df.filter(some).select(*group, F.col("__id").alias("id"), F.col(column).cast("array<bigint>").alias("words")) for df in (left, right)]
    return cells.in_cells(cells.dealt(*sides, group, "id"), group, cell, StructType.fromDDL("lid bigint, rid bigint"))


def candidates(left: DataFrame, right: DataFrame, group: list[str], rule: Rule) -> DataFrame:
    """(lid, rid) of a superset of the pairs that the rule accepts; both sides have unique ``__id``."""
    if isinstance(rule, EditRule):
        return edit_candidates(left, right, group, rule.column)
    if isinstance(rule, BitRule) and rule.tenths < LOW:
        return bit_candidates(left, right, group, rule.column, rule.tenths)
    items = bit_numbers(F.col(rule.column)) if isinstance(rule, BitRule) else F.col(rule.column)
    return set_candidates(left, right, group, items, rule.tenths)


def bit_numbers(words: Column) -> Column:
    """Numbers of the set bits of an array of words."""
    return F.flatten(F.transform(words, lambda w, i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit(w.cast("bigint"), k) == 1), lambda k: i * 64 + k)))


def _values(rows: DataFrame, group: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, values): the rows, written, as (__h, __v struct of ``columns``, __row struct), and the distinct values with their number of rows ``__n`` and an ``__id``, written too."""
    v = F.struct(*columns)
    kept = cut(rows.dropna("any", subset=group).select(F.xxhash64(v).alias("__h"), v.alias("__v"), F.struct(*rows.columns).alias("__row")))
    distinct = cut(kept.groupBy("__h", "__v").agg(F.count(F.lit(1)).alias("__n")).withColumn("__id", F.monotonically_increasing_id()))
    return kept, distinct


def _sides(left: DataFrame, right: DataFrame, group: list[str], rules: list[Rule], need_bitmap: str | None = None) -> list[tuple[DataFrame, DataFrame]]:
    if need_bitmap:
        right = right.join(right.filter(F.col(need_bitmap).isNotNull()).select(*group).distinct(), group, "left_semi")
    columns = list(dict.fromkeys([*group, *(rule.column for rule in rules)]))
    return [_values(side, group, columns) for side in (left, right)]


def _pairs_of_values(a: DataFrame, b: DataFrame, group: list[str], rules: list[Rule]) -> DataFrame:
    """lid, ln, l, rid, rn, r of the pairs of values that a rule accepts, ln and rn being their numbers of rows."""
    flat = [side.select("__id", "__v.*") for side in (a, b)]
    found = None
    for rule in rules:
        c = candidates(*flat, group, rule)
        found = c if found is None else found.unionByName(c)
    found = found if len(rules) == 1 else found.distinct()
    named = [side.select(F.col("__id").alias(f"{p}id"), F.col("__n").alias(f"{p}n"), F.col("__v").alias(p)) for side, p in ((a, "l"), (b, "r"))]
    both = found.join(named[0], "lid").join(named[1], "rid")
    same = F.lit(True)
    for g in group:
        same = same & (F.col(f"l.{g}") == F.col(f"r.{g}"))
    return both.filter(same & any_rule(rules))


def counted_join(left: DataFrame, right: DataFrame, group: list[str], rules: list[Rule]) -> DataFrame:
    """l, r, n: pairs of distinct values (structs of the group and the rules' columns) that a rule accepts, and the number of pairs of rows with these values.

    What ``similarity_join`` gives, counted instead of made: its cost is that of the values, however often they repeat.
    """
    (_, a), (_, b) = _sides(left, right, group, rules)
    return _pairs_of_values(a, b, group, rules).select("l", "r", (F.col("ln") * F.col("rn")).alias("n"))


def _packed(rows: DataFrame, values: DataFrame, side: str) -> DataFrame:
    """<side>id, <side>b and the rows of a value as arrays of about ``PACK`` each."""
    of = values.select(F.col("__h").alias("h"), F.col("__v").alias("v"), F.col("__id").alias(f"{side}id"), F.ceil(F.col("__n") / PACK).alias("blocks"))
    numbered = rows.withColumn("at", F.monotonically_increasing_id()).join(of, (F.col("__h") == F.col("h")) & F.col("__v").eqNullSafe(F.col("v")))
    at = F.pmod(F.xxhash64("at"), F.col("blocks"))
    return numbered.select(f"{side}id", at.alias(f"{side}b"), "__row").groupBy(f"{side}id", f"{side}b").agg(F.collect_list("__row").alias(f"{side}rows"))


def similarity_join(left: DataFrame, right: DataFrame, group: list[str], rules: list[Rule], need_bitmap: str | None = None) -> DataFrame:
    """Rows (l struct, r struct) of pairs within a group that any rule accepts, each pair of rows once.

    ``need_bitmap``: groups in which no right row has this column give nothing at all. Equal rows are different rows: each
    of them is in a pair of its own. A null group is in no pair, a null value is accepted by no rule. Values are told
    apart by comparison; their hash only brings them together. The rows of a value travel packed, once for each pack of
    a value that it is paired with; they are spread out last, in as many tasks as their pairs ask for.
    """
    (rows_l, a), (rows_r, b) = _sides(left, right, group, rules, need_bitmap)
    pairs = cut(_pairs_of_values(a, b, group, rules).select("lid", "ln", "rid", "rn"))
    made = pairs.agg(F.sum(F.col("ln").cast("double") * F.col("rn"))).first()[0] or 0
    packs = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col(n) / PACK) - 1))
    grid = pairs.withColumn("lb", packs("ln")).withColumn("rb", packs("rn")).select("lid", "lb", "rid", "rb")
    met = grid.join(_packed(rows_l, a, "l"), ["lid", "lb"]).join(_packed(rows_r, b, "r"), ["rid", "rb"])
    tasks = int(min(1 + made // TASK, 10_000))
    return met.repartition(tasks, "lid", "lb", "rid", "rb").select("rrows", F.explode("lrows").alias("l")).select("l", F.explode("rrows").alias("r"))


def pair_counts(pairs: DataFrame, group: list[str]) -> DataFrame:
    """n_pairs of each group, before any removal of repeated texts."""
    return pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("n_pairs"))
