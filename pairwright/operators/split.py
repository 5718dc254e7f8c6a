"""Group-disjoint train / test split, shuffles and step classes."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fragment_count, str_or_empty
from ..schemas import with_row_index


def group_sizes(df: DataFrame, group: str, index: str, within: list[str] | None = None) -> DataFrame:
    """Size and first index of each group; rows without a group are none."""
    return df.filter(F.col(group).isNotNull()).groupBy(*(within or []), group).agg(F.count(F.lit(1)).alias("size"), F.min(index).alias("first_idx"))


def grouped_split(df: DataFrame, group: str, index: str, tenths_test: int = 1, within: list[str] | None = None, out: str = "split") -> DataFrame:
    """Adds 'train' or 'test': small groups fill the test side up to ``tenths_test`` / 10 of all rows; rows without a group train.

    Taking groups by (size, first index) while they fit is a prefix sum over groups: sizes never fall, so after the
    first that doesn't fit none does. Groups of one size are one row of that sum first, and only the size at which
    the sum crosses the limit is looked at group by group, numbered over range partitions; so no task orders all groups
    even where nearly all of them have one size.
    """
    keys = within or []
    sizes = group_sizes(df, group, index, within)
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else df.agg(F.count(F.lit(1)).alias("n"))
    by_size = sizes.groupBy(*keys, "size").agg(F.count(F.lit(1)).alias("k"))
    order = Window.partitionBy(*keys).orderBy("size") if keys else Window.orderBy("size")
    ahead = by_size.withColumn("upto", F.sum(F.col("k") * F.col("size")).over(order)).withColumn("before", F.col("upto") - F.col("k") * F.col("size"))
    ahead = ahead.join(F.broadcast(total), keys) if keys else ahead.crossJoin(F.broadcast(total))
    # how many groups of each size fit: all, some or none
    fits = F.greatest(F.lit(0), F.floor((F.floor(F.col("n") * tenths_test / 10) - F.col("before")) / F.col("size")))
    ahead = ahead.select(*keys, "size", "k", F.least(fits, F.col("k")).alias("take"))
    placed = sizes.join(F.broadcast(ahead), [*keys, "size"])  # one row for each size of group
    whole = placed.filter((F.col("take") == F.col("k")) | (F.col("take") == 0)).select(*keys, group, (F.col("take") > 0).alias("__test"))
    # the one size of a key at which only some groups fit: numbered by ranges, as it may hold nearly all groups
    some = with_row_index(placed.filter((F.col("take") > 0) & (F.col("take") < F.col("k"))).select(*keys, group, "first_idx", "take"), [*keys, "first_idx"], "__r")
    first = some.groupBy(*keys).agg(F.min("__r").alias("__0")) if keys else some.agg(F.min("__r").alias("__0"))
    some = (some.join(first, keys) if keys else some.crossJoin(F.broadcast(first))).select(*keys, group, (F.col("__r") - F.col("__0") < F.col("take")).alias("__test"))
    return df.join(whole.unionByName(some), [*keys, group], "left").withColumn(out, F.when(F.coalesce("__test", F.lit(False)), "test").otherwise("train")).drop("__test")


def split_summary(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count_distinct(group).alias("n_groups"), F.count(F.lit(1)).alias("n_rows"))


def resolve_column(df: DataFrame, explicit: str | None = None, choices: tuple[str, ...] = ("toxic_safe_decoded_smiles", "toxic_smiles")) -> str:
    """The explicit column, or the first of the choices that the frame has."""
    for c in (explicit,) if explicit else choices:
        if c in df.columns:
            return c
    raise ValueError(f"none of {explicit or choices} in {df.columns}")


def has_name(dataset: str = "dataset_name", endpoint: str = "endpoint") -> Column:
    """Rows that name a dataset or an endpoint."""
    return (str_or_empty(F.col(dataset)) != "") | (str_or_empty(F.col(endpoint)) != "")


def step_of_one(fragments: Column) -> Column:
    """single_step if there is exactly one fragment."""
    return F.when(fragment_count(fragments) == 1, "single_step").otherwise("multi_step")


def step_of_two(a: Column, b: Column) -> Column:
    """single_step if both sides have exactly one fragment."""
    return F.when((fragment_count(a) == 1) & (fragment_count(b) == 1), "single_step").otherwise("multi_step")


def first_rows(df: DataFrame, n: int, index: str = "row_idx") -> DataFrame:
    """Rows with an index under n; 0 means all."""
    return df.filter(F.col(index) < n) if n else df


#: Rounds of the permutation, the prime that its round function counts by, and the steps a walk back into range may take.
ROUNDS, PRIME, WALK = 6, (1 << 31) - 1, 64


def round_keys(seed: int) -> list[tuple[int, int]]:
    """(shift, factor) of each round, from the seed alone."""
    rng = random.Random(seed)
    return [(rng.randrange(PRIME), rng.randrange(1, PRIME)) for _ in range(ROUNDS)]


def permuted(index: Column, n: int, seed: int) -> Column:
    """The place of row ``index`` of 0..n-1 in a seeded permutation, which each row computes alone.

    A keyed Feistel network over pairs below a = ceil(sqrt(n)) permutes 0..a*a-1; a value of n or more is put through
    again until it falls below n, which keeps it a permutation of 0..n-1. Of n values at most 2 sqrt(n) + 1 are out of
    range, so a walk of more than ``WALK`` steps is all but impossible; it raises. n may be up to 2**61.
    """
    side = math.isqrt(n - 1) + 1 if n > 1 else 1
    whole = lambda c: c.cast("bigint")

    def network(v: Column) -> Column:
        state = F.struct(whole(F.call_function("div", v, F.lit(side))).alias("l"), whole(v % side).alias("r"))
        keys = F.array(*[F.struct(F.lit(s).cast("bigint").alias("s"), F.lit(f).cast("bigint").alias("f")) for s, f in round_keys(seed)])

        def turn(x: Column, key: Column) -> Column:
            shifted = (x["r"] + key["s"]) % PRIME
            mixed = (shifted * shifted % PRIME) * key["f"] % PRIME
            return F.struct(x["r"].alias("l"), whole((x["l"] + mixed) % side).alias("r"))

        done = F.aggregate(keys, state, turn)
        return done["l"] * side + done["r"]

    steps = min(side * side - n, WALK)
    walked = network(whole(index))
    if steps:
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), walked, lambda v, _: F.when(v >= n, network(v)).otherwise(v))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("the walk did not end")).cast("bigint"))


def seeded_shuffle(df: DataFrame, seed: int, index: str = "id") -> DataFrame:
    """Rows renumbered by a seeded permutation of their index, which must run from 0 without gaps.

    Each row computes its place: nothing is sorted, joined or sent to the driver, and the same rule holds at every size.
    The order is not that of Python's own shuffle with this seed.
    """
    return df.withColumn(index, permuted(F.col(index), max(df.count(), 1), seed))
