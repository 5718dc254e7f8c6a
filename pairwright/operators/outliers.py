"""Property differences of pairs and two-sided outlier filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..schemas import DESCRIPTORS, require_columns


def add_deltas(pairs: DataFrame, properties: DataFrame, key: str, sides: tuple[str, str] = ("toxic_smiles", "nontoxic_smiles"), names: tuple[str, ...] = DESCRIPTORS, prefixes: tuple[str, str] = ("toxic", "nontoxic")) -> DataFrame:
    """For each property the two values, their difference and its absolute value; all four null where either is missing or not finite.

    ``properties`` has unique keys and is joined once a side.
    """
    for side, p in zip(sides, prefixes, strict=True):
        own = properties.select(F.col(key).alias("__k"), *[stats.number(F.col(c)).alias(f"__{p}_{c}") for c in names])
        pairs = pairs.join(own, F.col(side) == F.col("__k"), "left").drop("__k")
    return with_deltas(pairs, names, prefixes)


def with_deltas(pairs: DataFrame, names: tuple[str, ...], prefixes: tuple[str, str]) -> DataFrame:
    """``add_deltas`` of pairs that bring their properties as ``__<prefix>_<name>``."""
    a, b = prefixes
    made = {}
    for c in names:
        x, y = F.col(f"__{a}_{c}"), F.col(f"__{b}_{c}")
        both = x.isNotNull() & y.isNotNull()
        made |= {f"{a}_{c}": F.when(both, x), f"{b}_{c}": F.when(both, y), f"delta_{c}": F.when(both, x - y), f"delta_abs_{c}": F.when(both, F.abs(x - y))}
    return pairs.withColumns(made).drop(*[f"__{p}_{c}" for p in prefixes for c in names])


def thresholds(df: DataFrame, columns: list[str]) -> DataFrame:
    """descriptor, column, q1, q3, iqr, lower_fence, upper_fence."""
    require_columns(df, columns)
    out = stats.two_sided_fences(df, columns)
    return out.select(F.regexp_replace("column", "^delta_abs_", "").alias("descriptor"), "column", "q1", "q3", "iqr", "lower_fence", "upper_fence")


def outlier_flag(fences: str, columns: list[str]) -> Column:
    """True where a value lies outside its fences; missing values and missing fences never do. ``fences`` maps a column to (lower, upper)."""

    def out(c: str) -> Column:
        f, x = F.col(fences)[c], stats.number(F.col(c))
        return F.coalesce((x < f["lower_fence"]) | (x > f["upper_fence"]), F.lit(False))

    return reduce(lambda a, b: a | b, [out(c) for c in columns], F.lit(False))


def flag_outliers(df: DataFrame, columns: list[str], out: str = "is_outlier") -> DataFrame:
    """Adds the flag that parts kept rows from dropped ones; one pass for the fences, which return as a single row."""
    fences = thresholds(df, columns).agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("lower_fence", "upper_fence")))).alias("__f"))
    return df.crossJoin(F.broadcast(fences)).withColumn(out, outlier_flag("__f", columns)).drop("__f")


def split_outliers(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped)."""
    flagged = flag_outliers(df, columns, "__out")
    return flagged.filter(~F.col("__out")).drop("__out"), flagged.filter("__out").drop("__out")
