"""Robust fences from exact quantiles, and means that skip missing values."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import finite, str_or_empty

#: Relative size of the quantile sketches, and the distinct values of a bracket that may be read one by one.
ACCURACY, MOST = 10_000, 20_000


def number(c: Column) -> Column:
    """Anything as a finite double; null where that fails."""
    return finite(c.try_cast("double"))


@dataclass
class _Open:
    """A quantile that is looked for: its column, the ranks of its two order statistics, and two values that they lie between."""

    column: str
    share: float
    low: int = 0
    high: int = 0
    weight: float = 0.0
    lo: float | None = None
    hi: float | None = None
    #: values below and up to ``lo``, below and up to ``hi``
    counts: tuple[int, int, int, int] = (0, 0, 0, 0)
    found: float | None = None

    def inside(self) -> Column:
        """Values strictly between the two, or all while they are not known."""
        x = F.col(self.column)
        return x.isNotNull() if self.lo is None else (x > F.lit(self.lo)) & (x < F.lit(self.hi))

    def settle(self, at_low: float, at_high: float) -> None:
        self.found = at_low + (at_high - at_low) * self.weight


def exact_quantiles(df: DataFrame, columns: list[str], shares: tuple[float, ...] = (0.25, 0.75), accuracy: int = ACCURACY, most: int = MOST) -> dict[str, list[float | None]]:
    """Exact linear quantiles of double columns without NaN, nulls left out; None for a column without values.

    Ranks are selected, nothing is sorted. A sketch of bounded size gives values near each quantile; a second pass counts
    what lies below them, which tells for certain between which two the wanted ranks stand. More than ``most`` rows
    strictly between these are narrowed by a sketch of their own; the rest are read. Rows equal to one of the two are
    counted and never read, so ties are no load. Whatever the number of rows or of distinct values, no task and not the
    driver holds more than the sketches and ``most`` values a quantile; ``df`` is read three times as a rule.
    """
    wanted = {(c, j): _Open(c, s) for c in columns for j, s in enumerate(shares)}
    missing, known = list(wanted.values()), False
    while missing:
        marks = _marks(df, missing, accuracy, known)
        if not known:
            wanted = {k: w for k, w in wanted.items() if marks[id(w)]}
            missing, known = list(wanted.values()), True
            if not missing:
                break
        _bracket(df, missing, marks)
        for w in missing:
            if w.lo == w.hi or (w.low < w.counts[1] and w.high < w.counts[1]):
                w.settle(w.lo, w.lo)
            elif w.low >= w.counts[2]:
                w.settle(w.hi, w.hi)
            elif w.counts[2] == w.counts[1]:
                w.settle(w.lo, w.hi)
        _read(df, [w for w in missing if w.found is None and w.counts[2] - w.counts[1] <= most])
        missing = [w for w in missing if w.found is None]
    return {c: [w.found if (w := wanted.get((c, j))) else None for j in range(len(shares))] for c in columns}


def _marks(df: DataFrame, missing: list[_Open], accuracy: int, known: bool) -> dict[int, list[float]]:
    """Values near each quantile, the ends and the middle of what it is known to lie within; empty for a column without values.

    The first time this also counts each column and so sets the ranks.
    """
    near, asked = 3 / accuracy, []
    # the quantiles of one column share a sketch while they look at the same rows
    sketches: dict[tuple[str, float | None, float | None], list[_Open]] = {}
    for w in missing:
        # between ranks: the share itself while the count is unknown, then the ranks within the bracket
        inside = max(w.counts[2] - w.counts[1], 1)
        at = (w.low - w.counts[1] + 0.5) / inside, (w.high - w.counts[1] + 0.5) / inside
        edges = (at[0] - 8 * near, at[0] - near, at[1] + near, at[1] + 8 * near) if known else (w.share - near, w.share + near)
        asked.append([min(max(x, 0.0), 1.0) for x in edges])
        sketches.setdefault((w.column, w.lo, w.hi), []).append(w)
    number_of = {id(w): i for i, w in enumerate(missing)}
    aggregates = []
    for k, ws in enumerate(sketches.values()):
        x = F.when(ws[0].inside(), F.col(ws[0].column))
        aggregates += [F.count(x).alias(f"n{k}"), F.min(x).alias(f"l{k}"), F.max(x).alias(f"h{k}"), F.percentile_approx(x, [e for w in ws for e in asked[number_of[id(w)]]], accuracy).alias(f"e{k}")]
    row, out = df.agg(*aggregates).first(), {}
    for k, ws in enumerate(sketches.values()):
        n, least, most, found = (row[f"{c}{k}"] for c in "nlhe")
        for w in ws:
            mine, found = (found or [])[: len(asked[number_of[id(w)]])], (found or [])[len(asked[number_of[id(w)]]) :]
            if not known and n:
                rank = w.share * (n - 1)
                w.low = math.floor(rank)
                w.high, w.weight = min(w.low + 1, n - 1), rank - w.low
            out[id(w)] = sorted({*mine, least, most, *((w.lo, w.hi, least / 2 + most / 2) if known else ())}) if n else []
    return out


def _bracket(df: DataFrame, missing: list[_Open], marks: dict[int, list[float]]) -> None:
    """Narrow each quantile to the closest two of its marks, by exact counts below and up to each."""
    row = df.agg(*[f for i, w in enumerate(missing) for j, m in enumerate(marks[id(w)]) for f in (F.count_if(F.col(w.column) < F.lit(m)).alias(f"b{i}_{j}"), F.count_if(F.col(w.column) <= F.lit(m)).alias(f"u{i}_{j}"))]).first()
    for i, w in enumerate(missing):
        at = marks[id(w)]
        a = max(j for j in range(len(at)) if row[f"b{i}_{j}"] <= w.low)
        b = min(j for j in range(len(at)) if row[f"u{i}_{j}"] > w.high)
        w.lo, w.hi, w.counts = at[a], at[b], (row[f"b{i}_{a}"], row[f"u{i}_{a}"], row[f"b{i}_{b}"], row[f"u{i}_{b}"])


def _read(df: DataFrame, ready: list[_Open]) -> None:
    """Settle quantiles with few rows between their two values by reading these rows' values, counted by value."""
    if not ready:
        return
    each = F.array(*[F.when(w.inside(), F.struct(F.lit(i).alias("i"), F.col(w.column).alias("x"))) for i, w in enumerate(ready)])
    rows = df.select(F.explode(F.filter(each, lambda e: e.isNotNull())).alias("e")).groupBy("e.i", "e.x").agg(F.count(F.lit(1)).alias("n")).collect()
    for i, w in enumerate(ready):
        steps = [(w.lo, w.counts[1] - w.counts[0]), *sorted((r["x"], r["n"]) for r in rows if r["i"] == i), (w.hi, w.counts[3] - w.counts[2])]
        upto, held = w.counts[0], []
        for x, n in steps:
            held += [x] * ((upto <= w.low < upto + n) + (upto <= w.high < upto + n))
            upto += n
        w.settle(held[0], held[-1])


def upper_fences(df: DataFrame, wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row with a column for each (values, fallback): q3 + 1.5 iqr, or the fallback with fewer than 4 values or no spread. The quantiles are found at once; ``df`` is read several times."""
    a = df.select(*[number(x).alias(c) for c, (x, _) in wanted.items()])
    quartiles, counts = exact_quantiles(a, list(wanted)), a.agg(*[F.count(c).alias(c) for c in wanted]).first()

    def fence(c: str, fallback: float) -> float:
        q1, q3 = quartiles[c]
        return float(fallback) if counts[c] < 4 or q3 <= q1 else q3 + 1.5 * (q3 - q1)

    return df.sparkSession.range(1).select(*[F.lit(fence(c, fallback)).alias(c) for c, (_, fallback) in wanted.items()])


def upper_fence(df: DataFrame, x: Column, fallback: float) -> DataFrame:
    """One row (fence) of ``upper_fences``."""
    return upper_fences(df, {"fence": (x, fallback)})


def weighted_upper_fence(weights: DataFrame, fallback: float) -> float:
    """``upper_fence`` of values x that occur w times each, given by distinct x.

    For values such as lengths, whose distinct number is at most the root of twice the characters they count; only
    their sums go to the driver.
    """
    rows = sorted((float(r["x"]), r["w"]) for r in weights.select("x", "w").collect())
    n = sum(w for _, w in rows)
    if n < 4:
        return float(fallback)

    def at(share: float) -> float:
        rank = share * (n - 1)
        low, upto, held = math.floor(rank), 0, []
        for x, w in rows:
            held += [x] * ((upto <= low < upto + w) + (upto <= low + 1 < upto + w))
            upto += w
        return held[0] + (held[-1] - held[0]) * (rank - low)

    q1, q3 = at(0.25), at(0.75)
    return float(fallback) if q3 <= q1 else q3 + 1.5 * (q3 - q1)


def two_sided_fences(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, q1, q3, iqr, lower_fence, upper_fence: a row a column; all null for a column without values. The quantiles are found at once; ``df`` is read several times."""
    found = exact_quantiles(df.select(*[number(F.col(c)).alias(c) for c in columns]), columns)
    number_of = lambda x: F.lit(x).cast("double")
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), number_of(q1).alias("q1"), number_of(q3).alias("q3")) for c, (q1, q3) in found.items()]))
    q = df.sparkSession.range(1).select(rows.alias("r")).select("r.*").withColumn("iqr", F.col("q3") - F.col("q1"))
    return q.withColumn("lower_fence", F.col("q1") - 1.5 * F.col("iqr")).withColumn("upper_fence", F.col("q3") + 1.5 * F.col("iqr"))


def finite_mean(c: Column) -> Column:
    """Mean of the finite values; null if there are none. Booleans count as 0 and 1."""
    return F.avg(finite(c))


def accuracy(correct: Column) -> Column:
    return F.sum(correct) / F.greatest(F.count(F.lit(1)), F.lit(1))


def with_accuracy_twins(df: DataFrame, means: list[str]) -> DataFrame:
    """For each mean of an exact-match kind (EM, *_EM, exact_match) a column <name>_Acc in per cent."""
    twins = [m for m in means if m in ("EM", "exact_match") or m.endswith("_EM")]
    return df.withColumns({f"{m}_Acc": F.col(m) * 100.0 for m in twins})


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_missing, n_rows: rows whose value is null, blank or the text nan; one pass for all columns."""
    a = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(str_or_empty(F.col(c), nan_words=True) == "").alias(f"__{c}") for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__{c}").alias("n_missing"), F.col("n").alias("n_rows")) for c in columns]))
    return a.select(rows.alias("r")).select("r.*")
