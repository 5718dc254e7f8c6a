"""Whole-number vectors shared by the operators on embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole-number entries end here on either side, so that sums of 2**36 rows and squared distances of wide vectors stay exact in 64 bits.
BOUND = 1 << 27


def usable(vector: Column, dim: int) -> Column:
    """True for vectors of exactly ``dim`` entries of which none is null, NaN or infinite; never null."""
    values = vector.cast("array<double>")
    finite = F.forall(values, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.coalesce((F.size(values) == dim) & finite, F.lit(False))


def whole_numbers(vector: Column, scale: int, shift: int = 0) -> Column:
    """array<bigint>: floor(scale * x) + shift of each entry as a double; products beyond ``BOUND`` are taken as that bound."""
    bound = float(BOUND)
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(F.least(F.greatest(x * F.lit(float(scale)), F.lit(-bound)), F.lit(bound))) + F.lit(shift).cast("bigint"))
