"""Embedding whitening by a one-sided Jacobi SVD.

Entries become whole numbers, so the mean is exact: the centred rows are (n * x - S) / n with n and S counted by Spark.
Each partition of the distinct rows is compressed to its triangular factor, a block of rows at a time (QR of the factor
so far over the next block), and the factors are compressed in groups until one is left: a tall-skinny QR whose records are
as wide as a vector whatever the number of rows. Plane rotations then make the columns of that factor orthogonal, pair by
pair, until no pair is left that rounding can tell from orthogonal; the rotations' product holds the components, and the column lengths
are the singular values, of which small ones are as exact as large ones, as no product matrix was formed. A last pass
projects every row, and the covariance of the projections is measured against the identity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import usable, whole_numbers

#: Rows that meet in one QR, and factors that meet in one group.
BLOCK, FAN = 4096, 64


def _entries(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _factor(rows: np.ndarray) -> np.ndarray:
    """Square triangular factor of rows; few rows are filled up with zeros."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))]) if len(r) < rows.shape[1] else r


def folded(rows: DataFrame, first: Callable[[Iterator[pa.RecordBatch]], np.ndarray], join: Callable[[np.ndarray, np.ndarray], np.ndarray], empty: np.ndarray) -> np.ndarray:
    """One array of a fixed size: ``first`` makes one of each partition's batches, and ``join`` joins two of them.

    Partitions' arrays are joined in groups of ``FAN``, and what is left again, so that no task and not the driver holds more than a group.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([first(batches).tobytes()], type=pa.binary())], names=["state"])

    def merge(group: pa.Table) -> pa.Table:
        states = [np.frombuffer(x).reshape(empty.shape) for x in group.column("state").to_pylist()]
        return pa.table({"part": group.column("part")[:1], "state": pa.array([reduce(join, states, empty).tobytes()], type=pa.binary())})

    states = cut(rows.mapInArrow(one, "state binary").withColumn("part", F.spark_partition_id()))
    # one state a partition, numbered by it: each pass leaves one of FAN
    parts = (states.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        states = states.select(F.floor(F.col("part") / FAN).cast("int").alias("part"), "state").groupBy("part").applyInArrow(merge, "part int, state binary")
        parts = -(-parts // FAN)
    found = states.select("state").collect()  # one
    return reduce(join, [np.frombuffer(r["state"]).reshape(empty.shape) for r in found], empty)


def triangular_factor(distinct: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows of ``distinct`` (x array<bigint>): rows = Q R with orthonormal Q, up to signs."""
    dim, total = len(sums), np.array(sums, dtype=np.int64)

    def compress(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        r = np.zeros((dim, dim))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                centred = (n * _entries(batch.slice(at, BLOCK)) - total) / n
                r = _factor(np.vstack([r, centred]))
        return r

    return folded(distinct.select("x"), compress, lambda a, b: _factor(np.vstack([a, b])), np.zeros((dim, dim)))


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(components as columns, singular values) of a square matrix by falling value: one-sided Jacobi.

    A rotation is made wherever two columns' product is more than rounding leaves of it. Columns are kept by falling
    length, which lets the last sweeps find nothing to turn.
    """
    a, v, dim = r.copy(), np.eye(r.shape[1]), r.shape[1]
    tiny = np.finfo(float).eps * np.sqrt(dim)
    for _ in range(sweeps):
        turned = False
        order = np.argsort(-np.linalg.norm(a, axis=0), kind="stable")
        a, v = a[:, order], v[:, order]
        for p in range(dim - 1):
            for q in range(p + 1, dim):
                pp, qq, pq = a[:, p] @ a[:, p], a[:, q] @ a[:, q], a[:, p] @ a[:, q]
                if abs(pq) <= tiny * np.sqrt(pp) * np.sqrt(qq):
                    continue
                turned = True
                tau = (qq - pp) / (2 * pq)
                t = (1.0 if tau >= 0 else -1.0) / (abs(tau) + np.hypot(1.0, tau))
                cos = 1 / np.hypot(1.0, t)
                turn = np.array([[cos, t * cos], [-t * cos, cos]])
                a[:, [p, q]], v[:, [p, q]] = a[:, [p, q]] @ turn, v[:, [p, q]] @ turn
        if not turned:
            break
    length = np.linalg.norm(a, axis=0)
    order = np.argsort(-length, kind="stable")
    v = v[:, order]
    return v / np.linalg.norm(v, axis=0), length[order]


class Whitening:
    """Mean, components and deviations of a fit: n rows with sums, components as columns, singular values."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, singular: np.ndarray):
        self.n, self.sums, self.components, self.singular = n, sums, components, singular

    @property
    def rank(self) -> int:
        """Components with a variance that rounding can tell from none."""
        if not len(self.singular) or not self.singular[0]:
            return 0
        return int((self.singular > self.singular[0] * len(self.singular) * np.finfo(float).eps).sum())

    @property
    def deviations(self) -> np.ndarray:
        """Standard deviation along each component (divisor n)."""
        return self.singular / np.sqrt(max(self.n, 1))

    @property
    def explained(self) -> np.ndarray:
        """Each component's share of the whole variance; zeros where there is none."""
        square = (self.singular / self.singular[0]) ** 2 if self.rank else np.zeros(len(self.singular))
        return square / square.sum() if self.rank else square


def distinct_rows(vectors: DataFrame, dim: int, scale: int, shift: int, vector_col: str = "embedding") -> DataFrame:
    """x of each distinct usable vector, written to the checkpoint folder. Copies are told by whole vectors, and reduced before the shuffle."""
    rows = vectors.filter(usable(F.col(vector_col), dim)).select(whole_numbers(F.col(vector_col), scale, shift).alias("x"))
    return cut(rows.distinct())


def fit(distinct: DataFrame, dim: int) -> Whitening:
    """Whitening of the rows of ``distinct`` (x array<bigint>), each of which counts once. No rows give n = 0 and no variance."""
    row = distinct.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(dim)]).first()
    n, sums = row["n"], [row[f"s{i}"] or 0 for i in range(dim)]
    if not n:
        return Whitening(0, sums, np.eye(dim), np.zeros(dim))
    components, singular = jacobi(triangular_factor(distinct, n, sums))
    return Whitening(n, sums, components, singular)


def project(rows: DataFrame, model: Whitening, most: int) -> DataFrame:
    """The columns of ``rows`` but x, then deviation bigint and whitened array<double> with ``most`` entries (fewer if the vectors are narrower).

    ``deviation`` is the sum of (n * x - S)**2, exact, and null where it is too large for a bigint. A component without variance is null in ``whitened``.
    """
    n, total, most = model.n, np.array(model.sums, dtype=np.int64), min(most, len(model.sums))
    used = min(most, model.rank)
    with np.errstate(all="ignore"):
        matrix = model.components[:, :used] / model.deviations[:used]
    shared = rows.sparkSession.sparkContext.broadcast(matrix)
    kept = [f for f in rows.schema.fields if f.name != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                off = n * _entries(part) - total
                # squares wrap around beyond 64 bits, and are right wherever the true sum fits
                fits = (off.astype(np.float64) ** 2).sum(axis=1) < 2.0**63 * (1 - 1e-9)
                white = (off / max(n, 1)) @ shared.value
                padded = np.hstack([white, np.zeros((len(white), most - used))]).ravel()
                values = pa.array(padded, mask=np.tile(np.arange(most) >= used, len(white)))
                starts = pa.array(np.arange(len(white) + 1, dtype=np.int32) * most)
                columns = [part.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array((off * off).sum(axis=1), mask=~fits), pa.ListArray.from_arrays(starts, values)], names=[*(f.name for f in kept), "deviation", "whitened"])

    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return rows.mapInArrow(run, ddl + "deviation bigint, whitened array<double>")


def moments(white: np.ndarray) -> np.ndarray:
    """[n, mean, products of the centred rows] of a block, in one row a dimension: columns n, mean, products."""
    mean = white.mean(axis=0) if len(white) else np.zeros(white.shape[1])
    off = white - mean
    return np.hstack([np.full((white.shape[1], 1), float(len(white))), mean[:, None], off.T @ off])


def joined_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two blocks together: their own products, and that of the distance of their means."""
    n = a[0, 0] + b[0, 0]
    if not n:
        return a
    far = b[:, 1] - a[:, 1]
    mean = a[:, 1] + far * (b[0, 0] / n)
    return np.hstack([np.full((len(a), 1), n), mean[:, None], a[:, 2:] + b[:, 2:] + np.outer(far, far) * (a[0, 0] * b[0, 0] / n)])


def identity_error(distinct: DataFrame, model: Whitening, used: int) -> float | None:
    """Largest absolute entry of the covariance of the first ``used`` whitened entries of ``distinct`` minus the identity; None without components.

    The covariance is measured on the projected rows, each block centred by its own mean before it multiplies.
    """
    if not used:
        return None
    white = project(distinct, model, used)

    def measure(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        blocks = (batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, used) for batch in batches)
        return reduce(joined_moments, map(moments, blocks), np.zeros((used, used + 2)))

    found = folded(white.select("whitened"), measure, joined_moments, np.zeros((used, used + 2)))
    return float(np.abs(found[:, 2:] / found[0, 0] - np.eye(used)).max())


def whiten(vectors: DataFrame, dim: int, scale: int, shift: int, most: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component up to ``most``.

    Usable vectors have ``dim`` entries of which none is null or non-finite; others give no row. Repeated rows each give their
    rows but count once in the fit; null ids stay null. A component without variance (fewer distinct vectors than
    components, entries that never differ) has a null ``whitened`` and explains 0; ``identity_error`` is over the components
    with variance, null without any. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    distinct = distinct_rows(vectors, dim, scale, shift, vector_col)
    model = fit(distinct, dim)
    most = min(most, dim)
    used = min(most, model.rank)
    error = identity_error(distinct, model, used)
    rows = vectors.filter(usable(F.col(vector_col), dim)).select(F.col(id_col).cast("bigint").alias("id"), whole_numbers(F.col(vector_col), scale, shift).alias("x"))
    shares = F.array(*[F.lit(float(e)) for e in model.explained[:most]])
    out = project(rows, model, most).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        F.col("id").alias(id_col),
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
