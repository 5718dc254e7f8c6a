"""Centroid clustering by sort-means, in whole numbers.

Each round orders, for each centroid, the others by their distance from it. A vector starts at the centroid that it was
assigned to last and goes through the others in that one's order; by the triangle inequality no centroid strictly
farther from the start than twice the vector's own distance to it can be as near, so the scan stops there. Entries
are whole numbers, so distances, sums and means are exact, ties go to the smaller number, and the result does not hang
on how the rows are dealt out.

The vectors with their assignments stay on the executors between rounds (persisted; a lost block is computed again from
the table); a round brings one row of sums for each centroid to the driver and sends the new centroids back, both of a
size that is the number of centroids times the width, whatever the number of rows. Sums are taken on each partition
before they are shuffled, so a cluster that holds most of the rows makes no large task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import usable, whole_numbers

#: Entries below this in size have distances that are exact in double precision, where matrix products are fast.
EXACT = 1 << 22


def orders(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the numbers of all centroids by distance from it (itself first), and the squared distances in that order."""
    k = len(centroids)
    far = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    by = np.lexsort((np.broadcast_to(np.arange(k), (k, k)), np.where(np.eye(k, dtype=bool), -1, far)), axis=1)
    return by, np.take_along_axis(far, by, axis=1)


def assign(vectors: np.ndarray, before: np.ndarray, centroids: np.ndarray, by: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each vector, scanned from its assignment ``before``."""
    exact = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT
    kind = np.float64 if exact else np.int64
    x, c = vectors.astype(kind), centroids.astype(kind)
    xx, cc = (x * x).sum(axis=1), (c * c).sum(axis=1)
    best, least = before.copy(), np.empty(len(x), dtype=kind)
    for a in np.unique(before):
        rows = np.flatnonzero(before == a)
        own = xx[rows] + cc[a] - 2 * (x[rows] @ c[a])
        least[rows] = own
        # how many of the others each vector has to see; those that see most stand first
        sees = np.searchsorted(far[a], 4 * own, side="right")
        turn = np.argsort(-sees, kind="stable")
        rows, sees = rows[turn], sees[turn]
        for at in range(1, int(sees[0])):
            open_rows = rows[: np.searchsorted(-sees, -at, side="left")]
            b = by[a, at]
            d = xx[open_rows] + cc[b] - 2 * (x[open_rows] @ c[b])
            nearer = (d < least[open_rows]) | ((d == least[open_rows]) & (b < best[open_rows]))
            best[open_rows[nearer]], least[open_rows[nearer]] = b, d[nearer]
    return best, least.astype(np.int64)


def _assigned(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows of ``state`` (id, x, cluster, distance) with the assignment to ``centroids``, each scanned from the one before."""
    shared = state.sparkSession.sparkContext.broadcast((centroids, *orders(centroids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, by, far = shared.value
        for batch in batches:
            if batch.num_rows:
                entries = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                cluster, distance = assign(entries, batch.column("cluster").to_numpy().astype(np.int64), current, by, far)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["id", "x", "cluster", "distance"])

    return state.mapInArrow(run, "id bigint, x array<bigint>, cluster int, distance bigint")


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of each cluster; an empty one keeps its centroid."""
    sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(centroids.shape[1])]).alias("sums"))
    out = centroids.copy()
    for r in sums.collect():  # one row for each centroid
        out[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return out


def cluster(vectors: DataFrame, k: int, rounds: int, dim: int, scale: int, seed: int, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(rows of id, cluster, distance; final centroids) of the vectors with ``dim`` finite entries, as whole numbers floor(scale * x).

    The first centroids are the k rows with the least lowercase hex sha256 of ``seed:id``, in that order; rows of one
    id follow each other by their entries, and equal rows are different rows, so both may be centroids, of which the
    second stays empty. Rows with a null id are never first centroids but are clustered like the others. With fewer
    than k such rows there are fewer centroids; with none, for instance for an empty table, there are no clusters and
    rows of null ids alone have a null cluster and distance. Vectors that are null, of another width, or that hold
    null or non-finite entries give no row. Other columns of the input, whatever their names, are not read.
    """
    rows = vectors.filter(usable(F.col(vector_col), dim)).select(F.col(id_col).cast("bigint").alias("id"), whole_numbers(F.col(vector_col), scale).alias("x"))
    seeds = rows.filter("id IS NOT NULL").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)).orderBy("h", "x").limit(k)
    centroids = np.array([r["x"] for r in seeds.select("h", "x").orderBy("h", "x").collect()], dtype=np.int64).reshape(-1, dim)
    if not len(centroids):
        return rows.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("bigint").alias("distance")), centroids
    state = rows.select("id", "x", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
    held = None
    for _ in range(rounds):
        state = _assigned(state, centroids).persist(StorageLevel.MEMORY_AND_DISK)
        centroids = _means(state, centroids)
        if held is not None:
            held.unpersist()
        held = state
    done = cut(_assigned(state, centroids).select("id", "cluster", "distance"))
    if held is not None:
        held.unpersist()
    return done, centroids


def report(found: DataFrame, centroids: np.ndarray, id_col: str = "vec_id") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the rows that ``cluster`` gave."""
    per = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = {r["cluster"]: r["cluster_inertia"] for r in per.collect()}  # one row for each centroid
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    total = F.lit(sum(v or 0 for v in sums.values())).cast("bigint")

    def by_cluster(values: list, kind: str):
        if not values:
            return F.lit(None).cast(kind)
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))

    return found.select(
        F.col("id").alias(id_col),
        "cluster",
        "distance",
        by_cluster([sums.get(c) for c in range(len(centroids))], "bigint").alias("cluster_inertia"),
        total.alias("inertia"),
        by_cluster(names, "string").alias("centroid_sha256"),
    )


def oracle_sql(k: int, rounds: int, dim: int, scale: int, seed: int) -> str:
    """DuckDB statement for the same rows: every distance in every round, no triangle inequality."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(CAST(e AS DOUBLE)))) = 0)""",
        f"flat AS MATERIALIZED (SELECT r, unnest(range({dim})) AS i, unnest(x) AS v FROM kept)",
        f"seeds AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), x) - 1 AS c, x FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {k})",
        f"c0 AS MATERIALIZED (SELECT c, unnest(range({dim})) AS i, unnest(x) AS v FROM seeds)",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS (SELECT r, c, sum((flat.v - c{n}.v) * (flat.v - c{n}.v)) AS d FROM flat JOIN c{n} USING (i) GROUP BY r, c)")
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{n} GROUP BY r)")
        if n < rounds:
            # floor of a division of whole numbers: // rounds towards zero
            parts.append(f"s{n} AS (SELECT c, i, sum(v) AS s, count(*) AS m FROM flat JOIN a{n} USING (r) GROUP BY c, i)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN s IS NULL THEN v ELSE (s - (((s % m) + m) % m)) // m END AS v FROM c{n} LEFT JOIN s{n} USING (c, i))")
    last = f"c{rounds}"
    return f"""WITH {", ".join(parts)},
names AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS h FROM {last} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN names USING (c)"""
