"""Clustering and whitening of embeddings against brute force, and their edges."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm import registry, sort_means, whitening

ODD = [
    (None, [1.0, 2.0], "a"),
    (7, None, "b"),
    (8, [1.0, None], "c"),
    (9, [float("nan"), 1.0], "d"),
    (10, [float("inf"), 1.0], "e"),
    (11, [1.0], "f"),
    (12, [], "g"),
    (13, [1.0, 2.0, 3.0], "h"),
    (1, [0.5, -0.5], "i"),
    (1, [0.5, -0.5], "i"),
    (1, [0.25, 4.0], "j"),
    (2, [-3.0, 1e30], "k"),
]
SCHEMA = "vec_id bigint, embedding array<float>, cluster string"


def plain_clusters(rows, k, rounds, scale, seed):
    """Brute force in whole numbers of Python: rows of (id, vector)."""
    rows = [(i, [min(max(math.floor(scale * x), -(1 << 27)), 1 << 27) for x in v]) for i, v in rows]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)[:k]
    centroids = [v for _, v in first]
    for n in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in rows]
        if n < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, c) in zip(rows, near, strict=True) if c == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(rows, near, strict=True)), key=repr), centroids


def test_scan_sees_every_nearest_centroid():
    rng = np.random.default_rng(3)
    for span in (3, 200, 1 << 25):  # small spans make ties
        x, c = rng.integers(-span, span, (500, 6)), rng.integers(-span, span, (20, 6))
        c[5] = c[2]
        far = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        best, least = sort_means.assign(x, rng.integers(0, 20, 500), c, *sort_means.orders(c))
        assert (best == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()


def test_clusters_query_equals_its_sql(spark, data):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    got = registry.op11_sort_means(spark, data)
    want = duck.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()['op11_sort_means']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_clusters_of_odd_rows(spark):
    """Null ids and vectors, other widths, non-finite and huge entries, repeated ids and rows, a clashing column."""
    df = spark.createDataFrame(ODD, SCHEMA)
    kept = [(i, v) for i, v, _ in ODD if v is not None and len(v) == 2 and all(x is not None and math.isfinite(x) for x in v)]
    for k, rounds in ((1, 2), (3, 3), (40, 5), (2, 0)):
        found, centroids = sort_means.cluster(df, k, rounds, dim=2, scale=256, seed=2)
        rows, want = plain_clusters(kept, k, rounds, 256, 2)
        assert sorted(((r["id"], r["cluster"], r["distance"]) for r in found.collect()), key=repr) == rows
        assert centroids.tolist() == want
    out = sort_means.report(found, centroids).collect()
    assert sum(r["distance"] for r in out) == out[0]["inertia"]
    assert {r["centroid_sha256"] for r in out} <= {hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in want}


def test_clusters_without_rows_or_ids(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    assert sort_means.report(*sort_means.cluster(df.limit(0), 40, 5, 2, 256, 2)).count() == 0
    alone = sort_means.report(*sort_means.cluster(df.filter("vec_id IS NULL"), 40, 5, 2, 256, 2)).collect()
    assert [(r["vec_id"], r["cluster"], r["centroid_sha256"], r["inertia"]) for r in alone] == [(None, None, None, 0)]


def brute_whitening(vectors, scale, shift, most):
    x = np.clip(np.floor(scale * np.array(vectors, dtype=np.float64)), -(1 << 27), 1 << 27).astype(np.int64) + shift
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = (n * distinct - sums) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    return n, ((n * x - sums) ** 2).sum(axis=1), ((n * x - sums) / n) @ u[:, :most] / np.sqrt(e[:most]), e[:most] / e.sum()


def test_jacobi_keeps_small_values():
    """Singular values over 14 orders of magnitude, each to nearly full precision; components orthonormal."""
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    want = 10.0 ** -np.arange(0, 18, 2)
    v, s = whitening.jacobi(np.diag(want) @ q.T)
    assert np.abs(s / want - 1).max() < 1e-12
    assert np.abs(v.T @ v - np.eye(9)).max() < 1e-13 and np.abs(np.abs(v.T @ q) - np.eye(9)).max() < 1e-12


def test_whitening_query(spark, data):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    n, deviation, white, explained = brute_whitening([rows[i] for i in sorted(rows)], 64, 1_000_000, 16)
    got = registry.op13_whitening(spark, data).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 16 * len(rows) and set(got["n"]) == {n}
    assert (got["deviation"].to_numpy().reshape(-1, 16) == deviation[:, None]).all()
    mine = got["whitened"].to_numpy().reshape(-1, 16)
    assert np.abs(mine * np.sign((mine * white).sum(axis=0)) - white).max() < 1e-9
    assert np.abs(got["explained"].to_numpy().reshape(-1, 16) / explained - 1).max() < 1e-9
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9


def test_factors_meet_in_groups(spark, monkeypatch):
    """Many partitions and a small fan give the same singular values as one block."""
    monkeypatch.setattr(whitening, "FAN", 3)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 4)).round(2).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>").repartition(17)
    distinct = whitening.distinct_rows(df, 4, 64, 1000).repartition(17).cache()
    x = np.array([r["x"] for r in distinct.collect()])
    r = whitening.triangular_factor(distinct, len(x), x.sum(axis=0).tolist())
    assert np.allclose(np.linalg.svd(r)[1], np.linalg.svd(x - x.mean(axis=0))[1], rtol=1e-12)


def test_whitening_of_odd_rows(spark):
    """Null ids and vectors, other widths, non-finite and huge entries, repeated rows, a clashing column, few and no rows."""
    df = spark.createDataFrame(ODD, SCHEMA).withColumn("component", F.lit("x"))
    kept = [v for _, v, _ in ODD if v is not None and len(v) == 2 and all(x is not None and math.isfinite(x) for x in v)]
    n, deviation, white, _ = brute_whitening(kept, 64, 5, 2)
    got = whitening.whiten(df, 2, 64, 5, 16).collect()
    assert len(got) == 2 * len(kept) and {r["n"] for r in got} == {n} and sorted(r["deviation"] for r in got) == sorted(deviation.tolist() * 2)
    first = sorted(abs(r["whitened"]) for r in got if r["component"] == 1)
    assert np.allclose(first, sorted(np.abs(white[:, 0])), rtol=1e-6)
    one = whitening.whiten(df.filter("cluster = 'i'"), 2, 64, 5, 16).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, 0.0, None)] * 4
    assert whitening.whiten(df.limit(0), 2, 64, 5, 16).count() == 0


def test_a_deviation_beyond_64_bits_is_null(spark):
    df = spark.createDataFrame([(i, [float(i % 2 * 2**40), float(i)]) for i in range(20)], "vec_id bigint, embedding array<double>")
    got = whitening.whiten(df, 2, 64, 0, 2)
    assert got.filter("deviation < 10 * 10 * POWER(2, 54) OR deviation IS NULL").isEmpty()  # each is off the mean by half of 2**27
    far = spark.createDataFrame([(i, [float((i % 2 * 2 - 1) * 2**40), float(i)]) for i in range(64)], "vec_id bigint, embedding array<double>")
    assert whitening.whiten(far, 2, 64, 0, 2).filter("deviation IS NULL").count() == 128


@pytest.mark.parametrize("entries", [[1.5, -0.01, 0.0], [-1e300, 1e300, 3.0]])
def test_whole_numbers_are_floors(spark, entries):
    from pairwright.llm.vectors import BOUND, whole_numbers

    row = spark.createDataFrame([(entries,)], "v array<double>").select(whole_numbers(F.col("v"), 256, 7).alias("x")).first()
    assert row["x"] == [min(max(math.floor(256 * e), -BOUND), BOUND) + 7 for e in entries]
