"""Every query with a DuckDB statement gives the same rows as that statement."""

import os

import __spark_entry__
import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{data}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def same(x, y):
    return len(x) == len(y) and all(abs(a - b) <= 1e-9 * max(1, abs(a)) if isinstance(a, float) and isinstance(b, float) else a == b for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n in __spark_entry__.own.queries()))
def test_query(spark, data, duck, name):
    df = __spark_entry__.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    want = sorted(duck.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({__spark_entry__.oracle_sql()[name]})").fetchall(), key=repr)
    assert len(got) == len(want)
    assert all(same(a, b) for a, b in zip(want, got, strict=True))


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"dataset_name", "endpoint", "toxic_smiles", "nontoxic_smiles", "toxic_safe", "nontoxic_safe", "common_safe_fragments", "only_toxic_safe_fragments", "only_nontoxic_safe_fragments"}
