"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of a data folder; Spark alone opens the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str) -> Column:
    """A text column in which null counts as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only on a local master may that be unset; a temporary folder takes its place there."""
    if (folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-", dir=os.environ.get("TMPDIR"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: a lineage of one step, and sizes that later joins can trust.

    For loops that join what they wrote before: a checkpoint keeps the plan's estimated size, which each join multiplies.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What this worker process remembers from task to task, by the operator that it belongs to.
_REMEMBERED: dict = {}


def remembered(owner: str, make: Callable):
    """What ``make`` has built for ``owner`` in this worker. It goes when another owner asks, so a worker that runs operator after operator holds what one of them remembers."""
    if owner not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[owner] = make()
    return _REMEMBERED[owner]


def arrow_map(df: DataFrame, fn: Callable[..., Iterator[dict] | dict], schema: str, rows: int = 1024) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows.

    ``fn`` gets one list per input column and returns a dict of output columns (lists or arrays), or yields such dicts.
    """

    def run(batches):
        types = None
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = fn(*(c.to_pylist() for c in part.columns))
                for out in [made] if isinstance(made, dict) else made:
                    types = types or arrow_schema(schema)
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in types], schema=types)

    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a flat DDL string of the types that the operators return."""
    kinds = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.strip().split(" ", 1) for x in ddl.split(","))])


def held_out(doc_id: Column) -> Column:
    """True for rows that no classifier may learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def spread(df: DataFrame, key: Column, n: int) -> DataFrame:
    """At most ``n`` rows, the same ones each time: those with the least hash of ``key``. A bounded sample for fitting."""
    return df.orderBy(F.xxhash64(key), key).limit(n)
