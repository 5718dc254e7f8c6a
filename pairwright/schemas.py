"""Schemas of the stages, column checks and row numbers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = "dataset_name string, endpoint string, toxic_smiles string, nontoxic_smiles string"
PAIRS_SAFE = PAIRS + ", toxic_safe string, nontoxic_safe string"
#: Columns of the stages' tables, and descriptors.
COMPARED_COLUMNS = (
    "dataset_name", "endpoint", "toxic_smiles", "nontoxic_smiles", "toxic_safe", "nontoxic_safe", "toxic_safe_fragments", "nontoxic_safe_fragments", "common_safe_fragments", "only_toxic_safe_fragments",
    "only_nontoxic_safe_fragments", "n_common_safe", "n_only_toxic_safe", "n_only_nontoxic_safe", "has_safe_diff", "unique_safe",
)
FINAL_COLUMNS = (
    "dataset_name", "endpoint", "toxic_smiles", "nontoxic_smiles", "toxic_safe", "nontoxic_safe", "common_safe_fragments", "only_toxic_safe_fragments", "only_nontoxic_safe_fragments",
)
DESCRIPTORS = ("MW", "logP", "TPSA", "HBD", "HBA", "RotB")


def require_columns(df: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """The frame itself; an error that names each missing column otherwise."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def project(df: DataFrame, columns: tuple[str, ...], tolerant: bool = False) -> DataFrame:
    """Columns in a fixed order; a tolerant projection leaves out those that are not there."""
    if not tolerant:
        require_columns(df, columns)
    return df.select(*[c for c in columns if c in df.columns])


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; on a local master it may be unset, and a temporary folder takes its place."""
    if (folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-", dir=os.environ.get("TMPDIR"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def with_row_index(df: DataFrame, order: list[str] | None = None, name: str = "row_idx") -> DataFrame:
    """Row numbers from 0 in the order given, or in read order.

    Rows are numbered inside each partition and shifted by the sizes of the partitions before it, so no task sees
    more than its own rows. A given order is a distributed sort; as a second run of it could part the rows
    elsewhere, partitions and numbers are written once.
    """
    from pyspark.sql import Window

    own = df.orderBy(*order) if order else df
    own = cut(own.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = own.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    return own.join(F.broadcast(sizes.select("__p", before.alias("__before"))), "__p").withColumn(name, F.col("__before") + F.col("__i")).drop("__p", "__i", "__n", "__before")
