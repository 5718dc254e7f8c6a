"""Scoring of prediction files as they arrive: the batch expressions on a stream of JSON Lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.scoring import metric_keys, score_predictions, summarize

SCHEMA = "model string, task string, step string, id bigint, dataset_name string, endpoint string, source_index bigint, gold string, pred string, raw string"


def prediction_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(folder)


def score_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, task: str, step: str) -> StreamingQuery:
    """Append scored rows of all files that are there, then stop; the next call goes on from the checkpoint. Fragment tasks only."""
    if not task.startswith(("task1", "task2")):
        raise ValueError("molecule tasks need a batch: chemistry runs on distinct texts")
    scored = score_predictions(prediction_stream(spark, folder), task, step)
    return scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summary_of(spark: SparkSession, out: str, task: str, step: str) -> DataFrame:
    return summarize(spark.read.parquet(out), metric_keys(task, step), by=("task", "step", "model"))
