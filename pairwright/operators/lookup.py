"""Dimension lookups: maps by the last row, two-level fallback, positions, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import str_or_empty


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, value: the value of the last row of each key that is neither blank nor the text nan."""
    k = str_or_empty(F.col(key), nan_words=True)
    return df.select(k.alias(key), F.col(value).alias(value), F.col(order).alias("__o")).filter(F.col(key) != "").groupBy(key).agg(F.max_by(value, "__o").alias(value))


def fallback_lookup(df: DataFrame, text: str, canonical: Column, exact_map: DataFrame, canonical_map: DataFrame, out: str) -> DataFrame:
    """Adds ``out``: the value under the text itself; only where that key is absent, the one under the canonical text; else ''.

    Both maps are (key, value) with unique keys. An empty value under the text doesn't fall through.
    """
    a = exact_map.toDF("__ka", "__va")
    b = canonical_map.toDF("__kb", "__vb")
    joined = df.withColumn("__canonical", canonical).join(a, F.col(text) == F.col("__ka"), "left").join(b, F.col("__canonical") == F.col("__kb"), "left")
    value = F.when(F.col("__ka").isNotNull(), F.coalesce("__va", F.lit(""))).otherwise(F.coalesce("__vb", F.lit("")))
    return joined.withColumn(out, value).drop("__canonical", "__ka", "__va", "__kb", "__vb")


def distinct_keys(df: DataFrame, columns: list[str], out: str = "key") -> DataFrame:
    """Distinct stripped values of several columns, without blanks and the text nan."""
    values = F.explode(F.array(*[str_or_empty(F.col(c), nan_words=True) for c in columns]))
    return df.select(values.alias(out)).filter(F.col(out) != "").distinct()


def missing_only(keys: DataFrame, key: str, known: DataFrame, value: str) -> DataFrame:
    """Keys that have no non-blank value in ``known`` yet."""
    return keys.join(known.filter(str_or_empty(F.col(value)) != "").select(key), key, "left_anti")


def encode_missing(keys: DataFrame, key: str, known: DataFrame, value: str, encoder) -> DataFrame:
    """key, value of all keys: known values first, others by ``encoder`` (a function of a column) once for each distinct key."""
    have = known.filter(str_or_empty(F.col(value)) != "").select(key, value).join(keys.select(key), key, "left_semi")
    new = missing_only(keys, key, known, value).select(key, F.coalesce(encoder(F.col(key)), F.lit("")).alias(value))
    return have.unionByName(new)


def positional(df: DataFrame, rows: DataFrame, row_idx: str = "row_idx", source: str = "source_index", ident: str = "id") -> DataFrame:
    """Left join by position: source_index, or the id where that is null; no match where neither is in range."""
    at = F.coalesce(F.col(source), F.col(ident)) if source in df.columns else F.col(ident)
    return df.withColumn("__at", at.cast("bigint")).join(rows.withColumnRenamed(row_idx, "__row"), F.col("__at") == F.col("__row"), "left").drop("__at", "__row")


def done_ids(predictions: DataFrame) -> DataFrame:
    """Ids with a prediction that is neither blank nor an error."""
    pred, raw = str_or_empty(F.col("pred")), str_or_empty(F.col("raw")) if "raw" in predictions.columns else F.lit("")
    return predictions.filter((pred != "") & ~pred.startswith("ERROR:") & ~raw.startswith("ERROR:")).select("id").distinct()


def resume(questions: DataFrame, predictions: DataFrame) -> DataFrame:
    return questions.join(done_ids(predictions), "id", "left_anti")


def latest(predictions: DataFrame, order: str, ident: str = "id") -> DataFrame:
    """The last prediction of each id."""
    return predictions.groupBy(ident).agg(F.max_by(F.struct(*[c for c in predictions.columns if c != ident]), order).alias("r")).select(ident, "r.*")
