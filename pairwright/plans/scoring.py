"""Scores of predictions and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..operators.lookup import latest, positional

#: Metric names.
TASK3 = ("exact_match", "bleu", "levenshtein", "rdk_fts", "maccs_fts", "morgan_fts", "validity", "prs_property_score")
#: Metrics by task and step.
METRICS = {
    "task1": {"single_step": ("fragment_EM",), "multi_step": ("fragment_EM", "fragment_F1")},
    "task2": {"single_step": ("fragment_EM", "fragment_Levenshtein"), "multi_step": ("fragment_EM", "fragment_Levenshtein", "fragment_F1")},
    **{t: {"single_step": TASK3, "multi_step": TASK3} for t in ("task3", "task3_nontoxic_safe_generation", "task3_stepwise_cot_safe_generation")},
}


def metric_keys(task: str, step: str) -> tuple[str, ...]:
    if task not in METRICS or step not in METRICS[task]:
        raise ValueError(f"no metrics of {task!r}, {step!r}")
    return METRICS[task][step]


def fragment_scores(gold: Column, pred: Column) -> dict[str, Column]:
    """fragment_EM (gold not blank and equal as multisets), fragment_F1 (of sets), fragment_Levenshtein."""
    g, p = T.scoring_tokens(gold), T.scoring_tokens(pred)
    em = F.when(T.str_or_empty(gold) == "", 0.0).otherwise(T.multiset_equal(g, p).cast("double"))
    return {"fragment_EM": em, "fragment_F1": T.set_scores(g, p)["f1"], "fragment_Levenshtein": T.fragment_edit_mean(gold, pred)}


def molecule_scores(df: DataFrame, gold: str, pred: str, backend, decode: bool = False, toxic: str | None = None) -> DataFrame:
    """Adds the eight metrics of molecule tasks. Chemistry runs once for each distinct text, and its results are joined back.

    ``decode``: both texts are SAFE and are decoded first. ``toxic`` names the SMILES that property retention is
    measured against; missing values score 0, as do distances and similarities of texts that don't parse.
    """
    from ..chem.base import describe

    keys = [gold, pred] + ([toxic] if toxic else [])
    texts = df.select(F.explode(F.array(*[F.coalesce(F.col(k), F.lit("")) for k in keys])).alias("__x")).distinct()
    facts = describe(texts, "__x", backend, decode=decode)
    out = df
    for k in keys:
        out = out.join(facts.select(F.col("__x").alias(f"__j_{k}"), F.struct(*[c for c in facts.columns if c != "__x"]).alias(f"__{k}")), F.coalesce(F.col(k), F.lit("")) == F.col(f"__j_{k}"), "left").drop(f"__j_{k}")
    g, p = F.col(f"__{gold}"), F.col(f"__{pred}")
    both = F.coalesce(g["valid"] & p["valid"], F.lit(False))
    near = lambda c: F.coalesce(F.when(both, T.bitmap_tanimoto(g[c], p[c])), F.lit(0.0))
    score = {
        "exact_match": F.when(both, (g["canonical"] == p["canonical"]).cast("double")).otherwise(0.0),
        "bleu": F.when(both, T.unigram_precision(g["canonical"], p["canonical"])).otherwise(0.0),
        "levenshtein": F.when(both, F.levenshtein(g["canonical"], p["canonical"]).cast("double")).otherwise(0.0),
        "rdk_fts": near("path_fp"),
        "maccs_fts": near("key_fp"),
        "morgan_fts": near("circular_fp"),
        "validity": F.coalesce(p["valid"], F.lit(False)).cast("double"),
        "prs_property_score": T.prs(F.col(f"__{toxic}")["qed6"], p["qed6"]) if toxic else F.lit(0.0),
    }
    return out.withColumns(score).drop(*[f"__{k}" for k in keys])


def safe_validity(df: DataFrame, column: str, backend, out: str = "validity") -> DataFrame:
    """Adds 1.0 where a SAFE text decodes to a molecule, else 0.0; each distinct text is decoded once."""
    from ..chem.base import describe

    text = F.coalesce(F.col(column), F.lit(""))
    facts = describe(df.select(text.alias("__x")).distinct(), "__x", backend, decode=True).select("__x", "valid")
    return df.join(facts, text == F.col("__x"), "left").withColumn(out, F.coalesce(F.col("valid"), F.lit(False)).cast("double")).drop("__x", "valid")


def score_predictions(predictions: DataFrame, task: str, step: str, backend=None, rows: DataFrame | None = None) -> DataFrame:
    """Adds the metrics of a task: gold and pred may be JSON objects with ``answer`` or bare text. ``rows`` is the split's pair table by row_idx."""
    df = predictions.withColumn("__g", T.extract_answer(F.col("gold"))).withColumn("__p", T.extract_answer(F.col("pred")))
    keys = metric_keys(task, step)
    if task in ("task1", "task2"):
        made = fragment_scores(F.col("__g"), F.col("__p"))
        df = df.withColumns({k: made[k] for k in keys})
    else:
        toxic = None
        if rows is not None:
            df, toxic = positional(df, rows.select("row_idx", F.col("toxic_smiles").alias("__toxic"))), "__toxic"
        df = molecule_scores(df, "__g", "__p", backend, decode=task != "task3", toxic=toxic)
    return df.withColumn("correct", T.exact_match(F.col("__g"), F.col("__p"))).drop("__g", "__p", "__toxic")


def rescore(stored: DataFrame, scored: DataFrame, keys: tuple[str, ...], ident: str = "id") -> DataFrame:
    """Stored metrics where a row has all of them, else the new ones, all at once."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & (F.col(f"s.{k}").isNotNull() if k in stored.columns else F.lit(False))
    joined = scored.alias("n").join(stored.alias("s"), ident)
    pick = lambda k: F.when(whole, F.col(f"s.{k}")).otherwise(F.col(f"n.{k}")) if k in stored.columns else F.col(f"n.{k}")
    return joined.select(ident, *[f"n.{c}" for c in scored.columns if c != ident and c not in keys], *[pick(k).alias(k) for k in keys])


def summarize(scored: DataFrame, keys: tuple[str, ...], by: tuple[str, ...] = ("task", "step", "split", "model", "variant"), order: str | None = None) -> DataFrame:
    """total, correct, accuracy and the finite mean of each metric, with twins in per cent for exact matches.

    With ``order`` only the last prediction of each id counts.
    """
    df = latest(scored, order) if order else scored
    own = [c for c in by if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("total"), F.sum("correct").alias("correct"), stats.accuracy(F.col("correct")).alias("accuracy"), *[stats.finite_mean(F.col(k)).alias(k) for k in keys]]
    out = df.groupBy(*own).agg(*aggs) if own else df.agg(*aggs)
    return stats.with_accuracy_twins(out, list(keys))


def summary_record(summary: DataFrame, keys: tuple[str, ...], seconds: float, path: str) -> DataFrame:
    """One object a summary row: means as a map, and the run's timings."""
    names = [*keys, *[f"{k}_Acc" for k in keys if f"{k}_Acc" in summary.columns]]
    pairs = [x for k in names for x in (F.lit(k), F.col(k))]
    out = summary.withColumn("metrics_mean", F.create_map(*pairs)).drop(*names)
    n = F.greatest(F.col("total"), F.lit(1))
    return out.withColumns({"inference_time_seconds": F.round(F.lit(seconds), 3), "inference_samples": F.col("total"), "inference_seconds_per_sample": F.round(F.lit(seconds) / n, 6), "predictions_path": F.lit(path)})
