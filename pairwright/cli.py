"""Command line: thin wrappers around the plans."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chem.base import describe, load_backend
from .operators import fragments, outliers, similarity, split
from .plans import cliffs, inference, qa, scoring
from .schemas import DESCRIPTORS, cut
from .sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pairwright")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [c := sub.add_parser(name), *[c.add_argument(a, **k) for a, k in args]][0]
    io = [("--input", {"required": True}), ("--output", {"required": True}), ("--backend", {"default": "auto"})]
    add("pair", *io, ("--no-canonicalize", {"action": "store_true"}), ("--summary", {}), ("--scores", {"help": "folder for the scores of all pairs of each group, for small groups"}))
    add("attach-safe", *io, ("--mapping", {}))
    add("compare-safe", *io)
    add("filter-safe", *io, ("--fixed-thresholds", {"action": "store_true"}), ("--fallback-length", {"type": int, "default": 28}), ("--fallback-count", {"type": int, "default": 4}))
    add("property-delta", *io)
    add("drop-outliers", *io, ("--descriptors", {"default": ",".join(DESCRIPTORS)}))
    add("safe-pipeline", *io, ("--mapping", {}), ("--skip-outliers", {"action": "store_true"}))
    add("split", *io, ("--smiles-col", {}))
    routes = [(f"--{x}-input", {}) for x in ("train", "test", "unseen")]
    add("qa", *io, ("--tasks", {"default": "task1,task2,task3"}), ("--no-desc", {"action": "store_true"}), ("--seed", {"type": int}), ("--split", {"choices": ("train", "test", "all")}), ("--unseen", {"action": "store_true"}), ("--qa-set", {}), *routes)
    numbers = [("--num-samples", {"type": int, "default": 0}), ("--batch-size", {"type": int, "default": 8}), ("--retries", {"type": int, "default": 3}), ("--sleep", {"type": float, "default": 0.25}), ("--temperature", {"type": float, "default": 0.7}), ("--callers", {"type": int, "default": 8}), ("--rate", {"type": float, "default": 0.0}), ("--keep-every", {"type": int, "default": 512})]
    add("infer", *io, ("--model", {"required": True}), ("--client", {"required": True, "help": "module:function that makes a client"}), ("--task", {"required": True}), ("--step", {"default": "single"}), ("--rows", {}), ("--reset", {"action": "store_true"}), *numbers)
    add("evaluate", *io, ("--task", {"required": True}), ("--step", {"default": "single"}), ("--rows", {}))
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    """The command's result, written to ``--output``: CSV for tables, JSON Lines for records and summaries."""
    backend = load_backend(a.backend)
    read = lambda path, **k: files.read_csv(spark, path, **k)
    mapping = read(a.mapping).select("smiles", "safe") if getattr(a, "mapping", None) else None
    if a.command == "pair":
        molecules = spark.read.parquet(a.input)
        out = cut(cliffs.mine_pairs(molecules, backend, canonical=not a.no_canonicalize))
        if a.summary:
            files.write_csv(similarity.pair_counts(out, ["dataset_name", "endpoint"]), a.summary)
        if a.scores:
            cliffs.pair_scores(molecules, backend).write.mode("overwrite").parquet(a.scores)
    elif a.command == "attach-safe":
        out = cliffs.attach_fragments(read(a.input), backend, mapping)
    elif a.command == "compare-safe":
        out = fragments.compare(read(a.input))
    elif a.command == "filter-safe":
        counts = {c: F.col(c).try_cast("int") for c in ("n_common_safe", "n_only_toxic_safe", "n_only_nontoxic_safe")}
        out = fragments.filter_pairs(read(a.input).withColumns(counts), a.fixed_thresholds, a.fallback_length, a.fallback_count)
    elif a.command == "property-delta":
        df = read(a.input)
        texts = df.select(F.explode(F.array("toxic_smiles", "nontoxic_smiles")).alias("__x")).distinct()
        out = outliers.add_deltas(df, describe(texts, "__x", backend), "__x")
    elif a.command == "drop-outliers":
        columns = [f"delta_abs_{d}" for d in a.descriptors.split(",")]
        df = read(a.input)
        out, dropped = outliers.split_outliers(df, columns)
        files.write_csv(dropped, f"{a.output}_dropped")
        files.write_csv(outliers.thresholds(df, columns), f"{a.output}_thresholds")
    elif a.command == "safe-pipeline":
        out = cliffs.build_cliffs(read(a.input), backend, mapping, skip_outliers=a.skip_outliers)
    elif a.command == "split":
        df = read(a.input, index=True)
        column = split.resolve_column(df, a.smiles_col)
        key = backend.scaffold_udf()(F.coalesce(F.col(column), F.lit("")))
        both = split.grouped_split(df.withColumn("__scaffold", key), "__scaffold", "row_idx").drop("__scaffold")
        for side in ("train", "test"):
            files.write_csv(both.filter(F.col("split") == side).orderBy("row_idx").drop("split", "row_idx"), f"{a.output}/{side}")
        return both
    elif a.command == "qa":
        return _build_questions(read, a)
    elif a.command == "infer":
        return _infer(spark, a, backend, read(a.rows, index=True) if a.rows else None)
    else:
        step = files.normal_step(a.step)
        rows = read(a.rows, index=True) if a.rows else None
        scored = scoring.score_predictions(files.read_jsonl(spark, a.input, "id bigint, source_index bigint, gold string, pred string, raw string"), a.task, step, backend, rows)
        out = scoring.summarize(scored, scoring.metric_keys(a.task, step))
        files.write_jsonl(out, a.output)
        return out
    files.write_csv(out, a.output)
    return out


def _build_questions(read, a: argparse.Namespace) -> DataFrame:
    """Question files in a folder for each split, or in one if no split is named; the input of a split wins over the common one."""
    root = f"{a.output}/{files.bundle_name(a.qa_set, not a.no_desc)}" if a.qa_set else a.output
    paths = {"common": a.input} | {x: p for x in ("train", "test", "unseen") if (p := getattr(a, f"{x}_input"))}
    out = None
    for folder, path in qa.route(a.split, a.unseen, paths) if a.split or a.unseen else [("", a.input)]:
        made = qa.build_all(read(path, index=True), a.tasks, not a.no_desc, a.seed)
        files.write_jsonl(made, f"{root}/{folder}".rstrip("/"), ("task", "step"))
        out = made if out is None else out.unionByName(made)
    return out


RECORDS = "model string, task string, step string, id bigint, dataset_name string, endpoint string, source_index bigint, gold string, pred string, correct int, raw string"


def _infer(spark: SparkSession, a: argparse.Namespace, backend, rows: DataFrame | None) -> DataFrame:
    """Answers of the questions that the output has no answer to yet, added to it batch by batch; ``--reset`` starts anew. Gives the added records."""
    module, _, name = a.client.partition(":")
    factory = getattr(importlib.import_module(module), name)
    questions = files.read_jsonl(spark, a.input, "id bigint, question string, answer string, dataset_name string, endpoint string, source_index bigint")
    before = cut(files.read_jsonl(spark, a.output, RECORDS, allow_missing=True))
    before = before.limit(0) if a.reset else before
    have = before.count()
    options = inference.Options(a.retries, a.sleep, a.batch_size, a.temperature, a.callers, a.rate or None, a.keep_every)
    modes = iter([files.append_or_reset(have, a.reset, have > 0)])
    batches = inference.answer_in_batches(questions, lambda out: files.write_jsonl(out, a.output, mode=next(modes, "append")), factory, a.model, a.task, files.normal_step(a.step), before if have else None, a.num_samples, options, backend, rows)
    if not batches:
        return before.limit(0)
    return files.read_jsonl(spark, a.output, RECORDS).join(before.select("id"), "id", "left_anti")


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    run(SparkSession.builder.appName("pairwright").getOrCreate(), a)


if __name__ == "__main__":
    main()
