"""Question and answer records of five tasks from pair rows: projections that make text. The prompts are our own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import alias_coalesce, python_repr, str_or_empty, strip
from ..operators.split import has_name, seeded_shuffle, step_of_one, step_of_two
from ..schemas import require_columns
from ..sources.files import parse_tasks
from . import descriptions

REQUIRED = ("dataset_name", "endpoint", "toxic_safe", "nontoxic_safe", "only_toxic_safe_fragments", "only_nontoxic_safe_fragments")
FRAGMENTS = "A molecule can be written as SAFE text: its fragments, each a SMILES piece, joined by dots, with ring digits that mark the broken bonds. "
CONTEXT = "The toxic molecule below has a close relative without the toxic effect that differs in a few fragments only. "
PRESERVE = "Keep size, lipophilicity, polar surface, hydrogen-bond counts and flexibility as close as possible. "
ASK = {
    "task1": "Which fragments of the toxic molecule are absent from its harmless relative?",
    "task2": "Which fragments could take the place of the toxic ones so that the effect is lost?",
    "task3": "Write the SMILES of a harmless relative of the toxic molecule.",
    "task3_nontoxic_safe_generation": "Write the SAFE text of a harmless relative of the toxic molecule.",
    "task3_stepwise_cot_safe_generation": "First name the toxic fragments, then their replacements, then write the SAFE text of the harmless relative.",
}
FORMAT = 'Reply with JSON of the form {"answer": "..."}; join several fragments by dots.'
FORMAT_STEPWISE = (
    'Reply with JSON that has the keys "step1_only_toxic_safe_fragments", "step1_reasoning", "step2_only_nontoxic_safe_fragments", "step2_reasoning", "step3_reasoning" and "answer", all texts.'
)


def ingest(pairs: DataFrame) -> DataFrame:
    """Pair rows with missing text as '' and aliases filled; ``row_idx`` must be there."""
    require_columns(pairs, (*REQUIRED, "row_idx"))
    have = lambda c: F.col(c) if c in pairs.columns else F.lit("")
    made = {c: str_or_empty(F.col(c)) for c in REQUIRED}
    made |= {f"{s}_safe_decoded_smiles": alias_coalesce(have(f"{s}_safe_decoded_smiles"), have(f"{s}_smiles")) for s in ("toxic", "nontoxic")}
    return pairs.withColumns(made | {"common_safe_fragments": str_or_empty(have("common_safe_fragments"))})


def molecule_block(smiles: Column, safe: Column, mode: str = "both_repre", label: str = "Toxic molecule") -> Column:
    """One line with the molecule in the representations of ``mode`` (both_repre, smiles_only, safe_only); '' where they are blank."""
    one = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name} = "), python_repr(c)))
    shown = {"both_repre": [one("SMILES", smiles), one("SAFE", safe)], "smiles_only": [one("SMILES", smiles)], "safe_only": [one("SAFE", safe)]}
    if mode not in shown:
        raise ValueError(f"unknown mode {mode!r}")
    body = F.concat_ws(", ", *shown[mode])
    return F.when(body != "", F.concat(F.lit(f"{label}: "), body, F.lit(". "))).otherwise(F.lit(""))


def question(task: str, mode: str = "both_repre") -> Column:
    """Preamble, description, molecule and request, stripped as a whole, then the output format."""
    told = F.when(F.col("description") != "", F.concat(F.col("description"), F.lit(" "))).otherwise(F.lit(""))
    body = F.concat(F.lit(FRAGMENTS + CONTEXT + PRESERVE), told, molecule_block(F.col("toxic_safe_decoded_smiles"), F.col("toxic_safe"), mode), F.lit(ASK[task]))
    stepwise = task == "task3_stepwise_cot_safe_generation"
    return F.concat(strip(body), F.lit("\n\n" + FORMAT_STEPWISE if stepwise else " " + FORMAT))


def build_task(pairs: DataFrame, task: str, use_descriptions: bool = True, mode: str = "both_repre") -> DataFrame:
    """id, question, answer struct, dataset_name, endpoint, source_index, step and the task's extra columns.

    Rows that name neither dataset nor endpoint are left out (``skipped`` counts them); ids count what is left.
    """
    rows = ingest(pairs).filter(has_name())
    rows = descriptions.require_descriptions(descriptions.with_description(rows)) if use_descriptions else rows.withColumn("description", F.lit(""))
    toxic, harmless = F.col("only_toxic_safe_fragments"), F.col("only_nontoxic_safe_fragments")
    answer = {"task1": toxic, "task2": harmless, "task3": F.col("nontoxic_safe_decoded_smiles")}.get(task, F.col("nontoxic_safe"))
    gold = [answer.alias("answer")]
    if task == "task3_stepwise_cot_safe_generation":
        gold += [toxic.alias("gold_only_toxic_safe_fragments"), harmless.alias("gold_only_nontoxic_safe_fragments")]
    step = step_of_one(toxic) if task == "task1" else step_of_two(toxic, harmless)
    extra = ["common_safe_fragments", "nontoxic_safe_decoded_smiles"] if task == "task2" else []
    return rows.select(F.col("row_idx").alias("source_index"), question(task, mode).alias("question"), F.struct(*gold).alias("answer"), "dataset_name", "endpoint", step.alias("step"), F.lit(task).alias("task"), *extra)


def with_ids(records: DataFrame, seed: int | None = None) -> DataFrame:
    """Ids from 0 within each task and step, in source order or shuffled by ``seed``; source_index stays.

    All records are numbered in one distributed sort, and a group's first number is taken off; there are ten groups at most.
    """
    from ..schemas import with_row_index

    rows = with_row_index(records, ["task", "step", "source_index"], "__global")
    first = rows.groupBy("task", "step").agg(F.min("__global").alias("__first"))
    rows = rows.join(F.broadcast(first), ["task", "step"]).withColumn("id", F.col("__global") - F.col("__first")).drop("__global", "__first")
    if seed is None:
        return rows
    out = None
    for task, step in sorted(tuple(r) for r in first.select("task", "step").collect()):
        part = seeded_shuffle(rows.filter((F.col("task") == task) & (F.col("step") == step)), seed)
        out = part if out is None else out.unionByName(part)
    return rows if out is None else out


def skipped(pairs: DataFrame) -> DataFrame:
    """One row: rows read, rows that name nothing."""
    return pairs.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~has_name()).alias("n_skipped"))


def observe_skipped(pairs: DataFrame, observation: Observation) -> DataFrame:
    """Counts the same as a side effect of another action."""
    return pairs.observe(observation, F.count(F.lit(1)).alias("n_rows"), F.count_if(~has_name()).alias("n_skipped"))


def build_all(pairs: DataFrame, tasks: str = "task1,task2,task3,task3_nontoxic_safe_generation,task3_stepwise_cot_safe_generation", use_descriptions: bool = True, seed: int | None = None) -> DataFrame:
    """Records of several tasks under one schema; extra columns are null where a task has none, and gold structs are JSON text."""
    out = None
    for task in parse_tasks(tasks):
        part = build_task(pairs, task, use_descriptions).withColumn("answer", F.to_json("answer"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return with_ids(out, seed)


def route(split: str, unseen: bool, paths: dict[str, str]) -> list[tuple[str, str]]:
    """(split folder, input) to build: the unseen file wins for unseen tests, then the split's own file, then the common one."""
    if split not in ("train", "test", "all"):
        raise ValueError(f"unknown split {split!r}")
    if unseen and split != "test":
        raise ValueError("unseen data go with the test split only")
    if unseen:
        return [("unseen_test", paths["unseen"])]
    return [(s, paths.get(s) or paths["common"]) for s in (("train", "test") if split == "all" else (split,))]
