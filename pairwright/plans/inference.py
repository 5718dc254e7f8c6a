"""Model calls over question records: batches, retries, resume, and records of predictions.

The client is a factory that each task calls for itself, so nothing that holds a connection is shipped. Answers cost
money, so they are kept as they come: ``answer_in_batches`` hands over each batch before it asks the next, and a run
that is started again asks only what has no answer yet.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import exact_match, extract_answer
from ..operators.lookup import resume
from ..schemas import checkpoint_folder, cut, with_row_index
from . import scoring

_STEPWISE = ("answer", "step1_only_toxic_safe_fragments", "step1_reasoning", "step2_only_nontoxic_safe_fragments", "step2_reasoning", "step3_reasoning")
BASE_PROMPT = "You are a medicinal chemist. Answer with JSON only."
TAILS = {
    "task1": "The answer lists fragments of the toxic molecule, joined by dots.",
    "task2": "The answer lists replacement fragments, joined by dots.",
    "task3": "The answer is one SMILES text.",
    "task3_nontoxic_safe_generation": "The answer is one SAFE text.",
    "task3_stepwise_cot_safe_generation": "Fill in every step; the answer is one SAFE text.",
}


def answer_schema(task: str) -> dict:
    """JSON schema of a model's reply: one text, or six for the stepwise task."""
    keys = _STEPWISE if task == "task3_stepwise_cot_safe_generation" else ("answer",)
    return {"type": "object", "properties": {k: {"type": "string"} for k in keys}, "required": list(keys), "additionalProperties": False}


def system_prompt(task: str) -> str:
    return f"{BASE_PROMPT} {TAILS[task]}" if task in TAILS else BASE_PROMPT


@dataclass(frozen=True)
class Options:
    retries: int = 3
    sleep: float = 0.25
    batch_size: int = 8
    temperature: float = 0.7
    #: tasks that ask at the same time, calls a second of all of them together (none: no limit), and questions whose answers are kept at once
    callers: int = 8
    rate: float | None = None
    keep_every: int = 512

    @property
    def pause(self) -> float:
        """Seconds that a task waits after each of its batches."""
        return max(self.sleep, self.batch_size * self.callers / self.rate) if self.rate else self.sleep


def call(client, system: str, user: str, schema: dict | None, options: Options, pause: Callable[[float], None] = time.sleep) -> str:
    """The reply, or ERROR text after the last retry; each wait is longer than the one before.

    A client that does not know the argument ``schema`` is asked without it; any other failure is only retried, as
    asking in another form would be paid for twice.
    """
    last, k = None, 0
    while k < options.retries:
        try:
            return client.complete(system, user, temperature=options.temperature, **({} if schema is None else {"schema": schema}))
        except TypeError as e:
            if schema is not None and "schema" in str(e):
                schema = None
                continue
            last = e
        except Exception as e:  # noqa: BLE001  any failure of a remote call is retried
            last = e
        pause(options.sleep * (k + 1))
        k += 1
    return f"ERROR: {last}"


def infer(questions: DataFrame, client_factory: Callable[[], object], task: str, options: Options = Options()) -> DataFrame:
    """The questions with ``raw``: each partition works in batches with as many threads, in order."""
    system, schema = system_prompt(task), answer_schema(task)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        with ThreadPoolExecutor(options.batch_size) as pool:
            for frame in frames:
                raw: list[str] = []
                for at in range(0, len(frame), options.batch_size):
                    part = frame["question"].iloc[at : at + options.batch_size]
                    raw += pool.map(lambda q: call(client, system, q, schema, options), part)
                    time.sleep(options.pause)
                yield frame.assign(raw=raw)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in questions.schema)
    return questions.mapInPandas(run, f"{types}, raw string")


def prediction_records(answered: DataFrame, model: str, task: str, step: str) -> DataFrame:
    """model, task, step, id, dataset_name, endpoint, source_index, gold, pred, correct, raw. The endpoint falls back to the dataset."""
    gold = F.get_json_object("answer", "$.answer") if dict(answered.dtypes)["answer"] == "string" else F.col("answer.answer")
    pred = F.when(F.col("raw").startswith("ERROR:"), F.lit(None).cast("string")).otherwise(extract_answer(F.col("raw")))
    out = answered.select("id", "dataset_name", F.coalesce(F.nullif(F.col("endpoint"), F.lit("")), F.col("dataset_name")).alias("endpoint"), "source_index", gold.alias("gold"), pred.alias("pred"), "raw")
    return out.select(F.lit(model).alias("model"), F.lit(task).alias("task"), F.lit(step).alias("step"), "id", "dataset_name", "endpoint", "source_index", "gold", "pred", exact_match(F.col("gold"), F.col("pred")).alias("correct"), "raw")


def run_inference(questions: DataFrame, client_factory: Callable[[], object], model: str, task: str, step: str, done: DataFrame | None = None, limit: int = 0, options: Options = Options(), backend=None, rows: DataFrame | None = None) -> DataFrame:
    """Limit, resume, call, record and score."""
    own = questions.filter(F.col("id") < limit) if limit else questions
    own = resume(own, done) if done is not None else own
    return scoring.score_predictions(prediction_records(infer(own, client_factory, task, options), model, task, step), task, step, backend, rows)


def answer_in_batches(questions: DataFrame, write: Callable[[DataFrame], None], client_factory: Callable[[], object], model: str, task: str, step: str, done: DataFrame | None = None, limit: int = 0, options: Options = Options(), backend=None, rows: DataFrame | None = None) -> int:
    """Ask what ``done`` has no answer to, ``options.keep_every`` questions at a time in the order of ids; the number of batches.

    ``write`` gets the scored records of a batch once, and the next batch is asked after it returns, so a run that is
    lost loses the batch in flight at most: started again with what was written as ``done``, it asks no other question
    twice. Open questions are written to the shared folder by batch first, so each job reads its own batch alone.
    """
    own = questions.filter(F.col("id") < limit) if limit else questions
    own = with_row_index(resume(own, done) if done is not None else own, ["id"], "__at")
    folder = f"{checkpoint_folder(questions.sparkSession)}/questions-{uuid4().hex}"
    own.withColumn("__batch", F.floor(F.col("__at") / options.keep_every)).drop("__at").write.partitionBy("__batch").parquet(folder)
    batches = -(-own.count() // options.keep_every)
    for k in range(batches):
        part = questions.sparkSession.read.schema(questions.schema).parquet(f"{folder}/__batch={k}").repartition(options.callers, "id")
        write(cut(run_inference(part, client_factory, model, task, step, options=options, backend=backend, rows=rows)))
    return batches
