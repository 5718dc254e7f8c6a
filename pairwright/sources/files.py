"""CSV and JSON Lines sources and sinks, shard unions and path rules."""

from __future__ import annotations

import os
import re
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..schemas import require_columns, with_row_index

_CSV = {"header": "true", "escape": '"', "multiLine": "true", "encoding": "UTF-8"}


def read_csv(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None, required: tuple[str, ...] = (), index: bool = False) -> DataFrame:
    """CSV with a header; all text unless a schema is given. Quotes are doubled, empty cells null. ``index`` adds row_idx in read order."""
    reader = spark.read.options(**_CSV)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    require_columns(df, required)
    return with_row_index(df) if index else df


def read_csv_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The file, or None if it is not there or cannot be read."""
    try:
        df = read_csv(spark, path, index=True)
        df.head(1)
        return df
    except AnalysisException:
        return None


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...] | None = None, mode: str = "overwrite") -> None:
    """CSV part files; columns not named are left out."""
    out = df.select(*[c for c in columns if c in df.columns]) if columns else df
    out.write.mode(mode).options(header="true", escape='"', emptyValue="").csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, skip_bad: bool = True, allow_missing: bool = False) -> DataFrame:
    """JSON Lines; blank lines and one leading '$' are dropped. Bad lines are skipped, or raise when read."""
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        if not allow_missing:
            raise
        return spark.createDataFrame([], schema)
    line = F.regexp_replace(strip(F.col("value")), r"^\$\s*", "")
    rows = lines.select(line.alias("line")).filter("line <> ''")
    if skip_bad:
        rows = rows.filter(F.try_parse_json("line").isNotNull() & F.col("line").startswith("{"))
    return rows.select(F.from_json("line", schema, {"mode": "PERMISSIVE" if skip_bad else "FAILFAST"}).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """JSON Lines in UTF-8, by folders of ``partition_by``, such as split, task and step."""
    df.write.mode(mode).option("ignoreNullFields", "false").partitionBy(*partition_by).json(path)


#: File of a replaceable folder that names the set in force.
CURRENT = "CURRENT"


def stage_jsonl(df: DataFrame, folder: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write a new set beside those that ``folder`` holds; its name. Readers go on seeing the set in force."""
    name = f"set-{uuid4().hex}"
    write_jsonl(df, f"{folder}/{name}", partition_by)
    return name


def switch_to(spark: SparkSession, folder: str, name: str) -> None:
    """Put a staged set in force by one rename of the file that names it, so that readers see the old or the new set and never a mixture.

    Earlier sets stay, as a reader may still be at them; remove their folders when none is.
    """
    fs_of, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    staged, target = fs_of.Path(f"{folder}/.{CURRENT}-{name}"), fs_of.Path(f"{folder}/{CURRENT}")
    store = target.getFileSystem(conf)
    out = store.create(staged, True)
    out.write(bytearray(name.encode()))
    out.close()
    overwrite = getattr(fs_of, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(overwrite, 1)
    how[0] = overwrite.OVERWRITE
    fs_of.FileContext.getFileContext(store.getUri(), conf).rename(staged, target, how)


def replace_jsonl(df: DataFrame, folder: str, partition_by: tuple[str, ...] = ()) -> None:
    """Replace what ``read_current`` gives. A run that fails before the end leaves the old set in force; ``df`` may read it."""
    switch_to(df.sparkSession, folder, stage_jsonl(df, folder, partition_by))


def read_current(spark: SparkSession, folder: str, schema: str | T.StructType, skip_bad: bool = True, allow_missing: bool = False) -> DataFrame:
    """The set in force; without one an error, or no rows if that is allowed."""
    try:
        name = spark.read.text(f"{folder}/{CURRENT}").first()["value"]  # one line
    except AnalysisException:
        if not allow_missing:
            raise
        return spark.createDataFrame([], schema)
    return read_jsonl(spark, f"{folder}/{name}", schema, skip_bad)


def append_or_reset(done_ids: int, reset: bool, exists: bool) -> str:
    """Write mode of a resumable sink."""
    return "overwrite" if reset or not exists or not done_ids else "append"


def read_shards(spark: SparkSession, pattern: str) -> DataFrame:
    """Union of CSV shards that a glob matches, by column name; missing columns are null, empty shards add nothing."""
    paths = [p.getPath().toString() for p in _glob(spark, pattern)]
    out = None
    for p in sorted(paths):
        df = read_csv(spark, p)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(pattern)
    return out


def _glob(spark: SparkSession, pattern: str) -> list:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return list(found or [])


def union_shards(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def manifest_groups(molecules: DataFrame, excluded: tuple[str, ...] = ("toxcast_df",)) -> DataFrame:
    """dataset, endpoint of the groups that have both labels, without excluded datasets."""
    own = molecules.filter(~F.col("dataset").isin(*excluded)) if excluded else molecules
    return own.groupBy("dataset", "endpoint").agg(F.count_distinct("label").alias("n")).filter("n >= 2").select("dataset", "endpoint")


def under_root(path: str, root: str) -> str:
    """The resolved path; an error if it leaves the root."""
    full, top = os.path.realpath(path), os.path.realpath(root)
    if os.path.commonpath([full, top]) != top:
        raise ValueError(f"{path} is not under {root}")
    return full


def bundle_name(name: str, descriptions: bool = True) -> str:
    """A folder name without path parts; bundles without descriptions end in _no_desc."""
    clean = re.sub(r"\.\.+", "", name.replace("/", "").replace("\\", "")).strip()
    if not clean:
        raise ValueError("empty bundle name")
    return clean if descriptions or clean.endswith("_no_desc") else f"{clean}_no_desc"


#: Stems of the question files of each task, and their short forms in flat bundles.
QA_STEMS = {
    "task1": ("task1_toxic_fragment_identification", "task1_toxic_fragment_identification_qa", "task1"),
    "task2": ("task2_nontoxic_fragment_generation", "task2_nontoxic_fragment_generation_qa", "task2"),
    "task3": ("task3_nontoxic_smiles_generation", "task3_nontoxic_smiles_generation_qa", "task3_smiles_gen"),
    "task3_nontoxic_safe_generation": ("task3_nontoxic_safe_generation", "task3_nontoxic_safe_generation_qa", "task3_safe_gen"),
    "task3_stepwise_cot_safe_generation": ("task3_stepwise_cot_nontoxic_safe_generation", "task3_stepwise_cot_nontoxic_safe_generation_qa", None),
}


def normal_step(step: str) -> str:
    full = {"single": "single_step", "multi": "multi_step", "single_step": "single_step", "multi_step": "multi_step"}
    if step not in full:
        raise ValueError(f"unknown step {step!r}")
    return full[step]


def parse_tasks(text: str) -> list[str]:
    """Tasks of a comma list, once each, in order; unknown names raise."""
    out = list(dict.fromkeys(x.strip() for x in text.split(",") if x.strip()))
    if bad := [x for x in out if x not in QA_STEMS]:
        raise ValueError(f"unknown tasks: {', '.join(bad)}")
    return out


def qa_path(root: str, split: str, task: str, step: str, variant: str = "base", unseen: bool = False, flat: bool = False) -> str:
    """Path of a question file: <root>/<split>/<folder>/both_repre/<step>/<stem>.jsonl, or the short name of a flat bundle.

    A flat bundle has only base variants, no unseen split and no stepwise task; those fall back to the folder form.
    """
    if split not in ("train", "test"):
        raise ValueError(f"unknown split {split!r}")
    step = normal_step(step)
    folder, stem, short = QA_STEMS[task]
    if flat and not unseen and variant == "base" and short:
        return f"{root}/{split}/{split}_{short}_{step.removesuffix('_step')}.jsonl"
    name = stem if variant == "base" else f"{stem}_{variant}"
    return f"{root}/{'unseen_test' if unseen else split}/{folder}/both_repre/{step}/{name}.jsonl"


def is_flat_bundle(root: str) -> bool:
    return any(os.path.isfile(f"{root}/{s}/{s}_task1_single.jsonl") for s in ("test", "train"))
