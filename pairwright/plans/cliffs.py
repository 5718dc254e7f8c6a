"""From labelled molecules to the final pair table: pair, attach, compare, filter, property differences, outliers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..chem.base import describe
from ..functions.text import bitmap_tanimoto, edit_similarity, str_or_empty
from ..operators import fragments, outliers, similarity, tiles
from ..operators.lookup import distinct_keys, encode_missing
from ..schemas import DESCRIPTORS, FINAL_COLUMNS, cut, project
from ..sources.files import manifest_groups

RULES: list[similarity.Rule] = [similarity.BitRule("scaffold_fp"), similarity.BitRule("circular_fp"), similarity.EditRule("smiles")]


def mine_pairs(molecules: DataFrame, backend, excluded: tuple[str, ...] = ("toxcast_df",), canonical: bool = True) -> DataFrame:
    """Similar toxic and non-toxic molecules of one dataset and endpoint, from rows (dataset, endpoint, label, smiles).

    Fingerprints are computed once for each distinct text and written, as the join reads its sides several times.
    Groups without a harmless molecule that parses give nothing.
    """
    rows = molecules.join(F.broadcast(manifest_groups(molecules, excluded)), ["dataset", "endpoint"])
    facts = describe(rows.select(F.coalesce("smiles", F.lit("")).alias("__x")).distinct(), "__x", backend)
    text = F.coalesce("canonical", "__x") if canonical else F.col("__x")
    known = facts.select("__x", text.alias("__s"), "circular_fp", "scaffold_fp")
    rows = cut(rows.join(known, F.coalesce("smiles", F.lit("")) == F.col("__x")).select("dataset", "endpoint", "label", F.col("__s").alias("smiles"), "circular_fp", "scaffold_fp").distinct())
    toxic, harmless = (rows.filter(F.col("label") == side).drop("label") for side in ("toxic", "nontoxic"))
    pairs = similarity.similarity_join(toxic, harmless, ["dataset", "endpoint"], RULES, need_bitmap="circular_fp")
    return pairs.select(F.col("l.dataset").alias("dataset_name"), F.col("l.endpoint").alias("endpoint"), F.col("l.smiles").alias("toxic_smiles"), F.col("r.smiles").alias("nontoxic_smiles")).distinct()


def attach_fragments(pairs: DataFrame, backend, mapping: DataFrame | None = None) -> DataFrame:
    """Fragment texts from a (smiles, safe) mapping, others encoded once for each distinct molecule."""
    keys = distinct_keys(pairs, ["toxic_smiles", "nontoxic_smiles"], "smiles")
    known = mapping if mapping is not None else pairs.sparkSession.createDataFrame([], "smiles string, safe string")
    return fragments.attach(pairs, cut(encode_missing(keys, "smiles", known, "safe", backend.encode_udf())))


def build_cliffs(pairs: DataFrame, backend, mapping: DataFrame | None = None, fixed: bool = False, skip_outliers: bool = False) -> DataFrame:
    """The final nine columns of the pairs that pass all filters; fences are global and taken one after the other."""
    kept = fragments.filter_pairs(fragments.compare(attach_fragments(cut(pairs), backend, mapping)), fixed)
    if not skip_outliers:
        kept = cut(kept)
        keys = distinct_keys(kept, ["toxic_smiles", "nontoxic_smiles"], "__x")
        facts = cut(describe(keys, "__x", backend).select("__x", *DESCRIPTORS))
        kept, _ = outliers.split_outliers(cut(outliers.add_deltas(kept, facts, "__x")), [f"delta_abs_{d}" for d in DESCRIPTORS])
    return finalize(kept, backend)


def finalize(pairs: DataFrame, backend) -> DataFrame:
    """Canonical texts, stripped, made once for each distinct text; unparsable ones stay as they are, the word nan is blank."""
    texts = [str_or_empty(F.col(c), nan_words=True) for c in ("toxic_smiles", "nontoxic_smiles")]
    keys = pairs.select(F.explode(F.array(*texts)).alias("__x")).distinct()
    known = cut(keys.select("__x", F.coalesce(backend.canonical_udf()(F.col("__x")), F.col("__x")).alias("__c")))
    for c, text in zip(("toxic_smiles", "nontoxic_smiles"), texts, strict=True):
        pairs = pairs.join(known, text == F.col("__x")).withColumn(c, F.col("__c")).drop("__x", "__c")
    return project(pairs, FINAL_COLUMNS)


#: The scores of a pair, of rows with smiles, circular_fp and scaffold_fp.
SCORES: dict[str, Callable[[Column, Column], Column]] = {
    "scaffold_similarity": lambda a, b: bitmap_tanimoto(a["scaffold_fp"], b["scaffold_fp"]),
    "circular_similarity": lambda a, b: bitmap_tanimoto(a["circular_fp"], b["circular_fp"]),
    "edit_similarity": lambda a, b: edit_similarity(a["smiles"], b["smiles"]),
}


def pair_scores(molecules: DataFrame, backend, left: str = "toxic", right: str = "nontoxic", done: DataFrame | None = None) -> DataFrame:
    """Tiles (see ``tiles.score_tiles``) of dataset_name, endpoint: scaffold_similarity, circular_similarity, edit_similarity of every pair of a group's two sides, for audit.

    Rows (dataset, endpoint, label, smiles, idx), i and j being idx. The result is a group's whole matrix by nature;
    ``mine_pairs`` makes none. A score is null where a side doesn't parse or both fingerprints are empty.
    """
    facts = cut(describe(molecules.select(F.coalesce("smiles", F.lit("")).alias("__x")).distinct(), "__x", backend).select("__x", "circular_fp", "scaffold_fp"))
    rows = molecules.join(facts, F.coalesce("smiles", F.lit("")) == F.col("__x")).select(F.col("dataset").alias("dataset_name"), "endpoint", "label", "idx", "smiles", "circular_fp", "scaffold_fp")
    side = lambda name: rows.filter(F.col("label") == name).drop("label")
    return tiles.score_tiles(side(left), side(right), ["dataset_name", "endpoint"], "idx", SCORES, done=done)
