"""The pipeline against a brute-force version of each stage, and edge rows through all but the last."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_bpe import reference
from test_jaccard_join import slow_classes
from test_native_scans import ASSIGN

from pairwright.llm import bpe, common, decontaminate, registry, secrets, shingles, toxicity

pipeline = pytest.importorskip("corpus_pipeline")


def masked(texts, corpus):
    """Live base spans masked, from plain regular expressions and counts of owners in the whole corpus: {(id): (source, text)}."""
    import re

    found, owners = {}, {}
    for d, (source, t) in corpus.items():
        spans = [(m.start(), m.end(), m[2]) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        found[d] = sorted(spans)
        for *_, v in spans:
            owners.setdefault(v, set()).add(source)
    out = {}
    for d, (_, t) in texts.items():
        at, parts, end = 0, [], None
        for a, b, v in found[d]:
            if len(owners[v]) >= secrets.COPIED_OWNERS:
                continue
            if end is not None and a < end:
                at = end = max(end, b)
                continue
            parts.append(t[at:a])
            at = end = b
        out[d] = "[SECRET]".join([*parts, t[at:]]) if end is not None else t
    return out


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r["doc_id"]: (r["source"], r["text"] or "") for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.score_documents(docs, model).filter("predicted = 1").collect()}
    left = {d: x for d, x in rows.items() if d not in bad}
    left = {d: left[d] for d, c, _ in slow_classes([(d, t) for d, (_, t) in left.items()]) if d == c}
    bench = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    clean = {d: x for d, x in left.items() if not any(b in decontaminate.normal(x[1]) for b in bench)}
    texts = masked(clean, rows)
    codec = reference(registry.RANKS)
    got = {r["doc_id"]: r for r in pipeline.run(spark, data).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        assert got[d]["n_tokens"] == len(codec.encode_ordinary(t))
        assert got[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_redaction(spark):
    rows = [(1, "x token=abcdefgh y", "a", 18), (1, "x token=abcdefgh y", "a", 18), (2, None, "a", None), (None, 'password: "' + "0f" * 20 + '" end 🙂', None, 5), (3, "ghp_" + "Q" * 36, "a", 0), (4, "ghp_" + "Q" * 36, "b", 0), (5, "ghp_" + "Q" * 36, "c", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint").withColumn("spans", F.lit(1)).withColumn("hash", F.lit(1)).withColumn("row", F.lit(1))
    out = secrets.redact(df)
    assert out.columns == df.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["n_chars"]) for r in out.collect())
    assert got == sorted([(1, "x [SECRET] y", 12)] * 2 + [(2, "", None), (0, '[SECRET]" end 🙂', 15)] + [(k, "ghp_" + "Q" * 36, 0) for k in (3, 4, 5)])
    assert secrets.redact(df.limit(0)).count() == 0


def test_owners_of_dropped_copies_count(spark):
    """A value of three owners in the corpus stays though one document is left; one of a single owner is masked; one that the corpus lacks as well."""
    schema = "doc_id bigint, text string, source string, n_chars bigint"
    corpus = spark.createDataFrame([(k, "token=copied-example", s, 20) for k, s in enumerate("abc")] + [(9, "token=only-here-once", "a", 20)], schema)
    left = spark.createDataFrame([(0, "token=copied-example", "a", 20), (9, "token=only-here-once", "a", 20), (10, "token=new-and-unseen", "b", 20)], schema)
    assert {r["doc_id"]: r["text"] for r in secrets.redact(left, corpus=corpus).collect()} == {0: "token=copied-example", 9: "[SECRET]", 10: "[SECRET]"}
    assert {r["text"] for r in secrets.redact(left).collect()} == {"[SECRET]"}


def test_edges_pass_through(spark, data, tmp_path):
    """Nulls, repeated rows, empty and long texts, an empty table, and columns with the operators' own names."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, node string"
    rows = [(1, None, None, None, None, 0.5, "n"), (2, "", "en", "s", 0, None, None), (None, "a b c d e f g", None, "s", 13, None, None), (3, "word " * 20_000, "en", "s", 100_000, None, None), (4, "token=abcdefgh12", "en", "s", 1, None, None)]
    df = spark.createDataFrame(rows + rows[3:4], schema)
    for docs in (df, df.limit(0)):
        n = docs.count()
        for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
            stage(spark, docs, data).write.parquet(f"{tmp_path}/{n}-{k}")
            docs = spark.read.parquet(f"{tmp_path}/{n}-{k}")
            assert docs.columns == df.columns
        assert docs.count() == (4 if n else 0)
        coded = pipeline.STAGES[-1][1](spark, docs, data).collect()
        assert sorted(r["decoded_sha256"] for r in coded) == sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in docs.collect())


def test_a_worker_remembers_one_operator(spark):
    """What shingles remembered goes when a codec is built, and the other way round; results stay."""
    sets = [list(shingles.shingle_set(t)) for t in ("a b c d e f", "a b")]
    shared = bpe.Shared(spark, registry.RANKS, registry.public_tokenizers.PATTERN)
    codec = shared.codec()
    assert shared.codec() is codec and [*common._REMEMBERED] == [shared.key]
    assert [list(shingles.shingle_set(t)) for t in ("a b c d e f", "a b")] == sets
    assert [*common._REMEMBERED] == ["shingles"]


def test_texts_are_scored_in_slices(spark, monkeypatch):
    """However many rows a batch has, a few hundred texts are taken out of it at a time, and each gets its own score."""

    def scorer(_, model):
        def score(texts):
            if len(texts) > 512:
                raise ValueError(f"{len(texts)} texts at once")
            return np.array([0.9 if t is None or t.endswith("7") else 0.1 for t in texts])

        return score

    monkeypatch.setattr(toxicity, "_scorer", scorer)
    rows = [(k, None if k == 600 else f"text {k}") for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert sorted(r["doc_id"] for r in toxicity.keep_clean(df, None).collect()) == [k for k in range(2000) if k % 10 != 7 and k != 600]


def test_batches_of_the_stages_are_bounded(spark, data):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], type=pa.int64())], names=["n"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    try:
        pipeline.encode(spark, spark.read.parquet(f"{data}/documents.parquet"), data)
        got = [r["n"] for r in spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n bigint").collect()]
        assert sum(got) == 3000 and max(got) <= 1024
        spark.conf.set(key, "97")
        pipeline.encode(spark, spark.read.parquet(f"{data}/documents.parquet"), data)
        assert spark.conf.get(key) == "97"
    finally:
        spark.conf.unset(key)
