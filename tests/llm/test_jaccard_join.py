"""Chosen-path join: against all pairs of whole shingle sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm import components, jaccard_join, shingles

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def slow_classes(rows):
    sets = [set(shingles.shingle_set(t or "").tolist()) for _, t in rows]
    n, links = len(rows), [0] * len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = (rows[i][1] or "") == (rows[j][1] or "") if not a or not b else 5 * len(a & b) >= 4 * len(a | b)
            if same:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        r = find(i)
        least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], least[find(i)], links[i]) for i in range(n))


def got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = jaccard_join.similarity_classes(df).collect()
    return sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in out)


def near_copies(rng, n, words=150, edits=3):
    base = [f"w{rng.randint(0, 999)}" for _ in range(words)]
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(words)] = f"x{rng.randint(0, 10**6)}"
        yield " ".join(t)


def test_shingles_by_hand():
    words = "A b, c-d e F g"
    assert len(shingles.shingle_set(words)) == 3
    assert len(shingles.shingle_set("a b")) == 1 and len(shingles.shingle_set(" .,")) == 0
    assert shingles.shingle_set("a b c d e").tolist() == shingles.shingle_set("A, b c D e!").tolist()
    assert shingles.shingle_set("a b").tolist() != shingles.shingle_set("b a").tolist()


def test_small_table(spark):
    rng = random.Random(3)
    texts = [t for _ in range(6) for t in near_copies(rng, 6, edits=5)]
    texts += ["", None, " ", "one", "one", "two words", "Two, words"] + [" ".join(f"y{rng.randint(0, 9)}" for _ in range(40)) for _ in range(20)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (1000, texts[0])]
    assert got(spark, rows) == slow_classes(rows)


def test_large_group_in_blocks(spark, monkeypatch):
    """One group over LIMIT and BLOCK: it is split, then compared block by block, with no link lost."""
    monkeypatch.setattr(jaccard_join, "LIMIT", 12)
    monkeypatch.setattr(jaccard_join, "BLOCK", 10)
    rng = random.Random(5)
    rows = list(enumerate([*near_copies(rng, 60), *near_copies(rng, 5)]))
    assert got(spark, rows) == slow_classes(rows)


def chain(rng, n, words=60, step=11):
    """Texts of which each shares a stretch with the next: alike at some 0.6 to 0.7, never at 0.8."""
    run = [f"c{rng.randint(0, 10**6)}" for _ in range(words + step * n)]
    return [" ".join(run[k * step : k * step + words]) for k in range(n)]


def test_a_chain_is_verified_by_its_pairs(spark, monkeypatch):
    """A long component of texts that are not alike at 0.8, with some that are: few pairs are verified, and no link is lost."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 20)
    rng = random.Random(8)
    texts = chain(rng, 300)
    texts += [t + " and more" for t in texts[100:140]] + texts[:3]  # near copies and copies inside the chain
    rows = list(enumerate(texts))
    verified = []
    linked = jaccard_join.linked_pairs
    monkeypatch.setattr(jaccard_join, "linked_pairs", lambda pairs, tokens: linked(verified.append(pairs.count()) or pairs, tokens))
    assert got(spark, rows) == slow_classes(rows)
    assert len(verified) == 1 and verified[0] < 6 * len(rows)


def test_documents(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert got(spark, rows) == slow_classes(rows)


def test_repeated_rows_are_one_member(spark):
    """Many copies of one row beside its near copies: counted as rows, compared once."""
    rng = random.Random(6)
    texts = list(near_copies(rng, 4))
    rows = [(1, texts[0])] * 50 + [(k + 2, t) for k, t in enumerate(texts[1:])] + [(9, texts[1])] * 20
    assert got(spark, rows) == slow_classes(rows)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 9), (None, "a b c d e f", 9), (None, "q r s t u v", 9), (None, None, 9), (2, "z", 9), (2, "y", 9)], "doc_id bigint, text string, node bigint")
    df = df.withColumn("th", F.lit(1)).withColumn("comp", F.lit(1))
    out = jaccard_join.similarity_classes(df).collect()
    assert len(out) == 6 and sorted(r["n_links"] for r in out) == [0, 0, 0, 0, 1, 1]
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, ""), (0, "q r s t u v"), (1, "a b c d e f"), (2, "y"), (2, "z")]
    assert jaccard_join.similarity_classes(df.limit(0)).count() == 0 and jaccard_join.keep_one(df.limit(0)).count() == 0


def test_runs_reach_the_recall():
    assert jaccard_join.run_recall(0.8, 1) == pytest.approx(0.75 * 0.8 + 0.25 * 0.96)
    assert jaccard_join.miss(jaccard_join.runs_for()) <= 1 - jaccard_join.RECALL < jaccard_join.miss(jaccard_join.runs_for() - 1)
    with pytest.raises(ValueError, match="recall"):
        jaccard_join.runs_for(1.0)


def test_miss_rate_by_simulation():
    """Paths of pairs whose 64 shared positions agree by chance, walked as the join walks them."""
    rng, n, runs = np.random.default_rng(4), 4000, 2
    missed = 0
    for _ in range(n):
        same = rng.random(shingles.POSITIONS) < 0.8
        a = rng.integers(0, 1 << 32, shingles.POSITIONS, dtype=np.uint32)
        sigs = np.stack([a, np.where(same, a, a + np.uint32(1))])
        met = False
        for root in rng.integers(1, 1 << 40, runs):
            paths = {int(root)}
            for _ in range(jaccard_join.DEPTH):
                own = [{int(x) for x in jaccard_join.children(np.full(1, p), s[None])[1]} for p in paths for s in sigs]
                paths = set().union(*(x & y for x, y in zip(own[::2], own[1::2], strict=True))) if own else set()
            met |= bool(paths)
        missed += not (met and same.sum() >= np.ceil(jaccard_join.SKETCH * shingles.POSITIONS))
    want = jaccard_join.miss(runs)
    assert abs(missed / n - want) < 5 * (want * (1 - want) / n) ** 0.5


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30_000, 9000).astype(np.uint64)) for _ in range(5)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert jaccard_join.common_counts(sets).tolist() == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(k, k + 1) for k in range(1000, 1040)]
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    linked = {x for a, b in edges if a != b for x in (a, b)}
    out = components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["node"]: r["comp"] for r in out} == {x: root[x] for x in linked}
