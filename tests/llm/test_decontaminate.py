"""Decontamination: against a full dynamic programme over every window and document."""

import random

import numpy as np
from pyspark.sql import functions as F

from pairwright.llm import decontaminate as D


def slow_distance(pattern, text):
    """Least edits of the pattern against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, c in enumerate(text):
            new.append(min(row[j] + (p != c), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def words(rng, n):
    return " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 7))) for _ in range(n))


def damage(rng, t, edits):
    t = list(t)
    for _ in range(edits):
        k = rng.randrange(len(t))
        t[k] = rng.choice(["", "z", t[k] + "q"])
    return "".join(t)


def case(seed):
    rng = random.Random(seed)
    items = [(i, words(rng, n)) for i, n in enumerate((8, 14, 25, 60, 130, 3))]
    docs = [words(rng, rng.randint(0, 80)) for _ in range(6)]
    for _, t in items[:5]:
        n = D.budget(min(len(t), D.WINDOW))
        for edits in (0, n // 2, n, n + 3, 2 * n + 4):
            docs.append(f"{words(rng, rng.randint(0, 30))} {damage(rng, t, edits)} {words(rng, rng.randint(0, 30))}")
    return items, [*docs, "", "  ", items[5][1], docs[-1].upper().replace(" ", "\n ")]


def test_same_as_full_programme():
    for seed in (1, 2):
        items, docs = case(seed)
        index = D.build_index(items)
        found = {(n, i) for n, i, *_ in D.leaks(index, docs)}
        want = set()
        for n, t in enumerate(docs):
            for i, item in items:
                for w in D.windows(D.normal(item)):
                    if len(w) < D.Q:
                        if f" {w} " in f" {D.normal(t)} ":
                            want.add((n, i))
                    elif slow_distance(w, D.normal(t)) <= D.budget(len(w)):
                        want.add((n, i))
        assert found == want and len(want) > 10


def test_align_finds_the_stretch():
    p, t = D.codes("hello world again"), D.codes("xxxx hello wrld again yyy")
    edits, a, b = D.align([p, p[:5]], t, np.array([0, 0]), np.array([len(t)] * 2), np.array([0, 0]), 12)
    assert (edits[0], a[0], b[0]) == (1, 5, 21) and (edits[1], a[1], b[1]) == (0, 5, 10)


def test_chunks_do_not_matter(monkeypatch):
    items, docs = case(4)
    index = D.build_index(items)
    want = sorted(D.leaks(index, docs))
    monkeypatch.setattr(D, "CHUNK", 50)
    assert sorted(D.leaks(index, docs)) == want


def test_long_texts_in_slices(monkeypatch):
    """A text that is searched slice by slice gives the rows that it gives whole, at a slice's edge too."""
    rng = random.Random(9)
    items = [(1, words(rng, 60)), (2, words(rng, 12))]
    index = D.build_index(items)
    parts = []
    for k in range(40):
        parts += [words(rng, rng.randint(20, 60)), damage(rng, items[k % 2][1], k % 5)]
    text = " ".join(parts)
    want = sorted(D.leaks(index, [text, text[::-1], text]))
    assert len({x[0] for x in want}) == 2 and len(want) > 100
    for core, margin in ((500, 400), (1111, 300), (90, 400)):
        monkeypatch.setattr(D, "CHUNK", core)
        monkeypatch.setattr(D, "MARGIN", margin)
        assert sorted(D.leaks(index, [text, text[::-1], text])) == want


def test_common_grams_are_counted_in_bounded_steps(monkeypatch):
    """Texts and items full of the same q-grams: the same regions whatever number of hits is counted at a time."""
    rng = random.Random(5)
    items = [(1, "ab " * 60), (2, "a" * 150), (3, words(rng, 40))]
    index = D.build_index(items)
    docs = ["ab " * 150 + words(rng, 20), "a" * 400, items[2][1] + "ab " * 50, words(rng, 100)]
    want = sorted(D.leaks(index, docs))
    assert {(x[0], x[1]) for x in want} == {(0, 1), (1, 2), (2, 3), (2, 1)}
    for hits in (7, 1000):
        monkeypatch.setattr(D, "HITS", hits)
        assert sorted(D.leaks(index, docs)) == want
    assert {x[0] for x in D.leaks(index, docs, first_only=True)} == {0, 1, 2}


def test_verbatim_runs_are_found():
    """Any run of WINDOW + STEP - 1 characters of an item is a leak, wherever in the item it lies."""
    rng = random.Random(8)
    item = D.normal(words(rng, 80))
    index = D.build_index([(7, item)])
    n = D.WINDOW + D.STEP - 1
    docs = [f"{words(rng, 30)} {item[a : a + n]} {words(rng, 30)}" for a in range(0, len(item) - n + 1, 7)]
    assert {x[0] for x in D.leaks(index, docs)} == set(range(len(docs)))


def test_query(spark, data):
    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = {r["doc_id"]: D.normal(r["text"] or "") for r in docs.collect()}
    exact = {(d, r["item_id"]) for r in bench.collect() for d, t in texts.items() if D.normal(r["text"]) in t}
    got = {(r["doc_id"], r["item_id"]) for r in D.leak_report(D.find_leaks(docs, bench)).collect()}
    assert exact <= got and len(exact) > 0
    rest = {r["doc_id"] for r in D.drop_leaks(docs, bench).collect()}
    assert rest == set(texts) - {d for d, _ in got}


def test_blocks_and_edges(spark, monkeypatch):
    items, docs = case(3)
    bench = spark.createDataFrame([*items, (None, None), (50, "")], "item_id bigint, text string").withColumn("start", F.lit(1))
    df = spark.createDataFrame([*enumerate(docs), (0, None), (None, items[2][1]), (None, items[2][1])], "doc_id bigint, text string").withColumn("edits", F.lit(1))
    want = sorted(D.find_leaks(df, bench).collect(), key=str)
    assert sum(r["doc_id"] is None for r in want) == 2 * len(D.windows(D.normal(items[2][1])))
    kept = sorted(D.drop_leaks(df, bench).collect(), key=str)
    monkeypatch.setattr(D, "BLOCK_CHARS", 200)
    assert sorted(D.find_leaks(df, bench).collect(), key=str) == want
    assert sorted(D.drop_leaks(df, bench).collect(), key=str) == kept and 0 < len(kept) < df.count()
    assert D.find_leaks(df.limit(0), bench).count() == 0 and D.find_leaks(df, bench.limit(0)).count() == 0
    assert D.drop_leaks(df, bench).columns == df.columns
    assert np.all(D.build_index([]).need >= 0)
