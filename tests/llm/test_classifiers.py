"""License, quality and toxicity: held-out accuracy, matching against brute force, edge rows."""

import random
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm import license_scan, quality, toxicity
from pairwright.llm.common import held_out

SCHEMA = "doc_id bigint, text string"


# licenses


def test_license_lines(spark):
    prose = ["His license was revoked yesterday.", "Of the erthin and licensethat.", "", None]
    named = [(f, t) for f, texts in license_scan.TEMPLATES.items() for t in texts]
    texts = [f"some words\n{t}\nmore words" for _, t in named] + prose + ["Licensed under the Eclipse Public License 2.0.", "The Apache License, Version 2.0 applies."]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    got = {r["doc_id"]: r for r in rows}
    for i, (family, t) in enumerate(named):
        assert got[i]["family"] == family and got[i]["confirmed"] and got[i]["paragraph"] == 1 and got[i]["line"] == t
    n = len(named)
    assert not {n, n + 1, n + 2, n + 3} & set(got)
    assert got[n + 4]["family"] == license_scan.UNKNOWN and not got[n + 4]["confirmed"]
    assert got[n + 5]["family"] == "Apache-2.0"


def test_wrapped_license_lines_are_scored(spark):
    texts = ["Permission is hereby granted, free of charge, to any person obtaining a copy", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell", "modification, are permitted provided that the following conditions are met:", "It and.", "This or that of the."]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert {n: r["family"] for n, r in got.items()} == {0: "MIT", 1: "MIT", 2: "BSD"}


def test_lines_without_an_anchor_are_prose(spark):
    """No n-grams of the model without an anchor, alone or any number of the best together, make a row."""
    model = license_scan.train()
    anchors = set(model.anchors)
    free = [i for i, g in enumerate(model.grams) if not anchors & ({*(w := g.split())} | {" ".join(p) for p in zip(w, w[1:])})]
    assert all(" " not in model.grams[i] for i in free)
    for k in range(len(model.classes) - 1):
        order = sorted(free, key=lambda i: model.weights[i, -1] - model.weights[i, k])
        for m in range(1, len(order) + 1):
            z = model.bias + model.weights[order[:m]].sum(axis=0) / m**0.5
            assert license_scan._softmax(z[None])[0, -1] >= 0.5


def test_license_score_is_the_models(spark):
    """The joined score against the plain dot product."""
    model = license_scan.train()
    line = "Released under the terms of the MIT License, see the file."
    row = license_scan.scan(spark.createDataFrame([(1, line)], SCHEMA)).collect()[0]
    bag = license_scan.ngrams(license_scan.tokens(line))
    place = {g: i for i, g in enumerate(model.grams)}
    logit = license_scan._margin(model.weights, model.bias, place, [bag])[0]
    assert row["probability"] == pytest.approx(1 / (1 + np.exp(-(model.slope * logit + model.offset))), abs=1e-6)


def test_unknown_licenses_are_not_named(spark):
    """Notices of families that the model has never seen are named after none."""
    strange = ["Eclipse Public License - v 2.0", "Licensed under the Eclipse Public License, version 2.0.", "Licensed under the European Union Public Licence, version 1.2.", "Released under the Artistic License 2.0.", "Licensed under the Common Development and Distribution License, version 1.0.", "Released under the zlib License.", "Released under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: EPL-2.0"]
    got = license_scan.scan(spark.createDataFrame(list(enumerate(strange)), SCHEMA)).collect()
    assert got and all(r["family"] == license_scan.UNKNOWN and not r["confirmed"] for r in got), [(r["line"], r["family"]) for r in got if r["confirmed"]]


def test_license_rows_against_plain_scores(spark, data):
    """The whole result on a whole table and on wrapped templates, from a dot product for every line: no line is left out before it is scored."""
    model = license_scan.train()
    place = {g: i for i, g in enumerate(model.grams)}
    wrapped = [x for texts in license_scan.TEMPLATES.values() for t in texts for x in textwrap.wrap(t, 72)]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()] + [(10**6, "\n".join(wrapped)), (10**6 + 1, None)]
    pairs, telling, want = license_scan.template_pairs(), license_scan.telling_words(), {}
    for d, text in docs:
        for n, line in enumerate((text or "").split("\n")):
            words = license_scan.tokens(line)
            bag = license_scan.ngrams(words)
            z = model.bias + sum((model.weights[place[g]] for g in bag if g in place), np.zeros(len(model.bias))) / np.sqrt(max(1, len(bag)))
            p = license_scan._softmax(z[None])[0]
            if p[-1] >= 0.5:
                continue
            k = int(p[:-1].argmax())
            top = np.clip(p[k], 1e-9, 1 - 1e-9)
            sure = 1 / (1 + np.exp(-(model.slope * np.log(top / (1 - top)) + model.offset)))
            two = {" ".join(x) for x in zip(words, words[1:])}
            like = max(len(two & t) for t in pairs[k]) / max(1, len(two))
            named = sure >= license_scan.LEAST_PROBABILITY and like >= license_scan.LEAST_SIMILARITY and set(words) & set(telling[k])
            want[d, n] = (model.classes[k] if named else license_scan.UNKNOWN, sure, like)
    got = {(r["doc_id"], r["paragraph"]): r for r in license_scan.scan(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert set(got) == set(want) and sum(d == 10**6 for d, _ in got) > 0.6 * len(wrapped)
    for key, (family, sure, like) in want.items():
        assert got[key]["family"] == family, (key, got[key])
        assert got[key]["probability"] == pytest.approx(sure, abs=1e-6) and got[key]["similarity"] == pytest.approx(like)


def test_license_table_and_edges(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = docs.filter(F.col("text").rlike(r"(?m)^(Released under the MIT License\.|Licensed under the Apache License, Version 2\.0\.|Licensed under CC BY-NC 4\.0\.|This work is licensed under the GNU General Public License, version 3\.)$"))
    got = license_scan.scan(docs)
    assert {r["doc_id"] for r in want.collect()} <= {r["doc_id"] for r in got.collect()}
    twice = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "Released under the MIT License.")], SCHEMA).withColumn("row", F.lit(1)).withColumn("n", F.lit(1))
    assert license_scan.scan(twice).count() == 3
    assert license_scan.scan(twice.limit(0)).count() == 0


# quality


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    scored = quality.score_documents(docs, model).join(labels, "doc_id").filter(held_out(F.col("doc_id")))
    rows = scored.select("quality", "predicted", "score").collect()
    assert len(rows) > 30 and sum(r["quality"] == r["predicted"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "a b"), (2, "x" * 100_000)], SCHEMA).withColumn("y", F.lit(1)).withColumn("__id", F.lit(1))
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    rows = quality.score_documents(docs, model).collect()
    assert len(rows) == 4 and all(r["score"] == pytest.approx(0.3) for r in rows)
    assert quality.score_documents(docs.limit(0), model).count() == 0


def test_pairs_rank():
    rng = np.random.default_rng(1)
    good, poor = rng.random((60, len(quality.NAMES))) * 0.2, rng.random((40, len(quality.NAMES))) * 0.2
    poor[:, 0] += 0.5
    model = quality.fit_pairs(good, poor, pairs=2000)
    assert model.strength(good).min() > model.strength(poor).max()
    assert (model.score(good) >= quality.CUT).all() and (model.score(poor) < quality.CUT).all()


# toxicity


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def test_automaton_against_distances():
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("abc") for _ in range(n))
    terms = [(make(rng.randint(3, 11)), rng.random() < 0.4) for _ in range(40)]
    lexicon = toxicity.Lexicon(terms, frozenset(terms[:5]))
    hits = 0
    for _ in range(3000):
        word = make(rng.randint(1, 13))
        best = None
        for text, stem, k in lexicon.terms:
            row = slow_distance(text, word)
            d = min(row) if stem else row[-1]
            if d <= k:
                best = min(best or (9, True, ""), (d, stem, text))
        got = lexicon.search(word)
        assert (got and (got[2], got[1], got[0])) == best
        if best:
            hits += 1
            assert lexicon.may.search(word)
    assert hits > 200


def corpus(rng, n, quote=False):
    """Toxic texts abuse; others are clean or, with ``quote``, tell of it in quotation marks."""
    filler = ["".join(rng.choice("aeiorstn") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    bad = ["blatherskite", "nincompoop", "scallywag"]
    for i in range(n):
        words = [rng.choice(filler) for _ in range(60)]
        toxic = i % 3 == 0
        for _ in range(3 if toxic else 2 if quote and i % 3 == 1 else 0):
            w = rng.choice(bad)
            words.insert(rng.randrange(len(words)), w if toxic else f'he reported "{w}" verbatim')
        yield i, " ".join(words), int(toxic)


def test_misspelled_and_quoted(spark):
    rows = list(corpus(random.Random(4), 600, quote=True))
    docs = spark.createDataFrame([r[:2] for r in rows], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    new = [(1, "you are a nincompop and a scalywag, blatherskyte that you are"), (2, 'he reported "nincompoop" verbatim and went home, he reported "scallywag" verbatim'), (3, "a quiet day"), (4, None), (5, "")]
    got = {r["doc_id"]: r for r in toxicity.score_documents(spark.createDataFrame(new, SCHEMA), model).collect()}
    assert got[1]["predicted"] == 1
    assert [got[k]["predicted"] for k in (2, 3, 4, 5)] == [0] * 4
    scored = toxicity.score_documents(docs, model).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).collect()
    assert sum(r["predicted"] == r["toxic"] for r in scored) / len(scored) > 0.95
    kept = toxicity.keep_clean(docs.withColumn("score", F.lit(1)), model)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == sum(r["predicted"] == 0 for r in toxicity.score_documents(docs, model).collect())


def test_toxicity_of_the_tables(spark):
    """Held-out accuracy on labelled documents; twice the same model, however the rows come."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.score_documents(docs, model).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).collect()
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert len(toxic) > 50 and sum(toxic) / len(toxic) > 0.8 and sum(clean) / len(clean) < 0.04
    again = toxicity.fit(docs.repartition(7), labels.repartition(3))
    assert (again.terms, again.strict, again.cues, again.quoted) == (model.terms, model.strict, model.cues, model.quoted)
    assert np.allclose(again.weights, model.weights)


def test_toxicity_edges(spark):
    """Repeated rows teach once and are scored each; an empty table, long texts, nulls and clashing names have defined results."""
    rows = list(corpus(random.Random(4), 200))
    docs = spark.createDataFrame([r[:2] for r in rows] + [rows[0][:2]] * 30 + [(None, None), (500, ""), (501, "word " * 50_000 + "nincompoop nincompoop scallywag blatherskite"), (502, 'x "' * 5000)], SCHEMA)
    docs = docs.withColumns({c: F.lit(3) for c in ("toxic", "score", "predicted", "key", "id", "term")})
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(r[0], r[2]) for r in rows[:9]] + [(None, 1), (7, None)], "doc_id bigint, toxic int").withColumn("text", F.lit("z"))
    model = toxicity.fit(docs, labels)
    out = toxicity.score_documents(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    got = {r["doc_id"]: r["predicted"] for r in out}
    assert (got[None], got[500], got[501], got[502]) == (0, 0, 1, 0)
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs.limit(0), labels).terms == []
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in out)


def test_windows_by_hand():
    text = 'one two "three four" five\nsix "seven eight nine ten eleven twelve thirteen fourteen'
    w = toxicity.Windows(text)
    at = lambda x: w.around(text.index(x), text.index(x) + len(x))
    assert at("three") == (True, ["one", "two", "four", "five"]) and at("five") == (False, ["one", "two", "three", "four"])
    assert at("seven") == (False, ["six", "eight", "nine", "ten", "eleven", "twelve", "thirteen"])


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert [r["predicted"] for r in toxicity.score_documents(docs, model).collect()] == [0, 0]
    assert toxicity.keep_clean(docs.limit(0), model).count() == 0


def test_words_beat_stems():
    rows = [("idio", True, 50, 0), ("idiot", False, 50, 0), ("vequ", True, 60, 0), ("vequta", False, 12, 0), ("vequt", True, 12, 0), ("lost", True, 40, 3), ("lostr", True, 39, 0), ("lostra", True, 39, 0), ("lostran", False, 9, 0)]
    assert toxicity.choose_terms(rows) == [("idiot", False), ("lostr", True), ("vequ", True)]
