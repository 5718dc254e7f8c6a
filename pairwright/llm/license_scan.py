"""License scans by a trained paragraph classifier, scored with DataFrame functions only.

A paragraph (a line of a text) is a bag of word 1- to 3-grams. A multinomial logistic regression with one class per
license family and one for other prose is trained on the driver from ``TEMPLATES`` and seeded variations of them; its
weights are a table of n-grams. Paragraphs are scored by joining their n-grams with that table. How sure a family is
is calibrated on families left out in turn, so a license of no known family comes out as 'unknown'. The prediction is
confirmed by comparison with the family's templates: the share of the paragraph's word pairs that the nearest one has.

Every paragraph that can have a row is scored. Those without an anchor word are left out first: the anchors are chosen
from the weights so that whatever else a paragraph without one holds, other prose stays the likelier class.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import logistic

#: Notices of public licenses, by family.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "CC0": (
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
        "This work is dedicated to the public domain under CC0 1.0.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ),
}

#: Prose that shares words with licenses and is none.
OTHER = (
    "His driving license was suspended for three months after the accident.", "The city council voted to license new taxi operators this spring.", "She renewed her fishing licence at the harbour office.",
    "You need written permission from a parent to join the trip.", "The software crashed when the user copied the file.", "The warranty on the washing machine ran out last year.",
    "Please use the main entrance, the rear door is closed.", "The terms of the agreement were published by the ministry.", "A copy of the letter is in the archive.", "The foundation gave free meals to the public.",
    "He was licensed to practise medicine in two states.", "Conditions on the road got worse during the night.", "The general said that the version of the story was wrong.", "Under the bridge there is a public garden.",
    "The domain of the function is the set of real numbers.", "The author dedicated the book to her mother.", "Rights and duties of citizens are a common subject of debate.", "The source of the river lies in the north.",
    "The distribution of rainfall is uneven.", "Any person may attend the meeting without charge.", "All rooms are reserved for members.", "They released the birds in the morning.", "The work is subject to review by the board.",
    "Copyright law is taught in the second year.", "The court held that the license fee was a tax.", "Permission to land was granted at noon.", "The apache helicopter landed near the base.", "Students at MIT built a robot that can swim.",
    "Mozilla moved its office to another street.", "The notice on the door said that the shop was closed.", "This file lists the names of the contributors.", "The commons were used to graze sheep.", "the of in and to a is for with on as by at from",
)

UNKNOWN, NONE = "unknown", "none"
#: Least share of a paragraph's word pairs in a template, and least probability of a family, for a confirmed prediction.
LEAST_SIMILARITY, LEAST_PROBABILITY = 0.5, 0.5
#: Families, at most, that share a word which tells each of them.
TELLING = 3
VARIATIONS, BLANKS, SEED = 12, 150, 5
#: Words of the pieces, each half over the one before, into which templates are cut for training as wrapped lines cut them.
PIECES = (6, 12)
#: Families count alike in training, and other prose, which is much commoner, this much more.
NONE_WEIGHT = 4.0
_COMMON = OTHER[-1].split()
#: Function words, which tell nothing where they stand alone or out of order.
LOOSE = (*_COMMON, *"an any are be been but can do has have he her his if it its may no not only or our out she so such than that their them these they this those up was we were what where which who will you your".split())

_SPLIT = r"[^\p{L}\p{N}]+"
_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def ngrams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def _variation(rng: np.random.Generator, words: list[str], fillers: list[str]) -> list[str]:
    """The paragraph with words lost or replaced, cut at an end, or with words around it."""
    out = [w if (x := rng.random()) > 0.08 else str(rng.choice(fillers)) for w in words if rng.random() > 0.05 or len(words) < 8]
    if len(out) > 12 and rng.random() < 0.5:
        out = out[int(rng.integers(0, len(out) // 3)) :][: int(rng.integers(len(out) // 2, len(out) + 1))]
    if rng.random() < 0.4:
        out = [str(rng.choice(fillers)) for _ in range(int(rng.integers(1, 6)))] + out
    return out or words


@dataclass(frozen=True)
class Model:
    """classes (families, then none), n-gram -> weight of each class, intercepts, calibration (slope, offset) of a family's logit, and anchors."""

    classes: tuple[str, ...]
    grams: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    slope: float
    offset: float
    anchors: tuple[str, ...]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _train(bags: list[set[str]], y: np.ndarray, classes: int, vocabulary: dict[str, int], l2: float = 2e-4, steps: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts by gradient descent with momentum; a bag's n-grams count 1 over the root of their number."""
    x = np.zeros((len(bags), len(vocabulary)), dtype=np.float32)
    for r, bag in enumerate(bags):
        own = [vocabulary[g] for g in bag if g in vocabulary]
        x[r, own] = 1 / np.sqrt(max(1, len(bag)))
    w, b, vw, vb = np.zeros((x.shape[1], classes)), np.zeros(classes), 0.0, 0.0
    share = np.bincount(y, minlength=classes)[y]
    weight = (1 / np.maximum(share, 1)) * len(y) / classes * np.where(y == classes - 1, NONE_WEIGHT, 1)
    for _ in range(steps):
        d = (_softmax(x @ w + b) - np.eye(classes)[y]) * weight[:, None] / len(y)
        vw, vb = 0.9 * vw - 8.0 * (x.T @ d + l2 * w), 0.9 * vb - 8.0 * d.sum(axis=0)
        w, b = w + vw, b + vb
    return w, b


def _margin(w: np.ndarray, b: np.ndarray, vocabulary: dict[str, int], bags: list[set[str]], skip: int | None = None) -> np.ndarray:
    """Logit of the likeliest family of each bag against the rest."""
    z = np.array([b + sum((w[vocabulary[g]] for g in bag if g in vocabulary), np.zeros(len(b))) / np.sqrt(max(1, len(bag))) for bag in bags])
    p = _softmax(z)[:, :-1]
    if skip is not None:
        p[:, skip] = 0
    top = np.clip(p.max(axis=1), 1e-9, 1 - 1e-9)
    return np.log(top / (1 - top))


def choose_anchors(grams: tuple[str, ...], weights: np.ndarray, bias: np.ndarray) -> tuple[str, ...]:
    """Words and word pairs such that a paragraph without one is other prose for certain, whatever else it holds.

    A family's logit over other prose is at most its intercept plus the sum of its m greatest positive weights over the
    root of m, for some m, as a bag has at least as many n-grams as count. Words are left out of the anchors, function
    words and short ones first, while they alone cannot lift the families together above one half; pairs of words left
    out that lie in an n-gram that counts are anchors, so no longer n-gram of theirs is without one.
    """
    gain = np.maximum(weights - weights[:, -1:], 0)[:, :-1]
    need = -np.log(np.exp((bias - bias[-1])[:-1]).sum()) - 1e-6
    made = [g.split() for g in grams]
    alone = {g: gain[i] for i, g in enumerate(grams) if len(made[i]) == 1}

    def harmless(left: set[str]) -> bool:
        own = -np.sort(-np.array([alone[w] for w in left if w in alone]).reshape(-1, gain.shape[1]), axis=0)
        return (np.cumsum(own, axis=0) / np.sqrt(np.arange(1, len(own) + 1))[:, None]).max(initial=0.0) < need

    words, left = {w for g in made for w in g}, set()
    for w in sorted(words, key=lambda w: (w not in LOOSE, len(w), w)):
        if harmless(left | {w}):
            left.add(w)
    pairs = {" ".join(g[i : i + 2]) for g in made for i in range(len(g) - 1) if set(g[i : i + 2]) <= left}
    return tuple(sorted((words - left) | pairs))


@lru_cache(maxsize=1)
def train() -> Model:
    """Train on templates, other prose and their variations; the same result each time."""
    rng = np.random.default_rng(SEED)
    families = tuple(TEMPLATES)
    fillers = [w for p in OTHER for w in tokens(p)]
    bags, y = [], []
    for k, texts in enumerate((*TEMPLATES.values(), OTHER)):
        for t in texts:
            words = tokens(t)
            for v in range(VARIATIONS if k < len(families) else 3):
                bags.append(ngrams(words if v == 0 else _variation(rng, words, fillers)))
                y.append(k)
            for n in PIECES if k < len(families) else ():
                for i in range(0, len(words) - n // 2, n // 2) if len(words) > n else ():
                    bags.append(ngrams(words[i : i + n]))
                    y.append(k)
    for w in LOOSE:
        bags.append({w})
        y.append(len(families))
    for _ in range(BLANKS):  # function words in any order
        bags.append(ngrams([str(rng.choice(LOOSE)) for _ in range(int(rng.integers(1, 8)))]))
        y.append(len(families))
    for _ in range(BLANKS):  # prose of words that no template has, among the commonest ones
        n = int(rng.integers(3, 40))
        bags.append(ngrams([f"{x}" if x % 3 else str(rng.choice(_COMMON)) for x in rng.integers(10**6, 10**7, n)]))
        y.append(len(families))
    y = np.array(y)
    plain = {w for p in OTHER for w in tokens(p)}
    grams = sorted({g for t in TEMPLATES.values() for p in t for g in ngrams(tokens(p)) if not set(g.split()) <= (set(_COMMON) if g.count(" ") == 2 else plain)})
    vocabulary = {g: i for i, g in enumerate(grams)}
    w, b = _train(bags, y, len(families) + 1, vocabulary)
    known, logits = [], []
    for k in range(len(families)):  # what a family looks like to a model that has never seen it
        rest = y != k
        w2, b2 = _train([x for x, r in zip(bags, rest, strict=True) if r], y[rest], len(families) + 1, vocabulary, steps=60)
        out = _margin(w2, b2, vocabulary, [x for x, r in zip(bags, rest, strict=True) if not r], k)
        logits += [*out, *_margin(w, b, vocabulary, [x for x, r in zip(bags, rest, strict=True) if not r])]
        known += [0] * len(out) + [1] * len(out)
    x = np.stack([np.ones(len(logits)), np.array(logits)], axis=1)
    offset, slope = logistic.fit(x, np.array(known, dtype=float), l2=1e-2, free=1)
    return Model((*families, NONE), tuple(grams), w, b, float(slope), float(offset), choose_anchors(tuple(grams), w, b))


def weight_table(spark: SparkSession, model: Model) -> DataFrame:
    """gram (hash), w array<double>: fixed by the templates, some thousand rows."""
    rows = [(g, [float(v) for v in model.weights[i]]) for i, g in enumerate(model.grams)]
    return spark.createDataFrame(rows, "g string, w array<double>").select(F.xxhash64("g").alias("gram"), "w")


def template_pairs() -> list[list[set[str]]]:
    """The word pairs of each template of each family."""
    return [[{" ".join(p) for p in zip(w, w[1:], strict=False)} for w in map(tokens, texts)] for texts in TEMPLATES.values()]


def telling_words() -> list[list[str]]:
    """For each family the words that tell it: of two letters or more, no function words, in templates of ``TELLING`` families at most.

    A license of a family that is not known shares its phrases with known ones but hardly such a word, so a
    prediction without one is not confirmed.
    """
    own = [{w for t in texts for w in tokens(t)} for texts in TEMPLATES.values()]
    return [sorted(w for w in words if len(w) > 1 and w not in LOOSE and not w.isdigit() and sum(w in x for x in own) <= TELLING) for words in own]


def _words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), _SPLIT), lambda w: w != "")


def candidates(documents: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """row, doc_id, paragraph, line, words: the paragraphs with an anchor, numbered from 0 in their text."""
    # words are made before the lines are dealt out, so that no later expression takes a line apart again for each of its n-grams
    lines = F.transform(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n", -1), lambda x: F.struct(x.alias("line"), _words(x).alias("words")))
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), lines.alias("lines"))
    each = rows.select("row", "doc_id", F.posexplode_outer("lines").alias("paragraph", "x")).select("row", "doc_id", "paragraph", "x.line", "x.words")
    pairs = F.zip_with("words", F.slice("words", F.lit(2), F.size("words")), lambda a, b: F.concat(a, F.lit(" "), b))  # null after the last word
    return each.filter(F.arrays_overlap(F.concat("words", pairs), F.array(*[F.lit(a) for a in model.anchors])))


def _grams(words: Column, n: int) -> Column:
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " "))))


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, confirmed, line: one row for each paragraph that reads as a license.

    ``family`` is 'unknown' where the paragraph is license text but no family is likely enough, like enough to a
    template and named by a word that tells it. Paragraphs of ordinary prose have no row, so null and empty texts have none. Repeated rows each have
    theirs. An empty table gives no rows.
    """
    spark, model = documents.sparkSession, model or train()
    found = candidates(documents, id_col, text_col, model)
    key = ["row", "doc_id", "paragraph", "line"]
    grams = F.concat(*[_grams(F.col("words"), n) for n in (1, 2, 3)])
    # outer generators, whose input is not made a second time to filter it; what one makes is made once
    made = found.select(*key, F.explode_outer(F.array(grams)).alias("grams"))
    bags = made.select(*key, F.size("grams").alias("n"), F.array_intersect("grams", F.array(*[F.xxhash64(F.lit(g)) for g in model.grams])).alias("grams"))
    # a table of a size fixed by the templates
    scored = bags.select(*key, "n", F.explode_outer("grams").alias("gram")).join(F.broadcast(weight_table(spark, model)), "gram")
    sums = scored.groupBy(*key).agg(F.first("n").alias("n"), *[F.sum(F.get("w", F.lit(k))).alias(f"z{k}") for k in range(len(model.classes))])
    logits = F.array(*[F.col(f"z{k}") / F.sqrt(F.col("n")) + F.lit(float(model.bias[k])) for k in range(len(model.classes))])
    z = sums.select(*key, logits.alias("z")).withColumn("top", F.array_max("z"))
    z = z.withColumn("e", F.transform("z", lambda x: F.exp(x - F.col("top")))).withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    families = F.slice("e", 1, len(model.classes) - 1)
    z = z.withColumn("best", F.array_max(families) / F.col("total")).withColumn("k", (F.array_position(families, F.array_max(families)) - 1).cast("int"))
    z = z.withColumn("none", F.get("e", F.lit(len(model.classes) - 1)) / F.col("total")).filter("none < 0.5")
    safe = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("best")))
    z = z.withColumn("probability", 1 / (1 + F.exp(-(model.slope * F.log(safe / (1 - safe)) + model.offset))))
    z = z.withColumn("words", F.explode_outer(F.array(_words(F.col("line"))))).withColumn("two", F.explode_outer(F.array(_grams(F.col("words"), 2))))
    like = lambda pairs: F.size(F.array_intersect("two", F.array(*[F.xxhash64(F.lit(p)) for p in sorted(pairs)]))) / F.greatest(F.size("two"), F.lit(1))
    own = reduce(lambda rest, k: F.when(F.col("k") == k, F.array_max(F.array(*map(like, template_pairs()[k])))).otherwise(rest), range(len(TEMPLATES)), F.lit(0.0))
    z = z.withColumn("similarity", own)
    told = reduce(lambda rest, k: F.when(F.col("k") == k, F.arrays_overlap("words", F.array(*map(F.lit, telling_words()[k])))).otherwise(rest), range(len(TEMPLATES)), F.lit(False))
    z = z.withColumn("confirmed", (F.col("probability") >= LEAST_PROBABILITY) & (F.col("similarity") >= LEAST_SIMILARITY) & told)
    name = F.get(F.array(*[F.lit(c) for c in model.classes]), F.col("k"))
    return z.select("doc_id", F.col("paragraph").cast("bigint").alias("paragraph"), F.when(F.col("confirmed"), name).otherwise(F.lit(UNKNOWN)).alias("family"), "probability", "similarity", "confirmed", "line")
