"""Quality classifier by Bradley-Terry ranking.

A document's strength is a weighted sum of measures of its text. The weights are learned from preference pairs (a
labelled good text is preferred to a labelled poor one) by logistic loss on the difference of their measures, which is
the Bradley-Terry model. The threshold is a quantile of the training rows' strengths, the one that parts them best,
and strengths are put on a scale from 0 to 1 on which the threshold is ``CUT``.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import logistic
from .common import arrow_map, held_out, spread

#: Labelled rows, at most, of either label, and preference pairs, at most, from which the model is learned.
ROWS, PAIRS = 8000, 60_000
CUT = 0.3
QUANTILES = 400

_MARKS = "!#$%&*|"
_RUN = re.compile(r"[A-Za-z0-9]{24,}")
NAMES = (
    "capitals", "mark_words", *[f"mark_{i}" for i in range(len(_MARKS))], "repeats", "far_repeats", "distinct", "line_repeats", "digits", "word_length", "long_words", "ends", "n_words", "lines",
)


def measures(text: str) -> list[float]:
    """Shares and logarithms that tell prose from shouting, symbol noise, tables, word repetition and boilerplate. All zero for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    letters = max(1, len(text))
    marks = [text.count(c) for c in _MARKS]
    lines = [x for x in text.split("\n") if x]
    ordered = [
        sum(map(str.isupper, words)) / n,
        sum(marks) / n,
        *[m / n for m in marks],
        sum(map(operator.eq, words, words[1:])) / n,
        sum(map(operator.eq, words, words[2:])) / n,
        1 - len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(text.count(d) for d in "0123456789") / letters,
        letters / n / 10,
        sum(len(x) for x in _RUN.findall(text)) / letters,
        (text.count(".") + text.count(",")) / n,
    ]
    return [*ordered, np.log1p(n) / 10, np.log1p(len(lines)) / 10]


def basis(x: np.ndarray) -> np.ndarray:
    """Each measure, its square root and steps, so that a strength can rise or fall unevenly with it."""
    x = np.asarray(x, dtype=float).reshape(-1, len(NAMES))
    return np.concatenate([x, np.sqrt(np.abs(x)), *[(x > t).astype(float) for t in (0.02, 0.1, 0.3, 0.6)]], axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((basis(x) - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return logistic.sigmoid(self.slope * (self.strength(x) - self.cut) + np.log(CUT / (1 - CUT)))


def fit_pairs(good: np.ndarray, poor: np.ndarray, pairs: int = PAIRS, seed: int = 11) -> Model:
    """Model from the measures of good and of poor texts. With none of either kind all strengths are equal."""
    both = basis(np.concatenate([good.reshape(-1, len(NAMES)), poor.reshape(-1, len(NAMES))]))
    wide = both.shape[1]
    if not len(good) or not len(poor):
        return Model(np.zeros(wide), np.ones(wide), np.zeros(wide), 0.0, 1.0)
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    z = (both - mean) / scale
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, len(good), pairs), len(good) + rng.integers(0, len(poor), pairs)
    diff = z[a] - z[b]
    flip = rng.random(pairs) < 0.5  # the loss is the same for (winner, loser) and its mirror image
    diff[flip] *= -1
    weights = logistic.fit(diff, (~flip).astype(float), l2=30.0)
    s, y = z @ weights, np.concatenate([np.ones(len(good)), np.zeros(len(poor))])
    grid = np.quantile(s, np.linspace(0, 1, QUANTILES + 1))
    middle = (grid[1:] + grid[:-1]) / 2
    right = [((s >= c) == (y == 1)).mean() for c in middle]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-12)
    cut = float(middle[best[len(best) // 2]])
    w = logistic.fit(np.stack([np.ones(len(s)), s - cut], axis=1), y, l2=1e-3, free=1)
    return Model(mean, scale, weights, cut, float(np.clip(w[1], 0.05, 50)))


def measured(documents: DataFrame, id_col: str, text_col: str, more: tuple[str, ...] = ()) -> DataFrame:
    """id, ``more`` and the measures of each row."""

    def run(ids: list, texts: list, *rest: list) -> dict:
        x = [measures(t or "") for t in texts]
        return {"doc_id": ids, **dict(zip(more, rest, strict=True)), **{f"x{k}": [r[k] for r in x] for k in range(len(NAMES))}}

    schema = ", ".join(["doc_id bigint", *[f"{c} int" for c in more], *[f"x{k} double" for k in range(len(NAMES))]])
    return arrow_map(documents.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"), *more), run, schema, rows=512)


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from at most ``ROWS`` rows of either label outside the held-out fold. Rows with a null id or label teach nothing."""
    own = labels.select(F.col(id_col).cast("bigint").alias("__id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("__id").isNotNull() & ~held_out(F.col("__id"))).distinct()
    some = spread(own.filter("y <> 0"), F.col("__id"), ROWS).unionByName(spread(own.filter("y = 0"), F.col("__id"), ROWS))
    texts = documents.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias("__text"))
    rows = texts.join(F.broadcast(some), "__id")  # the sample's bound bounds the broadcast
    data = np.array([list(r) for r in measured(rows, "__id", "__text", ("y",)).drop("doc_id").collect()], dtype=float).reshape(-1, 1 + len(NAMES))
    return fit_pairs(data[data[:, 0] != 0, 1:], data[data[:, 0] == 0, 1:])


def score_documents(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, strength, score, predicted (1 from ``CUT`` on) of every whole text, row by row. A null text is the empty text, whose measures are all zero."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(ids: list, texts: list) -> dict:
        x = np.array([measures(t or "") for t in texts])
        s = shared.value.score(x)
        return {"doc_id": ids, "strength": shared.value.strength(x), "score": s, "predicted": (s >= CUT).astype(np.int32)}

    return arrow_map(documents.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")), run, "doc_id bigint, strength double, score double, predicted int", rows=512)
