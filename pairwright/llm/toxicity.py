"""Toxicity scores from a learned lexicon, matched by Levenshtein automata on a trie.

The lexicon is learned from labelled rows: whole words, and stems (word beginnings), that stand in many toxic texts
and hardly in others. A text's word is matched by running its Levenshtein automaton (one bit mask of reached
positions for each number of errors) down the trie of the lexicon, so misspelled terms are caught too. A window of
words around each hit tells quotation from abuse: quotation marks around the hit, and cue words whose weights are
learned. A logistic regression over the summed hits gives the score.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import logistic
from .common import arrow_map, cut, held_out, spread
from .shingles import minhash, shingle_set

#: Labelled rows, at most, from which a model is learned; they bound its lexicon and cue list too, as each entry stands in several of them.
TOXIC_ROWS, CLEAN_ROWS = 3000, 6000
#: A term must stand in this share of the toxic texts (in three at least) and this many times as often there as elsewhere.
SUPPORT, TIMES = 0.005, 20
#: A stem in this share of the toxic texts is known well enough to be matched with errors.
FUZZY_SUPPORT = 0.02
#: A word must stand in the windows of this many hits to be a cue, and this many clean hits must have been seen to weigh any.
CUE_HITS, CLEAN_HITS = 5, 20
STEM_LENGTHS = (4, 5, 6, 7)
WINDOW = 6

_WORD = re.compile(r"\w+")
_QUOTES = "\"“”«»„‘’‹›"
_QUOTE = re.compile(f"[{_QUOTES}]")
#: Words known to have no hit, at most, that a worker keeps.
_CLEAN_MOST = 1_000_000


def errors_for(term: str, stem: bool) -> int:
    """Errors allowed: none in short terms, one in longer ones, two in words of nine letters or more."""
    n = len(term)
    if stem:
        return 1 if n >= 7 else 0
    return 0 if n < 5 else 1 if n < 9 else 2


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    terms: list[tuple[str, bool, int]] = field(default_factory=list)
    most: int = 0


class Lexicon:
    """Trie of terms (text, is a stem). Terms in ``strict`` must match without error."""

    def __init__(self, terms: list[tuple[str, bool]], strict: frozenset = frozenset()):
        self.terms = [(t, s, 0 if (t, s) in strict else errors_for(t, s)) for t, s in sorted(set(terms))]
        self.root = Node()
        for text, stem, k in self.terms:
            node = self.root
            node.most = max(node.most, k)
            for c in text:
                node = node.children.setdefault(c, Node())
                node.most = max(node.most, k)
            node.terms.append((text, stem, k))
        self.may = self._filter()

    def _filter(self) -> re.Pattern:
        """A word with k errors or fewer keeps one of k + 1 parts of the term: the first at its start, the last of a whole word at its end, others anywhere."""
        starts, ends, inside = set(), set(), set()
        for text, stem, k in self.terms:
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            parts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            starts.add(parts[0])
            for n, p in enumerate(parts[1:], 1):
                (ends if n == k and not stem else inside).add(p)
        one = lambda xs: "|".join(map(re.escape, sorted(xs)))
        either = [f"^(?:{one(starts)})" if starts else "", f"(?:{one(ends)})$" if ends else "", f"(?:{one(inside)})" if inside else ""]
        return re.compile("|".join(x for x in either if x) or r"(?!)")

    def search(self, word: str) -> tuple[str, bool, int] | None:
        """The term with the fewest errors (term, is a stem, errors), or None. Ties go to whole words, then to the first term."""
        n = len(word)
        chi: dict[str, int] = {}
        for i, c in enumerate(word):
            chi[c] = chi.get(c, 0) | 1 << i
        best = None
        start = [(1 << d + 1) - 1 & (1 << n + 1) - 1 for d in range(self.root.most + 1)]
        stack, full = [(self.root, start)], (1 << n + 1) - 1
        while stack:
            node, masks = stack.pop()
            for text, stem, k in node.terms:
                for d in range(min(k, len(masks) - 1) + 1):
                    if masks[d] if stem else masks[d] >> n & 1:
                        key = (d, stem, text)
                        best = key if best is None or key < best else best
                        break
            for c, child in node.children.items():
                step, before = [], None
                for d in range(child.most + 1):
                    m = (masks[d] & chi.get(c, 0)) << 1
                    if d:
                        m |= masks[d - 1] << 1 | masks[d - 1] | before << 1
                    before = m & full
                    step.append(before)
                if any(step):
                    stack.append((child, step))
        return best and (best[2], best[1], best[0])


@dataclass
class Model:
    """What a fit has learned; small, and broadcast. ``weights`` belong to ``features``."""

    terms: list[tuple[str, bool]]
    strict: frozenset
    cues: dict[str, float]
    quoted: float
    weights: np.ndarray


class Matcher:
    """Hits of a worker's texts; remembers what each word matched."""

    def __init__(self, terms: list[tuple[str, bool]], strict: frozenset = frozenset()):
        self.lexicon = Lexicon(terms, strict)
        self.hits: dict[str, tuple[str, bool, int]] = {}
        self.clean: set[str] = set()

    def find(self, text: str) -> list[tuple[int, int, tuple[str, bool, int]]]:
        """(start, end, match) of each word that matches a term. The text is taken in lower case."""
        words = set(_WORD.findall(text))
        new = words - self.clean - self.hits.keys()
        if new:
            if len(self.clean) + len(new) > _CLEAN_MOST:
                self.clean.clear()
            if len(self.hits) > _CLEAN_MOST:
                self.hits.clear()
                new = words
            for w in new:
                got = self.lexicon.search(w) if self.lexicon.may.search(w) else None
                if got:
                    self.hits[w] = got
                else:
                    self.clean.add(w)
        if words.isdisjoint(self.hits):
            return []
        return [(m.start(), m.end(), self.hits[m.group()]) for m in _WORD.finditer(text) if m.group() in self.hits]


class Windows:
    """The surroundings of any hit of a text, from one pass over its words, line ends and quotation marks."""

    def __init__(self, text: str):
        self.text = text
        self.ends = [m.start() for m in re.finditer("\n", text)]
        self.marks = [m.start() for m in _QUOTE.finditer(text)]
        self.words = [m.span() for m in _WORD.finditer(text)]
        self.starts = [a for a, _ in self.words]

    def around(self, start: int, end: int) -> tuple[bool, list[str]]:
        """Whether the hit stands between quotation marks of its line, and the ``WINDOW`` words of the line on either side."""
        line = bisect_left(self.ends, start)
        a = self.ends[line - 1] + 1 if line else 0
        b = self.ends[line] if line < len(self.ends) else len(self.text)
        before = bisect_left(self.marks, start) - bisect_left(self.marks, a)
        after = bisect_left(self.marks, b) - bisect_left(self.marks, end)
        at = bisect_left(self.starts, start)
        near = [*range(max(0, at - WINDOW), at), *range(at + 1, min(len(self.words), at + 1 + WINDOW))]
        return before % 2 == 1 and after > 0, [self.text[x:y] for x, y in (self.words[k] for k in near) if a <= x < b]


#: Measures of a text that ``features`` gives.
N_FEATURES = 6


def features(text: str, hits: list, cues: dict[str, float], quoted_weight: float) -> list[float]:
    """1, whether hits outweigh half a hit, and logarithms of: whole words, stems, hits weighed by their context, distinct terms.

    A hit whose window speaks for quotation counts in none but the weighed sum. A misspelled term counts like the term.
    """
    whole = stems = 0
    weighed, terms = 0.0, set()
    windows = Windows(text) if hits else None
    for a, b, (term, stem, _) in hits:
        quoted, around = windows.around(a, b)
        abuse = 1 / (1 + np.exp(-(2.0 + quoted_weight * quoted + sum(cues.get(w, 0.0) for w in around))))
        weighed += abuse
        if abuse >= 0.5:
            whole += not stem
            stems += stem
            terms.add(term)
    return [1.0, float(weighed >= 0.5), np.log1p(whole), np.log1p(stems), np.log1p(weighed), np.log1p(len(terms))]


#: A stretch of one line between quotation marks.
_QUOTED = re.compile(f"[{_QUOTES.replace('’', '')}][^{_QUOTES}\\n]+[{_QUOTES.replace('‘', '')}]")


def _terms(text: str) -> set[tuple[str, bool]]:
    """Words and stems of a text outside quotation marks, so that a term stays telling where clean texts quote it."""
    out = set()
    for w in set(_WORD.findall(_QUOTED.sub(" ", text.lower()))):
        if len(w) >= 3 and not w.isdigit():
            out.add((w, False))
            out.update((w[:n], True) for n in STEM_LENGTHS if n < len(w))
    return out


def term_counts(train: DataFrame) -> DataFrame:
    """term, stem, toxic, clean: numbers of texts of the training rows (text, toxic) that hold each term."""

    def run(texts: list, toxic: list) -> dict:
        count: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for t, y in zip(texts, toxic, strict=True):
            count[bool(y)].update(_terms(t))
        both = [*(count[True] | count[False])]
        return {"term": [t for t, _ in both], "stem": [s for _, s in both], "toxic": [count[True][x] for x in both], "clean": [count[False][x] for x in both]}

    rows = arrow_map(train.select("text", "toxic"), run, "term string, stem boolean, toxic bigint, clean bigint")
    return rows.groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_terms(rows: list[tuple[str, bool, int, int]]) -> list[tuple[str, bool]]:
    """Of the terms that pass, the most telling form of each family: a whole word if it makes up its stem, else the shortest stem that is as clean as the longer ones."""
    count = {(t, s): (a, b) for t, s, a, b in rows}
    kept = set(count)
    for (t, s), (a, b) in sorted(count.items()):
        for n in STEM_LENGTHS:
            short = (t[:n], True)
            if n > len(t) or (n == len(t) and s) or short not in kept or (t, s) not in kept:
                continue
            sa, sb = count[short]
            if a >= 0.9 * sa and (not s or b < sb):
                kept.discard(short)
            else:
                kept.discard((t, s))
    return sorted(kept)


def training_rows(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """text, toxic of the bounded sample of labelled rows outside the held-out fold, one row of each group of near copies."""
    own = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct()
    some = spread(own.filter("toxic <> 0"), F.col("id"), TOXIC_ROWS).unionByName(spread(own.filter("toxic = 0"), F.col("id"), CLEAN_ROWS))
    texts = documents.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(some), "id")  # the sample's bound bounds the broadcast

    def key(ids: list, labels_: list, texts_: list) -> dict:
        near = [minhash(shingle_set(t))[:2] for t in texts_]  # copies at 0.8 agree in both more often than not, unlike texts hardly ever
        return {"id": ids, "toxic": labels_, "text": texts_, "key": [int(a) << 31 ^ int(b) for a, b in near]}

    keyed = arrow_map(rows.select("id", "toxic", "text"), key, "id bigint, toxic int, text string, key bigint", rows=256)
    # the row of the least id stands for its group, so that every run learns from the same rows
    return cut(keyed.groupBy("key", "toxic").agg(F.min(F.struct("id", "text")).alias("first")).select("first.text", "toxic"))


def may_err(stem: bool, support: int, toxic: int, clean: int, n_toxic: int, n_clean: int) -> bool:
    """Whether a term is matched with errors: by the measured rates of its near misses outside quotation marks.

    A term whose near misses no clean row has may err, a stem only with ``FUZZY_SUPPORT``, as many words begin alike.
    One with some may if its near misses are ``TIMES`` as frequent in toxic rows as in clean ones.
    """
    if stem and support < FUZZY_SUPPORT * n_toxic:
        return False
    return clean == 0 or (toxic + 0.5) / (n_toxic + 1) >= TIMES * (clean + 0.5) / (n_clean + 1)


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn lexicon, cues and weights. Without toxic or without other training rows the model has no terms and scores 0.5 or less."""
    train = training_rows(documents, labels, id_col, text_col, label_col)
    sizes = {bool(r["toxic"]): r["count"] for r in train.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return Model([], frozenset(), {}, 0.0, np.array([-3.0] + [0.0] * (N_FEATURES - 1)))
    rate = (F.col("toxic") + 0.5) / (n_toxic + 1) / ((F.col("clean") + 0.5) / (n_clean + 1))
    telling = term_counts(train).filter((F.col("toxic") >= max(3, SUPPORT * n_toxic)) & (rate >= TIMES))
    rows = telling.orderBy(F.desc("toxic"), "term", "stem").collect()  # each in SUPPORT of the sample's toxic rows
    terms = choose_terms([(r["term"], r["stem"], r["toxic"], r["clean"]) for r in rows])

    def wrong(texts: list, toxic: list) -> dict:
        """Near misses of the terms outside quotation marks, once a text."""
        matcher = Matcher(terms)
        found = [(h, bool(y)) for t, y in zip(texts, toxic, strict=True) for h in {x[2][:2] for x in matcher.find(_QUOTED.sub(" ", t.lower())) if x[2][2]}]
        return {"term": [t for (t, _), _ in found], "stem": [s for (_, s), _ in found], "toxic": [y for _, y in found]}

    missed = arrow_map(train.select("text", "toxic"), wrong, "term string, stem boolean, toxic boolean").groupBy("term", "stem").agg(F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean"))
    near_misses = {(r["term"], r["stem"]): (r["toxic"], r["clean"]) for r in missed.collect()}  # of the lexicon's terms
    support = {(r["term"], r["stem"]): r["toxic"] for r in rows}
    strict = frozenset(x for x in terms if not may_err(x[1], support[x], *near_misses.get(x, (0, 0)), n_toxic, n_clean))

    def near(texts: list, toxic: list) -> dict:
        """Windows around hits: (toxic, quoted, words)."""
        matcher, out = Matcher(terms, strict), {"toxic": [], "word": [], "n": []}
        count: Counter = Counter()
        for t, y in zip(texts, toxic, strict=True):
            low = t.lower()
            hits = matcher.find(low)
            windows = Windows(low) if hits else None
            for a, b, _ in hits:
                quoted, around = windows.around(a, b)
                count.update({(y, w) for w in around} | {(y, "\n")} | ({(y, '"')} if quoted else set()))
        for (y, w), n in count.items():
            out["toxic"].append(y)
            out["word"].append(w)
            out["n"].append(n)
        return out

    seen = arrow_map(train.select("text", "toxic"), near, "toxic int, word string, n bigint").groupBy("word").agg(F.sum(F.when(F.col("toxic") != 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    frequent = seen.filter((F.col("a") + F.col("c") >= CUE_HITS) | F.col("word").isin("\n", '"')).collect()  # words near hits of the sample
    count = {r["word"]: (r["a"], r["c"]) for r in frequent}
    total_a, total_c = count.get("\n", (0, 0))
    odds = lambda w: float(np.clip(np.log((count.get(w, (0, 0))[0] + 1) / (total_a + 2)) - np.log((count.get(w, (0, 0))[1] + 1) / (total_c + 2)), -3, 3))
    enough = total_c >= CLEAN_HITS  # too few hits outside abuse teach nothing about context
    cues = {w: odds(w) for w in count if enough and w not in ("\n", '"') and abs(odds(w)) > 1}
    quoted = odds('"') if enough else -1.0
    model = Model(terms, strict, cues, quoted, np.zeros(N_FEATURES))

    def measure(texts: list, toxic: list) -> dict:
        matcher = Matcher(terms, strict)
        x = [features(t.lower(), matcher.find(t.lower()), cues, quoted) for t in texts]
        return {"toxic": toxic, **{f"x{k}": [r[k] for r in x] for k in range(N_FEATURES)}}

    schema = "toxic int, " + ", ".join(f"x{k} double" for k in range(N_FEATURES))
    data = np.array([list(r) for r in arrow_map(train.select("text", "toxic"), measure, schema).collect()], dtype=float)  # bounded by the sample
    model.weights = logistic.fit(data[:, 1:], (data[:, 0] != 0).astype(float), l2=0.05, free=1)
    return model


def _scorer(spark, model: Model) -> Callable[[list], np.ndarray]:
    shared = spark.sparkContext.broadcast(model)
    state: list = []

    def score(texts: list) -> np.ndarray:
        if not state:
            state.append(Matcher(shared.value.terms, shared.value.strict))
        m = shared.value
        low = [(t or "").lower() for t in texts]
        x = np.array([features(t, state[0].find(t), m.cues, m.quoted) for t in low]).reshape(-1, N_FEATURES)
        return logistic.sigmoid(x @ m.weights)

    return score


def score_documents(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted of every whole text, row by row. A null text is the empty text, which has no hit; nothing else of the row is read."""
    score = _scorer(documents.sparkSession, model)

    def run(ids: list, texts: list) -> dict:
        s = score(texts)
        return {"doc_id": ids, "score": s, "predicted": (s >= threshold).astype(np.int32)}

    return arrow_map(documents.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")), run, "doc_id bigint, score double, predicted int", rows=512)


def keep_clean(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows with a score below the threshold, all columns as they are; no row moves."""
    score = _scorer(documents.sparkSession, model)
    at = documents.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield part.filter(pa.array(score(part.column(at).to_pylist()) < threshold))

    return documents.mapInArrow(run, documents.schema)
