"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Each benchmark item is cut into windows of ``WINDOW`` characters, one each ``STEP``, so any run of ``WINDOW + STEP - 1``
characters of an item holds one whole, and into wider ones, on which as many edits may lie less evenly; a document holds a leak if a stretch of it is within the edit budget ``e`` (8 %
of the window's length) of a window. By the q-gram lemma such a stretch shares at least
``m - q + 1 - q * e`` of the window's m - q + 1 q-grams, all on diagonals that differ by e at most. So the q-gram hits
of a text are counted in diagonal bands that overlap by half, bands that reach the bound are kept as regions, and each
region is aligned inside its band. Texts are compared in lower case with white space runs as one space.

The benchmark's q-grams are an index of bounded size: if the table is larger than ``BLOCK_CHARS``, it is taken block by
block, each against all documents, and only one block's index exists at a time. Long texts are searched in slices that
overlap, and q-gram hits are counted ``HITS`` at a time, so neither long texts nor common q-grams need more memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut

Q = 10
WINDOW, STEP = 100, 25
#: Wider windows of longer items; an item of up to ``REACH`` characters is a window itself. No window is longer.
WIDE, WIDE_STEP = 160, 80
REACH = WIDE + WIDE_STEP
BUDGET = 0.08
#: Characters of benchmark text that one index may hold; each stands in ``WINDOW / STEP`` windows.
BLOCK_CHARS = 4_000_000
#: Characters of text that are filtered at a time, and characters on either side of a slice of a longer text that it shares with its neighbours.
CHUNK, MARGIN = 1_000_000, 1_000
#: Q-gram hits that are counted at a time.
HITS = 2_000_000
#: Regions that are aligned at a time.
REGIONS = 512
#: Rows of a result that a worker gathers.
ROWS = 4096
_BITS = 22
_ODD = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(Q)], dtype=np.uint64)


def normal(text: str) -> str:
    """Lower case, character by character so that no length changes, with white space runs as one space."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return " ".join(low.split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(code: np.ndarray) -> np.ndarray:
    """Hash of the q-gram at each position."""
    n = len(code) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    wide, h = code.astype(np.uint64), np.zeros(n, dtype=np.uint64)
    for k in range(Q):
        h += wide[k : k + n] * _ODD[k]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def budget(m: int) -> int:
    """Edits allowed in a window of m characters: the share, or as many as keep the lemma's bound at 1 or above."""
    return max(0, min(int(BUDGET * m), (m - Q) // Q))


@dataclass
class Index:
    """Windows of benchmark items and the places of their q-grams."""

    item: np.ndarray
    text: list[np.ndarray]
    edits: np.ndarray
    need: np.ndarray
    gram: np.ndarray
    first: np.ndarray
    window: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    short: dict[str, list[int]]


def windows(text: str) -> list[str]:
    """The text, if it is no longer than one window; else overlapping windows of either width, the last of each ending with the text. A text of up to ``REACH`` characters is its own wide one."""
    if len(text) <= WINDOW:
        return [text] if text else []
    each = lambda width, step: [text[a : a + width] for a in (*range(0, len(text) - width, step), len(text) - width)]
    return (each(WIDE, WIDE_STEP) if len(text) > REACH else [text]) + each(WINDOW, STEP)


def build_index(items: list[tuple[int, str]]) -> Index:
    """Items shorter than a q-gram and one edit (2 q characters) can leak only as they stand, between word ends."""
    cut = [(i, w) for i, t in items for w in windows(normal(t or ""))]
    short: dict[str, list[int]] = {}
    for i, w in cut:
        if len(w) < Q:
            short.setdefault(w, []).append(i)
    cut = [(i, w) for i, w in cut if len(w) >= Q]
    text = [codes(w) for _, w in cut]
    edits = np.array([budget(len(t)) for t in text], dtype=np.int64)
    need = np.array([len(t) - Q + 1 for t in text], dtype=np.int64) - Q * edits
    each = [grams(t) for t in text]
    gram = np.concatenate(each) if each else np.zeros(0, dtype=np.uint64)
    window = np.repeat(np.arange(len(each), dtype=np.int32), [len(g) for g in each])
    place = np.concatenate([np.arange(len(g), dtype=np.int16) for g in each]) if each else np.zeros(0, dtype=np.int16)
    order = np.argsort(gram, kind="stable")
    unique, first = np.unique(gram[order], return_index=True)
    seen = np.zeros(1 << _BITS, dtype=bool)
    seen[(unique >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return Index(np.array([i for i, _ in cut], dtype=np.int64), text, edits, need, unique, np.append(first, len(gram)), window[order], place[order], seen, short)


def half_band(index: Index) -> int:
    """Bands are twice as wide and start at each multiple of it."""
    return int(index.edits.max(initial=0)) + 1


def regions(index: Index, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, diagonal of the band's start) of each band whose q-gram hits reach the window's bound, in batches by position.

    Hits come by their position in the text, so a band whose diagonals lie far enough back can get no more: its count
    is settled and forgotten, and only the bands of the last few hundred characters are carried on.
    """
    if not len(index.gram):
        return
    h = grams(code)
    at = np.flatnonzero(index.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
    where = np.searchsorted(index.gram, h[at])
    where[where == len(index.gram)] = 0
    ok = index.gram[where] == h[at]
    at, where = at[ok], where[ok]
    last = np.cumsum(index.first[where + 1] - index.first[where])
    half, span = half_band(index), (len(code) + REACH) // half_band(index) + 3
    rest = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * 2
    total = int(last[-1]) if len(last) else 0
    for lo in range(0, total, HITS):
        n = np.arange(lo, min(lo + HITS, total))
        row = np.searchsorted(last, n, "right")
        entry = index.first[where[row] + 1] - (last[row] - n)
        window, diagonal = index.window[entry].astype(np.int64), at[row] - index.place[entry] + REACH
        ended = n[-1] + 1 == total
        far = int(at[np.searchsorted(last, n[-1] + 1, "right")]) if not ended else 0  # the position of the next hit
        found_w, found_d = [], []
        for shift in (0, 1):
            key, first = np.unique(window * span + (diagonal // half + shift) // 2, return_counts=True)
            both = np.concatenate([rest[shift][0], key])
            key, owner = np.unique(both, return_inverse=True)
            count = np.bincount(owner, weights=np.concatenate([rest[shift][1], first]), minlength=len(key)).astype(np.int64)
            start = (key % span * 2 - shift) * half - REACH
            open_ = np.zeros(len(key), dtype=bool) if ended else start + 2 * half + REACH >= far
            rest[shift] = (key[open_], count[open_])
            good = ~open_ & (count >= index.need[key // span])
            found_w.append(key[good] // span)
            found_d.append(start[good])
        if sum(map(len, found_w)):
            pair = np.unique(np.stack([np.concatenate(found_w), np.concatenate(found_d)]), axis=1)
            yield pair[0], pair[1]


def align(patterns: list[np.ndarray], code: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits of each whole pattern against any stretch of code[start:end] on diagonals low .. low + width, with the stretch's start and end.

    All regions are aligned at once, row by row. Cell (i, k) of a band stands for i characters of the pattern and
    position i + low + k of the text. Moves along the text inside a row are resolved by a running minimum. Starts are
    carried as the low part of a cell; all positions count from the text's start.
    """
    n, size, big = len(patterns), np.array([len(p) for p in patterns]), 1 << 52
    letters = np.zeros((int(size.max()), n), dtype=np.uint32)
    for r, p in enumerate(patterns):
        letters[: len(p), r] = p
    k = np.arange(width + 1)
    step, last = k << 32, np.full((n, 1), big)
    first, limit = start[:, None], end[:, None]
    at = low[:, None] + k
    cell = np.where((at >= first) & (at <= limit), at - first, big)  # (edits << 32) + start
    out = np.zeros((3, n), dtype=np.int64)
    for i in range(1, len(letters) + 1):
        at = at + 1
        ok = (at >= first) & (at <= limit)
        wrong = (code[np.clip(at - 1, 0, len(code) - 1)] != letters[i - 1][:, None]).astype(np.int64) << 32
        diagonal = np.where(ok & (at > first), cell + wrong, big)
        skip = np.concatenate([cell[:, 1:], last], axis=1) + (1 << 32)
        best = np.where(ok, np.minimum(diagonal, skip), big)
        cell = np.where(ok, np.minimum.accumulate(best - step, axis=1) + step, big)
        if (done := np.flatnonzero(size == i)).size:
            j = cell[done].argmin(axis=1)
            value = cell[done, j]
            out[:, done] = value >> 32, value & 0xFFFFFFFF, at[done, j] - start[done]
    return out[0], out[1], out[2]


def leaks(index: Index, texts: list[str], first_only: bool = False) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end) of each leaked stretch; positions are in the normalised text, ends exclusive.

    ``first_only``: a text that has shown a leak is searched no further.
    """
    chunk: list[tuple[int, int, int, np.ndarray, int, int]] = []  # text, its slice's offset, its length, codes, core of the slice
    size, done, seen = 0, set(), set()
    step = 2 * half_band(index)
    core, margin = -(-CHUNK // step) * step, -(-MARGIN // step) * step
    for n, t in enumerate(texts):
        t = normal(t)
        for short, items in index.short.items():
            for m in re.finditer(rf"(?<!\w){re.escape(short)}(?!\w)", t):
                yield from ((n, i, 0, m.start(), m.end()) for i in items)
                done.add(n)
                if first_only:
                    break
        for lo in range(0, max(len(t), 1), core):
            if first_only and n in done:
                break
            begin, stop = max(0, lo - margin), min(len(t), lo + core + margin)
            chunk.append((n, begin, len(t), codes(t[begin:stop]), lo, lo + core))
            size += stop - begin
            if size >= CHUNK:
                for x in _chunk(index, chunk, seen, done if first_only else None):
                    done.add(x[0])
                    yield x
                # two slices may show one stretch by different bands: what reaches into the next slice is kept
                seen = {x for x in seen if x[1] == n and x[5] >= begin}
                chunk, size = [], 0
    yield from _chunk(index, chunk, seen, done if first_only else None)


def _chunk(index: Index, chunk: list[tuple[int, int, int, np.ndarray, int, int]], seen: set, skip: set[int] | None) -> Iterator[tuple[int, int, int, int, int]]:
    """Slices are joined by characters that no text has, so their q-grams are found in one pass; each starts on a band's edge, so bands don't hang on what stands before."""
    if not chunk:
        return
    half = half_band(index)
    sizes = [len(x[3]) for x in chunk]
    starts = np.concatenate([[0], np.cumsum([-(-(n + REACH + Q) // (2 * half)) * 2 * half for n in sizes])])
    whole = np.full(starts[-1], 0x110000, dtype=np.uint32)
    for x, a in zip(chunk, starts, strict=False):
        whole[a : a + len(x[3])] = x[3]
    length = np.array([len(t) for t in index.text], dtype=np.int64)
    offset, ends, core = np.array([x[1] for x in chunk]), starts[:-1] + np.array(sizes), np.array([[x[4], x[5]] for x in chunk])
    most = half - 1
    skip = skip if skip is not None else set()
    for window, band in regions(index, whole):
        # a band's stretch lies in the slice at its middle, seen from either edge of the band
        middle = [np.clip(band + length[window] // 2 + x, 0, len(whole) - 1) for x in (0, 2 * half)]
        piece = [np.searchsorted(starts, m, "right") - 1 for m in middle]
        # of the slices that share a stretch, the one whose core holds it answers; a text's ends belong to its first and last core
        own = np.clip(band + length[window] // 2, starts[piece[0]], ends[piece[0]] - 1) - starts[piece[0]] + offset[piece[0]]
        first = (own >= core[piece[0], 0]) & (own < core[piece[0], 1])
        second = (piece[1] != piece[0]) & (core[piece[1], 0] == 0)
        todo = np.concatenate([np.stack([window, band, piece[0]])[:, first], np.stack([window, band, piece[1]])[:, second]], axis=1)
        for k in range(0, todo.shape[1], REGIONS):
            w, d, at = todo[:, k : k + REGIONS]
            if skip:
                left = np.array([chunk[x][0] not in skip for x in at])
                w, d, at = w[left], d[left], at[left]
                if not len(w):
                    continue
            edits, start, end = align([index.text[x] for x in w], whole, starts[at], ends[at], d - most, 2 * half + 2 * most)
            for r in np.flatnonzero(edits <= index.edits[w]):
                key = (chunk[at[r]][0], int(index.item[w[r]]), int(edits[r]), int(start[r] + offset[at[r]]), int(end[r] + offset[at[r]]))
                if (int(w[r]), *key) not in seen:
                    seen.add((int(w[r]), *key))
                    yield key


def find_leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, edits, start, end: one row for each stretch of a document that is within the edit budget of a window of an item.

    Null and empty texts leak nothing and items without text match nothing. Repeated document rows are each
    searched; an empty table on either side gives no rows. Only the benchmark reaches the driver, block by block; if
    there are several, each one's rows are written before the next index is built.
    """
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts, out = _blocks(benchmark, item_col, item_text), None
    for last, items in parts:
        part, shared = _search(docs, items)
        if not last or out is not None:
            part = cut(part)
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def _blocks(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[tuple[bool, list[tuple[int, str]]]]:
    """(is the last block, items): at most about ``BLOCK_CHARS`` characters at a time; the benchmark's size is summed first."""
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t"))
    chars = items.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    blocks = -(-chars // BLOCK_CHARS) or 1
    for b in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == b)
        yield b == blocks - 1, [(r["item"], r["t"]) for r in own.collect()]


def _search(docs: DataFrame, items: list[tuple[int, str]]) -> tuple[DataFrame, Broadcast]:
    shared = docs.sparkSession.sparkContext.broadcast(build_index(items))

    def run(ids: list, texts: list) -> Iterator[dict]:
        names, rows = ("item_id", "edits", "start", "end"), []
        for x in leaks(shared.value, texts):
            rows.append(x)
            if len(rows) == ROWS:
                yield {"doc_id": [ids[x[0]] for x in rows], **{c: [x[k + 1] for x in rows] for k, c in enumerate(names)}}
                rows = []
        yield {"doc_id": [ids[x[0]] for x in rows], **{c: [x[k + 1] for x in rows] for k, c in enumerate(names)}}

    return arrow_map(docs, run, "doc_id bigint, item_id bigint, edits bigint, start bigint, end bigint", rows=512), shared


def leak_report(found: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, edits (the least), start, end of each document and item that it holds."""
    return found.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_windows"), F.min("edits").alias("edits"), F.min("start").alias("start"), F.max("end").alias("end"))


def drop_leaks(documents: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text leaks nothing, all columns as they are; no row moves. Null and empty texts stay.

    If the benchmark has several blocks, the rows that one leaves are written before the next index is built.
    """
    at, out = documents.columns.index(text_col), documents
    for last, items in _blocks(benchmark, "item_id", "text"):
        shared = documents.sparkSession.sparkContext.broadcast(build_index(items))

        def run(batches, shared=shared):
            for batch in batches:
                for k in range(0, batch.num_rows, 512):
                    part = batch.slice(k, 512)
                    clean = np.ones(part.num_rows, dtype=bool)
                    for x in leaks(shared.value, [t or "" for t in part.column(at).to_pylist()], first_only=True):
                        clean[x[0]] = False
                    yield part.filter(pa.array(clean))

        out = out.mapInArrow(run, documents.schema)
        if not last:
            out = cut(out)
            shared.unpersist()
    return out
