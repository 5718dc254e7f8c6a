"""N-gram Jaccard join by chosen paths.

A document is the set of its word shingles, embedded as MinHash values at ``POSITIONS`` positions; two sets agree at
a position with probability equal to their Jaccard index. Starting from all documents, each run picks one or two
positions (1 / threshold on average) by a hash of the path so far, and splits on the value there, which is a sampled
token that the members share. A bucket of at most ``LIMIT`` members is a leaf; a larger one is split again by new
positions. A pair at the threshold survives a run with a probability that hangs on the number of positions it agrees
in; all runs share the positions, so the chance to miss it is summed over these numbers, those that the filter below
turns away among them, and runs are repeated until it is under 1 - ``RECALL``. After the last level a bucket that will
not split (near copies of one text) is compared block by block; no bucket is cut short.

Within a leaf, members whose MinHash values agree in ``SKETCH`` of positions or more (five standard deviations below
the threshold) become candidates, kept as spanning edges with the number of partners each member saw, never as all
pairs. A component of candidates whose members saw few partners, as in a chain of texts each a little like the next,
has its candidate pairs listed (at most ``PAIRS`` rows a member) and verified one by one. A small or dense component is
brute-forced once, those over ``BLOCK`` members as pairs of blocks. Either way whole shingle sets decide: exact Jaccard, link
counts, and components of exact links. Documents with equal shingle sets are one node throughout.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, cut
from .components import connected_components
from .shingles import POSITIONS, minhash, set_digest, shingle_set

THRESHOLD = (4, 5)
RECALL = 0.9999
DEPTH, LIMIT, BLOCK, PAIRS = 3, 256, 256, 64
SKETCH = 0.54


def run_recall(agreement: float, depth: int = DEPTH) -> float:
    """Chance that a pair that agrees in this share of positions stays together on at least one path of a run through ``depth`` levels."""
    two, alive = THRESHOLD[1] / THRESHOLD[0] - 1, 1.0
    for _ in range(depth):
        miss = 1 - agreement * alive
        alive = 1 - ((1 - two) * miss + two * miss * miss)
    return alive


def miss(runs: int, jaccard: float = THRESHOLD[0] / THRESHOLD[1]) -> float:
    """Chance that no run shows a pair, over the number of positions it agrees in; fewer than the filter asks for are a miss."""
    need, total = math.ceil(SKETCH * POSITIONS), 0.0
    for k in range(POSITIONS + 1):
        share = math.comb(POSITIONS, k) * jaccard**k * (1 - jaccard) ** (POSITIONS - k)
        total += share * (1.0 if k < need else (1 - run_recall(k / POSITIONS)) ** runs)
    return total


def runs_for(recall: float = RECALL) -> int:
    """The least number of runs whose recall at the threshold is ``recall``."""
    runs = next((n for n in range(1, 100) if miss(n) <= 1 - recall), None)
    if runs is None:
        raise ValueError(f"{POSITIONS} positions can't reach a recall of {recall}")
    return runs


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def children(paths: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) of each path: the positions hang on the path alone, so members of a bucket split alike."""
    h = _mix(paths.astype(np.int64).view(np.uint64))
    first = (h % np.uint64(POSITIONS)).astype(np.int64)
    second = ((h >> np.uint64(8)) % np.uint64(POSITIONS - 1)).astype(np.int64)
    second = (first + 1 + second) % POSITIONS
    both = (h >> np.uint64(40)).astype(np.float64) / (1 << 24) < THRESHOLD[1] / THRESHOLD[0] - 1
    rows = np.concatenate([np.arange(len(paths)), np.flatnonzero(both)])
    at = np.concatenate([first, second[both]])
    value = sigs[rows, at].astype(np.uint64) | (at.astype(np.uint64) << np.uint64(32))
    return rows, _mix(h[rows] ^ _mix(value + np.uint64(1))).view(np.int64)


def _sigs(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint32).reshape(-1, POSITIONS)


def features(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, th, node, check, n, sig of each row: key is the id (a hash of the text where it is null), th tells texts of one id apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))

    def run(ids: list, hashes: list, texts: list) -> dict:
        sets = [shingle_set(t) for t in texts]
        digests = [set_digest(s, t) for s, t in zip(sets, texts, strict=True)]
        return {"doc_id": ids, "th": hashes, "node": [d[0] for d in digests], "check": [d[1] for d in digests], "n": [len(s) for s in sets], "sig": [minhash(s).tobytes() for s in sets]}

    return arrow_map(rows, run, "doc_id bigint, th bigint, node bigint, check bigint, n bigint, sig binary", rows=256)


def _split(rows: DataFrame) -> DataFrame:
    """path, node of the children of rows (path, node, sig)."""

    def run(paths: list, nodes: list, sigs: list) -> dict:
        at, path = children(np.array(paths, dtype=np.int64), _sigs(sigs))
        return {"path": path, "node": np.array(nodes, dtype=np.int64)[at]}

    return arrow_map(rows.select("path", "node", "sig"), run, "path bigint, node bigint", rows=8192)


def leaves(nodes: DataFrame, runs: int) -> DataFrame:
    """leaf, size, node: the buckets of at least two members at which splitting stops."""
    roots = F.explode(F.array(*[F.lit(r).cast("bigint") for r in range(1, runs + 1)]))
    rows, found = nodes.filter("n > 0").select(roots.alias("path"), "node", "sig"), []
    for level in range(1, DEPTH + 1):
        paths = cut(_split(rows))
        # written, so that the join's sides are read plainly: a small one is broadcast by its size, a hot path is split as a skewed key
        sizes = cut(paths.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
        sized = paths.join(sizes, "path")
        if level == DEPTH:
            found.append(sized)
            break
        sized = cut(sized)
        found.append(sized.filter(F.col("size") <= LIMIT))
        large = sized.filter(F.col("size") > LIMIT)
        if large.isEmpty():
            break
        rows = large.join(nodes.select("node", "sig"), "node")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.col("path").alias("leaf"), "size", "node")


def in_blocks(rows: DataFrame, size: str, node: str, most: int) -> DataFrame:
    """Deal each group's members to pairs of blocks (i <= j), so that a pair of blocks holds about 2 * ``most`` members at most.

    A group that fits one block gives the single pair (0, 0).
    """
    n = F.ceil(F.col(size) / F.lit(most))
    own = F.pmod(F.xxhash64(F.col(node), F.lit(7)), n)
    out = rows.withColumn("blocks", n).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return out.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")


def _by_group(keys: tuple[str, ...], each, schema: str):
    """mapInArrow function: ``each`` gets a table of rows and the bounds of its groups, which are whole and stand together."""
    target = arrow_schema(schema)

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = [np.asarray(table[k]) for k in keys]
        new = np.ones(table.num_rows, dtype=bool)
        if table.num_rows:
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        made = each(table, np.append(np.flatnonzero(new), table.num_rows))
        for m in made:
            yield pa.RecordBatch.from_arrays([pa.array(m[f.name], type=f.type) for f in target], schema=target)

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            # the rows of the last key wait for the next batch
            last = np.logical_and.reduce([np.asarray(table[k]) == table[k][-1].as_py() for k in keys])
            at = int(table.num_rows - last[::-1].argmin()) if not last.all() else 0
            if at:
                yield from out(table.slice(0, at))
            rest = table.slice(at).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from out(rest)

    return run


def _spread(same: np.ndarray) -> np.ndarray:
    """Component label (least index) of each row of a symmetric boolean matrix."""
    n = len(same)
    label, left = np.full(n, -1), np.ones(n, dtype=bool)
    for root in range(n):
        if not left[root]:
            continue
        wave = np.array([root])
        left[root] = False
        while len(wave):
            label[wave] = root
            reached = same[wave].any(axis=0) & left
            left &= ~reached
            wave = np.flatnonzero(reached)
    return label


def _alike(sig: np.ndarray) -> np.ndarray:
    need = math.ceil(SKETCH * POSITIONS)
    out = np.empty((len(sig), len(sig)), dtype=bool)
    for k in range(len(sig)):
        out[k] = (sig == sig[k]).sum(axis=1) >= need
    return out


def _by_leaf(leaf_rows: DataFrame, nodes: DataFrame, each: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]], names: tuple[str, ...]) -> DataFrame:
    """Columns ``names``, bigint: what ``each`` makes of the members of a leaf (or of two blocks of a large one) and their MinHash values."""
    rows = in_blocks(leaf_rows, "size", "node", LIMIT).select("leaf", "i", "j", "node").join(nodes.select("node", "sig"), "node")

    def run(table: pa.Table, bounds: np.ndarray) -> Iterator[dict]:
        node, sig = np.asarray(table["node"]), _sigs(table["sig"].to_pylist())
        made = [each(node[lo:hi], _alike(sig[lo:hi])) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True) if hi - lo > 1]
        if made:
            yield {name: np.concatenate(column) for name, column in zip(names, zip(*made, strict=True), strict=True)}

    schema = ", ".join(f"{name} bigint" for name in names)
    dealt = rows.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", "node")
    return dealt.mapInArrow(_by_group(("leaf", "i", "j"), run, schema), schema)


def candidate_edges(leaf_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, seen: each member that has a candidate in a leaf, the least member it is connected to there (or itself), and the partners seen, summed over leaves."""

    def each(node: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, ...]:
        seen = same.sum(axis=1) - 1
        own = np.flatnonzero(seen)
        return node[own], node[_spread(same)[own]], seen[own]

    return _by_leaf(leaf_rows, nodes, each, ("a", "b", "seen")).groupBy("a", "b").agg(F.sum("seen").alias("seen"))


def candidate_pairs(leaf_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: the pairs that agree well enough in some leaf, each once. For members that see few partners."""

    def each(node: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, ...]:
        i, j = np.nonzero(np.triu(same, 1))
        return np.minimum(node[i], node[j]), np.maximum(node[i], node[j])

    return _by_leaf(leaf_rows, nodes, each, ("a", "b")).filter("a <> b").distinct()


def linked_pairs(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose whole shingle sets are alike."""
    sets = pairs.join(tokens.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a").join(tokens.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")

    def run(a: list, b: list, ta: list, tb: list) -> dict:
        ok = [bool(linked([np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)])[0, 1]) for x, y in zip(ta, tb, strict=True)]
        return {"a": [x for x, k in zip(a, ok, strict=True) if k], "b": [x for x, k in zip(b, ok, strict=True) if k]}

    return arrow_map(sets.select("a", "b", "ta", "tb"), run, "a bigint, b bigint", rows=64)


def _thin(edges: DataFrame, comps: DataFrame, sizes: DataFrame) -> DataFrame:
    """comp of the candidate components over ``BLOCK`` members whose members saw at most ``PAIRS`` partners each, on average."""
    seen = edges.select(F.col("a").alias("node"), "seen").join(comps, "node").groupBy("comp").agg(F.sum("seen").alias("seen"))
    return sizes.filter(F.col("size") > BLOCK).join(seen, "comp").filter(F.col("seen") <= PAIRS * F.col("size")).select("comp")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the numbers of shared tokens, by products of dense slices of the membership matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    token, count = np.unique(np.concatenate(sets), return_inverse=True)[1], np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    width = 8192
    for at in range(0, int(token[-1]) + 1, width):
        lo, hi = np.searchsorted(token, [at, at + width])
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[owner[lo:hi], token[lo:hi] - at] = 1
        count += part @ part.T
    return count.astype(np.int64)


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """Symmetric boolean matrix: Jaccard index at the threshold or above, in whole numbers."""
    if len(sets) == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        ok = THRESHOLD[1] * shared >= THRESHOLD[0] * (len(sets[0]) + len(sets[1]) - shared)
        return np.array([[True, ok], [ok, True]])
    size = np.array([len(s) for s in sets])
    shared = common_counts(sets)
    return THRESHOLD[1] * shared >= THRESHOLD[0] * (size[:, None] + size[None, :] - shared)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """node, tokens (sorted 64-bit hashes, packed) of rows (node, text). A task gives a node once, so copies of a row that are read together are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                new = [(n, t) for n, t in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True) if n not in done and not done.add(n)]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in new], type=pa.int64()), pa.array([shingle_set(t).tobytes() for _, t in new], type=pa.binary())], names=["node", "tokens"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, tokens binary")


def verify(members: DataFrame) -> DataFrame:
    """node, links, root, whole from rows (comp, i, j, blocks, own, node, weight, tokens): exact links of each pair of blocks.

    ``links`` is the weight of the linked nodes that this pair of blocks shows, ``root`` the least node among those it
    connects, and ``whole`` says that the component had one block, so that ``root`` is final.
    """

    def each(table: pa.Table, bounds: np.ndarray) -> Iterator[dict]:
        node, weight, own, i, j, blocks = (np.asarray(table[c]) for c in ("node", "weight", "own", "i", "j", "blocks"))
        out = {"node": [], "links": [], "root": [], "whole": []}
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            rows = lo + np.unique(node[lo:hi], return_index=True)[1]  # a text that stands under one id twice counts once
            if len(rows) < 2:
                continue
            ok = linked([np.frombuffer(x, dtype=np.uint64) for x in table["tokens"].take(pa.array(rows)).to_pylist()])
            label = _spread(ok)
            counted = ok & ~np.eye(len(rows), dtype=bool)
            if i[lo] != j[lo]:
                counted &= own[rows][:, None] != own[rows][None, :]
            out["node"].append(node[rows])
            out["links"].append(counted @ weight[rows])
            out["root"].append(node[rows][label])
            out["whole"].append(np.full(len(rows), blocks[lo] == 1))
        if out["node"]:
            yield {k: np.concatenate(v) for k, v in out.items()}

    schema = "node bigint, links bigint, root bigint, whole boolean"
    dealt = members.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "node")
    return dealt.mapInArrow(_by_group(("comp", "i", "j"), each, schema), schema)


def similarity_classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """doc_id, th, root, class_id, n_links: a row for each input row.

    Documents are linked if the Jaccard index of their shingle sets is at least the threshold; equal sets are. A class
    is a connected component of links, named by its least id, and ``n_links`` counts the other rows that the document
    is linked to. Texts without words (null texts are empty) are linked only to equal texts. Where all rows of a class have a null
    id its name is null; ``root`` is a class's key in any case. ``th`` is the text's hash, to tell rows of one id
    apart. An empty table gives no rows; other columns of the input are not read.
    """
    base = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = cut(features(base, "doc_id", "text"))
    kept = F.min(F.struct("doc_id", "th"))
    # sets are told apart by 128 bits; what follows knows them by numbers, which are written with them
    digest = [F.col("node").alias("digest"), "check"]
    sets = rows.select(*digest, "doc_id", "th", "n", "sig").groupBy("digest", "check").agg(F.min("doc_id").alias("least"), kept.alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = cut(sets.withColumn("node", F.monotonically_increasing_id()))
    in_leaves = leaves(nodes, runs_for(recall))
    edges = cut(candidate_edges(in_leaves, nodes))
    comps = connected_components(edges.filter("a <> b"))
    sizes = cut(comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size")))
    thin = cut(_thin(edges, comps, sizes))
    members = nodes.select("node", "weight", "rep.doc_id", "rep.th").join(comps, "node").join(sizes, "comp")
    texts = base.withColumn("th", F.xxhash64("text"))
    told = members.select("node", "doc_id", "th").join(texts, members["doc_id"].eqNullSafe(texts["doc_id"]) & (members["th"] == texts["th"])).select("node", "text")
    # a member's set is made once and shipped to its blocks; its text goes no further than this
    tokens = cut(shingle_sets(told))
    dense = members.select("comp", "size", "node", "weight").join(thin, "comp", "left_anti")
    dealt = in_blocks(dense, "size", "node", BLOCK).join(tokens, "node")
    found = cut(verify(dealt.select("comp", "i", "j", "blocks", "own", "node", "weight", "tokens")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"), F.min(F.when(F.col("whole"), F.col("root"))).alias("root"))
    wide = found.filter(~F.col("whole"))
    if not wide.isEmpty():
        far = connected_components(wide.select(F.col("node").alias("a"), F.col("root").alias("b")))
        links = links.join(far.select("node", F.col("comp").alias("far")), "node", "left").select("node", "links", F.coalesce("root", "far").alias("root"))
    if not thin.isEmpty():
        few = comps.join(thin, "comp", "left_semi").select("node")
        pairs = cut(linked_pairs(candidate_pairs(in_leaves.join(few, "node", "left_semi"), nodes), tokens))
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        counted = both.join(nodes.select(F.col("node").alias("b"), "weight"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("links"))
        links = links.unionByName(counted.join(connected_components(pairs), "node").select("node", "links", F.col("comp").alias("root")))
    told = nodes.join(links, "node", "left").select("digest", "check", "least", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    names = told.groupBy("root").agg(F.min("least").alias("class_id"))
    told = told.join(names, "root").select(F.col("digest").alias("node"), "check", "root", "class_id", (F.col("weight") - 1 + F.col("links")).alias("n_links"))
    return rows.select("doc_id", "th", "node", "check").join(told, ["node", "check"]).select("doc_id", "th", "root", "class_id", "n_links")


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """One row of each class of near copies: that of the least id, and of rows with that id the least text hash.

    All columns of ``documents`` stay. A null id comes after the others. Rows that repeat an id and a text are one
    text, of which one row stays.
    """
    from pyspark.sql import Window

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    keep = similarity_classes(documents, id_col, text_col, recall).groupBy("root").agg(first).select(F.col("first.doc_id").alias("__id"), F.col("first.th").alias("__th"))
    keyed = documents.withColumn("__key", F.col(id_col).cast("bigint")).withColumn("__own", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    found = keyed.join(keep, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__th")), "left_semi")
    one = Window.partitionBy("__key", "__own").orderBy("__key")
    return found.withColumn("__n", F.row_number().over(one)).filter("__n = 1").drop("__own", "__key", "__n")
