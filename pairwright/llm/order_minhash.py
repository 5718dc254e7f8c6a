"""Document fingerprints by Order MinHash, with DataFrame functions only.

A text's k-mers are runs of ``K`` words, and equal k-mers of a text are told apart by their occurrence number. Each of
the ``M`` components of a signature has a random order of its own, hashed independently of all others; the ``L`` = 2
least numbered k-mers of that order are selected, kept in the order in which they stand in the text, and that
tuple is hashed. Two texts agree in a component if the same k-mers are least and also stand in the same order, so
likeness falls both with the share of k-mers lost and with k-mers moved.

K-mers are rows, and those that pass are rows for each order, so that hashes, occurrence numbers and minima are compiled
code over primitive columns that can spill: rows are counted by rank, and nothing of a text is collected. Order j ranks numbered k-mers by level first, the number of hash words in a row whose bit
j is set, and then by a hash. So all orders of a k-mer can be tested at once, and of a long text only the k-mers on
the levels that its size asks for, ``PASS`` or more of an order's on average, reach the minima; every order is the
same for all texts. That fewer than two pass has a chance below 1e-12 for an order, and none at all for texts of fewer than
2 * ``PASS`` k-mers; a component then holds one k-mer twice, as in a text of one k-mer, or is blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, M, L, DIGITS = 3, 32, 2, 8
#: K-mers of a text that pass the levels of an order: at least this many on average, if the text has them.
PASS = 32
#: Levels, at most; enough for the longest text that a row can hold.
LEVELS = 26
#: Characters that part words.
WHITE = " \t\n\x0b\f\r"
BLANK = "0" * DIGITS


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare != "", F.split(bare, f"[{WHITE}]+")).otherwise(F.array().cast("array<string>"))


def _kmers(words: Column) -> Column:
    """Each word with the two after it; the first ``max(1, n - K + 1)`` of them are the k-mers."""
    return F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.size(words)).alias("b"), F.slice(words, F.lit(3), F.size(words)).alias("c"))


def _component(a: Column, pos_a: Column, b: Column, pos_b: Column) -> Column:
    """Number of one component, of the two least ranks and where they stand; null without a k-mer, one k-mer stands twice."""
    behind = F.coalesce(pos_b < pos_a, F.lit(False))
    b = F.coalesce(b, a)
    hashed = F.xxhash64(F.when(behind, 1).otherwise(0), F.when(behind, b).otherwise(a), F.when(behind, a).otherwise(b)).bitwiseAND(F.lit((1 << 4 * DIGITS) - 1))
    return F.when(a.isNotNull(), hashed)


def signatures(rows: DataFrame, place: list[str], row: str, text: str, edited_text: str, shared: str, meta: str) -> DataFrame:
    """``place``, ``row``, ``meta``, fp, efp: the signatures of two texts of each row that have ``shared`` first characters in common.

    ``rows`` must be dealt by the columns ``place``, in which ``row`` numbers the rows; nothing is dealt again, so a
    task that is run anew gives the same rows. K-mers of the shared beginning are hashed once for both texts. ``meta``
    is a struct that travels in a row of its own. The signature of a text without words is blank throughout; a text
    with fewer than ``K`` words is a single k-mer.
    """
    key = [*place, row]
    df = rows.select(*key, meta, _words(F.col(text)).alias("wt"), _words(F.col(edited_text)).alias("we"), F.size(_words(F.left(F.col(text), F.col(shared)))).alias("wa"))
    # the last word of the beginning may go on differently, so a k-mer is shared if it ends before that word
    df = df.withColumn("own", F.greatest(F.lit(0), F.least("wa", F.size("we")) - K)).withColumn("nt", F.size("wt")).withColumn("ne", F.size("we"))
    none = F.array(F.struct(*[F.lit(None).cast("string").alias(c) for c in "abc"]))
    all_rows = F.concat(_kmers(F.col("wt")), F.slice(_kmers(F.col("we")), F.col("own") + 1, F.col("ne")), none)
    df = df.select(*key, meta, "own", "nt", "ne", F.posexplode(all_rows).alias("i", "z"))
    side = F.when(F.col("i") < F.col("nt"), 0).when(F.col("i") < F.col("nt") + F.greatest(F.col("ne") - F.col("own"), F.lit(0)), 1).otherwise(2)
    df = df.withColumn("side", side).withColumn("pos", F.when(F.col("side") == 0, F.col("i")).otherwise(F.col("i") - F.col("nt") + F.col("own")))
    count = lambda n: F.greatest(F.lit(1), F.col(n) - (K - 1))
    df = df.filter((F.col("side") == 2) | ((F.col("side") == 0) & (F.col("pos") < count("nt"))) | ((F.col("side") == 1) & (F.col("pos") < count("ne"))))
    fewest = F.when(F.col("nt") == 0, count("ne")).when(F.col("ne") == 0, count("nt")).otherwise(F.least(count("nt"), count("ne")))
    df = df.select(*key, "side", "pos", F.when(F.col("side") == 2, F.col(meta)).alias(meta), (F.col("side") == 0).alias("in_t"), ((F.col("side") == 1) | ((F.col("side") == 0) & (F.col("pos") < F.col("own")))).alias("in_e"), fewest.alias("n"), F.when(F.col("side") < 2, F.xxhash64("z.a", "z.b", "z.c")).alias("h"))
    so_far = Window.partitionBy(*key, "h").orderBy("pos", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("o", F.when(F.col("in_t"), F.sum(F.col("in_t").cast("int")).over(so_far)).otherwise(F.sum(F.col("in_e").cast("int")).over(so_far)))
    df = df.withColumn("x", F.xxhash64("h", "o"))
    mask = F.lit(-1).cast("bigint")  # the orders in which a k-mer passes the levels that the text's size asks for
    for level in range(LEVELS):
        mask = mask.bitwiseAND(F.when(F.col("n") >= PASS << (level + 1), F.xxhash64("x", F.lit(level))).otherwise(F.lit(-1).cast("bigint")))
    df = df.withColumn("mask", mask.bitwiseAND(F.lit((1 << M) - 1))).filter((F.col("side") == 2) | (F.col("mask") != 0))
    orders = F.when(F.col("side") == 2, F.array(F.lit(-1))).otherwise(F.array(*[F.lit(j) for j in range(M)]))
    df = df.withColumn("j", F.explode(orders)).filter((F.col("j") < 0) | (F.getbit("mask", F.greatest(F.col("j"), F.lit(0))) == 1))
    failed = lambda level: F.getbit(F.xxhash64("x", F.lit(level)), F.greatest(F.col("j"), F.lit(0))) == 0
    reached = F.when(failed(0), 0)
    for level in range(1, LEVELS):
        reached = reached.when(failed(level), level)
    # a rank is a positive long: levels that are not reached, then the order's own hash
    df = df.withColumn("v", F.shiftleft((LEVELS - reached.otherwise(LEVELS)).cast("bigint"), 58).bitwiseOR(F.shiftrightunsigned(F.xxhash64("x", F.col("j") + LEVELS), 6)))
    # one number for text and order comes first, by which a sort tells most rows apart
    df = df.select(*key, meta, "j", "pos", "in_t", "in_e", "v", (F.col(row) * (M + 1) + F.col("j")).alias("g"))
    by_rank = Window.partitionBy("g", *place).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.select(*key, meta, "j", "pos", "v", *[F.when(F.col(f"in_{s}"), F.sum(F.col(f"in_{s}").cast("int")).over(by_rank)).alias(f"at_{s}") for s in "te"])
    df = df.filter((F.col("j") < 0) | (F.col("at_t") <= L) | (F.col("at_e") <= L))
    least = df.groupBy(*key, meta, "j").agg(*[F.max(F.when(F.col(f"at_{s}") == n, F.col(c))).alias(f"{c}_{s}{n}") for s in "te" for n in (1, L) for c in ("v", "pos")])
    made = least.select(*key, meta, "j", *[_component(*[F.col(f"{c}_{s}{n}") for n in (1, L) for c in ("v", "pos")]).alias(s) for s in "te"])
    each = made.groupBy(*key).agg(F.first(meta, ignorenulls=True).alias(meta), *[F.max(F.when(F.col("j") == j, F.col(s))).alias(f"{s}{j}") for s in "te" for j in range(M)])
    digits = lambda c: F.coalesce(F.lpad(F.lower(F.hex(c)), DIGITS, "0"), F.lit(BLANK))
    return each.select(*key, meta, *[F.concat(*[digits(F.col(f"{s}{j}")) for j in range(M)]).alias(name) for s, name in (("t", "fp"), ("e", "efp"))])


def with_fingerprint(df: DataFrame, text_col: str, out: str, parts: int = 4096) -> DataFrame:
    """``df`` with column ``out``: the signature of a text as ``M * DIGITS`` hex digits. A null text counts as empty.

    Rows are dealt by the hash of all their columns, so copies of a text with different ids are not one task's.
    """
    whole = F.struct(*df.columns)
    rows = df.select(whole.alias("__meta"), F.pmod(F.xxhash64(whole), F.lit(parts)).alias("__b"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    rows = rows.repartition("__b").withColumn("__row", F.monotonically_increasing_id()).withColumn("__e", F.lit("")).withColumn("__shared", F.lit(0))
    made = signatures(rows, ["__b"], "__row", "__t", "__e", "__shared", "__meta")
    return made.select(*[F.col("__meta")[c].alias(c) for c in df.columns if c != out], F.col("fp").alias(out))


def agreement(a: Column, b: Column) -> Column:
    """Share of equal components of two signatures."""
    same = F.aggregate(F.sequence(F.lit(0), F.lit(M - 1)), F.lit(0), lambda n, j: n + (F.substr(a, j * DIGITS + 1, F.lit(DIGITS)) == F.substr(b, j * DIGITS + 1, F.lit(DIGITS))).cast("int"))
    return same / F.lit(float(M))


def likeness(a: Column, b: Column) -> Column:
    """Estimate of the share of text that two documents have in common, 0 to 1.

    The agreement estimates J**2 for a pair of k-mers, J being the numbered k-mers' Jaccard index, and 2J / (1 + J)
    is the share of k-mers in common.
    """
    return 2 - 2 / (1 + F.sqrt(agreement(a, b)))


def _place(key: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` (ascending) that a key reaches, by bisection; -1 for a null key."""
    if not bounds:
        return F.when(key.isNull(), -1).otherwise(0)
    edges = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(len(bounds).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(edges, at + s - 1) <= key), at + s).otherwise(at))
    return F.when(key.isNull(), -1).otherwise(found)


def bucketed(df: DataFrame, id_col: str, text_col: str, rows_per_bucket: int = 500, max_buckets: int = 1 << 16, per_task: int = 2) -> DataFrame:
    """``df`` with __b, __sub (bucket), __tie and __guest, dealt by bucket. Every bucket also holds, as a guest, the first row of the one after it.

    Buckets follow the order descending id (nulls last), hash of the text. Their bounds are quantiles of the ids from
    one pass over that column, so they hold about as many rows each wherever the ids lie; an id that fills whole
    quantiles, or the null id, has a range of its own that is parted by the text's hash. The head rows come from one
    more pass over the ids, a (bucket, id) pair a bucket, at most ``max_buckets`` or so; hence texts are shuffled
    once, and as many tasks as the table's size asks for take ``per_task`` buckets each.
    """
    key, ids = F.col(id_col), df.select(id_col)
    n, held = (int(x) for x in ids.agg(F.count(F.lit(1)), F.count(key)).first())
    per = max(rows_per_bucket, -(-n // max_buckets))
    cuts = max(0, held // per - 1)
    shares = [(i + 1) / (cuts + 1) for i in range(cuts)]
    points = sorted(ids.agg(F.percentile_approx(key, shares, max(10_000, 4 * cuts))).first()[0] or []) if cuts else []
    heavy = {x: points.count(x) + 1 for x in {a for a, b in zip(points, points[1:], strict=False) if a == b}}
    bounds = sorted({*points, *(x + 1 for x in heavy if x < (1 << 63) - 1)})
    parts = {bounds.index(x) + 1: many for x, many in heavy.items()} | ({-1: -(-(n - held) // per)} if n - held > per else {})
    tie = F.shiftrightunsigned(F.xxhash64(text_col), 24)
    split = df.sparkSession.createDataFrame([(b, many) for b, many in parts.items()], "__b int, __parts bigint")  # at most one for each bucket
    placed = df.withColumn("__b", _place(key, bounds)).withColumn("__tie", tie)
    if parts:
        placed = placed.join(F.broadcast(split), "__b", "left").withColumn("__sub", F.coalesce(F.shiftright(F.col("__tie") * F.col("__parts"), 40), F.lit(0).cast("bigint"))).drop("__parts")
    else:
        placed = placed.withColumn("__sub", F.lit(0).cast("bigint"))
    plain = ids.select(_place(key, bounds).alias("b"), key.alias("id"))
    heads = plain.filter(~F.col("b").isin(*parts) if parts else F.lit(True)).groupBy("b").agg(F.max("id").alias("head")).select("b", F.lit(0).cast("bigint").alias("sub"), "head", F.lit(None).cast("bigint").alias("least"))
    if parts:
        split_heads = placed.filter(F.col("__b").isin(*parts)).groupBy(F.col("__b").alias("b"), F.col("__sub").alias("sub")).agg(F.max(key).alias("head"), F.min("__tie").alias("least"))
        heads = heads.unionByName(split_heads)
    in_order = Window.orderBy(F.col("b").desc(), "sub")  # as many rows as buckets
    last = F.last(F.struct("b", "sub")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    hosts = heads.select("head", "least", F.coalesce(F.lag(F.struct("b", "sub")).over(in_order), last).alias("__host"), F.col("b").alias("__from"), F.col("sub").alias("__from_sub"))
    at_head = (F.col("__b") == F.col("__from")) & (F.col("__sub") == F.col("__from_sub")) & key.eqNullSafe(F.col("head")) & (F.col("least").isNull() | (F.col("__tie") == F.col("least")))
    joined = placed.join(F.broadcast(hosts), at_head, "left")
    here = F.array(F.struct(F.col("__b").alias("b"), F.col("__sub").alias("sub"), F.lit(False).alias("guest")), F.struct(F.col("__host.b").alias("b"), F.col("__host.sub").alias("sub"), F.lit(True).alias("guest")))
    rows = joined.withColumn("__at", F.explode(F.filter(here, lambda x: x["b"].isNotNull()))).select(*df.columns, "__tie", F.col("__at.b").alias("__b"), F.col("__at.sub").alias("__sub"), F.col("__at.guest").alias("__guest"))
    tasks = max(1, -(-(n // per + len(parts)) // per_task))
    return rows.repartition(tasks, "__b", "__sub")


def with_next(df: DataFrame, id_col: str, text_col: str, **sizes: int) -> DataFrame:
    """Each row with the text of the next one (``next_<c>`` of every column c), by descending id; after the last, the first.

    Null ids come last; rows of one id are ordered by their texts' hashes, then texts.
    """
    rows = bucketed(df, id_col, text_col, **sizes)
    out = rows.select(*df.columns, "__guest", *[F.lead(c).over(_in_bucket(id_col, text_col)).alias(f"next_{c}") for c in df.columns])
    return out.filter(~F.col("__guest")).drop("__guest")


def _in_bucket(id_col: str, text_col: str):
    return Window.partitionBy("__b", "__sub").orderBy("__guest", F.col(id_col).desc_nulls_last(), "__tie", text_col)


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every whole text.

    The edited text is the text with its last floor(n / 2) code points replaced by the first as many (or all) of the
    next document's. A null text is the empty text; repeated rows each have a row; an empty table gives none. A single
    document is its own next one.
    """
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = bucketed(docs, "doc_id", "t", **sizes)
    rows = rows.withColumn("after", F.coalesce(F.lead("t").over(_in_bucket("doc_id", "t")), F.lit("")))
    rows = rows.withColumn("__row", F.monotonically_increasing_id()).withColumn("half", F.floor(F.length("t") / 2).cast("int"))
    rows = rows.withColumn("shared", F.length("t") - F.col("half")).withColumn("e", F.concat(F.left("t", F.col("shared")), F.left("after", F.col("half"))))
    meta = F.struct("doc_id", F.length("t").cast("bigint").alias("n_chars"), F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"), F.col("__guest").alias("guest"))
    made = signatures(rows.withColumn("meta", meta), ["__b", "__sub"], "__row", "t", "e", "shared", "meta")
    made = made.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("__b", "__sub").orderBy("__row"))).filter(~F.col("meta.guest"))
    return made.select(
        "meta.doc_id",
        "meta.n_chars",
        "meta.edited_sha256",
        F.col("fp").alias("fingerprint"),
        F.col("efp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
