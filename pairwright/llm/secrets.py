"""Secret scans with corpus-wide ownership frequency, with DataFrame functions only.

Each text is scanned for candidate credentials: three base kinds, which are always reported, and formats that the
method adds. A candidate's value is hashed, and for each hash the corpus gives the number of distinct owners and of
distinct repositories that hold it. A value under many owners is a copied example; one that stays with few owners
looks live. Added kinds are reported where they look live.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


@dataclass(frozen=True)
class Kind:
    """A kind of candidate: its pattern, the group that is the value, the value's least length, and a text that every match holds."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    holds: str = ""

    def regex(self) -> str:
        """The pattern; a run shorter than its least length can be neither a match nor part of one, if the whole match is the value."""
        return self.pattern.removesuffix("+") + f"{{{self.least},}}" if self.group == 0 and self.least > 1 and self.pattern.startswith("[") else self.pattern

    def in_text(self, text: Column) -> Column:
        """Whether a text has a match; the plain search for what every match holds spares most texts the pattern."""
        hit = text.rlike(self.regex())
        return text.contains(self.holds) & hit if self.holds else hit


BASE = (
    Kind("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    Kind("hex", r"[0-9a-f]+", 0, 32),
)
#: Public formats of issued credentials. What comes before a pattern's fixed part, and can start anywhere in a run, has a bounded
#: length, so that a text costs time in proportion to its length: schemes of 31 characters, token headers of 256.
ADDED = (
    Kind("github", r"gh[pousr]_[A-Za-z0-9]{36,}", holds="gh"),
    Kind("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", holds="xox"),
    Kind("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", holds="k_live_"),
    Kind("google", r"AIza[A-Za-z0-9_-]{35}", holds="AIza"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,256}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", holds="eyJ"),
    Kind("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", holds="PRIVATE KEY-----"),
    Kind("url", r"[a-z][a-z0-9+]{0,30}://[A-Za-z0-9._-]+:[A-Za-z0-9._%+-]{6,}@", holds="://"),
)
KINDS = BASE + ADDED
#: A value that this many distinct owners hold is a copied example.
COPIED_OWNERS = 3
#: Matches of a text whose lengths are summed at a time, so that positions cost little in texts with many matches.
BLOCK = 64

def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("bigint"), lambda a, y: a + y)


def _block(i: Column) -> Column:
    return F.floor(i / BLOCK).cast("int")


def _steps(rank: int, kind: Kind, text: Column) -> tuple[list[dict[str, Column]], Column]:
    """Columns that lead to the spans of one kind, step by step, and the spans."""
    pattern = kind.regex()
    found, value, gap, step, sums, before = (F.col(f"__{x}_{rank}") for x in ("found", "value", "gap", "step", "sums", "before"))
    hit, none = kind.in_text(text), F.array().cast("array<string>")
    made = [
        {
            f"__found_{rank}": F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
            f"__value_{rank}": F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(kind.group))).otherwise(none),
            f"__gap_{rank}": F.when(hit, F.split(text, pattern, -1)).otherwise(none),
        },
        {f"__step_{rank}": F.transform(found, lambda m, i: (F.length(F.get(gap, i)) + F.when(i == 0, 0).otherwise(F.length(F.get(found, i - 1)))).cast("bigint"))},
        {f"__sums_{rank}": F.transform(F.sequence(F.lit(0), _block(F.size(step))), lambda b: _sum(F.slice(step, b * BLOCK + 1, F.least(F.lit(BLOCK), F.size(step)))))},
        {f"__before_{rank}": F.transform(sums, lambda x, b: _sum(F.slice(sums, F.lit(1), F.least(b, F.size(sums)))))},
    ]
    start = lambda i: F.get(before, _block(i)) + _sum(F.slice(step, _block(i) * BLOCK + 1, F.least(i % BLOCK + 1, F.size(step))))
    spans = F.transform(found, lambda m, i: F.struct(start(i).alias("start"), F.length(m).alias("n"), F.get(value, i).alias("value")))
    kept = F.filter(spans, lambda x: F.length(x["value"]) >= kind.least)
    told = lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["n"]).alias("stop"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), F.sha2(x["value"].cast("binary"), 256).alias("hash"))
    return made, F.transform(kept, told)


def with_spans(df: DataFrame, text_col: str, out: str = "found", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``df`` with ``out``: array of (start, stop, rank, kind, hash), the leftmost non-overlapping matches of each kind whose value is long enough.

    Positions count code points, the stop is exclusive, and the hash is that of the value. The start of a match is
    the length of all gaps up to it and all matches before it. These lengths are summed block by block, each step in
    a column of its own that the next one uses more than once, so a text with many matches costs little more than
    one with few and no step is computed inside the loop of another.
    """
    have = [c for c in df.columns if c != out]
    each = [_steps(rank, kind, F.col(text_col)) for rank, kind in enumerate(kinds)]
    for k in range(len(each[0][0])):
        df = df.withColumns({name: c for made, _ in each for name, c in made[k].items()})
    return df.select(*have, F.concat(*[spans for _, spans in each]).alias(out))


def _rows(documents: DataFrame, id_col: str, text_col: str, owner_col: str, kinds: tuple[Kind, ...]) -> DataFrame:
    """row, doc_id, owner, found of each row, written once with their row numbers: a second reading of a shuffled input could number its rows otherwise."""
    rows = documents.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"),
        F.monotonically_increasing_id().alias("row"),
    )
    return cut(with_spans(rows, "t", "found", kinds).select("row", "doc_id", "owner", "found"))


def _owned(own: DataFrame) -> DataFrame:
    each = own.select("doc_id", "owner", F.explode("found.hash").alias("hash")).distinct()
    by_owner = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def ownership(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """hash, owners, repositories of each candidate value of a corpus.

    A repository is a document here and its owner is ``owner_col``; a null owner counts as one owner named '', a null id
    as one repository. Hashes are reduced to distinct (hash, owner, repository), then (hash, owner), before they meet by
    hash, so a value that a third of all rows hold is summed where it is read first.
    """
    return _owned(_rows(corpus, id_col, text_col, owner_col, kinds))


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", kinds: tuple[Kind, ...] = KINDS, copied_owners: int = COPIED_OWNERS, owned: DataFrame | None = None) -> DataFrame:
    """doc_id and spans: array of (start, stop, rank, kind, hash, owners, repositories, live), by start and rank, a row per input row.

    Owners are counted in ``documents``, or are those of ``owned`` (an ``ownership`` of the corpus that the documents come
    from; a value that it lacks has no other owner). A null text is empty and has no spans; a very long one is scanned
    whole, in time that grows with its length. Repeated rows each give their row and count as one repository; an empty
    table gives no rows; columns of the input other than the three named are not read, whatever their names.
    """
    own = _rows(documents, id_col, text_col, owner_col, kinds)
    each = own.select("row", "doc_id", F.explode("found").alias("x"))
    by_hash = (_owned(own) if owned is None else owned).withColumnRenamed("hash", "__hash")
    owners, repositories = F.coalesce("owners", F.lit(1)).cast("bigint"), F.coalesce("repositories", F.lit(1)).cast("bigint")
    span = F.struct("x.start", "x.rank", "x.stop", "x.kind", "x.hash", owners.alias("owners"), repositories.alias("repositories"), (owners < copied_owners).alias("live"))
    told = each.join(by_hash, F.col("x.hash") == F.col("__hash"), "left").groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(span)).alias("spans")).select("doc_id", "spans")
    # rows without a candidate take no part in the join
    none = own.filter(F.size("found") == 0).select("doc_id", F.array().cast(told.schema["spans"].dataType).alias("spans"))
    return told.unionByName(none)


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied of the result of ``scan``."""
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    shown = F.filter("spans", lambda x: (x["rank"] < len(BASE)) | x["live"])
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    count = lambda name: F.size(F.filter(base, lambda x: x["kind"] == name)).cast("bigint")
    return scanned.select(
        "doc_id",
        *[count(k.name).alias(f"n_{k.name}") for k in BASE],
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(shown).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("bigint").alias("n_live"),
        F.size(F.filter("spans", lambda x: ~x["live"])).cast("bigint").alias("n_copied"),
    )


def redact(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", kinds: tuple[Kind, ...] = KINDS, copied_owners: int = COPIED_OWNERS, mask: str = "[SECRET]", corpus: DataFrame | None = None) -> DataFrame:
    """The table with each live candidate of its texts replaced by ``mask``; copied examples stay, and so do all rows and columns.

    ``corpus``: the table, with the same columns, whose owners count; without it those of the documents do. Where copies were
    dropped before, give the table from before, as an example whose copies are gone would look live.

    Overlapping spans are replaced as one. A column ``n_chars`` follows the new text where the text changed. Rows
    without a candidate pass as they are; the others meet their spans by (id, hash of the text), equal rows once.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hit = reduce(lambda a, k: a | k.in_text(text), kinds, F.lit(False))
    keyed = documents.withColumn("__id", F.col(id_col).cast("bigint")).withColumn("__th", F.when(hit, F.xxhash64(text)))
    # the few rows with a candidate are written once: patterns are costly and these rows are read several times
    plain, some = keyed.filter(F.col("__th").isNull()), cut(keyed.filter(F.col("__th").isNotNull()))
    source = some.select(F.struct("__id", "__th").alias("__key"), F.col(text_col).alias("__t"), F.col(owner_col).alias("__o"))
    ids = source.withColumn("__row", F.xxhash64("__key"))
    live = F.transform(F.filter("spans", lambda x: x["live"]), lambda x: F.struct(x["start"], x["stop"]))
    owned = None if corpus is None else ownership(corpus.filter(reduce(lambda a, k: a | k.in_text(text), kinds, F.lit(False))), id_col, text_col, owner_col, kinds)
    spans = scan(ids, "__row", "__t", "__o", kinds, copied_owners, owned).groupBy(F.col("doc_id").alias("__at")).agg(F.first(live).alias("__spans"))
    joined = some.withColumn("__at", F.xxhash64(F.struct("__id", "__th"))).join(spans, "__at", "left")
    merged = F.aggregate("__spans", F.array().cast("array<struct<start:bigint,stop:bigint>>"), _merge)
    joined = joined.withColumn("__spans", F.coalesce(merged, F.array().cast("array<struct<start:bigint,stop:bigint>>")))
    gaps = F.transform(F.sequence(F.lit(0), F.size("__spans")), lambda i: _between(F.col(text_col), F.col("__spans"), i))
    changed = F.when(F.size("__spans") > 0, F.array_join(gaps, mask)).otherwise(F.col(text_col))
    out = joined.withColumn(text_col, changed)
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length(text_col).cast(kind)).otherwise(F.col("n_chars")))
    return plain.select(documents.columns).unionByName(out.select(documents.columns))


def _merge(done: Column, x: Column) -> Column:
    """Spans come by their start: one that begins before the last ends joins it."""
    last = F.get(done, F.size(done) - 1)
    joins = (F.size(done) > 0) & (x["start"] < last["stop"])
    longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
    return F.when(joins, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(F.struct(x["start"].alias("start"), x["stop"].alias("stop")))))


def _between(text: Column, spans: Column, i: Column) -> Column:
    """The text between span i - 1 and span i."""
    a = F.coalesce(F.get(spans, i - 1)["stop"], F.lit(0))
    b = F.coalesce(F.get(spans, i)["start"], F.length(text))
    return F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))


def oracle_sql(kinds: tuple[Kind, ...] = KINDS, copied_owners: int = COPIED_OWNERS) -> str:
    """DuckDB's statement of ``digests(scan(documents))``. Letters in either case are spelled out, as its patterns fold more than ASCII ones."""

    def pattern(k: Kind) -> str:
        p = k.pattern
        if p.startswith("(?i)"):
            head, tail = p[4:].split(")", 1)
            p = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in head) + ")" + tail
        return "'" + p.replace("'", "''") + "'"

    parts = " UNION ALL ".join(f"SELECT r, doc_id, owner, {n} AS rank, '{k.name}' AS kind, {k.least} AS least, regexp_extract_all(t, {pattern(k)}) AS f, regexp_extract_all(t, {pattern(k)}, {k.group}) AS v, string_split_regex(t, {pattern(k)}) AS g FROM rows" for n, k in enumerate(kinds))
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k.name}') AS n_{k.name}" for k in BASE)
    told = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    return f"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
found AS ({parts}),
each AS (SELECT r, doc_id, owner, rank, kind, least, unnest(f) AS m, unnest(v) AS value, unnest(g[:len(f)]) AS gap, generate_subscripts(f, 1) AS i FROM found WHERE len(f) > 0),
placed AS (SELECT *, sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS start, sum(length(gap)) OVER w + sum(length(m)) OVER w AS stop FROM each WINDOW w AS (PARTITION BY r, rank ORDER BY i)),
kept AS (SELECT r, doc_id, owner, rank, kind, start::BIGINT AS start, stop::BIGINT AS stop, sha256(value) AS hash FROM placed WHERE length(value) >= least),
held AS (SELECT hash, count(DISTINCT owner) < {copied_owners} AS live FROM kept GROUP BY hash),
told AS (
  SELECT r, {counts}, {told} FILTER (WHERE rank < {len(BASE)}) AS base, {told} FILTER (WHERE rank < {len(BASE)} OR live) AS spans,
    count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_copied
  FROM kept JOIN held USING (hash) GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM rows LEFT JOIN told USING (r)
"""
