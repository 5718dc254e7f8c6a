"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime size: it starts at an offset and
steps by a skip, both hashed from the shard's name. Shards take turns; on its turn a shard claims the first slot
of its order that is still free. A record's slot is the hash of its key modulo the table size, so placement is one
hash and one probe of a broadcast table whose size is fixed by ``TABLE_SIZE`` and not by the data. If a shard
leaves, few keys move besides its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, size: int) -> tuple[int, int]:
    """Offset and skip of a shard's preference order."""
    digest = hashlib.md5(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:], "big") % (size - 1) + 1


def fill_table(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> np.ndarray:
    """Slot -> index of the shard that claimed it. ``size`` must be prime and no smaller than the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not is_prime(size) or size < len(shards):
        raise ValueError("size must be a prime of at least the number of shards")
    orders = [(o + s * np.arange(size, dtype=np.int64)) % size for o, s in (preference(x, size) for x in shards)]
    at, table, left = [0] * len(shards), np.full(size, -1, dtype=np.int64), size
    while left:
        for k, order in enumerate(orders):
            while table[order[at[k]]] >= 0:
                at[k] += 1
            table[order[at[k]]] = k
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the first 32 bits of its md5 modulo the table size. A null key counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % size


def slot_table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    table = fill_table(shards, size)
    return spark.createDataFrame([(i, shards[k]) for i, k in enumerate(table.tolist())], "slot bigint, shard string")


def assign_shards(df: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """Every row of ``df`` with its slot and shard; no row moves (broadcast of ``size`` pairs, no shuffle).

    Nulls: a null key is placed as the empty text. Repeated rows and equal keys get the same shard. An empty table
    gives an empty result. Columns of ``df`` named like the two new ones are replaced; any other name may stand in it.
    """
    lookup = slot_table(df.sparkSession, shards, size).toDF("own_slot", "own_shard")
    row = df.select(F.struct(*df.columns).alias("row"), slot_of(F.col(key), size).alias("at"))
    joined = row.join(F.broadcast(lookup), F.col("at") == F.col("own_slot"))
    return joined.select(*[F.col("row")[c].alias(c) for c in df.columns if c not in (slot_col, shard_col)], F.col("own_slot").alias(slot_col), F.col("own_shard").alias(shard_col))


def shard_report(assigned: DataFrame, bytes_col: str | None = None, shard_col: str = "shard") -> DataFrame:
    """Rows, and characters of ``bytes_col`` if given, of each shard."""
    size = F.sum(F.length(F.coalesce(F.col(bytes_col), F.lit("")))) if bytes_col else F.count(F.lit(1))
    return assigned.groupBy(shard_col).agg(F.count(F.lit(1)).alias("n_rows"), size.alias("n_chars"))


def write_shards(df: DataFrame, key: str, path: str, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE, files_per_shard: int = 1) -> None:
    """Write one folder for each shard. Rows are dealt by shard and a salt of the slot, so a shard has ``files_per_shard`` files."""
    out = assign_shards(df, key, shards, size)
    out = out.withColumn("__salt", F.col("slot") % files_per_shard)
    out.repartition(len(shards) * files_per_shard, "shard", "__salt").drop("__salt").write.partitionBy("shard").parquet(path)


def oracle_sql(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> str:
    """DuckDB's statement of the placement of ``documents``. Turns cannot be told in plain SQL, so the claims are spelled out by a slower rule.

    Here each slot is asked which shards want it: turn by turn, a shard's claim is the first entry of its full
    preference list that is not in the set of slots taken.
    """
    lists = [iter([(o + i * s) % size for i in range(size)]) for o, s in (preference(x, size) for x in shards)]
    owner: dict[int, int] = {}
    while len(owner) < size:
        for k, wants in enumerate(lists):
            if (slot := next((x for x in wants if x not in owner), None)) is not None:
                owner[slot] = k
    names = ", ".join(f"'{x}'" for x in shards)
    places = ",".join(str(owner[i] + 1) for i in range(size))
    return f"""
SELECT doc_id, text, lang, source, n_chars, slot, ([{names}])[([{places}])[slot + 1]] AS shard
FROM (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {size} AS slot FROM documents)
"""
