"""Byte-level BPE: the same ids as the rank files' own library, and exact round trips."""

import base64
import hashlib
import random
import struct

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from pairwright.llm import bpe, registry


def reference(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(7)
    alphabet = "ab \n\t\r é漢🙂'sS1٣\x00<|endoftext|>_-​́ "
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["", "a" * 5000, " " * 3000]


def test_same_ids_as_the_library():
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        path = public_tokenizers.path(name)
        codec, want = bpe.ByteBPE(bpe.read_ranks(path), public_tokenizers.PATTERN), reference(path)
        for t in odd_texts():
            ids = codec.encode(t)
            assert ids == want.encode_ordinary(t)
            assert codec.decode_bytes(ids) == t.encode()


def test_a_full_cache_changes_nothing(monkeypatch):
    codec = bpe.ByteBPE(bpe.read_ranks(registry.RANKS), public_tokenizers.PATTERN)
    texts = odd_texts()[:50]
    want = [codec.encode(t) for t in texts]
    monkeypatch.setattr(bpe, "CACHE", 3)
    assert [codec.encode(t) for t in texts] == want


def test_query(spark, data):
    want = reference(registry.RANKS)
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = registry.op7_bpe(spark, data).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = want.encode_ordinary(rows[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest()


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "a b", 5), (1, "a b", 5), (None, "", 5)], "doc_id bigint, text string, ids bigint")
    enc = bpe.encode_documents(df, registry.RANKS, public_tokenizers.PATTERN)
    assert sorted(len(r["ids"]) for r in enc.collect()) == [0, 0, 2, 2]
    dec = bpe.decode_documents(enc, registry.RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r["decoded"]) for r in dec.collect()) == [b"", b"", b"a b", b"a b"]
    assert bpe.encode_documents(df.limit(0), registry.RANKS, public_tokenizers.PATTERN).count() == 0


def test_edges_through_spark(spark):
    """Null, empty, repeated and very long texts, an empty table, and columns with the result's names."""
    want, texts = reference(registry.RANKS), [None, "", "a b", "a b", "long words and more " * 60_000, "x" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("n"))
    got = {r["doc_id"]: r for r in bpe.round_trip_digest(df, registry.RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = want.encode_ordinary(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip_digest(df.limit(0), registry.RANKS, public_tokenizers.PATTERN).count() == 0
