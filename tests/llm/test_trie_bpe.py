"""BPE by a trie: the same ids and texts as the tokenizers library, words encoded once per prefix, edges."""

import hashlib
import json
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairwright.llm import registry, trie_bpe


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(registry.WORDS)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def codec():
    return trie_bpe.TrieBPE(trie_bpe.read_vocabulary(registry.WORDS))


def odd_texts():
    rng = random.Random(5)
    out = ["", " " * 300, "a" * 5000, "!" * 333, "haha" * 500, "é" * 999, "<|endoftext|><|startoftext|>a<|endoftext|", "ΑΣ ΟΔΟΣ İstanbul ǅ ﬁ é", "don't WE'LL 's' ''s a</w>b", "՘a \U00010940b࢏"]
    for letters in ("ab \n\t\r é漢🙂'sS1٣\x00<|endoftext|>_-​́ ΣςİIıǅﬁ", "abcdeinthasor", "aaab'!.-", "lololhaah "):
        out += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(700)]
    return out


def test_same_as_the_library(codec, library):
    texts = odd_texts()
    for text, ids, want in zip(texts, codec.encode_all(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == want.ids, text
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_whole_vocabulary_as_words(codec, library):
    """Every token's text as a word of its own, with and without the end mark, so that unreachable tokens would show."""
    texts = [t.removesuffix("</w>") for t in library.get_vocab()]
    assert [ids for ids in codec.encode_all(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_prefixes_are_walked_once(codec):
    words = ["international", "internationally", "internet", "inter", "x"]
    root = codec.trie(words)

    def depth(node):
        return sum(1 + depth(c) if isinstance(c, dict) else 1 for c in node.values())

    assert depth(root) < sum(map(len, words))  # shared nodes, lone tails kept whole
    assert {s.removesuffix(trie_bpe.END) for s, _ in codec.walk(root)} == set(words)


def test_full_memories_change_nothing(codec, monkeypatch):
    texts = odd_texts()[:200]
    want = list(codec.encode_all(texts))
    monkeypatch.setattr(trie_bpe, "CACHE", 5)
    monkeypatch.setattr(trie_bpe, "SLICE", 40)
    fresh = trie_bpe.TrieBPE(trie_bpe.read_vocabulary(registry.WORDS))
    assert list(fresh.encode_all(texts)) == want


def test_words_in_use_outlive_a_full_memory(monkeypatch):
    """A word that each slice holds is encoded once, however often the memory fills with words that come once; ids are written out with it."""
    monkeypatch.setattr(trie_bpe, "CACHE", 40)
    monkeypatch.setattr(trie_bpe, "SLICE", 60)
    fresh, learnt = trie_bpe.TrieBPE(trie_bpe.read_vocabulary(registry.WORDS)), []
    learn = fresh.learn
    monkeypatch.setattr(fresh, "learn", lambda words: (learnt.extend(words), learn(words)))
    texts = ["".join(f" {chr(97 + i % 26)}{chr(97 + i // 26)}{c}x" for c in "bcdefg") + " common" for i in range(200)]
    want = [[i for w in t.split() for i in next(fresh.encode_all([w]))] for t in texts]
    learnt.clear()
    assert list(fresh.encode_all(texts)) == want
    assert len(learnt) > 1000 and learnt.count("common") <= 1


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        trie_bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    file = json.loads(open(registry.WORDS, encoding="utf-8").read())
    file["model"]["merges"].insert(0, file["model"]["merges"].pop())  # a merge before those of its parts
    (tmp_path / "v.json").write_text(json.dumps(file))
    with pytest.raises(ValueError):
        trie_bpe.read_vocabulary(str(tmp_path / "v.json"))


def digests(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_query(spark, data, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = registry.op12_trie_bpe(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == digests(library, texts[r["doc_id"]])


def test_edges_through_spark(spark, library):
    """Null, empty, repeated and very long texts, null ids, an empty table, and columns with the result's names."""
    texts = [None, "", "A b", "A b", "long words and more " * 60_000, "x" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("n"))
    got = {r["doc_id"]: r for r in trie_bpe.round_trip_digest(df, registry.WORDS).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == digests(library, t or "")
    none = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id bigint, text string")
    enc = trie_bpe.encode_documents(none, registry.WORDS)
    assert [(r["doc_id"], len(r["ids"])) for r in enc.collect()] == [(None, 1), (None, 1)]
    assert [r["decoded"] for r in trie_bpe.decode_documents(enc, registry.WORDS).collect()] == ["a</w>", "a</w>"]
    assert trie_bpe.round_trip_digest(df.limit(0), registry.WORDS).count() == 0
