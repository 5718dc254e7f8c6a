"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank file.

Each of the 256 bytes is written as one printable character; a token of the rank file becomes the piece of its
bytes' characters with score ``-rank``, so that sentencepiece's rule (join the adjacent pair with the highest score,
leftmost first) is the merge rule of the ranks. Normalisation is the identity, and no prefix or white space is
added. Texts are split into pre-tokens by the tokenizer's pattern; each distinct pre-token is encoded once for as
long as it stays in the worker's cache. Decoding maps ids to their bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, remembered

#: Pre-tokens that a worker keeps; when full the cache starts anew, which costs time and changes nothing else.
CACHE = 400_000


def byte_alphabet() -> list[str]:
    """Character of each byte: printable Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    return [chr(b) if b in printable else chr(256 + next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _field(number: int, value: int | bytes | float) -> bytes:
    """One protobuf field: float as fixed 32 bits, int as varint, bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        pairs = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, lines)]
    pairs.sort()
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without gaps")
    return [t for _, t in pairs]


def serialise_model(tokens: list[bytes]) -> bytes:
    """sentencepiece ModelProto with the pieces of ``tokens`` (id = rank) and one unknown piece after them.

    Fields of the public schema: pieces 1 {piece 1, score 2, type 3}, trainer_spec 2 {model_type 3 = BPE 2,
    vocab_size 4, unk/bos/eos/pad id 40-43, unk piece 45}, normalizer_spec 3 {name 1, charsmap 2, the three white
    space switches 3-5 off}.
    """
    letters = byte_alphabet()
    pieces = [_field(1, _field(1, "".join(letters[b] for b in t).encode()) + _field(2, float(-rank)) + _field(3, 1)) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    none = (1 << 64) - 1  # -1
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, none) + _field(42, none) + _field(43, none)
    normal = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normal)


class ByteBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.bytes_of = tokens
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialise_model(tokens))
        self.split = regex.compile(pattern).findall
        self.letters = byte_alphabet()
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Encode pre-tokens into the cache. One that is itself a token is that token, as in the rank files' libraries."""
        rest = []
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            if (i := self.whole.get(raw)) is not None:
                self.known[w] = struct.pack("<I", i)
            else:
                rest.append((w, "".join(map(self.letters.__getitem__, raw))))
        for (w, _), ids in zip(rest, self.model.encode([x for _, x in rest], num_threads=1), strict=True):
            self.known[w] = struct.pack(f"<{len(ids)}I", *ids)

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words = self.split(text)
        if new := set(words).difference(self.known):
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
                new = set(words)
            self.learn(list(new))
        return b"".join(map(self.known.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        packed = self.encode_packed(text)
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Shared:
    """A vocabulary that travels to the workers by broadcast, as they may not see the driver's files; each builds its codec once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.key, self.tokens, self.pattern = uuid4().hex, spark.sparkContext.broadcast(read_ranks(path)), pattern

    def codec(self) -> ByteBPE:
        return remembered(self.key, lambda: ByteBPE(self.tokens.value, self.pattern))


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<bigint> of every whole text. A null text is the empty text: no ids. Row by row: repeated rows stay."""

    shared = Shared(df.sparkSession, path, pattern)

    def run(ids: list, texts: list) -> dict:
        codec = shared.codec()
        return {id_col: ids, "ids": [codec.encode(t or "") for t in texts]}

    return arrow_map(_pair(df, id_col, text_col), run, f"{id_col} bigint, ids array<bigint>", rows=256)


def decode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded binary of every row of ids; null ids give no bytes."""

    shared = Shared(df.sparkSession, path, pattern)

    def run(keys: list, rows: list) -> dict:
        codec = shared.codec()
        return {id_col: keys, "decoded": [codec.decode_bytes(r or []) for r in rows]}

    return arrow_map(df.select(F.col(id_col).cast("bigint").alias(id_col), F.col(ids_col)), run, f"{id_col} bigint, decoded binary", rows=256)


def round_trip_digest(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, decode the ids again, and digest both in one pass.

    Ids and bytes go no further than the worker, so that the result has a fixed width. Nulls, empty and very long
    texts and repeated rows are as in ``encode_documents``.
    """

    shared = Shared(df.sparkSession, path, pattern)

    def run(keys: list, texts: list) -> Iterator[dict]:
        codec = shared.codec()
        n, digests, decoded = [], [], []
        for t in texts:
            packed = codec.encode_packed(t or "")
            ids = memoryview(packed).cast("I").tolist() if _LITTLE else struct.unpack(f"<{len(packed) // 4}I", packed)
            n.append(len(ids))
            digests.append(hashlib.sha256(packed).hexdigest())
            decoded.append(hashlib.sha256(codec.decode_bytes(ids)).hexdigest())
        yield {id_col: keys, "n_tokens": n, "ids_sha256": digests, "decoded_sha256": decoded}

    return arrow_map(_pair(df, id_col, text_col), run, f"{id_col} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", rows=512)


_LITTLE = struct.pack("=I", 1) == struct.pack("<I", 1)


def _pair(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias(text_col))
