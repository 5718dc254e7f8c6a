"""BPE with word ends by a trie of the distinct words, whose nodes hold the last token of their prefix.

The vocabulary is a JSON file: merges in order, an end mark on the last letter of each word, a pattern that finds
words, and tokens (markers) that are taken from the raw text before anything else. The distinct words of a slice of
texts are inserted into a trie. One walk, depth first, gives each node its state: the last token of the encoding of
the prefix that the node stands for. That token is the one suffix of the prefix which is a token of its own
encoding and which follows the last token of the prefix before it without a merge across their border; so a prefix
that many words share is encoded once, and a word's encoding is read back from its end. The end mark belongs to the
last letter, so the last node of a word is never a prefix of another.

Whether two tokens may follow each other is told by undoing their merges along the border: a merge across it happens
if the tokens on both sides stand there at the time of its rank, that is before either is merged away inside its own
token (of equal ranks the left one comes first). This needs merges ranked after those of their parts, which is
checked on reading.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple
from uuid import uuid4

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import arrow_map

#: Words, and token pairs, that a worker remembers. Full pairs start anew; of the words, those met since the memory was half full stay.
#: What is forgotten costs time and changes nothing else.
CACHE = 400_000
#: Characters of the texts whose words share a trie. A longer text makes a trie of its own.
SLICE = 1 << 20
#: Stands for the end mark inside this module. The byte alphabet has no blank.
END = " "


class Vocabulary(NamedTuple):
    """What a vocabulary file says: token texts by id, merges as (left, right, made) in order, letters, word pattern, markers, end mark."""

    tokens: list[str]
    merges: list[tuple[int, int, int]]
    letters: dict[int, str]
    pattern: str
    markers: dict[str, int]
    mark: str


def read_vocabulary(path: str) -> Vocabulary:
    """Vocabulary of a JSON file of the kind described above; ValueError for files of another kind."""
    with open(path, encoding="utf-8") as lines:
        file = json.load(lines)
    model, ids, mark = file["model"], file["model"]["vocab"], file["model"].get("end_of_word_suffix")
    steps = [s["type"] for s in (file["normalizer"] or {}).get("normalizers", [])]
    cuts = (file["pre_tokenizer"] or {}).get("pretokenizers", [])
    plain = not model.get("dropout") and not model.get("byte_fallback") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
    words = [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["invert"] and cuts[0]["behavior"] == "Removed" and not cuts[1]["add_prefix_space"] and not cuts[1].get("use_regex", True)
    markers = file.get("added_tokens") or []
    if model["type"] != "BPE" or not mark or not plain or not words or steps != ["NFC", "Replace", "Lowercase"] or file.get("decoder") or any(m["normalized"] or m["single_word"] or m["lstrip"] or m["rstrip"] for m in markers):
        raise ValueError(f"{path} is not a lower-case byte-level BPE with word ends")
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
    made = {m: rank for rank, (_, _, m) in enumerate(merges)}
    if len(made) != len(merges) or any(made.get(x, -1) >= rank for rank, (a, b, _) in enumerate(merges) for x in (a, b)):
        raise ValueError(f"{path}: merges must make each token once and come after those of their parts")
    # a token that no merge makes is a letter, with the end mark or without
    letters = {i: t if len(t) == 1 else t.removesuffix(mark) + END for t, i in ids.items() if i not in made}
    if any(len(t.removesuffix(END)) != 1 for t in letters.values()):
        raise ValueError(f"{path}: tokens that are neither letters nor merged")
    tokens = dict.fromkeys(range(1 + max([*ids.values(), *(m["id"] for m in markers)])), "")
    tokens |= {i: t for t, i in ids.items()} | {m["id"]: m["content"] for m in markers}
    return Vocabulary(list(tokens.values()), merges, letters, cuts[0]["pattern"]["Regex"], {m["content"]: m["id"] for m in markers}, mark)


def _ascii_pattern(pattern: str) -> regex.Pattern | re.Pattern:
    """``pattern`` for texts of ASCII alone: by the standard library, which is twice as fast, with the classes that it lacks spelt out.

    A pattern that holds any other class, or groups, stays with the ``regex`` module.
    """
    plain = pattern.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
    parts = plain.split("|")
    spelt = {c: "".join(f"\\x{i:02x}" for i in range(128) if regex.match(c, chr(i))) for c in (r"\p{L}", r"\p{N}", r"\s")}

    def own(part: str) -> str | None:
        classes = regex.fullmatch(r"(\[\^?(?:\\p\{[LN]\}|\\s)+\]|\\p\{[LN]\})(\+?)", part)
        if not classes:
            return part if regex.fullmatch(r"['A-Za-z]+", part) else None
        within = classes[1].strip("[]")
        for c, letters in spelt.items():
            within = within.replace(c, letters)
        return f"[{within}]{classes[2]}"

    made = [own(p) for p in parts]
    return regex.compile(pattern) if None in made else re.compile("|".join(made))


class Words:
    """Words of texts as the vocabulary's file has them: NFC, lower case letter by letter, matches of the pattern.

    White space never belongs to a word, so runs of it need no folding. Characters that this Python's Unicode tables
    lack are left to the tokenizers library's own normaliser and splitter, whose tables are newer.
    """

    def __init__(self, vocabulary: Vocabulary):
        import unicodedata

        self.pattern, self.nfc = vocabulary.pattern, unicodedata.normalize
        self.find = regex.compile(vocabulary.pattern).findall
        self.find_ascii = _ascii_pattern(vocabulary.pattern).findall
        self.markers = vocabulary.markers
        self.at_markers = regex.compile("(" + "|".join(regex.escape(m) for m in sorted(vocabulary.markers, key=len, reverse=True)) + ")").split if vocabulary.markers else lambda t: [t]
        self.category, self.assigned = unicodedata.category, set()

    def _unknown(self, text: str) -> bool:
        """Whether a character of the text is missing from this Python's Unicode tables. Those found in them are remembered."""
        new = set(text) - self.assigned
        self.assigned.update(c for c in new if self.category(c) != "Cn")
        return not new <= self.assigned

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.find_ascii(text.lower())
        if self._unknown(text):
            return self._by_library(text)
        return self.find(self.nfc("NFC", text).replace("Σ", "σ").lower())  # no final sigma: letters are lowered one by one

    def _by_library(self, text: str) -> list[str]:
        from tokenizers import Regex, normalizers, pre_tokenizers

        clean = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()]).normalize_str(text)
        return [w for w, _ in pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True).pre_tokenize_str(clean)]

    def of(self, text: str) -> list[str | int]:
        """Words in order; a marker of the raw text is given as its id."""
        parts = self.at_markers(text)
        if len(parts) == 1:
            return self._plain(text)
        return [x for k, part in enumerate(parts) for x in ([self.markers[part]] if k % 2 else self._plain(part))]


class TrieBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens, self.words = vocabulary.tokens, Words(vocabulary)
        self.letters = byte_alphabet()
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(vocabulary.merges)}
        self.parts = {m: (a, b) for a, b, m in vocabulary.merges}
        self.born = {m: r for r, (_, _, m) in enumerate(vocabulary.merges)}
        self.never = len(vocabulary.merges)
        spelt = dict(vocabulary.letters)
        for a, b, m in vocabulary.merges:
            spelt[m] = spelt[a] + spelt[b]
        self.whole: dict[int, bool] = {}
        self.by_text = {t: i for i, t in spelt.items() if self.stands(i)}
        self.width = {i: len(t.removesuffix(END)) for i, t in spelt.items()}
        self.widest = max(map(len, self.by_text))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.steps: dict[tuple[int, str], int] = {}
        self.told, self.read = [f" {i}" for i in range(len(self.tokens))], [f" {t}" for t in self.tokens]
        self.marked = [{i: texts[i] for i in vocabulary.markers.values()} for texts in (self.told, self.read)]
        # a word's ids in decimal and its tokens' texts, each behind a blank: what digests are made of, and nothing that a collector must walk
        self.known: list[dict[str | int, str]] = [dict(m) for m in self.marked]
        self.before: list[dict[str | int, str]] = [{}, {}]

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank at which it is merged away) of the tokens that stand at one border of ``token`` while it is built."""
        out, until = [(token, self.never)], self.never
        while token in self.parts:
            until, token = self.born[token], self.parts[token][side]
            out.append((token, until))
        return out

    def _crossed(self, left: int, right: int, before: int) -> bool:
        """Whether a merge ranked under ``before`` joins tokens across the border of ``left`` and ``right``."""
        ends = self._edge(right, 0)
        for p, gone in self._edge(left, 1):
            for q, taken in ends:
                rank = self.rank.get((p, q), self.never)
                if rank < before and rank < gone and rank <= taken:
                    return True
        return False

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' text is these two tokens."""
        pair = (left, right)
        if (ok := self.pairs.get(pair)) is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            ok = self.pairs[pair] = not self._crossed(left, right, self.never)
        return ok

    def stands(self, token: int) -> bool:
        """Whether the encoding of the token's text is the token."""
        if (ok := self.whole.get(token)) is None:
            ok = token not in self.parts or (all(map(self.stands, self.parts[token])) and not self._crossed(*self.parts[token], self.born[token]))
            self.whole[token] = ok
        return ok

    def trie(self, words: list[str]) -> dict:
        """Trie of words spelt in letters, the last with its mark. A branch that holds one word is that word, spelt."""
        return self._trie(map(self._spelt, words))

    def _spelt(self, word: str) -> str:
        return (word if word.isascii() and word.isalpha() else "".join(map(self.letters.__getitem__, word.encode()))) + END

    @staticmethod
    def _trie(words: Iterable[str]) -> dict:
        root: dict = {}
        for spelt in words:
            node, at = root, 0
            while True:
                symbol = spelt[at] if at < len(spelt) - 2 else spelt[at:]
                have = node.get(symbol)
                if have is None:
                    node[symbol] = spelt
                    break
                if isinstance(have, str):
                    if have == spelt:
                        break
                    node[symbol] = have = {have[at + 1] if at + 1 < len(have) - 2 else have[at + 1 :]: have}
                node, at = have, at + 1
        return root

    def walk(self, root: dict) -> Iterator[tuple[str, tuple[int, ...]]]:
        """(spelt word, ids) of each word of a trie, depth first. ``last`` is the state of the nodes on the way down."""
        last: list[int] = []
        by_text, width, widest, pairs, steps = self.by_text, self.width, self.widest, self.pairs, self.steps

        def step(text: str, at: int, to: int) -> None:
            """Take the letter ``text[at:to]``, with its mark if it has one, which the text before it led to."""
            depth = len(last) + 1
            way = (last[-1] if last else -1, text[at:to])
            token = steps.get(way)
            if token is not None:  # what followed this state before; it ends the prefix, so it is the one if it fits
                before = depth - width[token]
                if not before or pairs.get(pair := (last[before - 1], token)) or (pair not in pairs and self.fits(*pair)):
                    last.append(token)
                    return
            # one suffix fits, in whatever order they are tried; seldom is it much longer than the last token
            first = max(0, to - widest)
            near = max(first, to - len(way[1]) - (width[last[-1]] + 1 if last else 0))
            for k in chain(range(near, to), range(near - 1, first - 1, -1)):
                token = by_text.get(text[k:to])
                if token is not None:
                    before = depth - width[token]
                    if not before or self.fits(last[before - 1], token):
                        if not last or width[token] <= width[last[-1]] + 1:
                            if len(steps) >= CACHE:
                                steps.clear()
                            steps[way] = token
                        last.append(token)
                        return
            raise ValueError(f"the vocabulary has no token that ends {text[at:to]!r}")

        stack: list[tuple[int, str, dict | str]] = [(0, s, child) for s, child in root.items()]
        while stack:
            depth, prefix, child = stack.pop()
            del last[depth:]
            step(prefix, depth and len(prefix) - 1 - (prefix[-1] == END), len(prefix))
            if isinstance(child, dict):
                stack.extend((depth + 1, (prefix + s)[-widest:], c) for s, c in child.items())
                continue
            for at in range(depth + 1, len(child) - 1):
                to = at + 1 if at < len(child) - 2 else at + 2  # the last letter comes with its mark
                step(child, at, to)
            ids, at = [], len(last)
            while at:
                ids.append(last[at - 1])
                at -= width[ids[-1]]
            yield child, tuple(reversed(ids))

    def learn(self, words: set[str]) -> None:
        """Encode words by one trie and remember them."""
        spelt = {self._spelt(w): w for w in words}
        (told, read), (each_told, each_read) = self.known, (self.told, self.read)
        collects = gc.isenabled()
        gc.disable()  # a trie is many small dicts and no cycle
        try:
            for s, ids in self.walk(self._trie(spelt)):
                word = spelt[s]
                told[word] = "".join([each_told[i] for i in ids])
                read[word] = "".join([each_read[i] for i in ids])
        finally:
            if collects:
                gc.enable()

    def _recall(self, met: set[str | int]) -> None:
        """Put the words of a slice into ``known``: from the half of the memory before it, or anew."""
        new = met.difference(self.known[0])
        if len(self.known[0]) + len(new) > CACHE // 2:
            self.before, self.known = self.known, [dict(m) for m in self.marked]
            new = met.difference(self.known[0])
        kept = new.intersection(self.before[0])
        for now, before in zip(self.known, self.before, strict=True):
            now.update((w, before[w]) for w in kept)
        if len(new) > len(kept):
            self.learn(new - kept)

    def digestible(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Ids in decimal and token texts of each whole text, in order, each behind a blank; the texts of a slice share a trie."""
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE):
                size, to = size + len(texts[to]), to + 1
            found = [self.words.of(t) for t in texts[at:to]]
            self._recall(set().union(*found))
            told, read = (known.__getitem__ for known in self.known)
            for f in found:
                yield "".join(map(told, f)), "".join(map(read, f))
            at = to

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each whole text, in order."""
        for told, _ in self.digestible(texts):
            yield list(map(int, told.split()))

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: token texts joined by blanks, markers among them."""
        return " ".join(map(self.tokens.__getitem__, ids))


class Shared:
    """A vocabulary that travels to the workers by broadcast (its size is the file's); each worker builds its codec once."""

    def __init__(self, spark: SparkSession, path: str):
        self.key, self.vocabulary = uuid4().hex, spark.sparkContext.broadcast(read_vocabulary(path))

    def codec(self) -> TrieBPE:
        if self.key not in _CODECS:
            _CODECS.clear()
            _CODECS[self.key] = TrieBPE(self.vocabulary.value)
        return _CODECS[self.key]


#: The codec that this worker has built last.
_CODECS: dict[str, TrieBPE] = {}


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<bigint> of every whole text.

    A null or empty text has no ids. Row by row: repeated rows stay, null ids stay null, an empty table gives no rows,
    and other columns of the input, whatever their names, are not read. No text is cut; a word of any length is one
    path of the trie.
    """
    shared = Shared(df.sparkSession, path)

    def run(keys: list, texts: list) -> dict:
        return {id_col: keys, "ids": list(shared.codec().encode_all([t or "" for t in texts]))}

    return arrow_map(_pair(df, id_col, text_col), run, f"{id_col} bigint, ids array<bigint>", rows=256)


def decode_documents(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded string of every row of ids; null ids give the empty text."""
    shared = Shared(df.sparkSession, path)

    def run(keys: list, rows: list) -> dict:
        codec = shared.codec()
        return {id_col: keys, "decoded": [codec.decode(r or []) for r in rows]}

    return arrow_map(df.select(F.col(id_col).cast("bigint").alias(id_col), F.col(ids_col)), run, f"{id_col} bigint, decoded string", rows=256)


def round_trip_digest(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a blank), decoded_sha256: encode, decode the ids, digest both in one pass.

    Ids are written out and decoded once for each word that a worker learns, as a text's digests are those of its words' strings in a row.
    Nulls, empty and long texts, repeated rows and further columns are as in ``encode_documents``.
    """
    shared = Shared(df.sparkSession, path)

    def run(keys: list, texts: list) -> Iterator[dict]:
        codec = shared.codec()
        n, digests, decoded = [], [], []
        for told, read in codec.digestible([t or "" for t in texts]):
            n.append(told.count(" "))
            digests.append(hashlib.sha256(told[1:].encode()).hexdigest())
            decoded.append(hashlib.sha256(read[1:].encode()).hexdigest())
        yield {id_col: keys, "n_tokens": n, "ids_sha256": digests, "decoded_sha256": decoded}

    return arrow_map(_pair(df, id_col, text_col), run, f"{id_col} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", rows=512)


def _pair(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias(text_col))
