"""Word shingles as 64-bit hashes, and their MinHash values, with numpy."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

from .common import remembered

WORDS = 5
POSITIONS = 64

_WORD = re.compile(r"\w+").findall
_RNG = np.random.default_rng(20_240_229)
_MIX = _RNG.integers(1, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _RNG.integers(1, 1 << 63, size=POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, size=POSITIONS, dtype=np.uint64)

#: Words whose hashes a worker keeps; when full it starts anew.
_KNOWN_MOST = 500_000


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of each word: runs of letters, digits and underscores, in lower case."""
    words, known = _WORD(text.lower()), remembered("shingles", dict)
    if new := set(words).difference(known):
        if len(known) + len(new) > _KNOWN_MOST:
            known.clear()
            new = set(words)
        known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_set(text: str, size: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes. A text of fewer words than ``size`` is one shingle; one without words has none."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(size, len(w))
    h = np.zeros(len(w) - n + 1, dtype=np.uint64)
    for k in range(n):
        h += w[k : len(w) - n + 1 + k] * _MIX[k]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def minhash(tokens: np.ndarray) -> np.ndarray:
    """``POSITIONS`` minima of 32 bits; all ones for an empty set."""
    least = np.full(POSITIONS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(tokens), 2048):
        part = ((tokens[at : at + 2048, None] * _MUL + _ADD) >> np.uint64(32)).astype(np.uint32)
        np.minimum(least, part.min(axis=0), out=least)
    return least


def set_digest(tokens: np.ndarray, text: str) -> tuple[int, int]:
    """128 bits, as two signed longs, that equal sets share; a text without words is known by itself."""
    raw = hashlib.blake2b(tokens.tobytes() if len(tokens) else b"text:" + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)
