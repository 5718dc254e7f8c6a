"""A stand-in for chemistry on plain words, so that the whole chain of the plans can be held against SQL.

A text is a row of words, its fragments are the words, its canonical form has single spaces, and its descriptors are
counts that SQL can make too. Fingerprints are empty bitmaps, which are like nothing, so texts pair by edits alone.
"""

from __future__ import annotations

from .base import PureBackend


class WordBackend(PureBackend):
    """Letters counted by each descriptor: MW all, logP a, TPSA e, HBD i, HBA o; RotB counts words."""

    LETTERS = (("logP", "a"), ("TPSA", "e"), ("HBD", "i"), ("HBA", "o"))

    def facts(self, smiles: str) -> dict | None:
        words = smiles.split()
        if not words:
            return None
        text = " ".join(words)
        empty = {c: [0] for c in ("circular_fp", "scaffold_fp", "path_fp", "key_fp")}
        return {"canonical": text, **empty, "MW": float(len(text)), **{d: float(text.count(c)) for d, c in self.LETTERS}, "RotB": float(len(words)), "qed6": 0.0}

    def encode(self, smiles: str) -> str:
        return ".".join(smiles.split())

    def decode(self, text: str) -> str | None:
        return " ".join(x for x in text.split(".") if x) or None

    def canonical(self, smiles: str) -> str | None:
        return " ".join(smiles.split()) or None

    def scaffold(self, smiles: str) -> str | None:
        return next(iter(smiles.split()), "")
