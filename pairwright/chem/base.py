"""The chemistry backend: one interface, run by Arrow batches over distinct texts only."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import properties, safe
from .smiles import SmilesError, parse, ranks, write


class ChemBackend(Protocol):
    """What a stage may ask of chemistry. ``facts`` gives None for a text that doesn't parse."""

    def facts(self, smiles: str) -> dict | None: ...
    def encode(self, smiles: str) -> str: ...
    def decode(self, text: str) -> str | None: ...
    def canonical(self, smiles: str) -> str | None: ...
    def scaffold(self, smiles: str) -> str | None: ...


class PureBackend:
    """Plain Python; self-consistent, not identical to other toolkits."""

    def __init__(self, slicer: str = "brics"):
        self.slicer = slicer

    def facts(self, smiles: str) -> dict | None:
        try:
            mol = parse(smiles)
            rank = ranks(mol)
            core = properties.scaffold(mol)
            d = properties.descriptors(mol)
            return {
                "canonical": write(mol, rank),
                "circular_fp": properties.circular(mol),
                "scaffold_fp": properties.circular(core) if core.atoms else None,
                "path_fp": properties.paths(mol),
                "key_fp": properties.keys(mol),
                "qed6": properties.qed6(d),
            } | d
        except SmilesError:
            return None

    def encode(self, smiles: str) -> str:
        return safe.smiles_to_safe(smiles, self.slicer)

    def decode(self, text: str) -> str | None:
        return safe.safe_to_smiles(text)

    def canonical(self, smiles: str) -> str | None:
        try:
            return write(parse(smiles))
        except SmilesError:
            return None

    def scaffold(self, smiles: str) -> str | None:
        return properties.scaffold_text(smiles)

    def encode_udf(self) -> Callable[[Column], Column]:
        return _text_udf(self.encode)

    def decode_udf(self) -> Callable[[Column], Column]:
        return _text_udf(self.decode)

    def canonical_udf(self) -> Callable[[Column], Column]:
        return _text_udf(self.canonical)

    def scaffold_udf(self) -> Callable[[Column], Column]:
        """Scaffold as the group key of a split; null for a text that doesn't parse, '' for acyclic ones."""
        return _text_udf(self.scaffold)


def _text_udf(fn: Callable[[str], str | None]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fn(x))

    return run


FACTS = pa.schema(
    [("decoded", pa.string()), ("valid", pa.bool_()), ("canonical", pa.string())]
    + [(c, pa.list_(pa.int64())) for c in ("circular_fp", "scaffold_fp", "path_fp", "key_fp")]
    + [(c, pa.float64()) for c in ("MW", "logP", "TPSA", "HBD", "HBA", "RotB", "qed6")]
)
_DDL = "decoded string, valid boolean, canonical string, circular_fp array<bigint>, scaffold_fp array<bigint>, path_fp array<bigint>, key_fp array<bigint>, MW double, logP double, TPSA double, HBD double, HBA double, RotB double, qed6 double"


def describe(texts: DataFrame, column: str, backend: ChemBackend, decode: bool = False) -> DataFrame:
    """Facts of each distinct text: all null but ``valid`` = false where it doesn't parse. ``decode``: the text is SAFE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(column, pa.string()), *FACTS])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for x in batch.column(0).slice(at, 512).to_pylist():
                    text = (backend.decode(x) if decode else x) if x else None
                    facts = backend.facts(text) if text else None
                    rows.append({column: x, "decoded": text, "valid": facts is not None} | (facts or {}))
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return texts.select(column).mapInArrow(run, f"`{column}` string, {_DDL}")


def load_backend(name: str = "auto", slicer: str = "brics") -> ChemBackend:
    """'pure', 'rdkit', or whichever of the two is there."""
    if name in ("auto", "rdkit"):
        try:
            from .toolkit import ToolkitBackend

            return ToolkitBackend(slicer)
        except ImportError:
            if name == "rdkit":
                raise
    return PureBackend(slicer)
