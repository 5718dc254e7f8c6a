"""The backend over RDKit, where it is installed on driver and executors. Fragment texts stay our own."""

from __future__ import annotations

from rdkit import Chem
from rdkit.Chem import Crippen, Descriptors, MACCSkeys, rdFingerprintGenerator, rdMolDescriptors
from rdkit.Chem.Scaffolds import MurckoScaffold

from . import properties, safe

_MORGAN = rdFingerprintGenerator.GetMorganGenerator(radius=2, fpSize=1024)
_PATHS = rdFingerprintGenerator.GetRDKitFPGenerator()


def _words(fp) -> list[int]:
    n = fp.GetNumBits()
    out = [0] * -(-n // 64)
    for b in fp.GetOnBits():
        out[b // 64] |= 1 << b % 64
    return [w - (1 << 64) if w >> 63 else w for w in out]


class ToolkitBackend:
    def __init__(self, slicer: str = "brics"):
        self.slicer = slicer

    def facts(self, smiles: str) -> dict | None:
        mol = Chem.MolFromSmiles(smiles)
        if mol is None or not mol.GetNumAtoms():
            return None
        core = MurckoScaffold.GetScaffoldForMol(mol)
        d = {"MW": Descriptors.ExactMolWt(mol), "logP": Crippen.MolLogP(mol), "TPSA": rdMolDescriptors.CalcTPSA(mol), "HBD": float(rdMolDescriptors.CalcNumHBD(mol)), "HBA": float(rdMolDescriptors.CalcNumHBA(mol)), "RotB": float(rdMolDescriptors.CalcNumRotatableBonds(mol))}
        return {
            "canonical": Chem.MolToSmiles(mol),
            "circular_fp": _words(_MORGAN.GetFingerprint(mol)),
            "scaffold_fp": _words(_MORGAN.GetFingerprint(core)) if core.GetNumHeavyAtoms() else None,
            "path_fp": _words(_PATHS.GetFingerprint(mol)),
            "key_fp": _words(MACCSkeys.GenMACCSKeys(mol)),
            "qed6": properties.qed6(d),
        } | d

    def encode(self, smiles: str) -> str:
        return safe.smiles_to_safe(smiles, self.slicer)

    def decode(self, text: str) -> str | None:
        return self.canonical(safe.safe_to_smiles(text) or "")

    def canonical(self, smiles: str) -> str | None:
        mol = Chem.MolFromSmiles(smiles) if smiles else None
        return Chem.MolToSmiles(mol) if mol is not None and mol.GetNumAtoms() else None

    def scaffold(self, smiles: str) -> str | None:
        mol = Chem.MolFromSmiles(smiles) if smiles else None
        return Chem.MolToSmiles(MurckoScaffold.GetScaffoldForMol(mol)) if mol is not None else None

    def encode_udf(self):
        from .base import _text_udf

        return _text_udf(self.encode)

    def decode_udf(self):
        from .base import _text_udf

        return _text_udf(self.decode)

    def canonical_udf(self):
        from .base import _text_udf

        return _text_udf(self.canonical)

    def scaffold_udf(self):
        from .base import _text_udf

        return _text_udf(self.scaffold)
