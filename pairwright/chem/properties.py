"""Descriptors, fingerprints and scaffolds of molecular graphs, after their published definitions."""

from __future__ import annotations

import hashlib
import math
from itertools import pairwise

from .smiles import Mol, SmilesError, atom_text, parse, ranks, write

#: Monoisotopic masses.
MASS = {
    "H": 1.00782503223, "B": 11.00930536, "C": 12.0, "N": 14.00307400443, "O": 15.99491461957, "F": 18.99840316273, "Na": 22.989769282, "Mg": 23.985041697, "Si": 27.97692653465, "P": 30.97376199842, "S": 31.9720711744,
    "Cl": 34.968852682, "K": 38.9637064864, "Ca": 39.962590863, "Fe": 55.93493633, "Cu": 62.92959772, "Zn": 63.92914201, "As": 74.92159457, "Se": 79.9165218, "Br": 78.9183376, "I": 126.9044719, "Li": 7.0160034366, "*": 0.0,
}
#: Polar surface of nitrogen and oxygen environments (Ertl et al. 2000): (symbol, aromatic, H, single, double, triple, aromatic bonds, charge).
TPSA = {
    ("N", False, 0, 3, 0, 0, 0, 0): 3.24, ("N", False, 0, 1, 1, 0, 0, 0): 12.36, ("N", False, 0, 0, 0, 1, 0, 0): 23.79, ("N", False, 0, 1, 2, 0, 0, 0): 11.68, ("N", False, 1, 2, 0, 0, 0, 0): 12.03, ("N", False, 1, 0, 1, 0, 0, 0): 23.85,
    ("N", False, 2, 1, 0, 0, 0, 0): 26.02, ("N", False, 0, 4, 0, 0, 0, 1): 0.0, ("N", False, 0, 2, 1, 0, 0, 1): 3.01, ("N", False, 1, 3, 0, 0, 0, 1): 4.44, ("N", False, 2, 2, 0, 0, 0, 1): 16.61, ("N", False, 3, 1, 0, 0, 0, 1): 27.64,
    ("N", True, 0, 0, 0, 0, 2, 0): 12.89, ("N", True, 0, 0, 0, 0, 3, 0): 4.41, ("N", True, 0, 1, 0, 0, 2, 0): 4.93, ("N", True, 1, 0, 0, 0, 2, 0): 15.79, ("N", True, 0, 1, 0, 0, 2, 1): 3.88,
    ("O", False, 0, 2, 0, 0, 0, 0): 9.23, ("O", False, 0, 0, 1, 0, 0, 0): 17.07, ("O", False, 1, 1, 0, 0, 0, 0): 20.23, ("O", False, 0, 1, 0, 0, 0, -1): 23.06, ("O", True, 0, 0, 0, 0, 2, 0): 13.14,
}
#: Desirability functions and mean weights of the published QED (Bickerton et al. 2012): a, b, c, d, e, f, largest value, weight.
QED = {
    "MW": (2.817065973, 392.5754953, 290.7489764, 2.419764353, 49.22325677, 65.37051707, 104.9805561, 0.66),
    "logP": (3.172690585, 137.8624751, 2.534937431, 4.581497897, 0.822739154, 0.576295591, 131.3186604, 0.46),
    "HBA": (2.948620388, 160.4605972, 3.615294657, 4.435986202, 0.290141953, 1.300669958, 148.7763046, 0.05),
    "HBD": (1.618662227, 1010.051101, 0.985094388, 0.000000001, 0.713820843, 0.920922555, 258.1632616, 0.61),
    "TPSA": (1.876861559, 125.2232657, 62.90773554, 87.83366614, 12.01999824, 28.51324732, 104.5686167, 0.06),
    "RotB": (0.010000000, 272.4121427, 2.558379970, 1.565547684, 1.271567166, 2.758063707, 105.4420403, 0.65),
}
#: Atom contributions to logP by coarse classes, in the spirit of Wildman and Crippen 1999; self-consistent, not identical to full typing.
LOGP = {"C": 0.1441, "c": 0.2940, "N": -0.7614, "n": -0.3239, "O": -0.2893, "o": 0.1552, "S": 0.6482, "s": 0.6237, "F": 0.4118, "Cl": 0.6895, "Br": 0.8456, "I": 0.8857, "P": 0.8612, "H": 0.1230, "H_polar": -0.2677}

BITS = 1024


def descriptors(mol: Mol) -> dict[str, float]:
    """Exact mass, logP, polar surface, donors, acceptors, rotatable bonds."""
    mass = logp = tpsa = 0.0
    hbd = hba = 0
    for i, a in enumerate(mol.atoms):
        h = mol.hydrogens(i)
        if a.symbol not in MASS:
            raise SmilesError(f"no mass of {a.symbol}")
        mass += MASS[a.symbol] + h * MASS["H"]
        logp += LOGP.get(a.symbol.lower() if a.aromatic else a.symbol, 0.0) + h * (LOGP["H_polar"] if a.symbol in ("N", "O", "S") else LOGP["H"])
        if a.symbol in ("N", "O"):
            hbd += h > 0
            hba += not (a.symbol == "N" and (a.charge > 0 or (a.aromatic and (h or len(a.bonds) == 3)) or (not a.aromatic and _amide(mol, i))))
            orders = list(a.bonds.values())
            key = (a.symbol, a.aromatic, h, orders.count(1), orders.count(2), orders.count(3), orders.count(1.5), a.charge)
            tpsa += TPSA.get(key, 0.0)
    return {"MW": mass, "logP": logp, "TPSA": tpsa, "HBD": float(hbd), "HBA": float(hba), "RotB": float(len(rotatable(mol)))}


def _amide(mol: Mol, i: int) -> bool:
    return any(mol.atoms[j].symbol in ("C", "S") and any(mol.atoms[k].symbol == "O" and o == 2 for k, o in mol.atoms[j].bonds.items()) for j in mol.atoms[i].bonds)


def rotatable(mol: Mol) -> list[tuple[int, int]]:
    """Single bonds outside rings whose ends both have another heavy neighbour and no triple bond."""
    ring = mol.rings()
    open_end = lambda i: len(mol.atoms[i].bonds) > 1 and 3 not in mol.atoms[i].bonds.values()
    return [(i, j) for i, a in enumerate(mol.atoms) for j, o in a.bonds.items() if i < j and o == 1 and (i, j) not in ring and open_end(i) and open_end(j)]


def qed6(d: dict[str, float]) -> float:
    """Weighted geometric mean of the six desirabilities."""
    total = weights = 0.0
    for name, (a, b, c, e1, e2, e3, top, w) in QED.items():
        x = d[name]
        value = (a + b / (1 + math.exp(-(x - c + e1 / 2) / e2)) * (1 - 1 / (1 + math.exp(-(x - c - e1 / 2) / e3)))) / top
        total, weights = total + w * math.log(max(value, 1e-12)), weights + w
    return math.exp(total / weights)


def _hash(x: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=8).digest(), "little")


def _words(bits: set[int]) -> list[int]:
    """64-bit words, signed."""
    out = [0] * (BITS // 64)
    for b in bits:
        out[b // 64] |= 1 << b % 64
    return [w - (1 << 64) if w >> 63 else w for w in out]


def circular(mol: Mol, radius: int = 2) -> list[int]:
    """Circular fingerprint: hashes of atom environments up to the radius, folded to ``BITS``."""
    ring = {i for b in mol.rings() for i in b}
    ids = [_hash((a.symbol, a.aromatic, a.charge, len(a.bonds), mol.hydrogens(i), i in ring)) for i, a in enumerate(mol.atoms)]
    bits = {x % BITS for x in ids}
    for r in range(radius):
        ids = [_hash((r, ids[i], sorted((o, ids[j]) for j, o in a.bonds.items()))) for i, a in enumerate(mol.atoms)]
        bits |= {x % BITS for x in ids}
    return _words(bits)


def paths(mol: Mol, longest: int = 7) -> list[int]:
    """Path fingerprint: hashes of linear paths of up to ``longest`` bonds."""
    name = lambda i: (mol.atoms[i].symbol, mol.atoms[i].aromatic)
    bits: set[int] = set()
    stack = [[i] for i in range(len(mol.atoms))]
    while stack:
        p = stack.pop()
        if len(p) > 1:
            forward = [x for a, b in pairwise(p) for x in (name(a), mol.atoms[a].bonds[b])] + [name(p[-1])]
            bits.add(_hash(min(forward, forward[::-1], key=repr)) % BITS)
        if len(p) <= longest:
            stack += [[*p, j] for j in mol.atoms[p[-1]].bonds if j not in p]
    return _words(bits)


def keys(mol: Mol) -> list[int]:
    """Structural keys: counts of elements, bond kinds, rings, charges and neighbour pairs, as one bit for each count reached."""
    counts: dict = {}
    ring = mol.rings()
    for i, a in enumerate(mol.atoms):
        for k in (("atom", a.symbol), ("aromatic", a.symbol) if a.aromatic else None, ("charge", a.charge) if a.charge else None, ("degree", a.symbol, len(a.bonds)), ("h", a.symbol, mol.hydrogens(i))):
            if k:
                counts[k] = counts.get(k, 0) + 1
        for j, o in a.bonds.items():
            if i < j:
                k = ("bond", *sorted((a.symbol, mol.atoms[j].symbol)), o, (i, j) in ring)
                counts[k] = counts.get(k, 0) + 1
    return _words({_hash((k, n)) % BITS for k, c in counts.items() for n in (1, 2, 4, 8) if c >= n})


def scaffold(mol: Mol) -> Mol:
    """Rings, linkers between them, and atoms double-bonded to these; no atoms for an acyclic molecule."""
    ring = {i for b in mol.rings() for i in b}
    keep = set(range(len(mol.atoms)))
    while ends := [i for i in keep if i not in ring and sum(j in keep for j in mol.atoms[i].bonds) <= 1]:
        keep -= set(ends)
    if not ring:
        return Mol([])
    keep |= {j for i in keep for j, o in mol.atoms[i].bonds.items() if o == 2 and len(mol.atoms[j].bonds) == 1}
    part = mol.keep(sorted(keep))
    for a, i in zip(part.atoms, sorted(keep), strict=True):
        if a.hydrogens is not None and not a.charge:  # bonds that are cut leave hydrogens
            a.hydrogens += sum(o if o != 1.5 else 1 for j, o in mol.atoms[i].bonds.items() if j not in keep)
            a.hydrogens = int(a.hydrogens)
    return part


def scaffold_text(text: str) -> str | None:
    """Scaffold of a SMILES text: '' for an acyclic one, None for one that is blank or doesn't parse."""
    try:
        part = scaffold(parse(text))
        return write(part, ranks(part), texts={i: atom_text(part, i) for i in range(len(part.atoms))}) if part.atoms else ""  # without hands
    except SmilesError:
        return None
