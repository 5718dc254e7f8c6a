"""Molecular graphs from SMILES text, and text from graphs. Follows the public SMILES grammar.

The hand of a tetrahedral centre is kept where its four neighbours are of different classes of the graph, so mirror
images have texts of their own; marks of double bonds, and of centres that only other centres tell apart, are dropped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Atoms that need no brackets, and their usual valences.
VALENCES = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,)}
AROMATIC = "bcnops"
ORDER = {"-": 1, "=": 2, "#": 3, "$": 4, ":": 1.5, "/": 1, "\\": 1}
_BRACKET = re.compile(r"\[(\d+)?([A-Z][a-z]?|[bcnops]|se|as|\*)(@{0,2})(H\d*)?([+-]\d+|\++|-+)?(?::(\d+))?\]")
_TOKEN = re.compile(r"(\[[^\]]*\])|(Cl|Br|[BCNOPSFI]|[bcnops]|\*)|(%\d\d|\d)|([-=#$:/\\])|([().])")


class SmilesError(ValueError):
    pass


@dataclass
class Atom:
    symbol: str
    aromatic: bool = False
    charge: int = 0
    hydrogens: int | None = None
    isotope: int | None = None
    number: int | None = None
    bonds: dict[int, float] = field(default_factory=dict)
    #: '@' or '@@' of a centre, as seen along the neighbours in ``around``; -1 is its hydrogen.
    hand: str | None = None
    around: list = field(default_factory=list)


@dataclass
class Mol:
    atoms: list[Atom]

    def hydrogens(self, i: int) -> int:
        """Attached hydrogens: those of the brackets, or what the usual valence leaves."""
        a = self.atoms[i]
        if a.hydrogens is not None or a.symbol not in VALENCES:
            return a.hydrogens or 0
        used = sum(1 if o == 1.5 else o for o in a.bonds.values()) + (1 if a.aromatic and self._pi(i) else 0)
        for v in VALENCES[a.symbol]:
            if used <= v:
                return int(v - used)
        if a.aromatic and used - 1 <= VALENCES[a.symbol][-1]:
            return 0
        raise SmilesError(f"too many bonds at atom {i}")

    def _pi(self, i: int) -> bool:
        """An aromatic atom that gives one electron takes one valence for it; O and S, and N with three neighbours, give two."""
        a = self.atoms[i]
        if a.symbol in ("O", "S"):
            return False
        return not (a.symbol in ("N", "P") and len(a.bonds) >= 3)

    def rings(self) -> set[tuple[int, int]]:
        """Bonds that lie on a ring, as sorted pairs: those that are no bridges."""
        seen, low, bridges = {}, {}, set()
        for root in range(len(self.atoms)):
            if root in seen:
                continue
            stack = [(root, -1, iter(self.atoms[root].bonds))]
            seen[root] = low[root] = len(seen)
            while stack:
                v, parent, rest = stack[-1]
                for w in rest:
                    if w == parent:
                        continue
                    if w in seen:
                        low[v] = min(low[v], seen[w])
                    else:
                        seen[w] = low[w] = len(seen)
                        stack.append((w, v, iter(self.atoms[w].bonds)))
                        break
                else:
                    stack.pop()
                    if parent >= 0:
                        low[parent] = min(low[parent], low[v])
                        if low[v] > seen[parent]:
                            bridges.add((min(v, parent), max(v, parent)))
        every = {(min(i, j), max(i, j)) for i, a in enumerate(self.atoms) for j in a.bonds}
        return every - bridges

    def keep(self, ids: list[int]) -> Mol:
        """The part of these atoms."""
        place = {old: new for new, old in enumerate(ids)}
        whole = lambda a: a.hand and all(j in place for j in a.bonds)
        return Mol([Atom(a.symbol, a.aromatic, a.charge, a.hydrogens, a.isotope, a.number, {place[j]: o for j, o in a.bonds.items() if j in place}, a.hand if whole(a) else None, [place.get(j, -1) for j in a.around] if whole(a) else []) for a in (self.atoms[i] for i in ids)])


def parse(text: str) -> Mol:
    """Graph of a SMILES text; an error for what isn't one."""
    if not text:
        raise SmilesError("empty")
    atoms: list[Atom] = []
    stack, last, bond, open_rings, at = [], None, None, {}, 0
    for m in _TOKEN.finditer(text):
        if m.start() != at:
            raise SmilesError(f"unexpected {text[at]!r}")
        at = m.end()
        bracket, organic, ring, mark, other = m.groups()
        if bracket or organic:
            atoms.append(_atom(bracket) if bracket else Atom(organic.capitalize() if organic in AROMATIC else organic, organic in AROMATIC))
            if last is not None:
                _join(atoms, last, len(atoms) - 1, bond)
                atoms[last].around.append(len(atoms) - 1)
                atoms[-1].around.insert(0, last)
            last, bond = len(atoms) - 1, None
        elif ring:
            if last is None:
                raise SmilesError("ring label before an atom")
            n = int(ring.strip("%"))
            if n in open_rings:
                other_end, earlier, spot = open_rings.pop(n)
                if other_end == last or other_end in atoms[last].bonds or (bond and earlier and ORDER[bond] != ORDER[earlier]):
                    raise SmilesError(f"bad ring {n}")
                _join(atoms, other_end, last, bond or earlier)
                atoms[other_end].around[spot] = last
                atoms[last].around.append(other_end)
            else:
                open_rings[n] = (last, bond, len(atoms[last].around))
                atoms[last].around.append(None)  # a ring's neighbour stands where its label does
            bond = None
        elif mark:
            bond = mark
        elif other == "(":
            if last is None:
                raise SmilesError("branch before an atom")
            stack.append(last)
        elif other == ")":
            if not stack:
                raise SmilesError("unbalanced branch")
            last = stack.pop()
        else:
            if stack or bond:
                raise SmilesError("dot inside a branch")
            last = None
    if at != len(text) or stack or open_rings or bond or not atoms:
        raise SmilesError("unfinished")
    mol = Mol(atoms)
    ring_atoms = {i for b in mol.rings() for i in b}
    for i, a in enumerate(atoms):
        if a.aromatic and i not in ring_atoms:
            raise SmilesError("aromatic atom outside a ring")
        mol.hydrogens(i)
    if any(a.hand for a in atoms):
        group = _refined(mol, _invariants(mol))
        for a in atoms:
            if a.hand and (len(a.around) != 4 or len({-1 if j < 0 else group[j] for j in a.around}) != 4):
                a.hand = None
    return mol


def _odd(a: list[int], b: list[int]) -> bool:
    """Whether an odd number of swaps turns one order into the other."""
    at = [a.index(x) for x in b]
    return sum(at[i] > at[j] for i in range(len(at)) for j in range(i + 1, len(at))) % 2 == 1


def _atom(bracket: str) -> Atom:
    m = _BRACKET.fullmatch(bracket)
    if not m:
        raise SmilesError(f"bad atom {bracket}")
    isotope, symbol, hand, h, charge, number = m.groups()
    q = 0
    if charge:
        q = int(charge) if len(charge) > 1 and charge[1].isdigit() else (1 if charge[0] == "+" else -1) * len(charge)
    aromatic = symbol[0].islower()
    return Atom(symbol.capitalize() if aromatic else symbol, aromatic, q, 0 if not h else int(h[1:] or 1), int(isotope) if isotope else None, int(number) if number else None, hand=hand or None, around=[-1] if h else [])


def _join(atoms: list[Atom], i: int, j: int, mark: str | None) -> None:
    order = ORDER[mark] if mark else 1.5 if atoms[i].aromatic and atoms[j].aromatic else 1
    atoms[i].bonds[j] = atoms[j].bonds[i] = order


def _dense(k: list) -> list[int]:
    place = {x: r for r, x in enumerate(sorted(set(k)))}
    return [place[x] for x in k]


def _invariants(mol: Mol) -> list[int]:
    ring = {i for b in mol.rings() for i in b}
    return _dense([(a.symbol, a.aromatic, a.charge, len(a.bonds), mol.hydrogens(i), i in ring, a.isotope or 0) for i, a in enumerate(mol.atoms)])


def _refined(mol: Mol, rank: list[int]) -> list[int]:
    """Ranks told apart by the neighbours' ranks until that changes nothing."""
    while True:
        new = _dense([(rank[i], tuple(sorted((rank[j], o) for j, o in a.bonds.items()))) for i, a in enumerate(mol.atoms)])
        if len(set(new)) == len(set(rank)):
            return rank
        rank = new


def ranks(mol: Mol) -> list[int]:
    """Canonical ranks: invariants are refined by neighbours until stable; ties are broken one at a time."""
    rank = _refined(mol, _invariants(mol))
    while len(set(rank)) < len(mol.atoms):
        tied = min(r for r in rank if rank.count(r) > 1)
        first = rank.index(tied)
        rank = _refined(mol, _dense([(r, i != first) if r == tied else (r, False) for i, r in enumerate(rank)]))
    return rank


def atom_text(mol: Mol, i: int, hand: str = "") -> str:
    a = mol.atoms[i]
    symbol = a.symbol.lower() if a.aromatic else a.symbol
    if a.symbol == "*" and not (a.charge or a.isotope or a.number):
        return "*"
    h = mol.hydrogens(i)
    if a.symbol in VALENCES and not hand and not a.charge and a.isotope is None and a.number is None:
        bare = Atom(a.symbol, a.aromatic, bonds=a.bonds)
        try:
            if Mol([*mol.atoms[:i], bare, *mol.atoms[i + 1 :]]).hydrogens(i) == h:
                return symbol
        except SmilesError:
            pass
    charge = "" if not a.charge else ("+" if a.charge > 0 else "-") + (str(abs(a.charge)) if abs(a.charge) > 1 else "")
    return f"[{a.isotope or ''}{symbol}{hand}{'H' + (str(h) if h > 1 else '') if h else ''}{charge}{':' + str(a.number) if a.number else ''}]"


def bond_text(mol: Mol, i: int, j: int) -> str:
    o, both = mol.atoms[i].bonds[j], mol.atoms[i].aromatic and mol.atoms[j].aromatic
    return {1: "-" if both else "", 1.5: "" if both else ":", 2: "=", 3: "#", 4: "$"}[o]


def label(n: int) -> str:
    return str(n) if n < 10 else f"%{n:02d}"


def write(mol: Mol, rank: list[int] | None = None, extra: dict[int, list[str]] | None = None, texts: dict[int, str] | None = None) -> str:
    """Text of the graph, longer components first; ``extra`` labels follow their atom, and ``texts`` stand for atoms, without their hands. Deep graphs need no recursion."""
    rank = rank or ranks(mol)
    seen: set[int] = set()
    parts = [_component(mol, rank, start, seen, extra or {}, texts) for start in sorted(range(len(mol.atoms)), key=rank.__getitem__) if start not in seen]
    return ".".join(sorted(parts, key=lambda p: (-len(p), p)))


def _component(mol: Mol, rank: list[int], start: int, seen: set[int], extra: dict[int, list[str]], texts: dict[int, str] | None) -> str:
    children: dict[int, list[int]] = {}
    back: dict[int, list[int]] = {}
    parent = {start: -1}
    stack, visit = [start], []
    while stack:
        v = stack.pop()
        if v in seen:
            continue
        seen.add(v)
        visit.append(v)
        if parent[v] >= 0:
            children.setdefault(parent[v], []).append(v)
        for w in sorted(mol.atoms[v].bonds, key=rank.__getitem__, reverse=True):
            if w not in seen:
                parent[w] = v
                stack.append(w)
    tree = {(min(v, p), max(v, p)) for v, p in parent.items() if p >= 0}
    place = {v: k for k, v in enumerate(visit)}
    rings = sorted(((min(i, j), max(i, j)) for i in visit for j in mol.atoms[i].bonds if i < j and (min(i, j), max(i, j)) not in tree), key=lambda b: sorted((place[b[0]], place[b[1]])))
    free, names = list(range(1, 100)), {}
    for v in visit:  # numbers are free again once a ring is closed
        for b in [b for b in rings if v in b]:
            other = b[0] if b[1] == v else b[1]
            if b in names:
                free.append(names[b])
                free.sort()
            elif place[other] > place[v]:
                names[b] = free.pop(0)
            back.setdefault(v, []).append(b)
    out: list[str] = []
    todo: list = [start]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        p = parent[x]
        if texts is None:
            a = mol.atoms[x]
            written = [*([p] if p >= 0 else []), *([-1] if -1 in a.around else []), *(b[0] if b[1] == x else b[1] for b in back.get(x, [])), *children.get(x, [])]
            hand = "" if not a.hand else a.hand if not _odd(a.around, written) else {"@": "@@", "@@": "@"}[a.hand]
        out.append((bond_text(mol, p, x) if p >= 0 else "") + (atom_text(mol, x, hand) if texts is None else texts[x]))
        for b in back.get(x, []):
            other = b[0] if b[1] == x else b[1]
            out.append((bond_text(mol, x, other) if place[other] > place[x] else "") + label(names[b]))
        out += extra.get(x, [])
        kids = children.get(x, [])
        for k, c in reversed(list(enumerate(kids))):
            if k < len(kids) - 1:
                todo += [")", c, "("]
            else:
                todo.append(c)
    return "".join(out)


def canonical(text: str) -> str:
    return write(parse(text))


def components(mol: Mol, cut: set[tuple[int, int]] = frozenset()) -> list[list[int]]:
    """Atoms of each part once the bonds in ``cut`` are gone."""
    seen, out = set(), []
    for s in range(len(mol.atoms)):
        if s in seen:
            continue
        part, stack = [], [s]
        seen.add(s)
        while stack:
            v = stack.pop()
            part.append(v)
            for w in mol.atoms[v].bonds:
                if w not in seen and (min(v, w), max(v, w)) not in cut:
                    seen.add(w)
                    stack.append(w)
        out.append(sorted(part))
    return out
