"""The plain backend on textbook molecules, and round trips."""

import itertools
import random

import pytest

from pairwright.chem import properties, safe
from pairwright.chem.base import PureBackend, describe
from pairwright.chem.smiles import Mol, SmilesError, canonical, parse, ranks, write

MOLECULES = {
    # name: SMILES, exact mass, donors, acceptors, rotatable bonds, polar surface
    "aspirin": ("CC(=O)Oc1ccccc1C(=O)O", 180.0423, 1, 4, 3, 63.60),
    "caffeine": ("Cn1cnc2c1c(=O)n(C)c(=O)n2C", 194.0804, 0, None, 0, 61.82),
    "paracetamol": ("CC(=O)Nc1ccc(O)cc1", 151.0633, 2, None, None, 49.33),
    "ethanol": ("CCO", 46.0419, 1, 1, 0, 20.23),
    "benzene": ("c1ccccc1", 78.0470, 0, 0, 0, 0.0),
    "pyridine": ("c1ccncc1", 79.0422, 0, 1, 0, 12.89),
    "pyrrole": ("c1cc[nH]c1", 67.0422, 1, 0, 0, 15.79),
    "acetonitrile": ("CC#N", 41.0265, 0, 1, 0, 23.79),
    "glycine ion": ("[NH3+]CC(=O)[O-]", 75.0320, 1, None, 1, None),
    "ibuprofen": ("CC(C)Cc1ccc(cc1)C(C)C(=O)O", 206.1307, 1, 2, 4, 37.30),
}


@pytest.mark.parametrize("name", MOLECULES)
def test_descriptors(name):
    text, mass, hbd, hba, rot, tpsa = MOLECULES[name]
    d = properties.descriptors(parse(text))
    assert d["MW"] == pytest.approx(mass, abs=2e-3)
    for key, want in (("HBD", hbd), ("HBA", hba), ("RotB", rot)):
        assert want is None or d[key] == want, key
    assert tpsa is None or d["TPSA"] == pytest.approx(tpsa, abs=0.01)
    assert 0 < properties.qed6(d) < 1


@pytest.mark.parametrize("bad", ["", "C(", "C)", "c1ccccc", "C1CC", "CC=", "C..", "X", "[C", "cc", "C(C)(C)(C)(C)C", "1CC", "C11", "(C)"])
def test_rejected(bad):
    if bad == "C..":
        assert parse("C.C")
        return
    with pytest.raises(SmilesError):
        parse(bad)


def shuffled(mol, rng):
    order = list(range(len(mol.atoms)))
    rng.shuffle(order)
    return write(mol, order)


def test_canonical_does_not_hang_on_the_writing():
    rng = random.Random(1)
    for text, *_ in MOLECULES.values():
        want = canonical(text)
        assert canonical(want) == want
        for _ in range(10):
            assert canonical(shuffled(parse(text), rng)) == want
    assert canonical("C1CC1.CCO") == canonical("OCC.C1CC1")
    assert len({canonical(t) for t, *_ in MOLECULES.values()}) == len(MOLECULES)


def test_scaffold():
    assert properties.scaffold_text("CCc1ccccc1") == canonical("c1ccccc1")
    assert properties.scaffold_text("c1ccccc1CCC2CCCCC2C") == canonical("c1ccccc1CCC2CCCCC2")
    assert properties.scaffold_text("O=C1CCCCC1C") == canonical("O=C1CCCCC1")
    assert properties.scaffold_text("CCO") == "" and properties.scaffold_text("") is None and properties.scaffold_text("C(") is None


def test_fingerprints():
    a, b, c = (parse(x) for x in ("CCOc1ccccc1", "c1ccccc1OCC", "CCCCCCCC"))
    for fp in (properties.circular, properties.paths, properties.keys):
        assert fp(a) == fp(b) != fp(c) and len(fp(a)) == 16


def test_safe_round_trip():
    for (text, *_), slicer in itertools.product(MOLECULES.values(), safe.SLICERS):
        try:
            told = safe.encode(text, slicer)
        except safe.SAFEFragmentationError:
            continue
        assert "." in told
        assert safe.decode(told, canonical=True) == canonical(text)
        mixed = safe.encode(text, slicer, canonical=False, seed=3)
        assert sorted(mixed.split(".")) == sorted(told.split(".")) and safe.decode(mixed, canonical=True) == canonical(text)
    assert safe.smiles_to_safe("C") == "" and safe.smiles_to_safe("C(") == ""
    with pytest.raises(safe.SAFEFragmentationError):
        safe.encode("CCO", None)
    assert safe.encode("CCO", "brics", allow_empty=True) == canonical("CCO")
    with pytest.raises(safe.SAFEDecodeError):
        safe.decode("C(")
    assert safe.decode("C(", ignore_errors=True) is None
    kept = safe.encode("CC(=O)Oc1ccccc1C(=O)O", "rotatable", keep=[set(range(13))], allow_empty=True)
    assert kept == canonical("CC(=O)Oc1ccccc1C(=O)O")


def test_repair():
    assert safe.repair("c14ccccc1.C4") == "c14ccccc1.C4"
    assert safe.repair("CC5.O%12") == "CC5.O%12.*5.*%12"
    assert safe.decode("CC5", canonical=True) == canonical("CC")


def test_ranks_are_a_permutation():
    mol = parse("C1CCC1")
    assert sorted(ranks(mol)) == [0, 1, 2, 3] and isinstance(mol, Mol)


def test_describe(spark):
    df = spark.createDataFrame([("CCO",), ("OCC",), ("C(",), ("",), (None,)], "x string")
    got = {r["x"]: r for r in describe(df, "x", PureBackend()).collect()}
    assert got["CCO"]["canonical"] == got["OCC"]["canonical"] and got["CCO"]["valid"]
    assert not got["C("]["valid"] and not got[""]["valid"] and got[None]["MW"] is None
    decoded = describe(spark.createDataFrame([("CC5.O5",)], "x string"), "x", PureBackend(), decode=True).collect()[0]
    assert decoded["decoded"] == canonical("CCO")


def test_hands_of_centres():
    """One text for each mirror image, however it is written; hands that say nothing are dropped."""
    left = ["C[C@H](N)C(=O)O", "N[C@@H](C)C(=O)O", "OC(=O)[C@@H](N)C", "[C@H](C)(C(=O)O)N"]
    texts = {canonical(x) for x in left}
    assert len(texts) == 1 and canonical("C[C@@H](N)C(=O)O") not in texts and canonical("CC(N)C(=O)O") not in texts
    assert canonical("C[C@H]1CCCO1") == canonical("O1CCC[C@@H]1C") != canonical("C[C@@H]1CCCO1")
    assert canonical("C[C@H](C)O") == canonical("CC(C)O")
    for x in [*left, "F[C@@](Cl)(Br)I", "C[C@H]1CCCO1"]:
        assert canonical(canonical(x)) == canonical(x)
    assert "@" not in properties.scaffold_text("C[C@H]1CCCO1")


def test_pattern_slicers():
    """Bonds by pattern, several patterns or a function; round trips as with named slicers, and an error for what is no pattern."""
    mol = parse("CC(=O)NCc1ccccc1")
    assert safe.find_cuts(mol, "[#6]-!@[N;H1]") == [(1, 3), (3, 4)] and safe.find_cuts(mol, "C-!@c") == [(4, 5)]
    assert safe.find_cuts(mol, ["C-!@c", "C=O"]) == [(1, 2), (4, 5)] and safe.find_cuts(mol, "[!R]-[R]") == [(4, 5)]
    assert safe.find_cuts(mol, lambda m: [(5, 4)]) == [(4, 5)] and len(safe.find_cuts(mol, "c:@c")) == 6
    for s in ("[#6]-!@[N;H1]", ["C-!@c", "C-N"]):
        assert canonical(safe.decode(safe.encode("CC(=O)NCc1ccccc1", s))) == canonical("CC(=O)NCc1ccccc1")
    for bad in ("no-slicer", "[Q]-C", ""):
        with pytest.raises(safe.SAFEEncodeError):
            safe.find_cuts(mol, bad)
    with pytest.raises(safe.SAFEFragmentationError):
        safe.find_cuts(mol, "Br-C")
