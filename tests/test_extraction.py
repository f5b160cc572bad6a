"""Features from structure and matrix files by a manifest: every rule broken once, alone, and a whole run from files to scores."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from residua.operators import extraction as X
from residua.operators import structures as T
from residua.sources import structures as S

LETTERS = "MGA"
NAMES = {"M": "MET", "G": "GLY", "A": "ALA"}
TAGS = ["group_PDB", "label_atom_id", "label_comp_id", "label_asym_id", "label_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "B_iso_or_equiv", "pdbx_PDB_model_num"]


def cif(letters=LETTERS, more=(), change=None, ca="CA"):
    rows = [f"ATOM {a} {NAMES.get(c, c)} A {i} ? {i}.0 {k}.0 0.0 {70 + i}.0 1" for i, c in enumerate(letters, 1) for k, a in enumerate(("N", ca))]
    rows = change(rows) if change else rows
    return "\n".join(["loop_", *["_atom_site." + t for t in TAGS], *rows, *more, "#"]) + "\n"


def square(n=3, bad=None):
    return json.dumps([{"predicted_aligned_error": [[abs(i - j) if bad is None else bad for j in range(n)] for i in range(n)]}])


CASES = {
    "good": {}, "other": {"letters": "GGA"},
    "structure missing": {"structure": None}, "matrix missing": {"matrix": None}, "record missing": {"record": None}, "structure checksum": {"structure_sha256": "0"}, "matrix checksum": {"matrix_sha256": "0"},
    "entry": {"record": {"entryId": "x"}}, "version": {"record": {"latestVersion": 9}}, "chain": {"record": {"chainId": "B"}},
    "unreadable rows": {"structure": cif(change=lambda r: [x.replace(" 1.0 0.0 0.0", " 1.x 0.0 0.0") for x in r])}, "models": {"structure": cif(more=["ATOM CA MET A 1 ? 1.0 1.0 0.0 70.0 2"])}, "chains": {"structure": cif(more=["ATOM CA MET B 1 ? 1.0 1.0 0.0 70.0 1"])},
    "hetero atoms": {"structure": cif(more=["HETATM O HOH A . ? 1.0 1.0 0.0 70.0 1"])}, "inserted residues": {"structure": cif(change=lambda r: [x.replace("A 2 ?", "A 2 C") for x in r])},
    "no CA": {"structure": cif(ca="C")}, "unknown residues": {"structure": cif("MXA")}, "sequence": {"record": {"uniprotSequence": "MGG"}}, "length": {"length": 4}, "numbering": {"structure": cif(change=lambda r: [x.replace("A 3 ?", "A 4 ?") for x in r])},
    "sequence checksum": {"record": {"sequenceChecksum": "0"}}, "confidence": {"structure": cif(change=lambda r: [x.replace("71.0", "101.0") for x in r])}, "matrix shape": {"matrix": square(2)}, "matrix values": {"matrix": square(3, -1)},
}


@pytest.fixture
def folders(spark, tmp_path):
    rows = []
    for d in ("s", "m", "r"):
        (tmp_path / d).mkdir()
    for k, (name, c) in enumerate(CASES.items()):
        letters = c.get("letters", LETTERS)
        a, b = c.get("structure", cif(letters)), c.get("matrix", square())
        acc = f"P{k}"
        if a:
            (tmp_path / "s" / f"{acc}.cif").write_text(a)
        if b:
            (tmp_path / "m" / f"{acc}.json").write_text(b)
        if c.get("record", {}) is not None:
            own = {"entryId": f"AF-{acc}-F1", "uniprotAccession": acc, "latestVersion": 4, "chainId": "A", "uniprotSequence": letters.lower(), "sequenceChecksum": hashlib.md5(letters.encode()).hexdigest()}
            (tmp_path / "r" / f"{acc}.json").write_text(json.dumps([own | c.get("record", {})]))
        sha = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
        rows.append((name, f"{acc}.cif", f"{acc}.json", c.get("structure_sha256", sha(a)), c.get("matrix_sha256", sha(b)), acc, f"AF-{acc}-F1", 4, c.get("length", 3)))
    m = spark.createDataFrame(rows, "protein string, structure string, matrix string, structure_sha256 string, matrix_sha256 string, accession string, entry string, version int, length int")
    return tmp_path, m


def test_each_rule_fails_alone(spark, folders):
    d, manifest = folders
    features, verdicts = X.extract(spark, manifest, str(d / "s"), str(d / "m"), str(d / "r"))
    got = {r.protein: r.notes.split("; ") for r in verdicts.collect()}
    assert {k for k, v in got.items() if v == [""]} == {"good", "other"}
    assert all(name in got[name] for name in CASES if name not in ("good", "other"))
    alone = {k for k, v in got.items() if v == [k]}
    # what changes the residues breaks what follows from them too
    assert set(CASES) - alone - {"good", "other"} <= {"unreadable rows", "unknown residues", "length", "numbering", "sequence", "no CA", "chains", "matrix missing", "structure missing"}
    f = {(r.grp, r.pos): r for r in features.collect()}
    assert set(f) == {(g, i) for g in ("good", "other") for i in (1, 2, 3)}
    r = f["good", 1]
    assert (r.letter, r.plddt_ca, r.n_atoms, r.row_mean, r.density, r.neighbour_value) == ("M", 71.0, 2, 1.0, 2, 72.5)


def test_files_without_records(spark, folders):
    d, manifest = folders
    features, verdicts = X.extract(spark, manifest, str(d / "s"), str(d / "m"))
    good = {r.protein for r in verdicts.where("status = 'PASS'").collect()}
    assert {"good", "record missing", "entry", "version", "chain", "sequence", "sequence checksum"} <= good and "models" not in good
    assert features.select("grp").distinct().count() == len(good)


def test_scores_from_files(spark, tmp_path, capsys):
    from residua.__main__ import main
    from residua.operators import learning as L
    from residua.sinks import tables as K

    for n, (a, b) in {"one": (cif(), square()), "two": (cif("GGAGA"), square(5)), "odd": (cif(), square(2)), "lone": (cif(), None)}.items():
        (tmp_path / f"{n}.cif").write_text(a)
        if b:
            (tmp_path / f"{n}.pae.json").write_text(b)
    cells = S.matrix(spark, str(tmp_path / "two.pae.json")).withColumn("grp", F.lit("two"))
    r = X.residues_of(S.atoms(spark, str(tmp_path / "two.cif"))).withColumn("grp", F.lit("two"))
    table = T.features(r, cells, "grp")
    assert table.count() == 5
    train = table.withColumn("y", (F.col("pos") > 2).cast("int")).crossJoin(spark.range(20))
    K.model(L.fit(train, ["n_atoms", "row_mean", "density"], "y", L.boosted_trees(3)), str(tmp_path / "model"), {"features": ["n_atoms", "row_mean", "density"], "calibrator": {"method": "sigmoid", "slope": 1.0, "intercept": 0.0}})
    assert main(["score", "--structures", str(tmp_path), "--model", str(tmp_path / "model"), "--top", "20"]) == 0
    out, err = capsys.readouterr()
    assert sorted(x.split(",")[0] for x in out.splitlines()[1:]) == ["one"] * 3 + ["two"] * 5
    assert "odd: length; matrix shape" in err or "odd: length" in err and "lone: matrix missing" in err
