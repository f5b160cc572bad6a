"""Readers, residue tables, sinks and scoring against small files and plain figures."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from residua.operators import scoring as P
from residua.operators import structures as T
from residua.sinks import tables as K
from residua.sources import documents as D
from residua.sources import structures as S


def line(record, n, atom, alt, residue, chain, pos, icode, x, b):
    return f"{record:<6}{n:>5} {atom:<4}{alt:1}{residue:>3} {chain}{pos:>4}{icode:1}   {x:8.3f}{1.0:8.3f}{2.0:8.3f}{1.0:6.2f}{b:6.2f}"


PDB = "\n".join(
    [
        "MODEL        1", line("ATOM", 1, "N", " ", "MET", "A", 1, " ", 1, 80), line("ATOM", 2, "CA", " ", "MET", "A", 1, " ", 3, 90), line("ATOM", 3, "CA", "B", "MET", "A", 1, " ", 9, 10),
        line("ATOM", 4, "CA", " ", "GLY", "A", 2, "C", 5, 70), line("HETATM", 5, "O", " ", "HOH", "A", 3, " ", 5, 70), "ENDMDL", "MODEL        2", line("ATOM", 6, "CA", " ", "GLY", "A", 9, " ", 5, 70), "ENDMDL", "ATOM  short",
    ]
)
TAGS = ["group_PDB", "id", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "label_seq_id", "auth_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "B_iso_or_equiv", "pdbx_PDB_model_num"]
CIF = "\n".join(["loop_", *["_atom_site." + t for t in TAGS], "ATOM 1 N . MET A 1 11 0.0 0.0 0.0 50.0 1", "ATOM 2 CA . MET A 1 11 2.0 0.0 0.0 60.0 1", "ATOM 3 CA . MET A 1 11 8.0 0.0 0.0 99.0 1", "ATOM 4 C . GLY A . 12 4.0 0.0 0.0 70.0 1", "ATOM 5 CA . GLY A 9 19 4.0 0.0 0.0 70.0 2"])


@pytest.fixture
def files(tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "one.PDB").write_text(PDB)
    (tmp_path / "s" / "AF-P1-F1-model_v4.cif").write_text(CIF)
    (tmp_path / "s" / "note.txt").write_text("x")
    return tmp_path


def test_atoms(spark, files):
    d = str(files / "s")
    assert [r.name for r in D.listing(spark, d).collect()] == ["AF-P1-F1-model_v4.cif", "one.PDB"]
    a = S.atoms(spark, d)
    pdb = a.where(F.lower("file").endswith(".pdb"))
    c = T.record_counts(pdb, ["file"], icode="icode").first()
    assert (c.atoms, c.hetero, c.other_places, c.inserted) == (4, 1, 1, 1)
    r = {(x.file[-3:].lower(), x.pos): x for x in S.residues(a).collect()}
    assert set(r) == {("pdb", 1), ("pdb", 2), ("cif", 1), ("cif", 12)}
    m = r["pdb", 1]
    assert (m.residue, m.n_atoms, m.n_backbone_atoms, m.ca_x, m.plddt_ca, m.centroid_x) == ("MET", 2, 2, 3.0, 90.0, 2.0)
    m = r["cif", 1]  # the first CA counts
    assert (m.n_atoms, m.ca_x, m.plddt_ca, m.plddt_atom_max) == (2, 2.0, 60.0, 60.0)
    assert (r["cif", 12].ca_x, r["cif", 12].plddt_ca) == (None, 70.0)
    assert [x.rule for x in S.short_lines(spark, d + "/one.PDB").collect()] == ["short"]
    with pytest.raises(ValueError):
        S.atoms(spark, d + "/note.txt")


def test_matrix_shapes_and_siblings(spark, tmp_path):
    rows = [[0, 1.5], [2, 0]]
    for n, doc in enumerate([rows, {"predicted_aligned_error": rows}, [{"predicted_aligned_error": rows}]]):
        (tmp_path / f"m{n}.json").write_text(json.dumps(doc))
        assert {(r.i, r.j, r.value) for r in S.matrix(spark, str(tmp_path / f"m{n}.json")).collect()} == {(1, 1, 0.0), (1, 2, 1.5), (2, 1, 2.0), (2, 2, 0.0)}
    names = spark.createDataFrame([("AF-P1-F1-model_v4.cif",), ("own.pdb",), ("lone.cif",)], "name string")
    there = spark.createDataFrame([("AF-P1-F1-predicted_aligned_error_v4.json",), ("own_pae.json",), ("own.pae.json",)], "name string")
    assert dict(map(tuple, D.siblings(names, there).collect())) == {"AF-P1-F1-model_v4.cif": "AF-P1-F1-predicted_aligned_error_v4.json", "own.pdb": "own.pae.json", "lone.cif": None}


def test_documents(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"atom_plddts": [1.0], "pae": [[0.0]], "contact_probs": [[1.0]], "token_res_ids": [1]}))
    assert D.full_data(spark, str(tmp_path / "f.json")).first().missing == ["atom_chain_ids"]
    (tmp_path / "r.json").write_text(json.dumps([{"entryId": "AF-P1-2-F1", "uniprotAccession": "P1"}, {"entryId": "AF-P1-F1", "uniprotAccession": "P1", "latestVersion": 4}]))
    assert D.records(spark, str(tmp_path / "r.json")).first().entryId == "AF-P1-2-F1"
    assert D.records(spark, str(tmp_path / "r.json"), canonical=True).first().latestVersion == 4
    (tmp_path / "c.json").write_text(json.dumps({"candidates": [{"protein_id": "P1", "sequence_length": 5}, {"protein_id": "P2", "sequence_length": True}]}))
    assert [tuple(r)[1:] for r in D.candidates(spark, str(tmp_path / "c.json"), {"protein_id": "string", "sequence_length": "int"}).collect()] == [("P1", 5), ("P2", None)]
    (tmp_path / "x.fasta").write_text(">sp|P1 name\nmkt\nAY\n>two\nGG\n")
    assert tuple(S.fasta(spark, str(tmp_path / "x.fasta")).select("id", "sequence").first()) == ("sp|P1", "MKTAY")
    assert D.sequence(spark, "a", "mk-1 t").first().sequence == "MKT"
    assert len(D.checksums(spark, str(tmp_path / "x.fasta")).first().sha256) == 64


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.5, None), (1, 1 / 3, "x,y")], "k int, p double, note string")
    for n in ("a", "b"):
        K.csv(df.repartition(3), str(tmp_path / n), ["k", "p", "note"], ["k"], {"p": 6})
    one, two = (next((tmp_path / n).glob("*.csv")).read_bytes() for n in ("a", "b"))
    assert one == two == b'k,p,note\n1,0.333333,"x,y"\n2,0.500000,\n'
    assert K.lines(df, ["k", "p"], ["k"])[0] == "k,p"
    back = D.table(spark, str(tmp_path / "a"), "k int, p double, note string")
    assert {r.k: r.note for r in back.collect()} == {1: "x,y", 2: None}
    assert json.loads(K.documents(df, "k", {"score": ["p", "note"]}).where("k = 2").first().document) == {"k": 2, "score": {"p": 0.5, "note": None}}
    assert [r["k"] for r in json.loads(K.summary(df, "k"))] == [1, 2]
    K.key_values(spark.createDataFrame([("b", 1), ("a", 1), ("c", 5)], "letter string, n int"), str(tmp_path / "kv"), "letter", "n")
    assert next((tmp_path / "kv").glob("*.csv")).read_text() == "letter,n\nc,5\na,1\nb,1\n"


def test_scoring(spark, tmp_path):
    from residua.operators import learning as L

    df = spark.range(200).select(F.col("id").alias("pos"), (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 20 >= 15).cast("int").alias("y"))
    model = L.fit(df, ["a"], "y", L.boosted_trees(5))
    K.model(model, str(tmp_path / "m"), {"features": ["a"], "trees": 5})
    again, about = K.read_model(spark, str(tmp_path / "m"), ["a"])
    with pytest.raises(ValueError):
        K.read_model(spark, str(tmp_path / "m"), ["a", "b"])
    out = P.score(again, df, ["a"], {"method": "sigmoid", "slope": 1.0, "intercept": 0.0}, 0.5)
    s = P.summary(out.withColumn("l", F.lit("A")), [], "pos", "l").first()
    assert about["trees"] == 5 and (s.n, s.positives, s.most_pos) == (200, 50, 15)
    assert abs(s.mean_raw - s.mean_calibrated) < 1e-6
    with pytest.raises(ValueError):
        P.calibrated(F.col("a"), {"method": "none"})
    assert P.contract(["b", "a"], ["a", "b"]) == ["order"] and P.contract(["a"], ["a"]) == []
    x, y = P.score_digest(out, ["pos"], "probability_raw").first(), P.score_digest(out.repartition(7), ["pos"], "probability_raw").first()
    assert x == y
    grid = P.one_at_a_time(spark, {"d": 6.0}, {"d": [4, 6]}).collect()
    assert [r.config for r in grid] == ["base", "d=4"]


def test_lonely_residues_stay(spark):
    r = spark.createDataFrame([("p", 1, "A", 0.0, 0.0, 0.0, 80.0, 5), ("p", 2, "G", 1.0, 0.0, 0.0, 60.0, 4), ("p", 3, "B", 99.0, 0.0, 0.0, 101.0, 4)], "grp string, pos int, letter string, x double, y double, z double, plddt double, n_atoms int")
    cells = spark.createDataFrame([("p", i, j, float(10 * i + j)) for i in (1, 2, 3) for j in (1, 2, 3)], "grp string, i int, j int, value double")
    f = {x.pos: x for x in T.features(r, cells, "grp", 2.0).collect()}
    assert (f[1].density, f[1].neighbour_value, f[1].neighbour_cell, f[1].local_mean) == (1, 60.0, 12.0, 12.5)
    assert (f[2].neighbour_cell, f[3].density, f[3].neighbour_cell) == (21.0, 0, None)
    assert (f[1].class_nonpolar, f[2].class_special, f[3]["class"]) == (1.0, 1.0, "unknown")
    from residua.operators import quality as Q

    broken = {(x.id, x.rule) for x in Q.violations(T.features(r, cells, "grp", 2.0), "residue", "pos", T.feature_rules()).collect()}
    assert broken == {("3", "no neighbour"), ("3", "unknown residue"), ("3", "confidence")}


def test_arrays(spark, tmp_path):
    import numpy as np

    from residua.sources.documents import arrays

    np.savez(tmp_path / "a.npz", y=np.array([1, 0]), p=np.array([0.5, 0.25], np.float32))
    np.savez(tmp_path / "b.npz", y=np.array([1, 0]), p=np.array([0.5]))
    np.savez(tmp_path / "c.npz", y=np.array(["x"]), q=np.zeros((2, 2)))
    np.savez(tmp_path / "d.npz", y=np.zeros(0), p=np.zeros(0))
    (tmp_path / "e.txt").write_text("no array")
    got = sorted((r.file[-5:], r.missing, r.at, r.y, r.p) for r in arrays(spark, str(tmp_path), ["y", "p"]).collect())
    assert got == [("a.npz", [], 0, 1.0, 0.5), ("a.npz", [], 1, 0.0, 0.25), ("b.npz", ["p"], None, None, None), ("c.npz", ["y", "p"], None, None, None)]


def test_command(spark, tmp_path, capsys):
    from residua.__main__ import main
    from residua.operators import learning as L

    df = spark.range(200).select(F.lit("p").alias("grp"), F.col("id").alias("pos"), F.lit("A").alias("letter"), (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 20 >= 15).cast("int").alias("y"))
    df.write.parquet(str(tmp_path / "f"))
    K.model(L.fit(df, ["a"], "y", L.boosted_trees(5)), str(tmp_path / "m"), {"features": ["a"], "calibrator": {"method": "sigmoid", "slope": 1.0, "intercept": 0.0}})
    args = ["score", "--features", str(tmp_path / "f"), "--model", str(tmp_path / "m"), "--threshold", "0.5"]
    assert main([*args, "--top", "2"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "grp,pos,letter,probability_raw,probability_calibrated,predicted" and [x.split(",")[1] for x in out[1:]] == ["15", "16"]
    assert main([*args, "--out", str(tmp_path / "o")]) == 0
    assert '"positives": 50' in capsys.readouterr().out and spark.read.csv(str(tmp_path / "o"), header=True).count() == 200
    for bad in (["--threshold", "1.5"], ["--top", "0"]):
        with pytest.raises(SystemExit):
            main([*args, *bad])
    df.drop("a").write.parquet(str(tmp_path / "g"))
    assert main([*args[:2], str(tmp_path / "g"), *args[3:]]) == 1 and "missing" in capsys.readouterr().err


def test_cif_words(spark, tmp_path):
    """Quoted words, a text between semicolons, rows over two lines, lines that look like atoms elsewhere, bad numbers as rows."""
    tags = ["group_PDB", "id", "label_atom_id", "label_comp_id", "label_asym_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "B_iso_or_equiv"]
    doc = ["data_x", "_entry.id x", "_struct.title", ";ATOM 1 in a title", "loop_", ";", "loop_", "_other.kind", "_other.note", "ATOM 'ATOM 9 x'", "#", "loop_", *["_atom_site." + t for t in tags]]
    doc += ["""ATOM 1 "O5'" MET A 1 1.0 2.0 3.0 50.0""", "ATOM\t2 'C A' MET", "A 1 1.5 2.0 3.0 60.0", "HETATM 3 O HOH A . 1.0 2.0 3.0 20.0", "ATOM 4 N GLY A 2 1.x 2.0 3.0 70.0", "ATOM 5 N GLY A ? 1.0 2.0 3.0 70.0", "#", "loop_", "_atom_type.symbol", "ATOM", "_last.one 1"]
    (tmp_path / "a.cif").write_text("\n".join(doc) + "\n")
    got = S.mmcif_atoms(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.record, r.atom, r.residue, r.pos, r.x, r.b) for r in got] == [("ATOM", "O5'", "MET", 1, 1.0, 50.0), ("ATOM", "C A", "MET", 1, 1.5, 60.0), ("HETATM", "O", "HOH", None, 1.0, 20.0), ("ATOM", "N", "GLY", 2, None, 70.0), ("ATOM", "N", "GLY", None, 1.0, 70.0)]
    assert [r.rule for r in S.mmcif_errors(spark, str(tmp_path)).orderBy("ordinal").collect()] == ["number", "number"]


def test_large_files_are_split(spark, tmp_path):
    """Lines and matrix rows keep their numbers over splits of a file; keys around the matrix don't count."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        (tmp_path / "t.txt").write_text("".join(f"line {i}\n" for i in range(3000)))
        x = S.ordered(spark, str(tmp_path), (".TXT",))
        assert x.rdd.getNumPartitions() > 3 and all(r.value == f"line {r.ordinal}" for r in x.collect()) and x.count() == 3000
        n = 80
        rows = [[i * n + j for j in range(n)] for i in range(n)]
        doc = [{"other": [[7, 8]], "predicted_aligned_error": rows, "max_predicted_aligned_error": 31.75, "last": [1, 2]}]
        (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
        m = S.matrix(spark, str(tmp_path / "m.json"))
        got = m.collect()
        assert len(got) == n * n and all(r.value == (r.i - 1) * n + r.j - 1 for r in got)
        (tmp_path / "n.json").write_text(json.dumps({"other": [[7, 8]]}))
        assert S.matrix(spark, str(tmp_path / "n.json")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_residue_numbers_over_9999(spark):
    """Four columns hold 9999 as it is, then hybrid-36; both ways, to the last number."""
    want = {-999: "-999", 1: "   1", 9999: "9999", 10_000: "A000", 10_035: "A00Z", 1_223_055: "ZZZZ", 1_223_056: "a000", 2_436_111: "zzzz"}
    df = spark.createDataFrame([(n,) for n in want], "n int").select("n", S.residue_columns(F.col("n")).alias("t"))
    assert {r.n: (r.t, r.back) for r in df.select("n", "t", S.residue_number(F.trim("t")).alias("back")).collect()} == {n: (t, n) for n, t in want.items()}
    bad = spark.createDataFrame([("12A4",), ("A00",), ("Aa00",), ("",)], "t string").select(S.residue_number(F.col("t")).alias("n"))
    assert [r.n for r in bad.collect()] == [None] * 4
    with pytest.raises(Exception, match="four columns"):
        spark.range(1).select(S.residue_columns(F.lit(2_436_112))).collect()


def test_many_files_are_written_by_several_tasks_and_listed_by_few(spark):
    from urllib.parse import urlparse

    from residua.plans.file_queries import _written

    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    lines = spark.range(40).selectExpr("id AS grp", "0L AS ord", "concat('>g', id, '\nmk') AS value")
    path = _written(lines, "many")
    files = list(Path(urlparse(path).path).glob("grp=*/*.txt"))
    assert len(files) == 40 and len({f.name[:10] for f in files}) > 1
    context = spark.sparkContext
    context.setJobGroup("listing", "listing")
    x = S.fasta(spark, path)
    jobs = context.statusTracker().getJobIdsForGroup("listing")
    stages = [context.statusTracker().getStageInfo(i) for j in jobs for i in context.statusTracker().getJobInfo(j).stageIds]
    with S.listing(spark, 4):
        assert spark.conf.get(key) == "4"
    context.setLocalProperty("spark.jobGroup.id", None)
    assert spark.conf.get(key) == before and all(s.numTasks <= 64 for s in stages)
    assert sorted((r.id, r.sequence) for r in x.collect()) == sorted((f"g{i}", "MK") for i in range(40))
