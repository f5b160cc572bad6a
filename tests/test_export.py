"""Training, evaluation and export in one run, and the commands around it."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.__main__ import main
from residua.operators import description as D
from residua.operators import export as X
from residua.operators import trees as B
from tests.test_extraction import cif, square

KIND = "grp string, pos int, letter string, class string, a double, b double, y int"
def RULES():
    return X.residue_rules("grp", "pos", ["a", "b"], "y")


P = B.Boosting("", trees=3, depth=3, leaves=6, rate=0.3, positive=2.0, least_child=5)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    rows = [(f"p{i % 4}", i, "A", "nonpolar", float(rng.integers(0, 9)), float(rng.integers(0, 5)), 0) for i in range(240)]
    rows = [(*r[:6], int(rng.random() < r[4] / 9)) for r in rows]
    path = str(tmp_path_factory.mktemp("t") / "table")
    spark.createDataFrame(rows, KIND).write.parquet(path)
    return path


def test_train(spark, table, tmp_path):
    df = spark.read.parquet(table)
    about = X.train(df, "grp", "pos", ["a", "b"], "y", P, RULES(), path=str(tmp_path / "m"), bins=16)
    m = about["metrics"]
    assert (about["rows"], m["groups"], m["evaluable"], m["folds"]) == (240, 4, 4, 4) and m["pooled_roc"] > 0.7 and 0 < m["brier"] < 0.3
    again = X.train(df.repartition(7), "grp", "pos", ["a", "b"], "y", P, RULES(), {"folds": 4, "pooled_roc": m["pooled_roc"]}, "isotonic", None, 16)
    assert again["scores_sha256"] == about["scores_sha256"] and again["calibrator"]["method"] == "isotonic"
    models, told = B.load(spark, str(tmp_path / "m"))
    assert told == json.loads(json.dumps(about)) and len(models) == 1 and len(models[0].trees) == 3
    bad = lambda d, *more, **kw: pytest.raises(X.Rejected, match=kw.pop("match"))
    for change, match in ((df.withColumn("letter", F.lit("D")), "240 rows: class 240"), (df.union(df.limit(1)), "more than once"), (df.withColumn("y", F.lit(0)), "labels are"), (df.withColumn("a", F.when(F.col("pos") > 3, F.col("a"))), "finite_a")):
        with bad(change, match=match):
            X.train(change, "grp", "pos", ["a", "b"], "y", P, RULES(), bins=16)
    with pytest.raises(X.Rejected, match="recorded 5"):
        X.train(df, "grp", "pos", ["a", "b"], "y", P, RULES(), {"folds": 5}, bins=16)
    with pytest.raises(X.Rejected, match="oof_x"):
        X.train(df, "grp", "pos", ["a", "oof_x"], "y", P, RULES())


def test_commands(spark, table, tmp_path, capsys):
    m = str(tmp_path / "m")
    assert main(["export", "--table", table, "--features", "a,b", "--model", m, "--trees", "2"]) == 0
    assert json.loads(capsys.readouterr().out)["features"] == ["a", "b"]
    assert main(["score", "--features", table, "--model", m, "--top", "3"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 4
    (tmp_path / "r.json").write_text(json.dumps({"folds": 9}))
    assert main(["export", "--table", table, "--features", "a,b", "--model", m, "--trees", "1", "--recorded", str(tmp_path / "r.json")]) == 1 and "recorded 9" in capsys.readouterr().err
    for d in ("s", "x"):
        (tmp_path / d).mkdir()
    (tmp_path / "s" / "one.cif").write_text(cif())
    (tmp_path / "x" / "one.json").write_text(square(2))
    (tmp_path / "man.csv").write_text("protein,structure,matrix,structure_sha256,matrix_sha256,accession,entry,version,length\nP1,one.cif,one.json,,,P1,,4,3\n")
    assert main(["validate", "--manifest", str(tmp_path / "man.csv"), "--structures", str(tmp_path / "s"), "--matrices", str(tmp_path / "x"), "--out", str(tmp_path / "v")]) == 1
    assert "P1: structure checksum; matrix checksum; matrix shape" in capsys.readouterr().err
    assert main(["describe", "--sequence", "mk gx"]) == 0
    out = capsys.readouterr().out
    assert '"length": 4' in out and '"note": "other letters"' in out and '"letter": "G"' in out
    assert main(["describe", "--structures", str(tmp_path / "s")]) == 0 and '"confident": 1.0' in capsys.readouterr().out


def test_description(spark):
    df = spark.createDataFrame([(1, "MKTAYIAK"), (2, ""), (3, None), (4, "AAXX")], "k int, s string")
    got = {r.k: r for r in D.sequences(df, "k", "s").collect()}
    assert (got[1].length, got[1].note, got[2].length, got[3].note) == (8, None, 0, "other letters") and got[1].weight > 900 and got[4].gravy is None
    assert [(r.letter, r.n) for r in D.composition(df.where("k = 4"), "s").collect()] == [("A", 2), ("X", 2)]
    each = {(r.k, r.letter): r.share for r in D.composition(df, "s", ["k"]).collect()}
    assert each[4, "A"] == 0.5 and each[1, "K"] == 0.25 and not [k for k, _ in each if k in (2, 3)]
