"""Probabilities, isoelectric points, fits and gates against plain versions."""

import math

import numpy as np
from pyspark.sql import functions as F

from residua.functions import residues as R
from residua.operators import comparison as M
from residua.operators import gates as G
from residua.operators import learning as L
from residua.operators import trees as B


def test_probabilities(spark):
    rows = [(x, k) for x in (0.0, 0.3, 3.84, 20.0, 300.0) for k in (1, 2, 4)]
    got = spark.createDataFrame(rows, "x double, k int").withColumn("p", M.chi2_upper(F.col("x"), F.col("k"))).collect()
    for r in got:
        want = {1: math.erfc(math.sqrt(r.x / 2)), 2: math.exp(-r.x / 2), 4: math.exp(-r.x / 2) * (1 + r.x / 2)}[r.k]
        assert abs(r.p - want) < 1e-9


def test_isoelectric_point(spark):
    ubiquitin = "MQIFVKTLTGKTITLEVEPSDTIENVKAKIQDKEGIPPDQQRLIFAGKQLEDGRTLSDYNIQKESTLHLVLRLRGG"
    rows = spark.createDataFrame([(ubiquitin,), ("",), ("AXA",), (None,)], "s string")
    assert [r.p for r in rows.select(R.isoelectric_point(F.col("s")).alias("p")).collect()] == [6.56, None, None, None]


def test_out_of_group(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] + 0.2 * rng.normal(size=200) > 0).astype(int)
    df = spark.createDataFrame([(i % 4, i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "g int, i int, a double, b double, y int")
    got = {r.i: r.score for r in L.out_of_group_linear(df, "g", ["a", "b"], "y").collect()}
    for g in range(4):
        own = np.arange(200) % 4 == g
        full = np.column_stack([np.ones(200), x])
        w = np.linalg.lstsq(full[~own], y[~own], rcond=None)[0]
        assert np.allclose([got[i] for i in np.flatnonzero(own)], full[own] @ w)
    trees = L.out_of_group(df.where("g < 2"), "g", ["a", "b"], "y", B.Boosting("", trees=3, depth=4, rate=0.3, least_child=5), bins=32).collect()
    # positives weigh 20, so scores are held against each other, not against a half
    pairs = [(r.score > q.score) + (r.score == q.score) / 2 for r in trees for q in trees if r.g == q.g and r.y > q.y]
    assert len(trees) == 100 and np.mean(pairs) > 0.8
    one = L.out_of_group_linear(df.where("g = 0"), "g", ["a", "b"], "y").collect()
    assert all(r.score is None for r in one) and len(one) == 50


def test_gates(spark):
    df = spark.createDataFrame([("p", 1, 0.5), ("p", 2, None), ("q", 2, 3.0), ("r", 1, 1.0), ("r", 1, 1.0)], "g string, i int, v double")
    assert {(r.g, r.rule) for r in G.numbering(df, "g", "i").collect()} == {("q", "gap"), ("r", "repeated")}
    assert [r.rule for r in G.broken_rules(df.where("g <> 'r'"), ["g", "i"], {"range": ~F.col("v").between(0, 1)}).collect()] == ["range", "range"]
    a, b = spark.createDataFrame([(1, 2, 0.5)], "k int, n int, m double"), spark.createDataFrame([(1, 2, 0.5 + 1e-10), (2, 1, 1.0)], "k int, n int, m double")
    assert {(r.k, r.metric) for r in G.metric_gate(a, b, "k").collect()} == {(2, "n"), (2, "m")}
    cells = spark.createDataFrame([("a", i, j, 1.0) for i in (1, 2) for j in (1, 2)] + [("b", 1, 1, -1.0), ("c", 1, 2, 0.0)], "g string, i int, j int, value double")
    sizes = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1), ("d", 4)], "g string, n int")
    assert {(r.g, r.rule) for r in G.square(cells, "g", sizes, "n").collect()} == {("b", "value"), ("c", "shape"), ("d", "missing")}
    assert L.boosted_trees().getMaxIter() == 100 and G.leaks(["a", "oof_x"], ["a", "b", "oof_x"]) == ["b", "oof_x"]


def test_importances(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 3, float(a), float(b), int(a > 0)) for i, (a, b) in enumerate(rng.normal(size=(150, 2)))]
    df = spark.createDataFrame(rows, "g int, a double, b double, y int")
    got = {r.feature: r for r in L.out_of_group_importances(df, "g", ["a", "b"], "y", B.Boosting("", trees=2, depth=3), bins=32).collect()}
    assert {r.models for r in got.values()} == {3} and abs(sum(r["mean"] for r in got.values()) - 1) < 1e-9 and got["a"]["mean"] > 0.7


def test_nested_choice(spark):
    rows = [("f1", "x", 1.0), ("f2", "x", 0.0), ("f3", "x", 0.25), ("f1", "y", 0.5), ("f2", "y", 0.5), ("f3", "y", 0.5), ("f1", "z", 0.5), ("f2", "z", 0.5), ("f3", "z", 0.5), ("f1", "once", 9.0), ("f2", "once", None)]
    got = {r.fold: (r.config, round(r.inner, 6), r.value) for r in M.nested_choice(spark.createDataFrame(rows, "fold string, c string, v double"), "fold", "c", "v").collect()}
    assert got == {"f1": ("y", 0.5, 0.5), "f2": ("x", 0.625, 0.0), "f3": ("x", 0.5, 0.25)}
    assert M.nested_choice(spark.createDataFrame(rows[:1], "fold string, c string, v double"), "fold", "c", "v").count() == 0


def test_crc64(spark):
    from residua.functions.checksums import crc64

    def plain(b):
        c = 0
        for x in b:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (0xD800000000000000 if c & 1 else 0)
        return f"{c:016X}"

    texts = ["ACGTACGTACGT", "IHATEMATH", "", None, "É" * 70, "M"]
    got = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", crc64("s").alias("c")).orderBy("i").collect()]
    assert got == [None if t is None else plain(t.encode()) for t in texts]
    assert got[:2] == ["C4FBB762C4A87EBD", "E3DCADD69B01ADD1"]
