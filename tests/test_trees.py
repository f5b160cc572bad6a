"""Boosted trees against a plain version that holds all rows, on odd rows, by groups left out and by grids."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.operators import calibration as C
from residua.operators import learning as L
from residua.operators import trees as B
from residua.sinks import tables as K


def plain(bins, y, p, ids, n_f):
    """One model of all rows given: leaf by leaf from the first, with the sums of each leaf made anew."""
    pos, neg = (y == 1).sum() * p.positive, (y == 0).sum()
    margin = np.full(len(y), np.log(pos / neg))
    start, out = margin[0] if len(y) else 0.0, []

    def cut(at, g, h, cols):
        best = None
        for f in np.flatnonzero(cols):
            for b in range(int(bins[:, f].max()) if len(bins) else 0):
                left = at[bins[at, f] <= b]
                right = at[bins[at, f] > b]
                if min(len(left), len(right)) < p.least_child or min(h[left].sum(), h[right].sum()) < B.LEAST_HESSIAN:
                    continue
                gain = round(g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - g[at].sum() ** 2 / h[at].sum(), 9)
                if gain > 1e-9 and (best is None or (gain, -f, -b) > best[0]):
                    best = (gain, -f, -b), f, b, left, right
        return best

    for t in range(p.trees):
        prob = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, p.positive, 1.0)
        g, h = w * (prob - y), w * prob * (1 - prob)
        see, cols = np.flatnonzero(B.sampled(ids, p.seed, t, p.rows)), B.columns_of(n_f, p.seed, t, p.columns)
        leaves, tree, queue = {0: see}, {}, []
        offer = lambda i: (c := cut(leaves[i], g, h, cols) if i < (1 << p.depth) - 1 else None) and heapq.heappush(queue, (-c[0][0], i, c[1], c[2], c[3], c[4]))
        offer(0)
        while queue and len(leaves) < p.leaves:
            _, i, f, b, left, right = heapq.heappop(queue)
            tree[i] = f, b
            del leaves[i]
            leaves[2 * i + 1], leaves[2 * i + 2] = left, right
            offer(2 * i + 1)
            offer(2 * i + 2)
        value = {i: -g[a].sum() / h[a].sum() * p.rate for i, a in leaves.items()}
        out.append((tree, value))
        for r in range(len(y)):
            i = 0
            while i in tree:
                i = 2 * i + 1 + (bins[r, tree[i][0]] > tree[i][1])
            margin[r] += value[i]
    return start, out, margin


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    n = 400
    x = np.column_stack([rng.integers(0, 8, n), rng.integers(0, 5, n), rng.integers(0, 3, n)]).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 5 + 1.5 * (x[:, 1] > 2) * (x[:, 2] > 0))))).astype(int)
    rows = [(i, f"g{i % 4}", *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "i long, g string, a double, b double, c double, y int").repartition(5), x, y


CUTS = [[float(v) for v in range(7)], [0.0, 1.0, 2.0, 3.0], [0.0, 1.0]]


@pytest.mark.parametrize("p", [B.Boosting("m", trees=3, depth=4, leaves=6, rate=0.3, positive=3.0, least_child=8), B.Boosting("m", trees=10, depth=2, leaves=31, rate=0.2, rows=1.0, columns=0.4, positive=1.0)])
def test_against_plain(spark, table, p):
    df, x, y = table
    (m,) = B.fit(df, ["a", "b", "c"], "y", [p], cuts=CUTS, keys=("i",))
    ids = {r.i: r["__id"] for r in B.binned(df, ["a", "b", "c"], CUTS, "y", None, ("i",)).collect()}
    start, trees, margin = plain(x.astype(int), y, p, np.array([ids[i] for i in range(len(y))], np.int64), 3)
    assert abs(m.start - start) < 1e-12 and len(m.trees) == p.trees
    for t, (tree, value) in zip(m.trees, trees):
        assert {i: (int(t.feature[i]), int(t.cut[i])) for i in np.flatnonzero(t.feature >= 0)} == tree
        assert len(value) <= p.leaves and all(abs(t.value[i] - v) < 1e-9 for i, v in value.items())
    got = {r.i: r.score for r in B.predict(df, [m], ("i",)).collect()}
    assert np.allclose([got[i] for i in range(len(y))], 1 / (1 + np.exp(-margin)))


def test_groups_left_out_are_fits_without_them(spark, table):
    """All groups in one plan, in blocks of one model too, against one fit for each group."""
    df, *_ = table
    p = B.Boosting("x", trees=3, depth=3, leaves=4, rate=0.3, positive=2.0, least_child=5)
    each = B.left_out(df, "g", p)
    models = B.fit(df, ["a", "b", "c"], "y", each, "g", cuts=CUTS, keys=("i",))
    got = {r.i: (r.model, r.score) for r in B.out_of_fold(df, models, "g", ("i",)).collect()}
    assert len(got) == 400
    for g in ("g0", "g3"):
        # the same rows have the same hashes, as the fold is part of them in both fits
        (own,) = B.fit(df.where(f"g <> '{g}'"), ["a", "b", "c"], "y", [p], "g", cuts=CUTS, keys=("i",))
        want = {r.i: r.score for r in B.predict(df.where(f"g = '{g}'"), [own], ("i",)).collect()}
        assert all(got[i][0] == g and abs(got[i][1] - s) < 1e-9 for i, s in want.items())
    held, B.HELD = B.HELD, 1
    try:
        again = B.fit(df, ["a", "b", "c"], "y", each, "g", cuts=CUTS, keys=("i",))
    finally:
        B.HELD = held
    assert all((a.value == b.value).all() or np.allclose(a.value, b.value) for m, k in zip(models, again) for a, b in zip(m.trees, k.trees))


def test_grid_and_importances(spark, table):
    df, *_ = table
    configs = B.grid(spark.createDataFrame([("b", 2, 0.1, 1), ("a", 4, None, 2)], "name string, leaves int, rate double, trees int"))
    assert [(c.name, c.leaves, c.rate, c.trees) for c in configs] == [("a", 4, 0.05, 2), ("b", 2, 0.1, 1)]
    models = B.fit(df, ["a", "b", "c"], "y", configs, cuts=CUTS)
    assert [len(m.trees) for m in models] == [2, 1] and (models[1].trees[0].feature >= 0).sum() == 1
    rows = B.importances(spark, models).collect()
    assert len(rows) == 6 and abs(sum(r.importance for r in rows) - 2) < 1e-9
    assert {r.feature: r.models for r in L.mean_importances(B.importances(spark, models)).collect()} == {"a": 2, "b": 2, "c": 2}
    assert B.nodes(spark, models).where("tree = 0 and node = 0").count() == 2


def test_edges_and_odd_rows(spark):
    df = spark.createDataFrame([(float(i % 10), 1.0, None if i == 3 else i % 2, i % 3 or None) for i in range(100)], "a double, b double, y int, g int")
    assert B.edges(df, ["a", "b"]) == [[float(i) for i in range(10)], [1.0]]
    p = B.Boosting("m", trees=1, depth=2, leaves=4, rows=1.0, columns=1.0, positive=1.0)
    (m,) = B.fit(df, ["a", "b"], "y", [p])
    assert m.trees[0].rows[0] == 99 and m.trees[0].feature[0] == 0
    assert [x.name for x in B.left_out(df, "g", p)] == ["1", "2"]
    none = df.where("a < 0")
    (m,) = B.fit(none, ["a", "b"], "y", [p], cuts=[[1.0], []])
    assert m.trees[0].value.tolist() == [0.0] * 7 and B.predict(none, [m], ("g",)).count() == 0
    with pytest.raises(Exception, match="has a null"):
        B.fit(df.selectExpr("nullif(a, 1) AS a", "b", "y"), ["a", "b"], "y", [p], cuts=[[1.0], [1.0]])


def test_nested_calibration(spark, table):
    """Against models and calibrators fitted one at a time."""
    df, *_ = table
    p = B.Boosting("x", trees=2, depth=2, leaves=3, rate=0.5, positive=2.0, least_child=5, rows=1.0)
    rows, fits = B.nested(df, ["a", "b", "c"], "y", "g", p, ("i", "g", "y"), 2, CUTS)
    fits = {r.model: (r.slope, r.offset) for r in fits.collect()}
    got = {r.i: (r.score, r.calibrated) for r in rows.collect()}
    others = ["g0", "g1", "g3"]
    folds = B.inner_folds(dict.fromkeys(others, 100), 2)
    assert folds == [("g0",), ("g1", "g3")] and B.inner_folds({"a": 1}, 3) == [("a",)] and B.inner_folds({}, 2) == []
    inside = None
    for f in folds:
        (m,) = B.fit(df.where(~F.col("g").isin("g2", *f)), ["a", "b", "c"], "y", [p], cuts=CUTS)
        s = B.predict(df.where(F.col("g").isin(*f)), [m], ("y",))
        inside = s if inside is None else inside.unionByName(s)
    slope, offset = C.fit_platt(inside, "score", "y")
    assert abs(slope - fits["g2"][0]) < 1e-4 and abs(offset - fits["g2"][1]) < 1e-4
    (m,) = B.fit(df.where("g <> 'g2'"), ["a", "b", "c"], "y", [p], cuts=CUTS)
    for r in B.predict(df.where("g = 'g2'"), [m], ("i",)).collect():
        z = np.log(r.score / (1 - r.score))
        assert np.allclose(got[r.i], (r.score, 1 / (1 + np.exp(-(slope * z + offset)))), atol=1e-4)


def test_save_and_load(spark, table, tmp_path):
    df, *_ = table
    models = B.fit(df, ["a", "b", "c"], "y", [B.Boosting("one", trees=2, depth=3, leaves=4), B.Boosting("two", ("g1",), trees=1, depth=2)], "g", cuts=CUTS)
    about = K.provenance(spark, {"roc": 0.5}, 400, calibrator={"method": "sigmoid", "slope": 1.0, "intercept": 0.0})
    B.save(spark, models, str(tmp_path / "m"), about)
    again, told = B.load(spark, str(tmp_path / "m"))
    assert told == about and told["environment"]["spark"] == spark.version and [m.parameters for m in again] == [m.parameters for m in models]
    score = lambda x: sorted(map(tuple, B.predict(df, x, ("i",)).collect()))
    assert score(again) == score(models)


def test_rows_that_repeat_are_counted_once(spark, monkeypatch):
    """Repeated rows are one row of the passes; rows with a number of times give the same models and fits as rows that repeat."""
    rng = random.Random(4)
    rows = [(f"g{rng.randint(0, 2)}", rng.randint(0, 5) / 1.0, rng.randint(0, 3) / 1.0, int(rng.random() < 0.4), rng.randint(1, 4)) for _ in range(120)]
    df = spark.createDataFrame(rows, "g string, a double, b double, y int, r int")
    many = df.select("g", "a", "b", "y", F.explode(F.sequence(F.lit(1), "r"))).drop("col")
    counted, cuts = many.groupBy("g", "a", "b", "y").agg(F.count("*").alias("n")), B.edges(many, ["a", "b"])
    seen, kept = [], B.kept
    monkeypatch.setattr(B, "kept", lambda x, name="kept": seen.append((name, x.count())) or kept(x, name))
    models = [B.Boosting("m", ("g1",), trees=2, depth=2, leaves=3, rate=0.3, rows=0.7, columns=1.0, least_child=2, positive=2.0)]
    one, two = B.fit(many, ["a", "b"], "y", models, "g"), B.fit(counted, ["a", "b"], "y", models, "g", cuts=cuts, weight="n")
    assert seen[0] == ("binned", counted.count()) and counted.count() < many.count()
    for x, y in zip(one[0].trees, two[0].trees):
        assert (x.feature == y.feature).all() and (x.cut == y.cut).all() and (x.rows == y.rows).all() and x.value == pytest.approx(y.value)
    with pytest.raises(ValueError):
        B.fit(counted, ["a", "b"], "y", models, "g", weight="n")
