"""Ranks, areas and quantiles over ranges of scores against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.operators import comparison as M
from residua.operators import evaluation as E
from residua.operators import matrices as X


def plain(rows):
    """n, pos, roc, pr of (score, label) rows: all pairs, and the curve from the top."""
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    roc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None
    at, tp, n, area, before = sorted({s for s, _ in rows}, reverse=True), 0, 0, 0.0, (0.0, 1.0)
    for s in at:
        tp += sum(1 for t, y in rows if t == s and y)
        n += sum(1 for t, _ in rows if t == s)
        if pos:
            now = tp / len(pos), tp / n
            area += (now[0] - before[0]) * (now[1] + before[1]) / 2
            before = now
    return len(rows), len(pos), roc, area if pos else None


def test_areas(spark):
    rng = random.Random(1)
    rows = [("hot", rng.randint(0, 60) / 7, int(rng.random() < 0.3)) for _ in range(900)] + [(f"g{i % 5}", rng.gauss(0, 1), i % 2) for i in range(60)] + [("no", 1.0, 0), ("all", 2.0, 1), (None, 1.0, 1), (None, 0.0, 0)]
    df = spark.createDataFrame(rows, "g string, s double, y int").repartition(5)
    want = defaultdict(list)
    for g, s, y in rows:
        want[g].append((s, y))
    got = {r.g: (r.n, r.pos, r.roc, r.pr) for r in E.areas(df, "s", "y", ["g"]).collect()}
    assert set(got) == set(want)
    for g, x in want.items():
        assert got[g] == pytest.approx(plain(x)), g
    whole = E.areas(df, "s", "y").first()
    assert tuple(whole) == pytest.approx(plain([x[1:] for x in rows]))
    assert E.areas(df.where("false"), "s", "y", ["g"]).count() == 0


def test_ranked(spark):
    values = [3.0, 1.0, 3.0, None, 2.0, 3.0]
    got = {r["__s"]: (r["__n"], r["rank"]) for r in E.ranked(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()}
    assert got == {1.0: (1, 1.0), 2.0: (1, 2.0), 3.0: (3, 4.0)}


@pytest.mark.parametrize("buckets", [2, 1024])
def test_exact_quantiles(spark, buckets):
    rng = np.random.default_rng(0)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    for v in (rng.normal(size=500), np.exp(rng.normal(size=300) * 9), np.repeat([1.0, 2.0], [400, 3]), np.array([-1.7e308, 0.0, 1.7e308, 5.0]), np.array([7.0])):
        df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
        assert X.exact_quantiles(df, "v", shares, buckets) == pytest.approx(np.quantile(v / 4, shares) * 4, rel=1e-12)
    assert X.exact_quantiles(df.where("false"), "v", shares) == []
    with pytest.raises(ValueError):
        X.exact_quantiles(df.withColumn("v", F.lit(float("inf"))), "v", shares)


def test_values_that_change_when_computed_again(spark):
    """Means of doubles have other last digits in each evaluation of a plan; no row may be lost or counted twice for that."""
    again = F.udf(lambda v: v * (1 + random.random() * 1e-13), "double").asNondeterministic()
    values = [(i, (i + 1) * (-1.0 if i % 3 else 1.0)) for i in range(60)]
    d = spark.createDataFrame(values, "i int, v double").repartition(4)
    deltas = d.select(again("v").alias("delta"))
    w = M.wilcoxon(deltas).first()
    assert (w.n, w.w_plus, w.w_minus) == (60, sum(v for _, v in values if v > 0), -sum(v for _, v in values if v < 0))
    rows = [(abs(v), int(v > 0)) for _, v in values]
    for _ in range(3):
        a = E.areas(d.select(again(F.abs("v")).alias("s"), (F.col("v") > 0).cast("int").alias("y")), "s", "y").first()
        assert tuple(a) == pytest.approx(plain(rows))
    r = M.rank_correlations(d.select(again("v").alias("a"), again(-F.col("v")).alias("b")), ["a", "b"]).first()
    assert r.spearman == pytest.approx(-1.0)
