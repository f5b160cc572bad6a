"""Calibrators against plain versions."""

import math
import random
from fractions import Fraction

import pytest

from residua.operators import calibration
from pyspark.sql import functions as F


def pooled(points):
    """Pool adjacent violators: the fitted value of each point in order of its score."""
    blocks = []
    for y in points:
        blocks.append([y, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            (a, m), (b, n) = blocks[-2:]
            blocks[-2:] = [[(a * m + b * n) / (m + n), m + n]]
    return [v for v, n in blocks for _ in range(n)]


def test_isotonic(spark):
    labels = [0, 1, 0, 0, 1, 1, 0, 1, 1, 1]
    df = spark.createDataFrame([(i / 10, y) for i, y in enumerate(labels)], "p double, y int")
    b, v = calibration.fit_isotonic(df, "p", "y")
    got = [r.c for r in df.orderBy("p").select(calibration.isotonic(F.col("p"), b, v).alias("c")).collect()]
    assert got == pytest.approx(pooled(labels))
    ends = spark.createDataFrame([(-1.0,), (2.0,)], "p double").select(calibration.isotonic(F.col("p"), b, v).alias("c"))
    assert [r.c for r in ends.collect()] == pytest.approx([pooled(labels)[0], pooled(labels)[-1]])


def test_platt(spark):
    rows = [(i / 20, int((i * 7) % 20 < i)) for i in range(1, 20)]
    df = spark.createDataFrame(rows, "p double, y int")
    a, b = calibration.fit_platt(df, "p", "y")
    x = [(math.log(p / (1 - p)), y) for p, y in rows]
    u, w = 0.0, 0.0
    for _ in range(50):  # Newton's method
        q = [1 / (1 + math.exp(-(u * z + w))) for z, _ in x]
        g = [sum((p - y) * z for p, (z, y) in zip(q, x)), sum(p - y for p, (_, y) in zip(q, x))]
        h = [[sum(p * (1 - p) * z * z for p, (z, _) in zip(q, x)), sum(p * (1 - p) * z for p, (z, _) in zip(q, x))], [0, sum(p * (1 - p) for p in q)]]
        det = h[0][0] * h[1][1] - h[0][1] ** 2
        u, w = u - (h[1][1] * g[0] - h[0][1] * g[1]) / det, w - (h[0][0] * g[1] - h[0][1] * g[0]) / det
    assert (a, b) == pytest.approx((u, w), abs=1e-4)
    with pytest.raises(ValueError):
        calibration.fit_platt(df.withColumn("y", 1 - F.col("y")), "p", "y")


def test_isotonic_blocks_by_group(spark):
    """Many scores over many partitions, ties and one group of most rows, against pooling of all points in order; exact."""
    rng = random.Random(3)
    rows = [("hot" if i % 5 else f"g{i % 3}", rng.randint(0, 400) / 7, int(rng.random() < 0.3 + (i % 5 == 0) * 0.2)) for i in range(3000)]
    df = spark.createDataFrame([*rows, ("hot", None, 1), ("hot", 1.0, None), ("one", 2.0, 1)], "g string, p double, y int").repartition(7)
    got = {}
    for r in calibration.isotonic_blocks(df, "p", "y", ["g"]).orderBy("g", "low").collect():
        got.setdefault(r.g, []).append((r.low, r.high, r.n, r.pos))
    for g in {r[0] for r in rows}:
        sums = {}
        for k, p, y in rows:
            if k == g:
                n, s = sums.get(p, (0, 0))
                sums[p] = n + 1, s + y
        stack = []
        for p in sorted(sums):
            stack.append([p, p, *sums[p]])
            while len(stack) > 1 and Fraction(stack[-2][3], stack[-2][2]) >= Fraction(stack[-1][3], stack[-1][2]):
                b = stack.pop()
                stack[-1] = [stack[-1][0], b[1], stack[-1][2] + b[2], stack[-1][3] + b[3]]
        assert got[g] == [tuple(x) for x in stack]
    assert got["one"] == [(2.0, 2.0, 1, 1)]
    whole = calibration.isotonic_blocks(df.drop("g"), "p", "y").collect()
    assert sum(r.n for r in whole) == 3001 and sorted(whole, key=lambda r: r.low) == sorted(whole, key=lambda r: r.value)
    assert calibration.isotonic_blocks(df.where("false"), "p", "y", ["g"]).count() == 0


def test_platt_of_many_groups_at_once(spark):
    """Each group's fit is the one that it has alone; a group of one label ends too; steps that overshoot are halved."""
    rng = random.Random(8)
    rows = [(f"g{i % 4}", min(max(rng.random() ** 3, 0.0), 1.0), 0) for i in range(800)]
    rows = [(g, p, int(rng.random() < (p if g != "g3" else 0.999 * (p > 0.5)))) for g, p, _ in rows] + [("none", 0.3, 0), ("none", 0.6, 0), (None, 0.5, 1), ("g0", None, 1)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    fits = calibration.fit_platt_by(df, "g", "p", "y", most=40)
    got = {r.g: (r.slope, r.offset) for r in fits.collect()}
    assert set(got) == {"g0", "g1", "g2", "g3", "none"}
    for g in ("g0", "g1", "g2"):
        assert got[g] == pytest.approx(calibration.fit_platt(df.where(F.col("g") == g).dropna(), "p", "y"), abs=1e-4)
    assert got["g3"][0] > 3 and got["none"][1] < -5
    out = calibration.calibrated(df, "g", "p", fits)
    assert out.where("g is null and calibrated is null").count() == 1 and out.where("calibrated between 0 and 1").count() == len(rows) - 2
    assert calibration.fit_platt_by(df.where("false"), "g", "p", "y").count() == 0
