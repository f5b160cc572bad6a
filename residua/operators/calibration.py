"""Fitting of probability calibrators over (score, label) rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import residues as R
from ..sinks.kept import kept


def fit_platt(df: DataFrame, score: str, label: str, c: float = 1e6) -> tuple[float, float]:
    """(slope, offset) of the logistic on the logit of score; ValueError unless the slope is above 0.

    Rows are summed up by distinct score and label before the fit, as weights.
    """
    x = df.select(R.logit(F.col(score)).alias("z"), F.col(label).cast("double").alias("y")).groupBy("z", "y").agg(F.count("*").cast("double").alias("w"))
    n = df.count()
    m = LogisticRegression(featuresCol="f", labelCol="y", weightCol="w", regParam=1 / (c * max(n, 1)), standardization=False, tol=1e-12, maxIter=200).fit(VectorAssembler(inputCols=["z"], outputCol="f").transform(x))
    slope, offset = float(m.coefficients[0]), float(m.intercept)
    if slope <= 0:
        raise ValueError(f"the calibrator's slope {slope} isn't above 0")
    return slope, offset


def fit_platt_by(df: DataFrame, by: str, score: str, label: str, c: float = 1e6, most: int = 100, weight: str | None = None) -> DataFrame:
    """by (as text), slope, offset: one logistic on the logit of score for each value of by, all fitted at once.

    Newton's steps: a pass over the rows, summed up by distinct score and label beforehand, gives each fit's loss, slopes and
    curvature; a step that makes the loss greater is halved. The loop is over steps, not over fits; the driver holds six numbers
    of each fit, of which there are as many as the caller has folds. The slope is drawn to 0 by its square over 2 c. Rows with a
    null among the three columns teach nothing; a fit of one label alone goes towards an infinite offset and is cut off at
    ``most`` steps. ``weight`` says how often each row counts. Unlike ``fit_platt`` no sign is asked for: what falls with the score has a slope under 0.
    """
    x = df.select(F.col(by).cast("string").alias("k"), F.col(score).alias("p"), F.col(label).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1)).alias("n")).dropna().groupBy("k", R.logit(F.col("p")).alias("z"), "y").agg(F.sum("n").cast("double").alias("w"))
    x = kept(x, "logits")
    at = {r.k: (0.0, 0.0) for r in x.select("k").distinct().collect()}  # one row for each fit
    good: dict = {}  # of each fit: loss, parameters, step to take from them
    moving = set(at)
    for _ in range(most):
        if not moving:
            break
        told = df.sparkSession.createDataFrame([(k, *at[k]) for k in sorted(moving)], "k string, a double, b double")
        t = F.col("a") * F.col("z") + F.col("b")
        p = 1 / (1 + F.exp(-t))
        loss = F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t))) - F.col("y") * t
        d, h = p - F.col("y"), p * (1 - p)
        w = F.col("w")
        sums = x.join(F.broadcast(told), "k").groupBy("k").agg(F.sum(w * loss).alias("l"), F.sum(w * d * F.col("z")).alias("ga"), F.sum(w * d).alias("gb"), F.sum(w * h * F.col("z") * F.col("z")).alias("aa"), F.sum(w * h * F.col("z")).alias("ab"), F.sum(w * h).alias("bb"))
        for r in sums.collect():
            a, b = at[r.k]
            l, ga, aa = r.l + a * a / (2 * c), r.ga + a / c, r.aa + 1 / c
            if r.k in good and l > good[r.k][0] + 1e-12 * abs(good[r.k][0]):
                old, step = good[r.k][1], tuple(v / 2 for v in good[r.k][2])
                good[r.k] = good[r.k][0], old, step
            else:
                det = aa * r.bb - r.ab * r.ab
                step = (-(ga * r.bb - r.gb * r.ab) / det, -(r.gb * aa - ga * r.ab) / det) if det > 0 else (0.0, 0.0)
                old = (a, b)
                good[r.k] = l, old, step
            if max(map(abs, step)) < 1e-10:
                moving.discard(r.k)
                at[r.k] = old
            else:
                at[r.k] = old[0] + step[0], old[1] + step[1]
    return df.sparkSession.createDataFrame([(k, *at[k]) for k in sorted(at)], f"`{by}` string, slope double, offset double")


def isotonic_blocks(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """by, low, high, n, pos, value: the blocks of the non-decreasing step fit of a 0/1 label on score, for each group.

    Adjacent violators are pooled in each range of scores on its own, then the ranges' blocks are pooled again in order. Means
    of blocks are fractions of whole numbers that rise, so n rows make at most about n^(2/3) blocks: that is what one task
    holds of a group at last, and the rows themselves never meet in one task. Sums are whole numbers, so the result is exact. Rows
    with a null score or label count for nothing; blocks of equal means are one.
    """
    by = by or []
    kinds = dict(df.dtypes)
    counted = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("low")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    ranged = counted.select(*by, "low", F.col("low").alias("high"), "n", "pos").repartitionByRange(*by, "low").sortWithinPartitions(*by, "low")
    schema = "".join(f"`{c}` {kinds[c]}, " for c in by) + "low double, high double, n long, pos long"

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stack = None, []

        def out():
            return pa.RecordBatch.from_pylist([dict(zip(by, key)) | dict(zip(("low", "high", "n", "pos"), x)) for x in stack], schema=kind)

        for batch in batches:
            kind = batch.schema
            for r in batch.to_pylist():
                own = tuple(r[c] for c in by)
                if own != key and stack:
                    yield out()
                    stack = []
                key = own
                x = [r["low"], r["high"], r["n"], r["pos"]]
                while stack and stack[-1][3] * x[2] >= x[3] * stack[-1][2]:
                    low, _, n, pos = stack.pop()
                    x = [low, x[1], x[2] + n, x[3] + pos]
                stack.append(x)
        if stack:
            yield out()

    first = ranged.mapInArrow(pool, schema)
    whole = (first.repartition(*by) if by else first.repartition(1)).sortWithinPartitions(*by, "low")
    return whole.mapInArrow(pool, schema).withColumn("value", F.col("pos") / F.col("n"))


def fit_isotonic(df: DataFrame, score: str, label: str) -> tuple[list[float], list[float]]:
    """(boundaries, values) of the non-decreasing step fit: both ends of each block of ``isotonic_blocks``, one of a block of one score."""
    ends = [(x, r.value) for r in isotonic_blocks(df, score, label).orderBy("low").collect() for x in dict.fromkeys((r.low, r.high))]
    return [x for x, _ in ends], [v for _, v in ends]


def isotonic(score: Column, boundaries: list[float], values: list[float]) -> Column:
    """The fit's value at score, linear between boundaries, the end values beyond them, within [0, 1]."""
    b, v = F.array(*map(F.lit, boundaries)), F.array(*map(F.lit, values))
    i = F.size(F.filter(b, lambda t: t <= score))
    lo, hi = F.greatest(i - 1, F.lit(0)), F.least(i, F.lit(len(boundaries) - 1))
    x0, x1, y0, y1 = b[lo], b[hi], v[lo], v[hi]
    out = F.when(x1 > x0, y0 + (y1 - y0) * (F.least(F.greatest(score, x0), x1) - x0) / (x1 - x0)).otherwise(y0)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def calibrated(df: DataFrame, by: str, score: str, fits: DataFrame, out: str = "calibrated") -> DataFrame:
    """Adds the calibrated score by each row's own fit of ``fit_platt_by``; null where its value of by has none."""
    f = fits.select(F.col(by).alias("__k"), "slope", "offset")
    t = F.col("slope") * R.logit(F.col(score)) + F.col("offset")
    made = F.when(F.col(score).isNotNull(), 1 / (1 + F.exp(-t)))
    return df.join(F.broadcast(f), F.col(by).cast("string") == F.col("__k"), "left").withColumn(out, made).drop("__k", "slope", "offset")
