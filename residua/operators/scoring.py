"""From features to predictions: calibrators, labels, the summary of a run and its best rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import residues as R


def isotonic(p: Column, xs: list[float], ys: list[float]) -> Column:
    """The value of a fitted step curve at p: linear between its points, level beyond its ends."""
    if not xs:
        raise ValueError("an isotonic calibrator has one point at least")
    out = F.when(p <= xs[0], F.lit(ys[0]))
    for x0, y0, x1, y1 in zip(xs, ys, xs[1:], ys[1:], strict=False):
        out = out.when(p <= x1, F.lit(y0) + (p - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0))
    return F.when(p.isNotNull(), out.otherwise(F.lit(ys[-1])))


def calibrated(p: Column, calibrator: dict) -> Column:
    """A raw score by its calibrator: {"method": "sigmoid", "slope", "intercept"} or {"method": "isotonic", "x", "y"}; others are an error."""
    if calibrator.get("method") == "sigmoid":
        return R.platt(p, calibrator["slope"], calibrator["intercept"])
    if calibrator.get("method") == "isotonic":
        return F.least(F.greatest(isotonic(p, calibrator["x"], calibrator["y"]), F.lit(0.0)), F.lit(1.0))
    raise ValueError(f"no such calibrator: {calibrator.get('method')!r}")


def contract(columns: list[str], wanted: list[str]) -> list[str]:
    """How the columns break the contract of a model: their number, names and order."""
    broken = [] if len(columns) == len(wanted) else [f"{len(columns)} columns, not {len(wanted)}"]
    broken += [f"{c} missing" for c in wanted if c not in columns] + [f"{c} not asked for" for c in columns if c not in wanted]
    return broken or ([] if columns == wanted else ["order"])


def predictions(df: DataFrame, raw: str, calibrator: dict, threshold: float) -> DataFrame:
    """Adds probability_raw, probability_calibrated and predicted."""
    c = calibrated(F.col(raw), calibrator)
    return df.withColumn("probability_raw", F.col(raw)).withColumn("probability_calibrated", c).withColumn("predicted", R.at_least(F.col("probability_calibrated"), threshold))


def score(model, features: DataFrame, columns: list[str], calibrator: dict, threshold: float) -> DataFrame:
    """Predictions of a fitted pipeline for a feature table whose columns keep the model's contract."""
    from . import learning

    if broken := contract([c for c in features.columns if c in columns], columns):
        raise ValueError("; ".join(broken))
    return predictions(learning.score(model, features, "__raw"), "__raw", calibrator, threshold).drop("__raw")


def summary(df: DataFrame, by: list[str], pos: str, letter: str) -> DataFrame:
    """by, n, positives, share, mean_raw, mean_calibrated, most, most_pos, most_letter: the best row is the first of equal ones."""
    p = F.col("probability_calibrated")
    best = F.max_by(F.struct(F.col(pos).alias("p"), F.col(letter).alias("l")), F.struct(p, -F.col(pos)))
    g = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("predicted").alias("positives"), F.avg(F.col("predicted").cast("double")).alias("share"), F.avg("probability_raw").alias("mean_raw"), F.avg(p).alias("mean_calibrated"), F.max(p).alias("most"), best.alias("b"),
    )
    return g.select(*by, "n", "positives", "share", "mean_raw", "mean_calibrated", "most", F.col("b.p").alias("most_pos"), F.col("b.l").alias("most_letter"))


def top(df: DataFrame, pos: str, k: int) -> DataFrame:
    """The k rows of the highest calibrated probability, equal ones by place."""
    return df.orderBy(F.desc("probability_calibrated"), pos).limit(k)


def imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values of the columns as the mean of the others; the means are one row."""
    means = df.agg(*[F.avg(c).alias(f"__{c}") for c in columns])
    j = df.crossJoin(F.broadcast(means))
    return j.select(*[F.coalesce(F.col(c).cast("double"), F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def one_at_a_time(spark, base: dict[str, float], steps: dict[str, list[float]]) -> DataFrame:
    """config, name, value, and a column for each parameter: the base, and each other value of one parameter at a time."""
    every = spark.createDataFrame([(n, float(v)) for n, values in steps.items() for v in values], "name string, value double")
    return varied(every, base)


def varied(steps: DataFrame, base: dict[str, float]) -> DataFrame:
    """The same for a table of steps(name, value); values of other parameters and nulls are left out, equal ones are one."""
    start = F.create_map(*[x for n, v in base.items() for x in (F.lit(n), F.lit(float(v)))])
    rows = steps.select("name", F.col("value").cast("double").alias("value")).where(F.col("name").isin(*base) & F.col("value").isNotNull()).distinct()
    rows = rows.where(F.col("value") != F.element_at(start, F.col("name")))
    shown = F.regexp_replace(F.col("value").cast("string"), r"\.0$", "")
    first = steps.sparkSession.range(1).select(F.lit("base").alias("config"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("value"))
    both = first.unionByName(rows.select(F.concat("name", F.lit("="), shown).alias("config"), "name", "value"))
    return both.select("config", "name", "value", *[F.when(F.col("name") == n, F.col("value")).otherwise(float(v)).alias(n) for n, v in base.items()])


def score_digest(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows, digest: equal for equal scores of equal keys, whatever the order of rows and partitions."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*keys, value).cast("decimal(38,0)")).alias("digest"))


def ordered_digest(df: DataFrame, order: str, value: Column, size: int = 4096) -> DataFrame:
    """rows, sha256 of a buffer of values in the order of a column of unique numbers, the same whatever the partitions.

    Values (as text, null as an empty one) are joined by commas in chunks of ``size`` places; a chunk's SHA-256 is of its text, and chunks' digests
    are joined and hashed in the same way, level by level, until one is left. No task holds more than a chunk. An empty
    buffer has the digest of the empty text.
    """
    from .evaluation import ranked

    x = df.select(F.col(order).alias("__o"), F.coalesce(value.cast("string"), F.lit("")).alias("v"))
    place = ranked(x, "__o").select(F.col("__s").alias("__o"), (F.col("rank") - 1).cast("long").alias("i"))
    level, n = x.join(place, "__o").select("i", "v"), x.count()
    left, first = n, True
    while left > 1 or first:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]), ",")
        level = level.groupBy(F.floor(F.col("i") / size).cast("long").alias("c")).agg(F.sha2(joined.cast("binary"), 256).alias("v")).select(F.col("c").alias("i"), "v")
        left, first = -(-left // size), False
    return level.agg(F.max("v").alias("v")).select(F.lit(n).cast("long").alias("rows"), F.coalesce("v", F.sha2(F.lit("").cast("binary"), 256)).alias("sha256"))
