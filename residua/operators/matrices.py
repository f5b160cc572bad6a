"""Long matrices (group, i, j, value): figures of the whole and of its diagonal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The percentiles that are reported.
PERCENTILES = (1, 5, 25, 50, 75, 95, 99)


def quantiles(df: DataFrame, by: list[str], value: str, cuts: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """by, p1, p5, ...: exact percentiles with linear interpolation.

    Values are counted before they are sorted, and sorted by a window that can spill, so no task holds a group's values.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    w = W.partitionBy(*by).orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    c = c.select(*by, "__v", "__n", F.sum("__n").over(w).alias("__to"), F.sum("__n").over(W.partitionBy(*by)).alias("__all"))
    at = lambda p: (F.col("__all") - 1) * F.lit(p / 100)
    here = lambda k: F.max(F.when((k >= F.col("__to") - F.col("__n")) & (k < F.col("__to")), F.col("__v")))
    g = c.groupBy(*by).agg(F.max("__all").alias("__all"), *[x for p in cuts for x in (here(F.floor(at(p))).alias(f"__lo{p}"), here(F.ceil(at(p))).alias(f"__hi{p}"))])
    return g.select(*by, *[(F.col(f"__lo{p}") + (F.col(f"__hi{p}") - F.col(f"__lo{p}")) * (at(p) - F.floor(at(p)))).alias(f"p{p}") for p in cuts])


def exact_quantiles(df: DataFrame, value: str, shares: list[float], buckets: int = 1024) -> list[float]:
    """The value at each share of the sorted non-null values, between neighbours in proportion; exact, an empty list for no values.

    Values are counted in ``buckets`` parts of their range, and the parts that hold a wanted rank are divided again, all at once,
    until each has one value: two or three passes for most tables. A pass gives the driver ``buckets`` rows for each open rank,
    whatever the number of values. NaN counts as null; infinite values are an error.
    """
    v = df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    low, high, n = v.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n:
        return []
    if low == float("-inf") or high == float("inf"):
        raise ValueError(f"{value} has infinite values")
    at = [(n - 1) * s for s in shares]
    ranks = {r for x in at for r in (int(x), min(int(x) + 1, n - 1))}
    found = dict.fromkeys(ranks, low) if low == high else {}
    parts = {} if found else {(low, high): (0, sorted(ranks))}  # range -> values below it, ranks in it
    while parts:
        spans = list(parts)
        which = F.coalesce(*[F.when(F.col("v").between(a, b), F.lit(i)) for i, (a, b) in enumerate(spans)])
        # halves, so that the width of a range is always finite
        share = F.coalesce(*[F.when(F.col("i") == i, (F.col("v") / 2 - a / 2) / (b / 2 - a / 2)) for i, (a, b) in enumerate(spans)])
        cells = v.withColumn("i", which).where("i is not null").groupBy("i", F.least(F.floor(share * buckets), F.lit(buckets - 1)).alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        old, parts = parts, {}
        below = {i: old[s][0] for i, s in enumerate(spans)}
        for c in sorted(cells.collect()):
            inside = [r for r in old[spans[c.i]][1] if below[c.i] <= r < below[c.i] + c.n]
            if inside and c.lo == c.hi:
                found |= dict.fromkeys(inside, c.lo)
            elif inside:
                parts[c.lo, c.hi] = (below[c.i], inside)
            below[c.i] += c.n
    return [found[int(x)] + (found[min(int(x) + 1, n - 1)] - found[int(x)]) * (x - int(x)) for x in at]


def stats(cells: DataFrame, group: str) -> DataFrame:
    """group, n_rows, n_cols, least, most, mean and the percentiles."""
    g = cells.groupBy(group).agg(F.countDistinct("i").alias("n_rows"), F.countDistinct("j").alias("n_cols"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"))
    return g.join(quantiles(cells, [group], "value"), group)


def contact_stats(cells: DataFrame, group: str, threshold: float = 0.5) -> DataFrame:
    """group, asymmetry (greatest difference of a cell and its mirror), figures on and off the diagonal, contacts (pairs i < j at the threshold)."""
    mirror = cells.select(group, F.col("i").alias("j"), F.col("j").alias("i"), F.col("value").alias("__m"))
    on, v = F.col("i") == F.col("j"), F.col("value")
    a = cells.join(mirror, [group, "i", "j"], "left").groupBy(group).agg(
        F.max(F.abs(v - F.col("__m"))).alias("asymmetry"), F.min(F.when(on, v)).alias("diagonal_least"), F.max(F.when(on, v)).alias("diagonal_most"),
        F.avg(F.when(~on, v)).alias("other_mean"), F.max(F.when(~on, v)).alias("other_most"), F.count_if((F.col("i") < F.col("j")) & (v >= threshold)).alias("contacts"),
    )
    half = lambda rows, name: quantiles(rows, [group], "value", (50,)).withColumnRenamed("p50", name)
    return a.join(half(cells.where(on), "diagonal_median"), group, "left").join(half(cells.where(~on), "other_median"), group, "left")


def histogram(df: DataFrame, value: str, width: float = 2.0) -> DataFrame:
    """bin, n: bins of a width from 0 to the greatest value, rounded up; the last bin has its upper end too."""
    top = df.agg((F.ceil(F.max(value) / width) - 1).alias("__top"))  # one row
    b = F.greatest(F.least(F.floor(F.col(value) / width), F.col("__top")), F.lit(0)).cast("long")
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(top)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
