"""Comparison of models over the same folds, and the rules that choose among configurations.

Fold tables have one row for each fold and configuration; their sums are made by key, so only the final statistics
(one row for each pair or configuration) are small by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sinks.kept import kept
from .evaluation import ranked


def paired_deltas(folds: DataFrame, fold: str, config: str, value: str, a: str, b: str) -> DataFrame:
    """fold, delta: value of configuration b less that of a, over folds that have both."""
    one = lambda c: F.max(F.when(F.col(config) == c, F.col(value)))
    return folds.groupBy(fold).agg(one(a).alias("__a"), one(b).alias("__b")).select(fold, (F.col("__b") - F.col("__a")).alias("delta")).where("delta is not null")


def delta_summary(deltas: DataFrame) -> DataFrame:
    """folds, median_delta, up, down, tie: one row; the median is null without folds."""
    return deltas.agg(F.count("*").alias("folds"), F.percentile("delta", F.lit(0.5)).alias("median_delta"), F.count_if(F.expr("delta > 0")).alias("up"), F.count_if(F.expr("delta < 0")).alias("down"), F.count_if(F.expr("delta = 0")).alias("tie"))


def wilcoxon(deltas: DataFrame) -> DataFrame:
    """n, w_plus, w_minus, z: the signed-rank statistics, differences of 0 left out, equal ones ranked alike.

    z is the normal approximation with the correction for ties; it is null without a difference.
    """
    sizes = deltas.where("delta <> 0").select(F.abs("delta").alias("size"), (F.col("delta") > 0).cast("long").alias("up"))
    r = ranked(sizes, "size", "up").select(F.col("__n").alias("t"), F.col("__p").alias("up"), "rank")
    t = F.col("t")
    s = r.agg(F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (t - F.col("up"))).alias("w_minus"), F.sum(t * t * t - t).alias("ties"))
    n = F.col("n")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return s.select(F.coalesce(n, F.lit(0)).alias("n"), "w_plus", "w_minus", F.when(sd > 0, (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / sd).alias("z"))


def mean_ranks(folds: DataFrame, fold: str, config: str, value: str) -> DataFrame:
    """config, mean_rank, n: rank 1 is the greatest value of a fold, equal ones share their average rank."""
    r = F.rank().over(W.partitionBy(fold).orderBy(F.desc(value))) + (F.count("*").over(W.partitionBy(fold, value)) - 1) / 2
    return folds.where(F.col(value).isNotNull()).withColumn("__r", r).groupBy(config).agg(F.avg("__r").alias("mean_rank"), F.count("*").alias("n"))


def friedman(folds: DataFrame, fold: str, config: str, value: str) -> DataFrame:
    """n, k, chi2: over folds that have a value of every configuration, without the correction for ties."""
    k = folds.select(config).distinct().agg(F.count("*").alias("k"))  # one row
    full = folds.where(F.col(value).isNotNull()).groupBy(fold).agg(F.countDistinct(config).alias("have")).join(F.broadcast(k), F.col("have") == F.col("k")).select(fold, "k")
    r = mean_ranks(folds.join(full, fold), fold, config, value)
    s = r.agg(F.max("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("mean_rank") * F.col("mean_rank")).alias("s"))
    n, c = F.col("n"), F.col("k")
    return s.select("n", "k", (12 * n / (c * (c + 1)) * (F.col("s") - c * (c + 1) * (c + 1) / 4)).alias("chi2"))


def golden(configs: DataFrame, key: str, score: str, gain: str, loss: str, score_tolerance: float = 0.005, gain_tolerance: float = 0.05) -> DataFrame:
    """The one configuration chosen: of those near the best score those near the best gain among them, then least loss, then key.

    Each tolerance is measured from the best that is left, so no single order of all columns gives the same choice.
    """
    every = W.partitionBy()  # a table of configurations
    near = configs.withColumn("__s", F.max(score).over(every)).where(F.col(score) >= F.col("__s") - score_tolerance)
    near = near.withColumn("__g", F.max(gain).over(every)).where(F.col(gain) >= F.col("__g") - gain_tolerance)
    return near.drop("__s", "__g").orderBy(loss, key).limit(1)


def accepted(configs: DataFrame, base: DataFrame, score: str, gain: str, step: float = 0.002, gain_step: float = 0.05) -> DataFrame:
    """Adds ``accepted``: better than the one row of base by step, or as good within step with more gain by gain_step."""
    b = base.select(F.col(score).alias("__s"), F.col(gain).alias("__g")).limit(1)
    d, g = F.col(score) - F.col("__s"), F.col(gain) - F.col("__g")
    return configs.crossJoin(F.broadcast(b)).withColumn("accepted", (d > step) | ((F.abs(d) <= step) & (g > gain_step))).drop("__s", "__g")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, pearson: each pair of columns once, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("pearson")) for a, b in pairs]).alias("p"))
    return row.select(F.inline("p"))


def rank_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, spearman: each pair of columns once; equal values share their average rank.

    Each column's ranks are made of its distinct values, counted first, and joined back by value; so the values are written down
    before, as computed ones might not meet themselves.
    """
    df = kept(df.select(*columns), "ranks")
    for c in columns:
        df = df.join(ranked(df, c).select(F.col("__s").alias(c), F.col("rank").alias(f"__r_{c}")), c, "left")
    ranks = correlations(df.select(*[F.col(f"__r_{c}").alias(c) for c in columns]), columns)
    return ranks.withColumnRenamed("pearson", "spearman")


def radius_choice(configs: DataFrame, key: str, first: str, second: str, third: str, tolerance: float = 0.002) -> DataFrame:
    """The one configuration of the best first score; of those within the tolerance of it the best second, then third, then the least key."""
    every = W.partitionBy()  # a table of configurations
    for c in (first, second):
        configs = configs.withColumn("__s", F.max(c).over(every)).where(F.col(c) >= F.col("__s") - tolerance).drop("__s")
    return configs.orderBy(F.desc(third), key).limit(1)


def nested_choice(folds: DataFrame, fold: str, config: str, value: str) -> DataFrame:
    """fold, config, inner, value: for each fold the config of the highest mean over all other folds, and what it has in this one.

    Of equal means the least config is chosen. Folds without a value of a config don't count for it; a config that no other
    fold has can't be chosen, so a single fold gives no row.
    """
    known = folds.where(F.col(value).isNotNull()).select(F.col(fold).alias("fold"), F.col(config).alias("config"), F.col(value).cast("double").alias("value"))
    whole = known.groupBy("config").agg(F.sum("value").alias("total"), F.count("*").alias("n")).where("n > 1")  # a table of configs
    inner = known.join(whole, "config").withColumn("inner", (F.col("total") - F.col("value")) / (F.col("n") - 1))
    best = inner.groupBy("fold").agg(F.min(F.struct((-F.col("inner")).alias("cost"), "config", "inner", "value")).alias("b"))
    return best.select("fold", "b.config", "b.inner", "b.value")


def nested_summary(choice: DataFrame) -> DataFrame:
    """folds, median, mean of the values in the folds that had no part in the choice, and how far the means that chose are above them."""
    return choice.agg(F.count("*").alias("folds"), F.expr("percentile(value, 0.5)").alias("median"), F.avg("value").alias("mean"), F.avg(F.col("inner") - F.col("value")).alias("optimism"))


def chi2_upper(x: Column, df: Column, terms: int = 1500) -> Column:
    """Probability that a chi-squared variable of df (a whole number from 1) is over x: one less the series of the lower part."""
    odd, a = df % 2 == 1, df / 2
    half = F.sequence(F.lit(0), (F.floor((df + 1) / 2) - 1).cast("int"))
    shift = F.when(odd, F.lit(0.5)).otherwise(F.lit(1.0))
    log_gamma = F.aggregate(half, F.when(odd, F.lit(0.5) * F.log(F.pi())).otherwise(F.lit(0.0)), lambda s, i: s + F.log(shift + i))  # of a + 1
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(v: Column, i: Column) -> Column:
        t = v["t"] * (x / 2) / (a + i)
        return F.struct(t.alias("t"), (v["s"] + t).alias("s"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda v: v["s"])
    lower = F.exp(a * F.log(x / 2) - x / 2 - log_gamma) * total
    return F.when(x <= 0, 1.0).when(x > 600 + 4 * df, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - lower))


def wilcoxon_p(statistics: DataFrame) -> DataFrame:
    """Adds p, the two-sided probability of z in the normal approximation; 1 where no fold differs."""
    return statistics.withColumn("p", F.coalesce(chi2_upper(F.col("z") * F.col("z"), F.lit(1)), F.lit(1.0)))


def friedman_p(statistics: DataFrame) -> DataFrame:
    """Adds p, the probability of chi2 with one degree of freedom less than configurations; null with fewer than two of them."""
    return statistics.withColumn("p", F.when(F.col("k") > 1, chi2_upper(F.col("chi2"), F.col("k") - 1)))
