"""Ranking, probability and agreement metrics over (group, position, score, label) rows, as plans without loops.

Each takes a DataFrame and names of columns and returns a DataFrame; groups are grouping keys, so all groups are
computed at once. Sums are made before shuffles wherever the metric allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sinks.kept import kept
from .matrices import exact_quantiles


def _steps(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """One row for each group and distinct score: n, positives."""
    return df.groupBy(*by, F.col(score).alias("__s")).agg(F.count("*").alias("__n"), F.sum(F.col(label).cast("long")).alias("__p"))


def _running(x: DataFrame, by: list[str]) -> DataFrame:
    """Adds __cn and __cp, sums of n and positives up to each score of a group, and __an and __ap, those of the whole group.

    Scores are dealt to ranges, of which there are as many as shuffle partitions, by approximate percentiles; they may be uneven
    and change nothing. Each range of a group runs apart and starts at the sums of the ranges before it, so a group of most rows
    is no single task. x is written down first: a score that is a mean may have other last digits each time it is computed, and
    would then be of one range here and of another one there.
    """
    x = kept(x, "steps")
    ranges = max(2, int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = x.agg(F.percentile_approx("__s", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(1000)).alias("__e"))  # one row
    x = x.crossJoin(F.broadcast(edges)).withColumn("__k", F.size(F.filter("__e", lambda t: t < F.col("__s")))).drop("__e")
    own = x.groupBy(*by, "__k").agg(F.sum("__n").alias("__bn"), F.sum("__p").alias("__bp"))
    every = W.partitionBy(*by)  # a row for each range of a group
    before = every.orderBy("__k").rowsBetween(W.unboundedPreceding, -1)
    start = own.select(*by, "__k", *[F.coalesce(F.sum(f"__b{c}").over(before), F.lit(0)).alias(f"__b{c}") for c in "np"], *[F.sum(f"__b{c}").over(every).alias(f"__a{c}") for c in "np"])
    upto = W.partitionBy(*by, "__k").orderBy("__s").rowsBetween(W.unboundedPreceding, 0)
    run = x.select("*", *[F.sum(f"__{c}").over(upto).alias(f"__r{c}") for c in "np"])
    keys = [run[c].eqNullSafe(start[c]) for c in [*by, "__k"]]
    j = run.join(start, keys)
    return j.select(*[run[c] for c in by], "__s", "__n", "__p", *[(F.col(f"__r{c}") + F.col(f"__b{c}")).alias(f"__c{c}") for c in "np"], "__an", "__ap")


def ranked(df: DataFrame, column: str, label: str | None = None) -> DataFrame:
    """__s, __n, __p, rank: each distinct non-null value of a column, how often it is there, the sum of a 0/1 label (0 without one), and the average rank of its rows."""
    known = df.where(F.col(column).isNotNull()).select(F.col(column).alias("__c"), (F.col(label) if label else F.lit(0)).alias("__y"))
    return _running(_steps(known, "__c", "__y", []), []).select("__s", "__n", "__p", (F.col("__cn") - F.col("__n") + (F.col("__n") + 1) / 2).alias("rank"))


def areas(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """by, n, pos, roc, pr of each group, in one pass over its distinct scores.

    roc is Mann-Whitney with ties averaged, null unless both labels occur. pr is the sum of trapezoids under the
    precision-recall curve with a point for each distinct score, from (0, 1); null without positives. Scores run upwards, and
    what is above a score is the group less what is up to it.
    """
    by = by or []
    x = _running(_steps(df, score, label, by), by)
    ranks = F.sum(F.col("__p") * (F.col("__cn") - F.col("__n") + (F.col("__n") + 1) / 2))
    n0, p0 = F.col("__an") - F.col("__cn"), F.col("__ap") - F.col("__cp")  # above this score
    # positives gained times the mean precision at both ends; over all positives at last
    part = F.col("__p") * ((p0 + F.col("__p")) / (n0 + F.col("__n")) + F.when(n0 > 0, p0 / n0).otherwise(F.lit(1.0))) / 2
    g = x.groupBy(*by).agg(F.sum("__n").alias("n"), F.sum("__p").alias("pos"), ranks.alias("__r"), F.sum(part).alias("__a"))
    neg = F.col("n") - F.col("pos")
    roc = F.when((F.col("pos") > 0) & (neg > 0), (F.col("__r") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * neg))
    return g.select(*by, "n", "pos", roc.alias("roc"), F.when(F.col("pos") > 0, F.col("__a") / F.col("pos")).alias("pr"))


def roc_auc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """by, n, pos, roc of ``areas``."""
    return areas(df, score, label, by).drop("pr")


def pr_auc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """by, pr of ``areas``."""
    return areas(df, score, label, by).select(*(by or []), "pr")


def _figures(a: DataFrame, by: list[str]) -> DataFrame:
    return a.select(*by, "n", "pos", (F.col("pos") / F.col("n")).alias("prev"), "roc", "pr")


def pooled_metrics(df: DataFrame, score: str, label: str) -> DataFrame:
    """n, pos, prev, roc, pr of all rows as one: one row."""
    return _figures(areas(df, score, label), [])


def fold_metrics(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """group, n, pos, prev, roc, pr: one row for each held-out group, roc and pr null without positives."""
    return _figures(areas(df, score, label, [group]), [group])


def fold_summary(folds: DataFrame) -> DataFrame:
    """Medians and quartiles over folds with positives, and the median gain over prevalence."""
    ok = folds.where("pos > 0")
    q = lambda c, p: F.percentile(c, F.lit(p))
    return ok.agg(
        F.count("*").alias("folds"), q("roc", 0.5).alias("median_roc"), q("roc", 0.25).alias("q25_roc"), q("roc", 0.75).alias("q75_roc"),
        q("pr", 0.5).alias("median_pr"), q("pr", 0.25).alias("q25_pr"), q("pr", 0.75).alias("q75_pr"), q(F.col("pr") / F.col("prev"), 0.5).alias("median_gain"),
    )


def within_z(df: DataFrame, group: str, score: str, out: str = "z") -> DataFrame:
    """Adds the z-score within the group by population deviation, 0 where that is 0."""
    g = W.partitionBy(group)
    sd = F.stddev_pop(score).over(g)
    return df.withColumn(out, F.when(sd > 0, (F.col(score) - F.avg(score).over(g)) / sd).otherwise(F.lit(0.0)))


def within_rank(df: DataFrame, group: str, score: str, out: str = "rank") -> DataFrame:
    """Adds the average rank within the group over its size."""
    r = F.rank().over(W.partitionBy(group).orderBy(score)) + (F.count("*").over(W.partitionBy(group, score)) - 1) / 2
    return df.withColumn(out, r / F.count("*").over(W.partitionBy(group)))


def probability_metrics(df: DataFrame, p: str, label: str) -> DataFrame:
    """n, mean, least, most, brier, log_loss, distinct."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    y = F.col(label).cast("double")
    return df.agg(
        F.count("*").alias("n"), F.avg(p).alias("mean"), F.min(p).alias("least"), F.max(p).alias("most"), F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"),
        F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"), F.countDistinct(p).alias("n_distinct"),
    )


def calibration_error(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """ece: over quantile bins with equal edges merged; with fewer than two edges the difference of the means.

    The edges are exact quantiles of the whole table, found in a few passes of fixed memory before the plan is made.
    """
    edges = sorted(set(exact_quantiles(df, p, [i / bins for i in range(bins + 1)])))
    x = df.select(F.col(p).cast("double").alias("__p"), F.col(label).cast("double").alias("__y"))
    at = sum((F.when(F.col("__p") >= e, 1).otherwise(0) for e in edges), F.lit(-1))
    x = x.withColumn("__b", F.greatest(F.lit(0), F.least(at, F.lit(len(edges) - 2))))
    g = x.groupBy("__b").agg(F.count("*").alias("n"), F.avg("__p").alias("mp"), F.avg("__y").alias("my"))
    return g.agg((F.sum(F.abs(F.col("mp") - F.col("my")) * F.col("n")) / F.sum("n")).alias("ece"))


def between_groups(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """group, mean_score, prevalence, n."""
    return df.groupBy(group).agg(F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("prevalence"), F.count("*").alias("n"))


def average_rank(column: str) -> Column:
    """Average rank over a table of one row for each group (a single window: group tables are small)."""
    return F.rank().over(W.orderBy(column)) + (F.count("*").over(W.partitionBy(column)) - 1) / 2


def group_agreement(groups: DataFrame) -> DataFrame:
    """pearson, spearman and slope between mean score and prevalence of groups."""
    r = groups.withColumn("__a", average_rank("mean_score")).withColumn("__b", average_rank("prevalence"))
    return r.agg(F.corr("mean_score", "prevalence").alias("pearson"), F.corr("__a", "__b").alias("spearman"), F.regr_slope("prevalence", "mean_score").alias("slope"))


def class_balance(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """by, n, pos, prevalence, ratio (negatives to a positive; null without one)."""
    g = df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    return g.withColumn("prevalence", F.col("pos") / F.col("n")).withColumn("ratio", F.when(F.col("pos") > 0, (F.col("n") - F.col("pos")) / F.col("pos")))


def evaluable(df: DataFrame, group: str, label: str) -> DataFrame:
    """groups, zero_positive, evaluable: how many groups have no positive, and how many can be evaluated."""
    g = class_balance(df, label, [group])
    return g.agg(F.count("*").alias("groups"), F.count_if(F.col("pos") == 0).alias("zero_positive"), F.count_if(F.col("pos") > 0).alias("evaluable"))


def inflation_gap(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """pooled_roc, within_roc, gap: what the pooled figure owes to differences between groups, against z-scores within them."""
    z = within_z(df, group, score, "__z").select(F.round("__z", 9).alias("__z"), label)
    both = roc_auc(df, score, label).select(F.col("roc").alias("pooled_roc")).crossJoin(F.broadcast(roc_auc(z, "__z", label).select(F.col("roc").alias("within_roc"))))
    return both.withColumn("gap", F.col("pooled_roc") - F.col("within_roc"))


def sensitivity(df: DataFrame, group: str, score: str, label: str, without: dict[str, list]) -> DataFrame:
    """variant, n, pos, roc, pr: the pooled figures of all rows, without groups that have no positive, and without each list of groups.

    Every row is dealt to the variants that it belongs to, and all variants are computed as groups at once.
    """
    pos = df.groupBy(group).agg(F.max(F.col(label).cast("int")).alias("__any"))
    names = [F.lit("all"), F.when(F.col("__any") == 1, "with positives"), *[F.when(~F.col(group).isin(*v), name) for name, v in without.items()]]
    x = df.join(pos, group).select(score, label, F.explode(F.array_compact(F.array(*names))).alias("variant"))
    return fold_metrics(x, "variant", score, label).select("variant", "n", "pos", "roc", "pr")


def calibration_effect(df: DataFrame, group: str, raw: str, calibrated: str, label: str) -> DataFrame:
    """folds, max_roc_change, max_pr_change, up, down, mean_spearman: what calibration does to the figures of the folds and their order."""
    a, b = (fold_metrics(df, group, c, label).select(group, F.col("roc").alias(f"roc_{n}"), F.col("pr").alias(f"pr_{n}")) for n, c in (("a", raw), ("b", calibrated)))
    d, e = F.col("roc_b") - F.col("roc_a"), F.col("pr_b") - F.col("pr_a")
    folds = a.join(b, group).where("roc_a is not null").agg(F.count("*").alias("folds"), F.max(F.abs(d)).alias("max_roc_change"), F.max(F.abs(e)).alias("max_pr_change"), F.count_if(d > 1e-9).alias("up"), F.count_if(d < -1e-9).alias("down"))
    means = df.groupBy(group).agg(F.avg(raw).alias("__x"), F.avg(calibrated).alias("__y")).withColumn("__a", average_rank("__x")).withColumn("__b", average_rank("__y"))
    return folds.crossJoin(F.broadcast(means.agg(F.corr("__a", "__b").alias("mean_spearman"))))
