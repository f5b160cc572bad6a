"""Data-quality rules: what breaks them is reported as rows; nothing is repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, entity: str, key: str, rules: dict[str, Column]) -> DataFrame:
    """entity, id, rule: a row for each rule that a row breaks, in one pass. A condition that is null isn't broken."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return df.select(F.lit(entity).alias("entity"), F.col(key).cast("string").alias("id"), F.explode(broken).alias("rule"))


def contiguity(df: DataFrame, group: str, pos: str, first: int = 1) -> DataFrame:
    """group, n, contiguous: whether positions are first, first + 1, ... without gap or repetition."""
    ok = (F.min(pos) == first) & (F.max(pos) == F.count("*") - 1 + first) & (F.countDistinct(pos) == F.count("*"))
    return df.groupBy(group).agg(F.count("*").alias("n"), ok.alias("contiguous"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def key_difference(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """key, side: keys that are missing from got, or extra in it."""
    a, b = expected.select(key).distinct(), got.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def interval_label(df: DataFrame, intervals: DataFrame, keys: list[str], other: list[str], at: str, start: str, stop: str, row: str) -> DataFrame:
    """row, label: 1 where the row's place, a whole number, lies in an interval of its key (bounds included), else 0.

    An interval is dealt to the cells of the least power of two that is as long as it is, of which it touches two at most; a place
    lies in one cell of each power that occurs. The join is by key, power and cell, so a key with many rows and many
    intervals is no square and isn't one task. Intervals that end before they begin, or have a null, hold nothing.
    """
    i = intervals.select(*[F.col(c).alias(f"__k{n}") for n, c in enumerate(other)], F.col(start).cast("long").alias("__a"), F.col(stop).cast("long").alias("__b")).where("__a <= __b").distinct()
    i = i.withColumn("__p", F.ceil(F.log2((F.col("__b") - F.col("__a") + 1).cast("double"))).cast("int"))
    powers = [r[0] for r in i.select("__p").distinct().orderBy("__p").collect()]  # 64 at most
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("__p"))).cast("long")
    i = i.select("*", F.explode(F.array_distinct(F.array(cell("__a"), cell("__b")))).alias("__c"))
    x = df.select(row, *[F.col(c).alias(f"__x{n}") for n, c in enumerate(keys)], F.col(at).cast("long").alias("__at"))
    p = x.withColumn("__q", F.explode(F.array(*[F.lit(v) for v in powers]) if powers else F.expr("cast(array() as array<int>)"))).withColumn("__d", F.floor(F.col("__at") / F.pow(F.lit(2.0), F.col("__q"))).cast("long"))
    on = [F.col(f"__x{n}") == F.col(f"__k{n}") for n in range(len(keys))] + [F.col("__q") == F.col("__p"), F.col("__d") == F.col("__c"), F.col("__at").between(F.col("__a"), F.col("__b"))]
    hit = p.join(i, on, "left_semi").select(row).distinct().withColumn("__hit", F.lit(1))
    return x.select(row).distinct().join(hit, row, "left").select(row, F.coalesce("__hit", F.lit(0)).alias("label"))


def near(means: DataFrame, told: DataFrame, key: str, mean: str, value: str, most: float) -> DataFrame:
    """key, mean, diff, near: whether our figure is within ``most`` of the one that a record tells."""
    d = F.abs(F.col(mean) - F.col(value))
    return means.join(told, key).select(key, mean, d.alias("diff"), (d <= most).alias("near"))


def counts(df: DataFrame, category: str, total: str = "all") -> DataFrame:
    """category, n: rows of each category, and of all."""
    g = df.groupBy(category).agg(F.count("*").alias("n"))
    return g.unionByName(g.agg(F.lit(total).alias(category), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))
