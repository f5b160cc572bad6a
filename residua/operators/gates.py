"""Gates that a table must pass before it is used: each gives the rows that break it, so an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands for nothing in a required text.
BLANK = ("", "nan", "na", "none")


def blank_tokens(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column: required texts that are null or only stand for nothing, in one pass."""
    broken = [F.when(F.col(c).isNull() | F.lower(F.trim(F.col(c).cast("string"))).isin(*BLANK), F.lit(c)) for c in columns]
    return df.select(key, F.explode(F.array_compact(F.array(*broken))).alias("column"))


def broken_rules(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """keys, rule: each rule that a row breaks; a rule that is null of a row is broken, since what isn't known didn't pass."""
    broken = [F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in rules.items()]
    return df.select(*keys, F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def training_rules(group: str, position: str, letter: str, kind: str, label: str, numbers: list[str], ranges: dict[str, tuple[float, float]], expected: Column) -> dict[str, Column]:
    """Rules of one row of a training table; ``expected`` is the class that the letter asks for."""
    rules = {"label": ~F.col(label).isin(0, 1), "class": F.col(kind) != expected, "key": F.col(group).isNull() | F.col(position).isNull() | F.col(letter).isNull()}
    for c in numbers:
        rules[f"finite_{c}"] = F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    for c, (low, high) in ranges.items():
        rules[f"range_{c}"] = ~F.col(c).between(low, high)
    return rules


def numbering(df: DataFrame, group: str, position: str) -> DataFrame:
    """group, rows, rule: groups whose positions aren't 1 to the number of their rows, each once."""
    g = df.groupBy(group).agg(F.count("*").alias("rows"), F.min(position).alias("lo"), F.max(position).alias("hi"), F.countDistinct(position).alias("kinds"))
    rule = F.when(F.col("kinds") < F.col("rows"), "repeated").when((F.col("lo") != 1) | (F.col("hi") != F.col("rows")), "gap")
    return g.select(group, "rows", rule.alias("rule")).where("rule is not null")


def leaks(columns: list[str], features: list[str], prefix: str = "oof_") -> list[str]:
    """Features that are missing, or hold results of earlier models."""
    return [c for c in features if c not in columns or c.startswith(prefix)]


def metric_gate(found: DataFrame, wanted: DataFrame, key: str, tolerance: float = 1e-9) -> DataFrame:
    """key, metric, found, wanted: where one row's figures differ: integers at all, others by more than the tolerance."""
    made = [(c, t) for c, t in wanted.dtypes if c != key]
    f, w = found.alias("f"), wanted.alias("w")
    differs = lambda c, t: (~F.col(f"f.{c}").eqNullSafe(F.col(f"w.{c}"))) if t not in ("double", "float") else F.coalesce(F.abs(F.col(f"f.{c}") - F.col(f"w.{c}")) > tolerance, ~F.col(f"f.{c}").eqNullSafe(F.col(f"w.{c}")))
    each = [F.when(differs(c, t), F.struct(F.lit(c).alias("metric"), F.col(f"f.{c}").cast("double").alias("found"), F.col(f"w.{c}").cast("double").alias("wanted"))) for c, t in made]
    both = f.join(w, F.col(f"f.{key}") == F.col(f"w.{key}"), "full")
    return both.select(F.coalesce(f"f.{key}", f"w.{key}").alias(key), F.inline(F.array_compact(F.array(*each))))


def rows_conserved(out: DataFrame, expected: DataFrame, group: str, n: str) -> DataFrame:
    """group, rows, expected: groups that have other numbers of rows than was announced."""
    have = out.groupBy(group).agg(F.count("*").alias("rows"))
    j = have.join(expected.select(group, F.col(n).alias("expected")), group, "full")
    return j.select(group, F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("expected", F.lit(0)).cast("long").alias("expected")).where("rows <> expected")


def square(matrix: DataFrame, group: str, sizes: DataFrame, size: str) -> DataFrame:
    """group, rule: matrices of cells (i, j from 1, value) that aren't whole squares of the size, or have values under 0 or not finite."""
    v = F.col("value")
    bad = v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf"))
    g = matrix.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct("i", "j").alias("kinds"), F.max(F.greatest("i", "j")).alias("hi"), F.min(F.least("i", "j")).alias("lo"), F.count_if(bad).alias("bad"))
    j = sizes.select(group, F.col(size).cast("long").alias("size")).join(g, group, "full")
    rule = F.when(F.col("n").isNull(), "missing").when(F.col("size").isNull(), "extra")
    rule = rule.when((F.col("n") != F.col("size") * F.col("size")) | (F.col("kinds") != F.col("n")) | (F.col("lo") != 1) | (F.col("hi") != F.col("size")), "shape").when(F.col("bad") > 0, "value")
    return j.select(group, rule.alias("rule")).where("rule is not null")


def training_gate(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, rows that don't with ``broken``, the rules each breaks) of a training table, in one pass each.

    A rule that is null of a row is broken. A null among the keys goes to the broken rows like any other.
    """
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))
    told = df.withColumn("broken", broken)
    return told.where(F.size("broken") == 0).drop("broken"), told.where(F.size("broken") > 0).select(*keys, "broken")
