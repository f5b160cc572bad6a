"""Tables as CSV, and summaries as JSON, that are the same on every run: fixed columns, order and line ends, no time."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def formatted(df: DataFrame, decimals: dict[str, int]) -> DataFrame:
    """Columns as text with so many decimals; null stays null."""
    return df.select(*[F.when(F.col(c).isNotNull(), F.format_string(f"%.{decimals[c]}f", F.col(c).cast("double"))).alias(c) if c in decimals else F.col(c) for c in df.columns])


def csv(df: DataFrame, path: str, columns: list[str], order: list[str], decimals: dict[str, int] | None = None, files: int | None = 1) -> None:
    """Rows in order as CSV with a header and bare line feeds.

    One file by default, as for reports. With ``files`` None rows are sorted by range over as many files as Spark makes, whose
    names are in order, for tables that one task shouldn't write.
    """
    out = df.select(*columns).orderBy(*order)
    out = formatted(out.coalesce(files) if files else out, decimals or {})
    out.write.option("lineSep", "\n").option("nullValue", "").option("emptyValue", "").csv(path, header=True)


def lines(df: DataFrame, columns: list[str], order: list[str], most: int = 10_000) -> list[str]:
    """The header and up to ``most`` rows as CSV lines, for a terminal."""
    rows = df.select(*columns).orderBy(*order).limit(most).select(F.to_csv(F.struct(*columns)).alias("line")).collect()
    return [",".join(columns), *[r.line for r in rows]]


def key_values(df: DataFrame, path: str, key: str, value: str) -> None:
    """Two columns, most first, then by key."""
    df.select(key, value).orderBy(F.desc(value), key).coalesce(1).write.option("lineSep", "\n").csv(path, header=True)


def documents(df: DataFrame, key: str, parts: dict[str, list[str]] | None = None) -> DataFrame:
    """key, document: a JSON text for each row; ``parts`` puts columns into nested objects."""
    parts = parts or {}
    inner = {c for cs in parts.values() for c in cs}
    cols = [F.col(c) for c in df.columns if c not in inner] + [F.struct(*cs).alias(n) for n, cs in parts.items()]
    return df.select(key, F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("document"))


def summary(df: DataFrame, key: str, most: int = 10_000) -> str:
    """One JSON document of a small table (one row for each protein or run): its rows by key, with sorted names."""
    rows = df.orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a summary holds {most} rows; write documents instead")
    return json.dumps([r.asDict(recursive=True) for r in rows], indent=2, sort_keys=True, default=str) + "\n"


def provenance(spark: SparkSession, metrics: dict, rows: int, **more) -> dict:
    """What is said beside a model: its figures, how many rows it was made from, and the versions that made it."""
    import platform

    return {"environment": {"spark": spark.version, "python": platform.python_version(), "system": platform.system()}, "metrics": metrics, "rows": rows, **more}


def model(pipeline, path: str, about: dict) -> None:
    """A fitted pipeline, and beside it what it was made from, as sorted JSON."""
    pipeline.write().overwrite().save(path + "/model")
    SparkSession.getActiveSession().createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path + "/about")


def read_model(spark, path: str, wanted: list[str]):
    """The pipeline and what is said about it; an error unless its features are the wanted ones in their order."""
    from pyspark.ml import PipelineModel

    from ..operators.scoring import contract

    about = json.loads(spark.read.text(path + "/about", wholetext=True).first()[0])
    if broken := contract(about["features"], wanted):
        raise ValueError("; ".join(broken))
    return PipelineModel.load(path + "/model"), about
