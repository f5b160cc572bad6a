"""Incremental intake of texts: a manifest of what was delivered, with checksums and what is wrong with it.

    python -m jobs.intake --input s3a://bucket/documents --output s3a://bucket/intake [--config jobs/intake.json]

New files of the input are read as a stream that ends when it has taken all there is; its checkpoint knows the files that were
taken. Each text gets its SHA-256, its size and the rules that it breaks, and is ``accepted``, ``rejected`` or a ``duplicate``
of a text accepted before (in an earlier batch, or in this one under a smaller key). What is written:

- ``manifest/batch=.../status=...``: key, partition column, bytes, sha256, copies, notes; a batch overwrites its own partitions
  only, so a batch that is run again after a failure leaves the same rows;
- ``counts/batch=...``: rows and bytes by partition value and status, from which ``report`` adds up the whole table.

Null texts and blank required columns are broken rules; a row that is repeated whole counts as copies of one row; equal texts
under several keys are one accepted row and duplicates; a null key stays a row. An empty input writes no rows.
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.operators import gates, manifest

log = logging.getLogger("jobs.intake")
CONFIG = os.path.join(os.path.dirname(__file__), "intake.json")
STATUSES = ("accepted", "duplicate", "rejected")


def configuration(path: str | None = None) -> dict:
    with open(path or CONFIG) as f:
        return json.load(f)


def judged(rows: DataFrame, config: dict) -> DataFrame:
    """One row for each different row: key, partition, bytes, sha256, copies, notes (what it breaks; empty if nothing)."""
    key, text, part = config["key"], config["text"], config["partition"]
    rules = {f"{c} blank": F.col(c).isNull() | F.lower(F.trim(F.col(c).cast("string"))).isin(*gates.BLANK) for c in config["required"]}
    rules |= {n: c for n, c in manifest.hygiene(F.col(text)).items() if n in config["rules"]}
    broken = F.concat_ws("; ", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))
    body = F.coalesce(F.col(text), F.lit(""))
    each = rows.select(F.col(key), F.col(part), F.octet_length(body).cast("long").alias("bytes"), F.sha2(body.cast("binary"), 256).alias("sha256"), broken.alias("notes"))
    return each.groupBy(*each.columns).agg(F.count("*").alias("copies"))


def settled(rows: DataFrame, earlier: DataFrame | None, config: dict) -> DataFrame:
    """Adds status: duplicates are of texts that earlier batches accepted, or of the least key of this one (nulls last)."""
    key = config["key"]
    clean = rows.where("notes = ''")
    order = F.struct(F.col(key).isNull().alias("absent"), F.col(key).alias("key"), F.coalesce(F.col(config["partition"]).cast("string"), F.lit("")).alias("part"))
    first = clean.groupBy("sha256").agg(F.min(order).alias("_first"))
    if earlier is not None:
        first = first.join(earlier.where("status = 'accepted'").select("sha256").distinct(), "sha256", "left_anti")
    j = rows.join(first.withColumnRenamed("sha256", "_sha"), (F.col("sha256") == F.col("_sha")) & (F.col("notes") == ""), "left")
    status = F.when(F.col("notes") != "", "rejected").when(F.coalesce(F.col("_first") == order, F.lit(False)), "accepted").otherwise("duplicate")
    return j.select(*rows.columns, status.alias("status"))


def _counts(spark: SparkSession, output: str, config: dict) -> DataFrame:
    return spark.read.schema(f"{config['partition']} string, status string, rows long, bytes long, batch long").parquet(f"{output}/counts")


def take(batch: DataFrame, number: int, output: str, config: dict) -> None:
    """Write the manifest and the counts of one batch, in place of what an earlier attempt at it has left."""
    spark, kind = batch.sparkSession, dict(batch.dtypes)
    earlier = spark.read.schema("sha256 string, batch long, status string").parquet(f"{output}/manifest").where(F.col("batch") < number) if number else None
    done = settled(judged(batch, config), earlier, config).withColumn("batch", F.lit(number).cast("long"))
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "status").parquet(f"{output}/manifest")
    written = read(spark, output, *[f"{config[c]} {kind[config[c]]}" for c in ("key", "partition")]).where(F.col("batch") == number)
    counts = written.groupBy(F.col(config["partition"]).cast("string").alias(config["partition"]), "status").agg(F.sum("copies").alias("rows"), F.sum(F.col("copies") * F.col("bytes")).alias("bytes")).withColumn("batch", F.lit(number).cast("long"))
    counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/counts")
    for r in _counts(spark, output, config).where(F.col("batch") == number).groupBy("status").agg(F.sum("rows").alias("n"), F.sum("bytes").alias("b")).orderBy("status").collect():
        log.info("batch %d: %s rows %s, %s bytes", number, r.n, r.status, r.b)


def run(spark: SparkSession, source: str, output: str, config: dict | None = None, checkpoint: str | None = None) -> None:
    """Take what is new in ``source`` (a Parquet folder or file) into ``output``; returns when the stream has ended."""
    config = config or configuration()
    log.info("reading new files of %s", source)
    columns = dict.fromkeys([config["key"], config["text"], config["partition"], *config["required"]])
    reader = spark.readStream.schema(spark.read.parquet(source).schema)
    if config.get("files_at_a_time"):
        reader = reader.option("maxFilesPerTrigger", config["files_at_a_time"])
    folder, name = source.rstrip("/").rsplit("/", 1)
    stream = reader.parquet(f"{folder}/{{{name}}}").select(*columns)  # as a pattern of one name, which may be a file too
    query = stream.writeStream.foreachBatch(lambda b, n: take(b, n, output, config)).option("checkpointLocation", checkpoint or f"{output}/_checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("took %s rows into %s", sum(p["numInputRows"] for p in query.recentProgress), output)


def read(spark: SparkSession, output: str, key: str = "doc_id long", part: str = "source string") -> DataFrame:
    """The manifest as it stands; the key and the partition column by name and type."""
    return spark.read.schema(f"{key}, {part}, bytes long, sha256 string, notes string, copies long, batch long, status string").parquet(f"{output}/manifest")


def report(spark: SparkSession, output: str, config: dict | None = None) -> DataFrame:
    """Rows and bytes of all batches by partition value and status."""
    config = config or configuration()
    return _counts(spark, output, config).groupBy(config["partition"], "status").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


def main() -> None:
    p = argparse.ArgumentParser(description="Take new texts into a manifest with checksums and rules.")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--checkpoint")
    p.add_argument("--config")
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("intake").getOrCreate()
    try:
        config = configuration(a.config)
        run(spark, a.input, a.output, config, a.checkpoint)
        for r in report(spark, a.output, config).groupBy("status").agg(F.sum("rows").alias("n")).orderBy("status").collect():
            log.info("in all: %s rows %s", r.n, r.status)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
