"""Leave-one-group-out evaluation of labelled texts: scores by models that haven't seen the group, and figures for each group.

    python -m jobs.evaluate --documents s3a://bucket/documents --labels s3a://bucket/labels --output s3a://bucket/report

Features are made of the texts by column functions. Each group's model is solved from sums over all other groups, in one plan.
What is written, each run in place of the last one, the same for the same input:

- ``scores/<group>=...``: key, label and score of each labelled text;
- ``folds``: rows, positives, prevalence, ROC and PR areas and Brier score of each group;
- ``bins``: rows, mean score and share of positives by bins of the score, over all groups;
- ``summary``: medians over the groups and the pooled figures, one row.

Texts without label, or without group (null or empty), are left out, as are groups that the others determine no model for; a null text is an
empty one; rows that repeat count as often as they are there. Input without labelled texts gives empty tables, and a summary of
no folds.
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.operators import evaluation, learning

log = logging.getLogger("jobs.evaluate")
CONFIG = os.path.join(os.path.dirname(__file__), "evaluate.json")
FEATURES = ("log_chars", "blank_share")


def configuration(path: str | None = None) -> dict:
    with open(path or CONFIG) as f:
        return json.load(f)


def features(text: str) -> dict[str, F.Column]:
    """Logarithm of the characters, and the share of blanks among them."""
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.char_length(body)
    return {"log_chars": F.log(n + F.lit(1.0)), "blank_share": (n - F.char_length(F.translate(body, " \n\t", ""))) / (n + F.lit(1.0))}


def scored(documents: DataFrame, labels: DataFrame, config: dict) -> DataFrame:
    """key, group, label, score (rounded to nine digits, so that equal texts have equal scores whatever the order of sums)."""
    key, group, label = config["key"], config["group"], config["label"]
    x = documents.where(F.col(group).cast("string") != "").select(key, group, *[c.alias(n) for n, c in features(config["text"]).items()])
    rows = x.join(labels.where(F.col(label).isNotNull()).select(key, F.col(label).cast("int").alias(label)), key)
    out = learning.out_of_group_linear(rows, group, list(FEATURES), label)
    return out.where("score is not null").select(key, group, label, F.round("score", 9).alias("score"))


def figures(scores: DataFrame, config: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Folds, bins and summary of a table of scores."""
    group, label, n = config["group"], config["label"], config["bins"]
    p, y = F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)), F.col(label).cast("double")
    brier = scores.groupBy(group).agg(F.avg((p - y) * (p - y)).alias("brier"))
    folds = evaluation.fold_metrics(scores, group, "score", label).join(brier, group)
    bins = scores.groupBy(F.least(F.floor(p * n), F.lit(n - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_score"), F.avg(y).alias("positive_share"))
    pooled = evaluation.pooled_metrics(scores, "score", label).select("n", "pos", F.col("roc").alias("pooled_roc"), F.col("pr").alias("pooled_pr"))
    return folds, bins, evaluation.fold_summary(folds).crossJoin(F.broadcast(pooled))  # one row each


def run(spark: SparkSession, documents: str, labels: str, output: str, config: dict | None = None) -> None:
    """Read both tables, write scores and figures in place of those of an earlier run."""
    config = config or configuration()
    d, t = spark.read.parquet(documents), spark.read.parquet(labels)
    log.info("read %s and %s", documents, labels)
    scored(d, t, config).write.mode("overwrite").partitionBy(config["group"]).parquet(f"{output}/scores")
    schema = f"{config['key']} {dict(d.dtypes)[config['key']]}, {config['label']} int, score double, {config['group']} {dict(d.dtypes)[config['group']]}"
    scores = spark.read.schema(schema).parquet(f"{output}/scores")
    for name, table in zip(("folds", "bins", "summary"), figures(scores, config), strict=True):
        table.write.mode("overwrite").parquet(f"{output}/{name}")
    log.info("wrote %d scores of %d groups to %s", scores.count(), spark.read.parquet(f"{output}/folds").count(), output)


def main() -> None:
    p = argparse.ArgumentParser(description="Score labelled texts by models of other groups, and evaluate the scores.")
    for name in ("documents", "labels", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config")
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("evaluate").getOrCreate()
    try:
        run(spark, a.documents, a.labels, a.output, configuration(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
