"""Classifiers over feature tables: final fits, and scores of each group by a model that hasn't seen it."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import trees

# The parameters of the boosted trees, and what a positive row counts beside a negative one.
TREES, DEPTH, RATE, ROWS, COLUMNS, LEAST_CHILD, POSITIVE, SEED = 100, 6, 0.05, 0.75, 0.9, 20, 20.0, 42


def boosted_trees(number: int = TREES):
    """Spark's boosted trees with the fixed parameters; they grow by level, so leaves aren't limited beside the depth (``trees.fit`` limits them)."""
    return GBTClassifier(
        maxIter=number, maxDepth=DEPTH, stepSize=RATE, subsamplingRate=ROWS, featureSubsetStrategy=str(COLUMNS),
        minInstancesPerNode=LEAST_CHILD, seed=SEED, weightCol="__weight", labelCol="__label", featuresCol="__features",
    )


def random_forest(number: int = TREES, depth: int = DEPTH):
    return RandomForestClassifier(numTrees=number, maxDepth=depth, seed=SEED, weightCol="__weight", labelCol="__label", featuresCol="__features")


def fit(df: DataFrame, features: list[str], label: str, learner=None, positive: float = POSITIVE) -> PipelineModel:
    """A model of all rows whose label isn't null; a null feature is an error, nothing is filled in."""
    rows = df.where(F.col(label).isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("__label"))
    rows = rows.withColumn("__weight", F.when(F.col("__label") == 1, F.lit(positive)).otherwise(F.lit(1.0)))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__features"), learner or boosted_trees()]).fit(rows)


def score(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """Adds the probability of the positive class."""
    p = model.transform(df)
    return p.select(*df.columns, vector_to_array("probability")[1].alias(out))


def out_of_group(df: DataFrame, group: str, features: list[str], label: str, parameters: trees.Boosting | None = None, out: str = "score", bins: int = 255) -> DataFrame:
    """Scores of each group by boosted trees of all other groups, all models in one plan; rows of a null group have none.

    The list of groups and their models are what the driver holds. Where a linear model will do, ``out_of_group_linear`` needs
    neither.
    """
    models = _models(df, group, features, label, parameters, bins)
    if not models:
        return df.where(F.lit(False)).withColumn(out, F.lit(None).cast("double"))
    return trees.out_of_fold(df, models, group, tuple(df.columns)).select(*df.columns, F.col("score").alias(out))


def _models(df: DataFrame, group: str, features: list[str], label: str, parameters: trees.Boosting | None, bins: int) -> list[trees.Model]:
    each = trees.left_out(df, group, parameters or trees.Boosting("", positive=POSITIVE))
    return trees.fit(df, features, label, each, group, bins) if each else []


def importances(spark, models: dict[str, PipelineModel], features: list[str]) -> DataFrame:
    """model, feature, importance (they add up to 1 for each model) of fitted trees; models and features are what the driver holds anyway."""
    rows = [(name, f, float(v)) for name, m in models.items() for f, v in zip(features, m.stages[-1].featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def mean_importances(each: DataFrame) -> DataFrame:
    """feature, mean, sd (of the population), models: importances of each feature over all models, as by folds."""
    return each.groupBy("feature").agg(F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("sd"), F.count("importance").alias("models"))


def out_of_group_importances(df: DataFrame, group: str, features: list[str], label: str, parameters: trees.Boosting | None = None, bins: int = 255) -> DataFrame:
    """Mean importances over the models that ``out_of_group`` fits, one for each group left out."""
    return mean_importances(trees.importances(df.sparkSession, _models(df, group, features, label, parameters, bins)))


def out_of_group_linear(df: DataFrame, group: str, features: list[str], label: str, ridge: float = 0.0, out: str = "score") -> DataFrame:
    """Adds the least-squares score of each row by the rows of all other groups, in one plan.

    Each group is summed up by its moments, of which there are as many as pairs of features; a group's model is solved from
    the sums over all groups less its own. Rows with a null among group, features and label teach nothing; the score is null
    for a null feature, and where the other groups don't determine a model.
    """
    cols = ["__one", *features, "__y"]
    known = df.select(group, F.lit(1.0).alias("__one"), *[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("__y")).dropna()
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    own = known.groupBy(group).agg(*[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"__m{k}") for k, (i, j) in enumerate(pairs)])
    total = own.agg(*[F.sum(f"__m{k}").alias(f"__t{k}") for k in range(len(pairs))])  # one row
    less = own.crossJoin(F.broadcast(total)).select(group, F.array(*[F.col(f"__t{k}") - F.col(f"__m{k}") for k in range(len(pairs))]).alias("m"))
    n = len(cols)
    kind = own.schema[group].dataType.simpleString()

    def solve(frames):
        for f in frames:
            made = []
            for m in f["m"]:
                a = np.zeros((n, n))
                for v, (i, j) in zip(m, pairs, strict=True):
                    a[i, j] = a[j, i] = v
                x = a[:-1, :-1] + ridge * np.diag([0.0] + [1.0] * (n - 2))
                whole = np.linalg.matrix_rank(x) == n - 1
                made.append(np.linalg.solve(x, a[:-1, -1]).tolist() if whole else None)
            f["__w"] = made
            yield f[[group, "__w"]]

    w = less.mapInPandas(solve, f"`{group}` {kind}, __w array<double>")
    z = F.col("__w")[0]
    for k, c in enumerate(features):
        z = z + F.col("__w")[k + 1] * F.col(c)
    return df.join(w, group, "left").withColumn(out, z).drop("__w")


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """group, fold: groups dealt to k folds by size, largest first, back and forth, so that folds have about as many rows."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    r = F.row_number().over(W.orderBy(F.desc("n"), group)) - 1  # a table of groups
    turn, at = F.floor(r / k), r % k
    return sizes.select(group, F.when(turn % 2 == 0, at).otherwise(k - 1 - at).cast("int").alias("fold"))
