"""From a training table to a written model: gate, scores of groups left out, figures, calibrator and final fit in one run."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import residues as R
from ..sinks import tables as K
from ..sinks.kept import kept
from . import calibration as C
from . import evaluation as E
from . import gates as G
from . import scoring as P
from . import trees as B


class Rejected(ValueError):
    """The table, or what came of it, breaks a rule; nothing is written."""


def figures(scores: DataFrame, group: str, label: str) -> dict[str, float | int]:
    """All figures of a table of scores(group, score, label) by name: one row from each operator."""
    one = lambda df: df.first().asDict()
    folds = E.fold_metrics(scores, group, "score", label)
    out = one(E.evaluable(scores, group, label)) | one(E.fold_summary(folds)) | {f"pooled_{k}": v for k, v in one(E.pooled_metrics(scores, "score", label)).items()}
    ranks = E.within_rank(scores, group, "score", "r").select(F.round("r", 9).alias("r"), label)
    out |= one(E.inflation_gap(scores, group, "score", label)) | {"within_rank_roc": E.roc_auc(ranks, "r", label).first().roc}
    out |= one(E.probability_metrics(scores, "score", label)) | one(E.calibration_error(scores, "score", label)) | one(E.group_agreement(E.between_groups(scores, group, "score", label)))
    return out


def train(df: DataFrame, group: str, position: str, features: list[str], label: str, parameters: B.Boosting, rules: dict | None = None, recorded: dict | None = None, method: str = "sigmoid", path: str | None = None, bins: int = 255, tolerance: float = 1e-9) -> dict:
    """Train, evaluate, calibrate and (with a path) write; what is said of the model is returned, and stands beside it.

    Raises Rejected before anything is written: for rows that break a rule (``gates.training_rules`` or others), features that are
    missing or hold earlier results, a place that a group has twice, labels of one kind only, scores that aren't those of each row,
    and figures that differ from ``recorded`` ones by more than the tolerance. (group, position) tells rows apart.
    """
    spark = df.sparkSession
    if bad := G.leaks(df.columns, features):
        raise Rejected("features: " + ", ".join(bad))
    good, broken = G.training_gate(df, [group, position], rules or {})
    if n := broken.count():
        each = broken.select(F.explode("broken").alias("rule")).groupBy("rule").count().orderBy("rule").collect()  # one row for each rule
        raise Rejected(f"{n} rows: " + ", ".join(f"{r.rule} {r['count']}" for r in each))
    if twice := good.groupBy(group, position).count().where("count > 1").count():
        raise Rejected(f"{twice} places are there more than once")
    kinds = {r[0] for r in good.select(F.col(label).cast("int")).distinct().collect()}
    if kinds != {0, 1}:
        raise Rejected(f"labels are {sorted(kinds, key=str)}, not 0 and 1")
    keys = (group, position)
    models = B.fit(good, features, label, [*B.left_out(good, group, parameters), replace(parameters, name="final")], group, bins, keys=keys)
    scores = kept(B.out_of_fold(good, models[:-1], group, keys).drop("model").join(good.select(group, position, F.col(label).cast("int").alias(label)), [group, position]), "scores")
    rows = good.count()
    if scores.count() != rows or scores.where("score is null or score < 0 or score > 1").count():
        raise Rejected("not each row has one score between 0 and 1")
    found = figures(scores, group, label)
    for name, value in (recorded or {}).items():
        have = found.get(name)
        if have is None or (have != value if isinstance(value, int) else abs(have - value) > tolerance):
            raise Rejected(f"{name}: {have!r}, recorded {value!r}")
    if method == "sigmoid":
        slope, offset = C.fit_platt(scores, "score", label)
        calibrator = {"method": "sigmoid", "slope": slope, "intercept": offset}
    else:
        xs, ys = C.fit_isotonic(scores, "score", label)
        calibrator = {"method": "isotonic", "x": xs, "y": ys}
    digest = P.ordered_digest(scores.withColumn("__at", place(group, position)), "__at", F.round(F.col("score") * 1e9).cast("long")).first()
    about = K.provenance(spark, found, rows, features=features, calibrator=calibrator, group=group, scores_sha256=digest.sha256)
    if path:
        B.save(spark, models[-1:], path, about)
    return about


def place(group: str, position: str) -> Column:
    """A number by which (group, position) can be put in one order that depends on them alone."""
    return F.xxhash64(F.col(group).cast("string"), F.col(position).cast("long"))


def residue_rules(group: str, position: str, features: list[str], label: str) -> dict:
    """The rules of a training table of residues with letter and class: keys, labels, finite features, and the class that the letter asks for."""
    return G.training_rules(group, position, "letter", "class", label, features, {}, R.residue_class(F.col("letter")))
