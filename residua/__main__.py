"""Command line: ``python -m residua`` score, export, validate or describe.

- ``score``: a feature table, or structure and matrix files, scored with a written model;
- ``export``: a training table gated, scored by groups left out, calibrated and written as a model;
- ``validate``: structure and matrix files held against a manifest and records;
- ``describe``: sequences of FASTA files, a sequence that is written out, or chains of structure files.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import description, export, extraction, scoring, trees
from .sinks import tables
from .sources import documents, structures

COLUMNS = ["grp", "pos", "letter", "probability_raw", "probability_calibrated", "predicted"]
MANIFEST = "protein string, structure string, matrix string, structure_sha256 string, matrix_sha256 string, accession string, entry string, version int, length int"


def _share(text: str) -> float:
    x = float(text)
    if not 0 <= x <= 1:
        raise argparse.ArgumentTypeError("it lies between 0 and 1")
    return x


def _positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("it is 1 at least")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="residua")
    commands = p.add_subparsers(dest="command", required=True)
    s = commands.add_parser("score", help="score a Parquet feature table (grp, pos, letter and the model's features) or structure files")
    given = s.add_mutually_exclusive_group(required=True)
    given.add_argument("--features")
    given.add_argument("--structures", help="a folder of structure files, scored with the matrix files beside them")
    s.add_argument("--matrices", help="the folder of the matrix files, if another")
    s.add_argument("--model", required=True)
    s.add_argument("--threshold", type=_share, default=0.5)
    s.add_argument("--top", type=_positive, help="print the rows of the highest probability as CSV")
    s.add_argument("--out", help="write all rows as CSV to this folder")
    e = commands.add_parser("export", help="train on a Parquet table (grp, pos, letter, class, label and features) and write the model")
    e.add_argument("--table", required=True)
    e.add_argument("--features", required=True, help="columns, with commas between them, in the model's order")
    e.add_argument("--label", default="y")
    e.add_argument("--model", required=True)
    e.add_argument("--method", choices=("sigmoid", "isotonic"), default="sigmoid")
    e.add_argument("--trees", type=_positive, default=trees.Boosting("").trees)
    e.add_argument("--recorded", help="a JSON file of figures that must come out again")
    v = commands.add_parser("validate", help="hold files against a CSV manifest; verdicts as CSV")
    for name in ("manifest", "structures", "matrices", "out"):
        v.add_argument(f"--{name}", required=True)
    v.add_argument("--records")
    d = commands.add_parser("describe", help="print what sequences or chains are like, as JSON")
    what = d.add_mutually_exclusive_group(required=True)
    what.add_argument("--fasta")
    what.add_argument("--sequence")
    what.add_argument("--structures")
    return p


def main(argv: list[str] | None = None) -> int:
    """0, or 1 with the reason on standard error where a table, a model's contract or files break a rule."""
    a = parser().parse_args(argv)
    return {"score": _score, "export": _export, "validate": _validate, "describe": _describe}[a.command](a, SparkSession.builder.getOrCreate())


def _scored(spark: SparkSession, table: DataFrame, path: str, threshold: float) -> DataFrame:
    """Predictions by a written model, of own trees or of a pipeline; ValueError where the table breaks its contract."""
    about = json.loads(spark.read.text(path + "/about", wholetext=True).first()[0])
    if "edges" not in about:
        pipeline, _ = tables.read_model(spark, path, about["features"])
        return scoring.score(pipeline, table, about["features"], about["calibrator"], threshold)
    models, told = trees.load(spark, path)
    if broken := scoring.contract([c for c in table.columns if c in about["features"]], about["features"]):
        raise ValueError("; ".join(broken))
    raw = trees.predict(table, models, tuple(table.columns)).drop("model").withColumnRenamed("score", "__raw")
    return scoring.predictions(raw, "__raw", told["calibrator"], threshold).drop("__raw")


def _score(a: argparse.Namespace, spark: SparkSession) -> int:
    """A structure that breaks a rule is named on standard error and left out; the others are scored.

    Without ``top``, the summary of each group is printed as JSON.
    """
    if a.features:
        table = spark.read.parquet(a.features)
    else:
        folder = a.matrices or a.structures
        table, verdicts = extraction.extract(spark, extraction.paired(spark, a.structures, folder), a.structures, folder)
        if _failed(verdicts) and table.isEmpty():
            return 1
    try:
        out = _scored(spark, table, a.model, a.threshold)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    if a.out:
        tables.csv(out, a.out, COLUMNS, ["grp", "pos"], files=None)
    if a.top:
        best = scoring.top(out, "pos", a.top)
        print(",".join(COLUMNS))
        for r in best.select(*COLUMNS).collect():
            print(",".join(map(str, r)))
    else:
        print(tables.summary(scoring.summary(out, ["grp"], "pos", "letter"), "grp"), end="")
    return 0


def _failed(verdicts: DataFrame) -> int:
    failed = verdicts.where("status = 'FAIL'").select("protein", "notes").orderBy("protein").collect()  # one row for each protein that is left out
    for r in failed:
        print(f"{r.protein}: {r.notes}", file=sys.stderr)
    return len(failed)


def _export(a: argparse.Namespace, spark: SparkSession) -> int:
    features = a.features.split(",")
    recorded = json.loads(spark.read.text(a.recorded, wholetext=True).first()[0]) if a.recorded else None
    try:
        about = export.train(spark.read.parquet(a.table), "grp", "pos", features, a.label, trees.Boosting("", trees=a.trees), export.residue_rules("grp", "pos", features, a.label), recorded, a.method, a.model)
    except export.Rejected as e:
        print(e, file=sys.stderr)
        return 1
    print(json.dumps(about, indent=2, sort_keys=True))
    return 0


def _validate(a: argparse.Namespace, spark: SparkSession) -> int:
    _, verdicts = extraction.extract(spark, documents.table(spark, a.manifest, MANIFEST), a.structures, a.matrices, a.records)
    tables.csv(verdicts, a.out, ["protein", "structure", "matrix", "residues", "status", "notes"], ["protein"])
    return 1 if _failed(verdicts) else 0


def _describe(a: argparse.Namespace, spark: SparkSession) -> int:
    if a.structures:
        print(tables.summary(description.chains(extraction.residues_of(structures.atoms(spark, a.structures))), "grp"), end="")
        return 0
    s = structures.fasta(spark, a.fasta) if a.fasta else documents.sequence(spark, "sequence", a.sequence)
    print(tables.summary(description.sequences(s, "id", "sequence"), "id"), end="")
    print(tables.summary(description.composition(s, "sequence").select("letter", F.round("share", 6).alias("share"), "n", "class"), "letter"), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
