"""The jobs: two runs over growing input, runs that are made again, odd rows, command lines, and their queries against SQL."""

import hashlib
import os
import subprocess
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from jobs import evaluate, intake, queries
from tests.test_catalogue import rows

DIR = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCHEMA = "doc_id long, text string, lang string, source string, status string"


def deliver(spark, path, texts):
    """One more file in the folder; the column status clashes with the one that the job makes."""
    spark.createDataFrame([(i, t, "en", s, "x") for i, t, s in texts], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def taken(spark, out):
    return {(r.doc_id, r.source): (r.batch, r.status, r.copies, r.notes) for r in intake.read(spark, out).collect()}


def test_intake_of_growing_input(spark, tmp_path):
    src, out = str(tmp_path / "documents"), str(tmp_path / "out")
    deliver(spark, src, [(1, "A text.", "a"), (2, "A text.", "b"), (3, None, "a"), (4, "At /home/me it is.", "a"), (4, "At /home/me it is.", "a")])
    intake.run(spark, src, out)
    first = taken(spark, out)
    assert first == {(1, "a"): (0, "accepted", 1, ""), (2, "b"): (0, "duplicate", 1, ""), (3, "a"): (0, "rejected", 1, "text blank"), (4, "a"): (0, "rejected", 2, "text path")}
    files = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(out + "/manifest") for f in names if f.startswith("part-")}

    intake.run(spark, src, out)  # nothing new
    assert taken(spark, out) == first

    deliver(spark, src, [(0, "A text.", "a"), (5, "Another.", None), (6, "B text.", "c"), (None, "B text.", "c")])
    intake.run(spark, src, out)
    both = taken(spark, out)
    assert both == first | {(0, "a"): (1, "duplicate", 1, ""), (5, None): (1, "rejected", 1, "source blank"), (6, "c"): (1, "accepted", 1, ""), (None, "c"): (1, "duplicate", 1, "")}
    after = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(out + "/manifest") for f in names if f.startswith("part-")}
    assert files.items() <= after.items()  # what was there wasn't written again
    sums = {(r.source, r.status): r.rows for r in intake.report(spark, out).collect()}
    assert sums[("a", "rejected")] == 3 and sum(sums.values()) == 9


def test_intake_of_a_batch_again(spark, tmp_path):
    """A batch that failed after it was written, and is taken again, leaves the same rows."""
    out, config = str(tmp_path / "out"), intake.configuration()
    frame = lambda texts: spark.createDataFrame([(i, t, "en", "a", "x") for i, t in texts], SCHEMA)
    one, two = frame([(1, "One."), (2, "One."), (3, "")]), frame([(0, "One."), (4, "Two."), (5, "Two.")])
    intake.take(one, 0, out, config)
    intake.take(two, 1, out, config)
    want, sums = taken(spark, out), sorted(map(tuple, intake.report(spark, out).collect()))
    intake.take(two, 1, out, config)
    assert taken(spark, out) == want and sorted(map(tuple, intake.report(spark, out).collect())) == sums
    intake.take(one, 0, out, config)
    assert taken(spark, out) == want
    assert [want[i, "a"][1] for i in range(6)] == ["duplicate", "accepted", "duplicate", "rejected", "accepted", "duplicate"]


def test_intake_file_by_file_of_whole_and_long_texts(spark, tmp_path):
    src, out = str(tmp_path / "documents"), str(tmp_path / "out")
    deliver(spark, src, [(1, "long. " * 100_000, "a")] + [(10 + i, "Same.", "hot") for i in range(500)])
    deliver(spark, src, [(2, "long. " * 100_000, "b"), (3, "Same.", "b")])
    intake.run(spark, src, out, intake.configuration() | {"files_at_a_time": 1})
    got = taken(spark, out)
    assert len(got) == 503 and sum(v[1] == "accepted" for v in got.values()) == 2 and {v[0] for v in got.values()} == {0, 1}
    sha = {r.doc_id: r.sha256 for r in intake.read(spark, out).where("doc_id < 3").collect()}
    assert sha[1] == sha[2] == hashlib.sha256(b"long. " * 100_000).hexdigest()


def test_intake_of_nothing(spark, tmp_path):
    src, out = str(tmp_path / "documents"), str(tmp_path / "out")
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(src)
    intake.run(spark, src, out)
    assert intake.read(spark, out).count() == 0 == intake.report(spark, out).count()


def test_evaluate(spark, tmp_path):
    """Scores against models solved one group at a time; a second run and other partitions give the same."""
    rng = np.random.default_rng(2)
    docs = [(i, None if i == 7 else "wort " * int(rng.integers(0, 60)) + "x" * int(rng.integers(1, 9)), None if i == 5 else "" if i == 6 else f"s{i % 6}", 0.0) for i in range(300)] + [(8, "again", "s2", 0.0)]
    labels = [(i, None if i == 9 else int(rng.random() < 0.5), 1) for i in range(0, 300, 2)] + [(7, 1, 0), (9, None, 0)]
    d, t = str(tmp_path / "d"), str(tmp_path / "l")
    spark.createDataFrame(docs, "doc_id long, text string, source string, score double").write.parquet(d)
    spark.createDataFrame(labels, "doc_id long, quality int, n int").write.parquet(t)
    know = {i: q for i, q, _ in labels if q is not None}
    x = [(i, s, know[i], np.log(len(b) + 1), (len(b) - len(b.replace(" ", ""))) / (len(b) + 1)) for i, b, s, _ in ((i, b or "", s, 0) for i, b, s, _ in docs) if i in know and s]
    want = []
    for i, s, y, a, b in x:
        o = [(1, v[3], v[4], v[2]) for v in x if v[1] != s]
        w = np.linalg.lstsq(np.array(o)[:, :3], np.array(o)[:, 3], rcond=None)[0]
        want.append((i, s, y, round(float(w @ [1, a, b]), 6)))
    out = str(tmp_path / "out")
    seen = []
    for _ in range(2):
        evaluate.run(spark, d, t, out)
        s = spark.read.parquet(out + "/scores")
        assert sorted((r.doc_id, r.source, r.quality, round(r.score, 6)) for r in s.collect()) == sorted(want)
        seen.append([sorted(map(tuple, spark.read.parquet(f"{out}/{n}").select([F.round(c, 6) if k == "double" else c for c, k in spark.read.parquet(f"{out}/{n}").dtypes]).collect())) for n in ("folds", "bins", "summary")])
    assert seen[0] == seen[1]
    assert sum(r[1] for r in seen[0][0]) == len(want) == sum(r[1] for r in seen[0][1]) and seen[0][2][0][0] == len({r[1] for r in want})


def test_evaluate_of_nothing(spark, tmp_path):
    d, t, out = (str(tmp_path / n) for n in "dlo")
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(d)
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(t)
    evaluate.run(spark, d, t, out)
    assert spark.read.parquet(out + "/folds").count() == 0 and spark.read.parquet(out + "/summary").first().folds == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    (x, cols), (y, names) = rows(queries.QUERIES[name](spark, DIR).toPandas()), rows(con.execute(queries.SQL[name]).df())
    assert cols == names and sorted(x, key=str) == sorted(y, key=str)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the tables")
def test_command_lines(tmp_path):
    run = lambda *a: subprocess.run([sys.executable, "-m", *a], cwd=ROOT, capture_output=True, text=True, timeout=300)
    a = run("jobs.intake", "--input", f"{DIR}/documents.parquet", "--output", str(tmp_path / "a"))
    assert a.returncode == 0 and "in all:" in a.stderr, a.stderr[-2000:]
    b = run("jobs.evaluate", "--documents", f"{DIR}/documents.parquet", "--labels", f"{DIR}/labels.parquet", "--output", str(tmp_path / "b"))
    assert b.returncode == 0 and "scores of" in b.stderr, b.stderr[-2000:]
    assert any(x.startswith("source=") for x in os.listdir(tmp_path / "b" / "scores")) and os.path.isdir(tmp_path / "a" / "manifest" / "batch=0")
