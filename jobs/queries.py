"""The jobs as registered queries: each runs its function twice into one new folder and gives what is there after the second run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.sinks.kept import new_folder

from . import evaluate, intake


def job1_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "intake")
    for _ in range(2):
        intake.run(spark, f"{sf_dir}/documents.parquet", out)
    return intake.read(spark, out).select("doc_id", "source", "bytes", "sha256", "copies", "status", "notes")


def job2_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "evaluate")
    for _ in range(2):
        evaluate.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out)
    # source comes from folders' names: as text, whatever it looks like
    scores = spark.read.schema("doc_id long, quality int, score double, source string").parquet(f"{out}/scores")
    folds = spark.read.parquet(f"{out}/folds").select("source", "n", "pos", *[F.round(c, 6).alias(c) for c in ("roc", "pr", "brier")])
    whole = spark.read.parquet(f"{out}/summary").select("folds", *[F.round(c, 6).alias(c) for c in ("median_roc", "median_pr", "pooled_roc", "pooled_pr")])  # one row
    return scores.join(folds, "source").crossJoin(F.broadcast(whole)).select("doc_id", "source", "quality", F.round("score", 6).alias("score"), "n", "pos", "roc", "pr", "brier", "folds", "median_roc", "median_pr", "pooled_roc", "pooled_pr")


QUERIES = {"job1_intake": job1_intake, "job2_evaluate": job2_evaluate}
SQL = {
    "job1_intake": r"""WITH r AS (SELECT doc_id, source, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, sha256(coalesce(text, '')) AS sha256, array_to_string(list_filter([
  CASE WHEN text IS NULL OR lower(trim(text)) IN ('', 'nan', 'na', 'none') THEN 'text blank' END, CASE WHEN lang IS NULL OR lower(trim(lang)) IN ('', 'nan', 'na', 'none') THEN 'lang blank' END,
  CASE WHEN source IS NULL OR lower(trim(source)) IN ('', 'nan', 'na', 'none') THEN 'source blank' END, CASE WHEN regexp_matches(text, '\b20[0-9]{2}-[01][0-9]-[0-3][0-9]\b') THEN 'text date' END,
  CASE WHEN regexp_matches(text, '(^|[\s"''])/(home|root|tmp|Users|mnt|var)/') THEN 'text path' END, CASE WHEN contains(text, chr(13)) THEN 'text carriage return' END, CASE WHEN starts_with(text, chr(65279)) THEN 'text mark' END], lambda x: x IS NOT NULL), '; ') AS notes FROM documents),
g AS (SELECT doc_id, source, bytes, sha256, notes, count(*) AS copies FROM r GROUP BY ALL)
SELECT doc_id, source, bytes, sha256, copies, CASE WHEN notes <> '' THEN 'rejected' WHEN row_number() OVER (PARTITION BY sha256, notes = '' ORDER BY doc_id NULLS LAST, source NULLS FIRST) = 1 THEN 'accepted' ELSE 'duplicate' END AS status, notes FROM g""",
    "job2_evaluate": """WITH x AS (SELECT d.doc_id, source AS grp, CAST(quality AS INT) AS y, ln(length(coalesce(text, '')) + 1.0) AS a, (length(coalesce(text, '')) - length(translate(coalesce(text, ''), ' ' || chr(10) || chr(9), ''))) / (length(coalesce(text, '')) + 1.0) AS b FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE source <> '' AND quality IS NOT NULL),
g AS (SELECT grp, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS vy FROM x GROUP BY grp),
o AS (SELECT g.grp, sum(o.n) AS n, sum(o.a) / sum(o.n) AS ma, sum(o.b) / sum(o.n) AS mb, sum(o.y) / sum(o.n) AS my, sum(o.aa) AS aa, sum(o.ab) AS ab, sum(o.bb) AS bb, sum(o.ay) AS ay, sum(o.vy) AS vy FROM g JOIN g o ON g.grp <> o.grp GROUP BY g.grp),
c AS (SELECT grp, ma, mb, my, aa - n * ma * ma AS aa, ab - n * ma * mb AS ab, bb - n * mb * mb AS bb, ay - n * ma * my AS ay, vy - n * mb * my AS vy FROM o),
w AS (SELECT grp, ma, mb, my, (ay * bb - vy * ab) / (aa * bb - ab * ab) AS wa, (vy * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM c),
s AS (SELECT doc_id, grp, y AS label, round(my + wa * (a - ma) + wb * (b - mb), 9) AS score FROM x JOIN w USING (grp)),
v AS (SELECT grp AS v, grp, label, score FROM s UNION ALL SELECT NULL, grp, label, score FROM s),
t AS (SELECT v AS grp, score, count(*) AS n, sum(label) AS p FROM v GROUP BY ALL),
u AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(n) OVER (PARTITION BY grp) AS an, sum(p) OVER (PARTITION BY grp) AS ap FROM t WINDOW w AS (PARTITION BY grp ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT grp, sum(n) AS n, sum(p) AS pos, CASE WHEN sum(p) > 0 AND sum(n) > sum(p) THEN (sum(p * (cn - n + (n + 1) / 2.0)) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * (sum(n) - sum(p))) END AS roc,
  CASE WHEN sum(p) > 0 THEN sum(p * ((ap - cp + p) / (an - cn + n) + CASE WHEN an > cn THEN (ap - cp) / (an - cn) ELSE 1 END) / 2.0) / sum(p) END AS pr FROM u GROUP BY grp),
b AS (SELECT grp, avg((least(greatest(score, 0), 1) - label) * (least(greatest(score, 0), 1) - label)) AS brier FROM s GROUP BY grp),
m AS (SELECT count(*) AS folds, round(quantile_cont(roc, 0.5), 6) AS median_roc, round(quantile_cont(pr, 0.5), 6) AS median_pr FROM f WHERE grp IS NOT NULL AND pos > 0),
q AS (SELECT round(roc, 6) AS pooled_roc, round(pr, 6) AS pooled_pr FROM f WHERE grp IS NULL)
SELECT doc_id, s.grp AS source, label AS quality, round(score, 6) AS score, CAST(f.n AS BIGINT) AS n, CAST(f.pos AS BIGINT) AS pos, round(f.roc, 6) AS roc, round(f.pr, 6) AS pr, round(brier, 6) AS brier, folds, median_roc, median_pr, pooled_roc, pooled_pr
FROM s JOIN f ON f.grp = s.grp JOIN b ON b.grp = s.grp, m, q""",
}
