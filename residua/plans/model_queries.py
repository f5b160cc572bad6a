"""Queries of fitted models: line items stand in for residues, suppliers' numbers for proteins, returned ones are positives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as C
from ..operators import comparison as M
from ..operators import trees as B
from ..sinks.kept import kept
from .catalogue import _rounded, _t, query

_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _best(name: str, rows: str) -> str:
    """The best cut of each node of each model, from rows(model, node, out, f0, f1, f2, g, h)."""
    return f"""{name}c AS (SELECT model, node, f, v, count(*) n, sum(g) g, sum(h) h FROM (SELECT model, node, g, h, unnest([0, 1, 2]) f, unnest([f0, f1, f2]) v FROM {rows} WHERE NOT out) GROUP BY ALL),
{name}w AS (SELECT model, node, f, v, sum(n) OVER u nl, sum(g) OVER u gl, sum(h) OVER u hl, sum(n) OVER a n, sum(g) OVER a g, sum(h) OVER a h FROM {name}c WINDOW u AS (PARTITION BY model, node, f ORDER BY v ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY model, node, f)),
{name} AS (SELECT *, round(gl * gl / hl + (g - gl) * (g - gl) / (h - hl) - g * g / h, 9) gain FROM {name}w WHERE nl >= 20 AND n - nl >= 20 AND hl >= 1e-3 AND h - hl >= 1e-3 QUALIFY row_number() OVER (PARTITION BY model, node ORDER BY gain DESC, f, v) = 1)"""


_TREES = f"""WITH x AS (SELECT l_suppkey % 5 grp, l_quantity f0, l_discount f1, l_tax f2, CAST(l_returnflag = 'R' AS INT) y FROM lineitem),
m AS (SELECT DISTINCT CAST(grp AS VARCHAR) AS model FROM x UNION ALL SELECT 'whole'),
s AS (SELECT model, x.*, CAST(grp AS VARCHAR) = model AS out FROM m, x),
p AS (SELECT model, sum(2.0 * y) / (sum(2.0 * y) + sum(1 - y)) p FROM s WHERE NOT out GROUP BY model),
r0 AS (SELECT s.*, 0 node, CASE WHEN y = 1 THEN 2.0 * (p - 1) ELSE p END g, CASE WHEN y = 1 THEN 2.0 ELSE 1.0 END * p * (1 - p) h, ln(p / (1 - p)) AS start FROM s JOIN p USING (model)),
{_best("b0", "r0")},
r1 AS (SELECT r0.* EXCLUDE (node), CASE WHEN [f0, f1, f2][f + 1] > v THEN 2 ELSE 1 END node FROM r0 JOIN (SELECT model, f, v FROM b0) USING (model)),
{_best("b1", "r1")},
k AS (SELECT * FROM b1 QUALIFY row_number() OVER (PARTITION BY model ORDER BY gain DESC, node) = 1),
r2 AS (SELECT r1.* EXCLUDE (node), CASE WHEN k.node IS DISTINCT FROM r1.node THEN r1.node WHEN [f0, f1, f2][k.f + 1] > k.v THEN 2 * r1.node + 2 ELSE 2 * r1.node + 1 END node FROM r1 LEFT JOIN (SELECT model, node, f, v FROM k) k ON k.model = r1.model),
n AS (SELECT DISTINCT * FROM (SELECT model, node, count(*) AS rows, -sum(g) / sum(h) * 0.1 AS value FROM (SELECT model, node, g, h FROM r0 WHERE NOT out UNION ALL SELECT model, node, g, h FROM r1 WHERE NOT out UNION ALL SELECT model, node, g, h FROM r2 WHERE NOT out AND node > 2) GROUP BY ALL))"""


def _lines(spark, d):
    return _t(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("grp"), *_FEATURES, (F.col("l_returnflag") == "R").cast("int").alias("y"))


def _counted(x):
    """(rows, cuts): different rows with the number of times that each is there, and the cuts of features by all rows."""
    return kept(x.groupBy(*x.columns).agg(F.count("*").alias("times")), "lines"), B.edges(x, _FEATURES)


def _mean(c):
    return F.sum(c * F.col("times")) / F.sum("times")


def _models(spark, d):
    x, cuts = _counted(_lines(spark, d))
    p = B.Boosting("whole", trees=1, depth=2, leaves=3, rate=0.1, rows=1.0, columns=1.0, positive=2.0)
    return x, B.fit(x, _FEATURES, "y", [*B.left_out(x, "grp", p), p], "grp", cuts=cuts, weight="times")


@query(_TREES + """ SELECT n.model, 0 AS tree, n.node, CASE c.f WHEN 0 THEN 'l_quantity' WHEN 1 THEN 'l_discount' WHEN 2 THEN 'l_tax' END AS feature, c.v AS threshold, round(c.gain, 3) AS gain, n.rows, round(n.value, 6) + 0.0 AS value
FROM n LEFT JOIN (SELECT model, node, f, v, gain FROM b0 UNION ALL SELECT model, node, f, v, gain FROM k) c ON c.model = n.model AND c.node = n.node""")
def leaf_limited_trees(spark, d):
    """Trees of three leaves at a depth of two, of all lines and without each group."""
    n = B.nodes(spark, _models(spark, d)[1])
    return n.select("model", "tree", "node", "feature", "threshold", F.round("gain", 3).alias("gain"), "rows", (F.round("value", 6) + 0.0).alias("value"))


@query(_TREES + " SELECT grp, count(*) AS n, round(avg(1 / (1 + exp(-(start + value)))), 6) AS mean_score, round(min(1 / (1 + exp(-(start + value)))), 6) AS least FROM r2 JOIN n USING (model, node) WHERE out GROUP BY grp")
def out_of_group_trees(spark, d):
    """Each group's scores by the tree that hasn't seen it."""
    x, models = _models(spark, d)
    s = B.out_of_fold(x, models, "grp", ("grp", "times"))
    return _rounded(s.groupBy("grp").agg(F.sum("times").alias("n"), _mean(F.col("score")).alias("mean_score"), F.min("score").alias("least")))


@query(_TREES + """, c AS (SELECT model, f, gain FROM b0 UNION ALL SELECT model, f, gain FROM k), g AS (SELECT model, f, sum(gain) gain FROM c GROUP BY ALL), t AS (SELECT model, sum(gain) t FROM g GROUP BY model),
e AS (SELECT m.model, f.f, coalesce(g.gain, 0) / t AS importance FROM t JOIN m USING (model) CROSS JOIN (SELECT unnest([0, 1, 2]) f) f LEFT JOIN g ON g.model = m.model AND g.f = f.f)
SELECT CASE f WHEN 0 THEN 'l_quantity' WHEN 1 THEN 'l_discount' ELSE 'l_tax' END AS feature, round(avg(importance), 6) AS mean, round(stddev_pop(importance), 6) AS sd, count(*) AS models FROM e GROUP BY f""")
def tree_importances(spark, d):
    """Shares of the gain of each feature, over the models."""
    from ..operators import learning as L

    return _rounded(L.mean_importances(B.importances(spark, _models(spark, d)[1])))


# --- calibrators: of a table of scores by group, and nested in the folds of models ---------------------------------------


@query("""WITH x AS (SELECT l_linestatus grp, l_quantity s, count(*) n, count(*) FILTER (WHERE l_returnflag = 'R') p FROM lineitem GROUP BY ALL),
c AS (SELECT grp, s, sum(n) OVER w n, sum(p) OVER w p, coalesce(sum(n) OVER v, 0) n0, coalesce(sum(p) OVER v, 0) p0 FROM x WINDOW w AS (PARTITION BY grp ORDER BY s ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY grp ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT i.grp, i.s, a.s AS a, min((b.p - a.p0) / (b.n - a.n0)) AS m FROM c i JOIN c a ON a.grp = i.grp AND a.s <= i.s JOIN c b ON b.grp = i.grp AND b.s >= i.s GROUP BY ALL),
v AS (SELECT grp, s, round(max(m), 9) AS v FROM m GROUP BY ALL)
SELECT v.grp, min(v.s) AS low, max(v.s) AS high, CAST(sum(n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS pos, round(v.v, 6) AS value FROM v JOIN x ON x.grp = v.grp AND x.s = v.s GROUP BY v.grp, v.v""")
def isotonic_fit(spark, d):
    """Blocks of the step fit of each group; the SQL has them by the greatest least mean."""
    x = _t(spark, d, "lineitem").select(F.col("l_linestatus").alias("grp"), "l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return _rounded(C.isotonic_blocks(x, "l_quantity", "y", ["grp"]))


_NEWTON = """n(it, k, a, b) AS (SELECT DISTINCT 0, k, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM z UNION ALL
  SELECT it + 1, k, a - (ga * bb - gb * ab) / (aa * bb - ab * ab), b - (gb * aa - ga * ab) / (aa * bb - ab * ab) FROM (
    SELECT it, k, a, b, sum(w * (p - y) * z) + a / 1e6 AS ga, sum(w * (p - y)) AS gb, sum(w * p * (1 - p) * z * z) + 1e-6 AS aa, sum(w * p * (1 - p) * z) AS ab, sum(w * p * (1 - p)) AS bb
    FROM (SELECT it, n.k, a, b, z, y, w, 1 / (1 + exp(-(a * z + b))) AS p FROM n JOIN z ON z.k = n.k WHERE it < 25) GROUP BY it, k, a, b))"""


@query("""WITH RECURSIVE s AS (SELECT user_id % 6 AS k, least(greatest(floor(value / 10) / 100.0, 0), 1) AS s, CAST(event_type = 'purchase' AS INT) AS y FROM events),
z AS (SELECT k, ln(least(greatest(s, 1e-6), 1 - 1e-6) / (1 - least(greatest(s, 1e-6), 1 - 1e-6))) AS z, y, CAST(count(*) AS DOUBLE) AS w FROM s GROUP BY ALL), """ + _NEWTON + """
SELECT CAST(k AS VARCHAR) AS grp, round(a, 6) AS slope, round(b, 6) AS "offset" FROM n WHERE it = 25""")
def platt_by_group(spark, d):
    """A logistic calibrator for each group of events, all at once."""
    s = _t(spark, d, "events").select((F.col("user_id") % 6).alias("grp"), F.least(F.greatest(F.floor(F.col("value") / 10) / 100, F.lit(0.0)), F.lit(1.0)).alias("s"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    return _rounded(C.fit_platt_by(s, "grp", "s", "y"))


_NESTED = f"""WITH RECURSIVE x AS (SELECT l_suppkey % 5 grp, l_quantity f0, l_discount f1, l_tax f2, CAST(l_returnflag = 'R' AS INT) y FROM lineitem),
t AS (SELECT grp, count(*) n FROM x GROUP BY grp),
i AS (SELECT o.grp AS k, t.grp, row_number() OVER (PARTITION BY o.grp ORDER BY t.n DESC, t.grp) - 1 AS r FROM t o JOIN t ON t.grp <> o.grp),
j AS (SELECT k, grp, CASE WHEN (r // 2) % 2 = 0 THEN r % 2 ELSE 1 - r % 2 END AS fold FROM i),
m AS (SELECT k, CAST(fold AS VARCHAR) AS part, list(grp) || [k] AS without FROM j GROUP BY k, fold UNION ALL SELECT grp, 'all', [grp] FROM t),
s AS (SELECT k || ' ' || part AS model, k, part, x.*, list_contains(without, grp) AS out FROM m, x),
p AS (SELECT model, sum(2.0 * y) / (sum(2.0 * y) + sum(1 - y)) p FROM s WHERE NOT out GROUP BY model),
r0 AS (SELECT s.*, 0 node, CASE WHEN y = 1 THEN 2.0 * (p - 1) ELSE p END g, CASE WHEN y = 1 THEN 2.0 ELSE 1.0 END * p * (1 - p) h, ln(p / (1 - p)) AS start FROM s JOIN p USING (model)),
{_best("b0", "r0")},
v AS (SELECT model, f, v, -gl / hl * 0.5 AS low, -(g - gl) / (h - hl) * 0.5 AS high FROM b0),
q AS (SELECT k, part, grp, y, start + CASE WHEN [f0, f1, f2][f + 1] > v THEN high ELSE low END AS z FROM r0 JOIN v USING (model) WHERE out),
z AS (SELECT k, z, y, CAST(count(*) AS DOUBLE) AS w FROM q WHERE part <> 'all' AND grp <> k GROUP BY ALL), {_NEWTON}"""


@query(_NESTED + """ SELECT CAST(n.k AS VARCHAR) AS model, round(a, 4) AS slope, round(b, 4) AS "offset", rows, round(mean_score, 6) AS mean_score, round(mean_calibrated, 4) AS mean_calibrated
FROM n JOIN (SELECT q.k, count(*) AS rows, avg(1 / (1 + exp(-z))) AS mean_score, avg(1 / (1 + exp(-(a * z + b)))) AS mean_calibrated FROM q JOIN n ON n.k = q.k AND it = 25 WHERE part = 'all' GROUP BY q.k) c ON c.k = n.k WHERE it = 25""")
def nested_calibration(spark, d):
    """Calibrators of models that left a group out, fitted to scores by models that left an inner fold out too."""
    x, cuts = _counted(_lines(spark, d))
    p = B.Boosting("", trees=1, depth=1, leaves=2, rate=0.5, rows=1.0, columns=1.0, positive=2.0)
    rows, fits = B.nested(x, _FEATURES, "y", "grp", p, ("grp", "y", "times"), 2, cuts, "times")
    means = rows.groupBy("model").agg(F.sum("times").alias("rows"), _mean(F.col("score")).alias("mean_score"), _mean(F.col("calibrated")).alias("mean_calibrated"))
    return fits.join(means, "model").select("model", F.round("slope", 4).alias("slope"), F.round("offset", 4).alias("offset"), "rows", F.round("mean_score", 6).alias("mean_score"), F.round("mean_calibrated", 4).alias("mean_calibrated"))


# --- a grid of configurations from a table, fitted for all folds in one plan ----------------------------------------------

_GRID = _TREES.replace("CAST(l_returnflag = 'R' AS INT) y FROM lineitem)", "CAST(l_returnflag = 'R' AS INT) y FROM lineitem), cfg AS (SELECT r_name AS config, 2 + r_regionkey % 2 AS leaves, 0.1 * (r_regionkey + 1) AS rate FROM region)").replace("UNION ALL SELECT 'whole'", "") + """,
sc AS (SELECT config, a.model AS fold, avg(pow(1 / (1 + exp(-(a.start + n.value / 0.1 * rate))) - a.y, 2)) AS brier FROM cfg JOIN (SELECT model, 2 AS leaves, start, y, node FROM r1 WHERE out UNION ALL SELECT model, 3, start, y, node FROM r2 WHERE out) a USING (leaves) JOIN n ON n.model = a.model AND n.node = a.node GROUP BY ALL)"""


def _grid_scores(spark, d):
    """Brier score of each configuration and fold: as many models as both, from one table of configurations."""
    x, cuts = _counted(_lines(spark, d))
    table = _t(spark, d, "region").select(F.col("r_name").alias("name"), (2 + F.col("r_regionkey") % 2).alias("leaves"), (0.1 * (F.col("r_regionkey") + 1)).alias("rate"))
    folds = B.left_out(x, "grp", B.Boosting("", trees=1, depth=2, rows=1.0, columns=1.0, positive=2.0))
    models = [B.Boosting(**{**f.__dict__, "name": f"{c.name}|{f.name}", "leaves": c.leaves, "rate": c.rate}) for c in B.grid(table) for f in folds]
    s = B.out_of_fold(x, B.fit(x, _FEATURES, "y", models, "grp", cuts=cuts, weight="times"), "grp", ("grp", "y", "times"))
    part = F.split("model", r"\|")
    error = F.col("score") - F.col("y")
    return s.groupBy(part[0].alias("config"), part[1].alias("fold")).agg(_mean(error * error).alias("brier"))


@query(_GRID + " SELECT config, fold, round(brier, 6) AS brier FROM sc")
def grid_scores(spark, d):
    return _rounded(_grid_scores(spark, d))


@query(_GRID + """, i AS (SELECT a.fold, a.config, -a.brier AS value, -avg(b.brier) AS inner_mean FROM sc a JOIN sc b ON a.config = b.config AND a.fold <> b.fold GROUP BY a.fold, a.config, a.brier)
SELECT fold, config, round(inner_mean, 6) AS "inner", round(value, 6) AS value FROM i QUALIFY row_number() OVER (PARTITION BY fold ORDER BY inner_mean DESC, config) = 1""")
def grid_choice(spark, d):
    """For each fold the configuration that is best in all others."""
    s = _grid_scores(spark, d).withColumn("value", -F.col("brier"))
    return _rounded(M.nested_choice(s, "fold", "config", "value"))
