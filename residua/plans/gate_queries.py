"""Queries of residue values, of gates over proteins and training rows, and of digests: suppliers stand in for proteins, parts for residues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import residues as R
from ..operators import extraction as X
from ..operators import gates as G
from ..operators import manifest as N
from ..operators import quality as Q
from ..operators import scoring as P
from ..operators import structures as T
from .catalogue import _rounded, _t, query


def _sql_map(d: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v!r}" for k, v in d.items()) + "}"


_CASE = "CASE " + " ".join(f"WHEN contains('{s}', a) THEN '{c}'" for c, s in R.CLASSES.items()) + " ELSE 'unknown' END"
_CODES = [*R.THREE_TO_ONE, "UNK"]

# --- scalar values of residues and sequences ------------------------------------------------------------------------------


@query(f"""WITH l AS (SELECT p_partkey, {_CODES!r}[p_partkey % 21 + 1] AS code FROM part), m AS (SELECT *, coalesce({_sql_map(R.THREE_TO_ONE)}[code], 'X') AS a FROM l)
SELECT p_partkey, code, a AS letter, CAST({_sql_map(R.HYDROPATHY)}[a] AS DOUBLE) AS hydropathy, """ + ", ".join(f"CAST({_CASE} = '{c}' AS DOUBLE) AS class_{c}" for c in R.ONE_HOT_ORDER) + " FROM m")
def residue_values(spark, d):
    """Letter of a residue's name, its hydropathy and all six columns of its class."""
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("p_partkey") % 21 + 1).cast("int"))
    x = _t(spark, d, "part").select("p_partkey", code.alias("code")).withColumn("letter", R.one_letter(F.col("code")))
    return x.select("p_partkey", "code", "letter", R.hydropathy(F.col("letter")).alias("hydropathy"), *R.one_hot(R.residue_class(F.col("letter"))))


@query(f"""WITH s AS (SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS s FROM part), l AS (SELECT *, string_split(s, '') AS c, regexp_matches(s, '^[ACDEFGHIKLMNPQRSTVWY]+$') AS ok FROM s)
SELECT p_partkey, CASE WHEN ok THEN round(list_sum(list_transform(c, lambda x: CAST({_sql_map(R.MASS)}[x] AS DOUBLE))) - (length(s) - 1) * {R.WATER}, 1) END AS weight, CASE WHEN ok THEN round(list_sum(list_transform(c, lambda x: CAST({_sql_map(R.HYDROPATHY)}[x] AS DOUBLE))) / length(s), 3) END AS gravy,
CASE WHEN length(s) > 5 THEN left(s, 5) || '...' ELSE s END AS preview, CASE WHEN NOT ok THEN 'other letters' END AS note FROM l""")
def sequence_values(spark, d):
    """Weight, mean hydropathy and preview of sequences, and a note where other letters leave them without."""
    s = F.col("s")
    x = _t(spark, d, "part").select("p_partkey", F.regexp_replace(F.upper("p_name"), "[^A-Z]", "").alias("s"))
    return x.select("p_partkey", R.molecular_weight(s).alias("weight"), R.gravy(s).alias("gravy"), R.preview(s, 5).alias("preview"), R.skipped(s).alias("note"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN CAST(p_size AS DOUBLE) END AS version FROM part")
def model_versions(spark, d):
    """The version in a file's name, null for names of another form."""
    name = F.concat(F.lit("AF-P"), F.col("p_partkey"), F.lit("-F1-model_v"), F.col("p_size"), F.when(F.col("p_size") % 4 > 0, ".cif").otherwise(".txt"))
    return _t(spark, d, "part").select("p_partkey", R.model_version(name).cast("double").alias("version"))


# --- gates ----------------------------------------------------------------------------------------------------------------

_FACTS = """WITH l AS (SELECT l_suppkey, count(DISTINCT l_partkey) residues, min(l_partkey) AS first, max(l_partkey) AS last, count(DISTINCT l_linestatus) models, count_if(l_returnflag = 'R' AND l_quantity > 49) hetero, min(l_discount) * 1000 least_b, max(l_tax) * 1300 most_b, count_if(l_tax > 0.07 AND l_quantity > 45) bad_cells FROM lineitem GROUP BY 1),
f AS (SELECT s_suppkey AS protein, s_suppkey k, l.* EXCLUDE (l_suppkey), residues + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS length FROM supplier LEFT JOIN l ON l_suppkey = s_suppkey),
r AS (SELECT protein, [CASE WHEN k % 31 = 0 OR residues IS NULL THEN 'structure missing' END, CASE WHEN k % 29 = 0 THEN 'matrix missing' END, CASE WHEN k % 23 = 0 THEN 'record missing' END, CASE WHEN st AND k % 7 = 0 THEN 'structure checksum' END, CASE WHEN mx AND k % 11 = 0 THEN 'matrix checksum' END,
  CASE WHEN rc AND k % 13 = 0 THEN 'entry' END, CASE WHEN rc AND k % 17 = 0 THEN 'version' END, CASE WHEN st AND models <> 1 THEN 'models' END, CASE WHEN st AND k % 19 = 0 THEN 'chains' END, CASE WHEN hetero > 0 THEN 'hetero atoms' END, CASE WHEN st AND residues <> length THEN 'length' END,
  CASE WHEN st AND NOT (first = 1 AND last = residues) THEN 'numbering' END, CASE WHEN st AND NOT (least_b >= 0 AND most_b <= 100) THEN 'confidence' END, CASE WHEN mx AND residues IS NOT NULL AND k % 3 = 0 OR mx AND residues IS NULL THEN 'matrix shape' END, CASE WHEN bad_cells > 0 THEN 'matrix values' END] AS n
  FROM (SELECT *, k % 31 <> 0 AND residues IS NOT NULL AS st, k % 29 <> 0 AS mx, k % 23 <> 0 AS rc FROM f)),
v AS (SELECT protein, array_to_string(list_filter(n, lambda x: x IS NOT NULL), '; ') AS notes FROM r)"""


def _facts(spark, d):
    """Facts of each supplier's line items, some of them changed so that rules are broken."""
    x = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.countDistinct("l_partkey").alias("residues"), F.min("l_partkey").alias("first"), F.max("l_partkey").alias("last"), F.countDistinct("l_linestatus").alias("models"), F.count_if(F.expr("l_returnflag = 'R' and l_quantity > 49")).alias("hetero"),
        (F.min("l_discount") * 1000).alias("least_b"), (F.max("l_tax") * 1300).alias("most_b"), F.count_if(F.expr("l_tax > 0.07 and l_quantity > 45")).alias("bad_cells"),
    )
    f = _t(spark, d, "supplier").select("s_suppkey").join(x, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    k, unless = F.col("s_suppkey"), lambda n, v, other: F.when(F.col("s_suppkey") % n == 0, other).otherwise(v)
    name, none = k.cast("string"), F.lit(None)
    length = F.col("residues") + F.when(k % 5 == 0, 1).otherwise(0)
    here = (k % 31 != 0) & F.col("residues").isNotNull()
    return f.select(
        k.alias("protein"), "residues", "first", "last", "models", "hetero", "least_b", "most_b", "bad_cells", length.alias("length"), name.alias("structure_sha256"), name.alias("matrix_sha256"), name.alias("accession"), name.alias("entry"), F.lit(4).alias("version"),
        F.when(here, unless(7, name, F.lit("0"))).alias("found_structure_sha256"), unless(29, unless(11, name, F.lit("0")), none).alias("found_matrix_sha256"), unless(23, name, none).alias("found_accession"), unless(13, name, F.lit("0")).alias("found_entry"), unless(17, F.lit(4), F.lit(5)).alias("found_version"),
        unless(19, F.lit(1), F.lit(2)).alias("chains"), F.lit(0).alias("unreadable"), F.lit("A").alias("chain"), F.lit("A").alias("found_chain"), F.lit(0).alias("inserted"), F.lit(0).alias("without_ca"), F.lit(0).alias("unknown"), F.lit("M").alias("sequence"), F.lit("M").alias("found_sequence"), F.lit("m").alias("md5"), F.lit("m").alias("found_md5"),
        unless(3, length * length, F.lit(0)).alias("cells"), length.alias("most_i"), length.alias("most_j"),
    )


@query(_FACTS + " SELECT protein, CASE WHEN notes = '' THEN 'PASS' ELSE 'FAIL' END AS status, notes FROM v")
def extraction_gate(spark, d):
    """Each protein's verdict by the rules of the extraction."""
    return X.judged(_facts(spark, d)).select("protein", "status", "notes")


_TRAIN = f"""WITH x AS (SELECT CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id % 40 END AS grp, event_id AS pos, substr('ACDEFGHIKLMNPQRSTVWYB', CAST(event_id % 21 + 1 AS INT), 1) AS a, event_id, value, CASE WHEN event_type = 'purchase' THEN 1 WHEN event_id % 89 = 0 THEN 2 ELSE 0 END AS y FROM events),
t AS (SELECT pos, list_filter([CASE WHEN y NOT IN (0, 1) THEN 'label' END, CASE WHEN CASE WHEN event_id % 13 = 0 THEN 'polar' ELSE {_CASE} END <> {_CASE} THEN 'class' END, CASE WHEN grp IS NULL THEN 'key' END, CASE WHEN event_id % 50 = 0 OR value IS NULL THEN 'finite_value' END, CASE WHEN event_id % 50 = 0 OR value IS NULL OR value > 100 THEN 'range_value' END], lambda v: v IS NOT NULL) AS broken FROM x)"""


def _gate(spark, d):
    e = _t(spark, d, "events")
    a = F.substring(F.lit("ACDEFGHIKLMNPQRSTVWYB"), (F.col("event_id") % 21 + 1).cast("int"), F.lit(1))
    x = e.select(F.when(F.col("event_id") % 97 != 0, F.col("user_id") % 40).alias("grp"), F.col("event_id").alias("pos"), a.alias("a"), F.when(F.col("event_id") % 13 == 0, "polar").otherwise(R.residue_class(a)).alias("kind"), F.when(F.col("event_type") == "purchase", 1).when(F.col("event_id") % 89 == 0, 2).otherwise(0).alias("y"), F.when(F.col("event_id") % 50 == 0, float("nan")).otherwise(F.col("value")).alias("value"))
    return G.training_gate(x, ["pos"], G.training_rules("grp", "pos", "a", "kind", "y", ["value"], {"value": (0.0, 100.0)}, R.residue_class(F.col("a"))))


@query(_TRAIN + " SELECT pos, array_to_string(broken, '; ') AS broken FROM t WHERE len(broken) > 0")
def training_gate(spark, d):
    """Training rows that are kept back, with the rules that each breaks."""
    return _gate(spark, d)[1].select("pos", F.array_join("broken", "; ").alias("broken"))


@query(_TRAIN + " SELECT count(*) AS rows, count(*) FILTER (WHERE y = 1) AS positives FROM t JOIN x USING (pos) WHERE len(broken) = 0")
def training_rows(spark, d):
    """What the gate lets through."""
    return _gate(spark, d)[0].agg(F.count("*").alias("rows"), F.count_if(F.col("y") == 1).alias("positives"))


@query("""WITH x AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, CAST(round(value * 10) AS BIGINT) AS v FROM events), a AS (SELECT i // 64 AS i, sha256(string_agg(coalesce(CAST(v AS VARCHAR), ''), ',' ORDER BY i)) AS v FROM x GROUP BY i // 64),
b AS (SELECT i // 64 AS i, sha256(string_agg(v, ',' ORDER BY i)) AS v FROM a GROUP BY i // 64), c AS (SELECT i // 64 AS i, sha256(string_agg(v, ',' ORDER BY i)) AS v FROM b GROUP BY i // 64), e AS (SELECT sha256(string_agg(v, ',' ORDER BY i)) AS v FROM c),
n AS (SELECT count(*) AS n FROM events)
SELECT n.n AS rows, CASE WHEN n <= 64 THEN (SELECT max(v) FROM a) WHEN n <= 4096 THEN (SELECT max(v) FROM b) WHEN n <= 262144 THEN (SELECT max(v) FROM c) ELSE (SELECT max(v) FROM e) END AS sha256 FROM n""")
def ordered_digest(spark, d):
    """Digest of all values in the order of their ids."""
    return P.ordered_digest(_t(spark, d, "events"), "event_id", F.round(F.col("value") * 10).cast("long"), 64)


# --- sources, identities, records of figures, atoms -----------------------------------------------------------------------


@query("""WITH s AS (SELECT n_nationkey k, CASE WHEN n_nationkey % 11 = 0 THEN NULL ELSE n_name END AS name, CASE WHEN n_nationkey % 5 = 0 THEN ' ' ELSE 'u' END AS url FROM nation)
SELECT 'source' entity, CAST(k AS VARCHAR) id, unnest(list_filter([CASE WHEN k % 13 = 0 THEN 'source missing' END, CASE WHEN k % 13 = 0 OR name IS NULL THEN 'source.name missing' END, CASE WHEN k % 13 = 0 THEN 'source.full_name missing' END, CASE WHEN k % 13 = 0 OR url = ' ' THEN 'source.url missing' END, CASE WHEN k % 13 = 0 THEN 'source.license missing' END,
CASE WHEN k % 13 = 0 THEN 'source.license_url missing' END, CASE WHEN k % 13 = 0 THEN 'source.attribution_note missing' END, CASE WHEN k % 13 = 0 OR k % 3 = 0 THEN 'source.citation missing' END], lambda x: x IS NOT NULL)) AS rule FROM s""")
def source_block(spark, d):
    """What is missing from source blocks: texts, and citations (none at all, or a blank one among them)."""
    k, u = F.col("n_nationkey"), F.lit("u")
    cited = F.when(k % 6 == 0, F.expr("cast(array() as array<string>)")).when(k % 3 == 0, F.array(u, F.lit(" "))).otherwise(F.array(u))
    block = F.struct(F.when(k % 11 != 0, F.col("n_name")).alias("name"), u.alias("full_name"), F.when(k % 5 == 0, " ").otherwise("u").alias("url"), u.alias("license"), u.alias("license_url"), u.alias("attribution_note"), cited.alias("citation"))
    return Q.violations(_t(spark, d, "nation").select("n_nationkey", F.when(k % 13 != 0, block).alias("source")), "source", "n_nationkey", N.source_rules())


@query("""WITH x AS (SELECT p_partkey k, p_name a, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 7 = 0 THEN '' ELSE left(p_name, 3) || p_type END b FROM part),
y AS (SELECT *, list_filter(range(1, greatest(length(a), length(b)) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1)) AS d FROM x)
SELECT k, length(a) AS length_a, length(b) AS length_b, CAST(len(d) AS BIGINT) AS differing, CAST(d[1] AS DOUBLE) AS first, len(d) = 0 AND length(a) > 0 AS match FROM y""")
def sequence_identity(spark, d):
    """The document of each comparison of two sequences, and whether they are one."""
    k = F.col("p_partkey")
    x = _t(spark, d, "part").select(k.alias("k"), F.col("p_name").alias("a"), F.when(k % 3 == 0, F.col("p_name")).when(k % 7 == 0, "").otherwise(F.concat(F.substring("p_name", 1, 3), "p_type")).alias("b"))
    return N.sequence_identity(x, "k", "a", "b").withColumn("first", F.col("first").cast("double"))


@query("""WITH f AS (SELECT event_id k, CAST(event_type = 'purchase' AS INT) AS label, value AS score FROM events WHERE event_id % 17 > 0), w AS (SELECT event_id k, CASE WHEN event_id % 19 = 0 THEN 1 - CAST(event_type = 'purchase' AS INT) ELSE CAST(event_type = 'purchase' AS INT) END AS label, CASE WHEN event_id % 23 = 0 THEN value + 0.5 ELSE value + 1e-12 END AS score FROM events WHERE event_id % 29 > 0)
SELECT k, metric FROM (SELECT coalesce(f.k, w.k) k, unnest(list_filter([CASE WHEN f.label IS DISTINCT FROM w.label THEN 'label' END, CASE WHEN f.score IS NULL OR w.score IS NULL OR abs(f.score - w.score) > 1e-9 THEN 'score' END], lambda x: x IS NOT NULL)) AS metric FROM f FULL JOIN w ON f.k = w.k)""")
def recorded_scores(spark, d):
    """Scores and labels by id against those recorded: what differs, and what only one of both has."""
    k, y = F.col("event_id"), (F.col("event_type") == "purchase").cast("int")
    e = _t(spark, d, "events")
    found = e.where(k % 17 > 0).select(k.alias("k"), y.alias("label"), F.col("value").alias("score"))
    told = e.where(k % 29 > 0).select(k.alias("k"), F.when(k % 19 == 0, 1 - y).otherwise(y).alias("label"), F.when(k % 23 == 0, F.col("value") + 0.5).otherwise(F.col("value") + 1e-12).alias("score"))
    return G.metric_gate(found, told, "k").select("k", "metric")


@query("""WITH a AS (SELECT l_suppkey % 50 AS chain, l_partkey % 40 AS pos, CASE l_linenumber % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'CA' ELSE '' END AS atom, CASE WHEN l_orderkey % 211 = 0 THEN 'XXX' WHEN l_orderkey % 97 = 0 THEN 'GLY' ELSE 'ALA' END AS residue, CASE WHEN l_orderkey % 101 = 0 THEN 'B' ELSE '.' END AS icode, CASE WHEN l_orderkey % 89 = 0 THEN NULL ELSE l_quantity END AS x, l_extendedprice / 800 AS b FROM lineitem),
r AS (SELECT DISTINCT chain, pos, unnest(list_filter([CASE WHEN icode = 'B' THEN 'inserted residue' END, CASE WHEN atom = '' THEN 'no atom name' END, CASE WHEN residue = 'XXX' THEN 'unknown residue' END, CASE WHEN x IS NULL THEN 'coordinates' END, CASE WHEN NOT (b BETWEEN 0 AND 100) THEN 'confidence' END], lambda v: v IS NOT NULL)) AS rule FROM a),
p AS (SELECT chain, pos, count(DISTINCT residue) n, bool_or(atom = 'CA') ca FROM a GROUP BY ALL)
SELECT chain, pos, rule FROM r UNION ALL SELECT chain, pos, 'two residue names' FROM p WHERE n > 1 UNION ALL SELECT chain, pos, 'no CA' FROM p WHERE NOT ca UNION ALL SELECT chain, -1, 'fewer than two residues' FROM p GROUP BY chain HAVING count(*) < 2""")
def atom_violations(spark, d):
    """What keeps chains from being scored, by place."""
    k, line = F.col("l_orderkey"), F.col("l_linenumber") % 3
    a = _t(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("chain"), (F.col("l_partkey") % 40).alias("pos"), F.when(line == 0, "N").when(line == 1, "CA").otherwise("").alias("atom"), F.when(k % 211 == 0, "XXX").when(k % 97 == 0, "GLY").otherwise("ALA").alias("residue"),
        F.when(k % 101 == 0, "B").otherwise(".").alias("icode"), F.when(k % 89 != 0, F.col("l_quantity")).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), (F.col("l_extendedprice") / 800).alias("b"),
    )
    return T.inference_rules(a, ["chain"]).withColumn("pos", F.coalesce("pos", F.lit(-1)))
