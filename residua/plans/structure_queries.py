"""Queries of structure tables, manifests, matrices, scoring and evaluation, with the SQL that gives the same rows.

Customers stand in for candidates and proteins, line items for matrix cells and atoms, embeddings for residues in space.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import residues as R
from ..operators import comparison as M
from ..operators import evaluation as E
from ..operators import learning as L
from ..operators import manifest as N
from ..operators import matrices as X
from ..operators import quality as Q
from ..operators import scoring as P
from ..operators import spatial as S
from ..operators import structures as T
from .catalogue import _FOLDS, _M, _P, _S, _cells, _prob, _rounded, _scored, _t, query

# --- candidates, records, downloads --------------------------------------------------------------------------------------

_CAND = """WITH c AS (SELECT c_custkey k, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'P' || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') END acc, c_custkey % 700 len, c_nationkey % 3 v,
CASE c_nationkey % 4 WHEN 0 THEN 'enzyme' WHEN 1 THEN 'oxygen_binding' WHEN 2 THEN 'antioxidant_enzyme' ELSE 'other' END cat, c_mktsegment seg FROM customer),
d AS (SELECT *, CASE WHEN k % 13 = 0 THEN acc || 'X' ELSE acc END pid, CASE WHEN k % 7 = 0 THEN 'AF-' || acc || '-F2' ELSE 'AF-' || acc || '-F1' END entry FROM c),
e AS (SELECT *, entry || '-model_v' || CASE WHEN k % 5 = 0 THEN 9 ELSE v END || '.cif' model FROM d)"""


def _candidates(spark, d):
    k = F.col("k")
    c = _t(spark, d, "customer").select(
        F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 11 == 0, "").otherwise(F.concat(F.lit("P"), F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0"))).alias("uniprot_accession"),
        (F.col("c_custkey") % 700).alias("sequence_length"), (F.col("c_nationkey") % 3).cast("int").alias("model_version_recorded"), F.element_at(F.array(F.lit("enzyme"), F.lit("oxygen_binding"), F.lit("antioxidant_enzyme"), F.lit("other")), (F.col("c_nationkey") % 4 + 1).cast("int")).alias("category"),
        F.col("c_mktsegment").alias("status"),
    )
    acc = F.col("uniprot_accession")
    c = c.withColumn("protein_id", F.when(k % 13 == 0, F.concat(acc, F.lit("X"))).otherwise(acc)).withColumn("afdb_entry_id", F.concat(F.lit("AF-"), acc, F.when(k % 7 == 0, "-F2").otherwise("-F1")))
    return c.withColumn("planned_model_file", F.concat("afdb_entry_id", F.lit("-model_v"), F.when(k % 5 == 0, 9).otherwise(F.col("model_version_recorded")).cast("string"), F.lit(".cif")))


@query(_CAND + r""" SELECT 'candidate' entity, CAST(k AS VARCHAR) id, unnest(list_filter([CASE WHEN acc = '' THEN 'uniprot_accession missing' END, CASE WHEN acc <> '' AND NOT regexp_full_match(acc, '([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})') THEN 'accession form' END,
CASE WHEN acc <> '' AND pid <> acc THEN 'id differs' END, CASE WHEN NOT regexp_full_match(entry, 'AF-[A-Z0-9]{6,10}-F[0-9]+') THEN 'entry form' END, CASE WHEN acc <> '' AND regexp_full_match(entry, 'AF-[A-Z0-9]{6,10}-F[0-9]+') AND entry <> 'AF-' || acc || '-F1' THEN 'entry differs' END,
CASE WHEN cat = 'other' THEN 'category not allowed' END, CASE WHEN seg NOT IN ('BUILDING', 'MACHINERY') THEN 'status not allowed' END, CASE WHEN len NOT BETWEEN 20 AND 600 THEN 'length' END, CASE WHEN v < 1 THEN 'version' END,
CASE WHEN acc <> '' AND v >= 1 AND model <> entry || '-model_v' || v || '.cif' THEN 'planned_model_file differs' END, CASE WHEN pid = '' THEN 'protein_id missing' END], lambda x: x IS NOT NULL)) AS rule FROM e""")
def candidate_rules(spark, d):
    c = _candidates(spark, d).withColumn("planned_pae_file", F.concat("afdb_entry_id", F.format_string("-predicted_aligned_error_v%d.json", F.col("model_version_recorded"))))
    rules = N.candidate_rules(("uniprot_accession", "protein_id"), {}, {"category": N.ALLOWED["category"], "status": ("BUILDING", "MACHINERY")})
    return Q.violations(c, "candidate", "k", rules)


@query(_CAND + """, u AS (SELECT 'uniprot_accession' "column", acc AS value FROM e UNION ALL SELECT 'planned_model_file', model FROM e UNION ALL SELECT 'category', cat FROM e) SELECT "column", value, count(*) n FROM u WHERE value <> '' GROUP BY ALL HAVING count(*) > 1""")
def repeated_values(spark, d):
    return N.repeated_values(_candidates(spark, d), ("uniprot_accession", "planned_model_file", "category"))


@query(_CAND + ", g AS (SELECT count(*) n, count(DISTINCT cat) kinds FROM e) SELECT 'error' AS level, 'few categories' AS rule FROM g WHERE kinds < 5 UNION ALL SELECT 'warning', 'count' FROM g WHERE n NOT BETWEEN 5 AND 10")
def set_rules(spark, d):
    return N.set_rules(_candidates(spark, d), categories=5)


@query("""WITH r AS (SELECT page_id, 'P' || page_id acc, CASE WHEN page_id % 9 = 0 THEN 'Q' || page_id ELSE 'P' || page_id END up, 'AF-P' || CASE WHEN page_id % 8 = 0 THEN 0 ELSE page_id END || '-F1' entry, CASE WHEN page_id % 6 = 0 THEN NULL ELSE page_id % 10 = 0 END cx, page_id % 4 v, url FROM pages)
SELECT 'record' entity, CAST(page_id AS VARCHAR) id, unnest(list_filter([CASE WHEN up <> acc THEN 'accession' END, CASE WHEN NOT starts_with(entry, 'AF-' || acc || '-') THEN 'entry' END, CASE WHEN cx IS NULL OR cx THEN 'complex' END, CASE WHEN v < 1 THEN 'version' END,
CASE WHEN url IS NULL OR NOT starts_with(url, 'https://') THEN 'structure url' END, CASE WHEN url IS NULL OR NOT starts_with(url, 'https://') THEN 'matrix url' END], lambda x: x IS NOT NULL)) AS rule FROM r""")
def record_rules(spark, d):
    k = F.col("page_id")
    p = lambda x: F.concat(F.lit("P"), x.cast("string"))
    r = _t(spark, d, "pages").select(
        k, p(k).alias("accession"), F.when(k % 9 == 0, F.concat(F.lit("Q"), k.cast("string"))).otherwise(p(k)).alias("uniprotAccession"), F.concat(F.lit("AF-"), p(F.when(k % 8 == 0, 0).otherwise(k)), F.lit("-F1")).alias("entryId"),
        F.when(k % 6 != 0, k % 10 == 0).alias("isComplex"), (k % 4).cast("int").alias("latestVersion"), F.col("url").alias("cifUrl"), F.col("url").alias("paeDocUrl"),
    )
    return Q.violations(r, "record", "page_id", N.record_rules(prefix="https://"))


@query("SELECT page_id, coalesce(regexp_extract(url, '^([a-z]+)://([^/:?#]+)', 1) = 'https' AND regexp_extract(url, '^([a-z]+)://([^/:?#]+)', 2) LIKE '%0.%', false) AS secure FROM pages")
def url_allow_list(spark, d):
    p = _t(spark, d, "pages")
    hosts = p.select(F.regexp_extract("url", "^([a-z]+)://([^/:?#]+)", 2).alias("host")).where("host like '%0.%'")
    return N.allowed_by(p, "url", hosts, "host").select("page_id", F.col("allowed").alias("secure"))


@query("SELECT o_orderkey, CASE WHEN (CASE o_orderstatus WHEN 'F' THEN 404 ELSE 200 END) = 200 AND o_custkey % 10 > 0 THEN 'OK' ELSE 'FAILED' END AS download_status FROM orders")
def download_status(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", N.download_status(F.when(F.col("o_orderstatus") == "F", 404).otherwise(200), F.col("o_custkey") % 10).alias("download_status"))


_DOWN = "WITH f AS (SELECT o_custkey k, CASE o_orderkey % 2 WHEN 0 THEN 'cif' ELSE 'pae' END kind, max(o_orderstatus) status, min(md5(CAST(o_orderkey AS VARCHAR))) checksum FROM orders WHERE o_orderkey % 5 > 0 GROUP BY ALL), w AS (SELECT k, max(CASE WHEN kind = 'cif' THEN status END) cif_status, max(CASE WHEN kind = 'cif' THEN checksum END) cif_checksum, max(CASE WHEN kind = 'pae' THEN status END) pae_status, max(CASE WHEN kind = 'pae' THEN checksum END) pae_checksum FROM f GROUP BY k)"


def _downloads(spark, d):
    o = _t(spark, d, "orders").where("o_orderkey % 5 > 0")
    f = o.groupBy(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 0, "cif").otherwise("pae").alias("kind")).agg(F.max("o_orderstatus").alias("status"), F.min(F.md5(F.col("o_orderkey").cast("string"))).alias("checksum"))
    return N.by_file_type(f, "k", "kind", ["cif", "pae"], ["status", "checksum"])


@query(_DOWN + " SELECT c_custkey AS k, CASE WHEN c_nationkey % 3 > 0 AND c_nationkey % 5 > 0 AND cif_status = 'P' AND pae_status = 'P' AND cif_checksum <> '' AND pae_checksum <> '' THEN 'DOWNLOADED_VALIDATED' ELSE 'FAILED' END status FROM customer LEFT JOIN w ON k = c_custkey")
def manifest_status(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_nationkey") % 3 > 0, "PASS").otherwise("FAIL").alias("s"), F.when(F.col("c_nationkey") % 5 > 0, "PASS").otherwise("FAIL").alias("m"))
    j = c.join(_downloads(spark, d), "k", "left")
    ok = lambda x: F.when(F.col(x) == "P", "OK").otherwise("FAILED")
    return j.select("k", N.manifest_status(F.col("s"), F.col("m"), (ok("cif_status"), F.col("cif_checksum")), (ok("pae_status"), F.col("pae_checksum"))).alias("status"))


@query("""WITH s AS (SELECT p_partkey k, CASE WHEN p_partkey % 17 = 0 THEN 'unreadable' ELSE '' END error, p_partkey % 6 = 0 m2, p_partkey % 9 = 0 c2, CAST(CASE WHEN p_partkey % 19 = 0 THEN 2 ELSE 0 END AS BIGINT) unknown, length(p_name) observed, CASE WHEN p_partkey % 4 = 0 THEN length(p_name) + 1 ELSE length(p_name) END expected,
p_partkey % 7 > 0 sm, md5(p_name) = md5(CASE WHEN p_partkey % 8 = 0 THEN p_type ELSE p_name END) mm FROM part)
SELECT k, CASE WHEN error = '' AND NOT m2 AND NOT c2 AND unknown = 0 AND observed > 0 AND sm AND observed = expected AND mm THEN 'PASS' ELSE 'FAIL' END validation_status,
array_to_string(list_filter([CASE WHEN error <> '' THEN error END, CASE WHEN unknown > 0 THEN unknown || ' unknown residues' END, CASE WHEN observed <> expected THEN 'length ' || observed || ' not ' || expected END, CASE WHEN NOT sm THEN 'sequence differs' END, CASE WHEN NOT mm THEN 'checksum differs' END], lambda x: x IS NOT NULL), '; ') notes FROM s""")
def structure_status(spark, d):
    k, n = F.col("k"), F.length("p_name")
    s = _t(spark, d, "part").withColumn("k", F.col("p_partkey")).select(
        "k", F.when(k % 17 == 0, "unreadable").otherwise("").alias("error"), F.when(k % 6 == 0, 2).otherwise(1).alias("model_count"), F.when(k % 9 == 0, 2).otherwise(1).alias("chain_count"), F.when(k % 19 == 0, 2).otherwise(0).alias("unknown"),
        n.alias("observed"), F.when(k % 4 == 0, n + 1).otherwise(n).alias("expected"), (k % 7 > 0).alias("sequence_match"), (F.md5("p_name") == F.md5(F.when(k % 8 == 0, F.col("p_type")).otherwise(F.col("p_name")))).alias("md5_match"),
    )
    status, notes = N.structure_status()
    return s.select("k", status.alias("validation_status"), notes.alias("notes"))


_TWO = "WITH a AS (SELECT c_custkey k, c_name AS name, c_nationkey AS version FROM customer WHERE c_custkey % 10 > 0), b AS (SELECT c_custkey k, CASE WHEN c_custkey % 6 = 0 THEN upper(c_name) ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS version FROM customer WHERE c_custkey % 9 > 0), m AS (SELECT coalesce(a.k, b.k) k, a.k ak, b.k bk, a.name an, b.name bn, a.version av, b.version bv, unnest(list_filter([CASE WHEN a.k IS NULL OR b.k IS NULL THEN 'k' END, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL AND a.name IS DISTINCT FROM b.name THEN 'name' END, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL AND a.version IS DISTINCT FROM b.version THEN 'version' END], lambda x: x IS NOT NULL)) AS \"column\" FROM a FULL JOIN b ON a.k = b.k)"


def _two(spark, d):
    c, k = _t(spark, d, "customer"), F.col("c_custkey")
    a = c.where(k % 10 > 0).select(k.alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("version"))
    return a, c.where(k % 9 > 0).select(k.alias("k"), F.when(k % 6 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("name"), F.when(k % 4 != 0, F.col("c_nationkey")).alias("version"))


@query(_TWO + """ SELECT k, "column", CASE "column" WHEN 'k' THEN CAST(ak AS VARCHAR) WHEN 'name' THEN an ELSE CAST(av AS VARCHAR) END AS "left", CASE "column" WHEN 'k' THEN CAST(bk AS VARCHAR) WHEN 'name' THEN bn ELSE CAST(bv AS VARCHAR) END AS "right" FROM m""")
def identity_mismatches(spark, d):
    return N.mismatches(*_two(spark, d), "k", ["name", "version"])


@query(_TWO + ' SELECT "column", count(*) n FROM m GROUP BY ALL')
def changed_columns(spark, d):
    return N.changed_columns(*_two(spark, d), "k", ["name", "version"])


@query("SELECT p_partkey, CAST(len(list_filter(range(1, greatest(length(p_name), length(p_type)) + 1), lambda i: substr(p_name, i, 1) <> substr(p_type, i, 1))) AS BIGINT) differing FROM part")
def sequence_differences(spark, d):
    return N.sequence_differences(_t(spark, d, "part"), "p_partkey", "p_name", "p_type")


@query(r"""SELECT 'document' entity, CAST(doc_id AS VARCHAR) id, unnest(list_filter([CASE WHEN regexp_matches(text, '\b20[0-9]{2}-[01][0-9]-[0-3][0-9]\b') THEN 'text date' END, CASE WHEN regexp_matches(text, '(^|[\s"''])/(home|root|tmp|Users|mnt|var)/') THEN 'text path' END,
CASE WHEN contains(text, chr(13)) THEN 'text carriage return' END, CASE WHEN starts_with(text, chr(65279)) THEN 'text mark' END, CASE WHEN NOT ends_with(text, chr(10)) THEN 'text end' END], lambda x: x IS NOT NULL)) AS rule FROM documents""")
def text_hygiene(spark, d):
    return Q.violations(_t(spark, d, "documents"), "document", "doc_id", N.hygiene(F.col("text")))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https:/') THEN substr(url, 8) ELSE url END path FROM pages")
def relative_path(spark, d):
    return _t(spark, d, "pages").select("page_id", N.relative_path(F.col("url"), "https:/").alias("path"))


# --- atoms, residues, chains ---------------------------------------------------------------------------------------------

_ATOMS = "WITH a AS (SELECT l_suppkey AS file, l_orderkey % 40 AS pos, l_orderkey * 10 + l_linenumber AS ordinal, CASE l_linenumber WHEN 1 THEN 'CA' WHEN 2 THEN 'N' WHEN 3 THEN 'C' WHEN 4 THEN 'O' ELSE 'CB' END atom, l_returnflag residue, l_quantity x, l_discount y, l_tax z, l_extendedprice b FROM (SELECT DISTINCT ON (l_suppkey, l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate))"


def _atoms(spark, d):
    x = _t(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_extendedprice", "l_shipdate", "l_returnflag", "l_quantity", "l_discount", "l_tax")).alias("v"))
    names = F.array(*[F.lit(c) for c in ("CA", "N", "C", "O", "CB", "CB", "CB", "CB")])
    return x.select(
        F.col("l_suppkey").alias("file"), (F.col("l_orderkey") % 40).alias("pos"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.element_at(names, F.col("l_linenumber").cast("int")).alias("atom"),
        F.col("v.l_returnflag").alias("residue"), F.col("v.l_quantity").alias("x"), F.col("v.l_discount").alias("y"), F.col("v.l_tax").alias("z"), F.col("v.l_extendedprice").alias("b"),
    )


@query(_ATOMS + """, o AS (SELECT file, pos, atom, min(ordinal) ordinal, arg_min(b, ordinal) b, arg_min(x, ordinal) x FROM a GROUP BY ALL)
SELECT file, pos, count(*) n_atoms, count(*) FILTER (WHERE atom IN ('N', 'CA', 'C', 'O')) n_backbone_atoms, round(avg(x), 6) centroid_x, round(coalesce(max(CASE WHEN atom = 'CA' THEN b END), avg(b)), 6) plddt_ca, round(min(b), 6) plddt_atom_min, round(max(b), 6) plddt_atom_max, round(avg(b), 6) plddt_atom_mean FROM o GROUP BY ALL""")
def residue_atoms(spark, d):
    r = T.residue_atoms(_atoms(spark, d), ["file", "pos"])
    return _rounded(r.select("file", "pos", "n_atoms", "n_backbone_atoms", "centroid_x", "plddt_ca", "plddt_atom_min", "plddt_atom_max", "plddt_atom_mean"))


@query("SELECT o_orderstatus AS chain, count(*) n, round(avg(v), 6) mean, min(v) least, max(v) most, round(avg(CAST(v >= 70 AS DOUBLE)), 6) share_1, round(avg(CAST(v >= 90 AS DOUBLE)), 6) share_2 FROM (SELECT o_orderstatus, CAST(o_custkey % 101 AS DOUBLE) v FROM orders) GROUP BY 1")
def chain_confidence(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderstatus").alias("chain"), (F.col("o_custkey") % 101).cast("double").alias("v"))
    return _rounded(T.confidence(o, ["chain"], "v"))


@query('SELECT count(*) AS "rows", count(DISTINCT l_returnflag) models, count(DISTINCT l_suppkey) chains, count(DISTINCT (l_suppkey, l_partkey)) residues FROM lineitem')
def structure_totals(spark, d):
    return T.totals(_t(spark, d, "lineitem"), models=["l_returnflag"], chains=["l_suppkey"], residues=["l_suppkey", "l_partkey"])


@query("SELECT label, round(max(embedding[1]) - min(embedding[1]), 5) size_x, round(max(embedding[2]) - min(embedding[2]), 5) size_y, round(max(embedding[3]) - min(embedding[3]), 5) size_z FROM (SELECT label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) embedding FROM embeddings) GROUP BY label")
def bounding_box(spark, d):
    p = _t(spark, d, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    return _rounded(T.bounding_box(p, ["label"]), 5)


@query("SELECT c_mktsegment AS chain, min(c_custkey) AS first FROM customer GROUP BY 1")
def ordered_chains(spark, d):
    return T.ordered_distinct(_t(spark, d, "customer").select(F.col("c_mktsegment").alias("chain"), "c_custkey"), "chain", "c_custkey")


@query("""WITH a AS (SELECT o_orderstatus g, o_orderkey k, CAST(o_custkey AS DOUBLE) v FROM orders), b AS (SELECT o_orderstatus g, o_orderkey k, CASE WHEN o_orderkey % 50 = 0 THEN o_custkey + 3.0 ELSE o_custkey END v FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 9 > 0)
SELECT coalesce(a.g, b.g) g, count(a.v) n_a, count(b.v) n_b, round(avg(abs(a.v - b.v)), 6) mean_diff, max(abs(a.v - b.v)) max_diff, count(a.v) = count(b.v) AND avg(abs(a.v - b.v)) <= 0.5 aligned FROM a FULL JOIN b ON a.g = b.g AND a.k = b.k GROUP BY 1""")
def channel_alignment(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderstatus").alias("g"), F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("double").alias("v"))
    b = o.where("g <> 'P' or k % 9 > 0").withColumn("v", F.when(F.col("k") % 50 == 0, F.col("v") + 3.0).otherwise(F.col("v")))
    return _rounded(T.channel_alignment(o, b, ["g"], "k", "v"))


@query("SELECT c_nationkey AS file, count(DISTINCT c_mktsegment) chains, 'several chains' AS rule FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) <> 1")
def single_chain(spark, d):
    return T.chain_rules(_t(spark, d, "customer").withColumnRenamed("c_nationkey", "file"), "file", "c_mktsegment")


@query("SELECT c_nationkey AS file, count(DISTINCT c_mktsegment) chains, 'no such chain' AS rule FROM (SELECT * FROM customer WHERE NOT (c_nationkey % 3 = 0 AND c_mktsegment = 'BUILDING')) GROUP BY 1 HAVING max(CAST(c_mktsegment = 'BUILDING' AS INT)) = 0")
def wanted_chain(spark, d):
    c = _t(spark, d, "customer").where("not (c_nationkey % 3 = 0 and c_mktsegment = 'BUILDING')").withColumnRenamed("c_nationkey", "file")
    return T.chain_rules(c, "file", "c_mktsegment", "BUILDING")


@query("SELECT l_suppkey AS file, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus = 'O') atoms, count(*) FILTER (WHERE l_returnflag = 'R') hetero, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus <> 'O') other_places, count(*) FILTER (WHERE l_linenumber = 7) inserted FROM lineitem GROUP BY 1")
def record_counts(spark, d):
    a = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.when(F.col("l_returnflag") == "R", "HETATM").otherwise("ATOM").alias("record"), F.when(F.col("l_linestatus") == "O", "A").otherwise("B").alias("alt"), F.when(F.col("l_linenumber") == 7, "C").otherwise("?").alias("icode"))
    return T.record_counts(a, ["file"], icode="icode")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def row_selection(spark, d):
    c = _t(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return T.only(_t(spark, d, "orders"), "o_custkey", c.where("c_acctbal > 0"), c.where("c_nationkey = 7"), F.col("o_orderstatus") == "O").select("o_orderkey", "o_custkey")


@query("SELECT o_orderstatus AS status, count(*) n, CAST(list_slice(list(o_orderkey ORDER BY o_orderkey), 1, 10) AS VARCHAR) AS first FROM orders WHERE o_totalprice < 100000 GROUP BY 1")
def first_offenders(spark, d):
    x = T.first_offenders(_t(spark, d, "orders").where("o_totalprice < 100000").withColumnRenamed("o_orderstatus", "status"), ["status"], "o_orderkey")
    return x.select("status", "n", F.concat(F.lit("["), F.array_join(F.col("first").cast("array<string>"), ", "), F.lit("]")).alias("first"))


@query(_S + ", c AS (SELECT l_suppkey % 5 grp, CAST(l_partkey % 60 AS BIGINT) i, CAST(l_orderkey % 60 AS BIGINT) j, avg(l_quantity) v FROM lineitem GROUP BY ALL), r AS (SELECT grp, count(*) n, avg(score) a, min(score) b, max(score) c FROM s GROUP BY grp), m AS (SELECT grp, count(*) cells, avg(v) d, min(v) e, max(v) f FROM c GROUP BY grp), x AS (SELECT s_suppkey AS grp, CASE WHEN s_suppkey % 3 = 0 THEN 60 ELSE 61 END expected FROM supplier), "
"y AS (SELECT x.grp, expected, coalesce(n, 0) n, a, b, c, d, e, f, array_to_string(list_filter([CASE WHEN n IS NULL THEN 'no rows' END, CASE WHEN n <> expected THEN 'length' END, CASE WHEN coalesce(cells, 0) <> expected * expected THEN 'matrix shape' END], lambda q: q IS NOT NULL), '; ') notes FROM x LEFT JOIN r USING (grp) LEFT JOIN m USING (grp)) "
'SELECT grp, expected, n AS "rows", round(a, 6) mean_value, b min_value, c max_value, round(d, 6) mean_cell, round(e, 6) min_cell, round(f, 6) max_cell, CASE WHEN notes = \'\' THEN \'PASS\' ELSE \'FAIL\' END status, notes FROM y')
def protein_summary(spark, d):
    expected = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("grp"), F.when(F.col("s_suppkey") % 3 == 0, 60).otherwise(61).alias("expected"))
    return _rounded(T.protein_summary(_scored(spark, d), _cells(spark, d), expected, "grp", "score"))


_RES = """WITH v AS (SELECT label grp, row_number() OVER (PARTITION BY label ORDER BY vec_id) pos, CAST(embedding[1] AS DOUBLE) x, CAST(embedding[2] AS DOUBLE) y, CAST(embedding[3] AS DOUBLE) z, vec_id % 97 plddt, substr('ACDEFGHIKLMNPQRSTVWY', CAST(vec_id % 20 + 1 AS INT), 1) letter, vec_id % 9 + 4 n_atoms FROM embeddings),
b AS (SELECT a.grp, a.pos, count(*) density, round(avg(b.plddt), 3) nv, round(avg((a.pos * 7 + b.pos * 3) % 30), 3) nc FROM v a JOIN v b ON a.grp = b.grp AND a.pos <> b.pos AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 0.15 GROUP BY ALL),
r AS (SELECT a.grp, a.pos, avg((a.pos * 7 + b.pos * 3) % 30) rm, avg((b.pos * 7 + a.pos * 3) % 30) cm, avg((a.pos * 7 + b.pos * 3) % 30) FILTER (WHERE a.pos <> b.pos AND abs(a.pos - b.pos) <= 10) lm FROM v a JOIN v b ON a.grp = b.grp GROUP BY ALL)"""


def _residues(spark, d):
    from pyspark.sql import Window as W

    e = _t(spark, d, "embeddings")
    letter = F.substring(F.lit("ACDEFGHIKLMNPQRSTVWY"), (F.col("vec_id") % 20 + 1).cast("int"), F.lit(1))
    r = e.select(F.col("label").alias("grp"), F.row_number().over(W.partitionBy("label").orderBy("vec_id")).cast("long").alias("pos"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")], (F.col("vec_id") % 97).cast("double").alias("plddt"), letter.alias("letter"), (F.col("vec_id") % 9 + 4).alias("n_atoms"))
    # as in the SQL the matrix is a rule, so none of its cells, the square of a group's rows, is a row
    cells = S.Rule(lambda i, j: ((i * 7 + j * 3) % 30).cast("double"), 30, 10)
    return r, cells


@query(_RES + """ SELECT v.grp, v.pos, letter, CASE WHEN contains('AVLIM', letter) THEN 'nonpolar' WHEN contains('FWY', letter) THEN 'aromatic' WHEN contains('STCNQ', letter) THEN 'polar' WHEN contains('KRH', letter) THEN 'basic' WHEN contains('DE', letter) THEN 'acidic' ELSE 'special' END class,
CASE WHEN letter IN ('D', 'E') THEN -1 WHEN letter IN ('K', 'R') THEN 1 ELSE 0 END charge, n_atoms, CAST(plddt AS DOUBLE) plddt_ca, round(rm, 6) row_mean, round(cm, 6) col_mean, round(lm, 6) local_mean, coalesce(density, 0) density, nv + 0.0 neighbour_value, nc + 0.0 neighbour_cell,
CAST(contains('DE', letter) AS DOUBLE) class_acidic, CAST(contains('KRH', letter) AS DOUBLE) class_basic FROM v JOIN r USING (grp, pos) LEFT JOIN b USING (grp, pos)""")
def feature_table(spark, d):
    r, cells = _residues(spark, d)
    return _rounded(T.features(r, cells, "grp", 0.15).drop("hydropathy", "class_aromatic", "class_nonpolar", "class_polar", "class_special"))


@query(_RES + " SELECT 'residue' entity, v.grp || '/' || v.pos AS id, unnest(list_filter([CASE WHEN density IS NULL THEN 'no neighbour' END, CASE WHEN lm IS NULL THEN 'local_mean not finite' END], lambda q: q IS NOT NULL)) AS rule FROM v JOIN r USING (grp, pos) LEFT JOIN b USING (grp, pos)")
def feature_gate(spark, d):
    r, cells = _residues(spark, d)
    f = T.features(r, cells, "grp", 0.15).withColumn("id", F.concat_ws("/", F.col("grp").cast("string"), F.col("pos").cast("string")))
    return Q.violations(f, "residue", "id", T.feature_rules())


# --- matrices ------------------------------------------------------------------------------------------------------------


@query(_M + """ SELECT grp, round(max(abs(m.value - o.value)), 6) asymmetry, round(min(m.value) FILTER (WHERE m.i = m.j), 6) diagonal_least, round(max(m.value) FILTER (WHERE m.i = m.j), 6) diagonal_most, round(avg(m.value) FILTER (WHERE m.i <> m.j), 6) other_mean, round(max(m.value) FILTER (WHERE m.i <> m.j), 6) other_most,
count(*) FILTER (WHERE m.i < m.j AND m.value >= 25) contacts, round(quantile_cont(m.value, 0.5) FILTER (WHERE m.i = m.j), 6) diagonal_median, round(quantile_cont(m.value, 0.5) FILTER (WHERE m.i <> m.j), 6) other_median FROM m LEFT JOIN (SELECT grp, j i, i j, value FROM m) o USING (grp, i, j) GROUP BY grp""")
def contact_matrix_stats(spark, d):
    return _rounded(X.contact_stats(_cells(spark, d), "grp", 25.0))


# --- scores --------------------------------------------------------------------------------------------------------------


@query(_S + ", g AS (SELECT grp % 7 grp, count(*) n, CAST(sum(label) AS BIGINT) pos FROM s GROUP BY 1) SELECT grp, n, pos, round(pos / n, 6) prevalence, round(CASE WHEN pos > 0 THEN (n - pos) / pos END, 6) ratio FROM g")
def class_balance(spark, d):
    return _rounded(E.class_balance(_scored(spark, d).withColumn("grp", F.col("grp") % 7), "label", ["grp"]))


@query(_S + ", g AS (SELECT pos % 500 g, max(label) p FROM s GROUP BY 1) SELECT count(*) AS groups, count(*) FILTER (WHERE p = 0) zero_positive, count(*) FILTER (WHERE p > 0) evaluable FROM g")
def evaluable_groups(spark, d):
    return E.evaluable(_scored(spark, d).withColumn("g", F.col("pos") % 500), "g", "label")


_ROC = "(sum(p * (below + (n + 1) / 2.0)) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * (sum(n) - sum(p)))"


@query(_S + f""", z AS (SELECT label, round(CASE WHEN stddev_pop(score) OVER g > 0 THEN (score - avg(score) OVER g) / stddev_pop(score) OVER g ELSE 0 END, 9) z FROM s WINDOW g AS (PARTITION BY grp)),
a AS (SELECT score, count(*) n, sum(label) p FROM s GROUP BY 1), b AS (SELECT z, count(*) n, sum(label) p FROM z GROUP BY 1),
c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) below FROM a), e AS (SELECT *, coalesce(sum(n) OVER (ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) below FROM b),
x AS (SELECT {_ROC} r FROM c), y AS (SELECT {_ROC} r FROM e) SELECT round(x.r, 5) pooled_roc, round(y.r, 5) within_roc, round(x.r - y.r, 5) gap FROM x, y""")
def inflation_gap(spark, d):
    return _rounded(E.inflation_gap(_scored(spark, d), "grp", "score", "label"), 5)


@query(_FOLDS.replace("user_id % 40 AS grp", "0 AS grp, user_id % 40 AS g").replace("FROM events), t", "FROM events), o AS (SELECT * FROM s), h AS (SELECT g, max(label) a FROM o GROUP BY g), v AS (SELECT 'all' grp, score, label FROM o UNION ALL SELECT 'with positives', score, label FROM o JOIN h USING (g) WHERE a = 1 UNION ALL SELECT 'without 3, 5', score, label FROM o WHERE g NOT IN (3, 5)), t").replace("sum(label) p FROM s GROUP", "sum(label) p FROM v GROUP") + " SELECT grp AS variant, n, pos, round(roc, 6) roc, round(pr, 6) pr FROM f")
def sensitivity(spark, d):
    return _rounded(E.sensitivity(_scored(spark, d), "grp", "score", "label", {"without 3, 5": [3, 5]}))


@query(_P.replace("least(greatest(score / 1000.0, 0), 1) p FROM s)", "round(least(greatest(score / 1000.0, 0), 1), 4) p, round(least(greatest(score / 1000.0, 0), 1), 1) q FROM s)") + f""", u AS (SELECT grp, p s, label, 0 k FROM p UNION ALL SELECT grp, q, label, 1 FROM p), t AS (SELECT k, grp, s, count(*) n, sum(label) p FROM u GROUP BY ALL),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY k, grp ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) below FROM t), r AS (SELECT k, grp, CASE WHEN sum(p) > 0 AND sum(p) < sum(n) THEN {_ROC} END roc FROM b GROUP BY ALL),
w AS (SELECT grp, max(CASE WHEN k = 0 THEN roc END) a, max(CASE WHEN k = 1 THEN roc END) b FROM r GROUP BY grp)
SELECT count(*) folds, round(max(abs(b - a)), 6) max_roc_change, count(*) FILTER (WHERE b - a > 1e-9) up, count(*) FILTER (WHERE b - a < -1e-9) down FROM w WHERE a IS NOT NULL""")
def calibration_effect(spark, d):
    x = _prob(spark, d).select("grp", "label", F.round("p", 4).alias("p"), F.round("p", 1).alias("q"))
    return _rounded(E.calibration_effect(x, "grp", "p", "q", "label").drop("max_pr_change", "mean_spearman"))


_CAL = [0.0, 0.2, 0.5, 1.0], [0.01, 0.05, 0.4, 0.9]
_PRED = _P + """, e AS (SELECT grp, pos, p, CASE WHEN p <= 0.2 THEN 0.01 + p * 0.2 WHEN p <= 0.5 THEN 0.05 + (p - 0.2) * (0.35 / 0.3) ELSE 0.4 + (p - 0.5) * 1.0 END c FROM p)"""


def _predicted(spark, d):
    return P.predictions(_prob(spark, d), "p", {"method": "isotonic", "x": _CAL[0], "y": _CAL[1]}, 0.06)


@query(_PRED + " SELECT pos, round(c, 6) probability_calibrated, CAST(c >= 0.06 AS INT) predicted FROM e")
def isotonic_predictions(spark, d):
    return _rounded(_predicted(spark, d).select("pos", "probability_calibrated", "predicted"))


@query(_PRED + " SELECT grp, count(*) n, CAST(sum(CAST(c >= 0.06 AS INT)) AS BIGINT) positives, round(avg(CAST(c >= 0.06 AS DOUBLE)), 6) share, round(avg(p), 6) mean_raw, round(avg(c), 6) mean_calibrated, round(max(c), 6) most, arg_max(pos, (c, -pos)) most_pos FROM e GROUP BY grp")
def prediction_summary(spark, d):
    return _rounded(P.summary(_predicted(spark, d).withColumn("letter", F.lit("A")), ["grp"], "pos", "letter").drop("most_letter"))


@query(_PRED + " SELECT pos, round(c, 6) probability_calibrated FROM e ORDER BY c DESC, pos LIMIT 25")
def top_predictions(spark, d):
    return _rounded(P.top(_predicted(spark, d), "pos", 25).select("pos", "probability_calibrated"))


@query("WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN CAST(c_nationkey AS DOUBLE) END a FROM customer) SELECT c_custkey, round(coalesce(a, (SELECT avg(a) FROM c)), 6) a FROM c")
def mean_imputation(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.col("c_nationkey").cast("double")).alias("a"))
    return _rounded(P.imputed(c, ["a"]))


@query("""WITH s AS (SELECT DISTINCT 'depth' AS name, CAST(p_size % 3 + 5 AS DOUBLE) AS value FROM part UNION SELECT DISTINCT 'leaves', CAST(p_size % 4 * 8 + 15 AS DOUBLE) FROM part)
SELECT 'base' AS config, NULL AS name, CAST(NULL AS DOUBLE) AS value, CAST(6 AS DOUBLE) AS depth, CAST(31 AS DOUBLE) AS leaves UNION ALL
SELECT name || '=' || CAST(value AS INT), name, value, CASE WHEN name = 'depth' THEN value ELSE 6 END, CASE WHEN name = 'leaves' THEN value ELSE 31 END FROM s WHERE value <> CASE name WHEN 'depth' THEN 6 ELSE 31 END""")
def one_at_a_time(spark, d):
    p = _t(spark, d, "part")
    steps = p.select(F.lit("depth").alias("name"), (F.col("p_size") % 3 + 5).alias("value")).unionByName(p.select(F.lit("leaves").alias("name"), (F.col("p_size") % 4 * 8 + 15).alias("value")))
    return P.varied(steps, {"depth": 6.0, "leaves": 31.0})


@query("WITH c AS (SELECT s_nationkey k, round(avg(s_acctbal) / 1000, 3) a, round(max(s_acctbal) / 1000, 3) b, count(*) AS c FROM supplier GROUP BY 1), x AS (SELECT * FROM c WHERE a >= (SELECT max(a) FROM c) - 2), y AS (SELECT * FROM x WHERE b >= (SELECT max(b) FROM x) - 2) SELECT * FROM y ORDER BY y.c DESC, k LIMIT 1")
def radius_choice(spark, d):
    g = _t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.avg("s_acctbal") / 1000, 3).alias("a"), F.round(F.max("s_acctbal") / 1000, 3).alias("b"), F.count("*").alias("c"))
    return M.radius_choice(g, "k", "a", "b", "c", 2.0)


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 b FROM lineitem) SELECT 'l_quantity' a, 'l_discount' b, round(corr(r.a, r.b), 6) spearman FROM r")
def rank_correlations(spark, d):
    return _rounded(M.rank_correlations(_t(spark, d, "lineitem"), ["l_quantity", "l_discount"]))


@query("SELECT p_partkey % 21 = 20 AS unknown, class, count(*) n FROM (SELECT p_partkey, CASE WHEN p_partkey % 21 IN (0, 17, 9, 7, 10) THEN 'nonpolar' WHEN p_partkey % 21 IN (4, 18, 19) THEN 'aromatic' WHEN p_partkey % 21 IN (15, 16, 1, 11, 13) THEN 'polar' WHEN p_partkey % 21 IN (8, 14, 6) THEN 'basic' WHEN p_partkey % 21 IN (2, 3) THEN 'acidic' WHEN p_partkey % 21 IN (5, 12) THEN 'special' ELSE 'unknown' END class FROM part) GROUP BY ALL")
def class_counts(spark, d):
    a = F.substring(F.lit("ACDEFGHIKLMNPQRSTVWYB"), (F.col("p_partkey") % 21 + 1).cast("int"), F.lit(1))
    return _t(spark, d, "part").groupBy((F.col("p_partkey") % 21 == 20).alias("unknown"), R.residue_class(a).alias("class")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, round(avg(o_totalprice), 6) mean, round(abs(avg(o_totalprice) - c_acctbal * 20), 6) diff, abs(avg(o_totalprice) - c_acctbal * 20) <= 100000 AS near FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey, c_acctbal")
def mean_against_record(spark, d):
    means = _t(spark, d, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean"))
    record = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") * 20).alias("told"))
    return _rounded(Q.near(means, record, "o_custkey", "mean", "told", 100000.0), 6)


@query("SELECT c_mktsegment AS category, count(*) n FROM customer GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM customer")
def category_counts(spark, d):
    return Q.counts(_t(spark, d, "customer").withColumnRenamed("c_mktsegment", "category"), "category")


_CONFIGS = [20, 50, 80, 110]
_NESTED = _S + """, c AS (SELECT unnest([20, 50, 80, 110]) config), f AS (SELECT grp % 5 fold, config, CAST(count(*) FILTER (WHERE (score >= config) = (label = 1)) AS DOUBLE) v FROM s, c GROUP BY ALL),
t AS (SELECT config, sum(v) total, count(*) n FROM f GROUP BY 1), x AS (SELECT fold, config, v, (total - v) / (n - 1) i FROM f JOIN t USING (config)),
y AS (SELECT fold, arg_min(config, (-i, config)) config, arg_min(i, (-i, config)) "inner", arg_min(v, (-i, config)) AS value FROM x GROUP BY fold)"""


def _choices(spark, d):
    s = _scored(spark, d).select((F.col("grp") % 5).alias("fold"), F.explode(F.array(*map(F.lit, _CONFIGS))).alias("config"), "score", "label")
    right = ((F.col("score") >= F.col("config")) == (F.col("label") == 1)).cast("int")
    return M.nested_choice(s.groupBy("fold", "config").agg(F.sum(right).alias("value")), "fold", "config", "value")


@query(_NESTED + ' SELECT fold, config, round("inner", 6) "inner", value FROM y')
def nested_choice(spark, d):
    return _rounded(_choices(spark, d))


@query(_NESTED + ' SELECT count(*) folds, round(median(value), 6) median, round(avg(value), 6) mean, round(avg("inner" - value), 6) optimism FROM y')
def nested_summary(spark, d):
    return _rounded(M.nested_summary(_choices(spark, d)))


@query("WITH s AS (SELECT p_brand feature, p_size % 5 model, sum(p_retailprice) / 100000 importance FROM part GROUP BY ALL) SELECT feature, round(avg(importance), 6) mean, round(stddev_pop(importance), 6) sd, count(importance) models FROM s GROUP BY feature")
def mean_importances(spark, d):
    each = _t(spark, d, "part").groupBy(F.col("p_brand").alias("feature"), (F.col("p_size") % 5).alias("model")).agg((F.sum("p_retailprice") / 100000).alias("importance"))
    return _rounded(L.mean_importances(each))
