"""Queries of readers and writers: rows of the tables are written as files of each kind into a new folder, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import residues as R
from ..operators import extraction as X
from ..sinks import tables as K
from ..sinks.kept import new_folder
from ..sources import documents as D
from ..sources import structures as S
from .catalogue import _M, _cells, _t, query


def _written(lines: DataFrame, name: str) -> str:
    """A folder of one text file for each grp, of lines(grp, ord, value) in their order.

    Files take time by their number, not by their bytes: with the number of partitions given, Spark doesn't join small ones to a
    single task that writes all files one after another.
    """
    path, spark = new_folder(lines.sparkSession, name), lines.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines.repartition(n, "grp").sortWithinPartitions("grp", "ord").select("grp", "value").write.partitionBy("grp").text(path)
    return path


def _group(file: str = "file") -> Column:
    return F.regexp_extract(F.col(file), "grp=([0-9]+)", 1).cast("int").alias("grp")


def _framed(rows: DataFrame, head: list[str], tail: list[str]) -> DataFrame:
    """rows(grp, ord, value) of each grp between the lines of head and of tail."""
    groups = rows.select("grp").distinct()
    top = groups.select("grp", F.posexplode(F.array(*map(F.lit, head)))).select("grp", (F.col("pos") - len(head)).cast("long").alias("ord"), F.col("col").alias("value"))
    end = groups.select("grp", F.posexplode(F.array(*map(F.lit, tail)))).select("grp", (F.col("pos") + (1 << 40)).cast("long").alias("ord"), F.col("col").alias("value"))
    return top.unionByName(rows.select("grp", F.col("ord").cast("long").alias("ord"), "value")).unionByName(end)


# --- structures: a point of each vector is the CA of a residue, another one its N; some atoms have marks that leave them out ----------

_RESIDUES = """WITH v AS (SELECT label grp, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) pos, ['MET', 'GLY', 'ALA'][vec_id % 3 + 1] residue, round(CAST(embedding[1] AS DOUBLE) * 100) / 10 x, round(CAST(embedding[2] AS DOUBLE) * 100) / 10 y, CAST(vec_id % 90 + 10 AS DOUBLE) b FROM embeddings)
SELECT grp, CAST(pos AS INT) pos, residue, CAST(CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 2 END AS BIGINT) n_atoms, round(x, 1) + 0.0 ca_x, round(CASE WHEN vec_id % 7 = 0 THEN y ELSE (y + y + 1) / 2 END, 3) + 0.0 centroid_y, b plddt_ca FROM v"""


def _points(spark, d) -> DataFrame:
    from pyspark.sql import Window as W

    e = _t(spark, d, "embeddings")
    tenth = lambda i: F.round(F.col("embedding")[i].cast("double") * 100) / 10
    pos = F.row_number().over(W.partitionBy("label").orderBy("vec_id"))
    v = e.select(F.col("label").alias("grp"), "vec_id", pos.alias("pos"), F.element_at(F.array(*map(F.lit, ("MET", "GLY", "ALA"))), (F.col("vec_id") % 3 + 1).cast("int")).alias("residue"), tenth(0).alias("x"), tenth(1).alias("y"), (F.col("vec_id") % 90 + 10).cast("double").alias("b"))
    atom = lambda name, y, record, alt: F.struct(F.lit(name).alias("atom"), (F.col("y") + y).alias("ay"), record.alias("record"), F.lit(alt).alias("alt"))
    each = F.array(atom("N", 1.0, F.when(F.col("vec_id") % 7 == 0, "HETATM").otherwise("ATOM"), " "), atom("CA", 0.0, F.lit("ATOM"), "A"), atom("CA", 9.0, F.lit("ATOM"), "B"))
    return v.select("grp", "pos", "residue", "x", "b", F.posexplode(each).alias("k", "a")).select("grp", "pos", "residue", "x", "b", (F.col("pos") * 4 + F.col("k")).alias("ord"), "a.*")


def _read_back(atoms: DataFrame) -> DataFrame:
    # + 0.0: no negative zero
    return S.residues(atoms).select(_group(), "pos", "residue", "n_atoms", *[(F.round(c, 3) + 0.0).alias(c) for c in ("ca_x", "centroid_y")], "plddt_ca")


@query(_RESIDUES)
def cif_files(spark, d):
    """Residues of mmCIF files, one for each group; names in quotes, rows over two lines."""
    tags = ["group_PDB", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "B_iso_or_equiv"]
    p = _points(spark, d)
    name = F.when(F.col("pos") % 5 == 0, F.concat(F.lit("'"), "atom", F.lit("'"))).otherwise(F.col("atom"))
    alt = F.when(F.col("alt") == " ", ".").otherwise(F.col("alt"))
    cut = F.when(F.col("pos") % 4 == 0, "\n").otherwise(" ")
    row = F.concat(F.concat_ws(" ", "record", name, alt, "residue", F.lit("A"), F.col("pos").cast("string")), cut, F.concat_ws(" ", F.format_string("%.1f", "x"), F.format_string("%.1f", "ay"), F.lit("0.0"), F.format_string("%.2f", "b")))
    lines = _framed(p.select("grp", "ord", row.alias("value")), ["data_x", "_entry.id x", "loop_", *["_atom_site." + t for t in tags]], ["#"])
    return _read_back(S.mmcif_atoms(spark, _written(lines, "cif"), (".txt",)))


@query(_RESIDUES)
def pdb_files(spark, d):
    """Residues of fixed-column files, one for each group."""
    p, pad = _points(spark, d), lambda c, n: F.lpad(c, n, " ")
    number = lambda c, n: F.format_string(f"%.{n}f", c)
    row = F.concat(
        F.rpad("record", 6, " "), F.lpad((F.col("ord") % 100_000).cast("string"), 5, " "), F.lit(" "), F.rpad("atom", 4, " "), "alt", "residue", F.lit(" A"), S.residue_columns(F.col("pos")), F.lit("    "),
        pad(number("x", 3), 8), pad(number("ay", 3), 8), F.lit("   0.000  1.00"), pad(number("b", 2), 6),
    )
    lines = _framed(p.select("grp", "ord", row.alias("value")), ["HEADER", "MODEL        1"], ["ENDMDL", "END"])
    return _read_back(S.pdb_atoms(spark, _written(lines, "pdb"), (".txt",)))


@query(_M + """, g AS (SELECT grp, i, j FROM (SELECT DISTINCT grp FROM m) CROSS JOIN (SELECT unnest(range(0, 60)) i) CROSS JOIN (SELECT unnest(range(0, 60)) j))
SELECT CAST(grp AS INT) grp, i + 1 AS i, j + 1 AS j, round(coalesce(value, 0), 3) AS value FROM g LEFT JOIN m USING (grp, i, j)""")
def matrix_files(spark, d):
    """Cells of JSON matrices, one for each group, in an object with other keys before and after."""
    every = F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"))
    whole = _cells(spark, d).select("grp").distinct().select("grp", F.explode(every).alias("i")).select("grp", "i", F.explode(every).alias("j"))
    m = whole.join(_cells(spark, d), ["grp", "i", "j"], "left").select(F.col("grp").cast("int").alias("grp"), "i", "j", F.round(F.coalesce("value", F.lit(0)), 3).alias("value"))
    rows = m.groupBy("grp", "i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "value"))), lambda e: e["value"].cast("string")), ", ").alias("r"))  # 60 cells
    value = F.concat(F.when(F.col("i") > 0, ",").otherwise(""), F.lit("["), "r", F.lit("]"))
    lines = _framed(rows.select("grp", F.col("i").alias("ord"), value.alias("value")), ['[{"other": [[1, 2], [3, 4]],', '"predicted_aligned_error": ['], ["],", '"max": 31.75, "rest": [5]}]'])
    return S.matrix(spark, _written(lines, "matrix")).select(_group(), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("value", 3).alias("value"))


@query("SELECT CAST(conv_id AS INT) grp, 'c' || conv_id AS id, string_agg(upper(left(role, 1)) || upper(substr(role, 2, 1)), '' ORDER BY turn) AS sequence FROM conversations GROUP BY conv_id")
def fasta_files(spark, d):
    """First records of FASTA files, one for each conversation, over several lines and in small letters."""
    c = _t(spark, d, "conversations").select(F.col("conv_id").alias("grp"), F.col("turn").alias("ord"), F.substring("role", 1, 2).alias("value"))
    head = c.select("grp").distinct().select("grp", F.lit(-1).cast("long").alias("ord"), F.concat(F.lit(">c"), F.col("grp").cast("string"), F.lit(" a name")).alias("value"))
    more = c.select("grp").distinct().select("grp", F.lit(1 << 40).alias("ord"), F.lit(">other\nXX").alias("value"))
    return S.fasta(spark, _written(c.unionByName(head).unionByName(more), "fasta")).select(_group(), "id", "sequence")


# --- documents and tables -------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey AS protein_id, s_name AS name, CASE WHEN s_suppkey % 5 > 0 THEN CAST(s_nationkey AS DOUBLE) END AS sequence_length FROM supplier")
def candidate_files(spark, d):
    """Candidates of one JSON document; lengths that are texts are null."""
    s, k = _t(spark, d, "supplier"), F.col("s_suppkey")
    length = F.when(k % 5 > 0, F.col("s_nationkey").cast("string")).otherwise('"x"')
    value = F.concat(F.lit(',{"protein_id": '), k.cast("string"), F.lit(', "name": "'), "s_name", F.lit('", "sequence_length": '), length, F.lit("}"))
    lines = _framed(s.select(F.lit(0).alias("grp"), k.alias("ord"), value.alias("value")), ['{"candidates": [', '{"protein_id": -1}'], ["]}"])
    found = D.candidates(spark, _written(lines, "candidates"), {"protein_id": "long", "name": "string", "sequence_length": "int"})
    return found.select("protein_id", "name", F.col("sequence_length").cast("double").alias("sequence_length")).where("protein_id >= 0")  # the first one is there for the commas' sake


@query("SELECT CAST(n_nationkey AS INT) grp, 'AF-P' || n_nationkey || '-F1' AS entry, CAST(n_regionkey AS INT) AS version FROM nation")
def record_files(spark, d):
    """Entry records, one file for each nation, chosen from a list of two."""
    key = F.col("n_nationkey").cast("string")
    one = lambda entry, v: F.to_json(F.struct(entry.alias("entryId"), F.concat(F.lit("P"), key).alias("uniprotAccession"), v.cast("int").alias("latestVersion")))
    value = F.concat(F.lit("["), one(F.concat(F.lit("AF-P"), key, F.lit("-2-F1")), F.lit(99)), F.lit(","), one(F.concat(F.lit("AF-P"), key, F.lit("-F1")), F.col("n_regionkey")), F.lit("]"))
    lines = _t(spark, d, "nation").select(F.col("n_nationkey").alias("grp"), F.lit(0).alias("ord"), value.alias("value"))
    return D.records(spark, _written(lines, "records"), canonical=True).select(_group(), F.col("entryId").alias("entry"), F.col("latestVersion").alias("version"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 9 > 0 THEN c_name || CASE WHEN c_custkey % 4 = 0 THEN ', \"a\"' ELSE '' END END AS name, round(c_acctbal, 2) AS balance FROM customer")
def csv_tables(spark, d):
    """A CSV that is the same on every run, with quotes, empty texts and formatted numbers, and read in its schema."""
    c, k = _t(spark, d, "customer"), F.col("c_custkey")
    name = F.when(k % 9 > 0, F.concat("c_name", F.when(k % 4 == 0, ', "a"').otherwise("")))
    path = new_folder(spark, "csv")
    K.csv(c.select(k, name.alias("name"), F.round("c_acctbal", 2).alias("balance")), path, ["c_custkey", "name", "balance"], ["c_custkey"], {"balance": 2})
    return D.table(spark, path, "c_custkey long, name string, balance double")


@query("SELECT upper(c) AS letter, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(p_name, '')) c FROM part) WHERE regexp_matches(c, '[A-Za-z]') GROUP BY 1")
def key_value_tables(spark, d):
    """The composition of names as a CSV of keys and counts, read back."""
    x = _t(spark, d, "part").select(F.explode(F.split(F.upper("p_name"), "")).alias("letter")).where("letter rlike '[A-Z]'").groupBy("letter").agg(F.count("*").alias("n"))
    path = new_folder(spark, "pairs")
    K.key_values(x, path, "letter", "n")
    return D.table(spark, path, "letter string, n long")


@query("SELECT o_orderkey, o_orderstatus AS status, round(o_totalprice, 2) AS price, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS DOUBLE) END AS customer FROM orders")
def json_documents(spark, d):
    """Nested documents of each order, written as text and parsed again."""
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.round("o_totalprice", 2).alias("price"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("customer"))
    path = new_folder(spark, "documents")
    K.documents(o, "o_orderkey", {"sums": ["price", "customer"]}).select("document").write.text(path)
    j = spark.read.schema("o_orderkey long, status string, sums struct<price:double,customer:long>").json(path)
    return j.select("o_orderkey", "status", "sums.price", F.col("sums.customer").cast("double").alias("customer"))


@query("SELECT DISTINCT CAST(label AS INT) AS grp, sha256(CAST(label AS VARCHAR) || chr(10)) AS sha256, CAST(length(CAST(label AS VARCHAR)) + 1 AS BIGINT) AS size FROM embeddings")
def file_checksums(spark, d):
    """SHA-256 and size of files, one for each group."""
    lines = _t(spark, d, "embeddings").select(F.col("label").alias("grp")).distinct().select("grp", F.lit(0).alias("ord"), F.col("grp").cast("string").alias("value"))
    found = D.checksums(spark, _written(lines, "sums") + "/*")
    return found.select(_group("path"), "sha256", F.col("size").cast("long").alias("size"))


# --- a whole extraction from files ----------------------------------------------------------------------------------------

_EXTRACT = """WITH v AS (SELECT label grp, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) pos, round(CAST(embedding[1] AS DOUBLE) * 100) / 10 x, round(CAST(embedding[2] AS DOUBLE) * 100) / 10 y, CAST(vec_id % 90 + 10 AS DOUBLE) b FROM embeddings),
n AS (SELECT grp, count(*) n FROM v GROUP BY grp), s AS (SELECT grp, bool_or(vec_id % 7 = 0) AS het FROM v GROUP BY grp)
SELECT CAST(n.grp AS VARCHAR) AS protein, CASE WHEN het THEN 'hetero atoms' ELSE '' END || CASE WHEN het AND grp % 3 = 0 THEN '; ' ELSE '' END || CASE WHEN grp % 3 = 0 THEN 'length; matrix shape' ELSE '' END AS notes FROM n JOIN s USING (grp)"""


def _extraction(spark, d):
    p = _points(spark, d)
    tags = ["group_PDB", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "B_iso_or_equiv"]
    row = F.concat_ws(" ", "record", "atom", F.when(F.col("alt") == " ", ".").otherwise(F.col("alt")), "residue", F.lit("A"), F.col("pos").cast("string"), F.format_string("%.1f", "x"), F.format_string("%.1f", "ay"), F.lit("0.0"), F.format_string("%.2f", "b"))
    return p, _framed(p.select("grp", "ord", row.alias("value")), ["loop_", *["_atom_site." + t for t in tags]], ["#"])


@query(_EXTRACT)
def extraction_from_files(spark, d):
    """Verdicts of proteins by the facts of their structure files, against announced lengths."""
    p, lines = _extraction(spark, d)
    atoms = S.mmcif_atoms(spark, _written(lines, "structures"), (".txt",)).withColumn("file", F.regexp_extract("file", "grp=([0-9]+)", 1))
    n = p.groupBy("grp").agg(F.max("pos").alias("n"))
    told = n.select(F.col("grp").cast("string").alias("protein"), (F.col("n") + F.when(F.col("grp") % 3 == 0, 1).otherwise(0)).alias("length"), F.col("n").alias("size"))
    facts = told.join(X.structure_facts(atoms, atoms.where("false").select("file", "ordinal", F.lit("").alias("rule"))), F.col("structure") == F.col("protein"), "left")
    sha = F.lit("0")
    facts = facts.select("*", *[sha.alias(c) for c in ("structure_sha256", "found_structure_sha256", "matrix_sha256", "found_matrix_sha256", "accession", "found_accession", "entry", "found_entry", "version", "found_version")], F.lit("A").alias("found_chain"), F.col("sequence").alias("found_sequence"), F.col("md5").alias("found_md5"), (F.col("size") * F.col("size")).alias("cells"), F.col("size").alias("most_i"), F.col("size").alias("most_j"), F.lit(0).alias("bad_cells"))
    return X.judged(facts).select("protein", "notes")
