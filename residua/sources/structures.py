"""Structure files, matrices and sequences as typed DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.residues import chain_id
from ..operators.structures import residue_atoms


@contextmanager
def listing(spark: SparkSession, tasks: int = 64) -> Iterator[None]:
    """Folders that a reader lists here are dealt to so many tasks at most; else each of them is a task of its own, up to 10,000."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), tasks))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, id, sequence (upper-cased) of the first record of each file."""
    with listing(spark):
        texts = spark.read.text(path, wholetext=True)
    x = texts.select(F.col("_metadata.file_path").alias("file"), F.split("value", ">").alias("r"))
    first = F.element_at("r", 2)
    head = F.substring_index(first, "\n", 1)
    return x.select("file", F.split(F.trim(head), r"\s+")[0].alias("id"), F.upper(F.regexp_replace(F.expr("substring(element_at(r, 2), length(substring_index(element_at(r, 2), '\n', 1)) + 1)"), r"\s", "")).alias("sequence"))


def ordered(spark: SparkSession, path: str, ends: tuple[str, ...] = (), sep: str | None = None) -> DataFrame:
    """file, ordinal (from 0), value: the lines of text files, or what lies between ``sep``, numbered in each file.

    Spark splits large files, so no file is one row or one task; a split's lines come in one run, and its first number is the
    number of lines in the splits before it. ``ends``: only files whose names end so, in any case of letters.
    """
    reader = spark.read
    if sep:
        reader = reader.option("lineSep", sep)
    if ends:
        any_case = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
        reader = reader.option("pathGlobFilter", "{" + ",".join("*" + any_case(e) for e in ends) + "}")
    with listing(spark):
        lines = reader.text(path)
    x = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    per = x.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))  # a row for each split
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = per.select("file", "block", (before - F.col("first")).alias("shift"))
    return x.join(start, ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("ordinal"), "value")


CIF, PDB = (".cif", ".mmcif"), (".pdb", ".ent")
#: A word of a line: up to a quote that white space follows, or up to white space.
_WORDS = r"""'.*?'(?=\s|$)|".*?"(?=\s|$)|\S+"""
_NUMBERS = ("Cartn_x", "Cartn_y", "Cartn_z", "B_iso_or_equiv")


def _cif_rows(spark: SparkSession, path: str, ends: tuple[str, ...] = CIF) -> DataFrame:
    """file, ordinal, tags, v: the rows of the atom loop of each mmCIF file, as words in the order of the loop's tags.

    A loop ends where other tags or a new block begin. Lines of a text between lines that begin with a semicolon are no words; a
    quoted word may hold white space; a row may go over several lines.
    """
    w = W.partitionBy("file").orderBy("ordinal")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    x = ordered(spark, path, ends).withColumn("line", F.trim(F.regexp_replace("value", "[\t\r]", " ")))
    semi = F.col("value").startswith(";")
    x = x.withColumn("texts", F.sum(semi.cast("int")).over(upto)).where(~semi & (F.col("texts") % 2 == 0) & (F.col("line") != "") & ~F.col("line").startswith("#"))
    tag = F.col("line").startswith("_")
    x = x.withColumn("tag", tag).withColumn("last", F.lag("tag").over(w))
    head = F.lower("line").rlike("^(loop_|data_|save_)")
    # a loop_ line and the tags after it are one group: the tags begin another only where no loop_ stands before them
    x = x.withColumn("head", head).withColumn("after", F.lag("head").over(w))
    group = F.sum((head | (tag & ~F.coalesce("last", F.lit(False)) & ~F.coalesce("after", F.lit(False)))).cast("int")).over(upto)
    x = x.withColumn("group", group).where(~F.col("head")).select("file", "ordinal", "group", "line", "tag")
    tags = x.where("tag").groupBy("file", "group").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.split("line", r"\s+")[0].alias("t")))), lambda e: e["t"]).alias("tags"))  # as many as a loop has columns
    tags = tags.where(F.array_contains("tags", "_atom_site.group_PDB") | F.array_contains("tags", "_atom_site.Cartn_x"))
    words = F.transform(F.regexp_extract_all("line", F.lit(_WORDS), 0), lambda t: F.when(t.rlike("""^(['"]).*\\1$""") & (F.length(t) > 1), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t))
    rows = x.where(~F.col("tag")).join(tags, ["file", "group"]).select("file", "group", "ordinal", F.transform("tags", lambda t: F.substring_index(t, ".", -1)).alias("tags"), words.alias("v"))
    rows = rows.withColumn("n", F.size("tags"))
    start = F.sum(F.size("v")).over(W.partitionBy("file", "group").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)) - F.size("v")
    rows = rows.withColumn("start", start)
    whole = (F.col("start") % F.col("n") == 0) & (F.size("v") == F.col("n"))
    parts = rows.where(~whole).select("file", "group", "ordinal", "tags", "n", "start", F.posexplode("v").alias("k", "word"))
    at = F.col("start") + F.col("k")
    joined = parts.groupBy("file", "group", F.floor(at / F.col("n")).alias("r")).agg(F.min("ordinal").alias("ordinal"), F.first("tags").alias("tags"), F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), "word"))), lambda e: e["word"]).alias("v"))
    return rows.where(whole).select("file", "ordinal", "tags", "v").unionByName(joined.select("file", "ordinal", "tags", "v"))


def _word(tag: str) -> Column:
    return F.try_element_at("v", F.nullif(F.array_position("tags", F.lit(tag)), F.lit(0)).cast("int"))


def mmcif_atoms(spark: SparkSession, path: str, ends: tuple[str, ...] = CIF) -> DataFrame:
    """Atom rows of mmCIF files: file, ordinal and typed columns found by each file's own tags; what can't be read is null (``mmcif_errors``)."""
    named = lambda t: F.when(~_word(t).isin(".", "?"), _word(t))
    either = lambda a, b: F.coalesce(named(a), named(b))
    return _cif_rows(spark, path, ends).select(
        "file", "ordinal", _word("group_PDB").alias("record"), F.coalesce(_word("pdbx_PDB_model_num").try_cast("int"), F.lit(1)).alias("model"),
        chain_id(either("label_asym_id", "auth_asym_id")).alias("chain"), either("label_seq_id", "auth_seq_id").try_cast("int").alias("pos"), either("label_comp_id", "auth_comp_id").alias("residue"),
        either("label_atom_id", "auth_atom_id").alias("atom"), _word("label_alt_id").alias("alt"), _word("pdbx_PDB_ins_code").alias("icode"), _word("Cartn_x").try_cast("double").alias("x"), _word("Cartn_y").try_cast("double").alias("y"),
        _word("Cartn_z").try_cast("double").alias("z"), _word("B_iso_or_equiv").try_cast("double").alias("b"),
    )


def mmcif_errors(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, rule: atom rows of mmCIF files that are cut off, or whose numbers can't be read."""
    bad = F.lit(False)
    for t in _NUMBERS:
        bad |= _word(t).try_cast("double").isNull()
    number = F.coalesce(F.when(~_word("label_seq_id").isin(".", "?"), _word("label_seq_id")), _word("auth_seq_id"))
    rule = F.when(F.size("v") != F.size("tags"), "short").when(bad | ((_word("group_PDB") == "ATOM") & number.try_cast("int").isNull()), "number")
    return _cif_rows(spark, path).select("file", "ordinal", rule.alias("rule")).where("rule is not null")


def residue_number(text: Column) -> Column:
    """The number in the four columns of a residue; over 9999 as hybrid-36: A000 to ZZZZ, then a000 to zzzz. Null if it is neither."""
    digits = F.conv(F.upper(text), 36, 10).cast("int")
    base = 36**3
    upper, lower = text.rlike("^[A-Z][0-9A-Z]{3}$"), text.rlike("^[a-z][0-9a-z]{3}$")
    return F.when(upper, digits - 10 * base + 10_000).when(lower, digits + 16 * base + 10_000).otherwise(text.try_cast("int"))


def residue_columns(number: Column) -> Column:
    """Four columns of a residue's number, as ``residue_number`` reads them; an error where it doesn't fit."""
    base, over = 36**3, number - 10_000
    hybrid = F.when(over < 26 * base, F.conv((over + 10 * base).cast("string"), 10, 36)).when(over < 52 * base, F.lower(F.conv((over - 16 * base).cast("string"), 10, 36)))
    return F.when(number.between(-999, 9999), F.lpad(number.cast("string"), 4, " ")).otherwise(F.coalesce(F.when(over >= 0, hybrid), F.raise_error(F.lit("a residue's number has no four columns"))))


def pdb_atoms(spark: SparkSession, path: str, ends: tuple[str, ...] = PDB) -> DataFrame:
    """Atom rows of fixed-column PDB files, with the number of the model that each stands in."""
    x = ordered(spark, path, ends).withColumnRenamed("value", "line")
    w = W.partitionBy("file").orderBy("ordinal")
    x = x.withColumn("model", F.greatest(F.sum(F.when(F.col("line").startswith("MODEL"), 1).otherwise(0)).over(w), F.lit(1)).cast("int")).where("line rlike '^(ATOM|HETATM)' and length(line) >= 66")
    part = lambda a, n: F.trim(F.substring("line", a, n))
    return x.select(
        "file", "ordinal", part(1, 6).alias("record"), "model", chain_id(F.substring("line", 22, 1)).alias("chain"), residue_number(part(23, 4)).alias("pos"), part(18, 3).alias("residue"), part(13, 4).alias("atom"),
        part(17, 1).alias("alt"), part(27, 1).alias("icode"), part(31, 8).try_cast("double").alias("x"), part(39, 8).try_cast("double").alias("y"), part(47, 8).try_cast("double").alias("z"), part(61, 6).try_cast("double").alias("b"),
    )


def kept_atoms(atoms: DataFrame) -> DataFrame:
    """Atoms of the first model, of no or the first alternative place, without heteroatoms."""
    return atoms.where("record = 'ATOM' and model = 1").where(F.coalesce(F.col("alt"), F.lit("")).isin("", ".", "?", "A"))


def residues(atoms: DataFrame) -> DataFrame:
    """One row for each residue of kept atoms: counts, centre, CA place and confidence."""
    return residue_atoms(kept_atoms(atoms), ["file", "chain", "pos"])


def atoms(spark: SparkSession, path: str) -> DataFrame:
    """Atom rows of all structure files under path, by what their names end in: .cif and .mmcif, .pdb and .ent; others aren't read."""
    if ordered(spark, path, (*CIF, *PDB)).isEmpty():
        raise ValueError("no structure file: " + path)
    return mmcif_atoms(spark, path).unionByName(pdb_atoms(spark, path))


def matrix(spark: SparkSession, path: str, key: str = "predicted_aligned_error") -> DataFrame:
    """file, i, j (from 1), value of a JSON matrix: an object with ``key``, a list of one, or the bare rows.

    Files are read by matrix rows, what lies between closing brackets, so a large matrix is many rows in many tasks. Rows
    count from the one with the key (or the first one of a file without any) up to the next key. A number that can't be read is null.
    """
    x = ordered(spark, path, (), "]")
    name = r'"([^"]+)"\s*:\s*(?:\[\s*)+[^\[]*$'
    x = x.where(F.contains("value", F.lit("["))).select("file", "ordinal", "value", F.nullif(F.regexp_extract("value", name, 1), F.lit("")).alias("key"))
    keys = x.groupBy("file").agg(F.min(F.when(F.col("key") == key, F.col("ordinal"))).alias("from"), F.count("key").alias("keys"))
    after = x.where("key is not null").join(keys.select("file", "from"), "file").where("ordinal > from").groupBy("file").agg(F.min("ordinal").alias("to"))
    spans = keys.select("file", F.when(F.col("keys") == 0, -1).otherwise(F.col("from")).alias("from")).where("from is not null").join(after, "file", "left")
    rows = x.join(spans, "file").where("ordinal >= from and (to is null or ordinal < to)")
    rows = rows.select("file", F.row_number().over(W.partitionBy("file").orderBy("ordinal")).alias("i"), F.substring_index("value", "[", -1).alias("row")).where(F.trim("row") != "")
    return rows.select("file", "i", F.posexplode(F.split("row", ",")).alias("j", "value")).select("file", "i", (F.col("j") + 1).alias("j"), F.trim("value").try_cast("double").alias("value"))


def short_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, rule: atom lines of fixed-column files that are too short, or whose numbers can't be read."""
    x = ordered(spark, path, PDB).withColumnRenamed("value", "line").where("line rlike '^(ATOM|HETATM)'")
    number = lambda a, n, t: F.trim(F.substring("line", a, n)).try_cast(t).isNull()
    bad = residue_number(F.trim(F.substring("line", 23, 4))).isNull() | number(31, 8, "double") | number(39, 8, "double") | number(47, 8, "double") | number(61, 6, "double")
    return x.select("file", "ordinal", F.when(F.length("line") < 66, "short").when(bad, "number").alias("rule")).where("rule is not null")
