"""Rules of candidates, records and downloads, and the joins that hold them against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a candidate must have, how identifiers look, and what is allowed.
REQUIRED = (
    "protein_id", "uniprot_accession", "uniprot_entry_name", "afdb_entry_id", "protein_name", "gene", "organism", "category", "function_summary", "source",
    "source_url", "api_url", "license", "license_url", "annotation_source", "annotation_url", "planned_model_file", "planned_pae_file", "status",
)
UNIQUE = ("protein_id", "uniprot_accession", "afdb_entry_id", "source_url")
ACCESSION = r"^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})$"
ENTRY = r"^AF-[A-Z0-9]{6,10}-F[0-9]+$"
SHA256 = r"^[0-9a-f]{64}$"
URLS = {
    "source_url": "https://alphafold.ebi.ac.uk/entry/%s", "api_url": "https://alphafold.ebi.ac.uk/api/prediction/%s", "annotation_url": "https://www.uniprot.org/uniprotkb/%s/entry",
}
ALLOWED = {
    "source": ("AlphaFoldDB",), "license": ("CC BY 4.0",), "status": ("planned_not_downloaded", "downloaded"),
    "category": ("enzyme", "oxygen_binding", "electron_transfer", "calcium_signaling", "antioxidant_enzyme", "fluorescent_protein"),
}
LENGTHS, COUNTS, CATEGORIES = (20, 600), (5, 10), 3
FILES = "https://alphafold.ebi.ac.uk/files/"


def is_accession(c: Column) -> Column:
    return c.rlike(ACCESSION)


def is_entry(c: Column) -> Column:
    return c.rlike(ENTRY)


def is_sha256(c: Column) -> Column:
    return c.rlike(SHA256)


def is_allowed_url(url: Column, hosts: tuple[str, ...], scheme: str = "https") -> Column:
    """Whether the scheme is the one asked for and the host is listed; not so for a null."""
    part = lambda n: F.regexp_extract(url, r"^([a-z]+)://([^/:?#]+)", n)
    return F.coalesce((part(1) == scheme) & part(2).isin(*hosts), F.lit(False))


def allowed_by(df: DataFrame, url: str, hosts: DataFrame, host: str, scheme: str = "https") -> DataFrame:
    """Adds ``allowed`` as ``is_allowed_url`` has it, where the list of hosts is a table of any size."""
    part = lambda n: F.regexp_extract(F.col(url), r"^([a-z]+)://([^/:?#]+)", n)
    listed = hosts.select(F.col(host).alias("__host")).distinct().withColumn("__there", F.lit(True))
    j = df.join(listed, part(2) == F.col("__host"), "left")
    return j.withColumn("allowed", F.coalesce((part(1) == scheme) & F.col("__there"), F.lit(False))).drop("__host", "__there")


def text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def candidate_rules(required: tuple[str, ...] = REQUIRED, urls: dict[str, str] = URLS, allowed: dict[str, tuple[str, ...]] = ALLOWED, lengths: tuple[int, int] = LENGTHS) -> dict[str, Column]:
    """The rules of one candidate, each true where it is broken. Numbers of another type are null, and so broken."""
    acc, entry = text("uniprot_accession"), text("afdb_entry_id")
    rules = {f"{c} missing": text(c) == "" for c in required}
    rules["accession form"] = (acc != "") & ~is_accession(acc)
    rules["id differs"] = (acc != "") & (text("protein_id") != "") & (acc != text("protein_id"))
    rules["entry form"] = (entry != "") & ~is_entry(entry)
    rules["entry differs"] = (acc != "") & is_entry(entry) & (entry != F.concat(F.lit("AF-"), acc, F.lit("-F1")))
    for c, form in urls.items():
        rules[f"{c} differs"] = (acc != "") & (text(c) != "") & (text(c) != F.format_string(form, acc))
    for c, values in allowed.items():
        rules[f"{c} not allowed"] = ~text(c).isin(*values) if c != "category" else (text(c) != "") & ~text(c).isin(*values)
    n, v = F.col("sequence_length"), F.col("model_version_recorded")
    rules["length"] = n.isNull() | ~n.between(*lengths)
    rules["version"] = v.isNull() | (v < 1)
    for c, form in (("planned_model_file", "-model_v%d.cif"), ("planned_pae_file", "-predicted_aligned_error_v%d.json")):
        rules[f"{c} differs"] = (acc != "") & (entry != "") & (v >= 1) & (text(c) != F.concat(entry, F.format_string(form, v)))
    return rules


# What is said of the source of a table of candidates.
SOURCE = ("name", "full_name", "url", "license", "license_url", "attribution_note")


def source_rules(block: str = "source", required: tuple[str, ...] = SOURCE, citations: str = "citation") -> dict[str, Column]:
    """The rules of the source block, a struct with an array of citations: it is there, each text is filled in, and so is each citation, one at least."""
    s = F.col(block)
    blank = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""
    rules = {f"{block} missing": s.isNull()} | {f"{block}.{c} missing": blank(s[c]) for c in required}
    rules[f"{block}.{citations} missing"] = ~F.coalesce((F.size(s[citations]) > 0) & F.forall(s[citations], lambda c: ~blank(c)), F.lit(False))
    return rules


def repeated_values(df: DataFrame, keys: tuple[str, ...] = UNIQUE) -> DataFrame:
    """column, value, n: values of the columns that more than one row has, blank ones left out; one pass for all columns."""
    each = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in keys])))
    return each.where("value <> ''").groupBy("column", "value").agg(F.count("*").alias("n")).where("n > 1")


def set_rules(df: DataFrame, category: str = "category", counts: tuple[int, int] = COUNTS, categories: int = CATEGORIES) -> DataFrame:
    """level, rule: what the table as a whole breaks: too few categories is an error, another number of rows a warning."""
    g = df.agg(F.count("*").alias("n"), F.countDistinct(F.nullif(text(category), F.lit(""))).alias("kinds"))
    each = F.array_compact(F.array(F.when(F.col("kinds") < categories, F.struct(F.lit("error").alias("level"), F.lit("few categories").alias("rule"))), F.when(~F.col("n").between(*counts), F.struct(F.lit("warning").alias("level"), F.lit("count").alias("rule")))))
    return g.select(F.inline(each))


def record_rules(accession: str = "accession", prefix: str = FILES) -> dict[str, Column]:
    """The rules of one entry record beside the accession that was asked for."""
    acc = F.col(accession)
    return {
        "accession": ~F.col("uniprotAccession").eqNullSafe(acc),
        "entry": ~F.coalesce(F.col("entryId").startswith(F.concat(F.lit("AF-"), acc, F.lit("-"))), F.lit(False)),
        "complex": ~F.col("isComplex").eqNullSafe(F.lit(False)),
        "version": F.coalesce(F.col("latestVersion") < 1, F.lit(True)),
        "structure url": ~F.coalesce(F.col("cifUrl").startswith(prefix), F.lit(False)),
        "matrix url": ~F.coalesce(F.col("paeDocUrl").startswith(prefix), F.lit(False)),
    }


def download_status(http: Column, size: Column) -> Column:
    return F.when((http == 200) & (size > 0), "OK").otherwise("FAILED")


def structure_status() -> tuple[Column, Column]:
    """validation_status and notes of a row of error, model_count, chain_count, unknown, observed, expected, sequence_match, md5_match."""
    c = F.col
    good = (F.coalesce(c("error"), F.lit("")) == "") & (c("model_count") == 1) & (c("chain_count") == 1) & (c("unknown") == 0) & (c("observed") > 0) & c("sequence_match") & (c("observed") == c("expected")) & c("md5_match")
    notes = F.concat_ws(
        "; ", F.nullif("error", F.lit("")), F.when(c("unknown") > 0, F.concat(c("unknown").cast("string"), F.lit(" unknown residues"))),
        F.when(c("observed") != c("expected"), F.concat(F.lit("length "), c("observed").cast("string"), F.lit(" not "), c("expected").cast("string"))), F.when(~c("sequence_match"), "sequence differs"), F.when(~c("md5_match"), "checksum differs"),
    )
    return F.when(F.coalesce(good, F.lit(False)), "PASS").otherwise("FAIL"), notes


def manifest_status(structure: Column, matrix: Column, *files: tuple[Column, Column]) -> Column:
    """DOWNLOADED_VALIDATED where both checks pass and each file (status, checksum) is OK and has its checksum, else FAILED."""
    good = (structure == "PASS") & (matrix == "PASS")
    for status, checksum in files:
        good &= (status == "OK") & (F.coalesce(checksum, F.lit("")) != "")
    return F.when(F.coalesce(good, F.lit(False)), "DOWNLOADED_VALIDATED").otherwise("FAILED")


def by_file_type(downloads: DataFrame, key: str, kind: str, kinds: list[str], columns: list[str]) -> DataFrame:
    """key, <kind>_<column>: a candidate's files side by side; missing ones are null."""
    first = [F.max(F.when(F.col(kind) == k, F.col(c))).alias(f"{k}_{c}") for k in kinds for c in columns]
    return downloads.where(F.col(kind).isin(*kinds)).groupBy(key).agg(*first)


def mismatches(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column, left, right: what two tables say differently of a key, and keys that one of them lacks (column is the key's name)."""
    a, b = left.alias("a"), right.alias("b")
    j = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    s = lambda t, c: F.col(f"{t}.{c}").cast("string")
    lone = F.col(f"a.{key}").isNull() | F.col(f"b.{key}").isNull()
    made = lambda c: F.struct(F.lit(c).alias("column"), s("a", c).alias("left"), s("b", c).alias("right"))
    each = [F.when(lone, made(key)), *[F.when(~lone & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), made(c)) for c in columns]]
    return j.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.inline(F.array_compact(F.array(*each))))


def changed_columns(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """column, n: in how many rows that both tables have a column differs, and how many rows only one has (column is the key's name)."""
    return mismatches(left, right, key, columns).groupBy("column").agg(F.count("*").alias("n"))


def sequence_differences(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, differing: places at which two sequences differ, those that one is longer by included, without exploding them."""
    x, y = F.split(F.coalesce(F.col(a), F.lit("")), ""), F.split(F.coalesce(F.col(b), F.lit("")), "")
    both = F.size(F.filter(F.zip_with(x, y, lambda u, v: ~u.eqNullSafe(v)), lambda z: z))
    n = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    return df.select(key, F.when(n(a) == 0, n(b)).when(n(b) == 0, n(a)).otherwise(both).cast("long").alias("differing"))


def sequence_identity(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, length_a, length_b, differing, first (place from 1 of the first difference, null if there is none), match.

    The document of a comparison of each structure's sequence with the one that it should have; a null is an empty sequence, and
    an empty one matches nothing. Rows without a match are what must stop a run.
    """
    x, y = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))
    differs = F.zip_with(F.when(x == "", F.array()).otherwise(F.split(x, "")), F.when(y == "", F.array()).otherwise(F.split(y, "")), lambda u, v: ~u.eqNullSafe(v))
    told = df.select(key, F.length(x).cast("long").alias("length_a"), F.length(y).cast("long").alias("length_b"), differs.alias("__d"))
    first = F.nullif(F.array_position("__d", F.lit(True)), F.lit(0)).cast("long")
    n = F.size(F.filter("__d", lambda z: z)).cast("long")
    return told.select(key, "length_a", "length_b", n.alias("differing"), first.alias("first"), ((n == 0) & (F.col("length_a") > 0)).alias("match"))


def hygiene(value: Column, name: str = "text") -> dict[str, Column]:
    """What a text that is to be the same on every run may not have: dates, paths from the root, carriage returns, a byte order mark, no new line at its end."""
    return {
        f"{name} date": value.rlike(r"\b20[0-9]{2}-[01][0-9]-[0-3][0-9]\b"), f"{name} path": value.rlike(r"(^|[\s\"'])/(home|root|tmp|Users|mnt|var)/"),
        f"{name} carriage return": value.contains("\r"), f"{name} mark": value.startswith("﻿"), f"{name} end": ~value.endswith("\n"),
    }


def relative_path(path: Column, root: str) -> Column:
    """A path in POSIX form below root; others stay whole."""
    p, r = F.replace(path, F.lit("\\"), F.lit("/")), root.replace("\\", "/").rstrip("/") + "/"
    return F.when(p.startswith(r), F.substr(p, F.lit(len(r) + 1))).otherwise(p)
