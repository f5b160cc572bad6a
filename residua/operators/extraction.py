"""From a manifest and its files to feature tables: every protein is judged, those that pass go on, one that fails does so alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import residues as R
from ..sources import documents as D
from ..sources import structures as S
from . import structures as T

#: Columns of a manifest: the protein, its files by name, their checksums, and what its record must say.
MANIFEST = ("protein", "structure", "matrix", "structure_sha256", "matrix_sha256", "accession", "entry", "version", "length")


def rules() -> dict[str, Column]:
    """What facts of a protein may not be, true where it is broken. Where a file or record is missing, nothing else is said of it."""
    c = F.col
    differs = lambda a, b: ~c(a).eqNullSafe(c(b))
    structure, matrix, record = c("found_structure_sha256").isNotNull(), c("found_matrix_sha256").isNotNull(), c("found_accession").isNotNull()
    zero = lambda a: F.coalesce(c(a), F.lit(0))
    return {
        "structure missing": ~structure, "matrix missing": ~matrix, "record missing": ~record,
        "structure checksum": structure & differs("structure_sha256", "found_structure_sha256"), "matrix checksum": matrix & differs("matrix_sha256", "found_matrix_sha256"),
        "accession": record & differs("accession", "found_accession"), "entry": record & differs("entry", "found_entry"), "version": record & differs("version", "found_version"),
        "unreadable rows": zero("unreadable") > 0, "models": structure & (zero("models") != 1), "chains": structure & (zero("chains") != 1),
        "chain": structure & record & (F.coalesce("found_chain", F.lit("")) != "") & differs("chain", "found_chain"), "hetero atoms": zero("hetero") > 0, "inserted residues": zero("inserted") > 0,
        "no CA": zero("without_ca") > 0, "unknown residues": zero("unknown") > 0, "sequence": structure & record & differs("sequence", "found_sequence"), "length": structure & (zero("residues") != c("length")),
        "numbering": structure & ~F.coalesce((c("first") == 1) & (c("last") == c("residues")), F.lit(False)), "sequence checksum": structure & record & differs("md5", "found_md5"),
        "confidence": structure & ~F.coalesce((c("least_b") >= 0) & (c("most_b") <= 100), F.lit(False)),
        "matrix shape": matrix & ~F.coalesce((c("cells") == c("length") * c("length")) & (c("most_i") == c("length")) & (c("most_j") == c("length")), F.lit(False)), "matrix values": zero("bad_cells") > 0,
    }


def judged(facts: DataFrame, own: dict[str, Column] | None = None) -> DataFrame:
    """Adds status (PASS or FAIL) and notes (the rules that are broken, in their order)."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit(True)), F.lit(n)) for n, x in (own or rules()).items()]))
    return facts.withColumn("notes", F.array_join(broken, "; ")).withColumn("status", F.when(F.col("notes") == "", "PASS").otherwise("FAIL"))


def _name(file: str = "file") -> Column:
    return R.last_segment(F.col(file))


def residues_of(atoms: DataFrame) -> DataFrame:
    """grp (the file's name), pos, letter (null for an unknown residue), x, y, z (of CA), plddt, n_atoms of each residue of atom rows."""
    r = S.residues(atoms)
    return r.select(_name().alias("grp"), "chain", "pos", R.one_letter(F.col("residue"), None).alias("letter"), *[F.col(f"ca_{c}").alias(c) for c in "xyz"], F.col("plddt_ca").alias("plddt"), "n_atoms", "plddt_atom_min", "plddt_atom_max")


def structure_facts(atoms: DataFrame, errors: DataFrame) -> DataFrame:
    """One row for each structure file, by name: what its atoms and residues are, and its sequence with MD5."""
    a = atoms.groupBy(_name().alias("structure")).agg(
        F.countDistinct("model").alias("models"), F.countDistinct(F.when(F.col("model") == 1, F.col("chain"))).alias("chains"), F.min("chain").alias("chain"), F.count_if(F.col("record") != "ATOM").alias("hetero"),
        F.count_if(~F.coalesce(F.col("icode"), F.lit("")).isin("", ".", "?", " ")).alias("inserted"),
    )
    letters = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("letter", F.lit("X")).alias("a"))))  # as long as a protein
    r = residues_of(atoms).groupBy(F.col("grp").alias("structure")).agg(
        F.count("*").alias("residues"), F.count_if(F.col("x").isNull()).alias("without_ca"), F.count_if(F.col("letter").isNull()).alias("unknown"), F.min("pos").alias("first"), F.max("pos").alias("last"),
        F.min("plddt_atom_min").alias("least_b"), F.max("plddt_atom_max").alias("most_b"), F.array_join(F.transform(letters, lambda x: x["a"]), "").alias("sequence"),
    )
    bad = errors.groupBy(_name().alias("structure")).agg(F.count("*").alias("unreadable"))
    return a.join(r, "structure", "full").join(bad, "structure", "full").withColumn("md5", F.md5("sequence"))


def matrix_facts(cells: DataFrame) -> DataFrame:
    """matrix (the file's name), cells, most_i, most_j, bad_cells."""
    v = F.col("value")
    return cells.groupBy(_name().alias("matrix")).agg(F.count("*").alias("cells"), F.max("i").alias("most_i"), F.max("j").alias("most_j"), F.count_if(v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf"))).alias("bad_cells"))


def record_facts(records: DataFrame) -> DataFrame:
    return records.where("uniprotAccession is not null").groupBy(F.col("uniprotAccession").alias("found_accession")).agg(
        F.min_by("entryId", "file").alias("found_entry"), F.min_by(F.col("latestVersion").cast("int"), "file").alias("found_version"), F.min_by("chainId", "file").alias("found_chain"), F.min_by(F.upper("uniprotSequence"), "file").alias("found_sequence"), F.min_by("sequenceChecksum", "file").alias("found_md5"),
    )


def extract(spark: SparkSession, manifest: DataFrame, structures: str, matrices: str, records: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(features of proteins that pass, verdicts of all) of manifest(MANIFEST), from folders of files.

    Verdicts have one row for each protein of the manifest with status and notes; files that no protein names are left alone. A
    protein that fails has no features, and keeps no other one from having them. Without ``records`` nothing is held against them.
    """
    atoms = S.atoms(spark, structures)
    cells = S.matrix(spark, matrices)
    facts = manifest.select(*MANIFEST)
    errors = S.mmcif_errors(spark, structures).unionByName(S.short_lines(spark, structures))
    for name, folder in (("structure", structures), ("matrix", matrices)):
        sums = D.checksums(spark, folder).select(_name("path").alias(name), F.col("sha256").alias(f"found_{name}_sha256"))
        facts = facts.join(sums, name, "left")
    facts = facts.join(structure_facts(atoms, errors), "structure", "left").join(matrix_facts(cells), "matrix", "left")
    own = rules()
    if records:
        facts = facts.join(record_facts(D.records(spark, records)), facts.accession == F.col("found_accession"), "left")
    else:
        own = {n: c for n, c in own.items() if n not in ("record missing", "accession", "entry", "version", "chain", "sequence", "sequence checksum")}
        for c in ("accession", "entry", "chain", "sequence", "md5"):
            facts = facts.withColumn(f"found_{c}", F.lit(None).cast("string"))
        facts = facts.withColumn("found_version", F.lit(None).cast("int"))
    verdicts = judged(facts, own)
    good = verdicts.where("status = 'PASS'").select("protein", "structure", "matrix")
    r = residues_of(atoms).withColumnRenamed("grp", "structure").join(good.drop("matrix"), "structure").withColumnRenamed("protein", "grp").drop("structure", "chain", "plddt_atom_min", "plddt_atom_max")
    m = cells.withColumn("matrix", _name()).join(good.drop("structure"), "matrix").select(F.col("protein").alias("grp"), "i", "j", "value")
    return T.features(r, m, "grp"), verdicts


def paired(spark: SparkSession, structures: str, matrices: str) -> DataFrame:
    """A manifest of the structure files of a folder and the matrix files beside them, as they are: for scoring what has no manifest."""
    s, m = D.listing(spark, structures), D.listing(spark, matrices, (".json",))
    pairs = D.siblings(s, m)
    sums = D.checksums(spark, structures).select(_name("path").alias("structure"), F.col("sha256").alias("structure_sha256"))
    more = D.checksums(spark, matrices).select(_name("path").alias("matrix"), F.col("sha256").alias("matrix_sha256"))
    n = S.matrix(spark, matrices).groupBy(_name().alias("matrix")).agg(F.max("i").cast("int").alias("length"))
    none = F.lit(None).cast("string")
    out = pairs.select(F.col("name").alias("structure"), "matrix").join(sums, "structure").join(more, "matrix", "left").join(n, "matrix", "left")
    return out.select(F.regexp_replace("structure", r"\.[^.]*$", "").alias("protein"), "structure", "matrix", "structure_sha256", "matrix_sha256", none.alias("accession"), none.alias("entry"), F.lit(None).cast("int").alias("version"), "length")
