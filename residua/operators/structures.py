"""Atoms, residues and chains: what they sum up to, which of them a table may be made of, and the feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import residues as R
from .spatial import Rule, matrix_means, rule_means, spatial_features


def residue_atoms(atoms: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each residue of atoms(keys, ordinal, atom, residue, x, y, z, b): counts of atom names, centre, CA place, confidence.

    Of an atom name that a residue has twice the first one counts. The confidence is that of CA, or of all atoms without one.
    """
    one = atoms.groupBy(*keys, "atom").agg(F.min("ordinal").alias("ordinal"), F.min_by(F.struct("residue", "x", "y", "z", "b"), "ordinal").alias("v")).select(*keys, "atom", "ordinal", "v.*")
    ca = lambda c: F.max(F.when(F.col("atom") == "CA", F.col(c)))
    return one.groupBy(*keys).agg(
        F.min_by("residue", "ordinal").alias("residue"), F.count("*").alias("n_atoms"), F.count_if(F.col("atom").isin(*R.BACKBONE)).alias("n_backbone_atoms"),
        *[F.avg(c).alias(f"centroid_{c}") for c in "xyz"], *[ca(c).alias(f"ca_{c}") for c in "xyz"], F.coalesce(ca("b"), F.avg("b")).alias("plddt_ca"),
        F.avg("b").alias("plddt_atom_mean"), F.min("b").alias("plddt_atom_min"), F.max("b").alias("plddt_atom_max"), F.stddev_pop("b").alias("plddt_atom_std"),
    )


def confidence(residues: DataFrame, by: list[str], value: str, cuts: tuple[float, ...] = (70.0, 90.0)) -> DataFrame:
    """by, n, mean, least, most, and the share of rows at or over each cut (share_1, share_2, ...)."""
    v = F.col(value)
    return residues.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), *[F.avg((v >= c).cast("double")).alias(f"share_{k}") for k, c in enumerate(cuts, 1)])


def totals(df: DataFrame, **levels: list[str]) -> DataFrame:
    """One row: rows, and the number of different values of each level's columns, such as models, chains and residues."""
    return df.agg(F.count("*").alias("rows"), *[F.countDistinct(*cols).alias(name) for name, cols in levels.items()])


def bounding_box(points: DataFrame, by: list[str], xyz: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """by, size of the box that holds all points, for each axis."""
    return points.groupBy(*by).agg(*[(F.max(c) - F.min(c)).alias(f"size_{c}") for c in xyz])


def ordered_distinct(df: DataFrame, value: str, order: str) -> DataFrame:
    """value, first: different values by the place where each comes first."""
    return df.groupBy(value).agg(F.min(order).alias("first")).orderBy("first")


def channel_alignment(a: DataFrame, b: DataFrame, by: list[str], key: str, value: str, most: float = 0.5) -> DataFrame:
    """by, n_a, n_b, mean_diff, max_diff, aligned: two channels joined by the ordinal ``key``; aligned if as many and near on average."""
    x = a.select(*by, key, F.col(value).alias("__a"))
    y = b.select(*by, key, F.col(value).alias("__b"))
    d = F.abs(F.col("__a") - F.col("__b"))
    g = x.join(y, [*by, key], "full").groupBy(*by).agg(F.count("__a").alias("n_a"), F.count("__b").alias("n_b"), F.avg(d).alias("mean_diff"), F.max(d).alias("max_diff"))
    return g.withColumn("aligned", (F.col("n_a") == F.col("n_b")) & (F.coalesce(F.col("mean_diff"), F.lit(float("inf"))) <= most))


def chain_rules(atoms: DataFrame, by: str, chain: str, wanted: str | None = None) -> DataFrame:
    """by, chains, rule: structures without the wanted chain, or of several chains where none is named."""
    g = atoms.groupBy(by).agg(F.countDistinct(chain).alias("chains"), *([F.max((F.col(chain) == wanted).cast("int")).alias("__has")] if wanted else []))
    rule = F.when(F.col("__has") == 0, "no such chain") if wanted else F.when(F.col("chains") != 1, "several chains")
    return g.select(by, "chains", rule.alias("rule")).where("rule is not null")


def record_counts(atoms: DataFrame, by: list[str], record: str = "record", alt: str = "alt", icode: str | None = None) -> DataFrame:
    """by, atoms, hetero, other_places, inserted: what is kept and what is left out or rejected, counted in one pass."""
    a = F.coalesce(F.col(alt), F.lit("")).isin("", ".", "?", "A")
    atom = F.col(record) == "ATOM"
    ins = ~F.coalesce(F.col(icode), F.lit("")).isin("", ".", "?", " ") if icode else F.lit(False)
    return atoms.groupBy(*by).agg(F.count_if(atom & a).alias("atoms"), F.count_if(~atom).alias("hetero"), F.count_if(atom & ~a).alias("other_places"), F.count_if(ins).alias("inserted"))


def only(df: DataFrame, key: str, subset: DataFrame | None = None, without: DataFrame | None = None, status: Column | None = None) -> DataFrame:
    """Rows of a status, of the keys of ``subset`` and of none of ``without``."""
    if status is not None:
        df = df.where(status)
    if subset is not None:
        df = df.join(subset.select(key).distinct(), key, "left_semi")
    return df if without is None else df.join(without.select(key).distinct(), key, "left_anti")


def first_offenders(broken: DataFrame, by: list[str], pos: str, n: int = 10) -> DataFrame:
    """by, n, first: how many places break a rule, and the first n of them in order.

    Of each group only n places leave a task (Spark limits a filtered row number before the shuffle), and rows are counted apart.
    """
    first = broken.select(*by, pos).withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(pos))).where(F.col("__r") <= n)
    first = first.groupBy(*by).agg(F.array_sort(F.collect_list(pos)).alias("first"))
    return broken.groupBy(*by).agg(F.count("*").alias("n")).join(first, by)


def protein_summary(residues: DataFrame, cells: DataFrame, expected: DataFrame, group: str, value: str) -> DataFrame:
    """One row for each expected protein: observed rows, confidence and matrix figures, PASS or FAIL with notes.

    FAIL: no rows, other numbers of rows than expected(group, expected), or a matrix that isn't square of that size. A protein
    that fails stays as a row, so that the others go on.
    """
    r = residues.groupBy(group).agg(F.count("*").alias("rows"), F.avg(value).alias("mean_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    m = cells.groupBy(group).agg(F.count("*").alias("cells"), F.avg("value").alias("mean_cell"), F.min("value").alias("min_cell"), F.max("value").alias("max_cell"))
    j = expected.join(r, group, "left").join(m, group, "left")
    n, e = F.coalesce("rows", F.lit(0)), F.col("expected")
    notes = F.concat_ws("; ", F.when(n == 0, "no rows"), F.when((n > 0) & (n != e), "length"), F.when(F.coalesce("cells", F.lit(0)) != e * e, "matrix shape"))
    return j.select(group, "expected", n.alias("rows"), "mean_value", "min_value", "max_value", "mean_cell", "min_cell", "max_cell", F.when(notes == "", "PASS").otherwise("FAIL").alias("status"), notes.alias("notes"))


def features(residues: DataFrame, cells: DataFrame | Rule, group: str, radius: float = R.RADIUS, band: int = R.BAND) -> DataFrame:
    """The feature table of residues(group, pos, letter, x, y, z, plddt, n_atoms) and matrix cells (group, i, j, value), or a rule in place of them.

    Chemistry of the letter with the class one-hot in fixed order, row, column and band means of the matrix, and density, mean
    confidence and mean directed cell of the neighbours within ``radius``. A residue without a neighbour stays, with density 0.
    """
    own = residues.withColumn("plddt", F.round("plddt", 2))
    sp = spatial_features(own, cells, group, "pos", ("x", "y", "z"), radius, "plddt")
    means = rule_means(own, group, "pos", cells, band) if isinstance(cells, Rule) else matrix_means(cells, group, band)
    j = own.join(means, [group, "pos"], "left").join(sp, [group, "pos"], "left")
    kind = R.residue_class(F.col("letter"))
    return j.select(
        group, "pos", "letter", kind.alias("class"), R.hydropathy(F.col("letter")).alias("hydropathy"), R.charge(F.col("letter")).alias("charge"), "n_atoms", F.col("plddt").alias("plddt_ca"), "row_mean", "col_mean", "local_mean",
        F.coalesce("density", F.lit(0)).alias("density"), "neighbour_value", "neighbour_cell", *R.one_hot(kind),
    )


def feature_rules(group: str = "group") -> dict[str, Column]:
    """What a row of the feature table may not be: without neighbours, unknown, out of range or not finite."""
    rules = {"no neighbour": F.col("density") == 0, "unknown residue": F.col("class") == "unknown", "confidence": ~F.col("plddt_ca").between(0, 100)}
    for c in ("row_mean", "col_mean", "local_mean"):
        rules[f"{c} not finite"] = F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0)
    return rules


def atom_rules() -> dict[str, Column]:
    """What a kept atom row may not be: of an inserted residue, without a name, of an unknown residue, without numbers, out of range."""
    c = F.col
    none = lambda v: F.coalesce(F.trim(c(v)), F.lit("")) == ""
    finite = F.lit(True)
    for v in ("x", "y", "z"):
        finite &= c(v).isNotNull() & ~F.isnan(c(v)) & (F.abs(c(v)) < float("inf"))
    return {
        "inserted residue": ~F.coalesce(F.trim(c("icode")), F.lit("")).isin("", ".", "?"), "no atom name": none("atom"), "no residue name": none("residue"), "unknown residue": ~none("residue") & R.one_letter(c("residue"), None).isNull(),
        "coordinates": ~finite, "position": c("pos").isNull(), "confidence": ~F.coalesce(c("b").between(0, 100), F.lit(False)),
    }


def inference_rules(atoms: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """keys, pos (null for a chain as a whole), rule: what keeps a chain of kept atoms from being scored, each rule and place once.

    Beside the rules of its atoms: a place of two residue names or without a CA, and fewer than two residues.
    """
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in atom_rules().items()]))
    rows = atoms.select(*keys, F.col(pos).alias("pos"), F.explode(broken).alias("rule")).distinct()
    place = atoms.groupBy(*keys, F.col(pos).alias("pos")).agg(F.countDistinct(F.upper(F.trim("residue"))).alias("names"), F.max((F.col("atom") == "CA").cast("int")).alias("ca"))
    own = F.array_compact(F.array(F.when(F.col("names") > 1, F.lit("two residue names")), F.when(F.coalesce("ca", F.lit(0)) == 0, F.lit("no CA"))))
    few = place.groupBy(*keys).agg(F.count("pos").alias("n")).where("n < 2").select(*keys, F.lit(None).cast(dict(atoms.dtypes)[pos]).alias("pos"), F.lit("fewer than two residues").alias("rule"))
    return rows.unionByName(place.select(*keys, "pos", F.explode(own).alias("rule"))).unionByName(few)
