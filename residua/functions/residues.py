"""Scalar functions over residues, sequences, identifiers and scores, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard residues, their classes, hydropathies, charges and average masses.
THREE_TO_ONE = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
CLASSES = {"nonpolar": "AVLIM", "aromatic": "FWY", "polar": "STCNQ", "basic": "KRH", "acidic": "DE", "special": "GP"}
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}
CHARGE = {"D": -1, "E": -1, "K": 1, "R": 1}
MASS = {
    "A": 89.0932, "R": 174.201, "N": 132.1179, "D": 133.1027, "C": 121.1582, "Q": 146.1445, "E": 147.1293, "G": 75.0666, "H": 155.1546, "I": 131.1729,
    "L": 131.1729, "K": 146.1876, "M": 149.2113, "F": 165.1891, "P": 115.1305, "S": 105.0926, "T": 119.1192, "W": 204.2252, "Y": 181.1885, "V": 117.1463,
}
WATER = 18.0153
# Where side chains and the two ends of a chain are half charged (Bjellqvist et al., 1993).
PK_POSITIVE = {"K": 10.0, "R": 12.0, "H": 5.98}
PK_NEGATIVE = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
PK_FIRST, PK_FIRST_OF = 7.5, {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
PK_LAST, PK_LAST_OF = 3.55, {"D": 4.55, "E": 4.75}
BACKBONE = ("N", "CA", "C", "O")
ONE_HOT_ORDER = ("acidic", "aromatic", "basic", "nonpolar", "polar", "special")
BAND, CONTACT, RADIUS = 10, 0.50, 12.0


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def one_letter(residue: Column, unknown: str | None = "X") -> Column:
    """One letter of a residue name; ``unknown`` (None: null) for others."""
    return F.coalesce(F.element_at(_map(THREE_TO_ONE), F.upper(F.trim(residue))), F.lit(unknown))


def residue_class(letter: Column) -> Column:
    return F.coalesce(F.element_at(_map({a: c for c, s in CLASSES.items() for a in s}), letter), F.lit("unknown"))


def hydropathy(letter: Column) -> Column:
    return F.element_at(_map(HYDROPATHY), letter)


def charge(letter: Column) -> Column:
    return F.coalesce(F.element_at(_map(CHARGE), letter), F.lit(0))


def one_hot(value: Column, order: tuple[str, ...] = ONE_HOT_ORDER, prefix: str = "class_") -> list[Column]:
    """One double column for each value, in fixed order."""
    return [(value == t).cast("double").alias(prefix + t) for t in order]


def chain_id(chain: Column) -> Column:
    return F.when(F.trim(chain).isin("", ".", "?") | chain.isNull(), F.lit("_")).otherwise(F.trim(chain))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def platt(p: Column, slope: float, intercept: float) -> Column:
    """A calibrated score: the sigmoid of a line over the logit, within 0 and 1."""
    return F.least(F.greatest(sigmoid(F.lit(slope) * logit(p) + F.lit(intercept)), F.lit(0.0)), F.lit(1.0))


def at_least(p: Column, threshold: float) -> Column:
    return (p >= threshold).cast("int")


def letters_only(text: Column) -> Column:
    """Upper-cased, without what isn't a letter in Unicode."""
    return F.regexp_replace(F.upper(text), r"\P{L}", "")


def entry_id(accession: Column) -> Column:
    return F.concat(F.lit("AF-"), F.upper(F.trim(accession)), F.lit("-F1"))


def model_version(name: Column) -> Column:
    return F.regexp_extract(name, r"-model_v(\d+)\.cif$", 1).try_cast("int")


def last_segment(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def preview(text: Column, n: int = 70) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def molecular_weight(sequence: Column) -> Column:
    """Average mass, one decimal; null for other letters or no letter."""
    chars = F.split(sequence, "")
    total = F.aggregate(chars, F.lit(0.0), lambda a, c: a + F.coalesce(F.element_at(_map(MASS), c), F.lit(0.0)))
    return F.when(standard(sequence), F.round(total - (F.length(sequence) - 1) * WATER, 1))


def gravy(sequence: Column) -> Column:
    """Mean hydropathy, three decimals."""
    chars = F.split(sequence, "")
    total = F.aggregate(chars, F.lit(0.0), lambda a, c: a + F.coalesce(F.element_at(_map(HYDROPATHY), c), F.lit(0.0)))
    return F.when(standard(sequence), F.round(total / F.length(sequence), 3))


def standard(sequence: Column) -> Column:
    return sequence.rlike("^[ACDEFGHIKLMNPQRSTVWY]+$")


def skipped(sequence: Column) -> Column:
    """A note where weight, hydropathy and isoelectric point are left out, else null."""
    return F.when(~F.coalesce(standard(sequence), F.lit(False)), "other letters")


def isoelectric_point(sequence: Column, steps: int = 30) -> Column:
    """The pH from 4.05 to 12 at which the chain has no charge, two decimals, by halving; null for other letters or no letter."""
    first = F.coalesce(F.element_at(_map(PK_FIRST_OF), F.substring(sequence, 1, 1)), F.lit(PK_FIRST))
    last = F.coalesce(F.element_at(_map(PK_LAST_OF), F.right(sequence, F.lit(1))), F.lit(PK_LAST))
    n = lambda a: F.length(sequence) - F.length(F.replace(sequence, F.lit(a), F.lit("")))

    def net(ph: Column) -> Column:
        up = 1 / (1 + F.pow(F.lit(10.0), ph - first))
        down = 1 / (1 + F.pow(F.lit(10.0), last - ph))
        for a, pk in PK_POSITIVE.items():
            up = up + n(a) / (1 + F.pow(F.lit(10.0), ph - pk))
        for a, pk in PK_NEGATIVE.items():
            down = down + n(a) / (1 + F.pow(F.lit(10.0), pk - ph))
        return up - down

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        right = net(mid) > 0
        return F.struct(F.when(right, mid).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(4.05).alias("lo"), F.lit(12.0).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: F.round((s["lo"] + s["hi"]) / 2, 2))
    return F.when(standard(sequence), found)
