"""What sequences and chains are like: composition, weight, hydropathy, isoelectric point, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import residues as R
from . import structures as T


def sequences(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """key, length, weight, gravy, isoelectric_point, note, preview of each sequence; an empty or null one has length 0 and a note."""
    s = F.upper(F.coalesce(F.col(sequence), F.lit("")))
    return df.select(key, F.length(s).cast("long").alias("length"), R.molecular_weight(s).alias("weight"), R.gravy(s).alias("gravy"), R.isoelectric_point(s).alias("isoelectric_point"), R.skipped(s).alias("note"), R.preview(s).alias("preview"))


def composition(df: DataFrame, sequence: str, by: list[str] | None = None) -> DataFrame:
    """by, letter, n, share, class: letters of all sequences, most first, then by letter."""
    by = by or []
    c = df.select(*by, F.explode(F.split(F.upper(F.coalesce(F.col(sequence), F.lit(""))), "")).alias("letter")).where("letter <> ''").groupBy(*by, "letter").agg(F.count("*").alias("n"))
    all_ = c.groupBy(*by).agg(F.sum("n").alias("__all")) if by else c.agg(F.sum("n").alias("__all"))  # a row for each key
    j = c.join(all_, by) if by else c.crossJoin(F.broadcast(all_))
    return j.select(*by, "letter", "n", (F.col("n") / F.col("__all")).alias("share"), R.residue_class(F.col("letter")).alias("class")).orderBy(*by, F.desc("n"), "letter")


def chains(residues: DataFrame) -> DataFrame:
    """grp, chain, n, mean, least, most and the shares of confident residues (over 70 and over 90) of residues(grp, chain, plddt)."""
    return T.confidence(residues, ["grp", "chain"], "plddt").withColumnsRenamed({"share_1": "confident", "share_2": "very_confident"})
