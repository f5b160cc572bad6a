"""JSON records, CSV tables, file listings and written sequences as DataFrames."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.residues import letters_only

NUMBERS, ROWS = "array<double>", "array<array<double>>"
FULL = f"struct<atom_plddts:{NUMBERS},atom_chain_ids:array<string>,pae:{ROWS},contact_probs:{ROWS},token_res_ids:array<int>>"
RECORD = "struct<entryId:string,uniprotAccession:string,uniprotSequence:string,sequenceChecksum:string,latestVersion:int,chainId:string,isComplex:boolean,cifUrl:string,paeDocUrl:string,globalMetricValue:double>"


def sequence(spark: SparkSession, name: str, letters: str) -> DataFrame:
    """id, sequence of a sequence that is written out: upper-cased, letters only."""
    return spark.createDataFrame([(name, letters)], "id string, sequence string").select("id", letters_only(F.col("sequence")).alias("sequence"))


def listing(spark: SparkSession, path: str, ends: tuple[str, ...] = (".pdb", ".cif", ".mmcif")) -> DataFrame:
    """path, name, size of the files of a folder (not below it) that end so, by path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"))
    keep = F.lit(False)
    for e in ends:
        keep |= F.lower("name").endswith(e)
    return f.where(keep).orderBy("path")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of the bytes of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def matrix_names(name: Column) -> list[Column]:
    """Names that the matrix file beside a structure file may have, the first one that is there counts; null where there is none."""
    form = r"(?i)^(.*)-model_(v\d+)\.(?:cif|pdb)$"
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    official = F.concat(F.regexp_extract(name, form, 1), F.lit("-predicted_aligned_error_"), F.regexp_extract(name, form, 2), F.lit(".json"))
    return [F.when(name.rlike(form), official), F.concat(stem, F.lit(".pae.json")), F.concat(stem, F.lit("_pae.json"))]


def siblings(structures: DataFrame, files: DataFrame, name: str = "name") -> DataFrame:
    """name, matrix: the matrix file of each structure file, null where none of its names is among files(name)."""
    tries = structures.select(F.col(name).alias("name"), F.posexplode(F.array(*matrix_names(F.col(name)))).alias("rank", "matrix"))
    there = tries.join(files.select(F.col(name).alias("matrix")).distinct(), "matrix", "left_semi").groupBy("name").agg(F.min_by("matrix", "rank").alias("matrix"))
    return structures.select(F.col(name).alias("name")).distinct().join(there, "name", "left")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def full_data(spark: SparkSession, path: str) -> DataFrame:
    """file, missing (names of required parts that aren't there) and the parts of full-data files."""
    x = _whole(spark, path).select("file", F.from_json("value", FULL).alias("d"))
    parts = ["atom_plddts", "atom_chain_ids", "pae", "contact_probs", "token_res_ids"]
    return x.select("file", F.array_compact(F.array(*[F.when(F.col(f"d.{p}").isNull(), F.lit(p)) for p in parts])).alias("missing"), "d.*")


def records(spark: SparkSession, path: str, canonical: bool = False) -> DataFrame:
    """file and the entry record of each file: the first one, or the one whose entryId is AF-<accession>-F1 (no row without one)."""
    x = _whole(spark, path).select("file", F.coalesce(F.from_json("value", f"array<{RECORD}>"), F.array(F.from_json("value", RECORD))).alias("r"))
    if not canonical:
        return x.select("file", F.try_element_at("r", F.lit(1)).alias("r")).select("file", "r.*")
    own = F.filter("r", lambda e: e["entryId"] == F.concat(F.lit("AF-"), e["uniprotAccession"], F.lit("-F1")))
    return x.select("file", F.try_element_at(own, F.lit(1)).alias("r")).where("r is not null").select("file", "r.*")


def candidates(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """file and the columns of each candidate; a value of another type is null."""
    kind = "struct<candidates:array<struct<" + ",".join(f"{c}:{t}" for c, t in columns.items()) + ">>>"
    return _whole(spark, path).select("file", F.explode(F.from_json("value", kind)["candidates"]).alias("c")).select("file", "c.*")


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header, in the schema that is asked for; empty texts are null."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def arrays(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """file, missing, at, and a double for each key: the values of the one-dimensional arrays of NPZ files, row by row.

    A file that can't be used has one row with nulls and, in missing, the keys that it doesn't have, have other than one
    dimension, aren't numbers, or are of another length than the first. Objects are never unpickled. A file is read by one task.
    """

    def run(batches):
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                bad, got = [], {}
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    for k in keys:
                        v = z[k] if k in z.files else None
                        if v is None or v.dtype.kind not in "biuf" or v.ndim != 1 or len(v) != len(next(iter(got.values()), v)):
                            bad.append(k)
                        else:
                            got[k] = v.astype(np.float64)
                n = 1 if bad else len(got[keys[0]])
                at, values = (pa.nulls(1, pa.int64()), [pa.nulls(1, pa.float64())] * len(keys)) if bad else (pa.array(np.arange(n)), [pa.array(got[k]) for k in keys])
                yield pa.record_batch([pa.array([file] * n, pa.string()), pa.array([bad] * n, pa.list_(pa.string())), at, *values], names=["file", "missing", "at", *keys])

    schema = "file string, missing array<string>, at long, " + ", ".join(f"`{k}` double" for k in keys)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content").mapInArrow(run, schema)
