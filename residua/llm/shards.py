"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows of each block of the input go to each shard is drawn first, exactly as a uniform permutation of all rows would
have it: a row of the matrix is a multivariate hypergeometric sample of what is left of the shards. Blocks are then permuted
each on its own, their rows dealt to the shards by the drawn counts, and each shard is permuted again. The matrix is drawn in
two levels, groups of blocks on the driver and blocks within their group in tasks, so neither holds all of it; the shards' sizes
and each block's rows are met exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

#: Rows of a block, and of what is permuted in one task of the second permutation, as powers of two; blocks of a group.
BLOCK, LOT, GROUP = 20, 18, 256
#: numpy draws hypergeometric numbers of populations below this.
LARGE = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` items drawn without replacement are good; exact for any population that 64 bits can count.

    From a large population each item is taken by itself with probability p = sample / population, which is a uniform subset of a
    size near ``sample``; what is missing is drawn from the others, what is too much is given back, until few items are open.
    """
    took, sign = 0, 1
    while True:
        if sample == 0 or good == 0:
            return took
        if bad == 0:
            return took + sign * sample
        if good < LARGE and bad < LARGE:
            return took + sign * int(rng.hypergeometric(good, bad, sample))
        if sample <= 4096:  # places of the items drawn, one at a time
            seen: set[int] = set()
            while len(seen) < sample:
                seen.add(int(rng.integers(good + bad)))
            return took + sign * sum(x < good for x in seen)
        p = sample / (good + bad)
        g, b = int(rng.binomial(good, p)), int(rng.binomial(bad, p))
        took += sign * g
        if g + b <= sample:
            good, bad, sample = good - g, bad - b, sample - g - b
        else:
            good, bad, sample, sign = g, b, g + b - sample, -sign


def matrix(rng: np.random.Generator, rows: list[int], room: np.ndarray) -> np.ndarray:
    """Counts of each of ``rows`` (their sizes) in each column; columns add up to ``room``, whose sum is that of the rows."""
    left = np.array(room, np.int64)
    out = np.zeros((len(rows), len(left)), np.int64)
    for i, n in enumerate(rows):
        if left.sum() < LARGE:
            out[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
        else:
            rest, open_ = int(n), int(left.sum())
            for j, x in enumerate(left.tolist()):
                open_ -= x
                out[i, j] = k = hypergeometric(rng, x, open_, rest)
                rest -= k
        left -= out[i]
    return out


def sizes(rows: int, shards: int) -> np.ndarray:
    """Rows of each shard; the first ones have one more where they can't be equal."""
    return np.array([rows // shards + (j < rows % shards) for j in range(shards)], np.int64)


def shuffled(df: DataFrame, shards: int, seed: int = 1, block_bits: int = BLOCK, lot_bits: int = LOT, group: int = GROUP) -> DataFrame:
    """The rows of df with ``shard`` int and ``slot`` long (from 0 without a gap in each shard), uniformly shuffled.

    Shards' rows differ by one at most. A block is at most 2^block_bits rows of one partition of df, whose rows and their order
    are written down before counts are taken, so a lost executor changes nothing. Which row goes where depends on the seed and on
    how df is dealt into partitions; contents play no part, so nulls, ties and repeated rows are rows like others. An empty df
    gives no rows. Columns of df named as the results are replaced.
    """
    spark = df.sparkSession
    own = [c for c in df.columns if c not in ("shard", "slot")]
    row, packed = F.col("_row"), F.struct(*own).alias("_own")
    base = C.keep(df.select(packed).withColumn("_row", F.monotonically_increasing_id()).select("_own", F.shiftright(row, block_bits).alias("_block"), row), "rows")

    # communication matrix: blocks are gathered into groups by their order; the driver draws groups, tasks their blocks
    per = base.groupBy("_block").agg(F.count("*").alias("n"))
    part = F.shiftright("_block", 33 - block_bits)  # blocks are numbered from 0 in each partition of df
    offsets = per.groupBy(part.alias("p")).agg(F.count("*").alias("blocks"))
    before = F.coalesce(F.sum("blocks").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row for each partition
    place = offsets.select("p", before.alias("at"))
    placed = C.keep(per.withColumn("p", part).join(place, "p").select("_block", "n", ((F.col("at") + F.col("_block") % F.shiftleft(F.lit(1).cast("long"), 33 - block_bits)) / group).cast("long").alias("g")), "blocks")
    groups = placed.groupBy("g").agg(F.sum("n").alias("n")).orderBy("g").collect()  # one row for each group of blocks
    total = sum(r.n for r in groups)
    drawn = matrix(np.random.default_rng([seed, 0]), [r.n for r in groups], sizes(total, shards))
    wanted = spark.createDataFrame(pd.DataFrame({"g": [r.g for r in groups], "room": [x.tolist() for x in drawn]}), "g long, room array<long>") if groups else spark.createDataFrame([], "g long, room array<long>")

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        m = matrix(np.random.default_rng([seed, 1 + int(pdf.g.iloc[0])]), pdf.n.tolist(), np.array(pdf.room.iloc[0]))
        return pd.DataFrame({"_block": pdf._block, "_ends": [np.cumsum(x).tolist() for x in m]})

    ends = placed.join(wanted, "g").groupBy("g").applyInPandas(deal, "_block long, _ends array<long>")

    # permute blocks and deal their rows; then permute shards, each in lots of its own
    rank = F.row_number().over(W.partitionBy("_block").orderBy(F.xxhash64(F.lit(seed), F.lit("block"), "_row"), "_row"))
    dealt = base.withColumn("_rank", rank).join(ends, "_block")
    key = F.xxhash64(F.lit(seed), F.lit("shard"), "_row")
    lots = max(1, int(total // shards) >> lot_bits)
    dealt = C.keep(dealt.select("_own", "_row", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))).alias("shard"), F.pmod(F.shiftright(key, 20), F.lit(lots)).alias("_lot"), key.alias("_key")), "dealt")
    count = dealt.groupBy("shard", "_lot").agg(F.count("*").alias("n"))
    first = count.select("shard", "_lot", (F.sum("n").over(W.partitionBy("shard").orderBy("_lot")) - F.col("n")).alias("_first"))
    slot = F.row_number().over(W.partitionBy("shard", "_lot").orderBy("_key", "_row"))
    return dealt.withColumn("_slot", slot).join(first, ["shard", "_lot"]).select("_own.*", "shard", (F.col("_first") + F.col("_slot") - 1).cast("long").alias("slot"))


def op12_shards(spark, sf_dir: str) -> DataFrame:
    d = C.table(spark, sf_dir, "documents", "doc_id", "text").where("doc_id is not null")
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = d.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffled(narrow, 40).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
