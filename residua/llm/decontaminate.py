"""Benchmark decontamination by winnowing (Schleimer, Wilkerson and Aiken, 2003).

Both sides keep the least k-gram hash of every ``w`` consecutive k-grams, so a span of
``w + k - 1`` shared words has a fingerprint in common; fingerprints are joined and each
hit is extended word by word to the whole shared run. With k=5, w=6 every shared span of
ten words is found, and what is reported is exact. Items shorter than a window are one
gram of their own length, looked up at every position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

U = np.uint64


def _prints(words: C.Words, k: int, w: int) -> np.ndarray:
    """Places of the winnowed fingerprints, by word."""
    g, left = C.grams(words.hash, k), words.left()
    span = w + k - 1
    if len(g) < w:
        return np.zeros(0, np.int64)
    at = C.sliding_argmin(g, w)
    return np.unique(at[left[: len(at)] >= span])


def _context(words: C.Words, at: np.ndarray, before: int, after: int) -> np.ndarray:
    """Word hashes around each place, 0 outside the row."""
    h = np.concatenate([words.hash | U(1), np.zeros(1, U)])
    idx = at[:, None] + np.arange(-before, after)
    row = np.searchsorted(words.first, at, "right") - 1
    ok = (idx >= words.first[row][:, None]) & (idx < words.first[row + 1][:, None])
    return h[np.where(ok, idx, len(words.hash))]


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def item_prints(items: DataFrame, k: int = 5, w: int = 6) -> DataFrame:
    """item_id string, size int (0: a fingerprint of a longer item; else the words of a short one), hash long, context binary."""
    span = w + k - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            x = C.Words(b.column("text"), C.PLAIN, True)
            at = _prints(x, k, w)
            g = C.grams(x.hash, k)
            short = np.flatnonzero((x.counts > 0) & (x.counts < span))
            sh = np.array([C.grams(x.hash[x.first[r] : x.first[r + 1]], int(x.counts[r]))[0] for r in short], U)
            row = np.searchsorted(x.first, at, "right") - 1
            ids = b.column("item_id")
            yield pa.record_batch(
                [ids.take(pa.array(np.concatenate([row, short]))), pa.array(np.concatenate([np.zeros(len(at), np.int32), x.counts[short].astype(np.int32)])), pa.array(_signed(np.concatenate([g[at], sh]))), _binary(np.concatenate([_context(x, at, span - k, span), np.zeros((len(short), 2 * span - k), U)]))],
                names=["item_id", "size", "hash", "context"],
            )

    src = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInArrow(run, "item_id string, size int, hash long, context binary").distinct()


def hits(docs: DataFrame, items: DataFrame, k: int = 5, w: int = 6, filter_bits: int = 22) -> tuple[DataFrame, DataFrame]:
    """Two frames: one row for each document (doc_id, hash, n_words), and the shared spans (doc_id, hash, item_id, start, stop in words).

    ``filter_bits``: a bit map of 2^filter_bits places of item fingerprints goes to every task, whatever
    the size of ``items``; it only thins out what the join must look at. The join is by fingerprint, and
    Spark splits a hot one (skew join).
    """
    spark, span = docs.sparkSession, w + k - 1
    prints = C.keep(item_prints(items, k, w), "items")
    mask = (1 << filter_bits) - 1
    bits = np.zeros(1 << filter_bits, bool)
    slot = prints.select(F.col("hash").bitwiseAND(F.lit(mask)).cast("int").alias("s")).distinct().toArrow()
    bits[np.asarray(slot.column("s"))] = True
    sizes = sorted(r[0] for r in prints.where("size > 0").select("size").distinct().collect())  # at most span - 1 values
    packed = spark.sparkContext.broadcast((np.packbits(bits), sizes))
    kept = "array<struct<pos:int,size:int,hash:bigint,context:binary>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sizes = np.unpackbits(packed.value[0]).astype(bool), packed.value[1]
        for b in C.slices(batches):
            x = C.Words(b.column("text"), C.PLAIN, True)
            left, at = x.left(), _prints(x, k, w)
            g = C.grams(x.hash, k)[at]
            ok = seen[(g & U(mask)).astype(np.int64)]
            parts = [(at[ok], np.zeros(int(ok.sum()), np.int32), g[ok], _context(x, at[ok], span - k, span))]
            for m in sizes:
                s = C.grams(x.hash, m)
                p = np.flatnonzero((left >= m) & seen[(s & U(mask)).astype(np.int64)])
                parts.append((p, np.full(len(p), m, np.int32), s[p], np.zeros((len(p), 2 * span - k), U)))
            pos, size, hsh, ctx = (np.concatenate([p[i] for p in parts]) for i in range(4))
            order = np.argsort(pos, kind="stable")
            pos, size, hsh, ctx = pos[order], size[order], hsh[order], ctx[order]
            row = np.searchsorted(x.first, pos, "right") - 1
            st = pa.StructArray.from_arrays([pa.array((pos - x.first[row]).astype(np.int32)), pa.array(size), pa.array(_signed(hsh)), _binary(ctx)], names=["pos", "size", "hash", "context"])
            yield pa.record_batch([b.column("doc_id"), b.column("hash"), pa.array(x.counts), pa.ListArray.from_arrays(pa.array(np.searchsorted(pos, x.first).astype(np.int32)), st)], names=[*C.KEY, "n_words", "kept"])

    first = C.keep(C.keyed(docs).mapInArrow(run, f"doc_id long, hash long, n_words long, kept {kept}"), "prints")
    found = first.select(*C.KEY, F.explode("kept").alias("x")).select("doc_id", F.col("hash").alias("own"), "x.*")
    joined = found.join(prints.withColumnRenamed("context", "other"), ["size", "hash"]).select("doc_id", F.col("own").alias("hash"), "item_id", "pos", "size", "context", "other")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            size, pos = np.asarray(b.column("size")).astype(np.int64), np.asarray(b.column("pos")).astype(np.int64)
            one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), U).reshape(b.num_rows, -1) for c in ("context", "other"))
            same = (one == two) & (one != 0)
            back = np.cumprod(same[:, : span - k][:, ::-1], axis=1).sum(1)
            on = np.cumprod(same[:, span - k :], axis=1).sum(1)
            short = size > 0
            ok = short | ((on >= k) & (back + on >= span))
            start, stop = np.where(short, pos, pos - back), np.where(short, pos + size, pos + on)
            keep = pa.array(ok)
            yield pa.record_batch([*[b.column(c) for c in (*C.KEY, "item_id")], pa.array(start), pa.array(stop)], names=[*C.KEY, "item_id", "start", "stop"]).filter(keep)

    return first.select(*C.KEY, "n_words"), joined.mapInArrow(extend, "doc_id long, hash long, item_id string, start long, stop long")


def contamination(docs: DataFrame, items: DataFrame, k: int = 5, w: int = 6) -> DataFrame:
    """doc_id, n_words, n_hit long, spans array<struct<start,stop>> (merged, in words), items array<string> (sorted), contaminated, hash.

    A document word in any occurrence of w + k - 1 consecutive item words (all words of a shorter item) is hit.
    Null and empty texts have no words and no hits, an item without words never occurs, no items: no hits.
    Rows that repeat a doc_id are judged by their own texts, which ``hash`` tells apart. Order of rows and ties play no part.
    """
    base, spans = hits(docs, items, k, w)
    # one row for each place first; a span that begins behind all that end before it begins a new one
    at = W.partitionBy(*C.KEY).orderBy("start")
    place = spans.groupBy(*C.KEY, "start").agg(F.max("stop").alias("stop"))
    ended = F.max("stop").over(at.rowsBetween(W.unboundedPreceding, -1))
    runs = place.withColumn("new", (ended.isNull() | (F.col("start") > ended)).cast("int")).withColumn("run", F.sum("new").over(at.rowsBetween(W.unboundedPreceding, 0)))
    merged = runs.groupBy(*C.KEY, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    by_doc = merged.groupBy(*C.KEY).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"), F.sum(F.col("stop") - F.col("start")).alias("n_hit"))
    # a document's items are bounded by the items
    by_item = spans.select(*C.KEY, "item_id").distinct().groupBy(*C.KEY).agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    out = base.join(by_doc, C.KEY, "left").join(by_item, C.KEY, "left")
    n, empty = F.coalesce("n_hit", F.lit(0).cast("long")), lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    return out.select("doc_id", "n_words", n.alias("n_hit"), F.coalesce("spans", empty("struct<start:bigint,stop:bigint>")).alias("spans"), F.coalesce("items", empty("string")).alias("items"), (n > 0).alias("contaminated"), "hash")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    d, b = C.table(spark, sf_dir, "documents", "doc_id", "text"), C.table(spark, sf_dir, "benchmark", "item_id", "text")
    out = contamination(d, b)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark of sf_dir.

    Each row is judged by its own text, also where a doc_id repeats; null and empty texts stay, as do rows without doc_id; an empty
    table gives none, and no benchmark takes nothing.
    """
    bad = contamination(docs.select("doc_id", "text"), C.table(spark, sf_dir, "benchmark", "item_id", "text")).where("contaminated")
    bad = bad.select(F.col("doc_id").alias("_doc"), F.col("hash").alias("_hash")).distinct()
    return docs.join(bad, (docs["doc_id"].cast("long") == bad["_doc"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["_hash"]), "left_anti").select(*docs.columns)


#: Windows of ten words found by their text; hit words by exploding the places of each window.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT CAST(item_id AS VARCHAR) item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') g FROM (SELECT item_id, w, least(10, len(w)) m, unnest(range(1, len(w) - least(10, len(w)) + 2)) i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') g FROM (SELECT doc_id, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) i FROM d, (SELECT DISTINCT m FROM iw))),
h AS (SELECT DISTINCT dw.doc_id, dw.i, dw.m, iw.item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.g = iw.g),
p AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) p FROM h) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""
