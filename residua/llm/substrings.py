"""Substring deduplication with a compressed FM-index per shard (Ferragina and Manzini, 2000).

A document's windows are its runs of ``window`` words. Winnowing gives every window an anchor, the
least k-gram hash in it, so equal windows have equal anchors; the windows of one anchor place make a
segment. Segments whose anchor stands in one place of the corpus have no repeated window and are done.
The distinct texts of the others go, by their anchor, to shards. Each shard is an FM-index over word
numbers, with a wavelet matrix for ranks: segments are streamed through it by backward search, and
matching statistics tell for each window how many places of the corpus hold it.

A segment of an anchor that stands in very many places is dealt out as its single windows, by their
own hashes, so that no shard grows with one anchor; equal texts are summed before they move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U = np.uint64
WINDOW, K = 35, 8


class Wavelet:
    """A wavelet matrix over numbers of ``bits`` bits, packed, with a count for each 64 places."""

    def __init__(self, x: np.ndarray, bits: int):
        self.bits = bits
        self.words, self.before, self.zeros = [], [], []
        for b in range(bits - 1, -1, -1):
            bit = ((x >> b) & 1).astype(bool)
            w = np.packbits(np.concatenate([bit, np.zeros(-len(x) % 64 + 64, bool)]), bitorder="little").view(U)
            self.words.append(w)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(w), dtype=np.int32)])[:-1].astype(np.int32))
            self.zeros.append(int(len(x) - bit.sum()))
            x = np.concatenate([x[~bit], x[bit]])

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where each place leads to by the bits of each value: differences for one value are its ranks."""
        at = at.copy()
        for level in range(self.bits):
            w, b = at >> 6, (at & 63).astype(U)
            ones = self.before[level][w] + np.bitwise_count(self.words[level][w] & ((U(1) << b) - U(1)))
            one = ((value >> (self.bits - 1 - level)) & 1) > 0
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return at


class Index:
    """FM-index of a sequence of word numbers; 0 ends each segment. Suffixes are in order to ``depth`` words."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        rank, have = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while have < depth:
            top = int(rank.max()) + 2
            step = 3 if top < 2_000_000 else 2
            key = rank
            for j in range(1, step):  # the ranks of the next words' runs, in one number
                more = np.zeros(n, np.int64)
                more[: max(n - j * have, 0)] = rank[j * have :] + 1
                key = key * top + more
            order = np.argsort(key, kind="stable")
            k = key[order]
            new = np.zeros(n, np.int64)
            new[1:] = k[1:] != k[:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            have *= step
        self.order = order
        sigma = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.wavelet = Wavelet(text[order - 1].astype(np.int64), max(1, (sigma - 1).bit_length()))
        self.base = self.wavelet.rank(np.arange(sigma), np.zeros(sigma, np.int64))

    def extend(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of each word before what its interval stands for."""
        f, z = self.first[word], self.base[word]
        return f + self.wavelet.rank(word, lo) - z, f + self.wavelet.rank(word, hi) - z

    def blocks(self, text: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """For each rank the interval of the suffixes that share its first m words: where a match is cut short to."""
        n = len(text)
        pad = np.concatenate([text, np.zeros(m, text.dtype)])
        a, b = self.order[1:], self.order[:-1]
        same = np.ones(n - 1, bool)
        for j in range(m):
            same &= pad[a + j] == pad[b + j]
        differ = np.concatenate([[True], ~same])
        start = np.flatnonzero(differ)
        which = np.cumsum(differ) - 1
        return start[which], np.concatenate([start[1:], [n]])[which]


def matching(words: list[np.ndarray], weight: np.ndarray, window: int) -> list[np.ndarray]:
    """For each segment (word hashes) and window: the weight of all places that hold the window, its own included."""
    size = np.array([len(w) for w in words])
    _, number = np.unique(np.concatenate(words), return_inverse=True)
    ends = np.cumsum(size + 1) - 1
    text = np.zeros(int(size.sum()) + len(words), np.int64)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = number + 1
    index = Index(text, window + 1)
    total = np.concatenate([[0], np.cumsum(weight[np.searchsorted(ends, index.order, "left")])])
    low, high = index.blocks(text, window - 1)
    start = ends - size
    out = np.zeros(len(text), np.int64)
    # all segments at once from their right ends; step j puts the word j from the end before the match
    lo, hi, live = np.zeros(len(words), np.int64), np.full(len(words), len(text), np.int64), np.arange(len(words))
    for j in range(int(size.max())):
        live = live[size[live] > j]
        if j >= window:  # the match has ``window`` words: its last one is dropped first
            hi[live], lo[live] = high[lo[live]], low[lo[live]]
        at = start[live] + size[live] - 1 - j
        lo[live], hi[live] = index.extend(text[at], lo[live], hi[live])
        if j >= window - 1:
            out[at] = total[hi[live]] - total[lo[live]]
    return [out[s : s + n - window + 1] for s, n in zip(start, size, strict=True)]


def _segments(x: C.Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word, number of windows and anchor hash of each segment of a batch."""
    g, left = C.grams(x.hash, k), x.left()
    at = C.sliding_argmin(g, window - k + 1)
    w = np.flatnonzero(left[: len(at)] >= window)
    if not len(w):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U)
    a = at[w]
    new = np.ones(len(w), bool)
    new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1] + 1)
    first = np.flatnonzero(new)
    start = w[first]
    return np.searchsorted(x.first, start, "right") - 1, start, np.diff(np.concatenate([first, [len(w)]])), g[a[first]]


def _text_hash(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def covered(docs: DataFrame, window: int = WINDOW, k: int = K, shard_words: int = 300_000, hot: int = 5_000) -> DataFrame:
    """doc_id, hash, start, stop: words in windows that also start anywhere else (the same document included), in spans that may overlap.

    ``hot``: an anchor that stands in more places than this is dealt out by windows.
    """
    spark, src = docs.sparkSession, C.keyed(docs)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            x = C.Words(b.column("text"), C.SPACED, False)
            row, start, n, h = _segments(x, window, k)
            yield pa.record_batch([*[b.column(c).take(pa.array(row)) for c in C.KEY], pa.array((start - x.first[row]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h.view(np.int64))], names=[*C.KEY, "start", "n", "anchor"])

    segs = C.keep(src.mapInArrow(anchors, "doc_id long, hash long, start int, n int, anchor long"), "segments")
    twice = C.keep(segs.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1"), "anchors")
    # an anchor of more than a thousandth of all segments, of which there are less than a thousand, isn't shuffled by
    often = F.col("c") * 1000 > segs.count()
    heavy, light = F.broadcast(twice.where(often)), twice.where(~often)
    met = segs.join(heavy, "anchor").unionByName(segs.join(heavy, "anchor", "left_anti").join(light, "anchor"))
    wanted = met.groupBy(*C.KEY).agg(F.collect_set(F.struct("start", "n", "anchor", (F.col("c") > hot).alias("hot"))).alias("segs"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, 1 << 20):
            x = C.Words(b.column("text"), C.SPACED, False)
            low = (x.hash & U(0xFFFFFFFF)).astype(np.uint32)  # beside equal anchors, half of each hash tells words apart
            out: dict[str, list] = {c: [] for c in (*C.KEY, "start", "anchor", "key", "body")}
            for r, (doc, own, segs) in enumerate(zip(*[b.column(c).to_pylist() for c in (*C.KEY, "segs")], strict=True)):
                f = int(x.first[r])
                for s in segs:
                    parts = [(s["start"] + i, 1) for i in range(s["n"])] if s["hot"] else [(s["start"], s["n"])]
                    for at, n in parts:
                        body = low[f + at : f + at + n + window - 1].tobytes()
                        key = _text_hash(body)
                        out["doc_id"].append(doc)
                        out["hash"].append(own)
                        out["start"].append(at)
                        out["anchor"].append(key if s["hot"] else s["anchor"])
                        out["key"].append(key)
                        out["body"].append(body)
            yield pa.record_batch([pa.array(out["doc_id"], pa.int64()), pa.array(out["hash"], pa.int64()), pa.array(out["start"], pa.int32()), pa.array(out["anchor"], pa.int64()), pa.array(out["key"], pa.int64()), pa.array(out["body"], pa.binary())], names=list(out))

    placed = C.keep(src.join(wanted, C.KEY).mapInArrow(texts, "doc_id long, hash long, start int, anchor long, key long, body binary"), "texts")
    C.release(segs, twice)
    del wanted, twice, met, heavy, light
    C.tidy(spark)
    distinct = placed.groupBy("anchor", "key").agg(F.count("*").alias("weight"), F.first("body").alias("body"))
    words = placed.agg(F.coalesce(F.sum(F.length("body")), F.lit(0))).first()[0] // 4
    shards = max(C.partitions(spark), words // shard_words + 1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes, int]] = []
        size, last = 0, None
        for b in batches:
            for row in zip(b.column("anchor").to_pylist(), b.column("key").to_pylist(), b.column("body").to_pylist(), b.column("weight").to_pylist(), strict=True):
                if size > shard_words * 4 and row[0] != last:  # an index ends between two anchors
                    yield _searched(held, window)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
                last = row[0]
        if held:
            yield _searched(held, window)

    found = distinct.repartition(int(shards), "anchor").sortWithinPartitions("anchor", "key").mapInArrow(search, "anchor long, key long, spans array<struct<a:int,b:int>>")
    return placed.select(*C.KEY, "start", "anchor", "key").join(found, ["anchor", "key"]).select(*C.KEY, "start", F.explode("spans").alias("s")).select(*C.KEY, (F.col("start") + F.col("s.a")).alias("start"), (F.col("start") + F.col("s.b")).alias("stop"))


def _searched(held: list[tuple[int, int, bytes, int]], window: int) -> pa.RecordBatch:
    """Segments with a repeated window, and the spans that such windows cover."""
    count = matching([np.frombuffer(x[2], np.uint32) for x in held], np.array([x[3] for x in held], np.int64), window)
    anchor, key, spans = [], [], []
    for x, n in zip(held, count, strict=True):
        at = np.flatnonzero(n > 1)
        if len(at):
            cut = np.flatnonzero(np.diff(at) > 1)
            first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
            anchor.append(x[0])
            key.append(x[1])
            spans.append([{"a": int(i), "b": int(j) + window} for i, j in zip(first, last, strict=True)])
    return pa.record_batch([pa.array(anchor, pa.int64()), pa.array(key, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["anchor", "key", "spans"])


def dedup(docs: DataFrame, window: int = WINDOW, k: int = K, shard_words: int = 300_000, hot: int = 5_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one blank).

    Words stand between ASCII white space, unchanged. Null and empty texts have none; texts shorter than a window lose none.
    Rows that repeat a doc_id are rows like others; such as repeat their text too count as places of their own. An empty table gives none.
    """
    spans = covered(docs, window, k, shard_words, hot)
    by_doc = spans.groupBy(*C.KEY, "start").agg(F.max("stop").alias("stop")).groupBy(*C.KEY).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            x = C.Words(b.column("text"), C.SPACED, False)
            raw = x.buf.tobytes()
            removed, kept = [], []
            for r, spans in enumerate(b.column("spans").to_pylist()):
                f, t = int(x.first[r]), int(x.first[r + 1])
                stay = np.ones(t - f, bool)
                for s in spans or ():
                    stay[s["start"] : s["stop"]] = False
                removed.append(int(t - f - stay.sum()))
                kept.append(b" ".join([raw[i:j] for i, j in zip(x.start[f:t][stay].tolist(), x.end[f:t][stay].tolist(), strict=True)]))
            yield pa.record_batch([b.column("doc_id"), pa.array(x.counts), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return C.keyed(docs).join(by_doc, C.KEY, "left").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    out = dedup(C.table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents WHERE doc_id IS NOT NULL),
x AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 34], ' ')) h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) i FROM d WHERE len(w) >= 35)),
r AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) p FROM x SEMI JOIN r USING (h)),
g AS (SELECT doc_id, list(p) g, count(*) n FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n, 0) AS BIGINT) n_removed,
  sha256(coalesce((SELECT string_agg(v, ' ' ORDER BY i) FROM (SELECT unnest(d.w) v, unnest(range(1, len(d.w) + 1)) i) WHERE NOT coalesce(list_contains(g.g, i), false)), '')) kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
