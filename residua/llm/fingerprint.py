"""Improbable-feature digests (after Roussev's similarity digests, 2010).

Every window of ``WINDOW`` bytes gets the Shannon entropy of its bytes, in ``LEVELS``
steps. A window is the more improbable the rarer its entropy level is among all windows of
the corpus. Within each run of ``RUN`` consecutive windows the most improbable one scores;
windows that score at least ``POPULAR`` times are the features. Features go into a chain of
Bloom filters in order of place, ``PER_FILTER`` to a filter, and two digests are compared by
the bits that their filters share, normalised by what chance alone gives.

A digest has two such chains, of a coarse and a fine scale. Long texts have only the coarse and
short texts only the fine one; between them texts have both, so that texts of about one size have
a scale in common wherever that size lies. Digests are compared by the scales that both have.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U = np.uint64
WINDOW, RUN, POPULAR, LEVELS = 64, 64, 16, 1000
FILTER_BYTES, PER_FILTER, HASHES = 256, 160, 5
#: Window, run and popularity of the fine scale.
FINE = (16, 8, 1)
#: Texts of this many bytes have the coarse scale, texts under that many the fine one.
COARSE_FROM, FINE_BELOW = 256, 1024
#: Levels below this (long runs of few byte values) are never features.
LEAST_LEVEL = 100

_C = np.arange(WINDOW + 2, dtype=np.float64)
_F = np.where(_C > 0, _C * np.log2(np.maximum(_C, 1)), 0)
#: What one more occurrence adds to the sum of c * log2(c), in integer steps so that sums are exact.
_STEP = np.concatenate([[0], np.rint(np.diff(_F) * (1 << 20)).astype(np.int64)])


def levels(buf: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The entropy level of the window that starts at each byte; len(buf) - window + 1 of them.

    The sum of c * log2(c) of a window changes by what the byte that enters and the byte that
    leaves occur within reach, so all windows come from counts of equal bytes at each distance.
    """
    n = len(buf)
    if n < window:
        return np.zeros(0, np.int16)
    before = np.ones(n, np.uint8)  # occurrences in the window + 1 bytes up to each byte
    after = np.ones(n, np.uint8)  # and from each byte on
    for d in range(1, min(window + 1, n)):
        same = (buf[d:] == buf[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    first = np.bincount(buf[:window], minlength=256)
    total = np.empty(n - window + 1, np.int64)
    total[0] = np.cumsum(_STEP)[first].sum()
    if n > window:
        total[1:] = total[0] + np.cumsum(_STEP[before[window:]] - _STEP[after[: n - window]])
    h = np.log2(window) - total / float(1 << 20) / window
    return np.clip(np.rint(h * ((LEVELS - 1) / np.log2(window))), 0, LEVELS - 1).astype(np.int16)


def histogram(docs: DataFrame) -> np.ndarray:
    """How many windows have each level, of all texts on the coarse scale and of those that have the fine one on that: two rows of LEVELS sums, whatever the size of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, LEVELS), np.int64)
        for b in C.slices(batches, 1 << 20):
            buf, rows = C.utf8(b.column("text"))
            for scale, (part, ptr, window) in enumerate(((buf, rows, WINDOW), (*_of(buf, rows, _fine(rows)), FINE[0]))):
                lv = levels(part, window)
                if len(lv):
                    sums[scale] += np.bincount(lv[_inside(ptr, len(lv), window)], minlength=LEVELS)
        scale, level = np.nonzero(sums)
        yield pa.record_batch([pa.array(scale.astype(np.int32)), pa.array(level.astype(np.int32)), pa.array(sums[scale, level])], names=["scale", "level", "n"])

    out = np.zeros((2, LEVELS), np.int64)
    for scale, level, n in C.texts(docs).select("text").mapInArrow(run, "scale int, level int, n long").groupBy("scale", "level").agg(F.sum("n")).collect():
        out[scale, level] = n
    return out


def _fine(rows: np.ndarray) -> np.ndarray:
    """The rows that have the fine scale."""
    size = np.diff(rows)
    return np.flatnonzero((size > 0) & (size < FINE_BELOW))


def _of(buf: np.ndarray, rows: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row starts of some rows alone."""
    size = np.diff(rows)[some]
    ptr = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return buf[np.arange(ptr[-1]) + np.repeat(rows[some] - ptr[:-1], size)], ptr


def _inside(rows: np.ndarray, n: int, span: int = WINDOW) -> np.ndarray:
    """Whether the span from each place lies in one row."""
    ok = np.ones(max(n, 0), bool)
    for end in rows[1:-1] if len(rows) < 64 else ():
        ok[max(0, end - span + 1) : end] = False
    if len(rows) >= 64:
        mark = np.zeros(n + 1, np.int32)
        lo, hi = np.clip(rows[1:-1] - span + 1, 0, n), np.clip(rows[1:-1], 0, n)
        np.add.at(mark, lo, 1)
        np.add.at(mark, hi, -1)
        ok &= np.cumsum(mark[:-1]) == 0
    return ok


def rarity(hist: np.ndarray) -> np.ndarray:
    """Rank of each level, rarest first, for each scale of a histogram; levels under LEAST_LEVEL and unseen ones rank last."""
    if hist.ndim > 1:
        return np.stack([rarity(h) for h in hist])
    h = hist.astype(np.float64)
    h[:LEAST_LEVEL] = np.inf
    order = np.argsort(h, kind="stable")
    rank = np.empty(LEVELS, np.int16)
    rank[order] = np.arange(LEVELS)
    return rank


def _scale(buf: np.ndarray, rows: np.ndarray, rank: np.ndarray, window: int, run: int, popular: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the features of one scale, in order of place; a row with windows has one feature at least."""
    n = len(rows) - 1
    lv = levels(buf, window)
    key = rank[lv].astype(np.int32)
    m = len(lv) - run + 1
    at = np.zeros(0, np.int64)
    if m > 0:
        least = C.sliding_argmin(key, run)
        scores = np.bincount(least[_inside(rows, m, window + run - 1)], minlength=len(lv))
        at = np.flatnonzero(scores >= popular)
    have = np.bincount(np.searchsorted(rows, at, "right") - 1, minlength=n)[:n]
    more = [rows[r] + int(np.argmin(key[rows[r] : rows[r + 1] - window + 1])) for r in np.flatnonzero((have == 0) & (np.diff(rows) >= window))]
    at = np.sort(np.concatenate([at, np.array(more, np.int64)])).astype(np.int64)
    h = np.full(len(at), window, U)
    pw = C.powers(window)
    for j in range(window):
        h += C._R[buf[at + j]] * pw[j]
    return np.searchsorted(rows, at, "right") - 1, C.mix(h)


def features(buf: np.ndarray, rows: np.ndarray, rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the fine and the coarse scale: hashes of the features of each row in order of place, and the first of each row.

    ``rank`` has a row for the coarse scale and one for the fine one, or one for both. A row shorter than the finer window has
    itself as its one feature; an empty row has none.
    """
    size = np.diff(rows)
    rank, own = rank if rank.ndim > 1 else (rank, rank)
    row, h = _scale(buf, rows, rank, WINDOW, RUN, POPULAR)
    long = size[row] >= COARSE_FROM
    coarse = row[long], h[long]
    some = _fine(rows)
    row, h = np.zeros(0, np.int64), np.zeros(0, U)
    if len(some):
        r2, h2 = _scale(*_of(buf, rows, some), own, *FINE)
        tiny = some[size[some] < FINE[0]]
        h3 = np.array([int.from_bytes(hashlib.blake2b(buf[rows[r] : rows[r + 1]].tobytes(), digest_size=8).digest(), "little") for r in tiny], U)
        row, h = np.concatenate([some[r2], tiny]), np.concatenate([h2, h3])
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
    return [(h, np.searchsorted(row, np.arange(len(size) + 1))) for row, h in ((row, h), coarse)]


def filters(h: np.ndarray) -> np.ndarray:
    """The chain of Bloom filters of one row's features: rows of FILTER_BYTES."""
    k = -(-len(h) // PER_FILTER)
    out = np.zeros((k, FILTER_BYTES * 8), bool)
    which = np.arange(len(h)) // PER_FILTER
    for j in range(HASHES):
        out[which, ((h >> U(11 * j)) & U(FILTER_BYTES * 8 - 1)).astype(np.int64)] = True
    return np.packbits(out, axis=1)


def chain_likeness(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Likeness of two chains that aren't empty, 0 to 1, and its weight: bits of the shorter chain.

    Each filter of the shorter chain against its best partner, averaged. A pair scores (shared - chance) / (most - chance),
    shared bits between what independent filters of their fill have in common and the fill of the smaller.
    """
    if len(a) > len(b) or (len(a) == len(b) and np.bitwise_count(a).sum() > np.bitwise_count(b).sum()):
        a, b = b, a
    x, y = a.view(U), b.view(U)
    na, nb = np.bitwise_count(x).sum(1).astype(float), np.bitwise_count(y).sum(1).astype(float)
    best = np.zeros(len(a))
    for i in range(len(a)):
        shared = np.bitwise_count(y & x[i]).sum(1)
        chance = na[i] * nb / (FILTER_BYTES * 8)
        most = np.minimum(na[i], nb)
        best[i] = np.clip(((shared - chance) / np.maximum(most - chance, 1e-9)).max(), 0, 1)
    return float((best * na).sum() / na.sum()), float(na.sum())


Digest = list[np.ndarray]


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1: over the scales that both digests have, weighted by their bits.

    Two empty digests are alike (1); digests without a common scale are not (0): one text is empty, or four times the other.
    """
    if not any(map(len, a)) and not any(map(len, b)):
        return 1.0
    both = [chain_likeness(x, y) for x, y in zip(a, b, strict=True) if len(x) and len(y)]
    return min(1.0, sum(v * w for v, w in both) / sum(w for _, w in both)) if both else 0.0


def text_of(digest: Digest) -> str:
    """Base64 of the fine and the coarse chain with a colon between; empty for an empty digest."""
    return ":".join(base64.b64encode(c.tobytes()).decode() for c in digest) if any(map(len, digest)) else ""


def digests(buf: np.ndarray, rows: np.ndarray, rank: np.ndarray) -> list[Digest]:
    """The digest of each row."""
    scales = features(buf, rows, rank)
    return [[filters(h[first[i] : first[i + 1]]) for h, first in scales] for i in range(len(rows) - 1)]


def of_texts(rows: list[bytes], rank: np.ndarray) -> list[Digest]:
    """The digest of each text, computed together."""
    ptr = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
    return digests(np.frombuffer(b"".join(rows), np.uint8), ptr, rank)


def fingerprints(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """doc_id, fingerprint: base64 of the filter chains. Equal texts have equal fingerprints under one ``rank``.

    ``rank`` (rarity()) is fitted on all texts of docs by default; give the stored one to compare across corpora.
    Null and empty texts have an empty fingerprint; repeated rows are kept, one result each; an empty table gives none.
    """
    rank = rarity(histogram(docs)) if rank is None else rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, 1 << 20):
            buf, rows = C.utf8(b.column("text"))
            yield pa.record_batch([b.column("doc_id"), pa.array([text_of(x) for x in digests(buf, rows, rank)], pa.string())], names=["doc_id", "fingerprint"])

    return C.texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


def in_ranges(docs: DataFrame, n: int) -> tuple[DataFrame, list[int]]:
    """docs with ``bucket``: n ranges of doc_id of about equal row counts, rising with doc_id, and the bounds between them."""
    bounds = sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    bounds = [int(b) for b in bounds]
    # a look-up of at most n bounds
    return docs.withColumn("bucket", F.expr(f"cast(array_size(filter(array({', '.join(f'{b}L' for b in bounds)}), b -> b < doc_id)) as int)") if bounds else F.lit(0)), bounds


def edited(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """Each text against an edited text and against the next document's text.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next document
    by descending doc_id (after the last: the first). Rows that share a doc_id are ordered by text.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Texts move once, to their range of doc_id, where neighbours stand together; the first row of each range also
    goes to the range before it in that order.
    """
    spark = docs.sparkSession
    rank = rarity(histogram(docs)) if rank is None else rank
    src, bounds = in_ranges(C.texts(docs), C.partitions(spark))
    tops = src.groupBy("bucket").agg(F.max(F.struct("doc_id", "text")).alias("m")).select("bucket", "m.*")
    tops = C.keep(tops, "tops")  # one row for each range
    order = sorted((r[0] for r in tops.select("bucket").collect()), reverse=True)
    goes = {b: order[i - 1] for i, b in enumerate(order)}  # the first row of b follows the last of the bucket before b
    extra = tops.select("doc_id", "text", F.element_at(F.create_map(*[F.lit(x) for kv in goes.items() for x in kv]), F.col("bucket")).alias("bucket"), F.lit(1).alias("extra")) if goes else tops.select("doc_id", "text", "bucket", F.lit(1).alias("extra"))
    rows = src.select("doc_id", "text", "bucket", F.lit(0).alias("extra")).unionByName(extra)
    dealt = rows.repartitionById(max(1, len(bounds) + 1), F.col("bucket")).sortWithinPartitions("extra", F.desc("doc_id"), F.desc("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str, int]] = []
        size = 0
        for b in batches:
            for row in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("extra").to_pylist(), strict=True):
                held.append(row)
                size += len(row[1])
                if size > 1 << 19:
                    yield _compare(held, rank)
                    held, size = [row], len(row[1])
        if len(held) > 1:
            yield _compare(held, rank)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _compare(held: list[tuple[int, str, int]], rank: np.ndarray) -> pa.RecordBatch:
    """Each row but the last against the one after it."""
    own = [t for _, t, _ in held]
    new = [t[: len(t) - len(t) // 2] + o[: len(t) // 2] for t, o in zip(own, own[1:], strict=False)]
    raw = [t.encode() for t in [*own, *new]]
    chain = of_texts(raw, rank)
    n = len(new)
    return pa.record_batch(
        [
            pa.array([x[0] for x in held[:n]], pa.int64()),
            pa.array([len(t) for t in own[:n]], pa.int64()),
            pa.array([hashlib.sha256(raw[len(own) + i]).hexdigest() for i in range(n)]),
            pa.array([text_of(c) for c in chain[:n]]),
            pa.array([text_of(c) for c in chain[len(own) :]]),
            pa.array([likeness(chain[i], chain[len(own) + i]) for i in range(n)]),
            pa.array([likeness(chain[i], chain[i + 1]) for i in range(n)]),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited(C.table(spark, sf_dir, "documents", "doc_id", "text"))
