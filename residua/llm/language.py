"""Language identification with bit-sliced Bloom filters of byte n-grams.

One table of masks holds a Bloom filter of every language at once, one bit of each mask to a
language: the AND of the masks at an n-gram's places gives all languages that contain it. A
text's popcount for each language, corrected for the false positives that the filter's fill
makes likely, decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U = np.uint64
SIZES = (3, 4)
#: Bytes of text whose n-grams are held at once; each takes about a hundred bytes of a worker's memory.
SLICE = 1 << 17
_SEP = 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def _letters(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letter runs with one space around each, and each row's start."""
    raw, rows = C.utf8(col)
    n = len(raw)
    x = np.full(n + len(rows) - 1, _SEP, np.uint8)  # a space before each row
    at = np.arange(n) + np.repeat(np.arange(1, len(rows)), np.diff(rows))
    x[at] = C.LOWER[raw]
    x[~_LETTER[x]] = _SEP
    start = rows[:-1] + np.arange(len(rows) - 1)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != _SEP) | (x[:-1] != _SEP)
    keep[start] = True
    ptr = np.concatenate([[0], np.cumsum(keep)])
    return np.concatenate([x[keep], [_SEP]]).astype(np.uint8), np.concatenate([ptr[start], [ptr[-1]]])


def _ngrams(x: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams (the size in the top bits) and their rows; a row's last gram may end in the next row's first space."""
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    g = np.full(n, k, U)
    for j in range(k):
        g = (g << U(8)) | x[j : j + n].astype(U)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[:n]
    left = rows[row + 1] + 1 - np.arange(n)
    ok = left >= k
    for j in range(1, k - 1):  # within one word: no space inside
        ok &= x[j : j + n] != _SEP
    return g[ok], row[ok]


class Model:
    """langs, and one mask for each of 2^bits places, in as many rows of numbers as languages need bits."""

    def __init__(self, langs: list[str], masks: np.ndarray, bits: int, hashes: int, prior: int):
        self.langs, self.masks, self.bits, self.hashes, self.prior = langs, masks, bits, hashes, prior
        self.width = masks.dtype.itemsize * 8
        fill = np.array([np.count_nonzero(masks[i // self.width] & masks.dtype.type(1 << i % self.width)) for i in range(len(langs))]) / masks.shape[1]
        self.false = fill**hashes

    def places(self, g: np.ndarray) -> list[np.ndarray]:
        h = C.mix(g)
        return [((h >> U(j * 16)) + h * U(2 * j + 1) & U((1 << self.bits) - 1)).astype(np.int64) for j in range(self.hashes)]

    def contains(self, g: np.ndarray) -> list[np.ndarray]:
        """For each n-gram the mask of all languages whose filter has it, in rows as the masks are."""
        out = None
        for p in self.places(g):
            out = [row[p] for row in self.masks] if out is None else [m & row[p] for m, row in zip(out, self.masks)]
        return out

    def share(self, col: pa.Array) -> np.ndarray:
        """For each row and language the share of the row's n-grams that the language has, false positives taken off."""
        x, rows = _letters(col)
        n = len(rows) - 1
        total, hit = np.zeros(n), np.zeros((n, len(self.langs)))
        for k in SIZES:
            g, row = _ngrams(x, rows, k)
            m = self.contains(g)
            total += np.bincount(row, minlength=n)
            for i in range(len(self.langs)):
                bit = m[i // self.width] >> self.masks.dtype.type(i % self.width) & self.masks.dtype.type(1)
                hit[:, i] += np.bincount(row, weights=bit, minlength=n)
        t = total[:, None]
        return np.clip(np.where(t > 0, (hit - t * self.false) / np.maximum(t * (1 - self.false), 1e-9), 0), 0, 1)


def fit(rows: DataFrame, sample: int = 6000, bits: int = 18, hashes: int = 3, least_rate: float = 2e-6, against: float = 0.1) -> Model:
    """Learn from rows (doc_id, text, lang).

    ``sample`` bounds the rows learnt from: of each language about ``sample`` over their number, 300 at least, by hash of doc_id; a
    language of few rows is learnt from all of them. Any number of languages can be learnt, 64 to a row of masks.
    A language has an n-gram if at least ``least_rate`` of its n-grams, two at least, and ``against`` of the highest rate of any
    language are this one; the rest is noise, as are words borrowed in passing.
    """
    rows = rows.where("lang is not null and doc_id is not null")
    docs = {r[0]: r[1] for r in rows.groupBy(F.col("lang").cast("string")).count().collect()}  # a row for each language
    each = max(sample // max(len(docs), 1), 300)
    most = {v: int(min(1.0, each / n) * (1 << 20)) + 1 for v, n in docs.items()}
    mine = F.element_at(F.create_map(*[F.lit(x) for kv in most.items() for x in kv]), F.col("lang").cast("string")) if most else F.lit(0)
    picked = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < mine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, SLICE):
            x, ptr = _letters(b.column("text"))
            names = b.column("lang").to_pylist()
            of = {v: i for i, v in enumerate(sorted(set(names)))}
            code = np.array([of[v] for v in names])
            for k in SIZES:
                g, row = _ngrams(x, ptr, k)
                for v, i in of.items():
                    u, c = np.unique(g[code[row] == i], return_counts=True)
                    yield pa.record_batch([pa.array([v] * len(u)), pa.array(u.view(np.int64)), pa.array(c)], names=["lang", "gram", "n"])

    counted = C.keep(picked.select("text", F.col("lang").cast("string").alias("lang")).where("text is not null").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    total = {r[0]: r[1] for r in counted.groupBy("lang").agg(F.sum("n")).collect()}
    langs = sorted(docs)
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(langs) <= np.dtype(t).itemsize * 8 or t is np.uint64)
    width = np.dtype(kind).itemsize * 8
    masks = np.zeros((max(1, -(-len(langs) // width)), 1 << bits), kind)
    model = Model(langs, masks, bits, hashes, 0)
    if total:
        rate = F.col("n") / F.element_at(F.create_map(*[F.lit(x) for kv in total.items() for x in kv]), F.col("lang"))
        # a language has fewer than 1 / least_rate n-grams of that rate: what comes to the driver is bounded
        r = counted.withColumn("r", rate)
        top = r.groupBy("gram").agg(F.max("r").alias("top"))
        best = r.where(f"n >= 2 and r >= {least_rate}").join(top, "gram").where(f"r >= {against} * top").select("lang", "gram").toArrow()
        gram, lang = np.asarray(best.column("gram")).view(U), np.array(best.column("lang").to_pylist(), object)
        for i, v in enumerate(langs):
            for p in model.places(gram[lang == v]):
                masks[i // width][p] |= kind(1 << i % width)
    return Model(langs, masks, bits, hashes, max(range(len(langs)), key=lambda i: (docs[langs[i]], langs[i])) if langs else 0)


def predict(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """doc_id, the columns of ``more``, lang_pred, score.

    ``und`` with score 0: null or empty text, no letter, or no language learnt. A text with letters none of whose n-grams is
    known gets the most common language, with score 0. The score is the share of the best language, lessened by what a
    second language close to it leaves in doubt. Ties go to the first language by name.
    """
    big = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = big.value
        for b in C.slices(batches, SLICE):
            col = b.column("text")
            n = b.num_rows
            if m.langs:
                s = m.share(col)
                best = s.argmax(1)
                top = s[np.arange(n), best]
                s[np.arange(n), best] = 0
                second = s.max(1)
                score = np.where(top > 0, top * (1 - 0.5 * second / np.maximum(top, 1e-9)), 0)
                best = np.where(top > 0, best, m.prior)
                raw, rows = C.utf8(col)
                sure = (C.LOWER[raw] >= 97) & (C.LOWER[raw] <= 122)
                ptr = np.concatenate([[0], np.cumsum(sure)])
                plain = ptr[rows[1:]] > ptr[rows[:-1]]
                names = [m.langs[i] for i in best]
                for i in np.flatnonzero(~plain):
                    if not any(ch.isalpha() for ch in col[i].as_py()):
                        names[i], score[i] = "und", 0.0
            else:
                names, score = ["und"] * n, np.zeros(n)
            yield pa.record_batch([b.column("doc_id"), *[b.column(c) for c in more], pa.array(names), pa.array(score)], names=["doc_id", *more, "lang_pred", "score"])

    extra = "".join(f"`{c}` {kinds[c]}, " for c in more)
    return C.texts(docs, *[c for c in more if c != "text"]).mapInArrow(run, f"doc_id long, {extra}lang_pred string, score double")


def op2_language(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = C.crc_mod(F.col("doc_id"), 3) == 1
    model = fit(docs.where(~held))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (C.crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


#: Under this score a text is rejected: fewer than about a third of its n-grams belong to any learnt language.
REJECT = 0.3


def stage(spark, docs: DataFrame, sf_dir: str, reject: float = REJECT) -> DataFrame:
    """Keep documents in a learnt language: those without letters or with a score under ``reject`` go.

    Null and empty texts have no letters and go, as do rows without doc_id; rows that repeat are judged alike; other columns are
    handed on, whatever their names. An empty table gives none; without a labelled row there is no language, and all go.
    """
    kept = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("__row"))
    model = fit(docs.select("doc_id", "text", "lang"))
    out = predict(kept, model, "text", "__row").where((F.col("lang_pred") != "und") & (F.col("score") >= reject))
    return out.select(*[F.col("text") if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns])
