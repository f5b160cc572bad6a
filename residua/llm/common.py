"""Helpers shared by the corpus operators: kept tables, Arrow batches, vectorised words, components.

Conventions of all operators here: a row whose ``doc_id`` is null can't be addressed in a
result and is left out; a null text is an empty text; columns other than the ones an
operator names are ignored, so clashing names can't matter.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
_LOCAL: list[str] = []
_KEPT: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where the session names none, which must then run on one machine."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="kept-"))
    return _LOCAL[0]


def keep(df: DataFrame, name: str = "kept", compression: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _KEPT.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(*kept: DataFrame) -> None:
    """Delete kept tables that nothing reads any more, and let Spark free the shuffle files of what made them."""
    for df in kept:
        _delete(df.sparkSession, df._kept)
    for df in kept[:1]:
        tidy(df.sparkSession)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffles of plans that are gone, whose files it then deletes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _forget() -> None:
    for spark, path in _KEPT:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended
            return


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the columns named, null texts empty, rows without doc_id left out."""
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


#: What a row is known by: its doc_id, and a hash of its text for rows that share a doc_id.
KEY = ["doc_id", "hash"]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, hash of each row that has a doc_id."""
    return texts(docs).withColumn("hash", F.xxhash64("text"))


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def give_back() -> None:
    """Return what this Python worker has freed to the system: at the end of a task it lives on beside a JVM that has grown."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the column ``text`` has at most ``most`` bytes (or one row); memory is given back after the last one."""
    for b in batches:
        if not b.num_rows:
            continue
        off = np.frombuffer(b.column("text").buffers()[1], dtype=np.int32)[b.column("text").offset :][: b.num_rows + 1]
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            to = min(to, b.num_rows)
            yield b.slice(at, to - at)
            at = to
    give_back()


def short(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most, for what makes Python objects of whole columns; memory is given back after the last one."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    give_back()


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array without nulls, and each row's start in them (one more for the end)."""
    off = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset :][: len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def _table(outside: str) -> np.ndarray:
    t = np.ones(256, bool)
    t[[ord(c) for c in outside]] = False
    return t


#: Words are runs of bytes that aren't ASCII white space.
SPACED = _table("\x20\x09\x0a\x0b\x0c\x0d")
#: Words are runs of ASCII digits and lower-case letters and of all that is beyond ASCII.
PLAIN = _table("".join(chr(i) for i in range(128) if not (48 <= i <= 57 or 97 <= i <= 122)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(20240601)
_R = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_P = U(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, U)]


def powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.cumprod(np.concatenate([np.ones(1, U), np.full(max(n, 1 << 12), _P, U)]))
    return _POWERS[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """Words of a batch of texts: start and end byte, 64-bit hash, and each row's first word (one more for the end)."""

    def __init__(self, col: pa.Array, inside: np.ndarray, lower: bool):
        raw, self.rows = utf8(col)
        self.buf = LOWER[raw] if lower else raw
        n = len(self.buf)
        w = inside[self.buf]
        cut = np.zeros(n + 1, bool)
        cut[self.rows] = True
        prev = np.zeros(n, bool)
        prev[1:] = w[:-1]
        self.start = np.flatnonzero(w & (~prev | cut[:-1]))
        nxt = np.zeros(n, bool)
        nxt[:-1] = w[1:]
        self.end = np.flatnonzero(w & (~nxt | cut[1:])) + 1
        self.first = np.searchsorted(self.start, self.rows)
        size = self.end - self.start
        at = np.cumsum(size) - size
        if len(size):
            pos = np.arange(size.sum()) - np.repeat(at, size)
            v = _R[self.buf[w]]
            v *= powers(int(size.max()) + 1)[pos]
            self.hash = mix(np.add.reduceat(v, at) + size.astype(U) * U(0xD6E8FEB86659FD93))
        else:
            self.hash = np.zeros(0, U)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def left(self) -> np.ndarray:
        """For each word, the words of its row from it on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k items of h; runs over row ends are the caller's to leave out. Has len(h) items."""
    out = np.zeros(len(h), U)
    for j in range(k):
        part = h[j:] if j else h
        out[: len(part)] = out[: len(part)] * U(0xFF51AFD7ED558CCD) + part
    return mix(out ^ U(k))


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Leftmost place of the least of each w consecutive items."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, val, have = np.arange(len(x)), x, 1
    while have < w:
        step = min(have, w - have)
        m = len(at) - step
        right = val[step:] < val[:m]
        at, val = np.where(right, at[step:], at[:m]), np.where(right, val[step:], val[:m])
        have += step
    return at[:n]


def lists(values: np.ndarray, ptr: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of one list for each row, from row starts."""
    return pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(values, type=kind))


def components(edges: DataFrame, most: int = 200) -> DataFrame:
    """Connected components of edges(a, b): node, component (the least node reachable).

    Alternating large-star and small-star steps (Kiveris et al., 2014): each is one
    shuffled minimum by node, linear in the edges. To survive hubs, minima are
    aggregated before the shuffle and joined back, never windowed.
    An empty input gives an empty result; loops and repeated edges change nothing. Rounds grow with the logarithm of the
    nodes; should ``most`` not do, that is an error, never a part of the result.
    """
    e = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most):
        if e.isEmpty():
            break
        # large-star: each node's larger neighbours point to its least neighbour
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: each node and its smaller neighbours point to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        j = large.join(low, "a")
        small = j.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        new = keep(small, "edges")
        done = new.groupBy().agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        old = e.groupBy().agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        release(e)
        e = new
        if tuple(done) == tuple(old):
            break
    else:
        raise RuntimeError(f"components are not found in {most} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
