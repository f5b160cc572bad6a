"""Exact n-gram Jaccard join with set-relation skipping (after Wang, Qin, Lin, Zhang and Chang, 2017).

A document's set is its distinct 5-word shingles. Equal sets are one class. Classes are joined
by prefix filter: shingles are ordered by how common they are (common ones last) and then by
hash; two sets of the required similarity share one of their first ``n - ceil(t * n) + 1``.

Skipping on the answers: links are transitive for components, so the sets of a list are first
compared with a few leaders of the list; a set linked to a leader has the leader's answers, and
only pairs between different components are left to compare. Skipping on the index: sets that
still stand beside one of another component are listed anew by all of their shingles, rarest
first. Shingles of one set alone take up places but need no list, so a set with many of its own
leaves the index. Lists are cut into blocks by size and position; a pair of blocks is skipped
whole if one component holds both, or if sizes and positions leave no link possible.
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
SHINGLE = 5
#: Least bits of the parity sketch of a set; a larger set has a power of two of at least twice its size.
SKETCH = 512
#: Bits of the wide sketch that larger sets are held to once more: of over about 800 different shingles, half of the bits of a
#: small one differ and tell nothing.
WIDE = 2048


class Sets:
    """The distinct shingle hashes of each row of a batch, ordered within the row."""

    def __init__(self, col: pa.Array, k: int, last: np.ndarray | None = None):
        w = C.Words(col, C.SPACED, True)
        n = w.counts
        g, left = C.grams(w.hash, k), w.left()
        at = np.flatnonzero(left >= k)
        row = np.searchsorted(w.first, at, "right") - 1
        h = g[at]
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            one = np.array([C.grams(w.hash[w.first[r] : w.first[r + 1]], int(n[r]))[0] for r in short], U)
            row, h = np.concatenate([row, short]), np.concatenate([h, one])
        h &= U((1 << 63) - 1)
        # common shingles come last: their top bit is set
        if last is not None and len(last):
            i = np.minimum(np.searchsorted(last, h), len(last) - 1)
            h |= (last[i] == h).astype(U) << U(63)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        self.row, self.hash = row[new], h[new]
        self.first = np.searchsorted(self.row, np.arange(len(col) + 1))
        self.size = np.diff(self.first)

    def signatures(self) -> np.ndarray:
        """Two 64-bit sums of each set: equal for equal sets."""
        low = self.hash & U((1 << 63) - 1)
        out = np.zeros((len(self.size), 2), U)
        full = self.size > 0
        if full.any():
            for j, x in enumerate((C.mix(low), C.mix(low ^ U(0x5851F42D4C957F2D)))):
                out[full, j] = np.add.reduceat(x, self.first[:-1][full])
        return out

    def sketches(self) -> list[bytes]:
        """Parity of the shingles in each place: sets that differ in d shingles differ in at most d bits, folded to one size or not."""
        bits = np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(self.size, 1) * 2)).astype(np.int64))
        ptr = np.concatenate([[0], np.cumsum(bits)])
        at = (C.mix(self.hash & U((1 << 63) - 1)) >> U(17)).astype(np.int64) & (bits[self.row] - 1)
        flat = (np.bincount(ptr[self.row] + at, minlength=int(ptr[-1])) & 1).astype(bool)
        raw = np.packbits(flat).tobytes()
        return [raw[i:j] for i, j in zip((ptr[:-1] // 8).tolist(), (ptr[1:] // 8).tolist(), strict=True)]


def small_sketch(sketch: bytes) -> np.ndarray:
    """A sketch folded to SKETCH bits, as longs."""
    x = np.frombuffer(sketch, np.int64)
    while len(x) > SKETCH // 64:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def wide_sketches(rows: DataFrame) -> DataFrame:
    """x, wide of rows(x, sketch): the sketch folded to WIDE bits, as longs; null for sets whose sketch has fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.short(batches):
            wide = []
            for sketch in b.column("sketch").to_pylist():
                x = np.frombuffer(sketch, np.int64)
                wide.append(x.reshape(-1, WIDE // 64) if len(x) >= WIDE // 64 else None)
            folded = [None if x is None else np.bitwise_xor.reduce(x, axis=0) for x in wide]
            yield pa.record_batch([b.column("x"), pa.array(folded, pa.list_(pa.int64()))], names=["x", "wide"])

    return rows.select("x", "sketch").mapInArrow(run, "x long, wide array<long>")


def differing(one: bytes, two: bytes) -> int:
    """Bits in which two sketches differ; the larger is folded to the size of the smaller."""
    x, y = np.frombuffer(one, U), np.frombuffer(two, U)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    need = -(-n * percent // 100)
    return np.where(n > 0, n - need + 1, 0)


def common_shingles(docs: DataFrame, k: int, most: int = 1 << 17) -> np.ndarray:
    """Hashes that occur in many documents, most common first cut at ``most``; only the order of shingles depends on it.

    Every batch of every task counts its documents' shingles and passes on those in two or more of them, so what is shuffled
    is what repeats; sums are over all data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            h = np.sort(Sets(b.column("text"), k).hash)
            if not len(h):
                continue
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.diff(np.concatenate([first, [len(h)]]))
            yield pa.record_batch([pa.array(h[first][n > 1].view(np.int64)), pa.array(n[n > 1])], names=["hash", "n"])

    top = docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where("n >= 8").orderBy(F.desc("n"), "hash").limit(most).select("hash").toArrow()
    return np.sort(np.asarray(top.column("hash")).view(U)) if top.num_rows else np.zeros(0, U)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def links_components(docs: DataFrame, percent: int = 75, k: int = SHINGLE, rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id reachable by links, itself included.

    Two documents link when 100 * shared shingles >= percent * shingles of both together. Texts are lower-cased (A-Z), words
    stand between ASCII white space, a text of fewer words is one shingle. Null and empty texts have no shingles and no
    links. Rows that repeat a doc_id are one node; where their texts differ, links beyond equal sets follow one of the texts. An
    empty table gives none.
    """
    spark = docs.sparkSession
    src = C.texts(docs)
    hot = spark.sparkContext.broadcast(common_shingles(src, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            s = Sets(b.column("text"), k, hot.value)
            sig = s.signatures()
            p = prefix_size(s.size, percent)
            idx = np.arange(int(p.sum())) + np.repeat(s.first[:-1] - np.cumsum(p) + p, p)
            sk = s.sketches()
            small = C.lists(np.concatenate([small_sketch(x) for x in sk]), np.arange(len(sk) + 1) * (SKETCH // 64), pa.int64())
            yield pa.record_batch(
                [b.column("doc_id"), pa.array(s.size.astype(np.int64)), _signed(sig[:, 0].copy()), _signed(sig[:, 1].copy()), pa.array(sk, pa.binary()), small, C.lists(s.hash[idx].view(np.int64), np.concatenate([[0], np.cumsum(p)]), pa.int64())],
                names=["doc_id", "n", "s1", "s2", "sketch", "small", "prefix"],
            )

    made = C.keep(src.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, sketch binary, small array<long>, prefix array<long>"), "sets")
    ids = C.keep(made.select("doc_id", "n", "s1", "s2"), "ids")
    classes = C.keep(ids.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")), "classes")

    # index lists: sets by shingle, with position; lists of one set are skipped. A list has each set once, so it is a small
    # share of the entries even if it holds every set
    rep = made.join(classes.select(F.col("rep").alias("doc_id"), "s1", "s2"), ["doc_id", "s1", "s2"], "left_semi")
    entries = rep.select(F.col("doc_id").alias("x"), "n", F.posexplode("prefix").alias("pos", "token"))
    lists = C.keep(entries.withColumn("members", F.count("*").over(W.partitionBy("token"))).where("members > 1").drop("members").distinct().withColumn("listed", F.count("*").over(W.partitionBy("x"))), "lists")
    whole = C.keep(lists.select("x").distinct().join(rep.select(F.col("doc_id").alias("x"), "n", "s1", "s2", "sketch", "small"), "x").dropDuplicates(["x"]), "sketches")
    C.release(made)
    sketches = whole.select("x", "n", "sketch")
    edges = None
    label = None
    for r in range(rounds):
        cur = lists if label is None else _labelled(lists, label)
        if label is not None:
            open_ = cur.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
            cur = cur.join(open_, "token")
        # each list's leader: the same one in most lists of a group of similar sets
        order = F.struct(F.xxhash64("x", F.lit(r)).alias("o"), F.col("x").alias("y"), F.col("n").alias("m"), F.col("pos").alias("q"), F.col("listed").alias("held"), *([F.col("c").alias("d")] if label is not None else []))
        lead = cur.groupBy("token").agg(F.min(order).alias("l")).select("token", "l.y", "l.m", "l.q", "l.held", *(["l.d"] if label is not None else []))
        pairs = cur.join(lead, "token").where("x <> y").where(_possible(percent))
        if label is not None:
            pairs = pairs.where("c <> d")
        pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        new = _verified(_sketched(pairs, sketches, percent), src, percent, k)
        edges = new if edges is None else edges.unionByName(new)
        label = C.keep(C.components(edges.select(F.col("x").alias("a"), F.col("y").alias("b"))), "labels")
    # what is left: sets that a list has beside one of another component
    own = C.keep(_open(_labelled(lists, label), whole.select("x", "small"), sketches, percent).join(whole.select("x", "n", "s1", "s2"), "x"), "open")
    C.release(lists)
    ranked = _ranked(own, whole.select("x", "small"), src, percent, k)
    # other leaders, of the lists of these sets
    for r in range(rounds):
        new = _verified(_sketched(_led(ranked, percent, rounds + r).distinct(), sketches, percent), src, percent, k)
        edges = edges.unionByName(new)
        label = C.keep(C.components(edges.select(F.col("x").alias("a"), F.col("y").alias("b"))), "labels")
        again = C.keep(_labelled(ranked.drop("c"), label), "ranked")
        C.release(ranked)
        ranked = again
    new = _verified(_sketched(_block_pairs(ranked, percent).distinct(), sketches, percent), src, percent, k)
    C.release(ranked)
    edges = edges.unionByName(new)
    # classes to documents: rows of one doc_id and one class are joined through the class
    node = edges.select(F.col("x").alias("a"), F.col("y").alias("b"))
    many = ids.where("n > 0").join(classes, ["s1", "s2", "n"])
    twice = many.where("doc_id <> rep").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1")
    again = many.join(twice, "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    comp = C.keep(C.components(node.unionByName(again)), "components")
    out = many.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", "n", F.coalesce("component", "rep").alias("component_id"))
    return out.unionByName(ids.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _labelled(lists: DataFrame, label: DataFrame) -> DataFrame:
    return lists.join(label.select(F.col("node").alias("x"), F.col("component").alias("c")), "x", "left").withColumn("c", F.coalesce("c", "x"))


def _need(a, b, percent: int):
    """Shingles that two sets of these sizes share at least if they are similar."""
    return F.ceil((a + b) * percent / (100 + percent))


def _most(n, m, listed, held, percent: int):
    """Shingles that two sets share at most: of the shorter prefix by the order of shingles those that both have in lists, and all behind it."""
    return F.least(listed, held) + F.ceil(F.greatest(n, m) * percent / 100) - 1


def _possible(percent: int):
    """Sizes, positions and listed shingles leave the required overlap possible: from a shared shingle at pos and q on, at most the rest is shared, and less before."""
    need = _need(F.col("n"), F.col("m"), percent)
    near = F.least("pos", "q") + F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("q")) >= need
    return (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & near & (_most(F.col("n"), F.col("m"), F.col("listed"), F.col("held"), percent) >= need)


def _numbered(df: DataFrame, key: str, i: int) -> DataFrame:
    return df.select(key, *[F.col(c).alias(f"{c}{i}") for c in df.columns if c != key])


def _near(percent: int, name: str = "small", bits: int = SKETCH):
    """The small sketches, or those named, differ in no more bits than similar sets can."""
    d = sum((F.bit_count(F.col(f"{name}1")[i].bitwiseXOR(F.col(f"{name}2")[i])) for i in range(bits // 64)), F.lit(0))
    return d <= F.col("n1") + F.col("n2") - 2 * _need(F.col("n1"), F.col("n2"), percent)


def _open(cur: DataFrame, small: DataFrame, sketches: DataFrame, percent: int, parts: int = 8) -> DataFrame:
    """x, c: the sets that a list of cur has beside one of another component that they may be similar to.

    Of the shingles that two sets share, only the first one counts: all others stand behind it in both, so what is left of
    each set from there on must be as much as they need. Blocks of a list by size and position are held against each other
    first, then the sets of the blocks that are left, of which each only asks whether there is another one; the sets that are
    found ask again with wide sketches, as small ones tell nothing of large sets. Neither loses a link.
    """
    wide = float(np.log(100 / percent)) / parts
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    cut = cur.select("token", "x", "c", "n", "listed", (F.col("n") - F.col("pos")).alias("rest"), F.floor(F.log(F.col("n").cast("double")) / wide).alias("size"), F.floor(F.col("pos") * parts / prefix).alias("part"))
    blocks = cut.groupBy("token", "size", "part").agg(F.min("n").alias("n"), F.max("n").alias("top"), F.max("listed").alias("listed"), F.max("rest").alias("rest"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    near = F.col("size2").between(F.col("size1"), F.col("size1") + parts)
    need = _need(F.col("n1"), F.col("n2"), percent)
    able = (_most(F.col("top1"), F.col("top2"), F.col("listed1"), F.col("listed2"), percent) >= need) & (F.least("rest1", "rest2") >= need)
    met = _numbered(blocks, "token", 1).join(_numbered(blocks, "token", 2), "token").where(near & able & ~((F.col("lo1") == F.col("hi2")) & (F.col("hi1") == F.col("lo2"))))
    some = met.select("token", F.explode(F.array(F.struct(F.col("size1").alias("size"), F.col("part1").alias("part")), F.struct(F.col("size2").alias("size"), F.col("part2").alias("part")))).alias("b")).select("token", "b.size", "b.part").distinct()
    rows = C.keep(cut.join(some, ["token", "size", "part"], "left_semi").drop("size", "part").join(small, "x"), "blocks")
    able = (_most(F.col("n1"), F.col("n2"), F.col("listed1"), F.col("listed2"), percent) >= need) & (F.least("rest1", "rest2") >= need)
    able &= (F.col("c1") != F.col("c2")) & (F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent)

    def met_by_another(rows: DataFrame, near) -> DataFrame:
        one, two = _numbered(rows, "token", 1), _numbered(rows, "token", 2).withColumnRenamed("token", "list")
        met = one.join(two, (F.col("token") == F.col("list")) & able & near, "left_semi")
        return C.keep(met.select(F.col("x1").alias("x"), F.col("c1").alias("c")).distinct(), "found")

    found = met_by_another(rows, _near(percent))
    wide = C.keep(wide_sketches(found.select("x").join(sketches, "x")), "wide")
    again = met_by_another(rows.drop("small").join(wide, "x"), F.col("wide1").isNull() | F.col("wide2").isNull() | _near(percent, "wide", WIDE))
    C.release(rows, found, wide)
    return again


def _ranked(own: DataFrame, small: DataFrame, src: DataFrame, percent: int, k: int) -> DataFrame:
    """token, x, n, c, rest, small: the lists of the sets of own(x, c, n, s1, s2), by shingles in order of how many of these sets have them.

    Shingles of one set alone come first and have no list; ``rest`` shingles of a set are left from a list's on. Only the
    prefix of a set is listed, so a set of which a whole prefix is its own has no entry, as nothing can be similar to it.
    """
    full = _whole_sets(own.select("x"), src, k, "array<long>").join(own, ["x", "s1", "s2"]).dropDuplicates(["x"])
    every = full.select("x", "n", "c", F.explode("hashes").alias("token"))
    shared = every.withColumn("df", F.count("*").over(W.partitionBy("token"))).where("df > 1")
    of = W.partitionBy("x")
    # of the shared ones, which come last, as many are left as come at or behind this one
    at = shared.select("token", "x", "n", "c", (F.count("*").over(of) - F.row_number().over(of.orderBy("df", "token")) + 1).alias("rest"))
    return C.keep(at.where(F.col("rest") >= F.ceil(F.col("n") * percent / 100)).join(small, "x"), "ranked")


def _led(ranked: DataFrame, percent: int, seed: int) -> DataFrame:
    """x, y: each set of a list and the list's two leaders by hashes under the seed, if they are of different components and may be similar."""
    one = F.struct(F.xxhash64("x", F.lit(seed)).alias("o"), *[F.col(c).alias(f"{c}2") for c in ("x", "n", "c", "rest", "small")])
    ends = ranked.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.array(F.min(one), F.max(one)).alias("e")).where("lo <> hi")
    j = _numbered(ranked, "token", 1).join(ends.select("token", F.inline("e")), "token")
    need = _need(F.col("n1"), F.col("n2"), percent)
    ok = (F.col("c1") != F.col("c2")) & (F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent) & (F.least("rest1", "rest2") >= need) & _near(percent)
    return j.where(ok).select(F.least("x1", "x2").alias("x"), F.greatest("x1", "x2").alias("y"))


def _block_pairs(ranked: DataFrame, percent: int, parts: int = 4) -> DataFrame:
    """x, y: pairs of different components in one list that sizes and positions leave possible, block by block; repeated for further lists.

    Two similar sets have enough left of each from the first shingle on that they share; they are found there.
    """
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)))  # similar sets are in one class or the next
    most = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    cut = ranked.withColumn("size", size).withColumn("part", F.floor((F.col("n") - F.col("rest")) * parts / most))
    blocks = cut.groupBy("token", "size", "part").agg(F.min("n").alias("n"), F.max("rest").alias("rest"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    near = F.col("size2").isin(F.col("size1"), F.col("size1") + 1)
    able = F.least("rest1", "rest2") >= _need(F.col("n1"), F.col("n2"), percent)
    met = _numbered(blocks, "token", 1).join(_numbered(blocks, "token", 2), "token").where(near & able & ~((F.col("lo1") == F.col("hi2")) & (F.col("hi1") == F.col("lo2")))).select("token", "size1", "part1", "size2", "part2")
    both = _numbered(cut, "token", 1).join(met, ["token", "size1", "part1"]).join(_numbered(cut, "token", 2), ["token", "size2", "part2"])
    ok = (F.col("c1") != F.col("c2")) & ((F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("x1") < F.col("x2")))) & (F.col("n1") * 100 >= F.col("n2") * percent)
    return both.where(ok & able & _near(percent)).select(F.least("x1", "x2").alias("x"), F.greatest("x1", "x2").alias("y"))


def _sketched(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sketches differ in no more bits than similar sets can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.short(batches):
            d = np.array([differing(*x) for x in zip(b.column("sketch").to_pylist(), b.column("other").to_pylist(), strict=True)])
            n = np.asarray(b.column("n")) + np.asarray(b.column("m"))
            most = n - 2 * -(-n * percent // (100 + percent))
            ok = d <= most
            yield pa.record_batch([b.column("x"), b.column("y")], names=["x", "y"]).filter(pa.array(ok))

    j = pairs.join(sketches, "x").join(sketches.select(F.col("x").alias("y"), F.col("n").alias("m"), F.col("sketch").alias("other")), "y")
    return C.keep(j.select("x", "y", "n", "m", "sketch", "other").mapInArrow(run, "x long, y long"), "pairs")


def _whole_sets(ids: DataFrame, src: DataFrame, k: int, kind: str = "binary", bits: int = 22) -> DataFrame:
    """x, s1, s2, hashes: the sets of the documents that ids(x) names, and of some others, made again from their texts.

    A bit map of 2^bits places of their ids, whatever their number, picks those texts where they are read, so that texts aren't
    shuffled; an id that is picked by chance costs its set and changes nothing.
    """
    mask = (1 << bits) - 1
    slot = ids.select(F.xxhash64("x").bitwiseAND(F.lit(mask)).cast("int").alias("s")).distinct().toArrow()
    seen = np.zeros(1 << bits, bool)
    seen[np.asarray(slot.column("s"))] = True
    packed = src.sparkSession.sparkContext.broadcast(np.packbits(seen))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.unpackbits(packed.value).astype(bool)
        for whole in batches:
            for b in C.slices(iter([whole.filter(pa.array(seen[np.asarray(whole.column("s"))]))])):
                s = Sets(b.column("text"), k)
                sig = s.signatures()
                col = C.lists(s.hash.view(np.int64), s.first, pa.int64()) if kind != "binary" else pa.array([s.hash[s.first[i] : s.first[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())
                yield pa.record_batch([b.column("doc_id"), _signed(sig[:, 0].copy()), _signed(sig[:, 1].copy()), col], names=["x", "s1", "s2", "hashes"])

    slotted = src.withColumn("s", F.xxhash64("doc_id").bitwiseAND(F.lit(mask)).cast("int"))
    return slotted.mapInArrow(sets, f"x long, s1 long, s2 long, hashes {kind}")


def _verified(pairs: DataFrame, src: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs that are links, by their whole sets, which are made again from the texts of the documents that some pair needs."""
    full = C.keep(_whole_sets(pairs.select(F.explode(F.array("x", "y")).alias("x")), src, k).select("x", "hashes"), "full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.short(batches):
            ok = []
            for one, two in zip(b.column("hashes").to_pylist(), b.column("other").to_pylist(), strict=True):
                x, y = np.frombuffer(one, U), np.frombuffer(two, U)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                i = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int(np.count_nonzero(large[i] == small))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([b.column("x"), b.column("y")], names=["x", "y"]).filter(pa.array(ok, pa.bool_()))

    out = C.keep(pairs.join(full, "x").join(full.select(F.col("x").alias("y"), F.col("hashes").alias("other")), "y").select("x", "y", "hashes", "other").mapInArrow(run, "x long, y long"), "links")
    C.release(full, pairs)
    return out


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    return links_components(C.table(spark, sf_dir, "documents", "doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one of the least doc_id; documents without shingles stay."""
    kept = links_components(docs.select("doc_id", "text")).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
sig AS (SELECT doc_id, md5(string_agg(CAST(h AS VARCHAR), ',' ORDER BY h)) g FROM s GROUP BY doc_id),
rep AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY g) r FROM sig),
t AS (SELECT s.* FROM s JOIN rep ON s.doc_id = rep.doc_id AND rep.doc_id = rep.r),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM t a JOIN t b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
c(node, seen) AS (SELECT doc_id, doc_id FROM rep WHERE doc_id = r UNION SELECT u.y, c.seen FROM c JOIN u ON u.x = c.node AND c.seen < u.y),
m AS (SELECT node, min(seen) k FROM c GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) n_shingles, coalesce(m.k, d.doc_id) component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN m ON m.node = rep.r
"""
