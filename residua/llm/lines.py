"""Fuzzy line deduplication by MinHash.

Lines are compared by their sets of character shingles: the SHINGLE characters from each place
of the line (all of it, if it is shorter). Shingles of a line are dealt out on two rings by their
hashes; the first shingle at or after each of POINTS points of a ring is a minimum hash. Each line
goes to BANDS bands of ROWS of these, by lots of packed rows that are sorted where they arrive.
Lines of a band of up to FEW are all compared, lines of a larger one with its least and its greatest
one, by exact Jaccard similarity, and links are joined to components by alternating large-star and
small-star steps. Larger bands whose lines are then still of several components are gone through
again, with other leaders and at last with all lines of different components. Of these pairs, only
those whose parity sketches differ in no more bits than similar lines' can have their texts compared; that loses none.
Of each component the line that comes first (by doc_id, then place) stays.

Shingles, bands, their pairs and comparisons of texts are made in Arrow batches; everything else is DataFrame code. A form in
SQL functions alone took more CPU time and disk than it may (figures in the README).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

U = np.uint64
SHINGLE = 5
RINGS, ROWS, BANDS = 2, 7, 38
POINTS = ROWS * BANDS // RINGS
#: Bits of a place on a ring, so that it has room for a line's number among 1,024 beside it.
TURN = 22
_RNG = np.random.default_rng(8)
_CHAR = _RNG.integers(1, 2**63, 3, dtype=np.uint64) * U(2) + U(1)
_RING = _RNG.integers(1, 2**63, RINGS, dtype=np.uint64) * U(2) + U(1)
_ROW = _RNG.integers(1, 2**63, ROWS, dtype=np.uint64) * U(2) + U(1)
#: Points of each band, no point in two: from both rings in turn, far apart on each.
_POINT = np.stack([_RNG.permutation(POINTS) + POINTS * i for i in range(RINGS)], 1).reshape(BANDS, ROWS)
#: Lines of a band that are all compared with each other.
FEW = 6
#: Rows of bands that a task packs at once, and what a row is: 32 bits of the band's key beside its part, and the line.
LOT = 1 << 20
PACKED = np.dtype([("key", "<u4"), ("id", "<i8")])
#: Characters whose signatures are made at once: what they need stays in a core's cache.
CHUNK = 1 << 16
#: Bits of the number of a bit in a piece of a bit map.
PIECE = 18
#: Lines of more shingles than each of these have a sketch of twice as many numbers, from four on.
WIDER = (128, 256, 512, 1024, 2048)


_FOLD = re.compile("[ \t\r\f\x0b]+")
_ODD = ("  ", "\t", "\r", "\f", "\x0b")


def lines_of(text: str) -> list[str]:
    """The normal lines of a text, in order of place: white space folded and trimmed."""
    if any(x in text for x in _ODD):  # many times as fast as one expression
        text = _FOLD.sub(" ", text)
    return [x.strip(" ") for x in text.split("\n")]


def id_of(line: str) -> int:
    """64 bits, with a sign, that a normal line is known by."""
    x = xxhash.xxh64_intdigest(line)
    return x - (1 << 64) if x >> 63 else x


def blank(line: Column) -> Column:
    """Whether a line has only white space."""
    return F.trim(line, F.lit(" \t\r\f\x0b\n")) == ""


def once(**columns: Column) -> Column:
    """Columns that are computed once for a row, however often what follows uses them."""
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each normal line, repeated ones too, and where each line's begin; a line has one at least."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    pad = chr(0xE000) * SHINGLE  # what fills up a short line is told apart below
    c = np.frombuffer("".join([x if len(x) >= SHINGLE else (x + pad)[:SHINGLE] for x in lines]).encode("utf-32-le"), np.uint32).astype(U)
    n = np.maximum(size, SHINGLE)
    end = np.cumsum(n)
    inside = np.ones(len(c), bool)
    for j in range(1, SHINGLE):
        inside[end - j] = False
    h = c[:-1] * _CHAR[0] + c[1:]  # of two characters, then of four, then of five
    h = h[:-2] * _CHAR[1] + h[2:]
    h = h[:-1] * _CHAR[2] + c[4:]
    h = C.mix(h[inside[: len(h)]])
    first = np.concatenate([[0], np.cumsum(n - SHINGLE + 1)])
    short = np.flatnonzero(size < SHINGLE)
    h[first[short]] = C.mix(h[first[short]] + size[short].astype(U) + U(1))
    return h, first


def sketches(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lines of ``shingles``: how many different ones each has, how many 64-bit numbers its sketch has, and the sketches.

    A bit is the parity of the line's different shingles in its place, so lines that differ in d shingles differ in d bits at
    most. The halves of a sketch, one XOR the other, are the sketch of half the size. Shingles of a line are told apart by 44 bits.
    """
    row = np.repeat(np.arange(len(first) - 1, dtype=U), np.diff(first))
    x = np.sort((row << U(44)) | (h[: len(row)] >> U(20)))
    x = x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x
    row = (x >> U(44)).astype(np.int64)
    n = np.bincount(row, minlength=len(first) - 1)
    size = np.full(len(n), 4)
    for w in WIDER:
        size[n > w] *= 2
    at = np.cumsum(size) - size
    bit = at[row] * 64 + (x.astype(np.int64) & (size[row] * 64 - 1))
    odd = (np.bincount(bit, minlength=int(size.sum()) * 64) & 1).astype(bool)
    return n, size, np.packbits(odd, bitorder="little").view("<i8")


def chunks(lines: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of lines of about CHUNK characters, 1,024 lines at most."""
    cut = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines))) // CHUNK
    at = 0
    while at < len(lines):
        to = min(at + 1024, int(np.searchsorted(cut, cut[at], "right")))
        yield at, to
        at = to


def keys(lines: list[str]) -> np.ndarray:
    """A row of BANDS keys of 64 bits for each line, which isn't blank.

    A line's shingles are sorted on each ring by a hash, and counted between points, which gives the first one after each point;
    behind the last shingle comes the first again. So a place costs no pass over the shingles.
    """
    out = np.empty((len(lines), BANDS), U)
    for at, to in chunks(lines):
        h, first = shingles(lines[at:to])
        n = to - at
        row = np.repeat(np.arange(n), np.diff(first))
        high, low, begin, end = row.astype(np.uint32) << np.uint32(TURN), row * POINTS, first[:-1, None], first[1:, None]
        place = np.empty((n, RINGS * POINTS), np.uint32)
        for i in range(RINGS):
            x = np.sort(high | ((h[: len(row)] * _RING[i]) >> U(64 - TURN)).astype(np.uint32)) & np.uint32((1 << TURN) - 1)
            passed = np.bincount(((x * np.uint32(POINTS)) >> np.uint32(TURN)) + low, minlength=n * POINTS)
            after = (np.cumsum(passed) - passed).reshape(n, POINTS)
            place[:, i * POINTS : (i + 1) * POINTS] = x[np.where(after == end, begin, after)]
        key = np.zeros((n, BANDS), U)
        for i in range(ROWS):
            key += place[:, _POINT[:, i]] * _ROW[i]
            key ^= key >> U(29)
        out[at:to] = C.mix(key + np.arange(BANDS, dtype=U))
    return out


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, hash, place, id of each line that isn't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            row, place, ids, seen = [], [], [], {}
            for r, text in enumerate(b.column("text").to_pylist()):
                for p, x in enumerate(lines_of(text)):
                    if x:
                        i = seen.get(x)
                        if i is None:
                            i = seen[x] = id_of(x)
                        row.append(r)
                        place.append(p)
                        ids.append(i)
            if row:
                at = pa.array(row)
                yield pa.record_batch([b.column("doc_id").take(at), b.column("hash").take(at), pa.array(place, pa.int32()), pa.array(ids, pa.int64())], names=[*KEY, "place", "id"])

    return keyed(docs).mapInArrow(run, "doc_id long, hash long, place int, id long")


def packed(key: np.ndarray, ids: np.ndarray, parts: int) -> pa.RecordBatch:
    """part, rows: lines of bands, as PACKED, of each part that has any."""
    part = ((key >> U(32)) * U(parts)) >> U(32)
    order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.uint32), kind="stable")
    rows = np.empty(len(key), PACKED)
    rows["key"], rows["id"] = key[order].astype(np.uint32), ids[order // BANDS]
    n = np.bincount(part.astype(np.int64), minlength=parts)
    held = np.flatnonzero(n)
    ptr = np.concatenate([[0], np.cumsum(n[held])]) * PACKED.itemsize
    data = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(ptr.astype(np.int32)), pa.py_buffer(rows)])
    return pa.record_batch([pa.array(held, pa.int32()), data], names=["part", "rows"])


def banded(docs: DataFrame, parts: int) -> DataFrame:
    """part, rows: each line in its bands, once for each batch; a band is of one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in C.slices(batches):
            lines = list({x: None for text in b.column("text").to_pylist() for x in lines_of(text) if x})
            for at in range(0, len(lines), LOT // BANDS):
                some = lines[at : at + LOT // BANDS]
                held.append((keys(some).reshape(-1), np.fromiter(map(id_of, some), np.int64, len(some))))
                n += len(some) * BANDS
                if n >= LOT:
                    yield packed(*map(np.concatenate, zip(*held, strict=True)), parts)
                    held, n = [], 0
        if held:
            yield packed(*map(np.concatenate, zip(*held, strict=True)), parts)

    return docs.select("text").mapInArrow(run, "part int, rows binary")


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """x, y, band of the ``packed`` rows of some parts: pairs of lines that share a band, without band; and x, band of lines of bands of more than FEW."""
    some = [(b.column("part")[r].as_py(), b.column("rows")[r].as_buffer()) for b in batches for r in range(b.num_rows)]
    for part in sorted({p for p, _ in some}):
        rows = np.frombuffer(b"".join(x for p, x in some if p == part), PACKED)
        x = np.sort((rows["key"].astype(U) << U(32)) | np.arange(len(rows), dtype=U))
        key, ids = x >> U(32), rows["id"][x & U(0xFFFFFFFF)]
        new = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(ids) != 0)])  # most lines of other batches again
        key, ids = key[new], ids[new]
        same = np.diff(key) == 0
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        key, ids = key[shared], ids[shared]
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        if not len(key):
            continue
        new = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(ids) != 0)])
        key, ids = key[new], ids[new]
        first = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
        n = np.diff(np.append(first, len(key)))
        band, large = np.repeat(np.arange(len(n)), n), np.repeat(n > FEW, n)
        pairs = []
        for d in range(1, FEW):
            at = np.flatnonzero((band[d:] == band[:-d]) & ~large[d:])
            pairs.append((ids[at], ids[at + d]))
        least, greatest = np.repeat(first, n), np.repeat(first + n - 1, n)
        one, two = (np.flatnonzero(large & (np.arange(len(ids)) != x)) for x in (least, greatest))
        pairs += [(ids[least[one]], ids[one]), (ids[two], ids[greatest[two]])]
        x, y = (np.concatenate(z) for z in zip(*pairs, strict=True))
        none = pa.nulls(len(x), pa.int64())
        yield pa.record_batch([pa.array(x), pa.array(y), none], names=["x", "y", "band"])
        own = (key[large] | U(part) << U(32)).view(np.int64)
        yield pa.record_batch([pa.array(ids[large]), pa.nulls(len(own), pa.int64()), pa.array(own)], names=["x", "y", "band"])
    C.give_back()


def folded(sketch: Column, size: Column) -> Column:
    """A sketch of twice ``size`` numbers, folded to that size."""
    return F.zip_with(F.slice(sketch, F.lit(1), size), F.slice(sketch, size + 1, size), lambda x, y: x.bitwiseXOR(y))


def halved(wide: str) -> Column:
    """n and sketch with the sketch of half the size."""
    w = F.col(wide)
    return F.struct(w["n"].alias("n"), folded(w["sketch"], F.expr(f"size({wide}.sketch) div 2").cast("int")).alias("sketch"))


def possible(one: str, two: str, percent: int) -> Column:
    """Whether lines may be similar by their sizes and sketches, wide(n, sketch): no similar pair is left out.

    Sizes of similar lines are not so far apart that one sketch is more than twice as large as the other, which is folded.
    """
    a, b = F.col(one), F.col(two)
    size = F.least(F.size(a["sketch"]), F.size(b["sketch"]))
    fold = lambda s: F.when(F.size(s) > size, folded(s, size)).otherwise(s)
    bits = F.zip_with(fold(a["sketch"]), fold(b["sketch"]), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(bits, F.lit(0), lambda s, x: s + x)
    n = a["n"] + b["n"]
    return (F.least(a["n"], b["n"]) * 100 >= F.greatest(a["n"], b["n"]) * percent) & (differ <= n - 2 * F.ceil(n * percent / (100 + percent)))


def marks(ids: DataFrame, rows: int) -> tuple[bytes, int]:
    """A bit map of the lowest bits of ids(id), about ``rows`` of them, and how many bits these are: 22 to 27, so it has 16 MiB at most.

    Pieces of it are made in tasks, so that the driver gets no more than the map.
    """
    spark = ids.sparkSession
    bits = min(27, max(22, (16 * rows).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            slot = np.asarray(b.column("slot"))
            for p in np.unique(slot >> PIECE).tolist():
                seen.setdefault(p, np.zeros(1 << PIECE, bool))[slot[slot >> PIECE == p] & ((1 << PIECE) - 1)] = True
        yield pa.record_batch([pa.array(list(seen), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in seen.values()], pa.binary())], names=["piece", "bits"])

    slots = ids.select(F.col("id").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("slot"))
    pieces = slots.repartitionById(min(C.partitions(spark), 1 << (bits - PIECE)), F.shiftright("slot", PIECE)).mapInArrow(run, "piece int, bits binary").toArrow()
    out, size = bytearray(1 << (bits - 3)), 1 << (PIECE - 3)
    for p, x in zip(pieces.column("piece").to_pylist(), pieces.column("bits").to_pylist(), strict=True):
        out[p * size : (p + 1) * size] = x
    return bytes(out), bits


def wanted(ids: DataFrame, docs: DataFrame, made: Callable[[list[int], list[str]], pa.RecordBatch], kind: str, rows: int) -> DataFrame:
    """What ``made`` gives, in columns of ``kind``, of the lines of each batch of docs that ids(id), of about so many rows, names, and of some others.

    A bit map picks lines where they are read, so that others aren't shuffled.
    """
    held, bits = marks(ids, rows)
    packed = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(packed.value, np.uint8)
        for b in C.slices(batches):
            lines = list({x: None for text in b.column("text").to_pylist() for x in lines_of(text) if x})
            i = np.fromiter(map(id_of, lines), np.int64, len(lines))
            slot = i & ((1 << bits) - 1)
            found = np.flatnonzero((seen[slot >> 3] >> (slot & 7)) & 1)
            if len(found):
                yield made(i[found].tolist(), [lines[j] for j in found.tolist()])

    return docs.select("text").mapInArrow(run, kind)


def with_text(ids: DataFrame, docs: DataFrame, rows: int = 0) -> DataFrame:
    """id, line of the lines that ids(id), of about so many rows, names, once each, read again from the documents."""

    def made(i: list[int], lines: list[str]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(i, pa.int64()), pa.array(lines, pa.string())], names=["id", "line"])

    return wanted(ids, docs, made, "id long, line string", rows).join(ids, "id", "left_semi").groupBy("id").agg(F.first("line").alias("line"))


def with_sketch(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """id, wide (n and sketch, of ``sketches``) of the lines that ids(id) names, once each, made again from the documents."""
    return sketched(with_text(ids, docs))


def sketched(text: DataFrame) -> DataFrame:
    """id, wide (n and sketch, of ``sketches``) of text(id, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.short(batches):
            lines = b.column("line").to_pylist()
            n, size, bits = (np.concatenate(x) for x in zip(*[sketches(*shingles(lines[at:to])) for at, to in chunks(lines)], strict=True))
            yield pa.record_batch([b.column("id"), pa.array(n.astype(np.int32)), C.lists(bits, np.concatenate([[0], np.cumsum(size)]), pa.int64())], names=["id", "n", "sketch"])

    return text.select("id", "line").mapInArrow(run, "id long, n int, sketch array<bigint>").select("id", F.struct("n", "sketch").alias("wide"))


def alike(xs: list[str], ys: list[str], percent: int) -> np.ndarray:
    """Whether the shingles of each two lines are similar enough; shingles of a row are told apart by 53 bits."""
    out = np.empty(len(xs), bool)
    for at, to in chunks([x + y for x, y in zip(xs, ys, strict=True)]):
        n = to - at
        h, first = shingles(xs[at:to] + ys[at:to])
        mark = np.concatenate([np.arange(n, dtype=U) << U(54), (np.arange(n, dtype=U) << U(54)) | U(1)])
        x = np.sort(((h[: first[-1]] >> U(11)) << U(1)) | np.repeat(mark, np.diff(first)))
        x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        row = (x >> U(54)).astype(np.int64)
        both = np.bincount(row[1:][(x[1:] ^ x[:-1]) == 1], minlength=n)
        out[at:to] = both * 100 >= (np.bincount(row, minlength=n) - both) * percent
    return out


def similar(pairs: DataFrame, text: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs(x, y) of ids of lines of text(id, line) whose shingles are similar enough, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.short(batches):
            ok = alike(b.column("line_x").to_pylist(), b.column("line_y").to_pylist(), percent)
            yield pa.record_batch([b.column("x"), b.column("y")], names=["a", "b"]).filter(pa.array(ok))

    s, t = (text.select(F.col("id").alias(i), F.col("line").alias(f"line_{i}")) for i in "xy")
    return C.keep(pairs.join(s, "x").join(t, "y").select("x", "y", "line_x", "line_y").mapInArrow(run, "a long, b long"), "links")


def with_root(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """Adds root, the component of the column id or that id."""
    return rows.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("component", "id")).drop("component")


def sides(meet: DataFrame, comp: DataFrame) -> DataFrame:
    """id, band, root, main of meet(id, band), of bands with lines of several components; main is the band's largest one."""
    rows = with_root(meet, comp)
    by_root = rows.groupBy("band", "root").agg(F.count("*").alias("n"))
    main = by_root.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"))
    return rows.join(main.where("roots > 1").select("band", "main"), "band")


def _numbered(rows: DataFrame, i: int) -> DataFrame:
    return rows.select("band", *[F.col(c).alias(f"{c}{i}") for c in rows.columns if c != "band"])


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("id1", "id2").alias("x"), F.greatest("id1", "id2").alias("y")).distinct()


def led(meet: DataFrame, comp: DataFrame, sigs: DataFrame, percent: int, seed: int) -> DataFrame:
    """x, y: pairs of lines of different components, one of them a leader of a band of meet(id, band), that may be similar by sigs(id, wide).

    Leaders are two lines of a band's largest component and two of all others, by hashes under the seed. This is linear and joins
    most of a group of near copies, before all that is still apart is compared. Sketches are joined to pairs, not to bands.
    """
    held = sides(meet, comp)
    one = F.struct(F.xxhash64(F.lit(seed), "band", "id").alias("v"), "id", "root")
    ends = held.groupBy("band", (F.col("root") == F.col("main")).alias("own")).agg(F.array(F.min(one), F.max(one)).alias("e"))
    ends = ends.select("band", F.explode(F.array_distinct("e")).alias("e")).select("band", "e.id", "e.root")
    a, b = _numbered(held.where("root <> main").drop("main"), 1), _numbered(ends, 2)
    return _able(_pairs(a.join(b, "band").where(F.col("root1") != F.col("root2"))), sigs, percent)


def _able(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs(x, y) that may be similar by the whole sketches of sigs(id, wide)."""
    s, t = (sigs.select(F.col("id").alias(i), F.col("wide").alias(f"wide_{i}")) for i in "xy")
    return pairs.join(s, "x").join(t, "y").where(possible("wide_x", "wide_y", percent)).select("x", "y")


def rest(meet: DataFrame, comp: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """x, y: pairs of lines of different components that share a band of meet(id, band) and may be similar by sigs(id, wide, half), kept.

    Lines of a band are held against each other by half sketches, and pairs that are left by whole ones. A band's largest component is only held against its other ones, which are shuffled once for both joins. Half of the bands
    are shuffled at a time.
    """
    held = C.keep(sides(meet, comp), "held")
    alike = possible("half1", "half2", percent)
    short = sigs.select("id", "half")
    parts = []
    for half in (0, 1):
        rows = held.where(F.col("band").bitwiseAND(F.lit(1)) == half)
        others = rows.where("root <> main").select("id", "band", "root").join(short, "id")
        largest = rows.where("root = main").select("id", "band").join(short, "id")
        one = _numbered(others, 1)
        within = one.join(_numbered(others, 2), "band").where((F.col("root1") != F.col("root2")) & (F.col("id1") < F.col("id2")) & alike)
        across = one.join(_numbered(largest, 2), "band").where(alike)
        parts.append(C.keep(_pairs(within.select("id1", "id2").unionByName(across.select("id1", "id2"))), "met"))
        del rows, others, largest, one, within, across
        C.tidy(meet.sparkSession)
    met = C.keep(_able(parts[0].unionByName(parts[1]).distinct(), sigs, percent), "met")
    C.release(held, *parts)
    return met


def merged(comp: DataFrame, more: DataFrame) -> DataFrame:
    """Components of nodes that are in components, comp(node, component), by more links(a, b)."""
    up = comp.withColumnRenamed("component", "root")
    ends = more.join(up.withColumnRenamed("node", "a"), "a", "left").select(F.coalesce("root", "a").alias("a"), "b")
    ends = ends.join(up.withColumnRenamed("node", "b"), "b", "left").select("a", F.coalesce("root", "b").alias("b"))
    top = C.keep(C.components(ends), "components")
    every = comp.unionByName(top.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
    joined = every.join(top.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left")
    return C.keep(joined.select("node", F.coalesce("least", "component").alias("component")), "components")


#: What a row is known by: its doc_id, and a hash of its text for rows that share a doc_id.
KEY = ("doc_id", "hash")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")


def duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, hash, place, first_doc, first_place, for docs(doc_id, text) without nulls: each line that goes, and the line that stays for it.

    Lines whose normal forms are equal are one; two lines whose shingle sets have a Jaccard similarity of percent / 100 or more
    are linked if they share a band. Blank lines never go.
    """
    every = C.keep(placed(docs), "places", "zstd")
    parts = C.partitions(docs.sparkSession)
    meet = C.keep(banded(docs, parts).repartitionById(parts, "part").mapInArrow(met, "x long, y long, band long"), "bands")
    C.tidy(docs.sparkSession)
    pairs = C.keep(meet.where("band is null").select("x", "y").distinct(), "pairs")
    text = C.keep(with_text(pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct(), docs, pairs.count()), "lines", "zstd")
    links = similar(pairs, text, percent)
    C.release(pairs)
    comp = C.keep(C.components(links), "components")
    C.release(links)
    left = meet.where("band is not null").select(F.col("x").alias("id"), "band")  # of smaller bands, all pairs are compared
    # bands that are still of several components, and sketches of their lines
    apart = with_root(left, comp).groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    open_ = C.keep(left.join(apart, "band", "left_semi"), "open")
    if not open_.isEmpty():  # all of these lines are in pairs, so their texts are at hand
        known = C.keep(sketched(text.join(open_.select("id").distinct(), "id", "left_semi")).withColumn("half", halved("wide")), "sketches")
        more = similar(led(open_, comp, known, percent, 1), text, percent)
        comp = comp if more.isEmpty() else merged(comp, more)
        C.release(more)
        pairs = rest(open_, comp, known, percent)
        C.release(known)
        more = similar(pairs, text, percent)
        comp = comp if more.isEmpty() else merged(comp, more)
        C.release(more, pairs)
    C.release(open_, text, meet)
    # each component's first line
    here = F.struct(*KEY, "place")
    by_id = every.groupBy("id").agg(F.min(here).alias("first"), F.count("*").alias("n"))
    known = C.keep(by_id.join(comp.select(F.col("node").alias("id"), "component"), "id", "left"), "known")
    lowest = C.keep(known.where("component is not null").groupBy("component").agg(F.min("first").alias("kept")), "lowest")
    kept = known.join(lowest, "component", "left").where("component is not null or n > 1").select("id", F.coalesce("kept", "first").alias("kept"))
    out = every.join(kept, "id").where(here != F.col("kept"))
    return out.select(*KEY, "place", F.col("kept.doc_id").alias("first_doc"), F.col("kept.place").alias("first_place"))


def marked(docs: DataFrame, percent: int = 75) -> DataFrame:
    """row (all columns of docs), parts (the lines of its text), left (the places that stay, null if all do) for each row of docs."""
    gone = C.keep(duplicates(C.texts(docs), percent), "gone").groupBy(*KEY).agg(F.collect_set("place").alias("gone"))
    j = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")).join(gone, list(KEY), "left")
    # an empty array of places is one of all places but none
    return j.select("row", "gone", once(parts=F.split("row.text", "\n", -1))).select("row", "parts", F.when(F.col("gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone")).alias("left"))


def dedup(docs: DataFrame, percent: int = 75) -> DataFrame:
    """row (a struct of all columns of docs, the text without lines that go), n_lines (not blank ones), n_removed.

    Null texts stay null, blank lines stay. A document whose every line goes has an empty text. Documents that share a doc_id
    are compared like others; those that share the text too lose the same places. A row without doc_id stays as it is. An empty
    table gives none; names of other columns can't clash, as they are inside the struct.
    """
    m = marked(docs, percent)
    text = F.when(F.col("left").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform("left", lambda i: F.col("parts")[i]), "\n"))
    n = F.coalesce(F.size(F.filter("parts", lambda x: ~blank(x))), F.lit(0))
    row = F.struct(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
    return m.select(row.alias("row"), n.cast("long").alias("n_lines"), F.when(F.col("left").isNull(), 0).otherwise(F.size("parts") - F.size("left")).cast("long").alias("n_removed"))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(C.table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("row.text", F.lit("")).cast("binary"), 256).alias("kept_sha256"), "row.text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their duplicate lines, n_chars counted anew where lines went; one whose every line went goes with them.

    Null and blank texts that lost nothing stay, as do rows without doc_id; repeated rows are kept alike; an empty table gives none.
    """
    out = dedup(docs).where(~((F.col("n_removed") > 0) & blank(F.coalesce("row.text", F.lit("")))))
    own = lambda c: F.col("row")[c]
    return out.select(*[F.when(F.col("n_removed") > 0, F.length(own("text")).cast(kind)).otherwise(own(c)).alias(c) if c == "n_chars" else own(c).alias(c) for c, kind in docs.dtypes])
