"""Packing by shortest-pack-first over the length histogram (Krell, Kosec, Perez and Fitzgibbon, 2021).

Documents are cut into full sequences and one remainder each. The histogram of remainder
lengths, at most ``size`` numbers whatever the corpus, is packed on the driver: lengths go
longest first into the open pack with the most room left that takes them, and only counts of
packing patterns are kept. Patterns then join the remainders back by their rank among those
of their length.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from .tokenids import crc, pieces, vocabulary

#: Parts of texts whose ids a task remembers: about 100 bytes each, far fewer parts to encode again.
REMEMBERED = 700_000


def patterns(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Packing patterns (lengths in order of place) and how often each is used; every length is used as often as it counts.

    The open patterns are kept by the room they have left. A length goes to those with the most room (the shortest packs
    first), to part of a pattern's uses where it runs out, and opens new packs for the rest.
    """
    room: dict[int, list[list]] = {}  # room left -> [pattern, uses]
    heap: list[int] = []

    def put(left: int, pattern: list[int], n: int) -> None:
        if left not in room:
            room[left] = []
            heapq.heappush(heap, -left)
        room[left].append([pattern, n])

    for length in sorted((x for x, n in counts.items() if n > 0), reverse=True):
        need = counts[length]
        made = []
        while need and heap and -heap[0] >= length:
            left = -heap[0]
            pattern, n = room[left][-1]
            take = min(n, need)
            made.append((left - length, [*pattern, length], take))
            need -= take
            if take == n:
                room[left].pop()
                if not room[left]:
                    heapq.heappop(heap)
                    del room[left]
            else:
                room[left][-1][1] -= take
        if need:  # what is opened takes more of this length before the next is opened
            each = size // length
            if need // each:
                made.append((size - length * each, [length] * each, need // each))
            if need % each:
                made.append((size - length * (need % each), [length] * (need % each), 1))
        for x in made:
            put(*x)
    return [(p, n) for left in sorted(room) for p, n in room[left]]


class Slots:
    """Where the rank-th piece of each length goes: sequence and offset."""

    def __init__(self, packs: list[tuple[list[int], int]]):
        self.starts: dict[int, list[int]] = {}
        self.info: dict[int, list[tuple[int, int]]] = {}
        used: dict[int, int] = {}
        base = 0
        for pattern, n in packs:
            at = 0
            for length in pattern:
                self.starts.setdefault(length, []).append(used.get(length, 0))
                self.info.setdefault(length, []).append((base, at))
                used[length] = used.get(length, 0) + n
                at += length
            base += n
        self.sequences = base

    def place(self, length: int, rank: int) -> tuple[int, int]:
        i = bisect_right(self.starts[length], rank) - 1
        base, at = self.info[length][i]
        return base + rank - self.starts[length][i], at


def cut(docs: DataFrame, tokenizer: str, end: int, size: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, part: full pieces of ``size`` and one remainder, for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, part = pieces(tokenizer, REMEMBERED), TaskContext.get().partitionId()
        for b in C.slices(batches, 1 << 19):
            ids, ptr = tok(b.column("text").to_pylist(), end)
            n = np.diff(ptr)
            k = -(-n // size)
            row = np.repeat(np.arange(b.num_rows), k)
            start = (np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)) * size
            length = np.minimum(size, n[row] - start)
            at = ptr[row] + start
            crcs = [crc(ids[i : i + m]) for i, m in zip(at, length, strict=True)]
            yield pa.record_batch([b.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(n[row]), pa.array(np.full(len(row), part, np.int32))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part"])
        tok.forget()
        C.give_back()

    return C.texts(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int")


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = 0, size: int = 1024) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece.

    Null and empty texts are the end id alone, one piece. Repeated rows are packed each. Sequences are numbered from 0
    without gaps: first those of the patterns, then the full ones. An empty table gives no rows.

    The pieces, without ids, are written once with the task that made them; a piece's rank is the number of pieces of its length
    in tasks before (one number for each task and length) plus its rank in its task's file.
    """
    spark = docs.sparkSession
    made = C.keep(cut(docs, tokenizer or vocabulary(), end, size), "pieces")
    hist = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    total = dict(map(tuple, hist.groupBy("length").agg(F.sum("n")).collect()))  # at most ``size`` lengths
    slots = Slots(patterns({x: n for x, n in total.items() if x < size}, size))
    # a row for each task in a length's window
    w = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    table = hist.select("part", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("ahead"))

    ranked = _ranked(made, table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            seq, off = np.empty(len(length), np.int64), np.zeros(len(length), np.int64)
            whole = length == size
            seq[whole] = slots.sequences + rank[whole]
            for x in np.unique(length[~whole]):
                mine = length == x
                st, info = np.array(slots.starts[int(x)]), np.array(slots.info[int(x)])
                i = np.searchsorted(st, rank[mine], "right") - 1
                seq[mine], off[mine] = info[i, 0] + rank[mine] - st[i], info[i, 1]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.record_batch([*[b.column(c) for c in names], pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _ranked(made: DataFrame, ahead: DataFrame) -> DataFrame:
    """Adds each piece's rank among all of its length. The window is within one task's pieces of one length, never a whole length's."""
    w = W.partitionBy("part", "length").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    return made.withColumn("in_part", F.row_number().over(w) - 1).join(ahead, ["part", "length"]).withColumn("rank", F.col("ahead") + F.col("in_part"))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents", "doc_id", "text"))
