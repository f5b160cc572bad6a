"""Language-model scores by prediction by partial matching over bytes (Cleary and Witten, 1984).

The trie's counts come from all training texts. A symbol is coded in the longest context that
the trie has; where the context lacks it, an escape (method C: as likely as the number of
distinct symbols seen there) leads to the next shorter one, in which the symbols of the longer
context are excluded. As all symbols of a longer context also occur in the shorter one, what
is excluded from a context is one number for each longer context.

So the code length of a symbol depends on the run of it and the ORDER symbols before it alone.
The trie is kept as tables, a level each, with no bound. Code lengths of the most common runs go
to every task; other runs of a document are joined to theirs, whether training texts have them or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

U = np.uint64
ORDER = 4
#: The symbol before a text's first byte and after its last, in 9 bits beside the bytes.
EDGE = 256
_BITS = U(9)


def _symbols(col: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with ``order`` edges before each text and one after, the places that are coded, and their rows."""
    raw, rows = C.utf8(col)
    n = len(rows) - 1
    raw = C.LOWER[raw]
    pad = order + 1
    x = np.full(len(raw) + n * pad, EDGE, np.uint16)
    row = np.repeat(np.arange(n), np.diff(rows))
    x[np.arange(len(raw)) + row * pad + order] = raw
    begin = rows[:-1] + np.arange(n) * pad
    coded = np.ones(len(x), bool)
    for j in range(order):
        coded[begin + j] = False
    return x, np.flatnonzero(coded), np.repeat(np.arange(n), np.diff(rows) + 1)


def _packed(x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k symbols up to each place, packed."""
    out = np.zeros(len(at), U)
    for j in range(k - 1, -1, -1):
        out = (out << _BITS) | x[at - j].astype(U)
    return out


def counts(train: DataFrame, order: int = ORDER) -> DataFrame:
    """gram long, n long: how often each run of order + 1 symbols occurs, over all texts of train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(0, U), np.zeros(0, np.int64)
        for b in C.slices(batches):
            x, at, _ = _symbols(b.column("text"), order)
            g = np.sort(_packed(x, at, order + 1))
            new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            held, n = _merge(held, n, g[new], np.diff(np.concatenate([new, [len(g)]])))
            if len(held) > 1_000_000:  # a task's memory is bounded; the sums are made after the shuffle anyway
                yield pa.record_batch([pa.array(held.view(np.int64)), pa.array(n)], names=["gram", "n"])
                held, n = np.zeros(0, U), np.zeros(0, np.int64)
        if len(held):
            yield pa.record_batch([pa.array(held.view(np.int64)), pa.array(n)], names=["gram", "n"])

    return train.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _merge(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a) or not len(b):
        return (a, n) if len(a) else (b, m)
    both, cnt = np.concatenate([a, b]), np.concatenate([n, m])
    order = np.argsort(both, kind="stable")
    both, cnt = both[order], cnt[order]
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    return both[first], np.add.reduceat(cnt, first)


class _Table:
    """Number of each key, by open addressing: a few vectorised probes find all keys of a batch."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2))))
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        left, probe = np.arange(len(keys)), 0
        place = self._place(keys)
        while len(left):
            p = (place[left] + probe) & ((1 << self.bits) - 1)
            free = self.slot[p] < 0
            self.slot[p[free]] = left[free]
            left = left[self.slot[p] != left]
            probe += 1
        self.most = probe
        self.at = np.zeros(1 << self.bits, U)
        used = self.slot >= 0
        self.at[used] = keys[self.slot[used]]

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        p = self._place(keys)
        left = None
        for _ in range(self.most):
            s = self.slot[p]
            same = (self.at[p] == keys) & (s >= 0)
            if left is None:
                out[same] = s[same]
                left = np.flatnonzero(~same & (s >= 0))
            else:
                out[left[same]] = s[same]
                left = left[~same & (s >= 0)]
            if not len(left):
                break
            keys = keys[~same & (s >= 0)]
            p = (p[~same & (s >= 0)] + 1) & ((1 << self.bits) - 1)
        return out


def _mask(k: int) -> int:
    """The last k symbols of a run."""
    return (1 << (9 * k)) - 1


def _last(k: int, of: str = "gram") -> Column:
    return F.col(of).bitwiseAND(F.lit(_mask(k)))


class Trie:
    """Kept tables of each level k, from contexts of no symbol to such of ``order``: all runs, nothing left out.

    ``nodes[k]``: gram (a context and a symbol after it), n. ``contexts[k]``: ctx, total, distinct, and what a symbol that
    escapes from it finds in the next shorter context, its own symbols being excluded: left (counts), fresh (symbols).
    ``known``: gram, n, cost for the runs of order + 1 symbols that occur.
    """

    def __init__(self, train: DataFrame, order: int = ORDER):
        self.order = order
        self.nodes = {order: C.keep(counts(train, order), "runs")}
        for k in range(order - 1, -1, -1):  # shorter contexts: the same symbol, fewer symbols before it
            self.nodes[k] = C.keep(self.nodes[k + 1].groupBy(_last(k + 1).alias("gram")).agg(F.sum("n").alias("n")), "runs")
        ctx = F.shiftright("gram", 9).alias("ctx")
        sums = [F.sum("n").alias("total"), F.count("*").alias("distinct")]
        none = F.lit(0).cast("long")
        self.contexts = {0: C.keep(self.nodes[0].groupBy(ctx).agg(*sums).select("*", none.alias("left"), none.alias("fresh")), "contexts")}
        for k in range(1, order + 1):
            # a key has at most 257 rows: the symbols before it
            shorter = self.nodes[k - 1].select(F.col("gram").alias("same"), F.col("n").alias("n_shorter"))
            here = self.nodes[k].join(shorter, _last(k) == F.col("same")).groupBy(ctx).agg(*sums, F.sum("n_shorter").alias("excluded"))
            up = self.contexts[k - 1].select(F.col("ctx").alias("up"), F.col("total").alias("up_total"), F.col("distinct").alias("up_distinct"))
            here = here.join(up, _last(k - 1, "ctx") == F.col("up"))
            self.contexts[k] = C.keep(here.select("ctx", "total", "distinct", (F.col("up_total") - F.col("excluded")).alias("left"), (F.col("up_distinct") - F.col("distinct")).alias("fresh")), "contexts")
        direct = F.log10(F.col("n") / (F.col("total") + F.col("distinct")))
        self.known = C.keep(self.nodes[order].join(self.contexts[order], F.shiftright("gram", 9) == F.col("ctx")).select("gram", "n", direct.alias("cost")), "known")

    def costs(self, runs: DataFrame) -> DataFrame:
        """gram, cost: the log10 probability of the last symbol after the others, for each of the distinct runs(gram)."""
        at = runs.select("gram", F.lit(0.0).alias("cost"), F.lit(False).alias("done"), F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("fresh"))
        for k in range(self.order, -1, -1):
            # runs are distinct, so a key has at most 257^(order - k) rows; the two shortest levels have at most 257 and 257^2 nodes
            small = F.broadcast if k < 2 else lambda x: x
            node = small(self.nodes[k].select(F.col("gram").alias("node"), "n"))
            ctx = small(self.contexts[k].select("ctx", "total", "distinct", F.col("left").alias("next_left"), F.col("fresh").alias("next_fresh")))
            at = at.join(node, _last(k + 1) == F.col("node"), "left").join(ctx, F.shiftright(_last(k + 1), 9) == F.col("ctx"), "left")
            direct, hit = F.col("left").isNull(), F.col("n").isNotNull()
            whole = F.when(direct, F.col("total") + F.col("distinct")).otherwise(F.greatest(F.col("left") + F.col("fresh"), F.lit(1)))
            part = F.when(hit, F.col("n")).when(direct, F.col("distinct")).otherwise(F.greatest("fresh", F.lit(1)))
            cost = F.col("cost") + F.when(F.col("done") | F.col("ctx").isNull(), 0.0).otherwise(F.log10(part / whole))
            unseen = F.coalesce(F.lit(EDGE + 1) - F.col("distinct"), F.lit(EDGE + 1)) if k == 0 else F.lit(1)  # all symbols that no text has are equally likely
            cost = cost - F.when(F.col("done") | hit, 0.0).otherwise(F.log10(F.greatest(unseen, F.lit(1))))
            at = at.select("gram", cost.alias("cost"), (F.col("done") | hit).alias("done"), F.col("next_left").alias("left"), F.col("next_fresh").alias("fresh"))
        return at.select("gram", "cost")


def commonest(counted: DataFrame, most: int) -> DataFrame:
    """The rows of counted(n, ...) of the highest n, ``most`` at most, those of like n (by eighths of a power of two) all or none."""
    step = F.floor(F.log2("n") * 8)
    total, floor = 0, None
    for s, n in sorted(map(tuple, counted.groupBy(step.alias("s")).count().collect()), reverse=True):  # 504 rows at most
        total += n
        if total > most:
            break
        floor = s
    return counted.where(F.lit(False)) if floor is None else counted.where(step >= floor)


# --- the word model that gives the base score --------------------------------------------


def word_counts(train: DataFrame) -> DataFrame:
    """word long (a 64-bit hash of the lower-cased word), n long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(0, U), np.zeros(0, np.int64)
        for b in C.slices(batches):
            h = np.sort(C.Words(b.column("text"), C.SPACED, True).hash)
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            held, n = _merge(held, n, h[first], np.diff(np.concatenate([first, [len(h)]])))
            if len(held) > 1_000_000:
                yield pa.record_batch([pa.array(held.view(np.int64)), pa.array(n)], names=["word", "n"])
                held, n = np.zeros(0, U), np.zeros(0, np.int64)
        if len(held):
            yield pa.record_batch([pa.array(held.view(np.int64)), pa.array(n)], names=["word", "n"])

    return train.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, train: DataFrame, order: int = ORDER, common: int = 1 << 20) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are lower-cased words between ASCII white space, then one end. ``base_score`` is the smoothed word model's;
    ``score`` is the log10 probability of the text's lower-cased bytes and its end under the trie. Null and empty texts
    are the end alone. Repeated rows are scored each. With no training text, all counts are 0 and bytes are equally likely.

    At most ``common`` words and runs of the highest counts go to every task (16 bytes each, and a table of twice their
    number); others of a text are joined to their counts and code lengths, each once for a document, so both paths give
    exact numbers for every word and run.
    """
    spark = docs.sparkSession
    trie = Trie(C.texts(train), order)
    words = C.keep(word_counts(C.texts(train)), "words")
    n_docs = C.texts(train).count()
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = sums[0] + n_docs, sums[1] + (1 if n_docs else 0)
    top = commonest(words, common).toArrow()
    key, cnt = np.asarray(top.column("word")).view(U), np.asarray(top.column("n"))
    all_known = len(key) == sums[1]
    o = np.argsort(key, kind="stable")
    runs = commonest(trie.known, common).toArrow()
    big = spark.sparkContext.broadcast((key[o], np.log10(0.1 + cnt[o]), np.asarray(runs.column("gram")).view(U), np.asarray(runs.column("cost"))))
    unit = float(np.log10(total + 0.1 * (distinct + 1)))
    end = float(np.log10(n_docs + 0.1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, line, gram, cost = big.value
        table = _Table(gram)
        for b in C.slices(batches, 1 << 19):
            w = C.Words(b.column("text"), C.SPACED, True)
            row = w.row_of()
            i = np.minimum(np.searchsorted(key, w.hash), max(len(key) - 1, 0))
            known = key[i] == w.hash if len(key) else np.zeros(len(row), bool)
            n = w.counts
            base = np.bincount(row[known], weights=line[i[known]] if len(key) else None, minlength=len(n)) + end - unit * (n + 1)
            k = np.bincount(row[known], minlength=len(n)) + (1 if n_docs else 0)
            rest_row, rest = row[~known], w.hash[~known]
            if all_known:
                base -= np.bincount(rest_row, minlength=len(n))  # log10(0.1) is -1
                rest_row, rest = rest_row[:0], rest[:0]
            x, at, row = _symbols(b.column("text"), order)
            g = _packed(x, at, order + 1)
            found = table.find(g)
            hit = found >= 0
            sc = np.bincount(row[hit], weights=cost[found[hit]], minlength=len(n)) if hit.any() else np.zeros(len(n))
            g, row = g[~hit], row[~hit]
            o = np.lexsort((g, row))
            g, row = g[o], row[o]
            new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (row[1:] != row[:-1])])) if len(g) else np.zeros(0, np.int64)
            ptr = np.searchsorted(row[new], np.arange(len(n) + 1))
            times = np.diff(np.concatenate([new, [len(g)]]))
            lists = [C.lists(rest.view(np.int64), np.searchsorted(rest_row, np.arange(len(n) + 1)), pa.int64()), C.lists(g[new].view(np.int64), ptr, pa.int64()), C.lists(times, ptr, pa.int64())]
            yield pa.record_batch([b.column("doc_id"), pa.array(n + 1), pa.array(k.astype(np.int64)), pa.array(base), pa.array(sc), *lists], names=["doc_id", "n_tokens", "n_known", "base", "part", "rest", "runs", "times"])

    made = C.texts(docs).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base double, part double, rest array<long>, runs array<long>, times array<long>")
    made = C.keep(made.withColumn("row", F.struct(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))), "scored")
    # what isn't common: none of these words and runs holds a large share of what was counted
    left = made.select("row", F.explode(F.arrays_zip("runs", "times")).alias("r")).select("row", F.col("r.runs").alias("gram"), F.col("r.times").alias("m"))
    new = C.keep(left.select("gram").distinct().join(trie.known, "gram", "left_anti"), "unseen")
    costs = trie.known.select("gram", "cost").unionByName(trie.costs(new))
    more = left.join(costs, "gram").groupBy("row").agg(F.sum(F.col("m") * F.col("cost")).alias("more_score"))
    out = made.drop("rest", "runs", "times").join(more, "row", "left").withColumn("score", F.col("part") + F.coalesce("more_score", F.lit(0.0)))
    if all_known:
        return out.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
    rest = made.select("row", F.explode("rest").alias("word")).groupBy("row", "word").agg(F.count("*").alias("m"))
    found = rest.join(words, "word", "left").groupBy("row").agg(F.sum(F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("k"))
    out = out.join(found, "row", "left")
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")


def adaptive(text: str, order: int = ORDER) -> float:
    """log10 probability of one text by a trie that learns as it reads, from nothing; for short texts and as the plain form of the model."""
    seen: list[dict] = [{} for _ in range(order + 1)]
    x = [EDGE] * order + list(text.encode().lower()) + [EDGE]
    out = 0.0
    for i in range(order, len(x)):
        out += plain_step(seen, x, i, order)
        for k in range(order + 1):
            d = seen[k].setdefault(tuple(x[i - k : i]), {})
            d[x[i]] = d.get(x[i], 0) + 1
    return out


def plain_step(seen: list[dict], x: list[int], i: int, order: int) -> float:
    """log10 probability of symbol x[i] after x[:i], by counts seen[k][context][symbol]; the definition that score must match."""
    out, excluded = 0.0, set()
    for k in range(order, -1, -1):
        d = seen[k].get(tuple(x[i - k : i]))
        if d is None:
            continue
        left = {s: c for s, c in d.items() if s not in excluded}
        total = sum(left.values()) + len(left)
        if x[i] in left:
            return out + float(np.log10(left[x[i]] / total))
        if total:
            out += float(np.log10(len(left) / total))
        excluded |= set(d)
    return out - float(np.log10(max(EDGE + 1 - len(excluded), 1)))


def op5_ppm(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents", "doc_id", "text")
    out = score(docs, docs.where(C.crc_mod(F.col("doc_id"), 10) != 0))
    return out.select("doc_id", (C.crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
