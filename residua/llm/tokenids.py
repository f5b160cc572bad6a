"""Token ids of texts, and their word-aligned binary form (Simple-8b: Anh and Moffat, 2010).

File format: Parquet rows of one block each, so that Spark's writers commit it in any store.
A block holds whole documents in ascending doc_id order (a document of any length stays in
one block) and has

    shard, block     place in the order of all blocks
    before           ids of the shard's blocks before it
    first_doc, docs  zigzag-coded steps of doc_id from one document to the next, as Simple-8b words
    counts           ids of each document, as Simple-8b words
    n_docs, n_ids    how many of each
    words            the ids, as little-endian 64-bit words
    offsets          every GROUP ids, the word in which the next id begins and its rank there

Each word has a selector in its top 4 bits: how many values it packs, of how many bits. ESCAPE
says that the next word is one whole 64-bit value. Decoding is vectorised: selectors give the
counts, counts give each value's word and shift.
"""

from __future__ import annotations

import codecs
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .fingerprint import in_ranges

U = np.uint64
#: Values in a word and bits of each, by selector; the last packs nothing itself.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
_WIDTH = np.array([x.bit_length() for x in range(1 << 16)], np.int8)
#: 120 zeros are as well packed as 60 twice over, so this selector is free to mark a raw word.
ESCAPE = 1
GROUP = 1024
BLOCK_IDS = 1 << 17


def encode(values: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned 64-bit values; each word packs as many values as fit from where it begins."""
    v = np.ascontiguousarray(values, U)
    n = len(v)
    if not n:
        return np.zeros(0, U)
    if int(v.max()) < len(_WIDTH):
        width = _WIDTH[v]
    else:
        width = np.array([x.bit_length() for x in v.tolist()], np.int8)
    best = np.full(n, ESCAPE, np.int8)
    best[width <= BITS[15]] = 15
    # each value's word packs as many values as fit from there; a word that would not be filled is not used
    least, top, have = int(width.min()), {1: width}, 1
    for s in range(14, -1, -1):
        c = int(COUNTS[s])
        if s == ESCAPE or c > n or BITS[s] < least:
            continue
        half = top[have]  # the widest of each ``have`` values from there; two that overlap or more make one of c
        most = half[: n - c + 1].copy()
        for at in [*range(have, c - have + 1, have), c - have]:
            np.maximum(most, half[at : at + n - c + 1], out=most)
        top, have = {c: most}, c
        np.copyto(best[: n - c + 1], np.int8(s), where=most <= BITS[s])
    step = np.where(best == ESCAPE, 1, COUNTS[best]).astype(np.uint8).tobytes()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += step[i]
    at = np.array(at)
    sel = best[at].astype(np.int64)
    raw = sel == ESCAPE
    place = np.cumsum(1 + raw) - 1 - raw  # of each packed word; a raw value follows its mark
    words = np.zeros(int(place[-1]) + 1 + int(raw[-1]), U)
    words[place] = sel.astype(U) << U(60)
    words[place[raw] + 1] = v[at[raw]]
    for s in np.unique(sel[~raw]):
        if not BITS[s]:
            continue
        mine = sel == s
        shifts = (np.arange(COUNTS[s]) * BITS[s]).astype(U)
        words[place[mine]] |= np.bitwise_or.reduce(v[at[mine][:, None] + np.arange(COUNTS[s])] << shifts, axis=1)
    return words


def starts(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each packing word its place, and how many values come before it."""
    sel = (words >> U(60)).astype(np.int64)
    lead = np.ones(len(words), bool)
    for i in np.flatnonzero(sel == ESCAPE):  # few; a raw word's top bits may look like a mark
        if lead[i] and i + 1 < len(words):
            lead[i + 1] = False
    place = np.flatnonzero(lead)
    if len(place) and place[-1] == len(words) - 1 and sel[-1] == ESCAPE:  # its raw word was cut off
        place = place[:-1]
    n = np.where(sel[place] == ESCAPE, 1, COUNTS[sel[place]])
    return place, np.concatenate([[0], np.cumsum(n)])


def decode(words: np.ndarray, most: int | None = None) -> np.ndarray:
    """The values of encode(), all at once."""
    words = np.ascontiguousarray(words, U)
    if not len(words):
        return np.zeros(0, U)
    place, before = starts(words)
    sel = (words[place] >> U(60)).astype(np.int64)
    n = np.diff(before)
    rank = np.arange(before[-1]) - np.repeat(before[:-1], n)
    bits = np.repeat(BITS[sel], n)
    out = (np.repeat(words[place], n) >> (rank * bits).astype(U)) & ((U(1) << bits.astype(U)) - U(1))
    raw = sel == ESCAPE
    out[before[:-1][raw]] = words[place[raw] + 1]
    return out


def group_offsets(words: np.ndarray) -> np.ndarray:
    """For every GROUP values: word and rank in it, as word * 256 + rank."""
    place, before = starts(words)
    at = np.arange(0, before[-1], GROUP)
    w = np.searchsorted(before, at, "right") - 1
    return (place[w] * 256 + (at - before[w])).astype(U)


def decode_from(words: np.ndarray, offsets: np.ndarray, first: int, n: int) -> np.ndarray:
    """n values from value ``first`` on, reading only the words from its group's offset on."""
    if n <= 0:
        return np.zeros(0, U)
    g = first // GROUP
    at, rank = int(offsets[g]) // 256, int(offsets[g]) % 256
    last = (first + n - 1) // GROUP + 1
    stop = int(offsets[last]) // 256 + 2 if last < len(offsets) else len(words)
    skip = rank + first - g * GROUP
    return decode(words[at:stop])[skip : skip + n]


#: Single marks that the tokenizer splits from the letters before them.
_MARKS = frozenset(".,;:!?|)]}\"-")


def _byte_letters() -> str:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(256 + n))
        n += b not in plain
    out[10] = "\n"
    return "".join(out)


class Pieces:
    """Token ids of texts, with what a text's parts between blanks give remembered.

    The tokenizer splits before every blank that follows a character other than white space, so such parts
    are encoded apart, each once while it is remembered (``most`` parts; then it starts anew). A text with
    white space before a blank is encoded whole.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        from tokenizers import pre_tokenizers as pre

        self.tok, self.most = Tokenizer.from_file(path), most
        # for many words that are known not to be split further, as byte letters, one to a line: far cheaper than a call for each
        self.lines = Tokenizer.from_file(path)
        self.lines.pre_tokenizer = pre.CharDelimiterSplit("\n")
        self.letters = _byte_letters()
        self.split = Tokenizer.from_file(path)
        self.split.pre_tokenizer = pre.Split(chr(266), "isolated")  # the byte letter of a new line
        self.newline = self.tok.encode("\n", add_special_tokens=False).ids[0]
        begins = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
        for token, i in self.tok.get_vocab().items():
            begins[i] = token[0] == self.letters[32]
        self.begins = begins  # tokens that start with a blank, as each such word does and no other part of it
        self.after: dict[str, bytes] = {}  # parts that follow a blank, without it
        self.lead: dict[str, bytes] = {}

    def forget(self) -> None:
        """Give the memory back at the end of a task: Python workers live on and run other tasks."""
        self.after, self.lead = {}, {}

    def _encode(self, rows: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(rows), 4096):
            out += [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(rows[at : at + 4096], add_special_tokens=False)]
        return out

    def _whole(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only with a blank before each: the tokenizer splits none of them."""
        out: list[bytes] = []
        step = 512
        rows = [codecs.charmap_decode((" " + "\n ".join(words[i : i + step])).encode(), "strict", self.letters)[0] for i in range(0, len(words), step)]
        for e in self.lines.encode_batch_fast(rows, add_special_tokens=False):
            ids = np.array(e.ids, np.uint32)
            at = (np.flatnonzero(self.begins[ids]) * 4).tolist()
            raw = ids.tobytes()
            out += [raw[i:j] for i, j in zip(at, [*at[1:], len(raw)], strict=True)]
        return out

    def _bare(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only with nothing before them."""
        out: list[bytes] = []
        step = 512
        rows = [codecs.charmap_decode(chr(10).join(words[i : i + step]).encode(), "strict", self.letters)[0].replace("\n", chr(266)) for i in range(0, len(words), step)]
        for e in self.split.encode_batch_fast(rows, add_special_tokens=False):
            ids = np.array(e.ids, np.uint32)
            cut = (np.flatnonzero(ids == self.newline) * 4).tolist()
            raw = ids.tobytes()
            out += [raw[i:j] for i, j in zip([0, *[x + 4 for x in cut]], [*cut, len(raw)], strict=True)]
        return out

    def _learn(self, after: set[str], lead: set[str]) -> None:
        marked, lined, stems, other = [], [], [], []
        first, bare, tailed = set(lead), set(), []
        have, have2 = self.after, self.lead
        for w in after:
            if w.isalpha():
                stems.append(w)
            elif w[-1:] in _MARKS and w[:-1].isalpha():
                marked.append(w)
            elif w.count("\n") == 1 and w[0] != "\n" and w[-1] != "\n":
                lined.append(w)
            else:
                other.append(w)
        for w in lined:
            x, y = w.split("\n")
            if x not in have:
                if x.isalpha():
                    stems.append(x)
                elif x[-1] in _MARKS and x[:-1].isalpha():
                    marked.append(x)
                else:
                    other.append(x)
            if y not in have2:
                if y[-1] in _MARKS and y[:-1].isalpha():
                    tailed.append(y)
                    y = y[:-1]
                (bare if y.isalpha() else first).add(y)
        new = [*{*stems, *[w[:-1] for w in marked if w[:-1] not in have]}]
        have.update(zip(new, self._whole(new), strict=True))
        other = [*set(other)]
        have.update(zip(other, self._encode([" " + w for w in other]), strict=True))
        new = [w for w in {*first, *_MARKS, "\n"} if w not in have2]
        have2.update(zip(new, self._encode(new), strict=True))
        new = [w for w in bare if w not in have2]
        have2.update(zip(new, self._bare(new), strict=True))
        for w in tailed:
            have2[w] = have2[w[:-1]] + have2[w[-1]]
        for w in marked:
            have[w] = have[w[:-1]] + have2[w[-1]]
        for w in lined:
            x, y = w.split("\n")
            have[w] = have[x] + have2["\n"] + have2[y]

    def __call__(self, rows: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, ``end`` after each text, and each text's first place."""
        if len(self.after) + len(self.lead) > self.most:
            self.after, self.lead = {}, {}
        split: list[tuple[str, list[str], list, list[int]] | None] = []
        new: set[str] = set()
        get = self.after.get
        for t in rows:
            if "  " in t or "\n " in t or "\t " in t or "\r " in t or not t.isascii() and _odd(t):
                split.append(None)
                continue
            head, *rest = t.split(" ")
            got = list(map(get, rest))
            miss = [i for i, x in enumerate(got) if x is None]
            new.update([rest[i] for i in miss])
            split.append((head, rest, got, miss))
        first = {x[0] for x in split if x and x[0] not in self.lead}
        if new or first:
            self._learn(new, first)
        whole = iter(self._encode([t for t, x in zip(rows, split, strict=True) if x is None]))
        stop, out = array("I", [end]).tobytes(), []
        for x in split:
            if x is None:
                out.append(next(whole) + stop)
                continue
            head, rest, got, miss = x
            for i in miss:
                got[i] = self.after[rest[i]]
            out.append(self.lead[head] + b"".join(got) + stop)
        ptr = np.concatenate([[0], np.cumsum(np.fromiter(map(len, out), np.int64, len(out)) // 4)])
        return np.frombuffer(b"".join(out), "<u4"), ptr


_WHITE = [chr(c) for c in (11, 12, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _odd(t: str) -> bool:
    return any(c + " " in t for c in _WHITE)


_OPEN: dict[tuple[str, int], Pieces] = {}


def pieces(path: str, most: int = 500_000) -> Pieces:
    """One for each worker process and file."""
    if (path, most) not in _OPEN:
        _OPEN[path, most] = Pieces(path, most)
    return _OPEN[path, most]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def _zigzag(x: np.ndarray) -> np.ndarray:
    return ((x << 1) ^ (x >> 63)).view(U)


def _unzigzag(x: np.ndarray) -> np.ndarray:
    return (x >> U(1)).view(np.int64) ^ -((x & U(1)).view(np.int64))


FILE = "shard int, block int, before long, first_doc long, n_docs int, n_ids long, docs binary, counts binary, words binary, offsets binary"


def _block(shard: int, block: int, before: int, docs: list[int], counts: list[int], ids: np.ndarray) -> pa.RecordBatch:
    d = np.array(docs, np.int64)
    words = encode(ids.astype(U))
    return pa.record_batch(
        [
            pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([docs[0]], pa.int64()), pa.array([len(docs)], pa.int32()), pa.array([len(ids)], pa.int64()),
            pa.array([encode(_zigzag(np.diff(d))).astype("<u8").tobytes()]), pa.array([encode(np.array(counts, U)).astype("<u8").tobytes()]),
            pa.array([words.astype("<u8").tobytes()]), pa.array([group_offsets(words).astype("<u8").tobytes()]),
        ],
        names=[x.split()[0] for x in FILE.split(", ")],
    )


def write(docs: DataFrame, path: str, tokenizer: str, end: int, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text and write blocks, in ascending doc_id order (texts of one doc_id by text), to ``path``.

    Null and empty texts are the end id alone. Each shard is a range of doc_id with about as many documents
    as any other; a shard's text moves there once and is encoded as it streams by.
    """
    src, bounds = in_ranges(C.texts(docs), C.partitions(docs.sparkSession))
    dealt = src.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = pieces(tokenizer)
        ids, doc, count, size, shard, block, before = [], [], [], 0, 0, 0, 0
        for b in C.slices(batches, 1 << 20):
            shard = b.column("bucket")[0].as_py()
            got, ptr = tok(b.column("text").to_pylist(), end)
            for i, d in enumerate(b.column("doc_id").to_pylist()):
                ids.append(got[ptr[i] : ptr[i + 1]])
                doc.append(d)
                count.append(int(ptr[i + 1] - ptr[i]))
                size += count[-1]
                if size >= block_ids:
                    yield _block(shard, block, before, doc, count, np.concatenate(ids))
                    ids, doc, count, size, block, before = [], [], [], 0, block + 1, before + size
        tok.forget()
        if doc:
            yield _block(shard, block, before, doc, count, np.concatenate(ids))

    dealt.mapInArrow(run, FILE).write.parquet(path)


def read(spark, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32; with ``ids`` the decoded ids as well."""
    blocks = spark.read.schema(FILE).parquet(path)
    by_shard = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()  # one number for each shard
    before, total = {}, 0
    for shard, n in sorted(by_shard):
        before[shard] = total
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                word = {c: np.frombuffer(r[c], "<u8") for c in ("docs", "counts", "words")}
                doc = np.cumsum(np.concatenate([[r["first_doc"]], _unzigzag(decode(word["docs"]))]))
                n = decode(word["counts"]).astype(np.int64)
                all_ids = decode(word["words"]).astype(np.uint32)
                at = np.concatenate([[0], np.cumsum(n)])
                start = before[r["shard"]] + r["before"] + at[:-1]
                cols = [pa.array(doc.astype(np.int64)), pa.array(start), pa.array(n), pa.array([crc(all_ids[at[i] : at[i + 1]]) for i in range(len(n))], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(all_ids.astype(np.int64))))
                    names.append("ids")
                yield pa.record_batch(cols, names=names)

    slim = blocks.select("shard", "before", "first_doc", "docs", "counts", "words")
    return slim.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_ids(spark, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{C.shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write(C.table(spark, sf_dir, "documents", "doc_id", "text"), path, vocabulary(), 2)
    C._KEPT.append((spark, path))
    return read(spark, path)
