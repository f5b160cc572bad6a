"""The pipeline: stages hand on the columns of documents, and a run over planted cases gives what a plain version gives."""

import os
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from residua.llm.common import keep
from residua.llm.packing import vocabulary

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    cols, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = keep(stage(spark, docs, DIR), name)
        assert docs.columns == cols and 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert packed.select("doc_id").distinct().count() == before


def union(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def alike(a, b):
    return 100 * len(a & b) >= 75 * len(a | b) and bool(a and b)


def plain_lines(docs):
    """Texts without lines that an earlier place has, by all pairs of lines."""
    places = [(d, p, re.sub(r"\s+", " ", x).strip()) for d in sorted(docs) for p, x in enumerate((docs[d] or "").split("\n")) if x.strip()]
    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for _, _, x in places]
    root = union(len(places), [(i, j) for j in range(len(places)) for i in range(j) if alike(sets[i], sets[j])])
    gone = {places[i][:2] for i, r in enumerate(root) if r != i}
    out = {}
    for d, t in docs.items():
        lost = {p for e, p in gone if e == d}
        left = "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in lost)
        if not lost:
            out[d] = t
        elif left.strip():
            out[d] = left
    return out


def plain_copies(docs):
    """The first document of each component, by all pairs."""
    ids = sorted(docs)
    sets = []
    for d in ids:
        w = re.findall(r"[^\x20\x09-\x0D]+", (docs[d] or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = union(len(ids), [(i, j) for j in range(len(ids)) for i in range(j) if alike(sets[i], sets[j])])
    return {d: docs[d] for i, d in enumerate(ids) if root[i] == i}


def plain_clean(docs, items):
    """Documents that share no ten words with an item."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    wins = {tuple(w[i : i + 10]) for w in map(words, items) for i in range(len(w) - 9)}
    return {d: t for d, t in docs.items() if not any(tuple(words(t)[i : i + 10]) in wins for i in range(len(words(t))))}


def test_run_against_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    bag = {v: ["".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(400)] for v, letters in (("aa", "abcdefghij"), ("zz", "nopqrstuvwxyz"))}
    text = lambda v, n=60: "\n".join(" ".join(rng.choice(bag[v]) for _ in range(12)) for _ in range(n // 12))
    docs = {i: text("aa" if i % 2 else "zz") for i in range(1, 81)}
    lang = {i: "aa" if i % 2 else "zz" for i in docs}
    shared = " ".join(rng.choice(bag["aa"]) for _ in range(14))
    passage = " ".join(rng.choice(bag["zz"]) for _ in range(20))
    planted = {
        101: docs[1], 102: text("aa") + "\n" + shared, 103: shared + "\n" + text("aa"), 104: text("zz") + " " + passage[:-3] + "\n" + text("zz"), 105: "12 34 56 !!", 106: None,
        # a near copy whose words stand in other lines, so that only the join of whole texts finds it
        107: docs[3].replace("\n", " ") + " " + rng.choice(bag["aa"]), 108: shared[:-1] + "q" + "\n" + text("aa"),
    }
    docs |= planted
    rows = [(i, t, lang.get(i, "aa"), "s", len(t or ""), 1, 2, 3) for i, t in docs.items()]
    clash = "doc_id long, text string, lang string, source string, n_chars long, __gone int, __row int, component int"
    spark.createDataFrame(rows, clash).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("b1", passage), ("b2", None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    known = {d: t for d, t in docs.items() if d not in (105, 106)}
    want = plain_clean(plain_copies(plain_lines(known)), [passage])
    assert {1, 3, 102, 103, 108} <= set(want) and not {101, 104, 107} & set(want)
    tok = Tokenizer.from_file(vocabulary())
    pieces = {}
    for d, t in want.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces |= {(d, at): (len(ids[at : at + 1024]), zlib.crc32(ids[at : at + 1024].tobytes()), len(ids)) for at in range(0, len(ids), 1024)}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.start): (r.length, r.ids_crc32, r.doc_tokens) for r in got} == pieces and len(got) == len(pieces)


@pytest.mark.parametrize("rows", [[], [(1, None, "aa", "s", 0), (1, None, "aa", "s", 0), (None, "some words here", None, None, None)]])
def test_empty_and_null(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
