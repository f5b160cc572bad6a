"""Interval labels by cells, digests of ordered buffers, gates of training rows, varied parameters, allowed hosts."""

import hashlib
import random

from pyspark.sql import functions as F

from residua.operators import gates as G
from residua.operators import manifest as N
from residua.operators import quality as Q
from residua.operators import scoring as P
from residua.operators import structures as T


def test_interval_label(spark):
    """A key with most rows and intervals, places below 0, single places, empty and null intervals, rows and intervals that repeat."""
    rng = random.Random(2)
    rows = [(i, "hot" if i % 4 else f"k{i % 7}", rng.randint(-50, 2000)) for i in range(600)] + [(600, None, 1), (601, "hot", None), (0, "hot", 1_000_000)]
    spans = [("hot", a := rng.randint(-60, 2000), a + rng.choice([0, 1, 5, 64, 300])) for _ in range(40)] + [("k1", -5, 3), ("k1", -5, 3), ("k2", 7, 2), ("k3", None, 9), ("k4", -(2**40), 2**40), (None, 0, 5)]
    df, iv = spark.createDataFrame(rows, "id int, k string, at int"), spark.createDataFrame(spans, "q string, a long, b long")
    got = {r.id: r.label for r in Q.interval_label(df, iv, ["k"], ["q"], "at", "a", "b", "id").collect()}
    want = dict.fromkeys((r[0] for r in rows), 0)
    for i, k, at in rows:
        want[i] |= int(any(k == q and k and at is not None and a is not None and a <= at <= b for q, a, b in spans))
    assert got == want and sum(got.values()) > 20
    assert {r.label for r in Q.interval_label(df, iv.where("false"), ["k"], ["q"], "at", "a", "b", "id").collect()} == {0}


def test_ordered_digest(spark):
    def plain(values, size):
        while True:
            values = [hashlib.sha256(",".join(values[i : i + size]).encode()).hexdigest() for i in range(0, len(values), size)]
            if len(values) <= 1:
                return values[0] if values else hashlib.sha256(b"").hexdigest()

    for n in (0, 1, 8, 9, 100, 520):
        v = ["" if i % 9 == 4 else str(i * 7 % 31) for i in range(n)]
        df = spark.createDataFrame([(i * 3 - 50, x or None) for i, x in enumerate(v)], "o long, v string")
        for parts in (1, 7):
            assert tuple(P.ordered_digest(df.repartition(parts), "o", F.col("v"), 8).first()) == (n, plain(v, 8))
    other = spark.createDataFrame([(1, "a"), (2, "b")], "o long, v string")
    assert P.ordered_digest(other, "o", F.col("v")).first() != P.ordered_digest(other.withColumn("o", -F.col("o")), "o", F.col("v")).first()


def test_training_gate(spark):
    df = spark.createDataFrame([("p", 1, "D", "acidic", 1, 0.5), ("p", 2, "D", "basic", 3, float("nan")), (None, 3, "K", "basic", 0, 2.0), ("q", 4, "K", "basic", None, None)], "g string, i int, a string, k string, y int, v double")
    rules = G.training_rules("g", "i", "a", "k", "y", ["v"], {"v": (0.0, 1.0)}, F.when(F.col("a") == "D", "acidic").otherwise("basic"))
    good, broken = G.training_gate(df, ["i"], rules)
    assert [r.i for r in good.collect()] == [1] and good.columns == df.columns
    assert {r.i: r.broken for r in broken.collect()} == {2: ["label", "class", "finite_v", "range_v"], 3: ["key", "range_v"], 4: ["label", "finite_v", "range_v"]}


def test_varied_allowed_and_first(spark):
    steps = spark.createDataFrame([("d", 4.0), ("d", 4.0), ("d", 6.0), ("x", 1.0), ("l", None), ("l", 2.5)], "name string, value double")
    got = {r.config: (r.d, r.l) for r in P.varied(steps, {"d": 6.0, "l": 31.0}).collect()}
    assert got == {"base": (6.0, 31.0), "d=4": (4.0, 31.0), "l=2.5": (6.0, 2.5)}
    urls = spark.createDataFrame([(1, "https://a.b/c"), (2, "http://a.b/c"), (3, "https://x.y"), (4, None)], "i int, u string")
    hosts = spark.createDataFrame([("a.b",), ("a.b",), (None,)], "h string")
    assert {r.i: r.allowed for r in N.allowed_by(urls, "u", hosts, "h").collect()} == {1: True, 2: False, 3: False, 4: False}
    rows = spark.createDataFrame([("a", i % 50) for i in range(200)] + [("b", 3)], "g string, p int")
    assert {r.g: (r.n, r["first"]) for r in T.first_offenders(rows, ["g"], "p", 3).collect()} == {"a": (200, [0, 0, 0]), "b": (1, [3])}


def test_source_and_identity(spark):
    kind = "k int, source struct<name:string,full_name:string,url:string,license:string,license_url:string,attribution_note:string,citation:array<string>>"
    full = ("n", "f", "u", "l", "lu", "a")
    df = spark.createDataFrame([(1, (*full, ["c"])), (2, None), (3, ("n", " ", None, "l", "lu", "a", [])), (4, (*full, ["c", None]))], kind)
    got = {(r.id, r.rule) for r in Q.violations(df, "source", "k", N.source_rules()).collect()}
    assert {i for i, _ in got} == {"2", "3", "4"} and {r for i, r in got if i == "3"} == {"source.full_name missing", "source.url missing", "source.citation missing"}
    assert {r for i, r in got if i == "4"} == {"source.citation missing"} and ("2", "source missing") in got
    s = spark.createDataFrame([(1, "MGA", "MGA"), (2, "MGA", "MGAK"), (3, "MKA", "MGG"), (4, None, ""), (5, None, "M")], "k int, a string, b string")
    assert {r.k: (r.length_a, r.length_b, r.differing, r["first"], r.match) for r in N.sequence_identity(s, "k", "a", "b").collect()} == {1: (3, 3, 0, None, True), 2: (3, 4, 1, 4, False), 3: (3, 3, 2, 2, False), 4: (0, 0, 0, None, False), 5: (0, 1, 1, 1, False)}


def test_atom_rules(spark):
    kind = "chain string, pos int, atom string, residue string, icode string, x double, y double, z double, b double"
    good = ("CA", "ALA", ".", 1.0, 1.0, 1.0, 50.0)
    rows = [("a", 1, *good), ("a", 2, *good), ("b", 1, *good), ("c", 1, "N", "gly ", None, 1.0, 1.0, 1.0, 50.0), ("c", 2, "CA", "ALA", "C", float("nan"), 1.0, None, 101.0), ("c", 2, None, "GLY", ".", 1.0, 1.0, 1.0, 0.0), ("c", None, "CA", "UNK", ".", 1.0, 1.0, 1.0, None)]
    got = {(r.chain, r.pos, r.rule) for r in T.inference_rules(spark.createDataFrame(rows, kind), ["chain"]).collect()}
    assert got == {("b", None, "fewer than two residues"), ("c", 1, "no CA"), ("c", 2, "inserted residue"), ("c", 2, "coordinates"), ("c", 2, "confidence"), ("c", 2, "no atom name"), ("c", 2, "two residue names"), ("c", None, "position"), ("c", None, "unknown residue"), ("c", None, "confidence")}
