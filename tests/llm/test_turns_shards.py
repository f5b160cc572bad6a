"""Conversation repair and sharding against plain versions and on odd inputs."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.llm import shards, turns

FORM = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """(role, text, fault) of each row in its order."""
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def exhaustive(rows, most=2):
    """Least (cost, audit, lines) over every choice of edits, with at most two insertions in a place."""
    best, gaps = None, [c for k in range(most + 1) for c in itertools.product("ua", repeat=k)]
    name = {"u": "user", "a": "assistant"}
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for _, _, f in rows]
    for picks in itertools.product(*choices):
        for fill in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, lines, form = 0, "", [], ""
            for i in range(len(rows) + 1):
                for g in fill[i]:
                    cost, audit, lines, form = cost + 3, audit + "I", [*lines, name[g] + ":"], form + g
                if i < len(rows):
                    (role, text, f), e = rows[i], picks[i]
                    audit += e[0]
                    if e == "D":
                        cost += 4
                        continue
                    role = role if e == "K" else name[e[1]]
                    cost, lines, form = cost + 3 * (e != "K") + 3 * (f == "truncated"), [*lines, f"{role}:{text}"], form + (role[:1] or "?")
            if FORM.fullmatch(form) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
    return best


def by_layers(rows):
    """The same for long conversations: least (cost, audit, lines) of each state after each row."""
    name = {"u": "user", "a": "assistant"}

    def fill(d):
        for q, c in [("", "u"), ("s", "u"), ("a", "u"), ("u", "a"), ("a", "u")]:
            if q in d:
                new = d[q][0] + 3, d[q][1] + "I", (d[q][2], name[c] + ":")
                d[c] = min(d.get(c, new), new, key=lambda x: x[:2])
        return d

    d = {"": (0, "", None)}
    for role, text, f in rows:
        new = {}
        for q, (cost, audit, lines) in fill(d).items():
            ways = [(q, 4, "D", None)]
            if f not in ("blank", "duplicate"):
                more = 3 * (f == "truncated")
                ways += [(c, more + 3 * (e == "R"), e, f"{role if e == 'K' else name[c]}:{text}") for c in "sua" for e in "KR" if (q, c) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")} and (e == "K" and role[:1] == c or e == "R" and c != "s")]
            for c, k, e, line in ways:
                x = cost + k, audit + e, (lines, line) if line is not None else lines
                new[c] = min(new.get(c, x), x, key=lambda y: y[:2])
        d = new
    cost, audit, chain = min((v for q, v in fill(d).items() if q in ("", "a")), key=lambda x: x[:2])
    lines = []
    while chain is not None:
        chain, line = chain
        lines.append(line)
    return cost, audit, lines[::-1]


def talk(rng, n):
    return [(rng.choice(["user", "assistant", "system", "tool", "user", "assistant", "", " "]), rng.choice(["Yes.", "No", " \t", "", "So?", "Well !\n"] + [f"Line {i}." for i in range(9)])) for _ in range(n)]


def expected(talks):
    out = {}
    for i, rows in talks.items():
        f = faults(rows)
        cost, audit, lines = by_layers(f) if rows else (0, "", [])
        count = lambda k: sum(x[2] == k for x in f)
        illegal = sum((a[:1] or "?") + (b[:1] or "?") not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:]))
        out[i] = (0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_plain_versions_agree():
    rng = random.Random(5)
    for _ in range(25):
        rows = faults(talk(rng, rng.randint(0, 2)))
        assert exhaustive(rows) == by_layers(rows)
    for _ in range(3):
        rows = faults(talk(rng, 3))
        assert exhaustive(rows, 1)[:2] >= by_layers(rows)[:2]


@pytest.mark.parametrize("most", [2, 1024])
def test_repair(spark, most):
    """Chunks of two rows, so that costs and states pass through many chunks, and whole conversations at once."""
    rng = random.Random(7)
    talks = {i: talk(rng, rng.choice([1, 2, 3, 5, 8, 30])) for i in range(40)} | {100: talk(rng, 900), 101: [("user", "x" * 200_000)]}
    df = spark.createDataFrame([(i, t, a, b, "other", 0) for i, rows in talks.items() for t, (a, b) in enumerate(rows)], "conv_id long, turn long, role string, text string, kind string, edits int")
    df = df.repartition(5)
    done = turns.repair(df, most)
    got = {r.conv_id: tuple(r)[1:] for r in turns.summary(df, df, done).collect()}
    assert got == expected(talks)
    lines = {i: [] for i in talks}
    for r in sorted(turns.turns(done).collect()):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert {i: hashlib.sha256("\n".join(x).encode()).hexdigest() for i, x in lines.items()} == {i: x[-1] for i, x in got.items()}


def test_repair_odd_rows(spark):
    """Nulls in each column, turns that repeat, a hot conversation of one text, a conversation id of strings, an empty table."""
    kind = "conv_id string, turn long, role string, text string"
    rows = [("a", None, "user", "Hi."), ("a", 0, None, "Hm."), ("a", 3, "assistant", None), ("a", 3, "assistant", "B."), ("a", 3, "assistant", "A."), (None, 0, "user", "No."), (None, 1, "assistant", "Yes.")] + [("hot", 2, "user", "Same.")] * 3000
    df = spark.createDataFrame(rows, kind)
    got = {r.conv_id: r for r in turns.summary(df, df, turns.repair(df)).collect()}
    want = expected({"a": [("user", "Hi."), (" ", "Hm."), ("assistant", " "), ("assistant", "A."), ("assistant", "B.")], None: [("user", "No."), ("assistant", "Yes.")], "hot": [("user", "Same.")] * 3000})
    assert got["a"].gaps == 2 and got[None].audit == "KK" and got["hot"].cost == 4 * 2999 + 3
    assert {i: tuple(r)[2:] for i, r in got.items()} == {i: x[1:] for i, x in want.items()}
    none = spark.createDataFrame([], kind)
    assert turns.summary(none, none, turns.repair(none)).count() == 0


def test_damage(spark):
    rows = [(i, t, ["system", "user", "assistant"][t % 3], f"What {t}? No.") for i in range(60) for t in range(6)] + [(7, None, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for i, t, a, b in rows:
        k = zlib.crc32(f"{i}:{' ' if t is None else t}".encode()) % 20
        b = " " if b is None else b
        if k:
            want += [(i, -1 if t is None else t, "user" if k == 4 else a, "" if k == 1 else re.sub("[.!?]", "", b) if k == 2 else b)] * (2 if k == 3 else 1)
    got = [(r.conv_id, -1 if r.turn is None else r.turn, r.role, r.text) for r in turns.damage(df).collect() for _ in range(r.n)]
    assert sorted(got) == sorted(want)


def test_hypergeometric_of_large_populations():
    """The drawing for populations beyond numpy's has the mean and variance that it must have, whichever way it ends."""
    rng = np.random.default_rng(3)
    for good, bad, n, draws in ((6 * 10**11, 4 * 10**11, 3 * 10**9, 400), (2 * 10**12, 10**9, 10**12, 400), (3 * 10**9, 10**9, 2000, 400)):
        x = np.array([shards.hypergeometric(rng, good, bad, n) for _ in range(draws)], float)
        p, all_ = good / (good + bad), good + bad
        sd = (n * p * (1 - p) * (all_ - n) / (all_ - 1)) ** 0.5
        assert abs(x.mean() - n * p) < 5 * sd / draws**0.5 and 0.8 < x.std() / sd < 1.25
    assert shards.hypergeometric(rng, 0, 5, 3) == 0 and shards.hypergeometric(rng, 5, 0, 3) == 3
    room = np.array([2 * 10**9, 10**9, 5])
    m = shards.matrix(rng, [10**9, 2 * 10**9, 5], room)
    assert (m.sum(0) == room).all() and m.sum(1).tolist() == [10**9, 2 * 10**9, 5] and (m >= 0).all()


@pytest.mark.parametrize("n, bits", [(1000, (4, 3, 5)), (39, (20, 18, 256)), (0, (20, 18, 256))])
def test_shards(spark, n, bits):
    """Exact sizes, slots without gaps, every row once, the same on a second run, another order by another seed."""
    rows = [(i % 7 if i % 2 else None, None if i % 5 == 0 else "t" * (i % 3), i) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot long").withColumnRenamed("slot", "_n").repartition(6, "_n")
    out = [(r.shard, r.slot, r._n) for r in shards.shuffled(df, 40, 1, *bits).collect()]
    per = {s: sorted(b for a, b, _ in out if a == s) for s in range(40)}
    assert sorted(x for *_, x in out) == list(range(n))
    assert all(per[s] == list(range(n // 40 + (s < n % 40))) for s in per)
    assert sorted(out) == sorted((r.shard, r.slot, r._n) for r in shards.shuffled(df, 40, 1, *bits).collect())
    if n == 1000:
        assert sorted(out) != sorted((r.shard, r.slot, r._n) for r in shards.shuffled(df, 40, 2, *bits).collect())


def test_shards_are_uniform(spark):
    """Rows of a place go to each shard and slot alike, over many seeds; counts are those of a permutation, not of free draws."""
    df = spark.range(12).repartition(2).withColumn("shard", F.lit(0))
    hits = np.zeros((12, 3), int)
    for seed in range(60):
        for r in shards.shuffled(df, 3, seed, 1, 18, 2).collect():
            hits[r.id, r.shard] += 1
    assert hits.sum(0).tolist() == [240, 240, 240]  # four rows a shard each time
    chi = ((hits - 20) ** 2 / 20).sum()
    assert chi < 60  # 22 degrees of freedom or so

