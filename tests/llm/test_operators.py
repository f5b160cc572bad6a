"""Corpus operators against plain versions and on odd inputs."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.llm import common, decontaminate, fingerprint, jaccard, language, licenses, lines, lm, packing, substrings, tokenids

LOW = {k: k + 32 for k in range(65, 91)}


def frame(spark, rows):
    """Documents with an extra column whose name operators use themselves."""
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long")


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "word " * 20000), (6, "same text here"), (7, "same text here"), (None, "no id")]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_rows(spark, rows):
    df = frame(spark, rows)
    items = spark.createDataFrame([("a", "one"), ("b", None)] if rows else [], "item_id string, text string")
    want = sorted(i for i, _ in rows if i is not None)
    model = language.fit(df.withColumn("lang", df.text.substr(1, 0)))
    for out in (
        decontaminate.contamination(df, items), fingerprint.edited(df), fingerprint.fingerprints(df), language.predict(df, model), lm.score(df, df), licenses.scan(df),
        jaccard.links_components(df), substrings.dedup(df),
    ):
        assert sorted(r.doc_id for r in out.collect()) == want
    assert sorted({r.doc_id for r in packing.pack(df).collect()}) == want
    assert lines.dedup(df).count() == len(rows)


def test_simple8b():
    rng = np.random.default_rng(1)
    for n in (0, 1, 59, 60, 240, 241, 3000):
        for v in (rng.integers(0, 50257, n), np.zeros(n), rng.integers(0, 2, n), np.where(rng.random(n) < 0.1, rng.integers(0, 2**63, n), 3)):
            v = v.astype(np.uint64)
            w = tokenids.encode(v)
            assert (tokenids.decode(w) == v).all()
            if n > 2000:
                assert (tokenids.decode_from(w, tokenids.group_offsets(w), 1500, 700) == v[1500:2200]).all()


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t in enumerate(["", "a  b", "x y.\nZ w,", " lead", "tail ", "it's <|endoftext|> b", "é è ä. 12 3", None, "b\n c", "日本 語"])]
    path = str(tmp_path / "ids")
    tokenids.write(frame(spark, rows), path, tokenids.vocabulary(), 2, block_ids=5)
    got = {r.doc_id: r for r in tokenids.read(spark, path, ids=True).collect()}
    tok, start = Tokenizer.from_file(tokenids.vocabulary()), 0
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i].ids == ids and got[i].start == start and got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_packing(spark):
    random.seed(0)
    rows = [(i, " ".join(random.choice(["ab", "cd", "ef"]) for _ in range(random.randint(0, 900)))) for i in range(80)]
    got = packing.pack(frame(spark, rows), size=128).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for x in by.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 128
    assert sum(r.length for r in got) / (128 * len(by)) > 0.95


def test_trie(spark):
    random.seed(3)
    rows = [(i, "".join(random.choice("abcd e") for _ in range(random.randint(0, 60)))) for i in range(40)] + [(90, None), (91, "É zz")]
    df = frame(spark, rows)
    seen, wc, nd = [{} for _ in range(5)], Counter(), 0
    for i, t in rows:
        if i % 3 == 0:
            continue
        nd += 1
        x = [256] * 4 + list((t or "").translate(LOW).encode()) + [256]
        wc.update(words((t or "").translate(LOW)))
        for p in range(4, len(x)):
            for k in range(5):
                d = seen[k].setdefault(tuple(x[p - k : p]), {})
                d[x[p]] = d.get(x[p], 0) + 1
    for common in (1 << 20, 3):
        got = {r.doc_id: r for r in lm.score(df, df.where("doc_id % 3 <> 0"), common=common).collect()}
        total, distinct = sum(wc.values()) + nd, len(wc) + 1
        for i, t in rows:
            x = [256] * 4 + list((t or "").translate(LOW).encode()) + [256]
            assert abs(got[i].score - sum(lm.plain_step(seen, x, p, 4) for p in range(4, len(x)))) < 1e-6
            base = sum(np.log10((c + 0.1) / (total + 0.1 * (distinct + 1))) for c in [wc[w] for w in words((t or "").translate(LOW))] + [nd])
            assert abs(got[i].base_score - base) < 1e-6 and got[i].train_tokens == total
    for r in lm.score(df, df.where("false")).collect():  # nothing learnt: 257 symbols, equally likely
        n = len((dict(rows)[r.doc_id] or "").encode()) + 1
        assert abs(r.score + n * np.log10(257)) < 1e-6 and (r.n_known, r.train_tokens) == (0, 0)


def test_commonest(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 50 + [2] * 20 + [900] * 3)], "gram long, n long")
    assert [lm.commonest(df, m).count() for m in (100, 73, 72, 23, 22, 3, 2)] == [73, 73, 23, 23, 3, 3, 0]


def noisy(seed):
    random.seed(seed)
    out = []
    for g in range(12):
        base = [random.choice(["ab", "cd", "ef", "gh"]) + str(random.randint(0, 9)) for _ in range(random.randint(1, 60))]
        for c in range(random.randint(1, 8)):
            w = list(base)
            for _ in range(random.randint(0, 3)):
                w[random.randrange(len(w))] = random.choice("xyz") + str(random.randint(0, 99))
            out.append((len(out) * 7, " ".join(w).upper() if c % 3 == 0 else "  ".join(w)))
    return out


def test_jaccard(spark):
    rows = noisy(5)
    sets = {}
    for i, t in rows:
        w = words(t.translate(LOW))
        sets[i] = {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j:
                n = len(sets[i] & sets[j])
                if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                    a, b = root(i), root(j)
                    up[max(a, b)] = min(a, b)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.links_components(frame(spark, rows)).collect()} == {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("hot", [5000, 2])
def test_substrings(spark, hot):
    random.seed(4)
    base = [[random.choice("abcdefghij") + str(random.randint(0, 3)) for _ in range(random.randint(30, 120))] for _ in range(5)]
    rows = []
    for i in range(40):
        w = []
        for _ in range(random.randint(0, 4)):
            b = random.choice(base)
            a = random.randint(0, len(b) - 1)
            w += b[a : a + random.randint(5, 90)] + [str(random.random()) for _ in range(random.randint(0, 20))]
        rows.append((i, " ".join(w)))
    rows += [(102, "x " * 80), (104, "é\n" * 36)]
    count = Counter(tuple(w[i : i + 35]) for w in (words(t) for _, t in rows) for i in range(len(w) - 34))
    got = {r.doc_id: r for r in substrings.dedup(frame(spark, rows), hot=hot, shard_words=500).collect()}
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        assert got[d].kept == " ".join(x for i, x in enumerate(w) if i not in gone) and got[d].n_removed == len(gone)


def test_lines(spark):
    rows = [(1, "The first line of a text is here\nsecond one"), (2, "the first line\n\nThe first line of a text is here"), (3, "second  one \nThe first line of a text is there"), (4, None)]
    got = {r.row.doc_id: r.row.text for r in lines.dedup(frame(spark, rows)).collect()}
    assert got[1] == rows[0][1] and got[2] == "the first line\n" and got[4] is None and "second" not in got[3]


def test_lines_of_mixed_bands(spark):
    """Many lines share most of a form, and each has a near copy: all near copies meet, though few lines lead a band."""
    random.seed(7)
    word = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    form, made = [word() for _ in range(24)], []
    for _ in range(60):
        own = [word() for _ in range(16)]
        made += [form + own, [*form, *own[:-1], word()]]
    sets = [{" ".join(x)[m:][:12] for m in [sum(len(w) + 1 for w in x[:i]) for i in range(len(x))]} for x in made]
    least = list(range(len(made)))
    for i in range(len(made)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((least[i], least[j]))
                least = [low if x == high else x for x in least]
    got = lines.duplicates(frame(spark, [(i, " ".join(x)) for i, x in enumerate(made)])).collect()
    assert {(r.doc_id, r.first_doc) for r in got} == {(i, x) for i, x in enumerate(least) if x != i} and len(got) == 60


def test_lines_that_are_not_similar_are_not_compared(spark, monkeypatch):
    """Lines that share two thirds of their shingles meet in bands, but few pairs of texts are moved behind the leaders'; similar lines all meet."""
    random.seed(3)
    word = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    form, moved, similar = [word() for _ in range(40)], [], lines.similar

    def counted(pairs, docs, percent):
        kept = common.keep(pairs)
        moved.append(kept.count())
        return similar(kept, docs, percent)

    monkeypatch.setattr(lines, "similar", counted)
    made = [form + [word() for _ in range(10)] for _ in range(120)]
    made += [[*x[:-1], word()] for x in made[:20]]
    got = lines.duplicates(frame(spark, [(i, " ".join(x)) for i, x in enumerate(made)])).collect()
    assert {(r.doc_id, r.first_doc) for r in got} == {(120 + i, i) for i in range(20)}
    assert sum(moved[1:]) <= 100  # behind the first two leaders of each band


def test_bands_are_shuffled_without_whole_sketches(spark, monkeypatch):
    """Lines of bands of several components go to their bands once, with half of their sketches at most."""
    random.seed(3)
    word = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    form, plans, keep = [word() for _ in range(40)], {}, common.keep

    def planned(df, name="kept", *more):
        plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString() if name in ("pairs", "met") else "")
        return keep(df, name, *more)

    monkeypatch.setattr(common, "keep", planned)
    made = [form + [word() for _ in range(10)] for _ in range(60)]
    made += [[*x[:-1], word()] for x in made[:10]]
    got = lines.duplicates(frame(spark, [(i, " ".join(x)) for i, x in enumerate(made)])).collect()
    assert {(r.doc_id, r.first_doc) for r in got} == {(60 + i, i) for i in range(10)}
    by_band = [line for p in plans["pairs"] + plans.get("met", []) for line in p.split("\n") if re.search(r"Join Inner, .*\(band", line)]
    assert by_band and not any("wide" in line for line in by_band) and sum("half" in line for line in by_band) == 4


def test_sketches_leave_no_similar_pair_out(spark):
    """Sizes of all sketches, folded and not: whatever a pair's likeness, it stays if it is similar."""
    random.seed(5)
    rows = []
    for size in (3, 40, 120, 131, 240, 260, 500, 530, 1000, 1100, 2500):
        x = random.choices("abcdefgh_\u00e9", k=size)
        for part in (0.0, 0.01, 0.03, 0.05, 0.1, 0.2, 0.3):
            rows.append("".join(random.choice("xyz") if random.random() < part / 3 else c for c in x[: len(x) - int(part * size)]) or "x")
    rows = sorted(set(rows))
    known = {lines.id_of(x): {x[j : j + 5] for j in range(max(1, len(x) - 4))} for x in rows}
    made = lines.with_sketch(spark.createDataFrame([(i,) for i in known], "id long"), frame(spark, list(enumerate(rows)))).select("id", F.col("wide").alias("w"))
    got = {(r.x, r.y): r.p for r in made.select(F.col("id").alias("x"), F.col("w").alias("w1")).crossJoin(made.select(F.col("id").alias("y"), F.col("w").alias("w2"))).select("x", "y", lines.possible("w1", "w2", 75).alias("p")).collect()}
    like = {(x, y): len(known[x] & known[y]) / len(known[x] | known[y]) for x, y in got}
    assert len(got) == len(rows) ** 2 and sum(v >= 0.75 for v in like.values()) > len(rows) * 1.5
    assert all(got[p] for p, v in like.items() if v >= 0.75) and not any(got[p] for p, v in like.items() if v < 0.5)


def test_lines_without_blanks(spark):
    """All of a line counts, not only what begins a word."""
    han = "".join(chr(0x4E00 + 37 * i) for i in range(60))
    rows = ["https://example.com/a/report-1", "https://example.com/b/other-page", han[:30], han[:12] + han[40:58], "同" + han[1:30]]
    got = lines.duplicates(frame(spark, list(enumerate(rows)))).collect()
    assert {(r.doc_id, r.first_doc) for r in got} == {(4, 2)}


def test_lines_with_a_typo(spark):
    """Most short lines meet their copies with one letter replaced."""
    random.seed(11)
    made = []
    for i in range(200):
        x = " ".join("".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(3, 8))) for _ in range(9))
        at = random.choice([j for j, c in enumerate(x) if c != " "])
        made += [(2 * i, x), (2 * i + 1, x[:at] + "#" + x[at + 1 :])]
    got = lines.duplicates(frame(spark, made)).collect()
    assert all(r.doc_id == r.first_doc + 1 for r in got) and len(got) >= 190


def test_lines_meet_in_few_bands_if_they_are_not_similar(spark, monkeypatch):
    """Lines of the same few words share bands by chance; such pairs grow with the square of the lines, so they must be rare. Texts are read again once."""
    random.seed(21)
    word = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    bag, kept, reads, keep, wanted = [word() for _ in range(60)], {}, [], common.keep, lines.wanted

    def counted(df, name="kept", *more):
        out = keep(df, name, *more)
        kept[name] = kept.get(name, 0) + (out.count() if name == "bands" else 0)
        return out

    monkeypatch.setattr(common, "keep", counted)
    monkeypatch.setattr(lines, "wanted", lambda *x: reads.append(1) or wanted(*x))
    made = [random.choices(bag, k=12) for _ in range(1500)]
    long = [word() for _ in range(60)]
    made += [[*long[:-1], f"{i}xyz"] for i in range(30)]
    got = lines.duplicates(frame(spark, [(i, " ".join(x)) for i, x in enumerate(made)])).collect()
    sets = [{" ".join(x)[j : j + 5] for j in range(len(" ".join(x)) - 4)} for x in made]
    assert {(r.doc_id, r.first_doc) for r in got if r.doc_id >= 1500} == {(i, 1500) for i in range(1501, 1530)}
    assert all(100 * len(sets[r.doc_id] & sets[r.first_doc]) >= 60 * len(sets[r.doc_id] | sets[r.first_doc]) for r in got)
    assert kept["bands"] <= 1500 + 30 * lines.BANDS * 3 and len(reads) == 1


def test_bands_find_lines_that_are_just_similar():
    """Pairs of a similarity of 0.75 to 0.78, of short and long lines, share a band but for one in a hundred."""
    random.seed(13)
    one, two = [], []
    while len(one) < 3000:
        x = "".join(random.choices("abcdefghijklmnop", k=random.choice((12, 30, 60, 120, 400))))
        y = list(x)
        for at in random.sample(range(len(x)), max(1, len(x) // 33)):
            y[at] = "z"
        y = "".join(y)
        a, b = ({z[j : j + 5] for j in range(len(z) - 4)} for z in (x, y))
        if 0.75 <= len(a & b) / len(a | b) < 0.78:
            one.append(x)
            two.append(y)
    assert (lines.keys(one) == lines.keys(two)).any(1).mean() >= 0.99 and lines.alike(one, two, 75).all() and not lines.alike(one, two, 79).any()


def test_lines_of_a_band_meet():
    """Packed rows give all pairs of small bands, leaders of large ones, and nothing of repeated rows."""
    rng = np.random.default_rng(4)
    ids = rng.integers(-(2**62), 2**62, 400)
    key = rng.integers(0, 2**64, 60, dtype=np.uint64)[rng.integers(0, 60, (400, lines.BANDS)) ** 2 // 60]
    twice = np.concatenate([key, key[:50]]), np.concatenate([ids, ids[:50]])
    lots = [lines.packed(k.reshape(-1), i, 5) for k, i in ((key, ids), (key[:50], ids[:50]))]
    rows = [r for b in lines.met(iter(lots)) for r in b.to_pylist()]
    held = {}
    for k, i in zip(*twice, strict=True):
        for x in k.tolist():
            held.setdefault(x, set()).add(int(i))
    want, large = set(), set()
    for k, s in held.items():
        if len(s) <= lines.FEW:
            want |= set(itertools.combinations(sorted(s), 2))
        else:
            want |= {(min(s), x) for x in s - {min(s)}} | {(x, max(s)) for x in s - {max(s)}}
            large |= {(x, (k & 0xFFFFFFFF) | ((k >> 32) * 5 >> 32) << 32) for x in s}
    assert {(r["x"], r["y"]) for r in rows if r["band"] is None} == want and {(r["x"], r["band"]) for r in rows if r["band"] is not None} == large


def test_bit_map_has_all_ids(spark):
    ids = [random.Random(i).getrandbits(63) - 2**62 for i in range(500)]
    held, bits = lines.marks(spark.createDataFrame([(i,) for i in ids], "id long"), 1 << 20)
    slot = np.array(ids) & ((1 << bits) - 1)
    assert bits == 25 and len(held) == 1 << 22 and sum(x.bit_count() for x in held) == len(set(slot.tolist())) and all(held[s >> 3] >> (s & 7) & 1 for s in slot.tolist())


def test_decontamination(spark):
    item = " ".join(f"w{i}" for i in range(14))
    docs = [(1, "a b " + " ".join(f"W{i}" for i in range(2, 12)) + " c"), (2, " ".join(f"w{i}" for i in range(9))), (3, "x short item y"), (4, "shortitem")]
    items = spark.createDataFrame([(1, item), (2, "short item"), (3, None)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(frame(spark, docs), items).collect()}
    assert got == {1: (10, ["1"]), 2: (0, []), 3: (2, ["2"]), 4: (0, [])}


def test_licenses(spark):
    keys = {k for _, _, k, _ in licenses.rules()}
    assert len(licenses.rules()) > 200 and all(any(g.split(" ")[0] in k for g in licenses.gates()) for k in keys)
    rows = [(1, "MIT License MIT license, cc by cc by"), (2, "Licensed under CC BY-NC 4.0."), (3, "GNU lesser general public license"), (4, "nothing"), (5, "apache\n license")]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels) == (4, 0, 6, "cc-by,mit")
    assert got[2].labels == "cc-by,cc-by-nc" and got[3].labels == "lgpl" and got[4].labels == "" and got[4].first_word is None and got[5].n_base == 1


def samples(tree):
    """Texts of a parsed regular expression: each alternative, each optional part with and without."""
    parts = []
    for op, arg in tree:
        match str(op):
            case "LITERAL":
                parts.append([chr(arg)])
            case "NOT_LITERAL":
                parts.append(["w"])
            case "IN":
                parts.append(["w"] if str(arg[0][0]) == "NEGATE" else [chr(a) if str(o) == "LITERAL" else chr(a[0]) if str(o) == "RANGE" else "3" for o, a in arg])
            case "BRANCH":
                parts.append([s for b in arg[1] for s in samples(b)])
            case "SUBPATTERN":
                parts.append(samples(arg[3]))
            case "MAX_REPEAT" | "MIN_REPEAT":
                parts.append([""] * (arg[0] == 0) + [s * max(arg[0], 1) for s in samples(arg[2])])
    return ["".join(x) for x in itertools.product(*parts)]


def test_license_keywords(spark):
    """No match of a rule lacks all of its keywords or all gates, so what is gated finds as much as what isn't."""
    starts = [g.split(" ")[0] for g in licenses.gates()]
    for label, _, key, pattern in licenses.rules():
        texts = [s for s in samples(re._parser.parse(pattern)) if re.search(pattern, s)]
        assert texts, label
        for s in texts:
            assert any(k in s for k in licenses.keywords(key)) and any(g in s for g in starts), (label, s)
    rows = ["MIT licence", "X11 licence", "zero clause BSD", "zero-clause BSD", "beerware license", "open rail", "with llvm-exception", "mit license with advertising", "bsd-3-clause-clear", "do what the fuck you want to public license"]
    want = ["mit", "x11", "0bsd", "0bsd", "beerware", "openrail", "apache-2.0-llvm-exception", "mit-advertising", "bsd-3-clause-clear", "wtfpl"]
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(frame(spark, list(enumerate(rows)))).collect()}
    assert all(w in got[i] for i, w in enumerate(want))


def test_language(spark):
    random.seed(1)
    one, two = ["thing", "that", "where", "house"], ["stück", "nicht", "über", "haus"]
    rows = [(i, " ".join(random.choice(one if i % 2 else two) for _ in range(30)), "en" if i % 2 else "de") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df.where("doc_id < 40"))
    got = {r.doc_id: r for r in language.predict(df.unionByName(spark.createDataFrame([(99, "12 !!", None)], df.schema)), model).collect()}
    assert all(got[i].lang_pred == v for i, _, v in rows) and got[99].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())


def test_fingerprints(spark):
    random.seed(2)
    rows = [(i, " ".join(random.choice("abcdefghijklmnop") * random.randint(1, 5) + str(random.randint(0, 999)) for _ in range(400))) for i in range(6)]
    got = {r.doc_id: r for r in fingerprint.edited(frame(spark, rows + [(9, rows[0][1])])).collect()}
    assert got[0].fingerprint == got[9].fingerprint and got[0].near_next == 1 and all(r.near_edited > r.near_next for i, r in got.items() if i)


def plain_levels(raw, window):
    """Entropy levels of all windows of one text, counted anew for each."""
    out = []
    for i in range(len(raw) - window + 1):
        c = np.bincount(np.frombuffer(raw[i : i + window], np.uint8), minlength=256)
        c = c[c > 0] / window
        out.append(-(c * np.log2(c)).sum() * (fingerprint.LEVELS - 1) / np.log2(window))
    return np.array(out)


def test_entropy_and_features():
    rng = random.Random(5)
    raw = [bytes(rng.choice(b"abcdefghij \n") for _ in range(n)) for n in (700, 90, 15, 300)]
    ptr = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    for x in raw[:2]:
        assert (np.abs(fingerprint.levels(np.frombuffer(x, np.uint8)) - plain_levels(x, 64)) <= 0.51).all()
    rank = fingerprint.rarity(np.arange(fingerprint.LEVELS))
    (fine, f), (coarse, c) = fingerprint.features(np.frombuffer(b"".join(raw), np.uint8), ptr, rank)
    assert list(np.diff(c) > 0) == [True, False, False, True] and (np.diff(f) > 0).all() and f[3] - f[2] == 1
    # the coarse features of one text, run by run
    key = rank[fingerprint.levels(np.frombuffer(raw[0], np.uint8))].astype(int)
    score = Counter(int(i + np.argmin(key[i : i + 64])) for i in range(len(key) - 63))
    assert c[1] - c[0] == max(1, sum(v >= fingerprint.POPULAR for v in score.values()))


def test_no_size_parts_near_copies():
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(600)).encode()
    rank = fingerprint.rarity(np.arange(fingerprint.LEVELS))
    for n in (20, 60, 250, 505, 511, 1015, 2000):
        a, b, other = fingerprint.of_texts([text[:n], text[: n + 15], text[-n:]], rank)
        # a text of 20 bytes is no near copy of one of 35
        assert fingerprint.likeness(a, b) > (0.8 if n > 20 else 0.2) and fingerprint.likeness(a, a) == 1 and fingerprint.likeness(a, other) < 0.3


def test_packing_against_tokenizer(spark):
    from tokenizers import Tokenizer

    random.seed(3)
    rows = [(i, " ".join(random.choice(["alpha", "x1,", "Zed\n", "é"]) for _ in range(random.choice([0, 1, 40, 700])))) for i in range(60)] + [(70, None), (3, "twice the id")]
    tok = Tokenizer.from_file(packing.vocabulary())
    want = Counter()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(ids), 128):
            part = ids[at : at + 128]
            want[i, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    got = packing.pack(frame(spark, rows), size=128).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    taken = sorted((r.sequence_id, r.offset + k) for r in got for k in range(r.length))
    assert len(taken) == len(set(taken))


def test_license_words(spark):
    """The base columns against places counted one by one, and labels of texts in which rules overlap."""
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    random.seed(4)
    bag = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "MIT", "License,", "the", "x-y", "\u00e9t\u00e9", "\n"]
    rows = [(i, " ".join(random.choice(bag) for _ in range(random.randint(0, 60)))) for i in range(150)] + [(500, None), (501, ""), (502, "mit license " * 4000)]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
        places = [(k, v) for p, v in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({v for _, v in places})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_rows_that_share_an_id_keep_their_own_text(spark):
    """Two texts under one doc_id: what one loses, or is marked for, isn't the other's."""
    a, b = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    df = frame(spark, [(1, a), (1, b), (2, a), (3, b + " tail"), (3, "free text")])
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.dedup(df).collect())
    assert got == [(1, 80, 80), (1, 80, 80), (2, 80, 80), (3, 2, 0), (3, 81, 80)]
    one = frame(spark, [(1, a), (1, b), (2, a)])
    kept = {(r.doc_id, r.n_removed): r.kept for r in substrings.dedup(one).collect()}
    assert kept == {(1, 80): "", (1, 0): b, (2, 80): ""}
    items = spark.createDataFrame([("x", " ".join(a.split()[20:40])), ("y", " ".join(a.split()[35:50]))], "item_id string, text string")
    rows = sorted((r.doc_id, r.n_hit, [tuple(s) for s in r.spans], r["items"]) for r in decontaminate.contamination(one, items).collect())
    assert rows == [(1, 0, [], []), (1, 30, [(20, 50)], ["x", "y"]), (2, 30, [(20, 50)], ["x", "y"])]


def plain_histogram(texts):
    """Levels of all windows of each scale, by the definition of entropy."""
    out = np.zeros((2, fingerprint.LEVELS), int)
    for t in texts:
        raw = (t or "").encode()
        for scale, window in ((0, fingerprint.WINDOW), (1, fingerprint.FINE[0])):
            if len(raw) >= window and (scale == 0 or len(raw) < fingerprint.FINE_BELOW):
                out[scale] += np.bincount(np.rint(plain_levels(raw, window)).astype(int), minlength=fingerprint.LEVELS)
    return out


def test_each_scale_has_its_own_histogram(spark):
    rng = random.Random(6)
    texts = [None, "", "short", "a" * 300] + ["".join(rng.choice("abcdefgh é.") for _ in range(rng.choice([15, 16, 40, 300, 1000, 1500]))) for _ in range(40)]
    got, want = fingerprint.histogram(frame(spark, list(enumerate(texts)))), plain_histogram(texts)
    assert (got.sum(1) == want.sum(1)).all()
    # a level may round the other way, to its neighbour
    assert np.abs(np.cumsum(got, 1) - np.cumsum(want, 1)).max() <= 0.02 * want.sum()
    rank = fingerprint.rarity(got)
    assert rank.shape == got.shape and (rank[0] != rank[1]).any()


def test_edited_texts(spark):
    """Pairing, lengths, hashes and likenesses of the edited texts, one after another by the definition."""
    import hashlib

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(2, 9)))
    texts = {i: " ".join(word() for _ in range(rng.choice([0, 3, 40, 200, 500]))) for i in range(0, 60, 2)} | {61: None, 63: "x"}
    texts[64] = texts[8]
    df = frame(spark, list(texts.items()))
    rank = fingerprint.rarity(fingerprint.histogram(df))
    got = {r.doc_id: r for r in fingerprint.edited(df).collect()}
    order = sorted(texts, reverse=True)
    for i, nxt in zip(order, order[1:] + order[:1]):
        a, b = texts[i] or "", texts[nxt] or ""
        half = len(a) // 2
        new = a[: len(a) - half] + b[:half]
        one, two, other = fingerprint.of_texts([a.encode(), new.encode(), b.encode()], rank)
        assert (got[i].n_chars, got[i].edited_sha256) == (len(a), hashlib.sha256(new.encode()).hexdigest())
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (fingerprint.text_of(one), fingerprint.text_of(two))
        assert abs(got[i].near_edited - fingerprint.likeness(one, two)) < 1e-9 and abs(got[i].near_next - fingerprint.likeness(one, other)) < 1e-9
    assert got[8].fingerprint == got[64].fingerprint


def plain_languages(train, texts):
    """Language and score by sets of n-grams in place of filters."""
    def grams(t):
        raw = bytes(c if 97 <= c <= 122 or c > 127 else 32 for c in (t or "").translate(LOW).encode())
        x = b" " + b" ".join(raw.split()) + b" "
        return [x[i : i + k] for k in (3, 4) for i in range(len(x) - k + 1) if 32 not in x[i + 1 : i + k - 1]]

    n = {v: Counter(g for t, w in train if w == v for g in grams(t)) for v in {w for _, w in train}}
    rate = {v: {g: c / sum(x.values()) for g, c in x.items()} for v, x in n.items()}
    has = {v: {g for g, c in n[v].items() if c >= 2 and r[g] >= 2e-6 and r[g] >= 0.1 * max(q.get(g, 0) for q in rate.values())} for v, r in rate.items()}
    for t in texts:
        g = grams(t)
        s = sorted(((sum(x in has[v] for x in g) / max(len(g), 1), v) for v in has), key=lambda x: (-x[0], x[1]))
        yield s[0][1], s[0][0] * (1 - 0.5 * s[1][0] / s[0][0]) if s[0][0] else 0.0


def test_language_against_sets(spark):
    rng = random.Random(4)
    vocab = {v: ["".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(150)] for v, a in (("aa", "abcdef"), ("bb", "defghi"), ("cc", "éèbcxyz"))}
    say = lambda v, n: " ".join(rng.choice(vocab[v]).title() + rng.choice(["", ",", " 7"]) for _ in range(n))
    train = [(say(v, 60), v) for v in vocab for _ in range(20)]
    texts = [say(v, n) for v in vocab for n in (1, 5, 80)] + [say("aa", 9) + " " + say("bb", 8), "kkkk qqqq", None, "", "12 !!"]
    rows = [(i, t, v) for i, (t, v) in enumerate(train)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(frame(spark, list(enumerate(texts))), model).collect()}
    want = list(plain_languages(train, texts))
    for i in range(10):
        assert got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 0.02
    assert got[10][1] == 0 and [got[i] for i in (11, 12, 13)] == [("und", 0.0)] * 3


def test_many_and_rare_languages(spark):
    """More languages than a mask has bits, one of them in a single row among thousands of another."""
    word = lambda i: chr(97 + i % 26) + chr(97 + i // 26) + chr(97 + (7 * i) % 26) + "q"
    rows = [(i, f"{word(i)} {word(i)} {word(i)}x", f"l{i:02d}") for i in range(70)] + [(100 + i, word(0) + " " + word(0), "l00") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, sample=500)
    assert len(model.langs) == 70 and model.masks.shape[0] == 2
    got = {r.doc_id: r.lang_pred for r in language.predict(df.where("doc_id < 70"), model).collect()}
    assert sum(got[i] == f"l{i:02d}" for i in range(70)) >= 65 and got[69] == "l69"


def test_large_sets_that_only_share_a_shingle_are_not_listed_anew(spark):
    import pyarrow as pa

    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(10**9)}" for _ in range(1500)) for _ in range(4)]
    near = texts[3].split(" ")
    near[700:750] = ["other"] * 50
    few = texts[0].split(" ")[:40]
    s = jaccard.Sets(pa.array([*texts, " ".join(near), " ".join(few), " ".join([*few, "more"])]), 5)
    sketches = s.sketches()
    rows = [(i, int(n), bytes(k), jaccard.small_sketch(k).tolist()) for i, (n, k) in enumerate(zip(s.size, sketches, strict=True))]
    whole = spark.createDataFrame(rows, "x long, n long, sketch binary, small array<long>")
    cur = whole.selectExpr("cast(if(n < 100, 2, 1) as long) as token", "x", "x as c", "n", "0 as pos", "if(n < 100, 10L, 300L) as listed")
    found = jaccard._open(cur, whole.select("x", "small"), whole.select("x", "n", "sketch"), 75)
    assert {row.x for row in found.collect()} == {3, 4, 5, 6}


def test_workers_give_memory_back(monkeypatch):
    import pyarrow as pa

    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batch = pa.record_batch([pa.array(["one", "two", "three"])], names=["text"])
    assert [b.num_rows for b in common.slices(iter([batch]), 4)] == [1, 1, 1] and calls == [1]
    assert [b.num_rows for b in common.short(iter([batch]), 2)] == [2, 1] and calls == [1, 1]
    assert language.SLICE < 1 << 20
