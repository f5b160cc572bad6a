"""Conversation structure repair: least edits over the DAG of tight arcs, followed from both ends.

A conversation's rows, in order, are read by an automaton of four states (start, after system, after user, after assistant)
that takes role initials ``(s?(ua)+)?``. A node is a row boundary and a state; arcs keep, re-role or delete the next row, or
insert a turn. Least costs from the start (forward) and to the end (backward) tell the tight arcs, those of some cheapest
repair; from the start, the set of nodes that the edits so far may have led to takes the tight arcs of the least letter.

A conversation may hold any share of all rows, so rows are dealt by ranges of (conversation, turn) and cut into chunks. A
chunk's costs between its ends are a 4 x 4 matrix; matrices are multiplied along a conversation from both sides, one small row
for a chunk, so each chunk then knows the costs at its ends and finds its own tight arcs. The grammar moves each state by each
letter in one way only, so a frontier that starts as one state stays one, and a chunk's traversal is a map from state to state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import common as C

# Costs of the edits, white space, what ends a turn, initials that may follow one another.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
WHITE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
LEGAL = ("su", "ua", "au")

FAR = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
#: State and initial -> next state.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: From each state, what may be written by an inserted or re-roled turn.
WRITES = {q: [(r, NEXT[q, r[0]]) for r in ("assistant", "user") if (q, r[0]) in NEXT] for q in range(4)}
END = (0, 6, 3, 0)
ROWS, BYTES = 1024, 1 << 20

Item = tuple[str, bool, bool, int]  # initial, must go, truncated, copies (of what must go)


def row_arcs(q: int, item: Item) -> list[tuple[str, int, int, str]]:
    """Arcs that take a row from state q: edit, next state, cost, new role (empty: its own)."""
    initial, gone, cut, n = item
    arcs = [("D", q, DELETE * n, "")]
    if not gone:
        more = CUT * cut
        if (q, initial) in NEXT:
            arcs.append(("K", NEXT[q, initial], KEEP + more, ""))
        arcs += [("R", to, REROLE + more, role) for role, to in WRITES[q]]
    return arcs


_ARCS = {(q, i, g, c): row_arcs(q, (i, g, c, 1)) for q in range(4) for i in ("s", "u", "a", "?") for g in (False, True) for c in (False, True)}


def _of(q: int, item: Item):
    return _ARCS[q, item[0], item[1], item[2]] if item[3] == 1 else row_arcs(q, item)


def inserted(d: list[int]) -> list[int]:
    """Costs of one layer once turns may be inserted there."""
    d = list(d)
    for q in (START, SYSTEM, ASSISTANT, USER, ASSISTANT):
        for _, to in WRITES[q]:
            d[to] = min(d[to], d[q] + INSERT)
    return d


def forward(d: list[int], items: list[Item]) -> list[list[int]]:
    """Least costs on arrival at each layer, from those at the first one."""
    out = [list(d)]
    for item in items:
        new = [FAR] * 4
        for q, c in enumerate(inserted(out[-1])):
            if c < FAR:
                for _, to, cost, _ in _of(q, item):
                    new[to] = min(new[to], c + cost)
        out.append(new)
    return out


def backward(d: list[int], items: list[Item]) -> list[list[int]]:
    """Least costs from each layer to the end, from those at the last one."""
    out = [list(d)]
    for item in reversed(items):
        new = [min(out[-1][to] + cost for _, to, cost, _ in _of(q, item)) for q in range(4)]
        for q in (ASSISTANT, USER, ASSISTANT, SYSTEM, START):
            for _, to in WRITES[q]:
                new[q] = min(new[q], new[to] + INSERT)
        out.append(new)
    return out[::-1]


def follow(state: int, ahead: list[list[int]], back: list[list[int]], items: list[Item], last: bool) -> tuple[int, list[tuple[str, int, str]]]:
    """The state at the last layer and the edits (letter, item or -1, new role), by the least letter among tight arcs.

    The frontier has all nodes that the letters so far lead to; they are on one layer, as letters but I take a row each.
    """
    reach = [inserted(d) for d in ahead]
    best = min(reach[0][q] + back[0][q] for q in range(4))
    at, front, edits = 0, {state}, []
    while True:
        arcs = []
        for q in front:
            arcs += [("I", at, to, role) for role, to in WRITES[q] if (at < len(items) or last) and reach[at][q] + INSERT + back[at][to] == best]
            if at < len(items):
                arcs += [(edit, at + 1, to, role) for edit, to, cost, role in _of(q, items[at]) if reach[at][q] + cost + back[at + 1][to] == best]
        if not arcs:
            return min(front), edits
        letter = min(a[0] for a in arcs)
        arcs = [a for a in arcs if a[0] == letter]
        edits.append((letter, -1 if letter == "I" else at, arcs[0][3]))
        at, front = arcs[0][1], {a[2] for a in arcs}


def _items(r: dict) -> list[Item]:
    return [(i, g, c, n) for i, g, c, n in zip(r["initials"], r["gone"], r["cut"], r["copies"])]


def _stream(df: DataFrame, schema: str, start: Callable, rows: int = 4096) -> DataFrame:
    """Rows of each task in their order, one after another, through the function that ``start()`` gives: row (None at the end) -> rows."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, out, size = start(), [], 0
        for b in batches:
            for r in b.to_pylist():
                for x in step(r):
                    out.append(x)
                    size += x.pop("_size", 1)
                if len(out) >= rows or size > 8 * BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out, size = [], 0
        out += [{k: v for k, v in x.items() if k != "_size"} for x in step(None)]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, schema)


def numbered(conversations: DataFrame) -> DataFrame:
    """Distinct rows with what the repair needs to know of each: initial, n (its copies), blank, cut, first (its first copy repeats none)."""
    c = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"), *(["n"] if "n" in conversations.columns else []))
    d = c.groupBy("conv_id", "turn", "role", "text").agg((F.sum("n") if "n" in c.columns else F.count("*")).alias("n"))
    d = d.withColumn("_hash", F.md5("text"))
    low = d.groupBy("conv_id", "role", "_hash").agg(F.min(F.struct(F.col("turn").isNotNull().alias("there"), "turn")).alias("low"))
    low = low.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_hash").alias("_h"), F.col("low.turn").alias("_low"))
    j = d.join(low, d.conv_id.eqNullSafe(low._c) & (d.role == low._r) & (d._hash == low._h))
    end = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    return j.select("conv_id", "turn", "role", "text", "n", F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("initial"), (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(*ENDS)).alias("cut"), F.col("turn").eqNullSafe(F.col("_low")).alias("first"), "_hash")


_CHUNK = "conv_id {id}, ord long, roles array<string>, texts array<string>, initials array<string>, gone array<boolean>, cut array<boolean>, copies array<long>, matrix array<long>, blank long, duplicate long, truncated long, illegal long, head string, tail string"


def _chunker(most: int):
    """Rows of a task, sorted by conversation and turn, to chunks of at most ``most`` rows or about BYTES bytes."""
    part, seq, conv, held, size = TaskContext.get().partitionId(), 0, None, [], 0

    def close():
        nonlocal seq, held, size
        if not held:
            return []
        items, roles, texts, blank, dup, cut, illegal = [], [], [], 0, 0, 0, 0
        for r in held:
            n = r["n"]
            stays = r["first"] and not r["blank"]
            for gone, k in ((False, 1), (True, n - 1)) if stays else ((True, n),):
                if k:
                    items.append((r["initial"], gone, not gone and r["cut"], k))
                    roles.append(r["role"])
                    texts.append(None if gone else r["text"])
            blank += n if r["blank"] else 0
            dup += 0 if r["blank"] else n - r["first"]
            cut += stays and r["cut"]
            illegal += n - 1  # an initial never follows itself
        illegal += sum(a["initial"] + b["initial"] not in LEGAL for a, b in zip(held, held[1:]))
        columns = list(zip(*items))
        matrix = [c for q in range(4) for c in forward([0 if i == q else FAR for i in range(4)], items)[-1]]
        out = dict(conv_id=conv, ord=(part << 33) + seq, roles=roles, texts=texts, initials=columns[0], gone=columns[1], cut=columns[2], copies=columns[3], matrix=matrix, blank=blank, duplicate=dup, truncated=cut, illegal=illegal, head=held[0]["initial"], tail=held[-1]["initial"], _size=size)
        seq, held, size = seq + 1, [], 0
        return [out]

    def step(r):
        nonlocal conv, size
        out = close() if r is None or len(held) >= most or size >= BYTES or (held and r["conv_id"] != conv) else []
        if r is not None:
            conv = r["conv_id"]
            held.append(r)
            size += 4 * len(r["text"]) + 64
        return out

    return step


def _along(backwards: bool):
    """Chunks of each conversation in order, to the costs at their start; or in reverse, to those at their end."""

    def start():
        conv, d, last = None, None, True

        def step(r):
            nonlocal conv, d, last
            if r is None:
                return []
            if d is None or r["conv_id"] != conv:
                conv, d, last = r["conv_id"], list(END) if backwards else [0, FAR, FAR, FAR], True
            m = [r["matrix"][4 * q : 4 * q + 4] for q in range(4)]
            out = {"ord": r["ord"], "costs": d, "last": last}
            d = [min(m[q][t] + d[t] for t in range(4)) for q in range(4)] if backwards else [min(d[q] + m[q][t] for q in range(4)) for t in range(4)]
            d, last = [min(x, FAR) for x in d], False
            return [out]

        return step

    return start


def _maps():
    def step(r):
        if r is None:
            return []
        items = _items(r)
        ahead, back = forward(r["ahead"], items), backward(r["behind"], items)
        best = min(a + b for a, b in zip(inserted(ahead[0]), back[0]))
        ends = [follow(q, ahead, back, items, r["last"])[0] if ahead[0][q] + back[0][q] == best else -1 for q in range(4)]
        return [{"conv_id": r["conv_id"], "ord": r["ord"], "ends": ends}]

    return step


def _states():
    conv, state = None, None

    def step(r):
        nonlocal conv, state
        if r is None:
            return []
        if state is None or r["conv_id"] != conv:
            conv, state = r["conv_id"], START
        out = {"ord": r["ord"], "state": state}
        state = r["ends"][state]
        return [out]

    return step


_EDITS = "conv_id {id}, ord long, cost long, blank long, duplicate long, truncated long, illegal long, head string, tail string, edits array<struct<edit:string,role:string,text:string>>"


def _edits():
    def step(r):
        if r is None:
            return []
        items = _items(r)
        ahead, back = forward(r["ahead"], items), backward(r["behind"], items)
        edits, size = [], 0
        for letter, i, role in follow(r["state"], ahead, back, items, r["last"])[1]:
            if letter == "D":
                edits += [{"edit": "D", "role": None, "text": None}] * items[i][3]
            else:
                text = "" if i < 0 else r["texts"][i]
                edits.append({"edit": letter, "role": role or r["roles"][i], "text": text})
                size += 4 * len(text) + 64
        cost = min(a + b for a, b in zip(inserted(ahead[0]), back[0]))
        return [{k: r[k] for k in ("conv_id", "ord", "blank", "duplicate", "truncated", "illegal", "head", "tail")} | {"cost": cost, "edits": edits, "_size": size}]

    return step


def repair(conversations: DataFrame, rows_of_chunk: int = ROWS) -> DataFrame:
    """Chunks of repaired conversations: conv_id, ord (their order), edits array<struct<edit,role,text>>, cost (of the whole
    conversation), counts of faults in the chunk, and the initials of its first and last row.

    ``edits`` has a D, K, R or I for each row and inserted turn, with the role and text that the turn then has (null where it
    goes). Rows are taken by turn (nulls first), then role, the first
    hundred characters of the text and its MD5; a null role or text is one space; a null conv_id is a
    conversation like others. Equal rows of one turn are counted before they are dealt, so many copies are one row on the way.
    A role that is neither system, user nor assistant by its initial (an empty one too) is re-roled or deleted. A conversation
    without rows has no chunk; an empty table gives none. A column ``n`` of the input says how often a row counts; other
    columns are ignored.
    """
    kind = dict(conversations.dtypes)["conv_id"]
    keys = ["conv_id", "turn", "role", "_start", "_hash"]
    rows = numbered(conversations).withColumn("_start", F.substring("text", 1, 100))
    dealt = rows.repartitionByRange(C.partitions(conversations.sparkSession), *keys).sortWithinPartitions(*keys).drop("_start", "_hash", "turn")
    chunks = C.keep(_stream(dealt, _CHUNK.format(id=kind), lambda: _chunker(rows_of_chunk)), "turns")

    def along(df, schema, start, order=F.asc):
        return _stream(df.repartition("conv_id").sortWithinPartitions(order("conv_id"), order("ord")), schema, start)

    narrow = chunks.select("conv_id", "ord", "matrix")
    ahead = along(narrow, "ord long, costs array<long>, last boolean", _along(False)).select("ord", F.col("costs").alias("ahead"))
    behind = along(narrow, "ord long, costs array<long>, last boolean", _along(True), F.desc).select("ord", F.col("costs").alias("behind"), "last")
    costs = C.keep(ahead.join(behind, "ord"), "costs")
    coded = chunks.select("conv_id", "ord", "initials", "gone", "cut", "copies").join(costs, "ord")
    maps = _stream(coded, f"conv_id {kind}, ord long, ends array<int>", _maps)
    states = costs.join(along(maps, "ord long, state int", _states), "ord")
    return C.keep(_stream(chunks.drop("matrix").join(states, "ord"), _EDITS.format(id=kind), _edits), "repaired")


def turns(repaired: DataFrame) -> DataFrame:
    """The turns that repaired conversations have: conv_id, ord and place (their order), edit, role, text."""
    return repaired.select("conv_id", "ord", F.posexplode("edits").alias("place", "e")).where("e.edit <> 'D'").select("conv_id", "ord", "place", "e.edit", "e.role", "e.text")


def _digest():
    conv, got, sha = None, None, None

    def close():
        return [got | {"conv_id": conv, "audit": "".join(got["audit"]), "repaired_sha256": sha.hexdigest()}] if got else []

    def step(r):
        nonlocal conv, got, sha
        out = []
        if r is None or got is None or r["conv_id"] != conv:
            out = close()
            if r is None:
                return out
            conv, sha, got = r["conv_id"], hashlib.sha256(), {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": r["cost"], "audit": [], "_tail": "", "_lines": 0}
        for k in ("blank", "duplicate", "truncated", "illegal"):
            got[k] += r[k]
        got["illegal"] += bool(got["_tail"]) and got["_tail"] + r["head"] not in LEGAL
        got["audit"].append(r["letters"])
        if r["lines"]:
            sha.update(b"\n" if got["_lines"] else b"")
            sha.update(r["body"].encode())
        got["_tail"], got["_lines"] = r["tail"], got["_lines"] + r["lines"]
        return out

    return step


def summary(conversations: DataFrame, ids: DataFrame, repaired: DataFrame) -> DataFrame:
    """One row for each conv_id of ``ids``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``conversations`` are the rows that were repaired. Texts of a conversation pass through one hash in their order, a chunk at
    a time; one that has no rows has zeros, an empty audit and the hash of the empty string.
    """
    kind = dict(ids.dtypes)["conv_id"]
    gap = conversations.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps"))
    lines = F.filter("edits", lambda e: e["edit"] != "D")
    flat = repaired.select("conv_id", "ord", "cost", "blank", "duplicate", "truncated", "illegal", "head", "tail", F.array_join(F.transform("edits", lambda e: e["edit"]), "").alias("letters"), F.array_join(F.transform(lines, lambda e: F.concat(e["role"], F.lit(":"), e["text"])), "\n").alias("body"), F.size(lines).cast("long").alias("lines"))
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string"
    found = _stream(flat.repartition("conv_id").sortWithinPartitions("conv_id", "ord"), schema, _digest)
    zero = F.lit(None).cast("long")
    every = ids.select("conv_id").distinct().select("conv_id", zero.alias("gaps"), *[zero.alias(c) for c in counts], F.lit(None).cast("string").alias("audit"), F.lit(None).cast("string").alias("repaired_sha256"))
    both = every.unionByName(found, allowMissingColumns=True).unionByName(gap, allowMissingColumns=True)
    own = both.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", *counts)], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    return own.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: rows as the crc32 of ``conv_id:turn`` damages them; n is 2 for a row that is repeated."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"))


def op11_turns(spark, sf_dir: str) -> DataFrame:
    c = C.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    rows = damage(c)
    return summary(rows, c, repair(rows))


#: crc32 by its table; costs and audits of each state row by row, least (cost, audit) first, as no audit of equal cost starts another.
SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) tab),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda a, b: xor(a >> 8, tab[CAST((xor(a, b) & 255) + 1 AS INT)])), 4294967295) % 20 AS k FROM conversations, tab),
m AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE k <> 0),
n AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 100), md5(text)) AS i FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM n),
f AS (SELECT conv_id, turn, i, role, text, left(role, 1) AS initial, blank, NOT blank AND seen AS dup, NOT blank AND NOT seen AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE illegal) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 3, 3, 'I'), (3, 2, 3, 'I')) x(q, via, cost, letters)),
arc AS (SELECT * FROM (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')) x(q, nxt, initial)),
steps AS (
  SELECT x.via AS q, x.q AS src, x.cost, x.letters, NULL AS nxt, NULL AS needs, 'D' AS edit, 4 AS extra FROM ins x
  UNION ALL SELECT x.via, x.q, x.cost, x.letters, a.nxt, a.initial, 'K', 0 FROM ins x JOIN arc a ON a.q = x.via
  UNION ALL SELECT x.via, x.q, x.cost, x.letters, a.nxt, NULL, 'R', 3 FROM ins x JOIN arc a ON a.q = x.via WHERE a.initial <> 's'),
d AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, {'c': CAST(0 AS BIGINT), 'a': ''} AS best FROM g
  UNION ALL
  SELECT d.conv_id, f.i, coalesce(s.nxt, s.q), min({'c': CAST(d.best.c + s.cost + s.extra + CASE WHEN f.cut AND s.edit <> 'D' THEN 3 ELSE 0 END AS BIGINT), 'a': d.best.a || s.letters || s.edit})
  FROM d JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i + 1 JOIN steps s ON s.src = d.q WHERE s.edit = 'D' OR (NOT f.blank AND NOT f.dup AND (s.needs IS NULL OR s.needs = f.initial))
  GROUP BY d.conv_id, f.i, coalesce(s.nxt, s.q)),
e AS (SELECT g.conv_id, min({'c': d.best.c + x.cost, 'a': d.best.a || x.letters}) AS best FROM g JOIN d ON d.conv_id IS NOT DISTINCT FROM g.conv_id AND d.i = g.n JOIN ins x ON x.q = d.q WHERE x.via IN (0, 3) GROUP BY g.conv_id),
l AS (SELECT conv_id, k, letter, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER w AS i, sum(CASE WHEN letter = 'D' THEN 0 ELSE 1 END) OVER w AS pos FROM (SELECT conv_id, unnest(range(1, length(best.a) + 1)) AS k, best.a[k] AS letter FROM e) WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
w AS (SELECT l.conv_id, l.k, l.letter, l.pos, f.role, f.text, max(CASE WHEN l.pos = 1 AND l.letter = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS off FROM l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i),
r AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (pos - off) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS sha FROM w WHERE letter <> 'D' GROUP BY conv_id)
SELECT ids.conv_id, CAST(coalesce(g.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(g.blank, 0) AS BIGINT) AS blank, CAST(coalesce(g.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(g.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(g.illegal, 0) AS BIGINT) AS illegal,
  CAST(coalesce(e.best.c, 0) AS BIGINT) AS cost, coalesce(e.best.a, '') AS audit, coalesce(r.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
