"""Boosted trees with a limit of leaves, many models in one plan: final fits, one model for each group left out, grids of parameters.

Features are cut into bins once. For each level of a tree, one pass over the rows sums gradients by (model, node, feature, bin),
all models at once; sums are made in the tasks before they are shuffled, and the best cut of each node is found in the plan, so
the driver gets one row for each node of each model. Growing best leaf first gives the tree that the most gainful cuts make, and
a cut's gain doesn't depend on when it is made; so all levels are measured, and of their cuts the best are taken until the
leaves are used up. Rows and columns are sampled by hashes, the same on every run.

What a task holds is bounded: models are fitted in blocks whose sums have a fixed size at most.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sinks.kept import kept
from . import calibration

#: Bytes that the sums of one block of models may take in a task, and trees after which rows' margins are written down.
HELD, SETTLE = 64 << 20, 8
#: Least sum of second derivatives of a child, and least gain of a cut.
LEAST_HESSIAN, LEAST_GAIN = 1e-3, 1e-12
U = np.uint64


@dataclass(frozen=True)
class Boosting:
    """Parameters of one model, and the values of the fold column whose rows it may not see. The defaults are fixed values."""

    name: str
    without: tuple = ()
    trees: int = 100
    depth: int = 6
    leaves: int = 31
    rate: float = 0.05
    rows: float = 0.75
    columns: float = 0.9
    least_child: int = 20
    positive: float = 20.0
    seed: int = 42


@dataclass
class Tree:
    """Nodes in heap order: the children of node i are 2 i + 1 (bin up to the cut) and 2 i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    rows: np.ndarray


@dataclass
class Model:
    parameters: Boosting
    features: list[str]
    edges: list[list[float]]
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)


def edges(df: DataFrame, features: list[str], bins: int = 255) -> list[list[float]]:
    """Cuts of each feature: its quantiles (approximate, by sketches of fixed size), equal ones once; a value up to a cut is in its bin."""
    q = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), q, F.lit(10_000)).alias(c) for c in features]).first()  # one row
    return [sorted({float(v) for v in row[c] or [] if v == v}) for c in features]


def _bin(name: str, cuts: list[float]) -> Column:
    v = F.col(name).cast("double")
    n = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda t: t < v)) if cuts else F.lit(0)
    return F.when(v.isNull() | F.isnan(v), F.raise_error(F.lit(f"{name} has a null"))).otherwise(n)


def binned(df: DataFrame, features: list[str], cuts: list[list[float]], label: str | None = None, fold: str | None = None, keys: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """keys, __bins (a byte for each feature), __y, __fold, __w (how often the row counts), __id (a hash of the others but __w, by which rows are sampled).

    A null or NaN feature is an error, as nothing is filled in.
    """
    at = [_bin(c, e) for c, e in zip(features, cuts, strict=True)]
    hexed = F.unhex(F.concat(*[F.lpad(F.hex(x.cast("long")), 2, "0") for x in at]))
    y = F.col(label).cast("int") if label else F.lit(0)
    f = F.col(fold).cast("string") if fold else F.lit(None).cast("string")
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    return df.select(*keys, hexed.alias("__bins"), y.alias("__y"), f.alias("__fold"), w.alias("__w")).withColumn("__id", F.xxhash64(*keys, "__bins", "__y", "__fold"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def sampled(ids: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Which rows a tree sees: by their hash, the tree and the seed alone."""
    if share >= 1:
        return np.ones(len(ids), bool)
    with np.errstate(over="ignore"):
        key = _mix(np.array([seed * 1_000_003 + tree + 1], U))
        return (_mix(ids.view(U) ^ key) >> U(11)).astype(float) / (1 << 53) < share


def columns_of(n: int, seed: int, tree: int, share: float) -> np.ndarray:
    """Which features a tree sees: a fixed number of them, at least one, by their hashes."""
    with np.errstate(over="ignore"):
        order = np.argsort(_mix(np.arange(n, dtype=U) + U(7919) * U(tree + 1) + U(104_729) * U(seed)), kind="stable")
    out = np.zeros(n, bool)
    out[order[: max(1, int(np.ceil(share * n - 1e-9)))]] = True
    return out


def route(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node that each row comes to."""
    node, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        f = feature[node]
        node = np.where(f >= 0, 2 * node + 1 + (bins[every, np.maximum(f, 0)] > cut[node]), node)
    return node


def margins(bins: np.ndarray, m: Model, trees: list[Tree] | None = None, start: bool = True) -> np.ndarray:
    out = np.full(len(bins), m.start if start else 0.0)
    for t in m.trees if trees is None else trees:
        out += t.value[route(bins, t.feature, t.cut, m.parameters.depth)]
    return out


def _matrix(col: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, n)


def _sums(state: DataFrame, block: list[Model], done: list[int], partial: list[tuple[np.ndarray, np.ndarray]], level: int, n_bins: int) -> DataFrame:
    """model, node, feature, bin, n, g, h: gradients of the rows that each model sees, at the nodes of one level.

    ``done``: trees of each model that the margins in ``state`` have; ``partial``: the cuts of the tree that grows.
    """
    n_f, width = len(block[0].features), 1 << level
    held = state.sparkSession.sparkContext.broadcast((block, done, partial))
    first = width - 1  # the level's first node

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, done, partial = held.value
        total = np.zeros((len(block), n_f, width * n_bins, 3))
        for b in batches:
            if not b.num_rows:
                continue
            bins, y = _matrix(b.column("__bins"), n_f), np.asarray(b.column("__y")).astype(float)
            ids, before = np.asarray(b.column("__id")), np.frombuffer(b"".join(b.column("__margins").to_pylist())).reshape(b.num_rows, -1)
            fold = np.array([x if x is not None else "\0" for x in b.column("__fold").to_pylist()], object)
            for k, m in enumerate(block):
                p = m.parameters
                t = len(m.trees)
                if t >= p.trees or level >= p.depth:
                    continue
                times = np.asarray(b.column("__w")).astype(float)
                see = sampled(ids, p.seed, t, p.rows)
                for v in p.without:
                    see &= fold != v
                mine, target, times = bins[see], y[see], times[see]
                margin = before[see, k] + margins(mine, m, m.trees[done[k] :], False)
                prob = 1 / (1 + np.exp(-margin))
                w = np.where(target == 1, p.positive, 1.0) * times
                g, h = w * (prob - target), w * prob * (1 - prob)
                node = route(mine, *partial[k], level)
                at = node - first  # rows that came to a leaf before are below 0
                live = at >= 0
                cell = at[live] * n_bins
                for f in np.flatnonzero(columns_of(n_f, p.seed, t, p.columns)):
                    c = cell + mine[live, f]
                    total[k, f, :, 0] += np.bincount(c, times[live], width * n_bins)
                    total[k, f, :, 1] += np.bincount(c, g[live], width * n_bins)
                    total[k, f, :, 2] += np.bincount(c, h[live], width * n_bins)
        k, f, c = np.nonzero(total[..., 0])
        n, g, h = (total[k, f, c, i] for i in range(3))
        yield pa.record_batch([pa.array(x) for x in (k.astype(np.int32), (c // n_bins + first).astype(np.int32), f.astype(np.int32), (c % n_bins).astype(np.int32), n.astype(np.int64), g, h)], names=["model", "node", "feature", "bin", "n", "g", "h"])

    made = state.mapInArrow(run, "model int, node int, feature int, bin int, n long, g double, h double")
    return made.groupBy("model", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ngh"])


def best_cuts(sums: DataFrame, least: dict[int, int]) -> DataFrame:
    """model, node, n, g, h and its best cut: feature, bin, gain, and n, g, h to the left of it (null where no cut is good enough).

    Of equal gains (to nine digits) the first feature and the lowest bin win.
    """
    w = W.partitionBy("model", "node", "feature")
    up = w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    x = sums.select("model", "node", "feature", "bin", *[F.sum(c).over(up).alias(f"{c}l") for c in "ngh"], *[F.sum(c).over(w).alias(c) for c in "ngh"])
    nr, gr, hr = (F.col(c) - F.col(f"{c}l") for c in "ngh")
    part = lambda a, b: a * a / F.nullif(b, F.lit(0.0))
    gain = part(F.col("gl"), F.col("hl")) + part(gr, hr) - part(F.col("g"), F.col("h"))
    low = F.element_at(F.create_map(*[F.lit(v) for kv in least.items() for v in kv]), F.col("model"))
    good = (F.col("nl") >= low) & (nr >= low) & (F.col("hl") >= LEAST_HESSIAN) & (hr >= LEAST_HESSIAN)
    cut = F.when(good & (gain > LEAST_GAIN), F.struct(F.round(gain, 9).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "nl", "gl", "hl"))
    g = x.groupBy("model", "node").agg(*[F.max(c).alias(c) for c in "n"], F.min_by("g", "feature").alias("g"), F.min_by("h", "feature").alias("h"), F.max(cut).alias("c"))
    return g.select("model", "node", "n", "g", "h", (-F.col("c.f")).alias("feature"), (-F.col("c.b")).alias("bin"), "c.gain", "c.nl", "c.gl", "c.hl")


def best_first(cuts: dict[int, tuple], p: Boosting) -> Tree:
    """The tree of the most gainful cuts, leaf by leaf, until it has ``leaves`` leaves or no cut is left.

    ``cuts``: node -> (n, g, h, feature or None, bin, gain, n, g and h to the left), for each node that any cut above it leads to.
    """
    size = (1 << (p.depth + 1)) - 1
    t = Tree(np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros(size), np.zeros(size, np.int64))
    sums = {0: cuts[0][:3]} if 0 in cuts else {}
    queue = [(-cuts[0][5], 0)] if 0 in cuts and cuts[0][3] is not None else []
    left = p.leaves - 1
    while queue and left > 0:
        _, i = heapq.heappop(queue)
        n, g, h, f, b, gain, nl, gl, hl = cuts[i]
        t.feature[i], t.cut[i], t.gain[i] = f, b, gain
        sums[2 * i + 1], sums[2 * i + 2] = (nl, gl, hl), (n - nl, g - gl, h - hl)
        left -= 1
        for c in (2 * i + 1, 2 * i + 2):
            if c in cuts and cuts[c][3] is not None:
                heapq.heappush(queue, (-cuts[c][5], c))
    for i, (n, g, h) in sums.items():
        t.rows[i] = n
        t.value[i] = -g / h * p.rate if h > 0 else 0.0
    return t


def _fit_block(data: DataFrame, block: list[Model], n_bins: int) -> None:
    spark = data.sparkSession
    counts = data.groupBy("__fold").agg(F.sum(F.when(F.col("__y") == 1, F.col("__w")).otherwise(0)).alias("p"), F.sum("__w").alias("n"))
    for m in block:
        # one row each; a model of rows of one class only starts at (and stays near) its end
        seen = counts.where(~F.coalesce(F.col("__fold").isin(*m.parameters.without), F.lit(False))) if m.parameters.without else counts
        r = seen.agg(F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        pos, neg = r[0] * m.parameters.positive, r[1] - r[0]
        share = min(max(pos / (pos + neg), 1e-6), 1 - 1e-6) if pos + neg else 0.5
        m.start = float(np.log(share / (1 - share)))

    def settled(frame: DataFrame, add: list[list[Tree]], first: bool) -> DataFrame:
        held = spark.sparkContext.broadcast((block, add))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, add = held.value
            for b in batches:
                if b.num_rows:
                    bins = _matrix(b.column("__bins"), len(block[0].features))
                    old = np.tile([m.start for m in block], (b.num_rows, 1)) if first else np.frombuffer(b"".join(b.column("__margins").to_pylist())).reshape(b.num_rows, -1)
                    new = np.ascontiguousarray(old + np.column_stack([margins(bins, m, a, False) for m, a in zip(block, add)]))
                    yield pa.record_batch([b.column("__bins"), b.column("__y"), b.column("__fold"), b.column("__id"), b.column("__w"), pa.array([r.tobytes() for r in new], pa.binary())], names=["__bins", "__y", "__fold", "__id", "__w", "__margins"])

        return kept(frame.mapInArrow(run, "__bins binary, __y int, __fold string, __id long, __w long, __margins binary"), "margins")

    state, done = settled(data, [[] for _ in block], True), [0] * len(block)
    most, deep = max(m.parameters.trees for m in block), max(m.parameters.depth for m in block)
    least = {k: m.parameters.least_child for k, m in enumerate(block)}
    for t in range(most):
        size = (1 << (deep + 1)) - 1
        partial = [(np.full(size, -1, np.int64), np.zeros(size, np.int64)) for _ in block]
        cuts: list[dict[int, tuple]] = [{} for _ in block]
        for level in range(deep):
            found = best_cuts(_sums(state, block, done, partial, level, n_bins), least).collect()  # a row for each node of each model
            for r in found:
                cuts[r.model][r.node] = (r.n, r.g, r.h, r.feature, r.bin, r.gain, r.nl, r.gl, r.hl)
                if r.feature is not None:
                    partial[r.model][0][r.node], partial[r.model][1][r.node] = r.feature, r.bin
            if not any(r.feature is not None for r in found):
                break
        for m, c in zip(block, cuts):
            if t < m.parameters.trees:
                m.trees.append(best_first(c, m.parameters))
        if (t + 1) % SETTLE == 0 and t + 1 < most:
            state, done = settled(state, [m.trees[d:] for m, d in zip(block, done)], False), [len(m.trees) for m in block]


def fit(df: DataFrame, features: list[str], label: str, models: list[Boosting], fold: str | None = None, bins: int = 255, cuts: list[list[float]] | None = None, keys: tuple[str, ...] = (), weight: str | None = None) -> list[Model]:
    """The models, fitted to the rows whose label isn't null; each leaves out the rows whose fold is among its ``without``.

    ``keys`` may name columns that tell rows apart, for sampling; rows that repeat are sampled together, so they are counted once
    and the passes go over different rows only. ``weight``: a whole number, how often each row counts; it asks for ``cuts``, as
    quantiles (``edges``) are those of rows. ``cuts``: of each feature, instead of its quantiles. A null feature is an error. Without rows, a model has trees of one leaf of value 0.
    What the driver holds is the models; their number is bounded by the list that it is given.
    """
    rows = df.where(F.col(label).isNotNull())
    if weight and not cuts:
        raise ValueError("rows that count more than once need their cuts")
    cuts = cuts or edges(rows, features, bins)
    data = kept(binned(rows, features, cuts, label, fold, keys, weight).groupBy("__bins", "__y", "__fold", "__id").agg(F.sum("__w").alias("__w")), "binned")
    n_bins = max(len(c) for c in cuts) + 1
    out = [Model(p, features, cuts) for p in models]
    deep = max(p.depth for p in models)
    each = (1 << (deep - 1)) * len(features) * n_bins * 24
    step = max(1, HELD // each)
    for i in range(0, len(out), step):
        _fit_block(data, out[i : i + step], n_bins)
    return out


def _scored(df: DataFrame, models: list[Model], fold: str | None, every: bool, keys: tuple[str, ...]) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(models)
    n_f = len(models[0].features)
    data = binned(df, models[0].features, models[0].edges, None, fold, keys)
    kinds = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bins = _matrix(b.column("__bins"), n_f)
            folds = np.array([x if x is not None else "\0" for x in b.column("__fold").to_pylist()], object)
            for m in held.value:
                take = np.ones(len(bins), bool) if every else np.isin(folds.astype(str), [str(v) for v in m.parameters.without])
                at = np.flatnonzero(take)
                if len(at):
                    p = 1 / (1 + np.exp(-margins(bins[at], m)))
                    yield pa.record_batch([*[b.column(k).take(pa.array(at)) for k in keys], pa.array([m.parameters.name] * len(at)), pa.array(p)], names=[*keys, "model", "score"])

    return data.select(*keys, "__bins", "__fold").mapInArrow(run, f"{kinds}, model string, score double")


def predict(df: DataFrame, models: list[Model], keys: tuple[str, ...]) -> DataFrame:
    """keys, model, score: each row's probability by each model."""
    return _scored(df, models, None, True, keys)


def out_of_fold(df: DataFrame, models: list[Model], fold: str, keys: tuple[str, ...]) -> DataFrame:
    """keys, model, score: each row's probability by the models that left its fold out."""
    return _scored(df, models, fold, False, keys)


def left_out(df: DataFrame, fold: str, parameters: Boosting) -> list[Boosting]:
    """One model for each value of fold (as text, null left alone), which doesn't see its rows; the list of values is what the driver holds."""
    values = [r[0] for r in df.where(F.col(fold).isNotNull()).select(F.col(fold).cast("string")).distinct().orderBy(fold).collect()]
    return [Boosting(**{**parameters.__dict__, "name": v, "without": (v,)}) for v in values]


def importances(spark, models: list[Model]) -> DataFrame:
    """model, feature, gain, cuts, importance (share of the model's gain; 0 where it has none): a row for each feature of each model."""
    rows = []
    for m in models:
        gain, n = np.zeros(len(m.features)), np.zeros(len(m.features), int)
        for t in m.trees:
            cut = t.feature >= 0
            np.add.at(gain, t.feature[cut], t.gain[cut])
            np.add.at(n, t.feature[cut], 1)
        rows += [(m.parameters.name, f, float(g), int(c), float(g / gain.sum()) if gain.sum() else 0.0) for f, g, c in zip(m.features, gain, n)]
    return spark.createDataFrame(rows, "model string, feature string, gain double, cuts long, importance double")


def nodes(spark, models: list[Model]) -> DataFrame:
    """model, tree, node, feature, threshold (the greatest value that goes left), gain, rows, value: the nodes that models have."""
    rows = []
    for m in models:
        for k, t in enumerate(m.trees):
            for i in np.flatnonzero((t.rows > 0) | (t.feature >= 0)):
                f = int(t.feature[i])
                rows.append((m.parameters.name, k, int(i), m.features[f] if f >= 0 else None, float(m.edges[f][t.cut[i]]) if f >= 0 else None, float(t.gain[i]) if f >= 0 else None, int(t.rows[i]), float(t.value[i])))
    return spark.createDataFrame(rows, "model string, tree int, node int, feature string, threshold double, gain double, rows long, value double")


def grid(df: DataFrame) -> list[Boosting]:
    """Parameters of a table of configurations: a column for each parameter that isn't its default, ``name`` among them."""
    known = set(Boosting.__dataclass_fields__) - {"without"}
    return [Boosting(**{k: v for k, v in r.asDict().items() if k in known and v is not None}) for r in df.orderBy("name").collect()]  # what the caller lists


def inner_folds(sizes: dict[str, int], k: int) -> list[tuple[str, ...]]:
    """Groups dealt to k folds by size, largest first, back and forth, so that folds have about as many rows; empty folds are left out."""
    order = sorted(sizes, key=lambda g: (-sizes[g], g))
    folds: list[list[str]] = [[] for _ in range(k)]
    for i, g in enumerate(order):
        turn, at = divmod(i, k)
        folds[at if turn % 2 == 0 else k - 1 - at].append(g)
    return [tuple(f) for f in folds if f]


def nested(df: DataFrame, features: list[str], label: str, group: str, parameters: Boosting, keys: tuple[str, ...], inner: int = 3, cuts: list[list[float]] | None = None, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nested calibration of groups left out: (keys, model, score, calibrated) of each row, and (model, slope, offset) of each fit.

    For each group, a model of all others scores it; that model's calibrator is fitted to the scores that the others have from
    models which saw neither the group nor their own inner fold. All outer and inner models are fitted in one plan, and all
    calibrators at once. ``keys`` must tell rows apart and have group, label and ``weight``, if there is one, among them. The lists of groups and of models,
    as many as groups times inner folds and groups, are what the driver holds.
    """
    sizes = {r[0]: r[1] for r in df.where(F.col(group).isNotNull()).groupBy(F.col(group).cast("string")).agg(F.sum(F.col(weight) if weight else F.lit(1))).collect()}
    make = lambda name, without: Boosting(**{**parameters.__dict__, "name": name, "without": tuple(without)})
    outer = [make(g, (g,)) for g in sorted(sizes)]
    deeper = [make(f"{g}\0{i}", (g, *fold)) for g in sorted(sizes) for i, fold in enumerate(inner_folds({k: n for k, n in sizes.items() if k != g}, inner))]
    models = fit(df, features, label, [*outer, *deeper], group, cuts=cuts, keys=keys, weight=weight)
    raw = out_of_fold(df, models[: len(outer)], group, keys)
    own = F.split("model", "\0")[0]
    inside = out_of_fold(df, models[len(outer) :], group, keys).withColumn("model", own).where(F.col("model") != F.col(group).cast("string"))
    fits = calibration.fit_platt_by(inside, "model", "score", label, weight=weight)
    return calibration.calibrated(raw, "model", "score", fits), fits


def save(spark, models: list[Model], path: str, about: dict) -> None:
    """Models as a table of their nodes, and beside it, as sorted JSON, their parameters and what is said about them."""
    rows = [(k, t, int(i), int(tree.feature[i]), int(tree.cut[i]), float(tree.value[i]), float(tree.gain[i]), int(tree.rows[i])) for k, m in enumerate(models) for t, tree in enumerate(m.trees) for i in np.flatnonzero((tree.rows > 0) | (tree.feature >= 0))]
    spark.createDataFrame(rows, "model int, tree int, node int, feature int, cut int, value double, gain double, rows long").coalesce(1).write.mode("overwrite").parquet(path + "/nodes")
    told = {"about": about, "features": models[0].features, "edges": models[0].edges, "models": [{**m.parameters.__dict__, "start": m.start} for m in models]}
    spark.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path + "/about")


def load(spark, path: str) -> tuple[list[Model], dict]:
    """What ``save`` has written: models that score as they did, and what was said about them."""
    told = json.loads(spark.read.text(path + "/about", wholetext=True).first()[0])
    out = []
    for d in told["models"]:
        start = d.pop("start")
        p = Boosting(**{**d, "without": tuple(d["without"])})
        size = (1 << (p.depth + 1)) - 1
        trees = [Tree(np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros(size), np.zeros(size, np.int64)) for _ in range(p.trees)]
        out.append(Model(p, told["features"], told["edges"], start, trees))
    for r in spark.read.parquet(path + "/nodes").collect():  # the models' own size
        t = out[r.model].trees[r.tree]
        t.feature[r.node], t.cut[r.node], t.value[r.node], t.gain[r.node], t.rows[r.node] = r.feature, r.cut, r.value, r.gain, r.rows
    return out, told["about"]
