"""Regression trees on binned features: forests, extremely randomised trees, and boosting by levels, best leaf first or symmetric.

Features are cut into at most 256 bins once; a row is its bins as bytes, a target and a number. A tree is grown by a conversation:
the grower names nodes, and gets the best split of each (or the one split that is best for all of them together). The answers come
from sums of (weight, gradient) by (tree, node, feature, bin):

* Where all training rows, or those of a node of a forest, are at most ``LOCAL_ROWS``, one task holds their bins and finishes the
  tree, or the chain of boosted trees, by itself; many trees and models are tasks of one job.
* Otherwise every pass is one job for all open nodes of all trees of all models: tasks sum up what they read, the sums are added by
  (tree, node, feature), each group gives its best split, and the driver gets one row a node.

Both give the same trees: gradients are rounded to multiples of a power of two, so that sums are exact in any order, and
all chance (rows, columns, cuts) is a hash of the seed with the tree, the row, the feature or the place of the node.
The driver holds the trees, no rows.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, workers_see_package

BINS = 256
LOCAL_ROWS = 1 << 16
PASS_BYTES = 256 << 20  # of sums that a task holds in one pass
RENEW = 20  # boosted trees after which predictions are written
FINE = float(1 << 20)  # steps of a gradient up to the largest one
_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Spec:
    """How a model's trees are drawn and grown."""

    trees: int
    boosted: bool = False
    growth: str = "levels"  # or "best_first", "symmetric"
    rate: float = 1.0
    depth: int | None = None
    leaves: int | None = None
    l2: float = 0.0
    min_rows: float = 1.0
    bootstrap: bool = False
    row_share: float = 1.0
    column_share: float = 1.0
    random_cuts: bool = False
    seed: int = 42


def draw(*keys) -> np.ndarray:
    """Uniform numbers in [0, 1) that depend on the keys (integers or arrays of them) alone."""
    with np.errstate(over="ignore"):
        h = np.uint64(0)
        for k in keys:
            h = (h ^ np.asarray(k).astype(np.uint64)) + _GOLDEN
            h = (h ^ (h >> np.uint64(30))) * _M1
            h = (h ^ (h >> np.uint64(27))) * _M2
            h = h ^ (h >> np.uint64(31))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _child_place(place: int, side: int) -> int:
    h = (2 * place + side + 1) * int(_GOLDEN) % (1 << 64)
    return (h ^ (h >> 31)) * int(_M1) % (1 << 64) >> 11


def row_weights(spec: Spec, tree: int, rows: np.ndarray) -> np.ndarray:
    """How often a tree counts each row: Poisson draws for a bootstrap, 0 or 1 for a share."""
    u = draw(spec.seed, tree, 1, rows)
    if spec.bootstrap:
        steps = np.cumsum([np.exp(-1) / f for f in np.cumprod([1.0, *range(1, 16)])])
        return np.searchsorted(steps, u, "right").astype(np.float64)
    return (u < spec.row_share).astype(np.float64)


def column_mask(spec: Spec, tree: int, features: int) -> np.ndarray:
    kept = max(1, round(spec.column_share * features))
    out = np.zeros(features, bool)
    out[np.argsort(draw(spec.seed, tree, 2, np.arange(features)), kind="stable")[:kept]] = True
    return out


class Tree:
    """Nodes in lists; node 0 is the root; a leaf has feature -1. Rows with a bin up to ``cut`` go left."""

    def __init__(self, weight: float = 0.0, grad: float = 0.0):
        self.feature, self.cut, self.left, self.right, self.gain = [-1], [0], [0], [0], [0.0]
        self.weight, self.grad, self.place, self.depth = [weight], [grad], [1], [0]

    def split(self, node: int, feature: int, cut: int, gain: float, weight: float, grad: float) -> tuple[int, int]:
        new = len(self.feature)
        self.feature[node], self.cut[node], self.gain[node], self.left[node], self.right[node] = feature, cut, gain, new, new + 1
        for side, (w, g) in enumerate(((weight, grad), (self.weight[node] - weight, self.grad[node] - grad))):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.right.append(0)
            self.gain.append(0.0)
            self.weight.append(w)
            self.grad.append(g)
            self.place.append(_child_place(self.place[node], side))
            self.depth.append(self.depth[node] + 1)
        return new, new + 1

    def graft(self, node: int, other: Tree) -> None:
        """Puts a tree that was grown from ``node`` in its place."""
        at = {0: node}
        for k, f in enumerate(other.feature):
            if f >= 0:
                left, right = self.split(at[k], f, other.cut[k], other.gain[k], other.weight[other.left[k]], other.grad[other.left[k]])
                at[other.left[k]], at[other.right[k]] = left, right

    def route(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Leaf of each row, from the node where it stands; -1 stays."""
        feature, cut, left, right = map(np.asarray, (self.feature, self.cut, self.left, self.right))
        node = node.copy()
        moving = np.flatnonzero((node >= 0) & (feature[node] >= 0))
        while len(moving):
            at = node[moving]
            node[moving] = np.where(x[moving, feature[at]] <= cut[at], left[at], right[at])
            moving = moving[feature[node[moving]] >= 0]
        return node


Split = tuple[int, int, float, float, float]  # feature, cut, gain, weight and gradient of the left side


def _gain(w, g, total_w, total_g, spec: Spec, allowed):
    """Gain of candidate splits; not above 0 where a split is not allowed."""
    ok = (w >= spec.min_rows) & (total_w - w >= spec.min_rows) & allowed
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = total_g * total_g / (total_w + spec.l2)
        gain = g * g / (w + spec.l2) + (total_g - g) ** 2 / (total_w - w + spec.l2) - whole
        return np.where(ok & (gain > 1e-9 * (whole + 1)), gain, -1.0)


def _random_cut(low: np.ndarray, high: np.ndarray, edges: Sequence[np.ndarray], features: np.ndarray, seed: int, tree: int, place: np.ndarray) -> np.ndarray:
    """A cut for each (node, feature), uniform in value between the lowest and the highest bin of the node; -1 if there is one bin."""
    u = draw(seed, tree, 3, place.astype(np.uint64)[:, None], features[None])
    out = np.full(low.shape, -1)
    for j, f in enumerate(features):
        e = edges[f]
        if len(e):
            a, b = e[np.minimum(low[:, j], len(e) - 1)], e[np.clip(high[:, j] - 1, 0, len(e) - 1)]
            out[:, j] = np.clip(np.searchsorted(e, a + u[:, j] * (b - a), "left"), low[:, j], np.maximum(high[:, j] - 1, low[:, j]))
    return np.where(high > low, out, -1)


def sums(x: np.ndarray, slot: np.ndarray, weight: np.ndarray, grad: np.ndarray, slots: int) -> np.ndarray:
    """(2, slot, feature, bin) sums of weights and weighted gradients."""
    n, features = x.shape
    key = ((slot[:, None] * features + np.arange(features)) * BINS + x).ravel()
    return np.stack([np.bincount(key, np.repeat(v, features), slots * features * BINS).reshape(slots, features, BINS) for v in (weight, weight * grad)])


def split_sums(both: np.ndarray, spec: Spec, tree: int, places: np.ndarray, allowed: np.ndarray, edges, features: np.ndarray):
    """Candidates of each slot from its sums: cut, gain, left weight and left gradient, each (slot, feature, candidate)."""
    left = both.cumsum(3)
    total = left[:, :, :, -1:]
    if spec.random_cuts:
        filled = both[0] > 0
        low, high = filled.argmax(2), BINS - 1 - filled[:, :, ::-1].argmax(2)
        cut = _random_cut(low, high, edges, features, spec.seed, tree, places)[:, :, None]
        left, ok = np.take_along_axis(left, np.maximum(cut, 0)[None], 3), (cut >= 0) & allowed[None, :, None]
    else:
        left, cut, ok = left[:, :, :, :-1], np.broadcast_to(np.arange(BINS - 1), left.shape[1:3] + (BINS - 1,)), allowed[None, :, None]
    return cut, _gain(left[0], left[1], total[0], total[1], spec, ok), left[0], left[1]


class LocalRows:
    """Answers for one tree from rows that a task holds."""

    def __init__(self, x, weight, grad, spec: Spec, tree_number: int, edges, allowed):
        used = np.flatnonzero(weight > 0)
        self.all, self.x, self.weight, self.grad = x, x[used], weight[used], grad[used]
        self.spec, self.number, self.edges, self.allowed = spec, tree_number, edges, allowed
        self.node = np.zeros(len(used), np.int64)

    def start(self, place: int = 1) -> Tree:
        tree = Tree(float(self.weight.sum()), float((self.weight * self.grad).sum()))
        tree.place[0] = place
        return tree

    def answer(self, tree: Tree, asked: list[int], shared: bool):
        self.node = tree.route(self.x, self.node)
        slot = np.full(len(tree.feature), -1)
        slot[asked] = np.arange(len(asked))
        rows = np.flatnonzero(slot[self.node] >= 0)
        slot, places = slot[self.node[rows]], np.array([tree.place[n] for n in asked])
        x, weight, grad = self.x[rows], self.weight[rows], self.grad[rows]
        if shared or len(asked) * BINS <= 2 * len(rows):
            features = np.arange(x.shape[1])
            found = split_sums(sums(x, slot, weight, grad, len(asked)), self.spec, self.number, places, self.allowed, self.edges, features)
            return shared_split(*found) if shared else _best_of_each(*found)
        return self._by_order(x, slot, weight, grad, len(asked), places)

    def _by_order(self, x, slot, weight, grad, slots: int, places) -> list[Split | None]:
        """The same for nodes with few rows: by sorting instead of by bins."""
        n, features = x.shape
        key = slot[:, None] * BINS + x
        order = np.argsort(key, 0, kind="stable")
        key = np.take_along_axis(key, order, 0)
        w, g = np.cumsum(weight[order], 0), np.cumsum((weight * grad)[order], 0)
        first = np.searchsorted(np.sort(slot), np.arange(slots + 1))
        zero = np.zeros((1, features))
        w0, g0 = np.concatenate((zero, w))[first[:-1]], np.concatenate((zero, g))[first[:-1]]
        total_w, total_g = np.concatenate((zero, w))[first[1:]] - w0, np.concatenate((zero, g))[first[1:]] - g0
        if self.spec.random_cuts:
            low, high = key[np.minimum(first[:-1], n - 1)] % BINS, key[first[1:] - 1] % BINS
            cut = _random_cut(low, high, self.edges, np.arange(features), self.spec.seed, self.number, places)
            at = np.stack([np.searchsorted(key[:, f], np.arange(slots) * BINS + cut[:, f], "right") for f in range(features)], 1)
            lw, lg = np.take_along_axis(np.concatenate((zero, w)), at, 0) - w0, np.take_along_axis(np.concatenate((zero, g)), at, 0) - g0
            gain = _gain(lw, lg, total_w, total_g, self.spec, (cut >= 0) & self.allowed[None])
            return _best_of_each(cut[:, :, None], gain[:, :, None], lw[:, :, None], lg[:, :, None])
        own = np.repeat(np.arange(slots), np.diff(first))
        last = np.ones(key.shape, bool)
        last[:-1] = key[1:] != key[:-1]
        lw, lg = w - w0[own], g - g0[own]
        gain = _gain(lw, lg, total_w[own], total_g[own], self.spec, last & self.allowed[None])
        top = np.maximum.reduceat(gain, first[:-1], 0) if n else np.zeros((slots, features))
        out: list[Split | None] = []
        for s in range(slots):
            f = int(top[s].argmax())
            i = int(first[s] + gain[first[s]: first[s + 1], f].argmax())
            out.append((f, int(key[i, f] % BINS), float(gain[i, f]), float(lw[i, f]), float(lg[i, f])) if top[s, f] > 0 else None)
        return out


def _best_of_each(cut, gain, w, g) -> list[Split | None]:
    out: list[Split | None] = []
    flat = gain.reshape(len(gain), -1).argmax(1)
    for s, i in enumerate(flat.tolist()):
        f, k = divmod(i, gain.shape[2])
        out.append((f, int(cut[s, f, k]), float(gain[s, f, k]), float(w[s, f, k]), float(g[s, f, k])) if gain[s, f, k] > 0 else None)
    return out


def shared_split(cut, gain, w, g) -> list[Split | None]:
    """The one (feature, cut) with the largest summed gain, for every slot."""
    f, k = divmod(int(np.maximum(gain, 0).sum(0).argmax()), gain.shape[2])
    if not (gain[:, f, k] > 0).any():
        return [None] * len(gain)
    return [(f, int(cut[s, f, k]), max(float(gain[s, f, k]), 0.0), float(w[s, f, k]), float(g[s, f, k])) for s in range(len(gain))]


Conversation = Generator[tuple[list[int], bool], list, Tree]


def grow(tree: Tree, spec: Spec) -> Conversation:
    """Yields nodes (and whether they must share one split), is sent their splits, returns the tree."""
    def large(node: int) -> bool:
        return tree.weight[node] >= 2 * spec.min_rows and (spec.depth is None or tree.depth[node] < spec.depth)

    if spec.growth == "best_first":
        return (yield from _best_first(tree, spec, large))
    open_nodes = [n for n in (0,) if large(n)]
    while open_nodes:
        found = yield open_nodes, spec.growth == "symmetric"
        made = [c for node, s in zip(open_nodes, found, strict=True) if s for c in tree.split(node, *s)]
        # All nodes of a symmetric level that have rows go on; others only if they can be split.
        open_nodes = [n for n in made if (large(n) if spec.growth != "symmetric" else tree.weight[n] > 0 and tree.depth[n] < spec.depth)]
    return tree


def _best_first(tree: Tree, spec: Spec, large) -> Conversation:
    """Splits the open leaf of the largest gain until there are ``leaves``. Nodes are asked for together: with the answers so far the
    whole order is tried, and all leaves it leaves open are asked for, until none is unknown."""
    known: dict[int, Split | None] = {}
    while True:
        leaves, chosen = [0], set()
        while len(leaves) < spec.leaves:
            best = max((n for n in leaves if known.get(n)), key=lambda n: (known[n][2], -n), default=None)
            if best is None:
                break
            if tree.feature[best] < 0:
                tree.split(best, *known[best])
            leaves.remove(best)
            chosen.add(best)
            leaves += [tree.left[best], tree.right[best]]
        queue = [n for n in leaves if n not in known]
        known |= {n: None for n in queue if not large(n)}
        queue = [n for n in queue if large(n)]
        if not queue:
            if any(n not in chosen for n in range(len(tree.feature)) if tree.feature[n] >= 0):
                return _pruned(tree, chosen)
            return tree
        known |= dict(zip(queue, (yield queue, False), strict=True))


def _pruned(tree: Tree, chosen: set[int]) -> Tree:
    out, at = Tree(tree.weight[0], tree.grad[0]), [(0, 0)]
    while at:
        old, new = at.pop(0)
        if old in chosen:
            w, g = tree.weight[tree.left[old]], tree.grad[tree.left[old]]
            at += zip((tree.left[old], tree.right[old]), out.split(new, tree.feature[old], tree.cut[old], tree.gain[old], w, g), strict=True)
    return out


def leaf_values(tree: Tree, spec: Spec, unit: float) -> np.ndarray:
    w, g = np.array(tree.weight), np.array(tree.grad) * unit
    return spec.rate * g / np.maximum(w + spec.l2, 1e-12) * (w > 0)


def _finish(rows: LocalRows, tree: Tree, spec: Spec) -> Tree:
    talk = grow(tree, spec)
    try:
        asked, shared = next(talk)
        while True:
            asked, shared = talk.send(rows.answer(tree, asked, shared))
    except StopIteration as done:
        return done.value


@dataclass
class Ensemble:
    """Trees with their leaf values; ``base`` is added to their sum (boosting) or mean (forest)."""

    spec: Spec
    features: list[str]
    base: float
    feature: np.ndarray  # all trees one after the other
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, trees: list[tuple[Tree, np.ndarray]], spec: Spec, features: Sequence[str], base: float, edges) -> Ensemble:
        feature = np.concatenate([t.feature for t, _ in trees]).astype(np.int32)
        cut = np.concatenate([t.cut for t, _ in trees])
        threshold = np.array([edges[f][c] if f >= 0 else 0.0 for f, c in zip(feature.tolist(), cut.tolist(), strict=True)])
        starts = np.cumsum([0, *(len(t.feature) for t, _ in trees)])
        links = [np.concatenate([np.array(getattr(t, side)) + s for (t, _), s in zip(trees, starts)]).astype(np.int32) for side in ("left", "right")]
        return cls(spec, list(features), base, feature, threshold, *links, np.concatenate([v for _, v in trees]),
                   np.concatenate([t.gain for t, _ in trees]), starts)

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for root in self.starts[:-1]:
            node = np.full(len(x), root)
            moving = np.arange(len(x)) if self.feature[root] >= 0 else np.zeros(0, np.int64)
            while len(moving):
                at = node[moving]
                node[moving] = np.where(x[moving, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
                moving = moving[self.feature[node[moving]] >= 0]
            total += self.value[node]
        return self.base + (total if self.spec.boosted else total / max(len(self.starts) - 1, 1))

    def importances(self) -> np.ndarray:
        """Share of the gain of each feature, per tree, averaged over trees that split."""
        out, seen = np.zeros(len(self.features)), 0
        for a, b in zip(self.starts[:-1], self.starts[1:]):
            inner = self.feature[a:b] >= 0
            if inner.any():
                own = np.bincount(self.feature[a:b][inner], self.gain[a:b][inner], len(self.features))
                out, seen = out + own / own.sum(), seen + 1
        return out / max(seen, 1)


def _grow_forest_tree(spec: Spec, number: int, x, rows, grad, edges) -> Tree:
    local = LocalRows(x, row_weights(spec, number, rows), grad, spec, number, edges, column_mask(spec, number, x.shape[1]))
    return _finish(local, local.start(), spec)


def _grow_chain(spec: Spec, x, rows, grad, unit: float, edges) -> list[tuple[Tree, np.ndarray]]:
    """All boosted trees of a model on rows that one task holds."""
    left, out = grad.copy(), []
    for k in range(spec.trees):
        local = LocalRows(x, row_weights(spec, k, rows), np.rint(left), spec, k, edges, column_mask(spec, k, x.shape[1]))
        tree = _finish(local, local.start(), spec)
        values = leaf_values(tree, spec, unit)
        left -= values[tree.route(x, np.zeros(len(x), np.int64))] / unit
        out.append((tree, values))
    return out


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """At most ``bins - 1`` ascending edges a feature, from one mergeable quantile sketch over all rows; at most 255 numbers a feature."""
    shares = [i / bins for i in range(1, bins)]
    found = df.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(f"q{i}") for i, f in enumerate(features)],
                   *[F.max(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)]).first()
    out = []
    for i in range(len(features)):
        e = np.unique(np.array(found[f"q{i}"] or [], float))
        out.append(e[e < found[f"m{i}"]] if len(e) else e)  # no cut above the largest value
    return out


def binned(df: DataFrame, features: Sequence[str], label: str, edges: Sequence[np.ndarray]) -> DataFrame:
    """Rows as ``row``, ``x`` (a byte a feature) and ``y``; written once, so that row numbers hold. Null labels are left out."""
    wanted = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.searchsorted(e, batch.column(i).to_numpy(zero_copy_only=False), "left") for i, e in enumerate(edges)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(len(edges))], names=["x", "y"])
    made = wanted.filter(F.col("y").isNotNull()).mapInArrow(run, "x binary, y double")
    return cut_lineage(made.withColumn("row", F.monotonically_increasing_id()))


def _matrix(column: pa.Array, features: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, features)


def fit(df: DataFrame, features: Sequence[str], label: str, specs: dict[str, Spec], local_rows: int = LOCAL_ROWS) -> dict[str, Ensemble]:
    """All models of ``specs`` on the rows of ``df``; those that fit one task are grown in one job."""
    workers_see_package(df.sparkSession)
    edges = bin_edges(df, features)
    rows = binned(df, features, label, edges)
    whole = rows.agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.min("y").alias("low"), F.max("y").alias("high")).first()
    n, base = whole["n"], whole["mean"] or 0.0
    reach = max((whole["high"] or 0.0) - base, base - (whole["low"] or 0.0), 1e-12)
    unit = 2.0 ** np.ceil(np.log2(reach)) / FINE
    if n <= local_rows:
        made = _fit_in_tasks(rows, len(features), base, unit, edges, specs)
    else:
        made = _Passes(rows, len(features), base, unit, edges, local_rows).fit(specs)
    return {name: Ensemble.of(made[name], spec, features, base, edges) for name, spec in specs.items()}


def predict(df: DataFrame, models: dict[str, Ensemble]) -> DataFrame:
    """``df`` with one more column for each model; all models in one pass."""
    spark = df.sparkSession
    workers_see_package(spark)
    names = list(dict.fromkeys(f for m in models.values() for f in m.features))
    columns, held = df.columns, spark.sparkContext.broadcast(list(models.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {n: i for i, n in enumerate(columns)}
        for batch in batches:
            x = {n: batch.column(at[n]).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names}
            new = [pa.array(m.predict(np.stack([x[f] for f in m.features], 1))) for m in held.value]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*columns, *models])
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in models)])
    return df.mapInArrow(run, schema)


def _packed(tree: Tree) -> dict:
    return {k: np.asarray(v, t).tobytes() for k, v, t in (
        ("feature", tree.feature, "<i4"), ("cut", tree.cut, "<i4"), ("left", tree.left, "<i4"), ("right", tree.right, "<i4"),
        ("gain", tree.gain, "<f8"), ("weight", tree.weight, "<f8"), ("grad", tree.grad, "<f8"))}


def _unpacked(row: dict) -> Tree:
    out = Tree()
    for k, t in (("feature", "<i4"), ("cut", "<i4"), ("left", "<i4"), ("right", "<i4"), ("gain", "<f8"), ("weight", "<f8"), ("grad", "<f8")):
        setattr(out, k, np.frombuffer(row[k], t).tolist())
    return out


_TREE_FIELDS = [pa.field(c, pa.binary()) for c in ("feature", "cut", "left", "right", "gain", "weight", "grad")]
_TREE = "feature binary, cut binary, left binary, right binary, gain binary, weight binary, grad binary"


def _fit_in_tasks(rows: DataFrame, features: int, base: float, unit: float, edges, specs: dict[str, Spec]) -> dict[str, list]:
    """Trees of forests and chains of boosted trees as tasks; the rows, at most ``LOCAL_ROWS``, are sent to each."""
    spark = rows.sparkSession
    table = rows.orderBy("row").toArrow().combine_chunks()
    x = _matrix(table.column("x"), features) if table.num_rows else np.zeros((0, features), np.uint8)
    held = spark.sparkContext.broadcast((x, table.column("row").to_numpy(), np.rint((table.column("y").to_numpy() - base) / unit)))
    names = list(specs)
    # A chain is a task, the first ones, as they take longest; trees of forests are dealt to a few tasks a core.
    single = [(i, k) for i, m in enumerate(names) if not specs[m].boosted for k in range(specs[m].trees)]
    tasks = max(1, min(len(single), 4 * spark.sparkContext.defaultParallelism))
    jobs = [[(i, 0)] for i, m in enumerate(names) if specs[m].boosted] + [single[k::tasks] for k in range(tasks) if single]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, numbers, grad = held.value
        for batch in batches:
            for model, tree in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                spec = specs[names[model]]
                made = ([t for t, _ in _grow_chain(spec, x, numbers, grad, unit, edges)] if spec.boosted
                        else [_grow_forest_tree(spec, tree, x, numbers, grad, edges)])
                out = [{"model": model, "tree": tree + i, **_packed(t)} for i, t in enumerate(made)]
                yield pa.RecordBatch.from_pylist(out, pa.schema([("model", pa.int32()), ("tree", pa.int32()), *_TREE_FIELDS]))
    dealt = spark.createDataFrame(spark.sparkContext.parallelize(jobs, len(jobs)).flatMap(list), "model int, tree int")
    found = dealt.mapInArrow(run, f"model int, tree int, {_TREE}").toArrow().to_pylist()
    held.unpersist()
    out: dict[str, list] = {m: [] for m in names}
    for r in sorted(found, key=lambda r: (r["model"], r["tree"])):
        spec, tree = specs[names[r["model"]]], _unpacked(r)
        out[names[r["model"]]].append((tree, leaf_values(tree, spec, unit)))
    return out


@dataclass
class _Growing:
    """A tree in growth at the driver: its model, number, and what it waits for."""

    model: str
    number: int
    tree: Tree
    talk: Conversation
    asked: list[int]
    shared: bool


_SPLITS = "request int, slot int, feature int, score double, cut int, gain double, w double, g double, total_w double, total_g double"


class _Passes:
    """Training by passes over rows of any number: a job answers all open nodes of all trees in growth."""

    def __init__(self, rows: DataFrame, features: int, base: float, unit: float, edges, local_rows: int):
        self.rows, self.features, self.base, self.unit, self.edges, self.local_rows = rows, features, base, unit, edges, local_rows

    def fit(self, specs: dict[str, Spec]) -> dict[str, list]:
        self.specs, self.chains = specs, [m for m, s in specs.items() if s.boosted]
        self.made: dict[str, list] = {m: [] for m in specs}
        self.written = dict.fromkeys(self.chains, 0)
        self.rows = self._with_left(self.rows)
        growing = [g for m, s in specs.items() for k in range(1 if s.boosted else s.trees) if (g := self._begin(m, k))]
        while growing:
            answers = self._answers(growing)
            growing = [h for g, found in zip(growing, answers, strict=True) if (h := self._go_on(g, found))]
            if any(len(self.made[m]) - self.written[m] >= RENEW for m in self.chains):
                self.rows = self._with_left(self.rows)
        for m, s in specs.items():
            if not s.boosted:
                self.made[m] = [(t, leaf_values(t, s, self.unit)) for t in self._completed(m, [t for _, t in sorted(self.made[m], key=lambda x: x[0])])]
        return self.made

    def _begin(self, model: str, number: int) -> _Growing | None:
        spec = self.specs[model]
        if number >= spec.trees:
            return None
        tree = Tree(np.inf)
        # Nodes of a forest that fit a task are finished later, all at once.
        talk = grow(tree, spec if spec.boosted else replace(spec, min_rows=max(spec.min_rows, (self.local_rows + 1) / 2)))
        asked, shared = next(talk)
        return _Growing(model, number, tree, talk, asked, shared)

    def _go_on(self, g: _Growing, found: list) -> _Growing | None:
        spec = self.specs[g.model]
        if g.asked == [0]:
            _, g.tree.weight[0], g.tree.grad[0] = found[0]
        try:
            g.asked, g.shared = g.talk.send([s for s, _, _ in found])
            return g
        except StopIteration as done:
            tree = done.value
        if not spec.boosted:
            self.made[g.model].append((g.number, tree))
            return None
        self.made[g.model].append((tree, leaf_values(tree, spec, self.unit)))
        return self._begin(g.model, g.number + 1)

    def _with_left(self, rows: DataFrame) -> DataFrame:
        """Rows with what the boosted trees so far leave of the gradient of each chain."""
        first, unit, base = "left" not in rows.columns, self.unit, self.base
        new = [self.made[m][self.written[m]:] for m in self.chains]
        self.written = {m: len(self.made[m]) for m in self.chains}
        features = self.features

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = _matrix(batch.column(0), features), batch.column(1).to_numpy()
                if first:
                    left = np.repeat(np.rint((y - base) / unit)[:, None], len(new), 1)
                else:
                    left = batch.column(3).flatten().to_numpy().reshape(len(y), len(new)).copy()
                for i, trees in enumerate(new):
                    for tree, values in trees:
                        left[:, i] -= values[tree.route(x, np.zeros(len(x), np.int64))] / unit
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * len(new), pa.int32()), pa.array(left.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=["x", "y", "row", "left"])
        columns = ["x", "y", "row"] + ([] if first else ["left"])
        return cut_lineage(rows.select(columns).mapInArrow(run, "x binary, y double, row long, left array<double>"))

    def _state(self, requests):
        """For a batch: weight, gradient and node of its rows in each tree."""
        recent = [self.made[m][self.written[m]:] for m in self.chains]
        specs, chains, features, unit, base = self.specs, self.chains, self.features, self.unit, self.base

        def of(batch):
            x, y, row = _matrix(batch.column(0), features), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            left = batch.column(3).flatten().to_numpy().reshape(len(y), len(chains)).copy()
            for i, trees in enumerate(recent):
                for tree, values in trees:
                    left[:, i] -= values[tree.route(x, np.zeros(len(x), np.int64))] / unit
            for model, number, tree in requests:
                spec = specs[model]
                grad = np.rint(left[:, chains.index(model)]) if spec.boosted else np.rint((y - base) / unit)
                yield x, row, row_weights(spec, number, row), grad, tree.route(x, np.zeros(len(x), np.int64))
        return of

    def _answers(self, growing: list[_Growing]) -> list[list]:
        """(split or None, weight, gradient) of every node that is asked for."""
        most = max(1, PASS_BYTES // (16 * self.features * BINS))
        parts: list[tuple[int, list[int]]] = []
        for i, g in enumerate(growing):
            step = len(g.asked) if g.shared else most  # a symmetric level is answered as a whole
            parts += [(i, g.asked[k: k + step]) for k in range(0, len(g.asked), step)]
        found: dict[tuple[int, int], tuple] = {}
        while parts:
            now, size = [], 0
            while parts and (not now or size + len(parts[0][1]) <= most):
                now.append(parts.pop(0))
                size += len(now[-1][1])
            for shared in (False, True):
                if some := [(growing[i], i, nodes) for i, nodes in now if growing[i].shared == shared]:
                    for r in self._pass([(g, nodes) for g, _, nodes in some], shared):
                        _, i, nodes = some[r["request"]]
                        split = (r["feature"], r["cut"], r["gain"], r["w"], r["g"]) if r["score"] > 0 else None
                        found[i, nodes[r["slot"]]] = (split, r["total_w"], r["total_g"])
        return [[found.get((i, n), (None, 0.0, 0.0)) for n in g.asked] for i, g in enumerate(growing)]

    def _pass(self, some: list[tuple[_Growing, list[int]]], shared: bool) -> list:
        features, edges = self.features, self.edges
        state = self._state([(g.model, g.number, g.tree) for g, _ in some])
        asked = [nodes for _, nodes in some]
        sizes = [len(g.tree.feature) for g, _ in some]
        about = [(self.specs[g.model], g.number, np.array([g.tree.place[n] for n in nodes]), column_mask(self.specs[g.model], g.number, features)) for g, nodes in some]

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros((2, len(nodes), features, BINS)) for nodes in asked]
            for batch in batches:
                for q, (x, _, weight, grad, node) in enumerate(state(batch)):
                    slot = np.full(sizes[q], -1)
                    slot[asked[q]] = np.arange(len(asked[q]))
                    rows = np.flatnonzero((slot[node] >= 0) & (weight > 0))
                    total[q] += sums(x[rows], slot[node[rows]], weight[rows], grad[rows], len(asked[q]))
            for q, t in enumerate(total):
                s, f = np.nonzero(t[0].any(2))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(s), q, np.int32)), pa.array(s.astype(np.int32)), pa.array(f.astype(np.int32)),
                    pa.array([t[0, a, b].tobytes() for a, b in zip(s, f)], pa.binary()), pa.array([t[1, a, b].tobytes() for a, b in zip(s, f)], pa.binary())],
                    names=["request", "slot", "feature", "ws", "gs"])

        def summed(table: pa.Table) -> np.ndarray:
            return np.stack([np.sum([np.frombuffer(b) for b in table.column(c).to_pylist()], 0) for c in ("ws", "gs")])

        def added(key, table):
            w, g = summed(table)
            return pa.table({"request": [key[0].as_py()], "slot": [key[1].as_py()], "feature": [key[2].as_py()], "ws": pa.array([w.tobytes()], pa.binary()),
                             "gs": pa.array([g.tobytes()], pa.binary())}).cast(table.schema)

        def rated(q: int, slots: list[int], f: int, both: np.ndarray) -> pa.Table:
            spec, number, places, allowed = about[q]
            cut, gain, w, g = split_sums(both, spec, number, places[slots], allowed[[f]], edges, np.array([f]))
            found = shared_split(cut, gain, w, g) if shared else _best_of_each(cut, gain, w, g)
            score = np.maximum(gain, 0).sum(0).max() if shared else 0.0
            rows = []
            for i, (s, split) in enumerate(zip(slots, found, strict=True)):
                _, c, own, lw, lg = split or (0, 0, 0.0, 0.0, 0.0)
                total_w, total_g = both[0, i].sum(), both[1, i].sum()
                rows.append((q, s, f, float(score if shared else own), c, own, lw, lg, float(total_w), float(total_g)))
            return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), *[pa.float64()] * 5))],
                            names=[x.split()[0] for x in _SPLITS.split(", ")])

        def each(key, table):
            return rated(int(key[0].as_py()), [int(key[1].as_py())], int(key[2].as_py()), summed(table)[:, None, None])

        def level(key, table):
            table = table.sort_by("slot")
            both = np.stack([[np.frombuffer(b) for b in table.column(c).to_pylist()] for c in ("ws", "gs")])[:, :, None]
            return rated(int(key[0].as_py()), table.column("slot").to_pylist(), int(key[1].as_py()), both)

        parts = self.rows.mapInArrow(add_up, "request int, slot int, feature int, ws binary, gs binary").groupBy("request", "slot", "feature")
        if shared:
            whole = parts.applyInArrow(added, "request int, slot int, feature int, ws binary, gs binary")
            splits = whole.groupBy("request", "feature").applyInArrow(level, _SPLITS)
        else:
            splits = parts.applyInArrow(each, _SPLITS)
        best = splits.groupBy("request", "slot").agg(F.max_by(F.struct("feature", "score", "cut", "gain", "w", "g", "total_w", "total_g"),
                                                              F.struct("score", -F.col("feature"))).alias("best"))
        return best.select("request", "slot", "best.*").collect()

    def _completed(self, model: str, trees: list[Tree], wave: int = 16) -> list[Tree]:
        """Finishes the nodes of a forest that fit a task: their rows are shuffled by (tree, node)."""
        spec, features, edges = self.specs[model], self.features, self.edges
        for low in range(0, len(trees), wave):
            some = trees[low: low + wave]
            state = self._state([(model, low + i, t) for i, t in enumerate(some)])
            opened = [{n for n, f in enumerate(t.feature) if f < 0 and t.weight[n] >= 2 * spec.min_rows and (spec.depth is None or t.depth[n] < spec.depth)} for t in some]
            places, depths = [t.place for t in some], [t.depth for t in some]

            def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for q, (x, row, weight, grad, node) in enumerate(state(batch)):
                        at = np.flatnonzero((weight > 0) & np.isin(node, list(opened[q])))
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(at), q, np.int32)), pa.array(node[at].astype(np.int32)), pa.array([x[i].tobytes() for i in at], pa.binary()),
                            pa.array(weight[at]), pa.array(grad[at])], names=["tree", "node", "x", "weight", "grad"])

            def finish(key, table):
                q, n = key[0].as_py(), key[1].as_py()
                own = replace(spec, depth=None if spec.depth is None else spec.depth - depths[q][n])
                local = LocalRows(_matrix(table.column("x").combine_chunks(), features), table.column("weight").to_numpy(), table.column("grad").to_numpy(),
                                  own, low + q, edges, column_mask(spec, low + q, features))
                return pa.Table.from_pylist([{"tree": q, "node": n, **_packed(_finish(local, local.start(places[q][n]), own))}],
                                            pa.schema([("tree", pa.int32()), ("node", pa.int32()), *_TREE_FIELDS]))
            rows = self.rows.mapInArrow(deal, "tree int, node int, x binary, weight double, grad double")
            for r in rows.groupBy("tree", "node").applyInArrow(finish, f"tree int, node int, {_TREE}").toArrow().to_pylist():
                some[r["tree"]].graft(r["node"], _unpacked(r))
        return trees
