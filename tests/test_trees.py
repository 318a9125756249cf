"""Trees against plain versions; both ways of growing them; models on disk."""

import numpy as np
import pandas as pd
import pytest

from heliofleet.operators import trees
from heliofleet.plans import models

NAMES = list("abcde")


def data(n=700):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 5)).round(2)
    x[:, 3] = rng.integers(0, 3, n)
    x[:, 4] = 1.5  # constant
    return x, (np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 3] == 1) + rng.normal(size=n) * 0.1).round(3)


@pytest.fixture(scope="module")
def frame(spark):
    x, y = data()
    return spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=[*NAMES, "y"])).repartition(3)


def plain_split(x, y, rows, l2=0.0, min_rows=1):
    """Best split of the rows over all values of all features: gain, feature, value."""
    best = (0.0, None, None)
    for f in range(x.shape[1]):
        for v in np.unique(x[rows, f])[:-1]:
            left = rows[x[rows, f] <= v]
            right = rows[x[rows, f] > v]
            if min(len(left), len(right)) >= min_rows:
                gain = sum(y[s].sum() ** 2 / (len(s) + l2) for s in (left, right)) - y[rows].sum() ** 2 / (len(rows) + l2)
                if gain > best[0] + 1e-7:
                    best = (gain, f, v)
    return best


def plain_levels(x, y, depth, l2, min_rows, rate):
    out = np.zeros(len(x))

    def down(rows, d):
        gain, f, v = plain_split(x, y, rows, l2, min_rows) if d else (0, None, None)
        if f is None:
            out[rows] = rate * y[rows].sum() / (len(rows) + l2)
        else:
            down(rows[x[rows, f] <= v], d - 1)
            down(rows[x[rows, f] > v], d - 1)
    down(np.arange(len(x)), depth)
    return out


def plain_best_first(x, y, leaves, min_rows):
    open_leaves = [np.arange(len(x))]
    while len(open_leaves) < leaves:
        found = [plain_split(x, y, rows, 0.0, min_rows) for rows in open_leaves]
        k = max(range(len(found)), key=lambda i: found[i][0])
        gain, f, v = found[k]
        if f is None:
            break
        rows = open_leaves.pop(k)
        open_leaves += [rows[x[rows, f] <= v], rows[x[rows, f] > v]]
    out = np.zeros(len(x))
    for rows in open_leaves:
        out[rows] = y[rows].mean()
    return out, len(open_leaves)


def plain_symmetric(x, y, depth, l2):
    leaf = np.zeros(len(x), int)
    for _ in range(depth):
        best = (0.0, None, None)
        for f in range(x.shape[1]):
            for v in np.unique(x[:, f])[:-1]:
                gain = 0.0
                for k in np.unique(leaf):
                    rows = np.flatnonzero(leaf == k)
                    left, right = rows[x[rows, f] <= v], rows[x[rows, f] > v]
                    if len(left) and len(right):
                        gain += sum(y[s].sum() ** 2 / (len(s) + l2) for s in (left, right)) - y[rows].sum() ** 2 / (len(rows) + l2)
                if gain > best[0] + 1e-7:
                    best = (gain, f, v)
        leaf = 2 * leaf + (x[:, best[1]] > best[2])
    return np.array([y[leaf == k].sum() / ((leaf == k).sum() + l2) for k in leaf]), leaf


def few():
    x, y = data(160)
    return x, y - y.mean()


def fitted(spark, x, y, spec, **kw):
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=[*NAMES, "y"]))
    return trees.fit(df, NAMES, "y", {"m": spec}, **kw)["m"]


@pytest.mark.parametrize("local_rows", [1 << 16, 10])
def test_one_boosted_tree_is_the_plain_one(spark, local_rows):
    x, y = few()
    got = fitted(spark, x, y, trees.Spec(1, True, rate=0.3, depth=3, l2=1.0, min_rows=4), local_rows=local_rows)
    assert np.allclose(got.predict(x), plain_levels(x, y, 3, 1.0, 4, 0.3), atol=1e-5)


def test_forest_tree_reaches_pure_leaves(spark):
    x, y = few()
    got = fitted(spark, x, y, trees.Spec(1))
    assert np.allclose(got.predict(x), y, atol=1e-5)  # rows differ, so every leaf is one value


def test_best_leaf_first_is_the_plain_order(spark):
    x, y = few()
    want, leaves = plain_best_first(x, y, 9, 3)
    got = fitted(spark, x, y, trees.Spec(1, True, "best_first", leaves=9, min_rows=3))
    assert np.allclose(got.predict(x), want, atol=1e-5) and (got.feature < 0).sum() == leaves == 9
    assert max(_depths(got)) > 3  # not bounded by levels


def _depths(model):
    depth = np.zeros(len(model.feature), int)
    for n, f in enumerate(model.feature):
        if f >= 0:
            depth[model.left[n]] = depth[model.right[n]] = depth[n] + 1
    return depth.tolist()


def test_symmetric_tree_has_one_split_a_level(spark):
    x, y = few()
    got = fitted(spark, x, y, trees.Spec(1, True, "symmetric", depth=3, l2=3.0))
    want, _ = plain_symmetric(x, y, 3, 3.0)
    assert np.allclose(got.predict(x), want, atol=1e-5)
    by_level = {}
    for n, d in enumerate(_depths(got)):
        if got.feature[n] >= 0:
            by_level.setdefault(d, set()).add((got.feature[n], got.threshold[n]))
    assert all(len(s) == 1 for s in by_level.values()) and len(by_level) == 3


def test_random_cuts_lie_within_the_node(spark):
    x, y = few()
    a = fitted(spark, x, y, trees.Spec(5, random_cuts=True))
    assert np.allclose(a.predict(x), y, atol=1e-5)
    roots = [(a.feature[s], a.threshold[s]) for s in a.starts[:-1]]
    assert len(set(roots)) > 1 and 4 not in a.feature  # another cut in each tree; never the constant
    for f, t in roots:
        assert x[:, f].min() <= t < x[:, f].max()
    b = fitted(spark, x, y, trees.Spec(5, random_cuts=True, seed=7))
    assert (b.threshold[:1] != a.threshold[:1]).any() or b.feature[0] != a.feature[0]


SPECS = {
    "forest": trees.Spec(3, bootstrap=True), "extra": trees.Spec(3, random_cuts=True),
    "levels": trees.Spec(3, True, rate=0.3, depth=4, l2=1.0, row_share=0.8, column_share=0.8),
    "best_first": trees.Spec(3, True, "best_first", 0.3, leaves=9, min_rows=5, row_share=0.8),
    "symmetric": trees.Spec(3, True, "symmetric", 0.3, depth=4, l2=3.0, row_share=0.8),
}


def test_passes_over_all_rows_give_the_trees_of_a_task(frame, monkeypatch):
    monkeypatch.setattr(trees, "RENEW", 2)
    monkeypatch.setattr(trees, "PASS_BYTES", 16 * 5 * 256 * 20)  # several passes a level
    near = trees.fit(frame, NAMES, "y", SPECS)
    far = trees.fit(frame, NAMES, "y", SPECS, local_rows=90)
    for name in SPECS:
        a, b = near[name], far[name]
        assert len(a.feature) == len(b.feature), name
        x, _ = data()
        assert (a.predict(x) == b.predict(x)).all(), name
        assert np.allclose(a.importances(), b.importances()) and abs(a.importances().sum() - 1) < 1e-9


def test_boosting_learns(frame):
    x, y = data()
    spec = trees.Spec(60, True, rate=0.2, depth=4, l2=1.0, row_share=0.8, column_share=0.8)
    assert np.mean((trees.fit(frame, NAMES, "y", {"m": spec})["m"].predict(x) - y) ** 2) < 0.05 * y.var()


def test_difficult_tables(spark):
    none = spark.createDataFrame([], "a double, y double")
    assert trees.fit(none, ["a"], "y", {"m": trees.Spec(2), "b": trees.Spec(2, True, depth=2)})["b"].predict(np.ones((2, 1))).tolist() == [0, 0]
    rows = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (float("nan"), 2.0), (3.0, None)], "a double, y double")
    model = trees.fit(rows, ["a"], "y", {"m": trees.Spec(2, True, depth=2, rate=1.0)})["m"]
    out = trees.predict(rows.withColumn("p", rows.a), {"y_pred": model}).collect()  # a null or NaN feature goes right
    assert [r.y_pred for r in out] == [2.0] * 4


def test_tree_models_on_disk(spark, frame, tmp_path):
    from heliofleet.sources import sinks

    made = {n: models.PipelineModel([models.TreeModel(e)]) for n, e in trees.fit(frame, NAMES, "y", {"forest": SPECS["forest"]}).items()}
    sinks.save_models(spark, made, str(tmp_path / "m"))
    _, back = sinks.load_model(spark, str(tmp_path / "m"), "forest")
    x, _ = data()
    assert (back.stages[0].ensemble.predict(x) == made["forest"].stages[0].ensemble.predict(x)).all()
    assert back.transform(frame).filter("y_pred IS NULL").count() == 0
    assert list(back.stages[0].featureImportances) == list(made["forest"].stages[0].featureImportances)
