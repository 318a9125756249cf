"""Stored category index and sparse one-hot rows, up to fleets of more plants than columns."""

from pyspark.sql import functions as F

from heliofleet import contracts as C
from heliofleet.operators.categories import add_one_hot_vector, category_index
from heliofleet.plans import models
from heliofleet.plans.features import build_features, feature_columns


def fleet(spark, plants, rows):
    i, t = F.col("id") % plants, F.floor(F.col("id") / plants)
    return spark.range(plants * rows).select(
        F.concat(F.lit("p"), F.lpad(i.cast("string"), 5, "0")).alias(C.PLANT),
        F.timestamp_micros(F.lit(1709287200000000) + t * 900_000_000).cast("timestamp_ntz").alias(C.TS), (i % 9 * 90.0 + t).alias(C.RADIATION),
        (i % 5 + t / 10.0).alias(C.POWER), (20.0 + i % 3).alias(C.TEMPERATURE), (i % 5 / 10.0 + t / 100.0).alias(C.TARGET))


def test_positions_follow_the_order(spark):
    df = spark.range(2000).select(F.concat(F.lit("k"), F.col("id") % 333).alias("k")).union(spark.createDataFrame([(None,)], "k string"))
    index = category_index(df.repartition(7), "k")
    want = sorted(f"k{i}" for i in range(333))
    assert index.size == 333 and [(r.category, r.position) for r in index.table.orderBy("position").collect()] == [(k, i) for i, k in enumerate(want)]


def test_unknown_null_and_first(spark):
    index = category_index(spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "k string"), "k")
    rows = spark.createDataFrame([("a",), ("c",), ("x",), (None,)], "k string")
    whole = {r.k: (r.k_index, r.k_vector.size, r.k_vector.indices.tolist()) for r in add_one_hot_vector(rows, "k", index, "k").collect()}
    assert whole == {"a": (0, 3, [0]), "c": (2, 3, [2]), "x": (None, 3, []), None: (None, 3, [])}
    fewer = {r.k: (r.k_vector.size, r.k_vector.indices.tolist()) for r in add_one_hot_vector(rows, "k", index, "k", drop_first=True).collect()}
    assert fewer == {"a": (2, []), "c": (2, [1]), "x": (2, []), None: (2, [])}


def test_empty_index(spark):
    rows = spark.createDataFrame([], "k string")
    index = category_index(rows, "k")
    assert index.size == 0 and add_one_hot_vector(rows, "k", index, "k").count() == 0


def test_more_than_a_thousand_plants(spark):
    df = fleet(spark, 1001, 8)
    index = category_index(df, C.PLANT)
    out = build_features(df, C.Features(lags={C.TARGET: (1,)}, windows={}), index)
    assert out.columns[-2:] == ["plant_index", "plant_vector"] and not any(c.startswith("plant_p") for c in out.columns)
    rows = out.select(C.PLANT, "plant_index", "plant_vector").distinct().collect()
    assert len(rows) == 1001 and all((r.plant_vector.size, r.plant_vector.indices.tolist()) == (1001, [int(r[C.PLANT][1:])]) for r in rows)


def test_a_thousand_and_one_columns(spark):
    bare = C.Features(groups=frozenset({"plant"})).without_memory()
    out = build_features(fleet(spark, 1001, 1), bare)
    assert sum(c.startswith("plant_p") for c in out.columns) == 1001


def test_models_take_the_vector_or_the_index(spark):
    df = fleet(spark, 6, 60)
    out = build_features(df, C.Features(lags={C.TARGET: (1,)}, windows={}), category_index(df, C.PLANT))
    names = [f for f in feature_columns(out) if not f.startswith("regime")]
    both = models.registry(n_trees=3, rounds=3)
    fitted = models.fit_all(out, names, {k: both[k] for k in ("ridge", "boosted_depth6")})
    assert "plant_vector" not in fitted["boosted_depth6"].stages[-1].ensemble.features
    assert "plant_index" not in fitted["ridge"].stages[0].getInputCols()
    scored = models.predict_all(out, fitted, [C.PLANT]).groupBy("model").agg(F.count("y_pred").alias("n")).collect()
    assert {r.model: r.n for r in scored} == {"ridge": out.count(), "boosted_depth6": out.count()}
