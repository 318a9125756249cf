"""Chunked ordered work equals the plain single-partition form."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from heliofleet.operators import chunks
from heliofleet.operators.chunks import Order, exact_quantiles, halo_window, neighbours, number_rows, running_sum, value_ranks

BASE = pd.Timestamp("2024-03-01")
ORDER = Order(keys=("k",), time="t", width=3600)


def frame(spark, n=400, seed=1, hot=0.5):
    """Irregular series with one key holding half of the rows, and NULL values."""
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(n) < hot, "hot", rng.choice(["a", "b", "c"], n))
    minutes = rng.choice(60 * 24 * 4, n, replace=False)
    values = np.round(rng.normal(size=n), 3)
    pdf = pd.DataFrame({"k": keys, "t": BASE + pd.to_timedelta(minutes, unit="m"), "v": values})
    rows = [(k, t.to_pydatetime(), None if rng.random() < 0.3 else float(v)) for k, t, v in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "k string, t timestamp_ntz, v double")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_number_rows(spark):
    df = frame(spark)
    plain = df.withColumn("_pos", F.row_number().over(Window.partitionBy("k").orderBy("t")) - 1)
    assert rows(number_rows(df, ORDER), "k", "t", "_pos") == rows(plain, "k", "t", "_pos")


@pytest.mark.parametrize("size", [1, 7, 50, 4096])
def test_halo_window_equals_plain_window(spark, size):
    df = frame(spark)
    w = Window.partitionBy("k").orderBy("t")

    def columns():
        return {
            "lag3": lambda x: F.lag("v", 3).over(x), "lead5": lambda x: F.lead("v", 5).over(x),
            "mean": lambda x: F.round(F.avg("v").over(x.rowsBetween(-6, 2)), 9),
            "n": lambda x: F.count("v").over(x.rowsBetween(-6, -1)),
        }

    plain = df.withColumns({n: f(w) for n, f in columns().items()})
    chunked = halo_window(df, columns(), 6, 5, ORDER, rows=size)
    assert rows(chunked, "k", "t", *columns()) == rows(plain, "k", "t", *columns())


def test_even_chunks_split_a_burst(spark):
    """A third of all rows inside one hour of one series."""
    calm = frame(spark)
    burst = spark.range(200).select(
        F.lit("hot").alias("k"), F.timestamp_micros(F.col("id") * 1_000_003 + F.lit(1709287200000000)).cast("timestamp_ntz").alias("t"),
        F.col("id").cast("double").alias("v"))
    df = calm.unionByName(burst)
    even = Order(keys=("k",), time="t", parts=16)
    assert even.chunked(df).filter("k = 'hot'").groupBy("_chunk").count().agg(F.max("count")).first()[0] <= 80
    plain = df.withColumn("_pos", F.row_number().over(Window.partitionBy("k").orderBy("t")) - 1)
    assert rows(number_rows(df, even), "k", "t", "_pos") == rows(plain, "k", "t", "_pos")
    w = Window.partitionBy("k").orderBy("t")
    want = df.withColumns({"prev_x": F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                           "next_x": F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    assert rows(neighbours(df, {"x": F.col("v")}, even), "k", "t", "prev_x", "next_x") == rows(want, "k", "t", "prev_x", "next_x")


def test_join_ranked_equals_plain_join(spark):
    pdf, df = hot_values(spark)
    ranks = value_ranks(df, "v", ["k"]).select("k", "v", "n_equal", "n_below")
    got = chunks.join_ranked(df, ranks, ["k", "v"], "n_equal", share=20)
    assert rows(got, "k", "v", "n_below") == rows(df.join(ranks, ["k", "v"]), "k", "v", "n_below")
    assert got.count() == len(pdf)


def test_running_sum(spark):
    df = frame(spark)
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumn("s", F.round(F.coalesce(F.sum("v").over(w), F.lit(0)), 6))
    got = running_sum(df, {"s": F.col("v")}, ORDER).withColumn("s", F.round("s", 6))
    assert rows(got, "k", "t", "s") == rows(plain, "k", "t", "s")


def test_neighbours_cross_chunks(spark):
    df = frame(spark)
    w = Window.partitionBy("k").orderBy("t")
    plain = df.withColumns({
        "prev_x": F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "next_x": F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    })
    got = neighbours(df, {"x": F.col("v")}, ORDER)
    assert rows(got, "k", "t", "prev_x", "next_x") == rows(plain, "k", "t", "prev_x", "next_x")


def hot_values(spark, n=3000):
    """A third of all rows share one value."""
    rng = np.random.default_rng(3)
    values = np.where(rng.random(n) < 0.34, 5.0, np.round(rng.lognormal(size=n), 2))
    keys = rng.choice(["a", "b"], n, p=[0.8, 0.2])
    pdf = pd.DataFrame({"k": keys, "v": values})
    return pdf, spark.createDataFrame(pdf)


def test_value_ranks_with_hot_value(spark):
    pdf, df = hot_values(spark)
    got = {(r["k"], r["v"]): r["n_below"] + (r["n_equal"] + 1) / 2 for r in value_ranks(df, "v", ["k"]).collect()}
    want = pdf.assign(r=pdf.groupby("k")["v"].rank(method="average"))
    assert all(abs(got[k, v] - r) < 1e-9 for k, v, r in want.itertuples(index=False))


@pytest.mark.parametrize("by", [[], ["k"]])
def test_exact_quantiles(spark, by):
    pdf, df = hot_values(spark)
    probs = (0.0, 0.013, 0.25, 0.5, 0.667, 0.99, 1.0)
    got = {(*[r[b] for b in by], r["p"]): r["q"] for r in exact_quantiles(df, "v", probs, by, parts=16).collect()}
    groups = pdf.groupby(by) if by else [((), pdf)]
    for key, g in groups:
        for p in probs:
            assert got[(*key, p)] == pytest.approx(np.quantile(g["v"], p), abs=1e-12)


def test_quantiles_of_one_value_and_of_none(spark):
    one = spark.createDataFrame([(1.5,)] * 10, "v double")
    assert [r["q"] for r in exact_quantiles(one, "v", (0.25, 0.75)).collect()] == [1.5, 1.5]
    none = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(none, "v", (0.5,)).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5000), st.floats(-100, 100, allow_nan=False)), min_size=1, max_size=60, unique_by=lambda x: x[0]))
def test_lags_never_look_ahead(spark, points):
    data = [("k", (BASE + pd.Timedelta(minutes=m)).to_pydatetime(), float(v)) for m, v in points]
    df = spark.createDataFrame(data, "k string, t timestamp_ntz, v double")
    got = halo_window(df, {"seen": lambda w: F.max("t").over(w.rowsBetween(-4, -1))}, 4, order=ORDER, rows=5)
    assert got.filter(F.col("seen") >= F.col("t")).count() == 0
    assert got.count() == len(points)


def test_bucket_borders_are_bounded(spark):
    _, df = hot_values(spark)
    n = chunks.bucket_by_value(df, "v", 16).select("_bucket").distinct().count()
    assert n <= 16
