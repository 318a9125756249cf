"""Results that must not vanish or be cut: many groups, constant groups, wide files, several sites, half-written stages."""

import math
import os
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heliofleet.checks.compare import compare
from heliofleet.functions.special import chi2_tail, chi2_tail_of
from heliofleet.operators import stats
from heliofleet.plans import cleaning
from heliofleet.sources import files, sinks


def test_chi_square_tail_of_any_degrees(spark):
    rows = spark.range(1, 31).select(F.col("id").alias("df"), (F.col("id") * 1.3).alias("x"))
    got = {r.df: r.p for r in rows.select("df", chi2_tail_of(F.col("x"), F.col("df")).alias("p")).collect()}
    want = rows.select(*[chi2_tail(F.lit(1.3 * k), k).alias(f"p{k}") for k in range(1, 31)]).first()
    assert all(got[k] == pytest.approx(want[f"p{k}"], abs=1e-9) for k in got)
    far = spark.range(1).select(chi2_tail_of(F.lit(2000.0), F.lit(2000)).alias("p")).first().p
    assert far == pytest.approx(0.4958, abs=1e-3)  # mean of the distribution: a little under one half
    assert spark.range(1).select(chi2_tail_of(F.lit(2 * math.log(20)), F.lit(2)).alias("p")).first().p == pytest.approx(0.05)


def test_kruskal_wallis_with_twenty_groups(spark):
    rows = spark.range(400).select((F.col("id") % 20).alias("g"), (F.col("id") * 7919 % 401).cast("double").alias("v"))
    got = stats.kruskal_wallis(rows, "v", "g").first()
    assert got["k"] == 20 and 0 < got["p_value"] <= 1


def test_constant_groups_keep_their_rows(spark):
    rows = spark.createDataFrame([("a", float(i), float(i)) for i in range(50)] + [("b", 3.0, 3.0)] * 20, "id_planta string, v double, w double")
    assert rows.count() == stats.histogram(rows, "v", by=["id_planta"]).agg(F.sum("n")).first()[0]
    assert rows.count() == stats.hexagon_counts(rows, "v", "w", by=["id_planta"]).agg(F.sum("n")).first()[0]
    ks = {r["id_planta"]: r for r in stats.kolmogorov_smirnov(rows, "v", ["id_planta"]).collect()}
    assert ks["b"]["n"] == 20 and ks["b"]["statistic"] is None and ks["b"]["p_value"] is None and ks["a"]["statistic"] > 0


def test_export_of_any_width(spark, tmp_path):
    os.makedirs(tmp_path / "2024/01")
    head = ["Fecha y hora" if i == 0 else f"x{i}" for i in range(70)]
    head[0], head[3], head[67] = files.TIME_HEADER, files.RADIATION_HEADER, "SITE 1"
    line = ["2024-01-01 10:00:00"] + ['"a,b"' if i == 2 else str(i) for i in range(1, 70)]
    (tmp_path / "2024/01/wide.csv").write_text(",".join(head) + "\n" + ",".join(line) + "\n", encoding="iso-8859-1")
    good, bad = files.scan_exports(spark, str(tmp_path), ("SITE 1",))
    assert bad.count() == 0 and [(r["radiation"], r["power"]) for r in good.collect()] == [(3.0, 67.0)]


def test_weather_of_two_sites(spark):
    t0 = datetime(2024, 1, 1)
    readings = spark.createDataFrame([(p, t0 + timedelta(minutes=15 * i), 1.0) for p in "ab" for i in range(4)],
                                     "id_planta string, timestamp timestamp_ntz, power double").withColumn("radiation", F.lit(1.0)).withColumn("T_ambiente", F.lit(0.0))
    weather = spark.createDataFrame([(s, t0 + timedelta(minutes=15 * i), t) for s, t in (("n", 5.0), ("s", 25.0)) for i in range(4)],
                                    "site string, timestamp timestamp_ntz, T_ambiente double")
    sites = spark.createDataFrame([("a", "n"), ("b", "s")], "id_planta string, site string")
    got = cleaning.attach_temperature(readings, weather, sites=sites).collect()
    assert len(got) == 8 and {(r["id_planta"], r["T_ambiente"]) for r in got} == {("a", 5.0), ("b", 25.0)}
    with pytest.raises(Exception, match="several sites"):
        cleaning.attach_temperature(readings, weather).collect()


def test_half_written_stage_is_done_again(spark, tmp_path):
    path = str(tmp_path / "stage")
    rows = spark.range(10)
    assert sinks.materialise(rows, path).count() == 10
    os.remove(f"{path}/_SUCCESS")
    os.remove(next(f"{path}/{f}" for f in os.listdir(path) if f.startswith("part-")))
    assert sinks.materialise(rows, path).count() == 10


def test_lowess_on_tied_values_keeps_every_point(spark):
    rows = spark.range(400).select(F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id") / 4).alias("x"), (F.col("id") % 10).cast("double").alias("y"))
    got = {r["i"]: r["trend"] for r in stats.lowess_grid(rows, "x", "y").collect()}
    assert len(got) == 50 and got[0] == pytest.approx(4.0)


def _plain_lowess(x, y, points, frac, passes):
    """Row by row: tricube lines at grid points, residuals between them, bisquare weights."""
    at = np.linspace(x.min(), x.max(), points)
    weight = np.ones(len(x))
    for last in range(passes + 1):
        trend = []
        for g in at:
            d = np.abs(x - g)
            h = np.sort(d)[int(np.ceil(frac * len(x))) - 1]
            k = np.where(d < h, (1 - np.minimum(d / h, 1) ** 3) ** 3, 0) * weight
            s = [np.sum(k * (x - g) ** p) for p in range(3)]
            t = [np.sum(k * y * (x - g) ** p) for p in range(2)]
            trend.append((s[2] * t[0] - s[1] * t[1]) / (s[0] * s[2] - s[1] ** 2))
        if last < passes:
            e = np.abs(y - np.interp(x, at, trend))
            u = np.minimum(e / (6 * np.median(e)), 1)
            weight = (1 - u ** 2) ** 2
    return trend


def test_robust_lowess_against_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.uniform(0, 100, 500), 1)
    y = np.sin(x / 20) + rng.normal(0, 0.1, 500)
    y[::25] += 30  # outliers that the plain trend follows
    rows = spark.createDataFrame([(g, float(a), float(b) * f) for g, f in (("p", 1), ("q", -2)) for a, b in zip(x, y)] + [("p", None, 1.0)], "g string, x double, y double")
    got = {(r["g"], r["i"]): r["trend"] for r in stats.lowess_grid(rows, "x", "y", points=20, by=("g",), passes=3).collect()}
    assert len(got) == 40
    want = _plain_lowess(x, y, 20, 0.3, 3)
    assert [got["p", i] for i in range(20)] == pytest.approx(want, abs=1e-9) and [got["q", i] for i in range(20)] == pytest.approx([-2 * w for w in want], abs=1e-9)
    assert max(abs(w - np.sin(a / 20)) for w, a in zip(want, np.linspace(x.min(), x.max(), 20))) < 0.4
    flat = spark.range(30).select(F.lit(1.0).alias("x"), F.when(F.col("id") == 0, 9.0).otherwise(2.0).alias("y"))
    assert {r["trend"] for r in stats.lowess_grid(flat, "x", "y", points=5, passes=3).collect()} <= {2.0, (9 + 29 * 2) / 30}
    assert stats.lowess_grid(rows.limit(0), "x", "y", by=("g",), passes=1).count() == 0


def test_lowess_windows_that_no_row_is_inside(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([np.round(rng.uniform(0, 70, 300), 1), np.full(200, 100.0)])
    y = np.sin(x / 20) + rng.normal(0, 0.1, 500)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    at = np.linspace(x.min(), x.max(), 50)
    inside = [np.unique(x[np.abs(x - g) < np.sort(np.abs(x - g))[149]]) for g in at]
    empty = {i for i, d in enumerate(inside) if len(d) == 0}
    assert 49 in empty and len(empty) > 1 and all(len(d) != 1 for d in inside)
    whole = {r["i"]: r["trend"] for r in stats.lowess_grid(rows, "x", "y").collect()}
    left = {r["i"]: r["trend"] for r in stats.lowess_grid(rows, "x", "y", closed=False).collect()}
    assert set(whole) == set(range(50)) and set(left) == set(range(50)) - empty
    assert [whole[i] for i in left] == pytest.approx([left[i] for i in left])
    assert [whole[i] for i in sorted(empty)] == pytest.approx([y[300:].mean()] * len(empty))


def test_robust_lowess_with_windows_that_no_row_is_inside(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([np.round(rng.uniform(0, 70, 300), 1), np.full(200, 100.0)])
    y = np.sin(x / 20) + rng.normal(0, 0.1, 500)
    y[::25] += 5
    at, weight = np.linspace(x.min(), x.max(), 50), np.ones(500)
    for last in range(3):
        want = []
        for g in at:
            d = np.abs(x - g)
            h = np.sort(d)[149]
            k = weight * (np.where(d < h, (1 - np.minimum(d / h, 1) ** 3) ** 3, 0) if (d < h).any() else d == h)
            cx, cy = np.average(x, weights=k), np.average(y, weights=k)
            spread = np.sum(k * (x - cx) ** 2)
            want.append(cy + (np.sum(k * (x - cx) * (y - cy)) / spread * (g - cx) if spread > 1e-9 else 0))
        e = np.abs(y - np.interp(x, at, want))
        weight = (1 - np.minimum(e / (6 * np.median(e)), 1) ** 2) ** 2
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = {r["i"]: r["trend"] for r in stats.lowess_grid(rows, "x", "y", passes=2).collect()}
    assert [got.get(i) for i in range(50)] == pytest.approx(want, abs=1e-8)


def _crowded_events(path):
    """Half of the slots read the sentinel, the others no more than 696: many rows of one radiation far from all others."""
    rng = np.random.default_rng(15)
    n = 5 * 30 * 96
    k = np.where(rng.random(n) < 0.5, 99, rng.integers(0, 59, n))
    kinds = np.repeat(["click", "error", "purchase", "signup", "view"], n // 5)
    slots = np.tile(np.datetime64("2024-01-01", "us") + np.arange(n // 5) * np.timedelta64(15, "m"), 5)
    pd.DataFrame({
        "event_id": np.arange(n), "ts": slots, "user_id": rng.integers(0, 150, n), "event_type": kinds,
        "value": np.round(rng.exponential(50, n), 2), "props": [f'{{"k": {a}}}' for a in k],
    }).to_parquet(f"{path}/events.parquet", coerce_timestamps="us")


@pytest.mark.parametrize("name", ["lowess_trend", "lowess_trend_robust"])
def test_lowess_queries_where_a_third_of_the_rows_share_a_value(spark, tmp_path, name):
    _crowded_events(tmp_path)
    ok, note = compare(spark, str(tmp_path), name)
    assert ok, note


def test_qq_points_against_the_standard_library(spark):
    from statistics import NormalDist

    values = [3.0, 1.0, 1.0, 2.0, 7.0, 1.0]
    got = sorted((r["v"], r["n_equal"], r["score_first"], r["score_last"]) for r in stats.qq_points(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect())
    n = len(values)
    top = 0.5 ** (1 / n)
    score = [NormalDist().inv_cdf(p) for p in [1 - top, *[(i - 0.3175) / (n + 0.365) for i in range(2, n)], top]]
    want = [(1.0, 3, score[0], score[2]), (2.0, 1, score[3], score[3]), (3.0, 1, score[4], score[4]), (7.0, 1, score[5], score[5])]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [x for g in got for x in g[2:]] == pytest.approx([x for w in want for x in w[2:]], abs=1e-6)
