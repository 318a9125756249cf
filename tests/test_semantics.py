"""Edge cases of the scalar rules, splits and statistics."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heliofleet import contracts as C
from heliofleet.functions import scalar as S
from heliofleet.functions import solar, special
from heliofleet.operators import evaluate, quality, series, splits, stats
from heliofleet.plans.features import build_features, feature_columns

R = "id_planta string, timestamp timestamp_ntz, radiation double, power double, T_ambiente double"


def at(text):
    return pd.Timestamp(text).to_pydatetime()


def column(spark, values, kind, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, f"i int, c {kind}").orderBy("i").select(expression(F.col("c"))).collect()]


def test_band_edges(spark):
    got = column(spark, [0.0, 0.1, 100.0, 100.1, 2000.0, 2001.0, None], "double", S.irradiance_band)
    assert got == [None, "<100", "<100", "100-300", ">1000", None, None]


def test_null_radiation_is_top_regime_and_not_daylight(spark):
    assert column(spark, [None, 9.0], "double", S.regime) == ["alta", "noche"]
    assert column(spark, [None, 20.0, 20.1], "double", S.daylight) == [0, 0, 1]


def test_not_finite_becomes_null(spark):
    assert column(spark, [float("nan"), float("inf"), float("-inf"), None, 2.0], "double", S.finite) == [None] * 4 + [2.0]


def test_clip_keeps_null(spark):
    assert column(spark, [None, -1.0, 3.0], "double", lambda c: S.clip(c, 0.0, 2.0)) == [None, 0.0, 2.0]


def test_unknown_ramp_is_steady(spark):
    assert column(spark, [None, 0.05, 0.06, -0.06], "double", S.ramp) == ["Estable", "Estable", "Subida", "Bajada"]


def test_null_marker_anywhere_in_the_cell(spark):
    assert column(spark, ["\\N", "a\\Nb", "12.5", None], "string", S.strip_null_marker) == [None, None, "12.5", None]


def test_text_times(spark):
    got = column(spark, ["2024-01-01 1:05 PM", "2024-01-01 12:00 AM", "x"], "string", lambda c: S.to_timestamp(c, ("yyyy-MM-dd h:mm a",)))
    assert got == [at("2024-01-01 13:05"), at("2024-01-01 00:00"), None]


def test_dates_mean_midnight(spark):
    got = column(spark, [at("2023-12-31 00:00"), at("2023-12-31 00:15")], "timestamp_ntz", lambda c: splits.between(c, None, "2023-12-31"))
    assert got == [True, False]


def test_hour_22_is_kept_at_night(spark):
    rows = [("p", at(f"2024-01-01 {h:02}:00"), 5.0, 1.0, 1.0) for h in (5, 6, 22, 23)]
    got = quality.zero_night_radiation(spark.createDataFrame(rows, R)).orderBy("timestamp").collect()
    assert [r["radiation"] for r in got] == [0.0, 5.0, 5.0, 0.0]


def test_sentinel_keeps_null(spark):
    rows = [("p", at("2024-01-01"), v, 1.0, 1.0) for v in (None, 999.0, 1.0)]
    assert quality.drop_sentinel(spark.createDataFrame(rows, R)).count() == 2


def test_empty_and_stuck_days(spark):
    rows = [("p", at("2024-01-01 10:00"), 5.0, 1.0, 1.0), ("p", at("2024-01-01 11:00"), 5.0, 1.0, 1.0),
            ("p", at("2024-01-02 10:00"), 0.0, 1.0, 1.0), ("p", at("2024-01-03 10:00"), None, 1.0, 1.0),
            ("p", at("2024-01-04 10:00"), 3.0, None, 1.0), ("p", at("2024-01-05 10:00"), 3.0, 1.0, 1.0), ("p", at("2024-01-05 11:00"), 4.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, R)
    kept = {r["d"].day for r in quality.drop_empty_days(df).select(F.to_date("timestamp").alias("d")).collect()}
    assert kept == {1, 5}
    assert {r["day"].day for r in quality.stuck_days(df).collect()} == {1, 4}
    reset = {r["timestamp"].day for r in quality.reset_stuck_days(df).filter("radiation IS NULL").collect()}
    assert reset == {1, 3, 4}


def test_unknown_plant_is_an_error(spark):
    df = spark.createDataFrame([("x", at("2024-01-01"), 1.0, 1.0, 1.0)], R)
    with pytest.raises(Exception, match="no nominal power for: x"):
        quality.add_nominal_power(df, {"p": 10.0}).collect()
    assert quality.add_nominal_power(df, {"p": 10.0}, check=False).first()["power_pu"] is None
    got = quality.add_nominal_power(df, {"x": 10.0}).first()
    assert got["power_pu"] == pytest.approx(1 / 1000 / 10)


def test_required_columns(spark):
    with pytest.raises(ValueError, match="power, radiation"):
        C.require_columns(spark.createDataFrame([(1,)], "T_ambiente int").withColumn("timestamp", F.lit(1)))


def test_bias_is_real_minus_predicted_and_export_is_reversed(spark):
    df = spark.createDataFrame([("m", 3.0, 1.0), ("m", 5.0, 2.0)], "model string, y_true double, y_pred double")
    assert df.groupBy().agg(*evaluate.metric_columns(bias=True)).first()["Bias"] == 2.5
    assert [r["error"] for r in evaluate.prediction_export(df).collect()] == [-2.0, -3.0]


def test_r2_of_constant_truth(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 1.0)], "model string, y_true double, y_pred double")
    assert {r["model"]: r["R2"] for r in evaluate.metrics(df).collect()} == {"a": 1.0, "b": 0.0}


def test_no_producing_rows_is_an_error(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0)], "model string, y_true double, y_pred double")
    with pytest.raises(ValueError):
        evaluate.metrics_producing(df, check=True)


def test_daily_error_modes(spark):
    df = spark.createDataFrame([(at("2024-01-01"), "a", 1.0, 3.0), (at("2024-01-01"), "a", 3.0, 2.0)], "timestamp timestamp_ntz, model string, y_true double, y_pred double")
    assert evaluate.daily_error(df).first()["mae_dia"] == 0.5
    assert evaluate.daily_error(df, positive_part=False).first()["mae_dia"] == 1.5


def pu(spark, n=12, plants=("a", "b")):
    rows = [(p, at("2024-01-01") + pd.Timedelta(minutes=15 * i), float(i * 30), float(i * 100), 20.0) for p in plants for i in range(n)]
    return quality.add_nominal_power(spark.createDataFrame(rows, R), {p: 10.0 for p in plants})


def test_features_drop_the_first_rows_of_every_plant_and_ignore_foreign_columns(spark):
    df = pu(spark).withColumn("only_a", F.when(F.col("id_planta") == "a", 1.0))
    out = build_features(df)
    assert {(r["id_planta"], r["n"]) for r in out.groupBy("id_planta").agg(F.count("*").alias("n")).collect()} == {("a", 8), ("b", 8)}
    names = feature_columns(out.drop("only_a"))
    assert len(names) - 2 == 10 + 1 + 2 + 4 + 5 + 6 + 2 + 2  # plus radiation and T_ambiente, minus the two plant columns
    assert "power" not in names and "power_pu" not in names
    bare = build_features(df, C.Features().without_memory(), ["a", "b"])
    assert bare.count() == 24
    warm = build_features(df, C.Features(lags={"T_ambiente": (3,)}, windows={}, groups=frozenset({"daylight"})))
    assert warm.count() == 18 and "T_ambiente_lag_3" in warm.columns and not {"plant_a", "power_pu_lag_1"} & set(warm.columns)
    with pytest.raises(ValueError):
        C.Features(groups=frozenset({"weather"}))


def test_horizon_columns_are_not_features(spark):
    out = series.add_horizons(build_features(pu(spark, 40)))
    assert "power_pu_h4" in feature_columns(out) and "power_pu_h4" not in feature_columns(out, horizons=True)


def test_lags_cross_gaps_unless_time_exact(spark):
    rows = [("p", at("2024-01-01 00:00"), 1.0), ("p", at("2024-01-01 05:00"), 2.0)]
    df = spark.createDataFrame(rows, "id_planta string, timestamp timestamp_ntz, power_pu double")
    positional = series.halo_window(df, {"x": lambda w: F.lag("power_pu", 1).over(w)}, 1).orderBy("timestamp").collect()
    exact = series.time_exact_lag(df, "power_pu", 1, "x").orderBy("timestamp").collect()
    assert [r["x"] for r in positional] == [None, 1.0]
    assert [r["x"] for r in exact] == [None, None]


def test_scenarios_are_matched_by_key_not_by_row_number(spark):
    schema = "id_planta string, timestamp timestamp_ntz, y_true double, y_pred double"
    a = spark.createDataFrame([("p", at(f"2024-01-01 0{h}:00"), float(h), float(h)) for h in (4, 5, 6)], schema)
    b = spark.createDataFrame([("p", at(f"2024-01-01 0{h}:00"), float(h), float(h) + 10) for h in (1, 4, 5, 6)], schema)
    got = evaluate.pair_scenarios(a, b).orderBy("timestamp").collect()
    assert [(r["y_pred_lag"], r["y_pred_nolag"]) for r in got] == [(4.0, 14.0), (5.0, 15.0), (6.0, 16.0)]
    assert evaluate.common_keys(a, b).count() == 3


def test_splits_are_disjoint_and_checked(spark):
    df = pu(spark, 96 * 3)
    dates = C.SplitDates("2024-01-01", "2024-01-01", "2024-01-02", "2024-01-02", "2024-01-03")
    out = splits.assign_split(df, ["a"], "b", dates)
    assert out.count() == out.select("id_planta", "timestamp").distinct().count()
    train, val, test = splits.parts(out)
    assert train.count() == 1
    with pytest.raises(ValueError, match="test"):
        splits.parts(out.filter("split <> 'test'"))
    splits.assert_no_leakage(out)
    late = C.SplitDates("2024-01-03", "2024-01-01", "2024-01-02", "2024-01-02", "2024-01-03")
    with pytest.raises(AssertionError):
        splits.assert_no_leakage(splits.assign_split(df, ["a"], "b", late).unionByName(out.filter("split = 'val'")))
    shorter = splits.assign_split(df, ["a"], "b", dates, embargo="4 hours")
    ends = {r["split"]: str(r["t"]) for r in shorter.groupBy("split").agg(F.max("timestamp").alias("t")).collect()}
    assert ends == {"val": "2024-01-01 20:00:00", "test": "2024-01-02 20:00:00"}


def test_memory_guard(spark):
    splits.assert_complete_memory(build_features(pu(spark)))
    with pytest.raises(AssertionError):
        splits.assert_complete_memory(build_features(pu(spark), C.Features(complete_rows=False)))


def test_dst_changes(spark):
    got = column(spark, [at("2023-03-26 01:59"), at("2023-03-26 02:30"), at("2023-03-26 03:00"), at("2023-10-29 01:59"), at("2023-10-29 02:30"),
                         at("2023-10-29 03:00")], "timestamp_ntz", lambda c: solar.localize(c, "Europe/Madrid").cast("timestamp_ntz"))
    assert got == [at("2023-03-26 00:59"), None, at("2023-03-26 01:00"), at("2023-10-28 23:59"), None, at("2023-10-29 02:00")]


@pytest.mark.parametrize("day,rise,fall", [("2024-01-01", "07:38", "16:59"), ("2024-06-21", "04:45", "19:48"), ("2024-03-20", "06:18", "18:27")])
def test_sun_times_of_madrid(spark, day, rise, fall):
    got = spark.createDataFrame([(at(day),)], "t timestamp_ntz").select(
        *[c.cast("timestamp_ntz") for c in solar.sun_times(F.col("t"), 40.4168, -3.7038)]).first()
    for value, want in zip(got, (rise, fall)):
        assert abs((value - at(f"{day} {want}")).total_seconds()) < 180


# ---- statistics ----------------------------------------------------------------------------

def test_normal_quantile_and_tails(spark):
    from statistics import NormalDist

    ps = [1e-6, 0.01, 0.2, 0.5, 0.9, 0.999]
    for got, p in zip(column(spark, ps, "double", special.normal_quantile), ps):
        assert got == pytest.approx(NormalDist().inv_cdf(p), rel=1e-8, abs=1e-8)
    for x in (0.5, 3.0, 20.0):
        one = column(spark, [x], "double", lambda c: special.chi2_tail(c, 1))[0]
        assert one == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-6)
        three = column(spark, [x], "double", lambda c: special.chi2_tail(c, 3))[0]
        want = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
        assert three == pytest.approx(want, rel=1e-5)
        four = column(spark, [x], "double", lambda c: special.chi2_tail(c, 4))[0]
        assert four == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-9)


def sample(spark, n=500):
    rng = np.random.default_rng(5)
    e = np.round(rng.normal(size=n) + 0.3 * rng.exponential(size=n), 2)
    g = rng.choice(["x", "y", "z"], n)
    pdf = pd.DataFrame({"id_planta": "p", "timestamp": pd.date_range("2024-01-01", periods=n, freq="15min"), "e": e, "d": np.round(e + rng.normal(size=n), 1), "g": g})
    return pdf, spark.createDataFrame(pdf).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def test_kolmogorov_smirnov_statistic(spark):
    from statistics import NormalDist

    pdf, df = sample(spark)
    z = np.sort((pdf["e"] - pdf["e"].mean()) / pdf["e"].std(ddof=0))
    cdf = np.array([NormalDist().cdf(v) for v in z])
    n = len(z)
    want = max((np.arange(1, n + 1) / n - cdf).max(), (cdf - np.arange(n) / n).max())
    got = stats.kolmogorov_smirnov(df, "e").first()
    assert got["statistic"] == pytest.approx(want, abs=1e-6)
    assert 0 <= got["p_value"] <= 1


def test_spearman_and_pearson(spark):
    pdf, df = sample(spark)
    assert stats.spearman(df, "e", "d").first()["spearman_rho"] == pytest.approx(pdf["e"].rank().corr(pdf["d"].rank()), abs=1e-9)
    p = stats.pearson(df, "e", "d").first()
    assert p["pearson_r"] == pytest.approx(pdf["e"].corr(pdf["d"]), abs=1e-9) and p["p_value"] < 1e-10


@pytest.mark.parametrize("n,noise", [(12, 2.0), (60, 6.0)])
def test_pearson_p_value_is_the_t_tail(spark, n, noise):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n)
    y = x + noise * rng.normal(size=n)
    got = stats.pearson(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "x", "y").first()
    r, v = got["pearson_r"], n - 2
    t = abs(r) * math.sqrt(v / (1 - r * r))
    grid = np.linspace(0, t, 20001)
    density = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi) * (1 + grid**2 / v) ** (-(v + 1) / 2)
    inside = float(((density[1:] + density[:-1]) / 2 * np.diff(grid)).sum())
    assert got["p_value"] == pytest.approx(1 - 2 * inside, abs=2e-3)


def test_whole_diagnostics_plan(spark):
    from heliofleet.plans.diagnostics import residual_diagnostics, residual_table

    rng = np.random.default_rng(2)
    n = 400
    y = np.abs(rng.normal(0.5, 0.2, n))
    pdf = pd.DataFrame({"id_planta": "p", "timestamp": pd.date_range("2023-11-25", periods=n, freq="15min"), "y_true": y,
                        "y_pred": y + rng.normal(0, 0.05, n), "radiation": y * 900, "T_ambiente": rng.normal(15, 4, n).round(1)})
    rows = spark.createDataFrame(pdf).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    for name, table in residual_diagnostics(residual_table(rows, 10.0)).items():
        assert table.count() > 0 or name == "kruskal_wallis", name


def test_kruskal_with_ties(spark):
    pdf, df = sample(spark)
    r = pdf["d"].rank()
    n = len(r)
    h = 12 / (n * (n + 1)) * sum(x.sum() ** 2 / len(x) for _, x in r.groupby(pdf["g"])) - 3 * (n + 1)
    t = pdf["d"].value_counts()
    h /= 1 - (t**3 - t).sum() / (n**3 - n)
    got = stats.kruskal_wallis(df, "d", "g").first()
    assert got["H"] == pytest.approx(h, rel=1e-9) and got["k"] == 3
    assert got["p_value"] == pytest.approx(math.exp(-h / 2), rel=1e-9)


def test_ljung_box_p_values(spark):
    _, df = sample(spark)
    got = stats.ljung_box(stats.autocorrelation(df, "e", 48)).collect()
    assert [r["lag"] for r in sorted(got, key=lambda r: r["lag"])] == [1, 4, 8, 16, 24, 48]
    assert all(0 <= r["p_value"] <= 1 for r in got)


def test_lowess_follows_a_line(spark):
    df = spark.range(200).select((F.col("id") * 1.0).alias("x"), (F.col("id") * 2.0 + 1).alias("y"))
    got = stats.lowess_grid(df, "x", "y", points=11).collect()
    assert len(got) == 11 and all(r["trend"] == pytest.approx(2 * r["x"] + 1, abs=1e-6) for r in got)


def test_sample_does_not_depend_on_partitioning(spark):
    _, df = sample(spark)
    a = stats.hash_sample(df, ("id_planta", "timestamp"), 50).select("timestamp").collect()
    b = stats.hash_sample(df.repartition(5), ("id_planta", "timestamp"), 50).select("timestamp").collect()
    assert sorted(a) == sorted(b) and len(set(a)) == 50


def test_constant_series_give_null_not_an_error(spark):
    flat = spark.createDataFrame([("p", at(f"2024-01-01 {h:02}:00"), 5.0, 7.0, 1.0) for h in range(12)], R).withColumn("g", F.hour("timestamp") % 2)
    assert quality.monthly_correlation(flat).first()["Correlacion"] is None
    assert stats.spearman(flat, "radiation", "power").first()["spearman_rho"] is None
    assert stats.driver_correlations(flat, "power", ("radiation",)).first()["pearson_r"] is None
    assert stats.kruskal_wallis(flat, "power", "g").first()["H"] is None
    assert stats.qq_fit(flat, "power").first()["r"] is None
    assert [r["acf"] for r in stats.autocorrelation(flat, "power", 3).collect()] == [None] * 4
    assert [r["n"] for r in stats.histogram(flat, "power").collect()] == [flat.count()]
    assert stats.kolmogorov_smirnov(flat, "power").first()["statistic"] is None
    assert {r["pdf"] for r in stats.normal_curve(flat, "power", 3).collect()} == {None}


def test_empty_input(spark):
    empty = spark.createDataFrame([], R)
    assert quality.plant_summary(empty).count() == 0
    assert series.fill_gaps(empty).count() == 0
    assert quality.clip_outliers(empty)[0].count() == 0


def test_learning_queries_use_full_presets(spark, monkeypatch):
    from heliofleet.checks import learning
    from heliofleet.plans import models

    class Stop(Exception):
        pass

    def caught(owner, name, query):
        seen = {}

        def held(*a, **k):
            seen.update(k | {"given": a})
            raise Stop
        with monkeypatch.context() as m:
            m.setattr(learning.B, "per_unit", lambda *a: None)
            for step in ("build_features", "assign_split", "feature_columns"):
                m.setattr(learning, step, lambda *a, **k: None)
            m.setattr(owner, name, held)
            with pytest.raises(Stop):
                query(None, None)
        factories = next(x for x in [*seen["given"], *seen.values()] if isinstance(x, dict) and "random_forest" in x)
        assert factories["random_forest"](None).spec.trees == 200 and factories["random_forest"](None).spec.depth is None
        assert "horizons" not in seen and "min_rows" not in seen
        return set(factories)

    full = set(models.registry())
    assert caught(models, "train_and_evaluate", learning.train_and_evaluate) == full
    assert caught(learning.experiments, "memory_comparison", learning.memory_comparison) == full
    assert caught(learning.experiments, "local_adaptation", learning.local_adaptation) == full
    assert caught(learning.experiments, "seasonal_robustness", learning.seasonal_robustness) == full
    assert caught(learning.experiments, "horizon_comparison", learning.horizon_experiment) == full
    assert caught(learning.experiments, "horizon_comparison", learning.feature_importance) == {"random_forest"}
