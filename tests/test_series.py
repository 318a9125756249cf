"""Filling, grids and as-of joins against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heliofleet import contracts as C
from heliofleet.operators import asof, episodes, series
from heliofleet.operators.chunks import POS

T0 = pd.Timestamp("2024-01-01")
SCHEMA = "id_planta string, timestamp timestamp_ntz, v double"


def gap_series():
    """NULL at both ends, gaps of 2, 5, 8, 9, 30 and 150 slots."""
    rng = np.random.default_rng(0)
    out = [None, None, None]
    for gap in (2, 5, 8, 9, 30, 150):
        out += [round(float(x), 3) for x in rng.normal(size=7)] + [None] * gap
    return out + [1.25, 2.5] + [None] * 12


def grid(spark, values, plant="p"):
    rows = [(plant, (T0 + pd.Timedelta(minutes=15 * i)).to_pydatetime(), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def values(df):
    return [r["v"] for r in df.orderBy(C.TS).collect()]


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert (a is None and (b is None or b != b)) or a == pytest.approx(b, abs=1e-9)


@pytest.mark.parametrize("limit,both", [(8, False), (None, False), (3, True), (1, True)])
def test_interpolation_matches_pandas(spark, limit, both):
    data = gap_series()
    index = pd.date_range(T0, periods=len(data), freq="15min")
    want = pd.Series(data, index=index, dtype="float64").interpolate(
        method="time", limit=limit, limit_direction="both" if both else "forward"
    )
    numbered = series.reindex(grid(spark, data), keep_position=True)
    close(values(series.interpolate(numbered, ["v"], limit, both)), list(want))


def test_filling_never_changes_present_values(spark):
    data = gap_series()
    got = values(series.fill_gaps(grid(spark, data), ["v"]))
    assert all(g == d for g, d in zip(got, data) if d is not None)


def test_previous_day_is_three_passes(spark):
    data = gap_series() + [None] * 300
    s = pd.Series(data, dtype="float64")
    for _ in range(3):
        s = s.fillna(s.shift(96))
    close(values(series.previous_day(series.reindex(grid(spark, data), keep_position=True), ["v"])), list(s))


def test_gap_is_filled_only_in_its_first_eight_slots(spark):
    got = values(series.interpolate(series.reindex(grid(spark, [0.0] + [None] * 19 + [20.0]), keep_position=True), ["v"], 8))
    assert [i for i, v in enumerate(got) if v is None] == list(range(9, 20))


def test_limit_needs_grid_positions(spark):
    with pytest.raises(ValueError):
        series.interpolate(grid(spark, [1.0]), ["v"], 8)


def test_reindex_drops_off_grid_rows_and_long_series_unfold(spark):
    rows = [("p", T0.to_pydatetime(), 1.0), ("p", (T0 + pd.Timedelta(minutes=7)).to_pydatetime(), 9.0),
            ("p", (T0 + pd.Timedelta(days=3)).to_pydatetime(), 2.0)]
    got = series.reindex(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == 3 * 96 + 1
    assert got.filter("v = 9.0").count() == 0


def test_dedupe_first_and_last(spark):
    rows = [("p", T0.to_pydatetime(), 1.0, 3), ("p", T0.to_pydatetime(), 2.0, 1), ("p", T0.to_pydatetime(), None, 7)]
    df = spark.createDataFrame(rows, SCHEMA + ", seq int")
    assert series.dedupe(df, [F.col("seq")], "first").first()["v"] == 2.0
    assert series.dedupe(df, [F.col("seq")], "last").first()["v"] is None


def station_rows(spark, minutes, values_, station="s"):
    rows = [(station, (T0 + pd.Timedelta(minutes=m)).to_pydatetime(), float(v)) for m, v in zip(minutes, values_)]
    return spark.createDataFrame(rows, "station string, timestamp timestamp_ntz, station_radiation double")


def left_rows(spark, minutes, station="s"):
    rows = [(station, (T0 + pd.Timedelta(minutes=m)).to_pydatetime(), i) for i, m in enumerate(minutes)]
    return spark.createDataFrame(rows, "station string, timestamp timestamp_ntz, i int")


def test_asof_ties_go_backward_and_bound_is_inclusive(spark):
    got = asof.asof_nearest(left_rows(spark, [10, 30, 60]), station_rows(spark, [5, 15, 45], [1, 2, 3]), ["station_radiation"], ("station",))
    assert [r["station_radiation"] for r in got.orderBy("i").collect()] == [1.0, 2.0, 3.0]


@pytest.mark.parametrize("chunk", [60, 900, 7200])
def test_asof_matches_pandas(spark, chunk):
    rng = np.random.default_rng(7)
    lm, rm = np.sort(rng.choice(6000, 300, replace=False)), np.sort(rng.choice(6000, 200, replace=False))
    left, right = left_rows(spark, lm), station_rows(spark, rm, range(200))
    a = pd.DataFrame({"t": T0 + pd.to_timedelta(lm, unit="m")})
    b = pd.DataFrame({"t": T0 + pd.to_timedelta(rm, unit="m"), "x": np.arange(200.0)})
    want = pd.merge_asof(a, b, on="t", direction="nearest", tolerance=pd.Timedelta("15min"))["x"]
    got = asof.asof_nearest(left, right, ["station_radiation"], ("station",), chunk_seconds=chunk).orderBy("i").collect()
    close([r["station_radiation"] for r in got], list(want))


def test_asof_with_one_hot_quarter_hour(spark):
    """Many rows on both sides in one bucket: every left row still gets exactly one answer."""
    left = spark.range(4000).select(F.lit("s").alias("station"), F.timestamp_micros(F.col("id") * 1000 + F.lit(1704067200000000)).cast("timestamp_ntz").alias("timestamp"), F.col("id").alias("i"))
    right = spark.range(5000).select(F.lit("s").alias("station"), F.timestamp_micros(F.col("id") * 700 + F.lit(1704067200000100)).cast("timestamp_ntz").alias("timestamp"), F.col("id").cast("double").alias("station_radiation"))
    got = asof.asof_nearest(left, right, ["station_radiation"], ("station",)).toPandas().sort_values("i")
    r = np.arange(5000) * 700 + 100
    t = np.arange(4000) * 1000
    at = np.searchsorted(r, t, side="right")
    back, ahead = np.clip(at - 1, 0, None), np.clip(at, None, 4999)
    pick = np.where((at > 0) & (t - r[back] <= np.abs(r[ahead] - t)), back, ahead)
    assert (got["station_radiation"].to_numpy() == pick).all()


def test_station_fill_rules(spark):
    ts = [T0 + pd.Timedelta(hours=h) for h in (0, 1, 12, 13, 14, 15)]
    readings = spark.createDataFrame(
        [("p", t.to_pydatetime(), r) for t, r in zip(ts, (None, 0.0, 0.0, None, 7.0, 0.0))], "id_planta string, timestamp timestamp_ntz, radiation double")
    hours = {"A": {0: 0.0, 1: 4.0, 12: 0.0, 13: 0.0}, "B": {0: 3.0, 12: 5.0, 13: 0.0, 14: 9.0}}
    rows = [(s, (T0 + pd.Timedelta(hours=h)).to_pydatetime(), v) for s, x in hours.items() for h, v in x.items()]
    stations = spark.createDataFrame(rows, "station string, timestamp timestamp_ntz, station_radiation double")
    lit = F.hour("timestamp").between(8, 18)
    got = asof.fill_from_stations(readings, stations, ["A", "B"], lit).orderBy("timestamp").collect()
    assert [(r["radiation"], r["filled_from"]) for r in got] == [
        (0.0, "A"), (0.0, None), (5.0, "B"), (0.0, "A"), (7.0, None), (0.0, None)]


def test_alert_episodes_small(spark):
    e = [0.0] * 4 + [-1.0] * 12 + [0.5] * 6 + [-1.0] * 3
    rows = [("p", (T0 + pd.Timedelta(minutes=15 * i)).to_pydatetime(), v, True) for i, v in enumerate(e)]
    df = spark.createDataFrame(rows, "id_planta string, timestamp timestamp_ntz, e_rel double, is_daylight boolean")
    config = C.MonitorConfig(window=2, min_rows=1, threshold=0.6)
    mon = episodes.monitored(df, config)
    smooth = pd.Series(e).rolling(2, min_periods=1).mean()
    flag = smooth < -0.6
    block = (flag.astype(int).diff() != 0).cumsum()
    got = mon.orderBy("timestamp").collect()
    assert [r["bloque"] for r in got] == list(block)
    eps = episodes.episodes(mon, config).orderBy("inicio").collect()
    assert [(r["duracion_pasos"], r["tipo"]) for r in eps] == [(11, C.PERSISTENT), (2, C.SPORADIC)]
    assert POS not in mon.columns


def test_asof_many_rows_at_one_instant_share_one_lookup(spark):
    from pyspark.sql import functions as F

    left = spark.range(20_000).select(F.lit("a").alias("station"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("timestamp"), F.col("id").alias("i"))
    left = left.unionByName(spark.sql("select cast(null as string) station, timestamp_seconds(1700000000) timestamp, -1L i"))
    right = spark.sql("select 'a' station, timestamp_seconds(1700000300) timestamp, 5.0D station_radiation")
    got = asof.asof_nearest(left, right, ["station_radiation"], ("station",))
    assert got.columns == ["station", "timestamp", "i", "station_radiation"]
    assert got.filter("i >= 0").agg(F.count("*"), F.countDistinct("i"), F.sum("station_radiation")).first()[:] == (20_000, 20_000, 100_000.0)
    assert got.filter("i < 0").first()["station_radiation"] is None
