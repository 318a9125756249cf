"""Raw exports, plant tables, payloads, sinks and models on disk."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import StandardScalerModel
from pyspark.sql import functions as F

from heliofleet import contracts as C
from heliofleet.plans import models
from heliofleet.plans.cleaning import unify
from heliofleet.sources import files, sinks


@pytest.fixture
def exports(tmp_path):
    def write(name, text):
        path = tmp_path / "2023" / "01" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode("iso-8859-1"))

    write("d1.csv", "FECHA/HORA,RADIACION SOLAR,SITE 1,Otra ñ\n2023-01-01 00:00:00,\\N,5,x\n2023-01-01 00:15:00,10.5,-3,x\n")
    write("d2.csv", "Otra,SITE1,FECHA/HORA,RADIACION SOLAR\nx,7,2023-01-02 00:00:00,abc\nx,8,2023-01-02 00:00:00,4\n")
    write("d3.csv", "FECHA/HORA,RADIACION SOLAR\n2023-01-03 00:00:00,1\n")
    write("d4.csv", "FECHA/HORA,RADIACION SOLAR,SITE1\nnot a time,1,1\n2023-01-04 00:00:00,1,1\n")
    return str(tmp_path)


def test_exports_with_varying_headers(spark, exports):
    good, bad = files.scan_exports(spark, exports, ("SITE 1", "SITE1"))
    rows = {(str(r["timestamp"]), r["radiation"], r["power"]) for r in good.collect()}
    assert rows == {("2023-01-01 00:00:00", None, 5.0), ("2023-01-01 00:15:00", 10.5, -3.0),
                    ("2023-01-02 00:00:00", None, 7.0), ("2023-01-02 00:00:00", 4.0, 8.0)}
    assert {(r["file_path"].rsplit("/", 1)[1], r["reason"]) for r in bad.collect()} == {("d3.csv", "header"), ("d4.csv", "timestamp")}
    out = files.consolidate_exports(good, "p", check=True).orderBy("timestamp").collect()
    assert [(r["radiation"], r["power"]) for r in out] == [(0.0, 5.0), (10.5, 0.0), (0.0, 7.0)]
    assert out[0]["weekday"] == 6 and out[0]["sin_hour"] == 0.0


def test_no_valid_export(spark, exports):
    good, _ = files.scan_exports(spark, exports, ("OTHER",))
    with pytest.raises(RuntimeError):
        files.consolidate_exports(good, "p", check=True)


def test_plant_csv(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("timestamp,radiation,power,T_ambiente,Mes\n2024-01-01 00:00:00,1,2,3,a\n2024-01-01 00:00:00,inf,5,6,b\nbad,1,1,1,c\n2024-01-01 00:15:00,1,x,NaN,d\n")
    rows = files.load_plant(spark, str(path), "p").orderBy("timestamp").collect()
    assert rows[0].asDict() == {"id_planta": "p", "timestamp": pd.Timestamp("2024-01-01").to_pydatetime(), "radiation": None, "power": 5.0, "T_ambiente": 6.0, "Mes": "b"}
    assert (rows[1]["power"], rows[1]["T_ambiente"]) == (None, None) and len(rows) == 2
    assert files.load_plant(spark, str(path), "p", drop_duplicates=False).count() == 3
    both = files.load_plants(spark, {"a": str(path), "b": str(path)})
    assert both.count() == 4 and both.columns[:2] == ["id_planta", "timestamp"]
    with pytest.raises(ValueError):
        files.load_plants(spark, {})
    with pytest.raises(ValueError):
        unify([])
    (tmp_path / "q.csv").write_text("timestamp,power\n2024-01-01,1\n")
    with pytest.raises(ValueError, match="T_ambiente, radiation"):
        files.load_plant(spark, str(tmp_path / "q.csv"), "q")


def test_station_days_on_disk(spark, tmp_path):
    for station, day in (("S1", "2024-01-01"), ("S2", "2024-01-01"), ("S2", "2024-01-02")):
        folder = tmp_path / f"station={station}" / f"day={day}"
        folder.mkdir(parents=True)
        (folder / "f.csv").write_text("Time,Temperature\n1:05 PM,71.2 °F\n")
    from heliofleet.operators.asof import best_station_per_day, missing_days

    rows = files.scan_station_days(spark, str(tmp_path))
    best = best_station_per_day(rows, ["S1", "S2"]).select("Date", "station").orderBy("Date").collect()
    assert [tuple(r) for r in best] == [("2024-01-01", "S1"), ("2024-01-02", "S2")]
    assert [str(r["day"]) for r in missing_days(rows, "2024-01-01", "2024-01-03").collect()] == ["2024-01-03"]


def test_hourly_payload(spark, tmp_path):
    payload = {"hourly": {"time": [f"2024-01-01T{h:02}:00" for h in range(24) if h != 5], "temperature_2m": [float(h) for h in range(23)]}}
    (tmp_path / "w.json").write_text(json.dumps(payload, indent=1))
    hours = files.flatten_hourly(files.read_payloads(spark, str(tmp_path)))
    assert hours.count() == 23 and str(hours.orderBy(C.TS).first()[C.TS]) == "2024-01-01 00:00:00"
    assert files.hourly_completeness(hours, "2024-01-01", "2024-01-01").first().asDict() == {"expected": 24, "found": 23, "missing": 1}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.2345), ("b", 2.0)], "id_planta string, v double")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert {r["v"] for r in spark.read.option("header", "true").csv(str(tmp_path / "csv")).collect()} == {"1.23", "2.0"}
    sinks.write_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    first = sinks.materialise(df, str(tmp_path / "m")).count()
    assert sinks.materialise(df.limit(0), str(tmp_path / "m")).count() == first == 2
    sinks.write_feature_list(spark, ["x", "y"], str(tmp_path / "f"), best_with_lag="ridge")
    assert sinks.read_feature_list(spark, str(tmp_path / "f")) == ["x", "y"]
    ranking = spark.createDataFrame([("a", 1, "S")], "id_planta string, rank int, station string")
    assert sinks.cache_ranking(ranking, str(tmp_path / "r")).count() == 1
    sinks.write_predictions(df.withColumn("scenario", F.lit("with_lag")), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("scenario = 'with_lag'").count() == 2


def ridge_xy():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 3)) * [1.0, 5.0, 0.2] + [0, 3, -1]
    return x, x @ [1.5, -0.3, 2.0] + 0.7 + rng.normal(size=500) * 0.1


def ridge_frame(spark):
    x, y = ridge_xy()
    return spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=["a", "b", "c", C.TARGET]))


def test_ridge_matches_closed_form(spark):
    x, y = ridge_xy()
    xc = x - x.mean(axis=0)
    w = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ (y - y.mean()))
    fitted = models.fit_all(ridge_frame(spark), ["a", "b", "c"], {"ridge": models.registry()["ridge"]})["ridge"].stages[-1]
    assert np.allclose(fitted.coefficients.toArray(), w, atol=1e-8)
    assert fitted.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ w, abs=1e-8)


def test_registry_and_scaled_fit(spark):
    assert list(models.registry()) == ["ridge", "random_forest", "extra_trees", "boosted_depth6", "boosted_31_leaves", "boosted_symmetric"]
    specs = {name: make(None).spec for name, make in models.registry().items() if name != "ridge"}
    assert {n: (s.trees, s.depth, s.leaves, s.rate, s.row_share, s.column_share) for n, s in specs.items()} == {
        "random_forest": (200, None, None, 1.0, 1.0, 1.0), "extra_trees": (200, None, None, 1.0, 1.0, 1.0),
        "boosted_depth6": (300, 6, None, 0.05, 0.8, 0.8), "boosted_31_leaves": (300, None, 31, 0.05, 0.8, 0.8),
        "boosted_symmetric": (300, 6, None, 0.05, 0.8, 1.0)}
    assert specs["random_forest"].bootstrap and specs["extra_trees"].random_cuts
    df = ridge_frame(spark)
    fitted = models.fit_all(df, ["a", "b", "c"], {"ridge": models.registry()["ridge"]}, scale=True)["ridge"]
    assert any(isinstance(s, StandardScalerModel) for s in fitted.stages)
    assert fitted.stages[1].mean.toArray() == pytest.approx(ridge_xy()[0].mean(axis=0))


def test_models_on_disk_with_fallback(spark, tmp_path):
    df = ridge_frame(spark)
    fitted = models.fit_all(df, ["a"], {"ridge": models.registry()["ridge"]})
    sinks.save_models(spark, fitted, str(tmp_path / "models"))
    name, model = sinks.load_model(spark, str(tmp_path / "models"), "absent")
    assert name == "ridge" and model.transform(df).count() == 500


def test_missing_days_of_each_station(spark):
    from heliofleet.operators.asof import missing_days

    rows = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-03"), ("b", "2024-01-02")], "station string, Date string")
    got = {(r["station"], str(r["day"])) for r in missing_days(rows, "2024-01-01", "2024-01-03", ["station"]).collect()}
    assert got == {("a", "2024-01-02"), ("b", "2024-01-01"), ("b", "2024-01-03")}


def test_queries_over_all_stations_and_hours(spark):
    from heliofleet.checks import load_all

    queries, d = load_all()[0], "/root/testdata/sf0.001"
    assert {r["station"] for r in queries["missing_station_days"](spark, d).collect()} == {f"ST{i}" for i in range(6)}
    both = queries["hour_series_side_by_side"](spark, d)
    assert both.filter("hour >= 16 AND with_lag IS NOT NULL").count() and both.filter("hour <= 8 AND without_lag IS NOT NULL").count()
