"""Composed plans: every table of the diagnostics, of the memory experiment and of the unified readings."""

import pytest
from pyspark.sql import functions as F

from heliofleet import contracts as C
from heliofleet.checks import bindings as B
from heliofleet.operators import evaluate
from heliofleet.plans import cleaning, experiments, models
from heliofleet.plans.features import build_features

SF = "/root/testdata/sf0.001"


def test_unified_readings_with_reports(spark, tmp_path):
    rows = B.readings(spark, SF)
    plants = [rows.filter(F.col(C.PLANT) == p) for p in B.NOMINAL_KW]
    out = cleaning.unify_with_reports(plants, str(tmp_path / "unified"))
    assert set(out) == {"unified", "summary", "consistency", "gaps", "hour_profile", "sentinel_days", "nulls_and_negatives", "description", "seasonal_mean"}
    kept, want = out["unified"].count(), cleaning.unify(plants).count()
    dropped = out["sentinel_days"].agg(F.sum("n")).first()[0] or 0
    assert kept == want and out["summary"].agg(F.sum("n_rows")).first()[0] == kept + dropped
    assert sorted(r["column"] for r in out["description"].collect()) == sorted([C.RADIATION, C.POWER, C.TEMPERATURE])
    assert spark.read.parquet(str(tmp_path / "unified")).select(rows.columns).exceptAll(cleaning.unify(plants).select(rows.columns)).isEmpty()
    with pytest.raises(ValueError):
        cleaning.unify_with_reports([])


def test_memory_experiment_breaks_errors_down(spark):
    some = {"ridge": models.registry()["ridge"], "boosted_depth6": models.registry(rounds=3)["boosted_depth6"]}
    out = experiments.memory_comparison(B.per_unit(spark, SF), sorted(B.NOMINAL_KW), B.TRAIN_PLANTS, B.TEST_PLANT, B.SPLIT, some)
    best = {r["scenario"]: r["best_model"] for r in out["best"].collect()}
    assert set(best) == {"with_lag", "without_lag"}
    hours = out["by_hour"].collect()
    assert {(r["scenario"], r["model"]) for r in hours} == set(best.items())
    counts = {s: sum(r["n"] for r in hours if r["scenario"] == s) for s in best}
    assert counts["with_lag"] == counts["without_lag"] > 0  # both on the common rows
    rows = out["predictions"].filter("split = 'test' AND y_true > 0").toPandas()
    common = set(map(tuple, rows[rows.scenario == "with_lag"][["id_planta", "timestamp"]].values)) & set(
        map(tuple, rows[rows.scenario == "without_lag"][["id_planta", "timestamp"]].values))
    assert counts["with_lag"] == len(common)
    mine = rows[(rows.scenario == "with_lag") & (rows.model == best["with_lag"])]
    mine = mine[[k in common for k in map(tuple, mine[["id_planta", "timestamp"]].values)]]
    plain = (mine.y_true - mine.y_pred).abs().groupby(mine.timestamp.dt.hour).mean()
    assert {r["hour"]: r["MAE"] for r in hours if r["scenario"] == "with_lag"} == pytest.approx(plain.to_dict())
    assert out["by_irradiance"].count() > 0


def test_tracked_features(spark):
    shares = spark.createDataFrame([(1, "radiation", 0.5), (4, "radiation", 0.3), (1, "other", 0.5)], "horizon_steps int, feature string, importance double")
    got = {(r["feature"], r["horizon_steps"]): r["change"] for r in evaluate.tracked_features(shares).collect()}
    assert got == {("radiation", 1): 0.0, ("radiation", 4): pytest.approx(-0.2)}
    assert set(C.TRACKED_FEATURES) <= set(build_features(B.per_unit(spark, SF), plants=sorted(B.NOMINAL_KW)).columns)
