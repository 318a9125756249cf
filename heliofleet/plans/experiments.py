"""The comparison experiments: memory, local adaptation, seasons, horizons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import scalar as S
from ..operators import evaluate
from ..operators.series import add_horizons, horizon_names
from ..operators.splits import adapted_split, assign_split, season_windows
from ..session import cut_lineage
from .features import build_features, feature_columns
from .models import Factory, feature_importance, fit_all, predict_all, train_and_evaluate

KEEP = [C.PLANT, C.TS, C.RADIATION]


def _scenarios(df: DataFrame, plants: Sequence[str]) -> dict[str, tuple[DataFrame, list[str]]]:
    out = {}
    for name, config in (("with_lag", C.Features()), ("without_lag", C.Features().without_memory())):
        feats = build_features(df, config, plants)
        out[name] = (feats, feature_columns(feats))
    return out


def memory_comparison(
    df: DataFrame, plants: Sequence[str], train_plants: Sequence[str], test_plant: str, dates: C.SplitDates,
    factories: Mapping[str, Factory],
) -> dict[str, DataFrame]:
    """Models with and without memory features and the last-value baseline on common test rows.

    Rows are matched by plant and timestamp. The baseline is the last-value column of the memory features, so it is
    scored on exactly the rows of the models. The best model of either scenario, by RMSE on the common producing rows, is
    broken down by hour and irradiance over rows that produce at all.
    """
    stacks, naive = [], None
    for scenario, (feats, names) in _scenarios(df, plants).items():
        split = assign_split(feats, train_plants, test_plant, dates)
        _, stacked, _ = train_and_evaluate(split, names, factories)
        stacks.append(stacked.withColumn("scenario", F.lit(scenario)))
        if scenario == "with_lag":
            naive = split.select(*KEEP, "split", F.lit("naive").alias("model"), F.col(C.TARGET).alias("y_true"),
                                 F.col(f"{C.TARGET}_lag_1").alias("y_pred"), F.lit("baseline").alias("scenario"))
    both = stacks[0].unionByName(stacks[1])
    common = evaluate.common_keys(*[s.filter(F.col("split") == "test") for s in stacks])
    test = both.unionByName(naive).filter(F.col("split") == "test").join(common, [C.PLANT, C.TS], "left_semi")
    best = evaluate.best_model(evaluate.metrics_producing(both.filter(F.col("split") == "test").join(common, [C.PLANT, C.TS], "left_semi"),
                                                          ("scenario", "model")), ("scenario",))
    chosen = test.join(best.select("scenario", F.col("best_model").alias("model")), ["scenario", "model"], "left_semi")
    errors = chosen.filter(evaluate.producing(0.0)).withColumn("error", F.col("y_true") - F.col("y_pred"))
    named = {"scenario": F.col("scenario"), "model": F.col("model")}
    compared = evaluate.merge_scopes(test.withColumnRenamed("scenario", "type"))
    return {
        "scopes": evaluate.scope_frame(both),
        "comparison": evaluate.improvement_over(compared, "naive"),
        "predictions": evaluate.prediction_export(both),
        "best": best,
        "by_hour": evaluate.segment(errors, {**named, "hour": F.hour(C.TS)}, error="error"),
        "by_irradiance": evaluate.segment(errors, {**named, "rad_bin": S.irradiance_band(F.col(C.RADIATION))}, error="error"),
    }


def local_adaptation(
    df: DataFrame, plants: Sequence[str], base_plants: Sequence[str], target: str, base_end: str,
    local: tuple[str, str], val: tuple[str, str], test: tuple[str, str], factories: Mapping[str, Factory],
) -> DataFrame:
    """RMSE on the target plant with and without some of its own history in the training rows."""
    feats = build_features(df, plants=plants)
    names = feature_columns(feats)
    split = cut_lineage(adapted_split(feats, base_plants, target, base_end, local, val, test))
    tables = []
    for rows in (split, split.filter((F.col("split") != "train") | (F.col(C.PLANT) != target))):
        _, stacked, _ = train_and_evaluate(rows, names, factories)
        tables.append(evaluate.metrics_producing(stacked.filter(F.col("split") == "test")))
    return evaluate.relative_improvement(*tables)


def seasonal_robustness(
    df: DataFrame, plants: Sequence[str], train_plants: Sequence[str], test_plant: str, train_end: str,
    windows: Mapping[str, tuple[str, str]], factories: Mapping[str, Factory], min_rows: int = 20,
) -> dict[str, DataFrame]:
    """One fit per model and feature set, evaluated inside several named windows."""
    stacks = None
    labels = {"with_lag": "Con lags", "without_lag": "Sin lags"}
    for scenario, (feats, names) in _scenarios(df, plants).items():
        feats = cut_lineage(feats)
        train = feats.filter(F.col(C.PLANT).isin(*train_plants) & (F.col(C.TS) <= F.lit(train_end).cast("timestamp_ntz")))
        models = fit_all(train, names, factories)
        rows = season_windows(feats, windows, test_plant)
        part = cut_lineage(predict_all(rows, models, [*KEEP, "estacion"])).withColumn("tipo", F.lit(labels[scenario]))
        stacks = part if stacks is None else stacks.unionByName(part)
    table = evaluate.seasonal_metrics(stacks, min_rows=min_rows)
    return {"metrics": table, "variability": evaluate.variability(table),
            "daily": evaluate.daily_error(stacks, by=("tipo", "estacion", "model"))}


def horizon_comparison(
    df: DataFrame, plants: Sequence[str], train_plants: Sequence[str], test_plant: str, dates: C.SplitDates,
    factories: Mapping[str, Factory], horizons: Sequence[int] = (1, 4, 16), importance_of: str | None = None,
    embargo: bool = False,
) -> dict[str, DataFrame]:
    """Refit per horizon on the shifted target; errors, degradation, robustness, importances.

    The split cuts on the time of the inputs. With ``embargo`` rows whose target would lie past a
    cut are left out.
    """
    feats = cut_lineage(add_horizons(build_features(df, plants=plants), horizons).dropna(subset=horizon_names(horizons)))
    names = feature_columns(feats, horizons=True)
    stacks, fitted = None, {}
    for h in horizons:
        reach = f"{h * C.STEP_SECONDS} SECOND" if embargo else None
        shifted = assign_split(feats.withColumn(C.TARGET, F.col(f"{C.TARGET}_h{h}")), train_plants, test_plant, dates, reach)
        models, stacked, _ = train_and_evaluate(shifted, names, factories)
        if importance_of:
            fitted[h] = models[importance_of]
        part = stacked.filter(F.col("split") == "test").withColumn("horizon_steps", F.lit(h))
        stacks = part if stacks is None else stacks.unionByName(part)
    table = stacks.groupBy("model", "horizon_steps").agg(
        *evaluate.metric_columns(None, "_global"), *evaluate.metric_columns(evaluate.producing(), "_luz")
    )
    degraded = evaluate.degradation(table)
    out = {"metrics": table, "degradation": degraded, "robustness": evaluate.robustness(degraded),
           "delta": evaluate.horizon_steps_delta(table)}
    if importance_of:
        out["importance"] = feature_importance(df.sparkSession, fitted, names)
        out["tracked"] = evaluate.tracked_features(out["importance"])
    return out
