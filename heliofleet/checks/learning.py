"""Regressors and experiments, with the full presets of the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import contracts as C
from ..operators import evaluate as E
from ..operators.splits import assign_split
from ..plans import experiments, models
from ..plans.features import build_features, feature_columns
from . import bindings as B
from .registry import SPLITS, check
from .scalars import ADAPTED

PLANTS = sorted(B.NOMINAL_KW)
WINDOWS = {"semana_1": ("2024-01-01", "2024-01-08"), "semana_2": ("2024-01-08", "2024-01-15"),
           "semana_3": ("2024-01-15", "2024-01-22"), "semana_4": ("2024-01-22", "2024-01-30")}


@check("ridge_one_feature", """
WITH t AS (SELECT regr_sxy(power_pu, radiation) AS sxy, regr_sxx(power_pu, radiation) AS sxx, avg(power_pu) AS my, avg(radiation) AS mx FROM base WHERE split = 'train')
SELECT id_planta, "timestamp", power_pu AS y_true, my + sxy / (sxx + 1.0) * (radiation - mx) AS y_pred FROM base, t WHERE split = 'test'""", "y_true y_pred", SPLITS)
def ridge_one_feature(spark, d):
    rows = assign_split(B.per_unit(spark, d), B.TRAIN_PLANTS, B.TEST_PLANT, B.SPLIT)
    fitted = models.fit_all(rows.filter("split = 'train'"), [C.RADIATION], {"ridge": models.registry()["ridge"]})
    return models.predict_all(rows.filter("split = 'test'"), fitted, [C.PLANT, C.TS]).drop("model")


@check("train_and_evaluate_models")
def train_and_evaluate(spark, d):
    feats = build_features(B.per_unit(spark, d), plants=PLANTS)
    rows = assign_split(feats, B.TRAIN_PLANTS, B.TEST_PLANT, B.SPLIT)
    return models.train_and_evaluate(rows, feature_columns(feats), models.registry())[2]


@check("memory_comparison_experiment")
def memory_comparison(spark, d):
    return experiments.memory_comparison(B.per_unit(spark, d), PLANTS, B.TRAIN_PLANTS, B.TEST_PLANT, B.SPLIT, models.registry())["comparison"]


@check("local_adaptation_experiment")
def local_adaptation(spark, d):
    return experiments.local_adaptation(B.per_unit(spark, d), PLANTS, B.TRAIN_PLANTS, B.TEST_PLANT, factories=models.registry(), **ADAPTED)


@check("seasonal_robustness_experiment")
def seasonal_robustness(spark, d):
    return experiments.seasonal_robustness(
        B.per_unit(spark, d), PLANTS, B.TRAIN_PLANTS, B.TEST_PLANT, "2024-01-15", WINDOWS, models.registry()
    )["variability"]


@check("horizon_experiment")
def horizon_experiment(spark, d):
    return experiments.horizon_comparison(
        B.per_unit(spark, d), PLANTS, B.TRAIN_PLANTS, B.TEST_PLANT, B.SPLIT, models.registry()
    )["degradation"]


@check("feature_importance_top10")
def feature_importance(spark, d):
    out = experiments.horizon_comparison(
        B.per_unit(spark, d), PLANTS, B.TRAIN_PLANTS, B.TEST_PLANT, B.SPLIT, {"random_forest": models.registry()["random_forest"]},
        importance_of="random_forest",
    )
    return E.top_features(out["importance"])


@check("external_model_hook", """
SELECT id_planta, "timestamp", 'half' AS model, power_pu AS y_true, 0.5 * radiation / 1000 AS y_pred FROM base WHERE split = 'test'""", "y_true y_pred", SPLITS)
def external_model(spark, d):
    rows = assign_split(B.per_unit(spark, d), B.TRAIN_PLANTS, B.TEST_PLANT, B.SPLIT).filter("split = 'test'")
    return models.external_predictions(rows, lambda x: 0.5 * x[C.RADIATION] / 1000, [C.RADIATION], [C.PLANT, C.TS], "half")
