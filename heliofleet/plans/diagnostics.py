"""Residual table, its diagnostics, the operational monitor and per-model error tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import scalar as S
from ..operators import episodes, evaluate, stats
from ..operators.chunks import PLANT_ORDER, Order
from ..operators.quality import describe
from ..operators.splits import first_days
from ..session import cut_lineage


def residual_table(predictions: DataFrame, nominal_kw: Column | float) -> DataFrame:
    """Predictions with residual columns, hour, month and season."""
    ts = F.col(C.TS)
    return predictions.withColumns(
        S.residuals(F.col("y_true"), F.col("y_pred"), nominal_kw)
        | {"hour": F.hour(ts).cast("int"), "month": F.month(ts).cast("int"), "season": S.season(ts)}
    )


def residual_diagnostics(residuals: DataFrame, drivers: Sequence[str] = (C.RADIATION, C.TEMPERATURE, "y_true"),
                         order: Order = PLANT_ORDER) -> dict[str, DataFrame]:
    """Every diagnostic of the residual in kW on producing rows.

    Relative errors are clipped to three times the production before their Q-Q line. Hexagons and trends are one table a driver.

    The residual table is read several times: write it (or ``cut_lineage``) before calling this
    on anything expensive.
    """
    producing = residuals.filter("is_daylight")
    by = list(order.keys)
    relative = producing.withColumn("e_rel", S.clip(F.col("e_rel"), -3.0, 3.0))
    acf = stats.autocorrelation(producing, "e_kw", order=order)
    return {
        "histogram": stats.histogram(producing, "e_kw", 80, by),
        "normal_curve": stats.normal_curve(producing, "e_kw", 200, by),
        "moments": stats.moments(producing, "e_kw", by),
        "dagostino": stats.dagostino(producing, "e_kw", by),
        "kolmogorov_smirnov": stats.kolmogorov_smirnov(producing, "e_kw", by),
        "qq_fit": stats.qq_fit(producing, "e_kw", by),
        "percentiles": stats.percentiles(producing, "e_kw", (0.01, 0.99), by),
        "acf": acf,
        "ljung_box": stats.ljung_box(acf, keys=by),
        "by_hour": evaluate.segment(producing, {"hour": F.hour(C.TS)}),
        "by_irradiance": evaluate.segment(producing, {"rad_bin": S.irradiance_band(F.col(C.RADIATION))}),
        "by_season": evaluate.season_residuals(residuals),
        "kruskal_wallis": stats.kruskal_wallis(producing, "e_kw", "season", by),
        "drivers": stats.driver_correlations(producing, "e_kw", drivers, by),
        "exceedance": evaluate.exceedance(residuals, by),
        "significant_lags": stats.significant_lags(acf, by),
        "qq_fit_relative": stats.qq_fit(relative, "e_rel", by),
        "daily_digest": evaluate.daily_digest(evaluate.daily_residual(residuals, by), by),
        "box_by_season": evaluate.box_statistics(producing, "e_kw", [*by, "season"]),
        "box_by_hour": evaluate.box_statistics(producing, "e_kw", [*by, "hour"]),
        **{f"hexagons_{x}": stats.hexagon_counts(producing, x, "e_kw", by=by) for x in drivers},
        **{f"lowess_{x}": stats.lowess_grid(producing, x, "e_kw", by=by, passes=3) for x in drivers},
    }


def monitor(residuals: DataFrame, config: C.MonitorConfig = C.MonitorConfig(), order: Order = PLANT_ORDER,
            k: int = 2) -> dict[str, DataFrame]:
    """Monitored rows, episodes, the longest ones, and the anomalous/normal day extract.

    The monitored rows feed all four results and are written once to the checkpoint folder.
    """
    keys = list(order.keys)
    rows = cut_lineage(episodes.monitored(residuals, config, order))
    found = episodes.episodes(rows, config, keys)
    days = episodes.contrast_days(rows, found, keys)
    return {
        "rows": rows,
        "episodes": found,
        "longest": episodes.longest_persistent(found, k, keys),
        "days": days,
        "day_rows": episodes.day_extract(rows, days, keys),
    }


def error_tables(predictions: DataFrame, nominal_kw: Column | float) -> dict[str, DataFrame]:
    """Per model: error description in kW, monthly errors of producing rows, first week of rows."""
    res = residual_table(predictions, nominal_kw)
    producing = res.filter(evaluate.producing())
    return {
        "describe": describe(res, "e_kw", ("model",), population=True),
        "monthly": evaluate.segment(producing, {"model": F.col("model"), "Mes": S.month_key(F.col(C.TS))}),
        "first_week": first_days(res),
    }
