"""Operational monitor: smoothed relative error, alerts, episodes, day extracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contracts as C
from .chunks import PLANT_ORDER, Order
from .series import flag_blocks, guarded_mean


def alert_flag(smoothed: Column, threshold: float) -> Column:
    return F.coalesce(smoothed < -threshold, F.lit(False))


def monitored(residuals: DataFrame, config: C.MonitorConfig = C.MonitorConfig(), order: Order = PLANT_ORDER) -> DataFrame:
    """Producing rows with the trailing mean of ``e_rel``, the alert flag and its run number.

    Smoothing, flag, change marker and run count share one shuffle by ``(series, block)``.
    """
    smooth = {"e_rel_smooth": guarded_mean("e_rel", 1 - config.window, 0, config.min_rows)}
    flag = {"alerta": lambda w: alert_flag(F.col("e_rel_smooth"), config.threshold)}
    return flag_blocks(residuals.filter("is_daylight"), [smooth, flag], "alerta", config.window - 1, order)


def episodes(monitor: DataFrame, config: C.MonitorConfig = C.MonitorConfig(), keys: Sequence[str] = (C.PLANT,)) -> DataFrame:
    """One row per run of alerts: bounds, length, mean relative error and type."""
    hours = F.col("duracion_pasos") * config.step_hours
    return (
        monitor.filter("alerta").groupBy(*keys, "bloque")
        .agg(
            F.min(C.TS).alias("inicio"), F.max(C.TS).alias("fin"), F.count(C.TS).alias("duracion_pasos"),
            F.avg("e_rel").alias("e_rel_medio"),
        )
        .withColumns({
            "duracion_horas": hours,
            "tipo": F.when(hours >= config.min_hours, C.PERSISTENT).otherwise(C.SPORADIC),
        })
    )


def longest_persistent(eps: DataFrame, k: int = 2, keys: Sequence[str] = (C.PLANT,)) -> DataFrame:
    """The ``k`` longest persistent episodes (earliest first among equals)."""
    return eps.filter(F.col("tipo") == C.PERSISTENT).orderBy(F.desc("duracion_horas"), "inicio", *keys).limit(k)


def contrast_days(monitor: DataFrame, eps: DataFrame, keys: Sequence[str] = (C.PLANT,)) -> DataFrame:
    """Per series: the day its longest persistent episode starts, and its first day without a start."""
    keys = list(keys)
    longest = eps.filter(F.col("tipo") == C.PERSISTENT).groupBy(*keys).agg(
        F.max_by(F.to_date("inicio"), F.struct(F.col("duracion_horas"), -F.unix_micros(F.col("inicio").cast("timestamp"))))
        .alias("dia_anomalo")
    )
    days = monitor.select(*keys, F.to_date(C.TS).alias("dia")).distinct()
    starts = eps.select(*keys, F.to_date("inicio").alias("dia")).distinct()
    calm = days.join(starts, [*keys, "dia"], "left_anti").groupBy(*keys).agg(F.min("dia").alias("dia_normal"))
    first = days.groupBy(*keys).agg(F.min("dia").alias("_first"))
    return longest.join(first, keys).join(calm, keys, "left").select(
        *keys, "dia_anomalo", F.coalesce("dia_normal", "_first").alias("dia_normal")
    )


def day_extract(monitor: DataFrame, days: DataFrame, keys: Sequence[str] = (C.PLANT,)) -> DataFrame:
    """All rows of the anomalous and the normal day (one row of days per series)."""
    keys = list(keys)
    long = days.select(*keys, F.inline(F.array(
        F.struct(F.lit("anomalo").alias("clase"), F.col("dia_anomalo").alias("dia")),
        F.struct(F.lit("normal").alias("clase"), F.col("dia_normal").alias("dia")),
    )))
    return monitor.withColumn("dia", F.to_date(C.TS)).join(long, [*keys, "dia"])
