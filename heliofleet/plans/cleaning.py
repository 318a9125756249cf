"""Composed cleaning, filling, temperature and unification plans."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import scalar as S
from ..functions.solar import sunlit
from ..operators import asof, quality, series
from ..operators.chunks import POS, Order
from ..session import cut_lineage
from ..sources import sinks


def clean_readings(df: DataFrame, iqr_multiplier: float = 3.0, fill: bool = True) -> dict[str, DataFrame]:
    """Nulls and negatives, empty days, night radiation, dark power, gaps, outliers - in that order.

    Returns the clean table with the reports taken on the way. The filled table is written to the
    checkpoint folder: the outlier fences read it several times.
    """
    zeroed = quality.zero_nulls_and_negatives(df)
    kept = quality.drop_empty_days(zeroed)
    night = quality.zero_night_radiation(kept)
    dark = quality.zero_power_without_radiation(night)
    filled = cut_lineage(series.fill_gaps(dark, fill=fill))
    clipped, outliers = quality.clip_outliers(filled, k=iqr_multiplier)
    return {
        "clean": clipped,
        "outliers": outliers,
        "stuck_days": quality.stuck_days(night),
        "dark_power": quality.power_without_radiation_report(night),
        "missing_slots": series.missing_slots(dark),
        "monthly_correlation": quality.monthly_correlation(clipped),
    }


def fill_radiation(
    df: DataFrame, stations: DataFrame, pool: Sequence[str], sample_year: int, min_overlap: int,
    latitude: float, longitude: float, zone: str, tolerance_seconds: int = asof.TOLERANCE,
) -> dict[str, DataFrame]:
    """Reset stuck days, rank the stations for each plant, fill its missing radiation in that order.

    Readings, station rows and the ranking are each read by several joins and are written once.
    """
    reset = cut_lineage(quality.reset_stuck_days(df))
    stations = cut_lineage(stations.select("station", C.TS, "station_radiation"))
    lit = sunlit(F.col(C.TS), latitude, longitude, zone)
    ranking = cut_lineage(asof.rank_stations(reset, stations, sample_year, pool, min_overlap, tolerance_seconds))
    order = asof.ranking_or_pool(ranking, reset, pool)
    filled = asof.fill_from_stations(reset, stations, order, lit, tolerance_seconds)
    remaining, sample = asof.remaining_gaps(filled)
    return {"filled": filled, "ranking": ranking, "remaining": remaining, "remaining_sample": sample}


def unify(plants: Sequence[DataFrame]) -> DataFrame:
    """Union by name of the plants' readings; rows without power go, negatives are clipped."""
    return quality.drop_sentinel(_together(plants))


def _together(plants: Sequence[DataFrame]) -> DataFrame:
    if not plants:
        raise ValueError("no plants to unify")
    return quality.drop_null_power_and_clip(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), plants))


def unify_with_reports(plants: Sequence[DataFrame], path: str | None = None) -> dict[str, DataFrame]:
    """The unified readings with the reports taken on the way; stored at ``path``, partitioned by plant, if one is given.

    ``summary``, ``consistency``, ``gaps`` and ``hour_profile`` are of the readings before sentinel rows go, ``sentinel_days``
    counts those rows by day of the year, the others are of the result. The cleaned union is written once for all of them.
    """
    before = cut_lineage(_together(plants))
    clean = quality.drop_sentinel(before)
    if path is not None:
        sinks.write_table(clean, path)
        clean = before.sparkSession.read.schema(before.schema).parquet(path)
    measures = [C.RADIATION, C.POWER, C.TEMPERATURE]
    described = [quality.describe(clean, c).select(F.lit(c).alias("column"), "*") for c in measures]
    return {
        "unified": clean,
        "summary": quality.plant_summary(before),
        "consistency": series.time_consistency(before),
        "gaps": series.time_gaps(before),
        "hour_profile": before.groupBy(C.PLANT, F.hour(C.TS).alias("hour")).agg(F.avg(C.POWER).alias("mean_power")),
        "sentinel_days": before.filter(F.col(C.RADIATION) == C.SENTINEL).groupBy(F.dayofyear(C.TS).alias("day_of_year")).agg(F.count("*").alias("n")),
        "nulls_and_negatives": quality.null_negative_counts(clean),
        "description": reduce(DataFrame.unionByName, described),
        "seasonal_mean": quality.seasonal_mean(clean),
    }


# ---- temperature ---------------------------------------------------------------------------

SITE = Order(keys=("site",))


def hourly_temperature(weather: DataFrame) -> DataFrame:
    """Hourly ``site, timestamp, T_ambiente`` on the 15-minute grid."""
    return series.resample_up(weather, [C.TEMPERATURE], order=SITE)


def attach_temperature(
    df: DataFrame, weather: DataFrame, interpolate: Sequence[str] = (C.TEMPERATURE,), sites: DataFrame | None = None
) -> DataFrame:
    """Left join on site and time; what stays empty is interpolated over the plant's own rows.

    ``sites`` maps each plant to its weather site. Without it the weather must be of one site: a time
    that two sites report fails the plan.
    """
    bare = df.drop(C.TEMPERATURE)
    if sites is not None:
        placed = bare.join(sites.select(C.PLANT, "site"), C.PLANT, "left")
        joined = placed.join(weather.select("site", C.TS, C.TEMPERATURE), ["site", C.TS], "left").drop("site")
        return series.interpolate(joined, list(interpolate))
    if "site" in weather.columns:
        several = F.raise_error(F.lit("weather of several sites needs a table of plants and sites")).cast("double")
        weather = weather.groupBy(C.TS).agg(
            F.when(F.min("site") == F.max("site"), F.max(C.TEMPERATURE)).otherwise(several).alias(C.TEMPERATURE))
    return series.interpolate(bare.join(weather.select(C.TS, C.TEMPERATURE), C.TS, "left"), list(interpolate))


def station_temperature(observations: DataFrame, priority: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """Fahrenheit text of the best station of each day to a 15-minute Celsius series.

    Gaps are bridged at most three slots from either side.
    """
    chosen = asof.best_station_per_day(observations, priority)
    parsed = chosen.select(
        F.lit("all").alias("site"),
        S.to_timestamp(S.join_date_time(F.col("Date"), F.col("Time")), ("yyyy-MM-dd h:mm a",)).alias(C.TS),
        S.fahrenheit_to_celsius(S.to_number(S.strip_unit_after_space(F.col("Temperature")))).alias(C.TEMPERATURE),
        *sequence,
    ).filter(F.col(C.TS).isNotNull() & F.col(C.TEMPERATURE).isNotNull())
    unique = series.dedupe(parsed, [F.col(c) for c in sequence], "first", ("site", C.TS)).drop(*sequence)
    grid = series.resample_down(unique, [C.TEMPERATURE], order=SITE, keep_position=True)
    return series.interpolate(grid, [C.TEMPERATURE], limit=3, both=True, order=SITE).drop(POS)
