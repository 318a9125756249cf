"""Cleaning, sensor checks and completeness reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import scalar as S
from ..functions.aggregates import correlation
from .chunks import exact_quantiles, with_scalars

MEASURES = (C.RADIATION, C.POWER, C.TEMPERATURE)
DAY = "day"


def _day() -> Column:
    return F.to_date(C.TS)


# ---- target --------------------------------------------------------------------------------

def add_nominal_power(
    df: DataFrame, nominal_kw: Mapping[str, float], power: str = C.POWER, out: str = C.TARGET, check: bool = True
) -> DataFrame:
    """Nominal power and power per unit (W / 1000 / nominal kW).

    The mapping is configuration, one number per plant, and travels as a literal map. A plant without
    an entry fails the plan when its row is computed; with ``check=False`` its values are NULL.
    """
    entries = [F.lit(x) for kv in nominal_kw.items() for x in kv]
    nominal = F.try_element_at(F.create_map(*entries), F.col(C.PLANT)) if entries else F.lit(None).cast("double")
    if check:
        unknown = F.concat(F.lit("no nominal power for: "), F.coalesce(F.col(C.PLANT), F.lit("NULL")))
        nominal = F.coalesce(nominal, F.raise_error(unknown).cast("double"))
    return df.withColumn(C.NOMINAL, nominal).withColumn(
        out, F.try_divide(F.col(power) / 1000, F.col(C.NOMINAL))
    )


def add_nominal_from_table(df: DataFrame, nominal: DataFrame, power: str = C.POWER, out: str = C.TARGET) -> DataFrame:
    """The same from a table of plants; Spark broadcasts it if its size allows."""
    return df.join(nominal.select(C.PLANT, C.NOMINAL), C.PLANT, "left").withColumn(
        out, F.try_divide(F.col(power) / 1000, F.col(C.NOMINAL))
    )


# ---- row cleaning --------------------------------------------------------------------------

def drop_null_power_and_clip(df: DataFrame, power_lower: float = 0.0, radiation_lower: float = 0.0) -> DataFrame:
    return df.filter(F.col(C.POWER).isNotNull()).withColumns(
        {C.POWER: S.clip(F.col(C.POWER), power_lower), C.RADIATION: S.clip(F.col(C.RADIATION), radiation_lower)}
    )


def zero_nulls_and_negatives(df: DataFrame, columns: Sequence[str] = (C.RADIATION, C.POWER)) -> DataFrame:
    return df.withColumns({c: S.clip(F.coalesce(F.col(c), F.lit(0.0)), 0.0) for c in columns})


def null_negative_counts(df: DataFrame, columns: Sequence[str] = (C.RADIATION, C.POWER)) -> DataFrame:
    """NULL and negative cells of several columns in one pass."""
    return df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns],
        *[F.count_if(F.col(c) < 0).alias(f"{c}_negatives") for c in columns],
    )


def drop_sentinel(df: DataFrame, column: str = C.RADIATION, value: float = C.SENTINEL) -> DataFrame:
    """Rows carrying the sentinel go; NULL stays."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(float(value))))


def zero_night_radiation(df: DataFrame, start: int = 22, end: int = 6) -> DataFrame:
    """Radiation is 0 before hour ``end`` and after hour ``start`` (hour ``start`` itself is kept)."""
    hour = F.hour(C.TS)
    night = (hour < end) | (hour > start)
    return df.withColumn(C.RADIATION, F.when(night, 0.0).otherwise(F.col(C.RADIATION)))


def _dark_power() -> Column:
    return F.coalesce((F.col(C.RADIATION) == 0) & (F.col(C.POWER) > 0), F.lit(False))


def zero_power_without_radiation(df: DataFrame) -> DataFrame:
    return df.withColumn(C.POWER, F.when(_dark_power(), 0.0).otherwise(F.col(C.POWER)))


def power_without_radiation_report(df: DataFrame) -> DataFrame:
    return df.filter(_dark_power()).groupBy(C.PLANT).agg(
        F.count("*").alias("n_rows"), F.count_distinct(_day()).alias("n_days")
    )


# ---- day level -----------------------------------------------------------------------------

def daily_sums(df: DataFrame) -> DataFrame:
    """Sum of radiation and power per plant and day; a day of NULLs sums to 0."""
    return df.groupBy(C.PLANT, _day().alias(DAY)).agg(
        F.coalesce(F.sum(C.RADIATION), F.lit(0.0)).alias("sum_radiation"),
        F.coalesce(F.sum(C.POWER), F.lit(0.0)).alias("sum_power"),
    )


def drop_empty_days(df: DataFrame) -> DataFrame:
    """Days whose radiation or power sums to zero are removed."""
    empty = daily_sums(df).filter((F.col("sum_radiation") == 0) | (F.col("sum_power") == 0)).select(C.PLANT, DAY)
    return df.withColumn(DAY, _day()).join(empty, [C.PLANT, DAY], "left_anti").select(*df.columns)


def daily_distinct(df: DataFrame) -> DataFrame:
    """Distinct radiation values and their mean per plant and day."""
    return df.groupBy(C.PLANT, _day().alias(DAY)).agg(
        F.count_distinct(C.RADIATION).alias("n_distinct"), F.avg(C.RADIATION).alias("mean_radiation")
    )


def stuck_days(df: DataFrame) -> DataFrame:
    """Days with a single positive radiation value: min = max says so without a distinct count."""
    return df.groupBy(C.PLANT, _day().alias(DAY)).agg(
        F.min(C.RADIATION).alias("_lo"), F.max(C.RADIATION).alias("_hi"), F.avg(C.RADIATION).alias("mean_radiation")
    ).filter((F.col("_lo") == F.col("_hi")) & (F.col("mean_radiation") > 0)).select(C.PLANT, DAY, "mean_radiation")


def reset_stuck_days(df: DataFrame) -> DataFrame:
    """Radiation of a stuck day becomes NULL."""
    stuck = stuck_days(df).select(C.PLANT, DAY, F.lit(True).alias("_stuck"))
    return (
        df.withColumn(DAY, _day()).join(stuck, [C.PLANT, DAY], "left")
        .withColumn(C.RADIATION, F.when(F.col("_stuck").isNull(), F.col(C.RADIATION)))
        .select(*df.columns)
    )


def daily_completeness(df: DataFrame, column: str = C.TEMPERATURE, step_hours: float = 0.25,
                       significant_hours: float = 6.0) -> DataFrame:
    """Rows, values and missing values per day; ``significant`` marks more than six missing hours."""
    out = df.groupBy(C.PLANT, _day().alias(DAY)).agg(F.count("*").alias("size"), F.count(column).alias("count"))
    missing = F.col("size") - F.col("count")
    return out.withColumn("missing", missing).withColumn("significant", missing * step_hours > significant_hours)


def missing_radiation_days(df: DataFrame, is_sunlit: Column) -> DataFrame:
    """Days that hold a NULL reading, or a zero while the sun is up."""
    needs = F.col(C.RADIATION).isNull() | ((F.col(C.RADIATION) == 0) & is_sunlit)
    return df.filter(needs).select(C.PLANT, _day().alias(DAY)).distinct()


# ---- summaries -----------------------------------------------------------------------------

def plant_summary(df: DataFrame) -> DataFrame:
    return df.groupBy(C.PLANT).agg(
        F.count("*").alias("n_rows"), F.min(C.TS).alias("first_ts"), F.max(C.TS).alias("last_ts"),
        *[F.count_if(F.col(m).isNull()).alias(f"nulls_{m}") for m in MEASURES],
    )


def availability(df: DataFrame) -> DataFrame:
    """Range, rows and length in 30-day months of each plant (whole days of the range)."""
    days = F.floor((F.unix_micros(F.max(C.TS).cast("timestamp")) - F.unix_micros(F.min(C.TS).cast("timestamp")))
                   / 86_400_000_000)
    return df.groupBy(C.PLANT).agg(
        F.min(C.TS).alias("first_ts"), F.max(C.TS).alias("last_ts"), F.count("*").alias("n_rows"),
        (days / 30).alias("months"),
    )


def value_counts(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(k)


def zero_share(df: DataFrame, column: str) -> Column:
    return F.avg((F.col(column) == 0).cast("double"))


def describe(df: DataFrame, column: str, by: Sequence[str] = (), population: bool = False) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per group."""
    std = F.stddev_pop if population else F.stddev_samp
    moments = df.groupBy(*by).agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), std(column).alias("std"),
        F.min(column).alias("min"), F.max(column).alias("max"),
    )
    quartiles = exact_quantiles(df, column, (0.25, 0.5, 0.75), by).groupBy(*by).agg(
        *[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    )
    return moments.join(quartiles, list(by), "left") if by else with_scalars(moments, quartiles)


def validity_report(df: DataFrame, columns: Sequence[str] = MEASURES) -> DataFrame:
    """NULL (or NaN) and infinite counts, minimum and maximum per column, from one aggregation."""
    pieces = []
    for c in columns:
        v = F.col(c)
        pieces += [
            F.count_if(v.isNull() | F.isnan(v)).alias(f"{c}__n_null"),
            F.count_if(F.abs(v) == float("inf")).alias(f"{c}__n_inf"),
            F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max"),
        ]
    one = df.agg(*pieces)
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{k}").alias(k) for k in ("n_null", "n_inf", "min", "max")])
        for c in columns
    ])
    return one.select(F.inline(rows))


def hour_profile(df: DataFrame, plants: Sequence[str], column: str = C.POWER) -> DataFrame:
    """Mean by hour with one column per (declared) plant."""
    return df.groupBy(F.hour(C.TS).alias("hour")).pivot(C.PLANT, list(plants)).agg(F.avg(column))


def seasonal_mean(df: DataFrame, column: str = C.POWER) -> DataFrame:
    """Mean of producing rows by plant and season, with the season's position in the year."""
    producing = df.filter(F.col(column) > 0)
    label = S.season(F.col(C.TS))
    return producing.groupBy(C.PLANT, label.alias("season"), S.ordinal(label, C.SEASONS).alias("season_order")).agg(
        F.avg(column).alias("mean_power"), F.count("*").alias("n")
    )


def monthly_correlation(df: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Radiation-power correlation per plant and month; low months are marked."""
    both = df.filter(F.col(C.RADIATION).isNotNull() & F.col(C.POWER).isNotNull())
    out = both.groupBy(C.PLANT, S.month_key(F.col(C.TS)).alias("Mes")).agg(
        correlation(C.RADIATION, C.POWER).alias("Correlacion")
    )
    return out.withColumn("low", F.col("Correlacion") < threshold)


# ---- outliers ------------------------------------------------------------------------------

def iqr_bounds(df: DataFrame, columns: Sequence[str], k: float = 3.0) -> DataFrame:
    """One row per plant with the fences ``_lo_<column>`` and ``_hi_<column>``.

    The columns are stacked, so one set of quantile passes serves all of them.
    """
    long = df.select(C.PLANT, *columns).unpivot([C.PLANT], list(columns), "_column", "_value")
    q = exact_quantiles(long, "_value", (0.25, 0.75), (C.PLANT, "_column"))

    def quartile(c: str, p: float) -> Column:
        return F.max(F.when((F.col("_column") == c) & (F.col("p") == p), F.col("q")))

    q1 = {c: quartile(c, 0.25) for c in columns}
    q3 = {c: quartile(c, 0.75) for c in columns}
    return q.groupBy(C.PLANT).agg(
        *[(q1[c] - k * (q3[c] - q1[c])).alias(f"_lo_{c}") for c in columns],
        *[(q3[c] + k * (q3[c] - q1[c])).alias(f"_hi_{c}") for c in columns],
    )


def clip_outliers(
    df: DataFrame, columns: Sequence[str] = (C.POWER, C.RADIATION), k: float = 3.0
) -> tuple[DataFrame, DataFrame]:
    """Clipped readings, and the outlier rows as they were found.

    Columns go one after another: rows listed for the second column already carry the first one
    clipped. The fences of a column do not depend on the others, so they are all found up front.
    """
    rows, listed = df.join(iqr_bounds(df, columns, k), C.PLANT, "left"), None
    for c in columns:
        lower, upper = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        hits = rows.filter((F.col(c) < lower) | (F.col(c) > upper)).select(F.lit(c).alias("outlier_of"), *df.columns)
        listed = hits if listed is None else listed.unionByName(hits)
        rows = rows.withColumn(c, S.clip(F.col(c), lower, upper))
    return rows.select(*df.columns), listed
