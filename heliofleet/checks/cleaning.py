"""Quality, summary and outlier checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import scalar as S
from ..operators import quality, series, splits
from ..plans import cleaning as plans
from ..plans.features import build_features
from . import bindings as B
from .registry import DAILY, READINGS, check

DAY = 'CAST(CAST("timestamp" AS DATE) AS VARCHAR)'

# Some days of one plant without radiation, some of another without power, some stuck at one value.
FAULTY = READINGS + """,
faulty AS (SELECT id_planta, "timestamp", CASE WHEN id_planta = 'click' AND day("timestamp") % 7 = 0 THEN 0
  WHEN id_planta = 'view' AND day("timestamp") % 6 = 0 THEN 5 WHEN id_planta = 'error' AND day("timestamp") = 9 THEN NULL
  ELSE radiation END AS radiation, CASE WHEN id_planta = 'signup' AND day("timestamp") % 11 = 0 THEN NULL ELSE power END AS power,
  T_ambiente FROM readings)"""


def faulty(spark, d):
    day, p = F.dayofmonth(C.TS), F.col(C.PLANT)
    return B.readings(spark, d).withColumns({
        C.RADIATION: F.when((p == "click") & (day % 7 == 0), 0.0).when((p == "view") & (day % 6 == 0), 5.0)
        .when((p == "error") & (day == 9), F.lit(None)).otherwise(F.col(C.RADIATION)),
        C.POWER: F.when(~((p == "signup") & (day % 11 == 0)), F.col(C.POWER)),
    })


@check("daily_sums", f"""
SELECT id_planta, {DAY} AS day, coalesce(sum(radiation), 0) AS sum_radiation, coalesce(sum(power), 0) AS sum_power
FROM faulty GROUP BY 1, 2""", "sum_radiation sum_power", FAULTY, 4)
def daily_sums(spark, d):
    return quality.daily_sums(faulty(spark, d))


@check("empty_day_removal", """
WITH sums AS (SELECT id_planta, CAST("timestamp" AS DATE) AS day, coalesce(sum(radiation), 0) AS r, coalesce(sum(power), 0) AS p
  FROM faulty GROUP BY 1, 2)
SELECT f.* FROM faulty f JOIN sums s ON s.id_planta = f.id_planta AND s.day = CAST(f."timestamp" AS DATE)
WHERE s.r <> 0 AND s.p <> 0""", "radiation power T_ambiente", FAULTY)
def empty_days(spark, d):
    return quality.drop_empty_days(faulty(spark, d))


@check("daily_distinct_radiation", f"""
SELECT id_planta, {DAY} AS day, count(DISTINCT radiation) AS n_distinct, avg(radiation) AS mean_radiation FROM faulty GROUP BY 1, 2""",
       "mean_radiation", FAULTY)
def daily_distinct(spark, d):
    return quality.daily_distinct(faulty(spark, d))


@check("stuck_sensor_days", f"""
SELECT id_planta, {DAY} AS day, avg(radiation) AS mean_radiation FROM faulty GROUP BY 1, 2
HAVING count(DISTINCT radiation) = 1 AND avg(radiation) > 0""", "mean_radiation", FAULTY)
def stuck_days(spark, d):
    return quality.stuck_days(faulty(spark, d))


@check("stuck_sensor_reset", """
WITH stuck AS (SELECT id_planta, CAST("timestamp" AS DATE) AS day FROM faulty GROUP BY 1, 2
  HAVING count(DISTINCT radiation) = 1 AND avg(radiation) > 0)
SELECT f.id_planta, f."timestamp", CASE WHEN s.day IS NULL THEN f.radiation END AS radiation, f.power, f.T_ambiente
FROM faulty f LEFT JOIN stuck s ON s.id_planta = f.id_planta AND s.day = CAST(f."timestamp" AS DATE)""",
       "radiation power T_ambiente", FAULTY)
def stuck_reset(spark, d):
    return quality.reset_stuck_days(faulty(spark, d))


@check("daily_completeness", f"""
WITH grid AS (SELECT id_planta, unnest(generate_series(min("timestamp"), max("timestamp"), INTERVAL 15 MINUTE)) AS "timestamp"
  FROM readings GROUP BY 1)
SELECT id_planta, day, n AS size, c AS count, n - c AS missing, (n - c) * 0.25 > 6 AS significant FROM (
  SELECT g.id_planta, CAST(CAST(g."timestamp" AS DATE) AS VARCHAR) AS day, count(*) AS n, count(r.T_ambiente) AS c
  FROM grid g LEFT JOIN readings r ON r.id_planta = g.id_planta AND r."timestamp" = g."timestamp" GROUP BY 1, 2)""")
def daily_completeness(spark, d):
    return quality.daily_completeness(series.reindex(B.readings(spark, d)))


@check("plant_summary", """
SELECT id_planta, count(*) AS n_rows, min("timestamp") AS first_ts, max("timestamp") AS last_ts,
  count(*) FILTER (WHERE radiation IS NULL) AS nulls_radiation, count(*) FILTER (WHERE power IS NULL) AS nulls_power,
  count(*) FILTER (WHERE T_ambiente IS NULL) AS "nulls_T_ambiente" FROM readings_raw GROUP BY 1""")
def plant_summary(spark, d):
    return quality.plant_summary(B.readings_raw(spark, d))


@check("availability", """
SELECT id_planta, min("timestamp") AS first_ts, max("timestamp") AS last_ts, count(*) AS n_rows,
  floor((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 86400000000.0) / 30 AS months FROM daily GROUP BY 1""",
       "months", DAILY)
def availability(spark, d):
    return quality.availability(B.daily(spark, d))


@check("frequent_values", """
SELECT radiation, count(*) AS n FROM readings WHERE radiation IS NOT NULL GROUP BY 1 ORDER BY n DESC, radiation LIMIT 10""", "radiation")
def frequent_values(spark, d):
    return quality.value_counts(B.readings(spark, d), C.RADIATION)


@check("null_negative_zero_counts", """
SELECT count(*) FILTER (WHERE radiation IS NULL) AS radiation_nulls, count(*) FILTER (WHERE power IS NULL) AS power_nulls,
  count(*) FILTER (WHERE radiation < 0) AS radiation_negatives, count(*) FILTER (WHERE power < 0) AS power_negatives,
  (SELECT avg(CAST(power_pu = 0 AS INT)) FROM pu) AS zero_share FROM readings_raw""", "zero_share")
def null_negative(spark, d):
    from ..operators.chunks import with_scalars

    pu = B.per_unit(spark, d)
    return with_scalars(
        quality.null_negative_counts(B.readings_raw(spark, d)), pu.agg(quality.zero_share(pu, C.TARGET).alias("zero_share"))
    )


@check("hour_profile", """
SELECT CAST(hour("timestamp") AS INT) AS hour, avg(power) FILTER (WHERE id_planta = 'click') AS click,
  avg(power) FILTER (WHERE id_planta = 'error') AS error, avg(power) FILTER (WHERE id_planta = 'purchase') AS purchase,
  avg(power) FILTER (WHERE id_planta = 'signup') AS signup, avg(power) FILTER (WHERE id_planta = 'view') AS "view"
FROM readings GROUP BY 1""", "click error purchase signup view")
def hour_profile(spark, d):
    return quality.hour_profile(B.readings(spark, d), sorted(B.NOMINAL_KW))


@check("seasonal_mean", """
SELECT id_planta, CASE quarter("timestamp" + INTERVAL 1 MONTH) WHEN 1 THEN 'Invierno' WHEN 2 THEN 'Primavera' WHEN 3 THEN 'Verano'
  ELSE 'Otono' END AS season, CAST(quarter("timestamp" + INTERVAL 1 MONTH) AS INT) AS season_order, avg(power) AS mean_power,
  count(*) AS n FROM daily WHERE power > 0 GROUP BY ALL""", "mean_power", DAILY, 2)
def seasonal_mean(spark, d):
    return quality.seasonal_mean(B.daily(spark, d))


@check("descriptive_summary", """
SELECT id_planta, count(power) AS n, avg(power) AS mean, stddev_samp(power) AS std, min(power) AS min, max(power) AS max,
  quantile_cont(power, 0.25) AS q1, quantile_cont(power, 0.5) AS median, quantile_cont(power, 0.75) AS q3
FROM readings_raw GROUP BY 1""", "mean std min max q1 median q3")
def descriptive_summary(spark, d):
    return quality.describe(B.readings_raw(spark, d), C.POWER, (C.PLANT,))


@check("exact_quantiles", " UNION ALL ".join(f"""
SELECT id_planta, CAST({p} AS DOUBLE) AS p, quantile_cont(power, {p}) AS q FROM daily GROUP BY 1""" for p in (0.01, 0.1, 0.5, 0.9, 0.99)),
       "p q", DAILY, 3)
def exact_quantiles(spark, d):
    from ..operators.chunks import exact_quantiles as quantiles

    return quantiles(B.daily(spark, d), C.POWER, (0.01, 0.1, 0.5, 0.9, 0.99), (C.PLANT,))


OUTLIERS = READINGS + """,
bp AS (SELECT id_planta, quantile_cont(power, 0.25) AS a, quantile_cont(power, 0.75) AS b FROM readings GROUP BY 1),
br AS (SELECT id_planta, quantile_cont(radiation, 0.25) AS a, quantile_cont(radiation, 0.75) AS b FROM readings GROUP BY 1),
step1 AS (SELECT r.*, p.a - 1.5 * (p.b - p.a) AS plo, p.b + 1.5 * (p.b - p.a) AS phi, q.a - 1.5 * (q.b - q.a) AS rlo, q.b + 1.5 * (q.b - q.a) AS rhi
  FROM readings r JOIN bp p USING (id_planta) JOIN br q USING (id_planta)),
clipped AS (SELECT id_planta, "timestamp", radiation, least(greatest(power, plo), phi) AS power, T_ambiente, rlo, rhi FROM step1)"""


@check("outlier_clipping", """
SELECT id_planta, "timestamp", least(greatest(radiation, rlo), rhi) AS radiation, power, T_ambiente FROM clipped""",
       "radiation power T_ambiente", OUTLIERS)
def outlier_clipping(spark, d):
    return quality.clip_outliers(B.readings(spark, d), k=1.5)[0]


@check("outlier_list", """
SELECT 'power' AS outlier_of, id_planta, "timestamp", radiation, power, T_ambiente FROM step1 WHERE power < plo OR power > phi
UNION ALL SELECT 'radiation', id_planta, "timestamp", radiation, power, T_ambiente FROM clipped WHERE radiation < rlo OR radiation > rhi""",
       "radiation power T_ambiente", OUTLIERS)
def outlier_list(spark, d):
    return quality.clip_outliers(B.readings(spark, d), k=1.5)[1]


@check("monthly_correlation", """
SELECT *, Correlacion < 0.85 AS low FROM (SELECT id_planta, strftime("timestamp", '%Y-%m') AS Mes,
  CASE WHEN NOT isnan(corr(radiation, power)) THEN corr(radiation, power) END AS Correlacion FROM daily GROUP BY 1, 2)""", "Correlacion", DAILY)
def monthly_correlation(spark, d):
    return quality.monthly_correlation(B.daily(spark, d))


@check("validity_report", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) FILTER (WHERE "{c}" IS NULL OR isnan("{c}")) AS n_null, count(*) FILTER (WHERE isinf("{c}")) AS n_inf,
  min("{c}") AS min, max("{c}") AS max FROM readings_raw""" for c in (C.RADIATION, C.POWER, C.TEMPERATURE)), "min max")
def validity_report(spark, d):
    return quality.validity_report(B.readings_raw(spark, d))


@check("memory_null_guard", """
WITH w AS (SELECT lag(power_pu, 1) OVER o AS a, lag(power_pu, 2) OVER o AS b, lag(power_pu, 4) OVER o AS c,
  lag(radiation, 1) OVER o AS e, lag(radiation, 2) OVER o AS f, row_number() OVER o AS n FROM pu
  WINDOW o AS (PARTITION BY id_planta ORDER BY "timestamp"))
SELECT CAST(sum((a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT + (e IS NULL)::INT + (f IS NULL)::INT
  + 3 * (n <= 1)::INT + 3 * (n <= 2)::INT) AS BIGINT) AS n_null FROM w""")
def memory_null_guard(spark, d):
    config = C.Features(complete_rows=False)
    return splits.memory_nulls(build_features(B.per_unit(spark, d), config, sorted(B.NOMINAL_KW)))


@check("unified_readings", """
SELECT id_planta, "timestamp", CASE WHEN radiation < 0 THEN 0 ELSE radiation END AS radiation,
  CASE WHEN power < 0 THEN 0 ELSE power END AS power, T_ambiente
FROM readings_raw WHERE power IS NOT NULL AND radiation IS DISTINCT FROM 999.0""", "radiation power T_ambiente")
def unified(spark, d):
    raw = B.readings_raw(spark, d)
    return plans.unify([raw.filter(F.col(C.PLANT) == p) for p in B.NOMINAL_KW])


@check("sentinel_days_of_union", """
SELECT CAST(dayofyear("timestamp") AS INT) AS day_of_year, count(*) AS n FROM readings WHERE radiation = 999 AND power IS NOT NULL GROUP BY 1""")
def sentinel_days(spark, d):
    rows = B.readings(spark, d)
    return plans.unify_with_reports([rows.filter(F.col(C.PLANT) == p) for p in B.NOMINAL_KW])["sentinel_days"]
