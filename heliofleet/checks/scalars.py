"""Scalar, filter, split and source checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import scalar as S
from ..operators import asof, quality, splits
from ..sources import files
from . import bindings as B
from .registry import DAILY, PREDICTIONS, READINGS, SPLITS, STATIONS, check


@check("validated_union_load", """
SELECT id_planta, "timestamp", arg_max(radiation, event_id) AS radiation, arg_max(power, event_id) AS power,
  arg_max(T_ambiente, event_id) AS T_ambiente, max(event_id) AS event_id
FROM (SELECT event_type AS id_planta, time_bucket(INTERVAL '15 minutes', ts) AS "timestamp",
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) = 99 THEN -1.0
       ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) * 12 END AS radiation, value AS power,
  CAST(user_id AS DOUBLE) AS T_ambiente, event_id FROM events) GROUP BY 1, 2""", "radiation power T_ambiente")
def validated_union_load(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    raw = B.table(spark, d, "events").select(
        "event_type", F.date_format(F.window("ts", "15 minutes")["start"], "yyyy-MM-dd HH:mm:ss").alias(C.TS),
        F.when(k == 99, "Infinity").otherwise((k * 12).cast("string")).alias(C.RADIATION),
        F.col("value").cast("string").alias(C.POWER), F.col("user_id").cast("string").alias(C.TEMPERATURE), "event_id",
    )
    loaded = files.union_plants([
        files.validate_readings(raw.filter(F.col("event_type") == p).drop("event_type"), p, [F.col("event_id")])
        for p in B.NOMINAL_KW
    ])
    return loaded.withColumn(C.RADIATION, F.coalesce(C.RADIATION, F.lit(-1.0)))


@check("range_load_and_reload", """
SELECT id_planta, "timestamp", radiation, power, T_ambiente FROM readings
WHERE "timestamp" >= TIMESTAMP '2024-01-05' AND "timestamp" <= TIMESTAMP '2024-01-12'""", "radiation power T_ambiente")
def range_load(spark, d):
    return files.load_range(files.reload_unified(B.per_unit(spark, d)), "2024-01-05", "2024-01-12")


@check("station_text_parsing", 'SELECT * FROM station_radiation', "station_radiation", STATIONS)
def station_text(spark, d):
    return asof.parse_station_radiation(B.stations(spark, d), ["seq"])


@check("station_day_priority", """
WITH r AS (SELECT *, list_position(['ST3', 'ST1', 'ST5'], station) AS prio FROM stations
  WHERE station IN ('ST3', 'ST1', 'ST5'))
SELECT station, "Date", "Time", "Solar", "Temperature", seq, ts FROM r
WHERE prio = (SELECT min(prio) FROM r x WHERE x."Date" = r."Date")""", "", STATIONS)
def station_priority(spark, d):
    return asof.best_station_per_day(B.stations(spark, d), ["ST3", "ST1", "ST5"])


@check("missing_station_days", """
SELECT station, CAST(CAST(day AS DATE) AS VARCHAR) AS day FROM (SELECT DISTINCT station FROM stations),
  (SELECT unnest(generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS day)
WHERE (station, CAST(day AS DATE)) NOT IN (SELECT (station, CAST("Date" AS DATE)) FROM stations)""", "", STATIONS)
def missing_station_days(spark, d):
    return asof.missing_days(B.stations(spark, d), "2023-12-25", "2024-02-05", ["station"])


@check("text_coercion", """
SELECT event_id,
  TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS number,
  CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%d/%m/%Y %H:%M') END AS marked,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE date_trunc('minute', ts) END AS at,
  CAST(user_id % 70 + 30 AS DOUBLE) + 0.5 AS bare, (CAST(user_id % 70 + 30 AS DOUBLE) + 0.5 - 32) * 5.0 / 9.0 AS celsius
FROM events""", "number bare celsius")
def text_coercion(spark, d):
    e = B.table(spark, d, "events")
    text = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string"))
    stamp = F.date_format("ts", "dd/MM/yyyy HH:mm")
    marked = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x\\N"), stamp)).otherwise(stamp)
    mixed = F.when(F.col("event_id") % 11 == 0, "31/02/2024 25:00").when(
        F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm")
    ).otherwise(S.join_date_time(F.date_format("ts", " dd/MM/yyyy"), F.date_format("ts", "h:mm a")))
    bare = S.to_number(S.strip_unit_after_space(F.concat((F.col("user_id") % 70 + 30).cast("string"), F.lit(".5 °F"))))
    return e.select(
        "event_id", S.to_number(text).alias("number"), S.strip_null_marker(marked).alias("marked"),
        S.to_timestamp(mixed, ("yyyy-MM-dd HH:mm", "dd/MM/yyyy h:mm a")).alias("at"),
        bare.alias("bare"), S.fahrenheit_to_celsius(bare).alias("celsius"),
    )


@check("per_unit_target", "SELECT * FROM pu", "radiation power T_ambiente p_nominal_kw power_pu")
def per_unit_target(spark, d):
    return B.per_unit(spark, d)


@check("calendar_fields", """
SELECT id_planta, "timestamp", CAST(dayofyear("timestamp") AS INT) AS day_of_year, CAST(hour("timestamp") AS INT) AS hour,
  CAST(minute("timestamp") AS INT) AS minute, CAST(month("timestamp") AS INT) AS month,
  CAST(isodow("timestamp") - 1 AS INT) AS weekday, CAST(isodow("timestamp") >= 6 AS INT) AS is_weekend,
  sin(2 * pi() * dayofyear("timestamp") / 365) AS sin_day, cos(2 * pi() * dayofyear("timestamp") / 365) AS cos_day,
  sin(2 * pi() * (hour("timestamp") + minute("timestamp") / 60.0) / 24) AS sin_hour,
  cos(2 * pi() * (hour("timestamp") + minute("timestamp") / 60.0) / 24) AS cos_hour,
  sin(2 * pi() * hour("timestamp") / 24) AS sin_whole_hour, cos(2 * pi() * hour("timestamp") / 24) AS cos_whole_hour
FROM readings""", "sin_day cos_day sin_hour cos_hour sin_whole_hour cos_whole_hour")
def calendar_fields(spark, d):
    ts = F.col(C.TS)
    whole = S.cyclic_calendar(ts, fractional_hour=False)
    return B.readings(spark, d).select(C.PLANT, C.TS).withColumns(
        S.calendar(ts) | S.cyclic_calendar(ts)
        | {"sin_whole_hour": whole["sin_hour"], "cos_whole_hour": whole["cos_hour"]}
    )


@check("labels_and_one_hot", """
SELECT id_planta, "timestamp", CAST(coalesce(radiation, 0) > 20 AS INT) AS is_daylight,
  radiation * T_ambiente AS radiation_x_temp, radiation * radiation AS radiation_sq,
  CASE WHEN radiation < 10 THEN 'noche' WHEN radiation < 200 THEN 'baja' WHEN radiation < 600 THEN 'media' ELSE 'alta' END AS regime,
  CAST(radiation < 10 AS INT) AS regime_noche, CAST(radiation >= 10 AND radiation < 200 AS INT) AS regime_baja,
  CAST(radiation >= 200 AND radiation < 600 AS INT) AS regime_media, CAST(radiation >= 600 AS INT) AS regime_alta,
  CAST(id_planta = 'error' AS INT) AS plant_error, CAST(id_planta = 'purchase' AS INT) AS plant_purchase,
  CAST(id_planta = 'signup' AS INT) AS plant_signup, CAST(id_planta = 'view' AS INT) AS plant_view
FROM readings""", "radiation_x_temp radiation_sq", digits=4)
def labels_and_one_hot(spark, d):
    r = F.col(C.RADIATION)
    regime = S.regime(r)
    return B.readings(spark, d).withColumns(
        {"is_daylight": S.daylight(r)} | S.interactions(r, F.col(C.TEMPERATURE)) | {"regime": regime}
        | S.one_hot(regime, C.REGIMES, "regime")
        | S.one_hot(F.col(C.PLANT), sorted(B.NOMINAL_KW), "plant", drop_first=True)
    ).drop(C.RADIATION, C.POWER, C.TEMPERATURE)


@check("season_and_month", """
SELECT id_planta, "timestamp", CASE WHEN month("timestamp") IN (12, 1, 2) THEN 'Invierno'
  WHEN month("timestamp") IN (3, 4, 5) THEN 'Primavera' WHEN month("timestamp") IN (6, 7, 8) THEN 'Verano'
  ELSE 'Otono' END AS season, CAST(CASE WHEN month("timestamp") IN (12, 1, 2) THEN 1
  WHEN month("timestamp") IN (3, 4, 5) THEN 2 WHEN month("timestamp") IN (6, 7, 8) THEN 3 ELSE 4 END AS INT) AS season_order,
  strftime("timestamp", '%Y-%m') AS Mes FROM daily""", "", DAILY)
def season_and_month(spark, d):
    label = S.season(F.col(C.TS))
    return B.daily(spark, d).select(
        C.PLANT, C.TS, label.alias("season"), S.ordinal(label, C.SEASONS).alias("season_order"),
        S.month_key(F.col(C.TS)).alias("Mes"),
    )


@check("clip_and_drop_null_power", """
SELECT id_planta, "timestamp", CASE WHEN radiation < 0 THEN 0 ELSE radiation END AS radiation,
  CASE WHEN power < 0 THEN 0 ELSE power END AS power, T_ambiente FROM readings_raw WHERE power IS NOT NULL""",
       "radiation power T_ambiente")
def clip_and_drop(spark, d):
    return quality.drop_null_power_and_clip(B.readings_raw(spark, d))


@check("zero_nulls_and_negatives", """
SELECT id_planta, "timestamp", greatest(coalesce(radiation, 0), 0) AS radiation, greatest(coalesce(power, 0), 0) AS power,
  T_ambiente FROM readings_raw""", "radiation power T_ambiente")
def zero_nulls(spark, d):
    return quality.zero_nulls_and_negatives(B.readings_raw(spark, d))


@check("night_and_dark_zeroing", """
WITH n AS (SELECT id_planta, "timestamp", T_ambiente, power + 2 AS power, CASE WHEN hour("timestamp") < 6 OR hour("timestamp") > 22
  THEN 0 ELSE radiation - 3 END AS radiation FROM readings_raw)
SELECT id_planta, "timestamp", radiation, CASE WHEN radiation = 0 AND power > 0 THEN 0 ELSE power END AS power, T_ambiente
FROM n""", "radiation power T_ambiente")
def night_and_dark(spark, d):
    r = B.readings_raw(spark, d).withColumns({C.RADIATION: F.col(C.RADIATION) - 3, C.POWER: F.col(C.POWER) + 2})
    return quality.zero_power_without_radiation(quality.zero_night_radiation(r))


@check("dark_power_report", """
SELECT id_planta, count(*) AS n_rows, count(DISTINCT CAST("timestamp" AS DATE)) AS n_days FROM (
  SELECT id_planta, "timestamp", CASE WHEN hour("timestamp") < 10 OR hour("timestamp") > 22 THEN 0 ELSE radiation END AS radiation,
  power FROM readings) WHERE radiation = 0 AND power > 0 GROUP BY 1""")
def dark_power_report(spark, d):
    return quality.power_without_radiation_report(quality.zero_night_radiation(B.readings(spark, d), end=10))


@check("bands", """
SELECT id_planta, "timestamp", CASE WHEN radiation <= 0 THEN NULL WHEN radiation <= 100 THEN '<100'
  WHEN radiation <= 300 THEN '100-300' WHEN radiation <= 600 THEN '300-600' WHEN radiation <= 1000 THEN '600-1000'
  WHEN radiation <= 2000 THEN '>1000' END AS rad_bin, CASE WHEN power_pu <= 0 THEN NULL WHEN power_pu <= 0.1 THEN '0-10%'
  WHEN power_pu <= 0.2 THEN '10-20%' WHEN power_pu <= 0.4 THEN '20-40%' WHEN power_pu <= 0.6 THEN '40-60%'
  WHEN power_pu <= 0.8 THEN '60-80%' WHEN power_pu <= 1 THEN '80-100%' END AS prod_bin FROM pu""")
def bands(spark, d):
    return B.per_unit(spark, d).select(
        C.PLANT, C.TS, S.irradiance_band(F.col(C.RADIATION)).alias("rad_bin"),
        S.production_band(F.col(C.TARGET)).alias("prod_bin"),
    )


@check("label_cleanup", """
SELECT DISTINCT regexp_replace('rad_ST ' || (user_id % 6), '^rad_', '') AS plain,
  replace(regexp_replace('rad_ST ' || (user_id % 6), '^rad_', ''), ' ', '_') AS file_name,
  CASE event_type WHEN 'click' THEN 'Con lag' WHEN 'view' THEN 'Sin lag' END AS scenario FROM events""")
def label_cleanup(spark, d):
    name = F.concat(F.lit("rad_ST "), (F.col("user_id") % 6).cast("string"))
    return B.table(spark, d, "events").select(
        F.regexp_replace(name, "^rad_", "").alias("plain"), S.file_safe(name).alias("file_name"),
        S.relabel(F.col("event_type"), {"click": "Con lag", "view": "Sin lag"}).alias("scenario"),
    ).distinct()


@check("rounded_outputs", """
SELECT id_planta, "timestamp", round(power_pu * 1000 + 3.3e-8, 2) AS two, round(power_pu + 3.3e-8, 6) AS six FROM pu""", "two six")
def rounded_outputs(spark, d):
    pu = B.per_unit(spark, d).select(
        C.PLANT, C.TS, (F.col(C.TARGET) * 1000 + 3.3e-8).alias("two"), (F.col(C.TARGET) + 3.3e-8).alias("six")
    )
    return S.rounded(S.rounded(pu, 2, ["two"]), 6, ["six"])


# ---- filters and splits --------------------------------------------------------------------

@check("range_bounds", """
SELECT count(*) FILTER (WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-09') AS closed,
  count(*) FILTER (WHERE "timestamp" >= TIMESTAMP '2024-01-03' AND "timestamp" < TIMESTAMP '2024-01-09') AS half_open,
  count(*) FILTER (WHERE power > 0) AS producing FROM readings""")
def range_bounds(spark, d):
    ts = F.col(C.TS)
    return B.readings(spark, d).agg(
        F.count_if(splits.between(ts, "2024-01-03", "2024-01-09")).alias("closed"),
        F.count_if(splits.between(ts, "2024-01-03", "2024-01-09", closed=False)).alias("half_open"),
        F.count_if(F.col(C.POWER) > 0).alias("producing"),
    )


@check("sentinel_removal", "SELECT * FROM readings WHERE radiation IS DISTINCT FROM 999.0", "radiation power T_ambiente")
def sentinel_removal(spark, d):
    return quality.drop_sentinel(B.readings(spark, d))


@check("drop_any_null", """
SELECT id_planta, "timestamp", radiation, power FROM readings_raw WHERE power IS NOT NULL AND radiation IS NOT NULL""",
       "radiation power")
def drop_any_null(spark, d):
    return B.readings_raw(spark, d).select(C.PLANT, C.TS, C.RADIATION, C.POWER).dropna(
        "any", subset=[C.TS, C.RADIATION, C.POWER]
    )


@check("time_plant_split", 'SELECT id_planta, "timestamp", split, power_pu FROM base', "power_pu", SPLITS)
def time_plant_split(spark, d):
    return splits.assign_split(B.per_unit(spark, d), B.TRAIN_PLANTS, B.TEST_PLANT, B.SPLIT).select(
        C.PLANT, C.TS, "split", C.TARGET
    )


@check("plant_split", """
SELECT 'train' AS part, count(*) AS n FROM readings WHERE id_planta IN ('click', 'view')
UNION ALL SELECT 'test', count(*) FROM readings WHERE id_planta = 'purchase'""")
def plant_split(spark, d):
    train, test = splits.split_by_plant(B.readings(spark, d), B.TRAIN_PLANTS, B.TEST_PLANT)
    return train.agg(F.lit("train").alias("part"), F.count("*").alias("n")).unionByName(
        test.agg(F.lit("test").alias("part"), F.count("*").alias("n"))
    )


ADAPTED = dict(base_end="2024-01-16", local=("2024-01-12", "2024-01-19"), val=("2024-01-16", "2024-01-22"),
               test=("2024-01-22", "2024-01-30"))


@check("adapted_split", """
SELECT split, id_planta, count(*) AS n, min("timestamp") AS first_ts, max("timestamp") AS last_ts FROM (
  SELECT *, CASE WHEN id_planta IN ('click', 'view') AND "timestamp" < TIMESTAMP '2024-01-16' THEN 'train'
    WHEN id_planta = 'purchase' AND "timestamp" >= TIMESTAMP '2024-01-12' AND "timestamp" < TIMESTAMP '2024-01-19' THEN 'train'
    WHEN id_planta IN ('click', 'view') AND "timestamp" < TIMESTAMP '2024-01-22' THEN 'val'
    WHEN id_planta = 'purchase' AND "timestamp" >= TIMESTAMP '2024-01-22' AND "timestamp" < TIMESTAMP '2024-01-30' THEN 'test'
  END AS split FROM readings) WHERE split IS NOT NULL GROUP BY 1, 2""")
def adapted(spark, d):
    rows = splits.adapted_split(B.readings(spark, d), B.TRAIN_PLANTS, B.TEST_PLANT, **ADAPTED)
    return rows.groupBy("split", C.PLANT).agg(
        F.count("*").alias("n"), F.min(C.TS).alias("first_ts"), F.max(C.TS).alias("last_ts")
    )


SEASON_WINDOWS = {
    "Invierno": ("1996-12-01", "1997-02-28"), "Primavera": ("1997-03-01", "1997-05-31"),
    "Verano": ("1997-06-01", "1997-08-31"), "Otono": ("1997-09-01", "1997-11-30"),
}
SEASON_VALUES = ", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, (a, b) in SEASON_WINDOWS.items())


@check("season_windows", f"""
SELECT w.estacion, count(*) AS n, min(x."timestamp") AS first_ts, max(x."timestamp") AS last_ts, sum(x.power) AS power
FROM daily x JOIN (VALUES {SEASON_VALUES}) w(estacion, a, b) ON x."timestamp" BETWEEN w.a AND w.b
WHERE x.id_planta = 'N' GROUP BY 1""", "power", DAILY, 2)
def season_window_counts(spark, d):
    return splits.season_windows(B.daily(spark, d), SEASON_WINDOWS, "N").groupBy("estacion").agg(
        F.count("*").alias("n"), F.min(C.TS).alias("first_ts"), F.max(C.TS).alias("last_ts"), F.sum(C.POWER).alias("power")
    )


@check("split_report", """
SELECT split, count(*) AS n_rows, min("timestamp") AS first_ts, max("timestamp") AS last_ts,
  string_agg(DISTINCT id_planta, ',' ORDER BY id_planta) AS plants FROM base GROUP BY 1""", "", SPLITS)
def split_report(spark, d):
    return splits.split_report(splits.assign_split(B.per_unit(spark, d), B.TRAIN_PLANTS, B.TEST_PLANT, B.SPLIT))


@check("leakage_guard", """
SELECT max("timestamp") FILTER (WHERE split = 'train') AS train_max, min("timestamp") FILTER (WHERE split = 'val') AS val_min,
  max("timestamp") FILTER (WHERE split = 'val') AS val_max, min("timestamp") FILTER (WHERE split = 'test') AS test_min,
  max("timestamp") FILTER (WHERE split = 'train') < min("timestamp") FILTER (WHERE split = 'val')
  AND min("timestamp") FILTER (WHERE split = 'val') < min("timestamp") FILTER (WHERE split = 'test') AS ordered FROM base""", "", SPLITS)
def leakage_guard(spark, d):
    return splits.split_bounds(splits.assign_split(B.per_unit(spark, d), B.TRAIN_PLANTS, B.TEST_PLANT, B.SPLIT))


@check("first_week", """
SELECT id_planta, "timestamp", power FROM readings
WHERE "timestamp" < (SELECT min("timestamp") FROM readings) + INTERVAL 7 DAY""", "power")
def first_week(spark, d):
    return splits.first_days(B.readings(spark, d)).select(C.PLANT, C.TS, C.POWER)


@check("prediction_export", """
SELECT *, y_pred - y_true AS error, abs(y_pred - y_true) AS abs_error FROM pred""",
       "y_true y_pred radiation T_ambiente error abs_error", PREDICTIONS)
def prediction_export(spark, d):
    from ..operators.evaluate import prediction_export as export

    return export(B.predictions(spark, d))
