"""Lag, rolling, grid, filling and episode checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import scalar as S
from ..operators import episodes, evaluate, quality, series
from ..operators.chunks import POS, Order
from ..plans import cleaning as plans
from ..plans.diagnostics import monitor, residual_table
from ..plans.features import build_features
from ..plans.predictors import linear_predictions
from . import bindings as B
from .registry import DAILY, READINGS, RESIDUALS, STATIONS, WEATHER, check

O = 'OVER (PARTITION BY id_planta ORDER BY "timestamp")'


def rows(a, b):
    return f'OVER (PARTITION BY id_planta ORDER BY "timestamp" ROWS BETWEEN {a} AND {b})'


@check("lag_features", f"""
SELECT id_planta, "timestamp", power_pu, radiation, lag(power_pu, 1) {O} AS power_pu_lag_1, lag(power_pu, 2) {O} AS power_pu_lag_2,
  lag(power_pu, 4) {O} AS power_pu_lag_4, lag(radiation, 1) {O} AS radiation_lag_1, lag(radiation, 2) {O} AS radiation_lag_2,
  lag(power_pu, 1) {O} - lag(power_pu, 2) {O} AS delta_power_pu_1, lag(radiation, 1) {O} - lag(radiation, 2) {O} AS delta_radiation_1
FROM pu""", "power_pu radiation power_pu_lag_1 power_pu_lag_2 power_pu_lag_4 radiation_lag_1 radiation_lag_2 delta_power_pu_1 delta_radiation_1")
def lag_features(spark, d):
    return series.add_deltas(series.add_lags(B.per_unit(spark, d).select(C.PLANT, C.TS, C.TARGET, C.RADIATION)))


def _rolling_sql(column, n):
    w = rows(f"{n} PRECEDING", "1 PRECEDING")
    return f"avg({column}) {w} AS {column}_roll_mean_{n}, stddev_samp({column}) {w} AS {column}_roll_std_{n}"


ROLLING = ", ".join(_rolling_sql(c, n) for c, n in (("power_pu", 4), ("power_pu", 8), ("radiation", 4)))
ROLLING_NAMES = " ".join(f"{c}_roll_{k}_{n}" for c, n in (("power_pu", 4), ("power_pu", 8), ("radiation", 4)) for k in ("mean", "std"))


@check("rolling_features", f'SELECT id_planta, "timestamp", {ROLLING} FROM pu', ROLLING_NAMES, digits=5)
def rolling_features(spark, d):
    return series.add_rolling(B.per_unit(spark, d).select(C.PLANT, C.TS, C.TARGET, C.RADIATION)).drop(C.TARGET, C.RADIATION)


@check("horizon_targets", f"""
SELECT * FROM (SELECT id_planta, "timestamp", lead(power_pu, 1) {O} AS power_pu_h1, lead(power_pu, 4) {O} AS power_pu_h4,
  lead(power_pu, 16) {O} AS power_pu_h16 FROM pu) WHERE power_pu_h1 IS NOT NULL AND power_pu_h4 IS NOT NULL AND power_pu_h16 IS NOT NULL""",
       "power_pu_h1 power_pu_h4 power_pu_h16")
def horizon_targets(spark, d):
    out = series.add_horizons(B.per_unit(spark, d).select(C.PLANT, C.TS, C.TARGET)).drop(C.TARGET)
    return out.dropna(subset=series.horizon_names())


@check("time_exact_lag", """
SELECT a.id_planta, a."timestamp", a.power_pu, b.power_pu AS same_slot FROM pu a LEFT JOIN pu b
ON b.id_planta = a.id_planta AND b."timestamp" = a."timestamp" - INTERVAL 1 DAY""", "power_pu same_slot")
def time_exact_lag(spark, d):
    return series.time_exact_lag(B.per_unit(spark, d).select(C.PLANT, C.TS, C.TARGET), C.TARGET, 96, "same_slot")


@check("smoothers", f"""
SELECT id_planta, "timestamp", CASE WHEN count(power_pu) {rows('8 PRECEDING', '7 FOLLOWING')} >= 4
  THEN avg(power_pu) {rows('8 PRECEDING', '7 FOLLOWING')} END AS centred,
  CASE WHEN count(power_pu) {rows('95 PRECEDING', 'CURRENT ROW')} >= 24 THEN avg(power_pu) {rows('95 PRECEDING', 'CURRENT ROW')} END AS trailing
FROM pu""", "centred trailing")
def smoothers(spark, d):
    pu = B.per_unit(spark, d).select(C.PLANT, C.TS, C.TARGET)
    return series.trailing_mean(series.centred_mean(pu, C.TARGET, "centred"), C.TARGET, "trailing").drop(C.TARGET)


@check("first_difference", f'SELECT id_planta, "timestamp", power_pu - lag(power_pu) {O} AS delta FROM pu WHERE power_pu > 0', "delta")
def first_difference(spark, d):
    pu = B.per_unit(spark, d).filter(F.col(C.TARGET) > 0)
    return series.first_difference(pu.select(C.PLANT, C.TS, C.TARGET), C.TARGET, "delta").drop(C.TARGET)


@check("canonical_order", 'SELECT * FROM readings ORDER BY id_planta, "timestamp"', "radiation power T_ambiente")
def canonical_order(spark, d):
    return series.canonical_order(B.readings(spark, d))


@check("time_gaps", f"""
SELECT id_planta, prev_timestamp, "timestamp", date_diff('minute', prev_timestamp, "timestamp") + 0.0::DOUBLE AS gap_minutes
FROM (SELECT id_planta, lag("timestamp") {O} AS prev_timestamp, "timestamp" FROM readings)
WHERE "timestamp" - prev_timestamp <> INTERVAL 15 MINUTE""", "gap_minutes")
def time_gaps(spark, d):
    return series.time_gaps(B.readings(spark, d))


@check("time_consistency", f"""
WITH s AS (SELECT id_planta, date_diff('minute', lag("timestamp") {O}, "timestamp") AS step FROM readings),
c AS (SELECT id_planta, step, count(*) AS n FROM s WHERE step IS NOT NULL GROUP BY 1, 2),
m AS (SELECT id_planta, step FROM c QUALIFY row_number() OVER (PARTITION BY id_planta ORDER BY n DESC, step) = 1)
SELECT s.id_planta, count(*) AS n_rows, count(*) FILTER (WHERE s.step <> 15) AS n_gaps, max(m.step) + 0.0::DOUBLE AS mode_minutes,
  count(*) FILTER (WHERE s.step <> 15) / greatest(count(*) - 1, 1) AS gap_ratio FROM s JOIN m ON m.id_planta = s.id_planta GROUP BY 1""",
       "mode_minutes gap_ratio")
def time_consistency(spark, d):
    return series.time_consistency(B.readings(spark, d))


@check("dedupe_first_and_last", """
SELECT event_type AS id_planta, time_bucket(INTERVAL '15 minutes', ts) AS "timestamp", arg_min(value, event_id) AS first_value,
  arg_max(value, event_id) AS last_value FROM events GROUP BY 1, 2""", "first_value last_value")
def dedupe_both(spark, d):
    raw = B.table(spark, d, "events").select(
        F.col("event_type").alias(C.PLANT), F.window("ts", "15 minutes")["start"].cast("timestamp_ntz").alias(C.TS), "value", "event_id"
    )
    first, last = (series.dedupe(raw, [F.col("event_id")], k).drop("event_id").withColumnRenamed("value", f"{k}_value")
                   for k in ("first", "last"))
    return first.join(last, [C.PLANT, C.TS])


# ---- grid and filling ----------------------------------------------------------------------

def grid_sql(table, columns, key="id_planta", step="15 MINUTE"):
    picked = ", ".join(f"r.{c}" for c in columns)
    return f"""
slots_of_{table} AS (SELECT {key}, unnest(generate_series(min("timestamp"), max("timestamp"), INTERVAL {step})) AS "timestamp"
  FROM {table} GROUP BY 1),
grid_of_{table} AS (SELECT g.{key}, g."timestamp", {picked}, row_number() OVER (PARTITION BY g.{key} ORDER BY g."timestamp") AS pos
  FROM slots_of_{table} g LEFT JOIN {table} r ON r.{key} = g.{key} AND r."timestamp" = g."timestamp")"""


def interpolated(column, limit=None, both=False, key="id_planta"):
    """Expression for one interpolated column of a grid that carries ``pos``."""
    part = f'PARTITION BY {key} ORDER BY "timestamp" ROWS BETWEEN'
    back, ahead = f"({part} UNBOUNDED PRECEDING AND CURRENT ROW)", f"({part} CURRENT ROW AND UNBOUNDED FOLLOWING)"

    def near(what):
        value = f"CASE WHEN {column} IS NOT NULL THEN {what} END IGNORE NULLS"
        return f"last_value({value}) OVER {back}", f"first_value({value}) OVER {ahead}"

    (t0, t1), (v0, v1), (i0, i1) = near('epoch_us("timestamp")'), near(column), near("pos")
    line = f'{v0} + ({v1} - {v0}) * ((epoch_us("timestamp") - {t0}) / ({t1} - {t0}))'
    reach = f"pos - {i0} <= {limit}" if limit else f"{i0} IS NOT NULL"
    if both:
        reach = f"({reach} OR {i1} - pos <= {limit})"
    value = f"CASE WHEN {i0} IS NOT NULL AND {i1} IS NOT NULL THEN {line} WHEN {i0} IS NOT NULL THEN {v0} ELSE {v1} END"
    return f"CASE WHEN {column} IS NOT NULL THEN {column} WHEN {reach} THEN {value} END"


GRID = READINGS + "," + grid_sql("readings", ("radiation", "power"))


@check("regular_grid", 'SELECT id_planta, "timestamp", radiation, power FROM grid_of_readings', "radiation power", GRID)
def regular_grid(spark, d):
    return series.reindex(B.readings(spark, d).drop(C.TEMPERATURE))


@check("missing_slots", """
SELECT id_planta, "timestamp" FROM slots_of_readings EXCEPT SELECT id_planta, "timestamp" FROM readings""", "", GRID)
def missing_slots(spark, d):
    return series.missing_slots(B.readings(spark, d))


@check("interpolation_limited", f"""
SELECT id_planta, "timestamp", {interpolated('radiation', 2)} AS radiation, {interpolated('power', 2)} AS power FROM grid_of_readings""",
       "radiation power", GRID)
def interpolation_limited(spark, d):
    grid = series.reindex(B.readings(spark, d).drop(C.TEMPERATURE), keep_position=True)
    return series.interpolate(grid, [C.RADIATION, C.POWER], limit=2).drop(POS)


@check("interpolation_both_sides", f"""
SELECT id_planta, "timestamp", {interpolated('radiation', 1, True)} AS radiation FROM grid_of_readings""", "radiation", GRID)
def interpolation_both(spark, d):
    grid = series.reindex(B.readings(spark, d).select(C.PLANT, C.TS, C.RADIATION), keep_position=True)
    return series.interpolate(grid, [C.RADIATION], limit=1, both=True).drop(POS)


def copied(column, o='OVER (PARTITION BY id_planta ORDER BY "timestamp")'):
    return f"coalesce({column}, lag({column}, 96) {o}, lag({column}, 192) {o}, lag({column}, 288) {o})"


@check("previous_day_copy", f"""
SELECT id_planta, "timestamp", {copied('radiation')} AS radiation, {copied('power')} AS power FROM grid_of_readings""",
       "radiation power", GRID)
def previous_day_copy(spark, d):
    grid = series.reindex(B.readings(spark, d).drop(C.TEMPERATURE), keep_position=True)
    return series.previous_day(grid, [C.RADIATION, C.POWER])


@check("gap_processing", f"""
WITH f AS (SELECT id_planta, "timestamp", {interpolated('radiation', 1)} AS radiation, {interpolated('power', 1)} AS power FROM grid_of_readings)
SELECT id_planta, "timestamp", {copied('radiation')} AS radiation, {copied('power')} AS power,
  strftime("timestamp", '%Y-%m') AS Mes, CAST(hour("timestamp") AS INT) AS hour FROM f""", "radiation power", GRID)
def gap_processing(spark, d):
    return series.fill_gaps(B.readings(spark, d).drop(C.TEMPERATURE), limit=1)


UP = WEATHER + "," + grid_sql("weather", ("T_ambiente",), "site") + f""",
fine AS (SELECT site, "timestamp", {interpolated('T_ambiente', key='site')} AS T_ambiente FROM grid_of_weather)"""


@check("resample_up", "SELECT * FROM fine", "T_ambiente", UP)
def resample_up(spark, d):
    return plans.hourly_temperature(B.weather(spark, d))


DOWN = STATIONS + """,
means AS (SELECT station, time_bucket(INTERVAL '15 minutes', "timestamp") AS "timestamp", avg(station_radiation) AS v
  FROM station_radiation GROUP BY 1, 2),""" + grid_sql("means", ("v",), "station")


@check("resample_down", 'SELECT station, "timestamp", v AS station_radiation FROM grid_of_means', "station_radiation", DOWN)
def resample_down(spark, d):
    from ..operators.asof import parse_station_radiation

    rows_ = parse_station_radiation(B.stations(spark, d), ["seq"])
    return series.resample_down(rows_, ["station_radiation"], order=Order(keys=("station",)))


# ---- accumulation and monitor --------------------------------------------------------------

def residual_rows(spark, d):
    pu = B.per_unit(spark, d)
    from ..operators.chunks import with_scalars
    from ..operators.splits import assign_split

    train = assign_split(pu, B.TRAIN_PLANTS, B.TEST_PLANT, B.SPLIT).filter(F.col("split") == "train")
    line = train.agg(F.regr_slope(C.TARGET, C.RADIATION).alias("_a"), F.regr_intercept(C.TARGET, C.RADIATION).alias("_b"))
    scored = with_scalars(pu, line).withColumns({"y_true": F.col(C.TARGET), "y_pred": F.col("_b") + F.col("_a") * F.col(C.RADIATION)})
    return residual_table(scored, F.col(C.NOMINAL)).select(
        C.PLANT, C.TS, C.RADIATION, C.TEMPERATURE, "y_true", "y_pred", "e_pu", "e_kw", "e_abs_kw", "is_daylight", "e_rel", "season"
    )


@check("residual_columns", "SELECT * FROM res", "radiation T_ambiente y_true y_pred e_pu e_kw e_abs_kw e_rel", RESIDUALS, 5)
def residual_columns(spark, d):
    return residual_rows(spark, d).drop("season")


@check("cumulative_residual", f"""
SELECT id_planta, "timestamp", sum(CASE WHEN is_daylight THEN e_kw ELSE 0 END) {rows('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS e_kw_cum
FROM res""", "e_kw_cum", RESIDUALS, 5)
def cumulative_residual(spark, d):
    term = S.daylight_only(F.col("e_kw"), F.col("is_daylight"))
    return series.cumulative(residual_rows(spark, d), {"e_kw_cum": term}).select(C.PLANT, C.TS, "e_kw_cum")


MONITOR = C.MonitorConfig(threshold=1.0)
MONITORED = RESIDUALS + f""",
smooth AS (SELECT *, CASE WHEN count(e_rel) {rows('95 PRECEDING', 'CURRENT ROW')} >= 24 THEN avg(e_rel) {rows('95 PRECEDING', 'CURRENT ROW')} END
  AS e_rel_smooth FROM res WHERE is_daylight),
flagged AS (SELECT *, coalesce(e_rel_smooth < -1.0, FALSE) AS alerta FROM smooth),
marked AS (SELECT *, CASE WHEN alerta IS DISTINCT FROM lag(alerta) {O} THEN 1 ELSE 0 END AS changed FROM flagged),
mon AS (SELECT *, CAST(sum(changed) {rows('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS BIGINT) AS bloque FROM marked),
eps AS (SELECT id_planta, bloque, min("timestamp") AS inicio, max("timestamp") AS fin, count(*) AS duracion_pasos, avg(e_rel) AS e_rel_medio,
  count(*) * 0.25::DOUBLE AS duracion_horas, CASE WHEN count(*) * 0.25 >= 2 THEN 'Persistente (posible fallo/suciedad)'
  ELSE 'Esporádica (nube, sombra)' END AS tipo FROM mon WHERE alerta GROUP BY 1, 2)"""


@check("monitor_rows", """
SELECT id_planta, "timestamp", e_rel, e_rel_smooth, alerta, bloque FROM mon""", "e_rel e_rel_smooth", MONITORED, 4)
def monitor_rows(spark, d):
    return episodes.monitored(residual_rows(spark, d), MONITOR).select(C.PLANT, C.TS, "e_rel", "e_rel_smooth", "alerta", "bloque")


@check("alert_episodes", "SELECT * FROM eps", "e_rel_medio duracion_horas", MONITORED, 4)
def alert_episodes(spark, d):
    return episodes.episodes(episodes.monitored(residual_rows(spark, d), MONITOR), MONITOR)


@check("longest_episodes", """
SELECT id_planta, bloque, inicio, fin, duracion_horas FROM eps WHERE tipo LIKE 'Persistente%'
ORDER BY duracion_horas DESC, inicio, id_planta LIMIT 2""", "duracion_horas", MONITORED)
def longest(spark, d):
    eps = episodes.episodes(episodes.monitored(residual_rows(spark, d), MONITOR), MONITOR)
    return episodes.longest_persistent(eps).select(C.PLANT, "bloque", "inicio", "fin", "duracion_horas")


@check("contrast_day_rows", """
WITH top AS (SELECT id_planta, CAST(inicio AS DATE) AS dia FROM eps WHERE tipo LIKE 'Persistente%'
  QUALIFY row_number() OVER (PARTITION BY id_planta ORDER BY duracion_horas DESC, inicio) = 1),
calm AS (SELECT id_planta, coalesce(min(dia) FILTER (WHERE NOT started), min(dia)) AS dia FROM (
  SELECT DISTINCT m.id_planta, CAST(m."timestamp" AS DATE) AS dia, EXISTS (SELECT 1 FROM eps e WHERE e.id_planta = m.id_planta
    AND CAST(e.inicio AS DATE) = CAST(m."timestamp" AS DATE)) AS started FROM mon m) GROUP BY 1),
days AS (SELECT id_planta, 'anomalo' AS clase, dia FROM top UNION ALL
  SELECT c.id_planta, 'normal', c.dia FROM calm c JOIN top t ON t.id_planta = c.id_planta)
SELECT m.id_planta, CAST(d.dia AS VARCHAR) AS dia, d.clase, m."timestamp", m.y_true, m.y_pred, m.radiation
FROM mon m JOIN days d ON d.id_planta = m.id_planta AND d.dia = CAST(m."timestamp" AS DATE)""", "y_true y_pred radiation", MONITORED)
def contrast_day_rows(spark, d):
    out = monitor(residual_rows(spark, d), MONITOR)["day_rows"]
    return out.select(C.PLANT, "dia", "clase", C.TS, "y_true", "y_pred", C.RADIATION)


# ---- the whole feature plan and the whole cleaning plan -------------------------------------

FEATURES = READINGS + f""",
wide AS (SELECT *, CAST(dayofyear("timestamp") AS INT) AS day_of_year, CAST(hour("timestamp") AS INT) AS hour,
  CAST(minute("timestamp") AS INT) AS minute, CAST(month("timestamp") AS INT) AS month, CAST(isodow("timestamp") - 1 AS INT) AS weekday,
  CAST(isodow("timestamp") >= 6 AS INT) AS is_weekend, sin(2 * pi() * dayofyear("timestamp") / 365) AS sin_day,
  cos(2 * pi() * dayofyear("timestamp") / 365) AS cos_day,
  sin(2 * pi() * (hour("timestamp") + minute("timestamp") / 60.0) / 24) AS sin_hour,
  cos(2 * pi() * (hour("timestamp") + minute("timestamp") / 60.0) / 24) AS cos_hour,
  CAST(radiation > 20 AS INT) AS is_daylight, radiation * T_ambiente AS radiation_x_temp, radiation * radiation AS radiation_sq,
  CAST(radiation < 10 AS INT) AS regime_noche, CAST(radiation >= 10 AND radiation < 200 AS INT) AS regime_baja,
  CAST(radiation >= 200 AND radiation < 600 AS INT) AS regime_media, CAST(radiation >= 600 AS INT) AS regime_alta,
  lag(power_pu, 1) {O} AS power_pu_lag_1, lag(power_pu, 2) {O} AS power_pu_lag_2, lag(power_pu, 4) {O} AS power_pu_lag_4,
  lag(radiation, 1) {O} AS radiation_lag_1, lag(radiation, 2) {O} AS radiation_lag_2, {ROLLING},
  lag(power_pu, 1) {O} - lag(power_pu, 2) {O} AS delta_power_pu_1, lag(radiation, 1) {O} - lag(radiation, 2) {O} AS delta_radiation_1,
  CAST(id_planta = 'click' AS INT) AS plant_click, CAST(id_planta = 'error' AS INT) AS plant_error,
  CAST(id_planta = 'purchase' AS INT) AS plant_purchase, CAST(id_planta = 'signup' AS INT) AS plant_signup,
  CAST(id_planta = 'view' AS INT) AS plant_view FROM pu)"""
FEATURE_DOUBLES = ("radiation power T_ambiente p_nominal_kw power_pu sin_day cos_day sin_hour cos_hour radiation_x_temp radiation_sq "
                   "power_pu_lag_1 power_pu_lag_2 power_pu_lag_4 radiation_lag_1 radiation_lag_2 delta_power_pu_1 delta_radiation_1 " + ROLLING_NAMES)


@check("feature_table", "SELECT * FROM wide WHERE power_pu_lag_4 IS NOT NULL", FEATURE_DOUBLES, FEATURES, 4)
def feature_table(spark, d):
    return build_features(B.per_unit(spark, d), plants=sorted(B.NOMINAL_KW))


CLEANED = READINGS + """,
z AS (SELECT id_planta, "timestamp", greatest(coalesce(radiation - 3, 0), 0) AS radiation, greatest(coalesce(power, 0), 0) AS power FROM readings_raw),
sums AS (SELECT id_planta, CAST("timestamp" AS DATE) AS day, sum(radiation) AS r, sum(power) AS p FROM z GROUP BY 1, 2),
kept AS (SELECT z.* FROM z JOIN sums s ON s.id_planta = z.id_planta AND s.day = CAST(z."timestamp" AS DATE) WHERE s.r <> 0 AND s.p <> 0),
night AS (SELECT id_planta, "timestamp", CASE WHEN hour("timestamp") < 6 OR hour("timestamp") > 22 THEN 0 ELSE radiation END AS radiation, power FROM kept),
dark AS (SELECT id_planta, "timestamp", radiation, CASE WHEN radiation = 0 AND power > 0 THEN 0 ELSE power END AS power FROM night),""" \
    + grid_sql("dark", ("radiation", "power")) + f""",
short AS (SELECT id_planta, "timestamp", {interpolated('radiation', 8)} AS radiation, {interpolated('power', 8)} AS power FROM grid_of_dark),
full_ AS (SELECT id_planta, "timestamp", {copied('radiation')} AS radiation, {copied('power')} AS power FROM short),
bounds AS (SELECT id_planta, quantile_cont(power, 0.25) AS pa, quantile_cont(power, 0.75) AS pb, quantile_cont(radiation, 0.25) AS ra,
  quantile_cont(radiation, 0.75) AS rb FROM full_ GROUP BY 1)"""


@check("clean_readings", """
SELECT f.id_planta, f."timestamp", CASE WHEN radiation > rb + 3 * (rb - ra) THEN rb + 3 * (rb - ra) ELSE radiation END AS radiation,
  CASE WHEN power > pb + 3 * (pb - pa) THEN pb + 3 * (pb - pa) ELSE power END AS power, strftime("timestamp", '%Y-%m') AS Mes,
  CAST(hour("timestamp") AS INT) AS hour FROM full_ f JOIN bounds b ON b.id_planta = f.id_planta""", "radiation power", CLEANED)
def clean_readings(spark, d):
    raw = B.readings_raw(spark, d).drop(C.TEMPERATURE).withColumn(C.RADIATION, F.col(C.RADIATION) - 3)
    return plans.clean_readings(raw)["clean"]
