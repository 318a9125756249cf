"""Metric, segment, season and horizon checks over SQL-expressible predictors."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import scalar as S
from ..operators import evaluate as E
from ..operators.chunks import halo_window, with_scalars
from ..operators.splits import season_windows
from ..plans.diagnostics import error_tables, residual_table
from . import bindings as B
from .ordered import O, residual_rows
from .registry import DAILY, PREDICTIONS, READINGS, RESIDUALS, check
from .scalars import SEASON_VALUES, SEASON_WINDOWS


def m(where=None, suffix="", scale="", y="y_true", p="y_pred", bias=False):
    """MAE, RMSE and R2 in SQL."""
    f = f" FILTER (WHERE {where})" if where else ""
    e = f"({y} - {p}){scale}"
    out = (f"avg(abs({e})){f} AS MAE{suffix}, sqrt(avg({e} * {e}){f}) AS RMSE{suffix}, "
           f"CASE WHEN var_pop({y}{scale}){f} > 0 THEN 1 - sum({e} * {e}){f} / (var_pop({y}{scale}){f} * count({y}){f}) "
           f"WHEN sum({e} * {e}){f} = 0 THEN 1 WHEN sum({e} * {e}){f} > 0 THEN 0 END AS R2{suffix}")
    return out + (f", avg({e}){f} AS Bias{suffix}" if bias else "")


def names(*suffixes, bias=False):
    return " ".join(f"{k}{s}" for s in suffixes for k in ("MAE", "RMSE", "R2", *(("Bias",) if bias else ())))


@check("persistence_metrics", f"""
SELECT id_planta, {m()}, {m('y_true > 0', '_day')} FROM (SELECT id_planta, power_pu AS y_true, lag(power_pu) {O} AS y_pred FROM pu)
WHERE y_pred IS NOT NULL GROUP BY 1""", names("", "_day"))
def persistence_metrics(spark, d):
    from ..plans.predictors import persistence

    rows = persistence(B.per_unit(spark, d).select(C.PLANT, C.TS, C.TARGET))
    return rows.groupBy(C.PLANT).agg(*E.metric_columns(), *E.metric_columns(E.producing(), "_day"))


@check("model_metrics", f"SELECT model, {m()}, count(*) AS n FROM pred WHERE split = 'test' GROUP BY 1", names(""), PREDICTIONS)
def model_metrics(spark, d):
    return E.metrics(B.predictions(spark, d).filter("split = 'test'"))


@check("model_metrics_producing", f"""
SELECT model, {m()}, count(*) AS n FROM pred WHERE split = 'test' AND y_true > 0 GROUP BY 1""", names(""), PREDICTIONS)
def model_metrics_producing(spark, d):
    return E.metrics_producing(B.predictions(spark, d).filter("split = 'test'"))


@check("summary_kw", f"""
SELECT model, {m(None, '', ' * 19.53', bias=True)}, {m('y_true > 0', '_luz', ' * 19.53', bias=True)} FROM pred WHERE split = 'test' GROUP BY 1""",
       names("", "_luz", bias=True), PREDICTIONS)
def summary_kw(spark, d):
    return E.summary_kw(B.predictions(spark, d).filter("split = 'test'"), B.NOMINAL_KW[B.TEST_PLANT])


@check("models_ranked_by_rmse", f"""
SELECT *, CAST(row_number() OVER (ORDER BY RMSE, model) AS INT) AS position FROM (
  SELECT model, {m()}, count(*) AS n FROM pred WHERE split = 'test' GROUP BY 1)""", names(""), PREDICTIONS)
def models_ranked_by_rmse(spark, d):
    return E.ranked_table(E.metrics(B.predictions(spark, d).filter("split = 'test'")), "RMSE")


SCENARIO = """CASE model WHEN 'persistence' THEN 'with_lag' WHEN 'linear' THEN 'without_lag' ELSE 'baseline' END"""


def scenario():
    return S.relabel(F.col("model"), {"persistence": "with_lag", "linear": "without_lag", "same_slot_yesterday": "baseline"})


@check("scenario_scope_frame", f"""
SELECT {SCENARIO} AS scenario, model, {m("split = 'val'", '_val_global')}, {m("split = 'val' AND y_true > 0", '_val_day')},
  {m("split = 'test'", '_test_global')}, {m("split = 'test' AND y_true > 0", '_test_day')} FROM pred WHERE split <> 'train' GROUP BY 1, 2""",
       names("_val_global", "_val_day", "_test_global", "_test_day"), PREDICTIONS)
def scenario_scope_frame(spark, d):
    return E.scope_frame(B.predictions(spark, d).withColumn("scenario", scenario()))


@check("comparison_vs_naive", f"""
WITH t AS (SELECT model, {SCENARIO} AS type, {m(None, '_global')}, {m('y_true > 0', '_day')} FROM pred WHERE split = 'test' GROUP BY 1, 2)
SELECT *, (SELECT RMSE_day FROM t WHERE model = 'same_slot_yesterday') - RMSE_day AS mejora_vs_naive FROM t""",
       names("_global", "_day") + " mejora_vs_naive", PREDICTIONS)
def comparison_vs_naive(spark, d):
    rows = B.predictions(spark, d).filter("split = 'test'").withColumn("type", scenario())
    return E.improvement_over(E.merge_scopes(rows), "same_slot_yesterday")


@check("relative_improvement", f"""
WITH t AS (SELECT split, model, {m()}, count(*) AS n FROM pred WHERE y_true > 0 GROUP BY 1, 2)
SELECT a.model, a.MAE, a.RMSE, a.R2, a.n, b.RMSE AS RMSE_base, b.RMSE - a.RMSE AS RMSE_mejora, (b.RMSE - a.RMSE) / b.RMSE * 100 AS RMSE_mejora_pct
FROM t a LEFT JOIN t b ON b.model = a.model AND b.split = 'val' WHERE a.split = 'test'""",
       "MAE RMSE R2 RMSE_base RMSE_mejora RMSE_mejora_pct", PREDICTIONS)
def relative_improvement(spark, d):
    p = B.predictions(spark, d)
    return E.relative_improvement(*[E.metrics_producing(p.filter(F.col("split") == s)) for s in ("test", "val")])


SEG = "avg(abs(e_kw)) AS MAE, avg(e_kw) AS bias, stddev_samp(e_kw) AS std, sqrt(avg(e_kw * e_kw)) AS RMSE, count(e_kw) AS n"
SEG_NAMES = "MAE bias std RMSE"


@check("segment_by_hour", f"""
SELECT id_planta, CAST(hour("timestamp") AS INT) AS hour, {SEG} FROM res WHERE is_daylight GROUP BY 1, 2""", SEG_NAMES, RESIDUALS)
def segment_by_hour(spark, d):
    return E.segment(residual_rows(spark, d).filter("is_daylight"), {C.PLANT: F.col(C.PLANT), "hour": F.hour(C.TS)})


RAD_BIN = """CASE WHEN radiation <= 0 THEN NULL WHEN radiation <= 100 THEN '<100' WHEN radiation <= 300 THEN '100-300'
  WHEN radiation <= 600 THEN '300-600' WHEN radiation <= 1000 THEN '600-1000' WHEN radiation <= 2000 THEN '>1000' END"""


@check("segment_by_irradiance", f"""
SELECT rad_bin, CAST(CASE rad_bin WHEN '<100' THEN 1 WHEN '100-300' THEN 2 WHEN '300-600' THEN 3 WHEN '600-1000' THEN 4 ELSE 5 END AS INT) AS position, {SEG}
FROM (SELECT *, {RAD_BIN} AS rad_bin FROM res WHERE is_daylight) WHERE rad_bin IS NOT NULL GROUP BY 1, 2""", SEG_NAMES, RESIDUALS)
def segment_by_irradiance(spark, d):
    label = S.irradiance_band(F.col(C.RADIATION))
    return E.segment(residual_rows(spark, d).filter("is_daylight"), {"rad_bin": label, "position": S.ordinal(label, C.IRRADIANCE_LABELS)})


@check("segment_by_month", f"""
SELECT id_planta, strftime("timestamp", '%Y-%m') AS Mes, {SEG} FROM res WHERE is_daylight GROUP BY 1, 2""", SEG_NAMES, RESIDUALS)
def segment_by_month(spark, d):
    return E.segment(residual_rows(spark, d).filter("is_daylight"), {C.PLANT: F.col(C.PLANT), "Mes": S.month_key(F.col(C.TS))})


PAIRED = PREDICTIONS + """,
pair AS (SELECT a.id_planta, a."timestamp", a.radiation, a.y_true, a.y_pred AS y_pred_lag, b.y_pred AS y_pred_nolag,
  abs(a.y_true - a.y_pred) AS error_lag, abs(a.y_true - b.y_pred) AS error_nolag, abs(a.y_true - a.y_pred) / (a.y_true + 1e-6) AS error_rel_lag,
  abs(a.y_true - b.y_pred) / (a.y_true + 1e-6) AS error_rel_nolag
  FROM pred a JOIN pred b ON b.id_planta = a.id_planta AND b."timestamp" = a."timestamp" WHERE a.model = 'persistence' AND b.model = 'linear' AND a.y_true > 0)"""
PAIR = "avg(error_lag) AS MAE_lag, avg(error_nolag) AS MAE_nolag"


def paired(spark, d):
    p = B.predictions(spark, d)
    pair = E.pair_scenarios(p.filter("model = 'persistence'"), p.filter("model = 'linear'"))
    errors = S.paired_errors(F.col("y_true"), F.col("y_pred_lag"), F.col("y_pred_nolag"))
    return pair.withColumns(errors).filter(E.producing()).select(
        C.PLANT, C.TS, C.RADIATION, "y_true", "y_pred_lag", "y_pred_nolag", *errors
    )


@check("paired_scenario_errors", "SELECT * FROM pair",
       "radiation y_true y_pred_lag y_pred_nolag error_lag error_nolag error_rel_lag error_rel_nolag", PAIRED, 4)
def paired_scenario_errors(spark, d):
    return paired(spark, d)


@check("paired_by_hour", f"""
SELECT CAST(hour("timestamp") AS INT) AS hour, {PAIR}, avg(error_rel_lag) AS MAE_rel_lag, avg(error_rel_nolag) AS MAE_rel_nolag, count(*) AS n
FROM pair GROUP BY 1""", "MAE_lag MAE_nolag MAE_rel_lag MAE_rel_nolag", PAIRED, 4)
def paired_by_hour(spark, d):
    return E.paired_segment(paired(spark, d), F.hour(C.TS), "hour", relative=True)


@check("paired_by_irradiance", f"""
SELECT {RAD_BIN} AS rad_bin, {PAIR}, count(*) AS n FROM pair WHERE {RAD_BIN} IS NOT NULL GROUP BY 1""", "MAE_lag MAE_nolag", PAIRED)
def paired_by_irradiance(spark, d):
    return E.paired_segment(paired(spark, d), S.irradiance_band(F.col(C.RADIATION)), "rad_bin")


@check("paired_by_production", f"""
SELECT CASE WHEN y_true <= 0.1 THEN '0-10%' WHEN y_true <= 0.2 THEN '10-20%' WHEN y_true <= 0.4 THEN '20-40%' WHEN y_true <= 0.6 THEN '40-60%'
  WHEN y_true <= 0.8 THEN '60-80%' ELSE '80-100%' END AS prod_bin, {PAIR}, count(*) AS n FROM pair WHERE y_true <= 1 GROUP BY 1""", "MAE_lag MAE_nolag", PAIRED)
def paired_by_production(spark, d):
    return E.paired_segment(paired(spark, d), S.production_band(F.col("y_true")), "prod_bin")


@check("ramp_segments_long", f"""
WITH r AS (SELECT *, y_true - lag(y_true) {O} AS delta FROM pair),
g AS (SELECT CASE WHEN delta > 0.05 THEN 'Subida' WHEN delta < -0.05 THEN 'Bajada' ELSE 'Estable' END AS ramp_type, {PAIR}, count(*) AS n FROM r GROUP BY 1)
SELECT ramp_type, n, 'Con lag' AS escenario, MAE_lag AS MAE FROM g UNION ALL SELECT ramp_type, n, 'Sin lag', MAE_nolag FROM g""", "MAE", PAIRED)
def ramp_segments_long(spark, d):
    wide = E.ramp_segment(paired(spark, d))
    return E.melt_errors(wide, "ramp_type", labels={"MAE_lag": "Con lag", "MAE_nolag": "Sin lag"})


@check("hour_series_side_by_side", """
WITH a AS (SELECT CAST(hour("timestamp") AS INT) AS hour, avg(abs(y_true - y_pred)) AS v FROM pred WHERE model = 'persistence' GROUP BY 1),
b AS (SELECT CAST(hour("timestamp") AS INT) AS hour, avg(abs(y_true - y_pred)) AS v FROM pred WHERE model = 'linear' GROUP BY 1)
SELECT coalesce(a.hour, b.hour) AS hour, a.v AS with_lag, b.v AS without_lag FROM a FULL JOIN b ON b.hour = a.hour""", "with_lag without_lag", PREDICTIONS)
def hour_series(spark, d):
    p = B.predictions(spark, d).groupBy("model", F.hour(C.TS).alias("hour")).agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"))
    return E.side_by_side(p.filter("model = 'persistence'"), p.filter("model = 'linear'"), "hour", "mae", ("with_lag", "without_lag"))


@check("common_scenario_rows", """
SELECT id_planta, "timestamp" FROM pred WHERE model = 'persistence' INTERSECT SELECT id_planta, "timestamp" FROM pred WHERE model = 'same_slot_yesterday'""",
       "", PREDICTIONS)
def common_rows(spark, d):
    p = B.predictions(spark, d)
    return E.common_keys(p.filter("model = 'persistence'"), p.filter("model = 'same_slot_yesterday'"))


# ---- seasons (seven years of daily series) ---------------------------------------------------

DAILY_PRED = DAILY + """,
slope AS (SELECT regr_slope(power, radiation) AS a, regr_intercept(power, radiation) AS b FROM daily),
dp AS (SELECT * FROM (SELECT id_planta, "timestamp", power / 1e6 AS y_true, lag(power) OVER (PARTITION BY id_planta ORDER BY "timestamp") / 1e6 AS y_pred, 'last' AS model FROM daily)
  WHERE y_pred IS NOT NULL UNION ALL SELECT id_planta, "timestamp", power / 1e6, (b + a * radiation) / 1e6, 'line' FROM daily, slope)"""


def daily_predictions(spark, d):
    x = B.daily(spark, d)
    last = halo_window(x, {"_p": lambda w: F.lag(C.POWER).over(w)}, 1).filter(F.col("_p").isNotNull()).select(
        C.PLANT, C.TS, (F.col(C.POWER) / 1e6).alias("y_true"), (F.col("_p") / 1e6).alias("y_pred"), F.lit("last").alias("model")
    )
    fit = x.agg(F.regr_slope(C.POWER, C.RADIATION).alias("_a"), F.regr_intercept(C.POWER, C.RADIATION).alias("_b"))
    line = with_scalars(x, fit).select(
        C.PLANT, C.TS, (F.col(C.POWER) / 1e6).alias("y_true"),
        ((F.col("_b") + F.col("_a") * F.col(C.RADIATION)) / 1e6).alias("y_pred"), F.lit("line").alias("model")
    )
    return last.unionByName(line)


SEASONAL = DAILY_PRED + f""",
win AS (SELECT x.*, w.estacion, 'Con lags' AS tipo FROM dp x JOIN (VALUES {SEASON_VALUES}) w(estacion, a, b) ON x."timestamp" BETWEEN w.a AND w.b),
seas AS (SELECT model, tipo, estacion, {m()}, count(*) AS n FROM win WHERE y_true > 0 GROUP BY 1, 2, 3 HAVING count(*) >= 20)"""


def seasonal(spark, d):
    rows = season_windows(daily_predictions(spark, d), SEASON_WINDOWS).withColumn("tipo", F.lit("Con lags"))
    return E.seasonal_metrics(rows)


@check("seasonal_metrics", "SELECT * FROM seas", names(""), SEASONAL)
def seasonal_metrics(spark, d):
    return seasonal(spark, d)


@check("seasonal_variability", """
SELECT model, tipo, avg(RMSE) AS mean, stddev_samp(RMSE) AS std, min(RMSE) AS min, max(RMSE) AS max, max(RMSE) - min(RMSE) AS rango FROM seas GROUP BY 1, 2""",
       "mean std min max rango", SEASONAL)
def seasonal_variability(spark, d):
    return E.variability(seasonal(spark, d))


@check("best_model_per_season", """
SELECT estacion, arg_min(model, RMSE) AS best_model, min(RMSE) AS "best_RMSE" FROM seas GROUP BY 1""", "best_RMSE", SEASONAL)
def best_model_per_season(spark, d):
    return E.best_model(seasonal(spark, d), ("estacion",))


@check("daily_error_by_model", """
SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS date, model, avg(greatest(y_true - y_pred, 0)) AS mae_dia FROM pred GROUP BY 1, 2""", "mae_dia", PREDICTIONS)
def daily_error_by_model(spark, d):
    return E.daily_error(B.predictions(spark, d))


@check("daily_absolute_error_by_model", """
SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS date, model, avg(abs(y_true - y_pred)) AS mae_dia FROM dp GROUP BY 1, 2""", "mae_dia", DAILY_PRED)
def daily_absolute_error(spark, d):
    return E.daily_error(daily_predictions(spark, d), positive_part=False)


PER_DAY = """SELECT id_planta, CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS date, avg(e_abs_kw) AS MAE_kw, avg(e_kw) AS bias_kw, count(e_kw) AS n
FROM res WHERE is_daylight GROUP BY 1, 2"""


@check("daily_residual", PER_DAY, "MAE_kw bias_kw", RESIDUALS)
def daily_residual(spark, d):
    return E.daily_residual(residual_rows(spark, d), (C.PLANT,))


@check("daily_residual_digest", f"""
SELECT id_planta, avg(MAE_kw) AS mean_mae, max(MAE_kw) AS max_mae, arg_max(date, MAE_kw) AS worst_day, count(*) FILTER (WHERE bias_kw > 0) AS positive_days,
  count(*) AS days FROM ({PER_DAY}) GROUP BY 1""", "mean_mae max_mae", RESIDUALS)
def daily_residual_digest(spark, d):
    return E.daily_digest(E.daily_residual(residual_rows(spark, d), (C.PLANT,)), (C.PLANT,))


SEASON_STATS = f"""SELECT s.season, CAST(s.season_order AS INT) AS season_order, x.MAE, x.bias, x.std, x.RMSE, coalesce(x.n, 0) AS n
FROM (VALUES ('Invierno', 1), ('Primavera', 2), ('Verano', 3), ('Otono', 4)) s(season, season_order) LEFT JOIN (
  SELECT CASE quarter("timestamp" + INTERVAL 1 MONTH) WHEN 1 THEN 'Invierno' WHEN 2 THEN 'Primavera' WHEN 3 THEN 'Verano' ELSE 'Otono' END AS season,
  {SEG} FROM (SELECT "timestamp", y_true - y_pred AS e_kw FROM dp WHERE y_true > 0.01) GROUP BY 1) x ON x.season = s.season"""


def daily_residuals(spark, d):
    return residual_table(daily_predictions(spark, d), 1.0)


@check("season_residuals", SEASON_STATS, SEG_NAMES, DAILY_PRED)
def season_residuals(spark, d):
    return E.season_residuals(daily_residuals(spark, d))


@check("season_residuals_winter_only", f"""
SELECT s.season, CAST(s.season_order AS INT) AS season_order, x.MAE, x.bias, x.std, x.RMSE, coalesce(x.n, 0) AS n
FROM (VALUES ('Invierno', 1), ('Primavera', 2), ('Verano', 3), ('Otono', 4)) s(season, season_order) LEFT JOIN (
  SELECT 'Invierno' AS season, {SEG} FROM res WHERE is_daylight) x ON x.season = s.season""", SEG_NAMES, RESIDUALS)
def season_residuals_winter(spark, d):
    return E.season_residuals(residual_rows(spark, d))


@check("extreme_seasons", f"SELECT arg_max(season, MAE) AS worst, arg_min(season, MAE) AS best FROM ({SEASON_STATS})", "", DAILY_PRED)
def extreme_seasons(spark, d):
    return E.extreme_seasons(E.season_residuals(daily_residuals(spark, d)))


@check("box_statistics", """
WITH q AS (SELECT model, quantile_cont(y_true - y_pred, 0.25) AS q1, quantile_cont(y_true - y_pred, 0.5) AS median, quantile_cont(y_true - y_pred, 0.75) AS q3 FROM dp GROUP BY 1)
SELECT d.model, max(q1) AS q1, max(median) AS median, max(q3) AS q3, min(y_true - y_pred) FILTER (WHERE inside) AS whisker_low,
  max(y_true - y_pred) FILTER (WHERE inside) AS whisker_high, count(*) FILTER (WHERE NOT inside) AS n_outliers, count(*) AS n
FROM (SELECT x.*, q.q1, q.median, q.q3, y_true - y_pred BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM dp x JOIN q ON q.model = x.model) d GROUP BY 1""",
       "q1 median q3 whisker_low whisker_high", DAILY_PRED)
def box_statistics(spark, d):
    return E.box_statistics(daily_predictions(spark, d).withColumn("e", F.col("y_true") - F.col("y_pred")), "e", ("model",))


@check("exceedance_shares", """
SELECT id_planta, avg(CAST(e_abs_kw > 1 AS INT)) AS share_over_1kw, avg(CAST(e_abs_kw > 2 AS INT)) AS share_over_2kw, avg(e_rel) AS mean_e_rel
FROM res WHERE is_daylight GROUP BY 1""", "share_over_1kw share_over_2kw mean_e_rel", RESIDUALS, 4)
def exceedance_shares(spark, d):
    return E.exceedance(residual_rows(spark, d), (C.PLANT,))


@check("error_tables_describe", """
SELECT model, count(*) AS n, avg(e) AS mean, stddev_pop(e) AS std, min(e) AS min, max(e) AS max, quantile_cont(e, 0.25) AS q1,
  quantile_cont(e, 0.5) AS median, quantile_cont(e, 0.75) AS q3 FROM (SELECT model, (y_true - y_pred) * 19.53 AS e FROM pred) GROUP BY 1""",
       "mean std min max q1 median q3", PREDICTIONS)
def error_tables_describe(spark, d):
    return error_tables(B.predictions(spark, d), 19.53)["describe"]


@check("error_tables_monthly", f"""
SELECT model, strftime("timestamp", '%Y-%m') AS Mes, {SEG} FROM (SELECT model, "timestamp", (y_true - y_pred) * 19.53 AS e_kw FROM pred WHERE y_true > 0) GROUP BY 1, 2""",
       SEG_NAMES, PREDICTIONS)
def error_tables_monthly(spark, d):
    return error_tables(B.predictions(spark, d), 19.53)["monthly"]


# ---- horizons --------------------------------------------------------------------------------

HORIZONS = (1, 4, 16)
HORIZON = READINGS + f""",
hz AS ({" UNION ALL ".join(f'''SELECT {h} AS horizon_steps, id_planta, "timestamp", lead(power_pu, {h}) {O} AS y_true, power_pu AS now,
  avg(power_pu) OVER (PARTITION BY id_planta ORDER BY "timestamp" ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS recent FROM pu''' for h in HORIZONS)}),
hp AS (SELECT horizon_steps, 'last' AS model, y_true, now AS y_pred FROM hz WHERE y_true IS NOT NULL UNION ALL
  SELECT horizon_steps, 'recent_mean', y_true, recent FROM hz WHERE y_true IS NOT NULL),
ht AS (SELECT model, CAST(horizon_steps AS INT) AS horizon_steps, {m(None, '_global')}, {m('y_true > 0', '_luz')} FROM hp GROUP BY 1, 2),
dg AS (SELECT t.*, b.RMSE_luz AS RMSE_h1, b.MAE_luz AS MAE_h1, (t.RMSE_luz - b.RMSE_luz) / b.RMSE_luz * 100 AS RMSE_degradacion_pct,
  (t.MAE_luz - b.MAE_luz) / b.MAE_luz * 100 AS MAE_degradacion_pct FROM ht t LEFT JOIN ht b ON b.model = t.model AND b.horizon_steps = 1)"""
HORIZON_NAMES = names("_global", "_luz")


def horizon_table(spark, d):
    pu = B.per_unit(spark, d).select(C.PLANT, C.TS, C.TARGET)
    columns = {f"y_{h}": (lambda w, h=h: F.lead(C.TARGET, h).over(w)) for h in HORIZONS}
    columns["recent"] = lambda w: F.avg(C.TARGET).over(w.rowsBetween(-3, 0))
    wide = halo_window(pu, columns, 3, max(HORIZONS))
    picks = F.array(*[
        F.struct(F.lit(h).alias("horizon_steps"), F.lit(n).alias("model"), F.col(f"y_{h}").alias("y_true"), F.col(c).alias("y_pred"))
        for h in HORIZONS for n, c in (("last", C.TARGET), ("recent_mean", "recent"))
    ])
    long = wide.select(F.inline(picks)).filter(F.col("y_true").isNotNull())
    return long.groupBy("model", "horizon_steps").agg(*E.metric_columns(None, "_global"), *E.metric_columns(E.producing(), "_luz"))


@check("horizon_degradation", "SELECT * FROM dg",
       HORIZON_NAMES + " RMSE_h1 MAE_h1 RMSE_degradacion_pct MAE_degradacion_pct", HORIZON)
def horizon_degradation(spark, d):
    return E.degradation(horizon_table(spark, d))


@check("horizon_pivot", """
SELECT model, max(RMSE_degradacion_pct) FILTER (WHERE horizon_steps = 1) AS h1, max(RMSE_degradacion_pct) FILTER (WHERE horizon_steps = 4) AS h4,
  max(RMSE_degradacion_pct) FILTER (WHERE horizon_steps = 16) AS h16 FROM dg GROUP BY 1""", "h1 h4 h16", HORIZON)
def horizon_pivot(spark, d):
    return E.pivot_horizons(E.degradation(horizon_table(spark, d)), HORIZONS)


@check("robustness_ranking", """
SELECT model, avg(RMSE_degradacion_pct) AS degradacion_media_pct FROM dg WHERE horizon_steps > 1 GROUP BY 1""", "degradacion_media_pct", HORIZON)
def robustness_ranking(spark, d):
    return E.robustness(E.degradation(horizon_table(spark, d)))


@check("horizon_rmse_steps", """
SELECT *, RMSE_luz - lag(RMSE_luz) OVER (PARTITION BY model ORDER BY horizon_steps) AS delta_RMSE FROM ht""", HORIZON_NAMES + " delta_RMSE", HORIZON)
def horizon_rmse_steps(spark, d):
    return E.horizon_steps_delta(horizon_table(spark, d))


@check("best_model_overall", f"""
SELECT arg_min(model, RMSE) AS best_model, min(RMSE) AS "best_RMSE" FROM (SELECT model, {m()} FROM pred WHERE split = 'test' GROUP BY 1)""", "best_RMSE", PREDICTIONS)
def best_model_overall(spark, d):
    return E.best_model(E.metrics(B.predictions(spark, d).filter("split = 'test'")))
