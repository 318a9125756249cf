"""Pairs of a Spark query and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Both sides round after the same small shift: averages of few four-decimal values end exactly in
# a 5, and such ties would otherwise fall either way with the order of summation.
SHIFT = 3.3e-8

READINGS = """WITH slots AS (
  SELECT event_type AS id_planta, time_bucket(INTERVAL '15 minutes', ts) AS "timestamp", avg(value) AS v,
         avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS k,
         max(CAST(json_extract_string(props, '$.k') AS INT)) AS kmax, avg(user_id) AS u
  FROM events GROUP BY 1, 2),
shaped AS (SELECT *, greatest(CAST(0.0 AS DOUBLE),
  sin(pi() * (hour("timestamp") + minute("timestamp") / 60.0 - 6) / 12)) AS d FROM slots),
readings AS (SELECT id_planta, "timestamp",
  round(CASE WHEN kmax = 99 THEN CAST(999.0 AS DOUBLE) ELSE 12 * k * d END, 4) AS radiation,
  round(100 * v * d, 4) AS power, round(u / 5, 4) AS T_ambiente FROM shaped),
readings_raw AS (SELECT r.id_planta, r."timestamp", r.radiation + 3 AS radiation,
  CASE WHEN s.kmax <> 98 THEN r.power - 2 END AS power, r.T_ambiente
  FROM readings r JOIN slots s ON s.id_planta = r.id_planta AND s."timestamp" = r."timestamp"),
plants(id_planta, p_nominal_kw) AS (VALUES ('click', CAST(12.4 AS DOUBLE)), ('error', 12.0), ('purchase', 19.53),
  ('signup', 15.0), ('view', 10.0)),
pu AS (SELECT r.*, p.p_nominal_kw, r.power / 1000 / p.p_nominal_kw AS power_pu
  FROM readings r LEFT JOIN plants p ON p.id_planta = r.id_planta)"""

SPLITS = READINGS + """,
base AS (SELECT * FROM (SELECT *, CASE
  WHEN id_planta IN ('click', 'view') AND "timestamp" <= TIMESTAMP '2024-01-15' THEN 'train'
  WHEN id_planta IN ('click', 'view') AND "timestamp" BETWEEN TIMESTAMP '2024-01-16' AND TIMESTAMP '2024-01-21' THEN 'val'
  WHEN id_planta = 'purchase' AND "timestamp" BETWEEN TIMESTAMP '2024-01-22' AND TIMESTAMP '2024-01-31' THEN 'test'
  END AS split FROM pu) WHERE split IS NOT NULL)"""

PREDICTIONS = SPLITS + """,
line AS (SELECT regr_slope(power_pu, radiation) AS a, regr_intercept(power_pu, radiation) AS b FROM base WHERE split = 'train'),
pred AS (
  SELECT * FROM (SELECT id_planta, "timestamp", split, power_pu AS y_true,
    lag(power_pu) OVER (PARTITION BY id_planta ORDER BY "timestamp") AS y_pred, radiation, T_ambiente,
    'persistence' AS model FROM base) WHERE y_pred IS NOT NULL
  UNION ALL
  SELECT x.id_planta, x."timestamp", x.split, x.power_pu, y.power_pu, x.radiation, x.T_ambiente, 'same_slot_yesterday'
  FROM base x JOIN base y ON y.id_planta = x.id_planta AND y."timestamp" = x."timestamp" - INTERVAL 1 DAY
  UNION ALL
  SELECT id_planta, "timestamp", split, power_pu, b + a * radiation, radiation, T_ambiente, 'linear' FROM base, line)"""

# The line fitted on train rows, applied to every reading; residuals in kW of each plant.
RESIDUALS = SPLITS + """,
line AS (SELECT regr_slope(power_pu, radiation) AS a, regr_intercept(power_pu, radiation) AS b FROM base WHERE split = 'train'),
res AS (SELECT id_planta, "timestamp", radiation, T_ambiente, power_pu AS y_true, b + a * radiation AS y_pred,
  power_pu - (b + a * radiation) AS e_pu, (power_pu - (b + a * radiation)) * p_nominal_kw AS e_kw,
  abs((power_pu - (b + a * radiation)) * p_nominal_kw) AS e_abs_kw, power_pu > 0.01 AS is_daylight,
  CASE WHEN power_pu > 0.01 THEN (power_pu - (b + a * radiation)) / (power_pu + 1e-6) END AS e_rel
  FROM pu, line)"""

DAILY = """WITH daily AS (SELECT l_returnflag AS id_planta, l_shipdate AS "timestamp", round(sum(l_quantity), 4) AS radiation,
  round(sum(l_extendedprice), 4) AS power, round(avg(l_discount) * 100, 4) AS T_ambiente FROM lineitem GROUP BY 1, 2)"""

STATIONS = READINGS + """,
stations AS (SELECT 'ST' || (user_id % 6) AS station, strftime(ts, '%Y-%m-%d') AS "Date", strftime(ts, '%-I:%M %p') AS "Time",
  (CAST(json_extract_string(props, '$.k') AS INT) * 12) || ' w/m²' AS "Solar",
  (user_id % 70 + 30) || '.5 °F' AS "Temperature", event_id AS seq, ts FROM events),
station_radiation AS (SELECT station, "timestamp", arg_min(v, seq) AS station_radiation FROM (
  SELECT station, strptime("Date" || ' ' || "Time", '%Y-%m-%d %I:%M %p') AS "timestamp",
    CAST(replace("Solar", ' w/m²', '') AS DOUBLE) AS v, seq FROM stations) GROUP BY 1, 2)"""

WEATHER = READINGS + """,
weather AS (SELECT 'all' AS site, time_bucket(INTERVAL '1 hour', ts) AS "timestamp", round(avg(user_id) / 5, 4) AS T_ambiente
  FROM events GROUP BY 2)"""


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, timestamps without zone, dates as text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = F.round(c + SHIFT, digits)
        elif kind == "timestamp":
            c = c.cast("timestamp_ntz")
        elif kind == "date":
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def check(name: str, sql: str | None = None, doubles: str = "", base: str = READINGS, digits: int = 6):
    """Register a query and, if one can be written, its oracle over the given base tables."""
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, d: tidy(fn(spark, d), digits)
        if sql is not None:
            replaced = ", ".join(f'round("{c}" + {SHIFT!r}, {digits}) + 0.0 AS "{c}"' for c in doubles.split())
            star = f"* REPLACE ({replaced})" if replaced else "*"
            ORACLES[name] = f"{base}\nSELECT {star} FROM (\n{sql.strip()}\n) AS answer"
        return fn
    return register
