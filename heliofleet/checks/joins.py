"""As-of, station, weather and other join checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import contracts as C
from ..functions.solar import sunlit
from ..operators import asof, quality
from ..plans import cleaning as plans
from . import bindings as B
from .cleaning import DAY
from .ordered import grid_sql, interpolated
from .registry import READINGS, STATIONS, WEATHER, check

LATITUDE, LONGITUDE, ZONE = 40.0, -3.0, "Europe/Madrid"
POOL = [f"ST{i}" for i in range(6)]


def sunlit_sql(ts: str) -> str:
    """The same solar formula; local time is UTC+1 over the whole range of the data."""
    g = f"((dayofyear({ts}) - 0.5) * 2 * pi() / 365)"
    eq = (f"((0.000075 + 0.001868 * cos({g}) - 0.032077 * sin({g}) - 0.014615 * cos(2 * {g}) - 0.040849 * sin(2 * {g})) * 229.18)")
    dec = (f"(0.006918 - 0.399912 * cos({g}) + 0.070257 * sin({g}) - 0.006758 * cos(2 * {g}) + 0.000907 * sin(2 * {g})"
           f" - 0.002697 * cos(3 * {g}) + 0.00148 * sin(3 * {g}))")
    half = (f"(degrees(acos(cos(radians(90.833)) / (cos(radians({LATITUDE})) * cos({dec})) - tan(radians({LATITUDE})) * tan({dec}))) * 4)")
    noon = f"({720 - 4 * LONGITUDE} - {eq})"
    at = f"((epoch_us({ts}) - 3600000000 - epoch_us(date_trunc('day', {ts}))) / 60000000.0)"
    return f"(abs({at} - {noon}) <= {half})"


def nearest_sql(left: str, right: str, value: str, limit: str = "INTERVAL 15 MINUTE") -> str:
    """Nearest row within the tolerance, earlier one on a tie, from two one-sided as-of joins."""
    return f"""
SELECT b.*, CASE WHEN back_ts IS NOT NULL AND (ahead_ts IS NULL OR b."timestamp" - back_ts <= ahead_ts - b."timestamp") THEN back_v
  WHEN ahead_ts IS NOT NULL THEN ahead_v END AS {value} FROM (
  SELECT l.*, CASE WHEN p."timestamp" >= l."timestamp" - {limit} THEN p."timestamp" END AS back_ts, p.{value} AS back_v,
    CASE WHEN n."timestamp" <= l."timestamp" + {limit} THEN n."timestamp" END AS ahead_ts, n.{value} AS ahead_v
  FROM {left} l ASOF LEFT JOIN {right} p ON p.station = l.station AND l."timestamp" >= p."timestamp"
  ASOF LEFT JOIN {right} n ON n.station = l.station AND l."timestamp" <= n."timestamp") b"""


ASOF = STATIONS + f""",
lft AS (SELECT id_planta, "timestamp", 'ST' || (day("timestamp") % 6) AS station FROM readings),
near AS ({nearest_sql('lft', 'station_radiation', 'station_radiation')})"""


@check("asof_nearest_join", 'SELECT id_planta, "timestamp", station, station_radiation FROM near', "station_radiation", ASOF)
def asof_nearest_join(spark, d):
    left = B.readings(spark, d).select(
        C.PLANT, C.TS, F.concat(F.lit("ST"), (F.dayofmonth(C.TS) % 6).cast("string")).alias("station")
    )
    right = asof.parse_station_radiation(B.stations(spark, d), ["seq"])
    return asof.asof_nearest(left, right, ["station_radiation"], ("station",))


HOLES = STATIONS + """,
holed AS (SELECT id_planta, "timestamp", CASE WHEN day("timestamp") % 3 = 0 THEN NULL WHEN minute("timestamp") = 15 THEN 0 ELSE radiation END AS radiation,
  power, T_ambiente FROM readings)"""


def holed(spark, d):
    return B.readings(spark, d).withColumn(
        C.RADIATION, F.when(F.dayofmonth(C.TS) % 3 == 0, F.lit(None)).when(F.minute(C.TS) == 15, 0.0).otherwise(F.col(C.RADIATION))
    )


def lit():
    return sunlit(F.col(C.TS), LATITUDE, LONGITUDE, ZONE)


@check("missing_radiation_days", f"""
SELECT DISTINCT id_planta, {DAY} AS day FROM holed WHERE radiation IS NULL OR (radiation = 0 AND {sunlit_sql('"timestamp"')})""", "", HOLES)
def missing_radiation_days(spark, d):
    return quality.missing_radiation_days(holed(spark, d), lit())


def fill_sql(table: str, order: str) -> str:
    """CTEs that fill ``table`` from the stations of ``order`` (id_planta, station, rank)."""
    return f""",
needy AS (SELECT *, {sunlit_sql('"timestamp"')} AS sunlit FROM {table} WHERE radiation IS NULL OR (radiation = 0 AND {sunlit_sql('"timestamp"')})),
offers AS (SELECT n.id_planta, n."timestamp", n.sunlit, o.station, o.rank FROM needy n JOIN {order} o ON o.id_planta = n.id_planta),
offered AS ({nearest_sql('offers', 'station_radiation', 'station_radiation')}),
picked AS (SELECT id_planta, "timestamp", CASE WHEN bool_or(sunlit) THEN
    coalesce(arg_min(station_radiation, rank) FILTER (WHERE station_radiation <> 0), arg_min(station_radiation, rank) FILTER (WHERE station_radiation IS NOT NULL))
    ELSE arg_min(station_radiation, rank) FILTER (WHERE station_radiation IS NOT NULL) END AS v,
  CASE WHEN bool_or(sunlit) THEN
    coalesce(arg_min(station, rank) FILTER (WHERE station_radiation <> 0), arg_min(station, rank) FILTER (WHERE station_radiation IS NOT NULL))
    ELSE arg_min(station, rank) FILTER (WHERE station_radiation IS NOT NULL) END AS s FROM offered GROUP BY 1, 2)"""


FILLED = """
SELECT t.id_planta, t."timestamp", coalesce(p.v, t.radiation) AS radiation, t.power, t.T_ambiente, p.s AS filled_from
FROM {table} t LEFT JOIN picked p ON p.id_planta = t.id_planta AND p."timestamp" = t."timestamp" """

FIXED_ORDER = HOLES + """,
fixed AS (SELECT p.id_planta, v.station, v.rank FROM (SELECT DISTINCT id_planta FROM readings) p,
  (VALUES ('ST2', 1), ('ST0', 2), ('ST5', 3)) v(station, rank))""" + fill_sql("holed", "fixed")


@check("station_fill", FILLED.format(table="holed"), "radiation power T_ambiente", FIXED_ORDER)
def station_fill(spark, d):
    rows = asof.parse_station_radiation(B.stations(spark, d), ["seq"])
    return asof.fill_from_stations(holed(spark, d), rows, ["ST2", "ST0", "ST5"], lit())


def ranking_sql(table: str) -> str:
    return f""",
sample_rows AS (SELECT * FROM station_radiation WHERE day("timestamp") = 1),
plant_rows AS (SELECT r.id_planta, r."timestamp", r.radiation, s.station FROM {table} r, (SELECT DISTINCT station FROM stations) s WHERE r.radiation IS NOT NULL),
matched AS ({nearest_sql('plant_rows', 'sample_rows', 'station_radiation')}),
ranking AS (SELECT id_planta, station, count(*) AS overlap, corr(radiation, station_radiation) AS corr,
  CAST(row_number() OVER (PARTITION BY id_planta ORDER BY corr(radiation, station_radiation) DESC, station) AS INT) AS rank
  FROM matched WHERE station_radiation IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5 AND NOT isnan(corr(radiation, station_radiation)))"""


@check("station_ranking", "SELECT * FROM ranking", "corr", STATIONS + ranking_sql("readings"))
def station_ranking(spark, d):
    rows = asof.parse_station_radiation(B.stations(spark, d), ["seq"])
    return asof.rank_stations(B.readings(spark, d), rows, 2024, POOL, 5)


STUCK = STATIONS + """,
stuck_in AS (SELECT id_planta, "timestamp", CASE WHEN id_planta = 'view' AND day("timestamp") % 6 = 0 THEN 5 WHEN minute("timestamp") = 15 THEN 0
  ELSE radiation END AS radiation, power, T_ambiente FROM readings),
stuck_days AS (SELECT id_planta, CAST("timestamp" AS DATE) AS day FROM stuck_in GROUP BY 1, 2 HAVING count(DISTINCT radiation) = 1 AND avg(radiation) > 0),
reset AS (SELECT f.id_planta, f."timestamp", CASE WHEN s.day IS NULL THEN f.radiation END AS radiation, f.power, f.T_ambiente
  FROM stuck_in f LEFT JOIN stuck_days s ON s.id_planta = f.id_planta AND s.day = CAST(f."timestamp" AS DATE))""" + ranking_sql("reset") + """,
final_order AS (SELECT id_planta, station, rank FROM ranking UNION ALL SELECT p.id_planta, v.station, CAST(substr(v.station, 3) AS INT) + 1
  FROM (SELECT DISTINCT id_planta FROM readings) p, (SELECT DISTINCT station FROM stations) v
  WHERE p.id_planta NOT IN (SELECT id_planta FROM ranking))""" + fill_sql("reset", "final_order")


@check("radiation_fill_plan", FILLED.format(table="reset"), "radiation power T_ambiente", STUCK)
def radiation_fill_plan(spark, d):
    rows = asof.parse_station_radiation(B.stations(spark, d), ["seq"])
    stuck = B.readings(spark, d).withColumn(
        C.RADIATION, F.when((F.col(C.PLANT) == "view") & (F.dayofmonth(C.TS) % 6 == 0), 5.0).when(F.minute(C.TS) == 15, 0.0)
        .otherwise(F.col(C.RADIATION))
    )
    return plans.fill_radiation(stuck, rows, POOL, 2024, 5, LATITUDE, LONGITUDE, ZONE)["filled"]


@check("remaining_gap_report", """
SELECT id_planta, count(*) AS n_null FROM holed WHERE radiation IS NULL GROUP BY 1""", "", HOLES)
def remaining_gap_report(spark, d):
    return asof.remaining_gaps(holed(spark, d))[0]


@check("remaining_gap_sample", """
SELECT id_planta, "timestamp", power FROM holed WHERE radiation IS NULL ORDER BY id_planta, "timestamp" LIMIT 10""", "power", HOLES)
def remaining_gap_sample(spark, d):
    return asof.remaining_gaps(holed(spark, d))[1].select(C.PLANT, C.TS, C.POWER)


@check("nominal_lookup_join", "SELECT id_planta, \"timestamp\", p_nominal_kw, power_pu FROM pu", "p_nominal_kw power_pu")
def nominal_lookup_join(spark, d):
    nominal = spark.createDataFrame(list(B.NOMINAL_KW.items()), f"{C.PLANT} string, {C.NOMINAL} double")
    return quality.add_nominal_from_table(B.readings(spark, d), nominal).select(C.PLANT, C.TS, C.NOMINAL, C.TARGET)


ATTACHED = WEATHER + "," + grid_sql("weather", ("T_ambiente",), "site") + f""",
fine AS (SELECT "timestamp", {interpolated('T_ambiente', key='site')} AS T_ambiente FROM grid_of_weather),
joined AS (SELECT r.id_planta, r."timestamp", r.radiation, r.power, f.T_ambiente, row_number() OVER (PARTITION BY r.id_planta ORDER BY r."timestamp") AS pos
  FROM readings r LEFT JOIN fine f ON f."timestamp" = r."timestamp")"""


@check("hourly_temperature_plan", f"""
SELECT id_planta, "timestamp", radiation, power, {interpolated('T_ambiente')} AS T_ambiente FROM joined""", "radiation power T_ambiente", ATTACHED)
def hourly_temperature_plan(spark, d):
    return plans.attach_temperature(B.readings(spark, d), plans.hourly_temperature(B.weather(spark, d)))


CELSIUS = STATIONS + """,
prio AS (SELECT *, list_position(['ST3', 'ST1', 'ST5'], station) AS prio FROM stations WHERE station IN ('ST3', 'ST1', 'ST5')),
best AS (SELECT p.* FROM prio p JOIN (SELECT "Date", min(prio) AS prio FROM prio GROUP BY 1) b ON b."Date" = p."Date" AND b.prio = p.prio),
firsts AS (SELECT strptime("Date" || ' ' || "Time", '%Y-%m-%d %I:%M %p') AS "timestamp", arg_min((CAST(regexp_replace("Temperature", '\\s.*', '') AS DOUBLE) - 32) * 5.0 / 9.0, seq) AS v
  FROM best GROUP BY 1),
means AS (SELECT 'all' AS site, time_bucket(INTERVAL '15 minutes', "timestamp") AS "timestamp", avg(v) AS v FROM firsts GROUP BY 2),""" \
    + grid_sql("means", ("v",), "site") + f""",
bridged AS (SELECT site, "timestamp", {interpolated('v', 3, True, 'site')} AS T_ambiente FROM grid_of_means),
joined AS (SELECT r.id_planta, r."timestamp", r.radiation, r.power, f.T_ambiente, row_number() OVER (PARTITION BY r.id_planta ORDER BY r."timestamp") AS pos
  FROM readings r LEFT JOIN bridged f ON f."timestamp" = r."timestamp")"""


@check("station_temperature_grid", "SELECT * FROM bridged", "T_ambiente", CELSIUS)
def station_temperature_grid(spark, d):
    return plans.station_temperature(B.stations(spark, d), ["ST3", "ST1", "ST5"], ["seq"])


@check("station_temperature_plan", f"""
SELECT id_planta, "timestamp", radiation, power, {interpolated('T_ambiente')} AS T_ambiente FROM joined""", "radiation power T_ambiente", CELSIUS)
def station_temperature_plan(spark, d):
    grid = plans.station_temperature(B.stations(spark, d), ["ST3", "ST1", "ST5"], ["seq"])
    return plans.attach_temperature(B.readings(spark, d), grid)
