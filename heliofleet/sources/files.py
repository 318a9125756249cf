"""Raw site exports, plant tables, station and weather files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import contracts as C
from ..functions import scalar as S
from ..operators.series import dedupe
from ..operators.splits import between

# Header cells of the raw exports.
TIME_HEADER = "FECHA/HORA"
RADIATION_HEADER = "RADIACION SOLAR"

_ROW_ORDER = ("_file", "_block", "_row")


def _with_row_order(df: DataFrame) -> DataFrame:
    """File, block and row number: a total order of source rows (blocks are read whole, in order)."""
    return df.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def scan_exports(
    spark: SparkSession, path: str, power_headers: Sequence[str], formats: Sequence[str] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm"),
) -> tuple[DataFrame, DataFrame]:
    """Year/month/day CSV exports whose headers vary from file to file: ``(readings, quarantine)``.

    One scan without header. The row holding the time header is its file's header, and cells are
    picked by their position in it; the first of ``power_headers`` that is present names the power
    column. A file is set aside as a whole if a header is missing or a timestamp is unreadable. Lines
    are read whole and cut at commas outside quotes, so a file may be of any width.
    """
    raw = spark.read.schema("line string").option("header", "false").option("encoding", "iso-8859-1").option(
        "sep", "\u0001").option("quote", "").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(path)
    rows = _with_row_order(raw).select(
        *_ROW_ORDER, F.transform(
            F.split("line", ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1),
            lambda c: F.nullif(F.trim(F.regexp_replace(F.trim(c), '^"(.*)"$', "$1")), F.lit(""))).alias("cells")
    ).withColumn("_header", F.coalesce(F.array_contains("cells", TIME_HEADER), F.lit(False)))

    def position(name: str) -> Column:
        return F.nullif(F.array_position("header", F.lit(name)), F.lit(0))

    headers = rows.groupBy("_file").agg(
        F.min_by("cells", F.when(F.col("_header"), F.struct("_block", "_row"))).alias("header")
    ).select(
        "_file", position(TIME_HEADER).alias("_t"), position(RADIATION_HEADER).alias("_r"),
        F.coalesce(*[position(h) for h in power_headers]).alias("_p"),
    )
    complete = F.col("_t").isNotNull() & F.col("_r").isNotNull() & F.col("_p").isNotNull()

    def cell(at: str) -> Column:
        return S.strip_null_marker(F.get(F.col("cells"), (F.col(at) - 1).cast("int")))

    picked = rows.filter(~F.col("_header")).join(headers.filter(complete), "_file").select(
        *_ROW_ORDER, cell("_t").alias("_text"), S.to_timestamp(cell("_t"), formats).alias(C.TS),
        S.to_number(cell("_r")).alias(C.RADIATION), S.to_number(cell("_p")).alias(C.POWER),
    )
    unreadable = picked.filter(F.col("_text").isNotNull() & F.col(C.TS).isNull()).select("_file").distinct()
    quarantine = headers.filter(~complete).select(F.col("_file").alias("file_path"), F.lit("header").alias("reason")).unionByName(
        unreadable.select(F.col("_file").alias("file_path"), F.lit("timestamp").alias("reason"))
    )
    return picked.join(unreadable, "_file", "left_anti").drop("_text"), quarantine


def consolidate_exports(scan: DataFrame, plant: str, check: bool = False) -> DataFrame:
    """First row per timestamp, NULL to 0, negatives clipped, whole-hour calendar columns."""
    if check and scan.isEmpty():
        raise RuntimeError("no valid export file")
    unique = dedupe(scan, [F.col(c) for c in _ROW_ORDER], "first", (C.TS,)).drop(*_ROW_ORDER).filter(F.col(C.TS).isNotNull())
    zeroed = unique.withColumns({c: S.clip(F.coalesce(F.col(c), F.lit(0.0)), 0.0) for c in (C.RADIATION, C.POWER)})
    ts = F.col(C.TS)
    return zeroed.select(F.lit(plant).alias(C.PLANT), C.TS, C.RADIATION, C.POWER).withColumns(
        S.calendar(ts) | S.cyclic_calendar(ts, fractional_hour=False)
    )


def validate_readings(raw: DataFrame, plant: str, sequence: Sequence[Column] = (), keep: str = "last") -> DataFrame:
    """Required columns, readable timestamps, no infinities, one row per timestamp, plant stamped."""
    C.require_columns(raw)
    typed = raw.withColumns(
        {C.TS: S.to_timestamp(F.col(C.TS).cast("string")) if dict(raw.dtypes)[C.TS] == "string" else F.col(C.TS)}
        | {c: S.to_number(F.col(c)) for c in (C.RADIATION, C.POWER, C.TEMPERATURE)}
    ).filter(F.col(C.TS).isNotNull()).withColumn(C.PLANT, F.lit(plant))
    unique = dedupe(typed, sequence, keep) if sequence else typed
    first = [C.PLANT, C.TS]
    return unique.select(*first, *[c for c in unique.columns if c not in first])


def load_plant(spark: SparkSession, path: str, plant: str, drop_duplicates: bool = True) -> DataFrame:
    """One plant's CSV; all text is typed here, never inferred. Later rows win over earlier ones."""
    raw = _with_row_order(spark.read.option("header", "true").csv(path))
    sequence = [F.col(c) for c in _ROW_ORDER] if drop_duplicates else []
    return validate_readings(raw, plant, sequence).drop(*_ROW_ORDER)


def load_plants(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    if not paths:
        raise ValueError("no plants given")
    return union_plants([load_plant(spark, path, plant) for plant, path in paths.items()])


def union_plants(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def load_range(df: DataFrame, start: str, end: str, apply: bool = True) -> DataFrame:
    """Closed range between two midnights."""
    return df.filter(between(F.col(C.TS), start, end)) if apply else df


def reload_unified(df: DataFrame) -> DataFrame:
    """Stored readings without columns that are derived again later."""
    return df.drop(C.TARGET, C.NOMINAL)


def scan_station_days(spark: SparkSession, path: str) -> DataFrame:
    """Landed station files under ``station=<id>/day=<date>/``; both become columns and prune."""
    raw = spark.read.option("header", "true").csv(path)
    stamped = raw if "Date" in raw.columns else raw.withColumn("Date", F.col("day").cast("string"))
    return _with_row_order(stamped)


def flatten_hourly(payloads: DataFrame, column: str = "value") -> DataFrame:
    """JSON payloads with parallel arrays to one row per hour."""
    schema = "hourly struct<time: array<string>, temperature_2m: array<double>>"
    parsed = payloads.select(F.from_json(F.col(column), schema).alias("p"))
    hours = parsed.select(F.explode(F.arrays_zip(F.col("p.hourly.time").alias("time"),
                                                 F.col("p.hourly.temperature_2m").alias("temperature_2m"))).alias("h"))
    return hours.select(
        S.to_timestamp(F.col("h.time"), ("yyyy-MM-dd'T'HH:mm",)).alias(C.TS), F.col("h.temperature_2m").alias(C.TEMPERATURE)
    )


def hourly_completeness(hours: DataFrame, start: str, end: str) -> DataFrame:
    """Expected, found and missing hours from the first day's midnight to the last day's 23:00."""
    first = F.lit(start).cast("timestamp_ntz")
    last = F.lit(end).cast("timestamp_ntz") + F.expr("INTERVAL 23 HOUR")
    inside = hours.filter((F.col(C.TS) >= first) & (F.col(C.TS) <= last))
    expected = F.size(F.sequence(first, last, F.expr("INTERVAL 1 HOUR")))
    found = F.count_distinct(C.TS)
    return inside.agg(expected.alias("expected"), found.alias("found"), (expected - found).alias("missing"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file."""
    return spark.read.text(path, wholetext=True)
