"""The readings, stations, weather and prediction tables as views over the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts as C
from ..operators.splits import assign_split

NOMINAL_KW = {"click": 12.4, "error": 12.0, "purchase": 19.53, "signup": 15.0, "view": 10.0}
TRAIN_PLANTS = ("click", "view")
TEST_PLANT = "purchase"
SPLIT = C.SplitDates("2024-01-15", "2024-01-16", "2024-01-21", "2024-01-22", "2024-01-31")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _slots(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    grouped = table(spark, d, "events").groupBy(
        F.col("event_type").alias(C.PLANT), F.window("ts", "15 minutes").alias("_w")
    ).agg(
        F.avg("value").alias("v"), F.avg(k.cast("double")).alias("k"),
        F.max(k.cast("int")).alias("kmax"), F.avg("user_id").alias("u"),
    )
    start = F.col("_w.start")
    angle = F.pi() * (F.hour(start) + F.minute(start) / F.lit(60.0) - 6) / 12
    return grouped.select(
        C.PLANT, start.cast("timestamp_ntz").alias(C.TS), "v", "k", "kmax", "u",
        F.greatest(F.lit(0.0), F.sin(angle)).alias("d"),
    )


def readings(spark: SparkSession, d: str) -> DataFrame:
    s = _slots(spark, d)
    return s.select(
        C.PLANT, C.TS,
        F.round(F.when(F.col("kmax") == 99, 999.0).otherwise(12 * F.col("k") * F.col("d")), 4).alias(C.RADIATION),
        F.round(100 * F.col("v") * F.col("d"), 4).alias(C.POWER),
        F.round(F.col("u") / 5, 4).alias(C.TEMPERATURE),
    )


def readings_raw(spark: SparkSession, d: str) -> DataFrame:
    """Drifted radiation, negative power at night, some power missing."""
    s = _slots(spark, d)
    power = F.round(100 * F.col("v") * F.col("d"), 4) - 2
    return s.select(
        C.PLANT, C.TS,
        (F.round(F.when(F.col("kmax") == 99, 999.0).otherwise(12 * F.col("k") * F.col("d")), 4) + 3).alias(C.RADIATION),
        F.when(F.col("kmax") != 98, power).alias(C.POWER),
        F.round(F.col("u") / 5, 4).alias(C.TEMPERATURE),
    )


def per_unit(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.quality import add_nominal_power

    return add_nominal_power(readings(spark, d), NOMINAL_KW)


def stations(spark: SparkSession, d: str) -> DataFrame:
    """Raw station rows: text date, 12-hour clock, value with unit."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(
        F.concat(F.lit("ST"), F.col("user_id") % 6).alias("station"),
        F.date_format("ts", "yyyy-MM-dd").alias("Date"),
        F.date_format("ts", "h:mm a").alias("Time"),
        F.concat((k * 12).cast("string"), F.lit(" w/m²")).alias("Solar"),
        F.concat((F.col("user_id") % 70 + 30).cast("string"), F.lit(".5 °F")).alias("Temperature"),
        F.col("event_id").alias("seq"),
        F.col("ts"),
    )


def weather(spark: SparkSession, d: str) -> DataFrame:
    """One temperature per hour, over all events."""
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("_w")).agg(
        F.round(F.avg("user_id") / 5, 4).alias(C.TEMPERATURE)
    ).select(F.lit("all").alias("site"), F.col("_w.start").cast("timestamp_ntz").alias(C.TS), C.TEMPERATURE)


def daily(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(
        F.col("l_returnflag").alias(C.PLANT), F.col("l_shipdate").alias(C.TS)
    ).agg(
        F.round(F.sum("l_quantity"), 4).alias(C.RADIATION),
        F.round(F.sum("l_extendedprice"), 4).alias(C.POWER),
        F.round(F.avg("l_discount") * 100, 4).alias(C.TEMPERATURE),
    )


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Three predictors, long: last value, same slot yesterday, line on radiation fitted on train."""
    from ..plans.predictors import linear_predictions, persistence, same_slot_yesterday

    base = assign_split(per_unit(spark, d), TRAIN_PLANTS, TEST_PLANT, SPLIT)
    keep = [C.PLANT, C.TS, "split", "y_true", "y_pred", C.RADIATION, C.TEMPERATURE, "model"]
    parts = [
        persistence(base).withColumn("model", F.lit("persistence")),
        same_slot_yesterday(base).withColumn("model", F.lit("same_slot_yesterday")),
        linear_predictions(base).withColumn("model", F.lit("linear")),
    ]
    out = parts[0].select(*keep)
    for p in parts[1:]:
        out = out.unionByName(p.select(*keep))
    return out
