"""Splits by plant, time and season, and the guards around them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contracts as C
from .chunks import with_scalars


def midnight(date: str) -> Column:
    """A date bound means its midnight."""
    return F.lit(date).cast("timestamp_ntz")


def between(ts: Column, start: str | None = None, end: str | None = None, closed: bool = True) -> Column:
    """Closed range of timestamps, or half-open ``[start, end)``."""
    out = F.lit(True)
    if start is not None:
        out = out & (ts >= midnight(start))
    if end is not None:
        out = out & ((ts <= midnight(end)) if closed else (ts < midnight(end)))
    return out


def assign_split(df: DataFrame, train_plants: Sequence[str], test_plant: str, dates: C.SplitDates,
                 embargo: str | None = None) -> DataFrame:
    """``split`` = train, val or test in one pass; other rows are dropped.

    Train plants up to ``train_end``, the same plants inside the validation range, the test plant
    inside the test range. A row on a shared bound belongs to the earlier part. ``embargo`` (an
    interval such as ``'4 hours'``) leaves out the rows that end a part, for shifted targets.
    """
    ts, plant = F.col(C.TS), F.col(C.PLANT)
    trains = plant.isin(*train_plants)
    reach = ts + F.expr(f"INTERVAL {embargo}") if embargo else ts
    split = (
        F.when(trains & (reach <= midnight(dates.train_end)), "train")
        .when(trains & (ts >= midnight(dates.val_start)) & (reach <= midnight(dates.val_end)), "val")
        .when((plant == test_plant) & (ts >= midnight(dates.test_start)) & (reach <= midnight(dates.test_end)), "test")
    )
    return df.withColumn("split", split).filter(F.col("split").isNotNull())


def parts(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, validation and test frames; an empty one is an error."""
    present = {r["split"] for r in df.select("split").distinct().limit(4).collect()}
    absent = [s for s in ("train", "val", "test") if s not in present]
    if absent:
        raise ValueError(f"empty split: {', '.join(absent)}")
    return tuple(df.filter(F.col("split") == s) for s in ("train", "val", "test"))


def split_by_plant(df: DataFrame, train_plants: Sequence[str], test_plant: str) -> tuple[DataFrame, DataFrame]:
    train = df.filter(F.col(C.PLANT).isin(*train_plants))
    test = df.filter(F.col(C.PLANT) == test_plant)
    if train.isEmpty() or test.isEmpty():
        raise ValueError("empty split by plant")
    return train, test


def adapted_split(
    df: DataFrame, base_plants: Sequence[str], target: str, base_end: str,
    local: tuple[str, str], val: tuple[str, str], test: tuple[str, str],
) -> DataFrame:
    """Train on the base plants plus some local history of the target plant; half-open ranges."""
    ts, plant = F.col(C.TS), F.col(C.PLANT)
    base = plant.isin(*base_plants)
    split = (
        F.when(base & between(ts, None, base_end, False), "train")
        .when((plant == target) & between(ts, *local, False), "train")
        .when(base & between(ts, *val, False), "val")
        .when((plant == target) & between(ts, *test, False), "test")
    )
    return df.withColumn("split", split).filter(F.col("split").isNotNull())


def season_windows(df: DataFrame, windows: Mapping[str, tuple[str, str]], plant: str | None = None) -> DataFrame:
    """Rows inside the named closed windows, with the name in ``estacion``.

    The window table is a handful of literals, unfolded per row and filtered; a row that lies in
    two windows appears in both.
    """
    rows = df if plant is None else df.filter(F.col(C.PLANT) == plant)
    named = F.array_compact(
        F.array(*[F.when(between(F.col(C.TS), a, b), F.lit(n)) for n, (a, b) in windows.items()])
    )
    return rows.withColumn("estacion", F.explode(named))


def split_report(df: DataFrame) -> DataFrame:
    """Rows, first and last timestamp and plants of each split."""
    return df.groupBy("split").agg(
        F.count("*").alias("n_rows"), F.min(C.TS).alias("first_ts"), F.max(C.TS).alias("last_ts"),
        F.array_join(F.sort_array(F.collect_set(C.PLANT)), ",").alias("plants"),
    )


def split_bounds(df: DataFrame) -> DataFrame:
    """First and last timestamp of every split in one row, and whether they are in order."""
    def edge(fn, split: str) -> Column:
        return fn(F.when(F.col("split") == split, F.col(C.TS)))

    return df.agg(
        edge(F.max, "train").alias("train_max"), edge(F.min, "val").alias("val_min"),
        edge(F.max, "val").alias("val_max"), edge(F.min, "test").alias("test_min"),
    ).withColumn(
        "ordered", (F.col("train_max") < F.col("val_min")) & (F.col("val_min") < F.col("test_min"))
    )


def assert_no_leakage(df: DataFrame) -> None:
    row = split_bounds(df).first()
    if not row["ordered"]:
        raise AssertionError(f"splits overlap in time: {row}")


def memory_nulls(df: DataFrame, markers: Sequence[str] = ("_lag_", "_roll_")) -> DataFrame:
    """NULL count over all lag and rolling columns."""
    columns = [c for c in df.columns if any(m in c for m in markers)]
    per_row = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0)).alias("n_null"))


def assert_complete_memory(df: DataFrame) -> None:
    n = memory_nulls(df).first()["n_null"]
    if n:
        raise AssertionError(f"{n} NULL cells in lag or rolling columns")


def first_days(df: DataFrame, days: int = 7) -> DataFrame:
    """Rows earlier than the first timestamp plus ``days``."""
    start = df.agg(F.min(C.TS).alias("_start"))
    return with_scalars(df, start).filter(
        F.col(C.TS) < F.col("_start") + F.expr(f"INTERVAL {int(days)} DAY")
    ).drop("_start")
