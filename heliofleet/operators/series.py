"""Ordered-series operators: lags, rolling statistics, grids, gap filling, episodes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .. import contracts as C
from .chunks import BLOCK, PLANT_ORDER, POS, Order, WindowColumn, halo_window, micros, neighbours, running_sum


# ---- positional windows --------------------------------------------------------------------

def lag_columns(column: str, steps: Iterable[int]) -> dict[str, WindowColumn]:
    return {f"{column}_lag_{k}": (lambda w, k=k: F.lag(column, k).over(w)) for k in steps}


def rolling_columns(column: str, windows: Iterable[int]) -> dict[str, WindowColumn]:
    """Mean and sample deviation over the ``n`` rows strictly before the current one."""
    out: dict[str, WindowColumn] = {}
    for n in windows:
        out[f"{column}_roll_mean_{n}"] = lambda w, n=n: F.avg(column).over(w.rowsBetween(-n, -1))
        out[f"{column}_roll_std_{n}"] = lambda w, n=n: F.stddev_samp(column).over(w.rowsBetween(-n, -1))
    return out


def add_lags(
    df: DataFrame, power: str = C.TARGET, radiation: str = C.RADIATION,
    power_steps: Iterable[int] = (1, 2, 4), radiation_steps: Iterable[int] = (1, 2), order: Order = PLANT_ORDER,
) -> DataFrame:
    reach = max([*power_steps, *radiation_steps, 0])
    return halo_window(df, lag_columns(power, power_steps) | lag_columns(radiation, radiation_steps), reach, order=order)


def add_rolling(
    df: DataFrame, power: str = C.TARGET, radiation: str = C.RADIATION,
    power_windows: Iterable[int] = (4, 8), radiation_windows: Iterable[int] = (4,), order: Order = PLANT_ORDER,
) -> DataFrame:
    reach = max([*power_windows, *radiation_windows, 0])
    columns = rolling_columns(power, power_windows) | rolling_columns(radiation, radiation_windows)
    return halo_window(df, columns, reach, order=order)


def add_deltas(df: DataFrame, columns: Sequence[str] = (C.TARGET, C.RADIATION)) -> DataFrame:
    """lag 1 - lag 2, for the columns whose two lags are there."""
    ready = [c for c in columns if {f"{c}_lag_1", f"{c}_lag_2"} <= set(df.columns)]
    return df.withColumns({f"delta_{c}_1": F.col(f"{c}_lag_1") - F.col(f"{c}_lag_2") for c in ready})


def horizon_names(horizons: Iterable[int] = (1, 4, 16), column: str = C.TARGET) -> list[str]:
    return [f"{column}_h{h}" for h in horizons]


def add_horizons(
    df: DataFrame, horizons: Iterable[int] = (1, 4, 16), column: str = C.TARGET, order: Order = PLANT_ORDER
) -> DataFrame:
    """Future values of a column, ``h`` rows ahead."""
    leads = {f"{column}_h{h}": (lambda w, h=h: F.lead(column, h).over(w)) for h in horizons}
    return halo_window(df, leads, 0, max(horizons), order=order)


def first_difference(df: DataFrame, column: str, out: str, order: Order = PLANT_ORDER) -> DataFrame:
    return halo_window(df, {out: lambda w: F.col(column) - F.lag(column, 1).over(w)}, 1, order=order)


def time_exact_lag(df: DataFrame, column: str, steps: int, out: str, order: Order = PLANT_ORDER,
                   step_seconds: int = C.STEP_SECONDS) -> DataFrame:
    """The value exactly ``steps`` slots earlier; NULL where that slot is absent."""
    shift = F.expr(f"INTERVAL {steps * step_seconds} SECOND")
    earlier = df.select(*order.keys, (F.col(order.time) + shift).alias(order.time), F.col(column).alias(out))
    return df.join(earlier, [*order.keys, order.time], "left")


def guarded_mean(column: str, start: int, end: int, min_rows: int) -> WindowColumn:
    """Mean of the frame, NULL while it holds fewer than ``min_rows`` non-NULL values."""
    def build(w: WindowSpec) -> Column:
        frame = w.rowsBetween(start, end)
        return F.when(F.count(column).over(frame) >= min_rows, F.avg(column).over(frame))
    return build


def centred_mean(df: DataFrame, column: str, out: str, window: int = 16, min_rows: int = 4,
                 order: Order = PLANT_ORDER) -> DataFrame:
    back, ahead = window // 2, window - window // 2 - 1
    return halo_window(df, {out: guarded_mean(column, -back, ahead, min_rows)}, back, ahead, order=order)


def trailing_mean(df: DataFrame, column: str, out: str, window: int = 96, min_rows: int = 24,
                  order: Order = PLANT_ORDER) -> DataFrame:
    return halo_window(df, {out: guarded_mean(column, 1 - window, 0, min_rows)}, window - 1, order=order)


def canonical_order(df: DataFrame, order: Order = PLANT_ORDER) -> DataFrame:
    """Rows by series and time, for output only; operators never rely on the order of rows."""
    return df.orderBy(*order.keys, *order.sorting())


# ---- duplicates and gaps -------------------------------------------------------------------

def dedupe(df: DataFrame, sequence: Sequence[Column], keep: str = "last",
           keys: Sequence[str] = (C.PLANT, C.TS)) -> DataFrame:
    """One row per key, the first or last by an explicit source order.

    A ``max_by``/``min_by`` aggregate: duplicates are combined before the shuffle, so a key with
    any number of copies costs one row per map task.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    packed = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*sequence)).alias("_row"))
    return packed.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def _with_previous(df: DataFrame, order: Order) -> DataFrame:
    return halo_window(df, {"prev_timestamp": lambda w: F.lag(order.time, 1).over(w)}, 1, order=order)


def time_gaps(df: DataFrame, step_seconds: int = C.STEP_SECONDS, order: Order = PLANT_ORDER) -> DataFrame:
    """Steps of a series that differ from the sampling step."""
    seconds = (micros(F.col(order.time)) - micros(F.col("prev_timestamp"))) / 1_000_000
    return (
        _with_previous(df.select(*order.keys, order.time), order)
        .filter(seconds != step_seconds)
        .select(*order.keys, "prev_timestamp", order.time, (seconds / 60).alias("gap_minutes"))
    )


def time_consistency(df: DataFrame, step_seconds: int = C.STEP_SECONDS, order: Order = PLANT_ORDER) -> DataFrame:
    """Rows, gaps, gap share and most common step (smallest one on a tie) per series."""
    keys = list(order.keys)
    seconds = (micros(F.col(order.time)) - micros(F.col("prev_timestamp"))) / 1_000_000
    steps = _with_previous(df.select(*keys, order.time), order).groupBy(*keys, seconds.alias("_step")).agg(
        F.count("*").alias("_n")
    )
    known = F.col("_step").isNotNull()
    mode = F.max_by("_step", F.when(known, F.struct(F.col("_n"), -F.col("_step"))))
    out = steps.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"),
        F.coalesce(F.sum(F.when(known & (F.col("_step") != step_seconds), F.col("_n"))), F.lit(0)).alias("n_gaps"),
        (mode / 60).alias("mode_minutes"),
    )
    ratio = F.col("n_gaps") / F.greatest(F.col("n_rows") - 1, F.lit(1))
    return out.withColumn("gap_ratio", ratio)


def regular_grid(df: DataFrame, step_seconds: int = C.STEP_SECONDS, order: Order = PLANT_ORDER,
                 last: Column | None = None) -> DataFrame:
    """Every slot from a series' first to its last timestamp, with its number in ``_pos``.

    Slots are produced a day's worth at a time and spread by ``(series, day)`` before they are
    unfolded, so a long series is not unfolded by one task.
    """
    keys = list(order.keys)
    per = max(1, 86_400 // step_seconds)
    bounds = df.groupBy(*keys).agg(F.min(order.time).alias("_t0"), F.max(order.time).alias("_t1"))
    steps = F.floor((micros(F.col("_t1")) - micros(F.col("_t0"))) / (step_seconds * 1_000_000))
    days = bounds.withColumn("_steps", steps).withColumn(
        "_day", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_steps") / per)))
    ).repartition(*keys, "_day")
    start = F.col("_day") * per
    slot = F.explode(F.sequence(start, F.least(start + (per - 1), F.col("_steps"))))
    at = F.timestamp_micros(micros(F.col("_t0")) + F.col(POS) * (step_seconds * 1_000_000))
    return days.withColumn(POS, slot).select(*keys, at.cast("timestamp_ntz").alias(order.time), POS)


def reindex(df: DataFrame, step_seconds: int = C.STEP_SECONDS, order: Order = PLANT_ORDER,
            keep_position: bool = False) -> DataFrame:
    """The series on its regular grid: absent slots become NULL rows, off-grid rows are dropped."""
    grid = regular_grid(df, step_seconds, order)
    out = grid.join(df, [*order.keys, order.time], "left")
    return out if keep_position else out.drop(POS)


def missing_slots(df: DataFrame, step_seconds: int = C.STEP_SECONDS, order: Order = PLANT_ORDER) -> DataFrame:
    keys = [*order.keys, order.time]
    return regular_grid(df, step_seconds, order).join(df.select(*keys), keys, "left_anti").drop(POS)


# ---- filling -------------------------------------------------------------------------------

def interpolate(
    df: DataFrame, columns: Sequence[str], limit: int | None = None, both: bool = False, order: Order = PLANT_ORDER
) -> DataFrame:
    """Fill NULLs linearly in time between the neighbours that hold a value.

    ``limit`` counts rows from the edge of the gap: a longer gap is filled only in its first
    ``limit`` rows (and, with ``both``, its last ones too). After the last value the value is
    held; before the first one rows stay NULL unless ``both``. Values that are present never
    change. Needs ``_pos`` (a grid position) when a limit is given.
    """
    numbered = df
    if limit is not None and POS not in df.columns:
        raise ValueError("a limit counts grid positions: reindex(..., keep_position=True) first")
    has_pos = POS in numbered.columns
    packed = {
        c: F.when(
            F.col(c).isNotNull(),
            F.struct(micros(F.col(order.time)).alias("t"), F.col(c).cast("double").alias("v"),
                     (F.col(POS) if has_pos else F.lit(0).cast("bigint")).alias("i")),
        )
        for c in columns
    }
    found = neighbours(numbered, packed, order)
    t = micros(F.col(order.time))

    def filled(c: str) -> Column:
        before, after = F.col(f"prev_{c}"), F.col(f"next_{c}")
        share = F.coalesce(F.try_divide(t - before["t"], after["t"] - before["t"]), F.lit(0.0))
        line = before["v"] + (after["v"] - before["v"]) * share
        value = F.when(before.isNotNull() & after.isNotNull(), line).when(before.isNotNull(), before["v"])
        reach = before.isNotNull() if limit is None else F.coalesce(F.col(POS) - before["i"] <= limit, F.lit(False))
        if both:
            value = value.otherwise(after["v"])
            back = after.isNotNull() if limit is None else F.coalesce(after["i"] - F.col(POS) <= limit, F.lit(False))
            reach = reach | back
        return F.when(F.col(c).isNotNull(), F.col(c)).when(reach, value).alias(c)

    return found.select(*[filled(c) if c in columns else F.col(c) for c in df.columns])


def previous_day(df: DataFrame, columns: Sequence[str], days: int = 3, per_day: int = C.STEPS_PER_DAY,
                 order: Order = PLANT_ORDER) -> DataFrame:
    """NULL takes the value of the same slot one, two, ... ``days`` days before (grid input)."""
    def copied(c: str) -> WindowColumn:
        return lambda w: F.coalesce(F.col(c), *[F.lag(c, k * per_day).over(w) for k in range(1, days + 1)])

    reach = days * per_day
    wide = halo_window(df, {f"_c_{c}": copied(c) for c in columns}, reach, order=order)
    return wide.select(*[F.col(f"_c_{c}").alias(c) if c in columns else F.col(c) for c in df.columns if c != POS])


def fill_gaps(df: DataFrame, columns: Sequence[str] = (C.RADIATION, C.POWER), limit: int = 8, days: int = 3,
              fill: bool = True, order: Order = PLANT_ORDER) -> DataFrame:
    """Grid, short interpolation, previous-day copy; derived month and hour are restored."""
    from ..functions.scalar import month_key

    out = reindex(df, order=order, keep_position=True)
    if not fill:
        return out.drop(POS)
    out = previous_day(interpolate(out, columns, limit, order=order), columns, days, order=order)
    return out.withColumns({"Mes": month_key(F.col(order.time)), "hour": F.hour(order.time).cast("int")})


def resample_up(df: DataFrame, columns: Sequence[str], step_seconds: int = C.STEP_SECONDS,
                order: Order = PLANT_ORDER) -> DataFrame:
    """Finer grid with values interpolated in time; the last reading ends the grid."""
    return interpolate(reindex(df, step_seconds, order, keep_position=True), columns, order=order).drop(POS)


def resample_down(df: DataFrame, columns: Sequence[str], step_seconds: int = C.STEP_SECONDS,
                  order: Order = PLANT_ORDER, keep_position: bool = False) -> DataFrame:
    """Mean per slot; slots without a reading are NULL rows."""
    bucket = F.window(order.time, f"{step_seconds} seconds")
    means = df.groupBy(*order.keys, bucket.alias("_w")).agg(*[F.avg(c).alias(c) for c in columns]).select(
        *order.keys, F.col("_w.start").cast("timestamp_ntz").alias(order.time), *columns
    )
    return reindex(means, step_seconds, order, keep_position)


# ---- accumulation and episodes -------------------------------------------------------------

def cumulative(df: DataFrame, sums: Mapping[str, Column], order: Order = PLANT_ORDER) -> DataFrame:
    return running_sum(df, sums, order)


def flag_blocks(
    df: DataFrame, stages: Sequence[Mapping[str, WindowColumn]], flag: str, reach: int, order: Order = PLANT_ORDER,
    out: str = "bloque",
) -> DataFrame:
    """Runs of equal flag values, numbered from 1 within a series (gaps and islands).

    ``stages`` compute the flag's inputs, and the flag itself last; the change marker and the
    running count use the blocks of that same shuffle.
    """
    changed = {"_changed": lambda w: F.coalesce((F.col(flag) != F.lag(flag, 1).over(w)), F.lit(True)).cast("int")}
    marked = halo_window(df, [*stages, changed], reach + 1, order=order, keep_blocks=True)
    return running_sum(marked, {out: F.col("_changed")}, order, chunk=BLOCK).drop("_changed", BLOCK, POS)
