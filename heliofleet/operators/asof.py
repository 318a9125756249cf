"""Nearest-in-time joins against station readings, and what is built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import scalar as S
from ..functions.aggregates import correlation
from .chunks import Order, micros, neighbours
from .series import dedupe

_SIDE = "_side"
TOLERANCE = 15 * 60


def asof_nearest(
    left: DataFrame, right: DataFrame, values: Sequence[str], by: Sequence[str] = (), on: str = C.TS,
    tolerance_seconds: int = TOLERANCE, chunk_seconds: int = 3600, parts: int | None = None,
) -> DataFrame:
    """Each left row gets the closest right row with the same ``by`` values within the tolerance.

    Left rows of one key and time share one lookup, however many there are, and get its values back by join.
    Both sides are stacked and swept in time order inside ``(by, time chunk)``: linear in the rows,
    no row pairs, and a right row beyond the chunk arrives through the per-chunk edges, so neither a
    busy station nor a busy quarter of an hour multiplies anything. The bound is inclusive; of two
    equally distant rows the earlier one wins. The right side needs one row per key and time.
    ``parts`` cuts time into chunks of even size, for bursts that would overfill a fixed width.
    """
    if set(values) & set(left.columns):
        raise ValueError("value columns already present on the left side")
    stacked = left.select(*by, on).distinct().withColumn(_SIDE, F.lit(1)).unionByName(
        right.select(*by, on, *values).withColumn(_SIDE, F.lit(0)), allowMissingColumns=True
    )
    packed = F.when(F.col(_SIDE) == 0, F.struct(micros(F.col(on)).alias("t"), *values))
    swept = neighbours(stacked, {"r": packed}, Order(tuple(by), on, (_SIDE,), chunk_seconds, parts), unique_times=True).filter(F.col(_SIDE) == 1)
    t, limit = micros(F.col(on)), F.lit(tolerance_seconds * 1_000_000)
    back, ahead = t - F.col("prev_r.t"), F.col("next_r.t") - t
    near_back = back.isNotNull() & (back <= limit)
    near_ahead = ahead.isNotNull() & (ahead <= limit)
    use_ahead = near_ahead & (~near_back | (ahead < back))
    keys = [*by, on]
    found = swept.select(
        *[F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)],
        *[F.when(use_ahead, F.col(f"next_r.{v}")).when(near_back, F.col(f"prev_r.{v}")).alias(v) for v in values],
    )
    same = [left[c].eqNullSafe(found[f"_key{i}"]) for i, c in enumerate(keys)]
    return left.join(found, same, "left").select(*[left[c] for c in left.columns], *[found[v] for v in values])


def parse_station_radiation(raw: DataFrame, sequence: Sequence[str] = ()) -> DataFrame:
    """Text rows ``Date``, ``Time``, ``Solar`` to ``station, timestamp, station_radiation``.

    Unreadable rows are dropped; of several rows at one time the first in source order is kept.
    """
    parsed = raw.select(
        "station",
        S.to_timestamp(S.join_date_time(F.col("Date"), F.col("Time")), ("yyyy-MM-dd h:mm a",)).alias(C.TS),
        S.to_number(S.strip_suffix_unit(F.col("Solar"))).alias("station_radiation"),
        *sequence,
    ).filter(F.col(C.TS).isNotNull() & F.col("station_radiation").isNotNull())
    if not sequence:
        return parsed
    first = dedupe(parsed, [F.col(c) for c in sequence], "first", ("station", C.TS))
    return first.select("station", C.TS, "station_radiation")


def fill_mask(is_sunlit: Column) -> Column:
    """Readings to be replaced: NULL, or zero while the sun is up."""
    return F.col(C.RADIATION).isNull() | F.coalesce((F.col(C.RADIATION) == 0) & is_sunlit, F.lit(False))


def station_pairs(ranked: Sequence[str]) -> Column:
    """Rank and name of each station of an ordered pool, as an array of structs."""
    return F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.lit(s).alias("station")) for i, s in enumerate(ranked)])


def _per_station(df: DataFrame, ranked: Sequence[str] | DataFrame) -> DataFrame:
    if isinstance(ranked, DataFrame):
        return df.join(ranked.select(C.PLANT, "station", "rank"), C.PLANT)
    return df.select("*", F.inline(station_pairs(ranked)))


def fill_from_stations(
    df: DataFrame, stations: DataFrame, ranked: Sequence[str] | DataFrame, is_sunlit: Column,
    tolerance_seconds: int = TOLERANCE,
) -> DataFrame:
    """Replace missing radiation by nearby stations, in rank order; ``filled_from`` names the station.

    ``ranked`` is one order for all plants, or a table with a rank per plant and station. Only rows
    that need a value are looked up, against all stations at once. A station's zero in daytime
    stays eligible for the next station, so: at night the first value wins; in daylight the first
    non-zero value, else zero if any station had one, else the reading is left as it was.
    """
    if not isinstance(ranked, DataFrame) and not ranked:
        return df.withColumn("filled_from", F.lit(None).cast("string"))
    needs = fill_mask(is_sunlit)
    rest = df.filter(~needs).withColumn("filled_from", F.lit(None).cast("string"))
    holes = df.filter(needs).withColumn("_sunlit", F.coalesce(is_sunlit, F.lit(False)))
    offered = asof_nearest(
        _per_station(holes.select(C.PLANT, C.TS, "_sunlit"), ranked),
        stations.select("station", C.TS, "station_radiation"),
        ["station_radiation"], ("station",), tolerance_seconds=tolerance_seconds,
    )
    value, rank = F.col("station_radiation"), F.col("rank")
    choice = F.struct(value.alias("v"), F.col("station").alias("s"))
    first_any = F.min_by(choice, F.when(value.isNotNull(), rank))
    first_lit = F.min_by(choice, F.when(value.isNotNull() & (value != 0), rank))
    chosen = offered.groupBy(C.PLANT, C.TS).agg(
        F.when(F.max("_sunlit"), F.coalesce(first_lit, first_any)).otherwise(first_any).alias("_pick")
    )
    filled = holes.drop("_sunlit").join(chosen, [C.PLANT, C.TS], "left").select(
        *[F.coalesce("_pick.v", C.RADIATION).alias(C.RADIATION) if c == C.RADIATION else F.col(c) for c in df.columns],
        F.col("_pick.s").alias("filled_from"),
    )
    return rest.unionByName(filled)


def ranking_or_pool(ranking: DataFrame, df: DataFrame, pool: Sequence[str]) -> DataFrame:
    """The ranking, and the pool's own order for plants in which no station qualified."""
    plants = df.select(C.PLANT).distinct()
    unranked = plants.join(ranking.select(C.PLANT).distinct(), C.PLANT, "left_anti")
    own = ranking.select(C.PLANT, "rank", "station")
    return own.unionByName(unranked.select(C.PLANT, F.inline(station_pairs(pool))))


def rank_stations(
    df: DataFrame, stations: DataFrame, sample_year: int, pool: Sequence[str], min_overlap: int,
    tolerance_seconds: int = TOLERANCE,
) -> DataFrame:
    """Stations of each plant by correlation with its radiation, best first.

    The sample is the first day of every month of one year. Only plant rows that can reach a
    sample day take part. Stations with too few common points are left out, as are those whose
    correlation is undefined.
    """
    month_start = F.dayofmonth(C.TS) == 1
    sample = stations.filter((F.year(C.TS) == sample_year) & month_start & F.col("station").isin(*pool))
    reach = F.expr(f"INTERVAL {tolerance_seconds} SECOND")
    near = (F.dayofmonth(C.TS) == 1) | (F.dayofmonth(F.col(C.TS) - reach) == 1) | (F.dayofmonth(F.col(C.TS) + reach) == 1)
    plant_rows = df.filter((F.year(C.TS) == sample_year) & F.col(C.RADIATION).isNotNull() & near)
    matched = asof_nearest(
        _per_station(plant_rows.select(C.PLANT, C.TS, C.RADIATION), pool).drop("rank"),
        sample.select("station", C.TS, "station_radiation"), ["station_radiation"], ("station",),
        tolerance_seconds=tolerance_seconds,
    )
    scores = matched.filter(F.col("station_radiation").isNotNull()).groupBy(C.PLANT, "station").agg(
        F.count("*").alias("overlap"), correlation(C.RADIATION, "station_radiation").alias("corr")
    ).filter((F.col("overlap") >= min_overlap) & F.col("corr").isNotNull())
    w = Window.partitionBy(C.PLANT).orderBy(F.desc("corr"), "station")  # at most the pool per plant
    return scores.withColumn("rank", F.row_number().over(w))


def remaining_gaps(df: DataFrame, sample: int = 10) -> tuple[DataFrame, DataFrame]:
    """Count of NULL radiation per plant, and the first few such rows."""
    gaps = df.filter(F.col(C.RADIATION).isNull())
    return gaps.groupBy(C.PLANT).agg(F.count("*").alias("n_null")), gaps.orderBy(C.PLANT, C.TS).limit(sample)


def best_station_per_day(observations: DataFrame, priority: Sequence[str]) -> DataFrame:
    """Rows of the first station, in priority order, that reported on each day."""
    rank = F.array_position(F.array(*[F.lit(s) for s in priority]), F.col("station"))
    ranked = observations.withColumn("_prio", rank).filter(F.col("_prio") > 0)
    best = ranked.groupBy("Date").agg(F.min("_prio").alias("_prio"))
    return ranked.join(best, ["Date", "_prio"], "left_semi").drop("_prio")


def missing_days(observations: DataFrame, start: str, end: str, by: Sequence[str] = ()) -> DataFrame:
    """Calendar days of the range without any observation; with ``by``, for each of its groups that has observations at all."""
    spark = observations.sparkSession
    calendar = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    )
    present = observations.select(*by, F.col("Date").cast("date").alias("day")).distinct()
    if by:
        calendar = present.select(*by).distinct().crossJoin(calendar)
    return calendar.join(present, [*by, "day"], "left_anti")
