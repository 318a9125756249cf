"""Ordered work without one task per series.

A window partitioned by series alone puts a whole series into one task; with a few long series, or
one that holds a third of all rows, that task is the job. Everything ordered in this package goes
through the helpers below instead. They cut a series into chunks, work inside ``(series, chunk)``
and carry what crosses a chunk border in a small per-chunk table (one row per series and chunk):

``number_rows``    global 0-based position: chunk counts, prefix-summed, plus rank inside the chunk
``halo_window``    bounded frames: each block of rows also receives the last/first rows it looks at
``running_sum``    unbounded sums: chunk totals, prefix-summed, plus the sum inside the chunk
``neighbours``     nearest non-NULL row on either side at any distance
``value_ranks``    rank of every distinct value, ties combined before the shuffle
``exact_quantiles`` interpolated quantiles that only sort the buckets holding the wanted ranks

Series keys must not be NULL (plant identifiers are stamped by the loaders).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import contracts as C

POS = "_pos"
BLOCK = "_block"
_CHUNK = "_chunk"
BLOCK_ROWS = 4096

WindowColumn = Callable[[WindowSpec], Column]


@dataclass(frozen=True)
class Order:
    """Series keys, the column that orders a series, tie-breakers and how time is cut into chunks.

    ``width`` seconds per chunk suit regular sampling: a day of 15-minute rows is 96 rows, and a
    century is 36,525 chunk totals. For bursts, where one chunk could outgrow a task, ``parts``
    asks for that many chunks of even size instead; the borders cost one more pass.
    """

    keys: tuple[str, ...] = (C.PLANT,)
    time: str = C.TS
    ties: tuple[str, ...] = ()
    width: int = 86_400
    parts: int | None = None

    def chunked(self, df: DataFrame) -> DataFrame:
        at = micros(F.col(self.time))
        if self.parts is None:
            return df.withColumn(_CHUNK, F.floor(at / (self.width * 1_000_000)).cast("bigint"))
        timed = bucket_by_value(df.withColumn("_at", at.cast("double")), "_at", self.parts)
        return timed.withColumn(_CHUNK, F.col("_bucket").cast("bigint")).drop("_at", "_bucket")

    def sorting(self, descending: bool = False) -> list[Column]:
        columns = [F.col(c) for c in (self.time, *self.ties)]
        return [c.desc() for c in columns] if descending else [c.asc() for c in columns]


PLANT_ORDER = Order()


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def join_ranked(df: DataFrame, ranked: DataFrame, keys: Sequence[str], count: str, share: int = 1000) -> DataFrame:
    """Inner join on a value whose frequencies are known, without a hot partition.

    ``ranked`` has one row per key and its ``count`` of rows. Keys that hold more than one in
    ``share`` of all rows - there cannot be more than ``share`` of them - are joined by broadcast,
    the others by shuffle.
    """
    keys = list(keys)
    total = ranked.agg(F.sum(count).alias("_all"))
    marked = with_scalars(ranked, total).withColumn("_hot", F.col(count) * share > F.col("_all")).drop("_all")
    hot = F.broadcast(marked.filter("_hot").drop("_hot"))
    cold = marked.filter("NOT _hot").drop("_hot")
    rest = df.join(hot.select(*keys), keys, "left_anti").join(cold, keys)
    return df.join(hot, keys).unionByName(rest)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate (a scalar subquery in SQL terms)."""
    return df.crossJoin(F.broadcast(one_row.limit(1)))


def _before_totals(totals: DataFrame, keys: Sequence[str], chunk: str, sums: Mapping[str, str]) -> DataFrame:
    """Sum of each total over the earlier chunks of its series (small: a row per series and chunk)."""
    w = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, chunk, *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(o) for s, o in sums.items()])


def number_rows(df: DataFrame, order: Order = PLANT_ORDER, out: str = POS) -> DataFrame:
    """0-based position of each row in its series, in two balanced steps."""
    keys = list(order.keys)
    chunked = order.chunked(df)
    counts = chunked.groupBy(*keys, _CHUNK).agg(F.count("*").alias("_n"))
    offsets = _before_totals(counts, keys, _CHUNK, {"_n": "_before"})
    inside = F.row_number().over(Window.partitionBy(*keys, _CHUNK).orderBy(*order.sorting()))
    return (
        chunked.withColumn("_in", inside)
        .join(offsets, [*keys, _CHUNK])
        .withColumn(out, F.col("_before") + F.col("_in") - 1)
        .select(*df.columns, out)
    )


def halo_window(
    df: DataFrame,
    stages: Sequence[Mapping[str, WindowColumn]] | Mapping[str, WindowColumn],
    before: int,
    after: int = 0,
    order: Order = PLANT_ORDER,
    rows: int = BLOCK_ROWS,
    keep_blocks: bool = False,
) -> DataFrame:
    """Window columns whose frames reach at most ``before`` rows back and ``after`` rows ahead.

    Rows are numbered (unless a ``_pos`` column is there already), cut into blocks of ``rows``, and
    the rows near a border are copied into the block next door; one shuffle then serves every
    column of every stage. Later stages may use the columns of earlier ones; ``before``/``after``
    cover the whole reach of the last stage. The copies are dropped at the end.
    """
    if isinstance(stages, Mapping):
        stages = [stages]
    numbered = df if POS in df.columns else number_rows(df, order)
    size = max(rows, before, after, 1)
    home = F.expr(f"{POS} div {size}")
    offset = F.pmod(F.col(POS), F.lit(size))
    first = home - F.when(offset < after, 1).otherwise(0)
    last = home + F.when(offset >= size - before, 1).otherwise(0)
    out = numbered.withColumn(BLOCK, F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*order.keys, BLOCK).orderBy(POS)
    for stage in stages:
        out = out.withColumns({name: build(w) for name, build in stage.items()})
    out = out.filter(F.col(BLOCK) == home)
    return out if keep_blocks else out.drop(BLOCK, POS)


def running_sum(
    df: DataFrame, sums: Mapping[str, Column], order: Order = PLANT_ORDER, chunk: str | None = None
) -> DataFrame:
    """Sums from the start of the series up to each row, itself included.

    ``chunk`` names an existing chunk column, such as the block a ``halo_window`` left behind;
    the partitioning by ``(series, block)`` is then used again.
    """
    keys = list(order.keys)
    name = chunk or _CHUNK
    based = (df if chunk else order.chunked(df)).withColumns(
        {f"_s_{out}": c for out, c in sums.items()}
    )
    totals = based.groupBy(*keys, name).agg(*[F.sum(f"_s_{o}").alias(f"_t_{o}") for o in sums])
    offsets = _before_totals(totals, keys, name, {f"_t_{o}": f"_b_{o}" for o in sums})
    sorting = [F.col(POS)] if chunk else order.sorting()
    w = Window.partitionBy(*keys, name).orderBy(*sorting).rowsBetween(Window.unboundedPreceding, 0)
    inside = based.withColumns({f"_i_{o}": F.coalesce(F.sum(f"_s_{o}").over(w), F.lit(0)) for o in sums})
    return inside.join(offsets, [*keys, name]).select(
        *df.columns, *[(F.col(f"_b_{o}") + F.col(f"_i_{o}")).alias(o) for o in sums]
    )


def _edge(name: str, fields: Sequence[str], pick: Callable[[Column, Column], Column], key: Column, out: str) -> list[Column]:
    """Parts of a chunk's first or last value, field by field: primitive buffers stay in a hash aggregate."""
    present = F.when(F.col(f"_v_{name}").isNotNull(), key)
    if not fields:
        return [pick(F.col(f"_v_{name}"), present).alias(out)]
    return [pick(F.col(f"_v_{name}.{f}"), present).alias(f"{out}_{i}") for i, f in enumerate(fields)]


def neighbours(
    df: DataFrame, values: Mapping[str, Column], order: Order = PLANT_ORDER, chunk: str | None = None,
    unique_times: bool = False,
) -> DataFrame:
    """``prev_<name>`` and ``next_<name>``: nearest non-NULL value at or before / at or after a row.

    The look-ahead is a look-back over the reversed order, so both frames grow row by row
    (a frame that ends at the end of the partition would be rescanned for every row). Values that
    lie in another chunk come from the per-chunk edges. A struct value must have a first field
    that is never NULL. ``unique_times`` says that no two values of a series share a timestamp,
    so that tie-breakers do not matter for them.
    """
    keys = list(order.keys)
    name = chunk or _CHUNK
    based = (df if chunk else order.chunked(df)).withColumns({f"_v_{n}": c for n, c in values.items()})
    kinds = {n: based.schema[f"_v_{n}"].dataType for n in values}
    fields = {n: kinds[n].names if isinstance(kinds[n], T.StructType) else [] for n in values}
    at = micros(F.col(order.time))
    key = at if unique_times or not order.ties else F.struct(at, *[F.col(c) for c in order.ties])
    edges = based.groupBy(*keys, name).agg(
        *[c for n in values for c in _edge(n, fields[n], F.max_by, key, f"_l_{n}")],
        *[c for n in values for c in _edge(n, fields[n], F.min_by, key, f"_f_{n}")],
    )

    def whole(n: str, side: str) -> Column:
        if not fields[n]:
            return F.col(f"{side}_{n}")
        built = F.struct(*[F.col(f"{side}_{n}_{i}").alias(f) for i, f in enumerate(fields[n])])
        return F.when(F.col(f"{side}_{n}_0").isNotNull(), built)

    back = Window.partitionBy(*keys).orderBy(F.col(name)).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy(F.col(name).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *keys, name,
        *[F.last(whole(n, "_l"), ignorenulls=True).over(back).alias(f"_cp_{n}") for n in values],
        *[F.last(whole(n, "_f"), ignorenulls=True).over(ahead).alias(f"_cn_{n}") for n in values],
    )
    part = Window.partitionBy(*keys, name)
    up = part.orderBy(*order.sorting()).rowsBetween(Window.unboundedPreceding, 0)
    down = part.orderBy(*order.sorting(descending=True)).rowsBetween(Window.unboundedPreceding, 0)
    inside = based.withColumns(
        {f"_p_{n}": F.last(f"_v_{n}", ignorenulls=True).over(up) for n in values}
        | {f"_n_{n}": F.last(f"_v_{n}", ignorenulls=True).over(down) for n in values}
    )
    return inside.join(carried, [*keys, name]).select(
        *df.columns,
        *[F.coalesce(f"_p_{n}", f"_cp_{n}").alias(f"prev_{n}") for n in values],
        *[F.coalesce(f"_n_{n}", f"_cn_{n}").alias(f"next_{n}") for n in values],
    )


# ---- order by value ------------------------------------------------------------------------

_FINE = 1024  # cells that an uneven cell is cut into
_PER_OCTAVE = 128


def _octave_cell(v: Column) -> Column:
    """A whole number that rises with the value: 128 cells from each power of two to the next, on either side of 0."""
    size = F.floor(F.least(F.log2(F.abs(v)), F.lit(1100.0)) * _PER_OCTAVE) + 150_000  # above 0 for the smallest double
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, size).otherwise(-size)


def value_borders(df: DataFrame, value: str, parts: int) -> list[float]:
    """At most ``parts - 1`` ascending borders between buckets of even size; a bucket of one value may be larger.

    Rows are counted by cells of value, combined where they are read. Where more than one bucket ends in a cell, its rows
    are counted again by finer cells within their range, until the range is one value; six rounds reach the last bit of a
    double. Each round is one narrow read; the driver sees cells at which a bucket ends, at most ``parts`` of them.
    """
    rows = df.select(F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    order = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # a bounded number of cells
    counts = rows.groupBy(_octave_cell(F.col("_v")).alias("_cell")).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))

    def ends(at: Column) -> Column:  # buckets that end within the first ``at`` rows
        return F.floor(at * parts / F.col("total"))
    cells = counts.filter(ends(F.col("before")) < ends(F.col("before") + F.col("n"))).orderBy("low").collect()
    total, borders = (cells[0]["total"] if cells else 0), set()
    for _ in range(7):
        wide = []
        for c in cells:
            if c["n"] * parts <= total or c["low"] == c["high"]:  # small, or one value: it is a bucket's beginning
                borders.add(c["low"])
            else:
                wide.append(c)
        if not wide:
            break
        splits = [float("-inf"), *(x for c in wide for x in (c["low"], math.nextafter(c["high"], math.inf))), float("inf")]
        ranges = df.sparkSession.createDataFrame([(float(2 * i + 1), c["low"], c["high"], c["before"]) for i, c in enumerate(wide)],
                                                 "_in double, _low double, _high double, _before long")
        inside = Bucketizer(splits=sorted(set(splits)), inputCol="_v", outputCol="_in").transform(rows).join(F.broadcast(ranges), "_in")
        half = F.col("_v") / 2 - F.col("_low") / 2, F.col("_high") / 2 - F.col("_low") / 2  # halves cannot overflow
        fine = F.least(F.floor(half[0] / half[1] * _FINE), F.lit(_FINE - 1))
        found = inside.groupBy("_in", "_before", fine.alias("_cell")).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        within = Window.partitionBy("_in").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # at most _FINE rows
        found = found.withColumn("before", F.col("_before") + F.coalesce(F.sum("n").over(within), F.lit(0))).withColumn("total", F.lit(total))
        cells = found.filter(ends(F.col("before")) < ends(F.col("before") + F.col("n"))).orderBy("low").collect()
    else:
        borders.update(c["low"] for c in cells)
    return sorted(borders)


def bucket_by_value(df: DataFrame, value: str, parts: int | None = None) -> DataFrame:
    """Add a value-ordered ``_bucket``; equal values share a bucket.

    Borders come from the data (at most ``parts`` numbers reach the driver), so buckets are even whatever the distribution.
    """
    parts = max(2, parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = [c for c in value_borders(df, value, parts) if math.isfinite(c)]
    if not cuts:
        return df.withColumn("_bucket", F.lit(0.0))
    return Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=value, outputCol="_bucket").transform(df)


def _buckets(df: DataFrame, value: str, by: Sequence[str], parts: int | None) -> DataFrame:
    clean = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    return bucket_by_value(clean, "_v", parts)


def _bucket_totals(bucketed: DataFrame, by: Sequence[str]) -> DataFrame:
    counts = bucketed.groupBy(*by, "_bucket").agg(F.count("*").alias("_in"))
    w = Window.partitionBy(*by)
    return counts.withColumns(
        {
            "_before": F.coalesce(
                F.sum("_in").over(w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
            "_n": F.sum("_in").over(w),
        }
    )


def _counted(bucketed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct values with their count and the count of smaller values in the same bucket."""
    w = Window.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    return (
        bucketed.groupBy(*by, "_bucket", "_v").agg(F.count("*").alias("_cnt"))
        .withColumn("_run", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    )


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """One row per group and distinct value: ``value``, ``n_equal``, ``n_below``, ``n_total``.

    The average rank of a value is ``n_below + (n_equal + 1) / 2``.
    """
    by = list(by)
    bucketed = _buckets(df, value, by, parts)
    joined = _counted(bucketed, by).join(_bucket_totals(bucketed, by), [*by, "_bucket"])
    return joined.select(
        *by,
        F.col("_v").alias(value),
        F.col("_cnt").alias("n_equal"),
        (F.col("_before") + F.col("_run")).alias("n_below"),
        F.col("_n").alias("n_total"),
    )


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), parts: int | None = None
) -> DataFrame:
    """Linearly interpolated quantiles, long form: ``by``, ``p``, ``q``. NULL values are ignored.

    A histogram over value buckets locates the wanted ranks; only rows of those buckets are
    counted by value and sorted. One pass more than a sort, but almost nothing is shuffled.
    """
    by = list(by)
    bucketed = _buckets(df, value, by, parts)
    position = F.col("p") * (F.col("_n") - 1)
    wanted = (
        _bucket_totals(bucketed, by)
        .withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumns({"_lo": F.floor(position), "_hi": F.ceil(position), "_pos": position})
        .filter(
            ((F.col("_lo") >= F.col("_before")) & (F.col("_lo") < F.col("_before") + F.col("_in")))
            | ((F.col("_hi") >= F.col("_before")) & (F.col("_hi") < F.col("_before") + F.col("_in")))
        )
    )
    chosen = bucketed.join(wanted.select(*by, "_bucket").distinct(), [*by, "_bucket"], "left_semi")
    below = F.col("_before") + F.col("_run")

    def at(rank: str) -> Column:
        hit = (F.col(rank) >= below) & (F.col(rank) < below + F.col("_cnt"))
        return F.max(F.when(hit, F.col("_v")))

    return (
        _counted(chosen, by).join(wanted, [*by, "_bucket"])
        .groupBy(*by, "p")
        .agg(at("_lo").alias("_a"), at("_hi").alias("_b"), F.first(F.col("_pos") - F.col("_lo")).alias("_frac"))
        .select(*by, "p", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_frac")).alias("q"))
    )


def quantile_columns(
    df: DataFrame, value: str, named: Mapping[str, float], by: Sequence[str] = (), parts: int | None = None
) -> DataFrame:
    """The same quantiles as columns, one row per group."""
    long = exact_quantiles(df, value, sorted(set(named.values())), by, parts)
    return long.groupBy(*by).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for n, p in named.items()])
