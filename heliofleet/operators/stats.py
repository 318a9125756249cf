"""Residual statistics: distribution, normality, dependence, trend. All per group where asked."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions.aggregates import correlation
from ..functions.special import chi2_tail, chi2_tail_of, normal_pdf, normal_quantile, two_sided_normal
from ..session import cut_lineage
from .chunks import (
    PLANT_ORDER, Order, bucket_by_value, exact_quantiles, halo_window, join_ranked, value_ranks, with_scalars,
)


def _attach(df: DataFrame, summary: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.join(summary, list(by)) if by else with_scalars(df, summary)


def _spread(bounds: DataFrame, low: str, high: str) -> DataFrame:
    """A range of one value becomes half a unit to either side."""
    half = F.when(F.col(high) > F.col(low), 0.0).otherwise(0.5)
    return bounds.withColumns({low: F.col(low) - half, high: F.col(high) + half})


# ---- distribution --------------------------------------------------------------------------

def histogram(df: DataFrame, column: str, bins: int = 80, by: Sequence[str] = ()) -> DataFrame:
    """Equal bins over [min, max] of each group, last bin right-closed; count and density.

    A group of one constant value has its bins over half a unit to either side of it.
    """
    by = list(by)
    v = F.col(column)
    bounds = _spread(df.groupBy(*by).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count(v).alias("_n")), "_lo", "_hi")
    width = (F.col("_hi") - F.col("_lo")) / bins
    index = F.least(F.floor((v - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    binned = _attach(df.filter(v.isNotNull()), bounds, by)
    counts = binned.groupBy(*by, index.alias("bin"), "_lo", "_hi", "_n").agg(F.count("*").alias("n"))
    return counts.select(
        *by, "bin", (F.col("_lo") + F.col("bin") * width).alias("left"), "n",
        (F.col("n") / (F.col("_n") * width)).alias("density"),
    )


def hexagon_counts(df: DataFrame, x: str, y: str, cells: int = 40, by: Sequence[str] = ()) -> DataFrame:
    """Rows per hexagonal cell: the nearer centre of two offset lattices over the data range."""
    by = list(by)
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ny = int(cells / math.sqrt(3))
    bounds = rows.groupBy(*by).agg(
        F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1")
    )
    bounds = _spread(_spread(bounds, "_x0", "_x1"), "_y0", "_y1")
    sx, sy = (F.col("_x1") - F.col("_x0")) / cells, (F.col("_y1") - F.col("_y0")) / ny
    u, v = (F.col(x) - F.col("_x0")) / sx, (F.col(y) - F.col("_y0")) / sy
    i1, j1, i2, j2 = F.round(u), F.round(v), F.floor(u), F.floor(v)
    d1 = (u - i1) * (u - i1) + 3 * (v - j1) * (v - j1)
    d2 = (u - i2 - 0.5) * (u - i2 - 0.5) + 3 * (v - j2 - 0.5) * (v - j2 - 0.5)
    main = d1 < d2
    cell_x = F.when(main, i1.cast("double")).otherwise(i2 + 0.5)
    cell_y = F.when(main, j1.cast("double")).otherwise(j2 + 0.5)
    return _attach(rows, bounds, by).groupBy(
        *by, (F.col("_x0") + cell_x * sx).alias("cx"), (F.col("_y0") + cell_y * sy).alias("cy")
    ).agg(F.count("*").alias("n"))


def normal_curve(df: DataFrame, column: str, points: int = 200, by: Sequence[str] = ()) -> DataFrame:
    """Density of the fitted normal at equidistant points over the data range."""
    v = F.col(column)
    fit = df.groupBy(*by).agg(
        F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.avg(v).alias("_mu"), F.stddev_pop(v).alias("_sd")
    )
    x = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("i") / (points - 1)
    grid = fit.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", x)
    return grid.select(*by, "i", "x", normal_pdf(F.col("x"), F.col("_mu"), F.col("_sd")).alias("pdf"))


def moments(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Population skewness and excess kurtosis, with n, mean and population deviation."""
    return df.groupBy(*by).agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"),
        F.skewness(column).alias("skewness"), F.kurtosis(column).alias("kurtosis"),
    )


def dagostino(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """D'Agostino-Pearson omnibus test from the two moments (needs n >= 8)."""
    m = moments(df, column, by).filter(F.col("n") >= 8)
    n, g1, g2 = F.col("n").cast("double"), F.col("skewness"), F.col("kurtosis")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    ratio = y / F.sqrt(2 / (w2 - 1))
    z_skew = F.ln(ratio + F.sqrt(ratio * ratio + 1)) / F.sqrt(0.5 * F.ln(w2))
    mean_b2 = 3 * (n - 1) / (n + 1)
    var_b2 = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - mean_b2) / F.sqrt(var_b2)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    inner = F.try_divide(1 - 2 / a, 1 + x * F.sqrt(2 / (a - 4)))
    z_kurt = (1 - 2 / (9 * a) - F.signum(inner) * F.cbrt(F.abs(inner))) / F.sqrt(2 / (9 * a))
    k2 = z_skew * z_skew + z_kurt * z_kurt
    return m.select(*by, "n", z_skew.alias("z_skew"), z_kurt.alias("z_kurt"), k2.alias("K2"), F.exp(-k2 / 2).alias("p_value"))


def kolmogorov_smirnov(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Distance of the standardised values from the standard normal, and its asymptotic p-value.

    The empirical distribution function comes from the distributed value ranks, so any number of
    groups is tested at once.
    """
    by = list(by)
    ranks = value_ranks(df, column, by)
    fit = df.groupBy(*by).agg(F.avg(column).alias("_mu"), F.stddev_pop(column).alias("_sd"))
    z = F.try_divide(F.col(column) - F.col("_mu"), F.col("_sd"))  # a constant group keeps its row, without a statistic
    placed = _attach(ranks, fit, by).withColumn("_z", z).withColumn("_tail", two_sided_normal(F.col("_z")) / 2)
    placed = placed.withColumn("_cdf", F.when(F.col("_z") < 0, F.col("_tail")).otherwise(1 - F.col("_tail")))
    n, cdf = F.col("n_total"), F.col("_cdf")
    gap = F.when(cdf.isNotNull(), F.greatest(F.abs((F.col("n_below") + F.col("n_equal")) / n - cdf), F.abs(cdf - F.col("n_below") / n)))
    d = placed.groupBy(*by).agg(
        F.max(gap).alias("statistic"), F.max(n).alias("n")
    )
    root = F.sqrt(F.col("n").cast("double"))
    lam = (root + 0.12 + 0.11 / root) * F.col("statistic")
    series = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 41)), F.lit(0.0))
    p = F.when(lam < 0.2, 1.0).when(lam.isNull(), F.lit(None)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))
    return d.withColumn("p_value", p)


# ---- ranks ---------------------------------------------------------------------------------

def qq_points(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Ordered values against normal medians, one row per run of equal values.

    A run of ties covers consecutive plotting positions; the row carries its first and last score.
    """
    ranks = value_ranks(df, column, by)
    n = F.col("n_total").cast("double")

    def median(i: Column) -> Column:
        top = F.pow(F.lit(0.5), 1 / n)
        m = F.when(i == 1, 1 - top).when(i == n, top).otherwise((i - 0.3175) / (n + 0.365))
        return normal_quantile(m)

    first = (F.col("n_below") + 1).cast("double")
    last = (F.col("n_below") + F.col("n_equal")).cast("double")
    return ranks.withColumns({"score_first": median(first), "score_last": median(last)})


def _expand_scores(df: DataFrame, column: str, by: Sequence[str], per: int = 10_000) -> DataFrame:
    """One row per observation with its normal score, ties unfolded in bounded slices."""
    ranks = value_ranks(df, column, by)
    n = F.col("n_total").cast("double")
    slices = ranks.withColumn("_slice", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("n_equal") - 1) / per)
    )))
    start = F.col("_slice") * per
    stop = F.least(start + per, F.col("n_equal")) - 1
    rows = slices.repartition(*by, column, "_slice").withColumn("_k", F.explode(F.sequence(start, stop)))
    i = (F.col("n_below") + F.col("_k") + 1).cast("double")
    top = F.pow(F.lit(0.5), 1 / n)
    m = F.when(i == 1, 1 - top).when(i == n, top).otherwise((i - 0.3175) / (n + 0.365))
    return rows.select(*by, F.col(column), normal_quantile(m).alias("score"))


def qq_fit(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Line through the Q-Q points: slope, intercept, R, and Shapiro-Francia W' = R squared."""
    scores = _expand_scores(df, column, by)
    r = correlation("score", column)
    return scores.groupBy(*by).agg(
        F.regr_slope(column, "score").alias("slope"), F.regr_intercept(column, "score").alias("intercept"),
        r.alias("r"), (r * r).alias("w_francia"), F.count("*").alias("n"),
    )


def average_ranks(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Value to average rank (ties share the mean of their positions)."""
    ranks = value_ranks(df, column, by)
    return ranks.select(*by, column, "n_equal", (F.col("n_below") + (F.col("n_equal") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation; pairs are counted by value before the ranks are joined on."""
    by = list(by)
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    counted = pairs.groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_w"))
    rx = average_ranks(pairs, x, by).select(*by, F.col(x).alias("_x"), F.col("rank").alias("_rx"), "n_equal")
    ry = average_ranks(pairs, y, by).select(*by, F.col(y).alias("_y"), F.col("rank").alias("_ry"), "n_equal")
    joined = join_ranked(counted, rx, [*by, "_x"], "n_equal").drop("n_equal")
    joined = join_ranked(joined, ry, [*by, "_y"], "n_equal").drop("n_equal")
    w, a, b = F.col("_w").cast("double"), F.col("_rx"), F.col("_ry")
    # Ranks are centred on (n + 1) / 2, their known mean, so the sums stay well conditioned.
    n_rows = pairs.groupBy(*by).agg(((F.count("*") + 1) / 2).alias("_mid"))
    a, b = a - F.col("_mid"), b - F.col("_mid")
    return _attach(joined, n_rows, by).groupBy(*by).agg(
        F.try_divide(F.sum(w * a * b), F.sqrt(F.sum(w * a * a) * F.sum(w * b * b))).alias("spearman_rho"),
        F.sum("_w").alias("n"),
    )


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation with its two-sided p-value.

    The t statistic with n - 2 degrees is turned into a normal deviate by Wallace's formula.
    """
    out = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(
        correlation(x, y).alias("pearson_r"), F.count("*").alias("n")
    )
    r = F.col("pearson_r")
    degrees = (F.col("n") - 2).cast("double")
    z = (8 * degrees + 1) / (8 * degrees + 3) * F.sqrt(-degrees * F.ln(1 - r * r))
    p = F.when((degrees > 0) & (F.abs(r) < 1), two_sided_normal(z)).when((degrees > 0) & r.isNotNull(), 0.0)
    return out.withColumn("p_value", p)


def driver_correlations(df: DataFrame, target: str, drivers: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson and Spearman of a residual against several drivers, one row each.

    The drivers are stacked, so one set of passes ranks them all; those passes read the narrow
    stacked table, which is written once.
    """
    by = list(by)
    complete = df.select(*dict.fromkeys([*by, target, *drivers])).dropna(subset=[target, *drivers])
    pairs = F.array(*[F.struct(F.lit(d).alias("driver"), F.col(d).cast("double").alias("_driver")) for d in drivers])
    long = cut_lineage(complete.select(*by, F.col(target).alias("_target"), F.inline(pairs)))
    keys = [*by, "driver"]
    return pearson(long, "_driver", "_target", keys).join(spearman(long, "_driver", "_target", keys).drop("n"), keys)


def kruskal_wallis(df: DataFrame, column: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """H with tie correction over at least two groups; chi-square p-value with k - 1 degrees."""
    by = list(by)
    rows = df.filter(F.col(column).isNotNull() & F.col(group).isNotNull())
    counted = rows.groupBy(*by, group, column).agg(F.count("*").alias("_w"))
    ranks = average_ranks(rows, column, by)
    sums = counted.join(ranks, [*by, column]).groupBy(*by, group).agg(
        F.sum(F.col("_w") * F.col("rank")).alias("_r"), F.sum("_w").alias("_n")
    )
    ties = ranks.groupBy(*by).agg(F.sum(F.pow(F.col("n_equal").cast("double"), 3) - F.col("n_equal")).alias("_ties"))
    n = F.col("n").cast("double")
    total = sums.groupBy(*by).agg(
        F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_q"), F.sum("_n").alias("n"), F.count("*").alias("k")
    ).filter(F.col("k") >= 2)
    h = F.try_divide(12 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1), 1 - F.try_divide(F.col("_ties"), n * n * n - n))
    out = _attach(total, ties, by).select(*by, "n", "k", h.alias("H"))
    return out.withColumn("p_value", chi2_tail_of(F.col("H"), F.col("k") - 1))


# ---- dependence ----------------------------------------------------------------------------

def autocorrelation(df: DataFrame, column: str, lags: int = 48, order: Order = PLANT_ORDER) -> DataFrame:
    """Autocorrelation at lags 0..``lags`` (denominator n) with the Bartlett 95 % band.

    Row blocks with a halo of ``lags`` rows give lagged products, and the sums of their two factors, in one aggregate per series;
    the mean is taken out of the sums afterwards. Values are counted from one of them, so that a large mean costs no digits.
    """
    keys = list(order.keys)
    rows = df.filter(F.col(column).isNotNull()).select(*keys, order.time, *order.ties, column)
    e = with_scalars(rows, rows.select(F.col(column).alias("_at"))).withColumn("_e", F.col(column) - F.col("_at"))
    shifted = halo_window(e, {f"_l{k}": (lambda w, k=k: F.lag("_e", k).over(w)) for k in range(1, lags + 1)},
                          lags, order=order).withColumn("_l0", F.col("_e"))
    sums = shifted.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("_e").alias("_mu"), F.max("_e").alias("_hi"), F.min("_e").alias("_lo"),
        *[c for k in range(lags + 1) for c in (
            F.sum(F.col("_e") * F.col(f"_l{k}")).alias(f"_p{k}"),
            F.sum(F.when(F.col(f"_l{k}").isNotNull(), F.col("_e") + F.col(f"_l{k}"))).alias(f"_f{k}"), F.count(f"_l{k}").alias(f"_n{k}"))])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.coalesce(
        F.col(f"_p{k}") - F.col("_mu") * F.col(f"_f{k}") + F.col(f"_n{k}") * F.col("_mu") * F.col("_mu"), F.lit(0.0)).alias("_s")) for k in range(lags + 1)])
    spread = F.when(F.col("_hi") > F.col("_lo"), F.col("_p0") - F.col("n") * F.col("_mu") * F.col("_mu"))
    long = sums.select(*keys, "n", spread.alias("_c0"), F.inline(pairs))
    return long.select(  # a constant series has no correlation, but keeps its rows
        *keys, "lag", "n", F.try_divide("_s", "_c0").alias("acf"),
        (1.959963984540054 / F.sqrt(F.col("n").cast("double"))).alias("band"),
    )


def significant_lags(acf: DataFrame, keys: Sequence[str] = (C.PLANT,)) -> DataFrame:
    """Per series: lags above 0 whose autocorrelation leaves the band, of how many, and the last of them."""
    outside = F.abs("acf") > F.col("band")
    return acf.filter(F.col("lag") > 0).groupBy(*keys).agg(
        F.count_if(outside).alias("n_significant"), F.count("*").alias("n_lags"), F.max(F.when(outside, F.col("lag"))).alias("last_significant"))


def ljung_box(acf: DataFrame, tests: Sequence[int] = (1, 4, 8, 16, 24, 48), keys: Sequence[str] = (C.PLANT,)) -> DataFrame:
    """Q and p-value at several lags from the autocorrelation table."""
    keys = list(keys)
    n, k, r = F.col("n").cast("double"), F.col("lag"), F.col("acf")
    term = F.try_divide(r * r, n - k)
    wide = acf.filter(k > 0).groupBy(*keys, "n").agg(*[F.sum(F.when(k <= m, term)).alias(f"_q{m}") for m in tests])
    rows = F.array(*[
        F.struct(F.lit(m).alias("lag"), (n * (n + 2) * F.col(f"_q{m}")).alias("Q")) for m in tests
    ])
    p = F.when(F.lit(False), F.lit(None).cast("double"))
    for m in tests:
        p = p.when(F.col("lag") == m, chi2_tail(F.col("Q"), m))
    return wide.select(*keys, "n", F.inline(rows)).withColumn("p_value", p)


def lowess_grid(df: DataFrame, x: str, y: str, points: int = 50, frac: float = 0.3, by: Sequence[str] = (),
                passes: int = 0, closed: bool = True) -> DataFrame:
    """Local linear trend with tricube weights, evaluated on an even grid.

    Readings are first combined by distinct ``x`` (count, sums) and written; every pass after that
    reads distinct values. Bandwidth of a grid point: exact distance of its ceil(frac n)-th nearest row.

    Where many rows share a value, no row may be nearer to a grid point than its bandwidth. ``closed`` windows then hold
    the rows at that distance, alike, and every group has all its points; open ones are empty, and their points are left out.
    Rows of a single value have no slope: the trend is their mean.

    Each of ``passes`` weighs rows down by their residual r against the trend between grid points: (1 - (r / 6 m)^2)^2 below
    6 m and 0 above, m the exact median of |r| in the group; with m = 0 only rows on the trend count. A grid point left
    without weight keeps its trend of the pass before. With open windows a row beside a left-out grid point has no residual and
    takes no part from there on, and a point left without weight is NaN.
    """
    by = list(by)
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    if passes:
        rows = cut_lineage(rows)
    spots = cut_lineage(rows.groupBy(*by, "_x").agg(F.count("*").alias("_w"), F.sum("_y").alias("_sy")))
    bounds = spots.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.sum("_w").alias("_n"))
    at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("i") / (points - 1)
    grid = bounds.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(
        *by, "i", at.alias("x"), "_n"
    )
    # Fifty rows per group; without groups the grid is those fifty rows and is broadcast.
    far = spots.join(grid, by) if by else spots.crossJoin(F.broadcast(grid))
    near = nearest_distance(far.select(*by, "i", "_n", F.abs(F.col("_x") - F.col("x")).alias("_d"), "_w"), [*by, "i"], frac)
    reach = grid.join(near, [*by, "i"]).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", "x", "_h", "_nearer"))).alias("_grid"))
    reach = cut_lineage(reach) if passes else reach
    trend = _local_lines(spots, reach, by, closed)
    for _ in range(passes):
        before = cut_lineage(trend)
        weighed = _bisquare(rows, before, bounds, points, by)
        spots = cut_lineage(weighed.groupBy(*by, "_x").agg(F.sum("_r").alias("_w"), F.sum(F.col("_r") * F.col("_y")).alias("_sy")))
        if closed:
            now = _local_lines(spots.filter("_w > 0"), reach, by, closed).select(*by, "i", F.col("trend").alias("_now"))
            trend = before.join(now, [*by, "i"], "left").select(*by, "i", "x", F.coalesce("_now", "trend").alias("trend"))
        else:
            trend = _local_lines(spots, reach, by, closed).withColumn("trend", F.coalesce("trend", F.lit(math.nan)))
    return trend


def _local_lines(spots: DataFrame, reach: DataFrame, by: Sequence[str], closed: bool) -> DataFrame:
    """Weighted line at every grid point from the spots within its bandwidth; a spot is copied to the points that see it only."""
    def sees(g: Column) -> Column:
        d = F.abs(F.col("_x") - g["x"])
        return (d < g["_h"]) | ((g["_nearer"] == 0) & (d == g["_h"])) if closed else d < g["_h"]
    local = _attach(spots, reach, by).withColumn("_g", F.explode(F.filter("_grid", sees))).select(
        *by, "_x", "_w", "_sy", F.col("_g.i").alias("i"), F.col("_g.x").alias("x"), F.col("_g._h").alias("_h"))
    dx = F.col("_x") - F.col("x")
    u = F.when(F.col("_h") > 0, F.abs(dx) / F.col("_h")).otherwise(0.0)
    tri = F.greatest(F.pow(1 - u * u * u, 3), F.lit(1e-60))  # rows at the bandwidth itself weigh alike
    k = tri * F.col("_w")
    sums = local.groupBy(*by, "i", "x").agg(
        F.sum(k).alias("s0"), F.sum(k * dx).alias("s1"), F.sum(k * dx * dx).alias("s2"),
        F.sum(tri * F.col("_sy")).alias("t0"), F.sum(tri * F.col("_sy") * dx).alias("t1"),
    )
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    line = (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / det
    fit = F.when(det > 1e-12 * F.col("s0") * F.col("s2"), line).otherwise(F.try_divide("t0", "s0"))
    return sums.select(*by, "i", "x", fit.alias("trend"))


def _bisquare(rows: DataFrame, trend: DataFrame, bounds: DataFrame, points: int, by: Sequence[str]) -> DataFrame:
    """``_r``: robustness weight of a row against the trend, linear between grid points; rows beside a point without trend are left out."""
    lines = trend.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("i", "trend"))).alias("_m")).select(
        *by, F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.try_element_at("_m", i)).alias("_t"))
    lines = _attach(lines, bounds.select(*by, "_lo", "_hi"), by)
    step = (F.col("_hi") - F.col("_lo")) / (points - 1)
    at = F.when(step > 0, (F.col("_x") - F.col("_lo")) / step).otherwise(0.0)
    placed = _attach(rows, lines, by).withColumn("_at", at).withColumn("_k", F.least(F.floor("_at").cast("int"), F.lit(points - 2)))
    low, high = F.col("_t")[F.col("_k")], F.col("_t")[F.col("_k") + 1]
    distance = F.nanvl(F.abs(F.col("_y") - (low + (high - low) * (F.col("_at") - F.col("_k")))), F.lit(math.inf))
    left = cut_lineage(placed.select(*by, "_x", "_y", distance.alias("_e")).filter("_e IS NOT NULL"))
    middle = exact_quantiles(left, "_e", (0.5,), by).select(*by, (6 * F.col("q")).alias("_six"))
    u = F.col("_e") / F.col("_six")
    weight = F.when(F.col("_six") == 0, (F.col("_e") == 0).cast("double")).when(F.col("_e") < F.col("_six"), F.pow(1 - u * u, 2)).otherwise(0.0)
    return _attach(left, middle, by).select(*by, "_x", "_y", weight.alias("_r"))


def nearest_distance(weighted: DataFrame, by: Sequence[str], frac: float) -> DataFrame:
    """``_h`` per group: smallest distance that covers ceil(frac * n) weighted rows; ``_nearer``: rows at smaller ones.

    Counts per distance bucket find the bucket the rank falls into; only that one is ordered.
    """
    by = list(by)
    bucketed = bucket_by_value(weighted, "_d")
    counts = bucketed.groupBy(*by, "_bucket", "_n").agg(F.sum("_w").alias("_c"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.ceil(F.col("_n") * frac)
    hit = counts.withColumn("_below", F.coalesce(F.sum("_c").over(earlier), F.lit(0))).filter(
        (F.col("_below") < rank) & (F.col("_below") + F.col("_c") >= rank)
    ).select(*by, "_bucket", "_below", rank.alias("_rank"))
    inside = bucketed.join(hit, [*by, "_bucket"]).groupBy(*by, "_bucket", "_d", "_below", "_rank").agg(
        F.sum("_w").alias("_w")
    )
    run = Window.partitionBy(*by, "_bucket").orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    return inside.withColumn("_cum", F.col("_below") + F.sum("_w").over(run)).filter(
        F.col("_cum") >= F.col("_rank")
    ).groupBy(*by).agg(F.min("_d").alias("_h"), F.min_by(F.col("_cum") - F.col("_w"), "_d").alias("_nearer"))


def percentiles(df: DataFrame, column: str, probs: Sequence[float] = (0.01, 0.99), by: Sequence[str] = ()) -> DataFrame:
    return exact_quantiles(df, column, probs, by)


def hash_sample(df: DataFrame, keys: Sequence[str], n: int = 5000, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same ones whatever the partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)
