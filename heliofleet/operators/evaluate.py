"""Error metrics, segmentations and comparisons over long prediction tables.

Predictions are one long table (plant, timestamp, model, y_true, y_pred, ...); every table below
is one aggregation over it, whatever the number of models.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import scalar as S
from .chunks import PLANT_ORDER, Order, exact_quantiles
from .series import first_difference


def metric_columns(where: Column | None = None, suffix: str = "", scale: Column | float = 1.0,
                   actual: str = "y_true", predicted: str = "y_pred", bias: bool = False) -> list[Column]:
    """MAE, RMSE and R2 (and bias) as aggregates, optionally over a subset of the rows."""
    y, p = F.col(actual) * scale, F.col(predicted) * scale
    if where is not None:
        y, p = F.when(where, y), F.when(where, p)
    e = y - p
    sse, sst = F.sum(e * e), F.var_pop(y) * F.count(y)
    r2 = F.when(sst > 0, 1 - sse / sst).when(sse == 0, 1.0).when(sse > 0, 0.0)
    out = [F.avg(F.abs(e)).alias(f"MAE{suffix}"), F.sqrt(F.avg(e * e)).alias(f"RMSE{suffix}"), r2.alias(f"R2{suffix}")]
    return [*out, F.avg(e).alias(f"Bias{suffix}")] if bias else out


def producing(threshold: float = C.PRODUCING, actual: str = "y_true") -> Column:
    return F.col(actual) > threshold


def metrics(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return df.groupBy(*by).agg(*metric_columns(), F.count("*").alias("n"))


def metrics_producing(df: DataFrame, by: Sequence[str] = ("model",), threshold: float = C.PRODUCING,
                      check: bool = False) -> DataFrame:
    rows = df.filter(producing(threshold))
    if check and rows.isEmpty():
        raise ValueError("no producing rows to evaluate")
    return metrics(rows, by)


def summary_kw(df: DataFrame, nominal_kw: Column | float, by: Sequence[str] = ("model",)) -> DataFrame:
    """MAE, RMSE, R2 and bias in kW over all rows and, with ``_luz``, over producing rows."""
    return df.groupBy(*by).agg(
        *metric_columns(scale=nominal_kw, bias=True), *metric_columns(producing(), "_luz", nominal_kw, bias=True)
    )


def scope_frame(df: DataFrame, by: Sequence[str] = ("scenario", "model")) -> DataFrame:
    """Twelve metric columns: validation/test by global/producing, in one pass."""
    pieces: list[Column] = []
    for split in ("val", "test"):
        inside = F.col("split") == split
        pieces += metric_columns(inside, f"_{split}_global")
        pieces += metric_columns(inside & producing(), f"_{split}_day")
    return df.filter(F.col("split").isin("val", "test")).groupBy(*by).agg(*pieces)


def merge_scopes(df: DataFrame, by: Sequence[str] = ("model", "type")) -> DataFrame:
    """Global and producing-hours metrics side by side."""
    wide = df.groupBy(*by).agg(
        *metric_columns(None, "_global"), *metric_columns(producing(), "_day"),
        F.count_if(producing()).alias("_n_day"),
    )
    return wide.filter(F.col("_n_day") > 0).drop("_n_day")


def improvement_over(table: DataFrame, baseline: str, column: str = "RMSE_day", out: str = "mejora_vs_naive") -> DataFrame:
    """Baseline minus each row's metric; the baseline is a row of the same (small) table."""
    base = F.max(F.when(F.col("model") == baseline, F.col(column))).over(Window.partitionBy())
    return table.withColumn(out, base - F.col(column))


def relative_improvement(new: DataFrame, base: DataFrame, column: str = "RMSE") -> DataFrame:
    joined = new.join(base.select("model", F.col(column).alias(f"{column}_base")), "model", "left")
    gain = F.col(f"{column}_base") - F.col(column)
    return joined.withColumns({f"{column}_mejora": gain, f"{column}_mejora_pct": F.try_divide(gain, F.col(f"{column}_base")) * 100})


# ---- segments ------------------------------------------------------------------------------

def segment(df: DataFrame, by: Mapping[str, Column], drop_null: bool = True, error: str = "e_kw") -> DataFrame:
    """MAE, bias, deviation, RMSE and rows per segment; unlabelled rows are left out."""
    e = F.col(error)
    labelled = df.withColumns(dict(by))
    if drop_null:
        for name in by:
            labelled = labelled.filter(F.col(name).isNotNull())
    return labelled.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("MAE"), F.avg(e).alias("bias"), F.stddev_samp(e).alias("std"),
        F.sqrt(F.avg(e * e)).alias("RMSE"), F.count(e).alias("n"),
    )


def paired_segment(df: DataFrame, label: Column, name: str, relative: bool = False,
                   models: tuple[str, str] = ("lag", "nolag")) -> DataFrame:
    """MAE of two models per segment, from one row per reading (``error_*`` columns)."""
    pieces = [F.avg(f"error_{m}").alias(f"MAE_{m}") for m in models]
    if relative:
        pieces += [F.avg(f"error_rel_{m}").alias(f"MAE_rel_{m}") for m in models]
    return df.withColumn(name, label).filter(F.col(name).isNotNull()).groupBy(name).agg(
        *pieces, F.count("*").alias("n")
    )


def ramp_segment(df: DataFrame, actual: str = "y_true", order: Order = PLANT_ORDER,
                 models: tuple[str, str] = ("lag", "nolag")) -> DataFrame:
    """Errors on rising, falling and steady production; the step spans nights, as rows do."""
    stepped = first_difference(df, actual, "delta_power", order)
    return paired_segment(stepped, S.ramp(F.col("delta_power")), "ramp_type", models=models)


def melt_errors(wide: DataFrame, key: str, models: tuple[str, str] = ("lag", "nolag"),
                labels: Mapping[str, str] | None = None) -> DataFrame:
    long = wide.unpivot([key, "n"], [f"MAE_{m}" for m in models], "escenario", "MAE")
    if labels:
        long = long.withColumn("escenario", S.relabel(F.col("escenario"), labels))
    return long


def side_by_side(a: DataFrame, b: DataFrame, key: str, value: str, names: tuple[str, str]) -> DataFrame:
    """Two group series aligned on their key; a key of either side is kept."""
    return a.select(key, F.col(value).alias(names[0])).join(b.select(key, F.col(value).alias(names[1])), key, "full")


def pair_scenarios(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("lag", "nolag")) -> DataFrame:
    """Rows present in both scenarios, matched by plant and timestamp (not by row number)."""
    keys = [C.PLANT, C.TS]
    return a.withColumnRenamed("y_pred", f"y_pred_{names[0]}").join(
        b.select(*keys, F.col("y_pred").alias(f"y_pred_{names[1]}")), keys
    )


def common_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    keys = [C.PLANT, C.TS]
    return a.select(*keys).intersect(b.select(*keys))


def seasonal_metrics(df: DataFrame, by: Sequence[str] = ("model", "tipo", "estacion"), min_rows: int = 20) -> DataFrame:
    """Producing-hours metrics per season window; groups with too few rows are skipped."""
    return metrics(df.filter(producing()), by).filter(F.col("n") >= min_rows)


def variability(table: DataFrame, by: Sequence[str] = ("model", "tipo"), column: str = "RMSE") -> DataFrame:
    return table.groupBy(*by).agg(
        F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"),
        F.max(column).alias("max"),
    ).withColumn("rango", F.col("max") - F.col("min"))


def daily_error(df: DataFrame, positive_part: bool = True, by: Sequence[str] = ("model",)) -> DataFrame:
    term = S.daily_error_term(F.col("y_true"), F.col("y_pred"), positive_part)
    return df.groupBy(F.to_date(C.TS).alias("date"), *by).agg(F.avg(term).alias("mae_dia"))


def daily_residual(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """MAE, bias and rows per producing day."""
    return df.filter("is_daylight").groupBy(F.to_date(C.TS).alias("date"), *by).agg(
        F.avg("e_abs_kw").alias("MAE_kw"), F.avg("e_kw").alias("bias_kw"), F.count("e_kw").alias("n")
    )


def daily_digest(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and worst daily MAE, the (first) worst day, and days with positive bias."""
    return daily.groupBy(*by).agg(
        F.avg("MAE_kw").alias("mean_mae"), F.max("MAE_kw").alias("max_mae"),
        F.max_by("date", F.struct(F.col("MAE_kw"), -F.unix_date("date"))).alias("worst_day"),
        F.count_if(F.col("bias_kw") > 0).alias("positive_days"), F.count("*").alias("days"),
    )


def season_residuals(df: DataFrame) -> DataFrame:
    """Residual statistics of all four seasons; seasons without data stay as empty rows."""
    stats = segment(df.filter("is_daylight"), {"season": S.season(F.col(C.TS))})
    names = F.array(*[F.struct(F.lit(i + 1).alias("season_order"), F.lit(s).alias("season"))
                      for i, s in enumerate(C.SEASONS)])
    order = df.sparkSession.range(1).select(F.inline(names))
    return order.join(stats, "season", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def extreme_seasons(stats: DataFrame) -> DataFrame:
    known = F.col("MAE").isNotNull()
    return stats.agg(
        F.max_by("season", F.when(known, F.struct(F.col("MAE"), -F.col("season_order")))).alias("worst"),
        F.min_by("season", F.when(known, F.struct("MAE", "season_order"))).alias("best"),
    )


def box_statistics(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Median, quartiles, whiskers (furthest values within 1.5 IQR) and outliers per group."""
    by = list(by)
    q = exact_quantiles(df, column, (0.25, 0.5, 0.75), by).groupBy(*by).agg(
        *[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    )
    iqr = F.col("q3") - F.col("q1")
    fenced = df.filter(F.col(column).isNotNull()).join(
        q.withColumns({"_lo": F.col("q1") - 1.5 * iqr, "_hi": F.col("q3") + 1.5 * iqr}), by
    )
    v = F.col(column)
    inside = (v >= F.col("_lo")) & (v <= F.col("_hi"))
    return fenced.groupBy(*by).agg(
        F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"), F.count("*").alias("n"),
    )


def exceedance(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of producing rows with more than 1 and 2 kW of error, mean relative error."""
    return df.filter("is_daylight").groupBy(*by).agg(
        F.avg((F.col("e_abs_kw") > 1).cast("double")).alias("share_over_1kw"),
        F.avg((F.col("e_abs_kw") > 2).cast("double")).alias("share_over_2kw"),
        F.avg("e_rel").alias("mean_e_rel"),
    )


# ---- horizons ------------------------------------------------------------------------------

def degradation(table: DataFrame) -> DataFrame:
    """Change of RMSE and MAE against the first horizon of the same model, in percent."""
    base = table.filter(F.col("horizon_steps") == 1).select(
        "model", F.col("RMSE_luz").alias("RMSE_h1"), F.col("MAE_luz").alias("MAE_h1")
    )
    return table.join(base, "model", "left").withColumns({
        f"{m}_degradacion_pct": F.try_divide(F.col(f"{m}_luz") - F.col(f"{m}_h1"), F.col(f"{m}_h1")) * 100 for m in ("RMSE", "MAE")
    })


def pivot_horizons(table: DataFrame, horizons: Sequence[int], value: str = "RMSE_degradacion_pct") -> DataFrame:
    return table.groupBy("model").pivot("horizon_steps", list(horizons)).agg(F.avg(value)).select(
        "model", *[F.col(str(h)).alias(f"h{h}") for h in horizons]
    )


def robustness(table: DataFrame) -> DataFrame:
    return table.filter(F.col("horizon_steps") > 1).groupBy("model").agg(
        F.avg("RMSE_degradacion_pct").alias("degradacion_media_pct")
    )


def horizon_steps_delta(table: DataFrame) -> DataFrame:
    """RMSE change between consecutive horizons (a few rows per model)."""
    w = Window.partitionBy("model").orderBy("horizon_steps")
    return table.withColumn("delta_RMSE", F.col("RMSE_luz") - F.lag("RMSE_luz").over(w))


def best_model(table: DataFrame, by: Sequence[str] = (), column: str = "RMSE") -> DataFrame:
    return table.groupBy(*by).agg(
        F.min_by("model", F.struct(column, "model")).alias("best_model"), F.min(column).alias(f"best_{column}")
    )


def ranked_table(table: DataFrame, column: str, by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """A result table (a few rows per model) in order of a metric, with the position spelled out."""
    metric = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    w = Window.partitionBy(*by).orderBy(metric, "model")
    return table.withColumn("position", F.row_number().over(w)).orderBy(*by, "position")


def top_features(importances: DataFrame, k: int = 10, by: str = "horizon_steps") -> DataFrame:
    """The ``k`` largest shares per horizon (one row per feature and horizon goes in)."""
    w = Window.partitionBy(by).orderBy(F.desc("importance"), "feature")
    return importances.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def tracked_features(importances: DataFrame, features: Sequence[str] = C.TRACKED_FEATURES) -> DataFrame:
    """Shares of chosen features at every horizon, with the change against the first horizon."""
    w = Window.partitionBy("feature").orderBy("horizon_steps")  # a row per horizon
    return importances.filter(F.col("feature").isin(*features)).withColumn("change", F.col("importance") - F.first("importance").over(w))


def prediction_export(df: DataFrame) -> DataFrame:
    """Prediction rows as they are stored: error = predicted - real."""
    return df.withColumns(S.exported_error(F.col("y_true"), F.col("y_pred")))
