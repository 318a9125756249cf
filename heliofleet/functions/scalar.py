"""Column expressions: coercion, calendar, labels, residual arithmetic. No shuffle anywhere."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contracts as C


# ---- coercion -----------------------------------------------------------------------------

def to_number(c: Column) -> Column:
    """Text to DOUBLE; anything unreadable, NaN or infinite becomes NULL."""
    return finite(c.try_cast("double"))


def to_timestamp(c: Column, formats: Sequence[str] = ()) -> Column:
    """First format that parses wins; none parses gives NULL. No format: ISO text."""
    if not formats:
        return c.try_cast("timestamp_ntz")
    tries = [F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return tries[0] if len(tries) == 1 else F.coalesce(*tries)


def strip_null_marker(c: Column, marker: str = "\\N") -> Column:
    """A cell that contains the marker anywhere is NULL."""
    return F.when(~c.contains(marker), c)


def finite(c: Column) -> Column:
    """NaN and both infinities become NULL (NaN compares as greater than infinity in Spark)."""
    return F.when(F.abs(c) < float("inf"), c)


def strip_suffix_unit(c: Column, unit: str = " w/m²") -> Column:
    return F.trim(F.replace(c, F.lit(unit), F.lit("")))


def strip_unit_after_space(c: Column) -> Column:
    """Cut the text at its first whitespace character."""
    return F.regexp_replace(c, r"\s[\s\S]*", "")


def join_date_time(date: Column, time: Column) -> Column:
    return F.when(date.isNotNull() & time.isNotNull(), F.concat_ws(" ", F.trim(date), F.trim(time)))


def fahrenheit_to_celsius(c: Column) -> Column:
    return (c - 32) * 5.0 / 9.0


# ---- calendar -----------------------------------------------------------------------------

def calendar(ts: Column) -> dict[str, Column]:
    """Six integer calendar fields; Monday is weekday 0."""
    return {
        "day_of_year": F.dayofyear(ts).cast("int"),
        "hour": F.hour(ts).cast("int"),
        "minute": F.minute(ts).cast("int"),
        "month": F.month(ts).cast("int"),
        "weekday": F.weekday(ts).cast("int"),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"),
    }


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * F.lit(2.0) * F.pi() / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def cyclic_calendar(ts: Column, fractional_hour: bool = True) -> dict[str, Column]:
    """Sine and cosine of day and hour; the raw stage uses the whole hour only."""
    hour = F.hour(ts).cast("double")
    if fractional_hour:
        hour = hour + F.minute(ts) / F.lit(60.0)
    sin_day, cos_day = cyclic(F.dayofyear(ts).cast("double"), 365)
    sin_hour, cos_hour = cyclic(hour, 24)
    return {"sin_day": sin_day, "cos_day": cos_day, "sin_hour": sin_hour, "cos_hour": cos_hour}


def season(ts: Column) -> Column:
    month = F.month(ts)
    winter, spring, summer, autumn = C.SEASONS
    return (
        F.when(month.isNull(), F.lit(None))
        .when(month.isin(12, 1, 2), winter)
        .when(month.isin(3, 4, 5), spring)
        .when(month.isin(6, 7, 8), summer)
        .otherwise(autumn)
    )


def ordinal(label: Column, order: Sequence[str]) -> Column:
    """1-based position of a label in its category order; NULL when it is not one of them."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), label), F.lit(0)).cast("int")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


# ---- physics and labels -------------------------------------------------------------------

def daylight(radiation: Column, threshold: float = C.DAYLIGHT_RADIATION) -> Column:
    return (F.coalesce(radiation, F.lit(0.0)) > threshold).cast("int")


def interactions(radiation: Column, temperature: Column) -> dict[str, Column]:
    return {"radiation_x_temp": radiation * temperature, "radiation_sq": radiation * radiation}


def regime(radiation: Column) -> Column:
    """Irradiance regime; a NULL reading falls through to the last class."""
    night, low, mid, high = C.REGIMES
    return F.when(radiation < 10, night).when(radiation < 200, low).when(radiation < 600, mid).otherwise(high)


def one_hot(label: Column, categories: Sequence[str], prefix: str, drop_first: bool = False) -> dict[str, Column]:
    """0/1 columns for a declared category list, alphabetical for ``drop_first``."""
    names = sorted(categories)[1:] if drop_first else list(categories)
    return {f"{prefix}_{n}": F.coalesce((label == n).cast("int"), F.lit(0)) for n in names}


def right_closed_band(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval ``(lo, hi]`` that holds the value; NULL outside all of them."""
    band = F.when(c <= edges[0], F.lit(None))
    for hi, label in zip(edges[1:], labels, strict=True):
        band = band.when(c <= hi, label)
    return band


def irradiance_band(c: Column) -> Column:
    return right_closed_band(c, C.IRRADIANCE_EDGES, C.IRRADIANCE_LABELS)


def production_band(c: Column) -> Column:
    return right_closed_band(c, C.PRODUCTION_EDGES, C.PRODUCTION_LABELS)


def ramp(delta: Column, threshold: float = 0.05) -> Column:
    """Rise, fall or steady; an unknown step counts as steady."""
    down, steady, up = C.RAMPS
    return F.when(delta > threshold, up).when(delta < -threshold, down).otherwise(steady)


def clip(c: Column, lower: Column | float | None = None, upper: Column | float | None = None) -> Column:
    """Bounds that leave NULL alone (``greatest`` would replace it by the bound)."""
    out = c
    if lower is not None:
        lo = lower if isinstance(lower, Column) else F.lit(float(lower))
        out = F.when(c < lo, lo).otherwise(out)
    if upper is not None:
        hi = upper if isinstance(upper, Column) else F.lit(float(upper))
        out = F.when(c > hi, hi).otherwise(out)
    return out


def relabel(c: Column, mapping: Mapping[str, str]) -> Column:
    """Mapped label; a value without an entry becomes NULL."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for source, target in mapping.items():
        out = out.when(c == source, target)
    return out


def file_safe(c: Column, prefix: str = "rad_") -> Column:
    """Drop a leading prefix and turn spaces into underscores."""
    return F.replace(F.regexp_replace(c, "^" + prefix, ""), F.lit(" "), F.lit("_"))


# ---- residuals ----------------------------------------------------------------------------

def residuals(actual: Column, predicted: Column, nominal_kw: Column | float) -> dict[str, Column]:
    """Residual real - predicted in p.u. and kW; relative error on producing rows only."""
    nominal = nominal_kw if isinstance(nominal_kw, Column) else F.lit(float(nominal_kw))
    e = actual - predicted
    producing = actual > C.PRODUCING_RESIDUAL
    return {
        "e_pu": e,
        "e_kw": e * nominal,
        "e_abs_kw": F.abs(e * nominal),
        "is_daylight": F.coalesce(producing, F.lit(False)),
        "e_rel": F.when(producing, e / (actual + C.RELATIVE_EPS)),
    }


def exported_error(actual: Column, predicted: Column) -> dict[str, Column]:
    """The exported tables keep the opposite sign: predicted - real."""
    return {"error": predicted - actual, "abs_error": F.abs(predicted - actual)}


def paired_errors(actual: Column, a: Column, b: Column, names: tuple[str, str] = ("lag", "nolag")) -> dict[str, Column]:
    out = {f"error_{n}": F.abs(actual - p) for n, p in zip(names, (a, b))}
    out |= {f"error_rel_{n}": F.try_divide(F.abs(actual - p), actual + C.RELATIVE_EPS) for n, p in zip(names, (a, b))}
    return out


def daylight_only(error: Column, is_daylight: Column) -> Column:
    """Night rows count as zero when errors are accumulated."""
    return F.when(is_daylight, error).otherwise(F.lit(0.0))


def daily_error_term(actual: Column, predicted: Column, positive_part: bool = True) -> Column:
    """Positive part of real - predicted (what the daily charts use), or its absolute value."""
    e = actual - predicted
    return clip(e, 0.0) if positive_part else F.abs(e)


def rounded(df: DataFrame, digits: int, columns: Sequence[str] | None = None) -> DataFrame:
    floats = {n for n, t in df.dtypes if t in ("double", "float")}
    chosen = floats if columns is None else set(columns)
    return df.select(*[F.round(n, digits).alias(n) if n in chosen else F.col(n) for n in df.columns])
