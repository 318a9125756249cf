"""Distribution functions that Spark SQL lacks, as columns or on a handful of aggregated rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation of the inverse normal distribution function
# (P. J. Acklam), central and tail coefficients from the highest power down.
_CENTRAL_NUM = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
                1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_CENTRAL_DEN = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
                6.680131188771972e01, -1.328068155288572e01, 1.0)
_TAIL_NUM = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
             -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_TAIL_DEN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
             3.754408661907416e00, 1.0)
_TAIL_AT = 0.02425


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function, relative error below 1.2e-9."""
    q = p - 0.5
    r = q * q
    central = q * _poly(r, _CENTRAL_NUM) / _poly(r, _CENTRAL_DEN)
    low = F.sqrt(-2 * F.ln(p))
    high = F.sqrt(-2 * F.ln(1 - p))
    return (
        F.when((p <= 0) | (p >= 1), F.lit(None))
        .when(p < _TAIL_AT, _poly(low, _TAIL_NUM) / _poly(low, _TAIL_DEN))
        .when(p > 1 - _TAIL_AT, -_poly(high, _TAIL_NUM) / _poly(high, _TAIL_DEN))
        .otherwise(central)
    )


def normal_pdf(x: Column, mean: Column, std: Column) -> Column:
    z = F.try_divide(x - mean, std)
    return F.try_divide(F.exp(-0.5 * z * z), std * math.sqrt(2 * math.pi))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0: the series of erf in odd factorials below 3, a continued fraction from there."""
    square = x * x
    series = F.lit(1.0)  # 1 + 2x2/3 (1 + 2x2/5 (1 + ...)), which has positive terms only
    for k in range(60, 0, -1):
        series = 1 + 2 * square / (2 * k + 1) * series
    below = 1 - 2 / math.sqrt(math.pi) * F.exp(-square) * x * series
    far = F.greatest(x, F.lit(3.0))
    fraction = far
    for k in range(40, 0, -1):
        fraction = far + k / 2 / fraction
    return F.when(x < 3, below).otherwise(F.exp(-square) / math.sqrt(math.pi) / fraction)


def chi2_tail(x: Column, df: int) -> Column:
    """P(chi-square with ``df`` degrees > x), for every whole number of degrees."""
    half = x / 2
    if df % 2 == 0:
        series = F.lit(1.0)
        for k in range(df // 2 - 1, 0, -1):
            series = 1 + half / k * series
        return F.exp(-half) * series
    total = erfc(F.sqrt(half))
    for k in range(1, (df - 1) // 2 + 1):
        total = total + F.exp(-half + (k - 0.5) * F.ln(half) - math.lgamma(k + 0.5))
    return F.least(total, F.lit(1.0))


def chi2_tail_of(x: Column, df: Column) -> Column:
    """The same for degrees of freedom in a column, without an upper limit; sums in logarithms so that nothing underflows early."""
    half = (x / 2).cast("double")
    odd = df % 2 == 1
    first = F.when(odd, -half + 0.5 * F.ln(half) - math.lgamma(1.5)).otherwise(-half)
    begin = F.when(odd, erfc(F.sqrt(half))).otherwise(F.lit(0.0))
    terms = F.when(odd, (df - 1) / 2).otherwise(df / 2).cast("int")
    steps = F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    shift = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    total = F.aggregate(
        steps, F.struct(first.alias("log"), begin.alias("sum")),
        lambda s, k: F.struct((s["log"] + F.ln(half) - F.ln(k + shift)).alias("log"), (s["sum"] + F.exp(s["log"])).alias("sum")))
    return F.when(half <= 0, 1.0).otherwise(F.least(total["sum"], F.lit(1.0)))


def two_sided_normal(z: Column) -> Column:
    """P(|Z| > |z|) for a standard normal Z."""
    return erfc(F.abs(z) / math.sqrt(2))
