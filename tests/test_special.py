"""Distribution functions against the standard library."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliofleet.functions import special
from heliofleet.operators import chunks, stats


def test_erfc(spark):
    xs = [0.0, 1e-9, 0.3, 1.0, 2.0, 2.9, 2.999999, 3.0, 3.5, 5.0, 8.0, 20.0]
    got = [r.y for r in spark.createDataFrame([(x,) for x in xs], "x double").select(special.erfc(F.col("x")).alias("y")).collect()]
    assert got == pytest.approx([math.erfc(x) for x in xs], rel=1e-10)


def test_normal_quantile(spark):
    ps = [1e-9, 0.001, 0.024, 0.025, 0.3, 0.5, 0.9, 0.976, 0.99999]
    got = [r.y for r in spark.createDataFrame([(p,) for p in ps], "p double").select(special.normal_quantile(F.col("p")).alias("y")).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=2e-9, abs=1e-12)


def test_kolmogorov_smirnov_against_the_definition(spark):
    v = np.random.default_rng(2).exponential(size=200)
    z = np.sort((v - v.mean()) / v.std())
    cdf = np.array([NormalDist().cdf(x) for x in z])
    want = max((np.arange(1, 201) / 200 - cdf).max(), (cdf - np.arange(200) / 200).max())
    got = stats.kolmogorov_smirnov(spark.createDataFrame([(float(x),) for x in v], "v double"), "v").first()
    assert got.statistic == pytest.approx(want, abs=1e-12)
    lam = (math.sqrt(200) + 0.12 + 0.11 / math.sqrt(200)) * want
    assert got.p_value == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 200)), rel=1e-9)


@pytest.mark.parametrize("values", [
    [0.0] * 900 + [1.0, 2.0, 3.0], [float(i) for i in range(1000)], [100 + i * 1e-12 for i in range(1000)], [-1e300, 1e300, 5e-324, -5e-324, 0.0],
    [1e308 - i * 1e300 for i in range(300)] + [-1e308], [7.0], [],
    list(np.random.default_rng(1).lognormal(0, 8, 2000)) + list(-np.random.default_rng(2).lognormal(0, 8, 2000)),
])
def test_value_borders_are_even(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in [*values, None]], "v double").repartition(3)
    parts = 40
    borders = chunks.value_borders(df, "v", parts)
    assert borders == sorted(set(borders)) and len(borders) <= parts
    cut = np.searchsorted(borders, values, "right")
    for k in np.unique(cut):
        inside = [v for v, c in zip(values, cut) if c == k]
        assert len(inside) <= 2 * len(values) / parts + 1 or len(set(inside)) == 1 or sum(v != inside[0] for v in sorted(inside)) <= 2 * len(values) / parts + 1


def test_quantiles_over_many_buckets(spark):
    v = np.random.default_rng(3).normal(1e6, 1e-3, 5000)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = {r.p: r.q for r in chunks.exact_quantiles(df, "v", (0.0, 0.1, 0.5, 1.0), parts=20_000).collect()}
    assert got == pytest.approx({p: float(np.quantile(v, p)) for p in (0.0, 0.1, 0.5, 1.0)}, rel=1e-15)


def test_autocorrelation_with_a_large_mean(spark):
    v = 1e9 + np.random.default_rng(4).normal(size=300)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "id_planta string, i long, v double").withColumn(
        "timestamp", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, int(15 * i))")).drop("i")
    e = v - v.mean()
    got = {r.lag: r.acf for r in stats.autocorrelation(df, "v", 5).collect()}
    assert got == pytest.approx({k: float((e[k:] * e[: len(e) - k]).sum() / (e * e).sum()) for k in range(6)}, abs=1e-6)
