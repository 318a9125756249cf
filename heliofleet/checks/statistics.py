"""Distribution, normality, dependence and trend checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import scalar as S
from ..operators import stats
from . import bindings as B
from .ordered import residual_rows
from .registry import DAILY, RESIDUALS, check

PRODUCING = RESIDUALS + ", x AS (SELECT * FROM res WHERE is_daylight)"


def producing(spark, d):
    return residual_rows(spark, d).filter("is_daylight")


@check("residual_histogram", """
WITH b AS (SELECT id_planta, min(e_kw) AS lo, max(e_kw) AS hi, count(*) AS n FROM x GROUP BY 1),
k AS (SELECT x.id_planta, CAST(least(floor((e_kw - lo) / ((hi - lo) / 80)), 79) AS INT) AS bin, lo, (hi - lo) / 80 AS w, b.n AS total FROM x JOIN b ON b.id_planta = x.id_planta)
SELECT id_planta, bin, max(lo + bin * w) AS "left", count(*) AS n, count(*) / max(total * w) AS density FROM k GROUP BY 1, 2""", "left density", PRODUCING)
def residual_histogram(spark, d):
    return stats.histogram(producing(spark, d), "e_kw", 80, (C.PLANT,))


@check("hexagon_counts", """
WITH b AS (SELECT min(radiation) AS x0, (max(radiation) - min(radiation)) / 40 AS sx, min(e_kw) AS y0, (max(e_kw) - min(e_kw)) / 23 AS sy FROM x),
u AS (SELECT (radiation - x0) / sx AS u, (e_kw - y0) / sy AS v, x0, y0, sx, sy FROM x, b),
c AS (SELECT *, (u - round(u)) * (u - round(u)) + 3 * (v - round(v)) * (v - round(v))
  < (u - floor(u) - 0.5) * (u - floor(u) - 0.5) + 3 * (v - floor(v) - 0.5) * (v - floor(v) - 0.5) AS main FROM u)
SELECT x0 + CASE WHEN main THEN round(u) ELSE floor(u) + 0.5 END * sx AS cx, y0 + CASE WHEN main THEN round(v) ELSE floor(v) + 0.5 END * sy AS cy, count(*) AS n
FROM c GROUP BY 1, 2""", "cx cy", PRODUCING)
def hexagon_counts(spark, d):
    return stats.hexagon_counts(producing(spark, d), C.RADIATION, "e_kw")


@check("normal_curve", """
WITH f AS (SELECT id_planta, min(e_kw) AS lo, max(e_kw) AS hi, avg(e_kw) AS mu, stddev_pop(e_kw) AS sd FROM x GROUP BY 1)
SELECT id_planta, CAST(i AS INT) AS i, lo + (hi - lo) * i / 199 AS x, exp(-0.5 * ((lo + (hi - lo) * i / 199 - mu) / sd) ** 2) / (sd * sqrt(2 * pi())) AS pdf
FROM f, generate_series(0, 199) g(i)""", "x pdf", PRODUCING)
def normal_curve(spark, d):
    return stats.normal_curve(producing(spark, d), "e_kw", 200, (C.PLANT,))


MOMENTS = PRODUCING + """,
mo AS (SELECT id_planta, count(*) AS n, avg(e_kw) AS mean, stddev_pop(e_kw) AS std,
  (avg(e_kw ** 3) - 3 * avg(e_kw) * avg(e_kw ** 2) + 2 * avg(e_kw) ** 3) / stddev_pop(e_kw) ** 3 AS skewness, kurtosis_pop(e_kw) AS kurtosis FROM x GROUP BY 1)"""


@check("residual_moments", "SELECT * FROM mo", "mean std skewness kurtosis", MOMENTS)
def residual_moments(spark, d):
    return stats.moments(producing(spark, d), "e_kw", (C.PLANT,))


@check("dagostino_pearson", """
WITH a AS (SELECT *, n::DOUBLE AS m FROM mo),
s AS (SELECT *, skewness * sqrt((m + 1) * (m + 3) / (6 * (m - 2))) AS y, sqrt(2 * (3 * (m * m + 27 * m - 70) * (m + 1) * (m + 3) / ((m - 2) * (m + 5) * (m + 7) * (m + 9)) - 1)) - 1 AS w2,
  (kurtosis + 3 - 3 * (m - 1) / (m + 1)) / sqrt(24 * m * (m - 2) * (m - 3) / ((m + 1) * (m + 1) * (m + 3) * (m + 5))) AS z,
  6 * (m * m - 5 * m + 2) / ((m + 7) * (m + 9)) * sqrt(6 * (m + 3) * (m + 5) / (m * (m - 2) * (m - 3))) AS r FROM a),
t AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z_skew, 6 + 8 / r * (2 / r + sqrt(1 + 4 / (r * r))) AS q FROM s),
v AS (SELECT *, (1 - 2 / (9 * q) - cbrt((1 - 2 / q) / (1 + z * sqrt(2 / (q - 4))))) / sqrt(2 / (9 * q)) AS z_kurt FROM t)
SELECT id_planta, n, z_skew, z_kurt, z_skew ** 2 + z_kurt ** 2 AS K2, exp(-(z_skew ** 2 + z_kurt ** 2) / 2) AS p_value FROM v""",
       "z_skew z_kurt K2 p_value", MOMENTS, 5)
def dagostino(spark, d):
    return stats.dagostino(producing(spark, d), "e_kw", (C.PLANT,))


def _sql_erfc(x: str) -> str:
    """Complementary error function for 0 <= x by the alternating power series (to ten digits); nothing is left beyond 4.2."""
    terms = f"lambda k: CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * exp((2 * k + 1) * ln(greatest({x}, 1e-300)) - lgamma(k + 1)) / (2 * k + 1)"
    return f"CASE WHEN {x} > 4.2 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), {terms})) END"


def _sql_half_tail(z: str) -> str:
    return f"({_sql_erfc(f'(abs({z}) / sqrt(2))')}) / 2"


def _sql_chi2_tail(q: str, df: str) -> str:
    """Tail of chi-square for any whole number of degrees: a finite sum, and for odd ones the normal tail."""
    def finite(first: str) -> str:
        return f"coalesce(list_sum(list_transform(range(0, {df} // 2), lambda k: exp(-{q} / 2 + (k + {first}) * ln(greatest({q}, 1e-300) / 2) - lgamma(k + {first} + 1)))), 0)"
    return f"CASE WHEN {q} <= 0 THEN 1 WHEN {df} % 2 = 0 THEN least(1, {finite('0')}) ELSE least(1, {_sql_erfc(f'sqrt(greatest({q}, 0) / 2)')} + {finite('0.5')}) END"


@check("kolmogorov_smirnov", f"""
WITH o AS (SELECT id_planta, (e_kw - avg(e_kw) OVER p) / stddev_pop(e_kw) OVER p AS z, count(*) OVER p AS n, rank() OVER (PARTITION BY id_planta ORDER BY e_kw) - 1 AS below,
  count(*) OVER (PARTITION BY id_planta ORDER BY e_kw RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM x WINDOW p AS (PARTITION BY id_planta)),
c AS (SELECT id_planta, n, below, upto, CASE WHEN z < 0 THEN {_sql_half_tail('z')} ELSE 1 - {_sql_half_tail('z')} END AS cdf FROM o),
d AS (SELECT id_planta, max(n) AS n, max(greatest(abs(upto / n - cdf), abs(cdf - below / n))) AS statistic FROM c GROUP BY 1),
l AS (SELECT *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * statistic AS lam FROM d)
SELECT id_planta, statistic, n, CASE WHEN lam < 0.2 THEN 1 ELSE least(1, greatest(0, {" + ".join(f"{2.0 * (-1) ** (k - 1)} * exp({-2.0 * k * k} * lam * lam)" for k in range(1, 41))})) END AS p_value FROM l""",
       "statistic p_value", PRODUCING)
def kolmogorov_smirnov(spark, d):
    return stats.kolmogorov_smirnov(producing(spark, d), "e_kw", (C.PLANT,))


def _sql_quantile(p: str) -> str:
    from ..functions import special as sp

    def poly(x, cs):
        out = repr(cs[0])
        for c in cs[1:]:
            out = f"({out} * {x} + {c!r})"
        return out

    q, r = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return (f"CASE WHEN {p} < {sp._TAIL_AT} THEN {poly(low, sp._TAIL_NUM)} / {poly(low, sp._TAIL_DEN)} WHEN {p} > {1 - sp._TAIL_AT} "
            f"THEN -{poly(high, sp._TAIL_NUM)} / {poly(high, sp._TAIL_DEN)} ELSE {q} * {poly(r, sp._CENTRAL_NUM)} / {poly(r, sp._CENTRAL_DEN)} END")


QQ = """
WITH o AS (SELECT id_planta, {v} AS v, row_number() OVER (PARTITION BY id_planta ORDER BY {v}) AS i, count(*) OVER (PARTITION BY id_planta)::DOUBLE AS n FROM x),
p AS (SELECT *, CASE WHEN i = 1 THEN 1 - 0.5 ** (1 / n) WHEN i = n THEN 0.5 ** (1 / n) ELSE (i - 0.3175) / (n + 0.365) END AS p FROM o),
s AS (SELECT id_planta, v, {q} AS score FROM p)
SELECT id_planta, regr_slope(v, score) AS slope, regr_intercept(v, score) AS intercept, corr(v, score) AS r, corr(v, score) ** 2 AS w_francia, count(*) AS n
FROM s GROUP BY 1"""


@check("qq_fit_absolute", QQ.format(v="e_kw", q=_sql_quantile("p")), "slope intercept r w_francia", PRODUCING)
def qq_fit_absolute(spark, d):
    return stats.qq_fit(producing(spark, d), "e_kw", (C.PLANT,))


@check("qq_fit_relative", QQ.format(v="least(greatest(e_rel, -3), 3)", q=_sql_quantile("p")), "slope intercept r w_francia", PRODUCING)
def qq_fit_relative(spark, d):
    clipped = producing(spark, d).withColumn("e_rel", S.clip(F.col("e_rel"), -3.0, 3.0))
    return stats.qq_fit(clipped, "e_rel", (C.PLANT,))


@check("qq_points", QQ.split("SELECT id_planta, regr_slope")[0].format(v="e_kw", q=_sql_quantile("p")) + """
SELECT id_planta, v AS e_kw, count(*) AS n_equal, min(score) AS score_first, max(score) AS score_last FROM s GROUP BY 1, 2""",
       "e_kw score_first score_last", PRODUCING)
def qq_points(spark, d):
    return stats.qq_points(producing(spark, d), "e_kw", (C.PLANT,)).drop("n_below", "n_total")


@check("residual_percentiles", " UNION ALL ".join(
    f"SELECT id_planta, CAST({p} AS DOUBLE) AS p, quantile_cont(e_kw, {p}) AS q FROM x GROUP BY 1" for p in (0.01, 0.99)), "p q", PRODUCING)
def residual_percentiles(spark, d):
    return stats.percentiles(producing(spark, d), "e_kw", (0.01, 0.99), (C.PLANT,))


ACF = PRODUCING + """,
c AS (SELECT id_planta, e_kw - avg(e_kw) OVER (PARTITION BY id_planta) AS e, row_number() OVER (PARTITION BY id_planta ORDER BY "timestamp") AS i,
  count(*) OVER (PARTITION BY id_planta) AS n FROM x),
acf AS (SELECT a.id_planta, CAST(g.k AS INT) AS lag, max(a.n) AS n, coalesce(sum(a.e * b.e), 0) / max(v.s) AS acf FROM c a CROSS JOIN generate_series(0, 48) g(k)
  LEFT JOIN c b ON b.id_planta = a.id_planta AND b.i = a.i - g.k JOIN (SELECT id_planta, sum(e * e) AS s FROM c GROUP BY 1) v ON v.id_planta = a.id_planta GROUP BY 1, 2)"""


@check("autocorrelation", "SELECT *, 1.959963984540054 / sqrt(n) AS band FROM acf", "acf band", ACF)
def autocorrelation(spark, d):
    return stats.autocorrelation(producing(spark, d), "e_kw")


@check("significant_lags", """
SELECT id_planta, count(*) FILTER (abs(acf) > 1.959963984540054 / sqrt(n)) AS n_significant, count(*) AS n_lags,
  max(lag) FILTER (abs(acf) > 1.959963984540054 / sqrt(n)) AS last_significant FROM acf WHERE lag > 0 GROUP BY 1""", "", ACF)
def significant_lags(spark, d):
    return stats.significant_lags(stats.autocorrelation(producing(spark, d), "e_kw"))


@check("ljung_box", f"""SELECT *, {_sql_chi2_tail("Q", "lag")} AS p_value FROM (""" + " UNION ALL ".join(f"""
SELECT id_planta, n, {m} AS lag, n::DOUBLE * (n + 2) * sum(acf * acf / (n - lag)) AS Q FROM acf WHERE lag BETWEEN 1 AND {m} GROUP BY 1, 2"""
                                       for m in (1, 4, 8, 16, 24, 48)) + ")", "Q p_value", ACF, 5)
def ljung_box(spark, d):
    return stats.ljung_box(stats.autocorrelation(producing(spark, d), "e_kw"))


_WALLACE = "(8 * (n - 2)::DOUBLE + 1) / (8 * (n - 2)::DOUBLE + 3) * sqrt(-(n - 2)::DOUBLE * ln(1 - pearson_r * pearson_r))"


@check("driver_correlations", f"SELECT *, {_sql_erfc(f'({_WALLACE} / sqrt(2))')} AS p_value FROM (" + " UNION ALL ".join(f"""
SELECT id_planta, '{v}' AS driver, count(*) AS n, corr({v}, e_kw) AS pearson_r, corr(rx, ry) AS spearman_rho FROM (
  SELECT *, rank() OVER (PARTITION BY id_planta ORDER BY {v}) + (count(*) OVER (PARTITION BY id_planta, {v}) - 1) / 2 AS rx,
    rank() OVER (PARTITION BY id_planta ORDER BY e_kw) + (count(*) OVER (PARTITION BY id_planta, e_kw) - 1) / 2 AS ry FROM x) GROUP BY 1"""
                                                  for v in ("radiation", "T_ambiente", "y_true")) + ")", "pearson_r spearman_rho p_value", PRODUCING)
def driver_correlations(spark, d):
    return stats.driver_correlations(producing(spark, d), "e_kw", (C.RADIATION, C.TEMPERATURE, "y_true"), (C.PLANT,))


@check("kruskal_wallis", f"""
WITH r AS (SELECT id_planta, quarter("timestamp" + INTERVAL 1 MONTH) AS g, power, rank() OVER (PARTITION BY id_planta ORDER BY power)
    + (count(*) OVER (PARTITION BY id_planta, power) - 1) / 2 AS k FROM daily),
s AS (SELECT id_planta, g, sum(k) AS s, count(*) AS n FROM r GROUP BY 1, 2),
t AS (SELECT id_planta, sum(c ** 3 - c) AS t FROM (SELECT id_planta, power, count(*)::DOUBLE AS c FROM r GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT s.id_planta, CAST(sum(s.n) AS BIGINT) AS n, count(*) AS k, (12 / (sum(s.n)::DOUBLE * (sum(s.n) + 1)) * sum(s.s * s.s / s.n) - 3 * (sum(s.n) + 1))
  / (1 - max(t.t) / (sum(s.n)::DOUBLE ** 3 - sum(s.n))) AS H FROM s JOIN t ON t.id_planta = s.id_planta GROUP BY 1)
SELECT *, {_sql_chi2_tail("H", "(k - 1)")} AS p_value FROM h""", "H p_value", DAILY, 5)
def kruskal_wallis(spark, d):
    rows = B.daily(spark, d).withColumn("season", S.season(F.col(C.TS)))
    return stats.kruskal_wallis(rows, C.POWER, "season", (C.PLANT,))


@check("lowess_trend", """
WITH b AS (SELECT id_planta, min(radiation) AS lo, max(radiation) AS hi, count(*) AS n FROM x GROUP BY 1),
g AS (SELECT id_planta, CAST(i AS INT) AS i, lo + (hi - lo) * i / 49 AS gx, n FROM b, generate_series(0, 49) s(i)),
f AS (SELECT g.*, abs(x.radiation - gx) AS d, x.radiation - gx AS dx, x.e_kw AS y FROM g JOIN x ON x.id_planta = g.id_planta),
h AS (SELECT id_planta, i, d AS h FROM f QUALIFY row_number() OVER (PARTITION BY id_planta, i ORDER BY d) = CAST(ceil(n * 0.3) AS BIGINT)),
w AS (SELECT f.*, (1 - (d / h) ** 3) ** 3 AS w FROM f JOIN h ON h.id_planta = f.id_planta AND h.i = f.i WHERE d < h)
SELECT id_planta, i, max(gx) AS x, (sum(w * dx * dx) * sum(w * y) - sum(w * dx) * sum(w * dx * y)) / (sum(w) * sum(w * dx * dx) - sum(w * dx) ** 2) AS trend
FROM w GROUP BY 1, 2""", "x trend", PRODUCING, 5)
def lowess_trend(spark, d):
    return stats.lowess_grid(producing(spark, d), C.RADIATION, "e_kw", by=(C.PLANT,), closed=False)


def _robust_sql(passes: int) -> str:
    """The trend with robustness passes as one statement: weights, trend and residuals of each pass."""
    steps = []
    for p in range(passes + 1):
        steps.append(f"""t{p} AS (SELECT id_planta, i, max(gx) AS x, (sum(k * r * dx * dx) * sum(k * r * y) - sum(k * r * dx) * sum(k * r * dx * y))
  / (sum(k * r) * sum(k * r * dx * dx) - sum(k * r * dx) ** 2) AS trend FROM k JOIN r{p} USING (id_planta, t) GROUP BY 1, 2)""")
        if p < passes:
            steps.append(f"""r{p + 1} AS (SELECT id_planta, t, CASE WHEN e < 6 * m THEN (1 - (e / (6 * m)) ** 2) ** 2 ELSE 0 END AS r FROM (
  SELECT *, quantile_cont(e, 0.5) OVER (PARTITION BY id_planta) AS m FROM (
    SELECT o.id_planta, o.t, abs(o.y - (a.trend + (c.trend - a.trend) * (o.at - o.j))) AS e FROM o
    JOIN t{p} a ON a.id_planta = o.id_planta AND a.i = o.j JOIN t{p} c ON c.id_planta = o.id_planta AND c.i = o.j + 1)))""")
    return """
WITH b AS (SELECT id_planta, min(radiation) AS lo, max(radiation) AS hi, count(*) AS n FROM x GROUP BY 1),
g AS (SELECT id_planta, CAST(i AS INT) AS i, lo + (hi - lo) * i / 49 AS gx, n FROM b, generate_series(0, 49) s(i)),
f AS (SELECT g.*, x."timestamp" AS t, abs(x.radiation - gx) AS d, x.radiation - gx AS dx, x.e_kw AS y FROM g JOIN x ON x.id_planta = g.id_planta),
h AS (SELECT id_planta, i, d AS h FROM f QUALIFY row_number() OVER (PARTITION BY id_planta, i ORDER BY d) = CAST(ceil(n * 0.3) AS BIGINT)),
k AS (SELECT f.*, (1 - (d / h) ** 3) ** 3 AS k FROM f JOIN h ON h.id_planta = f.id_planta AND h.i = f.i WHERE d < h),
o AS (SELECT x.id_planta, x."timestamp" AS t, e_kw AS y, (radiation - lo) / ((hi - lo) / 49) AS at, CAST(least(floor((radiation - lo) / ((hi - lo) / 49)), 48) AS INT) AS j
  FROM x JOIN b ON b.id_planta = x.id_planta),
r0 AS (SELECT id_planta, "timestamp" AS t, CAST(1 AS DOUBLE) AS r FROM x),
""" + ",\n".join(steps) + f"\nSELECT * FROM t{passes}"


@check("lowess_trend_robust", _robust_sql(3), "x trend", PRODUCING, 5)
def lowess_trend_robust(spark, d):
    return stats.lowess_grid(producing(spark, d), C.RADIATION, "e_kw", by=(C.PLANT,), passes=3, closed=False)


@check("hash_sample")
def hash_sample(spark, d):
    return stats.hash_sample(producing(spark, d), (C.PLANT, C.TS), 500)
