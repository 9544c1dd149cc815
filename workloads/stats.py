"""Correlation, outlier, regression, clustering, lead-lag and forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearthpanel.operators import models, moments, stats, windows
from hearthpanel.plans.panel import build_panel
from workloads import tables as t
from workloads.contracts import PROVINCE_YEAR, r6
from workloads.panel import PANEL_MONTHLY, PANEL_YEARLY
from workloads.registry import query


def p_value_sql(r: str, n: str) -> str:
    """Two-sided p of a correlation by the finite series of the t distribution."""
    nu = f"({n} - 2)"
    c2 = f"(1 - {r} * {r})"
    even = (
        f"abs({r}) * list_sum(list_transform(range(0, CAST({nu} // 2 AS BIGINT)), "
        f"lambda k: exp(lgamma(k + 0.5e0) - lgamma(k + 1e0)) / sqrt(pi()) * pow({c2}, k)))"
    )
    odd = (
        f"2 / pi() * (asin(abs({r})) + abs({r}) * sqrt({c2}) * coalesce(list_sum(list_transform("
        f"range(0, CAST(({nu} - 1) // 2 AS BIGINT)), "
        f"lambda k: exp(lgamma(k + 1e0) - lgamma(k + 1.5e0)) * sqrt(pi()) / 2 * pow({c2}, k))), 0))"
    )
    return f"CASE WHEN abs({r}) >= 1 THEN 0e0 WHEN {nu} % 2 = 0 THEN 1 - {even} ELSE 1 - {odd} END"


def _cell(i: int, j: int) -> str:
    return f"m{min(i, j)}_{max(i, j)}"


def sweep_sql(source: str, size: int, pivots: list[int], keep: str, name: str) -> str:
    """Steps that sweep a symmetric matrix of columns m0_0, m0_1, ... row by row; the last one is called ``name``."""
    steps = []
    for place, k in enumerate(pivots):
        cells = []
        for i in range(size):
            for j in range(i, size):
                if i == j == k:
                    value = f"-1e0 / {_cell(k, k)}"
                elif k in (i, j):
                    value = f"{_cell(i, j)} / {_cell(k, k)}"
                else:
                    value = f"{_cell(i, j)} - {_cell(i, k)} * {_cell(k, j)} / {_cell(k, k)}"
                cells.append(f"{value} AS {_cell(i, j)}")
        step = name if place == len(pivots) - 1 else f"{name}_{place}"
        steps.append(f"{step} AS MATERIALIZED (SELECT {keep}, {', '.join(cells)} FROM {source})")
        source = step
    return ",\n".join(steps)


def centred_sql(columns: list[str]) -> str:
    """Centred sums of products of columns, as the cells of a matrix."""
    size = range(len(columns))
    return ", ".join(f"covar_samp({columns[i]}, {columns[j]}) * (count(*) - 1) AS {_cell(i, j)}" for i in size for j in size if i <= j)


def f_tail_sql(f: str, lag: int, df2: str) -> str:
    """P(F > f) for ``lag`` of 1 to 4 and ``df2`` degrees of freedom: finite series, one step up from the t tail for odd lags."""
    x, a = f"({df2} / ({df2} + {lag} * {f}))", f"({df2} / 2e0)"
    if lag == 2:
        return f"pow({x}, {a})"
    if lag == 4:
        return f"pow({x}, {a}) * (1 + {a} * (1 - {x}))"
    t = f"({p_value_sql(f'sqrt(1 - {x})', f'({df2} + 2)')})"
    if lag == 1:
        return t
    return f"{t} + pow({x}, {a}) * sqrt(1 - {x}) * 2 * exp(lgamma({a} + 0.5e0) - lgamma({a}) - lgamma(0.5e0))"


def granger_sql(y: str, x: str, max_lag: int) -> str:
    """Steps up to ``tests``: province, lag, f and p by normal equations of each lag."""
    lags = range(1, max_lag + 1)
    shifted = ", ".join(f"lag({c}, {i}) OVER w AS {c}{i}" for c in "yx" for i in lags)
    text = [
        f"""g0 AS (SELECT province, ym, CAST({y} AS DOUBLE) AS y, CAST({x} AS DOUBLE) AS x FROM panel_m WHERE {y} IS NOT NULL AND {x} IS NOT NULL),
g AS MATERIALIZED (SELECT province, y AS y0, {shifted}, row_number() OVER w AS place FROM g0 WINDOW w AS (PARTITION BY province ORDER BY ym))"""
    ]
    for lag in lags:
        columns = [f"y{i}" for i in range(lag + 1)] + [f"x{i}" for i in range(1, lag + 1)]
        text.append(f"a{lag} AS (SELECT province, CAST(count(*) AS DOUBLE) AS n, {centred_sql(columns)} FROM g WHERE place > {lag} GROUP BY province)")
        text.append(sweep_sql(f"a{lag}", 2 * lag + 1, list(range(1, lag + 1)), "province, n", f"b{lag}"))
        text.append(f"c{lag} AS (SELECT *, m0_0 AS restricted FROM b{lag})")
        text.append(sweep_sql(f"c{lag}", 2 * lag + 1, list(range(lag + 1, 2 * lag + 1)), "province, n, restricted", f"d{lag}"))
        text.append(f"e{lag} AS (SELECT province, n - {2 * lag + 1} AS df2, (restricted - m0_0) / {lag} / (m0_0 / (n - {2 * lag + 1})) AS f FROM d{lag})")
    union = " UNION ALL ".join(f"SELECT province, {lag} AS lag, f, {f_tail_sql('f', lag, 'df2')} AS p FROM e{lag}" for lag in lags)
    return ",\n".join(text) + f",\ntests AS ({union})"


def forecast_sql(hinges: int, seasons: int, periods: int = 12) -> str:
    """Steps up to ``fitted``: trend and season of every province by ridge normal equations, as ``models.forecast`` has them."""
    waves = [f"{wave}({2 * k} * pi() * {{month}} / 12)" for k in range(1, seasons + 1) for wave in ("sin", "cos")]

    def trend(t: str, last: str) -> list[str]:
        return ["1e0", t, *(f"greatest({t} - {last} * {0.8 * i / (hinges + 1)!r}, 0e0)" for i in range(1, hinges + 1))]

    def dot(columns: list[str], start: int) -> str:
        return " + ".join(["0e0", *(f"{c} * {_cell(0, start + i)}" for i, c in enumerate(columns, 1))])

    text = [
        """f0 AS (SELECT province, year, month, avg(avg_price) AS y FROM sales_rollup GROUP BY province, year, month),
f1 AS (SELECT *, CAST((year - min(year) OVER w) * 12 + month - arg_min(month, year * 12 + month) OVER w AS DOUBLE) AS t,
  count(*) OVER w AS n, row_number() OVER (PARTITION BY province ORDER BY year, month) AS place FROM f0 WINDOW w AS (PARTITION BY province)),
f2 AS MATERIALIZED (SELECT *, place <= n - least(12, n // 4) AS train, max(t) OVER w AS last,
  max(CASE WHEN place <= n - least(12, n // 4) THEN t END) OVER w AS last_train FROM f1 WHERE n >= 24 WINDOW w AS (PARTITION BY province))"""
    ]
    season = [w.format(month="month") for w in waves]
    for name, last, where in (("whole", "last", "TRUE"), ("part", "last_train", "train")):
        columns = ["y", *trend("t", last), *season]
        size = len(columns)
        cells = []
        for i in range(size):
            for j in range(i, size):
                ridge = f" + any_value({last})" if i == j and 2 < i <= 2 + hinges else " + 1e-8" if i == j and i > 0 else ""
                cells.append(f"sum(({columns[i]}) * ({columns[j]})){ridge} AS {_cell(i, j)}")
        text.append(f"{name}_sums AS MATERIALIZED (SELECT province, {', '.join(cells)} FROM f2 WHERE {where} GROUP BY province)")
        text.append(sweep_sql(f"{name}_sums", size, list(range(1, size)), "province", name))
        text.append(
            f"""{name}_fit AS MATERIALIZED (SELECT f2.*, {dot(trend('t', last), 0)} AS trend, {dot(season, 2 + hinges)} AS yearly FROM f2 JOIN {name} USING (province)),
{name}_sigma AS (SELECT province, stddev_samp(y - trend - yearly) AS sigma FROM {name}_fit WHERE {where} GROUP BY province)"""
        )
    ahead = [w.format(month="((month - 1 + i) % 12 + 1)") for w in waves]
    text.append(
        f"""future AS (SELECT province, CAST(make_date(year, month, 1) + to_months(CAST(i AS INTEGER)) AS DATE) AS ds,
  {dot(trend('(t + i)', 'last'), 0)} AS trend, {dot(ahead, 2 + hinges)} AS yearly
  FROM f2 JOIN whole USING (province), range(1, {periods + 1}) r(i) WHERE place = n),
points AS (SELECT province, 'history' AS part, make_date(year, month, 1) AS ds, y AS actual, trend, yearly, sigma FROM whole_fit JOIN whole_sigma USING (province)
  UNION ALL SELECT province, 'holdout', make_date(year, month, 1), y, trend, yearly, sigma FROM part_fit JOIN part_sigma USING (province) WHERE NOT train
  UNION ALL SELECT province, 'future', ds, NULL, trend, yearly, sigma FROM future JOIN whole_sigma USING (province)),
fitted AS (SELECT province, part, ds, actual, trend + yearly AS yhat, trend + yearly - {models.BAND} * sigma AS yhat_lower,
  trend + yearly + {models.BAND} * sigma AS yhat_upper, trend, yearly FROM points)"""
    )
    return ",\n".join(text)


_SERIES = ", ".join(f"round({c}, 4) AS {c}" for c in ("actual", "yhat", "yhat_lower", "yhat_upper"))
_METRICS = """SELECT province, round_even(avg(abs(actual - yhat)), 1) AS mae, round_even(avg(abs((actual - yhat) / actual)) * 100, 2) AS mape,
  round_even(sqrt(avg((actual - yhat) * (actual - yhat))), 1) AS rmse FROM fitted WHERE part = 'holdout' GROUP BY province"""


def monthly_panel(spark, sf):
    sources = t.panel_sources(spark, sf)
    wanted = ("sales", "deposit_only", "unsold", "permits", "price_index", "population")
    return build_panel({k: sources[k] for k in wanted}, freq="monthly")


CORR_COLUMNS = ["avg_price", "deal_count", "avg_unit_price", "deposit_ratio", "unsold"]
_CORR_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS var_x, '{b}' AS var_y, n, "
    + ("1e0 AS r" if a == b else f"corr({a}, {b}) AS r")
    + " FROM complete, (SELECT count(*) AS n FROM complete) GROUP BY n"
    for a in CORR_COLUMNS
    for b in CORR_COLUMNS
)


@query(
    "corr_matrix",
    f"""WITH {PANEL_MONTHLY},
complete AS (SELECT {", ".join(CORR_COLUMNS)} FROM panel_m WHERE {" AND ".join(f"{c} IS NOT NULL" for c in CORR_COLUMNS)}),
pairs AS ({_CORR_PAIRS})
SELECT var_x, var_y, n, round(r, 6) AS r,
  CASE WHEN var_x = var_y THEN 0e0 ELSE round({p_value_sql('r', 'n')}, 6) END AS p FROM pairs""",
)
def corr_matrix(spark, sf):
    out = stats.correlation_matrix(monthly_panel(spark, sf), CORR_COLUMNS)
    return out.select("var_x", "var_y", "n", r6("r"), r6("p"))


def _corr_by(key: str) -> str:
    return f"""WITH {PANEL_MONTHLY},
c AS (SELECT {key}, count(*) AS n, corr(unsold, avg_price) AS r FROM panel_m
      WHERE unsold IS NOT NULL AND avg_price IS NOT NULL GROUP BY {key} HAVING count(*) >= 3),
g AS (SELECT {key}, n, CASE WHEN NOT isnan(r) THEN r END AS r FROM c)
SELECT {key}, n, round_even(r, 4) AS r, round_even({p_value_sql('r', 'n')}, 4) AS p FROM g"""


@query("corr_by_region", _corr_by("province"))
def corr_by_region(spark, sf):
    return stats.correlation_by(monthly_panel(spark, sf), "unsold", "avg_price", key="province")


@query("corr_by_period", _corr_by("ym"))
def corr_by_period(spark, sf):
    return stats.correlation_by(monthly_panel(spark, sf), "unsold", "avg_price", key="ym", sort=False)


@query(
    "scatter_fit",
    f"""WITH {t.SALES}
SELECT count(*) AS n, round(regr_slope(amount, area), 4) AS slope, round(regr_intercept(amount, area), 4) AS intercept,
       round(corr(amount, area) * corr(amount, area), 6) AS r_squared
FROM sales WHERE amount IS NOT NULL AND area IS NOT NULL""",
)
def scatter_fit(spark, sf):
    out = stats.scatter_fit(t.sales(spark, sf), "area", "amount")
    return out.select("n", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), r6("r_squared"))


@query(
    "rolling_corr",
    f"""WITH {PANEL_MONTHLY},
m AS (SELECT ym, avg(avg_price) AS x, avg(deal_count) AS y FROM panel_m GROUP BY ym),
w AS (SELECT ym, corr(x, y) OVER (ORDER BY ym ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS c,
        count(*) OVER (ORDER BY ym ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS k FROM m)
SELECT ym, round(c, 6) AS rolling_corr FROM w WHERE k = 12 AND c IS NOT NULL""",
)
def rolling_corr(spark, sf):
    out = stats.rolling_correlation(monthly_panel(spark, sf), "avg_price", "deal_count", window=12)
    return out.select("ym", r6("rolling_corr"))


_CONTRACT_Z = """
stat AS (SELECT province, count(*) AS n, avg(amount) AS m, stddev_samp(amount) AS s,
           quantile_cont(CAST(amount AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(amount AS DOUBLE), 0.75) AS q3
         FROM sales GROUP BY province),
scored AS (SELECT sales.*, round_even((amount - m) / s, 4) AS z_score, abs((amount - m) / s) > 1.9 AS by_z,
             amount < q1 - 1.5e0 * (q3 - q1) OR amount > q3 + 1.5e0 * (q3 - q1) AS by_iqr
           FROM sales JOIN stat USING (province))"""


@query(
    "outliers_z",
    f"""WITH {t.SALES}, {_CONTRACT_Z}
SELECT l_orderkey, l_linenumber, province, amount, z_score, by_z AS is_outlier FROM scored""",
)
def outliers_z(spark, sf):
    out = stats.detect_outliers(t.sales(spark, sf, detail=True), "amount", group="province", threshold=1.9)
    return out.select("l_orderkey", "l_linenumber", "province", "amount", "z_score", "is_outlier")


@query(
    "outliers_iqr",
    f"""WITH {PANEL_MONTHLY},
stat AS (SELECT province, avg(avg_price) AS m, stddev_samp(avg_price) AS s,
           quantile_cont(avg_price, 0.25) AS q1, quantile_cont(avg_price, 0.75) AS q3 FROM panel_m GROUP BY province)
SELECT province, ym, round_even((avg_price - m) / s, 4) AS z_score,
  avg_price < q1 - 1.5e0 * (q3 - q1) OR avg_price > q3 + 1.5e0 * (q3 - q1) AS is_outlier
FROM panel_m JOIN stat USING (province)""",
)
def outliers_iqr(spark, sf):
    panel = build_panel({"sales": t.rolled_sales(spark, sf)}, freq="monthly")
    return stats.detect_outliers(panel, "avg_price", method="iqr").select("province", "ym", "z_score", "is_outlier")


@query(
    "outlier_counts",
    f"""WITH {t.SALES}, {_CONTRACT_Z}
SELECT province, count(*) AS contracts, CAST(sum(CAST(by_z AS INTEGER)) AS BIGINT) AS z_outliers,
       CAST(sum(CAST(by_iqr AS INTEGER)) AS BIGINT) AS iqr_outliers
FROM scored GROUP BY province""",
)
def outlier_counts(spark, sf):
    sales = t.sales(spark, sf)
    by_z = stats.detect_outliers(sales, "amount", threshold=1.9).withColumnRenamed("is_outlier", "by_z").drop("z_score")
    both = stats.detect_outliers(by_z, "amount", method="iqr")
    return both.groupBy("province").agg(
        F.count(F.lit(1)).alias("contracts"),
        F.sum(F.col("by_z").cast("bigint")).alias("z_outliers"),
        F.sum(F.col("is_outlier").cast("bigint")).alias("iqr_outliers"),
    )


@query(
    "price_quantiles",
    f"""WITH {t.SALES}
SELECT province, count(*) AS n, round(quantile_cont(CAST(amount AS DOUBLE), 0.05), 6) AS q0,
       round(quantile_cont(CAST(amount AS DOUBLE), 0.25), 6) AS q1, round(quantile_cont(CAST(amount AS DOUBLE), 0.5), 6) AS q2,
       round(quantile_cont(CAST(amount AS DOUBLE), 0.95), 6) AS q3
FROM sales GROUP BY province""",
)
def price_quantiles(spark, sf):
    out = stats.group_quantiles(t.sales(spark, sf), "amount", group=["province"], probs=[0.05, 0.25, 0.5, 0.95])
    return out.select("province", "n", *(r6(f"q{i}") for i in range(4)))


@query(
    "zscore_by_province",
    f"""WITH {t.SALES_ROLLUP}
SELECT province, district_code, ym,
  round(CASE WHEN stddev_samp(deal_count) OVER w > 0
        THEN (deal_count - avg(deal_count) OVER w) / stddev_samp(deal_count) OVER w ELSE CAST(deal_count AS DOUBLE) END, 6) AS volume_z
FROM sales_rollup WINDOW w AS (PARTITION BY province)""",
)
def zscore_by_province(spark, sf):
    out = windows.zscore(t.rolled_sales(spark, sf), "deal_count", group="province", name="volume_z")
    return out.select("province", "district_code", "ym", r6("volume_z"))


@query(
    "minmax_series",
    f"""WITH {PROVINCE_YEAR}, r AS (SELECT min(deal_count) AS lo, max(deal_count) AS hi FROM province_year)
SELECT province, year, CASE WHEN hi > lo THEN CAST(deal_count - lo AS DOUBLE) / (hi - lo) ELSE 0.5e0 END AS national,
  round(CASE WHEN max(avg_price) OVER w > min(avg_price) OVER w
    THEN (avg_price - min(avg_price) OVER w) / (max(avg_price) OVER w - min(avg_price) OVER w) ELSE 0e0 END, 6) AS regional
FROM province_year, r WINDOW w AS (PARTITION BY province)""",
)
def minmax_series(spark, sf):
    yearly = build_panel({"sales": t.rolled_sales(spark, sf)})
    out = windows.minmax(yearly, "deal_count", name="national")
    out = windows.minmax(out, "avg_price", group="province", name="regional", flat=0.0)
    return out.select("province", "year", "national", r6("regional"))


@query(
    "rebase100",
    f"""WITH {PROVINCE_YEAR}
SELECT province, year, round(avg_price / max(CASE WHEN year = 1996 THEN avg_price END) OVER (PARTITION BY province) * 100, 6) AS avg_price
FROM province_year""",
)
def rebase100(spark, sf):
    yearly = build_panel({"sales": t.rolled_sales(spark, sf)})
    out = windows.transform_series(yearly, "avg_price", mode="index100", base_period=1996)
    return out.select("province", "year", r6("avg_price"))


@query(
    "lag_features",
    f"""WITH {PROVINCE_YEAR}
SELECT province, year, deal_count, lag(deal_count, 1) OVER w AS deal_count_lag1, lag(deal_count, 2) OVER w AS deal_count_lag2
FROM province_year WINDOW w AS (PARTITION BY province ORDER BY year)""",
)
def lag_features(spark, sf):
    yearly = build_panel({"sales": t.rolled_sales(spark, sf)})
    out = windows.lags(yearly, ["deal_count"], count=2, group="province", order_by="year")
    return out.select("province", "year", "deal_count", "deal_count_lag1", "deal_count_lag2")


@query(
    "ols_two",
    f"""WITH {t.SALES},
s AS (SELECT count(*) AS n, avg(amount) AS my, avg(area) AS m1, avg(l_discount) AS m2, var_samp(amount) AS yy,
  covar_samp(amount, area) AS y1, covar_samp(amount, l_discount) AS y2, var_samp(area) AS s11, var_samp(l_discount) AS s22,
  covar_samp(area, l_discount) AS s12 FROM sales),
b AS (SELECT *, s11 * s22 - s12 * s12 AS d, (y1 * s22 - y2 * s12) / (s11 * s22 - s12 * s12) AS b1,
  (y2 * s11 - y1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s),
f AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, (n - 1) * (yy - b1 * y1 - b2 * y2) AS sse FROM b),
v AS (SELECT *, sse / (n - 3) AS s2 FROM f)
SELECT 'intercept' AS variable, round(b0, 3) AS coefficient,
  round(sqrt(s2 * (1e0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / d / (n - 1))), 3) AS std_error,
  NULL AS importance, n, round(1 - sse / ((n - 1) * yy), 6) AS r_squared FROM v
UNION ALL SELECT 'area', round(b1, 3), round(sqrt(s2 * s22 / d / (n - 1)), 3), round(abs(b1 * sqrt(s11 / yy)), 6), n,
  round(1 - sse / ((n - 1) * yy), 6) FROM v
UNION ALL SELECT 'l_discount', round(b2, 3), round(sqrt(s2 * s11 / d / (n - 1)), 3), round(abs(b2 * sqrt(s22 / yy)), 6), n,
  round(1 - sse / ((n - 1) * yy), 6) FROM v""",
)
def ols_two(spark, sf):
    out = models.ols_table(t.sales(spark, sf, detail=True), "amount", ["area", "l_discount"])
    return out.select(
        "variable",
        F.round("coefficient", 3).alias("coefficient"),
        F.round("std_error", 3).alias("std_error"),
        r6("importance"),
        "n",
        r6("r_squared"),
    )


_OLS = ["avg_price", "deal_count", "unsold", "permits"]
_OLS_TERM = """SELECT {place} AS place, '{name}' AS variable, {value} AS b, {error} AS se, {weight} AS w, n FROM o2"""
_OLS_MEANS = " - ".join(["mean0", *(f"m0_{i} * mean{i}" for i in (1, 2, 3))])
_OLS_LEVER = " + ".join(["1e0 / n", *(f"mean{i} * mean{j} * -{_cell(i, j)}" for i in (1, 2, 3) for j in (1, 2, 3))])


@query(
    "ols_panel",
    f"""WITH {PANEL_MONTHLY},
o0 AS (SELECT * FROM panel_m WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _OLS)}),
o1 AS (SELECT count(*) AS n, {', '.join(f'avg({c}) AS mean{i}, var_samp({c}) AS v{i}' for i, c in enumerate(_OLS))}, {centred_sql(_OLS)} FROM o0),
{sweep_sql('o1', 4, [1, 2, 3], 'n, ' + ', '.join(f'mean{i}, v{i}' for i in range(4)), 'o2')},
o3 AS ({' UNION ALL '.join(
    [_OLS_TERM.format(place=0, name='intercept', value=_OLS_MEANS, error=f'sqrt(m0_0 / (n - 4) * ({_OLS_LEVER}))', weight='NULL')]
    + [_OLS_TERM.format(place=i, name=c, value=f'm0_{i}', error=f'sqrt(m0_0 / (n - 4) * -{_cell(i, i)})', weight=f'abs(m0_{i} * sqrt(v{i}) / sqrt(v0))')
       for i, c in enumerate(_OLS) if i]
)}),
o4 AS (SELECT *, b / se AS t, n - 2 AS pairs, (b / se) / sqrt((b / se) * (b / se) + n - 4) AS r FROM o3)
SELECT variable, round_even(b, 6) AS coefficient, round_even(se, 6) AS std_error, round_even(t, 4) AS t,
  round_even({p_value_sql('r', 'pairs')}, 4) AS p, round_even(w, 4) AS importance FROM o4""",
)
def ols_panel(spark, sf):
    coefficients, importance, _ = models.ols(monthly_panel(spark, sf), "avg_price", ["deal_count", "unsold", "permits"])
    return coefficients.join(importance, "variable", "left")


@query(
    "ols_by_region",
    f"""WITH {t.SALES},
s AS (SELECT province, count(*) AS n, avg(amount) AS my, avg(area) AS m1, avg(l_discount) AS m2, var_samp(amount) AS yy,
  covar_samp(amount, area) AS y1, covar_samp(amount, l_discount) AS y2, var_samp(area) AS s11, var_samp(l_discount) AS s22,
  covar_samp(area, l_discount) AS s12 FROM sales GROUP BY province),
b AS (SELECT *, s11 * s22 - s12 * s12 AS d, (y1 * s22 - y2 * s12) / (s11 * s22 - s12 * s12) AS b1,
  (y2 * s11 - y1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s),
f AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, (n - 1) * (yy - b1 * y1 - b2 * y2) AS sse FROM b),
v AS (SELECT *, sse / (n - 3) AS s2, 1 - sse / ((n - 1) * yy) AS r2 FROM f),
u AS (SELECT province, 'intercept' AS variable, b0 AS c, sqrt(s2 * (1e0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / d / (n - 1))) AS se, n, r2 FROM v
  UNION ALL SELECT province, 'area', b1, sqrt(s2 * s22 / d / (n - 1)), n, r2 FROM v
  UNION ALL SELECT province, 'l_discount', b2, sqrt(s2 * s11 / d / (n - 1)), n, r2 FROM v)
SELECT province, variable, round(c, 3) AS coefficient, round(se, 3) AS std_error, round(c / se, 4) AS t, n, round(r2, 6) AS r_squared FROM u""",
)
def ols_by_region(spark, sf):
    """A regression of every province over its contracts, from one aggregate."""
    out = moments.ols_by(t.sales(spark, sf, detail=True), "amount", ["area", "l_discount"], by=["province"])
    return out.select(
        "province", "variable", F.round("coefficient", 3).alias("coefficient"), F.round("std_error", 3).alias("std_error"), F.round("t", 4).alias("t"), "n", r6("r_squared")
    )


_KMEANS = ["avg_price", "deal_count", "avg_unit_price"]
_KMEANS_MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in _KMEANS)


@query("kmeans_one", f"WITH {t.SALES_ROLLUP} SELECT district_code, 0 AS cluster, {_KMEANS_MEANS} FROM sales_rollup GROUP BY district_code")
def kmeans_one(spark, sf):
    """A single cluster holds every region with its means."""
    assigned, _ = models.cluster_regions(t.rolled_sales(spark, sf), _KMEANS, k=1, restarts=1, region="district_code")
    return assigned.select("district_code", "cluster", *(r6(c) for c in _KMEANS))


@query(
    "kmeans_each",
    f"""WITH {t.SALES_ROLLUP}, m AS (SELECT province, {', '.join(f'avg({c}) AS {c}' for c in _KMEANS)} FROM sales_rollup GROUP BY province)
SELECT CAST(row_number() OVER (ORDER BY avg_price) - 1 AS INTEGER) AS cluster, {', '.join(f'round({c}, 6) AS {c}' for c in _KMEANS)} FROM m""",
)
def kmeans_each(spark, sf):
    """As many clusters as regions: every centre is a region, in the order of its first feature."""
    _, centres = models.cluster_regions(t.rolled_sales(spark, sf), _KMEANS, k=5, region="province")
    return centres.select("cluster", *(r6(c) for c in _KMEANS))


@query("kmeans_regions")
def kmeans_regions(spark, sf):
    rollup = t.rolled_sales(spark, sf)
    assigned, _ = models.cluster_regions(
        rollup, ["avg_price", "deal_count", "avg_unit_price"], k=4, region="district_code"
    )
    return assigned


@query("kmeans_profile")
def kmeans_profile(spark, sf):
    features = ["avg_price", "deal_count", "avg_unit_price"]
    _, centres = models.cluster_regions(t.rolled_sales(spark, sf), features, k=3, region="province")
    return models.radar_profile(centres, features)


@query(
    "granger_lag1",
    f"""WITH {PANEL_MONTHLY},
l AS (SELECT province, avg_price AS y, lag(avg_price) OVER w AS y1, lag(CAST(unsold AS DOUBLE)) OVER w AS x1
      FROM panel_m WHERE unsold IS NOT NULL AND avg_price IS NOT NULL WINDOW w AS (PARTITION BY province ORDER BY ym)),
m AS (SELECT province, count(*) AS n, var_samp(y) AS yy, var_samp(y1) AS s11, var_samp(x1) AS s22, covar_samp(y1, x1) AS s12,
        covar_samp(y, y1) AS c1, covar_samp(y, x1) AS c2 FROM l WHERE y1 IS NOT NULL GROUP BY province),
e AS (SELECT province, n, (n - 1) * (yy - c1 * c1 / s11) AS sr,
  (n - 1) * (yy - (c1 * (c1 * s22 - c2 * s12) + c2 * (c2 * s11 - c1 * s12)) / (s11 * s22 - s12 * s12)) AS su FROM m),
f AS (SELECT province, n, (sr - su) / (su / (n - 3)) AS f FROM e),
r AS (SELECT province, f, n, sqrt(f / (f + n - 3)) AS rr, n - 1 AS pairs FROM f)
SELECT province, 1 AS lag, round(f, 4) AS f, round({p_value_sql('rr', 'pairs')}, 5) AS p,
  {p_value_sql('rr', 'pairs')} < 0.05 AS causal FROM r""",
)
def granger_lag1(spark, sf):
    out = models.granger(monthly_panel(spark, sf), "avg_price", "unsold", max_lag=1, digits=None)
    return out.select("province", "lag", F.round("f", 4).alias("f"), F.round("p", 5).alias("p"), "causal")


@query(
    "granger_lags",
    f"""WITH {PANEL_MONTHLY}, {granger_sql('avg_price', 'unsold', 4)}
SELECT province, lag, round_even(f, 4) AS f, round_even(p, 4) AS p, p < 0.05 AS causal FROM tests""",
)
def granger_lags(spark, sf):
    return models.granger(monthly_panel(spark, sf), "avg_price", "unsold", max_lag=4)


@query(
    "granger_matrix",
    f"""WITH {PANEL_MONTHLY}, {granger_sql('deal_count', 'permits', 3)}
SELECT province, {', '.join(f'round_even(max(p) FILTER (lag = {i}), 4) AS "{i}"' for i in (1, 2, 3))} FROM tests GROUP BY province""",
)
def granger_matrix(spark, sf):
    tests = models.granger(monthly_panel(spark, sf), "deal_count", "permits", max_lag=3)
    return stats.p_value_matrix(tests, [1, 2, 3])


def _rounded(series):
    return series.select("province", "part", "ds", *(F.round(c, 4).alias(c) for c in ("actual", "yhat", "yhat_lower", "yhat_upper")))


@query(
    "forecast",
    f"""WITH {t.SALES_ROLLUP}, {forecast_sql(models.HINGES, models.SEASON_TERMS)}
SELECT province, part, ds, {_SERIES} FROM fitted WHERE part <> 'holdout'""",
)
def forecast(spark, sf):
    series, _, _ = models.forecast(t.rolled_sales(spark, sf), periods=12)
    return _rounded(series)


@query("forecast_metrics", f"""WITH {t.SALES_ROLLUP}, {forecast_sql(models.HINGES, models.SEASON_TERMS)} {_METRICS}""")
def forecast_metrics(spark, sf):
    _, metrics, _ = models.forecast(t.rolled_sales(spark, sf), periods=12)
    return metrics


@query(
    "forecast_season",
    f"""WITH {t.SALES_ROLLUP}, {forecast_sql(models.HINGES, models.SEASON_TERMS)}
SELECT CAST(month(ds) AS INTEGER) AS month, round(avg(yearly), 3) AS yearly FROM fitted WHERE part <> 'holdout' GROUP BY month(ds)""",
)
def forecast_season(spark, sf):
    from hearthpanel.operators.aggregates import seasonal_effect

    _, _, components = models.forecast(t.rolled_sales(spark, sf), periods=12)
    return seasonal_effect(components, "yearly").select("month", F.round("yearly", 3).alias("yearly"))


@query(
    "forecast_line",
    f"""WITH {t.SALES_ROLLUP}, {forecast_sql(0, 0, 18)}
SELECT province, part, ds, {_SERIES} FROM fitted WHERE part <> 'holdout'""",
)
def forecast_line(spark, sf):
    """The straight line that is left without hinges and seasons."""
    series, _, _ = models.forecast(t.rolled_sales(spark, sf), periods=18, hinges=0, seasons=0)
    return _rounded(series)


@query(
    "seasonal_effect",
    f"""WITH {t.SALES_ROLLUP} SELECT CAST(month AS INTEGER) AS month, round(avg(deal_count), 6) AS deal_count
FROM sales_rollup GROUP BY month""",
)
def seasonal_effect(spark, sf):
    from hearthpanel.operators.aggregates import seasonal_effect as effect

    rollup = t.rolled_sales(spark, sf).withColumn("ds", F.make_date("year", "month", F.lit(1)))
    return effect(rollup, "deal_count").select("month", r6("deal_count"))


@query(
    "holdout_errors",
    f"""WITH {PROVINCE_YEAR}, p AS (
  SELECT province, year, avg_price, lag(avg_price) OVER (PARTITION BY province ORDER BY year) AS yhat FROM province_year)
SELECT province, year, round(avg_price, 6) AS actual, round(yhat, 6) AS yhat, round_even(yhat - avg_price, 0) AS error,
       round_even((yhat - avg_price) / avg_price * 100, 2) AS error_pct FROM p WHERE yhat IS NOT NULL""",
)
def holdout_errors(spark, sf):
    yearly = build_panel({"sales": t.rolled_sales(spark, sf)}).select("province", "year", F.col("avg_price").alias("actual"))
    before = F.lag("actual").over(Window.partitionBy("province").orderBy("year"))
    naive = yearly.select("province", "year", before.alias("yhat")).filter("yhat IS NOT NULL")
    out = models.holdout_errors(yearly, naive, keys=["province", "year"])
    return out.select("province", "year", r6("actual"), r6("yhat"), "error", "error_pct")


@query(
    "dual_series_corr",
    f"""WITH {PANEL_YEARLY},
g AS (SELECT count(*) AS n, corr(deal_count, avg_price) AS r FROM panel WHERE province = 'ASIA')
SELECT n, round(r, 6) AS r, round({p_value_sql('r', 'n')}, 6) AS p FROM g""",
)
def dual_series_corr(spark, sf):
    yearly = build_panel({"sales": t.rolled_sales(spark, sf)}).filter(F.col("province") == "ASIA")
    return stats.pair_correlation(yearly, "deal_count", "avg_price").select("n", r6("r"), r6("p"))


