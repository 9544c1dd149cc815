"""Score, matching, formula, tax and return queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthpanel.operators import formulas, scores, tax, views
from hearthpanel.operators.ratios import with_balance_sheet_ratios
from hearthpanel.operators.windows import page
from hearthpanel.plans.panel import build_panel
from workloads import tables as t
from workloads.contracts import PROVINCE_YEAR, r6
from workloads.panel import LEASES_ONLY, PANEL_MONTHLY, PANEL_YEARLY
from workloads.registry import query

# ---- value score and grades -------------------------------------------------

PENSION = """
pension AS (SELECT district_code, year, n AS heads, CAST(billed AS DOUBLE) / n AS per_head FROM facts),
pension_year AS (
  SELECT district_code, sum(per_head * heads) / sum(heads) AS per_head FROM pension
  WHERE year = (SELECT coalesce(max(year) FILTER (year <= (SELECT max(year) FROM sales_rollup)), max(year)) FROM pension)
  GROUP BY district_code)"""


def _zscore(column: str) -> str:
    return (
        f"CASE WHEN stddev_samp({column}) OVER w > 0 THEN ({column} - avg({column}) OVER w) / stddev_samp({column}) OVER w "
        f"ELSE CAST({column} AS DOUBLE) END"
    )


VALUE = (
    t.SALES_ROLLUP
    + LEASES_ONLY
    + ","
    + t.lease_rollup_sql("deposit_only", "rent = 0")
    + ","
    + t.FACTS
    + ","
    + PENSION
    + f""",
y AS (SELECT max(year) AS y FROM sales_rollup),
d AS (SELECT district_code, province, avg(avg_price) FILTER (year = y) AS avg_price,
        CAST(sum(deal_count) FILTER (year = y) AS BIGINT) AS volume,
        avg(avg_price) FILTER (year = y - 2) AS before FROM sales_rollup, y GROUP BY district_code, province),
dep AS (SELECT district_code, avg(avg_deposit) AS avg_deposit FROM deposit_only, y WHERE year = y GROUP BY district_code),
v AS (SELECT d.*, dep.avg_deposit / avg_price * 100 AS deposit_ratio,
        avg_price / (pension_year.per_head * 12 / 10000) AS pir_pension,
        (avg_price - before) / before * 100 AS momentum
      FROM d LEFT JOIN dep USING (district_code) LEFT JOIN pension_year USING (district_code) WHERE avg_price IS NOT NULL),
u AS (SELECT *, 1 / nullif(pir_pension, 0) AS inverse_pir, -momentum AS cooling FROM v),
z AS (SELECT *, {_zscore('deposit_ratio')} AS z1, {_zscore('inverse_pir')} AS z2, {_zscore('volume')} AS z3, {_zscore('cooling')} AS z4
      FROM u WINDOW w AS (PARTITION BY province)),
scored AS (SELECT district_code, n_name AS district_name, z.province,
  coalesce(z1, 0) * 0.35e0 + coalesce(z2, 0) * 0.3e0 + coalesce(z3, 0) * 0.15e0 + coalesce(z4, 0) * 0.2e0 AS value_score,
  deposit_ratio, pir_pension, volume, momentum
  FROM z JOIN nation ON district_code = lpad(CAST(n_nationkey AS VARCHAR), 5, '0'))"""
)


def value_scores(spark, sf):
    return scores.value_score(
        t.rolled_sales(spark, sf),
        t.rolled_leases(spark, sf, "deposit_only"),
        t.indicators(spark, sf)["pension"],
        names=t.regions(spark, sf),
    )


@query(
    "value_score",
    f"""WITH {VALUE}
SELECT district_code, district_name, province, round(value_score, 6) AS value_score, round(deposit_ratio, 6) AS deposit_ratio,
  round(pir_pension, 6) AS pir_pension, volume, round(momentum, 6) AS momentum FROM scored""",
)
def value_score(spark, sf):
    return value_scores(spark, sf).select(
        "district_code", "district_name", "province", r6("value_score"), r6("deposit_ratio"), r6("pir_pension"),
        "volume", r6("momentum"),
    )


for _name, _order, _view in (
    ("top_under_valued", "DESC", views.undervalued),
    ("top_over_valued", "ASC", views.overvalued),
):

    @query(
        _name,
        f"""WITH {VALUE}
SELECT district_name || ' (' || province || ')' AS label, round(value_score, 6) AS value_score
FROM scored ORDER BY scored.value_score {_order}, district_code LIMIT 10""",
    )
    def _top(spark, sf, view=_view):
        return view(value_scores(spark, sf)).select("label", r6("value_score"))


GRADES = (
    t.SALES_ROLLUP
    + LEASES_ONLY
    + ","
    + t.FACTS
    + ","
    + PENSION
    + """,
y AS (SELECT max(year) AS y FROM sales_rollup),
d AS (SELECT district_code, province, avg(avg_price) FILTER (year = y) AS avg_price,
        avg(avg_unit_price) FILTER (year = y) AS avg_unit_price,
        CAST(sum(deal_count) FILTER (year = y) AS BIGINT) AS volume,
        avg(avg_price) FILTER (year = y - 3) AS before FROM sales_rollup, y GROUP BY district_code, province),
g AS (SELECT d.*, per_head AS income_level, (avg_price - before) / before * 100 AS growth_3y
      FROM d LEFT JOIN pension_year USING (district_code) WHERE avg_price IS NOT NULL),
m AS (SELECT median(avg_unit_price) AS mu, median(income_level) AS mi, median(growth_3y) AS mg FROM g),
f AS (SELECT g.*, coalesce(avg_unit_price, mu) AS a, coalesce(income_level, mi) AS b, coalesce(volume, 0) AS c,
        coalesce(growth_3y, mg) AS e FROM g, m),
r AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1, min(c) AS c0, max(c) AS c1, min(e) AS e0, max(e) AS e1 FROM f),
s AS (SELECT f.*, 0.4e0 * CASE WHEN a1 = a0 THEN 0.5e0 ELSE (a - a0) / (a1 - a0) END
        + 0.25e0 * CASE WHEN b1 = b0 THEN 0.5e0 ELSE (b - b0) / (b1 - b0) END
        + 0.2e0 * CASE WHEN c1 = c0 THEN 0.5e0 ELSE CAST(c - c0 AS DOUBLE) / (c1 - c0) END
        + 0.15e0 * CASE WHEN e1 = e0 THEN 0.5e0 ELSE (e - e0) / (e1 - e0) END AS grade_score FROM f, r),
grades AS (SELECT district_code, n_name AS district_name, s.province,
  CAST(row_number() OVER (ORDER BY grade_score DESC, district_code) AS INTEGER) AS grade, grade_score, avg_price, avg_unit_price,
  income_level, volume, growth_3y FROM s JOIN nation ON district_code = lpad(CAST(n_nationkey AS VARCHAR), 5, '0'))"""
)


def district_grades(spark, sf):
    return scores.rank_districts(
        t.rolled_sales(spark, sf), t.indicators(spark, sf)["pension"], names=t.regions(spark, sf)
    )


@query(
    "grade_rank",
    f"""WITH {GRADES}
SELECT district_code, district_name, province, grade, round(grade_score, 6) AS grade_score, round(avg_price, 6) AS avg_price,
  round(avg_unit_price, 6) AS avg_unit_price, round(income_level, 6) AS income_level, volume, round(growth_3y, 6) AS growth_3y
FROM grades""",
)
def grade_rank(spark, sf):
    return district_grades(spark, sf).select(
        "district_code", "district_name", "province", "grade", r6("grade_score"), r6("avg_price"), r6("avg_unit_price"),
        r6("income_level"), "volume", r6("growth_3y"),
    )


@query(
    "grade_page",
    f"""WITH {GRADES} SELECT grade, district_code FROM grades ORDER BY grade LIMIT 10 OFFSET 10""",
)
def grade_page(spark, sf):
    return page(district_grades(spark, sf), F.asc("grade"), number=2, size=10).select("grade", "district_code")


@query(
    "top_grades",
    f"""WITH {GRADES} SELECT grade, district_name || ' (' || province || ')' AS label FROM grades ORDER BY grade LIMIT 30""",
)
def top_grades(spark, sf):
    return views.top_grades(district_grades(spark, sf)).select("grade", "label")


# ---- market temperature -----------------------------------------------------

_CLAMP = "greatest(0e0, least(100e0, {}))"


@query(
    "temperature",
    f"""WITH {PANEL_YEARLY},
p AS (SELECT year, avg(buyer_superiority) AS b, avg(price_outlook) AS o, avg(price_yoy) AS c,
        avg(deal_count) AS m, min(deal_count) AS lo, max(deal_count) AS hi FROM panel GROUP BY year),
q AS (SELECT year, {_CLAMP.format('(200 - b) / 200 * 100')} AS buyers, {_CLAMP.format('o / 200 * 100')} AS outlook,
        (greatest(-20e0, least(20e0, c)) + 20) / 40 * 100 AS price_change,
        CASE WHEN hi > lo THEN (m - lo) / (hi - lo) * 100 END AS turnover, b, o, c FROM p),
w AS (SELECT year, CASE WHEN b IS NOT NULL THEN buyers END AS buyers, CASE WHEN o IS NOT NULL THEN outlook END AS outlook,
        CASE WHEN c IS NOT NULL THEN price_change END AS price_change, turnover FROM q),
s AS (SELECT *, round_even(coalesce((coalesce(buyers * 0.25e0, 0) + coalesce(outlook * 0.2e0, 0) + coalesce(price_change * 0.25e0, 0)
        + coalesce(turnover * 0.15e0, 0)) / nullif(CASE WHEN buyers IS NULL THEN 0 ELSE 0.25e0 END + CASE WHEN outlook IS NULL THEN 0 ELSE 0.2e0 END
        + CASE WHEN price_change IS NULL THEN 0 ELSE 0.25e0 END + CASE WHEN turnover IS NULL THEN 0 ELSE 0.15e0 END, 0), 50), 2) AS score FROM w)
SELECT year, score, round_even(coalesce(score - lag(score) OVER (ORDER BY year), 0), 2) AS delta,
  round_even(buyers, 2) AS buyers, round_even(outlook, 2) AS outlook, round_even(price_change, 2) AS price_change,
  round_even(turnover, 2) AS turnover FROM s""",
)
def temperature(spark, sf):
    return scores.market_temperature(build_panel(t.panel_sources(spark, sf)))


# ---- percentiles, purchasing power, matching --------------------------------

QUINTILE_ROWS = t.LEASES + """,
years AS (SELECT year, ntile_, avg(deposit) AS household_assets, avg(rent) AS household_debt, avg(balance) AS household_income
  FROM (SELECT year, deposit, rent, balance, CAST(1 + least(4, floor(deposit / 100000)) AS INTEGER) AS ntile_ FROM leases) x
  GROUP BY year, ntile_)"""


def quintiles(spark, sf):
    """Household balance sheet per year and price class, labelled like the survey."""
    classed = t.leases(spark, sf).withColumn(
        "quintile", F.concat((F.least(F.lit(4), F.floor(F.col("deposit") / 100000)) + 1).cast("string"), F.lit("분위"))
    )
    return classed.groupBy("year", "quintile").agg(
        F.avg("deposit").alias("household_assets"),
        F.avg("rent").alias("household_debt"),
        F.avg("balance").alias("household_income"),
    )


def _pchip_sql(column: str) -> str:
    """Monotone cubic interpolation over five knots, one SQL pipeline per column."""
    return f"""
k_{column} AS (
  SELECT year, 20e0 * ntile_ - 10 AS x, {column} AS y,
    row_number() OVER (PARTITION BY year ORDER BY ntile_) AS i, count(*) OVER (PARTITION BY year) AS n
  FROM years WHERE {column} IS NOT NULL),
s_{column} AS (
  SELECT *, lead(x) OVER v - x AS h, (lead(y) OVER v - y) / (lead(x) OVER v - x) AS m,
    x - lag(x) OVER v AS hp, (y - lag(y) OVER v) / (x - lag(x) OVER v) AS mp
  FROM k_{column} WHERE n >= 3 WINDOW v AS (PARTITION BY year ORDER BY x)),
e_{column} AS (
  SELECT *, lead(h) OVER v AS h2, lead(m) OVER v AS m2, lag(hp) OVER v AS hp2, lag(mp) OVER v AS mp2
  FROM s_{column} WINDOW v AS (PARTITION BY year ORDER BY x)),
t_{column} AS (
  SELECT *, CASE WHEN i = 1 THEN ((2 * h + h2) * m - h * m2) / (h + h2)
                 WHEN i = n THEN ((2 * hp + hp2) * mp - hp * mp2) / (hp + hp2) END AS raw,
    CASE WHEN i = 1 THEN m WHEN i = n THEN mp END AS m_a, CASE WHEN i = 1 THEN m2 WHEN i = n THEN mp2 END AS m_b
  FROM e_{column}),
d_{column} AS (
  SELECT year, x, y, i, n, h, CASE
    WHEN i > 1 AND i < n THEN CASE WHEN m * mp <= 0 THEN 0e0 ELSE
      (2 * h + hp + h + 2 * hp) / ((2 * h + hp) / mp + (h + 2 * hp) / m) END
    WHEN sign(raw) <> sign(m_a) THEN 0e0
    WHEN sign(m_a) <> sign(m_b) AND abs(raw) > 3 * abs(m_a) THEN 3 * m_a ELSE raw END AS d FROM t_{column}),
g_{column} AS (
  SELECT *, lead(y) OVER v AS y1, lead(d) OVER v AS d1, lead(x) OVER v AS x1 FROM d_{column} WINDOW v AS (PARTITION BY year ORDER BY x)),
p_{column} AS (
  SELECT year, percentile, greatest(0e0, y * (1 + 2 * q) * (1 - q) * (1 - q) + h * d * q * (1 - q) * (1 - q)
      + y1 * q * q * (3 - 2 * q) + h * d1 * q * q * (q - 1)) AS {column}
  FROM (SELECT *, (percentile - x) / h AS q FROM g_{column}, (SELECT CAST(unnest(range(1, 100)) AS INTEGER) AS percentile) r
        WHERE i < n AND (percentile >= x OR i = 1) AND (percentile < x1 OR i = n - 1)) c)"""


PERCENTILES = QUINTILE_ROWS + "".join("," + _pchip_sql(c) for c in ("household_assets", "household_debt", "household_income")) + """,
pct AS (SELECT year, percentile, household_assets, household_debt, household_income
  FROM p_household_assets LEFT JOIN p_household_debt USING (year, percentile) LEFT JOIN p_household_income USING (year, percentile))"""

BALANCE = ["household_assets", "household_debt", "household_income"]


@query(
    "pchip",
    f"""WITH {PERCENTILES}
SELECT year, percentile, {", ".join(f"round({c}, 5) AS {c}" for c in BALANCE)} FROM pct""",
)
def pchip(spark, sf):
    out = scores.quintile_to_percentile(quintiles(spark, sf), columns=BALANCE, by_year=True)
    return out.select("year", "percentile", *(F.round(c, 5).alias(c) for c in BALANCE))


_ANNUITY = (1 - (1 + 3.5 / 100 / 12) ** (-360)) / (3.5 / 100 / 12)
POWER = PERCENTILES + f""",
cap AS (SELECT year, percentile, household_assets - household_debt AS net_worth, household_income AS annual_income,
    coalesce(household_income * greatest(0e0, 0.4e0 - coalesce(CASE WHEN household_income > 0 THEN household_debt / household_income * 100 END, 0) / 100)
      / 12 * {_ANNUITY!r}, 0) AS loan_capacity FROM pct),
power AS (SELECT *, greatest(0e0, net_worth + loan_capacity) AS purchasing_power FROM cap)"""


def household_power(spark, sf, *, year=None):
    pct = scores.quintile_to_percentile(quintiles(spark, sf), columns=BALANCE, by_year=True)
    if year is not None:
        pct = pct.filter(F.col("year") == year)
    sheet = with_balance_sheet_ratios(pct)
    return scores.purchasing_power(sheet.withColumn("debt_to_income", F.coalesce("debt_to_income", F.lit(0.0))))


@query(
    "purchasing_power",
    f"""WITH {POWER}
SELECT year, percentile, round(net_worth, 4) AS net_worth, round(annual_income, 4) AS annual_income,
  round(loan_capacity, 4) AS loan_capacity, round(purchasing_power, 4) AS purchasing_power FROM power""",
)
def purchasing_power(spark, sf):
    out = household_power(spark, sf)
    names = ["net_worth", "annual_income", "loan_capacity", "purchasing_power"]
    return out.select("year", "percentile", *(F.round(c, 4).alias(c) for c in names))


# The two CTE chains share the region and lease definitions.
_POWER_ONLY = POWER[len(t.LEASES):]


@query(
    "income_match",
    f"""WITH {GRADES}{_POWER_ONLY},
band AS (SELECT (percentile - 1) // 10 AS band, median(purchasing_power) / 8 AS power FROM power WHERE year = 2000 GROUP BY band),
best AS (SELECT band, min(grade) AS grade FROM band JOIN grades ON avg_price <= power GROUP BY band)
SELECT CAST(band * 10 + 1 AS VARCHAR) || '~' || CAST(least(band * 10 + 10, 99) AS VARCHAR) || '%' AS percentile_group,
  round(power, 4) AS purchasing_power, grade, coalesce(district_name, '구매불가') AS districts,
  round(avg_price, 4) AS market_price, round(power - avg_price, 4) AS gap
FROM band LEFT JOIN best USING (band) LEFT JOIN grades USING (grade)""",
)
def income_match(spark, sf):
    power = household_power(spark, sf, year=2000)
    scaled = power.withColumn("purchasing_power", F.col("purchasing_power") / 8)
    out = scores.match_income(scaled, district_grades(spark, sf), digits=None)
    rounded = [F.round(c, 4).alias(c) for c in ("purchasing_power", "market_price", "gap")]
    return out.select("percentile_group", "grade", "districts", *rounded)


# ---- formulas ---------------------------------------------------------------


@query(
    "formulas",
    f"""WITH {PANEL_YEARLY}
SELECT province, year, round(avg_price / (pension_per_head * 12 / 10000), 6) AS pir_pension,
  round(deposit_only_avg_deposit / avg_price * 100, 6) AS deposit_ratio_pct,
  round(CAST(permits AS DOUBLE) / population * 1000, 6) AS supply_intensity,
  round(log10(deal_count) - sqrt(abs(1 - deposit_ratio / 100)), 6) AS mixed FROM panel""",
)
def formula_columns(spark, sf):
    panel = build_panel(t.panel_sources(spark, sf))
    chosen = {k: formulas.PRESETS[k] for k in ("pir_pension", "deposit_ratio_pct", "supply_intensity")}
    out = formulas.with_formulas(panel, {**chosen, "mixed": "log10(deal_count) - sqrt(abs(1 - deposit_ratio / 100))"})
    return out.select("province", "year", *(r6(c) for c in (*chosen, "mixed")))


@query(
    "formula_check",
    f"""WITH {PROVINCE_YEAR}
SELECT count(*) AS valid_rows, round(min_by(ln(deal_count) / avg_price * 1000, province || year), 6) AS first_value, 'deal_count' AS zero_prone
FROM province_year WHERE deal_count > 0 AND avg_price <> 0""",
)
def formula_check(spark, sf):
    panel = build_panel({"sales": t.rolled_sales(spark, sf)})
    out = formulas.check_formula(panel, "log(deal_count) / avg_price * 1000")
    return out.select("valid_rows", r6("first_value"), "zero_prone")


@query(
    "formula_compare",
    f"""WITH {PANEL_MONTHLY},
a AS (SELECT ym, avg_price / max(CASE WHEN ym = '1996-01' THEN avg_price END) OVER () * 100 AS x,
        deal_count / max(CASE WHEN ym = '1996-01' THEN CAST(deal_count AS DOUBLE) END) OVER () * 100 AS y
      FROM panel_m WHERE province = 'EUROPE')
SELECT count(*) AS n, round(corr(x, y), 6) AS r FROM a""",
)
def formula_compare(spark, sf):
    panel = build_panel({"sales": t.rolled_sales(spark, sf)}, freq="monthly")
    out = formulas.compare_formulas(
        panel, "avg_price", "deal_count", province="EUROPE", mode="index100", base_period="1996-01", order_by="ym"
    )
    return out.select("n", r6("r"))


# ---- views ------------------------------------------------------------------


@query(
    "migration_view",
    f"""WITH {PANEL_YEARLY}
SELECT province, year, 'moved_in' AS series, CAST(moved_in AS DOUBLE) AS value FROM panel UNION ALL
SELECT province, year, 'moved_out', CAST(moved_out AS DOUBLE) FROM panel UNION ALL
SELECT province, year, 'net_moved', CAST(net_moved AS DOUBLE) FROM panel""",
)
def migration_view(spark, sf):
    sources = t.panel_sources(spark, sf)
    return views.migration_view(build_panel({k: sources[k] for k in ("sales", "migration")}))


@query(
    "supply_view",
    f"""WITH {PANEL_MONTHLY}
SELECT province, ym, 'permits' AS series, CAST(permits AS DOUBLE) AS value FROM panel_m WHERE province = 'ASIA' AND permits IS NOT NULL UNION ALL
SELECT province, ym, 'starts', CAST(starts AS DOUBLE) FROM panel_m WHERE province = 'ASIA' AND starts IS NOT NULL UNION ALL
SELECT province, ym, 'completions', CAST(completions AS DOUBLE) FROM panel_m WHERE province = 'ASIA' AND completions IS NOT NULL""",
)
def supply_view(spark, sf):
    sources = t.panel_sources(spark, sf)
    panel = build_panel({k: sources[k] for k in ("sales", "permits", "construction")}, freq="monthly")
    return views.supply_view(panel, province="ASIA", period="ym").filter("value IS NOT NULL")


@query(
    "normalised_view",
    f"""WITH {PROVINCE_YEAR}, a AS (SELECT * FROM province_year WHERE province = 'AFRICA'),
r AS (SELECT min(avg_price) AS p0, max(avg_price) AS p1, min(deal_count) AS d0, max(deal_count) AS d1 FROM a)
SELECT province, year, 'avg_price' AS series, round((avg_price - p0) / (p1 - p0), 6) AS value FROM a, r UNION ALL
SELECT province, year, 'deal_count', round(CAST(deal_count - d0 AS DOUBLE) / (d1 - d0), 6) FROM a, r""",
)
def normalised_view(spark, sf):
    panel = build_panel({"sales": t.rolled_sales(spark, sf)})
    return views.normalised_view(panel, ["avg_price", "deal_count"], province="AFRICA").withColumn("value", r6("value"))


@query(
    "unsold_view",
    f"""WITH {PANEL_YEARLY} SELECT province, unsold_mean FROM panel WHERE year = (SELECT max(year) FROM panel)""",
)
def unsold_view(spark, sf):
    sources = t.panel_sources(spark, sf)
    panel = build_panel({k: sources[k] for k in ("sales", "unsold")})
    return views.unsold_view(panel, "unsold_mean", latest=True)


@query(
    "gap_view",
    f"""WITH {PANEL_YEARLY}
SELECT year, round(avg_price - deposit_only_avg_deposit, 6) AS deposit_gap,
  round(deposit_only_avg_deposit / avg_price * 100, 6) AS gap_deposit_ratio FROM panel WHERE province = 'AMERICA'""",
)
def gap_view(spark, sf):
    panel = build_panel({"sales": t.rolled_sales(spark, sf), "deposit_only": t.rolled_leases(spark, sf, "deposit_only")})
    out = views.gap_view(panel, province="AMERICA")
    return out.select("year", r6("deposit_gap"), r6("gap_deposit_ratio"))


# ---- taxes and returns over all contracts -----------------------------------

TAX_ROWS = t.SALES + """,
deals AS (
  SELECT l_orderkey, l_linenumber, CAST(amount * 2 AS DOUBLE) AS price, CAST(amount AS DOUBLE) AS buy,
    amount * (1 + l_discount * 10 + l_tax * 5) * 1.5e0 AS sell, area * 3 AS area,
    CAST(l_linenumber AS INTEGER) AS held, CAST(l_orderkey % 5 AS INTEGER) AS lived,
    CAST(1 + l_suppkey % 3 AS INTEGER) AS homes, l_orderkey % 2 = 0 AS adjusted, l_orderkey % 3 = 0 AS first_home,
    CAST(amount AS DOUBLE) * 0.4e0 AS loan, CAST(amount AS DOUBLE) * 0.002e0 AS rent FROM sales)"""


def deals(spark, sf):
    amount = F.col("amount").cast("double")
    return t.sales(spark, sf, detail=True).select(
        "l_orderkey",
        "l_linenumber",
        (amount * 2).alias("price"),
        amount.alias("buy"),
        (F.col("amount") * (1 + F.col("l_discount") * 10 + F.col("l_tax") * 5) * 1.5).alias("sell"),
        (F.col("area") * 3).alias("area"),
        F.col("l_linenumber").cast("int").alias("held"),
        (F.col("l_orderkey") % 5).cast("int").alias("lived"),
        (F.col("l_suppkey") % 3 + 1).cast("int").alias("homes"),
        (F.col("l_orderkey") % 2 == 0).alias("adjusted"),
        (F.col("l_orderkey") % 3 == 0).alias("first_home"),
        (amount * 0.4).alias("loan"),
        (amount * 0.002).alias("rent"),
    )


@query(
    "acquisition_tax",
    f"""WITH {TAX_ROWS},
a AS (SELECT *, price / 10000 AS eok FROM deals),
b AS (SELECT *, CASE WHEN homes >= 3 THEN CASE WHEN adjusted THEN 0.12e0 ELSE 0.08e0 END
    WHEN homes = 2 AND adjusted THEN 0.08e0 WHEN eok <= 6 THEN 0.01e0
    WHEN eok <= 9 THEN 0.01e0 + (eok - 6) / 3e0 * 0.02e0 ELSE 0.03e0 END AS rate FROM a),
c AS (SELECT *, greatest(0e0, price * rate - CASE WHEN first_home AND homes = 1 THEN
    CASE WHEN eok <= 1.5e0 THEN price * rate WHEN eok <= 12 THEN least(price * rate, 200e0) ELSE 0e0 END ELSE 0e0 END) AS tax FROM b)
SELECT l_orderkey, l_linenumber, rate * 100 AS acquisition_rate_pct, tax AS acquisition_tax, tax * 0.1e0 AS education_tax,
  CASE WHEN area <= 85 THEN 0e0 ELSE tax * 0.1e0 END AS rural_tax,
  round(tax + tax * 0.1e0 + CASE WHEN area <= 85 THEN 0e0 ELSE tax * 0.1e0 END, 6) AS acquisition_total FROM c""",
)
def acquisition_tax(spark, sf):
    out = tax.with_acquisition_tax(
        deals(spark, sf), price="price", homes="homes", area="area", first_home="first_home", adjusted="adjusted", digits=False
    )
    return out.select(
        "l_orderkey", "l_linenumber", "acquisition_rate_pct", "acquisition_tax", "education_tax", "rural_tax",
        r6("acquisition_total"),
    )


_RATE = " ".join(f"WHEN base <= {limit!r}e0 THEN {rate!r}e0" for limit, rate, _ in tax.GAIN_BRACKETS if limit) + " ELSE 0.45e0"
_CUT = " ".join(f"WHEN base <= {limit!r}e0 THEN {cut!r}e0" for limit, _, cut in tax.GAIN_BRACKETS if limit) + " ELSE 6540e0"


@query(
    "capital_gains_tax",
    f"""WITH {TAX_ROWS},
a AS (SELECT *, sell - buy AS gain, homes = 1 AND held >= 2 AND lived >= 2 AS qualified FROM deals),
b AS (SELECT *, gain > 0 AND qualified AND sell / 10000 <= 12 AS exempt,
    CASE WHEN qualified AND sell / 10000 > 12 THEN gain * ((sell - 120000) / sell) ELSE gain END AS share,
    CASE WHEN homes = 1 AND lived >= 2 THEN least(least(held * 0.02e0, 0.4e0) + least(lived * 0.04e0, 0.4e0), 0.8e0)
         WHEN held >= 3 THEN least((held - 2) * 0.02e0, 0.3e0) ELSE 0e0 END AS rate0 FROM a),
c AS (SELECT *, gain > 0 AND NOT exempt AS taxed, greatest(0e0, greatest(0e0, share - share * rate0) - 250) AS base FROM b),
d AS (SELECT *, CASE {_RATE} END AS rate, CASE {_CUT} END AS cut,
    CASE WHEN homes = 2 THEN 0.2e0 WHEN homes >= 3 THEN 0.3e0 ELSE 0e0 END AS extra FROM c),
e AS (SELECT *, greatest(0e0, base * rate - cut + base * extra) AS tax FROM d)
SELECT l_orderkey, l_linenumber, gain, CASE WHEN taxed THEN share * rate0 ELSE 0e0 END AS long_holding_deduction,
  CASE WHEN taxed THEN base ELSE 0e0 END AS tax_base, CASE WHEN taxed THEN tax ELSE 0e0 END AS gains_tax,
  CASE WHEN taxed THEN tax * 0.1e0 ELSE 0e0 END AS local_income_tax, exempt AS is_exempt FROM e""",
)
def capital_gains_tax(spark, sf):
    out = tax.with_capital_gains_tax(
        deals(spark, sf), buy="buy", sell="sell", holding_years="held", residence_years="lived",
        one_home=F.col("homes") == 1, homes="homes", digits=False,
    )
    return out.select(
        "l_orderkey", "l_linenumber", "gain", "long_holding_deduction", "tax_base", "gains_tax", "local_income_tax", "is_exempt"
    )


@query(
    "investment_return",
    f"""WITH {TAX_ROWS},
a AS (SELECT *, greatest(buy + 500 - loan, 1e0) AS equity, loan * (3.5e0 / 100) * held AS interest, rent * 12 * held AS rental,
    30e0 * held AS upkeep FROM deals),
b AS (SELECT *, 500 + interest + upkeep + 0 AS cost, sell - buy + rental AS gross FROM a),
c AS (SELECT *, gross - cost AS net FROM b)
SELECT l_orderkey, l_linenumber, round(equity, 4) AS equity, round(gross, 4) AS gross_profit, round(net, 4) AS net_profit,
  round(net / equity * 100, 4) AS roe_pct,
  round(CASE WHEN equity + net > 0 THEN (pow((equity + net) / equity, 1e0 / held) - 1) * 100 ELSE -100 END, 5) AS annual_return_pct,
  round(cost, 4) AS total_cost, round(buy + 500 + interest + upkeep - rental, 4) AS break_even_price FROM c WHERE held > 0""",
)
def investment_return(spark, sf):
    out = tax.with_investment_return(
        deals(spark, sf), buy="buy", sell="sell", holding_years="held", loan="loan", monthly_income="rent",
        annual_expenses=30, acquisition_tax=500, digits=False,
    )
    names = ["equity", "gross_profit", "net_profit", "roe_pct", "total_cost", "break_even_price"]
    return out.filter("held > 0").select(
        "l_orderkey", "l_linenumber", *(F.round(c, 4).alias(c) for c in names), F.round("annual_return_pct", 5).alias("annual_return_pct")
    )
