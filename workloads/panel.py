"""Down-sampling, derived ratios and the full region panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthpanel.functions.numeric import ratio
from hearthpanel.operators import aggregates as agg
from hearthpanel.operators import joins, ratios, scope
from hearthpanel.plans.panel import build_panel
from workloads import tables as t
from workloads.contracts import PROVINCE_YEAR, r6
from workloads.registry import query

FACTS = t.LEASES + "," + t.FACTS
SUMS = ", ".join(
    f"CAST(sum({c}) AS BIGINT) AS {c}"
    for c in ("n", "open_n", "done_n", "part_n", "urgent_n", "low_n", "billed", "balances", "urgent_billed")
)
GRAINS = f"""
by_month AS (SELECT province, year, month, {SUMS} FROM facts GROUP BY province, year, month),
by_year AS (SELECT province, year, {SUMS} FROM facts GROUP BY province, year),
by_nation AS (SELECT year, month, {SUMS} FROM facts GROUP BY year, month)"""


def _lease_year(kind: str, rent: bool, keys: str) -> str:
    extra = f", sum(avg_rent * lease_count) / sum(lease_count) AS {kind}_avg_rent" if rent else ""
    return f"""
{kind}_p AS (SELECT {keys}, sum(avg_deposit * lease_count) / sum(lease_count) AS {kind}_avg_deposit,
  CAST(sum(lease_count) AS BIGINT) AS {kind}_count,
  sum(deposit_unit * lease_count) / sum(lease_count) AS {kind}_deposit_unit{extra}
  FROM {kind} GROUP BY {keys})"""


def _lease_blocks(keys: str) -> str:
    return ",".join(_lease_year(k, k != "deposit_only", keys) for k in t.LEASE_WHERE)


# The sale CTEs already define the regions, the lease CTEs must not again.
LEASES_ONLY = t.LEASES[len(t.REGIONS):]

PANEL_YEARLY = (
    PROVINCE_YEAR
    + LEASES_ONLY
    + ","
    + t.LEASE_ROLLUPS
    + ","
    + t.FACTS
    + ","
    + GRAINS
    + ","
    + _lease_blocks("province, year")
    + """,
monthly_sums AS (
  SELECT province, year, CAST(sum(open_n) AS BIGINT) AS permits, CAST(sum(open_n) AS BIGINT) AS starts,
    CAST(sum(part_n) AS BIGINT) AS completions, CAST(sum(part_n - low_n) AS BIGINT) AS land_price_change,
    CAST(sum(open_n) AS BIGINT) AS moved_in, CAST(sum(done_n) AS BIGINT) AS moved_out,
    CAST(sum(open_n - done_n) AS BIGINT) AS net_moved,
    avg(done_n) AS unsold_mean, avg(low_n) AS conversion_rate
  FROM by_month GROUP BY province, year),
income_p AS (
  SELECT province, year, n AS earners, billed AS pay_total,
    CASE WHEN n > 0 AND billed > 0 THEN CAST(billed AS DOUBLE) / n END AS pay_per_head,
    CASE WHEN urgent_n > 0 THEN CAST(urgent_billed AS DOUBLE) / urgent_n END AS tax_per_head FROM by_year),
december AS (
  SELECT province, year, CAST(billed AS DOUBLE) AS mortgage_balance,
    CAST(urgent_billed AS DOUBLE) / billed * 100 AS mortgage_share,
    CAST(billed AS DOUBLE) / n AS sale_index, CAST(done_n AS DOUBLE) / n * 200 AS buyer_superiority
  FROM by_month WHERE month = 12),
december_nation AS (
  SELECT year, CAST(urgent_n AS DOUBLE) / n AS base_rate, CAST(open_n AS DOUBLE) / n * 200 AS price_outlook
  FROM by_nation WHERE month = 12),
panel AS (
  SELECT p.province, p.year, p.avg_price, p.deal_count, p.avg_unit_price,
    d.* EXCLUDE (province, year), w.* EXCLUDE (province, year), a.* EXCLUDE (province, year),
    y.n AS pension_subscribers, CASE WHEN y.n > 0 THEN CAST(y.billed AS DOUBLE) / y.n END AS pension_per_head,
    y.urgent_n AS pension_workplaces, y.open_n - y.done_n AS pension_net_hires,
    s.* EXCLUDE (province, year),
    y.n * 40 AS population, y.billed AS grdp,
    CAST(y.billed AS DOUBLE) / y.n AS household_assets, CAST(y.urgent_billed AS DOUBLE) / y.n AS household_debt,
    CAST(y.balances AS DOUBLE) / y.n AS household_income,
    i.* EXCLUDE (province, year), e.* EXCLUDE (province, year), g.* EXCLUDE (year),
    d.deposit_only_avg_deposit / nullif(p.avg_price, 0) * 100 AS deposit_ratio,
    p.avg_price / nullif(CAST(y.balances AS DOUBLE) / y.n, 0) AS pir,
    p.avg_price / nullif(CAST(y.billed AS DOUBLE) / y.n * 12 / 10000, 0) AS pir_pension,
    p.deal_count / nullif(CAST(y.n * 40 AS DOUBLE), 0) * 1000 AS turnover,
    d.deposit_only_count / nullif(CAST(y.n * 40 AS DOUBLE), 0) * 1000 AS lease_turnover,
    e.mortgage_balance * 100000 / nullif(CAST(y.balances AS DOUBLE) / y.n, 0) AS loan_to_income,
    (p.avg_price / lag(p.avg_price) OVER (PARTITION BY p.province ORDER BY p.year) - 1) * 100 AS price_yoy
  FROM province_year p
  LEFT JOIN deposit_only_p d USING (province, year) LEFT JOIN monthly_rent_p w USING (province, year)
  LEFT JOIN all_leases_p a USING (province, year) LEFT JOIN by_year y USING (province, year)
  LEFT JOIN monthly_sums s USING (province, year) LEFT JOIN income_p i USING (province, year)
  LEFT JOIN december e USING (province, year) LEFT JOIN december_nation g USING (year))"""
)

DOUBLES = [
    "avg_price", "avg_unit_price",
    "deposit_only_avg_deposit", "deposit_only_deposit_unit",
    "monthly_rent_avg_deposit", "monthly_rent_deposit_unit", "monthly_rent_avg_rent",
    "all_leases_avg_deposit", "all_leases_deposit_unit", "all_leases_avg_rent",
    "pension_per_head", "unsold_mean", "conversion_rate", "household_assets", "household_debt", "household_income",
    "pay_per_head", "tax_per_head", "mortgage_balance", "mortgage_share", "sale_index", "buyer_superiority",
    "base_rate", "price_outlook", "deposit_ratio", "pir", "pir_pension", "turnover", "lease_turnover", "price_yoy",
]
COUNTS = [
    "deal_count", "deposit_only_count", "monthly_rent_count", "all_leases_count",
    "pension_subscribers", "pension_workplaces", "pension_net_hires",
    "permits", "starts", "completions", "land_price_change", "moved_in", "moved_out", "net_moved",
    "population", "grdp", "earners", "pay_total",
]


def _rounded(doubles: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in doubles)


# Loan over income divides by a small mean and runs to 1e10; four digits are exact there.
@query(
    "panel_yearly",
    f"""WITH {PANEL_YEARLY}
SELECT province, year, {", ".join(COUNTS)}, {_rounded(DOUBLES)}, round(loan_to_income, 2) AS loan_to_income FROM panel""",
)
def panel_yearly(spark, sf):
    panel = build_panel(t.panel_sources(spark, sf), freq="yearly")
    return panel.select(
        "province", "year", *COUNTS, *(r6(c) for c in DOUBLES), F.round("loan_to_income", 2).alias("loan_to_income")
    )


MONTHLY_COUNTS = [
    "deal_count", "deposit_only_count", "monthly_rent_count", "all_leases_count",
    "pension_subscribers", "permits", "starts", "completions", "net_moved", "unsold", "conversion_rate", "population", "earners",
]
MONTHLY_DOUBLES = [
    "avg_price", "avg_unit_price", "deposit_only_avg_deposit", "all_leases_avg_rent", "pension_per_head",
    "household_income", "pay_per_head", "mortgage_balance", "sale_index", "buyer_superiority", "base_rate",
    "price_outlook", "deposit_ratio", "pir", "turnover",
]

PANEL_MONTHLY = (
    t.SALES_ROLLUP
    + LEASES_ONLY
    + ","
    + t.LEASE_ROLLUPS
    + ","
    + t.FACTS
    + ","
    + GRAINS
    + ","
    + _lease_blocks("province, year, month")
    + """,
panel_m AS (
  SELECT p.*, d.deposit_only_avg_deposit, d.deposit_only_count, w.monthly_rent_count, a.all_leases_count, a.all_leases_avg_rent,
    m.n AS pension_subscribers, CASE WHEN m.n > 0 THEN CAST(m.billed AS DOUBLE) / m.n END AS pension_per_head,
    m.open_n AS permits, m.open_n AS starts, m.part_n AS completions, m.open_n - m.done_n AS net_moved,
    m.done_n AS unsold, m.low_n AS conversion_rate,
    y.n * 40 AS population, y.n AS earners, CAST(y.balances AS DOUBLE) / y.n AS household_income,
    CASE WHEN y.n > 0 AND y.billed > 0 THEN CAST(y.billed AS DOUBLE) / y.n END AS pay_per_head,
    CAST(m.billed AS DOUBLE) AS mortgage_balance, CAST(m.billed AS DOUBLE) / m.n AS sale_index,
    CAST(m.done_n AS DOUBLE) / m.n * 200 AS buyer_superiority,
    CAST(c.urgent_n AS DOUBLE) / c.n AS base_rate, CAST(c.open_n AS DOUBLE) / c.n * 200 AS price_outlook,
    d.deposit_only_avg_deposit / nullif(p.avg_price, 0) * 100 AS deposit_ratio,
    p.avg_price / nullif(CAST(y.balances AS DOUBLE) / y.n, 0) AS pir,
    p.deal_count / nullif(CAST(y.n * 40 AS DOUBLE), 0) * 1000 AS turnover
  FROM (SELECT province, year, month, CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS ym,
          sum(avg_price * deal_count) / sum(deal_count) AS avg_price, CAST(sum(deal_count) AS BIGINT) AS deal_count,
          sum(avg_unit_price * deal_count) / sum(deal_count) AS avg_unit_price
        FROM sales_rollup GROUP BY province, year, month) p
  LEFT JOIN deposit_only_p d USING (province, year, month) LEFT JOIN monthly_rent_p w USING (province, year, month)
  LEFT JOIN all_leases_p a USING (province, year, month) LEFT JOIN by_month m USING (province, year, month)
  LEFT JOIN by_year y USING (province, year) LEFT JOIN by_nation c USING (year, month))"""
)


@query(
    "panel_monthly",
    f"""WITH {PANEL_MONTHLY}
SELECT province, year, month, ym, {", ".join(MONTHLY_COUNTS)}, {_rounded(MONTHLY_DOUBLES)} FROM panel_m""",
)
def panel_monthly(spark, sf):
    panel = build_panel(t.panel_sources(spark, sf), freq="monthly")
    return panel.select("province", "year", "month", "ym", *MONTHLY_COUNTS, *(r6(c) for c in MONTHLY_DOUBLES))


@query(
    "downsample_rules",
    f"""WITH {FACTS}, {GRAINS}
SELECT province, year, CAST(sum(open_n) AS BIGINT) AS permits, avg(done_n) AS unsold,
       max(CASE WHEN month = 12 THEN CAST(billed AS DOUBLE) END) AS mortgage_balance
FROM by_month GROUP BY province, year""",
)
def downsample_rules(spark, sf):
    series = t.indicators(spark, sf)
    keys = t.PROVINCE_MONTH
    monthly = series["permits"].join(series["unsold"], keys).join(series["loans"].drop("mortgage_share"), keys)
    return agg.downsample(monthly, {c: agg.YEARLY_RULES[c] for c in ("permits", "unsold", "mortgage_balance")})


@query(
    "province_pension",
    f"""WITH {FACTS}, {GRAINS}
SELECT province, year, n AS pension_subscribers, urgent_n AS pension_workplaces, open_n - done_n AS pension_net_hires,
       CAST(billed AS DOUBLE) / n AS pension_per_head FROM by_year""",
)
def province_pension(spark, sf):
    return agg.province_pension(t.indicators(spark, sf)["pension"])


@query(
    "province_leases",
    f"""WITH {t.LEASES}, {t.lease_rollup_sql('monthly_rent', 'rent > 0')}
SELECT province, year, round(sum(avg_deposit * lease_count) / sum(lease_count), 6) AS avg_deposit,
       CAST(sum(lease_count) AS BIGINT) AS lease_count,
       round(sum(deposit_unit * lease_count) / sum(lease_count), 6) AS deposit_unit,
       round(sum(avg_rent * lease_count) / sum(lease_count), 6) AS avg_rent
FROM monthly_rent GROUP BY province, year""",
)
def province_leases(spark, sf):
    out = agg.province_leases(t.rolled_leases(spark, sf, "monthly_rent"))
    return out.select("province", "year", r6("avg_deposit"), "lease_count", r6("deposit_unit"), r6("avg_rent"))


@query(
    "province_income",
    f"""WITH {FACTS}, {GRAINS}
SELECT province, year, n AS earners, billed AS pay_total,
       CASE WHEN n > 0 AND billed > 0 THEN CAST(billed AS DOUBLE) / n END AS pay_per_head,
       CASE WHEN urgent_n > 0 THEN CAST(urgent_billed AS DOUBLE) / urgent_n END AS tax_per_head FROM by_year""",
)
def province_income(spark, sf):
    return agg.province_income(t.indicators(spark, sf)["income"])


@query(
    "district_series",
    f"""WITH {t.SALES_ROLLUP}
SELECT province, district_code, year, round(avg(avg_price), 6) AS avg_price, CAST(sum(deal_count) AS BIGINT) AS deal_count,
       round(avg(avg_unit_price), 6) AS avg_unit_price
FROM sales_rollup GROUP BY province, district_code, year""",
)
def district_series(spark, sf):
    out = agg.district_series(t.rolled_sales(spark, sf), period="year")
    return out.select("province", "district_code", "year", r6("avg_price"), "deal_count", r6("avg_unit_price"))


@query(
    "lease_district_series",
    f"""WITH {t.LEASES}, {t.lease_rollup_sql('all_leases', 'TRUE')}
SELECT province, district_code, ym, round(avg(avg_deposit), 6) AS avg_deposit, CAST(sum(lease_count) AS BIGINT) AS lease_count,
       round(avg(deposit_unit), 6) AS deposit_unit, round(avg(avg_rent), 6) AS avg_rent
FROM all_leases GROUP BY province, district_code, ym""",
)
def lease_district_series(spark, sf):
    out = agg.district_series(t.rolled_leases(spark, sf, "all_leases"), period="ym")
    return out.select(
        "province", "district_code", "ym", r6("avg_deposit"), "lease_count", r6("deposit_unit"), r6("avg_rent")
    )


@query(
    "district_summary",
    f"""WITH {t.SALES_ROLLUP}
SELECT district_code, min(province) AS province, round(avg(avg_price), 6) AS avg_price,
       CAST(sum(deal_count) AS BIGINT) AS deal_count, round(avg(avg_unit_price), 6) AS avg_unit_price
FROM sales_rollup GROUP BY district_code""",
)
def district_summary(spark, sf):
    out = agg.district_summary(t.rolled_sales(spark, sf))
    return out.select("district_code", "province", r6("avg_price"), "deal_count", r6("avg_unit_price"))


@query(
    "kpi",
    f"""WITH {PANEL_YEARLY},
latest AS (SELECT max(year) AS y FROM sales_rollup),
k AS (SELECT max(year) AS year, avg(avg_price) FILTER (year = y) AS price, avg(avg_price) FILTER (year = y - 1) AS price_before,
        CAST(sum(deal_count) FILTER (year = y) AS BIGINT) AS volume,
        CAST(sum(deal_count) FILTER (year = y - 1) AS BIGINT) AS volume_before
      FROM sales_rollup, latest),
r AS (SELECT avg(deposit_ratio) FILTER (year = y) AS now, avg(deposit_ratio) FILTER (year = y - 1) AS before FROM panel, latest)
SELECT year, round(price, 6) AS price, round(price_before, 6) AS price_before, volume, volume_before,
  round((price - price_before) / price_before * 100, 6) AS price_change_pct, volume - volume_before AS volume_change,
  round(now, 6) AS deposit_ratio, round(before, 6) AS deposit_ratio_before, round(now - before, 6) AS deposit_ratio_change
FROM k, r""",
)
def kpi(spark, sf):
    sales = t.rolled_sales(spark, sf)
    panel = build_panel({"sales": sales, "deposit_only": t.rolled_leases(spark, sf, "deposit_only")})
    out = agg.headline_kpis(sales, panel)
    return out.select(
        "year", r6("price"), r6("price_before"), "volume", "volume_before", r6("price_change_pct"), "volume_change",
        r6("deposit_ratio"), r6("deposit_ratio_before"), r6("deposit_ratio_change"),
    )


@query(
    "national_trend",
    f"""WITH {PANEL_MONTHLY}
SELECT year, round(avg(avg_price), 6) AS avg_price, round(avg(sale_index), 6) AS sale_index,
       CAST(sum(deal_count) AS BIGINT) AS deal_count, CAST(sum(unsold) AS BIGINT) AS unsold
FROM panel_m GROUP BY year""",
)
def national_trend(spark, sf):
    panel = build_panel(t.panel_sources(spark, sf), freq="monthly")
    out = agg.national_trend(panel, means=["avg_price", "sale_index"], sums=["deal_count", "unsold"])
    return out.select("year", r6("avg_price"), r6("sale_index"), "deal_count", "unsold")


@query(
    "province_series",
    f"""WITH {t.SALES_ROLLUP}
SELECT province, year, round(avg(avg_price), 6) AS avg_price, round(avg(deal_count), 6) AS deal_count
FROM sales_rollup WHERE year = (SELECT max(year) FROM sales_rollup) GROUP BY province, year""",
)
def province_series(spark, sf):
    latest = scope.latest_period(t.rolled_sales(spark, sf))
    out = agg.province_series(latest, ["avg_price", "deal_count"])
    return out.select("province", "year", r6("avg_price"), r6("deal_count"))


@query(
    "scope_filter",
    f"""WITH {t.SALES_ROLLUP}
SELECT province, district_code, ym, avg_price, deal_count FROM sales_rollup
WHERE year BETWEEN 1997 AND 1999 AND province IN ('ASIA', 'EUROPE')""",
)
def scope_filter(spark, sf):
    spec = scope.AnalysisSpec(years=(1997, 1999), provinces=("ASIA", "EUROPE"))
    return scope.apply_scope(t.rolled_sales(spark, sf), spec).select(
        "province", "district_code", "ym", "avg_price", "deal_count"
    )


@query(
    "nearest_year",
    f"""WITH {FACTS}, pick AS (SELECT coalesce(max(year) FILTER (year <= 2030), max(year)) AS y FROM facts)
SELECT province, district_code, year, month, n AS pension_subscribers FROM facts WHERE year = (SELECT y FROM pick)""",
)
def nearest_year(spark, sf):
    pension = t.indicators(spark, sf)["pension"]
    return scope.nearest_year(pension, 2030).select("province", "district_code", "year", "month", "pension_subscribers")


@query(
    "usable_variables",
    f"""WITH {t.SALES_ROLLUP}, c AS (
  SELECT count(avg_price) AS avg_price, count(deal_count) AS deal_count, count(avg_unit_price) AS avg_unit_price FROM sales_rollup)
UNPIVOT c ON avg_price, deal_count, avg_unit_price INTO NAME variable VALUE value_count""",
)
def usable_variables(spark, sf):
    return scope.usable_variables(t.rolled_sales(spark, sf))


@query(
    "deposit_gap",
    f"""WITH {PANEL_YEARLY}
SELECT province, year, round(avg_price - deposit_only_avg_deposit, 6) AS deposit_gap,
  round(CASE WHEN avg_price > 0 THEN deposit_only_avg_deposit / avg_price * 100 END, 6) AS gap_deposit_ratio FROM panel""",
)
def deposit_gap(spark, sf):
    panel = build_panel({"sales": t.rolled_sales(spark, sf), "deposit_only": t.rolled_leases(spark, sf, "deposit_only")})
    out = ratios.with_deposit_gap(panel)
    return out.select("province", "year", r6("deposit_gap"), r6("gap_deposit_ratio"))


@query(
    "loan_growth",
    f"""WITH {FACTS}, {GRAINS}, loans AS (
  SELECT province, CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS ym,
    CAST(urgent_billed AS DOUBLE) AS mortgage_balance, CAST(billed - urgent_billed AS DOUBLE) AS other_loan_balance FROM by_month)
SELECT province, ym, mortgage_balance, other_loan_balance,
  round((mortgage_balance / nullif(lag(mortgage_balance) OVER (PARTITION BY province ORDER BY ym), 0) - 1) * 100, 6) AS mortgage_growth,
  round(CASE WHEN mortgage_balance + other_loan_balance > 0
        THEN mortgage_balance / (mortgage_balance + other_loan_balance) * 100 END, 6) AS mortgage_share
FROM loans""",
)
def loan_growth(spark, sf):
    from hearthpanel.functions.periods import year_month

    facts = t.order_facts(spark, sf).groupBy(*t.PROVINCE_MONTH).agg(
        F.sum("billed").alias("billed"), F.sum("urgent_billed").alias("urgent")
    )
    loans = facts.select(
        "province",
        year_month("year", "month").alias("ym"),
        F.col("urgent").cast("double").alias("mortgage_balance"),
        (F.col("billed") - F.col("urgent")).cast("double").alias("other_loan_balance"),
    )
    out = ratios.with_loan_ratios(loans)
    return out.select("province", "ym", "mortgage_balance", "other_loan_balance", r6("mortgage_growth"), r6("mortgage_share"))


@query(
    "latest_gauge",
    f"""WITH {FACTS}, {GRAINS}
SELECT max_by(CAST(done_n AS DOUBLE) / n * 200, year * 100 + month) AS buyer_superiority, max(year * 100 + month) AS period
FROM by_nation""",
)
def latest_gauge(spark, sf):
    facts = t.order_facts(spark, sf).groupBy("year", "month").agg(F.sum("n").alias("n"), F.sum("done_n").alias("done_n"))
    series = facts.select(
        (F.col("year") * 100 + F.col("month")).alias("period"),
        (ratio("done_n", "n") * 200).alias("buyer_superiority"),
    )
    return ratios.latest_gauge(series, "buyer_superiority", order_by="period")


@query(
    "top_districts",
    f"""WITH {t.SALES_ROLLUP}
SELECT district_code, CAST(sum(deal_count) AS BIGINT) AS deal_count FROM sales_rollup
GROUP BY district_code ORDER BY deal_count DESC, district_code LIMIT 5""",
)
def top_districts(spark, sf):
    return agg.top_k_total(t.rolled_sales(spark, sf), "district_code", "deal_count", 5)


@query(
    "dimension_values",
    f"""WITH {t.SALES_ROLLUP} SELECT DISTINCT district_code FROM sales_rollup WHERE province = 'ASIA'""",
)
def dimension_values(spark, sf):
    return agg.dimension_values(t.rolled_sales(spark, sf), "district_code", where=F.col("province") == "ASIA")


@query("period_bounds", f"""WITH {t.SALES_ROLLUP} SELECT min(ym) AS first_period, max(ym) AS last_period FROM sales_rollup""")
def period_bounds(spark, sf):
    return agg.period_bounds(t.rolled_sales(spark, sf), "ym")


@query(
    "duplicate_keys",
    f"""WITH {FACTS} SELECT province, year, count(*) AS copies FROM facts GROUP BY province, year HAVING count(*) > 1""",
)
def duplicate_keys(spark, sf):
    return joins.duplicate_keys(t.order_facts(spark, sf), ["province", "year"])


@query(
    "market_outer_merge",
    f"""WITH {FACTS}, {GRAINS},
a AS (SELECT province, year, month, done_n AS buyer_superiority FROM by_month WHERE month <> 1),
b AS (SELECT province, year, month, open_n AS trade_activity FROM by_month WHERE month <> 2),
c AS (SELECT province, year, month, part_n AS lease_supply FROM by_month WHERE month <> 3)
SELECT province, year, month, buyer_superiority, trade_activity, lease_supply
FROM a FULL JOIN b USING (province, year, month) FULL JOIN c USING (province, year, month)""",
)
def market_outer_merge(spark, sf):
    series = t.indicators(spark, sf)
    keys = t.PROVINCE_MONTH
    frames = [
        series["unsold"].filter("month <> 1").select(*keys, F.col("unsold").alias("buyer_superiority")),
        series["permits"].filter("month <> 2").select(*keys, F.col("permits").alias("trade_activity")),
        series["construction"].filter("month <> 3").select(*keys, F.col("completions").alias("lease_supply")),
    ]
    return joins.outer_merge(frames, keys)


@query(
    "event_overlay",
    f"""WITH {PROVINCE_YEAR},
ev AS (SELECT event_id, event_type, CAST(year(ts) AS INTEGER) - 25 + CAST(event_id % 7 AS INTEGER) - 4 AS year FROM events)
SELECT province, year, event_type, count(*) AS events, max(deal_count) AS deal_count
FROM province_year JOIN ev USING (year) GROUP BY province, year, event_type""",
)
def event_overlay(spark, sf):
    yearly = agg.province_sales(t.rolled_sales(spark, sf))
    moved = F.year("ts") - 25 + (F.col("event_id") % 7).cast("int") - 4
    stamped = t.table(spark, sf, "events").select("event_type", F.make_date(moved, F.lit(1), F.lit(15)).alias("event_date"))
    # Counted per type and date before they meet the provinces.
    events = stamped.groupBy("event_type", "event_date").agg(F.count(F.lit(1)).alias("events"))
    placed = joins.overlay_events(yearly, events, period="year")
    return placed.groupBy("province", "year", "event_type").agg(
        F.sum("events").alias("events"), F.max("deal_count").alias("deal_count")
    )
