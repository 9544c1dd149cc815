"""Contract rollups, cleaning and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthpanel.operators import aggregates as agg
from hearthpanel.operators import contracts as con
from hearthpanel.operators.windows import pct_change
from workloads import tables as t
from workloads.registry import query


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


@query(
    "sales_rollup",
    f"""WITH {t.SALES_ROLLUP}
SELECT province, district_code, year, month, ym, avg_price, deal_count, round(avg_unit_price, 6) AS avg_unit_price
FROM sales_rollup""",
)
def sales_rollup(spark, sf):
    return t.rolled_sales(spark, sf).withColumn("avg_unit_price", r6("avg_unit_price"))


@query(
    "sales_detail",
    f"""WITH {t.SALES}
SELECT province, district_code, year, month,
       CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS ym, build_year,
       avg(amount) AS avg_price, count(*) AS deal_count, round(avg(amount / area), 6) AS avg_unit_price,
       avg(CASE WHEN year - build_year >= 0 THEN year - build_year END) AS avg_building_age
FROM sales WHERE amount > 0 AND area > 0
GROUP BY province, district_code, year, month, build_year""",
)
def sales_detail(spark, sf):
    detail = con.sales_detail_rollup(t.sales(spark, sf, detail=True))
    return detail.withColumn("avg_unit_price", r6("avg_unit_price"))


@query(
    "sales_rollup_from_base",
    f"""WITH {t.SALES_ROLLUP}
SELECT province, district_code, year, month, ym, avg_price, CAST(deal_count AS BIGINT) AS deal_count,
  round(avg_unit_price, 6) AS avg_unit_price FROM sales_rollup""",
)
def sales_rollup_from_base(spark, sf):
    base = con.sales_base(t.sales(spark, sf, detail=True))
    return con.rollup_from_base(base).withColumn("avg_unit_price", r6("avg_unit_price"))


@query(
    "sales_detail_from_base",
    f"""WITH {t.SALES}
SELECT province, district_code, year, month, build_year, avg(amount) AS avg_price, count(*) AS deal_count,
       avg(CASE WHEN year - build_year >= 0 THEN year - build_year END) AS avg_building_age
FROM sales WHERE amount > 0 AND area > 0 GROUP BY province, district_code, year, month, build_year""",
)
def sales_detail_from_base(spark, sf):
    base = con.sales_base(t.sales(spark, sf, detail=True))
    out = con.rollup_from_base(base, detail=True)
    return out.select("province", "district_code", "year", "month", "build_year", "avg_price", "deal_count", "avg_building_age")


for _kind in con.LEASE_KINDS:
    _rent = "" if _kind == "deposit_only" else ", avg_rent"

    @query(
        f"lease_rollup_{_kind}",
        f"""WITH {t.LEASES}, {t.lease_rollup_sql(_kind, t.LEASE_WHERE[_kind])}
SELECT province, district_code, year, month, ym, avg_deposit, lease_count,
       round(deposit_unit, 6) AS deposit_unit{_rent} FROM {_kind}""",
    )
    def _lease(spark, sf, kind=_kind):
        return t.rolled_leases(spark, sf, kind).withColumn("deposit_unit", r6("deposit_unit"))


_ALL_KINDS = " UNION ALL ".join(
    f"""SELECT '{kind}' AS lease_kind, province, district_code, year, month, ym, avg_deposit, lease_count,
       round(deposit_unit, 6) AS deposit_unit, {'NULL' if kind == 'deposit_only' else 'avg_rent'} AS avg_rent FROM {kind}"""
    for kind in con.LEASE_KINDS
)


@query("lease_rollups_one_scan", f"WITH {t.LEASES}, {t.LEASE_ROLLUPS} {_ALL_KINDS}")
def lease_rollups_one_scan(spark, sf):
    return con.lease_rollups(t.leases(spark, sf)).withColumn("deposit_unit", r6("deposit_unit"))


PROVINCE_YEAR = t.SALES_ROLLUP + """,
province_year AS (
  SELECT province, year, sum(avg_price * deal_count) / sum(deal_count) AS avg_price,
         CAST(sum(deal_count) AS BIGINT) AS deal_count,
         sum(avg_unit_price * deal_count) / sum(deal_count) AS avg_unit_price
  FROM sales_rollup GROUP BY province, year)"""


@query(
    "province_year",
    f"""WITH {PROVINCE_YEAR}
SELECT province, year, round(avg_price, 6) AS avg_price, deal_count, round(avg_unit_price, 6) AS avg_unit_price
FROM province_year""",
)
def province_year(spark, sf):
    out = agg.province_sales(t.rolled_sales(spark, sf))
    return out.select("province", "year", r6("avg_price"), "deal_count", r6("avg_unit_price"))


@query(
    "province_month",
    f"""WITH {t.SALES_ROLLUP}
SELECT province, year, month, CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS ym,
       round(sum(avg_price * deal_count) / sum(deal_count), 6) AS avg_price,
       CAST(sum(deal_count) AS BIGINT) AS deal_count,
       round(sum(avg_unit_price * deal_count) / sum(deal_count), 6) AS avg_unit_price
FROM sales_rollup GROUP BY province, year, month""",
)
def province_month(spark, sf):
    out = agg.province_sales(t.rolled_sales(spark, sf), freq="monthly")
    return out.select("province", "year", "month", "ym", r6("avg_price"), "deal_count", r6("avg_unit_price"))


PRICE_YOY_SQL = f"""WITH {PROVINCE_YEAR}
SELECT province, year, round(avg_price, 6) AS avg_price,
       round((avg_price / lag(avg_price) OVER (PARTITION BY province ORDER BY year) - 1) * 100, 6) AS price_yoy
FROM province_year"""


@query("price_yoy", PRICE_YOY_SQL)
def price_yoy(spark, sf):
    yearly = agg.province_sales(t.rolled_sales(spark, sf))
    out = pct_change(yearly, "avg_price", group="province", order_by="year", name="price_yoy")
    return out.select("province", "year", r6("avg_price"), r6("price_yoy"))
