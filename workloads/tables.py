"""Market inputs derived from the test tables, in Spark and as SQL.

The star schema plays the market: regions are provinces, nations are districts,
line items are sale contracts and orders are lease contracts. Amounts are whole
numbers as in real contracts, so sums do not depend on the order of rows.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthpanel.operators.contracts import lease_rollup, lease_rollups, sales_rollup
from hearthpanel.operators.reshape import keyed_series, series_totals


@lru_cache(maxsize=256)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).selectExpr(
        "n_nationkey",
        "lpad(string(n_nationkey), 5, '0') AS district_code",
        "n_name AS district_name",
        "r_name AS province",
    )


REGIONS = """
regions AS (
  SELECT n_nationkey, lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS district_code,
         n_name AS district_name, r_name AS province
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def sales(spark: SparkSession, sf_dir: str, *, detail: bool = False) -> DataFrame:
    lines, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    located = lines.join(supplier, lines.l_suppkey == supplier.s_suppkey)
    if detail:
        part = table(spark, sf_dir, "part")
        located = located.join(part, located.l_partkey == part.p_partkey)
    region = regions(spark, sf_dir)
    extra = ["l_orderkey", "l_linenumber", "l_suppkey", "l_discount", "l_tax", "year(l_shipdate) - p_size + 5 AS build_year"]
    return located.join(region, located.s_nationkey == region.n_nationkey).selectExpr(
        "province",
        "district_code",
        "year(l_shipdate) AS year",
        "month(l_shipdate) AS month",
        "bigint(floor(l_extendedprice)) AS amount",
        "l_quantity AS area",
        *(extra if detail else []),
    )


SALES = REGIONS + """,
sales AS (
  SELECT province, district_code, CAST(year(l_shipdate) AS INTEGER) AS year,
         CAST(month(l_shipdate) AS INTEGER) AS month,
         CAST(floor(l_extendedprice) AS BIGINT) AS amount, l_quantity AS area,
         CAST(year(l_shipdate) AS INTEGER) - p_size + 5 AS build_year,
         l_orderkey, l_linenumber, l_suppkey, l_discount, l_tax
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN part ON l_partkey = p_partkey
  JOIN regions ON s_nationkey = n_nationkey)"""


def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    region = regions(spark, sf_dir)
    located = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return located.join(region, located.c_nationkey == region.n_nationkey).selectExpr(
        "province",
        "district_code",
        "year(o_orderdate) AS year",
        "month(o_orderdate) AS month",
        "bigint(floor(o_totalprice)) AS deposit",
        "double(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN floor(o_totalprice / 100) ELSE 0 END) AS rent",
        "double(o_orderkey % 100 + 1) AS area",
        "o_orderkey",
        "o_orderstatus",
        "o_orderpriority",
        "bigint(floor(c_acctbal)) AS balance",
    )


LEASES = REGIONS + """,
leases AS (
  SELECT province, district_code, CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(month(o_orderdate) AS INTEGER) AS month,
         CAST(floor(o_totalprice) AS BIGINT) AS deposit,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN floor(o_totalprice / 100) ELSE 0e0 END AS rent,
         CAST(o_orderkey % 100 + 1 AS DOUBLE) AS area,
         o_orderkey, o_orderstatus, o_orderpriority, CAST(floor(c_acctbal) AS BIGINT) AS balance
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN regions ON c_nationkey = n_nationkey)"""


SALES_ROLLUP = SALES + """,
sales_rollup AS (
  SELECT province, district_code, year, month,
         CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS ym,
         avg(amount) AS avg_price, count(*) AS deal_count, avg(amount / area) AS avg_unit_price
  FROM sales WHERE amount > 0 AND area > 0
  GROUP BY province, district_code, year, month)"""


def lease_rollup_sql(kind: str, where: str) -> str:
    return f"""
{kind} AS (
  SELECT province, district_code, year, month,
         CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS ym,
         avg(deposit) AS avg_deposit, count(*) AS lease_count, avg(deposit / area) AS deposit_unit,
         avg(rent) AS avg_rent
  FROM leases WHERE deposit > 0 AND area > 0 AND {where}
  GROUP BY province, district_code, year, month)"""


LEASE_WHERE = {"deposit_only": "rent = 0", "monthly_rent": "rent > 0", "all_leases": "TRUE"}
LEASE_ROLLUPS = ",".join(lease_rollup_sql(kind, where) for kind, where in LEASE_WHERE.items())


def rolled_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_rollup(sales(spark, sf_dir))


def rolled_leases(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return lease_rollup(leases(spark, sf_dir), kind=kind)


FACT_SUMS = {
    "n": "1",
    "open_n": "int(o_orderstatus = 'O')",
    "done_n": "int(o_orderstatus = 'F')",
    "part_n": "int(o_orderstatus = 'P')",
    "urgent_n": "int(o_orderpriority = '1-URGENT')",
    "low_n": "int(o_orderpriority = '5-LOW')",
    "billed": "deposit",
    "balances": "balance",
    "urgent_billed": "if(o_orderpriority = '1-URGENT', deposit, 0)",
}


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """District-month figures from which the indicator tables are cut.

    One scan of the orders serves all indicators: the result has one row per
    district and month.
    """
    sums = [F.expr(f"sum({value}) AS {name}") for name, value in FACT_SUMS.items()]
    facts = leases(spark, sf_dir).groupBy("province", "district_code", "year", "month").agg(*sums)
    return facts


FACTS = """
facts AS (
  SELECT province, district_code, year, month, count(*) AS n,
         count(*) FILTER (o_orderstatus = 'O') AS open_n,
         count(*) FILTER (o_orderstatus = 'F') AS done_n,
         count(*) FILTER (o_orderstatus = 'P') AS part_n,
         count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent_n,
         count(*) FILTER (o_orderpriority = '5-LOW') AS low_n,
         CAST(sum(deposit) AS BIGINT) AS billed, CAST(sum(balance) AS BIGINT) AS balances,
         CAST(coalesce(sum(deposit) FILTER (o_orderpriority = '1-URGENT'), 0) AS BIGINT) AS urgent_billed
  FROM leases GROUP BY province, district_code, year, month)"""

PROVINCE_MONTH = ["province", "year", "month"]


def indicators(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Indicator tables in the shape of the curated public series."""
    # One long series per district and month: every branch below needs all of it, so all share the scan and its exchange.
    long = keyed_series(order_facts(spark, sf_dir), ["province", "district_code", "year", "month"], list(FACT_SUMS))

    def at(*keys: str) -> DataFrame:
        return series_totals(long, list(keys), list(FACT_SUMS))

    # Region-period totals, each the base of several indicators.
    facts, monthly = at("province", "district_code", "year", "month"), at(*PROVINCE_MONTH)
    yearly, national = at("province", "year"), at("year", "month")
    in_month = PROVINCE_MONTH
    return {
        "population": yearly.selectExpr("province", "year", "n * 40 AS population"),
        "grdp": yearly.selectExpr("province", "year", "billed AS grdp"),
        "permits": monthly.selectExpr(*in_month, "open_n AS permits"),
        "pension": facts.selectExpr(
            *in_month,
            "district_code",
            "n AS pension_subscribers",
            "billed AS pension_billed",
            "urgent_n AS pension_workplaces",
            "open_n - done_n AS pension_net_hires",
            "double(billed) / double(n) AS pension_per_head",
        ),
        "loans": monthly.selectExpr(
            *in_month, "double(billed) AS mortgage_balance", "double(urgent_billed) / billed * 100 AS mortgage_share"
        ),
        "assets": yearly.selectExpr(
            "province",
            "year",
            "double(billed) / n AS household_assets",
            "double(urgent_billed) / n AS household_debt",
            "double(balances) / n AS household_income",
        ),
        "income": at("province", "district_code", "year").selectExpr(
            "province", "district_code", "year", "n AS earners", "billed AS pay_total", "urgent_n AS taxpayers", "urgent_billed AS tax_total"
        ),
        "unsold": monthly.selectExpr(*in_month, "done_n AS unsold"),
        "construction": monthly.selectExpr(*in_month, "open_n AS starts", "part_n AS completions"),
        "land_price": monthly.selectExpr(*in_month, "part_n - low_n AS land_price_change"),
        "migration": monthly.selectExpr(
            *in_month, "open_n AS moved_in", "done_n AS moved_out", "open_n - done_n AS net_moved"
        ),
        "rates": national.selectExpr("year", "month", "double(urgent_n) / n AS base_rate"),
        "conversion": monthly.selectExpr(*in_month, "low_n AS conversion_rate"),
        "price_index": monthly.selectExpr(*in_month, "double(billed) / n AS sale_index"),
        "market": monthly.selectExpr(*in_month, "double(done_n) / n * 200 AS buyer_superiority"),
        "sentiment": national.selectExpr("year", "month", "double(open_n) / n * 200 AS price_outlook"),
    }


def panel_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    lease = lease_rollups(leases(spark, sf_dir))
    kinds = {kind: lease.filter(F.col("lease_kind") == kind).drop("lease_kind") for kind in LEASE_WHERE}
    return {
        "sales": rolled_sales(spark, sf_dir),
        **kinds,
        "deposit_only": kinds["deposit_only"].drop("avg_rent"),
        **indicators(spark, sf_dir),
    }
