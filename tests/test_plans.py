"""What the physical plans must and must not contain."""

import pytest

import __spark_entry__ as entry
from hearthpanel.operators import aggregates, stats
from workloads import tables as t

SF = "/root/testdata/sf0.001"
NATIVE = [
    "sales_rollup", "sales_detail", "lease_rollups_one_scan", "price_yoy", "outliers_z", "price_quantiles", "value_score",
    "grade_rank", "pchip", "formulas", "acquisition_tax", "capital_gains_tax", "xml_rows", "incremental_merge",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_run_without_python_or_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_rollup_reads_only_used_columns_and_combines_early(spark):
    spark.catalog.clearCache()
    execution = t.rolled_sales(spark, SF)._jdf.queryExecution()
    text = spark._jvm.PythonSQLUtils.explainString(execution, "formatted")
    assert "partial_avg" in text
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_extendedprice:double,l_shipdate:timestamp_ntz>" in text
    assert "l_discount" not in text and "GreaterThan(l_quantity,0.0), IsNotNull(l_suppkey)]" in text


def test_one_shuffle_serves_all_lease_kinds(spark):
    from hearthpanel.operators.contracts import lease_rollups

    text = plan(lease_rollups(t.leases(spark, SF)))
    assert text.count("orders.parquet") == 1


def test_totals_survive_the_rollup(spark):
    sales = t.sales(spark, SF)
    rollup = t.rolled_sales(spark, SF)
    valid = sales.filter("amount > 0 and area > 0").count()
    assert rollup.selectExpr("sum(deal_count)").first()[0] == valid
    again = aggregates.province_sales(rollup.repartition(13))
    assert again.selectExpr("sum(deal_count)").first()[0] == valid


def test_outliers_on_a_hot_group_do_not_shuffle_the_rows(spark):
    scored = stats.detect_outliers(t.sales(spark, SF), "amount")
    text = plan(scored)
    assert "BroadcastHashJoin" in text and "Window" not in text


@pytest.mark.parametrize("freq", ["yearly", "monthly"])
def test_indicators_share_the_scan_of_their_facts(spark, freq):
    from hearthpanel.plans.panel import build_panel

    panel = build_panel(t.panel_sources(spark, SF), freq=freq)
    panel.collect()
    final = plan(panel).split("== Initial Plan ==")[0]
    # One for all indicators and at most one for each of the three lease kinds; 18 without the long series.
    assert sum("orders.parquet" in line and "FileScan" in line for line in final.splitlines()) <= 5
    assert sum("lineitem.parquet" in line and "FileScan" in line for line in final.splitlines()) == 1
