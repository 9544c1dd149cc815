"""Rules for missing data, zero divisors, flat series and dirty text."""

import math

import pytest
from pyspark.sql import functions as F

from hearthpanel.functions import numeric, periods, regions
from hearthpanel.operators import aggregates, contracts, joins, ratios, scope, stats, windows


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize(
    "text, amount",
    [("12,500", 12500), (' "82,000" ', 82000), ("", None), ("1234.5", None), ("abc", None), (None, None), ("-7", -7)],
)
def test_clean_amount(spark, text, amount):
    df = spark.createDataFrame([(text,)], "t string").select(numeric.clean_amount("t").alias("a"))
    assert one(df)["a"] == amount


def test_codes_and_periods(spark):
    df = spark.createDataFrame([("110", "202401"), (" 11110 ", "2024-02"), (None, "2024"), ("123456", "20240315")], "c string, p string")
    rows = df.select(periods.pad_code("c").alias("c"), periods.ym_from_compact("p").alias("p")).collect()
    assert [r["c"] for r in rows] == ["00110", "11110", None, "123456"]
    assert [r["p"] for r in rows] == ["2024-01", "2024-02", None, "2024-03"]


@pytest.mark.parametrize(
    "name, short",
    [
        ("서울특별시", "서울"), ("서울", "서울"), (" 전북특별자치도 ", "전북"), ("강원도", "강원"), ("경기도 광주시", "광주"),
        ("전국", "전국"), ("부산광역", "부산"), ("어딘가", "어딘가"), (None, None),
    ],
)
def test_province_names(spark, name, short):
    df = spark.createDataFrame([(name,)], "n string").select(regions.short_province("n").alias("s"))
    assert one(df)["s"] == short


def test_exact_province_keeps_or_drops_unknown(spark):
    df = spark.createDataFrame([("경기도",), ("경기도 광주시",)], "n string")
    rows = df.select(regions.exact_province("n").alias("a"), regions.exact_province("n", keep_unknown=True).alias("b")).collect()
    assert [tuple(r) for r in rows] == [("경기", "경기"), (None, "경기도 광주시")]


def test_province_from_code(spark):
    df = spark.createDataFrame([("11110",), ("51110",), ("99999",), (None,)], "c string")
    assert [r[0] for r in df.select(regions.province_from_code("c")).collect()] == ["서울특별시", "강원특별자치도", None, None]


def test_district_name_falls_back_to_the_code(spark):
    df = spark.createDataFrame([("11110",), ("99999",)], "district_code string")
    names = spark.createDataFrame([("11110", "종로구")], "district_code string, district_name string")
    assert {tuple(r) for r in regions.with_district_name(df, names).collect()} == {("11110", "종로구"), ("99999", "99999")}


SALES = "district_code string, year string, month string, area string, build_year string, amount string"


def test_sale_contracts_are_cleaned(spark):
    raw = spark.createDataFrame(
        [
            ("11110", "2020", "1", "50", "2000", "10,000"),
            ("11110", "2020", "1", "100", "2030", '"30,000"'),
            ("11110", "2020", "1", "0", "2000", "10,000"),
            ("11110", "2020", "1", "50", "2000", "0"),
            ("11110", "2020", "1", "50", "2000", "1234.5"),
            (None, "2020", "1", "50", "2000", "10,000"),
            ("99110", "2020", "1", "50", "2000", "10,000"),
            ("11110", "2020", "x", "50", None, "10,000"),
        ],
        SALES,
    )
    typed = contracts.type_sales(raw)
    row = one(contracts.sales_rollup(typed))
    assert (row["province"], row["ym"], row["deal_count"], row["avg_price"], row["avg_unit_price"]) == ("서울", "2020-01", 2, 20000.0, 250.0)
    detail = {r["build_year"]: r["avg_building_age"] for r in contracts.sales_detail_rollup(typed).collect()}
    assert detail == {2000: 20.0, 2030: None}
    without_province = contracts.sales_rollup(typed, keep_province=False)
    assert {r["district_code"] for r in without_province.collect()} == {"11110", "99110"}


def test_lease_kinds(spark):
    raw = spark.createDataFrame(
        [("11110", "2020", "1", "50", "10,000", None), ("11110", "2020", "1", "50", "20,000", "0"), ("11110", "2020", "1", "50", "3,000", "70")],
        "district_code string, year string, month string, area string, deposit string, rent string",
    )
    typed = contracts.type_leases(raw)
    counts = {k: one(contracts.lease_rollup(typed, kind=k))["lease_count"] for k in contracts.LEASE_KINDS}
    assert counts == {"deposit_only": 2, "monthly_rent": 1, "all_leases": 3}
    together = {r["lease_kind"]: (r["lease_count"], r["avg_deposit"], r["avg_rent"]) for r in contracts.lease_rollups(typed).collect()}
    assert together == {"deposit_only": (2, 15000.0, None), "monthly_rent": (1, 3000.0, 70.0), "all_leases": (3, 11000.0, 70 / 3)}
    with pytest.raises(ValueError):
        contracts.lease_rollup(typed, kind="other")


def test_ratio_and_finite(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(numeric.ratio("a", "b")).collect()] == [None, 0.25, None]
    odd = spark.createDataFrame([(math.inf,), (-math.inf,), (math.nan,), (2.0,)], "v double")
    assert [r[0] for r in odd.select(numeric.finite_or_null("v")).collect()] == [None, None, None, 2.0]


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "v double")
    assert [r[0] for r in df.select(numeric.half_even("v", 0)).collect()] == [0.0, 2.0, 2.0]


def test_sum_of_nothing_is_zero_and_unknown_keys_drop(spark):
    df = spark.createDataFrame([("A", 2020, 1, None), ("A", 2020, 12, None), (None, 2020, 1, 5.0)], "province string, year int, month int, permits double")
    row = one(aggregates.downsample(df, {"permits": "sum"}))
    assert (row["province"], row["permits"]) == ("A", 0.0)


def test_downsample_rules(spark):
    df = spark.createDataFrame([("A", 2020, m, float(m)) for m in (1, 11, 12)], "province string, year int, month int, v double")
    rules = {"sum": 24.0, "mean": 8.0, "december": 12.0}
    for rule, expected in rules.items():
        assert one(aggregates.downsample(df, {"v": rule}))["v"] == expected
    assert "month" in str(aggregates.downsample(df, {"v": "december"})._jdf.queryExecution().optimizedPlan().toString())
    with pytest.raises(ValueError):
        aggregates.downsample(df, {"v": "median"})


def test_pct_change_follows_rows_and_fills_gaps(spark):
    df = spark.createDataFrame([("A", 2000, 100.0), ("A", 2003, 150.0), ("A", 2004, None), ("A", 2005, 300.0), ("B", 2000, 0.0), ("B", 2001, 5.0)], "province string, year int, v double")
    out = windows.pct_change(df, "v", group="province", order_by="year", name="c")
    got = {(r["province"], r["year"]): r["c"] for r in out.collect()}
    assert got == {("A", 2000): None, ("A", 2003): 50.0, ("A", 2004): 0.0, ("A", 2005): 100.0, ("B", 2000): None, ("B", 2001): None}


def test_zscore_degenerate_groups(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 3.0), ("B", 7.0), ("C", 5.0), ("C", 5.0)], "province string, v double")
    raw = sorted((r["province"], round(r["v_z"], 4)) for r in windows.zscore(df, "v", group="province").collect())
    assert raw == [("A", -0.7071), ("A", 0.7071), ("B", 7.0), ("C", 5.0), ("C", 5.0)]
    null = windows.zscore(df, "v", group="province", degenerate="null")
    assert null.filter("province <> 'A' and v_z is not null").count() == 0


def test_minmax_flat(spark):
    df = spark.createDataFrame([("A", 4.0), ("A", 4.0)], "province string, v double")
    assert {r["v_scaled"] for r in windows.minmax(df, "v").collect()} == {0.5}
    assert {r["v_scaled"] for r in windows.minmax(df, "v", group="province", flat=0.0).collect()} == {0.0}


def test_rebase_without_base(spark):
    df = spark.createDataFrame([("A", 2000, 50.0), ("A", 2001, 75.0), ("B", 2001, 5.0), ("C", 2000, 0.0)], "province string, year int, v double")
    out = {(r["province"], r["year"]): r["v_index"] for r in windows.rebase(df, "v", base_period=2000, group="province", order_by="year").collect()}
    assert out == {("A", 2000): 100.0, ("A", 2001): 150.0, ("B", 2001): None, ("C", 2000): None}


def test_left_join_multiplies_on_duplicates_and_finds_them(spark):
    panel = spark.createDataFrame([("A", 2000)], "province string, year int")
    table = spark.createDataFrame([("A", 2000, 1), ("A", 2000, 2)], "province string, year int, v int")
    assert joins.join_indicator(panel, table, keys=["province", "year"]).count() == 2
    assert joins.duplicate_keys(table, ["province", "year"]).first()["copies"] == 2
    same = joins.join_indicator(panel, table, keys=["province", "year"], columns=["missing"])
    assert same is panel


def test_nearest_year(spark):
    df = spark.createDataFrame([(2001,), (2005,)], "year int")
    assert one(scope.nearest_year(df, 2003))["year"] == 2001
    assert one(scope.nearest_year(df, 1990))["year"] == 2005


def test_prefer_value(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "kind string, v int")
    assert [r["v"] for r in scope.prefer_value(df, "kind", ["x", "b", "a"]).collect()] == [2]
    assert scope.prefer_value(df, "kind", ["x"]).count() == 2
    assert scope.prefer_value(df, "kind", ["x"], keep_all=False).count() == 0


def test_scope_and_modes(spark):
    panel = spark.createDataFrame([("A", "00001", 2000, 1.0, 2, 3.0, 9.0)], "province string, district_code string, year int, avg_price double, deal_count int, avg_unit_price double, grdp double")
    assert scope.apply_scope(panel, scope.AnalysisSpec(years=(1999, 2001), provinces=("B",), districts=("00001",))).count() == 1
    assert scope.apply_scope(panel, scope.AnalysisSpec(years=(2001, 2002))).count() == 0
    assert scope.mode_columns(panel, "sale") == (["avg_price", "deal_count", "avg_unit_price"], ["grdp"])
    assert scope.select_mode(panel, "deposit_only").columns == ["province", "district_code", "year", "grdp"]
    assert scope.choose_panel(panel, None, scope.AnalysisSpec(freq="monthly")).count() == 1
    assert scope.choose_panel(panel, panel.limit(0), scope.AnalysisSpec(freq="monthly")).count() == 1
    assert scope.first_available(panel, ["x", "grdp", "avg_price"]) == "grdp"


def test_pension_rollup_rules(spark):
    df = spark.createDataFrame(
        [("A", 2020, 1, 10, 100.0, 1, 1), ("A", 2020, 2, 30, None, 1, -2), ("B", 2020, 1, 0, 5.0, 2, 0)],
        "province string, year int, month int, pension_subscribers int, pension_per_head double, pension_workplaces int, pension_net_hires int",
    )
    got = {r["province"]: r for r in aggregates.province_pension(df).collect()}
    assert got["A"]["pension_per_head"] == 25.0 and got["A"]["pension_net_hires"] == -1
    assert got["B"]["pension_per_head"] is None
    assert {r["ym"] for r in aggregates.province_pension(df, freq="monthly").collect()} == {"2020-01", "2020-02"}


def test_outlier_groups(spark):
    rows = [("A", v) for v in (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 50.0)] + [("B", 5.0)] * 4 + [("C", 1.0), ("C", 2.0)] + [("A", None)]
    df = spark.createDataFrame(rows, "province string, v double")
    for method in ("zscore", "iqr"):
        out = stats.detect_outliers(df, "v", method=method)
        assert [r["v"] for r in out.filter("is_outlier").collect()] == [50.0]
        assert out.count() == len(rows)
        z = {(r["province"], r["v"]): r["z_score"] for r in out.collect()}
        assert z[("B", 5.0)] == 0.0 and z[("C", 1.0)] is None and z[("A", None)] is None


def test_gap_and_migration_helpers(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 4.0)], "avg_price double, deposit_only_avg_deposit double")
    assert [tuple(r)[2:] for r in ratios.with_deposit_gap(df).collect()] == [(-5.0, None), (6.0, 40.0)]
    moved = spark.createDataFrame([(5, 7)], "moved_in int, moved_out int")
    assert one(ratios.with_net_migration(moved))["net_moved"] == -2
    built = spark.createDataFrame([(10.0, 4.0)], "starts_total double, starts_apartment double")
    row = one(ratios.with_non_apartment(built))
    assert (row["starts"], row["starts_non_apartment"]) == (10.0, 6.0)


def test_events_reach_their_region_and_the_nation(spark):
    panel = spark.createDataFrame([("서울", 2020, 1.0), ("부산", 2020, 2.0)], "province string, year int, v double")
    events = spark.createDataFrame([("2020-05-01", "a", "전국"), ("2020-06-01", "b", "서울")], "d string, event_name string, event_region string").select(
        F.to_date("d").alias("event_date"), "event_name", "event_region"
    )
    placed = joins.overlay_events(panel, events, region="province")
    assert {(r["province"], r["event_name"]) for r in placed.collect()} == {("서울", "a"), ("부산", "a"), ("서울", "b")}
    assert joins.overlay_events(panel, events).count() == 4
