"""Loads that continue where the last one stopped."""

from hearthpanel.streaming import incremental as inc

ROWS = "province string, ym string, v int"


def table(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def test_months(spark):
    assert [r[0] for r in inc.month_range(spark, "2019-11", "2020-02").collect()] == ["2019-11", "2019-12", "2020-01", "2020-02"]
    assert inc.next_month("2020-12") == "2021-01" and inc.next_month("2020-01") == "2020-02"


def test_windows(spark):
    target = table(spark, ("A", "2020-11", 1), ("A", "2020-12", 2))
    assert inc.incremental_window(target, end="2021-03") == inc.Window("2021-01", "2021-03", False)
    assert inc.incremental_window(target, end="2020-12").up_to_date
    assert inc.incremental_window(target, grain="year", end="2021") == inc.Window("2020", "2021", False)
    assert inc.incremental_window(target.limit(0), end="2021-03") == inc.Window(None, "2021-03", False)
    landed = table(spark, ("A", "2020-12", 9), ("A", "2021-01", 9), ("A", "2021-04", 9))
    window = inc.incremental_window(target, end="2021-03")
    assert [r["ym"] for r in inc.in_window(landed, window).collect()] == ["2021-01"]
    assert inc.in_window(landed, inc.Window(None, "2021-03", False)).count() == 2
    assert inc.in_window(landed, inc.Window("2021-01", "2020-12", True)).count() == 0


def test_loading_twice_is_loading_once(spark):
    target = table(spark, ("A", "2020-11", 1), ("A", "2020-12", 2))
    increment = table(spark, ("A", "2020-12", 20), ("A", "2021-01", 3))
    once = inc.merge_increment(target, increment, ["province", "ym"])
    twice = inc.merge_increment(once, increment, ["province", "ym"])
    expected = {("A", "2020-11", 1), ("A", "2020-12", 20), ("A", "2021-01", 3)}
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in twice.collect()} == expected


def test_new_rows_into_an_empty_target(spark):
    landed = table(spark, ("A", "2020-12", 9))
    assert inc.new_rows(landed.limit(0), landed).count() == 1
    assert inc.new_rows(landed, landed).count() == 0


def test_ledger(spark, tmp_path):
    regions = spark.createDataFrame([("1",), ("2",), ("2",)], "district_code string")
    months = inc.month_range(spark, "2020-01", "2020-02")
    path = str(tmp_path / "ledger")
    none = spark.createDataFrame([], "district_code string, ym string")
    first = inc.pending_pairs(regions, months, none)
    assert first.count() == 4
    inc.record_done(first.filter("district_code = '2'"), path)
    left = inc.pending_pairs(regions, months, spark.read.parquet(path)).collect()
    assert {tuple(r) for r in left} == {("1", "2020-01"), ("1", "2020-02")}


def test_file_ingest_takes_each_file_once(spark, tmp_path):
    landing, target, checkpoint = (tmp_path / n for n in ("landing", "target", "checkpoint"))
    landing.mkdir()
    (landing / "a.csv").write_text("k,v\n1,2\n")
    args = (spark, str(landing), "k string, v string", str(target), str(checkpoint))
    inc.ingest_new_files(*args)
    inc.ingest_new_files(*args)
    (landing / "b.csv").write_text("k,v\n3,4\n")
    inc.ingest_new_files(*args)
    assert {tuple(r) for r in spark.read.parquet(str(target)).collect()} == {("1", "2"), ("3", "4")}


def test_report(spark):
    before = inc.table_profile(table(spark, ("A", "2020-11", 1)), name="x").unionByName(
        inc.table_profile(table(spark, ("A", "2020-11", 1)), name="y")
    )
    after = inc.table_profile(table(spark, ("A", "2020-11", 1), ("B", "2020-12", 1)), name="x")
    after = after.unionByName(inc.table_profile(table(spark, ("A", "2020-11", 1)), name="y"))
    after = after.unionByName(inc.table_profile(table(spark, ("A", "2020-11", 1)).limit(0), name="z"))
    report = inc.load_report(before, after)
    got = {r["table"]: (r["rows"], r["regions"], r["added_rows"], r["status"]) for r in report.collect()}
    assert got == {"x": (2, 2, 1, "loaded"), "y": (1, 1, 0, "skipped"), "z": (0, 0, 0, "failed")}
    assert tuple(inc.report_totals(report).first()) == (1, 1, 1, 1)
