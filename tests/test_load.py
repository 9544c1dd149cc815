"""The incremental load job and the aggregates that it keeps up to date."""

import math

import pytest
from pyspark.sql import functions as F

from hearthpanel.operators import contracts as con
from hearthpanel.operators.partials import State, merged, partial, quantile
from hearthpanel.plans import load as loads
from hearthpanel.plans.load import Partials, Target, load
from hearthpanel.sources.sinks import overwrite_years

SCHEMA = "province string, district_code string, year int, ym string, deal_count long"


def rows(*items):
    return [("A", d, int(ym[:4]), ym, n) for d, ym, n in items]


def test_loads_append_replace_and_stop(spark, tmp_path):
    path, ledger, rollup = (str(tmp_path / x) for x in ("table", "ledger", "rollup"))
    by_year = {rollup: lambda df: df.groupBy("year").agg(F.sum("deal_count").alias("n"))}
    target = Target("t", path, ["district_code", "ym"], ledger=ledger, rollups=by_year, order="deal_count")
    first = spark.createDataFrame(rows(("1", "2020-01", 5), ("1", "2020-02", 6), ("2", "2021-01", 7)), SCHEMA)
    report = load(spark, target, first, end="2021-12").first()
    assert (report["status"], report["added_rows"], report["rows_before"] if "rows_before" in report else 0) == ("loaded", 3, 0)
    kept = {p.name for p in (tmp_path / "table" / "year=2020").iterdir()}
    more = spark.createDataFrame(rows(("1", "2020-01", 99), ("2", "2021-02", 1), ("2", "2021-02", 8), ("3", "2022-01", 2), ("3", "2023-01", 4)), SCHEMA)
    report = load(spark, target, more, end="2022-12").first()
    assert (report["status"], report["added_rows"]) == ("loaded", 2)
    table = {(r.district_code, r.ym): r.deal_count for r in spark.read.parquet(path).collect()}
    assert table == {("1", "2020-01"): 5, ("1", "2020-02"): 6, ("2", "2021-01"): 7, ("2", "2021-02"): 8, ("3", "2022-01"): 2}
    assert {p.name for p in (tmp_path / "table" / "year=2020").iterdir()} == kept  # untouched years are not rewritten
    again = load(spark, target, more, end="2022-12").first()
    assert (again["status"], again["added_rows"]) == ("skipped", 0)
    assert spark.read.parquet(ledger).distinct().count() == 5
    assert {(r.year, r.n) for r in spark.read.parquet(rollup).collect()} == {(2020, 11), (2021, 15), (2022, 2)}


def test_a_yearly_table_loads_its_last_year_again(spark, tmp_path):
    target = Target("y", str(tmp_path / "y"), ["district_code", "year"], grain="year", period="year")
    one = spark.createDataFrame(rows(("1", "2020-01", 5), ("1", "2021-01", 6)), SCHEMA)
    load(spark, target, one, end="2021")
    two = spark.createDataFrame(rows(("1", "2020-01", 50), ("1", "2021-01", 60), ("1", "2022-01", 7)), SCHEMA)
    load(spark, target, two, end="2022")
    assert {(r.year, r.deal_count) for r in spark.read.parquet(target.path).collect()} == {(2020, 5), (2021, 60), (2022, 7)}


def test_an_empty_landing_is_reported(spark, tmp_path):
    target = Target("e", str(tmp_path / "e"), ["district_code", "ym"])
    assert load(spark, target, spark.createDataFrame([], SCHEMA), end="2020-01").first()["status"] == "failed"


CONTRACT = "id int, province string, district_code string, year int, month int, ym string, amount long, area double, build_year int"


def contracts(*items):
    """(id, district, ym, amount, build year)"""
    return [(i, "A", d, int(ym[:4]), int(ym[5:]), ym, a, 2.0, b) for i, d, ym, a, b in items]


def held(path, states, keys=None):
    return Partials(str(path), keys or [*con.SALE_KEYS, "build_year"], states, con.sales_rows)


def rebuilt(spark, target, like):
    table = spark.read.schema(like.schema).parquet(target.path)
    return [{tuple(r) for r in one.of(table).collect()} for one in target.partials]


def found(spark, target, like):
    return [{tuple(r) for r in one.read(spark, like).select(*one.of(like).columns).collect()} for one in target.partials]


def sums(tmp_path, **more):
    return Target("c", str(tmp_path / "c"), ["id", "year"], grain="year", period="year", partials=(held(tmp_path / "s", con.SALE_STATES),), **more)


def test_partials_follow_added_replaced_and_lost_rows(spark, tmp_path):
    target = sums(tmp_path)
    one = spark.createDataFrame(contracts((1, "1", "2019-03", 10, 2000), (2, "1", "2020-01", 5, None), (3, "1", "2020-01", 7, 1999), (4, "2", "2020-02", 9, 1990)), CONTRACT)
    load(spark, target, one, end="2020")
    assert found(spark, target, one) == rebuilt(spark, target, one)
    # 2 changes its build year, 3 its amount, 4 is no valid contract any more, 5 and 6 are new.
    two = spark.createDataFrame(
        contracts((2, "1", "2020-01", 5, 2001), (3, "1", "2020-01", 8, 1999), (4, "2", "2020-02", 0, 1990), (5, "2", "2020-05", 3, None), (6, "3", "2021-05", 4, 1980)), CONTRACT
    )
    report = load(spark, target, two, end="2021").first()
    assert (report["rows"], report["added_rows"], report["last_period"]) == (6, 2, 2021)
    assert found(spark, target, one) == rebuilt(spark, target, one) and len(found(spark, target, one)[0]) == 5
    before = found(spark, target, one)
    assert load(spark, target, two.filter("year = 2021"), end="2021").first()["added_rows"] == 0
    assert found(spark, target, one) == before


def test_the_last_contract_of_a_year_can_go(spark, tmp_path):
    for name, states in (("sums", con.SALE_STATES), ("sketches", con.SKETCH_STATES)):
        target = Target("c", str(tmp_path / name), ["id", "year"], grain="year", period="year", partials=(held(tmp_path / f"{name}-s", states),))
        one = spark.createDataFrame(contracts((1, "1", "2020-01", 5, 2000)), CONTRACT)
        load(spark, target, one, end="2020")
        load(spark, target, spark.createDataFrame(contracts((1, "1", "2020-01", 0, 2000)), CONTRACT), end="2020")
        assert found(spark, target, one) == [set()]


def test_a_load_reads_no_year_that_it_does_not_touch(spark, tmp_path):
    target = sums(tmp_path)
    one = spark.createDataFrame(contracts((1, "1", "2018-03", 10, 2000), (2, "1", "2019-01", 5, 1990), (3, "2", "2020-01", 7, 1999)), CONTRACT)
    load(spark, target, one, end="2020")
    for folder in ("c", "s"):
        for year in (2018, 2019):
            for file in (tmp_path / folder / f"year={year}").glob("*.parquet"):
                file.write_bytes(b"not to be read")
                (file.parent / f".{file.name}.crc").unlink()
    two = spark.createDataFrame(contracts((3, "2", "2020-01", 8, 1999), (4, "2", "2021-01", 1, 1999)), CONTRACT)
    report = load(spark, target, two, end="2021").first()
    assert (report["rows"], report["added_rows"], report["first_period"]) == (4, 1, 2018)
    late = target.partials[0].read(spark, one).filter("year >= 2020")
    assert {(r.year, r.amount_sum, r.n) for r in late.collect()} == {(2020, 8, 1), (2021, 1, 1)}


def test_a_load_that_broke_off_is_made_good(spark, tmp_path, monkeypatch):
    target = sums(tmp_path, ledger=str(tmp_path / "ledger"))
    one = spark.createDataFrame(contracts((1, "1", "2019-03", 10, 2000), (2, "1", "2020-01", 5, 1990)), CONTRACT)
    load(spark, target, one, end="2020")
    two = spark.createDataFrame(contracts((2, "1", "2020-01", 6, 1990), (3, "2", "2021-01", 7, 1999)), CONTRACT)

    def lost(*_):
        raise OSError("lost")

    monkeypatch.setattr(loads, "record_done", lost)  # the contracts are replaced, the states are not
    with pytest.raises(OSError):
        load(spark, target, two, end="2021")
    monkeypatch.undo()
    spark.catalog.refreshByPath(target.path)
    assert found(spark, target, one) != rebuilt(spark, target, one)
    assert load(spark, target, two, end="2021").first()["rows"] == 3
    assert found(spark, target, one) == rebuilt(spark, target, one)


def test_a_table_without_states_gets_them(spark, tmp_path):
    one = spark.createDataFrame(contracts((1, "1", "2019-03", 10, 2000), (2, "1", "2020-01", 5, 1990)), CONTRACT)
    overwrite_years(one, str(tmp_path / "c"))
    target = sums(tmp_path)
    assert load(spark, target, one.filter("year > 2100"), end="2020").first()["rows"] == 2
    assert found(spark, target, one) == rebuilt(spark, target, one)


def test_sketches_merge_and_are_made_again(spark, tmp_path):
    target = Target("c", str(tmp_path / "c"), ["id", "year"], grain="year", period="year", partials=(held(tmp_path / "s", con.SKETCH_STATES, con.SALE_KEYS),))
    one = spark.createDataFrame(contracts(*((i, str(i % 2), f"20{18 + i % 3}-0{1 + i % 4}", 100 + i, 1950 + i % 40) for i in range(400))), CONTRACT)
    load(spark, target, one, end="2020")
    two = spark.createDataFrame(contracts(*((i, str(i % 2), f"2020-0{1 + i % 4}", 5 + i, 1900) for i in range(2, 100, 3)), (999, "1", "2021-01", 1, None)), CONTRACT)
    load(spark, target, two, end="2021")
    now = {r["id"]: r for r in one.collect()} | {r["id"]: r for r in two.collect()}
    for row in con.price_spread(target.partials[0].read(spark, one), ["district_code"]).collect():
        mine = sorted(r["amount"] for r in now.values() if r["district_code"] == row.district_code)
        assert (row.n, row.least, row.most) == (len(mine), mine[0], mine[-1])
        for p, value in ((0.25, row.lower), (0.5, row.middle), (0.75, row.upper)):
            assert value == mine[math.ceil(p * len(mine)) - 1]
        assert row.build_years == len({r["build_year"] for r in now.values() if r["district_code"] == row.district_code} - {None})


def test_a_sketch_keeps_its_bound(spark):
    rows = spark.range(60_000).selectExpr("int(id % 50) AS part", "double((id * 7919) % 60000) AS v")
    states = (State("v", "v", "quantiles"),)
    both = merged(partial(rows, ["part"], states), [], states)
    for p in (0.1, 0.5, 0.9):
        assert abs(both.select(quantile("v", p).alias("q")).first().q - 60_000 * p) < 60_000 * 0.006
    with pytest.raises(ValueError):
        State("x", "x", "median")
    empty = merged(partial(rows.filter("v < 0"), ["part"], states), [], states)
    assert empty.select(quantile("v", 0.5).alias("q")).first().q is None
