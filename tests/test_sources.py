"""Files on disk: contracts, wide tables, indicators, landed responses, sinks."""

import json

import pytest
from pyspark.sql import functions as F

from hearthpanel.operators.contracts import type_sales
from hearthpanel.plans.pipeline import SourceConfig, load_panels, load_rollups, load_sources
from hearthpanel.sources import catalogue, csv_files, landed, sinks, specs


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


SALE_HEADER = ",".join(landed.SALE_LAYOUT)


def sale_line(year="2020", month="1", code="11110", area="50", built="2000", amount='"10,000"'):
    values = dict.fromkeys(landed.SALE_LAYOUT, "") | {"년": year, "월": month, "지역코드": code, "전용면적": area, "건축년도": built, "거래금액": amount}
    return ",".join(values.values())


def test_scan_sales_skips_long_lines_and_keeps_short_ones(spark, tmp_path):
    short = ",".join(sale_line(amount="20000").split(",")[:16])
    path = write(tmp_path / "s.csv", "\n".join([SALE_HEADER, sale_line(), short, sale_line() + ",1,2", sale_line(code="26110")]) + "\n")
    raw = csv_files.scan_sales(spark, path)
    assert raw.columns == list(csv_files.SALE_COLUMNS.values())
    assert sorted(r["amount"] for r in type_sales(raw).collect()) == [10000, 10000, 20000]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp949"])
def test_encodings(spark, tmp_path, encoding):
    path = write(tmp_path / "e.csv", "시도,연도,월,연월,미분양_호수\n서울특별시,2020,1,2020-01,\"1,200\"\n", encoding)
    assert csv_files.detect_encoding(spark, path) == ("MS949" if encoding == "cp949" else "UTF-8")
    row = specs.read_indicator(spark, "unsold", path).first()
    assert (row["province"], row["year"], row["ym"], row["unsold"]) == ("서울", 2020, "2020-01", 1200.0)


def test_missing_file_is_an_empty_table(spark, tmp_path):
    for name, spec in specs.INDICATOR_SPECS.items():
        empty = specs.read_indicator(spark, name, str(tmp_path / "none.csv"))
        assert empty.columns == [*spec.keys, *spec.columns.values()] and empty.isEmpty()
    assert csv_files.read_population(spark, [str(tmp_path / "none.csv")]).isEmpty()


def test_national_rows_and_required_columns(spark, tmp_path):
    path = write(tmp_path / "m.csv", "연월,시도,전입,전출,순이동,연도,월\n2020-01,전국,9,9,0,2020,1\n2020-01,경기도,5,3,2,2020,1\n")
    rows = specs.read_indicator(spark, "population_migration", path).collect()
    assert [(r["province"], r["net_moved"]) for r in rows] == [("경기", 2.0)]
    lacking = write(tmp_path / "l.csv", "연월,시도,전입\n2020-01,경기,5\n")
    assert specs.read_indicator(spark, "migration", lacking).isEmpty()


def test_blank_cells_and_dates(spark, tmp_path):
    rates = write(tmp_path / "r.csv", "연월,CD_91일,국고채_10년,기준금리,연도,월\n2000-01,7.28,,4.75,2000,1\n", "utf-8-sig")
    row = specs.read_indicator(spark, "rates", rates).first()
    assert (row["cd_91d"], row["bond_10y"], row["base_rate"]) == (7.28, None, 4.75)
    events = write(tmp_path / "p.csv", "날짜,카테고리,이벤트명,방향,영향지역,상세\n2013-04-01,세제,인하,규제완화,전국,상세\n")
    assert str(specs.read_indicator(spark, "policy_events", events).first()["event_date"]) == "2013-04-01"
    dsr = write(tmp_path / "d.csv", "시행일,대책명,적용대상,DSR_비율,적용범위,비고\n2018-01-00,a,은행,관리지표,,b\n")
    row = specs.read_indicator(spark, "dsr_history", dsr).first()
    assert (row["effective"], row["effective_month"]) == ("2018-01-00", "2018-01")


def test_grdp(spark, tmp_path):
    text = '지역,구분,2010,2010,2011,2011\n지역,구분,명목,실질,명목,실질\n서울특별시,소계,"1,000",1,-,2\n서울특별시,제조업,5,5,5,5\n부산광역시,소계,300,1,"400",2\n'
    rows = {(r["province"], r["year"]): r["grdp"] for r in csv_files.read_grdp(spark, write(tmp_path / "g.csv", text)).collect()}
    assert rows == {("서울", 2010): 1000, ("부산", 2010): 300, ("부산", 2011): 400}


def test_population(spark, tmp_path):
    head = "행정구역,2013년_계_총인구수,2013년_남_총인구수,2013년_여_총인구수,2013년_계_0~4세,2014년_계_총인구수\n"
    a = write(tmp_path / "a.csv", head + '서울특별시  (1100000000),"10","4","6",1,"11"\n서울 종로구 (1111000000),1,1,1,1,1\n전국,5,5,5,5,5\n', "cp949")
    b = write(tmp_path / "b.csv", head + '서울특별시 (1100000000),99,9,9,9,x\n부산광역시 (2600000000),7,3,4,1,8\n', "cp949")
    rows = csv_files.read_population(spark, [a, b, str(tmp_path / "none.csv")]).collect()
    got = {(r["province"], r["year"]): (r["population"], r["population_male"], r["population_female"]) for r in rows}
    assert got == {("서울", 2013): (10, 4, 6), ("서울", 2014): (11, None, None), ("부산", 2013): (7, 3, 4), ("부산", 2014): (8, None, None)}


def test_permits_and_their_fallback(spark, tmp_path):
    head = "시도명,대분류,소분류,2020.1월,2020. 2월\n"
    rows = '전국,아파트,가구수,9,9\n서울,아파트,가구수,"1,000",2.9\n서울,아파트,아파트,7,7\n서울,단독,가구수,1,1\n'
    main = csv_files.read_permits(spark, write(tmp_path / "p.csv", head + rows)).collect()
    assert {(r["ym"], r["permits"]) for r in main} == {("2020-01", 1000), ("2020-02", 2)}
    spare = csv_files.read_permits(spark, write(tmp_path / "q.csv", head + '서울,아파트,아파트,7,x\n')).collect()
    assert {(r["ym"], r["permits"]) for r in spare} == {("2020-01", 7)}


def test_age_population(spark, tmp_path):
    path = write(tmp_path / "a.csv", "시도코드,시도,연도,총인구,20대,남_20대,여_50대이상\n31,경기,2011,9,1,2,3\n31,경기,x,9,1,2,3\n", "utf-8-sig")
    rows = csv_files.read_age_population(spark, path).collect()
    assert [r.asDict() for r in rows] == [{"province": "경기", "year": 2011, "age_20s": 1, "male_age_20s": 2, "female_age_50_up": 3}]


def test_workplaces(spark, tmp_path):
    plain = ",".join(csv_files.WORKPLACE_COLUMNS)
    longer = plain.replace("당월고지금액", "당월고지금액(원)")
    a = write(tmp_path / "a.csv", f"{plain}\n202001,11,110,\"1,000\",5,3,1\n자료,11,110,1,1,1,1\n")
    b = write(tmp_path / "b.csv", f"{longer}\n2020-02,11,110,2,7,x,\n")
    c = write(tmp_path / "c.csv", "x,y\n1,2\n")
    rows = {r["ym"]: r for r in csv_files.read_workplaces(spark, [a, b]).collect()}
    assert set(rows) == {"2020-01", "2020-02"} and rows["2020-01"]["subscribers"] == 1000.0
    with pytest.raises(ValueError, match="lacks the columns"):
        csv_files.read_workplaces(spark, [a, c])
    assert csv_files.last_period(spark, b) == "202002"
    assert (rows["2020-02"]["hired"], rows["2020-02"]["left"], rows["2020-02"]["billed"]) == (0.0, 0.0, 7.0)
    assert csv_files.choose_workplace_files("m.csv", ["b2028.csv", "a2019.csv", "c202312.csv", "d202401.csv"], last="202312") == ["m.csv", "b2028.csv", "d202401.csv"]
    assert csv_files.choose_workplace_files(None, [], others=("z.csv", "y.csv")) == ["y.csv", "z.csv"]
    assert csv_files.choose_workplace_files(None, ["b2024.csv", "a2019.csv"]) == ["a2019.csv", "b2024.csv"]


def test_pension(spark, tmp_path):
    with_names = write(tmp_path / "a.csv", "지역코드,시도,연도,월,연월,NPS_가입자수\n1110,서울특별시,2020,1,2020-01,5\n", "utf-8-sig")
    row = csv_files.read_pension(spark, with_names).first()
    assert (row["district_code"], row["province"], row["pension_subscribers"]) == ("01110", "서울", 5.0)
    by_code = write(tmp_path / "b.csv", "지역코드,연도,월,연월,NPS_가입자수\n26110,2020,1,2020-01,5\n99999,2020,1,2020-01,5\n")
    assert {r["province"] for r in csv_files.read_pension(spark, by_code).collect()} == {"부산", None}
    assert csv_files.read_pension(spark, str(tmp_path / "none.csv")).isEmpty()


def test_region_register(spark, tmp_path):
    text = "법정동코드,법정동명,폐지여부\n1111000000,서울특별시 종로구,존재\n1111010100,서울특별시 종로구 청운동,존재\n2611000000,부산광역시 중구,존재\n1100000000,서울특별시,존재\n4111000000,경기도 수원시,폐지\n"
    path = write(tmp_path / "r.csv", text, "cp949")
    assert [r[0] for r in csv_files.read_district_codes(spark, path).collect()] == ["11000", "11110", "26110"]
    names = {tuple(r) for r in csv_files.read_district_names(spark, path).collect()}
    assert {("11110", "종로구"), ("26110", "중구")} <= names


def xml(items, code="000"):
    body = "".join("<item>" + "".join(f"<{k}> {v} </{k}>" for k, v in i.items()) + "</item>" for i in items)
    return f"<response><header><resultCode>{code}</resultCode><resultMsg>m</resultMsg></header><body><items>\n{body}\n</items></body></response>"


def test_contract_responses(spark, tmp_path):
    folder = tmp_path / "xml"
    folder.mkdir()
    write(folder / "1.xml", xml([{"년": "2020", "보증금": "5,000", "월세": "0"}, {"년": "2021", "보증금액": "7", "월세금액": "3"}]))
    write(folder / "2.xml", xml([{"년": "1999"}], code="22"))
    write(folder / "3.xml", xml([], code="00"))
    responses = landed.read_responses(spark, str(folder))
    assert [r["result_code"] for r in landed.rejected_responses(responses).collect()] == ["22"]
    rows = landed.lease_rows(landed.xml_rows(responses, ["년", "보증금", "월세", "보증금액", "월세금액"])).orderBy("년").collect()
    assert rows[0].asDict()["보증금액"] == rows[0]["보증금"] == "5,000" and rows[1]["월세"] == rows[1]["월세금액"] == "3"
    assert list(rows[0].asDict()) == landed.LEASE_LAYOUT and rows[0]["층"] == ""
    sale = landed.sale_rows(landed.xml_rows(responses, ["년"])).columns
    assert sale == landed.SALE_LAYOUT


def test_count_responses(spark):
    items = spark.createDataFrame(
        [("2020-01", "서울특별시", "1,200"), ("2020-01", "서울", "x"), ("2020-01", "서울", "3")], "ym string, ctprvnNm string, unslQy string"
    )
    row = landed.curate_unsold(items).first()
    assert (row["province"], row["unsold"], row["year"], row["month"]) == ("서울", 1203, 2020, 1)
    built = spark.createDataFrame(
        [("2020-01", "경기도", "starts", "", "5", "9"), ("2020-01", "경기", "starts", "2", None, None), ("2020-01", "경기", "completions", None, None, "4")],
        "ym string, ctprvnNm string, stage string, hseCnt string, hoCnt string, totHoCnt string",
    )
    row = landed.curate_building_counts(built).first()
    assert (row["starts"], row["completions"]) == (7, 4)


def bank(tmp_path, name, rows):
    keys = ["TIME", "DATA_VALUE", "ITEM_NAME1", "ITEM_NAME2", "ITEM_NAME3"]
    return write(tmp_path / name, json.dumps({"StatisticSearch": {"list_total_count": len(rows), "row": [dict(zip(keys, r)) for r in rows]}}, ensure_ascii=False, indent=1))


def test_bank_loans(spark, tmp_path):
    a = bank(tmp_path, "a.json", [("202001", "1,000", "주택담보대출", "서울"), ("202002", "1,100", "주택담보대출", "서울"), ("202001", "9", "주택담보대출", "전국"), ("2020", "9", "", "서울"), ("202001", "x", "", "서울")])
    b = bank(tmp_path, "b.json", [("202001", "3000", "기타대출", "서울")])
    rows = landed.read_bank(spark, a, series="mortgage_balance").unionByName(landed.read_bank(spark, b, series="other_loan_balance"))
    got = {r["ym"]: r for r in landed.curate_loans(rows).collect()}
    assert set(got) == {"2020-01", "2020-02"} and {r["province"] for r in got.values()} == {"서울"}
    assert got["2020-02"]["mortgage_growth"] == pytest.approx(10.0) and got["2020-01"]["mortgage_share"] == 25.0
    error = write(tmp_path / "e.json", '{"RESULT": {"MESSAGE": "no data"}}')
    assert landed.read_bank(spark, error).isEmpty()


def test_bank_regional_series(spark, tmp_path):
    moved = landed.read_bank(spark, bank(tmp_path, "m.json", [("202001", "5", "서울특별시", "총전입"), ("202001", "3", "서울특별시", "총전출")]))
    assert landed.curate_migration(moved).first()["net_moved"] == 2.0
    land = landed.read_bank(spark, bank(tmp_path, "l.json", [("202001", "1.5", "경기도", "전체"), ("202001", "9", "경기도", "주거")]))
    assert [r["land_price_change"] for r in landed.curate_land_price(land).collect()] == [1.5]
    conversion = landed.read_bank(
        spark, bank(tmp_path, "c.json", [("202001", "5.1", "아파트", "서울"), ("202001", "6", "단독주택", "서울"), ("202001", "7", "아파트", "전국")])
    )
    assert [(r["province"], r["conversion_rate"]) for r in landed.curate_conversion(conversion).collect()] == [("서울", 5.1)]
    built = landed.read_bank(spark, bank(tmp_path, "s.json", [("202001", "5", "서울", "착공실적"), ("202001", "2", "준공실적", "서울")]))
    row = landed.curate_bank_construction(built).first()
    assert (row["starts"], row["completions"]) == (5.0, 2.0)
    index = landed.read_bank(spark, bank(tmp_path, "i.json", [("202001", "50", "아파트"), ("202001", "60", "아파트(서울)"), ("202001", "1", "단독주택")]), series="sale_index")
    assert {(r["province"], r["sale_index"]) for r in landed.curate_price_index(index).collect()} == {("전국", 50.0), ("서울", 60.0)}
    regional = landed.read_bank(spark, bank(tmp_path, "j.json", [("202001", "50", "부산"), ("202001", "60", "아파트")]), series="sale_index")
    assert {r["province"] for r in landed.curate_price_index(regional).collect()} == {"부산", "아파트"}
    rates = landed.read_bank(spark, bank(tmp_path, "r.json", [("202001", "1.25"), ("202001", "9")]), series="base_rate")
    assert landed.curate_national(rates, ["base_rate", "cd_91d"]).first()["base_rate"] == 1.25


def listed(spark, rows):
    return landed.list_rows(spark.createDataFrame([{**dict.fromkeys(landed.LIST_FIELDS), **r} for r in rows], ", ".join(f"{f} string" for f in landed.LIST_FIELDS)))


def test_household_tables(spark):
    def row(region, trait, item, value, kind="전가구 평균"):
        return {"PRD_DE": "2020", "C1_NM": region, "C2_NM": trait, "C3_NM": item, "ITM_NM": kind, "DT": value}

    rows = [row("서울", "전체", "자산", "1,000"), row("서울", "전체", "부채", "400"), row("서울", "전체", "경상소득(전년도)", "200"), row("서울", "남자", "자산", "9"), row("서울", "전체", "자산", "7", "중앙값"), row("전국", "전체", "자산", "5")]
    got = landed.curate_household_assets(listed(spark, rows)).first()
    assert (got["household_assets"], got["net_worth"], got["debt_to_income"]) == (1000.0, 600.0, 200.0)
    other = landed.curate_household_assets(listed(spark, [row("서울", "전체", "전가구 평균", "3.5")]), items=["전가구 평균"]).first()
    assert other["전가구 평균"] == 3.5
    quint = [
        {"PRD_DE": "2020", "C1_NM": "전체", "C2_NM": " 1분위 ", "C3_NM": item, "ITM_NM": "평균", "DT": v}
        for item, v in (("자산", "10"), ("부채", "4"), ("경상소득", "0"), ("금융자산", "3"))
    ]
    got = landed.curate_quintiles(listed(spark, quint)).first()
    assert (got["quintile"], got["net_worth"], got["financial_assets"], got["debt_to_income"]) == ("1분위", 6.0, 3.0, None)


def test_household_items_of_other_wording_are_an_error(spark):
    row = {"PRD_DE": "2020", "C1_NM": "서울", "C2_NM": "전체", "C3_NM": "전가구 평균", "ITM_NM": "평균", "DT": "3.5"}
    with pytest.raises(ValueError, match="household_items"):
        landed.curate_household_assets(listed(spark, [row]))
    assert landed.curate_household_assets(listed(spark, [row]).limit(0)).count() == 0


def test_income_levels(spark):
    def row(code, name, c2, item, value):
        return {"PRD_DE": "2020", "C1": code, "C1_NM": name, "C2": c2, "ITM_ID": item, "DT": value}

    rows = [row("A00", "전국", "B02", "T001", "9"), row("A01", "서울시", "B02", "T001", "8"), row("A0101", "종로구", "B02", "T001", "4"), row("A0101", "종로구", "B02", "T002", "20"), row("A1801", "기타", "B02", "T001", "1")]
    data = listed(spark, rows)
    district = landed.curate_income(data).collect()
    assert [(r["district_name"], r["province"], r["pay_per_head"]) for r in district] == [("종로구", "서울", 5.0)]
    assert [r["district_name"] for r in landed.curate_income(data, level="province").collect()] == ["서울"]
    assert landed.curate_income(data, level=None).count() == 4


def test_age_rows(spark):
    rows = [{"PRD_DE": "2020", "C1": "11", "C2": c2, "ITM_ID": item, "DT": v} for c2, item, v in (("0", "T2", "100"), ("25", "T3", "4"), ("30", "T3", "5"), ("30", "T9", "9"), ("105", "T4", "1"))]
    got = landed.curate_age_population(listed(spark, rows)).first()
    assert (got["province"], got["population"], got["male_age_20s"], got["female_age_50_up"], got["age_20s"]) == ("서울", 100, 9, 1, None)
    district = [{**r, "C1": "11110", "C1_NM": "종로구"} for r in rows]
    got = landed.curate_age_population(listed(spark, district), level="district").first()
    assert (got["district_name"], got["province"], got["province_code"]) == ("종로구", "서울", "11")


def test_construction_rows(spark):
    rows = listed(spark, [{"PRD_DE": "202001", "C1_NM": "서울", "DT": v, "C2_NM": k} for k, v in (("total", "10"), ("apartment", "7"), ("apartment", "-"))])
    got = landed.curate_construction(rows.withColumns({"stage": F.lit("starts"), "kind": F.col("C2_NM")})).first()
    assert (got["starts"], got["starts_non_apartment"], got["completions"]) == (10.0, 3.0, None)


def test_market_survey(spark):
    def frame(rows):
        return spark.createDataFrame(rows, "region string, d string, value double").withColumn("date", F.to_date("d"))

    out = landed.curate_market(frame([("서울", "2020-01-31", 1.0)]), frame([("전국", "2020-01-31", 2.0), ("서울", "2020-02-29", 3.0)]), frame([("서울", "2020-01-01", 4.0)]))
    got = {r["ym"]: (r["buyer_superiority"], r["trade_activity"], r["lease_supply"]) for r in out.collect()}
    assert got == {"2020-01": (1.0, None, 4.0), "2020-02": (None, 3.0, None)}


def test_census(spark):
    text = json.dumps({"result": [{"tot_ppltn": "9,417", "avg_age": "43.4", "corp_cnt": "N/A"}]})
    responses = spark.createDataFrame([("11", "서울", 2022, text)], "province_code string, province string, year int, value string")
    got = landed.curate_census(responses, "population").first()
    assert (got["population"], got["mean_age"], got["businesses"]) == (9417, 43.4, None)
    for table in ("household", "house"):
        assert landed.curate_census(responses, table).count() == 1


def test_catalogue(spark):
    from hearthpanel.operators.scope import search_variables

    table = catalogue.variable_catalogue(spark)
    names = [r["variable"] for r in table.collect()]
    assert len(names) == len(set(names)) >= 68
    assert {r["variable"] for r in search_variables(table, "BASE RATE").collect()} == {"base_rate"}
    assert search_variables(table, "price", "derived").count() >= 3
    assert table.filter("variable = 'bond_3y'").first()["description"] == "[central bank]"


@pytest.fixture
def config(tmp_path):
    lines = [SALE_HEADER] + [sale_line(year=y, month=m, amount=a, code=c) for y, m, a, c in (("2020", "1", '"10,000"', "11110"), ("2020", "12", "20000", "11140"), ("2021", "12", "45000", "11110"))]
    sales = write(tmp_path / "sales.csv", "\n".join(lines) + "\n")
    head = ",".join(landed.LEASE_LAYOUT)
    values = dict.fromkeys(landed.LEASE_LAYOUT, "") | {"년": "2020", "월": "1", "지역코드": "11110", "전용면적": "50", "보증금액": "6000"}
    leases = write(tmp_path / "leases.csv", f"{head}\n{','.join(values.values())}\n")
    loans = write(tmp_path / "loans.csv", "시도,연도,월,연월,주담대_잔액\n서울,2020,11,2020-11,5\n서울,2020,12,2020-12,7\n")
    assets = write(tmp_path / "assets.csv", "시도,연도,가구_소득평균\n서울특별시,2020,5000\n")
    return SourceConfig(
        rollups=str(tmp_path / "rollups"), sales=sales, leases=leases, grdp=str(tmp_path / "none.csv"),
        indicators={"loans": loans, "assets": assets, "sentiment": str(tmp_path / "none.csv")},
    )


def test_pipeline_from_files_to_panels(spark, config, tmp_path):
    yearly, monthly = load_panels(spark, config)
    got = {r["year"]: r for r in yearly.collect()}
    assert got[2020]["avg_price"] == 15000.0 and got[2020]["deal_count"] == 2
    assert got[2020]["pir"] == 3.0 and got[2020]["mortgage_balance"] == 7.0 and got[2020]["deposit_ratio"] == 40.0
    assert got[2021]["price_yoy"] == pytest.approx(200.0) and got[2021]["household_income"] is None
    assert "grdp" not in yearly.columns and "sentiment" not in yearly.columns
    assert {r["ym"] for r in monthly.collect()} == {"2020-01", "2020-12", "2021-12"}
    assert set(load_sources(spark, config)) == {"sales", "sales_detail", *("deposit_only", "monthly_rent", "all_leases"), "loans", "assets"}


def test_rollups_are_reused_until_rebuilt(spark, config):
    first = load_rollups(spark, config)
    assert first["monthly_rent"].isEmpty() and "avg_rent" in first["monthly_rent"].columns
    with open(config.sales, "a", encoding="utf-8") as f:
        f.write(sale_line(year="2022") + "\n")
    assert load_rollups(spark, config)["sales"].count() == 3
    rebuilt = load_rollups(spark, config, force_rebuild=True)
    assert rebuilt["sales"].count() == 4 and rebuilt["sales_detail"].count() == 4
    pruned = rebuilt["sales"].filter("year = 2022")
    assert "PartitionFilters: [isnotnull(year" in pruned._jdf.queryExecution().executedPlan().toString()


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([("종로구", 1.5), ("중구", None)], "name string, score double")
    path = str(tmp_path / "out")
    sinks.export_csv(df, path, single_file=True)
    back = csv_files.read_csv_any(spark, path)
    assert back.columns == ["name", "score"] and [tuple(r) for r in back.collect()] == [("종로구", "1.5"), ("중구", None)]
    part = next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbf")
    sinks.write_curated(df, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2


def test_contract_files_are_read_by_their_own_header(spark, tmp_path):
    """Other encodings, another column order and years such as 2020.0 lose no row; a missing column is an error."""
    from hearthpanel.operators.contracts import type_sales, valid_contracts

    names = list(csv_files.SALE_COLUMNS)
    values = {"년": "2020.0", "월": "3", "지역코드": "11110", "전용면적": "84.5", "건축년도": "2001", "거래금액": '"12,500"'}
    line = lambda order: ",".join(order) + "\n" + ",".join(values[c] for c in order) + "\n"
    folder = tmp_path / "sales"
    folder.mkdir()
    write(folder / "a.csv", line(names))
    write(folder / "b.csv", line(names[::-1]))
    write(folder / "c.csv", line(names), "cp949")
    write(folder / "d.csv", line(names), "utf-8-sig")
    rows = valid_contracts(type_sales(csv_files.scan_sales(spark, str(folder)))).collect()
    assert len(rows) == 4 and {(r["district_code"], r["year"], r["month"], r["amount"], r["area"]) for r in rows} == {("11110", 2020, 3, 12500, 84.5)}
    write(folder / "e.csv", line(names[1:]))
    with pytest.raises(ValueError, match="lacks the columns 년"):
        csv_files.scan_sales(spark, str(folder))


def test_other_files_are_read_by_their_own_header_too(spark, tmp_path):
    """Encoding and order of one file say nothing about the next, in files that are no contracts either."""
    folder = tmp_path / "인구 표"
    folder.mkdir()
    write(folder / "a b.csv", "시도,연도,20대\n서울특별시,2020,5\n", "cp949")
    write(folder / "b%20.csv", "연도,시도,30대\n2021,부산광역시,6\n")
    write(folder / "empty.csv", "")
    rows = csv_files.read_csv_any(spark, str(folder)).select("시도", "연도", "20대", "30대").collect()
    assert sorted(map(tuple, rows)) == [("부산광역시", "2021", None, "6"), ("서울특별시", "2020", "5", None)]
    # Headers without Korean text leave the encoding to the lines.
    write(tmp_path / "x.csv", "region,n\n서울,1\n", "cp949")
    write(tmp_path / "y.csv", "region,n\n부산,2,3,4\n부산\n")
    both = [str(tmp_path / "x.csv"), str(tmp_path / "y.csv")]
    assert [(g.encoding, g.names) for g in csv_files.file_groups(spark, both)] == [("MS949", ("region", "n")), ("UTF-8", ("region", "n"))]
    assert sorted(map(tuple, csv_files.read_csv_any(spark, both).collect())) == [("부산", None), ("서울", "1")]
    twice = write(tmp_path / "z.csv", "a,,a\n1,2,3\n")
    assert csv_files.read_csv_any(spark, twice).columns == ["a0", "_c1", "a2"]
    assert csv_files.read_csv_any(spark, str(folder / "empty.csv")).isEmpty()


def test_headers_of_many_files_are_one_job(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(60):
        write(folder / f"{i:03d}.csv", f"년,값{i % 2}\n" + f"{i},1\n" * 3000)
    context = spark.sparkContext
    context.setJobGroup("headers", "headers")
    groups = csv_files.file_groups(spark, str(folder))
    jobs = context.statusTracker().getJobIdsForGroup("headers")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((g.names, len(g.files)) for g in groups) == [(("년", "값0"), 30), (("년", "값1"), 30)]
    assert len([j for j in jobs if len(context.statusTracker().getJobInfo(j).stageIds) == 1]) <= 2  # listing files may be one of its own


def test_contracts_land_with_their_rejects_in_one_scan(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    names = list(csv_files.SALE_COLUMNS)
    write(folder / "a.csv", ",".join(names) + "\n2020,1,11110,50,2000,10\n2020,1,11110,50,2000,10,9,9\n2020,2,11110\n")
    write(folder / "b.csv", ",".join(names[::-1]) + "\n20,2001,60,26110,3,2021\n")
    got = csv_files.land_contracts(spark, str(folder), csv_files.SALE_COLUMNS, str(tmp_path / "landed"))
    assert (got.lines, got.skipped, got.short) == (4, 1, 1)
    assert got.rows.columns == list(csv_files.SALE_COLUMNS.values())
    rows = sorted((r["year"], r["month"], r["amount"]) for r in got.rows.collect())
    assert [r[:2] for r in rows] == [("2020", "1"), ("2020", "2"), ("2021", "3")] and rows[2][2] == "20"
    reject = got.rejects.collect()
    assert [(r["file"].rsplit("/", 1)[-1], r["line"]) for r in reject] == [("a.csv", "2020,1,11110,50,2000,10,9,9")]


def test_household_items_have_no_cap(spark):
    rows = [{"PRD_DE": "2020", "C1_NM": "서울", "C2_NM": "전체", "C3_NM": f"항목 {i}", "ITM_NM": "평균", "DT": str(i)} for i in range(1500)]
    got = landed.household_items(listed(spark, rows)).collect()
    assert {(r["item"], r["value"]) for r in got} == {(f"항목 {i}", float(i)) for i in range(1500)}
