"""Landed XML and JSON responses to curated indicator tables.

Files are read in parallel; one response file is one page of a public interface
and stays small. Nothing here fetches anything.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthpanel.functions.numeric import clean_amount, clean_double
from hearthpanel.functions.periods import month_of, year_of, ym_from_compact
from hearthpanel.functions.regions import (
    INCOME_PROVINCE,
    NATIONWIDE,
    PROVINCE_SHORT,
    SURVEY_PROVINCE,
    exact_province,
    lookup,
    province_from_code,
    short_province,
)
from hearthpanel.operators.ratios import (
    with_balance_sheet_ratios,
    with_loan_ratios,
    with_net_migration,
    with_non_apartment,
    with_per_head_income,
)
from hearthpanel.operators.reshape import age_pivot, arrival, pivot_series
from hearthpanel.operators.scope import prefer_value

# ---- XML --------------------------------------------------------------------

# Column order of the contract files.
SALE_LAYOUT = [
    "년", "월", "일", "지역코드", "법정동", "지번", "아파트", "단지", "연립다세대", "연면적", "전용면적",
    "대지면적", "대지권면적", "층", "건축년도", "거래금액", "주택유형", "구분", "해제여부", "해제사유발생일",
    "거래유형", "등기일자",
]
LEASE_LAYOUT = [
    "년", "월", "일", "지역코드", "법정동", "지번", "아파트", "연립다세대", "단지", "계약면적", "전용면적",
    "층", "건축년도", "보증금액", "월세금액", "보증금", "월세", "종전계약보증금", "종전계약월세",
    "갱신요구권사용", "계약기간", "계약구분",
]


def read_responses(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per response file, with its result code and whether that is an error."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return with_result_code(files)


def with_result_code(files: DataFrame) -> DataFrame:
    code = F.trim(F.regexp_extract("value", r"<resultCode>([^<]*)</resultCode>", 1))
    return files.withColumns(
        {
            "result_code": code,
            "result_message": F.trim(F.regexp_extract("value", r"<resultMsg>([^<]*)</resultMsg>", 1)),
            "failed": (F.length(code) > 0) & (F.length(F.regexp_replace(code, "^0+", "")) > 0),
        }
    )


def rejected_responses(responses: DataFrame) -> DataFrame:
    return responses.filter("failed").select("file", "result_code", "result_message")


def xml_rows(responses: DataFrame, tags: list[str], *, keep: list[str] = ()) -> DataFrame:
    """Items of the accepted responses, one text column per tag, blanks trimmed."""
    schema = ", ".join(f"`{tag}` string" for tag in tags)
    items = responses.filter(~F.col("failed")).select(
        *keep, F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<item(?:\s[^>]*)?>.*?</item>"), F.lit(0))).alias("item")
    )
    parsed = items.select(*keep, F.from_xml("item", schema).alias("r"))
    return parsed.select(*keep, *(F.trim(F.col(f"r.`{tag}`")).alias(tag) for tag in tags))


MALFORMED = "malformed"


def read_items(spark: SparkSession, path: str | list[str], tags: list[str], *, item: str = "item") -> DataFrame:
    """Items of response files of any size: ``file``, one trimmed text column per tag, and ``malformed``.

    The end tag of an item ends a record, so a long file is split over tasks
    and no task holds more of it than one item. Files whose result code is an
    error give no items. An item that is no XML has null tags and its text in
    ``malformed``; one that a file breaks off in is taken for whole if the tags
    it has are closed. Text that holds no item gives no row.
    """
    opened = rf"<{item}(?:\s[^>]*)?>"
    records = spark.read.option("lineSep", f"</{item}>").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    coded = with_result_code(records.filter(F.col("value").contains("<resultCode>")))
    failed = coded.filter("failed").select("file").distinct()
    inner = F.regexp_extract("value", rf"(?s){opened}(.*)\z", 1)
    kept = records.filter(F.col("value").rlike(opened)).join(failed, "file", "left_anti").select("file", inner.alias("inner"))
    schema = ", ".join(f"`{name}` string" for name in (*tags, MALFORMED))
    text = F.concat(F.lit("<item>"), F.col("inner"), F.lit("</item>"))
    parsed = kept.select("file", F.from_xml(text, schema, {"columnNameOfCorruptRecord": MALFORMED}).alias("r"))
    return parsed.select("file", *(F.trim(F.col(f"r.`{tag}`")).alias(tag) for tag in tags), F.col(f"r.{MALFORMED}").alias(MALFORMED))


def _blank(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def _fill(name: str, other: str) -> Column:
    return F.coalesce(F.nullif(_blank(name), F.lit("")), _blank(other))


def sale_rows(items: DataFrame) -> DataFrame:
    """Sale contracts in file layout; missing fields are empty."""
    items = items.withColumns({c: F.lit("") for c in SALE_LAYOUT if c not in items.columns})
    return items.select(*(_blank(c).alias(c) for c in SALE_LAYOUT))


def lease_rows(items: DataFrame) -> DataFrame:
    """Lease contracts in file layout; old and new names of deposit and rent fill each other."""
    items = items.withColumns({c: F.lit("") for c in LEASE_LAYOUT if c not in items.columns})
    twins = {"보증금액": "보증금", "보증금": "보증금액", "월세금액": "월세", "월세": "월세금액"}
    return items.select(*((_fill(c, twins[c]) if c in twins else _blank(c)).alias(c) for c in LEASE_LAYOUT))


def _with_period(df: DataFrame) -> DataFrame:
    return df.withColumns({"year": year_of("ym"), "month": month_of("ym")})


def _count_or_zero(*tags: str) -> Column:
    """First tag with text; text that is no whole number counts 0."""
    text = F.coalesce(*(F.nullif(F.trim(F.col(f"`{tag}`")), F.lit("")) for tag in tags), F.lit("0"))
    return F.coalesce(clean_amount(text), F.lit(0))


def curate_unsold(items: DataFrame) -> DataFrame:
    """Unsold homes per province and month; ``items`` carry the requested ``ym``."""
    rows = items.select("ym", exact_province("ctprvnNm", keep_unknown=True).alias("province"), _count_or_zero("unslQy").alias("unsold"))
    return _with_period(rows.dropna(subset=["ym", "province"]).groupBy("ym", "province").agg(F.sum("unsold").alias("unsold")))


def curate_building_counts(items: DataFrame) -> DataFrame:
    """Starts and completions from month files, by the stage column of the request."""
    rows = items.select(
        "ym",
        exact_province("ctprvnNm", keep_unknown=True).alias("province"),
        "stage",
        _count_or_zero("hseCnt", "hoCnt", "totHoCnt").alias("homes"),
    )
    return _with_period(pivot_series(rows, keys=["ym", "province"], names="stage", values=["starts", "completions"], value="homes", agg="sum"))


# ---- central-bank statistics ------------------------------------------------

BANK_SCHEMA = (
    "StatisticSearch struct<row: array<struct<TIME: string, DATA_VALUE: string, ITEM_NAME1: string, "
    "ITEM_NAME2: string, ITEM_NAME3: string, ITEM_NAME4: string>>>"
)
ITEMS = ["item1", "item2", "item3", "item4"]


def read_bank(spark: SparkSession, path: str | list[str], *, series: str | None = None) -> DataFrame:
    """Rows of central-bank responses, labelled with the requested series."""
    return bank_rows(spark.read.schema(BANK_SCHEMA).option("multiLine", True).json(path), series=series, seq=arrival())


def bank_rows(responses: DataFrame, *, series: str | Column | None = None, seq: Column | None = None) -> DataFrame:
    """Monthly rows with a numeric value.

    ``seq`` orders the rows that compete for one cell: arrival first, then the
    position in the response.
    """
    label = series if isinstance(series, Column) else F.lit(series)
    placed = F.monotonically_increasing_id() if seq is None else seq
    rows = responses.select(
        label.alias("series"), placed.alias("arrival"), F.posexplode("StatisticSearch.row").alias("position", "r")
    )
    value = clean_double("r.DATA_VALUE")
    return rows.select(
        F.struct("arrival", "position").alias("seq"),
        F.when(F.length("r.TIME") >= 6, ym_from_compact("r.TIME")).alias("ym"),
        value.alias("value"),
        *(F.trim(F.coalesce(f"r.ITEM_NAME{i}", F.lit(""))).alias(f"item{i}") for i in range(1, 5)),
        "series",
    ).filter(F.col("ym").isNotNull() & F.col("value").isNotNull())


# Labels of loan rows that name the item, not a region.
LOAN_LABELS = ["주택담보대출", "기타대출", "예금은행", "가계대출", "주담대"]


def curate_loans(rows: DataFrame) -> DataFrame:
    """Mortgage and other loans per province and month with growth and share.

    ``series`` is ``mortgage_balance`` or ``other_loan_balance``.
    """
    named = [F.when((F.col(c) != "") & ~F.col(c).isin(LOAN_LABELS), F.col(c)) for c in ("item2", "item3", "item4", "item1")]
    shorts = sorted(set(PROVINCE_SHORT.values()) | {NATIONWIDE})
    rows = rows.withColumn("province", F.coalesce(*named)).filter(F.col("province").isin(shorts))
    wide = pivot_series(
        rows, keys=["ym", "province"], names="series", values=["mortgage_balance", "other_loan_balance"], value="value", seq="seq"
    )
    return _with_period(with_loan_ratios(wide)).filter(F.col("province") != NATIONWIDE)


def curate_national(rows: DataFrame, series: list[str]) -> DataFrame:
    """National monthly series side by side: rates, sentiment."""
    return _with_period(pivot_series(rows, keys=["ym"], names="series", values=series, value="value", seq="seq"))


def _region_and_kind(rows: DataFrame) -> DataFrame:
    """Region from the first item, or from the second where the first is missing; the other is the kind."""
    first = F.nullif(F.col("item1"), F.lit(""))
    region = exact_province(F.coalesce(first, F.col("item2")), keep_unknown=True)
    return rows.withColumns({"province": region, "kind": F.when(first.isNotNull(), F.col("item2")).otherwise(F.col("item1"))})


def curate_migration(rows: DataFrame) -> DataFrame:
    """People moving in and out per province and month, by the wording of the kind."""
    way = F.when(F.col("kind").contains("전입"), "moved_in").when(F.col("kind").contains("전출"), "moved_out")
    rows = _region_and_kind(rows).withColumn("way", way).filter(F.col("way").isNotNull())
    wide = pivot_series(rows, keys=["ym", "province"], names="way", values=["moved_in", "moved_out"], value="value", seq="seq")
    return _with_period(with_net_migration(wide))


# Labels of all uses in land prices, and of home types in conversion rates.
ALL_USES = ["전체", "계"]
HOME_TYPES = ["아파트", "단독주택", "연립다세대", "전체"]
PREFERRED_HOMES = ["아파트", "전체"]


def curate_land_price(rows: DataFrame) -> DataFrame:
    """Land price change per province and month, all uses where given."""
    rows = prefer_value(_region_and_kind(rows), "kind", ALL_USES)
    return _with_period(rows.select("ym", "province", F.col("value").alias("land_price_change")))


def curate_conversion(rows: DataFrame) -> DataFrame:
    """Deposit-to-rent conversion rate of apartments, else of all homes, else every row."""
    shorts = sorted(set(PROVINCE_SHORT.values()))
    names = [exact_province(c, keep_unknown=True) for c in ITEMS[:3]]
    # The last matching item decides, as later items are more specific.
    region = F.coalesce(*(F.when(n.isin(shorts), n) for n in reversed(names)))
    nation = reduce(lambda a, b: a | b, (F.col(c).contains(NATIONWIDE) for c in ITEMS[:3]))
    kind = F.coalesce(*(F.when(F.col(c).isin(HOME_TYPES) & ~n.isin(shorts), F.col(c)) for c, n in zip(reversed(ITEMS[:3]), reversed(names))), F.lit("전체"))
    rows = rows.withColumns({"province": F.coalesce(region, F.when(nation, NATIONWIDE)), "kind": kind})
    rows = prefer_value(rows.filter(F.col("province").isNotNull()), "kind", PREFERRED_HOMES)
    rows = rows.filter(F.col("province") != NATIONWIDE)
    return _with_period(rows.select("ym", "province", F.col("value").alias("conversion_rate")))


# Labels of the price index that name a home type instead of a region.
INDEX_TYPES = ["총지수", "단독주택", "연립주택", "아파트", "아파트(서울)", "총지수(서울)"]


def curate_price_index(rows: DataFrame) -> DataFrame:
    """Sale and lease price index per region and month.

    If the table lists home types only, apartments stand for the nation and
    apartments in Seoul for Seoul.
    """
    rows = rows.withColumn("label", exact_province("item1", keep_unknown=True))
    only_types = rows.select(F.min(F.col("label").isin(INDEX_TYPES))).scalar()
    as_region = F.when(F.col("label") == "아파트", NATIONWIDE).when(F.col("label") == "아파트(서울)", "서울")
    rows = rows.withColumn("_only_types", only_types)
    rows = rows.withColumn("province", F.when(F.col("_only_types"), as_region).otherwise(F.col("label")))
    wide = pivot_series(
        rows.filter(F.col("province").isNotNull()),
        keys=["ym", "province"],
        names="series",
        values=["sale_index", "lease_index"],
        value="value",
        seq="seq",
    )
    return _with_period(wide)


def curate_bank_construction(rows: DataFrame) -> DataFrame:
    """Starts and completions from bank rows whose items name region and stage in any order."""
    shorts = sorted(set(PROVINCE_SHORT.values()))
    names = [exact_province(c) for c in ITEMS[:3]]
    region = F.coalesce(*(F.when(n.isin([*shorts, NATIONWIDE]), n) for n in reversed(names)))

    def stage(c: str) -> Column:
        return F.when(F.col(c).contains("착공"), "starts").when(F.col(c).contains("준공") | F.col(c).contains("완공"), "completions")

    rows = rows.withColumns({"province": region, "stage": F.coalesce(*(stage(c) for c in reversed(ITEMS[:3])))})
    # Without any stage the rows count as starts.
    staged = rows.select(F.max(F.col("stage").isNotNull())).scalar()
    rows = rows.withColumn("_staged", staged).withColumn(
        "stage", F.when(F.col("_staged"), F.col("stage")).otherwise(F.lit("starts"))
    )
    rows = rows.filter(F.col("stage").isNotNull())
    return _with_period(
        pivot_series(rows, keys=["ym", "province"], names="stage", values=["starts", "completions"], value="value", agg="sum")
    )


# ---- statistics-office lists ------------------------------------------------

LIST_FIELDS = ["PRD_DE", "DT", "C1", "C1_NM", "C2", "C2_NM", "C3", "C3_NM", "ITM_ID", "ITM_NM"]


def read_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of list-shaped statistics with a numeric value and a year."""
    schema = ", ".join(f"{name} string" for name in LIST_FIELDS)
    return list_rows(spark.read.schema(schema).option("multiLine", True).json(path), seq=arrival())


def list_rows(raw: DataFrame, *, seq: Column | None = None) -> DataFrame:
    """``seq`` orders the rows; without it they keep the order of the table at hand."""
    placed = F.monotonically_increasing_id() if seq is None else seq
    return raw.withColumns(
        {"value": clean_double("DT"), "year": F.substring("PRD_DE", 1, 4).try_cast("int"), "seq": placed}
    )


# Wording of household balance sheet items.
def _household_item(name: str) -> Column:
    text = F.trim(F.col(name))
    return (
        F.when(text.isin("자산", "총자산", "자산액") | (text.contains("자산") & text.contains("총")), "household_assets")
        .when(text.isin("부채", "총부채", "부채액") | (text.contains("부채") & text.contains("총")), "household_debt")
        .when(text.isin("소득", "총소득") | (text.contains("소득") & (text.contains("경상") | text.contains("총"))), "household_income")
    )


def _province_values(rows: DataFrame, region: str) -> DataFrame:
    return rows.withColumn("province", exact_province(region)).filter(
        F.col("province").isNotNull() & (F.col("province") != NATIONWIDE) & F.col("year").isNotNull() & F.col("value").isNotNull()
    )


def household_items(rows: DataFrame, *, region: str = "C1_NM", item: str = "C3_NM") -> DataFrame:
    """Every item of a balance sheet table in long form: (year, province, item, value), the first value of each."""
    named = _province_values(rows, region).withColumn("item", F.trim(item)).filter(F.col("item").isNotNull())
    return named.groupBy("year", "province", "item").agg(F.min_by("value", "seq").alias("value"))


def curate_household_assets(
    rows: DataFrame, *, region: str = "C1_NM", item: str = "C3_NM", trait: str = "C2_NM", items: list[str] | None = None
) -> DataFrame:
    """Balance sheet of the average household per province and year.

    Total categories and average items are used where the table has them. A
    table with other wording is spread into the columns that ``items`` names;
    without them it is an error. ``household_items`` lists all it has.
    """
    rows = _province_values(rows, region)
    if items is not None:
        return pivot_series(rows.withColumn("measure", F.trim(item)), keys=["year", "province"], names="measure", values=items, value="value", seq="seq")
    known = rows.withColumn("measure", _household_item(item)).filter(F.col("measure").isNotNull())
    if known.isEmpty() and not rows.isEmpty():
        raise ValueError(f"no known balance sheet item in {item}: name the columns in items; household_items lists those of the table")
    total = F.col(trait).contains("전체") | (F.col(trait) == "계")
    average = F.col("ITM_NM").contains("평균")
    for wanted in (total, average):
        flag = F.coalesce(wanted, F.lit(False))
        some = known.select(F.max(flag)).scalar()
        known = known.withColumn("_some", some).filter(flag | ~F.col("_some")).drop("_some")
    measures = ["household_assets", "household_debt", "household_income"]
    return with_balance_sheet_ratios(
        pivot_series(known, keys=["year", "province"], names="measure", values=measures, value="value", seq="seq")
    )


def _quintile_item(name: str) -> Column:
    text = F.trim(F.col(name))
    return (
        F.when(text.isin("자산", "총자산", "자산액"), "household_assets")
        .when(text.isin("부채", "총부채", "부채액"), "household_debt")
        .when(text.isin("소득", "총소득") | (text.contains("소득") & text.contains("경상")), "household_income")
        .when(text.contains("순자산"), "net_worth")
        .when(text == "금융자산", "financial_assets")
        .when(text.contains("실물자산"), "real_assets")
        .when(text == "금융부채", "financial_debt")
        .when(text.contains("임대보증금"), "lease_deposits")
    )


QUINTILE_MEASURES = [
    "household_assets", "household_debt", "household_income", "net_worth",
    "financial_assets", "real_assets", "financial_debt", "lease_deposits",
]


def curate_quintiles(rows: DataFrame) -> DataFrame:
    """Balance sheet per income quintile and year: all households, average items."""
    rows = rows.filter((F.col("C1_NM") == "전체") & F.col("ITM_NM").contains("평균"))
    rows = rows.withColumns({"quintile": F.trim("C2_NM"), "measure": _quintile_item("C3_NM")}).filter(F.col("measure").isNotNull())
    wide = pivot_series(rows, keys=["year", "quintile"], names="measure", values=QUINTILE_MEASURES, value="value", seq="seq")
    debt = F.col("household_debt")
    return wide.withColumns(
        {
            "net_worth": F.coalesce("net_worth", F.col("household_assets") - debt),
            "debt_to_income": F.when(
                F.col("household_income") > 0, F.try_divide(debt, F.col("household_income")) * 100
            ),
        }
    )


# Codes of the labour-income table.
INCOME_ITEMS = {"B01": "급여총계", "B02": "총급여", "B03": "과세표준", "B04": "결정세액"}
INCOME_UNITS = {"T001": "인원", "T002": "금액"}
INCOME_MEASURES = {"총급여_인원": "earners", "총급여_금액": "pay_total", "결정세액_인원": "taxpayers", "결정세액_금액": "tax_total"}


def curate_income(rows: DataFrame, *, level: str | None = "district") -> DataFrame:
    """Labour income per region and year with amounts per head.

    ``level`` keeps districts (without the unassigned rest), provinces or the
    nation; ``None`` keeps all.
    """
    label = F.concat(
        F.coalesce(lookup(INCOME_ITEMS, "C2"), F.col("C2_NM")), F.lit("_"), F.coalesce(lookup(INCOME_UNITS, "ITM_ID"), F.col("ITM_NM"))
    )
    rows = rows.withColumn("measure", lookup(INCOME_MEASURES, label)).filter(F.col("measure").isNotNull())
    wide = pivot_series(
        rows, keys=["C1", "C1_NM", "year"], names="measure", values=list(INCOME_MEASURES.values()), value="value", seq="seq"
    )
    whole = F.length("C1") <= 3
    province = lookup(INCOME_PROVINCE, F.substring("C1", 1, 3))
    out = with_per_head_income(
        wide.select(
            F.col("C1").alias("district_code"),
            province.alias("province"),
            F.when(whole, province).otherwise(F.col("C1_NM")).alias("district_name"),
            F.when(F.col("C1") == "A00", "nation").when(whole, "province").otherwise("district").alias("level"),
            "year",
            *INCOME_MEASURES.values(),
        )
    )
    if level is None:
        return out
    kept = out.filter(F.col("level") == level)
    return kept.filter(F.col("province") != "기타") if level == "district" else kept


# Item codes of the population table.
SEX_ITEMS = {"T2": "total", "T3": "male", "T4": "female"}


def curate_age_population(rows: DataFrame, *, level: str = "province", names: DataFrame | None = None) -> DataFrame:
    """Population by decade and sex from five-year age rows."""
    sex = lookup(SEX_ITEMS, "ITM_ID")
    people = clean_amount("DT")
    if level == "district":
        prefix = F.substring("C1", 1, 2)
        long = rows.select(
            F.col("C1").alias("district_code"),
            F.coalesce("C1_NM", "C1").alias("district_name"),
            prefix.alias("province_code"),
            F.coalesce(short_province(province_from_code("C1")), prefix).alias("province"),
            "year",
            F.col("C2").alias("age_code"),
            sex.alias("sex"),
            people.alias("people"),
        )
        if names is not None:
            from hearthpanel.functions.regions import with_district_name

            long = with_district_name(long.drop("district_name"), names)
    else:
        long = rows.select(
            F.col("C1").alias("province_code"),
            F.coalesce(lookup(SURVEY_PROVINCE, "C1"), F.col("C1")).alias("province"),
            "year",
            F.col("C2").alias("age_code"),
            sex.alias("sex"),
            people.alias("people"),
        )
    return age_pivot(long.filter(F.col("sex").isNotNull()), level=level)


def curate_construction(rows: DataFrame) -> DataFrame:
    """Starts and completions by home type from list rows.

    ``stage`` is ``starts`` or ``completions``; ``kind`` is ``total``,
    ``apartment`` or another home type. A value that is no number counts 0.
    """
    rows = rows.withColumns(
        {
            "province": exact_province("C1_NM"),
            "ym": F.when(F.length("PRD_DE") >= 6, ym_from_compact("PRD_DE")),
            "value": F.coalesce(clean_double("DT"), F.lit(0.0)),
            "series": F.concat_ws("_", "stage", "kind"),
        }
    ).filter(F.col("province").isNotNull() & F.col("ym").isNotNull())
    series = [f"{stage}_{kind}" for stage in ("starts", "completions") for kind in ("total", "apartment")]
    wide = pivot_series(rows, keys=["ym", "province"], names="series", values=series, value="value", agg="sum")
    return _with_period(with_non_apartment(wide))


def curate_market(buyers: DataFrame, trades: DataFrame, leases: DataFrame) -> DataFrame:
    """Three market survey series merged on province and month, all rows kept."""
    from hearthpanel.operators.joins import outer_merge

    frames = []
    for frame, column in ((buyers, "buyer_superiority"), (trades, "trade_activity"), (leases, "lease_supply")):
        shorts = exact_province("region")
        frames.append(
            frame.select(shorts.alias("province"), F.date_format("date", "yyyy-MM").alias("ym"), F.col("value").alias(column)).filter(
                F.col("province").isNotNull() & (F.col("province") != NATIONWIDE)
            )
        )
    return _with_period(outer_merge(frames, ["province", "ym"]))


# ---- census -----------------------------------------------------------------

# Census response fields, and the columns they become (whole or decimal).
CENSUS_TABLES = {
    "population": {
        "tot_ppltn": ("population", "bigint"),
        "tot_family": ("households", "bigint"),
        "tot_house": ("houses", "bigint"),
        "avg_age": ("mean_age", "double"),
        "aged_child_idx": ("aging_index", "double"),
        "oldage_suprt_per": ("old_age_support", "double"),
        "juv_suprt_per": ("youth_support", "double"),
        "employee_cnt": ("employees", "bigint"),
        "corp_cnt": ("businesses", "bigint"),
        "ppltn_dnsty": ("density", "double"),
    },
    "household": {"household_cnt": ("households", "bigint"), "avg_family_member_cnt": ("household_size", "double")},
    "house": {"house_cnt": ("houses", "bigint")},
}


def curate_census(responses: DataFrame, table: str) -> DataFrame:
    """Census rows per province and year.

    ``responses`` has ``province_code``, ``province``, ``year`` of the request
    and the response text as ``value``.
    """
    fields = CENSUS_TABLES[table]
    schema = "result array<struct<" + ", ".join(f"{f}: string" for f in fields) + ">>"
    rows = responses.select(
        "province_code", "province", "year", F.explode(F.from_json("value", schema)["result"]).alias("r")
    )
    numbers = [
        (clean_amount(F.col(f"r.{f}")) if kind == "bigint" else clean_double(F.col(f"r.{f}"))).alias(name)
        for f, (name, kind) in fields.items()
    ]
    return rows.select("province_code", "province", "year", *numbers)
