"""Curated series from landed responses: one query per curator, over responses that the contracts are wrapped in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthpanel.functions.regions import lookup
from hearthpanel.sources import landed
from workloads import tables as t
from workloads.registry import query

# Names under which the regions of the test tables appear in responses.
FULL = {"AFRICA": "서울특별시", "AMERICA": "부산광역시", "ASIA": "경기도", "EUROPE": "강원도", "MIDDLE EAST": "제주특별자치도"}
SHORT = {"AFRICA": "서울", "AMERICA": "부산", "ASIA": "경기", "EUROPE": "강원", "MIDDLE EAST": "제주"}
SURVEY = {"AFRICA": "11", "AMERICA": "21", "ASIA": "31", "EUROPE": "32", "MIDDLE EAST": "39"}

_SHORT_SQL = "CASE province " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SHORT.items()) + " END"
NAMED = (
    t.LEASES
    + f""",
named AS (
  SELECT CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS ym, year, month, {_SHORT_SQL} AS province,
         o_orderkey AS k, deposit FROM leases)"""
)


def _key() -> Column:
    return F.col("o_orderkey")


def _named(spark, sf):
    leases = t.leases(spark, sf)
    return leases.withColumns({"full": lookup(FULL, "province"), "short": lookup(SHORT, "province"), "code": lookup(SURVEY, "province")})


def _choose(*values: Column | str) -> Column:
    """The values in turn, by the remainder of the key."""
    out = F.lit(values[-1]) if isinstance(values[-1], str) else values[-1]
    for i in reversed(range(len(values) - 1)):
        out = F.when(_key() % len(values) == i, F.lit(values[i]) if isinstance(values[i], str) else values[i]).otherwise(out)
    return out


def _bank(spark, sf, *items: Column | str, series: Column | None = None):
    """Every contract as a central-bank response of one row."""
    texts = [F.lit(i) if isinstance(i, str) else i for i in items]
    row = F.struct(
        F.format_string("%d%02d", "year", "month").alias("TIME"),
        F.format_number("deposit", 0).alias("DATA_VALUE"),
        *(text.alias(f"ITEM_NAME{i}") for i, text in enumerate(texts, 1)),
    )
    text = F.to_json(F.struct(F.struct(F.array(row).alias("row")).alias("StatisticSearch")))
    name = F.lit(None).cast("string") if series is None else series
    responses = _named(spark, sf).select("o_orderkey", name.alias("name"), text.alias("value"))
    parsed = responses.select("o_orderkey", "name", F.from_json("value", landed.BANK_SCHEMA)["StatisticSearch"].alias("StatisticSearch"))
    return landed.bank_rows(parsed, series=F.col("name"), seq=_key())


@query(
    "loan_series",
    f"""WITH {NAMED},
w AS (SELECT ym, CASE WHEN k % 7 = 0 THEN '전국' ELSE province END AS province, year, month,
  CAST(min_by(deposit, k) FILTER (k % 2 = 0) AS DOUBLE) AS mortgage_balance, CAST(min_by(deposit, k) FILTER (k % 2 = 1) AS DOUBLE) AS other_loan_balance
  FROM named GROUP BY ALL),
f AS (SELECT *, last_value(mortgage_balance IGNORE NULLS) OVER (PARTITION BY province ORDER BY ym) AS filled FROM w),
g AS (SELECT *, lag(filled) OVER (PARTITION BY province ORDER BY ym) AS before FROM f)
SELECT ym, province, year, month, mortgage_balance, other_loan_balance, round((filled / before - 1) * 100, 6) AS mortgage_growth,
  round(mortgage_balance / (mortgage_balance + other_loan_balance) * 100, 6) AS mortgage_share
FROM g WHERE province <> '전국'""",
)
def loan_series(spark, sf):
    region = F.when(_key() % 7 == 0, "전국").otherwise(F.col("short"))
    third = _key() % 3 == 0
    rows = _bank(
        spark, sf, "가계대출", F.when(third, "예금은행").otherwise(region), F.when(third, region).otherwise(""),
        series=_choose("mortgage_balance", "other_loan_balance"),
    )
    out = landed.curate_loans(rows)
    return out.withColumns({c: F.round(c, 6) for c in ("mortgage_growth", "mortgage_share")})


@query(
    "index_series",
    f"""WITH {NAMED}
SELECT ym, province, year, month, CAST(min_by(deposit, k) FILTER (k % 2 = 0) AS DOUBLE) AS sale_index,
  CAST(min_by(deposit, k) FILTER (k % 2 = 1) AS DOUBLE) AS lease_index FROM named GROUP BY ym, province, year, month""",
)
def index_series(spark, sf):
    return landed.curate_price_index(_bank(spark, sf, F.col("full"), series=_choose("sale_index", "lease_index")))


@query(
    "index_of_home_types",
    f"""WITH {NAMED}
SELECT ym, CASE k % 3 WHEN 0 THEN '전국' ELSE '서울' END AS province, year, month,
  CAST(min_by(deposit, k) AS DOUBLE) AS sale_index, CAST(NULL AS DOUBLE) AS lease_index
FROM named WHERE k % 3 <> 2 GROUP BY ym, province, year, month, k % 3""".replace("GROUP BY ym, province,", "GROUP BY ym,"),
)
def index_of_home_types(spark, sf):
    """Tables without regions: apartments stand for the nation, apartments in the capital for the capital."""
    return landed.curate_price_index(_bank(spark, sf, _choose("아파트", "아파트(서울)", "단독주택"), series=F.lit("sale_index")))


@query(
    "migration_series",
    f"""WITH {NAMED}, w AS (
SELECT ym, province, year, month, CAST(min_by(deposit, k) FILTER (k % 3 = 0) AS DOUBLE) AS moved_in,
  CAST(min_by(deposit, k) FILTER (k % 3 = 1) AS DOUBLE) AS moved_out FROM named WHERE k % 3 < 2 GROUP BY ym, province, year, month)
SELECT *, moved_in - moved_out AS net_moved FROM w""",
)
def migration_series(spark, sf):
    return landed.curate_migration(_bank(spark, sf, F.col("full"), _choose("총전입", "총전출", "순이동")))


@query(
    "land_price_series",
    f"WITH {NAMED} SELECT ym, province, year, month, CAST(deposit AS DOUBLE) AS land_price_change FROM named WHERE k % 2 = 1",
)
def land_price_series(spark, sf):
    return landed.curate_land_price(_bank(spark, sf, F.col("full"), _choose("주거", "전체")))


@query(
    "conversion_series",
    f"WITH {NAMED} SELECT ym, province, year, month, CAST(deposit AS DOUBLE) AS conversion_rate FROM named WHERE k % 3 = 0",
)
def conversion_series(spark, sf):
    """Apartments of the provinces; other homes and the nation's rows go."""
    rows = _bank(spark, sf, _choose("아파트", "단독주택", "아파트"), F.when(_key() % 3 == 2, "전국").otherwise(F.col("short")))
    return landed.curate_conversion(rows)


@query(
    "construction_series",
    f"""WITH {NAMED}
SELECT ym, province, year, month, CAST(sum(deposit) FILTER (k % 3 = 0) AS DOUBLE) AS starts,
  CAST(sum(deposit) FILTER (k % 3 = 1) AS DOUBLE) AS completions FROM named WHERE k % 3 < 2 GROUP BY ym, province, year, month""",
)
def construction_series(spark, sf):
    """Region and stage in either order; rows without a stage go where others have one."""
    rows = _bank(spark, sf, _choose(F.col("short"), F.lit("준공실적"), F.col("short")), _choose(F.lit("착공실적"), F.col("full"), F.lit("기타")))
    return landed.curate_bank_construction(rows)


# ---- statistics-office lists ------------------------------------------------


def _list(spark, sf, **fields: Column | str):
    """Every contract as one row of a list-shaped response."""
    given = {name: F.lit(v) if isinstance(v, str) else v for name, v in fields.items()}
    period = F.format_string("%d%02d", "year", "month")
    shaped = {"PRD_DE": period, "DT": F.format_number("deposit", 0), **given}
    raw = _named(spark, sf).select(
        *(shaped.get(name, F.lit(None)).cast("string").alias(name) for name in landed.LIST_FIELDS), "o_orderkey"
    )
    return landed.list_rows(raw, seq=_key())


@query(
    "household_series",
    f"""WITH {NAMED}, w AS (
SELECT province, year, CAST(min_by(deposit, k) FILTER (k % 3 = 0) AS DOUBLE) AS household_assets,
  CAST(min_by(deposit, k) FILTER (k % 3 = 1) AS DOUBLE) AS household_debt, CAST(min_by(deposit, k) FILTER (k % 3 = 2) AS DOUBLE) AS household_income
FROM named WHERE k % 4 <> 0 AND k % 5 <> 0 GROUP BY province, year)
SELECT *, household_assets - household_debt AS net_worth,
  round(CASE WHEN household_income > 0 THEN household_debt / household_income * 100 END, 6) AS debt_to_income FROM w""",
)
def household_series(spark, sf):
    """Balance sheets of all households, average items; rows by sex and medians go."""
    rows = _list(
        spark, sf,
        C1_NM=F.col("full"),
        C2_NM=F.when(_key() % 4 == 0, "남자").otherwise("전체"),
        C3_NM=_choose("자산", "부채", "경상소득(전년도)"),
        ITM_NM=F.when(_key() % 5 == 0, "중앙값").otherwise("전가구 평균"),
    )
    return landed.curate_household_assets(rows).withColumn("debt_to_income", F.round("debt_to_income", 6))


@query(
    "household_item_list",
    f"""WITH {NAMED} SELECT province, year, '항목 ' || CAST(k % 40 AS VARCHAR) AS item, CAST(min_by(deposit, k) AS DOUBLE) AS value
FROM named GROUP BY ALL""",
)
def household_item_list(spark, sf):
    return landed.household_items(_list(spark, sf, C1_NM=F.col("full"), C3_NM=F.concat(F.lit(" 항목 "), (_key() % 40).cast("string"))))


@query(
    "quintile_series",
    f"""WITH {NAMED}, w AS (
SELECT CAST(1 + k % 5 AS VARCHAR) || '분위' AS quintile, year,
  CAST(min_by(deposit, k) FILTER (k % 4 = 0) AS DOUBLE) AS household_assets, CAST(min_by(deposit, k) FILTER (k % 4 = 1) AS DOUBLE) AS household_debt,
  CAST(min_by(deposit, k) FILTER (k % 4 = 2) AS DOUBLE) AS household_income, CAST(min_by(deposit, k) FILTER (k % 4 = 3) AS DOUBLE) AS financial_assets
FROM named WHERE k % 3 <> 0 GROUP BY ALL)
SELECT quintile, year, household_assets, household_debt, household_income, financial_assets, household_assets - household_debt AS net_worth,
  round(CASE WHEN household_income > 0 THEN household_debt / household_income * 100 END, 6) AS debt_to_income FROM w""",
)
def quintile_series(spark, sf):
    rows = _list(
        spark, sf,
        C1_NM="전체",
        C2_NM=F.concat(F.lit(" "), (_key() % 5 + 1).cast("string"), F.lit("분위 ")),
        C3_NM=_choose("자산", "부채", "경상소득(전년도)", "금융자산"),
        ITM_NM=F.when(_key() % 3 == 0, "중앙값").otherwise("평균"),
    )
    out = landed.curate_quintiles(rows).withColumn("debt_to_income", F.round("debt_to_income", 6))
    return out.drop("real_assets", "financial_debt", "lease_deposits")


@query(
    "income_of_provinces",
    f"""WITH {NAMED}, w AS (
SELECT province, year, CAST(min_by(deposit, k) FILTER (k % 2 = 0) AS DOUBLE) AS earners, CAST(min_by(deposit, k) FILTER (k % 2 = 1) AS DOUBLE) AS pay_total
FROM named GROUP BY province, year)
SELECT province, year, earners, pay_total, round(pay_total / earners, 6) AS pay_per_head FROM w""",
)
def income_of_provinces(spark, sf):
    codes = {"AFRICA": "A01", "AMERICA": "A14", "ASIA": "A03", "EUROPE": "A04", "MIDDLE EAST": "A17"}
    rows = _list(spark, sf, C1=lookup(codes, "province"), C1_NM=F.col("full"), C2="B02", ITM_ID=_choose("T001", "T002"))
    out = landed.curate_income(rows, level="province")
    return out.select("province", "year", "earners", "pay_total", F.round("pay_per_head", 6).alias("pay_per_head"))


_AGES = "CAST(k % 22 * 5 AS VARCHAR)"


@query(
    "age_survey",
    f"""WITH {NAMED}
SELECT province, year, CAST(sum(deposit) FILTER (k % 22 = 0 AND k % 3 = 0) AS BIGINT) AS population,
  CAST(sum(deposit) FILTER ({_AGES} IN ('25', '30') AND k % 3 = 1) AS BIGINT) AS male_age_20s,
  CAST(sum(deposit) FILTER ({_AGES} IN ('45', '50') AND k % 3 = 2) AS BIGINT) AS female_age_40s
FROM named GROUP BY province, year""",
)
def age_survey(spark, sf):
    rows = _list(spark, sf, C1=F.col("code"), C2=(_key() % 22 * 5).cast("string"), ITM_ID=_choose("T2", "T3", "T4"))
    return landed.curate_age_population(rows).select("province", "year", "population", "male_age_20s", "female_age_40s")


@query(
    "construction_list",
    f"""WITH {NAMED}, w AS (
SELECT ym, province, year, month, CAST(sum(v) FILTER (k % 4 = 0) AS DOUBLE) AS starts_total, CAST(sum(v) FILTER (k % 4 = 1) AS DOUBLE) AS starts_apartment,
  CAST(sum(v) FILTER (k % 4 = 2) AS DOUBLE) AS completions_total, CAST(sum(v) FILTER (k % 4 = 3) AS DOUBLE) AS completions_apartment
FROM (SELECT *, CASE WHEN k % 7 = 0 THEN 0 ELSE deposit END AS v FROM named) GROUP BY ym, province, year, month)
SELECT *, starts_total AS starts, completions_total AS completions, starts_total - starts_apartment AS starts_non_apartment,
  completions_total - completions_apartment AS completions_non_apartment FROM w""",
)
def construction_list(spark, sf):
    """Homes by stage and kind; a dash counts nothing."""
    rows = _list(spark, sf, C1_NM=F.col("full"), DT=F.when(_key() % 7 == 0, "-").otherwise(F.format_number("deposit", 0)))
    staged = rows.withColumns({"stage": F.when(_key() % 4 < 2, "starts").otherwise("completions"), "kind": _choose("total", "apartment")})
    return landed.curate_construction(staged)


@query(
    "market_survey",
    f"""WITH {NAMED}, d AS (SELECT ym, province, year, month, k % 3 AS part, CAST(min_by(deposit, k) AS DOUBLE) AS value FROM named GROUP BY ALL)
SELECT ym, province, year, month, max(value) FILTER (part = 0) AS buyer_superiority, max(value) FILTER (part = 1) AS trade_activity,
  max(value) FILTER (part = 2) AS lease_supply FROM d GROUP BY ym, province, year, month""",
)
def market_survey(spark, sf):
    date = F.make_date("year", "month", F.lit(15))
    first = F.min_by("deposit", "o_orderkey").cast("double").alias("value")
    rows = _named(spark, sf).withColumn("part", _key() % 3).groupBy(F.col("full").alias("region"), date.alias("date"), "part").agg(first)
    return landed.curate_market(*(rows.filter(F.col("part") == i).drop("part") for i in range(3)))


# ---- census and month files -------------------------------------------------


@query(
    "census_rows",
    f"""WITH {NAMED}
SELECT k, province, year, deposit AS households, round(CAST(deposit AS DOUBLE) / 8, 3) AS household_size FROM named WHERE k % 9 <> 0""",
)
def census_rows(spark, sf):
    """Responses of one row each, and every ninth without a result."""
    row = F.struct(F.format_number("deposit", 0).alias("household_cnt"), (F.col("deposit") / 8).cast("string").alias("avg_family_member_cnt"))
    text = F.when(_key() % 9 == 0, '{"errCd": -100}').otherwise(F.to_json(F.struct(F.array(row).alias("result"))))
    responses = _named(spark, sf).select(
        F.concat_ws("/", "code", "o_orderkey").alias("province_code"), F.col("short").alias("province"), "year", text.alias("value")
    )
    rows = landed.curate_census(responses, "household")
    key = F.split("province_code", "/")[1].cast("bigint").alias("k")
    return rows.select(key, "province", "year", "households", F.round("household_size", 3).alias("household_size"))


def _month_items(spark, sf, tags: dict[str, Column]):
    """Every contract as an XML response of one item; every eleventh response is an error."""
    parts = [part for tag, text in tags.items() for part in (F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))]
    code = F.when(_key() % 11 == 0, "99").otherwise("00")
    body = F.concat(
        F.lit("<response><header><resultCode>"), code, F.lit("</resultCode></header><body><items><item>"), *parts, F.lit("</item></items></body></response>")
    )
    stage = _choose("starts", "completions").alias("stage")
    responses = _named(spark, sf).select(F.format_string("%d-%02d", "year", "month").alias("ym"), stage, body.alias("value"))
    return landed.xml_rows(landed.with_result_code(responses), list(tags), keep=["ym", "stage"])


@query(
    "unsold_months",
    f"""WITH {NAMED} SELECT ym, province, year, month, CAST(sum(CASE WHEN k % 5 = 0 THEN 0 ELSE deposit END) AS BIGINT) AS unsold
FROM named WHERE k % 11 <> 0 GROUP BY ym, province, year, month""",
)
def unsold_months(spark, sf):
    items = _month_items(spark, sf, {"ctprvnNm": F.col("full"), "unslQy": F.when(_key() % 5 == 0, "x").otherwise(F.format_number("deposit", 0))})
    return landed.curate_unsold(items)


@query(
    "building_months",
    f"""WITH {NAMED}
SELECT ym, province, year, month, CAST(sum(deposit) FILTER (k % 2 = 0) AS BIGINT) AS starts, CAST(sum(deposit) FILTER (k % 2 = 1) AS BIGINT) AS completions
FROM named WHERE k % 11 <> 0 GROUP BY ym, province, year, month""",
)
def building_months(spark, sf):
    """The first of three count tags that has text."""
    count = F.format_number("deposit", 0)
    tags = {"hseCnt": _choose(count, F.lit(" "), F.lit("")), "hoCnt": _choose(F.lit("7"), count, F.lit("")), "totHoCnt": _choose(F.lit(""), F.lit("9"), count)}
    return landed.curate_building_counts(_month_items(spark, sf, {"ctprvnNm": F.col("full"), **tags}))
