"""Declared indicator sources: header names, types, and what each loader does."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthpanel.functions.numeric import clean_double
from hearthpanel.functions.regions import NATIONWIDE, short_province
from hearthpanel.sources.csv_files import path_exists, read_csv_any

# Key columns shared by the indicator files.
KEYS = {"지역코드": "district_code", "시도": "province", "연도": "year", "월": "month", "연월": "ym"}
KEY_TYPES = {"district_code": "string", "province": "string", "year": "int", "month": "int", "ym": "string"}


@dataclass(frozen=True)
class SourceSpec:
    """One indicator file.

    ``columns`` maps header names to measures, all read as double unless listed
    in ``texts`` or ``dates``. A file without every ``required`` column is empty.
    """

    name: str
    keys: tuple[str, ...]
    columns: dict[str, str]
    provinces: bool = True
    drop_national: bool = False
    required: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()

    def type_of(self, name: str) -> str:
        if name in KEY_TYPES:
            return KEY_TYPES[name]
        if name in self.dates:
            return "date"
        return "string" if name in self.texts else "double"

    @property
    def ddl(self) -> str:
        return ", ".join(f"`{n}` {self.type_of(n)}" for n in (*self.keys, *self.columns.values()))


_MONTHLY = ("province", "year", "month", "ym")
_NATIONAL = ("year", "month", "ym")

PENSION = SourceSpec(
    "pension",
    ("district_code", *_MONTHLY),
    {
        "NPS_가입자수": "pension_subscribers",
        "NPS_1인당고지금액": "pension_per_head",
        "NPS_고지금액합계": "pension_billed",
        "NPS_사업장수": "pension_workplaces",
        "NPS_고용증감": "pension_net_hires",
    },
    provinces=False,
)
LOANS = SourceSpec(
    "loans",
    _MONTHLY,
    {
        "주담대_잔액": "mortgage_balance",
        "주담대_증감률": "mortgage_growth",
        "주담대_비중": "mortgage_share",
        "기타대출_잔액": "other_loan_balance",
    },
)
_HOUSEHOLD = {
    "가구_자산평균": "household_assets",
    "가구_부채평균": "household_debt",
    "가구_순자산": "net_worth",
    "가구_소득평균": "household_income",
    "DSR": "debt_to_income",
}
ASSETS = SourceSpec("assets", ("province", "year"), _HOUSEHOLD)
QUINTILES = SourceSpec(
    "quintiles",
    ("year",),
    {
        "소득분위": "quintile",
        **_HOUSEHOLD,
        "가구_금융자산": "financial_assets",
        "가구_실물자산": "real_assets",
        "가구_금융부채": "financial_debt",
        "가구_임대보증금": "lease_deposits",
    },
    provinces=False,
    texts=("quintile",),
)
INCOME = SourceSpec(
    "income",
    ("district_code", "province", "year"),
    {
        "시군구": "district_name",
        "총급여_인원": "earners",
        "총급여_금액": "pay_total",
        "결정세액_인원": "taxpayers",
        "결정세액_금액": "tax_total",
        "1인당총급여_백만원": "pay_per_head",
        "1인당결정세액_백만원": "tax_per_head",
    },
    texts=("district_name",),
)
UNSOLD = SourceSpec("unsold", _MONTHLY, {"미분양_호수": "unsold"})
LAND_PRICE = SourceSpec("land_price", _MONTHLY, {"지가변동률": "land_price_change"}, drop_national=True)
MIGRATION = SourceSpec(
    "migration",
    _MONTHLY,
    {"전입": "moved_in", "전출": "moved_out", "순이동": "net_moved"},
    drop_national=True,
    required=("시도", "전입", "전출", "순이동"),
)
RATES = SourceSpec(
    "rates",
    _NATIONAL,
    {"기준금리": "base_rate", "CD_91일": "cd_91d", "국고채_3년": "bond_3y", "국고채_5년": "bond_5y", "국고채_10년": "bond_10y"},
    provinces=False,
)
CONVERSION = SourceSpec("conversion", _MONTHLY, {"전월세전환율": "conversion_rate"})
PRICE_INDEX = SourceSpec(
    "price_index", _MONTHLY, {"아파트매매가격지수": "sale_index", "아파트전세가격지수": "lease_index"}, provinces=False
)
MARKET = SourceSpec(
    "market",
    _MONTHLY,
    {"KB_매수우위지수": "buyer_superiority", "KB_매매거래지수": "trade_activity", "KB_전세수급지수": "lease_supply"},
)
SENTIMENT = SourceSpec("sentiment", _NATIONAL, {"소비자심리지수": "sentiment", "주택가격전망CSI": "price_outlook"}, provinces=False)
CONSTRUCTION = SourceSpec(
    "construction",
    _MONTHLY,
    {
        "착공_호수": "starts",
        "준공_호수": "completions",
        "착공_전체": "starts_total",
        "준공_전체": "completions_total",
        "착공_아파트": "starts_apartment",
        "준공_아파트": "completions_apartment",
        "착공_비아파트": "starts_non_apartment",
        "준공_비아파트": "completions_non_apartment",
    },
    drop_national=True,
)
POLICY_EVENTS = SourceSpec(
    "policy_events",
    (),
    {
        "날짜": "event_date",
        "카테고리": "category",
        "이벤트명": "event_name",
        "방향": "direction",
        "영향지역": "event_region",
        "상세": "detail",
    },
    provinces=False,
    texts=("category", "event_name", "direction", "event_region", "detail"),
    dates=("event_date",),
)
# Regulation histories: some dates have day 00, so they stay text next to a month.
LTV_DTI = SourceSpec(
    "ltv_dti_history",
    (),
    {
        "시행일": "effective",
        "대책명": "measure",
        "투기지역_LTV": "ltv_speculative",
        "투기과열지구_LTV": "ltv_overheated",
        "조정대상지역_LTV": "ltv_adjusted",
        "비규제_LTV": "ltv_free",
        "투기지역_DTI": "dti_speculative",
        "투기과열지구_DTI": "dti_overheated",
        "조정대상지역_DTI": "dti_adjusted",
        "비규제_DTI": "dti_free",
        "비고": "note",
    },
    provinces=False,
    texts=("effective", "measure", "note"),
)
DSR_HISTORY = SourceSpec(
    "dsr_history",
    (),
    {"시행일": "effective", "대책명": "measure", "적용대상": "lenders", "DSR_비율": "dsr_limit", "적용범위": "reach", "비고": "note"},
    provinces=False,
    texts=("effective", "measure", "lenders", "dsr_limit", "reach", "note"),
)
ZONE_HISTORY = SourceSpec(
    "zone_history",
    (),
    {"일자": "effective", "유형": "change", "규제구분": "zone", "대상지역": "areas"},
    provinces=False,
    texts=("effective", "change", "zone", "areas"),
)
POLICY_REGIME = SourceSpec(
    "policy_regime",
    _NATIONAL,
    {
        "정책레짐": "regime",
        "서울_LTV": "ltv_seoul",
        "수도권_LTV": "ltv_capital_area",
        "지방_LTV": "ltv_provinces",
        "DSR_적용": "dsr_applied",
        "DSR_비율": "dsr_limit",
        "설명": "note",
    },
    provinces=False,
    texts=("regime", "dsr_applied", "note"),
)

INDICATOR_SPECS = {
    spec.name: spec
    for spec in (
        LOANS, ASSETS, QUINTILES, INCOME, UNSOLD, LAND_PRICE, MIGRATION, RATES, CONVERSION,
        PRICE_INDEX, MARKET, SENTIMENT, CONSTRUCTION, POLICY_EVENTS, LTV_DTI, DSR_HISTORY, ZONE_HISTORY, POLICY_REGIME,
    )
}
# The migration table once had another loader name, which still works.
ALIASES = {"population_migration": "migration"}


def read_source(spark: SparkSession, spec: SourceSpec, path: str, *, encoding: str | None = None) -> DataFrame:
    """Typed indicator table; a missing file is an empty table of the same shape.

    Columns missing from the file are left out of the result.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], spec.ddl)
    raw = read_csv_any(spark, path, encoding=encoding)
    if not set(spec.required) <= set(raw.columns):
        return spark.createDataFrame([], spec.ddl)
    picked = []
    for header, name in {**KEYS, **spec.columns}.items():
        if header not in raw.columns or (header in KEYS and name not in spec.keys):
            continue
        column, kind = F.col(f"`{header}`"), spec.type_of(name)
        if kind == "double":
            value = clean_double(column)
        elif kind == "int":
            value = clean_double(column).cast("int")
        elif kind == "date":
            value = F.to_date(F.try_to_timestamp(column))
        else:
            value = column
        picked.append(value.alias(name))
    df = raw.select(*picked)
    if spec.provinces and "province" in df.columns:
        df = df.withColumn("province", short_province("province"))
    if spec.drop_national and "province" in df.columns:
        df = df.filter(F.col("province") != NATIONWIDE)
    if "effective" in spec.columns.values() and "effective" in df.columns:
        df = df.withColumn("effective_month", F.substring("effective", 1, 7))
    return df


def read_indicator(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    return read_source(spark, INDICATOR_SPECS[ALIASES.get(name, name)], path, **options)
