"""Analysis scope: which measures, regions and years a request looks at."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from hearthpanel.functions.numeric import nan_to_null

KEY_COLUMNS = ("province", "district_code", "year", "month", "ym")


@dataclass(frozen=True)
class AnalysisMode:
    """Result measures of one market side, at district and at province level."""

    district_measures: tuple[str, ...]
    price: str
    volume: str
    unit: str
    rent: str | None = None

    @property
    def results(self) -> list[str]:
        return [m for m in (self.price, self.volume, self.unit, self.rent) if m]


def _lease_mode(kind: str, rent: bool) -> AnalysisMode:
    district = ("avg_deposit", "lease_count", "deposit_unit") + (("avg_rent",) if rent else ())
    return AnalysisMode(
        district, f"{kind}_avg_deposit", f"{kind}_count", f"{kind}_deposit_unit", f"{kind}_avg_rent" if rent else None
    )


MODES = {
    "sale": AnalysisMode(("avg_price", "deal_count", "avg_unit_price"), "avg_price", "deal_count", "avg_unit_price"),
    "deposit_only": _lease_mode("deposit_only", rent=False),
    "monthly_rent": _lease_mode("monthly_rent", rent=True),
    "all_leases": _lease_mode("all_leases", rent=True),
}

# Driver variables offered in every mode, in display order.
COMMON_DRIVERS = [
    "population", "grdp", "permits",
    "pension_subscribers", "pension_per_head", "pension_workplaces", "pension_net_hires",
    "mortgage_balance", "mortgage_growth", "mortgage_share",
    "household_assets", "household_debt", "net_worth", "household_income", "debt_to_income",
    "unsold_mean", "unsold", "conversion_rate", "land_price_change",
    "base_rate", "cd_91d", "bond_3y", "bond_5y", "bond_10y",
    "sale_index", "lease_index",
]


@dataclass(frozen=True)
class AnalysisSpec:
    """One request: mode, time grain, years and regions."""

    mode: str = "sale"
    freq: str = "yearly"
    years: tuple[int, int] | None = None
    provinces: tuple[str, ...] = ()
    districts: tuple[str, ...] = field(default=())


def apply_scope(df: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """Year range and, where the table has districts, the chosen districts.

    Without chosen districts the chosen provinces apply; without either all
    regions stay.
    """
    if spec.years is not None:
        df = df.filter(F.col("year").between(*spec.years))
    if spec.districts and "district_code" in df.columns:
        return df.filter(F.col("district_code").isin(list(spec.districts)))
    if spec.provinces and "province" in df.columns:
        return df.filter(F.col("province").isin(list(spec.provinces)))
    return df


def mode_columns(panel: DataFrame, mode: str) -> tuple[list[str], list[str]]:
    """Result measures and driver variables of a mode that the panel carries."""
    drivers = list(COMMON_DRIVERS)
    if mode == "sale":
        for kind in ("deposit_only", "monthly_rent", "all_leases"):
            drivers += MODES[kind].results
    have = set(panel.columns)
    return [c for c in MODES[mode].results if c in have], [c for c in drivers if c in have]


def select_mode(panel: DataFrame, mode: str) -> DataFrame:
    results, drivers = mode_columns(panel, mode)
    keys = [k for k in KEY_COLUMNS if k in panel.columns]
    return panel.select(*keys, *results, *drivers)


def choose_panel(yearly: DataFrame, monthly: DataFrame | None, spec: AnalysisSpec) -> DataFrame:
    """The monthly panel where asked for and present, else the yearly one."""
    wants_monthly = spec.freq == "monthly" and monthly is not None
    if wants_monthly and not apply_scope(monthly, spec).isEmpty():
        return apply_scope(monthly, spec)
    return apply_scope(yearly, spec)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in KEY_COLUMNS]


def usable_variables(df: DataFrame) -> DataFrame:
    """Numeric variables with at least one value, all counted in one pass."""
    names = numeric_columns(df)
    counts = df.agg(*(F.count(nan_to_null(F.col(c).cast("double"))).alias(c) for c in names))
    return counts.unpivot([], names, "variable", "value_count").filter(F.col("value_count") > 0)


def first_available(df: DataFrame, candidates: list[str], usable: list[str] | None = None) -> str | None:
    """First candidate the table has, and with ``usable`` (the names of ``usable_variables``) one that has a value."""
    return next((c for c in candidates if c in df.columns and (usable is None or c in usable)), None)


def first_usable(df: DataFrame, candidates: list[str]) -> str | None:
    """First candidate column that the table has and that holds a value; one aggregate over the candidates alone."""
    have = [c for c in candidates if c in df.columns]
    if not have:
        return None
    row = df.agg(*(F.count(nan_to_null(F.col(c).cast("double"))).alias(f"n{i}") for i, c in enumerate(have))).first()
    return first_available(df, have, [c for i, c in enumerate(have) if row[i] > 0])


def latest_period(df: DataFrame, column: str = "year") -> DataFrame:
    return df.filter(F.col(column) == df.select(F.max(column)).scalar())


def nearest_year(df: DataFrame, year, column: str = "year") -> DataFrame:
    """Rows of the last year up to ``year``; if all are later, of the last year."""
    target = F.lit(year) if isinstance(year, int) else year
    pick = df.select(F.coalesce(F.max(F.when(F.col(column) <= target, F.col(column))), F.max(column))).scalar()
    return df.filter(F.col(column) == pick)


def december_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("month") == 12)


def prefer_value(df: DataFrame, column: str, preference: list[str], *, keep_all: bool = True) -> DataFrame:
    """Rows of the first preferred dimension value that occurs at all.

    With none present every row stays (``keep_all``) or none does.
    """
    rank = F.lit(None).cast("int")
    for i in reversed(range(len(preference))):
        rank = F.when(F.col(column) == preference[i], F.lit(i)).otherwise(rank)
    best = df.select(F.min(rank)).scalar()
    return df.filter((rank == best) | (best.isNull() & F.lit(keep_all)))


def search_variables(catalogue: DataFrame, text: str | None = None, category: str | None = None) -> DataFrame:
    """Catalogue rows whose name or description contains the text, ignoring case."""
    if text:
        needle = F.lit(text.lower())
        catalogue = catalogue.filter(
            F.lower("label").contains(needle)
            | F.lower("variable").contains(needle)
            | F.lower("description").contains(needle)
        )
    return catalogue.filter(F.col("category") == category) if category else catalogue
