"""The region-period panel.

Sources that are rolled up to the panel key are stacked on top of each other
and aggregated once, so a dozen roll-ups cost one small shuffle instead of one
shuffle and one join each. Series that already carry the panel key are joined,
and a duplicate key in them multiplies rows just like any left join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.functions.numeric import ratio
from hearthpanel.functions.periods import year_month
from hearthpanel.operators.aggregates import FREQ_KEYS
from hearthpanel.operators.joins import join_indicator
from hearthpanel.operators.ratios import with_derived_ratios

LEASE_KINDS = ("deposit_only", "monthly_rent", "all_leases")

# Monthly series summed or averaged into the yearly panel, and their yearly name.
SUMMED = {
    "permits": ["permits"],
    "construction": ["starts", "completions"],
    "land_price": ["land_price_change"],
    "migration": ["moved_in", "moved_out", "net_moved"],
}
AVERAGED = {"unsold": {"unsold": "unsold_mean"}, "conversion": {"conversion_rate": "conversion_rate"}}

YEARLY_SERIES = {
    "population": None,
    "grdp": ["grdp"],
    "assets": ["household_assets", "household_debt", "net_worth", "household_income", "debt_to_income"],
}
# Gauges whose December value stands for the year.
DECEMBER_SERIES = {
    "loans": ["mortgage_balance", "mortgage_growth", "mortgage_share"],
    "price_index": ["sale_index", "lease_index"],
    "market": ["buyer_superiority", "trade_activity", "lease_supply"],
}
NATIONAL_SERIES = ("rates", "sentiment")
PERIOD_COLUMNS = {"province", "year", "month", "ym"}

Measures = Callable[[Callable[[str], Column]], dict[str, Column]]


class _Stack:
    """Sources waiting for the shared aggregate."""

    def __init__(self, keys: list[str]):
        self.keys = keys
        self.frames: list[DataFrame] = []
        self.measures: list[Column] = []

    def add(self, source: str, df: DataFrame, columns: list[str], measures: Measures) -> None:
        def own(name: str) -> Column:
            return F.col(f"{source}__{name}")

        picked = [f"`{c}` AS `{source}__{c}`" for c in columns]
        self.frames.append(df.selectExpr(*self.keys, f"'{source}' AS source", *picked))
        present = F.max(F.col("source") == source)
        self.measures += [F.when(present, value).alias(name) for name, value in measures(own).items()]

    def aggregate(self, *, base: str) -> DataFrame:
        stacked = self.frames[0]
        for frame in self.frames[1:]:
            stacked = stacked.unionByName(frame, allowMissingColumns=True)
        in_base = F.max(F.col("source") == base).alias("_in_base")
        return stacked.dropna(subset=self.keys).groupBy(*self.keys).agg(*self.measures, in_base).filter("_in_base").drop("_in_base")


def _mean_by(value: Column, weight: Column) -> Column:
    return ratio(F.sum(value.cast("double") * weight), F.sum(weight))


def _total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def _sale_measures(c) -> dict[str, Column]:
    return {
        "avg_price": _mean_by(c("avg_price"), c("deal_count")),
        "deal_count": F.sum(c("deal_count")),
        "avg_unit_price": _mean_by(c("avg_unit_price"), c("deal_count")),
    }


def _lease_measures(kind: str, with_rent: bool) -> Measures:
    def build(c) -> dict[str, Column]:
        out = {
            f"{kind}_avg_deposit": _mean_by(c("avg_deposit"), c("lease_count")),
            f"{kind}_count": F.sum(c("lease_count")),
            f"{kind}_deposit_unit": _mean_by(c("deposit_unit"), c("lease_count")),
        }
        if with_rent:
            out[f"{kind}_avg_rent"] = _mean_by(c("avg_rent"), c("lease_count"))
        return out

    return build


def _pension_measures(per_head_from_total: bool) -> Measures:
    def build(c) -> dict[str, Column]:
        heads = _total(c("pension_subscribers"))
        top = (
            _total(c("pension_billed"))
            if per_head_from_total
            else F.sum(F.coalesce(c("pension_per_head"), F.lit(0.0)) * c("pension_subscribers"))
        )
        return {
            "pension_subscribers": heads,
            "pension_per_head": F.when(heads > 0, ratio(top, heads)),
            "pension_workplaces": _total(c("pension_workplaces")),
            "pension_net_hires": _total(c("pension_net_hires")),
        }

    return build


def _income_measures(with_tax: bool) -> Measures:
    def build(c) -> dict[str, Column]:
        earners, pay = _total(c("earners")), _total(c("pay_total"))
        out = {
            "earners": earners,
            "pay_total": pay,
            "pay_per_head": F.when((earners > 0) & (pay > 0), ratio(pay, earners)),
        }
        if with_tax:
            payers = _total(c("taxpayers"))
            out["tax_per_head"] = F.when(payers > 0, ratio(_total(c("tax_total")), payers))
        return out

    return build


def _stack_contracts(stack: _Stack, sources: dict[str, DataFrame]) -> None:
    stack.add("sales", sources["sales"], ["avg_price", "deal_count", "avg_unit_price"], _sale_measures)
    for kind in LEASE_KINDS:
        if kind in sources:
            rent = ["avg_rent"] if "avg_rent" in sources[kind].columns else []
            stack.add(kind, sources[kind], ["avg_deposit", "lease_count", "deposit_unit", *rent], _lease_measures(kind, bool(rent)))
    if "pension" in sources:
        billed = "pension_billed" in sources["pension"].columns
        top = "pension_billed" if billed else "pension_per_head"
        columns = ["pension_subscribers", top, "pension_workplaces", "pension_net_hires"]
        stack.add("pension", sources["pension"], columns, _pension_measures(billed))


def _stack_yearly(stack: _Stack, sources: dict[str, DataFrame]) -> None:
    for source, columns in SUMMED.items():
        if source in sources:
            have = [c for c in columns if c in sources[source].columns]
            stack.add(source, sources[source], have, lambda c, have=have: {n: _total(c(n)) for n in have})
    for source, columns in AVERAGED.items():
        if source in sources:
            stack.add(
                source,
                sources[source],
                list(columns),
                lambda c, columns=columns: {out: F.avg(c(n)) for n, out in columns.items()},
            )


def _stack_income(sources: dict[str, DataFrame]) -> DataFrame:
    """Labour income is yearly at both grains, so it is rolled up on its own key."""
    stack = _Stack(["province", "year"])
    have = sources["income"].columns
    tax = {"taxpayers", "tax_total"} <= set(have)
    stack.add("income", sources["income"], ["earners", "pay_total", *(["taxpayers", "tax_total"] if tax else [])], _income_measures(tax))
    return stack.aggregate(base="income")


def _values(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in PERIOD_COLUMNS]


def build_panel(sources: dict[str, DataFrame], *, freq: str = "yearly") -> DataFrame:
    """Join all available sources into one row per province and period.

    ``sources`` needs ``sales``; every other entry is optional and a missing one
    leaves its columns out.
    """
    yearly = freq == "yearly"
    keys = FREQ_KEYS[freq]
    stack = _Stack(keys)
    _stack_contracts(stack, sources)
    if yearly:
        _stack_yearly(stack, sources)
    panel = stack.aggregate(base="sales")
    if not yearly:
        panel = panel.withColumn("ym", year_month("year", "month"))

    for source, columns in YEARLY_SERIES.items():
        if source in sources:
            panel = join_indicator(panel, sources[source], keys=["province", "year"], columns=columns)
    if "income" in sources:
        panel = join_indicator(panel, _stack_income(sources), keys=["province", "year"])
    if not yearly:
        monthly = {**SUMMED, **{s: list(c) for s, c in AVERAGED.items()}}
        for source, columns in monthly.items():
            if source in sources:
                panel = join_indicator(panel, sources[source], keys=keys, columns=columns)

    for source, columns in DECEMBER_SERIES.items():
        if source in sources:
            series = sources[source].filter(F.col("month") == 12) if yearly else sources[source]
            panel = join_indicator(panel, series, keys=keys, columns=columns)
    for source in NATIONAL_SERIES:
        if source in sources:
            series = sources[source].filter(F.col("month") == 12) if yearly else sources[source]
            panel = join_indicator(panel, series, keys=keys[1:], columns=_values(series))
    if "age_population" in sources:
        panel = join_indicator(
            panel, sources["age_population"], keys=["province", "year"], columns=_values(sources["age_population"]), only_new=True
        )
    return with_derived_ratios(panel, yearly=yearly)
