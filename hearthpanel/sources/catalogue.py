"""Catalogue of panel variables: label, unit, yearly rule, range, category, source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthpanel.operators.aggregates import YEARLY_RULES

_COLUMNS = "variable string, label string, unit string, yearly_rule string, low double, high double, category string, source string, description string"

_SIDES = {
    "deposit_only": "Deposit lease",
    "monthly_rent": "Monthly rent",
    "all_leases": "All leases",
}


def _rule(variable: str, default: str) -> str:
    return YEARLY_RULES.get(variable, default)


def catalogue_rows() -> list[tuple]:
    """One row per variable; families of variables are generated from their parts."""
    rows = []

    def add(category, source, unit, low, high, default_rule, **variables):
        for variable, (label, text) in variables.items():
            rows.append((variable, label, unit, _rule(variable, default_rule), low, high, category, source, text))

    deals = "contracts"
    add("result/sale", deals, "10k KRW", None, None, "weighted by deal_count", avg_price=("Sale price", "mean sale price"))
    add("result/sale", deals, "deals", 0.0, None, "sum", deal_count=("Sale deals", "number of sales, market activity"))
    add("result/sale", deals, "10k KRW/m2", None, None, "weighted by deal_count", avg_unit_price=("Sale unit price", "price per square metre"))
    for kind, label in _SIDES.items():
        weight = f"weighted by {kind}_count"
        add(f"result/{kind}", deals, "10k KRW", None, None, weight, **{f"{kind}_avg_deposit": (f"{label} deposit", "mean deposit")})
        add(f"result/{kind}", deals, "deals", 0.0, None, "sum", **{f"{kind}_count": (f"{label} deals", "number of leases")})
        add(f"result/{kind}", deals, "10k KRW/m2", None, None, weight, **{f"{kind}_deposit_unit": (f"{label} unit deposit", "deposit per square metre")})
        if kind != "deposit_only":
            add(f"result/{kind}", deals, "10k KRW", None, None, weight, **{f"{kind}_avg_rent": (f"{label} rent", "mean monthly rent")})
    add(
        "demand/population", "statistics office", "people", None, None, "last",
        population=("Population", "registered people"),
        population_male=("Men", ""),
        population_female=("Women", ""),
        **{
            f"{sex}age_{decade}": (f"{decade.replace('_', ' ')} {word}".strip(), "")
            for decade in ("20s", "30s", "40s", "50_up")
            for sex, word in (("", ""), ("male_", "men"), ("female_", "women"))
        },
    )
    add("demand/migration", "statistics office", "people", 0.0, None, "sum", moved_in=("Moved in", "arrivals"), moved_out=("Moved out", "departures"))
    add("demand/migration", "statistics office", "people", None, None, "sum", net_moved=("Net migration", "arrivals less departures"))
    add("supply", "statistics office", "million KRW", None, None, "last", grdp=("Regional product", "size of the regional economy"))
    add(
        "supply", "statistics office", "homes", 0.0, None, "sum",
        permits=("Apartment permits", "permits, supply two to three years ahead"),
        starts=("Building starts", "homes begun"),
        completions=("Completions", "homes finished"),
        unsold=("Unsold homes", "stock of unsold new homes"),
        unsold_mean=("Unsold homes, mean", "yearly mean of the unsold stock"),
    )
    add("demand/income", "pension service", "people", 0.0, None, "sum", pension_subscribers=("Pension subscribers", "insured employees"))
    add("demand/income", "pension service", "KRW", None, None, "weighted by pension_subscribers", pension_per_head=("Pension bill per head", "monthly contribution, a proxy of income"))
    add("demand/income", "pension service", "places", 0.0, None, "sum", pension_workplaces=("Workplaces", "insured workplaces"))
    add("demand/income", "pension service", "people", None, None, "sum", pension_net_hires=("Net hires", "hired less left"))
    add("demand/credit", "central bank", "billion KRW", None, None, "december", mortgage_balance=("Mortgage balance", "outstanding mortgages"))
    add("demand/credit", "central bank", "%", None, None, "december", mortgage_growth=("Mortgage growth", "against the month before"))
    add("demand/credit", "central bank", "%", 0.0, 100.0, "december", mortgage_share=("Mortgage share", "of household loans"))
    add(
        "demand/assets", "household survey", "10k KRW", None, None, "yearly",
        household_assets=("Household assets", "mean total assets"),
        household_debt=("Household debt", "mean total debt"),
        net_worth=("Net worth", "assets less debt"),
        household_income=("Household income", "mean yearly income"),
    )
    add("demand/assets", "household survey", "%", None, None, "yearly", debt_to_income=("Debt to income", "debt as percent of income"))
    add("demand/income", "tax office", "people", 0.0, None, "yearly sum", earners=("Earners", "people with declared pay"))
    add("demand/income", "tax office", "million KRW", 0.0, None, "yearly sum", pay_total=("Total pay", "declared pay"))
    add(
        "demand/income", "tax office", "million KRW", None, None, "yearly",
        pay_per_head=("Pay per head", "total pay over earners"),
        tax_per_head=("Tax per head", "tax over taxpayers"),
    )
    add(
        "sentiment", "market survey", "index", 0.0, 200.0, "december",
        buyer_superiority=("Buyer superiority", "buyers against sellers"),
        trade_activity=("Trade activity", "above 100 is lively"),
        lease_supply=("Lease supply", "above 100 is short supply"),
    )
    add("sentiment", "central bank", "index", 0.0, 200.0, "december", sentiment=("Consumer sentiment", ""), price_outlook=("Price outlook", "expected home prices"))
    add(
        "sentiment", "central bank", "%", None, None, "december",
        base_rate=("Base rate", ""), cd_91d=("CD 91 days", ""), bond_3y=("Bond 3 years", ""), bond_5y=("Bond 5 years", ""),
        bond_10y=("Bond 10 years", ""), conversion_rate=("Conversion rate", "deposit to rent"), land_price_change=("Land price change", ""),
    )
    add("sentiment", "central bank", "index", None, None, "december", sale_index=("Sale price index", ""), lease_index=("Lease price index", ""))
    add("derived", "derived", "%", 40.0, 80.0, "computed", deposit_ratio=("Deposit ratio", "lease deposit as percent of price"))
    add("derived", "derived", "times", None, None, "computed", pir=("Price to income", ""), pir_pension=("Price to pension income", ""), loan_to_income=("Loan to income", ""))
    add("derived", "derived", "per thousand", None, None, "computed", turnover=("Sale turnover", "sales per thousand people"), lease_turnover=("Lease turnover", "deposit leases per thousand people"))
    add("derived", "derived", "%", None, None, "computed", price_yoy=("Price change", "against the year before"))
    return rows


def variable_catalogue(spark: SparkSession) -> DataFrame:
    """The catalogue with the source in brackets after each description."""
    tagged = F.trim(F.concat("description", F.lit(" ["), "source", F.lit("]")))
    return spark.createDataFrame(catalogue_rows(), _COLUMNS).withColumn("description", tagged)


def range_violations(panel: DataFrame) -> DataFrame:
    """Count of panel values outside their normal range, one row per variable."""
    limits = {v: (low, high) for v, _, _, _, low, high, *_ in catalogue_rows() if (low, high) != (None, None) and v in panel.columns}

    def outside(name: str):
        low, high = limits[name]
        bad = F.lit(False)
        bad = bad | (F.col(name) < low) if low is not None else bad
        return bad | (F.col(name) > high) if high is not None else bad

    counts = panel.agg(*(F.sum(F.coalesce(outside(v), F.lit(False)).cast("bigint")).alias(v) for v in limits))
    return counts.unpivot([], list(limits), "variable", "violations")
