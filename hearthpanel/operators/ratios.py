"""Derived ratios of the panel and of the curated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthpanel.functions.numeric import ratio
from hearthpanel.operators.windows import pct_change


def _have(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def with_derived_ratios(panel: DataFrame, *, yearly: bool = True) -> DataFrame:
    """Every ratio whose inputs the panel has; a zero divisor gives null."""
    have = set(panel.columns)
    new = {}
    if {"deposit_only_avg_deposit", "avg_price"} <= have:
        new["deposit_ratio"] = ratio("deposit_only_avg_deposit", "avg_price", 100)
    if {"household_income", "avg_price"} <= have:
        new["pir"] = ratio("avg_price", "household_income")
    if {"pension_per_head", "avg_price"} <= have:
        # Monthly KRW per head to yearly 10k KRW.
        new["pir_pension"] = ratio("avg_price", F.col("pension_per_head") * F.lit(12.0) / F.lit(10000.0))
    if {"deal_count", "population"} <= have:
        new["turnover"] = ratio("deal_count", "population", 1000)
    if {"deposit_only_count", "population"} <= have:
        new["lease_turnover"] = ratio("deposit_only_count", "population", 1000)
    if {"mortgage_balance", "household_income"} <= have:
        # Billion KRW to 10k KRW.
        new["loan_to_income"] = ratio(F.col("mortgage_balance") * F.lit(100000.0), "household_income")
    panel = panel.withColumns(new) if new else panel
    if yearly and "avg_price" in have:
        panel = pct_change(panel, "avg_price", group="province", order_by="year", name="price_yoy")
    return panel


def with_loan_ratios(loans: DataFrame) -> DataFrame:
    """Month-on-month mortgage growth and mortgage share of household loans."""
    out = pct_change(loans, "mortgage_balance", group="province", order_by="ym", name="mortgage_growth")
    if _have(loans, "other_loan_balance"):
        total = F.col("mortgage_balance") + F.col("other_loan_balance")
        out = out.withColumn("mortgage_share", F.when(total > 0, ratio("mortgage_balance", total) * 100))
    return out


def with_balance_sheet_ratios(assets: DataFrame) -> DataFrame:
    """Net worth, unless already given, and debt as a share of income."""
    new = {}
    if _have(assets, "household_assets", "household_debt") and not _have(assets, "net_worth"):
        new["net_worth"] = F.col("household_assets") - F.col("household_debt")
    if _have(assets, "household_debt", "household_income"):
        new["debt_to_income"] = F.when(
            F.col("household_income") > 0, ratio("household_debt", "household_income") * 100
        )
    return assets.withColumns(new) if new else assets


def with_per_head_income(income: DataFrame) -> DataFrame:
    new = {}
    if _have(income, "pay_total", "earners"):
        new["pay_per_head"] = F.when(F.col("earners") > 0, ratio("pay_total", "earners"))
    if _have(income, "tax_total", "taxpayers"):
        new["tax_per_head"] = F.when(F.col("taxpayers") > 0, ratio("tax_total", "taxpayers"))
    return income.withColumns(new) if new else income


def with_net_migration(df: DataFrame) -> DataFrame:
    return df.withColumn("net_moved", F.col("moved_in") - F.col("moved_out"))


def with_non_apartment(df: DataFrame, stages: tuple[str, ...] = ("starts", "completions")) -> DataFrame:
    """Headline counts and the part outside apartment buildings, per building stage."""
    new = {}
    for stage in stages:
        total, flats = f"{stage}_total", f"{stage}_apartment"
        if _have(df, total):
            new[stage] = F.col(total)
        if _have(df, total, flats):
            new[f"{stage}_non_apartment"] = F.col(total) - F.col(flats)
    return df.withColumns(new) if new else df


def with_deposit_gap(panel: DataFrame) -> DataFrame:
    """Price minus lease deposit, and the deposit as a share of a positive price."""
    return panel.withColumn("deposit_gap", F.col("avg_price") - F.col("deposit_only_avg_deposit")).withColumn(
        "gap_deposit_ratio",
        F.when(F.col("avg_price") > 0, ratio("deposit_only_avg_deposit", "avg_price") * 100),
    )


def latest_gauge(df: DataFrame, column: str, *, order_by: str = "ym") -> DataFrame:
    """Last present value of a gauge series."""
    return df.filter(F.col(column).isNotNull()).agg(
        F.max_by(column, order_by).alias(column), F.max(order_by).alias(order_by)
    )
