"""Province roll-ups, yearly down-sampling and summary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.functions.numeric import ratio
from hearthpanel.functions.periods import year_month

FREQ_KEYS = {"yearly": ["province", "year"], "monthly": ["province", "year", "month"]}


def _keyed(df: DataFrame, freq: str) -> tuple[DataFrame, list[str]]:
    keys = FREQ_KEYS[freq]
    return df.dropna(subset=keys), keys


def _finish(df: DataFrame, freq: str) -> DataFrame:
    return df.withColumn("ym", year_month("year", "month")) if freq == "monthly" else df


def weighted_mean(value: str, weight: str) -> Column:
    """Mean of ``value`` weighted by ``weight``."""
    return ratio(F.sum(F.col(value).cast("double") * F.col(weight)), F.sum(weight))


def null_sum(value: str) -> Column:
    """Sum that is zero, not null, when every value is missing."""
    return F.coalesce(F.sum(value), F.lit(0))


def province_sales(rollup: DataFrame, *, freq: str = "yearly") -> DataFrame:
    df, keys = _keyed(rollup, freq)
    out = df.groupBy(*keys).agg(
        weighted_mean("avg_price", "deal_count").alias("avg_price"),
        F.sum("deal_count").alias("deal_count"),
        weighted_mean("avg_unit_price", "deal_count").alias("avg_unit_price"),
    )
    return _finish(out, freq)


def province_leases(rollup: DataFrame, *, freq: str = "yearly") -> DataFrame:
    df, keys = _keyed(rollup, freq)
    measures = [
        weighted_mean("avg_deposit", "lease_count").alias("avg_deposit"),
        F.sum("lease_count").alias("lease_count"),
        weighted_mean("deposit_unit", "lease_count").alias("deposit_unit"),
    ]
    if "avg_rent" in df.columns:
        measures.append(weighted_mean("avg_rent", "lease_count").alias("avg_rent"))
    return _finish(df.groupBy(*keys).agg(*measures), freq)


def province_pension(pension: DataFrame, *, freq: str = "yearly") -> DataFrame:
    """Summed subscribers, workplaces and employment change; amount per head.

    The per-head amount is total billed over subscribers. Without a billed
    column it is the subscriber-weighted mean, a missing amount counting as 0.
    """
    df, keys = _keyed(pension, freq)
    if "pension_billed" in df.columns:
        top = null_sum("pension_billed")
    elif "pension_per_head" in df.columns:
        top = F.sum(F.coalesce("pension_per_head", F.lit(0.0)) * F.col("pension_subscribers"))
    else:
        top = F.lit(None).cast("double")
    heads = null_sum("pension_subscribers")
    out = df.groupBy(*keys).agg(
        heads.alias("pension_subscribers"),
        null_sum("pension_workplaces").alias("pension_workplaces"),
        null_sum("pension_net_hires").alias("pension_net_hires"),
        F.when(heads > 0, ratio(top, heads)).alias("pension_per_head"),
    )
    return _finish(out, freq)


def province_income(income: DataFrame) -> DataFrame:
    """Labour income per province and year from district rows."""
    df, keys = _keyed(income, "yearly")
    earners, pay = null_sum("earners"), null_sum("pay_total")
    measures = [
        earners.alias("earners"),
        pay.alias("pay_total"),
        F.when((earners > 0) & (pay > 0), ratio(pay, earners)).alias("pay_per_head"),
    ]
    if {"taxpayers", "tax_total"} <= set(df.columns):
        payers = null_sum("taxpayers")
        measures.append(F.when(payers > 0, ratio(null_sum("tax_total"), payers)).alias("tax_per_head"))
    return df.groupBy(*keys).agg(*measures)


# How a monthly series becomes a yearly one.
YEARLY_RULES = {
    "permits": "sum",
    "unsold": "mean",
    "starts": "sum",
    "completions": "sum",
    "land_price_change": "sum",
    "moved_in": "sum",
    "moved_out": "sum",
    "net_moved": "sum",
    "conversion_rate": "mean",
    "mortgage_balance": "december",
    "mortgage_growth": "december",
    "mortgage_share": "december",
    "base_rate": "december",
    "cd_91d": "december",
    "bond_3y": "december",
    "bond_5y": "december",
    "bond_10y": "december",
    "sale_index": "december",
    "lease_index": "december",
    "sentiment": "december",
    "price_outlook": "december",
    "buyer_superiority": "december",
    "trade_activity": "december",
    "lease_supply": "december",
}


def downsample(df: DataFrame, rules: dict[str, str], *, keys: list[str] | None = None) -> DataFrame:
    """Yearly values of a monthly series by ``sum``, ``mean`` or ``december``.

    ``december`` keeps the December value, and when no rule needs another month
    the December filter runs before the aggregate, down at the scan.
    """
    keys = keys or ["province", "year"]
    df = df.dropna(subset=keys)
    december_only = all(rule == "december" for rule in rules.values())
    if december_only:
        df = df.filter(F.col("month") == 12)
    measures = []
    for name, rule in rules.items():
        if rule == "sum":
            measures.append(null_sum(name).alias(name))
        elif rule == "mean":
            measures.append(F.avg(name).alias(name))
        elif rule == "december":
            measures.append(F.max(F.when(F.col("month") == 12, F.col(name))).alias(name))
        else:
            raise ValueError(f"unknown rule {rule!r} for {name}")
    return df.groupBy(*keys).agg(*measures)


def december_rows(df: DataFrame, columns: list[str], *, keys: list[str] | None = None) -> DataFrame:
    """December rows as the yearly stock value, duplicates kept as they are."""
    return df.filter(F.col("month") == 12).select(*(keys or ["province", "year"]), *columns)


MEASURE_AGGREGATES = {
    "avg_price": F.avg,
    "deal_count": F.sum,
    "avg_unit_price": F.avg,
    "avg_deposit": F.avg,
    "lease_count": F.sum,
    "deposit_unit": F.avg,
    "avg_rent": F.avg,
}


def district_series(rollup: DataFrame, *, period: str = "year", measures: list[str] | None = None) -> DataFrame:
    """District time series: prices averaged, counts added."""
    period = period if period in rollup.columns else "year"
    keys = [c for c in ("province", "district_code") if c in rollup.columns] + [period]
    names = measures or [m for m in MEASURE_AGGREGATES if m in rollup.columns]
    return (
        rollup.dropna(subset=keys)
        .groupBy(*keys)
        .agg(*(MEASURE_AGGREGATES[m](m).alias(m) for m in names))
    )


def national_trend(panel: DataFrame, *, period: str = "year", means: list[str] = (), sums: list[str] = ()) -> DataFrame:
    return (
        panel.dropna(subset=[period])
        .groupBy(period)
        .agg(*(F.avg(c).alias(c) for c in means), *(null_sum(c).alias(c) for c in sums))
    )


def province_series(panel: DataFrame, columns: list[str], *, period: str | None = "year") -> DataFrame:
    keys = ["province"] + ([period] if period else [])
    return panel.dropna(subset=keys).groupBy(*keys).agg(*(F.avg(c).alias(c) for c in columns))


def district_summary(rollup: DataFrame) -> DataFrame:
    """One row per district over all its months.

    A code filed under more than one province shows the first one by name.
    """
    return (
        rollup.dropna(subset=["district_code"])
        .groupBy("district_code")
        .agg(
            F.min("province").alias("province"),
            F.avg("avg_price").alias("avg_price"),
            F.sum("deal_count").alias("deal_count"),
            F.avg("avg_unit_price").alias("avg_unit_price"),
        )
    )


def headline_kpis(rollup: DataFrame, panel: DataFrame | None = None) -> DataFrame:
    """Latest and previous year in one row: price, volume, deposit ratio, changes."""
    latest = rollup.select(F.max("year")).scalar()
    dated = rollup.withColumn("_latest", latest).filter(F.col("year") >= F.col("_latest") - 1)
    now, before = F.col("year") == F.col("_latest"), F.col("year") == F.col("_latest") - 1
    out = dated.agg(
        F.max("year").alias("year"),
        F.avg(F.when(now, F.col("avg_price"))).alias("price"),
        F.avg(F.when(before, F.col("avg_price"))).alias("price_before"),
        F.sum(F.when(now, F.col("deal_count"))).alias("volume"),
        F.sum(F.when(before, F.col("deal_count"))).alias("volume_before"),
    )
    out = out.withColumn("price_change_pct", ratio(F.col("price") - F.col("price_before"), "price_before", 100)).withColumn(
        "volume_change", F.col("volume") - F.col("volume_before")
    )
    if panel is not None and "deposit_ratio" in panel.columns:
        year = out.columns
        ratios = panel.filter(F.col("year") >= latest - 1).groupBy("year").agg(F.avg("deposit_ratio").alias("v"))
        by_year = ratios.select(F.map_from_entries(F.collect_list(F.struct("year", "v")))).scalar()
        out = out.select(
            *year,
            by_year[F.col("year")].alias("deposit_ratio"),
            by_year[F.col("year") - 1].alias("deposit_ratio_before"),
        ).withColumn("deposit_ratio_change", F.col("deposit_ratio") - F.col("deposit_ratio_before"))
    return out


def pension_rollup(workplaces: DataFrame) -> DataFrame:
    """Workplace rows to district-month totals, per-head amount and net hires."""
    return (
        workplaces.dropna(subset=["district_code", "ym"])
        .groupBy("district_code", "ym")
        .agg(
            null_sum("subscribers").alias("pension_subscribers"),
            null_sum("billed").alias("pension_billed"),
            F.count("subscribers").alias("pension_workplaces"),
            (null_sum("hired") - null_sum("left")).alias("pension_net_hires"),
        )
        .withColumn(
            "pension_per_head",
            F.when(F.col("pension_subscribers") > 0, ratio("pension_billed", "pension_subscribers")),
        )
    )


def sum_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.dropna(subset=keys).groupBy(*keys).agg(null_sum(value).alias(value))


def top_k_total(df: DataFrame, key: str, value: str, k: int = 5) -> DataFrame:
    """The ``k`` keys with the largest total; ties go to the smaller key."""
    return sum_by(df, [key], value).orderBy(F.desc_nulls_last(value), F.asc(key)).limit(k)


def seasonal_effect(df: DataFrame, value: str, *, date: str = "ds") -> DataFrame:
    return df.groupBy(F.month(date).alias("month")).agg(F.avg(value).alias(value))


def dimension_values(df: DataFrame, column: str, *, where: Column | None = None) -> DataFrame:
    """Sorted distinct values of a filter dimension."""
    df = df if where is None else df.filter(where)
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def period_bounds(df: DataFrame, column: str = "year") -> DataFrame:
    return df.agg(F.min(column).alias("first_period"), F.max(column).alias("last_period"))
