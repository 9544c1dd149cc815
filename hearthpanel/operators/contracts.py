"""From contract rows to district-month rollups.

Contract tables are the only inputs here that grow without bound. Every rollup
is one scan and one aggregate: Spark combines rows before the shuffle, so a
district that holds a third of all contracts arrives at the reducer as one row
per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.functions.numeric import clean_amount, clean_double, ratio
from hearthpanel.functions.periods import pad_code, year_month
from hearthpanel.functions.regions import province_from_code, short_province
from hearthpanel.operators.partials import State, distinct, merged, partial, quantile

SALE_KEYS = ["province", "district_code", "year", "month"]

LEASE_KINDS = ("deposit_only", "monthly_rent", "all_leases")


def _whole(name: str) -> Column:
    """A period part such as ``2020`` or ``2020.0``."""
    return F.col(name).try_cast("double").try_cast("int").alias(name)


def type_sales(raw: DataFrame) -> DataFrame:
    """Typed sale contracts from the all-text landing columns."""
    return raw.select(
        pad_code("district_code").alias("district_code"),
        short_province(province_from_code("district_code")).alias("province"),
        _whole("year"),
        _whole("month"),
        clean_double("area").alias("area"),
        F.col("build_year").try_cast("double").cast("int").alias("build_year"),
        clean_amount("amount").alias("amount"),
    )


def type_leases(raw: DataFrame) -> DataFrame:
    """Typed lease contracts; a missing rent counts as zero."""
    return raw.select(
        pad_code("district_code").alias("district_code"),
        short_province(province_from_code("district_code")).alias("province"),
        _whole("year"),
        _whole("month"),
        clean_double("area").alias("area"),
        clean_amount("deposit").alias("deposit"),
        F.coalesce(clean_double("rent"), F.lit(0.0)).alias("rent"),
    )


def valid_contracts(df: DataFrame, amount: str = "amount") -> DataFrame:
    """Contracts with a complete key, a positive amount and a positive area."""
    present = F.lit(True)
    for name in ("district_code", "year", "month"):
        present = present & F.col(name).isNotNull()
    return df.filter(present & (F.col(amount) > 0) & (F.col("area") > 0))


def with_unit_price(df: DataFrame, amount: str = "amount", name: str = "unit_price") -> DataFrame:
    return df.withColumn(name, ratio(amount, "area"))


def with_building_age(df: DataFrame) -> DataFrame:
    """Deal year minus build year; a negative age is unknown."""
    age = F.col("year") - F.col("build_year")
    return df.withColumn("building_age", F.when(age >= 0, age))


def lease_kind_filter(kind: str, rent: str = "rent") -> Column:
    if kind == "deposit_only":
        return F.col(rent) == 0
    if kind == "monthly_rent":
        return F.col(rent) > 0
    if kind == "all_leases":
        return F.lit(True)
    raise ValueError(f"unknown lease kind {kind!r}; expected one of {LEASE_KINDS}")


def _present(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(subset=keys)


def _with_period(df: DataFrame) -> DataFrame:
    return df.withColumn("ym", year_month("year", "month"))


def sales_rollup(sales: DataFrame, *, keep_province: bool = True) -> DataFrame:
    """Mean price, deal count and mean unit price per district and month."""
    keys = SALE_KEYS if keep_province else SALE_KEYS[1:]
    priced = with_unit_price(valid_contracts(sales))
    return _with_period(
        _present(priced, keys)
        .groupBy(*keys)
        .agg(
            F.avg("amount").alias("avg_price"),
            F.count(F.lit(1)).alias("deal_count"),
            F.avg("unit_price").alias("avg_unit_price"),
        )
    )


def sales_detail_rollup(sales: DataFrame) -> DataFrame:
    """The sale rollup split by build year, with the mean building age.

    One row per key: partial results of different input splits are merged.
    """
    keys = [*SALE_KEYS, "build_year"]
    priced = with_building_age(with_unit_price(valid_contracts(sales)))
    return _with_period(
        _present(priced, keys)
        .groupBy(*keys)
        .agg(
            F.avg("amount").alias("avg_price"),
            F.count(F.lit(1)).alias("deal_count"),
            F.avg("unit_price").alias("avg_unit_price"),
            F.avg("building_age").alias("avg_building_age"),
        )
    )


SALE_STATES = (
    State("amount_sum", "amount"),
    State("unit_sum", "unit_price"),
    State("age_sum", "building_age"),
    State("age_n", "if(building_age IS NULL, 0, 1)"),
    State("n", "1"),
)


def sales_rows(sales: DataFrame) -> DataFrame:
    """The contracts that count in sale rollups, with the columns of their states."""
    return _present(with_building_age(with_unit_price(valid_contracts(sales))), SALE_KEYS)


def sales_base(sales: DataFrame) -> DataFrame:
    """Sums and counts per district, month and build year, unknown build years too.

    Both sale rollups follow from it, so the contracts are scanned once for the two.
    """
    return partial(sales_rows(sales), [*SALE_KEYS, "build_year"], SALE_STATES)


def rollup_from_base(base: DataFrame, *, detail: bool = False) -> DataFrame:
    """The sale rollup, or the one by build year, from their shared base."""
    if detail:
        base = base.filter(F.col("build_year").isNotNull())
    keys = [*SALE_KEYS, "build_year"] if detail else SALE_KEYS
    measures = [
        ratio(F.sum("amount_sum"), F.sum("n")).alias("avg_price"),
        F.sum("n").alias("deal_count"),
        ratio(F.sum("unit_sum"), F.sum("n")).alias("avg_unit_price"),
    ]
    if detail:
        measures.append(ratio(F.sum("age_sum"), F.sum("age_n")).alias("avg_building_age"))
    return _with_period(base.groupBy(*keys).agg(*measures))


SKETCH_STATES = (
    State("n", "1"),
    State("amount_sum", "amount"),
    State("least", "amount", "min"),
    State("most", "amount", "max"),
    State("prices", "amount", "quantiles"),
    State("build_years", "build_year", "distinct"),
)


def price_spread(sketched: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean, range, quartiles and number of build years of any coarser keys, from stored states alone.

    Quartiles and build years come from sketches: see ``partials.SIZE`` and
    ``LOG`` for their errors. ``group_quantiles`` over the contracts is the
    exact way, and remains the default of everything else.
    """
    return merged(sketched, keys, SKETCH_STATES).select(
        *keys,
        "n",
        ratio("amount_sum", "n").alias("avg_price"),
        "least",
        "most",
        *(quantile("prices", p).alias(name) for p, name in ((0.25, "lower"), (0.5, "middle"), (0.75, "upper"))),
        distinct("build_years").alias("build_years"),
    )


def lease_rollup(leases: DataFrame, *, kind: str) -> DataFrame:
    """Mean deposit, deposit per square metre and rent per district and month."""
    chosen = with_unit_price(valid_contracts(leases, "deposit"), "deposit", "deposit_per_area").filter(
        lease_kind_filter(kind)
    )
    measures = [
        F.avg("deposit").alias("avg_deposit"),
        F.count(F.lit(1)).alias("lease_count"),
        F.avg("deposit_per_area").alias("deposit_unit"),
    ]
    if kind != "deposit_only":
        measures.append(F.avg("rent").alias("avg_rent"))
    return _with_period(_present(chosen, SALE_KEYS).groupBy(*SALE_KEYS).agg(*measures))


def lease_rollups(leases: DataFrame) -> DataFrame:
    """All three lease kinds in one scan and one shuffle, long by ``lease_kind``.

    A contract counts for its own kind and for ``all_leases``. The two base
    kinds are aggregated first, so the second step only adds up rollup rows.
    """
    priced = with_unit_price(valid_contracts(leases, "deposit"), "deposit", "deposit_per_area")
    own_kind = F.when(F.col("rent") > 0, "monthly_rent").when(F.col("rent") == 0, "deposit_only")
    base = (
        _present(priced, SALE_KEYS)
        .withColumn("base_kind", own_kind)
        .groupBy(*SALE_KEYS, "base_kind")
        .agg(
            F.sum("deposit").alias("deposit_sum"),
            F.sum("deposit_per_area").alias("unit_sum"),
            F.sum("rent").alias("rent_sum"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    kinds = F.explode(F.array_compact(F.array(F.col("base_kind"), F.lit("all_leases"))))
    return _with_period(
        base.withColumn("lease_kind", kinds)
        .groupBy(*SALE_KEYS, "lease_kind")
        .agg(
            ratio(F.sum("deposit_sum"), F.sum("n")).alias("avg_deposit"),
            F.sum("n").alias("lease_count"),
            ratio(F.sum("unit_sum"), F.sum("n")).alias("deposit_unit"),
            F.when(F.col("lease_kind") != "deposit_only", ratio(F.sum("rent_sum"), F.sum("n"))).alias("avg_rent"),
        )
    )
