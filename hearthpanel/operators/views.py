"""Tables behind the comparison, gap, migration, supply and shortage views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.operators.ratios import with_deposit_gap
from hearthpanel.operators.reshape import unpivot_wide
from hearthpanel.operators.scope import latest_period
from hearthpanel.operators.windows import minmax, top_k

MIGRATION = ["moved_in", "moved_out", "net_moved"]
SUPPLY = ["permits", "starts", "completions"]


def region_label(name: str = "district_name", province: str = "province") -> Column:
    return F.when(F.col(province).isNull(), F.col(name)).otherwise(
        F.concat(F.col(name), F.lit(" ("), F.col(province), F.lit(")"))
    )


def dual_series(panel: DataFrame, left: str, right: str, *, province: str, period: str = "year") -> DataFrame:
    return panel.filter(F.col("province") == province).select(period, left, right).orderBy(period)


def gap_view(panel: DataFrame, *, province: str, period: str = "year") -> DataFrame:
    gap = with_deposit_gap(panel.filter(F.col("province") == province))
    return gap.select(period, "avg_price", "deposit_only_avg_deposit", "deposit_gap", "gap_deposit_ratio").orderBy(period)


def long_view(panel: DataFrame, columns: list[str], *, province: str | None = None, period: str = "year") -> DataFrame:
    """Chart columns that the panel has, one row per period and column."""
    if province is not None:
        panel = panel.filter(F.col("province") == province)
    have = [c for c in columns if c in panel.columns]
    return unpivot_wide(panel, ids=["province", period], columns=have)


def migration_view(panel: DataFrame, **where) -> DataFrame:
    return long_view(panel, MIGRATION, **where)


def supply_view(panel: DataFrame, **where) -> DataFrame:
    return long_view(panel, SUPPLY, **where)


def normalised_view(panel: DataFrame, columns: list[str], *, province: str, period: str = "year") -> DataFrame:
    """Series of one region scaled to 0-1 over complete rows, long form."""
    rows = panel.filter(F.col("province") == province).select("province", period, *columns).dropna()
    for column in columns:
        rows = minmax(rows, column, group="province", name=column, flat=0.0)
    return unpivot_wide(rows, ids=["province", period], columns=columns)


def unsold_view(panel: DataFrame, column: str, *, period: str = "year", latest: bool = False) -> DataFrame:
    """Mean unsold homes per province and period, or of the latest year, most first."""
    keys = ["province"] if latest else ["province", period]
    rows = latest_period(panel) if latest else panel
    out = rows.dropna(subset=keys).groupBy(*keys).agg(F.avg(column).alias(column))
    return out.orderBy(F.desc_nulls_last(column), "province") if latest else out


def undervalued(scores: DataFrame, k: int = 10) -> DataFrame:
    return top_k(scores, "value_score", k, tie="district_code").withColumn("label", region_label())


def overvalued(scores: DataFrame, k: int = 10) -> DataFrame:
    return top_k(scores, "value_score", k, ascending=True, tie="district_code").withColumn("label", region_label())


def top_grades(grades: DataFrame, k: int = 30) -> DataFrame:
    return grades.orderBy("grade").limit(k).withColumn("label", region_label())
