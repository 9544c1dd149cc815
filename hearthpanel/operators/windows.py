"""Ordered and normalising column operators over region-period series.

Windows are partitioned by region and run over panel rows, whose number per
region is bounded by the number of periods. Table-wide statistics are scalar
subqueries of one aggregate, never a window without a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearthpanel.functions.numeric import ratio


def _ordered(group: str | list[str], order_by: str):
    return Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(F.asc_nulls_last(order_by))


def pct_change(
    df: DataFrame, col: str, *, group: str | list[str], order_by: str, name: str | None = None
) -> DataFrame:
    """Percent change against the previous row of the group, gaps filled forward."""
    series = _ordered(group, order_by)
    upto = series.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = series.rowsBetween(Window.unboundedPreceding, -1)
    current, previous = F.last(col, True).over(upto), F.last(col, True).over(before)
    return df.withColumn(name or f"{col}_change", (ratio(current, previous) - 1) * 100)


def lags(df: DataFrame, columns: list[str], *, count: int, group: str, order_by: str) -> DataFrame:
    series = _ordered(group, order_by)
    return df.withColumns(
        {f"{c}_lag{i}": F.lag(c, i).over(series) for c in columns for i in range(1, count + 1)}
    )


def zscore(df: DataFrame, col: str, *, group: str, name: str | None = None, degenerate: str = "raw") -> DataFrame:
    """Standard score inside the group.

    A group with under two values or no spread keeps its raw values
    (``degenerate="raw"``) or becomes null (``"null"``).
    """
    within = Window.partitionBy(group)
    mean, spread = F.avg(col).over(within), F.stddev_samp(col).over(within)
    flat = F.col(col).cast("double") if degenerate == "raw" else F.lit(None).cast("double")
    # `spread > 0` is null for a single value, which also takes the flat branch.
    return df.withColumn(name or f"{col}_z", F.when(spread > 0, ratio(F.col(col) - mean, spread)).otherwise(flat))


def with_table_stats(df: DataFrame, *measures: Column, name: str = "_stats") -> DataFrame:
    """Attach a one-row aggregate of the table to every row, as one struct column.

    It is a scalar subquery: no join, and no window that would pull the table
    into one task. All measures share it, so it runs once.
    """
    return df.withColumn(name, df.select(F.struct(*measures)).scalar())


def _scaled(col: str, low: Column, high: Column, flat: float) -> Column:
    return F.when(high > low, ratio(F.col(col) - low, high - low)).when(high == low, F.lit(float(flat)))


def minmax_table(df: DataFrame, columns: dict[str, str], *, flat: float = 0.5) -> DataFrame:
    """Scale several columns to 0-1 over the whole table; a flat column becomes ``flat``."""
    edges = [e for c in columns for e in (F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high"))]
    df = with_table_stats(df, *edges)
    stats = F.col("_stats")
    return df.withColumns(
        {name: _scaled(c, stats[f"{c}_low"], stats[f"{c}_high"], flat) for c, name in columns.items()}
    ).drop("_stats")


def minmax(
    df: DataFrame, col: str, *, group: str | None = None, name: str | None = None, flat: float = 0.5
) -> DataFrame:
    """Scale to 0-1 over the table or per group; a flat series becomes ``flat``.

    Grading uses 0.5 for a flat series, charts use 0.
    """
    name = name or f"{col}_scaled"
    if group is None:
        return minmax_table(df, {col: name}, flat=flat)
    within = Window.partitionBy(group)
    return df.withColumn(name, _scaled(col, F.min(col).over(within), F.max(col).over(within), flat))


def rebase(df: DataFrame, col: str, *, base_period, group: str, order_by: str, name: str | None = None) -> DataFrame:
    """Index with the base period at 100; no usable base gives null."""
    base = F.first(F.when(F.col(order_by) == F.lit(base_period), F.col(col)), True).over(
        Window.partitionBy(group)
    )
    return df.withColumn(name or f"{col}_index", ratio(col, base) * 100)


def transform_series(
    df: DataFrame, col: str, *, mode: str, base_period=None, group: str = "province", order_by: str = "year"
) -> DataFrame:
    """A chart series as it is (``raw``), as ``index100`` or scaled to ``unit``."""
    if mode == "raw" or (mode == "index100" and base_period is None):
        return df
    if mode == "index100":
        return rebase(df, col, base_period=base_period, group=group, order_by=order_by, name=col)
    if mode == "unit":
        return minmax(df, col, group=group, name=col, flat=0.0)
    raise ValueError(f"unknown mode {mode!r}")


def top_k(df: DataFrame, col: str, k: int, *, ascending: bool = False, tie: str | None = None) -> DataFrame:
    order = [F.asc_nulls_last(col) if ascending else F.desc_nulls_last(col)]
    return df.orderBy(*order, *([F.asc(tie)] if tie else [])).limit(k)


def page(df: DataFrame, *order: Column, number: int, size: int = 10) -> DataFrame:
    """One page of an ordered result table, the first page being 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
