"""Incremental loads: high-water marks, resume ledger, load reports.

There are no event-time streams; new data arrives as landed
files. A load appends what is new and then keeps the latest row per key, so
running it twice leaves the same table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthpanel.operators.reshape import keep_latest


def month_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    """All months from ``start`` to ``end`` as ``YYYY-MM``, both included."""
    first, last = (F.to_date(F.lit(f"{m}-01")) for m in (start, end))
    months = F.sequence(first, last, F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(months).alias("month_start")).select(F.date_format("month_start", "yyyy-MM").alias("ym"))


@dataclass(frozen=True)
class Window:
    """Periods to load; ``start`` is None for a first full load."""

    start: str | None
    end: str
    up_to_date: bool


def next_month(ym: str) -> str:
    year, month = int(ym[:4]), int(ym[5:7])
    return f"{year + month // 12}-{month % 12 + 1:02d}"


def high_water_mark(target: DataFrame, *, grain: str = "month") -> DataFrame:
    """Last period in the target as one row: a month, or a year from year or month."""
    if grain == "month":
        return target.agg(F.max("ym").alias("high_water"))
    period = F.col("year").cast("string") if "year" in target.columns else F.substring("ym", 1, 4)
    return target.agg(F.max(period).alias("high_water"))


def incremental_window(target: DataFrame, *, grain: str = "month", end: str) -> Window:
    """Periods still to load.

    Monthly tables go on after their last month. Yearly ones load their last
    year again, because late figures still change it.
    """
    mark = high_water_mark(target, grain=grain).first()["high_water"]
    if mark is None:
        return Window(None, end, False)
    if grain == "month":
        start = next_month(mark)
        return Window(start, end, start > end)
    return Window(mark, end, False)


def in_window(landed: DataFrame, window: Window, period: str = "ym") -> DataFrame:
    if window.up_to_date:
        return landed.filter(F.lit(False))
    column = F.col(period).cast("string")
    upto = column <= window.end
    return landed.filter(upto if window.start is None else upto & (column >= window.start))


def latest_rows(increment: DataFrame, keys: list[str], *, order: str | None = None) -> DataFrame:
    """One row per key of an increment: that with the largest ``order``, then with the largest values."""
    return keep_latest(increment.withColumn("_load", F.col(order) if order else F.lit(0)), keys, "_load").drop("_load")


def replace_rows(target: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """History plus rows that are unique by key; for a key in both, the new row stays."""
    kept = target.join(fresh.select(*keys), keys, "left_anti").select(*target.columns)
    return kept.unionByName(fresh, allowMissingColumns=True)


def merge_increment(target: DataFrame, increment: DataFrame, keys: list[str], *, order: str | None = None) -> DataFrame:
    """History plus new rows; for a key in both, the new row stays.

    The history loses the increment's keys in an anti join, for which Spark
    broadcasts a small increment and leaves the history where it is. A key that
    the increment repeats keeps the row with the largest ``order``, then with
    the largest values; a key with a null part never equals another.
    """
    return replace_rows(target, latest_rows(increment, keys, order=order), keys)


def new_rows(target: DataFrame, landed: DataFrame, *, period: str = "ym") -> DataFrame:
    """Landed rows after the target's last period, found without a driver round trip."""
    mark = target.select(F.max(period)).scalar()
    return landed.withColumn("_mark", mark).filter(F.col("_mark").isNull() | (F.col(period) > F.col("_mark"))).drop("_mark")


def pending_pairs(regions: DataFrame, months: DataFrame, ledger: DataFrame) -> DataFrame:
    """District-month pairs that no finished load has recorded.

    Every district needs every month, so the calendar is attached to each
    district as an array and exploded; the ledger is an anti join.
    """
    calendar = months.select(F.array_sort(F.collect_set("ym"))).scalar()
    wanted = regions.select("district_code").distinct().withColumn("ym", F.explode(calendar))
    return wanted.join(ledger.select("district_code", "ym"), ["district_code", "ym"], "left_anti")


def record_done(pairs: DataFrame, path: str) -> None:
    """Append finished pairs to the ledger, only after their rows are written."""
    pairs.select("district_code", "ym").write.mode("append").parquet(path)


def ingest_new_files(spark: SparkSession, landing: str, schema: str, target: str, checkpoint: str, **options) -> None:
    """Append landed CSV files that no earlier run has taken in.

    The file source keeps the ledger of finished files in the checkpoint, which
    must lie in storage that all executors share.
    """
    stream = spark.readStream.schema(schema).options(**{"header": True, **options}).csv(landing)
    query = (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def table_profile(df: DataFrame, *, name: str, region: str = "province", period: str = "ym") -> DataFrame:
    """Rows, distinct regions, first and last period of a table."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(region).alias("regions"),
        F.min(period).alias("first_period"),
        F.max(period).alias("last_period"),
    ).select(F.lit(name).alias("table"), "*")


def load_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a load changed per table, from profiles taken before and after."""
    old = before.select("table", F.col("rows").alias("rows_before"), F.col("last_period").alias("period_before"))
    added = F.col("rows") - F.coalesce("rows_before", F.lit(0))
    status: Column = F.when(F.col("rows") == 0, "failed").when(added == 0, "skipped").otherwise("loaded")
    return after.join(old, "table", "left").select(
        "table", "rows", "regions", "first_period", "last_period", "period_before", added.alias("added_rows"), status.alias("status")
    )


def report_totals(report: DataFrame) -> DataFrame:
    def tables(status: str) -> Column:
        return F.count(F.when(F.col("status") == status, 1)).alias(status)

    return report.agg(tables("loaded"), tables("failed"), tables("skipped"), F.sum("added_rows").alias("added_rows"))
