"""Joins onto the region panel; the optimizer and AQE broadcast a side by its size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def join_indicator(
    panel: DataFrame,
    table: DataFrame,
    *,
    keys: list[str],
    columns: list[str] | None = None,
    how: str = "left",
    only_new: bool = False,
) -> DataFrame:
    """Equi-join of a panel with an indicator table.

    Columns the table lacks are skipped; ``only_new`` also skips those the panel
    already has. No hint is set: the optimizer broadcasts the table by its
    known size, AQE by its run-time size, and a larger one is shuffled.
    """
    wanted = columns if columns is not None else [c for c in table.columns if c not in keys]
    wanted = [c for c in wanted if c in table.columns and not (only_new and c in panel.columns)]
    return panel.join(table.select(*keys, *wanted), keys, how) if wanted else panel


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that would multiply panel rows in a left join."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def outer_merge(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer merge of several series that share their keys."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.join(frame, keys, "full")
    return merged


def semi_by(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(wanted.select(*keys), keys, "left_semi")


def overlay_events(
    panel: DataFrame, events: DataFrame, *, period: str = "year", region: str | None = None, national: str = "전국"
) -> DataFrame:
    """Policy events placed on the series by their year or by their month.

    With ``region`` an event reaches the rows of its own region, and a national
    event reaches every row. Every event meets every row of its period, so give
    a panel (one row per region and period) and events counted or listed once.
    """
    stamp = F.year("event_date") if period == "year" else F.date_format("event_date", "yyyy-MM")
    placed = events.withColumn(period, stamp)
    if region is None:
        return panel.join(placed, [period], "inner")
    everywhere = placed.filter(F.col("event_region") == national)
    local = placed.filter(F.col("event_region") != national)
    return panel.join(everywhere, [period], "inner").unionByName(
        panel.join(local.withColumn(region, F.col("event_region")), [period, region], "inner")
    )
