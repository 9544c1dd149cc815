"""Long-to-wide and wide-to-long steps, unions and duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def arrival() -> Column:
    """Order of rows as they stand in their files: file name, place of the split, place in it.

    It does not depend on how splits are packed into tasks.
    """
    return F.struct(
        F.input_file_name().alias("file"),
        F.input_file_block_start().alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )


def pivot_series(
    long: DataFrame,
    *,
    keys: list[str],
    names: str,
    values: list[str],
    value: str,
    agg: str = "first",
    seq: str | None = None,
) -> DataFrame:
    """Series names become columns; the value list is explicit, so no extra job.

    ``first`` takes the value with the smallest ``seq`` (arrival order), which
    gives the same answer on every run; ``sum`` adds values up.
    """
    long = long.dropna(subset=keys).filter(F.col(value).isNotNull())
    grouped = long.groupBy(*keys).pivot(names, values)
    if agg == "sum":
        return grouped.agg(F.sum(value))
    if agg == "first":
        return grouped.agg(F.min_by(value, seq or value))
    raise ValueError(f"unknown aggregate {agg!r}")


def unpivot_wide(
    wide: DataFrame, *, ids: list[str], columns: list[str], name: str = "series", value: str = "value"
) -> DataFrame:
    cast = wide.select(*ids, *(F.col(f"`{c}`").cast("double").alias(c) for c in columns))
    return cast.unpivot(ids, columns, name, value)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_first(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the first in ``order``; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return kept.select(*keys, *(F.col("_row")[c].alias(c) for c in rest)).select(*df.columns)


def keep_latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one with the largest ``order``; of equal ones the one with the largest other values."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("_row"))
    return kept.select(*keys, *(F.col("_row")[c].alias(c) for c in rest)).select(*df.columns)


# Five-year age codes of the population survey per decade, "0" is all ages.
AGE_DECADES = {
    "age_20s": ["25", "30"],
    "age_30s": ["35", "40"],
    "age_40s": ["45", "50"],
    "age_50_up": ["55", "60", "65", "70", "75", "80", "85", "90", "95", "100", "105"],
}
SEX_PREFIX = {"total": "", "male": "male_", "female": "female_"}


def age_pivot(
    long: DataFrame,
    *,
    level: str = "province",
    decades: dict[str, list[str]] = AGE_DECADES,
    all_ages: str = "0",
) -> DataFrame:
    """Population by age and sex as fifteen columns in one aggregate."""
    keys = ["province_code", "province", "year"]
    if level == "district":
        keys = ["district_code", "district_name", *keys]

    def part(codes: list[str], sex: str) -> Column:
        return F.sum(F.when(F.col("age_code").isin(codes) & (F.col("sex") == sex), F.col("people")))

    totals = {"total": "population", "male": "population_male", "female": "population_female"}
    measures = [part([all_ages], sex).alias(name) for sex, name in totals.items()]
    measures += [
        part(codes, sex).alias(f"{prefix}{decade}")
        for decade, codes in decades.items()
        for sex, prefix in SEX_PREFIX.items()
    ]
    return long.groupBy(*keys).agg(*measures)


def keyed_series(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Figures of one type per key as rows of (keys, metric, value).

    Every series that is cut from the result needs all of its input, whatever
    metrics it keeps, so the plans of many series share one scan and one
    exchange below it.
    """
    return df.unpivot(keys, metrics, "metric", "value")


def series_totals(long: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Sums of the named metrics of a keyed series by coarser keys, one column each."""
    return long.groupBy(*keys).agg(*(F.sum(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics))
