"""Where results go: rollup tables, curated outputs, CSV downloads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from hearthpanel.sources.csv_files import path_exists

ROLLUPS = ("sales", "sales_detail", "deposit_only", "monthly_rent", "all_leases")


def rollup_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}_district_monthly"


def write_rollup(df: DataFrame, path: str) -> None:
    """Parquet by year, so that a year filter reads only its own folders.

    Districts of a year share files in order, so a district filter skips row
    groups, and a year is not one task's work.
    """
    keys = [c for c in ("year", "district_code") if c in df.columns]
    df.repartition(*keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("year").parquet(path)


def overwrite_years(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Replace the years that ``df`` holds and leave the others; a year's rows are dealt by their keys and kept in order.

    A year is replaced when all files are complete; ``df`` may read the years it replaces.
    """
    keys = [k for k in keys or [c for c in ("province", "district_code") if c in df.columns] if k != "year"]
    dealt = df.repartition("year", *keys).sortWithinPartitions("year", *keys)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


@dataclass(frozen=True)
class Clustering:
    """How a rollup is laid out: rows of one ``by`` share a bucket, and a bucket is kept in ``order``."""

    by: tuple[str, ...] = ("district_code",)
    order: tuple[str, ...] = ("district_code", "ym")
    buckets: int = 64

    def __post_init__(self):
        if self.buckets < 1 or not self.by:
            raise ValueError("a clustering needs columns and at least one bucket")


def write_clustered(df: DataFrame, name: str, path: str, layout: Clustering = Clustering()) -> None:
    """A rollup as a table of buckets, one file each.

    Tables of one layout join on ``by`` without an exchange, and a filter on
    ``by`` reads its own bucket only. Joins on further keys besides need
    ``spark.sql.requireAllClusterKeysForCoPartition`` off; ``by`` has to have
    many values then, as all rows of one are in one task.
    """
    dealt = df.repartition(layout.buckets, *layout.by).sortWithinPartitions(*layout.order)
    writer = dealt.write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(layout.buckets, *layout.by).sortBy(*layout.order).saveAsTable(name)


def open_clustered(spark: SparkSession, name: str, path: str, schema: StructType, layout: Clustering = Clustering()) -> DataFrame:
    """The same table in a session whose catalogue does not know it yet."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    by, order = (", ".join(f"`{c}`" for c in cs) for cs in (layout.by, layout.order))
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"CLUSTERED BY ({by}) SORTED BY ({order}) INTO {layout.buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def is_complete(spark: SparkSession, path: str) -> bool:
    """A rollup counts only once its write has finished."""
    return path_exists(spark, f"{path}/_SUCCESS")


def read_rollup(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read with the schema of the plan, so an empty rollup is readable too."""
    return spark.read.schema(schema).parquet(path)


def write_curated(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def export_csv(df: DataFrame, path: str, *, single_file: bool = False, bom: bool = True) -> None:
    """CSV with header in UTF-8, with a byte order mark for spreadsheet programs.

    ``single_file`` is for score and grade tables, one row per district.
    """
    if bom:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").options(header=True, encoding="UTF-8", nullValue="").csv(path)
