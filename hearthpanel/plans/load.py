"""The incremental load job: landed rows into a table by year, its ledger, its report and its rollups.

Beside the table lie its profile and any partial aggregates, all by year. A load
reads the landed rows, the table's years that they touch and those aggregates;
the other years are neither read nor written, however long the history is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthpanel.operators.partials import State, applied, partial, same_keys, signed_partial
from hearthpanel.sources.csv_files import path_exists
from hearthpanel.sources.sinks import overwrite_years, write_rollup
from hearthpanel.streaming.incremental import in_window, incremental_window, latest_rows, load_report, record_done, replace_rows

JOURNAL = "load_id string, state string, years array<int>"


@dataclass(frozen=True)
class Partials:
    """Partial aggregates of a table, kept at ``path`` by year and brought up to date by each load."""

    path: str
    keys: list[str]  # with ``year`` among them
    states: tuple[State, ...]
    rows: Callable[[DataFrame], DataFrame] = lambda table: table  # the rows that count, with the columns that states read
    count: str = "n"  # the state that sums 1: a key that has no rows left is not read

    def of(self, table: DataFrame) -> DataFrame:
        return partial(self.rows(table), self.keys, self.states)

    def read(self, spark: SparkSession, like: DataFrame) -> DataFrame:
        """The stored states; ``like`` has the table's columns."""
        schema = self.of(like).schema
        if path_exists(spark, self.path):
            return spark.read.schema(schema).parquet(self.path).filter(F.col(self.count) > 0)
        return spark.createDataFrame([], schema)

    def change(self, fresh: DataFrame, replaced: DataFrame) -> DataFrame:
        return signed_partial(self.rows(fresh), self.rows(replaced), self.keys, self.states)

    def applied(self, stored: DataFrame, change: DataFrame, table: DataFrame) -> DataFrame:
        rows = self.rows(table)

        def again(lost: DataFrame) -> DataFrame:
            return partial(rows.join(lost, same_keys(rows, lost, self.keys), "left_semi"), self.keys, self.states)

        return applied(stored, change, self.keys, self.states, count=self.count, again=again)


@dataclass(frozen=True)
class Target:
    """A stored table: where it is, what makes a row unique, how its periods are counted."""

    name: str
    path: str
    keys: list[str]
    grain: str = "month"
    period: str = "ym"
    region: str = "province"
    order: str | None = None  # of rows that repeat a key in one load, the one with the largest value stays
    ledger: str | None = None  # finished (district_code, ym) pairs are appended here
    rollups: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)  # by path, made anew after a load
    partials: tuple[Partials, ...] = ()  # brought up to date by what a load changes

    @property
    def profile(self) -> Partials:
        """Rows, first and last period by year and region: what windows and reports need to know of the table."""
        states = (State("n", "1"), State("first_period", self.period, "min"), State("last_period", self.period, "max"))
        return Partials(f"{self.path}_profile", list(dict.fromkeys(["year", self.region])), states)


def read_target(spark: SparkSession, target: Target, like: DataFrame) -> DataFrame:
    """The stored table, or an empty one of the landed rows' shape before the first load."""
    if path_exists(spark, target.path):
        return spark.read.schema(like.schema).parquet(target.path)
    return like.filter(F.lit(False))


def stored_profile(target: Target, profile: DataFrame) -> DataFrame:
    """The profile of a table (see ``table_profile``) from its stored states."""
    return profile.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.countDistinct(target.region).alias("regions"),
        F.min("first_period").alias("first_period"),
        F.max("last_period").alias("last_period"),
    ).select(F.lit(target.name).alias("table"), "*")


def _journal(spark: SparkSession, target: Target, load_id: str, state: str, years: list[int]) -> None:
    spark.createDataFrame([(load_id, state, years)], JOURNAL).coalesce(1).write.mode("append").parquet(f"{target.path}_journal")


def recover(spark: SparkSession, target: Target, like: DataFrame) -> None:
    """Make the states anew of the years that a load began to change and did not finish, or of all that have none yet."""
    years: list[int] | None = []
    path = f"{target.path}_journal"
    if path_exists(spark, path):
        journal = spark.read.schema(JOURNAL).parquet(path)
        states = journal.groupBy("load_id").agg(F.collect_set("state").alias("states"), F.flatten(F.collect_list("years")).alias("years"))
        broken = [r for r in states.collect() if "done" not in r.states]  # one row for each load
        years = sorted({y for r in broken for y in r.years})
    table = read_target(spark, target, like)
    for held in (target.profile, *target.partials):
        if not path_exists(spark, held.path):
            overwrite_years(held.of(table), held.path)
        elif years:
            overwrite_years(held.of(table.filter(F.col("year").isin(years))), held.path)
    if years:
        for r in broken:
            _journal(spark, target, r.load_id, "done", r.years)


def load(spark: SparkSession, target: Target, landed: DataFrame, *, end: str) -> DataFrame:
    """Bring a table up to ``end``; returns one report row.

    Landed rows need ``year``, the period and the keys. Rows of the open window
    replace stored ones of the same key; only the years they touch are read,
    merged and written, so history stays where it is. What the load adds and
    replaces is aggregated once and merged into the profile and the partial
    aggregates. A year is replaced when its files are complete, the ledger
    follows, then the aggregates and rollups. A load that breaks off can be run
    again: a journal names the years it had begun, whose aggregates the next
    load makes anew. A load that is run twice changes nothing.
    """
    recover(spark, target, landed)
    profile = target.profile.read(spark, landed)
    before = stored_profile(target, profile)
    before = spark.createDataFrame(before.collect(), before.schema)
    marks = profile.select("year", F.col("last_period").cast("string").alias("ym"))
    window = incremental_window(marks, grain=target.grain, end=end)
    opened = in_window(landed, window, target.period).filter(F.col("year").isNotNull())
    # Staged once: the landed rows are read, ordered and cut to one per key a single time.
    staged = f"{target.path}_increment"
    latest_rows(opened, target.keys, order=target.order).write.mode("overwrite").parquet(staged)
    fresh = spark.read.schema(landed.schema).parquet(staged)
    years = sorted(r.year for r in fresh.select("year").distinct().collect())  # as many as the calendar has
    if not years:
        return load_report(before, stored_profile(target, target.profile.read(spark, landed)))
    stored = read_target(spark, target, landed).filter(F.col("year").isin(years))
    replaced = stored.join(fresh.select(*target.keys), target.keys, "left_semi").select(*stored.columns)
    held = (target.profile, *target.partials)
    changes = []
    for i, one in enumerate(held):  # before the replaced rows go
        path = f"{target.path}_change_{i}"
        change = one.change(fresh, replaced)
        change.write.mode("overwrite").parquet(path)
        changes.append(spark.read.schema(change.schema).parquet(path))
    load_id = uuid.uuid4().hex
    _journal(spark, target, load_id, "begun", years)
    overwrite_years(replace_rows(stored, fresh, target.keys), target.path, target.keys)
    spark.catalog.refreshByPath(target.path)
    if target.ledger:
        record_done(fresh.select("district_code", "ym").distinct(), target.ledger)
    table = read_target(spark, target, landed)
    touched = F.col("year").isin(years)
    for one, change in zip(held, changes):
        overwrite_years(one.applied(one.read(spark, landed).filter(touched), change, table.filter(touched)), one.path)
        spark.catalog.refreshByPath(one.path)
    _journal(spark, target, load_id, "done", years)
    for path, rollup in target.rollups.items():
        write_rollup(rollup(table), path)
    return load_report(before, stored_profile(target, target.profile.read(spark, landed)))
