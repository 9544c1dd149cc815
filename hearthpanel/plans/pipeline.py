"""From configured files to rollups, sources and panels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthpanel.operators.contracts import lease_rollups, rollup_from_base, sales_base, type_leases, type_sales
from hearthpanel.plans.panel import LEASE_KINDS, build_panel
from hearthpanel.sources import csv_files as files
from hearthpanel.sources.sinks import is_complete, read_rollup, rollup_path, write_rollup
from hearthpanel.sources.specs import ALIASES, INDICATOR_SPECS, read_indicator


@dataclass(frozen=True)
class SourceConfig:
    """Where the inputs lie. Anything left out is left out of the panel."""

    rollups: str
    sales: str | None = None
    leases: str | None = None
    population: tuple[str, ...] = ()
    grdp: str | None = None
    permits: str | None = None
    age_population: str | None = None
    pension: str | None = None
    indicators: dict[str, str] = field(default_factory=dict)
    contract_encoding: str | None = None  # found for each file


def _lease_kind(base: DataFrame, kind: str) -> DataFrame:
    rollup = base.filter(F.col("lease_kind") == kind).drop("lease_kind")
    return rollup.drop("avg_rent") if kind == "deposit_only" else rollup


def _families(spark: SparkSession, config: SourceConfig) -> list[tuple[DataFrame, dict[str, Callable[[DataFrame], DataFrame]]]]:
    """Base aggregates over the raw contracts and the rollups that follow from each."""
    families = []
    if config.sales:
        sales = type_sales(files.scan_sales(spark, config.sales, encoding=config.contract_encoding))
        rollups = {"sales": rollup_from_base, "sales_detail": lambda base: rollup_from_base(base, detail=True)}
        families.append((sales_base(sales), rollups))
    if config.leases:
        leases = type_leases(files.scan_leases(spark, config.leases, encoding=config.contract_encoding))
        families.append((lease_rollups(leases), {kind: lambda base, kind=kind: _lease_kind(base, kind) for kind in LEASE_KINDS}))
    return families


def load_rollups(spark: SparkSession, config: SourceConfig, *, force_rebuild: bool = False) -> dict[str, DataFrame]:
    """Stored rollups, built first where they are missing or ``force_rebuild`` asks for it.

    New contracts make all rollups stale, so a rebuild renews every one of
    them. The base aggregate is kept only while its rollups are written: the
    contracts are scanned once, and a later rebuild sees new files.
    """
    stored = {}
    for base, rollups in _families(spark, config):
        paths = {name: rollup_path(config.rollups, name) for name in rollups}
        stale = [name for name in rollups if force_rebuild or not is_complete(spark, paths[name])]
        if stale:
            base.persist(StorageLevel.MEMORY_AND_DISK)
            for name in stale:
                write_rollup(rollups[name](base), paths[name])
            base.unpersist()
        for name, derive in rollups.items():
            stored[name] = read_rollup(spark, paths[name], derive(base).schema)
    return stored


def load_sources(spark: SparkSession, config: SourceConfig, *, force_rebuild: bool = False) -> dict[str, DataFrame]:
    """Every source that exists, by name; missing files are skipped."""
    sources = load_rollups(spark, config, force_rebuild=force_rebuild)
    population = [p for p in config.population if files.path_exists(spark, p)]
    if population:
        sources["population"] = files.read_population(spark, population)
    wide = {
        "grdp": (config.grdp, files.read_grdp),
        "permits": (config.permits, files.read_permits),
        "age_population": (config.age_population, files.read_age_population),
        "pension": (config.pension, files.read_pension),
    }
    for name, (path, read) in wide.items():
        if path and files.path_exists(spark, path):
            sources[name] = read(spark, path)
    for name, path in config.indicators.items():
        spec = INDICATOR_SPECS[ALIASES.get(name, name)]
        if files.path_exists(spark, path):
            sources[spec.name] = read_indicator(spark, name, path)
    return sources


def load_panels(spark: SparkSession, config: SourceConfig, *, force_rebuild: bool = False) -> tuple[DataFrame, DataFrame]:
    """Yearly and monthly panel over all configured sources."""
    sources = load_sources(spark, config, force_rebuild=force_rebuild)
    return build_panel(sources, freq="yearly"), build_panel(sources, freq="monthly")
