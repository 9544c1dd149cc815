"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE does the runtime work: joins turn into broadcasts only after the real
# size of a side is known, hot join partitions are split, small partitions merged.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Cached tables may be replanned too, so small ones do not keep every shuffle partition.
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
    # Korean agency exports are MS949 files; the charset must be allowed up front.
    "spark.sql.legacy.javaCharsets": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "hearthpanel", *, master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
