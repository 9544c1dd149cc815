"""As-of and validity-interval joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthpanel.operators.asof import asof_join, interval_join, validity_intervals
from workloads import tables as t
from workloads.registry import query

_VIEWS = "views AS (SELECT user_id, ts, max(value) AS view_value FROM events WHERE event_type = 'view' GROUP BY user_id, ts)"


def _micros(name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


@query(
    "event_asof",
    f"""WITH {_VIEWS}
SELECT p.event_id, p.user_id, v.view_value, CAST(epoch_us(p.ts) - epoch_us(v.ts) AS BIGINT) AS since_us
FROM (SELECT * FROM events WHERE event_type <> 'view') p ASOF LEFT JOIN views v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def event_asof(spark, sf):
    """Every other event with the last view of its user; days are sorted apart, so one busy user is many tasks."""
    events = t.table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    views = events.filter("event_type = 'view'").withColumnRenamed("value", "view_value")
    rest = events.filter("event_type <> 'view'").select("event_id", "user_id", "ts")
    found = asof_join(
        rest, views, by=["user_id"], on="ts", columns=["view_value"], block=lambda at: F.date_trunc("day", at), stamp="viewed"
    )
    return found.select("event_id", "user_id", "view_value", (_micros("ts") - _micros("viewed")).alias("since_us"))


@query(
    "event_next",
    f"""WITH {_VIEWS}
SELECT p.event_id, p.user_id, v.view_value, CAST(epoch_us(v.ts) - epoch_us(p.ts) AS BIGINT) AS until_us
FROM (SELECT * FROM events WHERE event_type = 'click') p ASOF LEFT JOIN views v ON p.user_id = v.user_id AND p.ts < v.ts""",
)
def event_next(spark, sf):
    """Every click with the user's first view after it."""
    events = t.table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    views = events.filter("event_type = 'view'").withColumnRenamed("value", "view_value")
    clicks = events.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    found = asof_join(clicks, views, by=["user_id"], on="ts", columns=["view_value"], direction="forward", strict=True, stamp="viewed")
    return found.select("event_id", "user_id", "view_value", (_micros("viewed") - _micros("ts")).alias("until_us"))


_REGIMES = """regimes AS (
  SELECT district_code, ym, CAST(floor(avg_price / 4000) AS BIGINT) AS tier, lead(ym) OVER (PARTITION BY district_code ORDER BY ym) AS until
  FROM sales_rollup WHERE month % 3 = 1)"""


def _regimes(spark, sf):
    rolled = t.rolled_sales(spark, sf).filter("month % 3 = 1")
    changes = rolled.select("district_code", "ym", F.floor(F.col("avg_price") / 4000).alias("tier"))
    return validity_intervals(changes, by=["district_code"], at="ym")


@query("regime_intervals", f"WITH {t.SALES_ROLLUP}, {_REGIMES} SELECT district_code, ym, tier, until FROM regimes")
def regime_intervals(spark, sf):
    return _regimes(spark, sf)


@query(
    "regime_leases",
    f"""WITH {t.SALES_ROLLUP}, {t.LEASES[len(t.REGIONS) + 2:]}, {_REGIMES},
dated AS (SELECT *, CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS ym FROM leases)
SELECT d.district_code, r.tier, count(*) AS leases, CAST(sum(d.deposit) AS BIGINT) AS deposits
FROM dated d LEFT JOIN regimes r ON d.district_code = r.district_code AND r.ym <= d.ym AND (r.until IS NULL OR d.ym < r.until)
GROUP BY d.district_code, r.tier""",
)
def regime_leases(spark, sf):
    """Lease contracts by the price regime that held in their district when they were made."""
    dated = t.leases(spark, sf).select("district_code", "deposit", F.format_string("%d-%02d", "year", "month").alias("ym"))
    placed = interval_join(
        dated, _regimes(spark, sf), by=["district_code"], on="ym", start="ym", until="until", columns=["tier"], block=lambda ym: F.substring(ym, 1, 4)
    )
    return placed.groupBy("district_code", "tier").agg(F.count(F.lit(1)).alias("leases"), F.sum("deposit").alias("deposits"))
