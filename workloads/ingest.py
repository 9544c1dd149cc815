"""Cleaning, reshaping, landed responses and incremental loads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from hearthpanel.functions import numeric, periods, regions
from hearthpanel.operators import aggregates as agg
from hearthpanel.operators import contracts as con
from hearthpanel.operators import joins, reshape, scope
from hearthpanel.plans.load import Partials, Target, load
from hearthpanel.plans.panel import build_panel
from hearthpanel.sources import catalogue, csv_files, landed
from hearthpanel.streaming import incremental as inc
from workloads import tables as t
from workloads.panel import FACTS, GRAINS, PANEL_YEARLY
from workloads.registry import query

# ---- cleaning ---------------------------------------------------------------


@query(
    "clean_amount",
    """SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS amount,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS from_mixed FROM orders""",
)
def clean_amount(spark, sf):
    orders = t.table(spark, sf, "orders")
    text = F.format_number(F.floor("o_totalprice"), 0)
    dirty = F.concat(F.lit(' "'), text, F.lit('" '))
    mixed = F.when(F.col("o_orderkey") % 5 == 0, F.concat(text, F.lit(".5"))).otherwise(dirty)
    return orders.select(
        "o_orderkey", numeric.clean_amount(dirty).alias("amount"), numeric.clean_amount(mixed).alias("from_mixed")
    )


SEGMENTS = {"AUTOMOBILE": "AUTO", "BUILDING": "BUILD", "FURNITURE": "FURN", "HOUSEHOLD": "HOUSE", "MACHINERY": "MACH"}
_SHORT_SQL = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENTS.items()) + " END"


@query(
    "normalize_region",
    f"""SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN 'ELSEWHERE' ELSE {_SHORT_SQL} END AS region FROM customer""",
)
def normalize_region(spark, sf):
    segment = F.col("c_mktsegment")
    short = regions.lookup(SEGMENTS, segment)
    spelled = (
        F.when(F.col("c_custkey") % 5 == 0, segment)
        .when(F.col("c_custkey") % 5 == 1, short)
        .when(F.col("c_custkey") % 5 == 2, F.concat(F.lit(" NEW "), short, F.lit(" CITY ")))
        .when(F.col("c_custkey") % 5 == 3, F.substring(segment, 1, 6))
        .otherwise(F.lit("ELSEWHERE"))
    )
    return t.table(spark, sf, "customer").select("c_custkey", regions.short_province(spelled, SEGMENTS).alias("region"))


@query(
    "period_and_code",
    """SELECT o_orderkey, lpad(CAST(o_custkey % 1000 AS VARCHAR), 5, '0') AS code, strftime(o_orderdate, '%Y-%m') AS ym,
  CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders""",
)
def period_and_code(spark, sf):
    orders = t.table(spark, sf, "orders")
    compact = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMM")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM")
    )
    shaped = orders.select(
        "o_orderkey", periods.pad_code(F.col("o_custkey") % 1000).alias("code"), periods.ym_from_compact(compact).alias("ym")
    )
    return shaped.withColumns({"year": periods.year_of("ym"), "month": periods.month_of("ym")})


@query(
    "prefer_value",
    """SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'""",
)
def prefer_value(spark, sf):
    orders = t.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return scope.prefer_value(orders, "o_orderpriority", ["0-NONE", "4-NOT SPECIFIED", "5-LOW"])


# ---- reshape ----------------------------------------------------------------

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_FIRST = ", ".join(
    f"""min_by(o_totalprice, o_orderkey) FILTER (o_orderpriority = '{p}') AS "{p}\"""" for p in PRIORITIES
)
_SUM = ", ".join(
    f"""CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) FILTER (o_orderpriority = '{p}') AS BIGINT) AS "{p}\""""
    for p in PRIORITIES
)


@query("pivot_first", f"SELECT strftime(o_orderdate, '%Y-%m') AS ym, {_FIRST} FROM orders GROUP BY ym")
def pivot_first(spark, sf):
    long = t.table(spark, sf, "orders").withColumn("ym", F.date_format("o_orderdate", "yyyy-MM"))
    return reshape.pivot_series(
        long, keys=["ym"], names="o_orderpriority", values=PRIORITIES, value="o_totalprice", seq="o_orderkey"
    )


@query("pivot_series", f"SELECT strftime(o_orderdate, '%Y-%m') AS ym, {_SUM} FROM orders GROUP BY ym")
def pivot_series(spark, sf):
    long = t.table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("ym"),
        "o_orderpriority",
        F.floor("o_totalprice").cast("bigint").alias("amount"),
    )
    return reshape.pivot_series(long, keys=["ym"], names="o_orderpriority", values=PRIORITIES, value="amount", agg="sum")


@query(
    "unpivot_wide",
    """SELECT l_orderkey, l_linenumber, l_partkey, 'l_discount' AS series, l_discount AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax', l_tax FROM lineitem""",
)
def unpivot_wide(spark, sf):
    lines = t.table(spark, sf, "lineitem")
    return reshape.unpivot_wide(lines, ids=["l_orderkey", "l_linenumber", "l_partkey"], columns=["l_discount", "l_tax"])


@query(
    "latest_per_key",
    "SELECT o_custkey, max(o_orderkey) AS o_orderkey, max_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey",
)
def latest_per_key(spark, sf):
    orders = t.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return reshape.keep_latest(orders, ["o_custkey"], "o_orderkey")


@query(
    "first_per_key",
    "SELECT o_custkey, min(o_orderkey) AS o_orderkey, min_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey",
)
def first_per_key(spark, sf):
    orders = t.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return reshape.keep_first(orders, ["o_custkey"], F.col("o_orderkey"))


@query(
    "semi_join",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def semi_join(spark, sf):
    wanted = t.table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey")
    return joins.semi_by(t.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), wanted, ["o_custkey"])


_AGE = "CAST(o_orderkey % 22 * 5 AS VARCHAR)"
_SEX = "CASE o_orderkey % 3 WHEN 0 THEN 'total' WHEN 1 THEN 'male' ELSE 'female' END"
_AGE_COLUMNS = {"population": (["0"], "total"), "population_male": (["0"], "male"), "population_female": (["0"], "female")}
for _decade, _codes in reshape.AGE_DECADES.items():
    for _sex, _prefix in reshape.SEX_PREFIX.items():
        _AGE_COLUMNS[f"{_prefix}{_decade}"] = (_codes, _sex)
_AGE_SQL = ", ".join(
    f"CAST(sum(deposit) FILTER ({_AGE} IN ({', '.join(repr(c) for c in codes)}) AND {_SEX} = '{sex}') AS BIGINT) AS {name}"
    for name, (codes, sex) in _AGE_COLUMNS.items()
)


@query(
    "age_pivot",
    f"""WITH {t.LEASES} SELECT district_code, substr(district_code, 1, 2) AS province_code, province, year, {_AGE_SQL}
FROM leases GROUP BY district_code, province, year""",
)
def age_pivot(spark, sf):
    key = F.col("o_orderkey")
    long = t.leases(spark, sf).select(
        "district_code",
        F.col("district_code").alias("district_name"),
        F.substring("district_code", 1, 2).alias("province_code"),
        "province",
        "year",
        (key % 22 * 5).cast("string").alias("age_code"),
        F.when(key % 3 == 0, "total").when(key % 3 == 1, "male").otherwise("female").alias("sex"),
        F.col("deposit").alias("people"),
    )
    return reshape.age_pivot(long, level="district").drop("district_name")


@query(
    "pension_rollup",
    f"""WITH {t.LEASES}
SELECT district_code, CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS ym,
  CAST(sum(o_orderkey % 50) AS DOUBLE) AS pension_subscribers, CAST(sum(deposit) AS DOUBLE) AS pension_billed,
  count(*) AS pension_workplaces, CAST(sum(o_orderkey % 7) - sum(o_orderkey % 5) AS DOUBLE) AS pension_net_hires,
  CASE WHEN sum(o_orderkey % 50) > 0 THEN CAST(sum(deposit) AS DOUBLE) / sum(o_orderkey % 50) END AS pension_per_head
FROM leases GROUP BY district_code, year, month""",
)
def pension_rollup(spark, sf):
    key = F.col("o_orderkey")
    raw = t.leases(spark, sf).select(
        F.when(key % 2 == 0, F.format_string("%d%02d", "year", "month"))
        .otherwise(F.format_string("%d-%02d", "year", "month"))
        .alias("period"),
        F.substring("district_code", 1, 2).alias("province_part"),
        F.substring("district_code", 3, 3).cast("int").cast("string").alias("district_part"),
        (key % 50).cast("string").alias("subscribers"),
        F.format_number("deposit", 0).alias("billed"),
        (key % 7).cast("string").alias("hired"),
        (key % 5).cast("string").alias("left"),
    )
    return agg.pension_rollup(csv_files.shape_workplaces(raw))


# ---- landed responses -------------------------------------------------------


def _tag(name: str, value) -> list:
    return [F.lit(f"<{name}>"), value, F.lit(f"</{name}>")]


@query(
    "xml_rows",
    f"""WITH {t.LEASES}
SELECT province, district_code, year, month, avg(deposit) AS avg_deposit, count(*) AS lease_count, avg(rent) AS avg_rent
FROM leases WHERE deposit > 0 AND o_orderkey % 10 <> 3 GROUP BY province, district_code, year, month""",
)
def xml_rows(spark, sf):
    """Each lease as one landed response; every tenth response is an error."""
    leases = t.leases(spark, sf)
    fields = {
        "년": F.col("year").cast("string"),
        "월": F.col("month").cast("string"),
        "지역코드": F.col("district_code"),
        "전용면적": F.col("area").cast("string"),
        "보증금": F.format_number("deposit", 0),
        "월세": F.col("rent").cast("string"),
    }
    item = [part for name, value in fields.items() for part in _tag(name, F.concat(F.lit(" "), value))]
    code = F.when(F.col("o_orderkey") % 10 == 3, "22").otherwise("000")
    body = F.concat(
        F.lit("<response><header>"), *_tag("resultCode", code), F.lit("</header><body><items><item>"), *item, F.lit("</item></items></body></response>")
    )
    responses = landed.with_result_code(leases.select("province", body.alias("value")))
    rows = landed.xml_rows(responses, list(fields), keep=["province"])
    shaped = landed.lease_rows(rows)
    typed = csv_files._renamed(shaped, csv_files.LEASE_COLUMNS)
    from hearthpanel.operators.contracts import lease_rollup, type_leases

    # Districts of the test tables have no national code, so the province comes from the register.
    names = t.regions(spark, sf).select("district_code", "province")
    located = type_leases(typed).drop("province").join(names, "district_code")
    out = lease_rollup(located, kind="all_leases")
    return out.select("province", "district_code", "year", "month", "avg_deposit", "lease_count", "avg_rent")


@query(
    "bank_series",
    f"""WITH {t.LEASES}
SELECT CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS ym, year, month,
  min_by(CAST(deposit AS DOUBLE), o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS base_rate,
  min_by(CAST(deposit AS DOUBLE), o_orderkey) FILTER (o_orderpriority = '5-LOW') AS cd_91d
FROM leases WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY year, month""",
)
def bank_series(spark, sf):
    leases = t.leases(spark, sf)
    row = F.struct(
        F.format_string("%d%02d", "year", "month").alias("TIME"),
        F.format_number("deposit", 0).alias("DATA_VALUE"),
        F.lit("").alias("ITEM_NAME1"),
    )
    text = F.to_json(F.struct(F.struct(F.array(row).alias("row")).alias("StatisticSearch")))
    name = F.when(F.col("o_orderpriority") == "1-URGENT", "base_rate").when(F.col("o_orderpriority") == "5-LOW", "cd_91d")
    responses = leases.select("o_orderkey", name.alias("name"), text.alias("value"))
    parsed = responses.filter("name IS NOT NULL").select(
        "o_orderkey", "name", F.from_json("value", landed.BANK_SCHEMA)["StatisticSearch"].alias("StatisticSearch")
    )
    rows = landed.bank_rows(parsed, series=F.col("name"), seq=F.col("o_orderkey"))
    return landed.curate_national(rows, ["base_rate", "cd_91d"])


@query(
    "list_income",
    f"""WITH {t.LEASES}, i AS (
  SELECT 'A' || lpad(CAST(1 + o_orderkey % 18 AS VARCHAR), 2, '0') || '01' AS district_code, year, o_orderkey % 4 AS slot, deposit, o_orderkey FROM leases),
w AS (SELECT district_code, year, min_by(deposit, o_orderkey) FILTER (slot = 0) AS earners, min_by(deposit, o_orderkey) FILTER (slot = 1) AS pay_total,
    min_by(deposit, o_orderkey) FILTER (slot = 2) AS taxpayers, min_by(deposit, o_orderkey) FILTER (slot = 3) AS tax_total
  FROM i GROUP BY district_code, year)
SELECT district_code, year, CAST(earners AS DOUBLE) AS earners, CAST(pay_total AS DOUBLE) AS pay_total,
  CASE WHEN earners > 0 THEN CAST(pay_total AS DOUBLE) / earners END AS pay_per_head,
  CASE WHEN taxpayers > 0 THEN CAST(tax_total AS DOUBLE) / taxpayers END AS tax_per_head
FROM w WHERE substr(district_code, 1, 3) <> 'A18'""",
)
def list_income(spark, sf):
    key = F.col("o_orderkey")
    region = F.concat(F.lit("A"), F.lpad((key % 18 + 1).cast("string"), 2, "0"), F.lit("01"))
    raw = t.leases(spark, sf).select(
        F.col("year").cast("string").alias("PRD_DE"),
        F.format_number("deposit", 0).alias("DT"),
        region.alias("C1"),
        region.alias("C1_NM"),
        F.when(key % 4 < 2, "B02").otherwise("B04").alias("C2"),
        F.lit("x").alias("C2_NM"),
        F.when(key % 2 == 0, "T001").otherwise("T002").alias("ITM_ID"),
        F.lit("x").alias("ITM_NM"),
        key.alias("o_orderkey"),
    )
    rows = landed.list_rows(raw).withColumn("seq", F.col("o_orderkey"))
    return landed.curate_income(rows).select("district_code", "year", "earners", "pay_total", "pay_per_head", "tax_per_head")


# ---- incremental loads ------------------------------------------------------

_EARLY = "ym <= '1999-06'"


@query(
    "incremental_merge",
    f"""WITH {t.SALES_ROLLUP} SELECT province, district_code, ym, avg_price, deal_count FROM sales_rollup""",
)
def incremental_merge(spark, sf):
    """Half the history with stale last months, plus an increment: the full rollup again."""
    full = t.rolled_sales(spark, sf).select("province", "district_code", "ym", "avg_price", "deal_count")
    target = full.filter(_EARLY).withColumn("deal_count", F.when(F.col("ym") > "1999-01", F.lit(0)).otherwise(F.col("deal_count")))
    increment = full.filter("ym > '1999-01'")
    return inc.merge_increment(target, increment, ["province", "district_code", "ym"])


_LOADED = ("province", "district_code", "year", "ym", "deal_count")


def _shared(spark):
    """The folder that all executors see; a temporary one only where there is a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="hearthpanel-")


def _loads(spark, sf, *ends):
    """The rollup loaded in steps into a new folder: reports of the loads, and the table as it is then."""
    landed = t.rolled_sales(spark, sf).select(*_LOADED)
    target = Target("sales", f"{_shared(spark)}/load-{uuid.uuid4().hex}", ["district_code", "ym"])
    reports = [load(spark, target, landed, end=end).collect() for end in ends]
    return reports, spark.read.schema(landed.schema).parquet(target.path)


@query("load_twice", f"""WITH {t.SALES_ROLLUP} SELECT province, district_code, year, ym, deal_count FROM sales_rollup""")
def load_twice(spark, sf):
    """Half the months, the rest, and the rest again: every row once."""
    return _loads(spark, sf, "1998-06", "2001-12", "2001-12")[1]


@query(
    "report_totals",
    f"""WITH {t.SALES_ROLLUP} SELECT 2 AS loaded, 0 AS failed, 1 AS skipped, count(*) AS added_rows FROM sales_rollup""",
)
def report_totals(spark, sf):
    reports, _ = _loads(spark, sf, "1998-06", "2001-12", "2001-12")
    kinds = "table string, rows long, regions long, first_period string, last_period string, period_before string, added_rows long, status string"
    return inc.report_totals(spark.createDataFrame([tuple(r) for rows in reports for r in rows], kinds))


# Order and line do not tell all contracts apart in the test tables.
_CONTRACT = ["l_orderkey", "l_linenumber", "l_suppkey", "l_discount", "l_tax", "area", "month", "year"]


def _contract_loads(spark, sf, partials):
    """Contracts loaded in three steps; the last year of a step comes again in the next and replaces what was stale.

    Returns the states as the loads left them.
    """
    whole = t.sales(spark, sf, detail=True).select(*_CONTRACT, "province", "district_code", "amount", "build_year")
    landed = whole.withColumn("ym", periods.year_month("year", "month"))
    odd = F.col("l_orderkey") % 3
    stale = landed.withColumns(
        {
            "amount": F.when(odd == 0, F.col("amount") + 1000).when(odd == 1, F.lit(0)).otherwise(F.col("amount")),
            "build_year": F.when(odd == 2, F.col("build_year") - 1).otherwise(F.col("build_year")),
        }
    )
    root = f"{_shared(spark)}/load-{uuid.uuid4().hex}"
    held = Partials(f"{root}/states", **partials)
    target = Target("contracts", f"{root}/contracts", _CONTRACT, grain="year", period="year", partials=(held,))
    late = F.col("year") >= 1996
    load(spark, target, landed.filter(~late).unionByName(stale.filter(late)), end="1996")
    load(spark, target, landed, end="1997")
    load(spark, target, landed, end="2100")
    return held.read(spark, landed)


@query(
    "rollup_delta",
    f"""WITH {t.SALES_ROLLUP}
SELECT province, district_code, year, month, ym, avg_price, deal_count, round(avg_unit_price, 6) AS avg_unit_price FROM sales_rollup""",
)
def rollup_delta(spark, sf):
    """Rollups brought up to date by what each load adds and replaces equal those of a full rebuild."""
    base = _contract_loads(spark, sf, {"keys": [*con.SALE_KEYS, "build_year"], "states": con.SALE_STATES, "rows": con.sales_rows})
    return con.rollup_from_base(base).withColumn("avg_unit_price", F.round("avg_unit_price", 6))


@query(
    "rollup_delta_detail",
    f"""WITH {t.SALES}
SELECT province, district_code, year, month, build_year, avg(amount) AS avg_price, count(*) AS deal_count,
       avg(CASE WHEN year - build_year >= 0 THEN year - build_year END) AS avg_building_age
FROM sales WHERE amount > 0 AND area > 0 GROUP BY province, district_code, year, month, build_year""",
)
def rollup_delta_detail(spark, sf):
    base = _contract_loads(spark, sf, {"keys": [*con.SALE_KEYS, "build_year"], "states": con.SALE_STATES, "rows": con.sales_rows})
    return con.rollup_from_base(base, detail=True).drop("ym", "avg_unit_price")


@query(
    "rollup_sketches",
    f"""WITH {t.SALES}
SELECT district_code, year, count(*) AS n, avg(amount) AS avg_price, min(amount) AS least, max(amount) AS most,
  CAST(quantile_disc(amount, 0.25) AS DOUBLE) AS lower, CAST(quantile_disc(amount, 0.5) AS DOUBLE) AS middle,
  CAST(quantile_disc(amount, 0.75) AS DOUBLE) AS upper, count(DISTINCT build_year) AS build_years
FROM sales WHERE amount > 0 AND area > 0 GROUP BY district_code, year""",
)
def rollup_sketches(spark, sf):
    """Quartiles and distinct counts of district years from the sketches of their months, kept up by loads."""
    held = _contract_loads(spark, sf, {"keys": con.SALE_KEYS, "states": con.SKETCH_STATES, "rows": con.sales_rows})
    return con.price_spread(held, ["district_code", "year"])


@query(
    "month_range",
    f"""WITH {t.SALES_ROLLUP}, b AS (SELECT min(ym) AS a, max(ym) AS z FROM sales_rollup)
SELECT strftime(unnest(generate_series(CAST(a || '-01' AS DATE), CAST(z || '-01' AS DATE), INTERVAL 1 MONTH)), '%Y-%m') AS ym FROM b""",
)
def month_range(spark, sf):
    bounds = t.rolled_sales(spark, sf).agg(F.min("ym").alias("a"), F.max("ym").alias("z")).first()
    return inc.month_range(spark, bounds.a, bounds.z)


@query(
    "new_rows",
    f"""WITH {t.SALES_ROLLUP} SELECT district_code, ym, deal_count FROM sales_rollup WHERE ym > '1999-06'""",
)
def new_rows(spark, sf):
    full = t.rolled_sales(spark, sf).select("district_code", "ym", "deal_count")
    return inc.new_rows(full.filter(_EARLY), full)


@query("incremental_plan", f"""WITH {t.SALES_ROLLUP} SELECT max(ym) AS high_water FROM sales_rollup""")
def incremental_plan(spark, sf):
    return inc.high_water_mark(t.rolled_sales(spark, sf))


@query(
    "ledger_pending",
    f"""WITH {t.SALES_ROLLUP}
SELECT d.district_code, m.ym FROM (SELECT DISTINCT district_code FROM regions) d, (SELECT DISTINCT ym FROM sales_rollup) m
WHERE NOT EXISTS (SELECT 1 FROM sales_rollup s WHERE s.district_code = d.district_code AND s.ym = m.ym AND s.deal_count >= 30)""",
)
def ledger_pending(spark, sf):
    rollup = t.rolled_sales(spark, sf)
    done = rollup.filter("deal_count >= 30").select("district_code", "ym")
    return inc.pending_pairs(t.regions(spark, sf), rollup.select("ym").distinct(), done)


@query(
    "load_report",
    f"""WITH {t.SALES_ROLLUP}
SELECT 'sales' AS "table", count(*) AS rows, count(DISTINCT province) AS regions, min(ym) AS first_period, max(ym) AS last_period,
  max(ym) FILTER ({_EARLY}) AS period_before, count(*) - count(*) FILTER ({_EARLY}) AS added_rows, 'loaded' AS status FROM sales_rollup""",
)
def load_report(spark, sf):
    full = t.rolled_sales(spark, sf)
    before = inc.table_profile(full.filter(_EARLY), name="sales")
    return inc.load_report(before, inc.table_profile(full, name="sales"))


@query(
    "range_violations",
    f"""WITH {PANEL_YEARLY}
SELECT 'deposit_ratio' AS variable, CAST(count(*) FILTER (deposit_ratio < 40 OR deposit_ratio > 80) AS BIGINT) AS violations FROM panel
UNION ALL SELECT 'moved_in', CAST(count(*) FILTER (moved_in < 0) AS BIGINT) FROM panel""",
)
def range_violations(spark, sf):
    sources = t.panel_sources(spark, sf)
    panel = build_panel({k: sources[k] for k in ("sales", "deposit_only", "migration")})
    return catalogue.range_violations(panel).filter(F.col("variable").isin("deposit_ratio", "moved_in"))


@query(
    "unsold_sum",
    f"""WITH {FACTS}, {GRAINS} SELECT province, year, CAST(sum(done_n) AS BIGINT) AS unsold FROM by_month GROUP BY province, year""",
)
def unsold_sum(spark, sf):
    return agg.sum_by(t.indicators(spark, sf)["unsold"], ["province", "year"], "unsold")
