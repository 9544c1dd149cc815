"""Files on disk and back: contracts, wide statistics, indicators, registers, responses, rollup tables and exports.

Each query writes the contracts' figures in the layout of a source to the
shared folder and reads them with the reader of that source.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hearthpanel.operators import joins, scope
from hearthpanel.operators.contracts import lease_rollup, sales_rollup, type_leases, type_sales
from hearthpanel.sources import csv_files, landed, sinks, specs
from workloads import tables as t
from workloads.ingest import _shared
from workloads.registry import query
from workloads.series import NAMED, _named

YEARS = tuple(range(1995, 2002))


def _folder(spark, name):
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(df, header: str, path: str, *, mode: str = "overwrite") -> None:
    """Rows of one text column as CSV lines under a header; nothing is quoted on the way."""
    df.toDF(header).write.mode(mode).options(header=True, sep="\u0001", encoding="UTF-8").csv(path)


def _csv(df, path: str, *, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(header=True, encoding="UTF-8").csv(path)


# ---- contracts --------------------------------------------------------------


def _sale_files(spark, sf):
    """Half the sales in one column order, half in another with a column more."""
    rows = t.sales(spark, sf, detail=True)
    values = {
        "year": F.col("year"), "month": F.col("month"), "district_code": F.col("district_code"), "area": F.col("area"),
        "build_year": F.col("build_year"), "amount": F.format_number("amount", 0),
    }
    named = [values[name].alias(raw) for raw, name in csv_files.SALE_COLUMNS.items()]
    root = _folder(spark, "sales")
    odd = F.col("l_orderkey") % 2 == 1
    _csv(rows.filter(~odd).select(*named), f"{root}/a")
    _csv(rows.filter(odd).select(F.lit("역삼동").alias("법정동"), *reversed(named)), f"{root}/b")
    return [f"{root}/a", f"{root}/b"]


def _located(spark, sf, typed):
    """Districts of the test tables have no national code, so the province comes from the register."""
    return typed.drop("province").join(t.regions(spark, sf).select("district_code", "province"), "district_code")


@query(
    "sale_files",
    f"WITH {t.SALES_ROLLUP} SELECT province, district_code, ym, avg_price, deal_count FROM sales_rollup",
)
def sale_files(spark, sf):
    typed = type_sales(csv_files.scan_sales(spark, _sale_files(spark, sf)))
    return sales_rollup(_located(spark, sf, typed)).select("province", "district_code", "ym", "avg_price", "deal_count")


@query(
    "lease_files",
    f"""WITH {t.LEASES}, {t.lease_rollup_sql("monthly_rent", t.LEASE_WHERE["monthly_rent"])}
SELECT province, district_code, ym, avg_deposit, lease_count, avg_rent FROM monthly_rent""",
)
def lease_files(spark, sf):
    values = {
        "year": F.col("year"), "month": F.col("month"), "district_code": F.col("district_code"), "area": F.col("area"),
        "deposit": F.format_number("deposit", 0), "rent": F.format_number("rent", 0),
    }
    path = _folder(spark, "leases")
    _csv(t.leases(spark, sf).select(*(values[name].alias(raw) for raw, name in csv_files.LEASE_COLUMNS.items())), path)
    rolled = lease_rollup(_located(spark, sf, type_leases(csv_files.scan_leases(spark, path))), kind="monthly_rent")
    return rolled.select("province", "district_code", "ym", "avg_deposit", "lease_count", "avg_rent")


@query(
    "landed_lines",
    f"""WITH {t.SALES}
SELECT unnest(['lines', 'skipped', 'short', 'rows', 'rejects']) AS kind, unnest([count(*), count(*) FILTER (l_orderkey % 50 = 0),
  count(*) FILTER (l_orderkey % 50 = 1), count(*) FILTER (l_orderkey % 50 <> 0), count(*) FILTER (l_orderkey % 50 = 0)]) AS n FROM sales""",
)
def landed_lines(spark, sf):
    """Lines of which some have two fields too many and some too few: what landed, what was left out, and the counts of the scan."""
    key = F.col("l_orderkey") % 50
    first = [F.col(c).cast("string") for c in ("year", "month", "district_code")]
    rest = [F.col(c).cast("string") for c in ("area", "build_year", "amount")]
    line = F.when(key == 0, F.concat_ws(",", *first, *rest, F.lit("x"), F.lit("y"))).when(key == 1, F.concat_ws(",", *first))
    path = _folder(spark, "lines")
    _lines(t.sales(spark, sf, detail=True).select(line.otherwise(F.concat_ws(",", *first, *rest))), ",".join(csv_files.SALE_COLUMNS), path)
    got = csv_files.land_contracts(spark, path, csv_files.SALE_COLUMNS, _folder(spark, "landed"))
    counted = spark.createDataFrame([("lines", got.lines), ("skipped", got.skipped), ("short", got.short)], "kind string, n long")
    sides = [df.groupBy(F.lit(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")) for kind, df in (("rows", got.rows), ("rejects", got.rejects))]
    return counted.unionByName(sides[0]).unionByName(sides[1])


# ---- wide statistics --------------------------------------------------------


def _yearly(spark, sf, value):
    rows = _named(spark, sf)
    return rows.groupBy("full", "code").pivot("year", list(YEARS)).agg(value)


_COUNTS = "counts AS (SELECT province, year, count(*) AS n, CAST(sum(deposit) AS BIGINT) AS total FROM named GROUP BY province, year)"


@query(
    "population_files",
    f"""WITH {NAMED}, {_COUNTS}
SELECT province, year, CASE WHEN year <= 1998 THEN n ELSE n + 1 END AS population, n // 2 AS population_male, n - n // 2 AS population_female FROM counts""",
)
def population_files(spark, sf):
    """Two wide files, of which the first one's years count; districts below the provinces and totals are left out."""
    wide = _yearly(spark, sf, F.count(F.lit(1))).na.fill(0)
    region = F.concat("full", F.lit(" ("), "code", F.lit("00000000)"))
    below = F.concat("full", F.lit(" 어느구 ("), "code", F.lit("11000000)"))
    paths = []
    for last, more in ((1998, 0), (2001, 1)):
        cells = []
        for y in YEARS:
            n = F.col(f"`{y}`")
            half = F.floor(n / 2)
            texts = {"계": n + more, "남": half, "여": n - half}
            cells += [F.format_number(v.cast("long"), 0).alias(f"{y}년_{k}_총인구수") for k, v in texts.items() if y <= last]
        path = _folder(spark, "population")
        names = wide.select(region.alias("행정구역"), *cells).unionByName(wide.select(below.alias("행정구역"), *cells))
        _csv(names.unionByName(wide.limit(1).select(F.lit("전국").alias("행정구역"), *cells)), path)
        paths.append(path)
    return csv_files.read_population(spark, paths).filter("population > 1")


@query(
    "product_file",
    f"WITH {NAMED}, {_COUNTS} SELECT province, CAST(year AS INTEGER) AS year, total AS grdp FROM counts",
)
def product_file(spark, sf):
    """Two header rows; every second column is a year, a dash is no value."""
    wide = _yearly(spark, sf, F.sum("deposit"))
    cells = [F.coalesce(F.concat(F.lit('"'), F.format_number(F.col(f"`{y}`"), 0), F.lit('",0')), F.lit("-,0")) for y in YEARS]
    lines = [
        wide.select(F.lit(2).alias("place"), F.concat_ws(",", F.col("full"), F.lit(part), *cells).alias("line")) for part in ("소계", "제조업")
    ]
    heads = [(0, ",".join(["지역", "구분", *(f"{y},{y}" for y in YEARS)])), (1, ",".join(["지역", "구분", *(["명목,실질"] * len(YEARS))]))]
    path = _folder(spark, "product")
    # One row per province: the file is as short as the list of provinces, and its head has to come first.
    lines = spark.createDataFrame(heads, "place int, line string").unionByName(lines[0]).unionByName(lines[1])
    lines.coalesce(1).sortWithinPartitions("place").select("line").write.text(path)
    return csv_files.read_grdp(spark, path)


@query(
    "permit_file",
    f"""WITH {NAMED} SELECT province, year, month, ym, count(*) AS permits FROM named GROUP BY province, year, month, ym""",
)
def permit_file(spark, sf):
    """A column a month; sums of other rows go, and apartments count only where no household rows are."""
    months = [(y, m) for y in YEARS for m in range(1, 13)]
    rows = _named(spark, sf).withColumn("cell", F.format_string("%d.%d월", "year", "month"))
    wide = rows.groupBy("full").pivot("cell", [f"{y}.{m}월" for y, m in months]).agg(F.count(F.lit(1)))
    cells = [F.col(f"`{y}.{m}월`") for y, m in months]
    parts = [
        wide.select(name.alias("시도명"), F.lit("아파트").alias("대분류"), F.lit(minor).alias("소분류"), *cells)
        for name, minor in ((F.col("full"), "가구수"), (F.col("full"), "동수"), (F.lit("수도권"), "가구수"))
    ]
    path = _folder(spark, "permits")
    _csv(parts[0].unionByName(parts[1]).unionByName(parts[2]), path)
    return csv_files.read_permits(spark, path)


@query(
    "age_file",
    f"""WITH {NAMED} SELECT province, year, count(*) FILTER (k % 3 = 0) AS age_20s, count(*) FILTER (k % 3 = 1) AS male_age_30s FROM named GROUP BY province, year""",
)
def age_file(spark, sf):
    """Rows without a year and columns of no use are left out."""
    key = F.col("o_orderkey") % 3
    counted = _named(spark, sf).groupBy(F.col("short").alias("시도"), F.col("year").cast("string").alias("연도")).agg(
        F.format_number(F.count_if(key == 0), 0).alias("20대"), F.count_if(key == 1).alias("남_30대"), F.lit("x").alias("총인구")
    )
    path = _folder(spark, "ages")
    _csv(counted.unionByName(counted.withColumn("연도", F.lit("미상"))), path)
    return csv_files.read_age_population(spark, path)


# ---- indicators -------------------------------------------------------------


def _monthly(spark, sf, *columns):
    keys = [F.col("year").alias("연도"), F.col("month").alias("월"), F.format_string("%d-%02d", "year", "month").alias("연월")]
    return _named(spark, sf).groupBy(F.col("full").alias("시도"), *keys).agg(*columns)


@query(
    "pension_file",
    f"""WITH {t.LEASES}
SELECT CAST(11000 + CAST(district_code AS INTEGER) AS VARCHAR) AS district_code, '서울' AS province, year, month, CAST(count(*) AS DOUBLE) AS pension_subscribers,
  CAST(sum(deposit) AS DOUBLE) AS pension_billed FROM leases GROUP BY district_code, year, month""",
)
def pension_file(spark, sf):
    """Provinces come from the district codes."""
    code = F.col("district_code").cast("int") + 11000
    rows = t.leases(spark, sf).groupBy(code.alias("지역코드"), F.col("year").alias("연도"), F.col("month").alias("월"))
    path = _folder(spark, "pension")
    _csv(rows.agg(F.count(F.lit(1)).alias("NPS_가입자수"), F.format_number(F.sum("deposit"), 0).alias("NPS_고지금액합계")), path)
    return csv_files.read_pension(spark, path)


@query(
    "indicator_file",
    f"""WITH {NAMED}
SELECT province, year, month, ym, CAST(count(*) FILTER (k % 2 = 0) AS DOUBLE) AS moved_in, CAST(count(*) FILTER (k % 2 = 1) AS DOUBLE) AS moved_out,
  CAST(count(*) FILTER (k % 2 = 0) - count(*) FILTER (k % 2 = 1) AS DOUBLE) AS net_moved FROM named GROUP BY province, year, month, ym""",
)
def indicator_file(spark, sf):
    """The migration table by its other name; the nation's rows go."""
    even = F.col("o_orderkey") % 2 == 0
    rows = _monthly(spark, sf, F.count_if(even).alias("전입"), F.count_if(~even).alias("전출")).withColumn("순이동", F.col("전입") - F.col("전출"))
    path = _folder(spark, "migration")
    _csv(rows.unionByName(rows.withColumn("시도", F.lit("전국"))), path)
    return specs.read_indicator(spark, "population_migration", path)


@query(
    "national_file",
    f"""WITH {NAMED}
SELECT year, month, ym, CAST(count(*) AS DOUBLE) AS base_rate, CAST(CASE WHEN month <> 3 THEN count(*) FILTER (k % 2 = 0) END AS DOUBLE) AS cd_91d
FROM named GROUP BY year, month, ym""",
)
def national_file(spark, sf):
    """Blank cells are no values, and columns that the file lacks are left out."""
    rows = _monthly(spark, sf, F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderkey") % 2 == 0).alias("even"))
    totals = rows.groupBy("연도", "월", "연월").agg(F.sum("n").alias("기준금리"), F.sum("even").alias("even"))
    path = _folder(spark, "rates")
    _csv(totals.select("연도", "월", "연월", "기준금리", F.when(F.col("월") != 3, F.col("even")).alias("CD_91일")), path)
    return specs.read_indicator(spark, "rates", path)


@query(
    "policy_file",
    """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS event_date, o_orderpriority AS category, CAST(o_orderkey AS VARCHAR) AS event_name FROM orders""",
)
def policy_file(spark, sf):
    orders = t.table(spark, sf, "orders")
    path = _folder(spark, "policy")
    _csv(
        orders.select(
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("날짜"), F.col("o_orderpriority").alias("카테고리"), F.col("o_orderkey").alias("이벤트명")
        ),
        path,
    )
    return specs.read_indicator(spark, "policy_events", path).withColumn("event_date", F.col("event_date").cast("string"))


@query(
    "district_register",
    """SELECT CAST(10000 + c_custkey % 1000 AS VARCHAR) AS district_code FROM customer WHERE c_custkey % 5 <> 0 GROUP BY ALL""",
)
def district_register(spark, sf):
    """Codes of regions that still exist, each once."""
    key = F.col("c_custkey")
    status = F.when(key % 5 == 0, "폐지").otherwise("존재")
    register = t.table(spark, sf, "customer").select(
        F.concat((key % 1000 + 10000).cast("string"), F.lpad((key % 7).cast("string"), 5, "0")).alias("법정동코드"), F.col("c_name").alias("법정동명"), status.alias("폐지여부")
    )
    path = _folder(spark, "register")
    _csv(register, path)
    return csv_files.read_district_codes(spark, path, encoding="UTF-8")


# ---- responses --------------------------------------------------------------


@query(
    "item_files",
    f"""WITH {t.LEASES}
SELECT province, district_code, year, month, avg(deposit) AS avg_deposit, count(*) AS lease_count, avg(rent) AS avg_rent
FROM leases WHERE deposit > 0 AND o_orderkey % 10 <> 3 AND o_orderkey % 10 <> 4 GROUP BY province, district_code, year, month""",
)
def item_files(spark, sf):
    """Many items to a file, split over tasks; files with an error code and items that are no XML give no contracts."""
    tags = {
        "년": F.col("year").cast("string"), "월": F.col("month").cast("string"), "지역코드": F.col("district_code"),
        "전용면적": F.col("area").cast("string"), "보증금": F.format_number("deposit", 0), "월세": F.col("rent").cast("string"),
    }
    parts = [part for tag, text in tags.items() for part in (F.lit(f"<{tag}> "), text, F.lit(f"</{tag}>\n"))]
    last = F.col("o_orderkey") % 10
    broken = F.when(last == 4, "<연장>").otherwise("")
    item = F.concat(F.lit("<item>\n"), *parts, broken, F.lit("</item>"))
    error = F.concat(F.lit("<response><header><resultCode>22</resultCode></header>"), item, F.lit("</response>"))
    root = _folder(spark, "items")
    leases = t.leases(spark, sf)
    leases.filter(last != 3).select(item).write.text(f"{root}/good")
    leases.filter(last == 3).select(error).write.text(f"{root}/error")
    items = landed.read_items(spark, [f"{root}/good", f"{root}/error"], list(tags)).filter("malformed IS NULL")
    typed = type_leases(csv_files._renamed(landed.lease_rows(items), csv_files.LEASE_COLUMNS))
    out = lease_rollup(_located(spark, sf, typed), kind="all_leases")
    return out.select("province", "district_code", "year", "month", "avg_deposit", "lease_count", "avg_rent")


# ---- rollup tables and exports ----------------------------------------------


@query("rollup_store", f"WITH {t.SALES_ROLLUP} SELECT province, district_code, year, ym, deal_count FROM sales_rollup WHERE year >= 1997")
def rollup_store(spark, sf):
    """A rollup by year, written once; a year filter reads its own folders."""
    rolled = t.rolled_sales(spark, sf).select("province", "district_code", "year", "ym", "deal_count")
    path = sinks.rollup_path(_folder(spark, "rollups"), "sales")
    sinks.write_rollup(rolled, path)
    if not sinks.is_complete(spark, path):
        raise ValueError(f"{path} is not complete")
    return sinks.read_rollup(spark, path, rolled.schema).filter("year >= 1997")


@query(
    "clustered_rollups",
    f"""WITH {t.SALES_ROLLUP}, {t.LEASES[len(t.REGIONS) + 2:]}, {t.lease_rollup_sql("deposit_only", t.LEASE_WHERE["deposit_only"])}
SELECT s.district_code, s.ym, s.deal_count, d.lease_count, round(d.avg_deposit / s.avg_price * 100, 6) AS deposit_ratio
FROM sales_rollup s JOIN deposit_only d ON s.district_code = d.district_code AND s.ym = d.ym""",
)
def clustered_rollups(spark, sf):
    """Two rollups as tables of buckets, joined bucket by bucket."""
    layout = sinks.Clustering(buckets=8)
    tables = {}
    for kind, df in (("sales", t.rolled_sales(spark, sf)), ("deposits", t.rolled_leases(spark, sf, "deposit_only"))):
        name = f"{kind}_{uuid.uuid4().hex}"
        sinks.write_clustered(df, name, _folder(spark, kind), layout)
        tables[kind] = spark.table(name)
    sold = tables["sales"].select("district_code", "ym", "deal_count", "avg_price")
    let = tables["deposits"].select("district_code", "ym", "lease_count", "avg_deposit")
    both = sold.join(let, ["district_code", "ym"])
    ratio = F.round(F.col("avg_deposit") / F.col("avg_price") * 100, 6).alias("deposit_ratio")
    return both.select("district_code", "ym", "deal_count", "lease_count", ratio)


@query("exported_table", f"WITH {t.SALES_ROLLUP} SELECT province, district_code, ym, deal_count FROM sales_rollup")
def exported_table(spark, sf):
    """A download with byte order mark, read back."""
    path = _folder(spark, "export")
    sinks.export_csv(t.rolled_sales(spark, sf).select("province", "district_code", "ym", "deal_count"), path)
    return csv_files.read_csv_any(spark, path).withColumn("deal_count", F.col("deal_count").cast("bigint"))


# ---- choices ----------------------------------------------------------------


@query(
    "chosen_panel",
    f"WITH {t.SALES_ROLLUP} SELECT province, year, CAST(sum(deal_count) AS BIGINT) AS deal_count FROM sales_rollup WHERE province = 'ASIA' GROUP BY province, year",
)
def chosen_panel(spark, sf):
    """Monthly rows are asked for, but the months at hand hold none of the province: the yearly panel."""
    rolled = t.rolled_sales(spark, sf)
    yearly = rolled.groupBy("province", "year").agg(F.sum("deal_count").alias("deal_count"))
    monthly = rolled.filter("province <> 'ASIA'").groupBy("province", "year", "month", "ym").agg(F.sum("deal_count").alias("deal_count"))
    return scope.choose_panel(yearly, monthly, scope.AnalysisSpec(freq="monthly", provinces=("ASIA",)))


@query(
    "usable_candidate",
    f"WITH {t.SALES_ROLLUP} SELECT province, district_code, ym, deal_count AS value FROM sales_rollup",
)
def usable_candidate(spark, sf):
    """The first of several measures that the table has and that holds a value."""
    rolled = t.rolled_sales(spark, sf).withColumn("turnover", F.lit(None).cast("double"))
    name = scope.first_usable(rolled, ["turnover_rate", "turnover", "deal_count", "avg_price"])
    return rolled.select("province", "district_code", "ym", F.col(name).alias("value"))


@query(
    "searched_variables",
    """SELECT c_name AS variable FROM customer WHERE c_nationkey % 3 = 1 AND (c_mktsegment LIKE '%BUILD%' OR lower(c_name) LIKE '%build%')""",
)
def searched_variables(spark, sf):
    catalogue = t.table(spark, sf, "customer").select(
        F.col("c_name").alias("variable"), F.lower("c_name").alias("label"), F.col("c_mktsegment").alias("description"), (F.col("c_nationkey") % 3).cast("string").alias("category")
    )
    return scope.search_variables(catalogue, "build", "1").select("variable")


@query(
    "only_new_columns",
    f"""WITH {t.SALES_ROLLUP}, {t.LEASES[len(t.REGIONS) + 2:]}, w AS (SELECT province, year, month, count(*) AS lease_count FROM leases GROUP BY ALL)
SELECT s.district_code, s.ym, s.deal_count, w.lease_count FROM sales_rollup s LEFT JOIN w USING (province, year, month)""",
)
def only_new_columns(spark, sf):
    """A column that the panel already has is not taken from the table."""
    rolled = t.rolled_sales(spark, sf)
    table = t.leases(spark, sf).groupBy("province", "year", "month").agg(F.count(F.lit(1)).alias("lease_count"), F.lit(-1).alias("deal_count"))
    joined = joins.join_indicator(rolled, table, keys=["province", "year", "month"], only_new=True)
    return joined.select("district_code", "ym", "deal_count", "lease_count")
