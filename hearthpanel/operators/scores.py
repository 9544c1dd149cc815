"""Composite scores: value, market temperature, district grades, affordability.

Inputs are district-month rollups. They are reduced to one row per district (or
per year) before anything is joined, normalised or ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearthpanel.functions.numeric import annuity_present_value, clamp, half_even, ratio
from hearthpanel.operators.scope import first_available, nearest_year
from hearthpanel.operators.windows import minmax_table, with_table_stats, zscore

# Weights of the district value score.
VALUE_WEIGHTS = {"deposit_ratio_z": 0.35, "inverse_pir_z": 0.30, "volume_z": 0.15, "momentum_z": 0.20}
# Weights of the district grade.
GRADE_WEIGHTS = {"unit_scaled": 0.40, "income_scaled": 0.25, "volume_scaled": 0.20, "growth_scaled": 0.15}


def _year_column(df: DataFrame, year: int | None) -> Column:
    return F.lit(year) if year is not None else df.select(F.max("year")).scalar()


def _district_sales(sales: DataFrame, year: Column, years_back: int) -> DataFrame:
    """District figures of the year and the price ``years_back`` earlier, in one pass.

    The earlier price belongs to the code alone, whichever province it was filed under.
    """
    dated = sales.withColumn("_at", year)
    now, before = F.col("year") == F.col("_at"), F.col("year") == F.col("_at") - years_back

    def current(name: str) -> Column:
        return F.when(now, F.col(name))

    earlier = F.when(before, F.col("avg_price"))
    districts = (
        dated.filter(now | before)
        .dropna(subset=["district_code", "province"])
        .groupBy("district_code", "province")
        .agg(
            F.avg(current("avg_price")).alias("avg_price"),
            F.avg(current("avg_unit_price")).alias("avg_unit_price"),
            F.sum(current("deal_count")).alias("volume"),
            F.count(F.when(now, F.lit(1))).alias("_rows"),
            F.sum(earlier).alias("_before_sum"),
            F.count(earlier).alias("_before_n"),
        )
    )
    same_code = Window.partitionBy("district_code")
    before_price = ratio(F.sum("_before_sum").over(same_code), F.sum("_before_n").over(same_code))
    return (
        districts.withColumn("price_before", before_price)
        .filter(F.col("_rows") > 0)
        .drop("_rows", "_before_sum", "_before_n")
    )


def _growth(price: str, before: str) -> Column:
    return F.when(F.col(before) > 0, ratio(F.col(price) - F.col(before), before) * 100)


def _pension_income(pension: DataFrame, year: Column, name: str) -> DataFrame:
    """Subscriber-weighted amount per head, of the year or the nearest one before it."""
    rows = nearest_year(pension, year).dropna(subset=["pension_per_head", "pension_subscribers", "district_code"])
    heads = F.sum("pension_subscribers")
    return rows.groupBy("district_code").agg(
        F.when(heads > 0, ratio(F.sum(F.col("pension_per_head") * F.col("pension_subscribers")), heads)).alias(name)
    )


def _named(df: DataFrame, names: DataFrame | None) -> DataFrame:
    from hearthpanel.functions.regions import with_district_name

    return df.withColumn("district_name", F.col("district_code")) if names is None else with_district_name(df, names)


def value_score(
    sales: DataFrame,
    deposits: DataFrame,
    pension: DataFrame | None = None,
    *,
    year: int | None = None,
    degenerate: str = "raw",
    names: DataFrame | None = None,
) -> DataFrame:
    """Under- or over-valuation of each district within its province.

    Deposit ratio, inverse price-to-income, volume and (negative) two-year
    momentum are standardised inside the province and weighted; a missing part
    counts 0. With ``degenerate="raw"`` a province of one district keeps its raw
    values in place of scores.
    """
    at = _year_column(sales, year)
    df = _district_sales(sales, at, 2)
    lease = deposits.filter(F.col("year") == at).dropna(subset=["district_code"])
    df = df.join(lease.groupBy("district_code").agg(F.avg("avg_deposit").alias("avg_deposit")), "district_code", "left")
    if pension is not None:
        df = df.join(_pension_income(pension, at, "pension_per_head"), "district_code", "left")
    else:
        df = df.withColumn("pension_per_head", F.lit(None).cast("double"))
    df = df.withColumns(
        {
            "deposit_ratio": F.when(F.col("avg_price") > 0, ratio("avg_deposit", "avg_price") * 100),
            "pir_pension": F.when(
                F.col("pension_per_head") > 0, ratio("avg_price", F.col("pension_per_head") * 12 / 10000)
            ),
            "momentum": _growth("avg_price", "price_before"),
        }
    )
    df = df.withColumns({"inverse_pir": ratio(F.lit(1.0), "pir_pension"), "cooling": -F.col("momentum")})
    for source, target in (
        ("deposit_ratio", "deposit_ratio_z"),
        ("inverse_pir", "inverse_pir_z"),
        ("volume", "volume_z"),
        ("cooling", "momentum_z"),
    ):
        df = zscore(df, source, group="province", name=target, degenerate=degenerate)
    score = sum(F.coalesce(F.col(c), F.lit(0.0)) * F.lit(w) for c, w in VALUE_WEIGHTS.items())
    return (
        _named(df.withColumn("value_score", score), names)
        .select(
            "district_code", "district_name", "province", "value_score", "deposit_ratio", "pir_pension", "volume", "momentum"
        )
        .orderBy(F.desc_nulls_last("value_score"), "district_code")
    )


# ---- market temperature -----------------------------------------------------


def market_temperature(panel: DataFrame, *, digits: int | None = 2) -> DataFrame:
    """0 (cold) to 100 (overheated) per year, its change, and the five parts.

    Missing parts hand their weight to the others; a year without any part
    scores 50. The latest year is the last row.
    """
    parts: dict[str, tuple[Column, float]] = {}
    measures = []

    def spread(name: str, column: str) -> None:
        measures.extend(
            [F.avg(column).alias(f"{name}_mean"), F.min(column).alias(f"{name}_min"), F.max(column).alias(f"{name}_max")]
        )

    if "buyer_superiority" in panel.columns:
        measures.append(F.avg("buyer_superiority").alias("buyer_mean"))
        parts["buyers"] = (clamp((200 - F.col("buyer_mean")) / 200 * 100, 0, 100), 0.25)
    if "price_outlook" in panel.columns:
        measures.append(F.avg("price_outlook").alias("outlook_mean"))
        parts["outlook"] = (clamp(F.col("outlook_mean") / 200 * 100, 0, 100), 0.20)
    if "price_yoy" in panel.columns:
        measures.append(F.avg("price_yoy").alias("yoy_mean"))
        parts["price_change"] = ((clamp("yoy_mean", -20, 20) + 20) / 40 * 100, 0.25)
    turnover = first_available(panel, ["turnover_rate", "sale_count", "deal_count"])
    if turnover:
        spread("turnover", turnover)
        low, high = F.col("turnover_min"), F.col("turnover_max")
        parts["turnover"] = (F.when(high > low, ratio(F.col("turnover_mean") - low, high - low) * 100), 0.15)
    if "unsold" in panel.columns:
        spread("unsold", "unsold")
        low, high = F.col("unsold_min"), F.col("unsold_max")
        parts["unsold"] = (F.when(high > low, ratio(high - F.col("unsold_mean"), high - low) * 100), 0.15)

    years = panel.dropna(subset=["year"]).groupBy("year").agg(*(measures or [F.count(F.lit(1)).alias("_rows")]))
    years = years.select("year", *(value.alias(name) for name, (value, _) in parts.items()))
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, (_, w) in parts.items():
        total = total + F.coalesce(F.col(name) * w, F.lit(0.0))
        weight = weight + F.when(F.col(name).isNotNull(), F.lit(w)).otherwise(0.0)
    score = half_even(F.coalesce(ratio(total, weight), F.lit(50.0)), digits)
    scored = years.withColumn("score", score)
    # The change counts only against the calendar year before; a gap gives 0.
    before = Window.orderBy("year")
    prior = F.when(F.lag("year").over(before) == F.col("year") - 1, F.lag("score").over(before))
    return scored.select(
        "year",
        "score",
        F.coalesce(half_even(F.col("score") - prior, digits), F.lit(0.0)).alias("delta"),
        *(half_even(name, digits).alias(name) for name in parts),
    ).orderBy("year")


# ---- income quintiles to percentiles ---------------------------------------

# Percentile that stands for each income quintile.
QUINTILE_CENTRES = {1: 10, 2: 30, 3: 50, 4: 70, 5: 90}
# Labels that mark totals instead of quintiles.
TOTAL_LABELS = "전체|평균|합계"


def _at(array: Column, index: Column) -> Column:
    return F.get(array, index)


def _hermite_slopes(x: Column, y: Column) -> Column:
    """Shape-preserving slopes at the knots of one series (arrays of equal size)."""
    last = F.size(x) - 1

    def width(k: Column) -> Column:
        return _at(x, k + 1) - _at(x, k)

    def secant(k: Column) -> Column:
        return F.try_divide(_at(y, k + 1) - _at(y, k), width(k))

    def end(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
        d = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
        limited = F.when((F.signum(m0) != F.signum(m1)) & (F.abs(d) > 3 * F.abs(m0)), 3 * m0).otherwise(d)
        return F.when(F.signum(d) != F.signum(m0), F.lit(0.0)).otherwise(limited)

    def slope(_value: Column, k: Column) -> Column:
        m0, m1 = secant(k - 1), secant(k)
        w1, w2 = 2 * width(k) + width(k - 1), width(k) + 2 * width(k - 1)
        inner = F.when(m0 * m1 <= 0, F.lit(0.0)).otherwise(
            F.try_divide(w1 + w2, F.try_divide(w1, m0) + F.try_divide(w2, m1))
        )
        first = end(width(F.lit(0)), width(F.lit(1)), secant(F.lit(0)), secant(F.lit(1)))
        final = end(width(last - 1), width(last - 2), secant(last - 1), secant(last - 2))
        return F.when(k == 0, first).when(k == last, final).otherwise(inner)

    return F.transform(x, slope)


def quintile_to_percentile(
    df: DataFrame, *, columns: list[str], year: int | None = None, quintile: str = "quintile", by_year: bool = False
) -> DataFrame:
    """Quintile means to percentiles 1-99 by monotone cubic interpolation.

    Values outside 10-90 are extrapolated by the end segments and never fall
    below zero. A year needs three quintiles; a column with fewer than three
    values is null. ``by_year`` interpolates every year of the table.
    """
    label = F.col(quintile).cast("string")
    digit = F.regexp_extract(label, r"(\d)", 1).try_cast("int")
    centre = F.create_map(*(F.lit(v) for pair in QUINTILE_CENTRES.items() for v in pair))[digit]
    rows = df if year is None else df.filter(F.col("year") == year)
    rows = rows.filter(~label.rlike(TOTAL_LABELS)).withColumn("_x", centre.cast("double")).filter(F.col("_x").isNotNull())
    # One row per year and quintile, whatever the table repeats.
    rows = rows.groupBy("year", "_x").agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in columns))

    def knots(column: str) -> Column:
        point = F.struct(F.col("_x").alias("x"), F.col(column).cast("double").alias("y"))
        return F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), point)))

    # At most five knots per year and column are gathered.
    gathered = rows.groupBy("year").agg(F.count(F.lit(1)).alias("_rows"), *(knots(c).alias(c) for c in columns))
    gathered = gathered.filter(F.col("_rows") >= 3)
    prepared = gathered.select(
        "year", *(F.struct(F.col(c)["x"].alias("x"), F.col(c)["y"].alias("y")).alias(c) for c in columns)
    )
    sloped = prepared.select(
        "year",
        *(
            F.when(
                F.size(F.col(c)["x"]) >= 3,
                F.struct(F.col(c)["x"].alias("x"), F.col(c)["y"].alias("y"), _hermite_slopes(F.col(c)["x"], F.col(c)["y"]).alias("d")),
            ).alias(c)
            for c in columns
        ),
    )

    def evaluate(column: str) -> Column:
        knot = F.col(column)
        x, y, d = knot["x"], knot["y"], knot["d"]
        p = F.col("percentile").cast("double")
        passed = F.size(F.filter(x, lambda v: v <= p))
        k = F.greatest(F.lit(0), F.least(passed - 1, F.size(x) - 2))
        h = _at(x, k + 1) - _at(x, k)
        s = (p - _at(x, k)) / h
        value = (
            _at(y, k) * (1 + 2 * s) * (1 - s) * (1 - s)
            + h * _at(d, k) * s * (1 - s) * (1 - s)
            + _at(y, k + 1) * s * s * (3 - 2 * s)
            + h * _at(d, k + 1) * s * s * (s - 1)
        )
        return F.when(knot.isNotNull(), F.greatest(value, F.lit(0.0)))

    spread = sloped.withColumn("percentile", F.explode(F.sequence(F.lit(1), F.lit(99))))
    keys = ["year", "percentile"] if by_year or year is None else ["percentile"]
    return spread.select(*keys, *(evaluate(c).alias(c) for c in columns))


def purchasing_power(df: DataFrame, *, rate: float = 3.5, dsr_limit: float = 0.40, years: int = 30) -> DataFrame:
    """Price a household can pay: net worth plus the loan its spare income carries."""
    if "net_worth" in df.columns:
        worth = F.col("net_worth")
    elif {"household_assets", "household_debt"} <= set(df.columns):
        worth = F.col("household_assets") - F.col("household_debt")
    else:
        worth = F.lit(0.0)
    income_name = first_available(df, ["household_income"])
    income = F.col(income_name) if income_name else F.lit(0.0)
    burden = F.col("debt_to_income") / 100.0 if "debt_to_income" in df.columns else F.lit(0.0)
    slack = dsr_limit - burden
    repayment = income * F.when(slack < 0, F.lit(0.0)).otherwise(slack)
    if rate > 0:
        loan = annuity_present_value(repayment / 12, rate / 100 / 12, years * 12)
    else:
        loan = repayment * years
    keys = [k for k in ("year", "percentile") if k in df.columns]
    out = df.select(
        *keys, worth.alias("net_worth"), income.alias("annual_income"), F.coalesce(loan, F.lit(0.0)).alias("loan_capacity")
    )
    power = F.col("net_worth") + F.col("loan_capacity")
    return out.withColumn("purchasing_power", F.when(power < 0, F.lit(0.0)).otherwise(power))


# ---- district grades --------------------------------------------------------


def rank_districts(
    sales: DataFrame,
    pension: DataFrame | None = None,
    income: DataFrame | None = None,
    *,
    year: int | None = None,
    names: DataFrame | None = None,
) -> DataFrame:
    """Grade every district by unit price, income, volume and three-year growth.

    Missing parts take the national median before scaling to 0-1. The grade is
    a position over all districts of the country, whose number is fixed by the
    administrative register.
    """
    at = _year_column(sales, year)
    df = _district_sales(sales, at, 3)
    if pension is not None:
        df = df.join(_pension_income(pension, at, "income_level"), "district_code", "left")
    elif income is not None and "pay_per_head" in income.columns:
        paid = income.filter(F.col("year") == at).groupBy("district_code").agg(F.avg("pay_per_head").alias("income_level"))
        df = df.join(paid, "district_code", "left")
    else:
        df = df.withColumn("income_level", F.lit(None).cast("double"))
    df = df.withColumn("growth_3y", _growth("avg_price", "price_before"))
    df = with_table_stats(df, *(F.median(c).alias(c) for c in ("avg_unit_price", "income_level", "growth_3y")), name="_medians")
    medians = F.col("_medians")
    df = df.withColumns(
        {
            "unit_filled": F.coalesce("avg_unit_price", medians["avg_unit_price"]),
            "income_filled": F.coalesce("income_level", medians["income_level"]),
            "volume_filled": F.coalesce("volume", F.lit(0)),
            "growth_filled": F.coalesce("growth_3y", medians["growth_3y"]),
        }
    )
    df = minmax_table(df, {f"{part}_filled": f"{part}_scaled" for part in ("unit", "income", "volume", "growth")}, flat=0.5)
    score = sum(F.col(c) * F.lit(w) for c, w in GRADE_WEIGHTS.items())
    best_first = Window.orderBy(F.desc_nulls_last("grade_score"), F.asc("district_code"))
    return (
        _named(df.withColumn("grade_score", score), names)
        .withColumn("grade", F.row_number().over(best_first))
        .select(
            "district_code", "district_name", "province", "grade", "grade_score",
            "avg_price", "avg_unit_price", "income_level", "volume", "growth_3y",
        )
        .orderBy("grade")
    )


UNAFFORDABLE = "구매불가"  # Fixed value: shown where no district is affordable.


def match_income(power: DataFrame, grades: DataFrame, *, price: str = "avg_price", digits: int | None = 0) -> DataFrame:
    """Best district grade that each ten-percent income band can afford.

    The ten band medians travel as one array of ten; every district reports
    itself to the bands that can pay for it, at most ten rows each, and the best
    grade is kept by an aggregate that combines before the shuffle.
    """
    band = F.floor((F.col("percentile") - 1) / 10).cast("int")
    bands = (
        power.filter(F.col("percentile").between(1, 99))
        .groupBy(band.alias("band"))
        .agg(F.median("purchasing_power").alias("power"))
    )
    offers = bands.select(F.collect_list(F.struct("band", "power"))).scalar()
    offer = F.struct(
        F.col("grade").alias("grade"), F.col("district_name").alias("name"), F.col(price).cast("double").alias("price")
    )
    reached = (
        grades.select(F.explode(offers).alias("b"), offer.alias("offer"))
        .filter(F.col("b")["power"] >= F.col("offer")["price"])
        .groupBy(F.col("b")["band"].alias("band"))
        .agg(F.min("offer.grade").alias("grade"), F.min("offer").alias("best"))
    )
    first = F.col("band") * 10 + 1
    label = F.format_string("%d~%d%%", first, F.least(first + 9, F.lit(99)))
    market = F.col("best")["price"]
    return (
        bands.join(reached, "band", "left")
        .orderBy("band")
        .select(
            label.alias("percentile_group"),
            half_even("power", digits).alias("purchasing_power"),
            "grade",
            F.coalesce(F.col("best")["name"], F.lit(UNAFFORDABLE)).alias("districts"),
            half_even(market, digits).alias("market_price"),
            half_even(F.col("power") - market, digits).alias("gap"),
        )
    )
