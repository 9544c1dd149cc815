"""Correlation, fit and outlier operators.

All of them reduce to moments that Spark combines before the shuffle; p-values
are computed on the small result tables.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearthpanel.functions.numeric import half_even, nan_to_null, ratio
from hearthpanel.functions.tails import correlation_pvalue

MIN_PAIRS = 3


def _double(name: str) -> Column:
    return nan_to_null(F.col(name).cast("double"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are present; null without spread."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_samp(px, py), F.stddev_samp(px) * F.stddev_samp(py))
    return F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise correlations and p-values, long form, over complete rows only.

    Fewer than three complete rows give an empty result.
    """
    columns = [c for c in columns if c in df.columns]
    complete = df.select(*(_double(c).alias(c) for c in columns)).dropna()
    pairs = list(combinations(columns, 2))
    # Rows are complete, so each column has one spread for all of its pairs.
    spreads = [F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)]
    shared = [F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    at = {c: i for i, c in enumerate(columns)}

    def bounded(i: int, a: str, b: str) -> Column:
        r = F.try_divide(F.col(f"c{i}"), F.col(f"s{at[a]}") * F.col(f"s{at[b]}"))
        return F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r).alias(f"r{i}")

    moments = complete.agg(F.count(F.lit(1)).alias("n"), *spreads, *shared)
    moments = moments.select("n", *(bounded(i, a, b) for i, (a, b) in enumerate(pairs)))

    def cell(a: str, b: str, r: Column) -> Column:
        return F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"), r.cast("double").alias("r"))

    cells = [cell(c, c, F.lit(1.0)) for c in columns]
    cells += [cell(*side, F.col(f"r{i}")) for i, (a, b) in enumerate(pairs) for side in ((a, b), (b, a))]
    long = moments.filter(F.col("n") >= MIN_PAIRS).select(F.explode(F.array(*cells)).alias("c"), "n").select("c.*", "n")
    p = F.when(F.col("var_x") == F.col("var_y"), F.lit(0.0)).otherwise(correlation_pvalue(F.col("r"), F.col("n")))
    return long.withColumn("p", p)


def correlation_by(df: DataFrame, x: str, y: str, *, key: str, digits: int | None = 4, sort: bool = True) -> DataFrame:
    """Correlation inside each region or inside each period, from three pairs up."""
    pairs = df.select(key, _double(x).alias("x"), _double(y).alias("y")).dropna()
    out = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n"), pearson(F.col("x"), F.col("y")).alias("raw"))
    out = out.filter(F.col("n") >= MIN_PAIRS).select(
        key,
        half_even("raw", digits).alias("r"),
        half_even(correlation_pvalue(F.col("raw"), F.col("n")), digits).alias("p"),
        "n",
    )
    return out.orderBy(F.desc_nulls_last("r"), key) if sort else out


def scatter_fit(df: DataFrame, x: str, y: str, *, group: str | None = None) -> DataFrame:
    """Regression line over complete rows in one row; null under three rows."""
    pairs = df.select(_double(x).alias("x"), _double(y).alias("y"), *([group] if group else [])).dropna()
    enough = F.col("n") >= MIN_PAIRS
    fitted = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        pearson(F.col("x"), F.col("y")).alias("r"),
    )
    return fitted.select(
        "n",
        F.when(enough, F.col("slope")).alias("slope"),
        F.when(enough, F.col("intercept")).alias("intercept"),
        F.when(enough, F.col("r") * F.col("r")).alias("r_squared"),
    )


def pair_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """One correlation with its p-value and pair count, empty under three pairs."""
    return correlation_by(df.withColumn("_all", F.lit(1)), x, y, key="_all", digits=None, sort=False).drop("_all")


def rolling_correlation(df: DataFrame, x: str, y: str, *, window: int = 12, order_by: str = "ym") -> DataFrame:
    """Correlation of the cross-region means over the last ``window`` periods.

    The ordered window runs over one row per period.
    """
    means = (
        df.dropna(subset=[order_by])
        .groupBy(order_by)
        .agg(F.avg(_double(x)).alias("x"), F.avg(_double(y)).alias("y"))
        .dropna()
    )
    recent = Window.orderBy(order_by).rowsBetween(-(window - 1), Window.currentRow)
    spread = F.stddev_samp("x").over(recent) * F.stddev_samp("y").over(recent)
    return (
        means.select(
            order_by,
            F.try_divide(F.covar_samp("x", "y").over(recent), spread).alias("rolling_corr"),
            F.count(F.lit(1)).over(recent).alias("rows"),
        )
        .filter((F.col("rows") == window) & F.col("rolling_corr").isNotNull())
        .drop("rows")
    )


# The sketch is off by at most 1/SKETCH_ACCURACY of the rows in rank; the bracket
# around a quantile is four times as wide on both sides.
SKETCH_ACCURACY = 100_000
BRACKET = 4 / SKETCH_ACCURACY


def group_quantiles(
    df: DataFrame, col: str, *, group: list[str], probs: list[float], extra: dict[str, Column] | None = None
) -> DataFrame:
    """Exact interpolated quantiles per group, for groups of any size.

    A sketch brackets each quantile, then one count per distinct value inside
    the brackets, and one count for each stretch outside them with its smallest
    and largest value, is enough to read off the exact order statistics, in a
    group of any size. A rank inside a stretch would mean that the sketch broke
    its bound and raises an error. No task holds a whole group. ``extra`` adds
    aggregates of the value ``v`` by name, from the pass of the sketch.
    """
    values = df.select(*group, _double(col).alias("v")).dropna()
    marks = [m for p in probs for m in (max(p - BRACKET, 0.0), min(p + BRACKET, 1.0))]
    edges = values.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
        F.percentile_approx("v", marks, SKETCH_ACCURACY).alias("marks"),
        *(c.alias(name) for name, c in (extra or {}).items()),
    )
    also = list(extra or {})
    bounds = []
    for i, p in enumerate(probs):
        low = F.when(F.lit(p - BRACKET <= 0), F.col("low")).otherwise(F.col("marks")[2 * i])
        high = F.when(F.lit(p + BRACKET >= 1), F.col("high")).otherwise(F.col("marks")[2 * i + 1])
        bounds += [low.alias(f"lo{i}"), high.alias(f"hi{i}")]
    placed = values.join(edges.select(*group, "n", *also, *bounds), group)

    v = F.col("v")
    inside, stretch = F.lit(False), F.lit(0)
    for i in range(len(probs)):
        inside = inside | v.between(F.col(f"lo{i}"), F.col(f"hi{i}"))
        stretch = stretch + (v >= F.col(f"lo{i}")).cast("int") + (v > F.col(f"hi{i}")).cast("int")
    counted = (
        placed.select(*group, "n", *also, stretch.alias("stretch"), F.when(inside, v).alias("v"), v.alias("any"))
        .groupBy(*group, "n", *also, "stretch", "v")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("any").alias("least"), F.max("any").alias("most"))
    )
    upto = Window.partitionBy(*group).orderBy("stretch", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("rank", F.sum("copies").over(upto))

    def at(rank: Column) -> Column:
        """The value of a rank: in a bracket exactly, at either end of a stretch by its smallest or largest value."""
        lost = F.raise_error(F.lit("a quantile lies outside of its bracket")).cast("double")
        value = F.coalesce(v, F.when(rank == F.col("rank"), F.col("most")), F.when(rank == F.col("rank") - F.col("copies") + 1, F.col("least")), lost)
        return F.max(F.when((rank <= F.col("rank")) & (rank > F.col("rank") - F.col("copies")), value))

    picks = []
    for i, p in enumerate(probs):
        place = (F.col("n") - 1) * F.lit(float(p))
        lower = F.floor(place) + 1
        upper = F.least(lower + 1, F.col("n"))
        picks += [at(lower).alias(f"a{i}"), at(upper).alias(f"b{i}")]
    quantiles = [
        (
            F.col(f"a{i}")
            + (F.col(f"b{i}") - F.col(f"a{i}")) * ((F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p))))
        ).alias(f"q{i}")
        for i, p in enumerate(probs)
    ]
    return ranked.groupBy(*group, "n", *also).agg(*picks).select(*group, "n", *also, *quantiles)


def quantiles(df: DataFrame, col: str, probs: list[float]) -> DataFrame:
    """Exact quantiles of a column in one row, for example a colour range."""
    return group_quantiles(df.withColumn("_all", F.lit(1)), col, group=["_all"], probs=probs).drop("_all")


def detect_outliers(
    df: DataFrame, col: str, *, group: str = "province", method: str = "zscore", threshold: float = 2.5, digits: int | None = 4
) -> DataFrame:
    """Flag values far from their group, by z-score or by quartile fences.

    Groups under three values get no score; a group without spread scores 0 and
    flags nothing. Group statistics are aggregated and joined back, so a hot
    group is never pulled into one task.
    """
    if method not in ("zscore", "iqr"):
        raise ValueError(f"unknown method {method!r}")
    value = _double(col)
    named = df.filter(F.col(group).isNotNull())
    if method == "iqr":
        moments = {"_mean": F.avg("v"), "_spread": F.stddev_samp("v")}
        fences = group_quantiles(named, col, group=[group], probs=[0.25, 0.75], extra=moments)
        width = (F.col("q1") - F.col("q0")) * 1.5
        low, high = (F.col("q0") - width).alias("_low"), (F.col("q1") + width).alias("_high")
        stats = fences.select(group, F.col("n").alias("_n"), "_mean", "_spread", low, high)
    else:
        stats = named.groupBy(group).agg(F.count(value).alias("_n"), F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_spread"))
    stats = stats.filter(F.col("_n") >= MIN_PAIRS)
    scored = df.join(stats, group, "left")
    z = F.when(F.col("_spread") == 0, F.when(value.isNotNull(), F.lit(0.0))).otherwise(
        ratio(value - F.col("_mean"), "_spread")
    )
    far = F.abs(z) > threshold if method == "zscore" else (value < F.col("_low")) | (value > F.col("_high"))
    flag = F.coalesce(far & (F.col("_spread") > 0), F.lit(False))
    extra = ["_n", "_mean", "_spread"] + (["_low", "_high"] if method == "iqr" else [])
    return scored.withColumns({"is_outlier": flag, "z_score": half_even(z, digits)}).drop(*extra)


def p_value_matrix(tests: DataFrame, lags: list[int], *, group: str = "province") -> DataFrame:
    """Lead-lag test p-values with one column per lag."""
    return tests.groupBy(group).pivot("lag", lags).agg(F.min("p"))
