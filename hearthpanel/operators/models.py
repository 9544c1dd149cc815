"""Regression, clustering, lead-lag tests and forecasts.

Spark reduces the data to moments, one matrix per region at most, which array
functions or, for the one regression of a whole table, NumPy solve.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearthpanel.functions.numeric import nan_to_null, ratio
from hearthpanel.functions.tails import f_pvalue, t_tail
from hearthpanel.operators import moments

MIN_OBSERVATIONS = 10


def _double(name: str) -> Column:
    return nan_to_null(F.col(name).cast("double"))


# ---- ordinary least squares -------------------------------------------------


def _moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, means and centred second moments of complete rows, in one pass."""
    complete = df.select(*(_double(c).alias(c) for c in columns)).dropna()
    pairs = list(combinations_with_replacement(columns, 2))
    return complete.agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*(F.avg(c) for c in columns)).alias("means"),
        F.array(*(F.covar_samp(a, b) for a, b in pairs)).alias("covariances"),
    )


def _solve_ols(frames, columns: list[str]):
    k = len(columns) - 1
    for frame in frames:
        for row in frame.itertuples(index=False):
            n = int(row.n)
            if n < MIN_OBSERVATIONS:
                raise ValueError(f"regression needs {MIN_OBSERVATIONS} complete rows, found {n}")
            means = np.asarray(row.means, dtype=float)
            cov = np.zeros((k + 1, k + 1))
            cov[np.triu_indices(k + 1)] = row.covariances
            cov = np.triu(cov) + np.triu(cov, 1).T
            syy, sxy, sxx = cov[0, 0], cov[0, 1:], cov[1:, 1:]
            # Solved as a correlation matrix: regressors of unlike scale weigh alike in the rank and the inverse.
            scale = np.sqrt(np.diag(sxx))
            scale[scale == 0] = 1.0
            scaled = sxx / np.outer(scale, scale)
            inverse = np.linalg.pinv(scaled, hermitian=True) / np.outer(scale, scale)
            slopes = inverse @ sxy
            intercept = means[0] - slopes @ means[1:]
            df_resid = n - 1 - int(np.linalg.matrix_rank(scaled, hermitian=True))
            sse = max((n - 1) * (syy - slopes @ sxy), 0.0)
            r2 = 1 - sse / ((n - 1) * syy) if syy > 0 else np.nan
            variance = sse / df_resid
            spread = inverse / (n - 1)
            errors = np.sqrt(variance * np.concatenate([[1 / n + means[1:] @ spread @ means[1:]], np.diag(spread)]))
            coefs = np.concatenate([[intercept], slopes])
            with np.errstate(divide="ignore", invalid="ignore"):
                t = coefs / errors
            weight = np.abs(slopes * np.sqrt(np.diag(sxx)) / np.sqrt(syy)) if syy > 0 else np.zeros(k)
            yield pd.DataFrame(
                {
                    "position": np.arange(k + 1),
                    "variable": ["intercept", *columns[1:]],
                    "coefficient": coefs,
                    "std_error": errors,
                    "t": t,
                    "p": t_tail(t, float(df_resid)),
                    "importance": np.concatenate([[np.nan], weight]),
                    "n": n,
                    "r_squared": r2,
                    "adj_r_squared": 1 - (1 - r2) * (n - 1) / df_resid,
                }
            )


_OLS_SCHEMA = (
    "position int, variable string, coefficient double, std_error double, t double, p double, "
    "importance double, n bigint, r_squared double, adj_r_squared double"
)


def _nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: nan_to_null(c) for c in columns})


def ols_table(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Full-precision regression result, intercept first, one row per term."""
    columns = [y, *xs]
    solved = _moments(df, columns).mapInPandas(lambda frames: _solve_ols(frames, columns), _OLS_SCHEMA)
    return _nulls(solved, ["coefficient", "std_error", "t", "p", "importance", "r_squared", "adj_r_squared"])


def ols(df: DataFrame, y: str, xs: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Coefficients, standardised importance (largest first) and fit of a regression."""
    table = ols_table(df, y, xs)
    coefficients = table.orderBy("position").select(
        "variable",
        F.bround("coefficient", 6).alias("coefficient"),
        F.bround("std_error", 6).alias("std_error"),
        F.bround("t", 4).alias("t"),
        F.bround("p", 4).alias("p"),
    )
    importance = (
        table.filter(F.col("position") > 0)
        .select("variable", F.bround("importance", 4).alias("importance"))
        .orderBy(F.desc_nulls_last("importance"), "variable")
    )
    fit = table.filter(F.col("position") == 0).select(
        "n", F.bround("r_squared", 4).alias("r_squared"), F.bround("adj_r_squared", 4).alias("adj_r_squared")
    )
    return coefficients, importance, fit


# ---- clustering -------------------------------------------------------------


def _apart(point: Column, centre: Column) -> Column:
    """Squared distance of two arrays."""
    return F.aggregate(F.zip_with(point, centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def _arrays(rows: list[list[list[float]]]) -> Column:
    return F.array(*(F.array(*(F.array(*(F.lit(float(v)) for v in centre)) for centre in centres)) for centres in rows))


def _seeds(scaled: DataFrame, region: str, k: int, restarts: int, seed: int) -> list[list[list[float]]]:
    """First centres of every restart: a region drawn by the seed, then the region farthest from those chosen, a job for each."""
    draws = F.array(*(F.struct(F.xxhash64(region, F.lit(seed + i)).alias("draw"), F.col("point")) for i in range(restarts)))
    drawn = scaled.select(F.posexplode(draws).alias("restart", "d")).groupBy("restart").agg(F.min("d")["point"].alias("point"))
    chosen = [[list(r.point)] for r in drawn.orderBy("restart").collect()]
    while len(chosen[0]) < k:
        near = F.transform(_arrays(chosen), lambda centres: F.array_min(F.transform(centres, lambda c: _apart(F.col("point"), c))))
        far = scaled.select(F.col(region).alias("region"), "point", F.posexplode(near).alias("restart", "gap"))
        picked = far.groupBy("restart").agg(F.max_by("point", F.struct("gap", "region")).alias("point")).orderBy("restart").collect()
        for centres, row in zip(chosen, picked):
            centres.append(list(row.point))
    return chosen


def _rounds(scaled: DataFrame, chosen: list[list[list[float]]], most: int) -> list[list[float]]:
    """Centres of the best restart; all restarts move together, one aggregate a round, until none gains."""
    cost = [math.inf] * len(chosen)
    for _ in range(most):
        gaps = F.transform(_arrays(chosen), lambda centres: F.transform(centres, lambda c: _apart(F.col("point"), c)))
        placed = scaled.select("point", F.posexplode(gaps).alias("restart", "gaps"))
        placed = placed.withColumn("gap", F.array_min("gaps")).withColumn("cluster", F.array_position("gaps", F.col("gap")) - 1)
        size = len(chosen[0][0])
        moved = (
            placed.groupBy("restart", "cluster")
            .agg(F.array(*(F.avg(F.get("point", F.lit(i))) for i in range(size))).alias("centre"), F.sum("gap").alias("cost"))
            .collect()
        )  # a number for each restart, cluster and feature
        now = [0.0] * len(chosen)
        for row in moved:
            chosen[row.restart][int(row.cluster)] = list(row.centre)  # a cluster that lost all regions keeps its centre
            now[row.restart] += row.cost
        if all(new >= old - 1e-12 * (1 + abs(new)) for new, old in zip(now, cost)):
            break
        cost = now
    return chosen[min(range(len(cost)), key=lambda i: cost[i])]


def cluster_regions(
    df: DataFrame, features: list[str], *, k: int = 4, seed: int = 42, restarts: int = 10, region: str = "province", most: int = 300
) -> tuple[DataFrame, DataFrame]:
    """K-means over standardised region means; clusters are numbered by their sorted centres.

    All restarts run side by side: their centres are one literal of a few dozen
    numbers, and a round of all of them is one aggregate. Returns the regions
    with their cluster and the centres in original units. Regions without a
    value of any feature are left out; a feature without spread counts 0.
    """
    means = df.dropna(subset=[region]).groupBy(region).agg(*(F.avg(_double(f)).alias(f) for f in features)).dropna()
    means = means.persist()  # one row per region, read by every round
    moments_of = [F.struct(F.avg(f).alias("mean"), F.stddev_samp(f).alias("spread")).alias(f) for f in features]
    shape = means.agg(F.count(F.lit(1)).alias("n"), *moments_of).first()
    if shape["n"] < k:
        means.unpersist()
        raise ValueError(f"{shape['n']} regions cannot form {k} clusters")
    mean, spread = [shape[f]["mean"] for f in features], [shape[f]["spread"] or 0.0 for f in features]
    point = F.array(*((F.col(f) - m) / s if s else F.lit(0.0) for f, m, s in zip(features, mean, spread)))
    scaled = means.withColumn("point", point)
    best = _rounds(scaled, _seeds(scaled, region, k, restarts, seed), most)
    centres = sorted([v * s + m for v, m, s in zip(c, mean, spread)] for c in best)
    ordered = _arrays([sorted(best, key=lambda c: [v * s + m for v, m, s in zip(c, mean, spread)])])[0]
    gaps = F.transform(ordered, lambda c: _apart(F.col("point"), c))
    cluster = (F.array_position("gaps", F.array_min("gaps")) - 1).cast("int")
    assigned = scaled.withColumn("gaps", gaps).select(region, cluster.alias("cluster"), *features).orderBy("cluster", region)
    schema = "cluster int, " + ", ".join(f"`{f}` double" for f in features)
    return assigned, df.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(centres)], schema)


def radar_profile(centres: DataFrame, features: list[str]) -> DataFrame:
    """Cluster centres scaled to 0-1 per feature; a flat feature shows 0."""
    from hearthpanel.operators.windows import minmax

    for feature in features:
        centres = minmax(centres, feature, name=feature, flat=0.0)
    return centres


# ---- lead-lag test ----------------------------------------------------------

#: A regression that leaves less than this share of its target is perfect, so that its F statistic is undefined.
PERFECT = 1e-12


def granger(
    df: DataFrame, y: str, x: str, *, max_lag: int = 4, group: str = "province", order_by: str = "ym", digits: int | None = 4
) -> DataFrame:
    """Does ``x`` lead ``y``? One F test per region and lag.

    Lagged columns come from a window over one row per region and period (rows
    that share a period count with their mean). One aggregate gives each region
    a moment matrix per lag; sweeping the lags of ``y``, then those of ``x``,
    leaves the two residual sums. A region needs more than ``3 * max_lag + 1``
    complete periods; regions with a flat series, with collinear lags or with a
    perfect fit at any lag are left out.
    """
    series = (
        df.select(group, order_by, _double(y).alias("_y"), _double(x).alias("_x"))
        .dropna()
        .groupBy(group, order_by)
        .agg(F.avg("_y").alias("y0"), F.avg("_x").alias("x0"))
    )
    ordered = Window.partitionBy(group).orderBy(order_by)
    lags = range(1, max_lag + 1)
    lagged = series.withColumns({f"{c}{i}": F.lag(f"{c}0", i).over(ordered) for c in "yx" for i in lags} | {"place": F.row_number().over(ordered)})

    def columns(lag: int) -> list[Column]:
        return [F.col(f"y{i}") for i in range(lag + 1)] + [F.col(f"x{i}") for i in range(1, lag + 1)]

    matrices = [moments.centred(columns(lag), F.col("place") > lag).alias(f"s{lag}") for lag in lags]
    varied = ((F.max("y0") > F.min("y0")) & (F.max("x0") > F.min("x0")) & (F.count(F.lit(1)) > 3 * max_lag + 1)).alias("usable")
    found = lagged.groupBy(group).agg(*matrices, varied).filter("usable")
    for lag in lags:
        matrix = F.col(f"s{lag}.matrix")
        start = moments.unswept(moments.scaled(matrix, moments.scales(matrix)))
        found = found.withColumn("own", moments.sweep(start, list(range(1, lag + 1))))
        found = found.withColumn("both", moments.sweep(F.col("own"), list(range(lag + 1, 2 * lag + 1))))
        restricted, full = moments.cell(F.col("own"), 0, 0), moments.cell(F.col("both"), 0, 0)
        df2 = F.col(f"s{lag}.n") - 2 * lag - 1
        good = (F.size("both.done") == 2 * lag) & (full > PERFECT)
        test = F.when(good, F.struct(F.lit(lag).alias("lag"), ((restricted - full) / lag / (full / df2)).alias("f"), df2.cast("double").alias("df2")))
        found = found.withColumn(f"t{lag}", test).drop("own", "both")
    for lag in lags:
        found = found.filter(F.col(f"t{lag}").isNotNull())
    tests = found.select(group, F.explode(F.array(*(f"t{lag}" for lag in lags))).alias("t")).select(group, "t.*")
    tested = tests.withColumn("p", f_pvalue(F.col("f"), F.col("lag"), F.col("df2")))
    rounded = (lambda c: F.bround(c, digits)) if digits is not None else F.col
    return tested.select(group, "lag", rounded("f").alias("f"), rounded("p").alias("p"), (F.col("p") < 0.05).alias("causal"))


# ---- forecast ---------------------------------------------------------------

HINGES = 8
SEASON_TERMS = 3
HINGE_RIDGE = 1.0
LEAST_RIDGE = 1e-8
BAND = 1.2815515655446004  # 80 % of a normal distribution on both sides
MIN_MONTHS = 24


def _trend(t: Column, last: Column, hinges: int) -> list[Column]:
    """Level, slope, and hinges in the first 80 % of the months."""
    knots = [0.8 * i / (hinges + 1) for i in range(1, hinges + 1)]
    return [F.lit(1.0), t, *(F.greatest(t - last * k, F.lit(0.0)) for k in knots)]


def _season(month: Column, seasons: int) -> list[Column]:
    angles = [month * (2 * math.pi * k / 12) for k in range(1, seasons + 1)]
    return [wave(angle) for angle in angles for wave in (F.sin, F.cos)]


def _dot(columns: list[Column], weights: Column, start: int = 0) -> Column:
    total = F.lit(0.0)
    for i, c in enumerate(columns):
        total = total + c * F.get(weights, F.lit(start + i))
    return total


def _weights(table: DataFrame, matrix: str, last: str, hinges: int, size: int, name: str) -> DataFrame:
    """Ridge regression weights from a matrix of products whose first row is the target's."""

    def damped(row: Column, i: Column) -> Column:
        ridge = F.when(i == 0, 0.0).when((i > 2) & (i <= 2 + hinges), HINGE_RIDGE * F.col(last)).otherwise(LEAST_RIDGE)
        return F.transform(row, lambda v, j: v + F.when(i == j, ridge).otherwise(0.0))

    regressors = list(range(1, size + 1))
    table = table.withColumn(matrix, F.transform(matrix, damped)).withColumn("units", moments.scales(F.col(matrix)))
    table = table.withColumn("state", moments.sweep(moments.unswept(moments.scaled(F.col(matrix), F.col("units"))), regressors))
    return table.withColumn(name, moments.slopes(F.col("state"), F.col("units"), 0, regressors)).drop("state", "units", matrix)


def _fitted(monthly: DataFrame, group: str, periods: int, hinges: int, seasons: int) -> DataFrame:
    """History, held-out months and future of every region with at least MIN_MONTHS, from one row per month."""
    region = Window.partitionBy(group)
    start = F.min("ds").over(region)
    months = (F.year("ds") - F.year(start)) * 12 + F.month("ds") - F.month(start)
    placed = monthly.withColumns(
        {"n": F.count(F.lit(1)).over(region), "place": F.row_number().over(region.orderBy("ds")), "t": months.cast("double")}
    ).filter(F.col("n") >= MIN_MONTHS)
    train = F.col("place") <= F.col("n") - F.least(F.lit(12), F.floor(F.col("n") / 4))
    placed = placed.withColumn("train", train)
    placed = placed.withColumns({"last": F.max("t").over(region), "last_train": F.max(F.when(F.col("train"), F.col("t"))).over(region)})
    t, season = F.col("t"), _season(F.month("ds"), seasons)
    whole, part = _trend(t, F.col("last"), hinges), _trend(t, F.col("last_train"), hinges)
    size, cut = len(whole) + len(season), len(whole)
    sums = placed.groupBy(group).agg(
        moments.products([F.col("y"), *whole, *season]).alias("whole"),
        moments.products([F.col("y"), *part, *season], F.col("train")).alias("part"),
        F.max("last").alias("reach"),
        F.max("last_train").alias("reach_train"),
    )
    weights = _weights(_weights(sums, "whole", "reach", hinges, size, "w"), "part", "reach_train", hinges, size, "v").select(group, "w", "v")
    joined = placed.join(weights, group)
    joined = joined.withColumns(
        {
            "trend": _dot(whole, F.col("w")),
            "yearly": _dot(season, F.col("w"), cut),
            "trend_train": _dot(part, F.col("v")),
            "yearly_train": _dot(season, F.col("v"), cut),
        }
    )
    off, off_train = F.col("y") - F.col("trend") - F.col("yearly"), F.col("y") - F.col("trend_train") - F.col("yearly_train")
    joined = joined.withColumns({"sigma": F.stddev_samp(off).over(region), "sigma_train": F.stddev_samp(F.when(F.col("train"), off_train)).over(region)})

    def point(part: str, ds: Column, actual: Column, trend: Column, yearly: Column, sigma: Column) -> Column:
        return F.struct(
            F.lit(part).alias("part"), ds.alias("ds"), actual.alias("actual"), trend.alias("trend"), yearly.alias("yearly"), sigma.alias("sigma")
        )

    def ahead(i: Column) -> Column:
        ds = F.add_months("ds", i)
        return point("future", ds, F.lit(None).cast("double"), _dot(_trend(t + i, F.col("last"), hinges), F.col("w")), _dot(_season(F.month(ds), seasons), F.col("w"), cut), F.col("sigma"))

    known = F.array(point("history", F.col("ds"), F.col("y"), F.col("trend"), F.col("yearly"), F.col("sigma")))
    held = F.array(point("holdout", F.col("ds"), F.col("y"), F.col("trend_train"), F.col("yearly_train"), F.col("sigma_train")))
    rows = F.when(F.col("train"), known).otherwise(F.concat(known, held))
    if periods > 0:
        future = F.transform(F.sequence(F.lit(1), F.lit(periods)), ahead)
        rows = F.when(F.col("place") == F.col("n"), F.concat(known, held, future)).otherwise(rows)
    fitted = joined.select(group, F.explode(rows).alias("r")).select(group, "r.*")
    yhat, band = F.col("trend") + F.col("yearly"), F.col("sigma") * BAND
    return fitted.select(
        group, "part", "ds", "actual", yhat.alias("yhat"), (yhat - band).alias("yhat_lower"), (yhat + band).alias("yhat_upper"), "trend", "yearly"
    )


def forecast(
    df: DataFrame, *, group: str = "province", periods: int = 12, price: str = "avg_price", hinges: int = HINGES, seasons: int = SEASON_TERMS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trend-and-season forecast of the monthly mean price of every region.

    Spark averages to one row per region and month. One aggregate gives each
    region its normal equations, over all months and over those before the
    held-out ones, which are solved as arrays; fits and bands are columns over
    the monthly rows. Returns history and future with an 80 % band, hold-out
    metrics, and the trend and season parts. Regions with fewer than 24 months
    are left out. ``hinges`` = 0 and ``seasons`` = 0 give a straight line.
    """
    monthly = (
        df.dropna(subset=[group, "year", "month"])
        .groupBy(group, F.make_date("year", "month", F.lit(1)).alias("ds"))
        .agg(F.avg(_double(price)).alias("y"))
        .filter(F.col("y").isNotNull())
    )
    fitted = _fitted(monthly, group, periods, hinges, seasons)
    series = fitted.filter(F.col("part") != "holdout")
    holdout = fitted.filter(F.col("part") == "holdout")
    metrics = holdout_metrics(holdout, group=group)
    components = series.select(group, "ds", "trend", "yearly")
    return series.drop("trend", "yearly"), metrics, components


def holdout_metrics(holdout: DataFrame, *, group: str = "province") -> DataFrame:
    error = F.col("actual") - F.col("yhat")
    return holdout.groupBy(group).agg(
        F.bround(F.avg(F.abs(error)), 1).alias("mae"),
        F.bround(F.avg(F.abs(ratio(error, "actual"))) * 100, 2).alias("mape"),
        F.bround(F.sqrt(F.avg(error * error)), 1).alias("rmse"),
    )


def holdout_errors(actual: DataFrame, predicted: DataFrame, *, keys: list[str]) -> DataFrame:
    """Predicted minus actual over the hold-out months, and as percent of actual."""
    joined = actual.select(*keys, "actual").join(predicted.select(*keys, "yhat"), keys)
    error = F.col("yhat") - F.col("actual")
    return joined.withColumns(
        {"error": F.bround(error, 0), "error_pct": F.bround(ratio(error, "actual") * 100, 2)}
    )
