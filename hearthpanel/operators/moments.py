"""Moment matrices of groups and their sweeps: regressions of every group in one aggregate, solved in the JVM.

Sums of products combine before the shuffle, so a group of any size arrives as
one matrix per task. What is left is a matrix of a few dozen columns per group,
held as an array of rows and solved by array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.functions.numeric import nan_to_null
from hearthpanel.functions.tails import t_pvalue

#: A column whose spread is this small a share of itself once others are taken out counts as their combination.
TOLERANCE = 1e-10


def _matrix(cell, size: int) -> Column:
    return F.array(*(F.array(*(cell(min(i, j), max(i, j)) for j in range(size))) for i in range(size)))


def centred(columns: list[Column], when: Column | None = None) -> Column:
    """Aggregate of complete rows: their number, means and centred sums of products, as a struct (n, means, matrix)."""
    columns = columns if when is None else [F.when(when, c) for c in columns]
    n = F.count(columns[0])
    return F.struct(
        n.alias("n"),
        F.array(*(F.avg(c) for c in columns)).alias("means"),
        _matrix(lambda i, j: F.covar_samp(columns[i], columns[j]) * (n - 1), len(columns)).alias("matrix"),
    )


def products(columns: list[Column], when: Column | None = None) -> Column:
    """Aggregate of complete rows: the matrix of their sums of products."""
    columns = columns if when is None else [F.when(when, c) for c in columns]
    return _matrix(lambda i, j: F.sum(columns[i] * columns[j]), len(columns))


def scaled(matrix: Column, scales: Column) -> Column:
    """A matrix with each cell divided by the scales of its row and column; cells without scale are 0."""

    def row(cells: Column, i: Column) -> Column:
        return F.transform(cells, lambda v, j: F.coalesce(F.try_divide(v, F.get(scales, i) * F.get(scales, j)), F.lit(0.0)))

    return F.transform(matrix, row)


def scales(matrix: Column) -> Column:
    """Roots of a matrix's diagonal."""
    return F.transform(matrix, lambda row, i: F.sqrt(F.greatest(F.get(row, i), F.lit(0.0))))


def sweep(state: Column, pivots: list[int]) -> Column:
    """Sweep rows of a scaled symmetric matrix, one after the other; ``state`` is a struct of (m, done).

    After the regressors are swept, the row of the target holds their slopes,
    its own cell the share of it that is left, and their block the negative
    inverse. Pivots under TOLERANCE are left out; ``done`` lists those that
    were taken.
    """

    def step(acc: Column, k: Column) -> Column:
        m = acc["m"]
        pivot_row = F.get(m, k)
        pivot = F.get(pivot_row, k)

        def row(cells: Column, i: Column) -> Column:
            side = F.get(cells, k)

            def cell(v: Column, j: Column) -> Column:
                inner = v - side * F.get(pivot_row, j) / pivot
                return F.when((i == k) & (j == k), -1.0 / pivot).when((i == k) | (j == k), v / pivot).otherwise(inner)

            return F.transform(cells, cell)

        taken = F.struct(F.transform(m, row).alias("m"), F.concat(acc["done"], F.array(k)).alias("done"))
        return F.when(pivot > TOLERANCE, taken).otherwise(acc)

    return F.aggregate(F.array(*(F.lit(k) for k in pivots)), state, step) if pivots else state


def unswept(matrix: Column) -> Column:
    return F.struct(matrix.alias("m"), F.array().cast("array<int>").alias("done"))


def slopes(state: Column, units: Column, target: int, regressors: list[int]) -> Column:
    """Slopes of the target on its swept regressors in their own units, 0 for those left out."""

    def slope(i: int) -> Column:
        own = F.get(F.get(state["m"], F.lit(target)), F.lit(i)) * F.try_divide(F.get(units, F.lit(target)), F.get(units, F.lit(i)))
        return F.when(F.array_contains(state["done"], i), own).otherwise(F.lit(0.0))

    return F.array(*(slope(i) for i in regressors))


def cell(state: Column, i: int, j: int) -> Column:
    return F.get(F.get(state["m"], F.lit(i)), F.lit(j))


def ols_by(df: DataFrame, y: str, xs: list[str], *, by: list[str], least: int = 10) -> DataFrame:
    """A regression with intercept for every group: one row per group and term, intercept first.

    Rows with a null key, or a null or NaN in any column, are left out, as are
    groups of fewer than ``least`` complete rows or without a degree of freedom. Of regressors
    that are combinations of earlier ones the coefficient is 0 and its error
    null. One aggregate per group, no Python but for the p-values.
    """
    names = [y, *xs]
    complete = df.select(*by, *(nan_to_null(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(names))).dropna()
    size = len(names)
    found = complete.groupBy(*by).agg(centred([F.col(f"c{i}") for i in range(size)]).alias("s")).filter(F.col("s.n") >= least)
    found = found.withColumn("units", scales(F.col("s.matrix")))
    found = found.withColumn("state", sweep(unswept(scaled(F.col("s.matrix"), F.col("units"))), list(range(1, size))))
    state, units, means = F.col("state"), F.col("units"), F.col("s.means")
    found = found.withColumn("slopes", slopes(state, units, 0, list(range(1, size)))).withColumn("df", F.col("s.n") - 1 - F.size("state.done"))
    found = found.filter(F.col("df") > 0)
    spread = F.get(units, F.lit(0))
    left = F.greatest(cell(state, 0, 0), F.lit(0.0))
    variance = left * spread * spread / F.col("df")

    def inverse(i: int, j: int) -> Column:
        both = F.array_contains(state["done"], i) & F.array_contains(state["done"], j)
        return F.when(both, -F.try_divide(cell(state, i, j), F.get(units, F.lit(i)) * F.get(units, F.lit(j)))).otherwise(F.lit(0.0))

    mean = [F.get(means, F.lit(i)) for i in range(size)]
    slope = [F.get("slopes", F.lit(i - 1)) for i in range(1, size)]
    intercept, lever = mean[0], 1.0 / F.col("s.n")
    for i in range(1, size):
        intercept = intercept - slope[i - 1] * mean[i]
        for j in range(1, size):
            lever = lever + mean[i] * mean[j] * inverse(i, j)

    def term(i: int) -> Column:
        value = slope[i - 1] if i else intercept
        share = inverse(i, i) if i else lever
        error = F.when(F.lit(i == 0) | F.array_contains(state["done"], i), F.sqrt(variance * share))
        return F.struct(F.lit(i).alias("position"), F.lit(names[i] if i else "intercept").alias("variable"), value.alias("coefficient"), error.alias("std_error"))

    fit = F.when(spread > 0, 1.0 - left)
    terms = found.select(*by, F.explode(F.array(*(term(i) for i in range(size)))).alias("term"), F.col("s.n").alias("n"), "df", fit.alias("r_squared"))
    tested = terms.select(*by, "term.*", "n", "df", "r_squared").withColumn("t", F.try_divide("coefficient", "std_error"))
    return tested.select(*by, "position", "variable", "coefficient", "std_error", "t", t_pvalue(F.col("t"), F.col("df")).alias("p"), "n", "r_squared")
