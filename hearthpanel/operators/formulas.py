"""User formulas over panel columns.

A formula is arithmetic over column names. It is turned into one column
expression; nothing in it is executed as Python.
"""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.functions.numeric import finite_or_null
from hearthpanel.operators.scope import numeric_columns
from hearthpanel.operators.stats import pair_correlation
from hearthpanel.operators.windows import transform_series

MAX_FORMULAS = 4
FUNCTIONS = {"abs": F.abs, "sqrt": F.sqrt, "log": F.ln, "log10": F.log10, "exp": F.exp}
OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: F.try_divide, ast.Pow: F.pow}

PRESETS = {
    "pir_pension": "avg_price / (pension_per_head * 12 / 10000)",
    "deposit_ratio_pct": "deposit_only_avg_deposit / avg_price * 100",
    "price_to_income": "avg_price / household_income",
    "supply_intensity": "permits / population * 1000",
}

# Variables that may well be zero and so empty a formula that divides by them.
ZERO_PRONE = [
    "deal_count", "deposit_only_count", "monthly_rent_count", "all_leases_count", "permits",
    "pension_subscribers", "pension_workplaces", "household_income", "earners", "pay_total",
    "turnover", "lease_turnover",
]


class FormulaError(ValueError):
    pass


def _build(node: ast.AST, variables: set[str]) -> Column:
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
        return F.lit(float(node.value))
    if isinstance(node, ast.Name):
        if node.id not in variables:
            raise FormulaError(f"unknown variable {node.id!r}")
        return F.col(f"`{node.id}`").cast("double")
    if isinstance(node, ast.BinOp) and type(node.op) in OPERATORS:
        return OPERATORS[type(node.op)](_build(node.left, variables), _build(node.right, variables))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        value = _build(node.operand, variables)
        return -value if isinstance(node.op, ast.USub) else value
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS:
        if len(node.args) == 1 and not node.keywords:
            return FUNCTIONS[node.func.id](_build(node.args[0], variables))
    raise FormulaError(f"not allowed in a formula: {ast.unparse(node)}")


def formula_column(formula: str, variables: list[str]) -> Column:
    """Column for a formula; infinite and undefined results become null."""
    try:
        tree = ast.parse(formula.strip(), mode="eval")
    except (SyntaxError, ValueError) as error:
        raise FormulaError(str(error)) from error
    return finite_or_null(_build(tree.body, set(variables)))


def _or_null(formula: str, variables: list[str]) -> Column:
    try:
        return formula_column(formula, variables)
    except FormulaError:
        return F.lit(None).cast("double")


def with_formulas(
    df: DataFrame, formulas: dict[str, str], *, provinces: list[str] | None = None, order_by: str = "year"
) -> DataFrame:
    """Up to four labelled formulas per region and period; a bad one is all null."""
    if len(formulas) > MAX_FORMULAS:
        raise ValueError(f"at most {MAX_FORMULAS} formulas, got {len(formulas)}")
    if provinces:
        df = df.filter(F.col("province").isin(list(provinces)))
    variables = numeric_columns(df)
    columns = [_or_null(formula, variables).alias(label) for label, formula in formulas.items()]
    return df.filter(F.col("province").isNotNull()).select(order_by, "province", *columns)


def check_formula(df: DataFrame, formula: str, *, order_by: str = "year") -> DataFrame:
    """One row: number of valid results, the first of them, and zero-prone divisors."""
    value = formula_column(formula, numeric_columns(df))
    warned = [v for v in ZERO_PRONE if v in formula] if "/" in formula else []
    valued = df.select(order_by, "province", value.alias("value")).filter(F.col("value").isNotNull())
    return valued.agg(
        F.count(F.lit(1)).alias("valid_rows"),
        F.min_by("value", F.struct("province", order_by)).alias("first_value"),
    ).withColumn("zero_prone", F.lit(", ".join(warned)))


def compare_formulas(
    df: DataFrame, left: str, right: str, *, province: str, mode: str = "raw", base_period=None, order_by: str = "year"
) -> DataFrame:
    """Correlation of two series of one region after the chosen transform."""
    region = df.filter(F.col("province") == province)

    def series(column: str) -> DataFrame:
        present = region.select("province", order_by, column).dropna(subset=[column])
        changed = transform_series(present, column, mode=mode, base_period=base_period, order_by=order_by)
        return changed.select(order_by, column)

    return pair_correlation(series(left).join(series(right), order_by).dropna(), left, right)
