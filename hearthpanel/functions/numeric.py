"""Column helpers for amounts, ratios and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def clean_amount(value) -> Column:
    """Whole amount from text such as ``"12,500"``; anything else is null."""
    stripped = F.trim(F.regexp_replace(_col(value).cast("string"), '[,"]', ""))
    return stripped.try_cast("bigint")


def clean_double(value) -> Column:
    """Decimal amount from text with thousands commas; anything else is null."""
    stripped = F.trim(F.regexp_replace(_col(value).cast("string"), '[,"]', ""))
    return nan_to_null(stripped.try_cast("double"))


def nan_to_null(value) -> Column:
    column = _col(value)
    return F.when(~F.isnan(column), column)


def finite_or_null(value) -> Column:
    """Null for NaN and both infinities."""
    column = _col(value).cast("double")
    return F.when(~F.isnan(column) & (F.abs(column) != F.lit(float("inf"))), column)


def ratio(top, bottom, scale: float | None = None) -> Column:
    """``top / bottom`` as double, null where the divisor is zero or missing."""
    value = F.try_divide(_col(top).cast("double"), _col(bottom).cast("double"))
    return value if scale is None else value * F.lit(float(scale))


def half_even(value, digits: int | None) -> Column:
    """Banker's rounding; ``digits=None`` leaves the value as it is."""
    return _col(value) if digits is None else F.bround(_col(value), digits)


def clamp(value, low: float, high: float) -> Column:
    column = _col(value)
    bounded = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), column))
    return F.when(column.isNotNull(), bounded)


def annuity_present_value(payment, monthly_rate: float, payments: int) -> Column:
    """Loan principal that a level monthly payment can carry."""
    pay = _col(payment).cast("double")
    if monthly_rate > 0:
        return pay * F.lit((1 - (1 + monthly_rate) ** (-payments)) / monthly_rate)
    return pay * F.lit(float(payments))
