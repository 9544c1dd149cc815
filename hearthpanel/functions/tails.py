"""Two-sided t and upper F tail probabilities for small result tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _log_gamma(x: np.ndarray) -> np.ndarray:
    # Lanczos approximation, g = 7, nine coefficients (published constants).
    coefficients = (
        0.99999999999980993,
        676.5203681218851,
        -1259.1392167224028,
        771.32342877765313,
        -176.61502916214059,
        12.507343278686905,
        -0.13857109526572012,
        9.9843695780195716e-6,
        1.5056327351493116e-7,
    )
    shifted = x - 1.0
    series = np.full_like(shifted, coefficients[0])
    for i, c in enumerate(coefficients[1:], start=1):
        series = series + c / (shifted + i)
    t = shifted + 7.5
    return 0.5 * np.log(2 * np.pi) + (shifted + 0.5) * np.log(t) - t + np.log(series)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 400) -> np.ndarray:
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    value = d
    for m in range(1, steps):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            value = value * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return value


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function, element by element."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    out = np.full(x.shape, np.nan)
    out[x <= 0] = 0.0
    out[x >= 1] = 1.0
    inner = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    if inner.any():
        p, q, z = a[inner], b[inner], x[inner]
        swap = z > (p + 1) / (p + q + 2)
        p2, q2, z2 = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, 1 - z, z)
        front = np.exp(
            _log_gamma(p2 + q2) - _log_gamma(p2) - _log_gamma(q2) + p2 * np.log(z2) + q2 * np.log1p(-z2)
        )
        tail = front * _beta_fraction(p2, q2, z2) / p2
        out[inner] = np.where(swap, 1 - tail, tail)
    return out


def t_tail(t, df) -> np.ndarray:
    """P(|T| > |t|) for ``df`` degrees of freedom."""
    t, df = np.broadcast_arrays(np.asarray(t, dtype=float), np.asarray(df, dtype=float))
    with np.errstate(invalid="ignore", divide="ignore"):
        x = np.where(np.isinf(t), 0.0, df / (df + t * t))
    out = incomplete_beta(df / 2.0, np.full(df.shape, 0.5), x)
    return np.where(np.isnan(t), np.nan, out)


def f_tail(f, d1, d2) -> np.ndarray:
    """P(F > f) for (d1, d2) degrees of freedom."""
    f, d1, d2 = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (f, d1, d2)))
    with np.errstate(invalid="ignore", divide="ignore"):
        x = np.where(np.isinf(f), 0.0, d2 / (d2 + d1 * f))
    out = incomplete_beta(d2 / 2.0, d1 / 2.0, x)
    return np.where(np.isnan(f), np.nan, out)


@F.pandas_udf(DoubleType())
def _t_tail_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_tail(t, df)).where(t.notna().to_numpy() & df.notna().to_numpy())


@F.pandas_udf(DoubleType())
def _f_tail_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_tail(f, d1, d2)).where(f.notna().to_numpy())


def t_pvalue(t: Column, df: Column) -> Column:
    p = _t_tail_udf(t.cast("double"), df.cast("double"))
    return F.when(~F.isnan(p), p)


def f_pvalue(f: Column, d1: Column, d2: Column) -> Column:
    p = _f_tail_udf(f.cast("double"), d1.cast("double"), d2.cast("double"))
    return F.when(~F.isnan(p), p)


def correlation_pvalue(r: Column, n: Column) -> Column:
    """Two-sided p of a Pearson correlation over ``n`` pairs; |r| = 1 gives 0."""
    df = n.cast("double") - 2
    t = r * F.sqrt(F.try_divide(df, F.greatest(F.lit(0.0), 1 - r * r)))
    return F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(t_pvalue(t, df))
