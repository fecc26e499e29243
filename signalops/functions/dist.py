"""Tail probabilities of the t and F laws, applied to result-sized batches only."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by a continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - betainc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + num / c
        c = c if abs(c) > tiny else tiny
        f *= c * d
        if i and abs(1.0 - c * d) < 1e-15:
            break
    return front * (f - 1.0)


def t_two_sided(t: float, df: float) -> float:
    if not (math.isfinite(t) and df > 0):
        return float("nan")
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def f_upper(stat: float, d1: float, d2: float) -> float:
    if not (math.isfinite(stat) and d1 > 0 and d2 > 0):
        return float("nan")
    return 1.0 if stat <= 0 else betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * stat))


def t_quantile(p: float, df: float) -> float:
    """Upper-half quantile of the t law by bisection (p > 0.5)."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if 1.0 - t_two_sided(mid, df) / 2.0 < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(t, df)],
                     dtype="float64").replace({np.nan: None}).astype("float64")


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_upper(a, b, c) if pd.notna(a) and pd.notna(b) and pd.notna(c) else None
                      for a, b, c in zip(f, d1, d2)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_critical(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_quantile(a, b) for a, b in zip(p, df)], dtype="float64")
