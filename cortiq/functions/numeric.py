"""Inverse distribution functions (no scipy here), and their use as vectorised Spark functions."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def f_cdf(x: float, d1: float, d2: float) -> float:
    return beta_cdf(d1 * x / (d1 * x + d2), d1 / 2, d2 / 2) if x > 0 else 0.0


def f_quantile(q: float, d1: float, d2: float) -> float:
    """x with F(x) = q, by bisection on the beta scale."""
    if not 0 <= q < 1:
        return math.inf if q == 1 else math.nan
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, d1 / 2, d2 / 2) < q else (low, mid)
    x = (low + high) / 2
    return d2 * x / (d1 * (1 - x)) if x < 1 else math.inf


def alpha_interval(alpha: float, n: int, m: int, level: float | tuple[float, float] = 0.95) -> tuple[float, float]:
    """Feldt's interval of Cronbach's alpha of n repetitions and m units; a level is symmetric, a pair gives both tails."""
    low, high = ((1 - level) / 2, 1 - (1 - level) / 2) if isinstance(level, float) else level
    d1, d2 = m - 1, (n - 1) * (m - 1)
    return 1 - (1 - alpha) * f_quantile(high, d1, d2), 1 - (1 - alpha) * f_quantile(low, d1, d2)


def inverse_normal(p: Column) -> Column:
    """The standard normal quantile of p."""

    @pandas_udf("double")
    def quantiles(s: pd.Series) -> pd.Series:
        inverse = NormalDist().inv_cdf
        return s.map(lambda v: inverse(v) if 0 < v < 1 else math.nan, na_action="ignore").astype(float)

    return quantiles(p)


def alpha_bounds(alpha: Column, n: Column, m: Column, level: float = 0.95) -> Column:
    """alpha_interval of each row, as struct<lower, upper>."""

    @pandas_udf("lower double, upper double")
    def bounds(a: pd.Series, n: pd.Series, m: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([alpha_interval(*x, level) for x in zip(a, n, m, strict=True)], columns=["lower", "upper"])

    return F.when(alpha.isNotNull(), bounds(alpha, n, m))
