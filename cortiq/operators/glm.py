"""General linear model of every vertex on one design: contrasts, t values and R squared."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dot(names: list[str], weights: list[Column]) -> Column:
    out = F.lit(0.0)
    for n, w in zip(names, weights, strict=True):
        out = out + F.col(n) * w
    return out


def _solved(inverse: np.ndarray, names: list[str]) -> list[Column]:
    """Weights from the sums xy_<name>, by the rows of the inverse."""
    return [sum((F.col(f"xy_{n}") * float(v) for n, v in zip(names, row, strict=True)), F.lit(0.0)) for row in inverse]


def _inverse(design: DataFrame, names: list[str]) -> tuple[np.ndarray, int]:
    """((X'X)^-1, rows) of a design table; raises if it is singular."""
    sums = design.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    m = np.array([[sums[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(names))] for i in range(len(names))], float)
    if np.linalg.matrix_rank(m, tol=1e-10 * max(np.abs(m).max(), 1e-300), hermitian=True) < len(names):
        raise ValueError("the design is singular")
    return np.linalg.inv(m), int(sums["n"])


def glm(signal: DataFrame, design: DataFrame, names: list[str], nuisance: list[str] = (), contrasts: list[list[float]] | None = None, return_r2: bool = False, key: str = "t", by: str = "v") -> DataFrame:
    """(by, contrast, beta, t[, r2]) of signal(key, by, x) on design(key, names, nuisance); no intercept is added.

    Weights come from X'X, which the design alone gives, and one aggregate of X'y by vertex; residuals from a second pass.
    Contrasts are over `names`; by default each regressor's own. R squared is adjusted, against zero or the nuisance fit.
    """
    every = [*names, *nuisance]
    inverse, n = _inverse(design, every)
    dof = n - len(every)
    joined = signal.join(design.select(key, *every), key)
    sums = joined.groupBy(by).agg(*[F.sum(F.col(c) * F.col("x")).alias(f"xy_{c}") for c in every])
    weights = sums.select(by, *[w.alias(f"b_{c}") for c, w in zip(every, _solved(inverse, every), strict=True)])
    if nuisance and return_r2:
        small, _ = _inverse(design, list(nuisance))
        weights = weights.join(sums.select(by, *[w.alias(f"c_{c}") for c, w in zip(nuisance, _solved(small, list(nuisance)), strict=True)]), by)
    fitted = joined.join(weights, by)
    rest = F.col("x") - _dot(every, [F.col(f"b_{c}") for c in every])
    base = F.col("x") - _dot(list(nuisance), [F.col(f"c_{c}") for c in nuisance]) if nuisance and return_r2 else F.col("x")
    errors = fitted.groupBy(by).agg(F.sum(rest * rest).alias("rss"), F.sum(base * base).alias("tss"))
    both = weights.join(errors, by)
    rows = []
    for k, c in enumerate(contrasts or np.eye(len(names)).tolist()):
        c = [*c, *[0.0] * (len(every) - len(c))]
        spread = float(np.array(c) @ inverse @ np.array(c))
        beta = sum((F.col(f"b_{name}") * float(v) for name, v in zip(every, c, strict=True)), F.lit(0.0))
        t = F.try_divide(beta, F.sqrt(F.col("rss") / dof * spread))
        rows.append(F.struct(F.lit(k).alias("contrast"), beta.alias("beta"), t.alias("t")))
    out = both.select(by, "rss", "tss", F.explode(F.array(*rows)).alias("c")).select(by, "c.contrast", "c.beta", "c.t", "rss", "tss")
    if return_r2:
        out = out.withColumn("r2", 1.0 - F.try_divide(F.col("rss") * (n - len(nuisance)), F.col("tss") * dof))
    return out.drop("rss", "tss")
