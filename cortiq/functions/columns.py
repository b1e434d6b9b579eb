"""Column expressions that stay inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan"))


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """a / b, null (or `empty`) where b is zero."""
    out = F.try_divide(a, b)
    return out if empty is None else F.coalesce(out, F.lit(empty))


def correlation(x: Column, y: Column, constant: float = float("nan")) -> Column:
    """Aggregate: Pearson correlation; `constant` where a side does not vary (the built-in raises there)."""
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), F.lit(1)))
    cov = F.covar_pop(x, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(flat | (n == 0), F.lit(constant)).otherwise(F.coalesce(F.try_divide(cov, spread), F.lit(constant)))


def cosine(x: Column, y: Column) -> Column:
    """Aggregate: cosine similarity; NaN where a side is zero."""
    return F.coalesce(F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x) * F.sum(y * y))), nan())


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cross(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> tuple[Column, Column, Column]:
    return ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx


def spearman_brown(r: Column, n: Column) -> Column:
    """Reliability of a test n times as long."""
    return ratio(n * r, 1.0 + (n - 1.0) * r)


def spearman_brown_length(r: Column, wanted: Column) -> Column:
    """How many times as long a test must be for the wanted reliability."""
    return ratio(wanted - r * wanted, r - r * wanted)


def triangle_side(n: Column) -> Column:
    """N of N (N + 1) / 2 = n; raises where there is none."""
    side = F.floor((F.sqrt(8.0 * n + 1.0) - 1.0) / 2.0).cast("long")
    return F.when(side * (side + 1) == 2 * n, side).otherwise(F.raise_error(F.lit("not the size of a triangle with its diagonal")))


def narrowest_type(low: Column, high: Column, whole: Column) -> Column:
    """The narrowest of Spark's integer types for [low, high]; double where values have fractions."""
    name = F.lit("bigint")
    for kind, bits in (("int", 31), ("smallint", 15), ("tinyint", 7)):
        name = F.when((low >= -(2**bits)) & (high < 2**bits), F.lit(kind)).otherwise(name)
    return F.when(whole, name).otherwise(F.lit("double"))
