"""Values to colored pixels: the relational part of plotting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats

GYRI, SULCI = (0.8, 0.8, 0.8, 1.0), (0.6, 0.6, 0.6, 1.0)


def value_range(values: DataFrame, x: str = "x") -> tuple[float, float]:
    """The 1st and 99th percentile of the numbers, from range-partitioned counts."""
    found = {r["share"]: r["value"] for r in stats.quantiles(values, x, [0.01, 0.99]).collect()}
    return (found[0.01], found[0.99]) if found else (0.0, 1.0)


def scaled(x: Column, vmax: float, vmin: float | None = None) -> Column:
    """x in [vmin, vmax] to [0, 1]; vmin is -vmax by default."""
    vmin = -vmax if vmin is None else vmin
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - vmin) / (vmax - vmin)))


def colored(values: DataFrame, colormap: DataFrame, gyri: DataFrame, vmax: float, vmin: float | None = None, alpha: Column | None = None) -> DataFrame:
    """(v, r, g, b, a) of values(v, x): the colormap's (k 0 to 255, r, g, b, a) color; NaN shows the surface, and alpha blends with it."""
    level = F.least(F.floor(scaled(F.col("x"), vmax, vmin) * 256), F.lit(255)).cast("int")
    placed = values.join(gyri, "v").withColumn("k", F.when(F.isnan("x"), F.lit(None)).otherwise(level)).join(F.broadcast(colormap), "k", "left")
    out = []
    for i, c in enumerate("rgba"):
        ground = F.when(F.col("gyrus"), GYRI[i]).otherwise(SULCI[i])
        own = F.col(c) if alpha is None or c == "a" else F.col(c) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), alpha)) + ground * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), alpha)))
        out.append(F.coalesce(own, ground).alias(c))
    return placed.select("v", *out)


def pixels(colors: DataFrame, lookup: DataFrame) -> DataFrame:
    """(row, col, r, g, b, a) by the pixel table (row, col, v); pixels of no vertex are transparent white."""
    blank = {"r": 1.0, "g": 1.0, "b": 1.0, "a": 0.0}
    return lookup.join(colors, "v", "left").select("row", "col", *[F.coalesce(k, F.lit(v)).alias(k) for k, v in blank.items()])


def stacked(images: DataFrame, sizes: DataFrame, vertical: bool = True, offset: int = 0, padding: int = 0) -> DataFrame:
    """Pixels of images(image, row, col, ..) one after the other, centred across; sizes(image, height, width)."""
    from pyspark.sql import Window

    along, across = ("height", "width") if vertical else ("width", "height")
    before = Window.orderBy("image").rowsBetween(Window.unboundedPreceding, -1)  # a row for each image
    place = sizes.withColumn("begin", F.coalesce(F.sum(F.col(along) + padding).over(before), F.lit(0)) + offset).withColumn("side", F.floor((F.max(across).over(Window.partitionBy()) - F.col(across)) / 2))
    moved = images.join(F.broadcast(place), "image")
    first, second = ("row", "col") if vertical else ("col", "row")
    return moved.withColumn(first, F.col(first) + F.col("begin")).withColumn(second, F.col(second) + F.col("side")).drop("height", "width", "begin", "side", "image")
