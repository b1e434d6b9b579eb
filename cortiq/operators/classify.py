"""Identification of time segments: is a measured segment nearest to its own prediction?"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .linalg import blocked

#: Numbers in a block of segments, and distances that a task holds at once.
BLOCK_NUMBERS, TILE = 250_000, 1_000_000


def segments(rows: DataFrame, size: int, npc: int | None = None) -> DataFrame:
    """(seg, x): vectors of `size` consecutive t of rows(t, x array), side by side; an incomplete last one is dropped."""
    x = F.slice("x", 1, npc) if npc else F.col("x")
    cut = rows.select(F.floor(F.col("t") / size).cast("long").alias("seg"), (F.col("t") % size).alias("k"), x.alias("x"))
    packed = cut.groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("parts"))
    return packed.where(F.size("parts") == size).select("seg", F.flatten(F.transform("parts", lambda p: p["x"])).alias("x"))


def _distances(x: np.ndarray, y: np.ndarray, metric: str | Callable) -> np.ndarray:
    if callable(metric):
        return metric(x, y)
    if metric == "correlation":
        x, y = (a - a.mean(axis=1, keepdims=True) for a in (x, y))
        x, y = (a / np.where(n > 0, n, 1) for a, n in ((a, np.linalg.norm(a, axis=1, keepdims=True)) for a in (x, y)))
        return 1 - x @ y.T
    if metric == "euclidean":
        return np.stack([np.sqrt(((y - row) ** 2).sum(axis=1)) for row in x])
    raise ValueError(f"no metric is called {metric}")


def _nearest(x: np.ndarray, y: np.ndarray, metric: str | Callable) -> tuple[np.ndarray, np.ndarray]:
    """(distance, place) of the nearest of y to each of x by rounded distances, the first on ties.

    Euclidean distances are measured exactly only where a product of matrices cannot rule a pair out.
    """
    if metric != "euclidean":
        d = np.round(_distances(x, y, metric), 12)
        return d.min(axis=1), d.argmin(axis=1)
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    rough = yy - 2 * (x @ y.T)
    rough += xx[:, None]
    # Rounding of the product, and what rounding of distances to 12 digits may hide.
    low = np.maximum(rough.min(axis=1), 0)
    slack = 1e-13 * x.shape[1] * (xx + yy.max()) + 4e-12 * (np.sqrt(low) + 1e-5)
    if not np.isfinite(slack).all():
        d = np.round(_distances(x, y, metric), 12)
        return d.min(axis=1), d.argmin(axis=1)
    i, j = np.nonzero(rough <= (low + slack)[:, None])
    d = np.concatenate([np.sqrt(((x[i[k : k + 4096]] - y[j[k : k + 4096]]) ** 2).sum(axis=1)) for k in range(0, len(i), 4096)]).round(12)
    order = np.lexsort((j, d, i))
    first = order[np.searchsorted(i[order], np.arange(len(x)))]
    return d[first], j[first]


def identified(measured: DataFrame, predicted: DataFrame, size: int = 1, npc: int | None = None, metric: str | Callable = "correlation", block: int | None = None) -> DataFrame:
    """(seg, nearest, correct): the predicted segment nearest to each measured one, the first on ties.

    Every measured segment is compared with every predicted one, as the definition asks. Blocks of either side (of about BLOCK_NUMBERS) are
    a row of a table in the shared folder; a task reads pairs of them from there, so that no row is shuffled once for each block, and only
    the nearest of each block leaves it. metric is correlation, euclidean, or a function of two matrices that gives the distances of their rows.
    """
    spark = measured.sparkSession

    def packed(side: DataFrame, names: tuple[str, str], most: int) -> DataFrame:
        rows = written(spark, segments(side, size, npc), "segments")
        width = rows.select(F.coalesce(F.max(F.size("x")), F.lit(1))).first()[0]
        cut, n = blocked(rows, "seg", block or max(1, min(most, BLOCK_NUMBERS // max(width, 1))))
        # A row and a file for each block; Spark reads as many at once as its partitions of files may have bytes.
        lists = cut.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("seg", "x"))).alias("e"))
        lists = lists.select(F.transform("e", lambda e: e["seg"]).alias(names[0]), F.flatten(F.transform("e", lambda e: e["x"])).alias(names[1]))
        return written(spark, lists.repartition(min(n, 4096)), "segment-blocks")

    a, b = packed(measured, ("seg", "x"), 8192), packed(predicted, ("other", "y"), 8192)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, x, other, y in zip(*(batch.column(k) for k in ("seg", "x", "other", "y")), strict=True):
                seg, other = seg.values.to_numpy(), other.values.to_numpy()
                x, y = x.values.to_numpy().reshape(len(seg), -1), y.values.to_numpy().reshape(len(other), -1)
                step = max(1, TILE // len(other))
                parts = [_nearest(x[k : k + step], y, metric) for k in range(0, len(x), step)]
                d, at = (np.concatenate(p) for p in zip(*parts, strict=True))
                yield pa.RecordBatch.from_pydict({"seg": pa.array(seg, pa.int64()), "d": d, "other": pa.array(other[at], pa.int64())})

    best = a.hint("shuffle_replicate_nl").crossJoin(b).mapInArrow(compare, "seg long, d double, other long").groupBy("seg").agg(F.min(F.struct("d", "other")).alias("c"))
    return best.select("seg", F.col("c.other").alias("nearest"), (F.col("c.other") == F.col("seg")).alias("correct"))


def accuracy(measured: DataFrame, predicted: DataFrame, size: int = 1, npc: int | None = None, metric: str | Callable = "correlation", reduce: str | Callable[[Column], Column] | None = "avg") -> DataFrame:
    """The share of segments identified, by an SQL aggregate of the flags, or a function that makes one of a column; None gives the flags themselves."""
    flags = identified(measured, predicted, size, npc, metric)
    if reduce is None:
        return flags
    correct = F.col("correct").cast("double")
    return flags.agg((reduce(correct) if callable(reduce) else F.expr(f"{reduce}(CAST(correct AS DOUBLE))")).alias("accuracy"))
