"""Tumbling segments of a signal that arrives as a stream: the bounded segments of an index, kept up as rows come in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segment_means(stream: DataFrame, time: str, value: str, keys: list[str], length: str, late: str = "1 hour") -> DataFrame:
    """(start, keys, n, mean, deviation) of each segment of `length`; rows later than `late` are dropped, closed segments leave the state."""
    w = F.window(time, length)
    out = stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "mean", "deviation")
