"""Reliability and correlation statistics as grouped aggregates.

scores(rep, unit, x) and further key columns: a value of each repetition (item, rater, subject) for each unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import correlation, finite, ratio
from ..functions.numeric import alpha_bounds, inverse_normal
from ..sources.scratch import written


def pearson(df: DataFrame, x: str, y: str, by: list[str], constant: float = float("nan")) -> DataFrame:
    return df.groupBy(*by).agg(correlation(F.col(x), F.col(y), constant).alias("r"))


def cronbach_alpha(scores: DataFrame, by: list[str] = (), level: float | None = None) -> DataFrame:
    """(by, alpha, n, m and, for a level, lower and upper): n repetitions, m units."""
    items = scores.groupBy(*by, "rep").agg(F.var_samp("x").alias("spread")).groupBy(*by).agg(F.sum("spread").alias("items"), F.count(F.lit(1)).alias("n"))
    sums = scores.groupBy(*by, "unit").agg(F.sum("x").alias("x")).groupBy(*by).agg(F.var_samp("x").alias("total"), F.count(F.lit(1)).alias("m"))
    both = items.join(sums, list(by)) if by else items.crossJoin(sums)  # a row each without keys
    alpha = F.col("n") / (F.col("n") - 1) * (1.0 - ratio(F.col("items"), F.col("total")))
    out = both.select(*by, F.when(F.col("n") > 1, alpha).alias("alpha"), "n", "m")
    if level is not None:
        out = out.withColumn("bounds", alpha_bounds(F.col("alpha"), F.col("n"), F.col("m"), level)).select("*", "bounds.lower", "bounds.upper").drop("bounds")
    return out


def noise_ceilings(scores: DataFrame, by: list[str] = (), with_alpha: bool = False) -> DataFrame:
    """(by, rep, lower, upper): correlation over units of a repetition with the sum of the others, and with the sum of all."""
    total = scores.groupBy(*by, "unit").agg(F.sum("x").alias("total"))
    both = scores.join(total, [*by, "unit"])
    x, s = F.col("x"), F.col("total")
    out = both.groupBy(*by, "rep").agg(correlation(x, s - x).alias("lower"), correlation(x, s).alias("upper"))
    if with_alpha:
        # Alpha without a repetition, from sums over all: neither the rows nor the others are copied for each left out.
        own = scores.groupBy(*by, "rep").agg(F.var_samp("x").alias("spread"))
        every = own.groupBy(*by).agg(F.sum("spread").alias("items"), F.count(F.lit(1)).alias("n"))
        rest = both.groupBy(*by, "rep").agg(F.var_samp(s - x).alias("total"))
        joined = own.join(rest, [*by, "rep"])
        joined = joined.join(every, list(by)) if by else joined.crossJoin(F.broadcast(every))  # one row
        k = F.col("n") - 1
        alpha = F.when(k > 1, k / (k - 1) * (1.0 - ratio(F.col("items") - F.col("spread"), F.col("total"))))
        out = out.join(joined.select(*by, "rep", alpha.alias("alpha")), [*by, "rep"])
    return out


def counted(df: DataFrame, x: str, by: list[str] = ()) -> DataFrame:
    """(by, x, k, start, n): how often each value occurs, how many values are smaller, and how many there are.

    Values are counted first, so ties and repeated rows add nothing; the counts are range-partitioned, summed up by partition,
    and run on inside each. Windows see a row for each partition, or one partition's values.
    """
    counts = df.groupBy(*by, x).agg(F.count(F.lit(1)).alias("k"))
    spread = written(df.sparkSession, counts.repartitionByRange(*by, x).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = spread.groupBy(*by, "part").agg(F.sum("k").alias("size"))
    parts = Window.partitionBy(*by).orderBy("part")
    offsets = sizes.select(*by, "part", F.coalesce(F.sum("size").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.sum("size").over(Window.partitionBy(*by)).alias("n"))
    inside = Window.partitionBy(*by, "part").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.join(offsets, [*by, "part"])
    return placed.select(*by, x, "k", (F.col("offset") + F.coalesce(F.sum("k").over(inside), F.lit(0))).alias("start"), "n")


def ranked(df: DataFrame, x: str, by: list[str] = (), low: float = 0.0005, high: float = 0.9995) -> DataFrame:
    """df with pct: (average rank - 0.5) / n, within [low, high]."""
    rank = F.col("start") + (F.col("k") + 1) / 2
    pct = F.greatest(F.lit(low), F.least(F.lit(high), (rank - 0.5) / F.col("n")))
    return df.join(counted(df, x, by).select(*by, x, pct.alias("pct")), [*by, x])


def normalized(df: DataFrame, x: str, by: list[str] = (), clip: float | tuple[float, float] = (0.0005, 0.9995), keep_stats: bool = True) -> DataFrame:
    """df with z: the normal quantile of the ranks, with the mean and deviation of x (or standard)."""
    low, high = clip if isinstance(clip, tuple) else (clip / 2, 1 - clip / 2)
    out = ranked(df, x, by, low, high).withColumn("z", inverse_normal(F.col("pct")))
    if not keep_stats:
        return out
    moments = df.groupBy(*by).agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"))
    out = out.join(moments, list(by)) if by else out.crossJoin(F.broadcast(moments))  # one row
    return out.withColumn("z", F.col("m") + F.col("s") * F.col("z")).drop("m", "s")


def quantiles(df: DataFrame, x: str, shares: list[float], by: list[str] = (), ignore_nan: bool = True) -> DataFrame:
    """(by, share, value) for each of the shares, linearly interpolated, without values that are not numbers.

    Each value says which of the two neighbors of a share's position it covers; no task holds a group's values.
    """
    kept = df.where(F.col(x).isNotNull() & ~F.isnan(x)) if ignore_nan else df.where(F.col(x).isNotNull())
    at = F.transform(F.array(*[F.lit(float(s)) for s in shares]), lambda d: F.struct(d.alias("share"), ((F.col("n") - 1) * d).alias("pos")))
    asked = counted(kept, x, by).withColumn("d", F.explode(at)).select(*by, x, "k", "start", "d.share", F.round("d.pos", 9).alias("pos"))
    covers = lambda place: (F.col("start") <= place) & (place < F.col("start") + F.col("k"))
    share = F.col("pos") - F.floor("pos")
    low, high = covers(F.floor("pos")), covers(F.ceil("pos"))
    value = F.when(low & high, F.col(x)).when(low, F.col(x) * (1 - share)).otherwise(F.col(x) * share)
    return asked.where(low | high).groupBy(*by, "share").agg(F.sum(value).alias("value"))


def deciles(df: DataFrame, x: str, by: list[str] = (), ignore_nan: bool = True) -> DataFrame:
    """(by, decile 0 to 100 by tens, value)"""
    found = quantiles(df, x, [k / 10 for k in range(11)], by, ignore_nan)
    return found.select(*by, F.round(F.col("share") * 100).cast("long").alias("decile"), "value")


def summary(df: DataFrame, x: str, by: list[str] = (), most: int = 10) -> DataFrame:
    """(by, n, n_distinct, values, percentiles): what a listing shows - the distinct values if at most `most`, else six percentiles.

    Values are counted before anything is listed, so a list has at most `most` of them.
    """
    counts = written(df.sparkSession, df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("k")), "counts")
    totals = counts.groupBy(*by).agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_distinct"))
    meet = lambda a, b: a.join(b, list(by), "left") if by else a.crossJoin(F.broadcast(b))  # noqa: E731 - a row each without keys
    few = meet(counts, totals).where(F.col("n_distinct") <= most).groupBy(*by).agg(F.array_sort(F.collect_list(x)).alias("values"))
    many = quantiles(df, x, [k / 5 for k in range(6)], by).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("share", "value"))), lambda p: p["value"]).alias("percentiles"))
    found = meet(meet(totals, few), many)
    return found.withColumn("percentiles", F.when(F.col("n_distinct") > most, F.col("percentiles"))).withColumn("values", F.when(F.col("n_distinct") <= most, F.col("values")))


def all_finite(signal: DataFrame, by: list[str]) -> DataFrame:
    """The keys all of whose values are finite."""
    return signal.groupBy(*by).agg(F.bool_and(finite(F.col("x"))).alias("ok")).where("ok").drop("ok")


def clipped(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))
