"""Preparation of signal(subject, run, t, v, x): masks, confounds, standardisation, slicing and run concatenation."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite

RUN = ("subject", "run")


def masked(signal: DataFrame, mask: DataFrame, key: str = "v") -> DataFrame:
    """The cells whose key the mask(key, keep) keeps."""
    return signal.join(mask.where("keep").select(key), key, "left_semi")


def with_global_signal(signal: DataFrame, confounds: DataFrame) -> DataFrame:
    """confounds(subject, run, t, c array) with the mean over vertices appended."""
    mean = signal.groupBy(*RUN, "t").agg(F.avg("x").alias("g"))
    return confounds.join(mean, [*RUN, "t"]).select(*RUN, "t", F.concat("c", F.array("g")).alias("c"))


def regressed(signal: DataFrame, confounds: DataFrame) -> DataFrame:
    """signal minus its least-squares fit on the confounds of its run (no intercept of its own); vertices with a value that is not finite stay as they are.

    For each run the p x p products are summed and inverted in a grouped task (p confounds, not the data); each vertex then
    needs one aggregate of p products and one join.
    """
    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.array(pdf["m"].iloc[0], float)
        p = int(round(np.sqrt(len(c))))
        return pd.DataFrame({RUN[0]: [key[0]], RUN[1]: [key[1]], "inverse": [np.linalg.pinv(c.reshape(p, p), hermitian=True).ravel().tolist()]})

    products = confounds.select(*RUN, F.expr("flatten(transform(c, a -> transform(c, b -> a * b)))").alias("m")).select(*RUN, F.posexplode("m").alias("k", "value")).groupBy(*RUN, "k").agg(F.sum("value").alias("value"))
    packed = products.groupBy(*RUN).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda e: e["value"]).alias("m"))
    kinds = dict(signal.dtypes)
    inverse = packed.groupBy(*RUN).applyInPandas(solve, f"subject {kinds['subject']}, run {kinds['run']}, inverse array<double>")
    good = signal.groupBy(*RUN, "v").agg(F.bool_and(finite(F.col("x"))).alias("ok"))
    marked = signal.join(good, [*RUN, "v"]).join(confounds, [*RUN, "t"])
    sums = marked.where("ok").select(*RUN, "v", "x", F.posexplode("c").alias("k", "c")).groupBy(*RUN, "v", "k").agg(F.sum(F.col("c") * F.col("x")).alias("s"))
    xy = sums.groupBy(*RUN, "v").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda e: e["s"]).alias("xy"))
    beta = xy.join(inverse, list(RUN)).select(*RUN, "v", F.expr("transform(sequence(0, size(xy) - 1), i -> aggregate(zip_with(slice(inverse, i * size(xy) + 1, size(xy)), xy, (a, b) -> a * b), 0D, (s, e) -> s + e))").alias("beta"))
    fit = F.expr("aggregate(zip_with(c, beta, (a, b) -> a * b), 0D, (s, e) -> s + e)")
    return marked.join(beta, [*RUN, "v"], "left").select(*RUN, "t", "v", F.when(F.col("ok"), F.col("x") - fit).otherwise(F.col("x")).alias("x"))


def standardised(signal: DataFrame) -> DataFrame:
    """x over time with mean 0 and deviation 1 in each run and vertex; 0 where that is not a number."""
    moments = signal.groupBy(*RUN, "v").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = F.try_divide(F.col("x") - F.col("m"), F.col("s"))
    return signal.join(moments, [*RUN, "v"]).withColumn("x", F.when(finite(z), z).otherwise(0.0)).drop("m", "s")


def default(signal: DataFrame, confounds: DataFrame | None = None, mask: DataFrame | None = None, z: bool = True, gsr: bool = False) -> DataFrame:
    if mask is not None:
        signal = masked(signal, mask)
    if confounds is not None:
        signal = regressed(signal, with_global_signal(signal, confounds) if gsr else confounds)
    return standardised(signal) if z else signal


def scrub(signal: DataFrame, confounds: DataFrame, keep: DataFrame, mask: DataFrame | None = None, z: bool = True, gsr: bool = False) -> DataFrame:
    """default() on the time points that keep(subject, run, t, keep) keeps."""
    good = keep.where("keep").select(*RUN, "t")
    return default(signal.join(good, [*RUN, "t"], "left_semi"), confounds.join(good, [*RUN, "t"], "left_semi"), mask, z, gsr)


def get_prep(name: str, **options) -> Callable[..., DataFrame]:
    """default or scrub, with -gsr for a global-signal regressor."""
    base, _, suffix = name.partition("-")
    if base not in ("default", "scrub") or suffix not in ("", "gsr"):
        raise ValueError(f"no preparation is called {name}")
    return partial(default if base == "default" else scrub, **({"gsr": True} if suffix else {}), **options)


def sliced(signal: DataFrame, intervals: DataFrame) -> DataFrame:
    """The time points inside intervals([subject,] run, start, end), half-open, in order and renumbered from 0 in each run.

    The new number is counted from the intervals' lengths, so no window gathers a run.
    """
    keys = [k for k in RUN if k in intervals.columns]
    w = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offset = intervals.withColumn("offset", F.coalesce(F.sum(F.col("end") - F.col("start")).over(w), F.lit(0)))
    at = signal.join(offset, keys).where("t >= start AND t < end")  # a few rows for each run; Spark broadcasts them by their size
    return at.select(*[F.col(c) if c != "t" else (F.col("t") - F.col("start") + F.col("offset")).alias("t") for c in signal.columns])


def trimmed(signal: DataFrame, first: int = 0, last: int = 0) -> DataFrame:
    """Without the first and last time points of each run, renumbered from 0."""
    ends = signal.groupBy(*RUN).agg((F.max("t") - last).alias("stop"))
    return signal.join(ends, list(RUN)).where((F.col("t") >= first) & (F.col("t") <= F.col("stop"))).withColumn("t", F.col("t") - first).drop("stop")


def renumbered(signal: DataFrame) -> DataFrame:
    """Time points numbered from 0 without gaps in each run: a window over the time points of a run, not over its cells."""
    w = Window.partitionBy(*RUN).orderBy("t")
    at = signal.select(*RUN, "t").distinct().withColumn("n", (F.row_number().over(w) - 1).cast("long"))
    return signal.join(at, [*RUN, "t"]).withColumn("t", F.col("n")).drop("n")


def concatenated(signal: DataFrame) -> DataFrame:
    """Runs one after the other in time: (subject, t, v, x), t running on."""
    lengths = signal.groupBy(*RUN).agg((F.max("t") + 1).alias("n"))
    w = Window.partitionBy("subject").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offset = lengths.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    return signal.join(offset, list(RUN)).select("subject", (F.col("t") + F.col("offset")).alias("t"), "v", "x")


def both_hemispheres(left: DataFrame, right: DataFrame, n_left: int) -> DataFrame:
    """The right hemisphere's vertices follow the left's."""
    return left.unionByName(right.withColumn("v", F.col("v") + n_left))
