"""Inter-subject correlation of signal(subject, t, v, x)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import correlation, cosine


def one_vs_rest(signal: DataFrame, metric: str = "correlation") -> DataFrame:
    """(subject, v, r): each subject with the sum of the others. Without variation a correlation is 0.

    The total over subjects is aggregated before it meets the cells again, so no window holds a time point's subjects.
    """
    total = signal.groupBy("t", "v").agg(F.sum("x").alias("total"))
    both = signal.join(total, ["t", "v"]).withColumn("rest", F.col("total") - F.col("x"))
    r = correlation(F.col("x"), F.col("rest"), 0.0) if metric == "correlation" else cosine(F.col("x"), F.col("rest"))
    return both.groupBy("subject", "v").agg(r.alias("r"))


def pairwise(signal: DataFrame, metric: str = "correlation") -> DataFrame:
    """(subject, other, v, r) of subjects in order, by an equi-join on time and vertex. The result itself has a row for each pair."""
    other = signal.select(F.col("subject").alias("other"), "t", "v", F.col("x").alias("y"))
    both = signal.join(other, ["t", "v"]).where("subject < other")
    r = correlation(F.col("x"), F.col("y")) if metric == "correlation" else cosine(F.col("x"), F.col("y"))
    return both.groupBy("subject", "other", "v").agg(r.alias("r"))


def isc(signal: DataFrame, paired: bool = False, metric: str = "correlation") -> DataFrame:
    return pairwise(signal, metric) if paired else one_vs_rest(signal, metric)


def zscored(signal: DataFrame, by: tuple[str, ...] = ("subject", "v")) -> DataFrame:
    """x standardised over time (population deviation); 0 where it does not vary."""
    moments = signal.groupBy(*by).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = F.coalesce(F.try_divide(F.col("x") - F.col("m"), F.col("s")), F.lit(0.0))
    return signal.join(moments, list(by)).withColumn("x", z).drop("m", "s")


def lagged(signal: DataFrame, steps: int = 1) -> DataFrame:
    """x and its value `steps` time points earlier, by subject and vertex."""
    w = Window.partitionBy("subject", "v").orderBy("t")
    return signal.withColumn("earlier", F.lag("x", steps).over(w))
