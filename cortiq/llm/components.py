"""Connected components of an edge table by contraction: vertices hang on their least neighbors, and the trees become vertices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ._shared import discard, written


def _tallied(spark: SparkSession, df: DataFrame, name: str, tally: Column) -> tuple[DataFrame, int]:
    """written(), and a count that is taken while it writes."""
    seen = Observation()
    return written(spark, df.observe(seen, tally.alias("n")), name), seen.get["n"]


def _rooted(spark: SparkSession, parents: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, root) whose roots have no row: each step doubles the way up, so steps grow with the logarithm of the depth."""
    found, moved = written(spark, parents, "roots"), True
    while moved:
        far = found.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new, moved = _tallied(spark, found.join(far, "root", "left").select("node", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots", F.count_if("moved"))
        discard(found)
        found = new.select("node", "root")
    return found


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (src, dst); component is the smallest node it reaches.

    In a round each vertex with a smaller neighbor hangs on the least one, the trees are contracted to their roots, and only
    edges between different trees stay, once each. So all edges are joined in the first round alone, later rounds join what is
    left, and two rounds leave at most half of the vertices. An edge's larger end moves first: of a hub's edges few are then
    left for the join on the smaller one. No edges give no rows.
    """
    pairs, n = _tallied(spark, edges.where("src <> dst").select(F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")).distinct(), "edges", F.count(F.lit(1)))
    labels = written(spark, pairs.select(F.explode(F.array("low", "high")).alias("node")).distinct().select("node", F.col("node").alias("component")), "labels")
    while n:
        roots = _rooted(spark, pairs.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root")))
        # Each vertex that is a larger end has a root.
        left = pairs.join(roots.select(F.col("node").alias("high"), "root"), "high").where("low <> root").select("low", "root").distinct()
        ends = left.join(roots.select(F.col("node").alias("low"), F.col("root").alias("other")), "low", "left").select("root", F.coalesce("other", "low").alias("other"))
        old = pairs, labels
        pairs, n = _tallied(spark, ends.where("root <> other").select(F.least("root", "other").alias("low"), F.greatest("root", "other").alias("high")).distinct(), "edges", F.count(F.lit(1)))
        labels = written(spark, labels.join(roots.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
        for table in (*old, roots):
            discard(table)
    discard(pairs)
    return labels
