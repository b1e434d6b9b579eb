"""The engine's relations, and how the test tables stand in for them.

signal(subject, t, v, x): a value for each subject, time point and vertex. rows(obs, x array): a feature vector for each
observation. transform(src, dst, w): a sparse matrix. vertices(v, x, y, z), faces(f, a, b, c): a mesh.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def completed(signal: DataFrame, keys: tuple[str, ...] = ("subject", "t", "v"), fill: float = 0.0) -> DataFrame:
    """signal on the whole grid of the distinct values of its keys; the grid is the size of the dense data, by definition."""
    grid = signal.select(keys[0]).distinct()
    for k in keys[1:]:
        grid = grid.crossJoin(signal.select(k).distinct())
    return grid.join(signal, list(keys), "left").withColumn("x", F.coalesce("x", F.lit(fill)))


def event_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as subjects, days as time, users modulo 8 as vertices, summed values as signal."""
    events = read(spark, sf_dir, "events")
    cells = events.groupBy(F.col("event_type").alias("subject"), F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("t"), (F.col("user_id") % 8).cast("long").alias("v"))
    return completed(cells.agg(F.sum("value").alias("x")))


EVENT_SIGNAL_SQL = """
cells AS (SELECT event_type AS subject, date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS t, (user_id % 8)::BIGINT AS v, sum(value) AS x
  FROM events GROUP BY ALL),
signal AS (SELECT s.subject, t.t, v.v, coalesce(c.x, 0.0) AS x FROM (SELECT DISTINCT subject FROM cells) s
  CROSS JOIN (SELECT DISTINCT t FROM cells) t CROSS JOIN (SELECT DISTINCT v FROM cells) v
  LEFT JOIN cells c ON c.subject = s.subject AND c.t = t.t AND c.v = v.v)
"""


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs, label, x) with x as doubles."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("obs"), "label", F.col("embedding").cast("array<double>").alias("x"))


def octahedron(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Vertices and outward faces of the octahedron."""
    vertices = spark.createDataFrame([(0, 1.0, 0.0, 0.0), (1, -1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, -1.0, 0.0), (4, 0.0, 0.0, 1.0), (5, 0.0, 0.0, -1.0)], "v long, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 2, 4), (1, 2, 1, 4), (2, 1, 3, 4), (3, 3, 0, 4), (4, 2, 0, 5), (5, 1, 2, 5), (6, 3, 1, 5), (7, 0, 3, 5)], "f long, a long, b long, c long")
    return vertices, faces


OCTAHEDRON_SQL = """
vertices(v, x, y, z) AS (VALUES (0, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (1, -1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, -1.0, 0.0), (4, 0.0, 0.0, 1.0), (5, 0.0, 0.0, -1.0)),
faces(f, a, b, c) AS (VALUES (0, 0, 2, 4), (1, 2, 1, 4), (2, 1, 3, 4), (3, 3, 0, 4), (4, 2, 0, 5), (5, 1, 2, 5), (6, 3, 1, 5), (7, 0, 3, 5))
"""
