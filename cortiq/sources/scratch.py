"""Tables written in the shared folder to cut lineage: spark.checkpoint.dir, which a cluster must name. Where it is unset, as in
tests, a folder of the warehouse serves, but not one of the driver's machine below executors of other machines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        if found.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cortiq/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a table that is deleted when the driver ends."""
    path = shared_path(spark, name)
    df.write.parquet(path)
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(found)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that no plan needs any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            found = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            found.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(found, True)
