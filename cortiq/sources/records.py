"""Results that are computed once, with a record of how: leases between callers, observed metrics, records as a table.

A result is a folder. Its caller first takes the lease, a file beside the folder that the store creates for one caller only.
Others wait for the result's _SUCCESS. A lease whose holder has died grows stale: of those who find it so, the one
who can rename it takes over, since the store renames a file once. The record, one line of JSON beside the folder, holds
name, parameters, host, rows and given metrics (DataFrame.observe), wall time, and the CPU time of driver and tasks.
"""

from __future__ import annotations

import json
import os
import platform
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RECORD = "name string, parameters map<string,string>, host string, pid long, started double, wall_seconds double, driver_cpu_seconds double, task_cpu_seconds double, rows long, metrics map<string,double>"


class Store:
    """Files of a Hadoop store by whole paths."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.fs = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def create(self, path: str) -> bool:
        """Whether this call made the empty file. Hadoop's local store looks before it creates, so there the system's own call is used."""
        self.fs.mkdirs(self.path(path).getParent())
        if self.fs.getUri().getScheme() == "file":
            try:
                os.close(os.open(self.path(path).toUri().getPath(), os.O_CREAT | os.O_EXCL))
                return True
            except FileExistsError:
                return False
        try:
            return self.fs.createNewFile(self.path(path))
        except Exception:  # a store may raise instead if another caller was first
            if self.exists(path):
                return False
            raise

    def age(self, path: str) -> float | None:
        try:
            return time.time() - self.fs.getFileStatus(self.path(path)).getModificationTime() / 1000
        except Exception:
            if self.exists(path):
                raise
            return None

    def taken(self, path: str) -> bool:
        """Whether this call removed the file, by a rename that succeeds once."""
        aside = f"{path}.{uuid.uuid4().hex}"
        try:
            won = self.fs.rename(self.path(path), self.path(aside))
        except Exception:
            won = False
        if won:
            self.fs.delete(self.path(aside), False)
        return won

    def write(self, path: str, text: str) -> None:
        out = self.fs.create(self.path(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


def task_cpu_seconds(spark: SparkSession, group: str) -> float:
    """CPU seconds of the tasks of a job group."""
    tracker, store = spark.sparkContext.statusTracker(), spark._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) for s in info.stageIds}
    total = 0.0
    for s in stages:
        try:
            total += store.lastStageAttempt(s).executorCpuTime() / 1e9
        except Exception:  # a stage that was skipped has no attempt
            continue
    return total


def monitored(spark: SparkSession, df: DataFrame, path: str, name: str, parameters: dict | None = None, metrics: dict[str, Column] | None = None) -> dict:
    """Write df to path as Parquet; the record, which is also written beside it."""
    seen = Observation(f"observed_{uuid.uuid4().hex}")
    values = [F.count(F.lit(1)).alias("rows"), *[c.cast("double").alias(k) for k, c in (metrics or {}).items()]]
    group, sc = f"monitored-{uuid.uuid4().hex}", spark.sparkContext
    began, wall, cpu = time.time(), time.perf_counter(), time.process_time()
    sc.setJobGroup(group, name)
    try:
        df.observe(seen, *values).write.mode("overwrite").parquet(path)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    found = seen.get
    record = {
        "name": name,
        "parameters": {k: str(v) for k, v in (parameters or {}).items()},
        "host": platform.node(),
        "pid": os.getpid(),
        "started": began,
        "wall_seconds": time.perf_counter() - wall,
        "driver_cpu_seconds": time.process_time() - cpu,
        "task_cpu_seconds": task_cpu_seconds(spark, group),
        "rows": found["rows"],
        "metrics": {k: found[k] for k in metrics or {}},
    }
    Store(spark, path).write(f"{path}.record.json", json.dumps(record))
    return record


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The records below a folder, with the result that each belongs to."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.record.json").text(folder).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.select(F.regexp_replace("file", r"\.record\.json$", "").alias("result"), F.from_json("value", RECORD).alias("r")).select("result", "r.*")


def save_results(spark: SparkSession, path: str, make: Callable[..., DataFrame], parameters: dict | None = None, name: str | None = None, metrics: dict[str, Column] | None = None, rerun: bool = False, stale_hours: float = 24.0, poll_seconds: float = 1.0, wait_hours: float = 48.0) -> DataFrame:
    """The table at path; where it is absent, or on rerun, make(**parameters) is written there by one caller of any number.

    A failed call gives its lease back, so that another caller can try.
    """
    path = path.rstrip("/")
    store, lease, done = Store(spark, path), f"{path}.lease", f"{path}/_SUCCESS"
    until, first = time.time() + wait_hours * 3600, True
    while rerun and first or not store.exists(done):
        if store.create(lease):
            try:
                if rerun and first or not store.exists(done):  # another caller may have finished in between
                    monitored(spark, make(**(parameters or {})), path, name or getattr(make, "__name__", "result"), parameters, metrics)
            finally:
                store.delete(lease)
            break
        first = first and rerun
        age = store.age(lease)
        if age is not None and age > stale_hours * 3600:
            store.taken(lease)
            continue
        if time.time() > until:
            raise TimeoutError(f"{lease} is held by another caller")
        time.sleep(poll_seconds)
    return spark.read.parquet(path)
