"""Results computed once by concurrent callers, stale leases, and records as a table."""

from __future__ import annotations

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from cortiq.sources import records


def test_two_callers_compute_once(spark, tmp_path):
    calls, got, path = [], [], str(tmp_path / "sums")

    def make(n):
        calls.append(n)
        time.sleep(1.5)
        return spark.range(n).withColumn("x", F.col("id") * 2)

    def ask():
        got.append(records.save_results(spark, path, make, {"n": 7}, "sums", {"total": F.sum("x")}, poll_seconds=0.1).count())

    threads = [threading.Thread(target=ask) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert calls == [7] and got == [7] * 3 and not os.path.exists(path + ".lease")
    r = records.records(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0]["result"].endswith("/sums") and r[0]["rows"] == 7 and r[0]["metrics"] == {"total": 42.0} and r[0]["parameters"] == {"n": "7"}
    assert 0 < r[0]["wall_seconds"] < 60 and r[0]["task_cpu_seconds"] > 0


def test_stale_leases_are_taken_over_once(spark, tmp_path):
    path = str(tmp_path / "late")
    open(path + ".lease", "w").close()
    with pytest.raises(TimeoutError):
        records.save_results(spark, path, lambda: spark.range(1), wait_hours=0.0001, poll_seconds=0.05)
    os.utime(path + ".lease", (time.time() - 7200,) * 2)
    store = records.Store(spark, path)
    wins = [store.taken(path + ".lease") for _ in range(3)]
    assert wins == [True, False, False]
    open(path + ".lease", "w").close()
    os.utime(path + ".lease", (time.time() - 7200,) * 2)
    assert records.save_results(spark, path, lambda: spark.range(4), stale_hours=1, poll_seconds=0.05).count() == 4


def test_failures_and_reruns(spark, tmp_path):
    path = str(tmp_path / "again")

    def fails():
        raise KeyError("no such table")

    with pytest.raises(KeyError):
        records.save_results(spark, path, fails)
    assert records.save_results(spark, path, lambda: spark.range(2)).count() == 2
    assert records.save_results(spark, path, lambda: spark.range(5)).count() == 2
    assert records.save_results(spark, path, lambda: spark.range(5), rerun=True).count() == 5
