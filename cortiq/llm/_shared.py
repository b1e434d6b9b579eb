"""What the corpus operators share: scratch tables in the shared folder, words, and size-checked joins."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its row count, taken first, is at most this; the sides have a few numbers or names a row.
BROADCAST_ROWS = 300_000
#: Entries of a worker's cache of word hashes (about 120 bytes each); a full cache is emptied.
CACHE_WORDS = 150_000
#: Bytes of rows that a Python worker gets at once, and a row more at most. Spark's own bound is 64 MB, which the executor and
#: the worker of each task hold in several copies.
BATCH_BYTES = "1m"
_BATCH_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, which a cluster must name; where it is unset, a
    folder of the warehouse, which they share as well."""
    found = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cortiq/{name}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def passing(spark: SparkSession, path: str) -> str:
    """A path that exists and is deleted when the driver ends."""
    store, found = _store(spark, path)
    store.deleteOnExit(found)
    return path


def discard(df: DataFrame) -> None:
    """Delete a table of written() that no plan needs any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        store, found = _store(df.sparkSession, path)
        store.delete(found, True)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, outlives lost executors, prunes columns when reread; it goes with the driver."""
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(passing(spark, path))


def observed(spark: SparkSession, df: DataFrame, name: str, *values: Column) -> tuple[DataFrame, dict]:
    """written(), and named aggregates of its rows, which Spark takes while it writes them: a query less for the driver to plan and to remember."""
    seen = Observation()
    return written(spark, df.observe(seen, *values), name), seen.get


def counted(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """written(), and its number of rows."""
    table, seen = observed(spark, df, name, F.count(F.lit(1)).alias("rows"))
    return table, seen["rows"]


def mapped(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """rows.mapInArrow(run, schema) by batches of BATCH_BYTES. Spark reads the bound when a plan runs, so the session keeps it; one
    that a user has set stays."""
    conf = rows.sparkSession.conf
    if conf.get(_BATCH_BOUND, None) is None:
        conf.set(_BATCH_BOUND, BATCH_BYTES)
    return rows.mapInArrow(run, schema)


def small_or_not(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint when its counted rows are few; otherwise unchanged, so that Spark shuffles it."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


#: Bytes of UTF-8: A-Z lower-cased; digits, a-z and bytes from 0x80 kept; all others separate words.
_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text after A-Z are lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


class WordIds(dict):
    """word -> unsigned 64-bit hash; a bounded cache that never changes a result."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value

    def of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near inputs give unrelated outputs."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive words from each position; a shorter text that is not empty has one gram of all its words."""
    n = len(ids)
    if n == 0:
        return ids
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out = mixed(out * np.uint64(0xC2B2AE3D27D4EB4F) + ids[j : n - k + 1 + j])
    return out


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A column of lists from one array per row, without Python objects per value."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=kind))


def runs(keys: np.ndarray) -> np.ndarray:
    """Start positions of the runs of equal values, and the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def text_keys(text: Column) -> list[Column]:
    """128 bits of hash that tell the texts of rows with one id apart; null is a text of its own."""
    return [F.xxhash64(F.lit(k), text).alias(name) for k, name in enumerate(ROW_KEY[1:])]


#: A row is known by its id and its text, so that rows that repeat an id, or have none, keep their own results.
ROW_KEY = ("doc_id", "text_one", "text_two")


def keyed_rows(docs: DataFrame) -> DataFrame:
    """ROW_KEY and text of each row."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(text), text.alias("text"))


def matching(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs whose row key is (left_semi) or is not (left_anti) among keys, which has ROW_KEY; names cannot clash."""
    names = [f"key_{uuid.uuid4().hex}" for _ in ROW_KEY]
    keys = keys.select(*[F.col(k).alias(n) for k, n in zip(ROW_KEY, names, strict=True)]).distinct()
    text = F.col("text").cast("string")
    own = [F.col("doc_id").cast("long"), *[F.xxhash64(F.lit(k), text) for k in range(len(ROW_KEY) - 1)]]
    on = own[0].eqNullSafe(F.col(names[0])) & (own[1] == F.col(names[1])) & (own[2] == F.col(names[2]))
    return docs.join(small_or_not(*counted(docs.sparkSession, keys, "row-keys")), on, how)


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    return matching(docs, keys, "left_anti")
