"""Array files: .npy and .npz as Python data sources, and suffix dispatch over the formats that Spark reads itself."""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written

DENSE = "path string, i long, j long, x double"
SPARSE = "path string, src long, dst long, w double"
RAGGED = "path string, center long, pos long, v long, dist double"


def _cells(path: str, a: np.ndarray) -> pa.RecordBatch:
    a = np.atleast_2d(a.T).T if a.ndim < 2 else a.reshape(a.shape[0], -1)
    i, j = np.indices(a.shape)
    return pa.RecordBatch.from_pydict({"path": pa.array([path] * a.size, pa.string()), "i": i.ravel().astype(np.int64), "j": j.ravel().astype(np.int64), "x": a.ravel().astype(float)})


def _npy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            a = np.load(io.BytesIO(content), allow_pickle=False)
            for k in range(0, max(len(np.atleast_1d(a)), 1), 4096):
                part = _cells(path, np.atleast_1d(a)[k : k + 4096])
                yield part.set_column(1, "i", pa.array(part.column("i").to_numpy() + k))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed sparse files: rows (csr) or columns (csc) by their pointers."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            f = np.load(io.BytesIO(content), allow_pickle=False)
            kind = f["format"].item()
            kind = kind.decode() if isinstance(kind, bytes) else str(kind)
            if kind == "coo":
                src, dst = f["row"], f["col"]
            else:
                major = np.repeat(np.arange(len(f["indptr"]) - 1), np.diff(f["indptr"]))
                src, dst = (major, f["indices"]) if kind == "csr" else (f["indices"], major)
            yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(src), pa.string()), "src": src.astype(np.int64), "dst": dst.astype(np.int64), "w": f["data"].astype(float)})


def _ragged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighborhood lists: concatenated members and distances, cut at boundaries."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            f = np.load(io.BytesIO(content), allow_pickle=False)
            v, d = f["concatenated_searchlights"], f["concatenated_distances"]
            cuts = np.concatenate([[0], f["boundaries"], [len(v)]]).astype(np.int64)
            sizes = np.diff(cuts)
            center = np.repeat(np.arange(len(sizes)), sizes)
            yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(v), pa.string()), "center": center, "pos": np.arange(len(v)) - np.repeat(cuts[:-1], sizes), "v": v.astype(np.int64), "dist": d.astype(float)})


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length, content) of the files below a path; listing alone does not read contents."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path, "*.npy").select("path", "content").mapInArrow(_npy, DENSE)


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path, "*.npz").select("path", "content").mapInArrow(_sparse, SPARSE)


def read_neighborhoods(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path, "*.npz").select("path", "content").mapInArrow(_ragged, RAGGED)


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """csv and tsv, plain or gz, with n/a as missing."""
    sep = "\t" if path.endswith((".tsv", ".tsv.gz")) else ","
    return spark.read.options(header=True, sep=sep, nullValue="n/a", inferSchema=True, **options).csv(path)


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """By suffix: npy, npz (sparse), tsv, csv, json (also gz), txt (also gz; a row for each line), parquet, volumes."""
    from .volumes import ENDINGS, read_volumes

    tables = (".tsv", ".csv", ".tsv.gz", ".csv.gz")
    for endings, reader in ((".npy", read_npy), (".npz", read_sparse), (tables, read_table), ((".txt", ".txt.gz"), lambda spark, path: spark.read.text(path)), (ENDINGS, read_volumes)):
        if path.endswith(endings):
            return reader(spark, path, **options)
    if path.endswith((".json", ".json.gz")):
        return spark.read.options(multiLine=True, **options).json(path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise TypeError(f"no reader for {path}")


def save(df: DataFrame, path: str, mode: str = "error") -> None:
    """By suffix: parquet, json, csv, tsv directories written by all tasks."""
    if path.endswith(".parquet"):
        df.write.mode(mode).parquet(path)
    elif path.endswith(".json"):
        df.write.mode(mode).json(path)
    elif path.endswith((".csv", ".tsv")):
        df.write.mode(mode).options(header=True, sep="\t" if path.endswith(".tsv") else ",", nullValue="n/a").csv(path)
    else:
        raise TypeError(f"no writer for {path}")


def memoised(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path, computed once: Spark's _SUCCESS marks a finished one."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def put(path: str, content: bytes) -> None:
    """A file written by the task that calls it, on any store; it is there as a whole or not at all."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    store.create_dir(name.rpartition("/")[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        f.write(content)
    store.move(part, name)


def save_arrays(cells: DataFrame, folder: str, kind: str = "npy") -> DataFrame:
    """A file for each name: dense arrays of cells(name, i, j, x), or with kind npz sparse matrices of cells(name, src, dst, w). (name, path, bytes).

    A file holds one array, so a task does. Cells that are absent are 0.
    """
    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, path = io.BytesIO(), f"{folder.rstrip('/')}/{key[0]}.{kind}"
        if kind == "npy":
            a = np.zeros((int(pdf["i"].max()) + 1, int(pdf["j"].max()) + 1))
            a[pdf["i"], pdf["j"]] = pdf["x"]
            np.save(out, a)
        else:
            shape = (int(pdf["src"].max()) + 1, int(pdf["dst"].max()) + 1)
            np.savez_compressed(out, format="coo", shape=shape, row=pdf["src"].to_numpy(), col=pdf["dst"].to_numpy(), data=pdf["w"].to_numpy())
        put(path, out.getvalue())
        return pd.DataFrame({"name": [key[0]], "path": [path], "bytes": [out.tell()]})

    if kind not in ("npy", "npz"):
        raise TypeError(f"no writer for {kind}")
    return written(cells.sparkSession, cells.groupBy("name").applyInPandas(write, "name string, path string, bytes long"), "arrays-written")


def content_digest(path: str, content: bytes) -> str:
    """What two files have in common if they say the same: arrays by shape and values, archives by their keys, meshes by both arrays, others by bytes."""
    if path.endswith((".npy", ".npz")):
        found = np.load(io.BytesIO(content), allow_pickle=False)
        parts = {"": found} if path.endswith(".npy") else {k: found[k] for k in sorted(found.files)}
        said = [k.encode() + repr(a.shape).encode() + (a.astype(float).tobytes() if a.dtype.kind in "biuf" else a.astype(str).tobytes()) for k, a in parts.items()]
    elif path.endswith(".gii"):
        from .surfaces import gifti

        said = [a.tobytes() for a in gifti(content)]
    else:
        said = [content]
    return hashlib.sha256(b"\0".join(said)).hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [content_digest(p, c) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "digest": pa.array(found, pa.string())})


def compared(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(path, status) of files below two folders: same, differs, only left or only right, by what the files say."""
    def digests(root: str) -> DataFrame:
        found = spark._jvm.org.apache.hadoop.fs.Path(root)
        base = found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString().rstrip("/")
        rel = F.substring("path", len(base) + 2, 2**31 - 1)
        return files(spark, root).select("path", "content").mapInArrow(_digests, "path string, digest string").select(rel.alias("path"), "digest")

    a, b = digests(left), digests(right).withColumnRenamed("digest", "other")
    status = F.when(F.col("other").isNull(), "only left").when(F.col("digest").isNull(), "only right").when(F.col("digest") == F.col("other"), "same").otherwise("differs")
    return a.join(b, "path", "full").select("path", status.alias("status"))


def kind_of(path, head=None):
    """A file's kind by its suffix; text or binary by its first bytes where the suffix says nothing."""
    kind = F.lit(None).cast("string")
    for name, endings in (("volume", (".nii", ".nii.gz", ".mgz", ".mgh")), ("surface", (".gii",)), ("npy", (".npy",)), ("npz", (".npz",)), ("text", (".txt", ".tsv", ".csv", ".json"))):
        for e in endings:
            kind = F.when(path.endswith(e), F.lit(name)).otherwise(kind)
    if head is not None:
        kind = F.coalesce(kind, F.when(F.is_valid_utf8(head), F.lit("text")).otherwise(F.lit("binary")))
    return kind
