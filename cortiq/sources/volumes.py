"""Volumes (NIfTI-1 and MGH, plain or gz) as a Spark data source, readers of a user's own, and comparison by values.

`spark.read.format("volumes").load(path)` has a row for each slice of each frame: path, t, k, shape, x (the slice, first
axis fastest). A plain file is cut into partitions of SLAB bytes, each of which seeks to its slices; a gz file is one
partition that is inflated as a stream, a slice at a time, so no volume is ever held as a whole.

Values are as stored times the header's slope plus its intercept (NIfTI; a slope of 0 means none). Formats without a
header of either kind raise an error that names the file.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .arrays import files, put

#: Bytes of values in a partition of a plain file.
SLAB = 32_000_000
SLICES = "path string, t int, k int, shape array<int>, x array<double>"
ENDINGS = (".nii", ".nii.gz", ".mgh", ".mgz")
#: Codes of types in both formats.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
MGH_TYPES = {0: "u1", 1: "i4", 3: "f4", 4: "i2"}
#: Bytes of the headers.
NIFTI_HEADER, MGH_HEADER = 348, 284


def header_of(path: str, head: bytes) -> dict:
    """shape (x, y, z, frames), type, offset of the values, slope and intercept, from a file's first bytes."""
    if len(head) >= NIFTI_HEADER and head[344:347] in (b"n+1", b"ni1"):
        order = "<" if struct.unpack("<i", head[:4])[0] == NIFTI_HEADER else ">"
        dim = struct.unpack(order + "8h", head[40:56])
        kind = struct.unpack(order + "h", head[70:72])[0]
        offset, slope, intercept = struct.unpack(order + "3f", head[108:120])
        shape = [max(d, 1) for d in dim[1 : dim[0] + 1]] + [1] * 4
        if kind in NIFTI_TYPES:
            return {"shape": [*shape[:3], int(np.prod(shape[3 : dim[0]] or [1]))], "type": order + NIFTI_TYPES[kind], "offset": int(offset), "slope": slope or 1.0, "intercept": intercept if slope else 0.0}
    elif len(head) >= MGH_HEADER and struct.unpack(">i", head[:4])[0] == 1:
        *shape, kind = struct.unpack(">5i", head[4:24])
        if kind in MGH_TYPES:
            return {"shape": shape, "type": ">" + MGH_TYPES[kind], "offset": MGH_HEADER, "slope": 1.0, "intercept": 0.0}
    raise ValueError(f"not a NIfTI-1 or MGH volume of a known type: {path}")


def zipped(path: str) -> bool:
    return path.endswith((".gz", ".mgz"))


def opened(path: str):
    """A stream of the file's bytes; that of a gz file is inflated as it is read."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")
    raw = store.open_input_file(name)
    return gzip.GzipFile(fileobj=raw) if zipped(path) else raw


class Part(InputPartition):
    def __init__(self, path: str, header: dict, begin: int, end: int):
        self.path, self.header, self.begin, self.end = path, header, begin, end


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def paths(self) -> list[str]:
        from pyarrow import fs

        root = self.options["path"]
        store, name = fs.FileSystem.from_uri(root if ":" in root.split("/")[0] else f"file://{root}")
        info = store.get_file_info(name)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(name, recursive=True))
        prefix = root[: len(root) - len(name)] if root.endswith(name) else ""
        return sorted(prefix + f.path for f in found if f.is_file and f.path.endswith(ENDINGS))

    def partitions(self) -> list[Part]:
        """A part for each slab of slices; only headers are read here."""
        out = []
        for path in self.paths():
            with opened(path) as f:
                header = header_of(path, f.read(NIFTI_HEADER))
            slices = header["shape"][2] * header["shape"][3]
            each = max(1, int(self.options.get("slab", SLAB)) // max(1, header["shape"][0] * header["shape"][1] * np.dtype(header["type"]).itemsize))
            step = slices if zipped(path) else each
            out += [Part(path, header, a, min(a + step, slices)) for a in range(0, slices, max(step, 1))]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        h = part.header
        kind = np.dtype(h["type"])
        n = h["shape"][0] * h["shape"][1]
        with opened(part.path) as f:
            f.seek(h["offset"] + part.begin * n * kind.itemsize)
            for at in range(part.begin, part.end):
                raw = f.read(n * kind.itemsize)
                if len(raw) < n * kind.itemsize:
                    raise ValueError(f"{part.path} ends before its header says")
                x = np.frombuffer(raw, kind).astype(float) * h["slope"] + h["intercept"]
                yield pa.RecordBatch.from_pydict({"path": [part.path], "t": pa.array([at // h["shape"][2]], pa.int32()), "k": pa.array([at % h["shape"][2]], pa.int32()), "shape": pa.array([h["shape"]], pa.list_(pa.int32())), "x": pa.array([x], pa.list_(pa.float64()))})


class VolumeSource(DataSource):
    """The format `volumes`: a file or a folder of files; option slab for the bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "volumes"

    def schema(self) -> str:
        return SLICES

    def reader(self, schema) -> VolumeReader:
        return VolumeReader(dict(self.options))


def read_volumes(spark: SparkSession, path: str, slab: int = SLAB) -> DataFrame:
    spark.dataSource.register(VolumeSource)
    return spark.read.format("volumes").option("slab", str(slab)).load(path)


def cells(slices: DataFrame) -> DataFrame:
    """(path, i, j, k, t, x) of the slices."""
    each = slices.select("path", "t", "k", "shape", F.posexplode("x").alias("at", "x"))
    return each.select("path", (F.col("at") % F.col("shape")[0]).alias("i"), F.floor(F.col("at") / F.col("shape")[0]).cast("int").alias("j"), "k", "t", "x")


def load_with(spark: SparkSession, path: str, load_func: Callable[[str, bytes], pd.DataFrame], schema: str, pattern: str | None = None) -> DataFrame:
    """The files below a path by a user's own function of (path, content), which gives rows of the schema; a file is one call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                yield load_func(name, content)

    return files(spark, path, pattern).select("path", "content").mapInPandas(run, schema)


def nifti(x: np.ndarray, slope: float = 0.0, intercept: float = 0.0) -> bytes:
    """A NIfTI-1 file of an array of up to four axes."""
    code = {np.dtype(v): k for k, v in NIFTI_TYPES.items()}[x.dtype.newbyteorder("=")]
    dim = [x.ndim, *x.shape] + [1] * (7 - x.ndim)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, NIFTI_HEADER)
    struct.pack_into("<8h", head, 40, *dim)
    struct.pack_into("<2h", head, 70, code, x.dtype.itemsize * 8)
    struct.pack_into("<3f", head, 108, 352.0, slope, intercept)
    head[344:348] = b"n+1\0"
    return bytes(head) + np.asfortranarray(x.astype(x.dtype.newbyteorder("<"))).tobytes(order="F")


def write_volumes(voxels: DataFrame, folder: str, shape: tuple[int, int, int, int]) -> DataFrame:
    """A gz NIfTI file for each name of voxels(name, i, j, k, t, x), absent ones 0; (name, path, bytes). A volume is one task's, bounded by its shape."""

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros(shape)
        a[pdf["i"], pdf["j"], pdf["k"], pdf["t"]] = pdf["x"]
        content = gzip.compress(nifti(a), mtime=0)
        put(path := f"{folder.rstrip('/')}/{key[0]}.nii.gz", content)
        return pd.DataFrame({"name": [str(key[0])], "path": [path], "bytes": [len(content)]})

    return voxels.groupBy("name").applyInPandas(write, "name string, path string, bytes long")


def compared_volumes(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(path, status, most): volumes below two folders by shape and values; most is the largest difference of two of one shape.

    Status is same, values differ, shapes differ, only left or only right; NaN equals NaN.
    """

    def slices(root: str) -> DataFrame:
        found = read_volumes(spark, root)
        return found.withColumn("path", F.substring("path", len(root.rstrip("/")) + 2, 2**31 - 1))

    a = slices(left)
    b = slices(right).withColumnsRenamed({"shape": "shape2", "x": "x2"})
    apart = lambda p, q: F.when(F.isnan(p) & F.isnan(q), F.lit(0.0)).when(F.isnan(p) | F.isnan(q), F.lit(float("inf"))).when(p == q, F.lit(0.0)).otherwise(F.abs(p - q))
    both = a.join(b, ["path", "t", "k"], "full").withColumn("d", F.when(F.col("shape") == F.col("shape2"), F.array_max(F.zip_with("x", "x2", apart))))
    found = both.groupBy("path").agg(F.max(F.col("shape").cast("string")).alias("one"), F.max(F.col("shape2").cast("string")).alias("two"), F.max("d").alias("most"))
    status = F.when(F.col("two").isNull(), "only left").when(F.col("one").isNull(), "only right").when(F.col("one") != F.col("two"), "shapes differ").when(F.col("most") > 0, "values differ").otherwise("same")
    return found.select("path", status.alias("status"), F.when(F.col("one") == F.col("two"), F.col("most")).alias("most"))
