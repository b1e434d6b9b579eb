"""Surface files: FreeSurfer's binary geometry and GIFTI, a mesh for each file; and OBJ lines."""

from __future__ import annotations

import base64
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mesh import Mesh
from .arrays import files, put
from .scratch import written


def freesurfer(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, faces) of a triangle file: three magic bytes, a comment that ends in two line ends, big-endian numbers."""
    if content[:3] != b"\xff\xff\xfe":
        raise ValueError("not a triangle file")
    at = content.index(b"\n\n", 3) + 2
    nv, nf = np.frombuffer(content, ">i4", 2, at)
    xyz = np.frombuffer(content, ">f4", 3 * nv, at + 8).reshape(-1, 3).astype(float)
    return xyz, np.frombuffer(content, ">i4", 3 * nf, at + 8 + 12 * nv).reshape(-1, 3).astype(np.int64)


def gifti(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, faces): the first two data arrays."""
    kinds = {"NIFTI_TYPE_FLOAT32": "f4", "NIFTI_TYPE_INT32": "i4", "NIFTI_TYPE_UINT8": "u1"}
    out = []
    for a in ET.fromstring(content).iter("DataArray"):
        shape = [int(a.get(f"Dim{i}")) for i in range(int(a.get("Dimensionality")))]
        text = (a.find("Data").text or "").strip()
        if a.get("Encoding") == "ASCII":
            values = np.array(text.split(), float)
        else:
            raw = base64.b64decode(text)
            raw = zlib.decompress(raw) if a.get("Encoding") == "GZipBase64Binary" else raw
            values = np.frombuffer(raw, (">" if a.get("Endian") == "BigEndian" else "<") + kinds[a.get("DataType")])
        out.append(values.reshape(shape, order="C" if a.get("ArrayIndexingOrder") != "ColumnMajorOrder" else "F"))
    return out[0].astype(float), out[1].astype(np.int64)


def sniffed(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    return freesurfer(content) if content[:3] == b"\xff\xff\xfe" else gifti(content)


def to_freesurfer(xyz: np.ndarray, faces: np.ndarray) -> bytes:
    head = b"\xff\xff\xfe" + b"triangles\n\n" + np.array([len(xyz), len(faces)], ">i4").tobytes()
    return head + xyz.astype(">f4").tobytes() + faces.astype(">i4").tobytes()


def to_gifti(xyz: np.ndarray, faces: np.ndarray) -> bytes:
    """Points and triangles, compressed."""
    root = ET.Element("GIFTI", Version="1.0", NumberOfDataArrays="2")
    for intent, kind, a in (("NIFTI_INTENT_POINTSET", "NIFTI_TYPE_FLOAT32", xyz.astype("<f4")), ("NIFTI_INTENT_TRIANGLE", "NIFTI_TYPE_INT32", faces.astype("<i4"))):
        shape = {f"Dim{i}": str(n) for i, n in enumerate(a.shape)}
        array = ET.SubElement(root, "DataArray", Intent=intent, DataType=kind, ArrayIndexingOrder="RowMajorOrder", Dimensionality="2", Encoding="GZipBase64Binary", Endian="LittleEndian", **shape)
        ET.SubElement(array, "Data").text = base64.b64encode(zlib.compress(a.tobytes())).decode()
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)


def write_meshes(mesh: Mesh, folder: str, kind: str = "gifti", radius: float = 1.0) -> DataFrame:
    """A file for each mesh of vertices(mesh, v, x, y, z), faces(mesh, f, a, b, c): (mesh, path, bytes). Spheres are stored with a radius of 100.

    A file holds one mesh, so a task does; a mesh's size is bounded by its space.
    """
    ending, encode = {"gifti": (".surf.gii", to_gifti), "freesurfer": ("", to_freesurfer)}[kind]

    def write(key: tuple, v: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        content = encode(v.sort_values("v")[["x", "y", "z"]].to_numpy() * radius, f.sort_values("f")[["a", "b", "c"]].to_numpy())
        path = f"{folder.rstrip('/')}/{key[0]}{ending}"
        put(path, content)
        return pd.DataFrame({"mesh": [key[0]], "path": [path], "bytes": [len(content)]})

    kind_of_key = dict(mesh.vertices.dtypes)["mesh"]
    faces = mesh.faces.select("mesh", "f", "a", "b", "c").toDF("of", "f", "a", "b", "c")  # a name of its own, for tables with common columns
    found = mesh.vertices.groupBy("mesh").cogroup(faces.groupBy("of")).applyInPandas(write, f"mesh {kind_of_key}, path string, bytes long")
    return written(mesh.vertices.sparkSession, found, "meshes-written")


def _rows(parse: Callable, which: int):
    names = ("v", "x", "y", "z") if which == 0 else ("f", "a", "b", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                table = parse(content)[which]
                yield pa.RecordBatch.from_pydict({"mesh": pa.array([path] * len(table), pa.string()), names[0]: np.arange(len(table)), **{n: table[:, i] for i, n in enumerate(names[1:])}})

    return run


def read_meshes(spark: SparkSession, path: str, pattern: str | None = None, parse: Callable = sniffed) -> Mesh:
    """All meshes below a path: vertices(mesh, v, x, y, z) and faces(mesh, f, a, b, c)."""
    found = files(spark, path, pattern).select("path", "content")
    return Mesh(found.mapInArrow(_rows(parse, 0), "mesh string, v long, x double, y double, z double"), found.mapInArrow(_rows(parse, 1), "mesh string, f long, a long, b long, c long"))


def merged(left: Mesh, right: Mesh, n_left: int, f_left: int, center: bool = True) -> Mesh:
    """Two hemispheres as one mesh, moved so that the middle of their bounding box is the origin."""
    vertices = left.vertices.unionByName(right.vertices.withColumn("v", F.col("v") + n_left))
    faces = left.faces.unionByName(right.faces.select((F.col("f") + f_left).alias("f"), *[(F.col(k) + n_left).alias(k) for k in "abc"]))
    if center:
        box = vertices.agg(*[((F.min(k) + F.max(k)) / 2).alias(k) for k in "xyz"]).first()
        vertices = vertices.select("v", *[(F.col(k) - float(box[k])).alias(k) for k in "xyz"])
    return Mesh(vertices, faces)


def obj_lines(mesh: Mesh) -> DataFrame:
    """(kind, id, line) of a Wavefront OBJ file, in the order of kind and id: vertices, then faces counted from 1."""
    v = mesh.vertices.select(F.lit(0).alias("kind"), F.col("v").alias("id"), F.format_string("v %.6f %.6f %.6f", "x", "y", "z").alias("line"))
    return v.unionByName(mesh.faces.select(F.lit(1).alias("kind"), F.col("f").alias("id"), F.format_string("f %d %d %d", F.col("a") + 1, F.col("b") + 1, F.col("c") + 1).alias("line")))
