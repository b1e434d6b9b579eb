from __future__ import annotations

import base64
import zlib

import numpy as np
from pyspark.sql import functions as F

from cortiq.functions import columns
from cortiq.operators import mesh, render
from cortiq.sources import surfaces
from cortiq.streaming.segments import segment_means
from cortiq.tables import octahedron


def test_surface_files(spark, tmp_path):
    xyz, faces = np.random.default_rng(0).standard_normal((4, 3)).astype("f4"), np.array([[0, 1, 2], [0, 2, 3]])
    (tmp_path / "lh.pial").write_bytes(b"\xff\xff\xfemade\n\n" + np.array([4, 2], ">i4").tobytes() + xyz.astype(">f4").tobytes() + faces.astype(">i4").tobytes())
    part = lambda a, k: f'<DataArray Dimensionality="2" Dim0="{a.shape[0]}" Dim1="3" DataType="{k}" Encoding="GZipBase64Binary" Endian="LittleEndian"><Data>{base64.b64encode(zlib.compress(a.tobytes())).decode()}</Data></DataArray>'
    (tmp_path / "l.surf.gii").write_text(f"<GIFTI>{part(xyz, 'NIFTI_TYPE_FLOAT32')}{part(faces.astype('i4'), 'NIFTI_TYPE_INT32')}</GIFTI>")
    m = surfaces.read_meshes(spark, str(tmp_path))
    for _, v in m.vertices.toPandas().groupby("mesh"):
        np.testing.assert_allclose(v.sort_values("v")[["x", "y", "z"]], xyz, rtol=1e-6)
    assert m.faces.count() == 4
    one = mesh.Mesh(m.vertices.where("mesh LIKE '%pial'").drop("mesh"), m.faces.where("mesh LIKE '%pial'").drop("mesh"))
    lines = [r["line"] for r in surfaces.obj_lines(surfaces.merged(one, one, 4, 2)).orderBy("kind", "id").collect()]
    assert len(lines) == 12 and lines[-1] == "f 5 7 8"


def test_flips_shorten_edges(spark):
    m = mesh.subdivided(mesh.Mesh(*octahedron(spark)), 2, on_sphere=True)
    rng = np.random.default_rng(0)
    moved = [(r["v"], *(np.array([r["x"], r["y"], r["z"]]) + rng.normal(0, 0.25, 3)).tolist()) for r in m.vertices.orderBy("v").collect()]
    m = mesh.Mesh(spark.createDataFrame(moved, "v long, x double, y double, z double"), m.faces)
    after = mesh.flipped(m)
    total = lambda x: mesh.edge_lengths(x).agg(F.sum("d"), F.count(F.lit(1))).first()
    assert total(after)[0] < total(m)[0] and total(after)[1] == total(m)[1] and after.faces.count() == m.faces.count()


def test_colors(spark):
    values = spark.createDataFrame([(0, 5.0), (1, float("nan")), (2, -9.0)], "v long, x double")
    gyri = spark.createDataFrame([(0, True), (1, True), (2, False)], "v long, gyrus boolean")
    ramp = spark.createDataFrame([(k, k / 255, 0.0, 0.0, 1.0) for k in range(256)], "k int, r double, g double, b double, a double")
    got = {r["v"]: (r["r"], r["g"]) for r in render.colored(values, ramp, gyri, 5.0).collect()}
    assert got == {0: (1.0, 0.0), 1: (0.8, 0.8), 2: (0.0, 0.0)}
    lookup = spark.createDataFrame([(0, 0, 0), (0, 1, None)], "row int, col int, v long")
    pixels = {r["col"]: r["a"] for r in render.pixels(render.colored(values, ramp, gyri, 5.0), lookup).collect()}
    assert pixels == {0: 1.0, 1: 0.0}
    assert render.value_range(values) == (-8.86, 4.86)


def test_narrowest_type(spark):
    df = spark.createDataFrame([(0.0, 100.0, True), (-1.0, 40000.0, True), (0.0, 1.0, False)], "a double, b double, w boolean")
    assert [r[0] for r in df.select(columns.narrowest_type(F.col("a"), F.col("b"), F.col("w"))).collect()] == ["tinyint", "int", "double"]


def test_segments_of_a_stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", "a", float(m)) for m in range(20)]
    table = spark.createDataFrame(rows, "ts string, k string, x double").select(F.to_timestamp("ts").alias("ts"), "k", "x")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = segment_means(stream, "ts", "x", ["k"], "5 minutes").writeStream.format("memory").queryName("segments").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["mean"] for r in spark.table("segments").collect()) == [2.0, 7.0, 12.0, 17.0]


def test_sizes_tell_the_space(spark):
    import pytest

    from cortiq.operators import spaces

    assert spaces.guessed(9675, 9666) == ("onavg-ico32", True, 9675)
    assert spaces.guessed(324) == ("onavg-ico4", False, 162) and spaces.vertex_count(4) == 162
    with pytest.raises(ValueError):
        spaces.guessed(5, 5)
    mask = spark.createDataFrame([(0, True), (1, False), (2, True)], "v long, keep boolean")
    t = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (2, 2, 0.5), (0, 2, 0.5)], "src long, dst long, w double")
    values = spark.createDataFrame([(0, 1.0), (1, 3.0)], "vm long, x double")
    got = {r["v"]: r["x"] for r in spaces.upsampled(values, t, mask).collect()}
    assert got[0] == 1.0 and np.isnan(got[1]) and got[2] == 2.0
