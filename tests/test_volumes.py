"""Volumes as a data source: round trips, slabs, gz streams, headers and comparison."""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pandas as pd
import pytest

from cortiq.sources import volumes


def back(df, shape):
    out = np.full(shape, np.nan)
    for r in volumes.cells(df).collect():
        out[r["i"], r["j"], r["k"], r["t"]] = r["x"]
    return out



@pytest.mark.parametrize("ending", [".nii", ".nii.gz"])
def test_round_trip(spark, tmp_path, ending):
    x = np.random.default_rng(41).integers(-99, 99, (5, 4, 7, 3)).astype("i2")
    content = volumes.nifti(x, 0.5, 2.0)
    (tmp_path / f"a{ending}").write_bytes(gzip.compress(content) if ending.endswith("gz") else content)
    df = volumes.read_volumes(spark, str(tmp_path), slab=100)
    np.testing.assert_array_equal(back(df, x.shape), x * 0.5 + 2.0)
    assert df.rdd.getNumPartitions() == (1 if ending.endswith("gz") else 11) and df.count() == 21
    assert df.first()["shape"] == [5, 4, 7, 3]


def test_mgh_and_big_endian(spark, tmp_path):
    x = np.arange(24.0).reshape(2, 3, 4, 1)
    content = struct.pack(">i", 1) + struct.pack(">4i", *x.shape) + struct.pack(">i", 3) + bytes(260) + np.asfortranarray(x.astype(">f4")).tobytes(order="F")
    (tmp_path / "a.mgz").write_bytes(gzip.compress(content))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.mgh").write_bytes(content)
    df = volumes.read_volumes(spark, str(tmp_path))
    for name in ("a.mgz", "b.mgh"):
        np.testing.assert_array_equal(back(df.where(df["path"].endswith(name)), x.shape), x)


def test_a_gz_stream_of_many_slices(spark, tmp_path):
    """More values than a batch of slices holds, from one stream."""
    x = np.random.default_rng(42).normal(size=(64, 64, 80, 4)).astype("f4")
    (tmp_path / "big.nii.gz").write_bytes(gzip.compress(volumes.nifti(x), 1))
    df = volumes.read_volumes(spark, str(tmp_path / "big.nii.gz"))
    got = df.selectExpr("aggregate(x, 0D, (a, e) -> a + e) AS s").agg({"s": "sum"}).first()[0]
    assert df.count() == 320 and got == pytest.approx(x.astype(float).sum(), rel=1e-9)


def test_errors_name_the_file(spark, tmp_path):
    (tmp_path / "bad.nii").write_bytes(b"x" * 400)
    with pytest.raises(Exception, match="bad.nii"):
        volumes.read_volumes(spark, str(tmp_path)).count()
    (tmp_path / "bad.nii").write_bytes(volumes.nifti(np.ones((3, 3, 3)))[:-5])
    with pytest.raises(Exception, match="ends before"):
        volumes.read_volumes(spark, str(tmp_path)).count()


def test_comparison(spark, tmp_path):
    x = np.random.default_rng(43).normal(size=(3, 2, 4, 1))
    y, z = x.copy(), x.copy()
    x[0, 0, 0, 0] = y[0, 0, 0, 0] = z[0, 0, 0, 0] = np.nan
    z[1, 1, 2, 0] += 0.25
    for side, made in (("a", {"same": x, "values": x, "shape": x, "left": x}), ("b", {"same": y, "values": z, "shape": x[:2], "right": x})):
        (tmp_path / side).mkdir()
        for name, v in made.items():
            content = volumes.nifti(v)
            (tmp_path / side / f"{name}.nii.gz").write_bytes(gzip.compress(content, 9 if side == "a" else 1))
    got = {r["path"]: (r["status"], r["most"]) for r in volumes.compared_volumes(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()}
    assert got == {"same.nii.gz": ("same", 0.0), "values.nii.gz": ("values differ", pytest.approx(0.25)), "shape.nii.gz": ("shapes differ", None), "left.nii.gz": ("only left", None), "right.nii.gz": ("only right", None)}


def test_a_function_of_ones_own(spark, tmp_path):
    (tmp_path / "a.dat").write_bytes(b"1 2 3")
    load = lambda path, content: pd.DataFrame({"path": path, "x": [float(v) for v in content.split()]})
    assert [r["x"] for r in volumes.load_with(spark, str(tmp_path), load, "path string, x double", "*.dat").collect()] == [1.0, 2.0, 3.0]
