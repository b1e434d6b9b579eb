from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cortiq.operators import hull, mesh
from cortiq.tables import octahedron


def points(spark, p):
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p / np.linalg.norm(p, axis=1, keepdims=True))], "v long, x double, y double, z double")


def test_local_hull_is_convex():
    p = np.random.default_rng(0).standard_normal((40, 3))
    faces = hull.hull(p)
    for a, b, c in faces:
        assert ((p - p[a]) @ np.cross(p[b] - p[a], p[c] - p[a])).max() < 1e-9
    used = {v for f in faces for v in f}
    assert len(faces) == 2 * len(used) - 4


def test_triangulated_sphere_equals_the_whole_hull(spark):
    p = np.random.default_rng(1).standard_normal((150, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    got = hull.triangulated(points(spark, p), reach=60)
    assert {tuple(sorted((r["a"], r["b"], r["c"]))) for r in got.faces.collect()} == {tuple(sorted(f)) for f in hull.hull(p)}
    with pytest.raises(ValueError):
        hull.triangulated(points(spark, p), reach=4)


@pytest.mark.parametrize("kind", ["crowds and voids", "half", "cube", "repeated"])
def test_triangulated_sphere_at_any_density(spark, kind):
    """Crowds with wide empty places between, a half of the sphere only, points of one circle, equal points."""
    rng = np.random.default_rng(3)
    p = rng.standard_normal((700, 3))
    if kind == "crowds and voids":
        p = np.concatenate([p[:60], 5 * np.array([1, 2, 3]) + 0.05 * rng.standard_normal((600, 3)), 5 * np.array([-3, 1, 0]) + 0.001 * rng.standard_normal((340, 3))])
    elif kind == "half":
        p[:, 2] = np.abs(p[:, 2]) + 0.1
    elif kind == "cube":
        p = np.array([[x, y, z] for x in (-1, 1) for y in (-1, 1) for z in (-1, 1)], float)
    else:
        p = np.concatenate([p, p[:50], np.zeros((2, 3))])
    df = mesh.sphere(spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "v long, x double, y double, z double"))
    faces = np.array(hull.triangulated(df).faces.select("a", "b", "c").collect())
    n = {"crowds and voids": 1000, "cube": 8}.get(kind, 700)
    assert len(faces) == 2 * n - 4 and len(np.unique(faces)) == n
    u = np.array(df.orderBy("v").select("x", "y", "z").collect())
    whole(u, faces)


def test_union_sphere_stays_closed(spark):
    m = mesh.Mesh(*octahedron(spark))
    more = points(spark, np.random.default_rng(2).standard_normal((20, 3)))
    out, index = hull.union_sphere(m, more)
    assert out.vertices.count() == 26 and index.count() == 20
    assert out.faces.count() == 2 * 26 - 4
    assert mesh.neighbors(out.faces).where("v < nbr").count() == 3 * 26 - 6
    assert out.faces.select(F.explode(F.array("a", "b", "c")).alias("v")).distinct().count() == 26


def whole(p, faces):
    """Every face sees no point, and the surface is closed."""
    for i in range(0, len(faces), 50):
        f = faces[i : i + 50]
        n = np.cross(p[f[:, 1]] - p[f[:, 0]], p[f[:, 2]] - p[f[:, 0]])
        n /= np.linalg.norm(n, axis=1)[:, None]
        assert (p @ n.T - (n * p[f[:, 0]]).sum(axis=1)).max() < 1e-9 * np.abs(p).max()
    sides = [tuple(e) for k in range(3) for e in faces[:, [k, (k + 1) % 3]].tolist()]
    assert len(set(sides)) == len(sides) and {(b, a) for a, b in sides} == set(sides)


@pytest.mark.parametrize("kind", ["ball", "cube", "sphere", "line and spikes"])
def test_quick_hull(kind):
    rng = np.random.default_rng(51)
    p = rng.normal(size=(800, 3))
    if kind == "cube":
        p = np.concatenate([rng.uniform(-1, 1, (500, 3)), np.array([[x, y, z] for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)], float)])
    elif kind == "sphere":
        p /= np.linalg.norm(p, axis=1)[:, None]
    elif kind == "line and spikes":
        p = np.concatenate([np.outer(np.linspace(-1, 1, 200), [1, 2, 3]), 1e6 * np.eye(3), -1e6 * np.eye(3)])
    faces = hull.quick_hull(p)
    whole(p, faces)
    assert len(faces) == 2 * len(np.unique(faces)) - 4


def test_flat_points_have_no_hull(spark):
    flat = np.column_stack([np.random.default_rng(52).normal(size=(60, 2)), np.zeros(60)])
    for p in (flat, flat[:3], flat[:0], np.zeros((9, 3))):
        assert len(hull.quick_hull(p)) == 0
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(flat)], "v long, x double, y double, z double")
    assert hull.convex_hull(df, part=20).faces.count() == 0 and hull.convex_hull(df.limit(0)).faces.count() == 0


def test_hull_of_a_ball_by_parts(spark):
    """100,000 points in parts; no point sees a face."""
    rng = np.random.default_rng(53)
    p = rng.normal(size=(100_000, 3))
    p *= (rng.random(100_000) ** (1 / 3) / np.linalg.norm(p, axis=1))[:, None]
    df = spark.createDataFrame(pa.table({"v": np.arange(len(p)) + 7, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})).repartition(6)
    m = hull.convex_hull(df, part=9_000)
    faces = m.faces.select("a", "b", "c").toPandas().to_numpy() - 7
    whole(p, faces)
    assert m.vertices.count() == len(np.unique(faces))
