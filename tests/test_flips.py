"""Edge flips that a limit of rounds stops."""

from __future__ import annotations

import numpy as np
import pytest

from cortiq.operators import mesh
from cortiq.tables import octahedron


def test_flips_left_are_an_error(spark):
    m = mesh.Mesh(*octahedron(spark))
    long = mesh.Mesh(m.vertices.withColumn("x", m.vertices.x * 9), m.faces)
    with pytest.raises(RuntimeError):
        mesh.flipped(long, rounds=0)
    assert mesh.flipped(long).faces.count() == 8
    assert mesh.flipped(m, rounds=0).same_as(m)


def looped(faces, places, order):
    """The same flips, one edge after the other."""
    faces = [tuple(sorted(f)) for f in faces]
    for sweep in range(100):
        edges = {}
        for i, f in enumerate(faces):
            for e in ((f[0], f[1]), (f[0], f[2]), (f[1], f[2])):
                edges.setdefault(e, set()).add(i)
        flips = 0
        for e in sorted(edges, key=lambda e: (order[sweep, e], e)):
            i, j = sorted(edges[e])
            c, d = sorted(next(v for v in faces[k] if v not in e) for k in (i, j))
            if (c, d) in edges or not np.linalg.norm(places[c] - places[d]) < np.linalg.norm(places[e[0]] - places[e[1]]):
                continue
            for k, end in ((i, e[0]), (j, e[1])):
                for old in ((faces[k][0], faces[k][1]), (faces[k][0], faces[k][2]), (faces[k][1], faces[k][2])):
                    edges[old].discard(k)
                faces[k] = tuple(sorted((c, d, end)))
            del edges[e]
            for k in (i, j):
                f = faces[k]
                for new in ((f[0], f[1]), (f[0], f[2]), (f[1], f[2])):
                    edges.setdefault(new, set()).add(k)
            flips += 1
        if not flips:
            return set(faces), sweep
    raise AssertionError


def test_optimized_equals_the_loop_in_any_order(spark):
    """Ten spheres side by side, whose edges have ten orders; their points are crumpled, so that many flips gain."""
    rng = np.random.default_rng(61)
    base = mesh.subdivided(mesh.Mesh(*octahedron(spark)), 2, on_sphere=True)
    p = base.vertices.orderBy("v").toPandas()[["x", "y", "z"]].to_numpy()
    f = base.faces.select("a", "b", "c").toPandas().to_numpy()
    n = len(p)
    places = np.concatenate([p + rng.normal(0, 0.3, p.shape) + 10 * k for k in range(10)])
    faces = np.concatenate([f + n * k for k in range(10)])
    vertices = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(places)], "v long, x double, y double, z double")
    table = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(faces)], "f long, a long, b long, c long")
    pairs = spark.createDataFrame([(n * k + i, n * k + j) for k in range(10) for i in range(n) for j in range(i + 1, n)], "p long, q long")
    order = {(s, (r["p"], r["q"])): r["t"] for s in range(12) for r in pairs.select("p", "q", mesh.flip_order(7, s).alias("t")).collect()}
    want, passes = looped(faces, places, order)
    got = mesh.optimized(mesh.Mesh(vertices, table), seed=7)
    assert {tuple(sorted((r["a"], r["b"], r["c"]))) for r in got.faces.collect()} == want
    assert passes >= 2 and want != {tuple(sorted(x)) for x in faces.tolist()}
