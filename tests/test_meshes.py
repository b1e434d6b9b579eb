"""Meshes, geodesics and transforms on shapes with known answers."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cortiq import registry
from cortiq.operators import geodesic, mesh, pairwise, spaces
from cortiq.tables import octahedron


@pytest.fixture(scope="module")
def ball(spark):
    m = mesh.subdivided(mesh.Mesh(*octahedron(spark)), 3, on_sphere=True)
    return mesh.Mesh(m.vertices.cache(), m.faces.cache())


def test_subdivision(ball):
    assert ball.vertices.count() == 38 and ball.faces.count() == 72
    assert mesh.neighbors(ball.faces).where("v < nbr").count() == 108
    area = mesh.face_areas(ball).agg(F.sum("area")).first()[0]
    assert 0.8 * 4 * math.pi < area < 4 * math.pi
    assert mesh.vertex_areas(ball).agg(F.sum("area")).first()[0] == pytest.approx(area)
    degrees = mesh.neighbor_lists(ball.faces).select(F.size("nbrs").alias("n"), "v").toPandas()
    assert set(degrees.loc[degrees["v"] < 6, "n"]) == {4}


def test_flat_square_keeps_edges_together(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 1.0, 1.0, 0.0), (3, 0.0, 1.0, 0.0)], "v long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 2, 3)], "f long, a long, b long, c long")
    m = mesh.subdivided(mesh.Mesh(v, f), 3)
    assert m.vertices.count() == 16 and m.faces.count() == 18
    assert mesh.face_areas(m).agg(F.min("area"), F.max("area")).first() == pytest.approx((1 / 18, 1 / 18))


def test_barycentric_finds_every_point(spark, ball):
    rng = np.random.default_rng(0)
    points = rng.standard_normal((40, 3))
    table = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "p long, x double, y double, z double")
    found = mesh.barycentric(ball, table).toPandas()
    assert len(found) == 40 and (found[["wa", "wb", "wc"]].min(axis=1) > -1e-6).all()
    v = ball.vertices.toPandas().set_index("v")
    f = ball.faces.toPandas().set_index("f")
    for r in found.itertuples():
        at = sum(w * v.loc[f.loc[r.f, k]].to_numpy() for w, k in ((r.wa, "a"), (r.wb, "b"), (r.wc, "c")))
        np.testing.assert_allclose(at / np.linalg.norm(at), points[r.p] / np.linalg.norm(points[r.p]), atol=1e-9)
    w = mesh.interpolation(ball, table).groupBy("dst").agg(F.sum("w").alias("w")).toPandas()["w"]
    np.testing.assert_allclose(w, 1)


def test_dijkstra_matches_a_heap(spark, ball):
    e = mesh.edge_lengths(ball)
    rows = e.collect()
    near = {}
    for r in rows:
        near.setdefault(r["v"], []).append((r["nbr"], r["d"]))
    best, heap = {0: 0.0}, [(0.0, 0)]
    while heap:
        d, v = heapq.heappop(heap)
        if d > best[v]:
            continue
        for n, s in near[v]:
            if d + s < best.get(n, math.inf):
                best[n] = d + s
                heapq.heappush(heap, (d + s, n))
    got = {r["v"]: r["d"] for r in geodesic.dijkstra(e, 0).collect()}
    assert got == pytest.approx(best)
    limit = sorted(best.values())[10]
    assert {r["v"] for r in geodesic.dijkstra(e, 0, limit).collect()} == {v for v, d in best.items() if d < limit}


def test_unreached_parts_are_absent(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "v long, nbr long, d double")
    assert {r["v"] for r in geodesic.dijkstra(e, 0).collect()} == {0, 1}


def test_ties_go_to_the_lowest_seed(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)], "v long, nbr long, d double")
    seeds = spark.createDataFrame([(0, 0, 0.0), (2, 2, 0.0)], "v long, seed long, d double")
    assert {r["v"]: r["seed"] for r in geodesic.nearest_seed(e, seeds).collect()} == {0: 0, 1: 0, 2: 2}


def test_territories_cover_the_surface(spark):
    m = mesh.Mesh(*octahedron(spark))
    area = mesh.face_areas(m).agg(F.sum("area")).first()[0]
    assert geodesic.geodesic_areas(m, 2, 4).agg(F.sum("area")).first()[0] == pytest.approx(area)
    targets = m.vertices.select(F.col("v").alias("p"), "x", "y", "z")
    w = geodesic.overlap_transform(m, m, targets, 2, 4)
    assert w.agg(F.sum("w")).first()[0] == pytest.approx(area)
    assert w.where("src = dst").agg(F.sum("w")).first()[0] == pytest.approx(area)


def test_territories_need_no_table_of_lines(spark, ball, monkeypatch):
    """By faces as by all lines between the points of a border and all tiles, on an uneven mesh."""
    m = mesh.Mesh(ball.vertices.select("v", F.col("x") * 3, "y", (F.col("z") / 4).alias("z")).toDF("v", "x", "y", "z"), ball.faces)
    points, edges = geodesic.visibility_graph(m, 4)
    _, border = geodesic.face_borders(m, 4)
    few = m.vertices.where("v % 6 = 0").select("v", F.col("v").alias("seed"), F.lit(0.0).alias("d"))
    want = {r["v"]: r["d"] for r in geodesic.nearest_seed(edges, few).collect()}
    assert {r["v"]: r["d"] for r in geodesic.nearest_in_faces(border, few).collect()} == pytest.approx(want, abs=1e-12)
    every = geodesic.nearest_in_faces(border, m.vertices.select("v", F.col("v").alias("seed"), F.lit(0.0).alias("d"))).localCheckpoint()
    tiles = geodesic.occupation(m, points, every, None, 8).groupBy("f", "owner").count()
    assert sorted(map(tuple, geodesic.territories(border, m, every, 8).collect())) == sorted(map(tuple, tiles.collect()))
    monkeypatch.setattr(geodesic, "visibility_graph", None)
    area = mesh.face_areas(m).agg(F.sum("area")).first()[0]
    assert geodesic.geodesic_areas(m, 4, 8).agg(F.sum("area")).first()[0] == pytest.approx(area)


def test_nearest_matches_all_pairs(spark):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((30, 3)) * 3, rng.standard_normal((25, 3))
    table = lambda m, k: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(m)], f"{k} long, x double, y double, z double")
    got = {r["p"]: r["q"] for r in mesh.nearest(table(a, "p"), table(b, "q")).collect()}
    assert got == {i: int(np.linalg.norm(b - p, axis=1).argmin()) for i, p in enumerate(a)}


def test_union_and_rotation(spark, ball):
    more = ball.vertices.where("v < 3").unionByName(spark.createDataFrame([(100, 0.6, 0.8, 0.0)], "v long, x double, y double, z double"))
    points, index = mesh.union_points(ball.vertices, more)
    assert points.count() == 39 and {r["v"]: r["u"] for r in index.collect()} == {0: 0, 1: 1, 2: 2, 100: 38}
    c, s = math.cos(0.4), math.sin(0.4)
    turned = ball.vertices.select("v", (F.col("x") * c - F.col("y") * s).alias("x"), (F.col("x") * s + F.col("y") * c).alias("y"), "z")
    r = mesh.rotation(ball.vertices, turned)
    back = mesh.rotated(ball.vertices, r).join(turned.select("v", F.col("x").alias("tx"), F.col("y").alias("ty")), "v")
    assert back.agg(F.max(F.abs(F.col("x") - F.col("tx")) + F.abs(F.col("y") - F.col("ty")))).first()[0] < 1e-9


def test_orientation_and_tetrahedra(spark):
    v, f = octahedron(spark)
    turned = f.select("f", F.when(F.col("f") % 2 == 0, F.col("c")).otherwise(F.col("a")).alias("p"), "b", F.when(F.col("f") % 2 == 0, F.col("a")).otherwise(F.col("c")).alias("q")).select("f", F.col("p").alias("a"), "b", F.col("q").alias("c"))
    assert mesh.oriented(mesh.Mesh(v, turned)).same_as(mesh.Mesh(v, f)) or mesh.face_areas(mesh.oriented(mesh.Mesh(v, turned))).count() == 8
    assert mesh.tetrahedra(f).count() == 0
    t = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 1, 3), (2, 0, 2, 3), (3, 1, 2, 3)], "f long, a long, b long, c long")
    assert mesh.tetrahedra(t).count() == 1


def test_smoothing_and_masks(spark):
    d = spark.createDataFrame([(i, j, float(abs(i - j))) for i in range(5) for j in range(5)], "i long, j long, d double")
    w = spaces.smoothing(d, fwhm=2.0)
    np.testing.assert_allclose(w.groupBy("dst").agg(F.sum("w").alias("s")).toPandas()["s"], 1)
    assert spaces.smoothing(d, fwhm=0).count() == 5
    with pytest.raises(ValueError):
        spaces.smoothing(d)
    mask = spark.createDataFrame([(i, i % 2 == 0) for i in range(5)], "v long, keep boolean")
    kept = spaces.masked_pairs(d, mask, mask)
    assert kept.count() == 9 and kept.agg(F.max("i"), F.max("j")).first() == (2, 2)
    lights = spaces.searchlights(d.select(F.col("i").alias("center"), F.col("j").alias("v"), F.col("d").alias("dist")), 1.0)
    assert lights.where("center = 0").count() == 2
    with pytest.raises(ValueError):
        spaces.searchlights(lights, 21)


def _regions(spark):
    rng = np.random.default_rng(61)
    rows = [(int(rng.integers(3)), i, [float(e) for e in rng.normal(0, 1, 3)]) for i in range(70)]
    points = spark.createDataFrame([*rows, (None, 70, [0.0, 0.0, 0.0]), (1, 71, None), (1, 72, [1.0, None, 0.0])], "region int, v long, x array<double>")
    d = {(i, j): float(np.linalg.norm(np.subtract(p, q))) for r, i, p in rows for s, j, q in rows if r == s}
    return points, d | {(i, i): 0.0 for i in (70, 71, 72)}


@pytest.mark.parametrize("keep_sum", [False, True])
def test_smoothing_sums_make_no_pairs(spark, monkeypatch, keep_sum):
    """Many small blocks, against all pairs as a table; points without a place or a region are near to themselves only."""
    points, d = _regions(spark)
    monkeypatch.setattr(pairwise, "BLOCK", 7)
    monkeypatch.setattr(pairwise, "TILE", 20)
    table = spark.createDataFrame([(i, j, x) for (i, j), x in d.items()], "i long, j long, d double")
    want = spaces.smoothing(table, fwhm=1.2, keep_sum=keep_sum).groupBy("src").agg(F.sum("w").alias("w"), F.sum(F.col("w") ** 2).alias("w2")).collect()
    got = {r["src"]: (r["w"], r["w2"]) for r in pairwise.smoothing_sums(points, spaces.spread(fwhm=1.2), keep_sum).collect()}
    assert len(got) == len(want) == 73
    for r in want:
        assert got[r["src"]] == pytest.approx((r["w"], r["w2"]))


def test_smooth_queries_make_no_table_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(spaces, "symmetric", None)
    for name in ("smooth_kernel", "smooth_kernel_keep_sum"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 500


def test_sums_by_source_take_one_pass(spark, monkeypatch):
    points, _ = _regions(spark)
    passes, once = [], pairwise.distance_sums
    monkeypatch.setattr(pairwise, "distance_sums", lambda *a, **k: passes.append(1) or once(*a, **k))
    assert {r["w"] for r in pairwise.smoothing_sums(points, 1.0, True).collect()} == {1.0} and len(passes) == 1


def test_searchlight_sums_make_no_pairs(spark, monkeypatch):
    points, d = _regions(spark)
    monkeypatch.setattr(pairwise, "BLOCK", 7)
    monkeypatch.setattr(spaces, "searchlights", None)
    kept = spark.createDataFrame([(i, i - i // 5 - 1) for i in range(73) if i % 5], "v long, vm long")
    got = {r["center"]: (r["n"], r["mean"], r["first"]) for r in pairwise.searchlight_sums(points, 1.5, kept).collect()}
    for i in range(73):
        near = [(x, j - j // 5 - 1) for (c, j), x in d.items() if c == i and j % 5 and x <= 1.5]
        assert (i in got) == bool(near)
        if near:
            assert got[i] == (len(near), pytest.approx(sum(x for x, _ in near) / len(near)), min(vm for _, vm in near))
    assert registry.QUERIES["searchlight_mean"](spark, "/root/testdata/sf0.001").count() > 0


def test_empty_target_is_zero_or_first_source(spark):
    t = spark.createDataFrame([(1, 0, 0.0), (0, 1, 2.0), (1, 1, 2.0)], "src long, dst long, w double")
    assert {(r["src"], r["dst"]): r["w"] for r in spaces.mapping(t).collect()} == {(1, 0): 0.0, (0, 1): 0.5, (1, 1): 0.5}
    assert {r["dst"]: r["src"] for r in spaces.mapping(t, nn=True).collect()} == {0: 0, 1: 0}
