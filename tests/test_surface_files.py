"""Writers against readers, comparison by what files say, the aligner, and areal transforms against a heap-based search."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cortiq.operators import align, geodesic, hull, mesh, spaces
from cortiq.sources import arrays, catalog, surfaces
from cortiq.tables import octahedron


@pytest.fixture(scope="module")
def ball(spark):
    return mesh.subdivided(mesh.Mesh(*octahedron(spark)), 3, on_sphere=True)


def coordinates(df):
    p = df.toPandas().sort_values("v")
    return p["v"].to_numpy(), p[["x", "y", "z"]].to_numpy()


@pytest.mark.parametrize("kind", ["gifti", "freesurfer"])
def test_meshes_come_back(spark, ball, tmp_path, kind):
    names = spark.createDataFrame([("lh.sphere",), ("rh.sphere",)], "mesh string")
    both = mesh.Mesh(ball.vertices.crossJoin(names), ball.faces.crossJoin(names))
    out = surfaces.write_meshes(both, f"file://{tmp_path}/out", kind, radius=100.0)
    assert {r["mesh"] for r in out.collect()} == {"lh.sphere", "rh.sphere"}
    back = surfaces.read_meshes(spark, f"{tmp_path}/out")
    assert back.vertices.select("mesh").distinct().count() == 2
    one = back.vertices.where(F.col("mesh").contains("lh.sphere"))
    np.testing.assert_allclose(coordinates(one)[1], coordinates(ball.vertices)[1] * 100, rtol=1e-6)
    faces = lambda df: df.orderBy("f").select("a", "b", "c").collect()
    assert faces(back.faces.where(F.col("mesh").contains("rh.sphere"))) == faces(ball.faces)


def test_arrays_come_back(spark, tmp_path):
    cells = spark.createDataFrame([(n, i, j, float(i * 10 + j + len(n))) for n in ("a", "bb") for i in range(4) for j in range(3)], "name string, i long, j long, x double")
    arrays.save_arrays(cells, f"file://{tmp_path}/dense")
    a = np.load(tmp_path / "dense" / "bb.npy")
    assert a.shape == (4, 3) and a[2, 1] == 23.0
    assert arrays.load(spark, f"{tmp_path}/dense/a.npy").count() == 12
    arrays.save_arrays(cells.select("name", F.col("i").alias("src"), F.col("j").alias("dst"), F.col("x").alias("w")), f"file://{tmp_path}/sparse", "npz")
    got = arrays.load(spark, f"{tmp_path}/sparse/a.npz").toPandas()
    assert len(got) == 12 and got["w"].sum() == sum(i * 10 + j + 1 for i in range(4) for j in range(3))
    with pytest.raises(TypeError):
        arrays.save_arrays(cells, "x", "pkl")


def test_files_are_compared_by_what_they_say(spark, tmp_path):
    for side, dtype in (("a", np.float32), ("b", np.float64)):
        (tmp_path / side).mkdir()
        np.save(tmp_path / side / "same.npy", np.arange(6, dtype=dtype).reshape(2, 3))
        np.save(tmp_path / side / "shape.npy", np.arange(6).reshape((2, 3) if side == "a" else (3, 2)))
        keys = ("x", "y") if side == "a" else ("y", "x")
        np.savez(tmp_path / side / "keys.npz", **{k: np.full(3, ord(k)) for k in keys})
        np.savez(tmp_path / side / "other.npz", x=np.ones(3), **({"z": np.ones(1)} if side == "b" else {}))
        (tmp_path / side / "t.txt").write_text("one" if side == "a" else "two")
    xyz, faces = np.random.default_rng(0).random((4, 3)), np.array([[0, 1, 2], [1, 2, 3]])
    (tmp_path / "a" / "m.gii").write_bytes(surfaces.to_gifti(xyz, faces))
    (tmp_path / "b" / "m.gii").write_bytes(surfaces.to_gifti(xyz, faces).replace(b"Version", b" Version"))
    got = {r["path"]: r["status"] for r in arrays.compared(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()}
    assert got == {"same.npy": "same", "shape.npy": "differs", "keys.npz": "same", "other.npz": "differs", "t.txt": "differs", "m.gii": "same"}


def turned(xyz, angle=0.5):
    c, s = np.cos(angle), np.sin(angle)
    return xyz @ np.array([[c, s, 0], [-s, c, 0], [0, 0, 1]])


def test_aligner(spark, ball, tmp_path):
    """A turned and moved copy of a template comes back onto it, from files of either layout."""
    v, xyz = coordinates(ball.vertices)
    template = xyz * [2, 3, 4] + 0.1 * xyz[:, [1, 2, 0]] ** 2
    own = turned(template) + [5, -3, 2]
    faces = ball.faces.orderBy("f").select("a", "b", "c").toPandas().to_numpy()
    surf = tmp_path / "fs" / "surf"
    anat = tmp_path / "prep" / "sub-1" / "anat"
    surf.mkdir(parents=True), anat.mkdir(parents=True)
    (surf / "lh.sphere.reg").write_bytes(surfaces.to_freesurfer(xyz * 100, faces))
    (surf / "lh.pial").write_bytes(surfaces.to_freesurfer(own, faces))
    (anat / "sub-1_hemi-L_space-fsaverage_desc-reg_sphere.surf.gii").write_bytes(surfaces.to_gifti(xyz * 100, faces))
    (anat / "sub-1_hemi-L_pial.surf.gii").write_bytes(surfaces.to_gifti(own, faces))
    table = lambda a: spark.createDataFrame([(int(i), *map(float, p)) for i, p in zip(v, a, strict=True)], "v long, x double, y double, z double")
    for a in (align.Aligner.from_freesurfer(spark, f"{tmp_path}/fs", "l"), align.Aligner.from_fmriprep(spark, f"{tmp_path}/prep", "l")):
        ids, got = coordinates(a.run(ball.vertices, table(template)))
        np.testing.assert_array_equal(ids, v)
        np.testing.assert_allclose(got, template - template.mean(0), atol=1e-4)
    with pytest.raises(RuntimeError):
        align.Aligner.from_fmriprep(spark, f"{tmp_path}/prep", "r")


def brute_areal(union, anatomy, first, second):
    """Areas of vertices by their nearest of first and of second (union numbers), by a heap."""
    v, xyz = anatomy
    where = dict(zip(v, xyz, strict=True))
    near, area = defaultdict(set), defaultdict(float)
    for a, b, c in union.faces.select("a", "b", "c").collect():
        size = np.linalg.norm(np.cross(where[b] - where[a], where[c] - where[a])) / 6
        for p, q in ((a, b), (b, c), (a, c)):
            near[p].add(q), near[q].add(p)
        for p in (a, b, c):
            area[p] += size

    def owners(seeds):
        best, heap = {}, [(0.0, s, s) for s in seeds]
        heapq.heapify(heap)
        while heap:
            d, s, p = heapq.heappop(heap)
            if p not in best:
                best[p] = s
                for q in near[p]:
                    heapq.heappush(heap, (d + np.linalg.norm(where[p] - where[q]), s, q))
        return best

    one, two, out = owners(first), owners(second), defaultdict(float)
    for p, size in area.items():
        out[one[p], two[p]] += size
    return out


def test_areal_transform(spark, ball):
    rng = np.random.default_rng(2)
    points = spark.createDataFrame([(100 + i, *map(float, p)) for i, p in enumerate(rng.standard_normal((7, 3)))], "v long, x double, y double, z double")
    anatomy = ball.vertices.select("v", F.col("x") * 2, F.col("y") * 1.5, F.col("z") + 0.2 * F.col("x")).toDF("v", "x", "y", "z")
    got = {(r["src"], r["dst"]): r["w"] for r in geodesic.areal_transform(ball, anatomy, points).collect()}
    union, index = hull.union_sphere(ball, mesh.sphere(points))
    weights = mesh.interpolation(ball, union.vertices.withColumnRenamed("v", "p")).toPandas()
    v, xyz = coordinates(anatomy)
    place = dict(zip(v, xyz, strict=True))
    there = defaultdict(lambda: np.zeros(3))
    for r in weights.itertuples():
        there[r.dst] = there[r.dst] + r.w * place[r.src]
    number = {r["u"]: r["v"] for r in index.collect()}
    want = brute_areal(union, (list(there), list(there.values())), [int(i) for i in v], list(number))
    want = {(s, number[d]): w for (s, d), w in want.items()}
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=1e-9)


def test_areal_highres_covers_the_surface(spark, ball):
    rng = np.random.default_rng(3)
    sets = [spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.standard_normal((n, 3)))], "v long, x double, y double, z double") for n in (5, 4)]
    got = geodesic.areal_highres(ball, ball.vertices, *sets, n_div=2).toPandas()
    assert set(got["src"]) == set(range(5)) and set(got["dst"]) == set(range(4))
    flat = mesh.face_areas(ball).agg(F.sum("area")).first()[0]
    assert got["w"].sum() == pytest.approx(flat, rel=1e-6)


def test_parcels_and_masks(spark):
    parcels = spark.createDataFrame([(1, 0, 0.2), (1, 1, 0.9), (2, 2, 0.7), (2, 3, 0.7)], "label int, v int, p double")
    whole = spaces.with_background(parcels, spark.range(4).select(F.col("id").cast("int").alias("v")))
    assert whole.where("label = 0").count() == 4 and whole.where("label = 0 AND p <> 0").count() == 0
    members = spark.createDataFrame([(1, 1), (2, 3)], "label int, v int")
    assert {(r["label"], r["v"], r["found"]) for r in spaces.peaks_in(whole, members).collect()} == {(1, 1, True), (2, 2, False)}
    a, b = (spark.createDataFrame(rows, "v int, keep boolean") for rows in ([(0, True), (1, False)], [(0, True), (1, True), (2, False)]))
    assert {r["v"] for r in spaces.masks_differ(a, b).collect()} == {1, 2}


def test_mask_names(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path))
    rows = [("fsavg-ico32", "aparc.a2009s", "l", "fsaverage", 0, True), ("mkavg-ico32", "MEBRAIN", "l", "MEBRAIN", 0, False)]
    c.write(spark.createDataFrame(rows, "space string, which string, hemi string, group string, v int, keep boolean").withColumn("resample", F.lit("overlap-8div")), "masks", ["space", "which", "hemi", "group", "resample"])
    assert c.mask("l", "fsavg-ico32", legacy=True).first()["keep"] and not c.mask("l", "mkavg-ico32").first()["keep"] and c.mask("l", "fsavg-ico32").count() == 0
