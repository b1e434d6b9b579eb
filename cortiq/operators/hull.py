"""Hulls: of any points, by divide and conquer; and of points on a sphere, put together from small neighborhoods.

On a sphere the faces of the hull around a vertex mostly depend on the points near it alone. Each vertex's neighborhood (REACH points,
more where they do not settle it) is one small group; a face counts when all three of its corners found it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, written
from .mesh import Mesh, barycentric, corners, oriented, sphere, union_points
from .nearest import nearest as knn

REACH = 24
#: Centers and points that meet in one row where neighborhoods were too small.
CENTERS, POINTS = 256, 8192
#: Points whose hull a task makes.
PART = 20_000


def hull(points: np.ndarray, eps: float = 1e-12) -> list[tuple[int, int, int]]:
    """Outward triangles of the hull of a few points, added one by one: faces that see a point give way to its cone."""
    n = len(points)
    normal = lambda f: np.cross(points[f[1]] - points[f[0]], points[f[2]] - points[f[0]])
    first = next(((0, i, j) for i in range(1, n) for j in range(i + 1, n) if np.linalg.norm(normal((0, i, j))) > eps), None)
    if first is None:
        return []
    side = (points - points[0]) @ normal(first)
    top = int(np.abs(side).argmax())
    if abs(side[top]) <= eps:
        return []
    a, b, c = first if side[top] < 0 else (first[0], first[2], first[1])
    faces = [(a, b, c), (a, top, b), (b, top, c), (c, top, a)]
    normals = [normal(f) for f in faces]
    for i in range(n):
        if i in (a, b, c, top):
            continue
        sees = [float(m @ (points[i] - points[f[0]])) > eps for f, m in zip(faces, normals, strict=True)]
        edges = {(f[k], f[(k + 1) % 3]) for f, s in zip(faces, sees, strict=True) if s for k in range(3)}
        kept = [(f, m) for f, m, s in zip(faces, normals, sees, strict=True) if not s]
        fresh = [(u, v, i) for u, v in edges if (v, u) not in edges]
        faces, normals = [f for f, _ in kept] + fresh, [m for _, m in kept] + [normal(f) for f in fresh]
    return faces


def quick_hull(points: np.ndarray) -> np.ndarray:
    """Outward triangles of the hull, none if the points are flat: the farthest point outside a face replaces all faces that it sees.

    Points wait at one of the faces that they are outside of; those inside all of them are never looked at again.
    """
    scale = np.abs(points - points.mean(axis=0)).max(initial=0) if len(points) else 0.0
    eps = 1e-12 * max(scale, 1e-300)
    low = int(points[:, 0].argmin()) if len(points) else 0
    far = lambda d: int(np.abs(d).argmax())
    if len(points) < 4:
        return np.zeros((0, 3), int)
    second = far(np.linalg.norm(points - points[low], axis=1))
    line = points[second] - points[low]
    third = far(np.linalg.norm(np.cross(points - points[low], line), axis=1))
    up = np.cross(line, points[third] - points[low])
    side = (points - points[low]) @ up / max(np.linalg.norm(up), 1e-300)
    top = far(side)
    if np.linalg.norm(up) <= eps * scale or abs(side[top]) <= eps:
        return np.zeros((0, 3), int)
    a, b, c = (low, second, third) if side[top] < 0 else (low, third, second)
    faces = np.array([(a, b, c), (a, top, b), (b, top, c), (c, top, a)])

    def planes(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.cross(points[f[:, 1]] - points[f[:, 0]], points[f[:, 2]] - points[f[:, 0]])
        n /= np.maximum(np.linalg.norm(n, axis=1), 1e-300)[:, None]
        return n, (n * points[f[:, 0]]).sum(axis=1)

    def waiting(some: np.ndarray, n: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        if not len(some):
            return [some] * len(n)
        height = points[some] @ n.T - at
        best = height.argmax(axis=1)
        out = height[np.arange(len(some)), best] > eps
        return [some[out & (best == k)] for k in range(len(n))]

    normal, offset = planes(faces)
    alive, outside = np.ones(4, bool), waiting(np.arange(len(points)), normal, offset)
    while todo := [k for k in np.flatnonzero(alive).tolist() if len(outside[k])]:
        for k in todo:
            if not alive[k]:
                continue
            some = outside[k]
            p = int(some[(points[some] @ normal[k]).argmax()])
            sees = np.flatnonzero(alive & (normal @ points[p] - offset > eps))
            gone = faces[sees]
            edges = np.concatenate([gone[:, [0, 1]], gone[:, [1, 2]], gone[:, [2, 0]]])
            known = set(map(tuple, edges.tolist()))
            rim = np.array([e for e in edges.tolist() if (e[1], e[0]) not in known])
            fresh = np.column_stack([rim, np.full(len(rim), p)])
            left = np.unique(np.concatenate([outside[j] for j in sees]))
            n, at = planes(fresh)
            alive[sees] = False
            for j in sees:
                outside[j] = outside[j][:0]
            faces, normal, offset = np.concatenate([faces, fresh]), np.concatenate([normal, n]), np.concatenate([offset, at])
            alive, outside = np.append(alive, np.ones(len(fresh), bool)), [*outside, *waiting(left[left != p], n, at)]
    return faces[alive]


def convex_hull(vertices: DataFrame, part: int = PART) -> Mesh:
    """The hull of any vertices(v, x, y, z), faces outward, of vertices that are corners; no faces if they are flat.

    Divide and conquer: only the corners of the hulls of parts go on, level by level, until one part holds all that is left, or
    a level drops hardly any - then nearly all of them are corners, and the last hull is as large as its result. A point inside the hull of
    its part is inside the whole one.
    """
    spark = vertices.sparkSession
    left = written(spark, vertices.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").select("v", "x", "y", "z"), "hull-level")
    n = left.count()

    def corners_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v", ignore_index=True)
        faces = quick_hull(pdf[["x", "y", "z"]].to_numpy())
        return pdf.loc[np.unique(faces) if len(faces) else pdf.index, ["v", "x", "y", "z"]]  # a flat part goes on as it is

    kind = dict(vertices.dtypes)["v"]
    while n > part:
        parts = -(-n // part)
        dealt = left.withColumn("part", F.pmod(F.xxhash64("v", F.lit(n)), F.lit(parts)))
        fewer = written(spark, dealt.groupBy("part").applyInPandas(corners_of, f"v {kind}, x double, y double, z double"), "hull-level")
        discard(left)
        before, left, n = n, fewer, fewer.count()
        if n > 0.9 * before:
            break

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v", ignore_index=True)
        faces = quick_hull(pdf[["x", "y", "z"]].to_numpy())
        ids = pdf["v"].to_numpy()[faces].reshape(-1, 3)
        return pd.DataFrame({"f": np.arange(len(faces)), "a": ids[:, 0], "b": ids[:, 1], "c": ids[:, 2]})

    faces = written(spark, left.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(whole, f"f long, a {kind}, b {kind}, c {kind}"), "hull")
    used = faces.select(F.explode(F.array("a", "b", "c")).alias("v")).distinct()
    return Mesh(left.join(used, "v", "left_semi"), faces)


def _flat_hull(u: np.ndarray) -> list[int]:
    """Corners of the hull of points in a plane, counterclockwise."""
    order = np.lexsort((u[:, 1], u[:, 0])).tolist()
    points = u.tolist()
    sides = []
    for way in (order, order[::-1]):
        side: list[int] = []
        for i in way:
            x, y = points[i]
            while len(side) > 1:
                (ax, ay), (bx, by) = points[side[-2]], points[side[-1]]
                if (bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0:
                    break
                side.pop()
            side.append(i)
        sides += side[:-1]
    return sides


def _seen_from(center: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Places of points of the unit sphere in the plane to which the inversion about a point of it takes them; the farther, the nearer to 0."""
    w = p - center
    axis = np.eye(3)[np.abs(center).argmin()]
    one = np.cross(axis, center)
    one /= np.linalg.norm(one)
    return (w @ np.column_stack([one, np.cross(center, one)])) / (w * w).sum(axis=1)[:, None]


def _sides(u: np.ndarray, ring: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Outward normals of a ring's sides and their distances from 0."""
    a, b = u[ring], u[np.roll(ring, -1)]
    normal = np.column_stack([b[:, 1] - a[:, 1], a[:, 0] - b[:, 0]])
    normal /= np.maximum(np.linalg.norm(normal, axis=1), 1e-300)[:, None]
    return normal, (normal * a).sum(axis=1)


def _star(me: int, u: np.ndarray, ids: np.ndarray, ring: list[int]) -> list[tuple[int, int, int]]:
    """The faces around a point, outward, from the hull of what it sees. Points on one circle make one flat piece, a fan from its smallest."""
    normal, at = _sides(u, ring)
    near = np.abs(u @ normal.T - at) <= 1e-10 * np.abs(u).max()
    out = []
    for k, (i, j) in enumerate(zip(ring, ring[1:] + ring[:1], strict=True)):
        on = np.flatnonzero(near[:, k])
        if len(on) > 2:
            along = (u[on] - u[i]) @ (u[j] - u[i])
            line = [int(v) for v in ids[on[np.argsort(along)]]]
        else:
            line = [int(ids[i]), int(ids[j])]
        first = min(me, *line)
        round_ = [me, *line]
        out += [(first, x, y) for x, y in zip(round_, round_[1:] + round_[:1], strict=True) if first not in (x, y) and me in (first, x, y)]
    return [min((f, f[1:] + f[:1], f[2:] + f[:2])) for f in out]


def triangulated(vertices: DataFrame, reach: int | None = None) -> Mesh:
    """The hull of vertices(v, x, y, z) on a sphere, faces outward; of equal places the smallest v is the corner, and zero vectors are inside.

    The inversion about a vertex makes the sphere a plane, and the faces around the vertex are the sides of the hull of all others in it. The
    nearest neighbors give these sides for certain when the hull holds the disc in which all that are farther lie. Vertices of which
    that is not so see more neighbors, and then all points, of which a task keeps what is outside the hull so far. With `reach` only so
    many neighbors are seen; raises if they were too few, or if points are flat.
    """
    spark = vertices.sparkSession
    places = sphere(vertices.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")).where("x * x + y * y + z * z > 0.5")
    unit = written(spark, places.groupBy("x", "y", "z").agg(F.min("v").cast("long").alias("v")), "sphere")
    n = unit.count()
    schema = "center long, a long, b long, c long, cx double, cy double, cz double, sides array<double>"
    at = unit.select(F.col("v").alias("center"), *[F.col(k).alias("c" + k) for k in "xyz"])

    def stars(near: DataFrame, complete: bool) -> DataFrame:
        """Faces of centers that are certain; of the others a row with their hull's sides and no face. near(center, cx, cy, cz, v, x, y, z)"""

        def one(rows: pd.DataFrame) -> Iterator[tuple]:
            me, center = int(rows["center"].iloc[0]), rows[["cx", "cy", "cz"]].iloc[0].to_numpy(float)
            other = rows["v"].to_numpy()
            p, ids = rows[["x", "y", "z"]].to_numpy()[other != me], other[other != me]
            u = _seen_from(center, p)
            ring = _flat_hull(u) if len(p) > 1 else []
            normal, h = _sides(u, ring) if len(ring) > 2 else (np.zeros((0, 2)), np.zeros(0))
            far = ((p - center) ** 2).sum(axis=1).max(initial=0)
            sure = complete or len(ids) == n - 1 or (len(h) and h.min() >= math.sqrt(max(1 / far - 0.25, 0)) * (1 + 1e-9))
            if sure and len(h):
                yield from ((me, *f, *center, None) for f in _star(me, u, ids, ring))
            else:
                yield (me, None, None, None, *center, np.column_stack([normal, h]).ravel().tolist())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = None
            for batch in batches:
                kept = batch if kept is None else pa.concat_batches([kept, batch])
                centers = kept.column("center").to_numpy()
                if len(centers):  # the last center may go on in the next batch
                    end = int(np.searchsorted(centers, centers[-1]))
                    yield from made(kept.slice(0, end))
                    kept = kept.slice(end)
            if kept is not None:
                yield from made(kept)

        def made(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = [r for _, rows in batch.to_pandas().groupby("center") for r in one(rows)]
            if found:
                kinds = [pa.int64()] * 4 + [pa.float64()] * 3 + [pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], ["center", "a", "b", "c", "cx", "cy", "cz", "sides"])

        return written(spark, near.repartition("center").sortWithinPartitions("center", "v").mapInArrow(run, schema), "stars")

    def among(centers: DataFrame, k: int) -> DataFrame:
        found = knn(centers.select(F.col("center").alias("p"), *[F.col("c" + x).alias(x) for x in "xyz"]), unit.withColumnRenamed("v", "q"), k + 1)
        return found.select(F.col("p").alias("center"), F.col("q").alias("v")).join(at, "center").join(unit, "v")

    found, left = [], at
    for k in (REACH, 8 * REACH) if reach is None else (reach,):
        found.append(stars(among(left, k), False))
        left = found[-1].where("sides IS NOT NULL")
        if not left.limit(1).count():
            break
    else:
        if reach is None:
            found.append(stars(written(spark, _outside(left, unit), "outside").join(at, "center"), True))
    faces = found[0]
    for more in found[1:]:
        faces = faces.unionByName(more)
    agreed = faces.where("sides IS NULL").groupBy("a", "b", "c").count().where("count = 3").select("a", "b", "c")
    from .mesh import _numbered

    faces = written(spark, _numbered(agreed, ["a", "b", "c"], 0).select(F.col("id").alias("f"), "a", "b", "c"), "hull")
    if faces.count() != 2 * n - 4:
        raise ValueError("neighborhoods are too small for the spacing of the points, or points are flat; take a larger reach")
    return Mesh(vertices, faces)


def _outside(centers: DataFrame, unit: DataFrame) -> DataFrame:
    """(center, v, x, y, z): of all points those that the sides so far of each of centers(center, cx, cy, cz, sides) do not hold inside.

    Centers are packed by CENTERS, and every pack meets every pack of POINTS points; of what a task finds for a center only the corners of its hull go on.
    """
    packs = centers.groupBy(F.pmod(F.xxhash64("center"), F.lit(max(1, -(-centers.count() // CENTERS)))).alias("pack")).agg(F.collect_list(F.struct("center", "cx", "cy", "cz", "sides")).alias("centers"))
    lists = unit.groupBy(F.pmod(F.xxhash64("v"), F.lit(max(1, -(-unit.count() // POINTS)))).alias("part")).agg(F.collect_list(F.struct("v", "x", "y", "z")).alias("points"))
    packs, lists = written(unit.sparkSession, packs, "packs"), written(unit.sparkSession, lists, "lists")
    pairs = packs.crossJoin(F.broadcast(lists.select("part"))).join(lists, "part")  # a row for each pair of packs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, points in zip(batch.column("centers"), batch.column("points"), strict=True):
                v, x, y, z = (points.values.field(k).to_numpy() for k in range(4))
                p = np.column_stack([x, y, z])
                for c in some.as_py():
                    other = v != c["center"]
                    u, sides = _seen_from(np.array([c["cx"], c["cy"], c["cz"]]), p[other]), np.array(c["sides"]).reshape(-1, 3)
                    mine = np.flatnonzero(((u @ sides[:, :2].T - sides[:, 2]) >= -1e-9 * np.abs(u).max(initial=0)).any(axis=1)) if len(sides) else np.arange(len(u))
                    if len(mine) > 64:
                        ring = _flat_hull(u[mine])
                        normal, h = _sides(u[mine], ring)
                        mine = mine[(np.abs(u[mine] @ normal.T - h) <= 1e-9 * np.abs(u[mine]).max()).any(axis=1)]
                    at = np.flatnonzero(other)[mine]
                    yield pa.RecordBatch.from_pydict({"center": pa.array(np.full(len(at), c["center"]), pa.int64()), "v": pa.array(v[at], pa.int64()), "x": p[at, 0], "y": p[at, 1], "z": p[at, 2]})

    return pairs.select("centers", "points").mapInArrow(run, "center long, v long, x double, y double, z double")


def union_sphere(mesh: Mesh, points: DataFrame, eps: float = 1e-10) -> tuple[Mesh, DataFrame]:
    """(mesh with the points(v, x, y, z) added, index(v, u) of the points): each face that is hit becomes the hull of its corners and points."""
    spark = mesh.faces.sparkSession
    every, index = union_points(mesh.vertices, points, eps)
    every = written(spark, every, "union")
    fresh = every.join(mesh.vertices.select("v"), "v", "left_anti")
    hit = barycentric(mesh, fresh.withColumnRenamed("v", "p")).select(F.col("p").alias("v"), "f")
    own = corners(mesh).select("f", F.explode(F.array(*[F.struct(F.col(k).alias("v"), *[F.col(k + d).alias(d) for d in "xyz"], F.lit(True).alias("corner")) for k in "abc"])).alias("e")).select("f", "e.*")
    members = own.join(hit.select("f").distinct(), "f", "left_semi").unionByName(hit.join(fresh, "v").select("f", "v", "x", "y", "z", F.lit(False).alias("corner")))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["corner", "v"], ascending=[False, True])
        ids, corner = pdf["v"].to_numpy(), pdf["corner"].to_numpy()
        found = [f for f in hull(pdf[["x", "y", "z"]].to_numpy()) if not corner[list(f)].all()]
        return pd.DataFrame([ids[list(f)] for f in found], columns=["a", "b", "c"], dtype="int64")

    new = members.groupBy("f").applyInPandas(split, "a long, b long, c long")
    kept = mesh.faces.select("f", "a", "b", "c").join(hit.select("f").distinct(), "f", "left_anti")
    base = (mesh.faces.agg(F.max("f")).first()[0] or 0) + 1
    from .mesh import _numbered

    faces = kept.unionByName(_numbered(new, ["a", "b", "c"], base).select(F.col("id").alias("f"), "a", "b", "c"))
    return oriented(Mesh(every, written(spark, faces, "faces"))), index
