"""Triangle meshes as vertices(v, x, y, z) and faces(f, a, b, c)."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cross
from ..sources.scratch import discard, written
from .nearest import nearest as knn


@dataclass(frozen=True)
class Mesh:
    vertices: DataFrame
    faces: DataFrame

    def same_as(self, other: Mesh) -> bool:
        """Equal as bags of rows."""
        pairs = ((self.vertices, other.vertices), (self.faces, other.faces))
        return all(not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count() for a, b in pairs)


def corners(mesh: Mesh) -> DataFrame:
    """faces with the coordinates ax .. cz of their corners: three equi-joins."""
    out = mesh.faces
    for corner in "abc":
        out = out.join(mesh.vertices.select(F.col("v").alias(corner), *[F.col(k).alias(corner + k) for k in "xyz"]), corner)
    return out


def _edge(p: str, q: str):
    return tuple(F.col(q + k) - F.col(p + k) for k in "xyz")


def _unit(v):
    n = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return tuple(F.coalesce(F.try_divide(c, n), F.lit(0.0)) for c in v)


def neighbors(faces: DataFrame) -> DataFrame:
    """(v, nbr), each once in each direction."""
    edges = F.array(*[F.struct(F.col(p).alias("v"), F.col(q).alias("nbr")) for p in "abc" for q in "abc" if p != q])
    return faces.select(F.explode(edges).alias("e")).select("e.v", "e.nbr").distinct()


def neighbor_lists(faces: DataFrame) -> DataFrame:
    """(v, nbrs): neighbors in the order in which the faces first show them."""
    pairs = [F.struct("f", F.lit(i).alias("i"), F.col(p).alias("v"), F.col(q).alias("nbr")) for i, (p, q) in enumerate((("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b")))]
    seen = faces.select(F.explode(F.array(*pairs)).alias("e")).groupBy("e.v", "e.nbr").agg(F.min(F.struct("e.f", "e.i")).alias("first"))
    return seen.groupBy("v").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "nbr"))), lambda s: s["nbr"]).alias("nbrs"))


def edge_lengths(mesh: Mesh, pairs: DataFrame | None = None) -> DataFrame:
    """(v, nbr, d)"""
    pairs = neighbors(mesh.faces) if pairs is None else pairs
    p = mesh.vertices.select("v", *[F.col(k).alias("p" + k) for k in "xyz"])
    q = mesh.vertices.select(F.col("v").alias("nbr"), *[F.col(k).alias("q" + k) for k in "xyz"])
    e = _edge("p", "q")
    return pairs.join(p, "v").join(q, "nbr").select("v", "nbr", F.sqrt(e[0] * e[0] + e[1] * e[1] + e[2] * e[2]).alias("d"))


def face_areas(mesh: Mesh) -> DataFrame:
    """(f, area)"""
    n = cross(*_edge("a", "b"), *_edge("a", "c"))
    return corners(mesh).select("f", (F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2).alias("area"))


def vertex_areas(mesh: Mesh) -> DataFrame:
    """(v, area): a third of the faces around."""
    shares = mesh.faces.join(face_areas(mesh), "f").select(F.explode(F.array("a", "b", "c")).alias("v"), (F.col("area") / 3).alias("area"))
    return shares.groupBy("v").agg(F.sum("area").alias("area"))


def normals(mesh: Mesh, weight: str = "equal") -> DataFrame:
    """(v, nx, ny, nz): unit sums of the faces' unit normals, or (weight `sine`) of each corner's cross product of unit edges."""
    faces = corners(mesh)
    rows = []
    for p, q, r in (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")):
        n = _unit(cross(*_edge(p, q), *_edge(p, r))) if weight == "equal" else cross(*_unit(_edge(p, q)), *_unit(_edge(p, r)))
        rows.append(F.struct(F.col(p).alias("v"), *[c.alias("n" + k) for c, k in zip(n, "xyz", strict=True)]))
    sums = faces.select(F.explode(F.array(*rows)).alias("r")).groupBy("r.v").agg(*[F.sum(f"r.n{k}").alias("s" + k) for k in "xyz"])
    return sums.select("v", *[c.alias("n" + k) for c, k in zip(_unit(tuple(F.col("s" + k) for k in "xyz")), "xyz", strict=True)])


def vertex_faces(faces: DataFrame) -> DataFrame:
    """(v, faces array)"""
    return faces.select("f", F.explode(F.array("a", "b", "c")).alias("v")).groupBy("v").agg(F.array_sort(F.collect_list("f")).alias("faces"))


def sphere(vertices: DataFrame) -> DataFrame:
    """Vertices on the unit sphere."""
    return vertices.select("v", *[c.alias(k) for c, k in zip(_unit(tuple(F.col(k) for k in "xyz")), "xyz", strict=True)])


def oriented(mesh: Mesh) -> Mesh:
    """Faces turned so that their normals point away from the origin."""
    n = cross(*_edge("a", "b"), *_edge("a", "c"))
    out = sum((n[i] * (F.col("a" + k) + F.col("b" + k) + F.col("c" + k)) for i, k in enumerate("xyz")), F.lit(0.0))
    turned = corners(mesh).select("f", F.when(out < 0, F.col("c")).otherwise(F.col("a")).alias("p"), "b", F.when(out < 0, F.col("a")).otherwise(F.col("c")).alias("q"))
    return Mesh(mesh.vertices, turned.select("f", F.col("p").alias("a"), "b", F.col("q").alias("c")))


def tetrahedra(faces: DataFrame) -> DataFrame:
    """(p, q, r, s) of the four vertices whose four triangles are all faces: a pattern of equi-joins on sorted triangles."""
    t = faces.select(F.array_sort(F.array("a", "b", "c")).alias("k")).select(F.col("k")[0].alias("p"), F.col("k")[1].alias("q"), F.col("k")[2].alias("r")).distinct()
    with_s = t.join(t.select("p", "q", F.col("r").alias("s")), ["p", "q"]).where("r < s")
    third = with_s.join(t.select("p", F.col("q").alias("r"), F.col("r").alias("s")), ["p", "r", "s"], "left_semi")
    return third.join(t.select(F.col("p").alias("q"), F.col("q").alias("r"), F.col("r").alias("s")), ["q", "r", "s"], "left_semi").select("p", "q", "r", "s")


def subdivided(mesh: Mesh, n: int, on_sphere: bool = False) -> Mesh:
    """Each edge cut in n, each face in n * n. Old vertices keep their numbers, then come edge points, then inside points.

    A point is known by its weights on sorted corners, so neighbors agree on an edge whatever their orientation.
    """
    spark = mesh.faces.sparkSession
    if n == 1:
        return mesh
    lattice = spark.createDataFrame([(i, j, n - i - j) for i in range(n + 1) for j in range(n + 1 - i)], "wa int, wb int, wc int")
    key = F.array_sort(F.filter(F.array(*[F.struct(F.col(k).alias("v"), F.col("w" + k).alias("w")) for k in "abc"]), lambda e: e["w"] > 0))
    points = mesh.faces.crossJoin(F.broadcast(lattice)).select("f", "wa", "wb", "wc", key.alias("key"))  # a fixed lattice for each face
    fresh = points.where(F.size("key") > 1).select("key").distinct()
    count = mesh.vertices.agg(F.max("v")).first()[0] + 1
    rank = _numbered(fresh.withColumn("kind", F.size("key")), ["kind", "key"], count).drop("kind")
    ids = points.join(rank, "key", "left").withColumn("id", F.coalesce("id", F.get("key", F.lit(0))["v"]))
    parts = rank.select("id", F.posexplode("key").alias("pos", "e")).select("id", F.col("e.v").alias("v"), (F.col("e.w") / n).alias("w"))
    new = parts.join(mesh.vertices, "v").groupBy("id").agg(*[F.sum(F.col(k) * F.col("w")).alias(k) for k in "xyz"]).select(F.col("id").alias("v"), "x", "y", "z")
    new = sphere(new) if on_sphere else new
    small = [((i, j), (i + 1, j), (i, j + 1)) for i in range(n) for j in range(n - i)] + [((i + 1, j), (i + 1, j + 1), (i, j + 1)) for i in range(n - 1) for j in range(n - 1 - i)]
    tiles = spark.createDataFrame([(t, c, n - i - j, i, j) for t, tri in enumerate(small) for c, (i, j) in enumerate(tri)], "t int, corner int, wa int, wb int, wc int")
    faces = ids.join(F.broadcast(tiles), ["wa", "wb", "wc"]).groupBy("f", "t").pivot("corner", [0, 1, 2]).agg(F.first("id"))
    faces = faces.select((F.col("f") * n * n + F.col("t")).alias("f"), *[F.col(str(i)).alias(k) for i, k in enumerate("abc")])
    return Mesh(mesh.vertices.unionByName(new), faces)


def _numbered(df: DataFrame, order: list[str], base: int) -> DataFrame:
    """df with `id` from base on, in the given order: each range partition's rows are counted, then ranked inside it."""
    spread = written(df.sparkSession, df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offset = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy(*order)
    return spread.join(F.broadcast(offset), "part").select(*df.columns, (F.col("offset") + F.row_number().over(inside) - 1 + base).cast("long").alias("id"))


def barycentric(mesh: Mesh, points: DataFrame, eps: float = 5e-9, cells: int | None = None) -> DataFrame:
    """(p, f, wa, wb, wc): the face that the ray from the origin through each point(p, x, y, z) meets, and its weights.

    Faces are entered into all cells of a grid over directions that their bounding box touches, points into one, so
    candidates meet by an equi-join, in cells whose size follows from the number of faces; the face of the largest smallest weight wins, the first on ties.
    """
    if cells is None:
        # F faces cover a sphere of area 4 pi; a cell as wide as two of their edges holds a few faces at any size of the mesh.
        cells = int(min(2048, max(4, (max(mesh.faces.count(), 1) ** 0.5) / 3)))

    def cell(k, scale):
        return F.floor((F.least(F.greatest(k, F.lit(-1.0)), F.lit(0.999999)) + 1.0) * (cells / 2) + scale).cast("int")

    c = corners(mesh)
    unit = {p: _unit(tuple(F.col(p + k) for k in "xyz")) for p in "abc"}
    # A spherical triangle bulges beyond its corners' box by less than its longest edge.
    size = F.greatest(*[F.sqrt(sum(((unit[p][i] - unit[q][i]) * (unit[p][i] - unit[q][i]) for i in range(3)), F.lit(0.0))) for p, q in ("ab", "bc", "ca")])
    boxed = c.withColumn("pad", size / 2)
    for i, k in enumerate("xyz"):
        low, high = F.least(*[unit[p][i] for p in "abc"]), F.greatest(*[unit[p][i] for p in "abc"])
        boxed = boxed.withColumn("g" + k, F.explode(F.sequence(cell(low - F.col("pad"), 0.0), cell(high + F.col("pad"), 0.0))))
    u = _unit(tuple(F.col(k) for k in "xyz"))
    asked = points.select("p", *[F.col(k).alias("p" + k) for k in "xyz"], *[cell(u[i], 0.0).alias("g" + k) for i, k in enumerate("xyz")])
    both = boxed.join(asked, ["gx", "gy", "gz"])
    a, e1, e2, d = tuple(F.col("a" + k) for k in "xyz"), _edge("a", "b"), _edge("a", "c"), tuple(F.col("p" + k) for k in "xyz")
    n = cross(*e1, *e2)
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    det = dot(n, d)
    t = F.try_divide(dot(n, a), det)
    hit = tuple(t * d[i] - a[i] for i in range(3))
    wb, wc = F.try_divide(dot(cross(*hit, *e2), n), dot(n, n)), F.try_divide(dot(cross(*e1, *hit), n), dot(n, n))
    found = both.select("p", "f", t.alias("t"), (1.0 - wb - wc).alias("wa"), wb.alias("wb"), wc.alias("wc")).where("t > 0")
    best = found.groupBy("p").agg(F.min(F.struct((-F.round(F.least("wa", "wb", "wc"), 12)).alias("m"), "f", "wa", "wb", "wc")).alias("b"))
    return best.where(F.col("b.m") <= eps + 1e-6).select("p", "b.f", "b.wa", "b.wb", "b.wc")


def interpolation(mesh: Mesh, points: DataFrame, eps: float = 5e-9) -> DataFrame:
    """The transform (src vertex, dst point, w) of barycentric()."""
    found = barycentric(mesh, points, eps).join(mesh.faces, "f")
    return found.select(F.explode(F.array(*[F.struct(F.col(k).alias("src"), F.col("p").alias("dst"), F.col("w" + k).alias("w")) for k in "abc"])).alias("e")).select("e.*")


def nearest(points: DataFrame, targets: DataFrame) -> DataFrame:
    """(p, q, d): the nearest of targets(q, x, y, z) to each of points(p, x, y, z), the first on ties."""
    return knn(points, targets, 1).select("p", "q", "d")


def nearest_forward_reverse(sources: DataFrame, targets: DataFrame, reverse: bool = True) -> DataFrame:
    """The transform (src, dst, w) by nearest neighbors: each target's nearest source and, with reverse, each source that no target
    chose for its nearest target; weights of a target sum to 1."""
    s, t = sources.select(F.col("v").alias("q"), "x", "y", "z"), targets.select(F.col("v").alias("p"), "x", "y", "z")
    votes = nearest(t, s).select(F.col("q").alias("src"), F.col("p").alias("dst"))
    if reverse:
        rest = sources.join(votes.select(F.col("src").alias("v")), "v", "left_anti")
        back = nearest(rest.select(F.col("v").alias("p"), "x", "y", "z"), targets.select(F.col("v").alias("q"), "x", "y", "z"))
        votes = votes.unionByName(back.select(F.col("p").alias("src"), F.col("q").alias("dst")))
    sums = votes.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k")).join(sums, "dst").select("src", "dst", (F.col("k") / F.col("n")).alias("w"))


def union_points(first: DataFrame, second: DataFrame, eps: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """(points of both, index(v of the second, u of the union)): points of the second within eps of the first are the first's."""
    near = nearest(second.select(F.col("v").alias("p"), "x", "y", "z"), first.select(F.col("v").alias("q"), "x", "y", "z")).where(F.col("d") < eps)
    fresh = second.join(near.select(F.col("p").alias("v")), "v", "left_anti")
    base = (first.agg(F.max("v")).first()[0] or -1) + 1
    numbered = _numbered(fresh, ["v"], base)
    index = near.select(F.col("p").alias("v"), F.col("q").alias("u")).unionByName(numbered.select("v", F.col("id").alias("u")))
    return first.select("v", "x", "y", "z").unionByName(numbered.select(F.col("id").alias("v"), "x", "y", "z")), index


def rotation(source: DataFrame, target: DataFrame) -> np.ndarray:
    """The rotation that carries source(v, x, y, z), centred, best onto target: nine sums, then a 3 x 3 decomposition."""
    t = target.select("v", *[F.col(k).alias("t" + k) for k in "xyz"])
    both = source.join(t, "v")
    sums = both.agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(f"s{k}") for k in "xyz"], *[F.sum("t" + k).alias(f"m{k}") for k in "xyz"], *[F.sum(F.col(a) * F.col("t" + b)).alias(a + b) for a in "xyz" for b in "xyz"]).first()
    m = np.array([[sums[a + b] - sums["s" + a] * sums["m" + b] / sums["n"] for b in "xyz"] for a in "xyz"])
    u, _, vt = np.linalg.svd(m)
    d = np.sign(np.linalg.det(u @ vt))
    return u @ np.diag([1.0, 1.0, d]) @ vt


def rotated(vertices: DataFrame, r: np.ndarray, centred: bool = True) -> DataFrame:
    """vertices, less their mean, times a rotation."""
    mean = vertices.agg(*[F.avg(k).alias(k) for k in "xyz"]).first() if centred else {k: 0.0 for k in "xyz"}
    moved = [F.col(k) - float(mean[k]) for k in "xyz"]
    return vertices.select("v", *[sum((moved[i] * float(r[i, j]) for i in range(3)), F.lit(0.0)).alias(k) for j, k in enumerate("xyz")])


def flipped(mesh: Mesh, rounds: int | None = None) -> Mesh:
    """Faces after flips of edges that shorten them: of ABC and ABD, if CD is shorter than AB and no edge yet, ACD and BCD.

    A round takes every flip that gains most for both of its faces, so flips of a round never touch; rounds go on until
    none gains, which ends as each shortens the edges. If flips are left after a given number of rounds, an error says so.
    Distances are Euclidean. Edges must have two faces.
    """
    spark = mesh.faces.sparkSession
    where = mesh.vertices.select("v", F.array("x", "y", "z").alias("at"))
    faces = written(spark, mesh.faces, "faces")
    for done_rounds in itertools.count():
        sides = F.array(*[F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"), F.col(r).alias("r")) for p, q, r in (("a", "b", "c"), ("b", "c", "a"), ("a", "c", "b"))])
        edges = faces.select("f", F.explode(sides).alias("e")).select("f", "e.p", "e.q", "e.r")
        pairs = edges.groupBy("p", "q").agg(F.array_sort(F.collect_list(F.struct("f", "r"))).alias("s")).where(F.size("s") == 2)
        pairs = pairs.select("p", "q", F.col("s")[0]["f"].alias("f"), F.col("s")[1]["f"].alias("g"), F.least(F.col("s")[0]["r"], F.col("s")[1]["r"]).alias("c"), F.greatest(F.col("s")[0]["r"], F.col("s")[1]["r"]).alias("d"))
        fresh = pairs.join(edges.select(F.col("p").alias("c"), F.col("q").alias("d")).distinct(), ["c", "d"], "left_anti")
        for k in "pqcd":
            fresh = fresh.join(where.select(F.col("v").alias(k), F.col("at").alias("at" + k)), k)
        length = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        gain = (length("atp", "atq") - length("atc", "atd")).alias("gain")
        wanted = written(spark, fresh.select("p", "q", "c", "d", "f", "g", gain).where("gain > 1e-12"), "flips")
        if not wanted.limit(1).count():
            break
        if rounds is not None and done_rounds >= rounds:
            raise RuntimeError(f"flips that shorten edges are left after {rounds} rounds")
        rank = F.struct("gain", "p", "q")
        by_face = wanted.select(F.explode(F.array("f", "g")).alias("face"), rank.alias("r")).groupBy("face").agg(F.max("r").alias("top"))
        by_edge = wanted.groupBy("c", "d").agg(F.max(rank).alias("best"))
        tops = lambda n, t: by_face.select(F.col("face").alias(n), F.col("top").alias(t))
        done = wanted.join(tops("f", "t1"), "f").join(tops("g", "t2"), "g").join(by_edge, ["c", "d"]).where((F.col("t1") == rank) & (F.col("t2") == rank) & (F.col("best") == rank))
        new = done.select(F.explode(F.array(F.struct("f", F.col("c").alias("a"), F.col("d").alias("b"), F.col("p").alias("c")), F.struct(F.col("g").alias("f"), F.col("c").alias("a"), F.col("d").alias("b"), F.col("q").alias("c")))).alias("n")).select("n.*")
        new = written(spark, new, "flipped")
        faces = written(spark, faces.join(new.select("f"), "f", "left_anti").select("f", "a", "b", "c").unionByName(new), "faces")
    return Mesh(mesh.vertices, faces)


def edge_pairs(faces: DataFrame) -> DataFrame:
    """(p, q, f, g, c, d): each edge p < q with its two faces, and the corners c < d across it."""
    sides = F.array(*[F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"), F.col(r).alias("r")) for p, q, r in (("a", "b", "c"), ("b", "c", "a"), ("a", "c", "b"))])
    edges = faces.select("f", F.explode(sides).alias("e")).select("f", "e.p", "e.q", "e.r")
    two = edges.groupBy("p", "q").agg(F.array_sort(F.collect_list(F.struct("r", "f"))).alias("s")).where(F.size("s") == 2)
    return two.select("p", "q", F.col("s")[0]["f"].alias("f"), F.col("s")[1]["f"].alias("g"), F.col("s")[0]["r"].alias("c"), F.col("s")[1]["r"].alias("d"))


def flip_order(seed: int, sweep: int):
    """The place of edge (p, q) in a sweep: a hash, so that an order is known everywhere and needs no sort."""
    return F.xxhash64(F.lit(seed), F.lit(sweep), "p", "q")


def optimized(mesh: Mesh, seed: int = 0, sweeps: int | None = None) -> Mesh:
    """Faces after greedy flips in a seed's order: the same as of a loop over edges that flips each, in its turn, if that shortens it.

    A sweep takes all edges there are, in the order of flip_order; of faces ABC and ABD it makes ACD and BCD if CD is shorter than AB and
    no edge yet. Sweeps go on until one flips nothing. Edges are decided in rounds, by deterministic reservations: an edge is
    ready when, of the edges of the sweep that are left, it is the first at C and the first at D, where an edge is at the four
    corners of its two faces. Earlier edges then cannot change a face at C or D before its turn - a flip makes no face at a corner
    that it is not at - so neither its faces nor whether CD exists; and edges that are ready together share no face. Hence the result is
    the loop's, whatever runs at the same time. Distances are Euclidean.
    """
    spark = mesh.faces.sparkSession
    where = mesh.vertices.select("v", F.array("x", "y", "z").alias("at"))
    length = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    faces = written(spark, mesh.faces.select("f", "a", "b", "c"), "faces")
    for sweep in itertools.count():
        if sweeps is not None and sweep >= sweeps:
            break
        edges = written(spark, edge_pairs(faces), "edges")
        left, flips = written(spark, edges.select("p", "q", flip_order(seed, sweep).alias("turn")), "left"), 0
        while left.limit(1).count():
            mine = edges.join(left, ["p", "q"])
            turn = F.struct("turn", "p", "q")
            first = mine.select(F.explode(F.array("p", "q", "c", "d")).alias("v"), turn.alias("t")).groupBy("v").agg(F.min("t").alias("first"))
            at = lambda k: first.select(F.col("v").alias(k), F.col("first").alias("first_" + k))  # noqa: E731, B023
            ready = mine.join(at("c"), "c").join(at("d"), "d").where((F.col("first_c") == turn) & (F.col("first_d") == turn)).drop("first_c", "first_d")
            for k in "pqcd":
                ready = ready.join(where.select(F.col("v").alias(k), F.col("at").alias("at_" + k)), k)
            there = edges.select(F.col("p").alias("c"), F.col("q").alias("d"), F.lit(True).alias("there"))
            flip = F.col("there").isNull() & (length(F.col("at_c"), F.col("at_d")) < length(F.col("at_p"), F.col("at_q")))
            ready = written(spark, ready.join(there, ["c", "d"], "left").select("p", "q", "c", "d", "f", "g", flip.alias("flip")), "ready")
            new = ready.where("flip").select(F.explode(F.array(F.struct("f", F.col("c").alias("a"), F.col("d").alias("b"), F.col("p").alias("c")), F.struct(F.col("g").alias("f"), F.col("c").alias("a"), F.col("d").alias("b"), F.col("q").alias("c")))).alias("n")).select("n.*")
            remaining = written(spark, left.join(ready, ["p", "q"], "left_anti"), "left")
            if count := ready.where("flip").count():
                flips += count
                changed = written(spark, faces.join(new.select("f"), "f", "left_anti").unionByName(new), "faces")
                again = written(spark, edge_pairs(changed), "edges")
                discard(faces, edges)
                faces, edges = changed, again
            discard(left, ready)
            left = remaining
        discard(left, edges)
        if not flips:
            break
    return Mesh(mesh.vertices, faces)
