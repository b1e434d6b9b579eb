"""Queries over meshes that are made from tables, and the SQL that checks them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import geodesic, hull, mesh, nearest
from .registry import query, six
from .sources import surfaces
from .tables import OCTAHEDRON_SQL, embedding_rows, octahedron, read

# The vectors' first three dimensions as vertices; a face from each vector to the next and the seventh after it.

_MESH = """n AS (SELECT count(*) AS n FROM embeddings),
vertices AS (SELECT vec_id AS v, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
faces AS (SELECT vec_id AS f, vec_id AS a, (vec_id + 1) % n AS b, (vec_id + 7) % n AS c FROM embeddings, n),
corner AS (SELECT f, a, b, c, pa.x AS xa, pa.y AS ya, pa.z AS za, pb.x AS xb, pb.y AS yb, pb.z AS zb, pc.x AS xc, pc.y AS yc, pc.z AS zc
  FROM faces JOIN vertices pa ON pa.v = a JOIN vertices pb ON pb.v = b JOIN vertices pc ON pc.v = c),
crossed AS (SELECT *, (yb - ya) * (zc - za) - (zb - za) * (yc - ya) AS nx, (zb - za) * (xc - xa) - (xb - xa) * (zc - za) AS ny, (xb - xa) * (yc - ya) - (yb - ya) * (xc - xa) AS nz FROM corner),
area AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS n2 FROM crossed)"""


def _mesh(spark: SparkSession, sf_dir: str) -> mesh.Mesh:
    e = embedding_rows(spark, sf_dir)
    n = e.count()
    vertices = e.select(F.col("obs").alias("v"), *[F.col("x")[i].alias(k) for i, k in enumerate("xyz")])
    return mesh.Mesh(vertices, vertices.select(F.col("v").alias("f"), F.col("v").alias("a"), ((F.col("v") + 1) % n).alias("b"), ((F.col("v") + 7) % n).alias("c")))


@query(f"WITH {_MESH} SELECT f, round(n2 / 2, 7) + 0.0 AS area FROM area")
def data_face_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.face_areas(_mesh(spark, sf_dir)).select("f", six("area", 7))


@query(f"WITH {_MESH} SELECT v, round(sum(n2) / 6, 7) + 0.0 AS area FROM (SELECT unnest([a, b, c]) AS v, n2 FROM area) GROUP BY v")
def data_vertex_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.vertex_areas(_mesh(spark, sf_dir)).select("v", six("area", 7))


_EDGES = f"{_MESH}, e AS (SELECT DISTINCT unnest([a, a, b, b, c, c]) AS v, unnest([b, c, a, c, a, b]) AS nbr FROM faces)"


@query(f"WITH {_EDGES} SELECT e.v, nbr, round(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)), 7) + 0.0 AS d FROM e JOIN vertices p ON p.v = e.v JOIN vertices q ON q.v = nbr")
def data_edge_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.edge_lengths(_mesh(spark, sf_dir)).select("v", "nbr", six("d", 7))


@query(f"WITH {_EDGES} SELECT v, string_agg(nbr::VARCHAR, ',' ORDER BY nbr) AS nbrs FROM e GROUP BY v")
def data_neighbor_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.neighbor_lists(_mesh(spark, sf_dir).faces).select("v", F.array_join(F.array_sort("nbrs").cast("array<string>"), ",").alias("nbrs"))


@query(f"WITH {_MESH} SELECT v, string_agg(f::VARCHAR, ',' ORDER BY f) AS faces FROM (SELECT f, unnest([a, b, c]) AS v FROM faces) GROUP BY v")
def data_vertex_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.vertex_faces(_mesh(spark, sf_dir).faces).select("v", F.array_join(F.col("faces").cast("array<string>"), ",").alias("faces"))


@query(
    f"""WITH {_MESH}, s AS (SELECT v, sum(nx / n2) AS x, sum(ny / n2) AS y, sum(nz / n2) AS z FROM (SELECT unnest([a, b, c]) AS v, nx, ny, nz, n2 FROM area) GROUP BY v)
SELECT v, round(x / sqrt(x * x + y * y + z * z), 5) + 0.0 AS nx, round(y / sqrt(x * x + y * y + z * z), 5) + 0.0 AS ny, round(z / sqrt(x * x + y * y + z * z), 5) + 0.0 AS nz FROM s"""
)
def data_normals_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.normals(_mesh(spark, sf_dir)).select("v", six("nx", 5), six("ny", 5), six("nz", 5))


@query(
    f"""WITH {_MESH}, l AS (SELECT *, sqrt(pow(xb - xa, 2) + pow(yb - ya, 2) + pow(zb - za, 2)) AS ab, sqrt(pow(xc - xa, 2) + pow(yc - ya, 2) + pow(zc - za, 2)) AS ac, sqrt(pow(xc - xb, 2) + pow(yc - yb, 2) + pow(zc - zb, 2)) AS bc FROM area),
s AS (SELECT v, sum(nx / w) AS x, sum(ny / w) AS y, sum(nz / w) AS z FROM (SELECT unnest([a, b, c]) AS v, unnest([ab * ac, ab * bc, ac * bc]) AS w, nx, ny, nz FROM l) GROUP BY v)
SELECT v, round(x / sqrt(x * x + y * y + z * z), 5) + 0.0 AS nx, round(y / sqrt(x * x + y * y + z * z), 5) + 0.0 AS ny, round(z / sqrt(x * x + y * y + z * z), 5) + 0.0 AS nz FROM s"""
)
def data_normals_sine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.normals(_mesh(spark, sf_dir), "sine").select("v", six("nx", 5), six("ny", 5), six("nz", 5))


@query(f"WITH {_MESH} SELECT v, round(x / sqrt(x * x + y * y + z * z), 6) + 0.0 AS x, round(y / sqrt(x * x + y * y + z * z), 6) + 0.0 AS y, round(z / sqrt(x * x + y * y + z * z), 6) + 0.0 AS z FROM vertices")
def data_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.sphere(_mesh(spark, sf_dir).vertices).select("v", six("x"), six("y"), six("z"))


@query(f"WITH {_MESH}, o AS (SELECT *, nx * (xa + xb + xc) + ny * (ya + yb + yc) + nz * (za + zb + zc) < 0 AS turn FROM area) SELECT f, CASE WHEN turn THEN c ELSE a END AS a, b, CASE WHEN turn THEN a ELSE c END AS c FROM o")
def data_oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.oriented(_mesh(spark, sf_dir)).faces.select("f", "a", "b", "c")


@query(f"WITH {_MESH} SELECT f AS face, 9::BIGINT AS pieces, round(n2 / 18, 7) + 0.0 AS smallest, round(n2 / 18, 7) + 0.0 AS largest, round(n2 / 2, 7) + 0.0 AS area FROM area")
def data_subdivided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each face in nine: pieces of one size, which add up to it."""
    pieces = mesh.face_areas(mesh.subdivided(_mesh(spark, sf_dir), 3)).groupBy(F.floor(F.col("f") / 9).alias("face"))
    return pieces.agg(F.count(F.lit(1)).alias("pieces"), F.min("area").alias("smallest"), F.max("area").alias("largest"), F.sum("area").alias("area")).select("face", "pieces", six("smallest", 7), six("largest", 7), six("area", 7))


@query(
    f"""WITH {_EDGES}, p AS (SELECT p.x + (q.x - p.x) * k / 3 AS x, p.y + (q.y - p.y) * k / 3 AS y, p.z + (q.z - p.z) * k / 3 AS z FROM e JOIN vertices p ON p.v = e.v JOIN vertices q ON q.v = nbr, (VALUES (1), (2)) t(k) WHERE e.v < nbr
UNION ALL SELECT (xa + xb + xc) / 3, (ya + yb + yc) / 3, (za + zb + zc) / 3 FROM corner UNION ALL SELECT x, y, z FROM vertices)
SELECT round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM p"""
)
def data_subdivided_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old vertices, two points on each edge and one in each face."""
    return mesh.subdivided(_mesh(spark, sf_dir), 3).vertices.select(six("x"), six("y"), six("z"))


_FOURS = "t AS (SELECT 10 * n_nationkey + p AS p, 10 * n_nationkey + q AS q, 10 * n_nationkey + r AS r, n_nationkey AS k FROM nation, (VALUES (0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4)) v(p, q, r))"


@query(f"WITH {_FOURS} SELECT k * 10 + b AS p, k * 10 + b + 1 AS q, k * 10 + b + 2 AS r, k * 10 + b + 3 AS s FROM (SELECT DISTINCT k FROM t) x, (VALUES (0), (1)) y(b) WHERE b = 0 OR k % 2 = 0")
def data_tetrahedra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tetrahedra that share a face for each even nation; odd ones lack a face of the second."""
    from .tables import read

    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    tri = spark.createDataFrame([(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4)], "p int, q int, r int")
    t = nations.crossJoin(F.broadcast(tri)).where("k % 2 = 0 OR NOT (p = 2 AND r = 4)")  # seven rows for each
    at = lambda c: F.col("k") * 10 + F.col(c)
    return mesh.tetrahedra(t.select(F.monotonically_increasing_id().alias("f"), at("q").alias("a"), at("r").alias("b"), at("p").alias("c")))


@query(
    f"""WITH {_MESH}, {OCTAHEDRON_SQL.strip().replace("vertices(", "ov(", 1).replace("faces(", "of(", 1)},
k AS (SELECT of.f, of.a, of.b, of.c, pa.x AS xa, pa.y AS ya, pa.z AS za, pb.x AS xb, pb.y AS yb, pb.z AS zb, pc.x AS xc, pc.y AS yc, pc.z AS zc FROM of JOIN ov pa ON pa.v = a JOIN ov pb ON pb.v = b JOIN ov pc ON pc.v = c),
w AS (SELECT v AS p, f, x * xa + y * ya + z * za AS wa, x * xb + y * yb + z * zb AS wb, x * xc + y * yc + z * zc AS wc FROM vertices, k)
SELECT p, f::BIGINT AS f, round(wa / (wa + wb + wc), 6) + 0.0 AS wa, round(wb / (wa + wb + wc), 6) + 0.0 AS wb, round(wc / (wa + wb + wc), 6) + 0.0 AS wc FROM w WHERE wa >= 0 AND wb >= 0 AND wc >= 0"""
)
def barycentric_octahedron(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The octant of each vector, and its share of each axis."""
    points = _mesh(spark, sf_dir).vertices.withColumnRenamed("v", "p")
    return mesh.barycentric(mesh.Mesh(*octahedron(spark)), points).select("p", "f", six("wa"), six("wb"), six("wc"))


@query(
    f"""WITH {_MESH}, {OCTAHEDRON_SQL.strip().replace("vertices(", "ov(", 1).replace("faces(", "of(", 1)}, s AS (SELECT v AS dst, x, y, z, abs(x) + abs(y) + abs(z) AS n FROM vertices)
SELECT ov.v::BIGINT AS src, dst, round((s.x * ov.x + s.y * ov.y + s.z * ov.z) / n, 6) + 0.0 AS w FROM s, ov WHERE s.x * ov.x + s.y * ov.y + s.z * ov.z > 0"""
)
def interpolation_octahedron(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _mesh(spark, sf_dir).vertices.withColumnRenamed("v", "p")
    return mesh.interpolation(mesh.Mesh(*octahedron(spark)), points).where("w > 0").select("src", "dst", six("w"))


@query(f"WITH {_MESH} SELECT count(*) AS points, (SELECT count(*) FROM vertices WHERE v % 3 <> 1) AS shared, round(sum(x * x + y * y + z * z), 4) + 0.0 AS size FROM (SELECT * FROM vertices UNION ALL SELECT v, -y + 7, x, z FROM vertices WHERE v % 3 = 1)")
def union_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, and a copy of which a third is moved away: the rest are the first's."""
    first = _mesh(spark, sf_dir).vertices
    away = F.col("v") % 3 == 1
    second = first.select("v", F.when(away, -F.col("y") + 7).otherwise(F.col("x")).alias("x"), F.when(away, F.col("x")).otherwise(F.col("y")).alias("y"), "z")
    points, index = mesh.union_points(first, second, 1e-9)
    shared = index.where("u = v").agg(F.count(F.lit(1)).alias("shared"))
    return points.agg(F.count(F.lit(1)).alias("points"), F.sum(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("size")).crossJoin(shared).select("points", "shared", six("size", 4))  # a row each


@query("SELECT count(*) AS corners, 2 * count(*) - 4 AS faces, 3 * count(*) - 6 AS edges, 0::BIGINT AS open_edges FROM embeddings")
def hull_of_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hull of the vectors' directions in three dimensions: on a sphere every point is a corner, and the surface is closed."""
    points = mesh.sphere(_mesh(spark, sf_dir).vertices)
    faces = hull.triangulated(points).faces
    sides = faces.select(F.explode(F.array(*[F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])).alias("e")).select("e.*")
    back = sides.select(F.col("q").alias("p"), F.col("p").alias("q"))
    counts = sides.agg(F.count_distinct("p").alias("corners"), F.floor(F.count(F.lit(1)) / 2).alias("edges"))
    return counts.crossJoin(faces.agg(F.count(F.lit(1)).alias("faces"))).crossJoin(sides.join(back, ["p", "q"], "left_anti").agg(F.count(F.lit(1)).alias("open_edges"))).select("corners", "faces", "edges", "open_edges")  # a row each


@query(
    """SELECT d.vec_id AS direction, round(max(d.embedding[4]::DOUBLE * p.embedding[1]::DOUBLE + d.embedding[5]::DOUBLE * p.embedding[2]::DOUBLE + d.embedding[6]::DOUBLE * p.embedding[3]::DOUBLE), 7) + 0.0 AS reach
FROM embeddings d, embeddings p GROUP BY d.vec_id"""
)
def hull_reach_of_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the vectors' points go in many directions: as far as the corners of their hull, which parts of them make."""
    x = embedding_rows(spark, sf_dir)
    ends = hull.convex_hull(_mesh(spark, sf_dir).vertices, part=200).vertices
    asked = x.select(F.col("obs").alias("direction"), *[F.col("x")[3 + i].alias("d" + k) for i, k in enumerate("xyz")])
    both = asked.crossJoin(F.broadcast(ends))  # the hull's corners, about the root of the points
    return both.groupBy("direction").agg(F.max(F.col("dx") * F.col("x") + F.col("dy") * F.col("y") + F.col("dz") * F.col("z")).alias("reach")).select("direction", six("reach", 7))


_QUADS = """q AS (SELECT c_custkey AS k, 1 + c_nationkey / 10.0 AS w, 1 + abs(c_acctbal) / 5000.0 AS h, 100.0 * c_custkey AS x0 FROM customer)"""


@query(
    f"""WITH {_QUADS}, d AS (SELECT k, pow(w + 0.5, 2) + h * h AS kept, pow(w - 0.5, 2) + h * h AS other FROM q)
SELECT list_sort(CASE WHEN i = 0 THEN [4 * k, 4 * k + 1, 4 * k + 3] ELSE [4 * k + 1, 4 * k + 2, 4 * k + 3] END)::VARCHAR AS face FROM d, (VALUES (0), (1)) t(i) WHERE other < kept
UNION ALL SELECT list_sort(CASE WHEN i = 0 THEN [4 * k, 4 * k + 1, 4 * k + 2] ELSE [4 * k, 4 * k + 2, 4 * k + 3] END)::VARCHAR FROM d, (VALUES (0), (1)) t(i) WHERE NOT other < kept"""
)
def flipped_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slanted quad for each customer, cut along its long diagonal, then along the short one."""
    from .tables import read

    q = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (1 + F.col("c_nationkey") / 10.0).alias("w"), (1 + F.abs("c_acctbal") / 5000.0).alias("h"), (100.0 * F.col("c_custkey")).alias("x0"))
    corners = ((F.lit(0.0), F.lit(0.0)), (F.col("w"), F.lit(0.0)), (F.col("w") + 0.5, F.col("h")), (F.lit(0.5), F.col("h")))
    vertices = q.select(F.explode(F.array(*[F.struct((4 * F.col("k") + i).alias("v"), (F.col("x0") + x).alias("x"), y.alias("y"), F.lit(0.0).alias("z")) for i, (x, y) in enumerate(corners)])).alias("p")).select("p.*")
    faces = q.select(F.explode(F.array(*[F.struct((2 * F.col("k") + i).alias("f"), (4 * F.col("k")).alias("a"), (4 * F.col("k") + b).alias("b"), (4 * F.col("k") + c).alias("c")) for i, (b, c) in enumerate(((1, 2), (2, 3)))])).alias("p")).select("p.*")
    out = mesh.flipped(mesh.Mesh(vertices, faces)).faces
    return out.select(F.concat(F.lit("["), F.array_join(F.array_sort(F.array("a", "b", "c")).cast("array<string>"), ", "), F.lit("]")).alias("face"))


@query(
    f"""WITH {_QUADS}, d AS (SELECT k, pow(w + 0.5, 2) + h * h AS kept, pow(w - 0.5, 2) + h * h AS other FROM q)
SELECT list_sort(CASE WHEN i = 0 THEN [4 * k, 4 * k + 1, 4 * k + 3] ELSE [4 * k + 1, 4 * k + 2, 4 * k + 3] END)::VARCHAR AS face FROM d, (VALUES (0), (1)) t(i) WHERE other < kept
UNION ALL SELECT list_sort(CASE WHEN i = 0 THEN [4 * k, 4 * k + 1, 4 * k + 2] ELSE [4 * k, 4 * k + 2, 4 * k + 3] END)::VARCHAR FROM d, (VALUES (0), (1)) t(i) WHERE NOT other < kept"""
)
def greedy_flips_of_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slanted quad for each customer, cut along its long diagonal, then along the short one."""
    from .tables import read

    q = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (1 + F.col("c_nationkey") / 10.0).alias("w"), (1 + F.abs("c_acctbal") / 5000.0).alias("h"), (100.0 * F.col("c_custkey")).alias("x0"))
    corners = ((F.lit(0.0), F.lit(0.0)), (F.col("w"), F.lit(0.0)), (F.col("w") + 0.5, F.col("h")), (F.lit(0.5), F.col("h")))
    vertices = q.select(F.explode(F.array(*[F.struct((4 * F.col("k") + i).alias("v"), (F.col("x0") + x).alias("x"), y.alias("y"), F.lit(0.0).alias("z")) for i, (x, y) in enumerate(corners)])).alias("p")).select("p.*")
    faces = q.select(F.explode(F.array(*[F.struct((2 * F.col("k") + i).alias("f"), (4 * F.col("k")).alias("a"), (4 * F.col("k") + b).alias("b"), (4 * F.col("k") + c).alias("c")) for i, (b, c) in enumerate(((1, 2), (2, 3)))])).alias("p")).select("p.*")
    out = mesh.optimized(mesh.Mesh(vertices, faces)).faces
    return out.select(F.concat(F.lit("["), F.array_join(F.array_sort(F.array("a", "b", "c")).cast("array<string>"), ", "), F.lit("]")).alias("face"))


@query(f"WITH {_MESH} SELECT v, round(x - (SELECT avg(x) FROM vertices), 6) + 0.0 AS x, round(y - (SELECT avg(y) FROM vertices), 6) + 0.0 AS y, round(z - (SELECT avg(z) FROM vertices), 6) + 0.0 AS z FROM vertices")
def rotation_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors turned and moved, then turned back yb the rotation that fits best."""
    first = _mesh(spark, sf_dir).vertices
    c, s = np.cos(0.7), np.sin(0.7)
    turned = mesh.rotated(first, np.array([[c, s, 0], [-s, c, 0], [0, 0, 1]]) @ np.array([[1, 0, 0], [0, c, s], [0, -s, c]]), centred=False)
    moved = turned.select("v", F.col("x") + 3.0, F.col("y") - 2.0, F.col("z") + 0.5).toDF("v", "x", "y", "z")
    return mesh.rotated(moved, mesh.rotation(moved, first)).select("v", six("x"), six("y"), six("z"))


@query(f"WITH {_MESH} SELECT 0 AS kind, v AS id, printf('v %.6f %.6f %.6f', x, y, z) AS line FROM vertices UNION ALL SELECT 1, f, printf('f %d %d %d', a + 1, b + 1, c + 1) FROM faces")
def obj_of_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces.obj_lines(_mesh(spark, sf_dir)).select("kind", "id", "line")


#: Radius of the neighborhoods below, in which a vertex has several neighbors and paths of several edges.
_RADIUS = 0.35


@query(
    f"""WITH RECURSIVE {_EDGES}, l AS (SELECT e.v, nbr, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) AS step FROM e JOIN vertices p ON p.v = e.v JOIN vertices q ON q.v = nbr),
r AS (SELECT v AS center, v, 0.0::DOUBLE AS d FROM vertices UNION ALL SELECT center, nbr, d + step FROM r JOIN l ON l.v = r.v WHERE d + step < {_RADIUS})
SELECT center, v, round(min(d), 6) + 0.0 AS d FROM r GROUP BY center, v"""
)
def geodesic_neighborhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vertices within a geodesic radius of every vertex of the mesh of the vectors."""
    edges = mesh.edge_lengths(_mesh(spark, sf_dir))
    return geodesic.neighborhoods(edges, _RADIUS).select("center", "v", six("d"))


@query(
    """WITH t AS (SELECT vec_id AS q, embedding[4]::DOUBLE AS x, embedding[5]::DOUBLE AS y, embedding[6]::DOUBLE AS z FROM embeddings),
p AS (SELECT vec_id AS p, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
d AS (SELECT p, q, sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y) + (p.z - t.z) * (p.z - t.z)) AS d FROM p, t)
SELECT p, rank::INT AS rank, q, round(d, 6) + 0.0 AS d FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY d, q) AS rank FROM d) WHERE rank <= 7"""
)
def knn_of_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven points of dimensions 4 to 6 nearest to each of dimensions 1 to 3."""
    x = embedding_rows(spark, sf_dir)
    at = lambda name, first: x.select(F.col("obs").alias(name), *[F.col("x")[first + i].alias(k) for i, k in enumerate("xyz")])
    return nearest.nearest(at("p", 0), at("q", 3), 7).select("p", "rank", "q", six("d"))


@query(
    """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 0 THEN c_acctbal ELSE c_nationkey / 1000.0 END::DOUBLE AS x, (c_custkey % 4)::DOUBLE AS y, 0.0::DOUBLE AS z FROM customer),
d AS (SELECT a.k AS p, b.k AS q, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM c a, c b)
SELECT p, rank::INT AS rank, q, round(d, 6) + 0.0 AS d FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY d, q) AS rank FROM d) WHERE rank <= 3"""
)
def knn_of_dense_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers crowded at a hundred places that are near to each other against the reach of the others: ties and dense leaves."""
    x = F.when(F.col("c_custkey") % 50 == 0, F.col("c_acctbal")).otherwise(F.col("c_nationkey") / 1000.0)
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("p"), x.alias("x"), (F.col("c_custkey") % 4).cast("double").alias("y"), F.lit(0.0).alias("z"))
    return nearest.nearest(c, c.withColumnRenamed("p", "q"), 3).select("p", "rank", "q", six("d"))


#: Every supplier has an octahedron, of a size of its own: vertices 6 s .. 6 s + 5, faces 8 s .. 8 s + 7.
_OCTAHEDRA = f"""{OCTAHEDRON_SQL.replace("vertices(", "v1(").replace("faces(", "f1(")}, s AS (SELECT s_suppkey AS s, (1 + s_suppkey % 9)::DOUBLE AS r FROM supplier),
vertices AS (SELECT s, r, 6 * s + v AS v, r * x AS x, r * y AS y, r * z AS z, x AS ux, y AS uy, z AS uz FROM s, v1), faces AS (SELECT s, r, 8 * s + f AS f, 6 * s + a AS a, 6 * s + b AS b, 6 * s + c AS c FROM s, f1)"""


def _octahedra(spark: SparkSession, sf_dir: str) -> mesh.Mesh:
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), (1.0 + F.col("s_suppkey") % 9).alias("r"))
    vertices, faces = (F.broadcast(df) for df in octahedron(spark))  # 6 and 8 rows
    v = s.crossJoin(vertices).select((6 * F.col("s") + F.col("v")).alias("v"), *[(F.col("r") * F.col(k)).alias(k) for k in "xyz"])
    return mesh.Mesh(v, s.crossJoin(faces).select((8 * F.col("s") + F.col("f")).alias("f"), *[(6 * F.col("s") + F.col(k)).alias(k) for k in "abc"]))


@query(f"WITH {_OCTAHEDRA} SELECT v, round(4 * sqrt(3) * r * r / 6, 6) + 0.0 AS area FROM vertices")
def mesh_vertex_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.vertex_areas(_octahedra(spark, sf_dir)).select("v", six("area"))


@query(f"WITH {_OCTAHEDRA}, e AS (SELECT DISTINCT unnest([a, a, b, b, c, c]) AS v, unnest([b, c, a, c, a, b]) AS nbr FROM faces) SELECT v, nbr FROM e")
def mesh_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.neighbors(_octahedra(spark, sf_dir).faces)


@query(f"WITH {_OCTAHEDRA} SELECT v, ux + 0.0 AS nx, uy + 0.0 AS ny, uz + 0.0 AS nz FROM vertices")
def mesh_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On an octahedron a vertex's normal is its direction."""
    return mesh.normals(_octahedra(spark, sf_dir), "sine").select("v", six("nx"), six("ny"), six("nz"))


@query("SELECT 66 * count(*) AS vertices, 128 * count(*) AS faces, 192 * count(*) AS edges, 0::BIGINT AS tetrahedra FROM supplier")
def mesh_subdivision(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mesh.subdivided(_octahedra(spark, sf_dir), 4, on_sphere=True)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = count(m.vertices, "vertices").crossJoin(count(m.faces, "faces")).crossJoin(count(mesh.neighbors(m.faces).where("v < nbr"), "edges"))
    return out.crossJoin(count(mesh.tetrahedra(m.faces), "tetrahedra"))  # a row each


@query(f"WITH {_OCTAHEDRA} SELECT s, 6::BIGINT AS owners, round(4 * sqrt(3) * r * r, 5) + 0.0 AS area FROM s")
def geodesic_territories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geodesic territories of each octahedron's vertices, at the usual fineness: each vertex has one, together they are the surface."""
    areas = geodesic.geodesic_areas(_octahedra(spark, sf_dir))
    return areas.groupBy(F.floor(F.col("v") / 6).alias("s")).agg(F.count_if(F.col("area") > 0).alias("owners"), F.sum("area").alias("area")).select("s", "owners", six("area", 5))


@query("SELECT 6::BIGINT AS sources, round(4 * sqrt(3), 5) + 0.0 AS area, true AS each_point_at_most FROM (SELECT count(*) FROM embeddings)")
def overlap_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas that an octahedron's territories share with those of the vectors' directions on it add up to the surface."""
    m = mesh.Mesh(*octahedron(spark))
    points = mesh.sphere(_mesh(spark, sf_dir).vertices).select(F.col("v").alias("p"), "x", "y", "z")
    shared = geodesic.overlap_transform(m, m, points, n_div=4, t_div=16)
    return shared.agg(F.count_distinct("src").alias("sources"), F.sum("w").alias("area"), (F.count_distinct("dst") <= points.count()).alias("each_point_at_most")).select("sources", six("area", 5), "each_point_at_most")
