"""Queries over linear models with given plans, decompositions and quantiles, and the SQL that checks them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dual, factor, linalg, ridge
from .registry import _ALPHA, SQL, query, six
from .tables import embedding_rows, read

# Quantiles: SQL has none, so it refines an approximation by the distribution itself, or halves an interval.

#: Phi(z) by its series, for a list comprehension over the terms; z must be a column.
_PHI = "0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 80), lambda k: list_reduce(list_prepend(z, list_transform(range(1, k + 1), lambda i: z * z / (2 * i + 1))), lambda a, b: a * b)))"


def _halley(k: int) -> str:
    return f"""e{k} AS (SELECT key, p, z, ({_PHI}) - p AS e FROM z{k}),
z{k + 1} AS (SELECT key, p, z - e * sqrt(2 * pi()) * exp(z * z / 2) / (1 + z * e * sqrt(2 * pi()) * exp(z * z / 2) / 2) AS z FROM e{k})"""


SQL["inverse_normal"] = f"""WITH r AS (SELECT p_partkey AS key, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS r, count(*) OVER () AS n FROM part),
p AS (SELECT key, greatest(0.0005, least(0.9995, (r - 0.5) / n))::DOUBLE AS p FROM r),
z0 AS (SELECT key, p, 5.05 * (pow(p, 0.135) - pow(1 - p, 0.135)) AS z FROM p), {_halley(0)}, {_halley(1)}, {_halley(2)}
SELECT key AS p_partkey, round(m + s * z, 6) + 0.0 AS z FROM z3, (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s FROM part)"""

#: In SQL the quantiles are found by halving, with the finite sum of the beta distribution for whole b.
SQL["cronbach_alpha_interval"] = (
    _ALPHA.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, asked AS (SELECT v, alpha, q, (m - 1) / 2.0 AS a, ((n - 1) * (m - 1) / 2)::INT AS b FROM alpha, (VALUES (0.025), (0.975)) t(q)),
halved AS (SELECT v, alpha, q, a, b, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, 0 AS k FROM asked UNION ALL
  SELECT v, alpha, q, a, b, CASE WHEN cdf < q THEN mid ELSE low END, CASE WHEN cdf < q THEN high ELSE mid END, k + 1 FROM (SELECT *, pow(mid, a) * list_sum(list_transform(range(0, b),
    lambda i: CASE WHEN i = 0 THEN 1.0 ELSE exp(list_sum(list_transform(range(0, i), lambda j: ln((a + j) / (j + 1) * (1 - mid))))) END)) AS cdf FROM (SELECT *, (low + high) / 2 AS mid FROM halved WHERE k < 60))),
f AS (SELECT v, alpha, q, b * ((low + high) / 2) / (a * (1 - (low + high) / 2)) AS f FROM halved WHERE k = 60)
SELECT v, round(max(alpha), 6) + 0.0 AS alpha, round(1 - (1 - max(alpha)) * max(CASE WHEN q > 0.5 THEN f END), 6) + 0.0 AS lower, round(1 - (1 - max(alpha)) * max(CASE WHEN q < 0.5 THEN f END), 6) + 0.0 AS upper FROM f GROUP BY v"""
)


# Models on a plan that both sides know: split s withholds the labels s and s + 5.

_SPLITS = 5
_XY = "e AS (SELECT vec_id AS obs, label, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2, embedding[3]::DOUBLE AS y, embedding[4]::DOUBLE AS y2 FROM embeddings)"
_ALPHAS = (0.5, 5.0)


def _given(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame]]:
    """Rows of two features and a target, (grp, obs) and the plan with what it withholds."""
    e = embedding_rows(spark, sf_dir)
    member = e.select(F.col("label").cast("long").alias("grp"), "obs")
    splits = spark.range(_SPLITS).select(F.col("id").cast("int").alias("split"))
    plan = member.crossJoin(F.broadcast(splits)).select("split", "obs", F.when(F.col("grp") % _SPLITS == F.col("split"), "test").otherwise("train").alias("role"), F.lit(1).alias("multiplicity"))  # a row for each split
    withheld = member.select("grp").distinct().select((F.col("grp") % _SPLITS).cast("int").alias("split"), "grp")
    return e.select("obs", F.slice("x", 1, 2).alias("x"), F.col("x")[2].alias("y")), member, (plan, withheld)


#: Ridge on one or both components of two centred features: the eigenvalues of a symmetric 2 x 2 matrix in closed form.
_RIDGE = f"""{_XY}, s AS (SELECT k AS split, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, count(*) * var_pop(x1) AS a, count(*) * covar_pop(x1, x2) AS b, count(*) * var_pop(x2) AS c, count(*) * covar_pop(x1, y) AS u, count(*) * covar_pop(x2, y) AS w
  FROM e, (SELECT unnest(range(0, {_SPLITS})) AS k) WHERE label % {_SPLITS} <> k GROUP BY k),
g AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l1, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS l2 FROM s),
v AS (SELECT *, b / sqrt(b * b + pow(l1 - a, 2)) AS p1, (l1 - a) / sqrt(b * b + pow(l1 - a, 2)) AS p2 FROM g),
w AS (SELECT split, m1, m2, my, alpha, npc, p1 * (p1 * u + p2 * w) / (l1 + al) + CASE WHEN npc = 1 THEN -p2 * (-p2 * u + p1 * w) / (l2 + al) ELSE 0 END AS b1,
  p2 * (p1 * u + p2 * w) / (l1 + al) + CASE WHEN npc = 1 THEN p1 * (-p2 * u + p1 * w) / (l2 + al) ELSE 0 END AS b2 FROM v, (VALUES {", ".join(f"({i}, {a}::DOUBLE)" for i, a in enumerate(_ALPHAS))}) t(alpha, al), (VALUES (0), (1)) n(npc)),
pred AS (SELECT e.obs, e.label AS grp, w.split, alpha, npc, y, my + b1 * (x1 - m1) + b2 * (x2 - m2) AS pred FROM e JOIN w ON e.label % {_SPLITS} = w.split)"""


@query(f"WITH {_RIDGE} SELECT obs, alpha, npc, round(pred, 6) + 0.0 AS yhat FROM pred")
def ridge_cv_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, member, plan = _given(spark, sf_dir)
    return ridge.ridge_cv(spark, rows, member, 2, list(_ALPHAS), [1, None], given=plan)[0].select("obs", "alpha", "npc", six("yhat"))


_NESTED = f"""{_RIDGE}, mine AS (SELECT DISTINCT grp AS g, split FROM pred), sse AS (SELECT g, alpha, npc, sum(pow(y - pred, 2)) AS sse FROM pred JOIN mine USING (split) WHERE g <> grp GROUP BY ALL),
chosen AS (SELECT g AS grp, alpha, npc FROM sse QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(sse, 9), alpha, npc) = 1)"""


@query(f"WITH {_NESTED} SELECT obs, round(pred, 6) + 0.0 AS yhat FROM pred JOIN chosen USING (grp, alpha, npc)")
def ridge_nested_cv_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, member, plan = _given(spark, sf_dir)
    return ridge.ridge_nested_cv(spark, rows, member, 2, list(_ALPHAS), [1, None], given=plan)[0].select("obs", six("yhat"))


@query(
    f"""WITH {_NESTED}, best AS (SELECT -1 AS grp, alpha, npc FROM (SELECT alpha, npc, sum(pow(y - pred, 2)) AS sse FROM pred GROUP BY ALL) QUALIFY row_number() OVER (ORDER BY round(sse, 9), alpha, npc) = 1)
SELECT grp::BIGINT AS grp, alpha, npc FROM chosen UNION ALL SELECT grp, alpha, npc FROM best"""
)
def ridge_choices_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameters chosen for each group, and (-1) for all."""
    rows, member, plan = _given(spark, sf_dir)
    return ridge.ridge_nested_cv(spark, rows, member, 2, list(_ALPHAS), [1, None], given=plan)[2].select(F.col("grp").cast("long").alias("grp"), "alpha", "npc")


@query(
    f"""WITH {_RIDGE.replace("WHERE label % 5 <> k GROUP BY k", "GROUP BY k")} SELECT alpha, npc, round(b1, 6) + 0.0 AS b1, round(b2, 6) + 0.0 AS b2, round(my - b1 * m1 - b2 * m2, 6) + 0.0 AS intercept FROM w WHERE split = 0"""
)
def ridge_grid_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    beta = ridge.ridge_grid(_given(spark, sf_dir)[0], 2, list(_ALPHAS), [1, None])
    rows = [(a, k, *map(float, beta[:, a, k])) for a in range(2) for k in range(2)]
    return spark.createDataFrame(rows, "alpha int, npc int, b1 double, b2 double, intercept double").select("alpha", "npc", six("b1"), six("b2"), six("intercept"))


@query(
    f"""WITH {_XY}, t AS (SELECT obs, label, x1, x2, 0 AS target, y FROM e UNION ALL SELECT obs, label, x1, x2, 1, y2 FROM e),
s AS (SELECT k AS split, target, sum(x1 * x1) AS a, sum(x1 * x2) AS b, sum(x2 * x2) AS c, sum(x1 * y) AS u, sum(x2 * y) AS w FROM t, (SELECT unnest(range(0, {_SPLITS})) AS k) WHERE label % {_SPLITS} <> k GROUP BY ALL),
p AS (SELECT t.target, t.y, ((c * u - b * w) * x1 + (a * w - b * u) * x2) / (a * c - b * b) AS h FROM t JOIN s ON t.label % {_SPLITS} = s.split AND t.target = s.target),
o AS (SELECT *, (sum(y) OVER g - y) / (count(*) OVER g - 1) AS rest FROM p WINDOW g AS (PARTITION BY target))
SELECT target, round(1 - sum(pow(y - h, 2)) / sum(pow(y - rest, 2)), 6) + 0.0 AS r2, round(corr(y, h), 6) + 0.0 AS r FROM o GROUP BY target"""
)
def ensemble_lstsq_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _given(spark, sf_dir)[2][0]
    rows = embedding_rows(spark, sf_dir).select("obs", F.slice("x", 1, 2).alias("x"), F.slice("x", 3, 2).alias("y"))
    return linalg.ensemble_lstsq(spark, rows, plan, 2, 2)[2].select("target", six("r2"), six("r"))


# Decompositions

_TWO = f"""{_XY}, m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, count(*) * var_pop(x1) AS a, count(*) * covar_pop(x1, x2) AS b, count(*) * var_pop(x2) AS c FROM e),
l AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l1, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS l2 FROM m),
v AS (SELECT *, b / sqrt(b * b + pow(l1 - a, 2)) AS q1, (l1 - a) / sqrt(b * b + pow(l1 - a, 2)) AS q2 FROM l),
d AS (SELECT *, CASE WHEN CASE WHEN abs(q1) >= abs(q2) THEN q1 ELSE q2 END < 0 THEN -1 ELSE 1 END AS s1, CASE WHEN CASE WHEN abs(q2) >= abs(q1) THEN -q2 ELSE q1 END < 0 THEN -1 ELSE 1 END AS s2 FROM v)"""


@query(f"WITH {_TWO} SELECT obs, round(s1 * ((x1 - m1) * q1 + (x2 - m2) * q2) / sqrt(l1), 6) + 0.0 AS u1, round(s2 * ((x1 - m1) * -q2 + (x2 - m2) * q1) / sqrt(l2), 6) + 0.0 AS u2, round(sqrt(l1), 6) + 0.0 AS largest FROM e, d")
def svd_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedding_rows(spark, sf_dir).select("obs", F.slice("x", 1, 2).alias("x"))
    u, s, _ = linalg.svd(rows)
    return u.select("obs", F.col("u")[0].alias("u1"), F.col("u")[1].alias("u2"), F.lit(float(s[0])).alias("largest")).select("obs", six("u1"), six("u2"), six("largest"))


@query(f"WITH {_TWO} SELECT obs, round(s1 * ((x1 - m1) * q1 + (x2 - m2) * q2), 6) + 0.0 AS p1, round(s2 * ((x1 - m1) * -q2 + (x2 - m2) * q1), 6) + 0.0 AS p2 FROM e, d")
def pca_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedding_rows(spark, sf_dir).select("obs", F.slice("x", 1, 2).alias("x"))
    return linalg.pca(rows).select("obs", F.col("score")[0].alias("p1"), F.col("score")[1].alias("p2")).select("obs", six("p1"), six("p2"))


@query(
    """WITH m AS (SELECT l_returnflag AS name, avg(l_quantity) - 20 AS a, avg(l_discount * l_quantity) AS b, -avg(l_tax * 30) AS c, avg(l_linenumber) AS d FROM lineitem GROUP BY ALL),
s AS (SELECT *, CASE WHEN a * d - b * c < 0 THEN -1 ELSE 1 END AS g FROM m), n AS (SELECT *, sqrt(pow(a + g * d, 2) + pow(b - g * c, 2)) AS n FROM s),
u AS (SELECT *, (a + g * d) / n AS u11, (b - g * c) / n AS u12, (c - g * b) / n AS u21, (d + g * a) / n AS u22 FROM n)
SELECT name, round(u11, 6) + 0.0 AS u11, round(u12, 6) + 0.0 AS u12, round(u21, 6) + 0.0 AS u21, round(a * u11 + b * u12, 6) + 0.0 AS p11, round(a * u21 + b * u22, 6) + 0.0 AS p12, round(u11 * a + u21 * c, 6) + 0.0 AS q11 FROM u"""
)
def polar_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both polar decompositions of a 2 x 2 matrix of each flag: u, the left side p and the right side q."""
    m = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg((F.avg("l_quantity") - 20).alias("a"), F.avg(F.col("l_discount") * F.col("l_quantity")).alias("b"), (-F.avg(F.col("l_tax") * 30)).alias("c"), F.avg("l_linenumber").alias("d"))
    out = []
    for r in m.collect():  # a row for each flag
        a = np.array([[r["a"], r["b"]], [r["c"], r["d"]]])
        (u, p), (_, q) = linalg.polar(a, "left"), linalg.polar(a, "right")
        out.append((r["l_returnflag"], *map(float, (u[0, 0], u[0, 1], u[1, 0], p[0, 0], p[0, 1], q[0, 0]))))
    return spark.createDataFrame(out, "name string, u11 double, u12 double, u21 double, p11 double, p12 double, q11 double").select("name", *[six(k) for k in ("u11", "u12", "u21", "p11", "p12", "q11")])


_CENTRED = "m AS (SELECT label, unnest(range(len(embedding))) AS col, unnest(embedding)::DOUBLE AS x FROM embeddings), a AS (SELECT label, col, avg(x) AS x FROM m GROUP BY ALL), c AS (SELECT label, col, x - avg(x) OVER (PARTITION BY col) AS x FROM a)"


def _label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = embedding_rows(spark, sf_dir).select("label", F.posexplode("x").alias("col", "x")).groupBy("label", "col").agg(F.avg("x").alias("x"))
    return cells.groupBy(F.col("label").alias("obs")).agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "x"))), lambda e: e["x"]).alias("x"))


@query(f"WITH {_CENTRED} SELECT a.label::BIGINT AS i, b.label::BIGINT AS j, round(sum(a.x * b.x), 6) + 0.0 AS value FROM c a JOIN c b ON a.col = b.col AND a.label <= b.label GROUP BY ALL")
def gram_pca_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of the scores that a Gram matrix gives, which are the matrix again."""
    rows = _label_means(spark, sf_dir)
    gram, _ = dual.centred_gram(spark, rows, True)
    value, u = dual.leading(gram, len(gram.obs) - 1)
    table = spark.createDataFrame([(int(i), [float(v) for v in s]) for i, s in zip(gram.obs, u * np.sqrt(value), strict=True)], "obs long, x array<double>")
    return linalg.gram(table, remove_mean=False).select("i", "j", six("value"))


@query(f"WITH {_CENTRED}, g AS (SELECT a.label AS i, b.label AS j, sum(a.x * b.x) AS g FROM c a JOIN c b ON a.col = b.col GROUP BY ALL) SELECT i::BIGINT AS obs, round(sum(g * (1 + j % 4)), 5) + 0.0 AS pred FROM g GROUP BY i")
def weights_of_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of components, as weights of rows, then of features; its predictions are the Gram matrix times the targets."""
    rows = _label_means(spark, sf_dir)
    gram, _ = dual.centred_gram(spark, rows, True)
    value, u = dual.leading(gram, len(gram.obs) - 1)
    beta = (u * np.sqrt(value)).T @ (1.0 + gram.obs % 4)
    features = linalg.feature_weights(spark, rows, dual.row_weights(gram, beta), gram.obs)
    cells = rows.select("obs", F.posexplode("x").alias("col", "x")).join(features, "col")
    return cells.groupBy(F.col("obs").cast("long").alias("obs")).agg(F.sum((F.col("x") - F.col("mean")) * F.col("beta")).alias("pred")).select("obs", six("pred", 5))


_DUAL = f"""{_RIDGE}, asked AS (SELECT obs, alpha, npc, round(pred, 5) + 0.0 AS yhat FROM pred)"""


@query(f"WITH {_DUAL} SELECT * FROM asked")
def ridge_cv_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models of ridge_cv_given through the rows' Gram matrix."""
    rows, member, plan = _given(spark, sf_dir)
    return ridge.ridge_cv(spark, rows, member, 2, list(_ALPHAS), [1, None], given=plan, dual_form=True)[0].select("obs", "alpha", "npc", six("yhat", 5))


@query(f"WITH {_NESTED} SELECT obs, round(pred, 5) + 0.0 AS yhat FROM pred JOIN chosen USING (grp, alpha, npc)")
def ridge_nested_cv_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, member, plan = _given(spark, sf_dir)
    return ridge.ridge_nested_cv(spark, rows, member, 2, list(_ALPHAS), [1, None], given=plan, dual_form=True)[0].select("obs", six("yhat", 5))


#: Draws of a bootstrap that both sides know: a row outside the withheld labels is drawn (7 obs + 3 split) mod 4 times.
_BOOT = f"""{_XY}, d AS (SELECT e.*, k AS split, ((obs * 7 + k * 3) % 4)::INT AS w FROM e, (SELECT unnest(range(0, {_SPLITS})) AS k) WHERE label % {_SPLITS} <> k),
m AS (SELECT split, sum(w) AS n, sum(w * x1) / sum(w) AS m1, sum(w * x2) / sum(w) AS m2, sum(w * y) / sum(w) AS my FROM d GROUP BY split),
s AS (SELECT split, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my, sum(w * (x1 - m1) * (x1 - m1)) AS a, sum(w * (x1 - m1) * (x2 - m2)) AS b, sum(w * (x2 - m2) * (x2 - m2)) AS c,
  sum(w * (x1 - m1) * (y - my)) AS u, sum(w * (x2 - m2) * (y - my)) AS v FROM d JOIN m USING (split) GROUP BY split),
b AS (SELECT split, m1, m2, my, alpha, ((c + al) * u - b * v) / ((a + al) * (c + al) - b * b) AS b1, ((a + al) * v - b * u) / ((a + al) * (c + al) - b * b) AS b2
  FROM s, (VALUES {", ".join(f"({i}, {a}::DOUBLE)" for i, a in enumerate(_ALPHAS))}) t(alpha, al))
SELECT obs, alpha, 0 AS npc, round(my + b1 * (x1 - m1) + b2 * (x2 - m2), 6) + 0.0 AS yhat FROM e JOIN b ON e.label % {_SPLITS} = b.split"""


def _bootstrapped(spark: SparkSession, sf_dir: str):
    rows, member, (plan, withheld) = _given(spark, sf_dir)
    times = ((F.col("obs") * 7 + F.col("split") * 3) % 4).cast("int")
    plan = plan.where("role = 'test'").unionByName(plan.where("role = 'train'").withColumn("multiplicity", times).where("multiplicity > 0"))
    return rows, member, (plan, withheld)


@query(f"WITH {_BOOT}")
def ridge_cv_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given plan in which rows are drawn none to three times."""
    rows, member, plan = _bootstrapped(spark, sf_dir)
    return ridge.ridge_cv(spark, rows, member, 2, list(_ALPHAS), [None], given=plan)[0].select("obs", "alpha", "npc", six("yhat"))


@query(f"WITH {_BOOT}")
def ridge_cv_bootstrap_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, member, plan = _bootstrapped(spark, sf_dir)
    return ridge.ridge_cv(spark, rows, member, 2, list(_ALPHAS), [None], given=plan, dual_form=True)[0].select("obs", "alpha", "npc", six("yhat"))


_ENERGY = """c AS (SELECT vec_id AS obs, k, embedding[k]::DOUBLE - avg(embedding[k]::DOUBLE) OVER (PARTITION BY k) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS k))"""


@query(f"WITH {_ENERGY} SELECT obs, round(sum(x * x), 6) + 0.0 AS energy, round(max(CASE WHEN k = 1 THEN x END), 6) + 0.0 AS first, round(max(CASE WHEN k = 64 THEN x END), 6) + 0.0 AS last FROM c GROUP BY obs")
def svd_at_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 64 columns: rows put together again from left vectors, singular values and right vectors."""
    u, s, v = linalg.svd(embedding_rows(spark, sf_dir).select("obs", "x"))
    again = factor.times(u, (v * s).T, x="u", name="again")
    energy = F.aggregate("again", F.lit(0.0), lambda t, e: t + e * e)
    return again.select("obs", energy.alias("energy"), F.col("again")[0].alias("first"), F.col("again")[63].alias("last")).select("obs", six("energy"), six("first"), six("last"))


@query(
    """WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings), least AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM embeddings GROUP BY label)),
x AS (SELECT r.label AS obs, r.n * 64 + k AS col, e.embedding[k]::DOUBLE AS x FROM r JOIN embeddings e USING (vec_id), least, (SELECT unnest(range(1, 65)) AS k) WHERE r.n <= least.c),
d AS (SELECT obs, col, x - avg(x) OVER (PARTITION BY col) AS x FROM x)
SELECT a.obs::BIGINT AS i, b.obs::BIGINT AS j, round(sum(a.x * b.x), 6) + 0.0 AS value FROM d a JOIN d b ON a.col = b.col AND a.obs <= b.obs GROUP BY ALL"""
)
def svd_wide_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each label, of all its vectors one after the other (as many as the rarest label has): more columns than rows.

    Left vectors times squared singular values are the rows' products.
    """
    e = embedding_rows(spark, sf_dir)
    least = e.groupBy("label").count().agg(F.min("count")).first()[0]
    lists = e.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("obs", "x"))).alias("e"))  # a label's vectors are one row here, by definition
    rows = lists.select(F.col("label").cast("long").alias("obs"), F.flatten(F.transform(F.slice("e", 1, least), lambda r: r["x"])).alias("x"))
    found = factor.svd_wide(rows)
    again = spark.createDataFrame([(int(i), [float(v) for v in u * found.s]) for i, u in zip(found.obs, found.u, strict=True)], "obs long, x array<double>")
    return linalg.gram(again, remove_mean=False).select("i", "j", six("value"))
