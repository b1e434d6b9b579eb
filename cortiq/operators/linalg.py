"""Decompositions of tall tables, Gram matrices, and least squares over resampled rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import factor
from .moments import moments


def svd(rows: DataFrame, remove_mean: bool = True) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(rows with `u`, singular values, right vectors) of rows(obs, x) with up to factor.SMALL columns, from a tree of QR factors.

    factor.svd_wide takes any number of columns of as many rows, factor.range_finder the leading components of tables large both ways.
    """
    return factor.svd_tall(rows, remove_mean)


def pca(rows: DataFrame) -> DataFrame:
    """rows with `score`: centred and projected on the components, largest first."""
    mean = factor.column_means(rows)
    r = factor.tall_r(rows, mean)
    v = factor.signed(np.linalg.svd(r, full_matrices=True)[2].T) if r.size else np.zeros((len(mean), 0))
    return factor.times(rows, v, mean, name="score")


def polar(a: np.ndarray, side: str = "left") -> tuple[np.ndarray, np.ndarray]:
    """(u, p) of a small matrix: a = p u for the left side, u p for the right; u has orthonormal rows or columns."""
    w, s, vt = np.linalg.svd(a, full_matrices=False)
    u = w @ vt
    if side == "left":
        return u, (w * s) @ w.T
    if side == "right":
        return u, (vt.T * s) @ vt
    raise ValueError("side is left or right")


def blocked(rows: DataFrame, key: str, size: int) -> tuple[DataFrame, int]:
    """rows with `block`, by a hash of the key, and the number of blocks, of about `size` rows each."""
    n = max(1, -(-rows.count() // size))
    return rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n


def gram(rows: DataFrame, chunks: int | None = None, remove_mean: bool = True, block: int = 1024) -> DataFrame:
    """(i, j, value) for i <= j[, chunk]: inner products of rows(obs, x array of one length), by column; chunks of columns are summed apart.

    Rows meet in pairs of blocks, each of which is one product of two matrices in a task.
    """
    width = rows.select(F.max(F.size("x"))).first()[0] or 0
    base, more = divmod(width, chunks or 1)  # the first n mod chunks chunks have one column more
    edges = np.cumsum([0] + [base + (k < more) for k in range(chunks or 1)])
    centred = factor.less(rows, factor.column_means(rows)) if remove_mean and width else rows.select("obs", "x")
    cut, n = blocked(centred.select("obs", F.col("x").alias("z")), "obs", block)
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = dealt.select("obs", "z", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))

    def products(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("obs", ignore_index=True)
        left, right = (pdf[pdf["block"] == b] for b in key)
        out = []
        x, y = (np.stack(side["z"].to_numpy()) if len(side) else np.zeros((0, width)) for side in (left, right))
        a, b = np.meshgrid(left["obs"].to_numpy(), right["obs"].to_numpy(), indexing="ij")
        keep = a <= b if key[0] == key[1] else np.ones(a.shape, bool)
        for k in range(len(edges) - 1):
            part = x[:, edges[k] : edges[k + 1]] @ y[:, edges[k] : edges[k + 1]].T
            out.append(pd.DataFrame({"chunk": np.full(int(keep.sum()), k, np.int32), "i": np.minimum(a, b)[keep], "j": np.maximum(a, b)[keep], "value": part[keep]}))
        return pd.concat(out)

    kind = dict(rows.dtypes)["obs"]
    found = dealt.groupBy("bi", "bj").applyInPandas(products, f"chunk int, i {kind}, j {kind}, value double")
    return found if chunks else found.drop("chunk")


def gram_matrix(g: DataFrame) -> np.ndarray:
    """The symmetric matrix of (i, j, value) on the driver, ordered by index: for the few hundred rows that kernels take."""
    found = g.groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas()
    ids = np.unique(np.concatenate([found["i"], found["j"]]))
    a, b = np.searchsorted(ids, found["i"]), np.searchsorted(ids, found["j"])
    out = np.zeros((len(ids), len(ids)))
    out[a, b] = out[b, a] = found["value"]
    return out


def gram_pca(g: np.ndarray, tol: float = 1e-7, return_us: bool = False):
    """Scores of all but the last component, largest first, from a Gram matrix of centred rows."""
    value, vector = np.linalg.eigh(g)
    if value.min() <= -tol:
        raise ValueError("not a Gram matrix: it has a negative eigenvalue")
    s = np.sqrt(np.maximum(value[:0:-1], 0))
    u = vector[:, :0:-1]
    return (u, s) if return_us else u * s


def weights_of_rows(beta: np.ndarray, g: np.ndarray, tol: float = 1e-7) -> np.ndarray:
    """The weight of each row in a model that is linear in the first components' scores."""
    u, s = gram_pca(g, tol, return_us=True)
    k = len(beta)
    return u[:, :k] @ (beta / s[:k])


def feature_weights(spark: SparkSession, rows: DataFrame, weights: np.ndarray, ids: np.ndarray) -> DataFrame:
    """(col, beta): the weights of features from those of rows (centred by columns), by a join and a sum."""
    table = spark.createDataFrame([(int(i), float(w)) for i, w in zip(ids, weights, strict=True)], "obs long, w double")
    cells = rows.join(table, "obs").select("w", F.posexplode("x").alias("col", "x"))
    return cells.groupBy("col").agg((F.sum(F.col("x") * F.col("w")) - F.avg("x") * F.sum("w")).alias("beta"), F.avg("x").alias("mean"))


def weighted(spark: SparkSession, rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with `counts`: how often each split's training set has the row."""
    drawn = plan.where("role = 'train'").groupBy("obs").agg(F.map_from_entries(F.collect_list(F.struct("split", "multiplicity"))).alias("counts"))
    return rows.join(drawn, "obs")


def ensemble_lstsq(spark: SparkSession, rows: DataFrame, plan: DataFrame, p: int, q: int) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Least squares of rows(obs, x, y arrays of p and q) on every split: (mean weights, predictions, metrics).

    predictions(obs, target, y, yhat) average the splits in which an observation was left out; metrics(target, r2, r) compare
    with the mean of the others.
    """
    w = p + q
    z = weighted(spark, rows, plan).select(F.concat("x", "y").alias("z"), "counts")
    fits = {}
    for row in moments(z, w, "counts").collect():  # splits x (p + q)^2 numbers
        m = np.array(row["m"]).reshape(w, w)
        fits[row["split"]] = np.linalg.pinv(m[:p, :p], hermitian=True) @ m[:p, p:]
    betas = spark.createDataFrame([(int(s), k, [float(v) for v in b[:, k]]) for s, b in fits.items() for k in range(q)], "split int, target int, beta array<double>")
    out = plan.where("role = 'test'").select("split", "obs").join(betas, "split")
    dot = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda t, e: t + e)
    found = rows.join(out, "obs").select("obs", "target", F.get("y", F.col("target")).alias("y"), dot.alias("yhat"))
    predictions = found.groupBy("obs", "target").agg(F.first("y").alias("y"), F.avg("yhat").alias("yhat"))
    return np.mean(list(fits.values()), axis=0), predictions, scored(predictions)


def scored(predictions: DataFrame, by: tuple[str, ...] = ("target",)) -> DataFrame:
    """(by, r2, r) of (by, y, yhat); the baseline of r2 is the mean of the other observations."""
    total = predictions.groupBy(*by).agg(F.sum("y").alias("sy"), F.count(F.lit(1)).alias("n"))
    y, h = F.col("y"), F.col("yhat")
    both = predictions.join(total, list(by))
    others = F.try_divide(F.col("sy") - y, F.col("n") - 1)
    moving = F.stddev_pop(y) * F.stddev_pop(h)
    r2 = 1.0 - F.try_divide(F.sum((y - h) * (y - h)), F.sum((y - others) * (y - others)))
    return both.groupBy(*by).agg(r2.alias("r2"), F.try_divide(F.covar_pop(y, h), moving).alias("r"))
