"""Decompositions of tall, wide and large tables, and dual ridge, against numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from cortiq.operators import dual, factor, linalg, ridge


def frame(spark, x, y=None, obs=None):
    columns = {"obs": np.arange(len(x)) if obs is None else obs, "x": pa.FixedSizeListArray.from_arrays(x.ravel(), x.shape[1]).cast(pa.list_(pa.float64()))}
    return spark.createDataFrame(pa.table(columns | ({} if y is None else {"y": y})))


def arrays(df, order, name):
    return np.array(df.orderBy(order).toPandas()[name].tolist())


def test_tall_keeps_the_condition_number(spark):
    """64 columns with singular values down to 1e-8 of the first, from more partitions than one merge takes."""
    rng = np.random.default_rng(21)
    s = np.logspace(2, -6, 64)
    x = np.linalg.qr(rng.normal(size=(700, 64)))[0] * s @ np.linalg.qr(rng.normal(size=(64, 64)))[0].T
    u, got, v = factor.svd_tall(frame(spark, x).repartition(70), remove_mean=False)
    np.testing.assert_allclose(got, s, rtol=1e-6)
    squared = np.sqrt(np.maximum(np.linalg.eigvalsh(x.T @ x)[0], 0))
    assert abs(got[-1] / s[-1] - 1) < 0.01 * abs(squared / s[-1] - 1)  # what squaring the table loses
    left = arrays(u, "obs", "u")
    np.testing.assert_allclose(left.T @ left, np.eye(64), atol=1e-5)
    np.testing.assert_allclose((left * got) @ v.T, x, atol=1e-10)


def test_tall_with_few_and_no_rows(spark):
    x = np.random.default_rng(22).normal(size=(3, 5))
    u, s, v = factor.svd_tall(frame(spark, x).repartition(6))
    np.testing.assert_allclose((arrays(u, "obs", "u") * s) @ v.T, x - x.mean(axis=0), atol=1e-12)
    u, s, v = factor.svd_tall(frame(spark, x).limit(0))
    assert u.count() == 0 and not len(s)
    scores = linalg.pca(frame(spark, x).withColumnRenamed("x", "x"))
    assert arrays(scores, "obs", "score").shape == (3, 5)


def test_wide(spark):
    """300 rows of 20,000 columns; no matrix of columns x columns exists anywhere."""
    rng = np.random.default_rng(23)
    x = rng.normal(1, 1, (300, 20_000)) + np.outer(rng.normal(size=300), rng.normal(size=20_000))
    found = factor.svd_wide(frame(spark, x, obs=np.arange(300) * 7 + 3))
    want = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    np.testing.assert_allclose(found.s, want[1], rtol=1e-9, atol=1e-8)
    assert found.obs.tolist() == (np.arange(300) * 7 + 3).tolist()
    right = arrays(found.right.where("col < 1000"), "col", "v")
    np.testing.assert_allclose((found.u * found.s) @ right.T, (x - x.mean(axis=0))[:, :1000], atol=1e-8)
    with pytest.raises(ValueError):
        factor.svd_wide(frame(spark, np.ones((factor.SMALL + 1, 1))))


def test_range_finder(spark):
    """The leading components of a table that is large both ways."""
    rng = np.random.default_rng(24)
    x = (rng.normal(size=(900, 9)) * np.logspace(1, 0, 9)) @ rng.normal(size=(9, 1100)) + 0.02 * rng.normal(size=(900, 1100)) + 5
    left, s, right = factor.range_finder(frame(spark, x), 5, rounds=2, block=200)
    u, want, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    np.testing.assert_allclose(s, want[:5], rtol=1e-8)
    again = (arrays(left, "obs", "u") * s) @ arrays(right, "col", "v").T
    np.testing.assert_allclose(again, (u[:, :5] * want[:5]) @ vt[:5], atol=1e-6)


def test_gram_blocks_and_leading(spark):
    rng = np.random.default_rng(25)
    x = rng.normal(size=(90, 50)) * np.linspace(3, 0.1, 50)
    rows = frame(spark, x, obs=rng.permutation(1000)[:90])
    gram = dual.gram_blocks(spark, rows)
    order = np.argsort(rows.toPandas()["obs"].to_numpy())
    k = (x @ x.T)[np.ix_(order, order)]
    v = rng.normal(size=(90, 3))
    np.testing.assert_allclose(gram.times(v), k @ v, atol=1e-9)
    value, u = dual.leading(gram, 6)
    want = np.linalg.eigvalsh(k)[::-1]
    np.testing.assert_allclose(value, want[:6], rtol=1e-8)
    np.testing.assert_allclose(k @ u, u * value, atol=1e-5)
    value, u = dual.leading(gram, 90)
    np.testing.assert_allclose(value[:50], want[:50], rtol=1e-6, atol=1e-9)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(dual, "BLOCK_NUMBERS", 1)
    x = np.random.default_rng(26).normal(size=(83, 4))
    gram = dual.gram_blocks(spark, frame(spark, x))
    assert gram.blocks.count() == 21 and gram.size == 16
    np.testing.assert_allclose(gram.times(np.eye(83)), x @ x.T, atol=1e-12)


def test_products_of_many_rows_need_no_blocks(spark, monkeypatch):
    """More rows than twice the features: nothing of rows x rows is made."""
    rng = np.random.default_rng(28)
    x = rng.normal(3, 1, size=(400, 5))
    monkeypatch.setattr(dual, "gram_blocks", None)
    gram, mean = dual.centred_gram(spark, frame(spark, x, obs=rng.permutation(2000)[:400]), True)
    c = gram.rows.orderBy("row").toPandas()
    c = np.stack(c["x"].to_numpy())
    np.testing.assert_allclose(mean, x.mean(axis=0))
    v = rng.normal(size=(400, 3))
    np.testing.assert_allclose(gram.times(v), c @ (c.T @ v), atol=1e-9)
    value, u = dual.leading(gram, 4)
    want = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    np.testing.assert_allclose(value, want[:4], rtol=1e-8)
    np.testing.assert_allclose(c @ (c.T @ u), u * value, atol=1e-5)


def test_dual_ridge_of_wide_rows(spark):
    """Far more features than rows, and than the primal form takes."""
    rng = np.random.default_rng(27)
    n, p = 120, 6000
    x = rng.normal(2, 1, (n, p))
    y = x[:, :5].sum(axis=1) + rng.normal(size=n)
    got = ridge.ridge_grid(frame(spark, x, y), p, [3.0, 500.0], [8, None])
    c = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    for a, alpha in enumerate((3.0, 500.0)):
        for k, npc in enumerate((8, n - 1)):
            beta = vt[:npc].T @ (s[:npc] / (s[:npc] ** 2 + alpha) * (u.T[:npc] @ (y - y.mean())))
            np.testing.assert_allclose(got[:-1, a, k], beta, atol=1e-7)
            assert got[-1, a, k] == pytest.approx(y.mean() - x.mean(axis=0) @ beta, abs=1e-5)
