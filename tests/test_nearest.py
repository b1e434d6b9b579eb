"""k nearest neighbors by the tree, and distances from all sources, against plain loops."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pytest

from cortiq.operators import geodesic, nearest


def points(spark, name, x):
    return spark.createDataFrame(pa.table({name: np.arange(len(x)), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]})).repartition(3)


def brute(p, x, k):
    d = np.sqrt(((x - p) ** 2).sum(axis=1))
    order = np.lexsort((np.arange(len(x)), d))[:k]
    return order.tolist(), d[order]


@pytest.mark.parametrize("k", [1, 4, 40])
def test_any_density(spark, k):
    """Nearly all points in what was one cell, many at one place, some far away."""
    rng = np.random.default_rng(31)
    x = np.concatenate([rng.normal(size=(200, 3)), 1e-7 * rng.normal(size=(4000, 3)), np.zeros((300, 3)), [[1e6, 0, 0], [0, -1e6, 5]]])
    p = np.concatenate([rng.normal(size=(60, 3)), 1e-7 * rng.normal(size=(5000, 3)), [[0, 0, 0], [9e5, 1, 1], [-3e6, 0, 0]]])
    got = nearest.nearest(points(spark, "p", p), points(spark, "q", x), k).toPandas().sort_values(["p", "rank"]).groupby("p")
    lists, far = got["q"].apply(list), got["d"].apply(list)
    assert len(lists) == len(p)
    for i in [*range(0, 60, 3), *range(60, 5060, 211), 5060, 5061, 5062]:
        q, d = brute(p[i], x, k)
        assert lists[i] == q
        np.testing.assert_allclose(far[i], d, rtol=1e-12)


def test_few_targets_and_nulls(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0), (3, -0.0, 5.0, 0.0)], "p long, x double, y double, z double")
    q = spark.createDataFrame([(7, 1.0, 0.0, 0.0), (5, 1.0, 0.0, 0.0), (6, 0.0, 9.0, None)], "q long, x double, y double, z double")
    got = sorted((r["p"], r["rank"], r["q"]) for r in nearest.nearest(p, q, 3).collect())
    assert got == [(1, 1, 5), (1, 2, 7), (3, 1, 5), (3, 2, 7)]
    assert nearest.nearest(p, q.limit(0), 2).count() == 0 and nearest.nearest(p.limit(0), q, 2).count() == 0


def test_leaves_are_bounded(spark):
    """A sample that misses the dense part still ends in leaves of bounded size; boxes hold their targets."""
    rng = np.random.default_rng(32)
    x = np.concatenate([rng.normal(size=(20_000, 3)), 1e-9 * rng.normal(size=(20_000, 3)) + 3])
    places = points(spark, "q", x).select("x", "y", "z")
    tree = nearest.tree_of(places, len(x))
    at = tree.leaf_of(x)
    sizes = np.bincount(at)
    assert sizes.max() <= 4 * nearest.LEAF and tree.count[0] == len(x)
    assert (tree.low[at] <= x).all() and (x <= tree.high[at]).all()


def graph(seed, n, m):
    rng = np.random.default_rng(seed)
    steps = {}
    for a, b, w in zip(rng.integers(0, n, m), rng.integers(0, n, m), rng.choice([0.0, 0.05, 0.4, 1.0, 7.0], m) * rng.uniform(0.5, 1, m), strict=True):
        if a != b:
            steps[int(a), int(b)] = steps[int(b), int(a)] = float(w)
    return steps


def heap(steps, source):
    out, best, queue = {}, {source: 0.0}, [(0.0, source)]
    near = {}
    for (a, b), w in steps.items():
        near.setdefault(a, []).append((b, w))
    while queue:
        d, v = heapq.heappop(queue)
        if v in out:
            continue
        out[v] = d
        for b, w in near.get(v, ()):
            if d + w < best.get(b, np.inf):
                best[b] = d + w
                heapq.heappush(queue, (d + w, b))
    return out


@pytest.mark.parametrize("delta", [None, 0.3, 100.0])
def test_neighborhoods_of_all_nodes(spark, delta):
    """Any width of buckets: only short edges, only long ones, and both."""
    steps = graph(33, 24, 50)
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in steps.items()], "v long, nbr long, d double")
    got = {}
    for r in geodesic.neighborhoods(edges, 1.5, delta=delta).collect():
        got.setdefault(r["center"], []).append((r["pos"], r["v"], r["d"]))
    nodes = {a for a, _ in steps}
    assert got.keys() == nodes
    for c in nodes:
        want = {v: d for v, d in heap(steps, c).items() if d < 1.5}
        rows = sorted(got[c])
        assert [p for p, *_ in rows] == list(range(len(want))) and rows[0][2] == 0.0
        assert {v: pytest.approx(d, abs=1e-9) for _, v, d in rows} == want
        assert [d for *_, d in rows] == sorted(d for *_, d in rows)


def test_neighborhoods_of_some_nodes_and_the_strict_radius(spark):
    edges = spark.createDataFrame([(a, b, 1.0) for i in range(9) for a, b in ((i, i + 1), (i + 1, i))], "v long, nbr long, d double")
    some = spark.createDataFrame([(0,), (5,)], "v long")
    got = sorted((r["center"], r["v"]) for r in geodesic.neighborhoods(edges, 2.0, some).collect())
    assert got == [(0, 0), (0, 1), (5, 4), (5, 5), (5, 6)]
    assert geodesic.neighborhoods(edges.limit(0), 2.0).count() == 0


def test_nearest_seed_by_buckets(spark):
    steps = graph(34, 60, 150)
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in steps.items()], "v long, nbr long, d double")
    seeds = {3: 0.0, 17: 0.3, 44: 0.0}
    table = spark.createDataFrame([(v, v, d) for v, d in seeds.items()], "v long, seed long, d double")
    want = {}
    for s, d in seeds.items():
        for v, e in heap(steps, s).items():
            want[v] = min(want.get(v, (np.inf, 0)), (round(d + e, 9), s))
    got = {r["v"]: (round(r["d"], 9), r["seed"]) for r in geodesic.nearest_seed(edges, table).collect()}
    assert got == want
