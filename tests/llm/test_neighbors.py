"""Multi-index hashing against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from cortiq.llm import neighbors, queries

SCHEMA = "vec_id long, embedding array<float>, score string, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1) for i, v in rows], SCHEMA)


def brute(rows, k, every=20):
    """{(id, vector): [(vec_id, score)]} over all usable rows."""
    found = {(i, tuple(np.float32(v).astype(float))) for i, v in rows if i is not None}
    out = {}
    for i, v in found:
        if i % every == 0:
            near = [(-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in found if j != i]
            out[i, v] = [(j, -s) for s, j in sorted(near)[:k]]
    return out


def listed(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


@pytest.mark.parametrize("scale", [0.0, 1.0])
def test_against_all_rows(spark, scale):
    """With norms alike and norms that differ; several shards, and few codes in the radius."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24))
    x = x / np.linalg.norm(x, axis=1)[:, None] * np.exp(scale * rng.normal(size=(3000, 1)) / 2)
    rows = [(int(i), v) for i, v in enumerate(x)]
    want = {q: v for (q, _), v in brute(rows, 20).items()}
    got = listed(neighbors.searched(spark, frame(spark, rows), near=200, shard=1000))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    exact = {i: np.float32(v).astype(float) for i, v in rows}
    for q, found in got.items():
        assert [s for _, s in found] == pytest.approx([exact[q] @ exact[i] for i, _ in found], abs=1e-12)
        assert found == sorted(found, key=lambda e: (-e[1], e[0]))


def test_hard_rows(spark):
    """Copies beyond k, ties, near copies, and rows that take no part; everything is in the radius, so the result is exact."""
    rng = np.random.default_rng(2)
    hot, other = rng.integers(-3, 4, (2, 6)) + 0.5
    rows = [(i, hot) for i in range(0, 300)] + [(i, other) for i in range(300, 330)] + [(400 + i, v) for i, v in enumerate(rng.integers(-2, 3, (40, 6)) + 0.25)]
    rows += [(40, hot), (40, hot), (320, other * 2)]  # repeated rows, and an id with two vectors
    bad = [(None, hot), (500, None), (520, np.zeros(6)), (540, [1, None, 0, 0, 0, 0]), (560, [1, np.nan, 0, 0, 0, 0]), (580, [np.inf, 0, 0, 0, 0, 0]), (600, [1.0, 2.0]), (620, [])]
    got = listed(neighbors.searched(spark, frame(spark, rows + bad), k=5))
    for (q, v), want in brute(rows, 5).items():
        if q != 320:
            assert [i for i, _ in got[q]] == [i for i, _ in want], q
            assert [s for _, s in got[q]] == pytest.approx([s for _, s in want])
    both = sorted((s, i) for (q, _), want in brute(rows, 5).items() if q == 320 for i, s in want)
    assert sorted((s, i) for i, s in got[320]) == both
    assert not {500, 520, 540, 560, 580, 600, 620} & got.keys()


def test_few_and_no_rows(spark):
    assert neighbors.searched(spark, frame(spark, [])).count() == 0
    assert neighbors.searched(spark, frame(spark, [(1, [1, 2]), (3, [1, 2])])).count() == 0
    assert neighbors.searched(spark, frame(spark, [(20, [1, 2])])).count() == 0
    assert listed(neighbors.searched(spark, frame(spark, [(20, [1, 2]), (1, [0, 1]), (2, [-1, 0])]))) == {20: [(1, 2.0), (2, -1.0)]}


def test_probing_sees_every_code_in_the_radius():
    """The pigeonhole principle: a query near to many codes ends by probes alone, and misses none."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 4, np.uint64)
    flips = [rng.choice(256, int(n), replace=False) for n in rng.integers(0, 60, 500)]
    code = np.tile(base, (6000, 1))
    for i, f in enumerate(flips):
        for b in f:
            code[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    code[500:] = rng.integers(0, 2**64, (5500, 4), np.uint64)
    s = neighbors.Shard(np.zeros((6000, 1)), code)
    distance = np.bitwise_count(code ^ base).sum(axis=1)
    for near in (1, 50, 200):
        rows, found, probes = s.probed(base, near)
        assert probes and np.array_equal(found, distance[rows])
        cut = np.sort(distance, kind="stable")[near - 1]
        assert sorted(s.within(base, near)) == np.flatnonzero(distance <= cut).tolist()
    far = rng.integers(0, 2**64, 4, np.uint64)
    assert not s.probed(far, 50)[2]
    reach = np.bitwise_count(code ^ far).sum(axis=1)
    assert sorted(s.within(far, 50)) == np.flatnonzero(reach <= np.sort(reach)[49]).tolist()


def test_rotations_fit_signs_better_than_chance():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 16)) * np.linspace(3, 0.2, 16)
    r = neighbors.rotations(x, 16)
    assert r.shape == (16, 16) and np.allclose(r.T @ r, np.eye(16))
    chance = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    loss = lambda m: ((np.where(x @ m >= 0, 1, -1) - x @ m) ** 2).mean()
    assert loss(r) < loss(chance)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = listed(queries.op11_nearest(spark, sf))
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = {q: v for (q, _), v in brute(rows, 20).items()}
    assert got.keys() == want.keys()
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in v}) for q, v in want.items()) >= 0.98 * 20 * len(want)
