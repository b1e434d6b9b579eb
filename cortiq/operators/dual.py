"""Ridge regression in its dual form, for many more features than observations: Gram blocks and block Lanczos.

The Gram matrix of the rows is a table of blocks, made in pairs of row blocks and never held as a whole. What a fit needs of it
are products with a few vectors, one for each observation: a job in which every task multiplies its blocks, and sums leave by row.
Of rows with fewer features than half the observations no block is made: a product goes through the rows, X (X' v), and X' v is smaller
than v. The driver holds vectors (observations x basis), no matrix of observations x observations and none of the features.

A split of resampled rows is a diagonal of counts c: with rows centred by the split's weighted mean, its Gram matrix applied to v is
sqrt(c) * (K h - c'K h / N), h = sqrt(c) * v - c * sum(sqrt(c) * v) / N. So all splits share the table of K, and one job
multiplies the vectors of all of them. A block Krylov space, fully orthogonalised, from the target and random vectors gives the
leading eigenpairs (for models on the first components) and the solution of the shifted system (for models on all), for all
penalties at once.

Defined results: the same as the primal form's (ridge.ridge_grid) up to rounding. Eigenvalues below 1e-12 of the largest count as zero,
and components beyond the rank add nothing. A split without rows predicts 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written
from .factor import column_means, dense, inverse_of, less, listed, signed

#: Numbers in a block of rows that a task holds (two at a time), and rows in it at most.
BLOCK_NUMBERS, BLOCK_ROWS = 2_000_000, 512
#: Numbers of the driver's bases: splits are fitted in batches that keep to it.
BASIS_NUMBERS = 40_000_000
#: Vectors by which a Krylov space grows, and the relative residual at which it is large enough.
GROWTH, TOLERANCE = 6, 1e-9


@dataclass
class Gram:
    """Blocks of the Gram matrix of rows, numbered 0.. by ascending obs: (bi, bj, k) for bi <= bj, k the packed block."""

    blocks: DataFrame
    obs: np.ndarray
    size: int

    @property
    def rank(self) -> int:
        """The rank is not more."""
        return len(self.obs)

    def times(self, v: np.ndarray) -> np.ndarray:
        """The matrix times (observations, m) on the driver."""
        return _collected(self.product(v), v.shape)

    def product(self, v: np.ndarray) -> DataFrame:
        """(row, y: an array by column of v): the matrix times v, added up by row on Spark."""
        shared, size, n = self.blocks.sparkSession.sparkContext.broadcast(v), self.size, len(self.obs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, sums = shared.value, {}
            part = lambda b: slice(b * size, min((b + 1) * size, n))
            for batch in batches:
                for i, j, k in zip(*(batch.column(c) for c in ("bi", "bj", "k")), strict=True):
                    i, j = i.as_py(), j.as_py()
                    m = k.values.to_numpy().reshape(-1, len(v[part(j)]))
                    sums[i] = sums.get(i, 0) + m @ v[part(j)]
                    if i != j:
                        sums[j] = sums.get(j, 0) + m.T @ v[part(i)]
            for b, y in sums.items():
                yield pa.RecordBatch.from_pydict({"row": pa.array(b * size + np.arange(len(y)), pa.int64()), "y": listed(y)})

        parts = self.blocks.mapInArrow(run, "row long, y array<double>").select("row", F.posexplode("y").alias("k", "v"))
        cells = parts.groupBy("row", "k").agg(F.sum("v").alias("v"))
        return cells.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda e: e["v"]).alias("y"))


def _collected(found: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    found = found.toArrow().combine_chunks()
    if found.num_rows:
        out[found.column("row").to_numpy()] = found.column("y").combine_chunks().flatten().to_numpy().reshape(-1, shape[1])
    return out


@dataclass
class Factored:
    """The same matrix as its rows(row, x array of `width`), for many more rows than columns: products with it as X (X' v)."""

    rows: DataFrame
    obs: np.ndarray
    width: int

    @property
    def rank(self) -> int:
        return self.width

    def times(self, v: np.ndarray) -> np.ndarray:
        return _collected(self.product(v), v.shape)

    def product(self, v: np.ndarray) -> DataFrame:
        """(row, y: an array by column of v). Sums of (width, m) leave a task; a row's products need the row alone."""
        context, m = self.rows.sparkSession.sparkContext, v.shape[1]
        shared = context.broadcast(v)

        def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = dense(batch, "x").T @ shared.value[batch.column("row").to_numpy()]
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(total.size), pa.int64()), "v": total.ravel()})

        found = self.rows.mapInArrow(inner, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        shared.destroy()
        z = np.zeros(self.width * m)
        z[found.column("at").to_numpy()] = found.column("v").to_numpy()
        z = context.broadcast(z.reshape(self.width, m))

        def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "y": listed(dense(batch, "x") @ z.value)})

        return self.rows.mapInArrow(outer, "row long, y array<double>")


def factored(spark: SparkSession, rows: DataFrame, width: int, obs: np.ndarray, mean: np.ndarray | None = None) -> Factored:
    shared = spark.sparkContext.broadcast((obs, 0 if mean is None else mean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        obs, mean = shared.value
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"row": pa.array(np.searchsorted(obs, batch.column("obs").to_numpy()), pa.int64()), "x": listed(dense(batch, "x") - mean)})

    return Factored(written(spark, rows.select("obs", "x").mapInArrow(run, "row long, x array<double>"), "gram-rows"), obs, width)


def gram_blocks(spark: SparkSession, rows: DataFrame, mean: np.ndarray | None = None) -> Gram:
    """The Gram matrix of rows(obs, x) less a mean; obs differ. A pair of blocks is one product of matrices in a task."""
    obs = np.sort(rows.select("obs").toArrow().column("obs").to_numpy())  # a number for each row
    width = rows.select(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    size = int(np.clip(BLOCK_NUMBERS // max(width, 1), 16, BLOCK_ROWS))
    n = max(1, -(-len(obs) // size))
    place = spark.createDataFrame(pa.table({"obs": obs, "row": np.arange(len(obs))}))
    centred = rows.select("obs", "x") if mean is None else less(rows, mean)
    cut = centred.join(place, "obs").select("row", F.floor(F.col("row") / size).cast("int").alias("block"), "x")
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("row", "x", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    dealt = dealt.repartition("bi", "bj").sortWithinPartitions("bi", "bj", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, rows_of = None, [], []

        def close() -> pa.RecordBatch:
            x, row = np.concatenate(held), np.concatenate(rows_of)
            left, right = (x[row // size == b] for b in at)
            return pa.RecordBatch.from_pydict({"bi": pa.array([at[0]], pa.int32()), "bj": pa.array([at[1]], pa.int32()), "k": listed((left @ right.T).reshape(1, -1))})

        for batch in batches:
            keys = np.column_stack([batch.column("bi").to_numpy(), batch.column("bj").to_numpy()])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)] if len(keys) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tuple(keys[a]) != at:
                    yield close()
                    held.clear(), rows_of.clear()
                at = tuple(int(k) for k in keys[a])
                held.append(dense(batch.slice(a, b - a), "x"))
                rows_of.append(batch.column("row").to_numpy()[a:b])
        if held:
            yield close()

    return Gram(written(spark, dealt.mapInArrow(run, "bi int, bj int, k array<double>"), "gram-blocks"), obs, size)


@dataclass
class Split:
    """A resampled, centred target and the Krylov space that grows from it."""

    root: np.ndarray  # square roots of the counts
    target: np.ndarray
    mean: float
    total: float
    centred: bool
    q: np.ndarray
    gq: np.ndarray
    next: np.ndarray | None = None  # new directions, orthonormal

    def into(self, v: np.ndarray) -> np.ndarray:
        """What K is to be multiplied by."""
        w = self.root[:, None] * v
        return w - np.outer(self.root**2, w.sum(axis=0)) / self.total if self.centred else w

    def outof(self, kh: np.ndarray) -> np.ndarray:
        return self.root[:, None] * (kh - (self.root**2 @ kh) / self.total if self.centred else kh)

    def fresh(self, v: np.ndarray) -> np.ndarray:
        """The part of v that is new to the space, orthonormal."""
        size = np.linalg.norm(v, axis=0)
        v = v[:, size > 0] / size[size > 0]
        for _ in range(2):
            v = v - self.q @ (self.q.T @ v)
        u, s, _ = np.linalg.svd(v, full_matrices=False)
        u = u[:, s > 1e-8]
        u = u - self.q @ (self.q.T @ u)
        return np.linalg.qr(u)[0] if u.size else u

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Ritz values and vectors in the basis, largest first."""
        h = self.q.T @ self.gq
        value, vector = np.linalg.eigh((h + h.T) / 2)
        return np.maximum(value[::-1], 0), vector[:, ::-1]

    def residuals(self, alphas: list[float], npcs: list[int | None]) -> float:
        """The largest relative residual of the eigenpairs and solutions that are asked for."""
        value, vector = self.pairs()
        top = max(value.max(initial=0), 1e-300)
        worst = 0.0
        leading = max((k for k in npcs if k is not None), default=0)
        if leading:
            if len(value) < min(leading, len(self.root)):
                return np.inf
            y = vector[:, :leading]
            worst = np.linalg.norm(self.gq @ y - (self.q @ y) * value[:leading], axis=0).max(initial=0) / top
        if None in npcs:
            a = self.solution(min(alphas), None)
            rest = self.target - (self.gq @ (self.q.T @ a) + min(alphas) * a)
            # What the table cannot reach is orthogonal to it and changes no weight.
            rest = self.q @ (self.q.T @ rest) + (rest - self.q @ (self.q.T @ rest)) * (len(value) < len(self.root))
            worst = max(worst, np.linalg.norm(rest) / max(np.linalg.norm(self.target), 1e-300))
        return worst

    def solution(self, alpha: float, npc: int | None) -> np.ndarray:
        value, vector = self.pairs()
        live = value > 1e-12 * max(value.max(initial=0), 1e-300)
        if npc is not None:
            live[npc:] = False
        part = vector.T @ (self.q.T @ self.target)
        return self.q @ (vector @ np.where(live, part / np.where(live, value + alpha, 1), 0))


def _grow(gram: Gram | Factored, spaces: list[tuple[int, Split]], alphas: list[float], npcs: list[int | None]) -> None:
    """Grow the spaces, all by the same jobs, until each holds what is asked for or all that its rows span."""
    while live := [space for _, space in spaces if space.next is not None and space.next.size]:
        found = gram.times(np.concatenate([space.into(space.next) for space in live], axis=1))
        at = 0
        for space in live:
            g = space.outof(found[:, at : at + space.next.shape[1]])
            at += space.next.shape[1]
            space.q, space.gq = np.concatenate([space.q, space.next], axis=1), np.concatenate([space.gq, g], axis=1)
            more = space.fresh(g)
            space.next = None if not more.size or space.residuals(alphas, npcs) <= TOLERANCE else more


def leading(gram: Gram | Factored, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(k largest eigenvalues, eigenvectors (observations, k)) of the Gram matrix, with no matrix of its size on the driver."""
    n = len(gram.obs)
    start = np.random.default_rng(seed).normal(size=(n, min(n, GROWTH)))
    space = Split(np.ones(n), np.zeros(n), 0.0, max(n, 1), False, np.zeros((n, 0)), np.zeros((n, 0)))
    space.next = space.fresh(start)
    _grow(gram, [(0, space)], [1.0], [min(k, n)])
    value, vector = space.pairs()
    vectors = space.q @ vector[:, :k]
    return value[:k], signed(vectors)


def row_weights(gram: Gram | Factored, beta: np.ndarray) -> np.ndarray:
    """The weight of each row in a model that is linear in the first components' scores."""
    value, u = leading(gram, len(beta))
    return u @ (beta * inverse_of(np.sqrt(value)))


def fits(gram: Gram | Factored, y: np.ndarray, counts: np.ndarray, alphas: list[float], npcs: list[int | None], fit_intercept: bool = True, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(weights of observations (n, splits, alphas, npcs), intercepts (splits, alphas, npcs)); features' weights are X' times the first."""
    n, splits = counts.shape
    out, intercept = np.zeros((n, splits, len(alphas), len(npcs))), np.zeros((splits, len(alphas), len(npcs)))
    basis = min(n, 20 * GROWTH + max((k for k in npcs if k is not None), default=0) if None not in npcs else n)
    basis = min(basis, gram.rank + 2 * GROWTH)  # random vectors start outside the range
    step = max(1, BASIS_NUMBERS // max(1, 2 * n * basis))
    for first in range(0, splits, step):
        some = range(first, min(first + step, splits))
        spaces = []
        for s in some:
            c = counts[:, s].astype(float)
            total = max(c.sum(), 1.0)
            mean = float(c @ y / total) if fit_intercept else 0.0
            root = np.sqrt(c)
            space = Split(root, root * (y - mean), mean, total, fit_intercept, np.zeros((n, 0)), np.zeros((n, 0)))
            start = np.column_stack([space.target, np.random.default_rng([seed, s]).normal(size=(n, GROWTH - 1)) * root[:, None]])
            space.next = space.fresh(start)
            spaces.append((s, space))
        _grow(gram, spaces, alphas, npcs)
        for s, space in spaces:
            for a, alpha in enumerate(alphas):
                for k, npc in enumerate(npcs):
                    out[:, s, a, k] = space.into(space.solution(alpha, npc)[:, None])[:, 0]
            intercept[s] = space.mean
    if fit_intercept:
        flat = out.reshape(n, -1)
        mean = (counts / np.maximum(counts.sum(axis=0), 1)).repeat(flat.shape[1] // splits, axis=1)
        intercept -= np.concatenate([(mean[:, k : k + 256] * gram.times(flat[:, k : k + 256])).sum(axis=0) for k in range(0, flat.shape[1], 256)]).reshape(intercept.shape)
    return out, intercept


def feature_weights(rows: DataFrame, gram: Gram | Factored, weights: np.ndarray, mean: np.ndarray | None = None) -> np.ndarray:
    """(features, m): X' times weights (observations, m), of rows less a mean; a task adds up its rows."""
    shared = rows.sparkSession.sparkContext.broadcast((gram.obs, weights))
    m = weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        obs, w = shared.value
        total = None
        for batch in batches:
            if batch.num_rows:
                part = (dense(batch, "x") - (0 if mean is None else mean)).T @ w[np.searchsorted(obs, batch.column("obs").to_numpy())]
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(total.size), pa.int64()), "v": total.ravel()})

    found = rows.select("obs", "x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(found.num_rows)
    out[found.column("at").to_numpy()] = found.column("v").to_numpy()
    return out.reshape(-1, m)


def targets(rows: DataFrame, gram: Gram | Factored) -> np.ndarray:
    found = rows.select("obs", "y").toArrow()
    out = np.zeros(len(gram.obs))
    out[np.searchsorted(gram.obs, found.column("obs").to_numpy())] = found.column("y").to_numpy()
    return out


def centred_gram(spark: SparkSession, rows: DataFrame, fit_intercept: bool) -> tuple[Gram | Factored, np.ndarray | None]:
    """Rows are moved to their mean where an intercept takes it up again, so that large means cancel nothing."""
    mean = column_means(rows) if fit_intercept else None
    width = rows.select(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    obs = np.sort(rows.select("obs").toArrow().column("obs").to_numpy())
    if width and 2 * width < len(obs):  # the rows are fewer numbers than the half of their Gram matrix
        return factored(spark, rows, width, obs, mean), mean
    return gram_blocks(spark, rows, mean), mean


def ridge_grid(spark: SparkSession, rows: DataFrame, alphas: list[float], npcs: list[int | None], fit_intercept: bool = True) -> np.ndarray:
    """As ridge.ridge_grid, of rows(obs, x, y): (features[, intercept last], alphas, npcs)."""
    gram, mean = centred_gram(spark, rows, fit_intercept)
    weights, intercept = fits(gram, targets(rows, gram), np.ones((len(gram.obs), 1)), alphas, npcs, fit_intercept)
    return with_intercept(feature_weights(rows, gram, weights.reshape(len(gram.obs), -1), mean), intercept[0], mean)


def with_intercept(beta: np.ndarray, intercept: np.ndarray, mean: np.ndarray | None) -> np.ndarray:
    shape = intercept.shape
    if mean is None:
        return beta.reshape(-1, *shape)
    return np.concatenate([beta, (intercept.ravel() - mean @ beta)[None]]).reshape(-1, *shape)


def counts_of(plan: DataFrame, gram: Gram | Factored) -> tuple[np.ndarray, list[int]]:
    """(observations x splits) multiplicities of the training rows, and the splits' names."""
    found = plan.where("role = 'train'").groupBy("split", "obs").agg(F.sum("multiplicity").alias("n")).toArrow()
    splits, at = np.unique(found.column("split").to_numpy(), return_inverse=True)
    out = np.zeros((len(gram.obs), len(splits)))
    row = np.minimum(np.searchsorted(gram.obs, found.column("obs").to_numpy()), len(gram.obs) - 1)
    known = gram.obs[row] == found.column("obs").to_numpy()
    out[row[known], at[known]] = found.column("n").to_numpy()[known]
    return out, splits.tolist()


def predictions(spark: SparkSession, gram: Gram | Factored, weights: np.ndarray, intercept: np.ndarray, splits: list[int], member: DataFrame, withheld: DataFrame) -> DataFrame:
    """(split, grp, obs, alpha, npc, pred) of the observations of member(grp, obs) by the splits that withhold their group, from products
    that stay on Spark: a row has all of its predictions until it meets its splits."""
    n, s, a, k = weights.shape
    place = spark.createDataFrame(pa.table({"obs": gram.obs, "row": np.arange(n)}))
    names = spark.createDataFrame([(int(splits[i]), i * a * k + 1, [float(v) for v in intercept[i].ravel()]) for i in range(s)], "split int, first int, intercepts array<double>")
    own = gram.product(weights.reshape(n, -1)).join(place, "row").join(member, "obs").join(withheld, "grp").join(F.broadcast(names), "split")  # a row for each split
    cells = own.select("split", "grp", "obs", F.posexplode(F.zip_with(F.slice("y", F.col("first"), F.lit(a * k)), "intercepts", lambda v, c: v + c)).alias("pos", "pred"))
    return cells.select("split", "grp", "obs", F.floor(F.col("pos") / k).cast("int").alias("alpha"), (F.col("pos") % k).alias("npc"), "pred")
