"""Ridge regression on principal components, with group-aware cross-validation and nested choice of its parameters.

A split is fitted from the moments of its rows, so a split's data never meets in a task. With more than factor.SMALL features the
fits go through the rows' Gram matrix instead (dual). By linearity, a prediction with averaged weights is the average of the
splits' predictions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.resampling import group_bagging, group_bagging_plan, plan_table, withheld_table
from ..sources.scratch import written
from . import dual
from .factor import SMALL, column_means, dense, listed, times
from .linalg import weighted
from .moments import group_moments, matrix, moments


def ridge_weights(m: np.ndarray, alphas: list[float], npcs: list[int | None], fit_intercept: bool = True) -> np.ndarray:
    """(coefficients[, intercept last], alphas, npcs) from the moments of [1, x, y]."""
    n, sx, sy = m[0, 0], m[0, 1:-1], m[0, -1]
    xx, xy = m[1:-1, 1:-1], m[1:-1, -1]
    if fit_intercept:
        xx, xy = xx - np.outer(sx, sx) / n, xy - sx * sy / n
    value, vector = np.linalg.eigh(xx)
    value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
    part = vector.T @ xy
    live = value > 1e-12 * max(value.max(initial=0), 1e-300)
    out = np.zeros((len(xy) + fit_intercept, len(alphas), len(npcs)))
    for a, alpha in enumerate(alphas):
        each = vector * np.where(live, part / np.where(live, value + alpha, 1), 0)
        for k, npc in enumerate(npcs):
            beta = each[:, :npc].sum(axis=1)
            out[: len(xy), a, k] = beta
            if fit_intercept:
                out[-1, a, k] = (sy - sx @ beta) / n
    return out


def augmented(rows: DataFrame, p: int) -> tuple[DataFrame, np.ndarray]:
    """rows(obs, x, y) with z = [1, x, y] less the means of all rows, so that large means cancel nothing; and the means."""
    both = rows.withColumn("z", F.concat("x", F.array("y")))
    found = column_means(both, "z")
    mean = found if len(found) else np.zeros(p + 1)
    shared, kept = rows.sparkSession.sparkContext.broadcast(mean), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = dense(batch, "z") - shared.value
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], listed(np.column_stack([np.ones(len(z)), z]))], [*kept, "z"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes if c != "z")
    return both.select(*kept, "z").mapInArrow(run, f"{kinds}, z array<double>"), mean


def unshifted(beta: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Weights on shifted rows as weights on the rows: only the intercept moves."""
    p = len(mean) - 1
    beta[p] += mean[p] - np.tensordot(mean[:p], beta[:p], 1)
    return beta


def ridge_grid(rows: DataFrame, p: int, alphas: list[float], npcs: list[int | None], fit_intercept: bool = True, dual_form: bool | None = None) -> np.ndarray:
    """Weights of one model for each pair of parameters on all rows; through the Gram matrix for more than factor.SMALL features."""
    if _by_dual(p, dual_form):
        return dual.ridge_grid(rows.sparkSession, rows, alphas, npcs, fit_intercept)
    if not fit_intercept:  # without an intercept the rows must stay where they are
        raw = rows.withColumn("z", F.concat(F.array(F.lit(1.0)), "x", F.array("y")))
        return ridge_weights(matrix(moments(raw, p + 2), p + 2), alphas, npcs, False)
    z, mean = augmented(rows, p)
    return unshifted(ridge_weights(matrix(moments(z, p + 2), p + 2), alphas, npcs), mean)


def ridge(rows: DataFrame, p: int, alpha: float, npc: int | None = None, test: DataFrame | None = None, fit_intercept: bool = True, dual_form: bool | None = None):
    """Weights, or test(obs, x) with yhat."""
    beta = ridge_grid(rows, p, [alpha], [npc], fit_intercept, dual_form)[:, 0, 0]
    if test is None:
        return beta
    return times(test, beta[:p, None], name="yhat").withColumn("yhat", F.col("yhat")[0] + float(beta[p] if fit_intercept else 0.0))


def _planned(spark: SparkSession, groups: DataFrame | list[np.ndarray], n_folds: int, n_reps: int, seed: int, given=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(member(grp, obs), plan, withheld(split, grp)); a list of groups gets numpy's draws, made on the driver."""
    if given is not None:
        return groups, *given
    if isinstance(groups, DataFrame):
        return groups, *group_bagging_plan(groups, n_folds, n_reps, seed)
    splits = group_bagging(groups, n_folds, n_reps, seed)
    member = spark.createDataFrame([(int(g), int(o)) for g, m in enumerate(groups) for o in m], "grp int, obs long")
    return member, plan_table(spark, [(t, np.zeros(0, int)) for t, _ in splits], n_folds), withheld_table(spark, splits)


@dataclass
class Fits:
    """Weights of each split as [intercept, features] x alphas x npcs, on rows that are moved by `mean`."""

    betas: dict[int, np.ndarray]
    rows: DataFrame  # with z = [1, x, y], moved
    mean: np.ndarray
    p: int

    def average(self) -> np.ndarray:
        """Mean weights over splits, on the rows as they are: features[, intercept last]."""
        return self.plain(np.mean(list(self.betas.values()), axis=0))

    def plain(self, beta: np.ndarray) -> np.ndarray:
        return unshifted(np.concatenate([beta[1:], beta[:1]]), self.mean)


def _fits(spark: SparkSession, rows: DataFrame, plan: DataFrame, p: int, alphas, npcs, fit_intercept: bool) -> Fits:
    wide, mean = augmented(rows, p) if fit_intercept else (rows.withColumn("z", F.concat(F.array(F.lit(1.0)), "x", F.array("y"))), np.zeros(p + 1))
    found = moments(weighted(spark, wide, plan).select("z", "counts"), p + 2, "counts").collect()  # splits x (p + 2)^2 numbers
    betas = {}
    for r in found:
        b = ridge_weights(np.array(r["m"]).reshape(p + 2, p + 2), alphas, npcs, fit_intercept)
        betas[r["split"]] = np.concatenate([b[p:], b[:p]]) if fit_intercept else np.concatenate([np.zeros((1, *b.shape[1:])), b])
    # The plan marks no split empty: every split draws as many rows as there are.
    return Fits(betas, wide, mean, p)


def _group_weights(fits: Fits, withheld: DataFrame) -> DataFrame:
    """(grp, weights): the mean of the splits that withhold a group, packed as (1 + p) x alphas x npcs."""
    shared = withheld.sparkSession.sparkContext.broadcast(fits.betas)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.mean([shared.value[s] for s in splits if s in shared.value], axis=0).ravel() for splits in batch.column("splits").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), pa.array(found, pa.list_(pa.float64()))], ["grp", "weights"])

    listed = withheld.distinct().groupBy("grp").agg(F.collect_list("split").alias("splits"))  # splits of a group
    return listed.mapInArrow(run, f"grp {dict(withheld.dtypes)['grp']}, weights array<double>")


def _grid(alphas, npcs):
    return F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(k).alias("npc")) for a in range(len(alphas)) for k in range(len(npcs))]))


def ridge_cv(spark: SparkSession, rows: DataFrame, groups: DataFrame | list[np.ndarray], p: int, alphas: list[float], npcs: list[int | None], n_folds: int = 5, n_reps: int = 20, fit_intercept: bool = True, seed: int = 0, given: tuple[DataFrame, DataFrame] | None = None, dual_form: bool | None = None) -> tuple[DataFrame, np.ndarray]:
    """(yhat(obs, alpha, npc, yhat), mean weights): each group is predicted by the splits that withhold it; 0 if none does.

    groups is member(grp, obs), or a list of the observations of each group for a plan made on the driver; a plan of one's own is
    given as plan(split, obs, role, multiplicity) and withheld(split, grp). By linearity the mean of predictions is the prediction
    by mean weights, so a row is predicted once for each pair of parameters, however many splits there are.
    """
    member, plan, withheld = _planned(spark, groups, n_folds, n_reps, seed, given)
    if _by_dual(p, dual_form):
        held, weights = _dual_predictions(spark, rows, member, plan, withheld, alphas, npcs, fit_intercept)
        average = held.groupBy("obs", "alpha", "npc").agg(F.avg("pred").alias("yhat"))
    else:
        fits = _fits(spark, rows, plan, p, alphas, npcs, fit_intercept)
        weights = fits.average() if fit_intercept else fits.average()[:p]
        own = fits.rows.join(member, "obs").join(_group_weights(fits, withheld), "grp").select("obs", "z", "weights", _grid(alphas, npcs).alias("g")).select("obs", "z", "weights", "g.*")
        average = own.select("obs", "alpha", "npc", (_dot(fits, len(alphas), len(npcs)) + float(fits.mean[p])).alias("yhat"))
    grid = rows.select("obs", _grid(alphas, npcs).alias("g")).select("obs", "g.*")
    return grid.join(average, ["obs", "alpha", "npc"], "left").withColumn("yhat", F.coalesce("yhat", F.lit(0.0))), weights


def _dot(fits: Fits, a: int, k: int):
    """[1, x] times the weights of (alpha, npc) in a packed array."""
    at = F.sequence(F.lit(0), F.lit(fits.p))
    return F.aggregate(at, F.lit(0.0), lambda t, j: t + F.get("z", j) * F.get("weights", (j * a + F.col("alpha")) * k + F.col("npc")))


def _by_dual(p: int, dual_form: bool | None) -> bool:
    return p > SMALL if dual_form is None else dual_form


def _dual_predictions(spark: SparkSession, rows: DataFrame, member: DataFrame, plan: DataFrame, withheld: DataFrame, alphas, npcs, fit_intercept: bool) -> tuple[DataFrame, np.ndarray]:
    """(held(split, grp, obs, alpha, npc, y, pred) of the splits that withhold a group, mean weights), through the rows' Gram matrix."""
    gram, mean = dual.centred_gram(spark, rows, fit_intercept)
    counts, splits = dual.counts_of(plan, gram)
    weights, intercept = dual.fits(gram, dual.targets(rows, gram), counts, alphas, npcs, fit_intercept)
    found = dual.predictions(spark, gram, weights, intercept, splits, member, withheld)
    held = written(spark, found.join(rows.select("obs", "y"), "obs"), "held-predictions")
    beta = dual.feature_weights(rows, gram, weights.mean(axis=1).reshape(len(gram.obs), -1), mean)
    return held, dual.with_intercept(beta, intercept.mean(axis=0), mean)


def _pairs(withheld: DataFrame) -> DataFrame:
    """(grp, pairs: an array of (g, splits)): for each group the others, with the splits that withhold both; g is grp for its own."""
    mine = withheld.distinct()
    both = mine.join(mine.withColumnRenamed("grp", "g"), "split").groupBy("grp", "g").agg(F.sort_array(F.collect_list("split")).alias("splits"))
    return both.groupBy("grp").agg(F.collect_list(F.struct("g", "splits")).alias("pairs"))  # a struct for each other group


def _errors_by_moments(fits: Fits, member: DataFrame, withheld: DataFrame, shape: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(others(g, alpha, npc, sse), own(grp, alpha, npc, sse)): squared errors on all other groups of the mean of the splits that withhold
    them and g, and on a group of the mean of its own splits.

    yy - 2 b'xy + b'xx b of a group's [1, x, y]. Which splits withhold two groups follows from the sets of splits that withhold each, so
    groups of one set are one by the sum of their moments, and what g adds to it is taken off again: a pair of different sets
    costs (1 + p)^2, and there are as many sets as groups at most, 2^splits at most.
    """
    p, kind = fits.p, dict(withheld.dtypes)["grp"]
    names = sorted(fits.betas)
    mine = withheld.distinct().groupBy("grp").agg(F.sort_array(F.collect_list("split")).alias("splits"))  # splits of a group
    own = written(withheld.sparkSession, group_moments(fits.rows.join(member, "obs").select("grp", "z"), p + 2, "grp").join(mine, "grp"), "group-moments")
    sets = [r["splits"] for r in own.select("splits").distinct().collect()]
    marked = lambda some: np.isin(np.array(names, int), some)
    shared = withheld.sparkSession.sparkContext.broadcast((np.array([fits.betas[s] for s in names]).reshape(len(names), -1), np.array([marked(s) for s in sets]).reshape(len(sets), len(names))))
    cells = shape[0] * shape[1]

    def errors(m: np.ndarray, means: np.ndarray, betas: np.ndarray) -> np.ndarray:
        b = (means @ betas).reshape(len(means), p + 1, cells)
        return m[-1, -1] - 2 * np.einsum("j,ejk->ek", m[:-1, -1], b) + np.einsum("eik,ij,ejk->ek", b, m[:-1, :-1], b, optimize=True)

    def of_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        betas, asked = shared.value
        sse, n = np.zeros((len(asked), cells)), np.zeros(len(asked), np.int64)
        step = max(1, 4_000_000 // betas.shape[1]) if betas.size else 1
        for batch in batches:
            for flat, splits, groups in zip(batch.column("m"), batch.column("splits").to_pylist(), batch.column("groups").to_pylist(), strict=True):
                m = flat.values.to_numpy().reshape(p + 2, p + 2)
                both, at = np.unique(asked & marked(splits), axis=0, return_inverse=True)
                k = both.sum(axis=1)
                found = np.concatenate([errors(m, both[i : i + step] / np.maximum(k[i : i + step], 1)[:, None], betas) for i in range(0, len(both), step)])
                sse += np.where(k > 0, 1, 0)[at.ravel(), None] * found[at.ravel()]
                n += groups * (k > 0)[at.ravel()]
        live = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.repeat(live, cells), pa.int32()), "cell": pa.array(np.tile(np.arange(cells), len(live)), pa.int32()), "sse": sse[live].ravel(), "n": np.repeat(n[live], cells)})

    def of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        betas, _ = shared.value
        for batch in batches:
            known = np.array([marked(s) for s in batch.column("splits").to_pylist()]).reshape(batch.num_rows, len(names))
            live = np.flatnonzero(known.any(axis=1))
            sse = [errors(batch.column("m")[i].values.to_numpy().reshape(p + 2, p + 2), (known[i] / known[i].sum())[None], betas)[0] for i in live.tolist()]
            at = pa.array(np.repeat(live, cells))
            yield pa.RecordBatch.from_arrays([batch.column("grp").take(at), batch.column("splits").take(at), pa.array(np.tile(np.arange(cells), len(live)), pa.int32()), pa.array(np.maximum(np.concatenate([np.zeros(0), *sse]), 0))], ["grp", "splits", "cell", "sse"])

    summed = own.select("splits", F.posexplode("m").alias("k", "v")).groupBy("splits", "k").agg(F.sum("v").alias("v"))
    summed = summed.groupBy("splits").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda e: e["v"]).alias("m"))
    summed = summed.join(own.groupBy("splits").agg(F.count(F.lit(1)).alias("groups")), "splits")
    totals = summed.repartition("splits").mapInArrow(of_sets, "at int, cell int, sse double, n long").groupBy("at", "cell").agg(F.sum("sse").alias("all"), F.sum("n").alias("n"))
    numbered = withheld.sparkSession.createDataFrame([(i, s) for i, s in enumerate(sets)], "at int, splits array<int>")
    found = written(withheld.sparkSession, own.select("grp", "m", F.col("splits").cast("array<int>").alias("splits")).mapInArrow(of_groups, f"grp {kind}, splits array<int>, cell int, sse double"), "own-errors")
    named = [F.floor(F.col("cell") / shape[1]).cast("int").alias("alpha"), (F.col("cell") % shape[1]).cast("int").alias("npc")]
    others = found.join(numbered, "splits").join(totals, ["at", "cell"]).where("n > 1")
    return others.select(F.col("grp").alias("g"), *named, F.greatest(F.col("all") - F.col("sse"), F.lit(0.0)).alias("sse")), found.select("grp", *named, "sse")


def _errors_by_predictions(held: DataFrame, withheld: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(g, grp, alpha, npc, sse) of each pair of groups, from held predictions for the dual form: the moments of [y, the splits'
    predictions] in each group and pair of parameters.

    A mean of predictions over any splits has an error that follows from these, so no row of observations x groups is made.
    """
    kind = dict(withheld.dtypes)["grp"]
    vectors = held.groupBy("grp", "alpha", "npc", "obs").agg(F.sort_array(F.collect_list(F.struct("split", "pred"))).alias("e"), F.first("y").alias("y"))
    own = vectors.select("grp", "alpha", "npc", F.transform("e", lambda e: e["split"]).alias("splits"), F.concat(F.transform("e", lambda e: e["pred"]), F.array("y")).alias("z"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("grp", "alpha", "npc")), strict=True))
            for key in dict.fromkeys(keys):
                rows = [i for i, k in enumerate(keys) if k == key]
                z = np.stack([batch.column("z")[i].values.to_numpy() for i in rows])
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], batch.column("grp").type), pa.array([key[1]], pa.int32()), pa.array([key[2]], pa.int32()), batch.column("splits").slice(rows[0], 1), pa.array([(z.T @ z).ravel()], pa.list_(pa.float64()))], ["grp", "alpha", "npc", "splits", "m"])

    parts = own.mapInArrow(partial, f"grp {kind}, alpha int, npc int, splits array<int>, m array<double>")
    cells = parts.select("grp", "alpha", "npc", "splits", F.posexplode("m").alias("k", "v")).groupBy("grp", "alpha", "npc", "splits", "k").agg(F.sum("v").alias("v"))
    summed = cells.groupBy("grp", "alpha", "npc", "splits").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda e: e["v"]).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = len(r["splits"])
                m = np.array(r["m"]).reshape(n + 1, n + 1)
                b = np.array([np.isin(r["splits"], e["splits"]) / max(len(e["splits"]), 1) for e in r["pairs"]])
                sse = np.maximum(m[-1, -1] - 2 * b @ m[:-1, -1] + np.einsum("ei,ij,ej->e", b, m[:-1, :-1], b, optimize=True), 0)
                out = [[e["g"] for e in r["pairs"]], [r["grp"]] * len(sse), [r["alpha"]] * len(sse), [r["npc"]] * len(sse), sse]
                kinds = [batch.column("grp").type, batch.column("grp").type, pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["g", "grp", "alpha", "npc", "sse"])

    return summed.join(_pairs(withheld), "grp").mapInArrow(run, f"g {kind}, grp {kind}, alpha int, npc int, sse double")


def ridge_nested_cv(spark: SparkSession, rows: DataFrame, groups: DataFrame | list[np.ndarray], p: int, alphas: list[float], npcs: list[int | None], n_folds: int = 5, n_reps: int = 20, fit_intercept: bool = True, seed: int = 0, given: tuple[DataFrame, DataFrame] | None = None, dual_form: bool | None = None) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(yhat(obs, yhat), weights at the best pair of all, choices(grp, alpha, npc) with grp -1 for all).

    A group's pair is chosen by the squared errors on every other group, predicted by the splits that withhold both. Errors come
    from moments: of each set of splits and group, or in the dual form of each group, where the choice costs groups x groups.
    """
    member, plan, withheld = _planned(spark, groups, n_folds, n_reps, seed, given)
    shape = (len(alphas), len(npcs))
    if _by_dual(p, dual_form):
        held, weights = _dual_predictions(spark, rows, member, plan, withheld, alphas, npcs, fit_intercept)
        errors = written(spark, _errors_by_predictions(held, withheld, shape), "group-errors")
        others, alone = errors.where("g <> grp").groupBy("g", "alpha", "npc").agg(F.sum("sse").alias("sse")), errors.where("g = grp")
        own = held.groupBy("grp", "obs", "alpha", "npc").agg(F.avg("pred").alias("yhat"))
    else:
        fits = _fits(spark, rows, plan, p, alphas, npcs, fit_intercept)
        weights = fits.average() if fit_intercept else fits.average()[:p]
        others, alone = _errors_by_moments(fits, member, withheld, shape)
        own = None
    first = Window.partitionBy("g").orderBy(F.round("sse", 9), "alpha", "npc")
    chosen = others.withColumn("n", F.row_number().over(first)).where("n = 1").select(F.col("g").alias("grp"), "alpha", "npc")
    every = member.select("grp").distinct()
    chosen = every.join(chosen, "grp", "left").select("grp", F.coalesce("alpha", F.lit(0)).alias("alpha"), F.coalesce("npc", F.lit(0)).alias("npc"))
    chosen = written(spark, chosen, "choices")
    overall = alone.groupBy("alpha", "npc").agg(F.sum("sse").alias("sse")).orderBy(F.round("sse", 9), "alpha", "npc").first()
    best = (overall["alpha"], overall["npc"]) if overall else (0, 0)
    if own is None:
        asked = fits.rows.join(member, "obs").join(chosen, "grp").join(_group_weights(fits, withheld), "grp")
        found = asked.select("obs", (_dot(fits, *shape) + float(fits.mean[p])).alias("yhat"))
    else:
        found = own.join(chosen, ["grp", "alpha", "npc"]).select("obs", "yhat")
    yhat = rows.select("obs").join(found, "obs", "left").withColumn("yhat", F.coalesce("yhat", F.lit(0.0)))
    choices = chosen.unionByName(spark.createDataFrame([(-1, *best)], f"grp {dict(chosen.dtypes)['grp']}, alpha int, npc int"))
    return yhat, weights[:, best[0], best[1]], choices
