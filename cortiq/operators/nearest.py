"""The k nearest of many points: a k-d tree from samples, and boxes to prune by.

1. Targets at one place are one point with its k smallest numbers, so a place that many targets share cannot fill a leaf.
2. The driver splits a bounded sample by medians into a tree; tasks count the targets of each leaf, and leaves with too many
   get further splits from samples of their own. The tree - splits, boxes and counts of at most LEAVES leaves - is all that is broadcast.
3. A point asks its own leaf first; the k-th distance found there bounds what others can hold. Where the leaf has fewer than k
   targets, the bound is the far corner of the lowest box above it that has as many. Walking the tree from its root, the point then asks
   every other leaf whose box is not farther than the bound. No distance beyond that is computed.
4. Points and targets meet by leaf. A leaf's points are cut into parts of PART, each of which meets the leaf's targets, so neither
   dense targets nor dense points meet in one task as a whole.

Defined results: ties go to the smaller target; fewer targets than k give as many as there are; points without a coordinate have no
neighbors, and targets without one are none. Points that repeat p are answered together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Targets in a leaf, about; leaves at most, beyond which they hold more; rows of a sample for each leaf that is split.
LEAF, LEAVES, SAMPLE = 256, 65_536, 32
#: Points of a leaf that a task answers together.
PART = 4_096


@dataclass
class Tree:
    """Nodes by number: axis (-1 for a leaf), cut, first of two children, and the box and count of their targets."""

    axis: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.axis[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            at[inner] = self.child[node] + (x[inner, self.axis[node]] > self.cut[node])

    def near(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The distance of points to boxes."""
        gap = np.maximum(np.maximum(self.low[node] - x, x - self.high[node]), 0)
        return np.sqrt((gap * gap).sum(axis=1))

    def far(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        reach = np.maximum(np.abs(x - self.low[node]), np.abs(x - self.high[node]))
        return np.sqrt((reach * reach).sum(axis=1))

    def others(self, x: np.ndarray, home: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the point, leaf) of the leaves within the bound, but the point's own."""
        who, node, out = np.arange(len(x)), np.zeros(len(x), np.int64), []
        while len(who):
            close = (self.count[node] > 0) & (self.near(x[who], node) <= bound[who] * (1 + 1e-12))
            who, node = who[close], node[close]
            leaf = self.axis[node] < 0
            found = leaf & (node != home[who])
            out.append((who[found], node[found]))
            who, node = np.repeat(who[~leaf], 2), np.repeat(self.child[node[~leaf]], 2) + np.tile([0, 1], int((~leaf).sum()))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2

    def bounds(self, x: np.ndarray, k: int) -> np.ndarray:
        """An upper bound of the k-th distance: the far corner of the lowest box on the way to the leaf that has k targets."""
        at, best = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        active = np.arange(len(x))
        while len(active):
            node = at[active]
            enough = self.count[node] >= k
            best[active[enough]] = np.minimum(best[active[enough]], self.far(x[active[enough]], node[enough]))
            inner = self.axis[node] >= 0
            active, node = active[inner], node[inner]
            at[active] = self.child[node] + (x[active, self.axis[node]] > self.cut[node])
        return best


def _split(sample: np.ndarray, parts: int) -> tuple[list, list, list]:
    """(axis, cut, child) of a tree of about `parts` leaves by medians of the widest axis; child counts from this tree's root."""
    axis, cut, child = [-1], [0.0], [0]
    waiting = [(0, sample, parts)]
    while waiting:
        node, x, n = waiting.pop()
        if n < 2 or len(x) < 2:
            continue
        wide = int((x.max(axis=0) - x.min(axis=0)).argmax())
        at = np.sort(x[:, wide])
        middle = at[(len(at) - 1) // 2]
        if middle == at[-1]:
            smaller = at[at < middle]
            if not len(smaller):
                continue
            middle = smaller[-1]
        axis[node], cut[node], child[node] = wide, float(middle), len(axis)
        axis += [-1, -1]
        cut += [0.0, 0.0]
        child += [0, 0]
        left = x[:, wide] <= middle
        waiting += [(child[node], x[left], n - n // 2), (child[node] + 1, x[~left], n // 2)]
    return axis, cut, child


def _placed(tree_of, rows: DataFrame, names: list[str]) -> DataFrame:
    """rows(names, x, y, z) with the leaf of each."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(k).to_numpy() for k in "xyz"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree_of.value.leaf_of(x))], [*batch.schema.names, "leaf"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*names, "x", "y", "z"])
    return rows.select(*names, "x", "y", "z").mapInArrow(run, schema + ", leaf long")


def tree_of(places: DataFrame, n: int) -> Tree:
    """The tree of n different places(x, y, z)."""
    spark = places.sparkSession
    size = max(LEAF, -(-n // LEAVES))
    wanted = -(-n // size)
    some = lambda df, rows: np.array(df.select("x", "y", "z").orderBy(F.xxhash64("x", "y", "z"), "x", "y", "z").limit(rows).toPandas(), float).reshape(-1, 3)
    axis, cut, child = _split(some(places, SAMPLE * wanted), wanted)
    while True:
        tree = Tree(np.array(axis), np.array(cut), np.array(child), np.zeros((len(axis), 3)), np.zeros((len(axis), 3)), np.zeros(len(axis), np.int64))
        placed = _placed(spark.sparkContext.broadcast(tree), places, [])
        found = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *[f(k).alias(f.__name__ + k) for f in (F.min, F.max) for k in "xyz"]).toPandas()  # a row for each leaf
        full = found[found["n"] > 4 * size]
        if full.empty:
            break
        # The fullest leaves together get a sample of their own, split leaf by leaf.
        leaves = spark.createDataFrame([(int(i),) for i in full["leaf"]], "leaf long")
        rank = F.row_number().over(Window.partitionBy("leaf").orderBy(F.xxhash64("x", "y", "z"), "x", "y", "z"))
        own = placed.join(F.broadcast(leaves), "leaf").withColumn("rank", rank).where(F.col("rank") <= 64 * SAMPLE).toPandas()
        for leaf, n_leaf in zip(full["leaf"], full["n"], strict=True):
            x = own.loc[own["leaf"] == leaf, ["x", "y", "z"]].to_numpy()
            more = _split(x, min(64, -(-int(n_leaf) // size)))
            base = len(axis) - 1  # the new root takes the leaf's place
            axis[leaf], cut[leaf], child[leaf] = more[0][0], more[1][0], more[2][0] + base
            axis += more[0][1:]
            cut += more[1][1:]
            child += [c + base for c in more[2][1:]]
    leaf = found["leaf"].to_numpy()
    tree.low[:], tree.high[:] = np.inf, -np.inf
    tree.low[leaf], tree.high[leaf], tree.count[leaf] = found[["minx", "miny", "minz"]], found[["maxx", "maxy", "maxz"]], found["n"]
    for node in range(len(axis) - 1, -1, -1):  # children come after their parents
        if tree.axis[node] >= 0:
            two = tree.child[node] + np.array([0, 1])
            tree.low[node], tree.high[node], tree.count[node] = tree.low[two].min(axis=0), tree.high[two].max(axis=0), tree.count[two].sum()
    return tree


def _met(asked: DataFrame, targets: DataFrame, k: int, kind_p: str, kind_q: str) -> DataFrame:
    """(p, q, d): for each row of asked(p, x, y, z, leaf) the k nearest in that leaf of targets(leaf, x, y, z, qs)."""
    sizes = asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))  # a row for each leaf
    left = asked.join(F.broadcast(sizes), "leaf").select("leaf", F.pmod(F.xxhash64("p", "x", "y", "z"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), "p", F.array().cast(f"array<{kind_q}>").alias("qs"), "x", "y", "z")
    right = targets.join(F.broadcast(sizes), "leaf").select("leaf", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(0).alias("side"), F.lit(None).cast(kind_p).alias("p"), "qs", "x", "y", "z")
    both = left.unionByName(right).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "side", F.get("qs", F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, places, qs = None, [], None, None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in ("leaf", "part", "side")])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)] if len(keys) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                if tuple(keys[a, :2]) != at:
                    at, held, places = tuple(keys[a, :2]), [], None
                if not keys[a, 2]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if places is None:
                    places = np.concatenate([np.column_stack([h.column(c).to_numpy() for c in "xyz"]) for h in held])
                    qs = [q for h in held for q in h.column("qs").to_pylist()]
                x = np.column_stack([part.column(c).to_numpy() for c in "xyz"])
                p, out = part.column("p"), ([], [], [])
                step = max(1, 2_000_000 // len(places))
                for i in range(0, len(x), step):
                    gap = x[i : i + step, None] - places[None]
                    d = np.sqrt((gap * gap).sum(axis=2))
                    # Places are ordered by their first target; a stable sort keeps ties in that order.
                    first = np.argmin(d, axis=1)[:, None] if k == 1 else np.argsort(d, axis=1, kind="stable")[:, :k]
                    for j, near in enumerate(first, i):
                        rows = sorted((d[j - i, m], q) for m in near for q in qs[m])[:k]
                        out[0].extend([j] * len(rows))
                        out[1].extend(q for _, q in rows)
                        out[2].extend(float(e) for e, _ in rows)
                yield pa.RecordBatch.from_arrays([p.take(pa.array(out[0], pa.int64())), pa.array(out[1], held[0].column("qs").type.value_type), pa.array(out[2], pa.float64())], ["p", "q", "d"])

    return both.mapInArrow(run, f"p {kind_p}, q {kind_q}, d double")


def nearest(points: DataFrame, targets: DataFrame, k: int = 1) -> DataFrame:
    """(p, rank, q, d): the k nearest of targets(q, x, y, z) to each of points(p, x, y, z), rank 1 first."""
    spark = points.sparkSession
    kind_p, kind_q = dict(points.dtypes)["p"], dict(targets.dtypes)["q"]
    whole = "x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL"
    plus = [(F.col(c).cast("double") + 0.0).alias(c) for c in "xyz"]  # -0.0 is 0.0
    targets = targets.where(whole).select("q", *plus)
    order = F.row_number().over(Window.partitionBy(*"xyz").orderBy("q"))
    places = targets.withColumn("n", order).where(F.col("n") <= k).groupBy(*"xyz").agg(F.sort_array(F.collect_list("q")).alias("qs"))  # k at most
    places = written(spark, places, "places")
    n = places.count()
    if not n:
        return spark.createDataFrame([], f"p {kind_p}, rank int, q {kind_q}, d double")
    tree = tree_of(places, n)
    shared = spark.sparkContext.broadcast(tree)
    leaves = written(spark, _placed(shared, places, ["qs"]), "leaves")
    asked = written(spark, _placed(shared, points.where(whole).select("p", *plus), ["p"]), "asked")
    home = written(spark, _met(asked, leaves, k, kind_p, kind_q), "nearest-home")
    kth = home.groupBy("p").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).alias("bound"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy() for c in "xyz"])
            bound = batch.column("bound").to_numpy(zero_copy_only=False).astype(float)
            bound = np.where(np.isnan(bound), t.bounds(x, k), bound)
            who, leaf = t.others(x, batch.column("leaf").to_numpy(), bound)
            some = batch.select(["p", "x", "y", "z"]).take(pa.array(who))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(leaf)], ["p", "x", "y", "z", "leaf"])

    more = asked.join(kth, "p", "left").select("p", "x", "y", "z", "leaf", "bound").mapInArrow(walk, f"p {kind_p}, x double, y double, z double, leaf long")
    found = home.unionByName(_met(written(spark, more, "asked-more"), leaves, k, kind_p, kind_q))
    rank = F.row_number().over(Window.partitionBy("p").orderBy("d", "q"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("p", "rank", "q", "d")
