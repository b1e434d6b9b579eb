"""Singular value decompositions without products of columns: QR factors merged as a tree, and random range finders.

Squaring a table (its moments, its Gram matrix) squares its condition number. Here every task takes QR factors of its own
rows and hands on R alone; the Rs of FAN tasks are stacked and factored again, level by level, until one is left, which is
the R of all rows.

- Tall tables (at most SMALL columns): the tree runs over rows. R's singular values and right vectors are the table's.
- Wide tables (at most SMALL rows, any number of columns): rows are cut into blocks of columns, and the tree runs over the columns,
  so R belongs to the transposed table.
- Tables large both ways: the leading components by a random range finder. The table, in blocks of columns, is multiplied by random
  columns made where they are needed; a tree of Rs makes the products orthonormal, and a few more rounds through the
  table sharpen them. What is left is a table of few rows.

The driver holds matrices of SMALL x SMALL, or of components x components. Rows and column blocks never come to it.

Defined results: components whose singular value is below 1e-12 of the largest have no vectors (zeros). Signs are such that the entry of
largest size of each right vector is positive (of each left vector, for wide tables). A table without rows has no components. Null and
NaN are not expected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Columns of a tall table and rows of a wide one: an R of so many squared numbers is a worker's and the driver's.
SMALL = 2_048
#: Rs that one merge takes, and columns in a block.
FAN, BLOCK = 8, 512
#: Values in a chunk of rows that a task factors together.
CHUNK = 4_000_000


def dense(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def listed(x: np.ndarray) -> pa.Array:
    """A matrix as a column of arrays."""
    x = np.ascontiguousarray(x, float)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(x.shape[1], 1), np.int32) if x.size else np.zeros(len(x) + 1, np.int32)), pa.array(x.ravel()))


def r_of(x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(x, mode="r") if len(x) else x


def signed(v: np.ndarray) -> np.ndarray:
    """Columns of v with the entry of largest size positive: signs of components are arbitrary."""
    if not v.size:
        return v
    top = np.abs(v).argmax(axis=0)
    return v * np.where(v[top, np.arange(v.shape[1])] < 0, -1.0, 1.0)


def column_means(rows: DataFrame, x: str = "x") -> np.ndarray:
    """Means of the columns of rows(x array of one length): a vector of sums leaves each task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                part = dense(batch, x).sum(axis=0)
                n, total = n + batch.num_rows, part if total is None else total + part
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "total": listed(total[None])})

    parts = rows.select(x).mapInArrow(sums, "n long, total array<double>").select("n", F.posexplode("total").alias("k", "v"))
    found = parts.groupBy("k").agg((F.sum("v") / F.sum("n")).alias("mean")).toArrow()
    out = np.zeros(found.num_rows)
    out[found.column("k").to_numpy()] = found.column("mean").to_numpy()
    return out


def _reduced(parts: DataFrame, tasks: int) -> np.ndarray:
    """The R of all rows r of parts(task, no, r), level by level, on the driver."""
    spark = parts.sparkSession

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, held = None, []

        def close() -> pa.RecordBatch:
            r = r_of(np.concatenate(held))
            return pa.RecordBatch.from_pydict({"task": pa.array(np.full(len(r), to), pa.int32()), "no": pa.array(np.arange(len(r)), pa.int32()), "r": listed(r)})

        for batch in batches:
            key = batch.column("to").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)] if len(key) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and key[a] != to:
                    yield close()
                    held.clear()
                to = key[a]
                held.append(dense(batch.slice(a, b - a), "r"))
                if sum(len(h) for h in held) > 2 * held[0].shape[1]:
                    held[:] = [r_of(np.concatenate(held))]
        if held:
            yield close()

    while tasks > FAN:
        tasks = -(-tasks // FAN)
        dealt = parts.withColumn("to", F.floor(F.col("task") / FAN).cast("int")).repartition(tasks, "to").sortWithinPartitions("to", "task", "no")
        parts = written(spark, dealt.mapInArrow(merge, "task int, no int, r array<double>"), "r-factors")
    last = parts.orderBy("task", "no").toArrow().combine_chunks()
    if not last.num_rows:
        return np.zeros((0, 0))
    return r_of(last.column("r").combine_chunks().flatten().to_numpy().reshape(last.num_rows, -1))


def tall_r(rows: DataFrame, mean: np.ndarray | None = None, x: str = "x") -> np.ndarray:
    """R of rows(x array of one length), less a mean."""

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            m = dense(batch, x)
            step = max(m.shape[1], CHUNK // m.shape[1])
            for i in range(0, len(m), step):
                part = m[i : i + step] if mean is None else m[i : i + step] - mean
                held = r_of(part if held is None else np.concatenate([held, part]))
        if held is not None:
            yield pa.RecordBatch.from_pydict({"task": pa.array(np.full(len(held), TaskContext.get().partitionId()), pa.int32()), "no": pa.array(np.arange(len(held)), pa.int32()), "r": listed(held)})

    parts = written(rows.sparkSession, rows.select(x).mapInArrow(factor, "task int, no int, r array<double>"), "r-factors")
    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    return _reduced(parts, tasks)


def times(rows: DataFrame, matrix: np.ndarray, mean: np.ndarray | None = None, x: str = "x", name: str = "u") -> DataFrame:
    """rows with `name`: x, less a mean, times a matrix of at most SMALL columns that every task gets."""
    shared = rows.sparkSession.sparkContext.broadcast((matrix, mean))
    kept = [c for c in rows.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, mu = shared.value
        for batch in batches:
            out = (dense(batch, x) if mu is None else dense(batch, x) - mu) @ m if batch.num_rows else np.zeros((0, m.shape[1]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], listed(out)], [*kept, name])

    kinds = dict(rows.dtypes)
    return rows.select(*[f"`{c}`" for c in kept]).mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], f"`{name}` array<double>"]))


def inverse_of(s: np.ndarray) -> np.ndarray:
    live = s > 1e-12 * max(s.max(initial=0), 1e-300)
    return np.where(live, 1 / np.where(live, s, 1), 0)


def svd_tall(rows: DataFrame, remove_mean: bool = True) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(rows with `u`, singular values, right vectors) of rows(obs, x)."""
    mean = column_means(rows) if remove_mean else None
    r = tall_r(rows, mean)
    s, v = np.linalg.svd(r)[1:] if r.size else (np.zeros(0), np.zeros((0, 0)))
    v = signed(v[: len(s)].T)
    return times(rows, v * inverse_of(s), mean), s, v


# Blocks of columns


def column_blocks(rows: DataFrame, width: int, block: int = BLOCK, mean: np.ndarray | None = None) -> DataFrame:
    """(block, obs, x): slices of `block` columns of rows(obs, x), less a mean; the last is shorter. A row is cut where it is."""
    if mean is not None:
        rows = less(rows, mean)
    starts = F.sequence(F.lit(0), F.lit(max(0, -(-width // block) - 1)))
    return rows.select("obs", "x", F.explode(starts).alias("block")).select("block", "obs", F.slice("x", F.col("block") * block + 1, F.lit(block)).alias("x"))


def less(rows: DataFrame, mean: np.ndarray) -> DataFrame:
    """(obs, x less a mean)."""
    shared = rows.sparkSession.sparkContext.broadcast(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("obs"), listed(dense(batch, "x") - shared.value)], ["obs", "x"])

    return rows.select("obs", "x").mapInArrow(run, f"obs {dict(rows.dtypes)['obs']}, x array<double>")


def by_block(blocks: DataFrame, work, schema: str) -> DataFrame:
    """work(block, obs, matrix of obs x columns) -> record batches, for each block of columns as a whole, ordered by obs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, obs, held = None, [], []
        for batch in batches:
            key = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)] if len(key) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and key[a] != at:
                    yield from work(int(at), np.concatenate(obs), np.concatenate(held))
                    obs.clear(), held.clear()
                at = key[a]
                part = batch.slice(a, b - a)
                obs.append(part.column("obs").to_numpy(zero_copy_only=False))
                held.append(dense(part, "x"))
        if held:
            yield from work(int(at), np.concatenate(obs), np.concatenate(held))

    return blocks.repartition("block").sortWithinPartitions("block", "obs").mapInArrow(run, schema)


@dataclass
class WideSvd:
    """Left vectors by obs (sorted), singular values, and the right vectors as (block, col, v: an array by component)."""

    obs: np.ndarray
    u: np.ndarray
    s: np.ndarray
    right: DataFrame


def svd_wide(rows: DataFrame, remove_mean: bool = True, block: int = BLOCK) -> WideSvd:
    """Of rows(obs, x) with at most SMALL rows and any number of columns; obs differ."""
    spark = rows.sparkSession
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if n > SMALL:
        raise ValueError(f"more than {SMALL} rows: ask svd_tall, or components by range_finder")
    if not n:
        return WideSvd(np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), spark.createDataFrame([], "block int, col int, v array<double>"))
    blocks = written(spark, column_blocks(rows, width, block), "column-blocks")

    def centred(m: np.ndarray) -> np.ndarray:
        return m - m.mean(axis=0) if remove_mean else m

    def factor(at: int, obs: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        r = r_of(centred(m).T)
        yield pa.RecordBatch.from_pydict({"task": pa.array(np.full(len(r), at), pa.int32()), "no": pa.array(np.arange(len(r)), pa.int32()), "r": listed(r)})

    parts = written(spark, by_block(blocks, factor, "task int, no int, r array<double>"), "r-factors")
    r = _reduced(parts, -(-width // block))
    w, s, _ = np.linalg.svd(r.T, full_matrices=False)
    w = signed(w)
    shared = spark.sparkContext.broadcast(w * inverse_of(s))

    def back(at: int, obs: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        v = centred(m).T @ shared.value
        yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(v), at), pa.int32()), "col": pa.array(at * block + np.arange(len(v)), pa.int32()), "v": listed(v)})

    ids = np.sort(rows.select("obs").toArrow().column("obs").to_numpy())
    return WideSvd(ids, w, s, by_block(blocks, back, "block int, col int, v array<double>"))


def range_finder(rows: DataFrame, components: int, remove_mean: bool = True, extra: int = 10, rounds: int = 3, block: int = BLOCK, seed: int = 0) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(left(obs, u), singular values, right(block, col, v)) of the leading components of rows(obs, x), large both ways.

    Each round goes twice through the table of column blocks: down for rows x random columns, up for columns x rows.
    """
    spark = rows.sparkSession
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    most = min(components + extra, n, width)
    mean = column_means(rows) if remove_mean and n else None
    blocks = written(spark, column_blocks(rows, width, block, mean), "column-blocks")
    kind = dict(rows.dtypes)["obs"]

    def random(at: int, columns: int) -> np.ndarray:
        return np.random.default_rng([seed, at]).normal(size=(columns, most))

    def down_random(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, part in _same_block(batch):
                m = dense(part, "x")
                yield pa.RecordBatch.from_pydict({"obs": part.column("obs"), "y": listed(m @ random(a, m.shape[1]))})

    def summed(parts: DataFrame) -> DataFrame:
        """(obs, y): products of the blocks added up by row."""
        cells = parts.select("obs", F.posexplode("y").alias("k", "v")).groupBy("obs", "k").agg(F.sum("v").alias("v"))
        return cells.groupBy("obs").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda e: e["v"]).alias("y"))  # `most` values

    def orthonormal(y: DataFrame) -> DataFrame:
        """(obs, y) with orthonormal columns, twice, so that rounding leaves them so."""
        for _ in range(2):
            r = tall_r(y, x="y")
            _, s, vt = np.linalg.svd(r)
            y = written(spark, times(y, vt.T * inverse_of(s), x="y", name="q").select("obs", F.col("q").alias("y")), "range")
        return y

    def up(q: DataFrame) -> DataFrame:
        """(block, col, v): the transposed table times q, block by block."""
        joined = blocks.join(q, "obs").sortWithinPartitions("block")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for a, part in _same_block(batch):
                    totals[a] = totals.get(a, 0) + dense(part, "x").T @ dense(part, "y")
                    if len(totals) > 64:
                        yield from sent(totals)
            yield from sent(totals)

        def sent(totals: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, t in totals.items():
                yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(t), a), pa.int32()), "col": pa.array(a * block + np.arange(len(t)), pa.int32()), "v": listed(t)})
            totals.clear()

        parts = joined.mapInArrow(run, "block int, col int, v array<double>").select("block", "col", F.posexplode("v").alias("k", "v"))
        cells = parts.groupBy("block", "col", "k").agg(F.sum("v").alias("v"))
        return written(spark, cells.groupBy("block", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda e: e["v"]).alias("v")), "range-up")

    def down(z: DataFrame) -> DataFrame:
        """(obs, y): the table times z(block, col, v)."""
        packed = z.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "v"))), lambda e: e["v"]).alias("z"))  # `block` columns
        flat = blocks.join(packed.select("block", F.flatten("z").alias("z")), "block")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, part in _same_block(batch):
                    z = part.column("z")[0].values.to_numpy().reshape(-1, most)
                    yield pa.RecordBatch.from_pydict({"obs": part.column("obs"), "y": listed(dense(part, "x") @ z)})

        return summed(flat.mapInArrow(run, f"obs {kind}, y array<double>"))

    if not most:
        return spark.createDataFrame([], f"obs {kind}, u array<double>"), np.zeros(0), spark.createDataFrame([], "block int, col int, v array<double>")
    q = orthonormal(written(spark, summed(blocks.mapInArrow(down_random, f"obs {kind}, y array<double>")), "range"))
    for _ in range(rounds):
        z = up(q)
        q = orthonormal(written(spark, down(z), "range"))
    z = up(q)  # the transposed table, in the rows' leading directions: columns x `most`
    r = tall_r(z, x="v")
    w, s, _ = np.linalg.svd(r.T)
    w, s = signed(w)[:, :components], s[:components]
    left = times(q, w, x="y", name="u").select("obs", "u")
    right = times(z, w * inverse_of(s), x="v", name="w").select("block", "col", F.col("w").alias("v"))
    return left, s, right


def _same_block(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows of one block, of CHUNK values at most."""
    key = batch.column("block").to_numpy()
    cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)] if len(key) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(key[a]), batch.slice(a, b - a)
