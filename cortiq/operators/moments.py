"""Second moments of rows, in one pass and with partial sums in every task: what the linear models are fitted from.

Rows never meet in one task. A task adds up Z'WZ for its rows; the sums, of a size that depends on the number of columns
alone, are then added up by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Groups that a task adds up before it sends their sums on.
HELD = 64


def moments(rows: DataFrame, width: int, weights: str | None = None) -> DataFrame:
    """(split, m) of rows(z array of `width`[, weights map<int, int>]): m is the packed width x width matrix of weighted products.

    Without weights there is one split, 0. With them a row counts in each split of its map as often as that says.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            if weights is None:
                total[0] = total.get(0, 0) + z.T @ z
                continue
            maps = batch.column(weights)
            sizes = np.diff(np.asarray(maps.offsets))
            row = np.repeat(np.arange(batch.num_rows), sizes)
            lo, hi = maps.offsets[0].as_py(), maps.offsets[-1].as_py()
            split, w = maps.keys.to_numpy()[lo:hi], maps.items.to_numpy()[lo:hi]
            for s in np.unique(split):
                at = split == s
                part = z[row[at]]
                total[int(s)] = total.get(int(s), 0) + (part * w[at, None]).T @ part
        yield pa.RecordBatch.from_pydict({"split": pa.array(list(total), pa.int32()), "m": pa.array([m.ravel() for m in total.values()], pa.list_(pa.float64()))})

    columns = ["z"] if weights is None else ["z", weights]
    return _summed(rows.select(*columns).mapInArrow(partial, "split int, m array<double>"), "split")


def group_moments(rows: DataFrame, width: int, key: str) -> DataFrame:
    """(key, m) of rows(key, z array of `width`): the moments of each group's rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), kind), pa.array([m.ravel() for m in total.values()], pa.list_(pa.float64()))], [key, "m"])
            total.clear()
            return out

        for batch in batches:
            kind = batch.column(key).type
            coded = batch.column(key).dictionary_encode()
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            order = np.argsort(code, kind="stable")
            for name, at in zip(names, np.split(order, np.cumsum(np.bincount(code, minlength=len(names)))[:-1]), strict=True):
                part = z[at]
                total[name] = total.get(name, 0) + part.T @ part
                if len(total) >= HELD:
                    yield sent()
        if total:
            yield sent()

    return _summed(rows.select(key, "z").mapInArrow(partial, f"`{key}` {dict(rows.dtypes)[key]}, m array<double>"), key)


def _summed(parts: DataFrame, key: str) -> DataFrame:
    values = parts.select(key, F.posexplode("m").alias("k", "value")).groupBy(key, "k").agg(F.sum("value").alias("value"))
    return values.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda e: e["value"]).alias("m"))


def matrix(df: DataFrame, width: int, split: int = 0) -> np.ndarray:
    """The matrix of one split on the driver: width x width numbers."""
    found = df.where(F.col("split") == split).select("m").first()
    return np.zeros((width, width)) if found is None else np.array(found["m"]).reshape(width, width)
