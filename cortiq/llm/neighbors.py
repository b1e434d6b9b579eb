"""Nearest neighbors by inner product, by multi-index hashing of learned binary codes and exact reranking.

1. Rows of equal vectors are one node with its smallest ids, of which as many are kept as a result can hold; so copies of a
   vector, however many, are one code and one query.
2. Codes: vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, which makes the largest inner product the
   smallest angle. Several rotations are learnt on a bounded sample (alternating between signs and the orthogonal
   rotation that fits them best, from different starts), each on the leading principal directions; signs are the bits.
3. Nodes are dealt by hash into shards of about SHARD codes; a task holds one shard and streams a group of queries past it. The
   shard's codes are split into substrings of 16 bits, each with an index from value to codes. A query probes all values
   within w bits of each of its substrings, for w = 0, 1, ...: by the pigeonhole principle every code within
   PARTS (w + 1) - 1 bits has then been seen. It stops when NEAR codes lie in that radius; when the next probes would read
   more index entries than the shard has codes, all codes are measured instead (the same set, cheaper).
4. The radius is that of the NEAR-th code; all codes within it - no cap on ties - are ranked by inner products in double
   precision of the original vectors, and a shard sends its best k + 1. The best over all shards are the result.

The result depends on the vectors and the number of shards, which depends on the number of different vectors alone.

Defined results: vectors null, zero, holding null or non-finite components take no part, nor do rows without an id, nor
vectors of another length than the most frequent one (the shortest of these in a tie). Rows that repeat an id and vector are one;
rows that share an id with other vectors are queries of their own, and no row with the query's id is its neighbor. Ties go to
the smaller vec_id. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import written

K, EVERY = 20, 20
BITS, PART_BITS = 256, 16
PARTS = BITS // PART_BITS
#: Rows that the rotations are learnt from, and their alternations.
TRAIN_ROWS, ROUNDS = 20_000, 30
#: Codes in a shard; codes of a shard within the radius of a query, at least; queries in a group, at most.
SHARD, NEAR, QUERIES = 32_768, 1_024, 16_384
#: Values that differ from a query's by one more bit each time.
MASKS = [np.array([v for v in range(2**PART_BITS) if v.bit_count() == w], np.int64) for w in range(PART_BITS + 1)]
#: A vector is hot if it has more than this share of the queries; so there are at most 1 / HOT_SHARE hot vectors.
HOT_SHARE = 0.001


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part, each once."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0.0))
    width = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    return rows.where(F.size("v") == (width["width"] if width else 0)).distinct()


def nodes_of(spark: SparkSession, rows: DataFrame, asked: Column, k: int) -> DataFrame:
    """(node, v, ids, asked, queries): the k + 1 smallest ids of each different vector, and whether some row of it is a query."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    ids = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    flags = rows.groupBy("v").agg(F.count_if(asked).alias("queries"))
    return written(spark, ids.join(flags, "v").withColumn("node", F.monotonically_increasing_id()), "vectors")


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(norm**2 - (x * x).sum(axis=1), 0))])


def rotations(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(width, bits): the leading principal directions, times rotations that bring vectors near to their signs."""
    value, vector = np.linalg.eigh(x.T @ x)
    use = min(bits, int((value > 1e-9 * value[-1]).sum()))
    base, out = vector[:, ::-1][:, :use], []
    z = x @ base
    for start in range(-(-bits // use)):
        r = np.linalg.qr(np.random.default_rng(start).normal(size=(use, use)))[0]
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(z.T @ np.where(z @ r >= 0, 1.0, -1.0))
            r = u @ w
        out.append(base @ r)
    return np.column_stack(out)[:, :bits]


def learnt(nodes: DataFrame) -> tuple[float, np.ndarray]:
    """The largest norm, and rotations from the TRAIN_ROWS nodes with the smallest hashes."""
    norm = nodes.agg(F.max(F.aggregate("v", F.lit(0.0), lambda t, e: t + e * e))).first()[0]
    some = nodes.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(TRAIN_ROWS).toArrow().column("v").combine_chunks()
    x = some.flatten().to_numpy().reshape(len(some), -1)
    return float(np.sqrt(norm)), rotations(lifted(x, np.sqrt(norm)))


def codes(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, BITS / 64) unsigned 64-bit words of the signs."""
    return np.packbits(x @ planes >= 0, axis=1, bitorder="little").view("<u8")


class Shard:
    """Codes, an index of each of their substrings, and the vectors behind them."""

    def __init__(self, x: np.ndarray, code: np.ndarray):
        self.x, self.code = x, code
        parts = code.view("<u2")
        self.order = [np.argsort(parts[:, j], kind="stable") for j in range(PARTS)]
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(parts[:, j], minlength=2**PART_BITS))]) for j in range(PARTS)]

    def distances(self, code: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
        return np.bitwise_count(self.code[rows] ^ code).sum(axis=1, dtype=np.int64)

    def probed(self, code: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """(rows, their distances, whether by probes alone): all codes within the radius of the near-th one, at least."""
        parts, n = code.view("<u2").astype(np.int64), len(self.code)
        seen, read = [np.zeros(0, np.int64)], 0
        for w, masks in enumerate(MASKS):
            values = [parts[j] ^ masks for j in range(PARTS)]
            begin = [s[v] for s, v in zip(self.starts, values, strict=True)]
            sizes = [s[v + 1] - b for s, v, b in zip(self.starts, values, begin, strict=True)]
            read += sum(int(k.sum()) for k in sizes)
            # Probing costs a lookup for each value as well as an entry for each code.
            if read + len(masks) * PARTS > n:
                break
            for order, b, k in zip(self.order, begin, sizes, strict=True):
                b, k = b[k > 0], k[k > 0]
                seen.append(order[np.repeat(b - np.cumsum(k) + k, k) + np.arange(k.sum())])
            rows = np.unique(np.concatenate(seen))
            seen = [rows]
            distance = self.distances(code, rows)
            if (distance <= PARTS * (w + 1) - 1).sum() >= near:
                return rows, distance, True
        return np.arange(n), self.distances(code, slice(None)), False

    def within(self, code: np.ndarray, near: int = NEAR) -> np.ndarray:
        """Rows of all codes in the smallest radius that holds `near` of them, or all."""
        rows, distance, _ = self.probed(code, near)
        if len(rows) <= near:
            return rows
        return rows[distance <= np.partition(distance, near - 1)[near - 1]]

    def best(self, q: np.ndarray, code: np.ndarray, first: np.ndarray, k: int, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k largest inner products in the radius; ties to the smaller first id."""
        rows = self.within(code, near)
        score = (self.x[rows] * q).sum(axis=1)
        order = np.lexsort((first[rows], -score))[:k]
        return rows[order], score[order]


def _searcher(norm: float, planes: np.ndarray, k: int, near: int):
    """Rows sorted by (shard, grp, query): a shard's vectors come before the queries that ask it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard, first, ids = None, [], None, None, None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "grp", "query")])
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]]) if len(keys) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part, here = batch.slice(a, b - a), tuple(keys[a, :2])
                if here != at:
                    at, held, shard = here, [], None
                if not keys[a, 2]:
                    held.append(part)
                    continue
                if shard is None and held:
                    x = np.concatenate([p.column("v").flatten().to_numpy() for p in held])
                    x = x.reshape(sum(p.num_rows for p in held), -1)
                    ids = pa.chunked_array([p.column("ids") for p in held]).combine_chunks()
                    first = pa.compute.list_element(ids, 0).to_numpy()
                    shard = Shard(x, codes(lifted(x, norm), planes))
                if shard is None:
                    continue
                q = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1)
                asked = codes(np.column_stack([q, np.zeros(len(q))]), planes)  # a query is not lifted: its angle is what counts
                found = [shard.best(v, c, first, k + 1, near) for v, c in zip(q, asked, strict=True)]
                rows = np.concatenate([r for r, _ in found])
                node = np.repeat(part.column("node").to_numpy(), [len(r) for r, _ in found])
                yield pa.RecordBatch.from_pydict({"node": node, "score": np.concatenate([s for _, s in found]), "ids": ids.take(pa.array(rows))})

    return run


def searched(spark: SparkSession, vectors: DataFrame, asked: Column | None = None, k: int = K, near: int = NEAR, shard: int = SHARD, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that `asked`, a condition on vec_id, chooses."""
    asked = F.pmod(F.col("vec_id"), F.lit(EVERY)) == 0 if asked is None else asked
    rows = written(spark, usable(vectors, vec_id, vector), "vector-rows")
    nodes = nodes_of(spark, rows, asked, k)
    sizes = nodes.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("queries") > 0).alias("queries"), F.sum("queries").alias("rows")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes["queries"]:
        return spark.createDataFrame([], schema)
    norm, planes = learnt(nodes)
    shards = -(-sizes["n"] // shard)
    # Groups of queries change the tasks, not the results: as many tasks as there are cores, and QUERIES of them at most.
    cores = spark.sparkContext.defaultParallelism
    groups = max(-(-sizes["queries"] // QUERIES), min(-(-2 * cores // shards), sizes["queries"]))
    key = F.xxhash64("v")
    base = nodes.select(F.pmod(key, F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(0).alias("query"), "node", "v", "ids")
    other = nodes.where("queries > 0").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("node", F.lit(1)), F.lit(groups)).cast("int").alias("grp"), F.lit(1).alias("query"), "node", "v", F.array().cast("array<long>").alias("ids"))
    cells = base.unionByName(other).repartition("shard", "grp").sortWithinPartitions("shard", "grp", "query")
    found = written(spark, cells.mapInArrow(_searcher(norm, planes, k, near), "node long, score double, ids array<long>"), "shard-neighbors")
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), F.col("ids")[0]))
    best = found.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("node").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    best = written(spark, nodes.where("queries > 0").select("node", "v", "queries").join(best, "node"), "nearest-of-vectors")
    return _of_rows(rows.where(asked), best, sizes["rows"], k)


def _of_rows(queries: DataFrame, best: DataFrame, total: int, k: int) -> DataFrame:
    """Each query row's own list. Vectors that many rows ask are joined by a broadcast of at most 1 / HOT_SHARE rows."""
    hot = F.col("queries") > HOT_SHARE * total
    marked = queries.join(F.broadcast(best.where(hot).select("v", F.col("found").alias("hot_found"))), "v", "left")
    # Rows that are done get a key of their own, which finds nothing among the rest.
    spread = F.when(F.col("hot_found").isNull(), F.col("v")).otherwise(F.array(F.col("vec_id").cast("double"), F.lit(float("nan"))))
    rest = best.where(~hot).select(F.col("v").alias("key"), "found")
    joined = marked.select("vec_id", "hot_found", spread.alias("key")).join(rest, "key", "left")
    pairs = F.flatten(F.transform(F.coalesce("hot_found", "found"), lambda e: F.transform(e["ids"], lambda i: F.struct((-e["score"]).alias("away"), i.alias("id")))))
    others = F.slice(F.array_sort(F.filter(pairs, lambda e: e["id"] != F.col("vec_id"))), 1, k)
    listed = joined.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("place", "e"))
    return listed.select("query_id", (F.col("place") + 1).alias("rank"), F.col("e.id").alias("vec_id"), (-F.col("e.away")).alias("score"))
