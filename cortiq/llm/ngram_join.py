"""Jaccard self-join of documents on sets of five-word shingles, with Bayesian pruning of candidates.

1. Each text becomes a set of shingle hashes, a digest of the set and BANDS band keys of ROWS MinHash values. Documents
   of equal sets are one node from here on, weighted by their number, so copies never multiply.
2. Nodes that share a band key are candidates. A pair at the threshold shares no key with probability
   (1 - 0.8 ** ROWS) ** BANDS = 5e-5, and less the more alike it is. Candidates are dealt out as units, in the cheaper of
   two ways for each connected group of buckets: the group as a whole (near copies, which share nearly all keys), or
   bucket by bucket, where a pair is compared only in the first band that it shares (texts that a chain of chance keys
   ties together). So the pairs compared are never more than those of the buckets.
3. A unit is cut into pairs of blocks of about BLOCK nodes, or fewer long ones, so no task holds a unit, however large. In a task the pairs
   of its two blocks are compared by MinHash values a step at a time; a pair is dropped when the posterior probability
   (uniform prior) that its similarity reaches the threshold is below TOLERANCE. The others are verified exactly on the
   sets. Links are counted in the task and leave it as one row for each node, never as a row for each pair.
4. Ties keep linked nodes connected. Blocks are compared with themselves first, and a node is tied to the smallest one that it
   reaches in its block, its head. Two different blocks then tie heads only, and no more of them than connect: in a group of n near copies
   that are n ties and at most one for each pair of blocks.

Defined results: texts of one to four words are one shingle; null and wordless texts are nodes without links, each its
own class. Rows that repeat an id share its class if their texts do; n_copies and n_links count rows. Rows without an id
are linked like others; a class of such rows alone has a null class_id. one_of_each keeps one row of each class: the
smallest id (a null one only if no other), then the smallest text hash, then the smallest hash of the row's other columns.
Columns beyond doc_id and text are ignored by near_duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ROW_KEY, WordIds, counted, grams, keyed_rows, list_array, mapped, matching, mixed, runs, small_or_not, without, written
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
#: MinHash values compared before each look at the posterior, and the probability below which a pair is dropped.
STEP, TOLERANCE = 25, 1e-6
#: Nodes in a block, and shingles in it (8 bytes each), on average; a task holds two blocks at a time.
BLOCK, BLOCK_SHINGLES = 128, 250_000
#: A group is dealt as a whole if its pairs, times this, are at most those of its buckets.
WHOLE_COST = 1.0

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 2**32, HASHES, np.uint32)[:, None]
_ODD = _rng.integers(0, 2**31, HASHES, np.uint32)[:, None] * np.uint32(2) + np.uint32(1)


def shingle_set(ids: np.ndarray) -> np.ndarray:
    return np.unique(grams(ids, SHINGLE))


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set that is not empty."""
    low = np.full(HASHES, 2**32 - 1, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(low, ((x[i : i + 1024] ^ _XOR) * _ODD).min(axis=1), out=low)
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mixed(key * np.uint64(0xC2B2AE3D27D4EB4F) + sig[j::ROWS])
    return key


def least_matches(n: int) -> int:
    """The fewest of n equal MinHash values at which a pair stays: the posterior is P(Binomial(n + 1, threshold) <= matches)."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)
        if total >= TOLERANCE:
            return m
    return n


_LEAST = {n: least_matches(n) for n in range(STEP, HASHES + 1, STEP)}


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordIds()
    for batch in batches:
        sizes, ones, twos, bands = [], [], [], []
        for text in batch.column("text"):
            s = shingle_set(words.of(text.as_py()))
            sizes.append(len(s))
            ones.append(int(mixed(s).sum(dtype=np.uint64).astype(np.int64)))
            twos.append(int(mixed(s ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64).astype(np.int64)))
            bands.append(band_keys(signature(s)).view(np.int64) if len(s) else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in ROW_KEY} | {"size": pa.array(sizes, pa.int64()), "one": pa.array(ones, pa.int64()), "two": pa.array(twos, pa.int64()), "bands": list_array(bands, pa.int64())})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordIds()
    for batch in batches:
        # Rows that repeat an id and text have one node; a batch sends it once, and a block counts it once.
        seen: set[int] = set()
        new = [i for i, n in enumerate(batch.column("node").to_pylist()) if n not in seen and not seen.add(n)]
        batch = batch.take(pa.array(new, pa.int64()))
        found = [shingle_set(words.of(t.as_py())) for t in batch.column("text")]
        yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in ("node", "copies", "units")} | {"shingles": pa.array([s.tobytes() for s in found], pa.binary()), "sig": pa.array([signature(s).tobytes() if len(s) else b"" for s in found], pa.binary())})


def linked_pairs(sets: list[np.ndarray], sigs: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (left[i], right[i]), those that Bayesian pruning keeps and exact verification confirms."""
    sizes = np.array([len(s) for s in sets])
    near = np.minimum(sizes[left], sizes[right]) * 5 >= np.maximum(sizes[left], sizes[right]) * 4
    left, right = left[near], right[near]
    matches = np.zeros(len(left), np.int32)
    for n in range(0, HASHES, STEP):
        matches += (sigs[left, n : n + STEP] == sigs[right, n : n + STEP]).sum(axis=1, dtype=np.int32)
        keep = matches >= _LEAST[n + STEP]
        left, right, matches = left[keep], right[keep], matches[keep]
    order = np.argsort(left, kind="stable")
    left, right = left[order], right[order]
    good = np.zeros(len(left), bool)
    bounds = runs(left)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        mine, others = sets[left[a]], [sets[r] for r in right[a:b]]
        flat = np.concatenate(others)
        at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        starts = np.cumsum([0] + [len(o) for o in others[:-1]])
        shared = np.add.reduceat((mine[at] == flat).astype(np.int64), starts)
        good[a:b] = shared * 5 >= (len(mine) + np.array([len(o) for o in others]) - shared) * 4
    return left[good], right[good]


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest index that it reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def first_shared_band(sigs: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The first band in which each pair agrees in all ROWS values."""
    return (sigs[left] == sigs[right]).reshape(len(left), BANDS, ROWS).all(axis=2).argmax(axis=1)


def _compared(rows: list[dict]) -> list[tuple]:
    """(unit, band, node, tie, links) of each node with links among the rows of one pair of blocks of one unit; two different
    blocks tie heads, in rows without links, and their nodes have no tie."""
    rows = sorted({r["node"]: r for r in rows}.values(), key=lambda r: r["node"])
    if len(rows) < 2:
        return []
    nodes, blocks = np.array([r["node"] for r in rows]), np.array([r["block"] for r in rows])
    left, right = np.triu_indices(len(rows), 1)
    if rows[0]["i"] != rows[0]["j"]:
        asked = blocks[left] != blocks[right]
        left, right = left[asked], right[asked]
    sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
    sigs = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint32).reshape(len(rows), HASHES)
    if (band := rows[0]["band"]) >= 0:
        asked = np.concatenate([first_shared_band(sigs, left[k : k + 65_536], right[k : k + 65_536]) == band for k in range(0, len(left), 65_536)] or [np.zeros(0, bool)])
        left, right = left[asked], right[asked]
    left, right = linked_pairs(sets, sigs, left, right)
    copies = np.array([r["copies"] for r in rows])
    links = np.bincount(left, copies[right], len(rows)) + np.bincount(right, copies[left], len(rows))
    has = np.flatnonzero(links)
    at, counts = (rows[0]["unit"], band), links[has].astype(np.int64).tolist()
    if rows[0]["i"] == rows[0]["j"]:
        ties = nodes[_roots(len(rows), left, right)[has]].tolist()
        return [(*at, *x) for x in zip(nodes[has].tolist(), ties, counts, strict=True)]
    heads, head = np.unique(np.array([r["head"] for r in rows]), return_inverse=True)
    root = _roots(len(heads), head[left], head[right])
    tied = np.flatnonzero(root != np.arange(len(heads)))
    return [(*at, node, None, n) for node, n in zip(nodes[has].tolist(), counts, strict=True)] + [(*at, a, b, 0) for a, b in zip(heads[tied].tolist(), heads[root[tied]].tolist(), strict=True)]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (unit, band, i, j): one pair of blocks is held at a time."""
    rows: list[dict] = []
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pydict({n: pa.array([x[k] for x in out], pa.int32() if n == "band" else pa.int64()) for k, n in enumerate(("unit", "band", "node", "tie", "links"))})
        out.clear()
        return made

    def close() -> None:
        out.extend(_compared(rows))
        rows.clear()

    for batch in batches:
        for row in batch.to_pylist():
            if rows and any(row[k] != rows[0][k] for k in ("unit", "band", "i", "j")):
                close()
                if len(out) > 10_000:
                    yield flush()
            rows.append(row)
    if rows:
        close()
    yield flush()


def _units(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(node, units) of the nodes with candidates; units is an array of (unit, band, blocks, block), band -1 for a whole group."""
    banded = nodes.select("node", "size", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("tie"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")).where("n > 1")
    buckets = written(spark, buckets, "shingle-buckets")
    members = written(spark, banded.join(buckets, "key").select("node", "size", "band", "key", "tie", "n", "shingles"), "bucket-members")
    groups = components(spark, members.where("node <> tie").select(F.col("node").alias("src"), F.col("tie").alias("dst")).distinct())
    pairs = lambda n: n * (n - 1) / 2.0
    alone = buckets.join(groups.select(F.col("node").alias("tie"), "component"), "tie").groupBy("component").agg(F.sum(pairs(F.col("n"))).alias("alone"))
    each = groups.join(nodes.select("node", F.col("size").alias("of_node")), "node")
    sizes = written(spark, each.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("of_node").alias("shingles")).join(alone, "component"), "group-sizes")
    chosen = groups.join(sizes, "component").select("node", "component", "size", "shingles", (pairs(F.col("size")) * WHOLE_COST <= F.col("alone")).alias("whole"))
    chosen = written(spark, chosen, "groups")
    whole = chosen.where("whole").select("node", F.col("component").alias("unit"), F.lit(-1).alias("band"), F.col("size").alias("n"), "shingles")
    apart = members.join(chosen.where("NOT whole").select("node"), "node").select("node", F.col("key").alias("unit"), "band", "n", "shingles")
    # No more blocks than nodes: a block of one long text is as small as it gets.
    blocks = F.least(F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)), F.col("n"))
    units = whole.unionByName(apart).withColumn("blocks", blocks.cast("int"))
    units = units.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks").cast("long")).cast("int"))
    return units.groupBy("node").agg(F.collect_list(F.struct("unit", "band", "blocks", "block")).alias("units"))  # at most BANDS


def _linked(spark: SparkSession, dealt: DataFrame) -> DataFrame:
    """(unit, band, node, tie, links) of rows dealt to pairs of blocks (i, j)."""
    dealt = dealt.repartition("unit", "band", "i", "j").sortWithinPartitions("unit", "band", "i", "j")
    return written(spark, mapped(dealt, _compare, "unit long, band int, node long, tie long, links long"), "links")


def _links(spark: SparkSession, sets: DataFrame) -> DataFrame:
    """_linked of all pairs of blocks: each block and itself, then different ones, whose rows carry their heads."""
    placed = sets.withColumn("u", F.explode("units")).select("node", "copies", "shingles", "sig", "u.*")
    own = _linked(spark, placed.select("*", F.col("block").alias("i"), F.col("block").alias("j"), F.col("node").alias("head")).drop("blocks"))
    apart = placed.where("blocks > 1")
    parts = apart.select("unit", "band").distinct()
    heads = own.join(small_or_not(*counted(spark, parts, "units-of-blocks")), ["unit", "band"], "left_semi").select("unit", "band", "node", F.col("tie").alias("head"))
    apart = apart.join(small_or_not(*counted(spark, heads, "heads")), ["unit", "band", "node"], "left").withColumn("head", F.coalesce("head", "node"))
    apart = apart.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).where("other <> block")
    apart = apart.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    return own.unionByName(_linked(spark, apart))


def _classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """For each row: ROW_KEY, the class and copy ids, counts, and `chosen`: whether its key is the class's first."""
    docs = keyed_rows(docs)
    key = ", ".join(f"{k} long" for k in ROW_KEY)
    keyed = written(spark, mapped(docs, _keys, f"{key}, size long, one long, two long, bands array<long>"), "shingle-keys")
    digest = ["size", "one", "two"]
    first = F.struct(F.col("doc_id").isNull().alias("none"), *ROW_KEY)
    nodes = keyed.where("size > 0").groupBy(*digest).agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    nodes = written(spark, nodes.withColumn("node", F.monotonically_increasing_id()), "shingle-nodes")  # numbers are fixed by writing them

    units = _units(spark, nodes)
    wanted, n = counted(spark, nodes.select("node", "copies", "first").join(units, "node"), "group-members")
    firsts = [F.col(f"first.{k}").alias(f"first_{k}") for k in ROW_KEY]
    same = [F.col(k).eqNullSafe(F.col(f"first_{k}")) if k == "doc_id" else F.col(k) == F.col(f"first_{k}") for k in ROW_KEY]
    # Three numbers a row may be broadcast to leave the other texts where they are; what a row has to carry is joined by size.
    texts = docs.join(small_or_not(wanted.select(*firsts), n), same, "left_semi").join(wanted.select("node", "copies", "units", *firsts), same).select("node", "copies", "units", "text")
    unit = "array<struct<unit:bigint,band:int,blocks:int,block:int>>"
    sets = written(spark, mapped(texts, _sets, f"node long, copies long, units {unit}, shingles binary, sig binary"), "shingle-sets")
    found = _links(spark, sets)

    classes = components(spark, found.where("tie IS NOT NULL").select(F.col("node").alias("src"), F.col("tie").alias("dst")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labelled = nodes.select(*digest, "node", "copies", "first").join(classes, "node", "left").join(links, "node", "left").withColumn("class", F.coalesce("component", "node"))
    heads = classes.join(nodes.select("node", "first"), "node").groupBy(F.col("component").alias("class")).agg(F.min("first").alias("head"))
    labelled = labelled.join(small_or_not(*counted(spark, heads, "class-heads")), "class", "left").withColumn("head", F.coalesce("head", "first"))
    labelled = labelled.select(*digest, "head", F.col("first.doc_id").alias("copy_id"), F.col("copies").alias("n_copies"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = keyed.select(*ROW_KEY, *digest)
    chosen = F.struct(F.col("doc_id").isNull().alias("none"), *ROW_KEY).eqNullSafe(F.col("head"))
    worded = rows.where("size > 0").join(written(spark, labelled, "shingle-classes"), digest).select(*ROW_KEY, F.col("head.doc_id").alias("class_id"), "copy_id", "n_copies", "n_links", chosen.alias("chosen"))
    empty = rows.where("size = 0").select(*ROW_KEY, F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("boolean").alias("chosen"))
    return worded.unionByName(empty)


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, class_id (the smallest id that links reach), copy_id (the smallest id of an equal set), n_copies, n_links (other documents at the threshold or above)."""
    return _classes(spark, docs).select("doc_id", "class_id", "copy_id", "n_copies", "n_links")


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with one row of each class; all columns stay."""
    rows = written(spark, _classes(spark, docs).select(*ROW_KEY, "n_copies", "chosen"), "classes")
    kept = without(docs, rows.where("NOT chosen"))
    # Rows that repeat id and text are one key: the few such keys among the chosen lose all rows but one.
    again = rows.where("chosen AND n_copies > 1").groupBy(*ROW_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again, n = counted(spark, again, "repeated")
    if not n:
        return kept
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    repeated = matching(kept, again, "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(*hashed).alias("order"), F.col("doc_id").cast("long").alias("id"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("digest"))
    return without(kept, again).unionByName(repeated.groupBy("id", "digest").agg(F.min_by("row", "order").alias("row")).select("row.*"))
