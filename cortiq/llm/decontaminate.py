"""Benchmark decontamination by winnowing.

A text's fingerprints are the minimum k-gram hashes of its sliding windows of w k-grams (the rightmost on ties). With
k + w - 1 = SPAN words, each passage of SPAN words that two texts share has a fingerprint in common at the same place
in both, so joining fingerprints finds every such passage; each hit is then extended along its diagonal over the words
that could complete a window. Items shorter than SPAN are one window of all their words: each such length has a scheme
of its own (k = that length, w = 1), at most SPAN - 1 further schemes.

Documents are read once, in one narrow pass, and send on only the fingerprints that pass a bitmap of the benchmark's
fingerprints, of fixed size whatever the benchmark's. These few rows meet the benchmark's fingerprints in an ordinary
equi-join, in which Spark broadcasts, sorts or splits hot keys by size.

Defined results: null or wordless texts have no words, no hits and no items; wordless items never occur; items of equal
text all count; rows of documents that repeat an id and text get equal results; an empty benchmark leaves all clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ROW_KEY, WordIds, grams, keyed_rows, list_array, mapped, without, written

#: Words of a window, and of the k-grams whose hashes are compared.
SPAN, K = 10, 5
#: The bitmap has 2 ** BITS bits (1 MB) at any size of the benchmark.
BITS = 23


def selected(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the minimum of each window of w hashes, the rightmost on ties; each position once."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    w = min(w, n)
    low, at = hashes[: n - w + 1], np.arange(n - w + 1)
    for j in range(1, w):
        later = hashes[j : n - w + 1 + j]
        better = later <= low
        low = np.where(better, later, low)
        at = np.where(better, np.arange(n - w + 1) + j, at)
    return np.unique(at)


def fingerprints(ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of a text of word hashes under the scheme of windows of `length` words; none if it is shorter."""
    if len(ids) < length or length < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    k = K if length >= SPAN else length
    hashes = grams(ids, k) ^ np.uint64(length * 0x9E3779B97F4A7C15 % 2**64)
    at = selected(hashes, length - k + 1)
    return at, hashes[at]


def around(ids: np.ndarray, at: np.ndarray, length: int, edge: int) -> np.ndarray:
    """For each position the words that any window over its k-gram can have; `edge` stands beyond the text."""
    k = K if length >= SPAN else length
    side = length - k
    padded = np.concatenate([np.full(side, edge, np.uint64), ids, np.full(side, edge, np.uint64)])
    return padded[at[:, None] + np.arange(k + 2 * side)]


def _rows(names: tuple[str, ...], lengths: list[int] | None, bitmap: np.ndarray | None, edge: int):
    """A row for each text: its key, its number of words, and parallel lists of length, position, hash and words around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds()
        for batch in batches:
            counts, cols = [], ([], [], [], [])
            for text in batch.column("text"):
                ids = words.of(text.as_py())
                counts.append(len(ids))
                parts: list[list] = [[], [], [], []]
                for length in lengths if lengths is not None else [min(SPAN, len(ids))]:
                    at, fp = fingerprints(ids, length)
                    if bitmap is not None and len(fp):
                        low = fp & np.uint64(2**BITS - 1)
                        keep = bitmap[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1 == 1
                        at, fp = at[keep], fp[keep]
                    if len(fp):
                        context = around(ids, at, length, edge).view(np.int64)
                        for part, x in zip(parts, (np.full(len(at), length), at, fp.view(np.int64), [c.tobytes() for c in context]), strict=True):
                            part.append(x)
                for col, part, empty in zip(cols, parts, (np.int64, np.int64, np.int64, None), strict=True):
                    col.append(sum(part, []) if empty is None else np.concatenate(part) if part else np.zeros(0, empty))
            yield pa.RecordBatch.from_pydict(
                {name: batch.column(name) for name in names}
                | {
                    "n_words": pa.array(counts, pa.int64()),
                    "length": list_array(cols[0], pa.int64()),
                    "at": list_array(cols[1], pa.int64()),
                    "fp": list_array(cols[2], pa.int64()),
                    "context": pa.array(cols[3], pa.list_(pa.binary())),
                }
            )

    return run


def _exploded(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    one = F.explode(F.arrays_zip("length", "at", "fp", "context")).alias("x")
    return rows.select(*names, one).select(*names, "x.length", "x.at", "x.fp", "x.context")


def _bitmap(fps: DataFrame) -> np.ndarray:
    """Bits of the benchmark's fingerprints: at most 2 ** BITS / 64 words of 64 bits come back, however many rows there are."""
    low = F.col("fp").bitwiseAND(F.lit(2**BITS - 1))
    words = fps.select(F.shiftright(low, 6).alias("word"), F.expr(f"shiftleft(1L, CAST((fp & {2**BITS - 1}) & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = words.toPandas()
    out = np.zeros(2**BITS // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined fingerprints -> the windows over them whose words all agree, by their first word's position in the document."""
    for batch in batches:
        length = batch.column("length").to_numpy()
        at = batch.column("at").to_numpy()
        docs, items, starts, lengths = [], [], [], []
        for one in np.unique(length):
            rows = np.flatnonzero(length == one)
            take = pa.array(rows)
            k = K if one >= SPAN else one
            side = int(one - k)
            a, b = (np.frombuffer(b"".join(batch.column(c).take(take).to_pylist()), np.int64).reshape(len(rows), -1) for c in ("context", "item_context"))
            same = np.pad(np.cumsum(a == b, axis=1), ((0, 0), (1, 0)))
            for j in range(side + 1):
                hit = same[:, j + one] - same[:, j] == one
                docs.append(rows[hit])
                starts.append(at[rows[hit]] - side + j)
                lengths.append(np.full(int(hit.sum()), one))
        take = pa.array(np.concatenate(docs) if docs else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_pydict({name: batch.column(name).take(take) for name in (*ROW_KEY, "item_id")} | {"start": np.concatenate(starts) if starts else np.zeros(0, np.int64), "length": np.concatenate(lengths) if lengths else np.zeros(0, np.int64)})


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each document: its ROW_KEY, n_words, hits (starts and lengths of windows found), item_ids (as strings, sorted), n_hit, n_items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    schema = "n_words long, length array<long>, at array<long>, fp array<long>, context array<binary>"
    item_rows = written(spark, mapped(items, _rows(("item_id",), None, None, 1), f"item_id string, {schema}"), "item-fingerprints")
    item_fps = _exploded(item_rows, ("item_id",))
    lengths = sorted(r[0] for r in item_fps.select("length").distinct().collect())  # at most SPAN values
    key = ", ".join(f"{k} long" for k in ROW_KEY)
    doc_rows = mapped(keyed_rows(docs), _rows(ROW_KEY, lengths, _bitmap(item_fps), 0), f"{key}, {schema}")
    doc_rows = written(spark, doc_rows, "doc-fingerprints")
    # Items that share a passage and the words around it meet a document once, with all their ids.
    shared = item_fps.groupBy("fp", "length", "context").agg(F.collect_set("item_id").alias("item_id"))
    hits = _exploded(doc_rows, ROW_KEY).join(shared.select("item_id", "fp", "length", F.col("context").alias("item_context")), ["fp", "length"])
    hits = mapped(hits.select(*ROW_KEY, "item_id", "length", "at", "context", "item_context"), _starts, f"{key}, item_id array<string>, start long, length long")
    windows = hits.groupBy(*ROW_KEY, "start", "length").agg(F.array_distinct(F.flatten(F.collect_set("item_id"))).alias("item_id"))
    by_doc = windows.groupBy(*ROW_KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_id")))).alias("item_ids"), F.collect_set(F.struct("start", "length")).alias("hits"))
    words = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))
    by_doc = by_doc.select(*[F.col(k).alias(f"hit_{k}") for k in ROW_KEY], "item_ids", "hits", F.size(words).cast("long").alias("n_hit"))
    same = [F.col(k).eqNullSafe(F.col(f"hit_{k}")) if k == "doc_id" else F.col(k) == F.col(f"hit_{k}") for k in ROW_KEY]
    joined = doc_rows.select(*ROW_KEY, "n_words").join(by_doc, same, "left")
    none = F.array().cast("array<string>")
    return joined.select(*ROW_KEY, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), "hits", F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"))


def report(found: DataFrame) -> DataFrame:
    """The digest columns of contamination()."""
    ids = F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.greatest("n_items", F.lit(0)).cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, share: float = 0.0) -> DataFrame:
    """docs without those of which more than `share` of the words are hit (by default: any). All columns stay, and so does a clean row whose id a contaminated one has too."""
    return without(docs, contamination(spark, docs, benchmark).where(F.col("n_hit") > share * F.col("n_words")))
