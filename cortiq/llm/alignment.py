"""How the tokens of two tokenizers correspond: groups between common cuts, links of overlapping tokens, and their counts.

1. A task encodes its texts by both tokenizers and keeps the ids, and a hash of the groups, as a table: the texts are read and
   encoded once. Many texts are handled as one run of bytes: token ends are cumulative sums of byte lengths, common cuts
   their intersection, and a token's group is the number of cuts before its end (searchsorted).
2. A token of A overlaps a range of tokens of B; repeats of the ranges are the links. Tasks count id pairs and send sorted
   partial counts; these are added in two shuffles, the first of which also deals by the sender (salt), so that a pair of
   which every task has some never meets in one task as often as there are tasks times flushes.
3. The TABLE pairs of the largest counts are broadcast as sorted arrays (a bound by definition: 4.5 MB), and a task looks its links
   up there. Links of other pairs leave it as one row for each document and pair and are joined with the counts. So frequent
   pairs, which nearly all documents have, are never shuffled with documents, and no pair is dropped.

Ids must be below 2^31; a pair is one 64-bit number. Texts longer than CHUNK are a chunk of their own.

Defined results: a text that is null or empty, or whose tokens by either tokenizer do not spell a space and the text byte for byte
(a U+2581 that the piece tokenizer reads as a space, say), has no tokens: zeros and ''. Special tokens' strings in texts are plain
text. Rows that repeat an id or text are documents of their own, in the counts as well. Null ids stay. Further columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import small_or_not, written
from .token_files import _LETTERS, Encoder, default_tokenizer

#: Bytes of text that are aligned together, pairs that a task counts before it sends them on, and pairs whose counts are broadcast.
CHUNK, TASK_PAIRS, TABLE = 1_000_000, 400_000, 2**18
#: Dealings of partial counts before they meet by pair.
SALTS = 16
#: Meta symbol of the piece tokenizer: a space.
_SPACE = "▁"
ENCODED = "row_no long, doc_id long, a binary, b binary, n_a long, n_b long, n_groups long, groups_sha256 string"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def lengths(spelt: list[bytes]) -> np.ndarray:
    return np.array([len(s) for s in spelt], np.int64)


class ByteTokens:
    """Ids of space+text by a byte-level BPE; special tokens' strings are plain text."""

    def __init__(self, path: str):
        self.encoder = Encoder(path, 0)
        self.encoder.tokenizer.encode_special_tokens = True
        letters = {c: b for b, c in _LETTERS.items()}
        names = {i: s for s, i in self.encoder.tokenizer.get_vocab(with_added_tokens=True).items()}
        special = {i for i, t in self.encoder.tokenizer.get_added_tokens_decoder().items()}
        self.spelt = [names.get(i, "").encode() if i in special else bytes(letters.get(c, 0) for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.sizes = lengths(self.spelt)
        # With a token for each byte, merges alone and no normalizer, the tokens of a text always spell it.
        self.lossless = self.encoder.by_pieces and set(_LETTERS.values()) <= set(names.values())

    def spells(self, ids: np.ndarray, whole: bytes) -> bool:
        return self.sizes[ids].sum() == len(whole) and (self.lossless or b"".join(map(self.spelt.__getitem__, ids.tolist())) == whole)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(self.encoder.encode(" " + t), self.encoder.kind).astype(np.int64) for t in texts]


class PieceTokens:
    """Ids of a text by a piece BPE that adds the leading space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.spelt = [bytes([int(s[3:5], 16)]) if self.model.is_byte(i) else s.replace(_SPACE, " ").encode() for i, s in enumerate(names)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in A, place in B) of all tokens that overlap, from the ends of both over the same bytes."""
    first = np.searchsorted(b, np.concatenate([[0], a[:-1]]), "right")
    n = np.searchsorted(b, a, "left") - first + 1
    left = np.repeat(np.arange(len(a)), n)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def group_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(common cuts, the group of each token of A, and of B)."""
    cuts = np.intersect1d(a, b, assume_unique=True)
    return cuts, np.searchsorted(cuts, a), np.searchsorted(cuts, b)


class Speller:
    """The text `a1,a2|b1;a3|b2` of groups, by a table of each id with what follows it."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a = n_a
        said = [f"{i}{end}".encode() for ends, n in ((",|", n_a), (",;", n_b)) for i in range(n) for end in ends]
        self.size = lengths(said)
        self.letters = np.zeros((len(said), int(self.size.max())), np.uint8)
        self.filled = np.arange(self.letters.shape[1]) < self.size[:, None]
        self.letters[self.filled] = np.frombuffer(b"".join(said), np.uint8)

    def codes(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> np.ndarray:
        """Rows of the table in the order of the text: a group's tokens of A, then of B."""
        last_a = np.append(group_a[1:] != group_a[:-1], True)
        last_b = np.append(group_b[1:] != group_b[:-1], True)
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = 2 * a + last_a
        out[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = 2 * (self.n_a + b) + last_b
        return out

    def texts(self, codes: np.ndarray, ends: np.ndarray) -> Iterator[memoryview]:
        """The texts of codes up to each end, without the sign after the last group."""
        flat = memoryview(self.letters[codes][self.filled[codes]])
        at = np.concatenate([[0], np.cumsum(self.size[codes])])[np.concatenate([[0], ends])]
        for begin, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield flat[begin : max(begin, end - 1)]


def chunks(sizes: list[int], limit: int = CHUNK) -> Iterator[slice]:
    """Slices of neighbors whose sizes add up to `limit` at most, or of one."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def id_type(vocabulary: int) -> str:
    """The unsigned type of stored ids."""
    return "<u2" if vocabulary <= 2**16 else "<u4"


@lru_cache(maxsize=1)
def tools_for(tokenizer: str, pieces: str) -> tuple[ByteTokens, PieceTokens, Speller]:
    """The worker's own, kept from task to task."""
    one, two = ByteTokens(tokenizer), PieceTokens(pieces)
    return one, two, Speller(len(one.spelt), len(two.spelt))


def _encoder(tokenizer: str, pieces: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        one, two, speller = None, None, None
        # A task's rows are numbered below its own block of numbers.
        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            if one is None:
                one, two, speller = tools_for(tokenizer, pieces)
                long_a, long_b = lengths(one.spelt), lengths(two.spelt)
            column = batch.column("text")
            sizes = pa.compute.fill_null(pa.compute.binary_length(column.cast(pa.binary())), 0).to_pylist()
            for some in chunks(sizes):
                part = batch.slice(some.start, some.stop - some.start)
                texts = part.column("text").to_pylist()
                n = len(texts)
                ids: list = [(np.zeros(0, np.int64),) * 2] * n
                asked = [i for i in range(n) if texts[i]]
                said = [texts[i] for i in asked]
                for i, text, a, b in zip(asked, said, one.ids(said), two.ids(said), strict=True):
                    whole = b" " + text.encode()
                    if one.spells(a, whole) and b"".join(map(two.spelt.__getitem__, b.tolist())) == whole:
                        ids[i] = (a, b)
                a, b = (np.concatenate([x[k] for x in ids]) for k in (0, 1))
                ends_a, ends_b = np.cumsum(long_a[a]), np.cumsum(long_b[b])
                cuts, group_a, group_b = group_labels(ends_a, ends_b)
                codes = speller.codes(a, b, group_a, group_b)
                n_a, n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
                upto = np.concatenate([[0], np.searchsorted(cuts, ends_a[np.cumsum(n_a) - 1], "right")]) if len(a) else np.zeros(n + 1, np.int64)
                upto[1:][np.cumsum(n_a) == 0] = 0  # texts before the first token
                shas = [hashlib.sha256(x).hexdigest() if len(x) else "" for x in speller.texts(codes, np.cumsum(n_a + n_b))]
                yield pa.RecordBatch.from_pydict({"row_no": pa.array(np.arange(at, at + n)), "doc_id": part.column("doc_id"), "a": pa.array([x[0].astype(id_type(len(long_a))).tobytes() for x in ids], pa.binary()), "b": pa.array([x[1].astype(id_type(len(long_b))).tobytes() for x in ids], pa.binary()), "n_a": n_a, "n_b": n_b, "n_groups": np.diff(upto), "groups_sha256": shas})
                at += n

    return run


def _linked(batch: pa.RecordBatch, long_a: np.ndarray, long_b: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, pair of each link, row of each link), a chunk at a time."""
    sizes = [len(x) if x else 0 for x in batch.column("a").to_pylist()]
    for some in chunks(sizes):
        part = batch.slice(some.start, some.stop - some.start)
        a, b = ([np.frombuffer(x, id_type(len(size))).astype(np.int64) for x in part.column(k).to_pylist()] for k, size in (("a", long_a), ("b", long_b)))
        row = np.repeat(np.arange(len(a)), [len(x) for x in a])
        a, b = np.concatenate(a), np.concatenate(b)
        left, right = links(np.cumsum(long_a[a]), np.cumsum(long_b[b])) if len(a) else (np.zeros(0, np.int64),) * 2
        yield part, a[left] << 32 | b[right], row[left]


def _counter(long_a: np.ndarray, long_b: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, links_of, _ in _linked(batch, long_a, long_b):
                new, n = np.unique(links_of, return_counts=True)
                pairs, at = np.unique(np.concatenate([pairs, new]), return_inverse=True)
                old, counts = np.concatenate([counts, n]), np.zeros(len(pairs), np.int64)
                np.add.at(counts, at, old)
                if len(pairs) > TASK_PAIRS:
                    yield pa.RecordBatch.from_pydict({"pair": pairs, "n": counts})
                    pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_pydict({"pair": pairs, "n": counts})

    return run


def _summer(long_a: np.ndarray, long_b: np.ndarray, table):
    """For each document what its links of broadcast pairs add up to, and the others as arrays of (pair, how often)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = table.value
        for batch in batches:
            for part, links_of, row in _linked(batch, long_a, long_b):
                n = part.num_rows
                at = np.minimum(np.searchsorted(pairs, links_of), max(len(pairs) - 1, 0))
                known = pairs[at] == links_of if len(pairs) else np.zeros(len(links_of), bool)
                # Whole numbers beyond 2^53 would not survive weights of floats.
                n_best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
                np.add.at(n_best, row[known], best[at[known]].astype(np.int64))
                np.add.at(total, row[known], counts[at[known]])
                rest_row, rest_pair = row[~known], links_of[~known]
                order = np.lexsort((rest_pair, rest_row))
                rest_row, rest_pair = rest_row[order], rest_pair[order]
                new = np.flatnonzero(np.append(True, (rest_row[1:] != rest_row[:-1]) | (rest_pair[1:] != rest_pair[:-1]))) if len(rest_row) else np.zeros(0, np.int64)
                often = np.diff(np.append(new, len(rest_row)))
                ends = np.searchsorted(rest_row[new], np.arange(n + 1)).astype(np.int32)
                lists = {k: pa.ListArray.from_arrays(pa.array(ends), pa.array(v, pa.int64())) for k, v in (("rest", rest_pair[new]), ("often", often))}
                yield pa.RecordBatch.from_pydict({k: part.column(k) for k in ("row_no", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")} | {"n_links": np.bincount(row, minlength=n).astype(np.int64), "n_best": n_best, "count_sum": total} | lists)

    return run


def encoded(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, pieces: str | None = None) -> DataFrame:
    """A table of ENCODED: the ids of both tokenizers as 16- or 32-bit numbers, and each document's groups."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(spark, rows.mapInArrow(_encoder(tokenizer or default_tokenizer(), pieces or default_pieces()), ENCODED), "two-encodings")


def byte_lengths(tokenizer: str | None = None, pieces: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    return lengths(ByteTokens(tokenizer or default_tokenizer()).spelt), lengths(PieceTokens(pieces or default_pieces()).spelt)


def pair_counts(spark: SparkSession, rows: DataFrame, sizes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(pair, n, best) of all id pairs (A's id times 2^32, plus B's): links, and whether no pair of its B id has more."""
    parts = rows.select("a", "b").mapInArrow(_counter(*sizes), "pair long, n long").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    counts = written(spark, parts.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    of_b = F.col("pair").bitwiseAND(F.lit(2**32 - 1))
    most = written(spark, counts.groupBy(of_b.alias("b")).agg(F.max("n").alias("most")), "best-counts")  # at most B's vocabulary
    return written(spark, counts.join(small_or_not(most), of_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counted-pairs")


def aligned(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, pieces: str | None = None, table: int = TABLE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of docs(doc_id, text)."""
    sizes = byte_lengths(tokenizer, pieces)
    rows = encoded(spark, docs, tokenizer, pieces)
    counts = pair_counts(spark, rows, sizes)
    head = counts.orderBy(F.desc("n"), "pair").limit(table).toArrow()  # `table` rows of corpus counts
    order = np.argsort(head.column("pair").to_numpy())
    shared = spark.sparkContext.broadcast(tuple(head.column(k).to_numpy()[order] for k in ("pair", "n", "best")))
    parts = rows.mapInArrow(_summer(*sizes, shared), "row_no long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long, rest array<long>, often array<long>")
    parts = written(spark, parts, "document-links")
    rest = parts.where("size(rest) > 0").select("row_no", F.explode(F.arrays_zip("rest", "often")).alias("e")).select("row_no", F.col("e.rest").alias("pair"), F.col("e.often").alias("often"))
    more = rest.join(counts, "pair").groupBy("row_no").agg(F.sum(F.when(F.col("best"), F.col("often")).otherwise(F.lit(0))).alias("more_best"), F.sum(F.col("often") * F.col("n")).alias("more_sum"))
    found = parts.join(more, "row_no", "left")
    plus = lambda one, two: (F.col(one) + F.coalesce(two, F.lit(0))).alias(one)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256")
