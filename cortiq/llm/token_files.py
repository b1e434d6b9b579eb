"""Token ids as flat little-endian unsigned files, with 64-bit document offsets beside them.

Ids take 16 bits where the vocabulary and the end id allow it, else 32; the manifest says which.

Documents are range-partitioned and sorted by doc_id; each task encodes its range and streams it into one ids file and
one offsets file (begin and end of each document inside the shard). A row for each shard goes to the manifest, whose
prefix sum over shards gives every partition its base: a document's global start is that base plus its local offset.
Names hold a random part for each attempt and only the files of attempts that succeeded are in the manifest, so a
lost executor or a speculative task leaves nothing that is read. Files are read by memory map where the store is local.

Defined results: a null text is encoded as an empty one, so it has the end id alone; null ids come first; rows that
repeat an id stand next to each other, in an order fixed by their text; an empty table gives an empty manifest. Encodings
are those of the library with add_special_tokens=False and nothing else set: a special token's string in a text becomes
its id. Further columns are ignored.
"""

from __future__ import annotations

import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import mapped, passing, shared_path, written

#: Pieces of text whose ids a worker keeps; a full cache is emptied.
CACHE_PIECES = 200_000
#: Letters and numbers among the characters up to U+024F.
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Texts of printable ASCII, tabs, line ends and Latin letters: there `re` has the same classes as the tokenizer's own split.
#: Other texts are encoded whole.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u024f]*").fullmatch
#: Fixed value: the split of byte-level BPE before its merges, over those characters.
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+").findall
#: Byte-level BPE spells printable bytes as themselves and the others as the letters from U+0100 on, in order.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LETTERS = {b: chr(b) for b in _SEEN} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(0x100) if b not in _SEEN)}
#: Array codes of unsigned integers by bits.
_CODES = {16: "H", 32: "I"}
MANIFEST = "pid int, ids_path string, offsets_path string, bits int, docs long, tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder(dict):
    """text -> bytes of its ids, through a bounded cache of split pieces: a byte-level BPE never merges across the split.

    A new piece goes straight to the tokenizer's BPE model, spelt in the letters that stand for bytes there; this skips what
    the library does for offsets. Tokenizers of another make, texts outside _PLAIN, and texts with the string of an added
    token (special or not), take the library's whole encoding.
    """

    def __init__(self, tokenizer: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        kind = repr(self.tokenizer.pre_tokenizer)
        self.by_pieces = kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind and self.tokenizer.normalizer is None
        self.bits = 16 if max(self.tokenizer.get_vocab_size() - 1, end_id) < 2**16 else 32
        self.kind = f"<u{self.bits // 8}"
        self.model = self.tokenizer.model
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.has_added = re.compile("|".join(added)).search if added else lambda text: None

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        spelt = piece.encode().decode("latin-1").translate(_LETTERS)
        ids = array(_CODES[self.bits], [t.id for t in self.model.tokenize(spelt)])
        if sys.byteorder == "big":
            ids.byteswap()
        found = self[piece] = ids.tobytes()
        return found

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not (self.by_pieces and _PLAIN(text)) or self.has_added(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, _SPLIT(text)))


@lru_cache(maxsize=1)
def encoder_for(tokenizer: str, end_id: int) -> Encoder:
    """The worker's own, kept from task to task: loading a vocabulary for each task leaves memory in pieces."""
    return Encoder(tokenizer, end_id)


def _open(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store, path


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, name, at, docs, sinks = None, None, 0, 0, []
        pid = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            if encoder is None:
                encoder, name = encoder_for(tokenizer, end_id), f"{folder}/shard-{pid:06d}-{uuid.uuid4().hex}"
                end, size = np.array([end_id], encoder.kind).tobytes(), encoder.bits // 8
                store, path = _open(name)
                store.create_dir(path.rpartition("/")[0], recursive=True)
                sinks = [store.open_output_stream(path + ending) for ending in (".ids", ".offsets")]
            ends = []
            for text in batch.column("text"):
                ids = encoder.encode(text.as_py()) + end
                sinks[0].write(ids)
                ends.append((at, at + len(ids) // size))
                at = ends[-1][1]
            ids = batch.column("doc_id").cast(pa.int64())
            valid = ids.is_valid().to_numpy(zero_copy_only=False)
            record = np.zeros((batch.num_rows, 4), "<i8")
            record[:, 0], record[:, 1], record[:, 2:] = ids.fill_null(0).to_numpy(), valid, ends
            sinks[1].write(record.tobytes())
            docs += batch.num_rows
        if encoder is not None:
            for sink in sinks:
                sink.close()
            yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "ids_path": [name + ".ids"], "offsets_path": [name + ".offsets"], "bits": pa.array([encoder.bits], pa.int32()), "docs": [docs], "tokens": [at]})

    return write


def write_token_files(spark: SparkSession, docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 2, shards: int | None = None, ordered: bool = True) -> DataFrame:
    """Encode docs (doc_id, text) into files below `folder`; the manifest, a row for each shard with its `base`.

    Without `ordered` nothing is shuffled: each input partition becomes a shard, in the order it has.
    """
    own = not folder
    folder = folder or shared_path(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if ordered:
        rows = rows.repartitionByRange(shards or int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("doc_id").asc_nulls_first())
        rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    manifest = written(spark, mapped(rows, _writer(folder, tokenizer or default_tokenizer(), end_id), MANIFEST), "manifest")
    if own and manifest.limit(1).count():
        passing(spark, folder)
    # As many rows as shards: the number of output partitions bounds this window, not the documents.
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))


def ranged(uri: str, kind: str, begin: int, end: int) -> np.ndarray:
    """The values [begin, end) of a file, reading no more than these."""
    from pyarrow import fs

    store, path = _open(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r", begin * np.dtype(kind).itemsize, (end - begin,)) if end > begin else np.zeros(0, kind)
    with store.open_input_file(path) as f:
        f.seek(begin * np.dtype(kind).itemsize)
        return np.frombuffer(f.read((end - begin) * np.dtype(kind).itemsize), kind)


def _reader(rows: int = 5_000):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                for i in range(0, shard["docs"], rows):
                    part = np.array(ranged(shard["offsets_path"], "<i8", i * 4, min(i + rows, shard["docs"]) * 4)).reshape(-1, 4)
                    first = int(part[0, 2])
                    ids = ranged(shard["ids_path"], f"<u{shard['bits'] // 8}", first, int(part[-1, 3]))
                    crc = [zlib.crc32(ids[a - first : b - first].astype("<u4").tobytes()) for a, b in part[:, 2:].tolist()]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(part[:, 0], mask=part[:, 1] == 0), "start": part[:, 2] + shard["base"], "n_tokens": part[:, 3] - part[:, 2], "ids_crc32": pa.array(crc, pa.int64()), "shard": pa.array([shard["pid"]] * len(part), pa.int32()), "ordinal": pa.array(np.arange(i, i + len(part)), pa.int64())})

    return read


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard, ordinal in the shard) of every document in the files; a task for each few shards."""
    shards = manifest.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "pid")
    return shards.mapInArrow(_reader(), "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, ordinal long")


def _offsets(rows: int = 50_000):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                for i in range(0, shard["docs"], rows):
                    part = np.array(ranged(shard["offsets_path"], "<i8", i * 4, min(i + rows, shard["docs"]) * 4)).reshape(-1, 4)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(part[:, 0], mask=part[:, 1] == 0), "start": part[:, 2] + shard["base"], "n_tokens": part[:, 3] - part[:, 2], "shard": pa.array([shard["pid"]] * len(part), pa.int32()), "ordinal": pa.array(np.arange(i, i + len(part)), pa.int64())})

    return read


def read_offsets(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, shard, ordinal) of every document, from the offsets alone: no id is read."""
    shards = manifest.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "pid")
    return shards.mapInArrow(_offsets(), "doc_id long, start long, n_tokens long, shard int, ordinal long")
