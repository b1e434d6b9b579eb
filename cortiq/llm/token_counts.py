"""Token counts by scanning flat, unindexed token files for the end-of-document id.

Files are cut into blocks of a fixed number of ids, wherever that falls, and dealt out over the tasks. A task maps its block
and finds all separators by one vectorised comparison. Documents that lie across blocks are stitched by a prefix scan
over the blocks of a file: the running maximum of the last separator gives where a block's first document began, the
running sum of separators gives its ordinal. A task reads its block alone, by map or by a range read.

Defined results: separators next to each other end documents of one token; ids after the last separator of a file are an
unterminated document (`ended` false); empty files have no documents; a file without separators is one such document;
no files give no rows. Further columns of files are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import small_or_not, written
from .token_files import ranged

#: Ids in a block.
BLOCK = 2**21


def _scan(separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = ranged(row["ids_path"], f"<u{row['bits'] // 8}", row["begin"], row["end"])
                at = np.flatnonzero(block == separator).astype(np.int64) + row["begin"]
                starts = np.concatenate([[0], at[:-1] + 1]) if len(at) else at
                carried = np.arange(len(at)) == 0  # where the block's first document began is not known here
                same = {n: pa.array(np.full(len(at), row[n])) for n in ("file", "begin")}
                yield pa.RecordBatch.from_pydict(same | {"i": np.arange(len(at)), "at": at, "start": pa.array(starts, pa.int64(), mask=carried)})

    return run


def documents_in(files: DataFrame, separator: int, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended) of each document of files (file, ids_path, bits, n_ids); start counts from the file's begin, n_tokens has the separator."""
    spark = files.sparkSession
    files = files.select(F.col("file").cast("long").alias("file"), "ids_path", "bits", F.col("n_ids").cast("long").alias("n_ids"))
    cut = files.where("n_ids > 0").select("file", "ids_path", "bits", "n_ids", F.explode(F.expr(f"sequence(0L, CAST((n_ids - 1) DIV {block} AS BIGINT))")).alias("k"))
    cut = cut.select("file", "ids_path", "bits", (F.col("k") * block).alias("begin"), F.least((F.col("k") + 1) * block, F.col("n_ids")).alias("end"))
    # Ten bytes or so for each document; a block that is lost is scanned again, and the table has each block once.
    found = written(spark, cut.repartition("file", "begin").mapInArrow(_scan(separator), "file long, begin long, i long, at long, start long"), "separators")
    before = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    # The prefix scan has a row for each block with separators.
    sums = written(spark, found.groupBy("file", "begin").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last")), "blocks")
    carry = sums.select("file", "begin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(before) + 1, F.lit(0)).alias("carried"))
    start = F.coalesce("start", "carried")
    ended = found.join(small_or_not(carry), ["file", "begin"]).select("file", (F.col("base") + F.col("i")).cast("long").alias("ordinal"), start.alias("start"), (F.col("at") + 1 - start).alias("n_tokens"), F.lit(True).alias("ended"))
    totals = sums.groupBy("file").agg(F.sum("n").cast("long").alias("ordinal"), (F.max("last") + 1).alias("start"))
    rest = files.select("file", "n_ids").join(totals, "file", "left").select("file", F.coalesce("ordinal", F.lit(0)).cast("long").alias("ordinal"), F.coalesce("start", F.lit(0)).cast("long").alias("start"), "n_ids").where("start < n_ids")
    return ended.unionByName(rest.select("file", "ordinal", "start", (F.col("n_ids") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended")))
