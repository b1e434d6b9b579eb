"""Exact dedup against a persistent index of digests, bucketed and sorted by hash; DataFrame operations only.

The index is an external Parquet table (digest, keep_id, copies, first), CLUSTERED and SORTED BY digest. A batch is first
reduced to one row for each digest (partial aggregation, so a group of any size sends one row for each task). Digests
that a sort-merge anti-join does not find in the index, in which only the batch is shuffled, are appended as `first`
rows; for those it finds, the batch's number of copies is appended beside them, so counts go on without rewriting.

Defined results: a null text counts as empty, and empty texts equal each other; of equal texts in a batch the largest
doc_id stays (a null id only if all are null); a text that the index already has keeps the index's id, and a row that
comes again with that id is that document. group_size counts the text's rows in all batches so far. Rows that repeat
both text and id are one document: all are marked alike. An empty batch appends nothing. Further columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import passing, shared_path, written

#: A digest is hot if it has more than this share of the rows; so there are at most 1 / HOT_SHARE hot digests.
HOT_SHARE = 0.001


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class DigestIndex:
    """An index at `path`, made when absent from the catalog; opening the same path again goes on with what it has. Without a path it goes with the driver."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 12):
        self.spark, self.path, self.passing = spark, path or shared_path(spark, "digest-index"), path is None
        self.buckets = buckets
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, keep_id BIGINT, copies BIGINT, first BOOLEAN) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def forget(self) -> None:
        """Leave the catalog; the files stay as long as their folder does."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def rows(self) -> DataFrame:
        """A row for each digest: keep_id and the copies of all batches. The buckets hold a digest's rows together, so nothing is shuffled."""
        return self.spark.table(self.table).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))

    def reduced(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        batch = docs.select(F.col(doc_id).cast("long").alias("id"), digest(F.col(text)).alias("digest")).groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
        return written(self.spark, batch, "digests")  # else Spark moves the anti-join below the partial aggregation

    def append_new(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        batch = self.reduced(docs, doc_id, text)
        known = self.spark.table(self.table).where("first").select("digest").hint("merge")
        fresh = batch.join(known, "digest", "left_anti").withColumn("first", F.lit(True))
        again = batch.join(known, "digest", "left_semi").select("digest", F.lit(None).cast("long").alias("keep_id"), "copies", F.lit(False).alias("first"))
        added = fresh.select("digest", "keep_id", "copies", "first").unionByName(again)
        (
            added.repartition(self.buckets, "digest")
            .sortWithinPartitions("digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)
        if self.passing:
            passing(self.spark, self.path)

    def marked(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256) of each row of docs, whose texts the index must have.

        Digests that are hot among docs are joined by a broadcast of at most 1 / HOT_SHARE rows; the rest by a sort-merge join.
        """
        here = self.reduced(docs, doc_id, text).select("digest", F.col("copies").alias("here"))
        marks = written(self.spark, here.join(self.rows().hint("merge"), "digest"), "marks")
        total = marks.agg(F.sum("here")).first()[0] or 0
        hot = marks.where(F.col("here") > HOT_SHARE * total)
        keyed = docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("digest"))
        heavy = F.broadcast(hot.select("digest", F.col("keep_id").alias("hot_id"), F.col("copies").alias("hot_copies")))
        tagged = keyed.join(heavy, "digest", "left")
        # Rows of hot digests are done; a key of their own spreads them over the tasks and finds nothing among the others.
        spread = F.when(F.col("hot_copies").isNull(), F.col("digest")).otherwise(F.concat(F.lit("hot-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        rare = marks.where(F.col("here") <= HOT_SHARE * total).select(F.col("digest").alias("key"), "keep_id", "copies")
        joined = tagged.withColumn("key", spread).join(rare.hint("merge"), "key", "left").withColumn("keep_id", F.when(F.col("hot_copies").isNull(), F.col("keep_id")).otherwise(F.col("hot_id")))
        return joined.select(
            "doc_id",
            "keep_id",
            F.coalesce("hot_copies", "copies").alias("group_size"),
            F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )


def exact_duplicates(spark: SparkSession, docs: DataFrame, index: DigestIndex | None = None, buckets: int | None = None) -> DataFrame:
    """Append the batch to the index (a new one if none is given) and mark each of its documents."""
    index = index or DigestIndex(spark, buckets=buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    index.append_new(docs)
    return index.marked(docs)
