"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat_format, decontaminate, divergence, exact_dedup, html_text, mixing, neighbors, ngram_join, token_counts, token_files, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table in two batches to one index, the larger ids first, since a text keeps the id that the index has."""
    docs = table(spark, sf_dir, "documents")
    middle = docs.agg(F.expr("min(doc_id) + (max(doc_id) - min(doc_id)) DIV 2")).first()[0]
    later = F.coalesce(F.col("doc_id") > F.lit(middle), F.lit(False))
    index = exact_dedup.DigestIndex(spark, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    for batch in (docs.where(later), docs.where(~later)):
        index.append_new(batch)
    found = index.marked(docs)
    index.forget()
    return found


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(spark, table(spark, sf_dir, "documents"))
    return token_files.read_token_files(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    fold = F.crc32(F.col("doc_id").cast("string")) % toxicity.FOLDS == toxicity.HELD_OUT_FOLD
    scored = toxicity.scores(spark, docs.select("doc_id", "text", "lang"), model)
    return scored.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "toxic_in_lang")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles and rendering of every line of all conversations, written as transcripts in which four turns of five have a
    speaker marker; the model learns from the conversations of three folds of four."""
    turns = chat_format.transcribed(table(spark, sf_dir, "conversations"))
    lines = chat_format.lines_of(turns, ("conv_id", "turn", "role"))
    order = ("turn", "line_no")
    model = chat_format.learnt(lines.where(F.crc32(F.col("conv_id").cast("string")) % 4 != 2), order)
    return chat_format.parsed(spark, lines.drop("role"), model, order)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.calibrated(spark, table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees learn lexical features and counts of suffixes and first path segments from the URLs of the table that a rule decides."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    statistics = url_filter.statistics_of(spark, pages)
    model = url_filter.train(url_filter.labelled_by_rules(pages), rates=False, statistics=statistics)
    found = url_filter.judged(spark, pages, model, statistics=statistics)
    return found.select("page_id", "host", "path", "rule", "verdict", "score")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(spark, table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's tokens, found again in unindexed files; the ids are then looked up by place in the files' indexes."""
    end = 50257  # beyond the vocabulary, so that no text has it
    manifest = token_files.write_token_files(spark, table(spark, sf_dir, "documents"), end_id=end, ordered=False)
    files = manifest.select(F.col("pid").cast("long").alias("file"), "ids_path", "bits", F.col("tokens").alias("n_ids"))
    found = token_counts.documents_in(files, end)
    index = token_files.read_offsets(manifest).select("doc_id", F.col("shard").cast("long").alias("file"), "ordinal", F.col("n_tokens").alias("n_indexed"))
    return found.join(index, ["file", "ordinal"], "full").select("doc_id", "n_tokens", "ended", "n_indexed")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.searched(spark, table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(spark, table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(spark, table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_exact_dedup,
        op3_token_files,
        op4_toxicity,
        op5_chat_format,
        op6_mixing,
        op7_url_filter,
        op8_html_text,
        op9_token_counts,
        op10_ngram_join,
        op11_nearest,
        op12_alignment,
        op13_divergence,
    )
}
SQL = {"op2_exact_dedup": OP2_SQL, "op6_mixing": mixing.oracle(), "op13_divergence": divergence.oracle()}
