"""The corpus pipeline: toxic documents go, one of each group of near copies stays, contaminated documents go, sources are
mixed to target weights, and the rest is written as token files. run() returns the last stage's rows.

Defined results, for every stage: a row is known by its id and its text, so rows that share an id (or have none) with other
texts are judged each for itself; an empty table gives no rows; all columns, whatever their names, come out as they went in
(the last stage has its own); null and empty texts are never toxic by a filter that finds nothing in them unless the language's
threshold says so, are no copies, are not contaminated, keep their cell's probability, and have the end id alone as tokens. Rows
that repeat id and text are one document to the near copies: one of them stays. Labels of toxicity that repeat an id count as
toxic if one does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cortiq.llm import decontaminate, mixing, ngram_join, token_files, toxicity
from cortiq.llm._shared import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs less those at or above their language's threshold; scores are kept apart from a table's columns of their names."""
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    own = {c: next(n for n in (f"{c}_{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns) for c in ("score", "toxic_in_lang") if c in docs.columns}
    scored = toxicity.scores(spark, docs.withColumnsRenamed(own), model)
    return scored.where(~F.col("toxic_in_lang")).select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each class of links at a similarity of 0.8 or more: the smallest id (null last), then text hash."""
    return ngram_join.one_of_each(spark, docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that have a window of a benchmark's item."""
    return decontaminate.decontaminated(spark, docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs sampled by probabilities that meet the marginals of source, language and topic; a row by its own cell."""
    return mixing.mixed_documents(spark, docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row in the files, rows without an id first."""
    return token_files.read_token_files(token_files.write_token_files(spark, docs)).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near copies", near_copies_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token files", token_stage),
]

#: The classifier is outside SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and reread."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
