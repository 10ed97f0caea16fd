"""From raw documents to token ids: language, repeated lines, near-duplicates, benchmark leaks, tokens.

Every stage takes (spark, docs, sf_dir), works on all documents that the stage before it kept, and returns a DataFrame that
is written as Parquet and read again as the next stage's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.llm import bpe, decontaminate, langid, linededup, simhash
from edgetide.llm.common import bounded_batches, fresh, table
from edgetide.session import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter have no language and go."""
    return langid.accepted_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more hold are taken out; every document stays, if only with an empty text."""
    return linededup.cleaned_documents(docs, threshold=10)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return simhash.one_per_group(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, also where its numbers, names or units were changed."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"), decontaminate.held)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids (little-endian unsigned 32-bit), with digests of ids and of the bytes decoded from them."""
    coded = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"))
    data = fresh(coded.columns, "data")
    return coded.withColumn(data, bpe.decoded(F.col("ids"))).select(
        "doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(data, 256).alias("decoded_sha256"))


def _bounded(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(bounded_batches(spark), docs, sf_dir)

    return run_stage


STAGES = [(stage.__name__, _bounded(stage)) for stage in (language, lines, near_duplicates, benchmark_leaks, tokens)]
ORACLE_SQL = None  # language models, fingerprints and token ids are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
