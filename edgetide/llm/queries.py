"""Registered queries over the operators of this package: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from edgetide.llm import (
    bpe,
    decontaminate,
    htmltext,
    langid,
    linededup,
    quality,
    ranked,
    sharding,
    simhash,
    spelling,
    topk,
    toxicity,
    warc,
)
from edgetide.llm.common import bounded_batches, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_byte_cnn(spark: SparkSession, folder: str) -> DataFrame:
    return quality.document_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.document_shards(table(spark, folder, "documents"))


def op4_template_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.held_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linededup.line_digest(table(spark, folder, "documents"))


def op6_toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.document_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"))


def op3_html_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return htmltext.page_texts(table(spark, folder, "pages"))


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.fingerprint_components(table(spark, folder, "documents"))


def op9_pivot_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_language_spans(spark: SparkSession, folder: str) -> DataFrame:
    return langid.document_languages(table(spark, folder, "documents"))


def op11_best_positions(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_warc_index(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.archived_pages(table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


def _prepared(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(bounded_batches(spark), folder)

    return run


QUERIES: dict[str, Query] = {f.__name__: _prepared(f) for f in (
    op1_byte_cnn, op2_feistel_shards, op3_html_blocks, op4_template_decontamination, op5_line_dedup, op6_toxic_segments,
    op7_byte_bpe, op8_simhash, op9_pivot_topk, op10_language_spans, op11_best_positions, op12_warc_index, op13_spelling_variants)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES: dict[str, str] = {"op5_line_dedup": linededup.LINE_DIGEST_SQL, "op9_pivot_topk": topk.TOP_K_SQL,
                           "op11_best_positions": ranked.RANKED_SQL, "op12_warc_index": warc.WARC_SQL}
