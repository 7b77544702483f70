"""Registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm import chat, context_mixing, decontaminate, hard_negatives, line_dedup, mixing
from patchloom.llm import order_minhash, pii, quality, simhash, token_alignment, topk_search, toxicity
from patchloom.llm.oracle import ORACLE
from patchloom.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]

CONTROL_TEXT = "</s>[INST] ok [/INST]"


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)]
    added = spark.createDataFrame(own, "conv_id bigint, turn bigint, role string, text string")
    return chat.digest(chat.format_chats(rows.unionAll(added)))


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.with_surrogates(docs).select("doc_id", "text", "n_entities")


def text_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compared_with_edits(table(spark, sf_dir, "documents"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scored(table(spark, sf_dir, "documents"))


def shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.remove_boilerplate(docs, counts=True).select("doc_id", "n_lines", "n_removed", "text")


def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def toxicity_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.graded(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search_embeddings(table(spark, sf_dir, "embeddings"))


def mined_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.aligned_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_chat_formatting": chat_formatting,
        "op2_source_mixing": source_mixing,
        "op3_pii_surrogates": personal_data,
        "op4_order_minhash": text_fingerprints,
        "op5_quality_classifier": quality_scores,
        "op6_context_mixing": language_model,
        "op7_line_dedup": shared_lines,
        "op8_decontamination": benchmark_hits,
        "op9_simhash": simhash_classes,
        "op10_toxicity": toxicity_grades,
        "op11_topk_search": nearest_vectors,
        "op12_token_alignment": token_links,
        "op13_hard_negatives": mined_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
