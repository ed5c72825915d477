"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from talkloom.llm import decontamination, media, merkle, mixing, near_dedup, oracles, prefix_trie, quality_classifier, secret_scan, sharding, toxicity, url_filters, warc
from talkloom.llm import token_counts as tokens
from talkloom.llm.common import table
from talkloom.session import ensure_checkpoint_dir


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_pages(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both derivatives of every page, with their whole blocks."""
    return warc.derivatives(warc.page_responses(table(spark, sf_dir, "pages")), ["page_id"])


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in which a benchmark item is found, with the items."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), fresh_folder(spark, "token-cache"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_report(table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_url_filters": (op1_url_filters, None),
    "op2_toxicity": (op2_toxicity, None),
    "op3_mixing": (op3_mixing, None),
    "op4_near_dedup": (op4_near_dedup, oracles.OP4),
    "op5_warc": (op5_warc, None),
    "op6_sharding": (op6_sharding, None),
    "op7_decontamination": (op7_decontamination, None),
    "op8_quality": (op8_quality, None),
    "op9_media": (op9_media, None),
    "op10_token_counts": (op10_token_counts, None),
    "op11_merkle": (op11_merkle, oracles.OP11),
    "op12_secret_scan": (op12_secret_scan, oracles.OP12),
    "op13_prefix_trie": (op13_prefix_trie, oracles.OP13),
}
