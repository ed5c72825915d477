"""A corpus from raw documents to shards: quality, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages read the columns of
`documents` alone and all but the last return just them, so other columns, whatever their names, end with the first
stage. Null and empty texts, repeated rows, missing ids and empty tables are treated as each operator defines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm.common import table
from talkloom.llm.decontamination import without_leaks
from talkloom.llm.mixing import mix
from talkloom.llm.near_dedup import without_near_duplicates
from talkloom.llm.quality_classifier import keep_good
from talkloom.llm.sharding import shuffle_into_shards
from talkloom.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; those it rejects go."""
    return keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words a shingle, similarity of 0.8 or more."""
    return without_near_duplicates(docs.select(*COLUMNS), percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for each use of a document, with the words that it lends."""
    return mix(docs.select(*COLUMNS))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with shard and slot, uniformly shuffled into eight shards."""
    rows = docs.select(*COLUMNS)
    identity = [rows["doc_id"], F.xxhash64(rows["text"]), rows["source"], rows["lang"], rows["n_chars"]]
    out = shuffle_into_shards(rows, identity)
    return out.select("row.*", "shard", F.col("slot").cast("long").alias("slot"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: A fitted classifier has no SQL; tests hold every stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
