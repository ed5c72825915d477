"""Token counts through a cache of content digests.

Texts are normalised (null becomes empty; the tokenizer sees every other byte, so nothing else may be changed),
digested together with the tokenizer's version, and joined to a stored table of counts. Only distinct digests that the
table lacks are encoded; their counts are appended to it, and all rows read their counts from there."""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.llm.common import utf8_length

CACHE_SCHEMA = "tokenizer string, digest string, n_tokens bigint"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_version(path: str) -> str:
    """The file's own digest: another file is another version, whatever its name."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def content_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _json_counter(path: str):
    """Counts as the tokenizers library gives them for a .json file.

    Where the same vocabulary also lies beside it as ranks, tiktoken counts with them, which gives the same numbers
    (tests compare the two) at a fifth of the time; texts that it can't take go to the tokenizers library."""

    @functools.lru_cache(maxsize=1)
    def tokenizer():  # loaded only where it is used: every worker of an executor holds its own
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        return found

    slow = lambda text: len(tokenizer().encode(text, add_special_tokens=False))
    twin = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(twin):
        return slow
    import public_tokenizers
    import tiktoken

    with open(twin, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    with open(path, encoding="utf-8") as file:
        special = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def count(text: str) -> int:
        try:
            return len(encoding.encode(text, allowed_special="all"))
        except BaseException as error:  # a panic of the native code is no Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return slow(text)

    return count


@functools.lru_cache(maxsize=2)
def counter(path: str):
    """A function from a text to its number of tokens; loaded once in a worker."""
    if path.endswith(".json"):
        return _json_counter(path)
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: len(processor.encode(text))


def encode_counts(misses: DataFrame, path: str) -> DataFrame:
    """digest, n_tokens of distinct (digest, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            counts = pa.array((count(text.as_py()) for text in batch.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), counts], ["digest", "n_tokens"])

    return misses.select("digest", "text").mapInArrow(run, "digest string, n_tokens bigint")


def read_cache(spark, cache_dir: str) -> DataFrame:
    """The stored counts; an empty table before the first append."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_dir)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_dir)


def append_misses(docs: DataFrame, cache_dir: str, tokenizer: str, text: str = "text") -> None:
    """Encode the distinct contents of `docs` that the cache lacks for this tokenizer's version and append them.

    What a failed run has committed is known to the next one, which encodes only what is still missing; so a digest is
    stored once as long as one writer at a time appends to a cache."""
    path = tokenizer_path(tokenizer)
    version = tokenizer_version(path)
    known = read_cache(docs.sparkSession, cache_dir).where(F.col("tokenizer") == version).select("digest")
    body = F.coalesce(F.col(text), F.lit(""))
    distinct = docs.select(content_digest(F.col(text)).alias("digest"), body.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(known, "digest", "left_anti")
    counts = encode_counts(misses, path).select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
    counts.write.mode("append").parquet(cache_dir)


def token_counts(docs: DataFrame, cache_dir: str, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of `docs` (doc_id, text).

    Null and empty texts have no tokens. Repeated rows and rows without an id are each counted; other columns, whatever
    their names, are ignored. An empty table gives an empty result. Special strings inside a text count as the
    tokenizer's library counts them by default; nothing is added, cut or padded."""
    append_misses(docs, cache_dir, tokenizer)
    version = tokenizer_version(tokenizer_path(tokenizer))
    # a digest is stored once, so the cache side needs no aggregate and the join splits a digest that very many rows share
    cache = read_cache(docs.sparkSession, cache_dir).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    rows = docs.select("doc_id", utf8_length(F.col("text")).alias("n_bytes"), content_digest(F.col("text")).alias("digest"))
    found = rows.join(cache, "digest", "left")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
