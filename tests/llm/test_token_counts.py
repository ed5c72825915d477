"""Counts against the tokenizers library, and the cache."""

import random

import pytest

from talkloom.llm import token_counts as tc
from talkloom.llm.queries import fresh_folder

PATH = tc.tokenizer_path("byte_bpe_50k.json")


def library_count(text):
    from tokenizers import Tokenizer

    library_count.tokenizer = getattr(library_count, "tokenizer", None) or Tokenizer.from_file(PATH)
    return len(library_count.tokenizer.encode(text, add_special_tokens=False))


def test_counts_equal_the_library(spark):
    rng = random.Random(4)
    odd = ["", " ", "a<|endoftext|>b <|endoftext|>", "it's I'LL", "  \n\n x ", "१२३ ½", "😀👨‍👩‍👧", "\x00\x01a\x85b", "x" * 3000, "ab " * 3000]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0, 0x300), rng.randrange(0xE000, 0x20000)])) for _ in range(12)) for _ in range(3000)]
    count = tc.counter(PATH)
    assert [count(t) for t in odd] == [library_count(t) for t in odd]
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert [count(t) for t in texts] == [library_count(t) for t in texts]


def test_edges_and_reuse_of_the_cache(spark):
    folder = fresh_folder(spark, "cache-test")
    docs = spark.createDataFrame(
        [(1, "one two", "x"), (1, "one two", "x"), (None, None, None), (3, "", "y"), (4, "one two", "z")], "doc_id bigint, text string, n_tokens string"
    )
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tc.token_counts(docs, folder, limit=1).collect())
    n = library_count("one two")
    assert got == [(False, 1, 7, n, n > 1), (False, 1, 7, n, n > 1), (False, 3, 0, 0, False), (False, 4, 7, n, n > 1), (True, None, 0, 0, False)]
    assert tc.read_cache(spark, folder).count() == 2
    more = spark.createDataFrame([(9, "one two"), (10, "three")], "doc_id bigint, text string")
    assert tc.token_counts(more, folder).count() == 2
    assert tc.read_cache(spark, folder).count() == 3
    assert tc.token_counts(docs.limit(0), folder).count() == 0
    assert tc.read_cache(spark, folder).count() == 3


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(name):
    assert tc.counter(tc.tokenizer_path(name))("a small test") > 0
