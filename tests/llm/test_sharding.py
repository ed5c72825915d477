"""Exact sizes, repeatability and the law of the shuffle."""

import zlib
from collections import Counter, defaultdict

import numpy as np

from talkloom.llm import sharding as sh

SCHEMA = "doc_id bigint, text string, shard string"


def test_matrix_has_its_sums_and_is_unbiased():
    sizes, parts = sh.shard_sizes(100, 8), [40, 0, 1, 59]
    drawn = np.array([sh.communication_matrix(parts, sizes, seed) for seed in range(2000)])
    assert (drawn.sum(axis=1) == sizes).all() and (drawn.sum(axis=2) == parts).all()
    want = np.outer(parts, sizes) / 100
    assert abs(drawn.mean(axis=0) - want).max() < 0.2
    variance = 40 * (sizes[0] / 100) * (1 - sizes[0] / 100) * (100 - 40) / 99
    assert abs(drawn[:, 0, 0].var() - variance) < 0.3
    rng = np.random.default_rng(1)
    large = np.array([sh._large_draw(rng, np.array([2_000_000_000, 1_000_000_000]), 300) for _ in range(200)])
    assert (large.sum(axis=1) == 300).all() and abs(large[:, 0].mean() - 200) < 3


def test_documents_fill_shards(spark):
    docs = [(i, f"text {i}", "clash") for i in range(1000)] + [(i, "same", None) for i in range(1000, 1500)]
    docs += [(None, None, None), (None, None, None), (7, "text 7", "clash"), (8, "", ""), (9, "é" * 10_000, "")]
    frame = spark.createDataFrame(docs, SCHEMA)
    got = sh.document_shards(frame).collect()
    again = sh.document_shards(frame.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in docs
    )
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert sorted(slots) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_small_and_empty_tables(spark):
    assert sh.document_shards(spark.createDataFrame([], SCHEMA)).count() == 0
    got = sh.document_shards(spark.createDataFrame([(1, "a", ""), (2, "b", "")], SCHEMA)).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(0, 0), (1, 0)]


def test_places_are_uniform(spark):
    frame = spark.range(64).selectExpr("id as doc_id", "string(id) as text")
    sums = np.zeros(64)
    for seed in range(12):
        for r in sh.document_shards(frame, n_shards=2, seed=1000 + 17 * seed).collect():
            sums[r["doc_id"]] += r["shard"]
    assert sums.sum() == 12 * 32 and 30 < ((sums - 6) ** 2 / 3).sum() < 110  # about 64 if each shard is as likely
