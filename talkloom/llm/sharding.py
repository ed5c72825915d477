"""A uniform shuffle into shards of exact sizes.

Rows lie in logical partitions (by a seeded hash of their content). How many rows each partition sends to each shard is
drawn from the exact law of a uniform shuffle, the multivariate hypergeometric one: a small matrix of counts. Each
partition is permuted and dealt out by its row of the matrix, and each shard is permuted again. Ranks inside a shard are
found in buckets with summed offsets, so that no task sorts a whole shard."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.llm.common import utf8_length

#: The matrix has at most this many rows of `n_shards` counts, at the driver and in the join.
MOST_PARTITIONS = 1 << 17
ROWS_PER_PARTITION = 128


def shard_sizes(n_rows: int, n_shards: int) -> list[int]:
    """As equal as can be; the first shards take the rest."""
    return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]


def communication_matrix(partition_sizes: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Counts from each partition to each shard, with these row and column sums, as a uniform shuffle would have them."""
    rng, left, matrix = np.random.Generator(np.random.PCG64(seed)), np.array(sizes, np.int64), []
    for n in partition_sizes:
        drawn = rng.multivariate_hypergeometric(left, n, method="marginals") if left.sum() < 10**9 else _large_draw(rng, left, n)
        left = left - drawn
        matrix.append([int(x) for x in drawn])
    return matrix


def _large_draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """The same law beyond the generator's range of 10^9: rank the drawn places among all that are left.

    n distinct places of the `left.sum()` are drawn uniformly (again where two fall together) and counted by shard."""
    total, places = int(left.sum()), set()
    while len(places) < n:
        places.update(int(x) for x in rng.integers(0, total, n - len(places)))
    bounds = np.cumsum(left)
    return np.bincount(np.searchsorted(bounds, np.fromiter(places, np.int64, n), "right"), minlength=len(left))


def _hash(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def shuffle_into_shards(rows: DataFrame, identity: list[Column], n_shards: int = 8, seed: int = 20_240) -> DataFrame:
    """`rows` as one struct column `row`, with shard (int) and slot (long, gapless from 0 in each shard).

    `identity`: what tells rows apart; equal rows share a partition and may change places. Shard sizes differ by one at
    most. The same rows, shards and seed give the same result. An empty table gives an empty result; nulls are values."""
    content = F.xxhash64(*identity)
    marked = rows.select(F.struct(*[rows[f"`{c}`"] for c in rows.columns]).alias("row"), content.alias("content"), F.struct(*identity).alias("tie"))
    n_rows = rows.count()
    n_partitions = max(1, min(MOST_PARTITIONS, -(-n_rows // ROWS_PER_PARTITION)))
    part = F.pmod(_hash(seed, F.col("content")), F.lit(n_partitions))
    counts = {r["part"]: r["n"] for r in rows.select(F.pmod(_hash(seed, content), F.lit(n_partitions)).alias("part")).groupBy("part").agg(F.count("*").alias("n")).collect()}
    parts = sorted(counts)
    matrix = communication_matrix([counts[p] for p in parts], shard_sizes(n_rows, n_shards), seed)
    sends = rows.sparkSession.createDataFrame(
        [(p, [int(x) for x in np.cumsum(m)]) for p, m in zip(parts, matrix, strict=True)], "part bigint, upto array<bigint>"
    )
    first = Window.partitionBy("part").orderBy("mix", "tie")
    ranked = marked.withColumn("part", part).withColumn("mix", _hash(seed + 1, F.col("content"))).withColumn("rank", F.row_number().over(first) - 1)
    dealt = ranked.join(sends, "part").select(
        "row", "content", "tie", F.size(F.filter("upto", lambda upto: upto <= F.col("rank"))).alias("shard"), F.lit(1).alias("one")
    )
    n_buckets = max(1, n_partitions // n_shards)
    bucket = F.pmod(_hash(seed + 2, F.col("content")), F.lit(n_buckets))
    placed = dealt.withColumn("bucket", bucket).withColumn("mix", _hash(seed + 3, F.col("content")))
    second = Window.partitionBy("shard", "bucket")
    inside = placed.withColumn("rank", F.row_number().over(second.orderBy("mix", "tie"))).withColumn("size", F.count("*").over(second))
    # the last row of each bucket tells its size; sums over buckets give each bucket's first slot
    sizes = inside.where("rank = size").select("shard", "bucket", "size")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    return inside.join(starts, ["shard", "bucket"]).select("row", F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("rank") - 1).alias("slot"))


def document_shards(docs: DataFrame, n_shards: int = 8, seed: int = 20_240) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of `docs` (doc_id, text).

    The law is `rows`: counts at most one apart. Size is the UTF-8 bytes of the text plus 1; a null text has size 1 and
    the checksum of no bytes. Other columns are ignored, so their names may clash with the result's."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (utf8_length(F.col("text")) + 1).alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64("text").alias("digest"))
    identity = [F.col(c) for c in ("doc_id", "size", "text_crc32", "digest")]
    out = shuffle_into_shards(narrow, identity, n_shards, seed)
    return out.select(
        "row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
