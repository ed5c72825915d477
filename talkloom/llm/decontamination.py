"""Benchmark decontamination by spaced seeds.

A mask selects some of the words at each place and ignores the rest, so a substituted word at an ignored place does not
hide a passage. Masked hashes of the benchmark are joined to those of the training texts; around each hit the two texts
are laid side by side, and a stretch in which most words agree confirms the leak. The masks are chosen so that every
stretch that the rule accepts holds a seed: none is missed. Items shorter than a stretch have masks of their own length.

Everything runs as column expressions. What is joined on a seed is a place of a text, never its words; the words of texts
with hits are read again. The benchmark's seeds are broadcast only up to MOST_BROADCAST rows; beyond that the join is
shuffled."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.llm.common import GAP
from talkloom.session import materialise

#: A leak is a stretch of so many words (or the whole item, if shorter) of which such a share agrees.
STRETCH_WORDS = 13
SHARE = 0.8
#: Places that each mask keeps. Any two of thirteen words may be substituted: one of the masks fits between them somewhere.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
#: Items are compared in pieces: the words of the hit's block and one block on either side.
BLOCK = 32
#: Words of a text that are seeded as one row.
CHUNK = 64
MOST_BROADCAST = 1_000_000


def substitutions(n_words: int) -> int:
    """How many words of a stretch of so many may differ."""
    return n_words - math.ceil(n_words * SHARE)


def short_masks(n_words: int) -> list[tuple[int, ...]]:
    """Masks for whole items under a stretch: words fall into k + 2 groups in turn (k may be substituted), and each mask
    ignores k of the groups, so some mask ignores all substituted words."""
    k = substitutions(n_words)
    groups = k + 2 if k else 1
    ignored = [()] if k == 0 else [(g,) for g in range(groups)] if k == 1 else [(g, h) for g in range(groups) for h in range(g)]
    return [tuple(p for p in range(n_words) if p % groups not in out) for out in ignored]


def word_keys(text: Column) -> Column:
    """64-bit hashes of the words of a text, A to Z in lower case; none for blank texts."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bare = F.btrim(lowered, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(bare, GAP), lambda w: F.xxhash64(w)))


def _masks(lengths: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """(length, places) of all masks: length 0 for those of stretches, else of the items that they are for."""
    return [(0, m) for m in MASKS] + [(n, m) for n in lengths for m in short_masks(n)]


def _masked(keys: Column, at: Column, masks: list[tuple[int, tuple[int, ...]]]) -> Column:
    """The hashes of all masks at a place. Past the end of a text words are missing, and such a hash meets no seed."""
    return F.array(*[F.xxhash64(F.lit(i), F.lit(n), *[F.get(keys, at + k) for k in mask]) for i, (n, mask) in enumerate(masks)])


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item, item_id (the smallest of equal items), same_items, keys, n_words of all items that have words."""
    keyed = benchmark.select("item_id", word_keys(F.col("text")).alias("keys")).where(F.size("keys") > 0)
    items = keyed.groupBy("keys").agg(F.min("item_id").alias("item_id"), F.count("*").alias("same_items"))
    return items.select(F.monotonically_increasing_id().alias("item"), "item_id", "same_items", "keys", F.size("keys").alias("n_words"))


def _seeds(items: DataFrame, masks: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """seed, item, at, n_words: where each masked hash lies in each item; short items have those of their length, at 0."""
    last = F.when(F.col("n_words") < STRETCH_WORDS, 0).otherwise(F.col("n_words") - 1)
    places = items.select("item", "keys", "n_words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    spread = places.select("item", "at", "n_words", F.posexplode(_masked(F.col("keys"), F.col("at"), masks)).alias("mask", "seed"))
    spans, lengths = F.array(*[F.lit(m[-1]) for _, m in masks]), F.array(*[F.lit(n) for n, _ in masks])
    length = F.get(lengths, F.col("mask"))
    own = F.when(F.col("n_words") < STRETCH_WORDS, length == F.col("n_words")).otherwise(length == 0)
    return spread.where(own & (F.col("at") + F.get(spans, F.col("mask")) < F.col("n_words"))).select("seed", "item", "at", "n_words")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_key, item_id, same_items, item_words, position, compared, agreeing: a row for each text and leaked item.

    `docs` (doc_id, text), `benchmark` (item_id, text). Equal items count as one, named by their smallest id, with their
    number; items without an id are items like others, and texts that share an id are items of their own. Position is
    where the item would begin among the text's words; of several the one with most agreeing words, then the first. Null
    and empty texts and items have no leaks; an item of up to four words leaks where it stands word for word. Equal rows
    of `docs` give one row (text_key tells texts of one id apart); rows without an id keep a null. Texts of any length are
    seeded whole, place by place. Empty tables give an empty result; other columns are ignored."""
    items = materialise(benchmark_items(benchmark))
    short = items.where(F.col("n_words") < STRETCH_WORDS).select("n_words").distinct().collect()  # a dozen lengths at most
    masks = _masks(sorted(r["n_words"] for r in short))
    seeds = materialise(_seeds(items, masks))
    # outer generators: inferred filters on the inner kind would split every text into words once more
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), word_keys(F.col("text")).alias("w"))
    # by chunks of words and those that masks reach beyond them, so that a place carries no more than that
    cuts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(CHUNK))
    chunks = F.transform(cuts, lambda at: F.struct(at.alias("at"), F.slice("w", at + 1, F.lit(CHUNK + STRETCH_WORDS - 1)).alias("c")))
    cut = rows.select("doc_id", "text_key", F.explode_outer(chunks).alias("x")).select("doc_id", "text_key", F.col("x.at").alias("from"), F.col("x.c").alias("c"))
    inside = F.when(F.size("c") > 0, F.sequence(F.lit(0), F.least(F.lit(CHUNK), F.size("c")) - 1))
    each = cut.select("doc_id", "text_key", "from", "c", F.explode_outer(inside).alias("q"))
    places = each.select("doc_id", "text_key", (F.col("from") + F.col("q")).alias("p"), F.explode_outer(_masked(F.col("c"), F.col("q"), masks)).alias("seed"))
    hits = places.join(F.broadcast(seeds) if seeds.count() <= MOST_BROADCAST else seeds, "seed").where("p is not null")
    offset, low = F.col("p") - F.col("at"), F.floor(F.col("at") / BLOCK).cast("int") * BLOCK - BLOCK
    start = F.greatest(low, -offset, F.lit(0))
    count = F.least(low + 3 * BLOCK, F.col("n_words")) - start
    near = materialise(hits.select("doc_id", "text_key", "item", offset.alias("position"), start.alias("start"), count.alias("count")).distinct())
    wanted = near.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    hit = keyed.join(wanted, keyed["doc_id"].eqNullSafe(wanted["_doc"]) & (keyed["text_key"] == wanted["_key"]), "left_semi")
    texts = hit.groupBy("doc_id", "text_key").agg(F.first("text").alias("text")).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), word_keys(F.col("text")).alias("w"))
    pairs = near.join(texts, near["doc_id"].eqNullSafe(texts["_doc"]) & (near["text_key"] == texts["_key"])).join(items, "item")
    words = F.slice("w", F.col("position") + F.col("start") + 1, F.col("count"))
    same = F.zip_with(words, F.slice("keys", F.col("start") + 1, F.size(words)), lambda a, b: (a == b).cast("int"))
    agreed = pairs.select("doc_id", "text_key", "item", "item_id", "same_items", "n_words", "position", same.alias("same"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    stretch = F.least(F.lit(STRETCH_WORDS), F.col("n_words"))
    starts = F.when(F.size("same") >= stretch, F.sequence(F.lit(1), F.size("same") - stretch + 1))
    leaked = agreed.where(F.exists(starts, lambda s: total(F.slice("same", s, stretch)) >= F.ceil(stretch * SHARE)))
    best = F.max(F.struct(total(F.col("same")).alias("agreeing"), (-F.col("position")).alias("back"), F.size("same").alias("compared"))).alias("best")
    found = leaked.groupBy("doc_id", "text_key", "item", "item_id", "same_items", "n_words").agg(best)
    return found.select(
        "doc_id",
        "text_key",
        "item_id",
        "same_items",
        F.col("n_words").alias("item_words"),
        (-F.col("best.back")).alias("position"),
        F.col("best.compared").alias("compared"),
        F.col("best.agreeing").alias("agreeing"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no benchmark item is found, with all their columns."""
    found = materialise(leaks(docs, benchmark).select(F.col("doc_id").alias("_leaked"), F.col("text_key").alias("_key")).distinct())
    kept = docs.join(found, docs["doc_id"].eqNullSafe(found["_leaked"]) & (F.xxhash64(docs["text"]) == found["_key"]), "left_anti")
    return kept
