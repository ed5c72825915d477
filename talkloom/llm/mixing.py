"""Mixing sources to target weights by Sainte-Laguë apportionment.

The words of each source, its documents laid end to end in seeded order, are cut into blocks of equal size (of one word,
unless told otherwise, so that the smallest source can hold a seat). Blocks are seats: sources win them by highest
quotients of their targets, shard after shard, so every shard of the mix has integer quotas. A source draws consecutive
blocks from the start of its order, and again from there once all are used: those of the first shard's quota go to that
shard, the next ones to the next. So documents are taken whole but for the ones in which a run ends, and what a document
lends to each shard is the overlap of its place with the shard's run.

Only one row of totals for each source reaches the driver (at most MOST_SOURCES, checked); everything per document stays
in Spark. A source of any size is split into parts for its running sums."""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.llm.common import word_count
from talkloom.session import materialise

WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 1
PART_WORDS = 1 << 16
#: Parts of one source; beyond this they grow instead.
MOST_PARTS = 1 << 17
MOST_SOURCES = 1_000_000


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Shares of `share` times all sizes by weight; none above `most` times its size, the excess shared again by weight."""
    left, weight = share * sum(sizes), float(sum(weights))
    found = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    for i in order:
        found[i] = min(most * sizes[i], left / weight * weights[i])
        left, weight = left - found[i], weight - weights[i]
    return found


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by highest quotients votes / (2k + 1); ties go to the earlier party."""
    total = sum(votes)
    if seats <= 0 or total <= 0:
        return [0] * len(votes)
    low, high = 0.0, 2 * seats / total + 2 / min(v for v in votes if v > 0)

    def given(scale: float) -> list[int]:  # every quotient that is at least 1 / scale, in half votes
        return [math.floor(v * scale / 2 + 0.5) for v in votes]

    for _ in range(200):  # the largest scale that gives no more seats than there are
        middle = (low + high) / 2
        if sum(given(middle)) <= seats:
            low = middle
        else:
            high = middle
    won = given(low * (1 - 1e-9))  # short of the last seats, which exact quotients decide
    queue = [(-Fraction(v) / (2 * won[i] + 1), i) for i, v in enumerate(votes) if v > 0]
    heapq.heapify(queue)
    for _ in range(seats - sum(won)):
        _, i = heapq.heappop(queue)
        won[i] += 1
        heapq.heappush(queue, (-Fraction(votes[i]) / (2 * won[i] + 1), i))
    return won


def shard_quotas(votes: list[float], seats: int, n_shards: int) -> list[list[int]]:
    """Quotas of each source up to and with each shard; a later shard never takes a seat back."""
    return [sainte_lague(votes, seats * (s + 1) // n_shards) for s in range(n_shards)]


def source_plan(sizes: dict, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK_WORDS, n_shards: int = 8) -> list[tuple]:
    """A row for each source: sid, source, source_size, target, words drawn up to and with each shard, parts."""
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"{len(sizes)} sources; at most {MOST_SOURCES}")
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))  # code points order as UTF-8 bytes
    totals = [sizes[s] for s in names]
    aims = targets(totals, [weights[i % len(weights)] for i in range(len(names))]) if names else []
    quotas = shard_quotas(aims, round(sum(aims) / block), n_shards)
    rows = []
    for i, name in enumerate(names):
        blocks = -(-totals[i] // block)

        def drawn(uses: int, total: int = totals[i], blocks: int = blocks) -> int:
            """Words of the first `uses` blocks drawn; the last block of a pass may be short."""
            return uses // blocks * total + min(uses % blocks * block, total) if blocks else 0

        ends = [drawn(min(q[i], 2 * blocks)) for q in quotas]  # no block is used more than twice
        rows.append((i, name, totals[i], aims[i], ends, max(1, min(MOST_PARTS, -(-totals[i] // PART_WORDS)))))
    return rows


PLAN_SCHEMA = "sid int, source string, source_size bigint, target double, ends array<bigint>, parts bigint"


def _plan(sized: DataFrame, n_shards: int, block: int) -> DataFrame:
    """The plan of all sources of `sized` (of: the source, size, n: how many)."""
    totals = sized.groupBy("of").agg(F.sum(F.col("size") * F.col("n")).alias("total")).collect()
    return sized.sparkSession.createDataFrame(source_plan({r["of"]: r["total"] for r in totals}, block=block, n_shards=n_shards), PLAN_SCHEMA)


def _named(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """`sized` (of, mix, and others) with the row of its source and the part that it falls in."""
    # the plan has one row a source (checked above); Spark broadcasts it where it is small
    named = sized.join(plan, sized["of"].eqNullSafe(plan["source"])).drop("source")
    return named.withColumn("part", F.pmod(F.shiftright("mix", 3), F.col("parts")))


def _part_starts(named: DataFrame) -> DataFrame:
    sizes = named.groupBy("sid", "part").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    before = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("sid", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("part_start"))


def _placed(named: DataFrame, starts: DataFrame, ties: list[str]) -> DataFrame:
    """`named` with `first`: the place of its first word in its source."""
    inside = Window.partitionBy("sid", "part").orderBy("mix", *ties).rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("size") * F.col("n")
    return named.withColumn("upto", F.sum(own).over(inside)).join(starts, ["sid", "part"]).withColumn("first", F.col("part_start") + F.col("upto") - own)


def _lent(first: Column, size: Column) -> Column:
    """Words that a document lends to each shard, over both passes through its source."""

    def overlap(end: Column, s: Column) -> Column:
        start = F.when(s > 0, F.get("ends", s - 1)).otherwise(0)
        parts = [F.greatest(F.least(end, at + size) - F.greatest(start, at), F.lit(0)) for at in (first, first + F.col("source_size"))]
        return parts[0] + parts[1]

    return F.transform("ends", overlap)


def mixed_documents(docs: DataFrame, n_shards: int = 8, seed: int = 7, block: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, shard_words, source for every row of `docs` (doc_id, text, source).

    `taken`: words that the mix takes from the document, repeats counted, at most twice its size; `shard_words`: the same
    for each shard. A null or empty text has size 0 and gives nothing; null is a source of its own, after all others. Texts
    of any length are counted whole. Repeated rows are separate documents, told apart by nothing and counted before they are
    shuffled. The same rows and seed give the same result. An empty table gives an empty result; other columns are ignored."""
    row = docs.select(F.col("source").alias("of"), word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("mix"), "doc_id")
    equal = materialise(row.groupBy("of", "mix", "doc_id", "size").agg(F.count("*").alias("n")))
    named = _named(equal, _plan(equal, n_shards, block))
    placed = _placed(named, _part_starts(named), ["doc_id", "size"])
    each = placed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    lent = each.withColumn("shard_words", _lent(F.col("first") + F.col("k") * F.col("size"), F.col("size")))
    taken = F.aggregate("shard_words", F.lit(0).cast("long"), lambda a, x: a + x)
    return lent.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "shard_words", F.col("of").alias("source"))


def mix(docs: DataFrame, n_shards: int = 8, seed: int = 7, block: int = BLOCK_WORDS, shard: str | None = None) -> DataFrame:
    """The mix itself: `docs` (doc_id, text, source and others) with one row for each first and second use of a document.

    A document used in part, one of a source at most, keeps its first words, each with the white space after it; one used
    whole keeps its text. Unused documents, and those without words, are left out. `n_chars` follows the text where it
    exists. `shard` names a column for the shard that a use's first word goes to; without it there is none."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    sized = docs.select(
        row.alias("row"), word_count(F.col("text")).alias("size"), F.col("source").alias("of"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("mix"), F.lit(1).alias("n")
    )
    # places come from narrow stored rows, told apart by a hash of all columns; equal rows share it and their order is all one
    narrow = materialise(sized.select("of", "size", "mix", F.xxhash64("row").alias("tie"), "n"))
    plan = _plan(narrow, n_shards, block)
    starts = materialise(_part_starts(_named(narrow, plan)))
    named = _named(sized, plan)
    placed = _placed(named.withColumn("tie", F.xxhash64("row")), starts, ["tie"])
    at = F.col("first") + (F.col("copy") - 1) * F.col("source_size")
    copies = placed.withColumn("copy", F.explode(F.lit([1, 2]))).withColumn("kept", F.least(F.element_at("ends", -1) - at, F.col("size"))).where("kept > 0")
    pieces = F.filter(F.split("row.text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"), lambda w: F.length(F.btrim(w, F.lit(" \t\n\x0b\f\r"))) > 0)
    text = F.when(F.col("kept") == F.col("size"), F.col("row.text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.col("kept"), F.lit(0)).cast("int")), ""))
    changed = copies.withColumn("text", text)
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    if shard:
        columns[shard] = F.size(F.filter("ends", lambda e: e <= at))
    return changed.select(*[value.alias(name) for name, value in columns.items()])
