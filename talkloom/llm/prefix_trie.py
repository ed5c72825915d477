"""The prefix trie of conversations, built by bursting containers.

A turn is the digest of its role and text, a conversation the sequence of its turns. Conversations of one sequence are
one row from the start, with their number, smallest id and the hash of all their ids. A container holds the suffixes
under a head of the trie; at first a single one holds them all under the root. A container of more than CONTAINER
suffixes, or of more than CONTAINER_TURNS turns in several, bursts: what all its suffixes begin with becomes a chain of
nodes below its head, and those that go on are dealt by the next turn id to containers of their own. Once none is
oversized, each is sorted and swept into nodes inside a task, and what the tops of containers have below them is summed
along the burst heads, last burst first.

Rounds of bursting number the branchings above a container, not the turns. No task holds more than a container; the
sequence of one conversation is one row (some 40 bytes a turn)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.llm.common import word_count
from talkloom.session import materialise

CONTAINER = 128
CONTAINER_TURNS = 1 << 16
#: Conversation ids whose decimals are joined to one string before they are hashed in order.
ID_RANGE = 1024
NO_IDS = hashlib.sha256(b"").hexdigest()

NODE_SCHEMA = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
NODE_COLUMNS = [c.split()[0] for c in NODE_SCHEMA.split(", ")]


def turn_id(role: Column, text: Column) -> Column:
    """128 bits of the digest of role and text; null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(framed.cast("binary"), 256), 1, 32)


def turn_sequences(turns: DataFrame) -> DataFrame:
    """conv_id, ids, words (turn ids and word counts in order) of `turns` (conv_id, turn, role, text).

    Turns ascend by number, null first; those of one number by turn id, repeated rows side by side. Rows without a
    conv_id belong to no conversation and are left out; other columns are ignored."""
    one = F.struct(turns["turn"], turn_id(turns["role"], turns["text"]).alias("id"), word_count(turns["text"]).alias("words"))
    ordered = turns.where(turns["conv_id"].isNotNull()).groupBy(turns["conv_id"]).agg(F.sort_array(F.collect_list(one)).alias("t"))
    return ordered.select("conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))


def grafted(convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of c - c % `every` (all of them if fewer, none if there
    is no such conversation); h is the crc32 of the decimal c modulo `most`."""
    base = convs.select(F.col("conv_id").alias("base"), F.slice("ids", 1, most).alias("base_ids"), F.slice("words", 1, most).alias("base_words"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h)

    def graft(first: str, rest: str) -> Column:
        none = F.slice(rest, 1, F.lit(0))
        return F.concat(F.slice(F.coalesce(first, none), F.lit(1), F.col("h")), F.slice(rest, F.col("h") + 1, F.size(rest)))

    joined = own.join(base, "base", "left")
    return joined.select("conv_id", graft("base_ids", "ids").alias("ids"), graft("base_words", "words").alias("words"))


def _hash_in_order(ranges: DataFrame) -> DataFrame:
    """key, n, least, ends from `ranges` (key, range, listed, n, least): ids of a key hashed in one stream, range by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, n, least = None, hashlib.sha256(), 0, 0
        for batch in batches:
            done: list[tuple] = []
            for own, listed, count, first in zip(*(batch.column(c).to_pylist() for c in ("key", "listed", "n", "least")), strict=True):
                if own == key:
                    state.update(b"," + listed.encode())
                    n, least = n + count, min(least, first)
                    continue
                if key is not None:
                    done.append((key, n, least, state.hexdigest()))
                key, state, n, least = own, hashlib.sha256(listed.encode()), count, first
            if done:
                yield _table(done, out)
        if key is not None:
            yield _table([(key, n, least, state.hexdigest())], out)

    out = pa.schema([("key", pa.string()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])
    ordered = ranges.repartition("key").sortWithinPartitions("key", "range").select("key", "listed", "n", "least")
    return ordered.mapInArrow(run, "key string, n bigint, least bigint, ends string")


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """n, least, ends, ids, words: a row for each distinct sequence of `convs` (conv_id, ids, words)."""
    keyed = materialise(convs.withColumn("key", F.sha2(F.array_join("ids", "").cast("binary"), 256)))
    listed = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    ranges = keyed.groupBy("key", F.floor(F.col("conv_id") / ID_RANGE).alias("range")).agg(
        listed.alias("listed"), F.count("*").alias("n"), F.min("conv_id").alias("least")
    )
    hashed = _hash_in_order(ranges)
    return hashed.join(keyed.select(F.col("conv_id").alias("least"), "ids", "words"), "least").select("n", "least", "ends", "ids", "words")


def sweep(depth: int, suffixes: list[tuple]) -> list[list]:
    """The nodes of a container, its top first: conv_id, depth, parent's conv_id (of the top: None), n_convs, n_children,
    n_leaves, saved_tokens, ends. suffixes: sorted (ids, words, n, least, ends); words start with those of the top."""
    up: list[int] = []
    nodes: list[list] = []  # least, depth, words, n, children, leaves, saved, ends

    def add(parent: int, at: int, words: int) -> int:
        up.append(parent)
        nodes.append([None, at, words, 0, 0, 0, 0, NO_IDS])
        return len(nodes) - 1

    path = [add(-1, depth, suffixes[0][1][0])]
    before: list = []
    for ids, words, n, least, ends in suffixes:
        common, most = 0, min(len(ids), len(before))
        while common < most and ids[common] == before[common]:
            common += 1
        del path[common + 1 :]
        for k in range(common, len(ids)):
            path.append(add(path[-1], depth + k + 1, words[k + 1]))
        last = nodes[path[-1]]
        last[0], last[3], last[7] = least, n, ends
        before = ids
    for k in range(len(nodes) - 1, -1, -1):  # children follow their parents
        least, _, words, n, children, leaves, _, _ = nodes[k]
        nodes[k][5] = leaves if children else 1
        nodes[k][6] += (n - 1) * words
        if k:
            top = nodes[up[k]]
            top[0] = least if top[0] is None else min(top[0], least)
            top[3] += n
            top[4] += 1
            top[5] += nodes[k][5]
            top[6] += nodes[k][6]
    return [[x[0], x[1], nodes[p][0] if p >= 0 else None, *x[3:]] for x, p in zip(nodes, up, strict=True)]


def _swept(containers: DataFrame) -> DataFrame:
    """The nodes of all containers; `under` names the burst head above the top of each."""
    out = pa.schema([(c, pa.int64()) for c in NODE_COLUMNS[:-1]] + [("ends_sha256", pa.string()), ("under", pa.string())])

    def nodes(rows: list[dict]) -> pa.RecordBatch:
        first = rows[0]
        found = sweep(first["depth"], [(r["ids"], r["words"], r["n"], r["least"], r["ends"]) for r in rows])
        found[0][2] = first["parent_least"]
        return _table([(*x, first["under"] if k == 0 else None) for k, x in enumerate(found)], out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            ready = []
            for row in batch.to_pylist():
                if held and held[0]["head"] != row["head"]:
                    ready.append(nodes(held))
                    held = []
                held.append(row)
            if ready:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
        if held:
            yield nodes(held)

    ordered = containers.repartition("head").sortWithinPartitions("head", "ids")
    return ordered.mapInArrow(run, f"{NODE_SCHEMA}, under string")


def _burst(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Burst containers: their chains (head, under, parent_least, depth, n, least, words, ends) and the rows that go on below."""
    heads = rows.groupBy("head", "under", "parent_least", "depth").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.min(F.struct("ids", "words")).alias("low"), F.max("ids").alias("high")
    )
    differs = F.array_position(F.zip_with("low.ids", "high", lambda a, b: a.eqNullSafe(b)), F.lit(False))
    common = F.when(differs > 0, differs - 1).otherwise(F.size("low.ids")).cast("int")
    shared = materialise(heads.withColumn("common", common).select("*", F.slice("low.words", F.lit(1), F.col("common") + 1).alias("chain")).drop("low", "high"))
    above = shared.select("head", "common", F.col("least").alias("head_least"))
    dealt = rows.join(above, "head")
    ending = dealt.where(F.size("ids") == F.col("common")).select("head", "ends")
    chains = shared.join(ending, "head", "left").select("head", "under", "parent_least", "depth", "n", "least", "chain", F.coalesce("ends", F.lit(NO_IDS)).alias("ends"))
    rest = F.col("common") + 2
    below = dealt.where(F.size("ids") > F.col("common")).select(
        F.sha2(F.concat("head", F.get("ids", F.col("common"))).cast("binary"), 256).alias("head"),
        F.col("head").alias("under"),
        F.col("head_least").alias("parent_least"),
        (F.col("depth") + F.col("common") + 1).alias("depth"),
        F.slice("ids", rest, F.size("ids")).alias("ids"),
        F.slice("words", rest, F.size("words")).alias("words"),
        "n",
        "least",
        "ends",
    )
    return chains, below


def _chain_nodes(chains: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes of burst chains; `tops`: the tops (under, n_leaves, saved_tokens) right below them."""
    sums = tops.groupBy("under").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    full = chains.join(sums.withColumnRenamed("under", "head"), "head")
    nodes = full.select("*", F.posexplode("chain").alias("k", "own_words"))
    last, top = F.col("k") == F.size("chain") - 1, F.col("k") == 0
    along = F.aggregate(F.slice("chain", F.col("k") + 1, F.size("chain")), F.lit(0).cast("bigint"), lambda a, w: a + w)
    return nodes.select(
        F.col("least").alias("conv_id"),
        (F.col("depth") + F.col("k")).alias("depth"),
        F.when(top, F.col("parent_least")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(1).cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        ((F.col("n") - 1) * along + F.col("saved")).alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(NO_IDS).alias("ends_sha256"),
        F.when(top, F.col("under")).alias("under"),
    )


def prefix_trie(convs: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of `convs` (conv_id unique, ids, words): a row for each distinct sequence of first turns.

    conv_id: the smallest member; with depth it names the node, whose last turn is the member's turn of that number.
    parent_conv_id: the parent's (of the root: null). n_convs: members; n_children; n_leaves: childless nodes at or below
    it; saved_tokens: words that a cache of prefixes saves, (n_convs - 1) times the words of a node's last turn, summed
    at and below it; ends_sha256: hash of the decimal ids, ascending, of members that end here. Conversations without
    turns end at the root. An empty table has no nodes."""
    rows = distinct_sequences(convs).select(
        F.lit("").alias("head"),
        F.lit(None).cast("string").alias("under"),
        F.lit(None).cast("bigint").alias("parent_least"),
        F.lit(0).cast("bigint").alias("depth"),
        "ids",
        F.concat(F.array(F.lit(0).cast("bigint")), F.col("words")).alias("words"),
        "n",
        "least",
        "ends",
    )
    settled, bursts = None, []
    while True:
        rows = materialise(rows)
        sizes = rows.groupBy("head").agg(F.count("*").alias("suffixes"), F.sum(F.size("ids")).alias("turns"))
        oversized = (F.col("suffixes") > CONTAINER) | ((F.col("suffixes") > 1) & (F.col("turns") > CONTAINER_TURNS))
        large = materialise(sizes.where(oversized).select("head"))
        small = rows.join(large, "head", "left_anti")
        settled = small if settled is None else settled.unionByName(small)
        if large.isEmpty():
            break
        chains, rows = _burst(rows.join(large, "head", "left_semi"))
        bursts.append(materialise(chains))
    found = materialise(_swept(settled))
    tops = found.where("under is not null").select("under", "n_leaves", "saved_tokens")
    for chains in reversed(bursts):
        nodes = materialise(_chain_nodes(chains, tops))
        found = found.unionByName(nodes)
        tops = tops.unionByName(nodes.where("under is not null").select("under", "n_leaves", "saved_tokens"))
    return found.select(*NODE_COLUMNS)


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The prefix trie of `turns` (conversations), each conversation grafted onto the first of its twenty."""
    return prefix_trie(grafted(materialise(turn_sequences(turns))))
