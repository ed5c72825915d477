"""Merkle manifests over concatenated-level strings.

Nodes of a tree are dealt to aligned blocks of BLOCK consecutive ones. A block keeps each level as one string of hex
digests, laid end to end; substrings of fixed width are its nodes, so the next level is the hash of every substring that
is ARITY digests wide. What flanks a node within its run, to its left and right, is its sibling segment of that level.
The roots of the blocks are the nodes of the next tier, and so on until every tree has one block.

Positions come from a range partitioning by tree and order, numbered within each partition; only counts of partitions
are summed over. No task holds more than a block, and rows cross a shuffle twice, as digests without their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.session import materialise

#: Nodes that become their parent together.
ARITY = 2
#: Levels in a block, which so has ARITY ** DEPTH nodes.
DEPTH = 6
BLOCK = ARITY**DEPTH
#: Characters of a digest.
WIDTH = 64

PROOF = "array<struct<left:string,right:string>>"


def digest(*values: Column) -> Column:
    """H of values laid end to end."""
    return F.sha2(F.concat(*values).cast("binary"), 256)


def framed(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return digest(*[framed(f) for f in fields])


def _numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """`nodes` (tree, digest, and others) with position in its tree and n_nodes of the tree; order: columns, then digest."""
    keys = ["tree", *order, "digest"]
    # equal rows are told apart by an arbitrary number, so that very many of them don't meet in one partition
    apart = nodes.withColumn("_tie", F.monotonically_increasing_id())
    dealt = apart.repartitionByRange(*[F.col(k).asc_nulls_first() for k in [*keys, "_tie"]]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])
    rows = materialise(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(2**33 - 1)
    counts = rows.groupBy("tree", part.alias("_part")).agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    own = Window.partitionBy("tree")
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("tree").alias("_tree"), "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"), F.sum("_n").over(own).alias("n_nodes")
    )
    starts = materialise(starts)
    placed = rows.withColumn("_part", part).join(starts, "_part").where(F.col("tree").eqNullSafe(F.col("_tree")))
    return placed.withColumn("position", place + F.col("_start")).drop("_at", "_part", "_tree", "_start")


def _next_level(level: Column) -> Column:
    """The digests of all runs of a level, end to end. Levels are the bytes of hex strings: binary substrings start in O(1)."""
    run = ARITY * WIDTH
    runs = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / run).cast("int"))
    return F.array_join(F.transform(runs, lambda r: F.sha2(F.substring(level, r * run + 1, F.lit(run)), 256)), "").cast("binary")


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """tree, block, n_nodes, items, levels, top of `nodes` (tree, position, n_nodes, digest and `carried`).

    A tree of several blocks rises DEPTH levels in each of them, one of a single block until one node remains."""
    item = F.struct("position", "digest", *carried)
    block = F.floor(F.col("position") / BLOCK)
    grouped = nodes.groupBy("tree", block.alias("block"), "n_nodes").agg(F.sort_array(F.collect_list(item)).alias("items"))
    bottom = F.array_join(F.transform("items", lambda x: x["digest"]), "").cast("binary")
    steps = F.filter(F.lit([ARITY**k for k in range(DEPTH)]), lambda width: width < F.col("n_nodes"))
    levels = F.aggregate(steps, F.array(bottom), lambda done, _: F.concat(done, F.array(_next_level(F.element_at(done, -1)))))
    built = materialise(grouped.select("tree", "block", "n_nodes", "items", levels.alias("levels")))
    return built.withColumn("top", F.element_at("levels", -1).cast("string"))


def _segments(place: Column) -> Column:
    """left and right neighbours within its run, at each level below the top, of the node at a place of a block."""

    def at(level: Column, k: Column) -> Column:
        node = F.floor(place / F.pow(F.lit(ARITY), k))
        first = (node - node % ARITY) * WIDTH
        left = F.substring(level, (first + 1).cast("int"), ((node % ARITY) * WIDTH).cast("int"))
        right = F.substring(level, ((node + 1) * WIDTH + 1).cast("int"), ((ARITY - 1 - node % ARITY) * WIDTH).cast("int"))
        return F.struct(left.cast("string").alias("left"), right.cast("string").alias("right"))

    below = F.slice("levels", F.lit(1), F.size("levels") - 1)
    return F.transform(below, at)


def forest(nodes: DataFrame, order: list[str], carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """The proofs and the roots of the trees over `nodes` (tree, digest, the columns of `order` and `carried`).

    Leaves ascend by `order` (nulls first), then digest. Every ARITY consecutive nodes, fewer at the end and even one,
    become their digest while several remain. Proofs: tree, digest, `carried`, proof (left and right neighbours level by
    level) of every row; roots: tree, root. Both tables are lazy over stored blocks."""
    numbered = _numbered(nodes, order)
    tier = _blocks(numbered, carried)
    tiers, most = [tier], tier.agg(F.max("n_nodes")).first()[0] or 0
    while most > BLOCK:
        above = tier.select("tree", F.col("block").alias("position"), F.col("top").alias("digest"), F.ceil(F.col("n_nodes") / BLOCK).alias("n_nodes"))
        tier = _blocks(above, [])
        tiers.append(tier)
        most = -(-most // BLOCK)
    roots = tier.select("tree", F.col("top").alias("root"))
    upper = None
    for k in range(len(tiers) - 1, -1, -1):
        blocks = tiers[k].withColumn("upper", F.array().cast(PROOF)) if upper is None else _with(tiers[k], upper)
        places = F.transform("items", lambda x, i: F.struct(x.alias("item"), F.concat(_segments(i), F.col("upper")).alias("proof")))
        leaves = blocks.select("tree", F.explode(places).alias("leaf"))
        if k:
            upper = materialise(leaves.select("tree", F.col("leaf.item.position").alias("block"), F.col("leaf.proof").alias("upper")))
    return leaves.select("tree", "leaf.item.digest", *[f"leaf.item.{c}" for c in carried], "leaf.proof"), roots


def _with(blocks: DataFrame, upper: DataFrame) -> DataFrame:
    named = upper.select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), "upper")
    return blocks.join(named, (blocks["block"] == named["_block"]) & blocks["tree"].eqNullSafe(named["_tree"])).drop("_tree", "_block")


def proof_digest(proof: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), ""))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda node, x: digest(x["left"], node, x["right"]))


def manifest(
    docs: DataFrame,
    tree: str = "lang",
    order: str = "doc_id",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    carried: dict[str, Column] | None = None,
) -> DataFrame:
    """`order`, leaf, subroot, root, proof and the `carried` expressions for every row of `docs`.

    A leaf is H of the framed `fields`. Rows with one value of `tree` (null is a value, and the first) form a tree whose
    root is subroot; the subroots, by bytes of that value, form the tree of root, and a proof leads through both.
    Repeated rows are leaves of their own side by side; rows that tie in `order` follow by leaf, those without a value
    come first. Empty texts are framed as `0:`, texts of any length are hashed whole. An empty table gives an empty
    result; other columns, whatever their names, are ignored."""
    extra = carried or {}
    passengers = F.struct(*[c.alias(n) for n, c in extra.items()] or [F.lit(0).alias("_")])
    leaves = docs.select(docs[tree].alias("tree"), docs[order].alias("order"), leaf_digest([docs[f] for f in fields]).alias("digest"), passengers.alias("extra"))
    proofs, roots = forest(materialise(leaves), ["order"], ["order", "extra"])
    roots = materialise(roots)
    tops, whole = forest(roots.select(F.lit(0).alias("tree"), F.col("root").alias("digest"), F.col("tree").alias("of")), ["of"], ["of"])
    tops = materialise(tops.select("of", F.col("digest").alias("subroot"), F.col("proof").alias("upper"), "tree").join(whole, "tree").drop("tree"))
    found = proofs.join(tops, proofs["tree"].eqNullSafe(tops["of"]))
    proof = F.concat("proof", "upper").alias("proof")
    return found.select(F.col("order").alias(order), F.col("digest").alias("leaf"), "subroot", "root", proof, *[f"extra.{n}" for n in extra])


def tampered_leaf(docs: DataFrame) -> Column:
    """The leaf with 1 added to n_chars where 7 divides the crc32 of the decimal doc_id; null elsewhere.

    A row without doc_id isn't tampered with; one without n_chars keeps its leaf."""
    chosen = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0
    return F.when(chosen, leaf_digest([docs["doc_id"], docs["source"], docs["lang"], F.try_add(docs["n_chars"], F.lit(1)), docs["text"]]))


def tamper_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of `docs` (documents).

    folded_root comes from the tampered leaf where there is one, else from the leaf, and the true siblings."""
    rows = manifest(docs, carried={"tampered": tampered_leaf(docs)})
    again = fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    folded = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), again.alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
