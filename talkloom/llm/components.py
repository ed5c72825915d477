"""Connected components of a graph given as an edge table.

Alternating large-star and small-star rounds: each round a node's neighbours are linked to the smallest of them instead.
A round is a minimum by node, combined before its shuffle, and a join back on the same key, which adaptive execution
splits where a node has very many edges. Rounds grow with the logarithm of the longest path. Each round's edges are
written to the shared checkpoint folder, so a lost executor does not replay the rounds before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.session import materialise


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v), both ways for a large star, v < u for a small one: links of u's neighbours to the smallest of all."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if large:
        links = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        links = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = links.unionByName(least.select("u", F.col("m").alias("v")))
    return links.where(F.col("u") != F.col("v")).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, component (the smallest node reachable) for every node of `edges`.

    Columns u and v hold comparable values of one type; a row with a null is no edge; a self-loop only names its node.
    Direction and repetition don't matter. No edges give no rows."""
    clean = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")
    loops = clean.where("u = v").select("u").distinct()
    current = materialise(clean.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _fingerprint(current)
    while seen[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        current = materialise(_star(_star(both, large=True), large=False))
        now = _fingerprint(current)
        if now == seen:
            break
        seen = now
    found = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    members = found.unionByName(roots)
    return members.unionByName(alone.join(members, "node", "left_anti"))
