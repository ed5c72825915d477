"""Hash trees over the ordered rows of a key: one fingerprint for any number of rows, and where two tables differ.

Rows of ``leaf`` consecutive positions give a leaf digest, ``fan`` consecutive digests their parent, until a key has one
node. No task holds more than a leaf or a fan, and a comparison goes down only where digests differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.session import materialise

LEAF = 1 << 12
FAN = 64


def _joined(order: str) -> Column:
    """The digests of a group, end to end in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "digest"))), lambda x: x["digest"]), "")


def levels(df: DataFrame, keys: Sequence[str], pos: str, row: Column, leaf: int = LEAF, fan: int = FAN, sides: Sequence[str] = ()) -> list[DataFrame]:
    """The nodes of all levels, leaves first: (keys, sides, node, digest, rows, last). ``last`` is the key's last node of
    the level on any side; where it is 0, node 0 is the root. A node without rows does not exist."""
    every = [*keys, *sides]
    place = F.col(pos).cast("long")
    hashed = df.select(*every, place.alias("place"), F.floor(place / leaf).alias("node"), F.sha2(row, 256).alias("digest"))
    leaves = materialise(hashed.groupBy(*every, "node").agg(F.sha2(_joined("place"), 256).alias("digest"), F.count("*").alias("rows")))
    ends = leaves.groupBy(*keys).agg(F.max("node").alias("last"))
    found = [materialise(leaves.join(ends, list(keys)))]
    while True:
        below = found[-1].where("last > 0")
        if below.isEmpty():
            return found
        parent = below.withColumns({"parent": F.floor(F.col("node") / fan), "last": F.floor(F.col("last") / fan)})
        risen = parent.groupBy(*every, "parent", "last").agg(F.sha2(_joined("node"), 256).alias("digest"), F.sum("rows").alias("rows"))
        found.append(materialise(risen.select(*every, F.col("parent").alias("node"), "digest", "rows", "last")))


def fingerprint(df: DataFrame, keys: Sequence[str], pos: str, row: Column, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(keys, fingerprint, rows) of every key: the roots."""
    roots = None
    for level in levels(df, keys, pos, row, leaf, fan):
        here = level.where("last = 0").select(*keys, F.col("digest").alias("fingerprint"), "rows")
        roots = here if roots is None else roots.unionByName(here)
    return roots


def differing_leaves(left: DataFrame, right: DataFrame, keys: Sequence[str], pos: str, row: Column, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(keys, node, from_pos, to_pos, left_rows, right_rows) of the leaves in which two tables differ; rows null where a side has none.

    Both are put into trees of one shape, and each level is compared only below nodes that differ."""
    both = left.select(*keys, pos, row.alias("__row"), F.lit("left").alias("side")).unionByName(right.select(*keys, pos, row.alias("__row"), F.lit("right").alias("side")))
    above = None
    for level in reversed(levels(both, keys, pos, F.col("__row"), leaf, fan, ["side"])):
        looked = level.where("last = 0")
        if above is not None:
            down = above.select(*keys, F.col("node").alias("parent"))
            looked = looked.unionByName(level.where("last > 0").withColumn("parent", F.floor(F.col("node") / fan)).join(down, [*keys, "parent"], "left_semi").select(*level.columns))
        of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
        compared = looked.groupBy(*keys, "node").agg(
            of("left", "digest").alias("l"), of("right", "digest").alias("r"), of("left", "rows").alias("left_rows"), of("right", "rows").alias("right_rows")
        )
        above = materialise(compared.where(~F.col("l").eqNullSafe(F.col("r"))).select(*keys, "node", "left_rows", "right_rows"))
    first = F.col("node") * leaf
    return above.select(*keys, "node", first.alias("from_pos"), (first + leaf - 1).alias("to_pos"), "left_rows", "right_rows")
