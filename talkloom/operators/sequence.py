"""Ordered operators that stay parallel when one key holds a large share of all rows.

A plain window over (video) puts a whole video into one task. The operators here cut every
sequence into blocks of consecutive positions and shuffle by (key, block):

* ``neighbour_window`` copies the few rows next to a block edge into the neighbouring block, so
  lag/lead see past the edge;
* ``running`` computes block totals first (a small table), then offsets, then the running value
  inside each block;
* ``bounded_greedy`` runs a greedy grouping ("extend until the next row would break a limit") over
  all blocks at once: each block works out, for the rows that its first group may start at, where the
  first group beyond the block would start; pointer doubling over those jumps gives each block's true
  entry point, and the blocks are then walked in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.session import materialise

WINDOW_BLOCK = 1 << 16
GREEDY_BLOCK = 1 << 17
_BLOCK = "__block"


def block_of(pos: str, block: int) -> Column:
    return F.expr(f"`{pos}` div {block}")


def neighbour_window(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    columns: Callable[[WindowSpec], dict[str, Column]],
    *,
    back: int = 1,
    ahead: int = 1,
    block: int = WINDOW_BLOCK,
    dense: bool = True,
) -> DataFrame:
    """Add columns that look at most ``back`` rows behind and ``ahead`` rows ahead along ``pos``.

    ``dense=False`` takes positions with holes or repetitions, as validators must: the rows are numbered first."""
    if not dense:
        numbered = dense_position(df, keys, pos, "__dense", block=block)
        return neighbour_window(numbered, keys, "__dense", columns, back=back, ahead=ahead, block=block).drop("__dense")
    home = block_of(pos, block)
    offset = F.pmod(F.col(pos), F.lit(block))
    copies = F.array(
        home,
        F.when((offset < ahead) & (home > 0), home - 1),
        F.when(offset >= block - back, home + 1),
    )
    spread = df.withColumn(_BLOCK, F.explode(F.array_compact(copies)))
    window = Window.partitionBy(*keys, _BLOCK).orderBy(pos)
    return (
        spread.withColumns(columns(window)).where(F.col(_BLOCK) == block_of(pos, block)).drop(_BLOCK)
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    sums: dict[str, Column] | None = None,
    latest: dict[str, Column] | None = None,
    *,
    ties: Sequence[str] = (),
    block: int = WINDOW_BLOCK,
) -> DataFrame:
    """Running sums, and "largest value so far" columns, over ``pos`` within each key (both inclusive).
    ``ties`` orders rows of equal position."""
    sums, latest = sums or {}, latest or {}
    blocked = df.withColumn(_BLOCK, block_of(pos, block)).withColumns(
        {**{f"__v_{n}": c for n, c in sums.items()}, **{f"__v_{n}": c for n, c in latest.items()}}
    )
    totals = blocked.groupBy(*keys, _BLOCK).agg(
        *[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums],
        *[F.max(f"__v_{n}").alias(f"__t_{n}") for n in latest],
    )
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        _BLOCK,
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums],
        *[F.max(f"__t_{n}").over(before).alias(f"__o_{n}") for n in latest],
    )
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(pos, *ties).rowsBetween(Window.unboundedPreceding, 0)
    joined = blocked.join(offsets, [*keys, _BLOCK])
    return joined.withColumns(
        {
            **{n: F.col(f"__o_{n}") + F.sum(f"__v_{n}").over(inside) for n in sums},
            **{n: F.greatest(F.col(f"__o_{n}"), F.max(f"__v_{n}").over(inside)) for n in latest},
        }
    ).drop(_BLOCK, *[f"__v_{n}" for n in [*sums, *latest]], *[f"__o_{n}" for n in [*sums, *latest]])


def dense_position(
    df: DataFrame, keys: Sequence[str], order: str, out: str, *, ties: Sequence[str] = (), block: int = WINDOW_BLOCK
) -> DataFrame:
    """0-based dense position of the rows of a key along an integer column (then ``ties``)."""
    return running(df, keys, order, sums={out: F.lit(1)}, ties=ties, block=block).withColumn(out, F.col(out) - 1)


def ranked_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """0-based position of the rows of a key along any columns. Rows are cut into ranges of about equal numbers, so a key
    that holds very many rows, even at one value of the first column, is spread over many tasks."""
    cut = materialise(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    sizes = cut.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*keys, "__part").orderBy(*order)
    placed = cut.join(starts, [*keys, "__part"]).withColumn(out, F.col("__start") + F.row_number().over(inside) - 1)
    return placed.drop("__part", "__start")


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, spread: str, parts: int | None = None) -> DataFrame:
    """The first n rows per key. A key's rows are salted over parts that keep their own first n, so only
    n x parts rows of the hottest key meet in one task. ``spread`` names a column that varies within a key; there are
    as many parts as shuffle partitions, unless told otherwise."""
    parts = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    local = Window.partitionBy(*keys, "__part").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    salted = df.withColumn("__part", F.pmod(F.xxhash64(spread), F.lit(parts))).withColumn("__n", F.row_number().over(local))
    return salted.where(F.col("__n") <= n).withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= n).drop("__part", "__n")


NextStart = Callable[[dict[str, list], int, int], int]


def bounded_greedy(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    columns: Sequence[str],
    next_start: NextStart,
    *,
    reach: int,
    block: int = GREEDY_BLOCK,
    stored: bool = False,
) -> DataFrame:
    """Greedy grouping of a dense sequence; returns (keys, pos, group) with groups numbered from 0.

    ``next_start(cols, i, n)`` gets the rows' column arrays and says where the group after the one
    starting at row ``i`` starts (``i < j <= n``), or -1 when it ran out of rows undecided. Only the
    narrow columns travel to Python. ``reach`` is the usual length of a group: so many rows of the next
    block are read along, and so many first rows of a block are tried as places where its first group
    may start. A longer group is no error: the blocks that it leaves open are walked again from its end,
    with more rows read along, until none is open. ``stored`` says the input is a stored table already.
    """
    narrow = df.select(*keys, pos, *columns)
    narrow = narrow if stored else materialise(narrow)
    fields = {f.name: f.dataType for f in narrow.schema.fields}
    key_fields = [T.StructField(k, fields[k]) for k in keys]
    longs = lambda *names: T.StructType([*key_fields, *[T.StructField(n, T.LongType()) for n in names]])
    ends = narrow.groupBy(*keys).agg(F.max(pos).alias("__last"))
    blocks = (narrow.agg(F.max(pos)).first()[0] or 0) // block + 1

    def around(halo: int) -> DataFrame:
        """Rows of each block and so many after it, with the last position of their key."""
        first = F.greatest(F.lit(0), F.expr(f"(`{pos}` - {halo}) div {block}"))
        return narrow.join(ends, list(keys)).withColumn(_BLOCK, F.explode(F.sequence(first, block_of(pos, block))))

    def walked(pdf: pd.DataFrame, starts: list[int]) -> tuple[dict[int, tuple[int, int]], dict[int, int]]:
        """For rows of a block where a group may start: the first start beyond the block (-1 if open) and the
        groups until then; and the next start of every row met on the way."""
        cols, n = {c: pdf[c].tolist() for c in (pos, *columns)}, len(pdf)
        own = int((pdf[pos] // block == pdf[_BLOCK]).sum())
        final = blocks == 1 or cols[pos][n - 1] == int(pdf["__last"].iloc[0])
        following: dict[int, int] = {}
        leaves: dict[int, tuple[int, int]] = {}
        for start in starts:
            path, i = [], start
            while i < own and i not in leaves:
                if i not in following:
                    j = next_start(cols, i, n)
                    following[i] = j if j >= 0 else n if final else -1
                path.append(i)
                i = following[i]
                if i < 0:
                    break
            if i < 0 or i >= own:
                leave, hops = (cols[pos][0] + i if i >= 0 else -1), 0
            else:
                leave, hops = leaves[i]
            for i in reversed(path):
                hops += 1
                leaves[i] = (leave, hops)
        return leaves, following

    def jumps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, kind="stable").reset_index(drop=True)
        first, own = int(pdf[pos].iloc[0]), int((pdf[pos] // block == pdf[_BLOCK]).sum())
        if "__wanted" in pdf:
            starts = [int(pdf["__wanted"].iloc[0]) - first]
        else:
            starts = [0] if pdf[_BLOCK].iloc[0] == 0 else list(range(min(own, reach + 1)))
        leaves, _ = walked(pdf, starts)
        out = pd.DataFrame([(first + i, *leaves[i]) for i in starts], columns=["__entry", "__exit", "__hops"], dtype="int64")
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, kind="stable").reset_index(drop=True)
        first, own = int(pdf[pos].iloc[0]), int((pdf[pos] // block == pdf[_BLOCK]).sum())
        entry, g = pdf["__entry"].iloc[0], int(pdf["__g"].iloc[0])
        group = np.full(own, g if pd.isna(entry) else g - 1, dtype=np.int64)
        if not pd.isna(entry):
            i = int(entry) - first
            _, following = walked(pdf, [i])
            while 0 <= i < own:
                j = following[i]
                group[i : own if j < 0 else j] = g
                i, g = j, g + 1
        out = pdf.iloc[:own][[*keys, pos]].copy()
        out["group"] = group
        return out

    row_type = T.StructType([*key_fields, T.StructField(pos, T.LongType()), T.StructField("group", T.LongType())])
    jump_type = longs("__entry", "__exit", "__hops")
    if blocks == 1:  # every key's one block holds it whole and is entered at its first row
        ordered = narrow.repartition(*keys).sortWithinPartitions(*keys, pos)
        return ordered.mapInArrow(_walk_whole(keys, pos, columns, next_start), row_type)
    begin = ends.select(*keys, F.lit(0).cast("long").alias("__entry"), F.lit(0).cast("long").alias("__g"))
    known = materialise(around(reach).groupBy(*keys, _BLOCK).applyInPandas(jumps, jump_type))
    halo = reach
    while True:
        entries = materialise(_follow(known, begin, keys, blocks))
        ending = entries.join(ends, list(keys)).where(F.col("__entry") <= F.col("__last"))
        unknown = ending.join(known.where("__exit >= 0"), [*keys, "__entry"], "left_anti")
        unknown = materialise(unknown.select(*keys, F.col("__entry").alias("__wanted"), block_of("__entry", block).alias(_BLOCK)))
        if unknown.isEmpty():
            break
        halo *= 8
        again = around(halo).join(unknown, [*keys, _BLOCK]).groupBy(*keys, _BLOCK, "__wanted").applyInPandas(jumps, jump_type)
        kept = known.join(unknown.withColumnRenamed("__wanted", "__entry"), [*keys, "__entry"], "left_anti")
        known = materialise(kept.unionByName(again))
    reach = max(reach, halo)

    top = entries.groupBy(*keys).agg(F.max("__g").alias("__top"))  # an entry after the last row tells the number of groups
    placed = entries.join(ends, list(keys)).where(F.col("__entry") <= F.col("__last")).drop("__last").withColumn(_BLOCK, block_of("__entry", block))
    full = around(reach)
    # a block without an entry lies inside the last group that started before it
    span = F.sequence(F.lit(0), block_of("__last", block))
    every = ends.select(*keys, F.explode(span).alias(_BLOCK)).join(placed, [*keys, _BLOCK], "left")
    before = Window.partitionBy(*keys).orderBy(F.desc(_BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    # the next entry's number is one more than that of the group which covers everything up to it
    later = F.min("__g").over(before)
    filled = every.withColumn("__later", later).join(top, list(keys))
    number = F.coalesce("__g", F.col("__later") - 1, F.col("__top") - 1)
    labelled = full.join(filled.select(*keys, _BLOCK, "__entry", number.alias("__g")), [*keys, _BLOCK])
    return labelled.groupBy(*keys, _BLOCK).applyInPandas(label, row_type)


def _walk_whole(keys: Sequence[str], pos: str, columns: Sequence[str], next_start: NextStart) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Groups of keys that come whole and in order, many keys to a batch; only the rows of the last key wait for the next batch."""

    def starts_of(table: pa.Table) -> list[int]:
        """Rows at which another key begins; null keys are alike."""
        n = table.num_rows
        new = np.zeros(n, dtype=bool)
        new[:1] = True
        for k in keys:
            values = table.column(k).combine_chunks()
            here, before = values.slice(1), values.slice(0, n - 1)
            differ = pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
            new[1:] |= differ | (pc.is_null(here).to_numpy(zero_copy_only=False) != pc.is_null(before).to_numpy(zero_copy_only=False))
        return np.flatnonzero(new).tolist()

    def labelled(table: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        cols = {c: table.column(c).to_pylist() for c in (pos, *columns)}
        group = np.zeros(n, dtype=np.int64)
        for first, end in zip(starts, [*starts[1:], n], strict=True):
            i, g = first, 0
            while i < end:
                j = next_start(cols, i, end)
                j = end if j < 0 else j
                group[i:j] = g
                i, g = j, g + 1
        out = table.select([*keys, pos]).append_column("group", pa.array(group))
        yield from out.combine_chunks().to_batches()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            ends = pa.Table.from_batches([held[0].slice(0, 1), batch.slice(batch.num_rows - 1)])
            if len(starts_of(ends)) < 2:  # one key until now
                continue
            table = pa.Table.from_batches(held)
            starts = starts_of(table)
            yield from labelled(table.slice(0, starts[-1]), starts[:-1])
            held = table.slice(starts[-1]).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from labelled(table, starts_of(table))

    return walk


def _follow(known: DataFrame, begin: DataFrame, keys: Sequence[str], blocks: int) -> DataFrame:
    """Entries met from each key's first row, with the number of groups before each, by pointer doubling:
    after k rounds all entries within 2^k jumps are known, and a jump skips 2^k blocks."""
    met, steps, span = begin, known.where("__exit >= 0"), 1
    while span <= blocks:
        onward = met.join(steps, [*keys, "__entry"]).select(*keys, F.col("__exit").alias("__entry"), (F.col("__g") + F.col("__hops")).alias("__g"))
        met = materialise(met.unionByName(onward).distinct())
        second = steps.select(*keys, F.col("__entry").alias("__exit"), F.col("__exit").alias("__end"), F.col("__hops").alias("__more"))
        steps = materialise(
            steps.join(second, [*keys, "__exit"]).select(*keys, "__entry", F.col("__end").alias("__exit"), (F.col("__hops") + F.col("__more")).alias("__hops"))
        )
        span *= 2
    return met
