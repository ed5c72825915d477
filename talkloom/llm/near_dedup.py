"""Near-duplicate groups by MinHash, with sequential Bayesian verification.

Texts become sets of hashed shingles of five words. Equal sets form classes, and only one text of a class goes on.
MinHash bands find classes that may be alike. Signatures of candidates are compared batch by batch; after each, a pair is
pruned once the posterior probability of the wanted similarity falls under a chosen miss probability. Survivors are
verified on their whole sets, and links are followed by distributed connected components.

A bucket of n classes is not expanded into n^2 pairs. Turn by turn, each member of a bucket that holds several components
meets others in a random block of one of its buckets; the block's task verifies pairs of different components and emits a
spanning forest of these, never the pairs. Once a turn leaves more than half of the members outside their buckets' main
components there, those that are left are alike to few, and each is compared to all others, again by blocks. Pairs of
members that are already joined are never looked at again, nor are buckets of which all members have met."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.common import mix64, word_hashes
from talkloom.llm.components import connected_components
from talkloom.session import materialise

SHINGLE_WORDS = 5
BANDS, ROWS = 20, 4
#: Bytes of the long signature of candidates (one per hash function), compared in batches.
SIGNATURE, BATCH = 512, 32
#: Members of a block; a task holds two blocks.
BLOCK = 512
SLICE = 256

_RNG = np.random.Generator(np.random.PCG64(31))
_BAND_A = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_B = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_LONG_A = _RNG.integers(0, 2**63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LONG_B = _RNG.integers(0, 2**63, SIGNATURE, dtype=np.uint64)
_PLACES = _RNG.integers(0, 2**63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a word-hash sequence; a shorter sequence is one shingle, an empty one none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    size = min(n, SHINGLE_WORDS)
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total += words[k : n - size + 1 + k] * _PLACES[k]
    return np.unique(mix64(total + np.uint64(size)))


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least hash of a set under each of several hash functions (upper 32 bits)."""
    least = np.full(len(a), 2**64 - 1, np.uint64)
    for start in range(0, len(values), 2048):
        least = np.minimum(least, (values[None, start : start + 2048] * a[:, None] + b[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def _digest(values: np.ndarray) -> bytes:
    """128 bits of a set, the same in any order."""
    other = mix64(values ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return np.array([mix64(values).sum(dtype=np.uint64), (other * np.uint64(3)).sum(dtype=np.uint64)], np.uint64).tobytes()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SLICE rows at most, so that what a worker makes of one stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, hashes, offsets in word_hashes(texts):
        for k in range(len(offsets) - 1):
            yield shingles(hashes[offsets[k] : offsets[k + 1]])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and k1, k2: 128 bits of the two together."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit("other"), "doc_id", "text").alias("k2"))


def text_sets(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, n_shingles, digest, bands for every row of `docs` (doc_id, text); bands is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sizes, digests, bands = [], [], []
            for values in _sets(batch.column("text")):
                sizes.append(len(values))
                digests.append(_digest(values))
                bands.append(minima(values, _BAND_A, _BAND_B).tobytes() if len(values) else None)
            columns = [*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "n_shingles", "digest", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs).mapInArrow(run, f"doc_id {kind}, k1 bigint, k2 bigint, n_shingles bigint, digest binary, bands binary")


def candidate_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, n, signature, bands, shingles of the texts of `wanted` (id, k1, k2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sizes, signatures, bands, sets = [], [], [], []
            for values in _sets(batch.column("text")):
                sizes.append(len(values))
                signatures.append(minima(values, _LONG_A, _LONG_B).astype(np.uint8).tobytes())
                bands.append(minima(values, _BAND_A, _BAND_B).tobytes())
                sets.append(values.view(np.int64))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            columns = [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary()), pa.array(bands, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "signature", "bands", "shingles"])

    # repeated rows are one from here on: they share their key, and all but one fall out before the shuffle
    texts = _keyed(docs).groupBy("k1", "k2").agg(F.first("text").alias("text")).join(wanted, ["k1", "k2"]).select("id", "text")
    return texts.mapInArrow(run, "id bigint, n bigint, signature binary, bands binary, shingles array<bigint>")


def least_matches(similarity: float, miss: float) -> list[int]:
    """For each number of compared batches the fewest matches with which a pair stays.

    With a flat prior and m of k matches, the posterior of the match probability is Beta(m + 1, k - m + 1), and the
    probability that it is at least t is that of at most m successes in k + 1 trials of t. Bytes also match by chance."""
    t, found = similarity + (1 - similarity) / 256, []
    for k in range(BATCH, SIGNATURE + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
        found.append(m)
    return found


def _alike(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, needed: list[int]) -> np.ndarray:
    """Which of the pairs (left[i], right[j]) survive all batches."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), np.int32)
    for step, least in enumerate(needed):
        cut = slice(step * BATCH, (step + 1) * BATCH)
        matches = matches + (left[i[alive], cut] == right[j[alive], cut]).sum(axis=1, dtype=np.int32)
        stay = matches >= least
        alive, matches = alive[stay], matches[stay]
        if not len(alive):
            break
    return alive


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIGNATURE)


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int((y[at] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _joins(rows: pa.Table, i: np.ndarray, j: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of components that verified pairs (i, j) of rows join: a spanning forest, as pairs already joined are skipped."""
    component, sets = rows["component"].to_numpy(), rows["shingles"].combine_chunks()
    offsets, values = sets.offsets.to_numpy(), sets.values.to_numpy()
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while c in up:
            c = up[c]
        return c

    unsigned = lambda k: values[offsets[k] : offsets[k + 1]].view(np.uint64)
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = root(int(component[a])), root(int(component[b]))
        if x != y and _similar(unsigned(a), unsigned(b), percent):
            up[max(x, y)] = min(x, y)
            yield min(x, y), max(x, y)


def _tasks(rows: DataFrame, compare: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`compare` over all rows of each task, wherever batches end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the rows of the task that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            tasks = batch.column("task").to_numpy()
            cuts = [0, *(np.flatnonzero(tasks[1:] != tasks[:-1]) + 1).tolist(), len(tasks)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                part = pa.Table.from_batches([batch.slice(start, end - start)])
                if held and held[0]["task"][0].as_py() != int(tasks[start]):
                    yield from compare(pa.concat_tables(held).combine_chunks())
                    held = []
                held.append(part)
        if held:
            yield from compare(pa.concat_tables(held).combine_chunks())

    return rows.repartition("task").sortWithinPartitions("task", "id").mapInArrow(run, schema)


def _likely(rows: pa.Table, percent: int, needed: list[int], first_band: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a task, of different components, that sizes and signatures leave possible."""
    side, component, n = (rows[c].to_numpy() for c in ("side", "component", "n"))
    left = np.flatnonzero(side == 0)
    if rows["alone"][0].as_py():
        i, j = (left[x] for x in np.triu_indices(len(left), 1))
    else:
        right = np.flatnonzero(side == 1)
        i, j = np.repeat(left, len(right)), np.tile(right, len(left))
    likely = (component[i] != component[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
    i, j = i[likely], j[likely]
    if len(i):
        signatures = _signatures(rows["signature"])
        alive = _alike(signatures, signatures, i, j, needed)
        if first_band and len(alive):
            bands = np.frombuffer(b"".join(rows["bands"].to_pylist()), np.uint64).reshape(len(n), BANDS, -1)
            alive = alive[(bands[i[alive]] == bands[j[alive]]).all(axis=2).argmax(axis=1) == rows["band"][0].as_py()]
        i, j = i[alive], j[alive]
    return i, j


KEYED = "task bigint, alone boolean, side int, band int, id bigint, component bigint"


def _by_task(keyed: DataFrame, sets: DataFrame, percent: int, miss: float, first_band: bool) -> DataFrame:
    """Pairs (a, b) of components that are joined by a pair of `keyed` (task, alone, side, band, id, component) in a task.

    In a task that is `alone` all pairs are compared, else those of different sides; with `first_band` only in the first
    band that the two share. First signatures alone are dealt to the tasks, which tell the members that may be alike to
    another; then these members' whole sets, to verify. A task holds at most some two blocks of members."""
    needed = least_matches(percent / 100, miss)
    columns = [c.split()[0] for c in KEYED.split(", ")]

    def members(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        i, j = _likely(rows, percent, needed, first_band)
        if len(i):
            yield from rows.select(columns).take(pa.array(np.union1d(i, j))).combine_chunks().to_batches()

    def forest(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        found = list(_joins(rows, *_likely(rows, percent, needed, first_band), percent))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    dealt = keyed.select(*[F.col(c).cast(kind) for c, kind in (x.split() for x in KEYED.split(", "))])
    likely = materialise(_tasks(dealt.join(sets.select("id", "n", "signature", "bands"), "id"), members, KEYED))
    return _tasks(likely.join(sets, "id"), forest, "a bigint, b bigint").distinct()


def _sampled(members: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Each member in one of its buckets, the one of the least hash in this turn, and there in one block at random: the
    tasks, and the buckets of which all `n` members meet in one."""
    chosen = members.groupBy("id", "component").agg(F.min_by(F.struct("bucket", "band", "n"), F.xxhash64("bucket", F.lit(turn))).alias("at"))
    dealt = materialise(chosen.select("id", "component", "at.bucket", "at.band", F.col("at.n").alias("all")))
    sizes = dealt.groupBy("bucket", "all").agg(F.count("*").alias("there"))
    met = sizes.where((F.col("there") == F.col("all")) & (F.col("there") <= BLOCK)).select("bucket")
    block = F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("there") / BLOCK))
    tasks = dealt.join(sizes.drop("all"), "bucket").select(F.xxhash64("bucket", block).alias("task"), F.lit(True).alias("alone"), F.lit(0).alias("side"), "band", "id", "component")
    return tasks, met


def _exhaustive(members: DataFrame) -> DataFrame:
    """All pairs of an outsider and another member of its bucket, by blocks.

    `members`: bucket, band, id, component, outside, outsiders and insiders (of the bucket). A pair that shares buckets in
    several bands meets in the first of them, and is in no need of it if both are insiders there."""
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    own = F.when(F.col("outside"), F.pmod(F.xxhash64("id"), blocks("outsiders"))).otherwise(F.pmod(F.xxhash64("id"), blocks("insiders"))).cast("int")
    all_outer = F.sequence(F.lit(0), blocks("outsiders") - 1)
    all_inner = F.sequence(F.lit(0), blocks("insiders") - 1)
    # a task is (outer block i, outer block j >= i) or (outer block i, inner block ~j)
    place = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    same = F.transform(all_outer, lambda o: F.when(o < F.col("own"), place(o, F.col("own"), 1)).otherwise(place(F.col("own"), o, 0)))
    outer = F.concat(same, F.transform(all_inner, lambda o: place(F.col("own"), -o - 1, 0)))
    inner = F.transform(all_outer, lambda o: place(o, -F.col("own") - 1, 1))
    dealt = members.withColumn("own", own).withColumn("at", F.explode(F.when(F.col("outside"), outer).otherwise(inner)))
    return dealt.select(F.xxhash64("bucket", "at.i", "at.j").alias("task"), (F.col("at.i") == F.col("at.j")).alias("alone"), "at.side", "band", "id", "component")


def _open_members(members: DataFrame, joined: DataFrame) -> DataFrame:
    """bucket, band, id, n, component, outside, outsiders, insiders of all buckets with members outside their main component.

    The main component is the one of most members, then the smallest. `members`: bucket, band, id, n."""
    own = members.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    shares = own.groupBy("bucket", "component").agg(F.count("*").alias("here"))
    main = shares.groupBy("bucket").agg(F.max(F.struct("here", (-F.col("component")).alias("back"))).alias("top"), F.count("*").alias("components"))
    open_buckets = main.where("components > 1").select("bucket", F.col("top.here").alias("insiders"), (-F.col("top.back")).alias("main"))
    placed = own.join(open_buckets, "bucket").withColumn("outside", F.col("component") != F.col("main")).withColumn("outsiders", F.col("n") - F.col("insiders"))
    return placed.drop("main")


def _merged(joined: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """`joined` (node, component) after pairs (a, b) of components are joined too."""
    roots = connected_components(pairs, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("root"))
    if joined is None:
        return materialise(roots.select(F.col("component").alias("node"), F.col("root").alias("component")))
    known = joined.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    single = roots.join(joined.select(F.col("node").alias("component")), "component", "left_anti")
    return materialise(known.unionByName(single.select(F.col("component").alias("node"), F.col("root").alias("component"))))


def near_duplicates(docs: DataFrame, percent: int = 85, miss: float = 1e-5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id integer, text).

    Texts are linked with 100 * intersection >= percent * union of their shingle sets. component_id is the smallest id
    reachable over links; kept says that it is the row's own. Null and blank texts have no shingles, are linked with
    nothing and kept. Rows without an id link like any others; where no row of a component has an id, component_id is
    null and its rows are kept. Several texts under one id are linked each by itself, repeated rows each get the same
    answer. Texts of any length are taken whole; a task holds the sets of two blocks of texts. An empty table gives an
    empty result; other columns are ignored.

    Two texts share no band with probability 4e-7 at similarity 0.85 and 3e-5 at 0.8; a pair is pruned by mistake with probability `miss`."""
    rows = materialise(text_sets(docs))
    grouped = rows.where("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.min(F.struct("k1", "k2")).alias("key")
    )
    classes = materialise(grouped.select("digest", "least", "bands", "key.k1", "key.k2", F.monotonically_increasing_id().alias("id")))
    width = 4 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring(F.col("bands"), k * width + 1, F.lit(width))))
    banded = classes.select("id", "k1", "k2", F.posexplode(keys).alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(banded.join(shared, "bucket"))
    sets = materialise(candidate_sets(docs, members.select("id", "k1", "k2").distinct()))
    left = members.select("bucket", "band", "id", "n")
    open_members, before, turn, joined = left.withColumn("component", F.col("id")), left.count(), 0, None
    while True:
        tasks, met = _sampled(open_members, turn)
        joined = _merged(joined, materialise(_by_task(tasks, sets, percent, miss, first_band=False)))
        left = materialise(left.join(met, "bucket", "left_anti"))
        open_members = materialise(_open_members(left, joined))
        outsiders = open_members.where("outside").count()
        if 2 * outsiders > before or not outsiders:
            break
        before, turn = outsiders, turn + 1
    if outsiders:  # they are alike to few others, so each is compared to all
        joined = _merged(joined, materialise(_by_task(_exhaustive(open_members), sets, percent, miss, first_band=True)))
    placed = classes.select("digest", "id", "least").join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = materialise(placed.select("digest", "component", "least"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of = materialise(placed.join(named, "component").select("digest", "component_id"))
    found = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(of, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = found.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, percent: int = 80, miss: float = 1e-5) -> DataFrame:
    """One row of each group, with all columns of `docs`: the one with the smallest id, rows without an id last, then by hash.

    Every row is a document of its own, so repeated rows, rows without an id and several texts under one id are linked by
    their texts like any others. Rows without words are linked with nothing; of those with the same id one stays."""
    number = "_near_dedup_row"
    rows = materialise(docs.withColumn(number, F.monotonically_increasing_id()))  # written, so that numbers stay as they are
    found = near_duplicates(rows.select(F.col(number).alias("doc_id"), "text"), percent, miss).withColumnRenamed("doc_id", number)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(*[rows[f"`{c}`"] for c in docs.columns]).alias("mix"), number)
    blank = F.col("n_shingles") == 0
    group = F.when(blank, F.coalesce("order.doc_id", number)).otherwise(F.col("component_id"))
    placed = rows.select(number, order.alias("order")).join(found, number)
    firsts = placed.groupBy(blank.alias("blank"), (blank & F.col("order.no_id")).alias("alone"), group.alias("group")).agg(F.min("order").alias("first"))
    kept = materialise(firsts.select(F.col(f"first.{number}").alias(number)))
    return rows.join(kept, number, "left_semi").select(*[f"`{c}`" for c in docs.columns])
