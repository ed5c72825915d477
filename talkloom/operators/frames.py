"""Frame quality, quality drop and near-duplicate removal over frame feature tables.

The frame plan puts at most ``max_frames_per_scene`` frames into a scene, but any number is taken. The quality rule folds
over a scene's array of narrow fields inside the JVM. Near-duplicates are found by bands of their hashes, and the ordered
rule then streams over a scene's conflicts, one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.config import DEFAULTS, SceneLimits
from talkloom.operators import sequence as seq
from talkloom.session import materialise

HASH_BITS = 64
#: From this distance on bands of a hash tell hardly anything apart, and half of all pairs are alike anyway.
DENSE_DISTANCE = 16
#: Frames of a block where all pairs of a scene are compared.
PAIR_BLOCK = 256

SEVERE = ["transition_like", "gray_transition_like", "high_central_blurred_tile_ratio"]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("long")


def percentile_of(values: Column, q: float) -> Column:
    """Percentile of a number array with linear interpolation."""
    ordered = F.array_sort(values)
    at = (F.size(values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    high = F.ceil(at).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, high)
    return a + (b - a) * (at - low)


def central_tiles(grid: int) -> list[int]:
    """Indexes of the tiles around the middle of a square grid."""
    if grid <= 1:
        return [0]
    inner = [r for r in range(grid) if grid / 2 - 1 <= r <= grid / 2]
    return [r * grid + c for r in inner for c in inner]


def tile_ratios(frames: DataFrame, limits: SceneLimits = DEFAULTS.scene, threshold: float = 20.0) -> DataFrame:
    """Blurred-tile ratios and percentiles out of the per-tile sharpness array ``tiles``."""
    centre = F.array(*[F.get("tiles", F.lit(i)) for i in central_tiles(limits.grid_size)])

    def ratio(values: Column) -> Column:
        present = F.array_compact(values)
        share = F.size(F.filter(present, lambda t: t < threshold)) / F.size(present)
        return F.when(F.size(present) == 0, F.lit(0.0)).otherwise(share)

    return frames.withColumns(
        {
            "blurred_tile_ratio": ratio(F.col("tiles")),
            "central_blurred_tile_ratio": ratio(centre),
            "tile_p10": percentile_of(F.col("tiles"), 0.1),
            "tile_p50": percentile_of(F.col("tiles"), 0.5),
            "tile_p90": percentile_of(F.col("tiles"), 0.9),
        }
    )


def quality(frames: DataFrame, limits: SceneLimits = DEFAULTS.scene) -> DataFrame:
    """Flags, score and class of every frame from its metrics."""
    c = F.col
    low_sharp = c("global_sharpness") < 35
    low_contrast = c("contrast") < 18
    low_edges = c("edge_density") < 0.035
    low_sat = (c("mean_saturation") < 18) & (c("saturation_p90") < 32)
    central = c("central_blurred_tile_ratio") >= 0.5
    grey = low_sat & (c("contrast") < 30) & (c("edge_density") < 0.06)
    flags = F.array_compact(
        F.array(
            F.when(low_sharp, "low_global_sharpness"),
            F.when(low_contrast, "low_contrast"),
            F.when(low_edges, "low_edge_density"),
            F.when(low_sat, "low_saturation"),
            F.when(c("blurred_tile_ratio") >= 0.65, "high_blurred_tile_ratio"),
            F.when(central, "high_central_blurred_tile_ratio"),
            F.when(low_sharp & (low_contrast | low_edges), "transition_like"),
            F.when(central & ~low_sharp, "partial_blur_like"),
            F.when(grey, "gray_transition_like"),
        )
    )

    def log_share(value: Column, reference: float) -> Column:
        return F.least(F.lit(1.0), F.log1p(F.greatest(F.lit(0.0), value)) / F.log1p(F.lit(reference)))

    score = (
        0.55 * log_share(c("global_sharpness"), 180.0)
        + 0.20 * log_share(c("contrast"), 48.0)
        + 0.15 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("edge_density")) / 0.16)
        - 0.10 * c("blurred_tile_ratio")
        - (0.20 * limits.central_region_weight / 1.5) * c("central_blurred_tile_ratio")
        - F.when(grey, 0.18).otherwise(0.0)
    )
    severe = F.arrays_overlap(F.col("flags"), F.array(*[F.lit(s) for s in SEVERE]))
    return (
        frames.withColumn("flags", flags)
        .withColumn("score", F.greatest(F.lit(0.0), F.bround(score, 6)))
        .withColumn("quality_class", F.when(severe, "low_quality_kept").otherwise("good"))
    )


def _scene_arrays(frames: DataFrame, keys: list[str], order: str, fields: list[str], limits: SceneLimits) -> DataFrame:
    """One ordered array of frames per scene, however many it holds; only the named narrow fields are gathered."""
    rows = F.array_sort(F.collect_list(F.struct(order, *fields)))
    return frames.groupBy(*keys).agg(rows.alias("frames"))


def quality_drop(frames: DataFrame, keys: list[str], limits: SceneLimits = DEFAULTS.scene, min_frames: int = 1) -> DataFrame:
    """Drop low-quality frames in order, keeping a minimum per scene and its only keyframe."""
    scenes = _scene_arrays(frames, keys, "image_index", ["frame_role", "quality_class"], limits)
    is_key = lambda f: f["frame_role"] == "keyframe"
    start = F.struct(
        F.size("frames").alias("left"),
        F.size(F.filter("frames", is_key)).alias("keys"),
        F.array().cast("array<struct<image_index:bigint,status:string,guard:string>>").alias("out"),
    )

    def step(acc: Column, f: Column) -> Column:
        low = f["quality_class"] == "low_quality_kept"
        at_min = acc["left"] <= min_frames
        only_key = (acc["keys"] <= 1) & is_key(f)
        drop = low & ~at_min & ~only_key
        row = F.struct(
            f["image_index"].cast("long").alias("image_index"),
            F.when(drop, "low_quality_dropped").otherwise(f["quality_class"]).alias("status"),
            F.when(low & at_min, "min_scene_guard").when(low & only_key, "only_keyframe_guard").alias("guard"),
        )
        return F.struct(
            (acc["left"] - drop.cast("int")).alias("left"),
            (acc["keys"] - (drop & is_key(f)).cast("int")).alias("keys"),
            F.concat(acc["out"], F.array(row)).alias("out"),
        )

    folded = scenes.select(*keys, F.explode(F.aggregate("frames", start, step)["out"]).alias("f"))
    return folded.select(*keys, "f.image_index", "f.status", "f.guard")


def hash_bands(max_distance: int) -> tuple[list[tuple[int, int]], int]:
    """(offset, width) of bands of a hash, and the distance that some band of two hashes keeps to (pigeonhole): 0 for few
    differing bits, so that bands are equal, else 1, so that one bit is flipped at most."""
    n = max_distance + 1 if max_distance < 4 else (max_distance + 2) // 2
    cuts = [HASH_BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)], max_distance // n


def hamming_pairs(frames: DataFrame, keys: list[str], max_distance: int, limits: SceneLimits = DEFAULTS.scene) -> DataFrame:
    """Pairs of frames of a scene (keys, left_index < right_index, distance) whose hashes differ in few bits.

    Multi-index hashing: a pair is found in the first band in which it is close enough, and there alone, so frames that
    are not alike hardly ever meet. For distances at which bands don't tell frames apart, all pairs are compared by blocks."""
    sides = [frames.where("phash IS NOT NULL").select(*keys, F.col("image_index").alias(f"{side}_index"), F.col("phash").alias(f"{side}_hash")) for side in ("left", "right")]
    if max_distance >= DENSE_DISTANCE:
        met = _all_pairs(*sides, keys)
    else:
        met = _banded_pairs(*sides, keys, max_distance)
    distance = hamming(F.col("left_hash"), F.col("right_hash"))
    return met.select(*keys, "left_index", "right_index", distance.alias("distance")).where((F.col("distance") <= max_distance) & (F.col("left_index") < F.col("right_index")))


def _banded_pairs(left: DataFrame, right: DataFrame, keys: list[str], max_distance: int) -> DataFrame:
    bands, radius = hash_bands(max_distance)

    def band(value: Column, k: int) -> Column:
        offset, width = bands[k]
        return F.shiftrightunsigned(value, offset).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))

    def probes(value: Column, k: int) -> Column:
        own = band(value, k)
        flipped = [own.bitwiseXOR(F.lit(1 << b)) for b in range(bands[k][1])] if radius else []
        return F.array(*[F.struct(F.lit(k).alias("band"), v.alias("value")) for v in [own, *flipped]])

    asked = left.withColumn("b", F.explode(F.concat(*[probes(F.col("left_hash"), k) for k in range(len(bands))])))
    stored = right.withColumn("b", F.explode(F.array(*[F.struct(F.lit(k).alias("band"), band(F.col("right_hash"), k).alias("value")) for k in range(len(bands))])))
    joined = asked.join(stored, [*keys, "b"])
    differing = F.col("left_hash").bitwiseXOR(F.col("right_hash"))
    first = F.coalesce(*[F.when(F.bit_count(band(differing, k)) <= radius, k) for k in range(len(bands))])
    return joined.where(first == F.col("b.band"))


def _all_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    sizes = left.groupBy(*keys).agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("n"))
    place = lambda side: F.pmod(F.xxhash64(f"{side}_index"), F.col("n")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    one = left.join(sizes, keys).withColumn("i", place("left")).withColumn("j", every).drop("n")
    two = right.join(sizes, keys).withColumn("j", place("right")).withColumn("i", every).drop("n")
    return one.join(two, [*keys, "i", "j"])


def drop_near_duplicates(
    frames: DataFrame,
    keys: list[str],
    limits: SceneLimits = DEFAULTS.scene,
    *,
    max_distance: int | None = None,
    min_frames: int | None = None,
) -> DataFrame:
    """Greedy near-duplicate removal in time order against the frames kept so far.

    The earliest keyframe (or else the first frame) is protected; when fewer than ``min_frames`` stay, the
    sharpest dropped ones come back. Returns every frame with kept, matched_index and distance.

    Frames of one hash share their conflicts, so only the first of each and the protected frame are compared. A scene of
    any size is held as rows; of those that the ordered rule goes through, it keeps only which frames have stayed."""
    distance = limits.phash_max_distance if max_distance is None else max_distance
    floor = limits.min_frames_per_scene if min_frames is None else min_frames
    place = F.struct("ts_ms", "image_index")
    rows = frames.select(*keys, F.col("image_index").cast("long").alias("image_index"), F.col("ts_ms").cast("long").alias("ts_ms"), "frame_role", F.col("phash").cast("long").alias("phash"), "sharpness")
    guarded = rows.groupBy(*keys).agg(F.min(F.when(F.col("frame_role") == "keyframe", place)).alias("k"), F.min("image_index").alias("i"))
    firsts = rows.where("phash IS NOT NULL").groupBy(*keys, "phash").agg(F.min(place).alias("first"))
    # frames without a hash have no conflicts and stay
    same_hash = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys] + [F.col("r.phash") == F.col("f.phash")]
    joined = rows.join(guarded.select(*keys, F.coalesce("k.image_index", "i").alias("protected")), keys).alias("r").join(firsts.alias("f"), same_hash, "left")
    marked = materialise(
        joined.select(*[F.col(f"r.{c}") for c in rows.columns], F.col("f.first.image_index").alias("first_index"), (F.col("r.image_index") == F.col("r.protected")).alias("protected"))
    )
    nodes = marked.where((F.col("image_index") == F.coalesce("first_index", "image_index")) | F.col("protected"))
    pairs = hamming_pairs(nodes, keys, distance)
    both = pairs.select(*keys, F.col("left_index").alias("image_index"), F.col("right_index").alias("other"), "distance").unionByName(
        pairs.select(*keys, F.col("right_index").alias("image_index"), F.col("left_index").alias("other"), "distance")
    )
    times = nodes.select(*keys, F.col("image_index").alias("other"), F.col("ts_ms").alias("other_ts"))
    conflicts = both.join(times, [*keys, "other"])
    earlier = (F.col("other_ts") < F.col("ts_ms")) | ((F.col("other_ts") == F.col("ts_ms")) & (F.col("other") < F.col("n.image_index")))
    on = [F.col(f"n.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys] + [F.col("n.image_index") == F.col("c.image_index"), earlier]
    asked = nodes.alias("n").join(conflicts.alias("c"), on, "left").select(*[f"n.{k}" for k in keys], "n.image_index", "n.ts_ms", "n.protected", "other", "other_ts", "distance")
    decided = materialise(_kept_in_order(asked, keys))
    # a later frame of the same hash matches what its first one matched, or else that one itself
    named = decided.select(*keys, F.col("image_index").alias("node"), "kept", "matched_index", "distance")
    of_first = named.select(*keys, F.col("node").alias("first_index"), F.coalesce("matched_index", "node").alias("m"), F.coalesce("distance", F.lit(0).cast("long")).alias("d"))
    late = marked.where((F.col("image_index") != F.col("first_index")) & ~F.col("protected")).join(of_first, [*keys, "first_index"])
    dropped_late = late.select(*keys, "image_index", "ts_ms", "sharpness", F.lit(False).alias("kept"), F.col("m").alias("matched_index"), F.col("d").alias("distance"))
    own = nodes.select(*keys, "image_index", "ts_ms", "sharpness").join(decided.drop("ts_ms"), [*keys, "image_index"])
    matched = F.when(~F.col("kept"), F.col("matched_index")), F.when(~F.col("kept"), F.col("distance"))
    every = own.select(*keys, "image_index", "ts_ms", "sharpness", "kept", matched[0].alias("matched_index"), matched[1].alias("distance")).unionByName(dropped_late)
    missing = every.groupBy(*keys).agg((F.lit(floor) - F.count_if("kept")).alias("missing")).where("missing > 0")
    short = every.where("NOT kept").join(missing, keys).withColumn("blur", -F.col("sharpness"))
    best = seq.first_n(short, keys, ["blur", "ts_ms", "image_index"], max(floor, 1), "image_index")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("blur", "ts_ms", "image_index"))
    back = best.withColumn("rank", rank).where(F.col("rank") <= F.col("missing")).select(*keys, "image_index", F.lit(True).alias("back"))
    out = every.join(back, [*keys, "image_index"], "left")
    returned = F.col("back").isNotNull()
    return out.select(
        *keys,
        "image_index",
        (F.col("kept") | returned).alias("kept"),
        F.when(~returned, F.col("matched_index")).alias("matched_index"),
        F.when(~returned, F.col("distance")).alias("distance"),
    )


def _kept_in_order(conflicts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, image_index, ts_ms, kept, matched_index, distance of every frame of ``conflicts``: a row for each earlier frame that
    one conflicts with, or one with null. In time order a frame stays if it is protected or no conflicting one has stayed."""
    names = [*keys, "image_index", "ts_ms", "kept", "matched_index", "distance"]
    fields = {f.name: f.dataType.simpleString() for f in conflicts.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", image_index bigint, ts_ms bigint, kept boolean, matched_index bigint, distance bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scene, stayed = None, set()
        now: list | None = None  # the frame whose conflicts are being read

        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys] + [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            columns = [batch.column(c).to_pylist() for c in (*keys, "image_index", "ts_ms", "protected", "other", "distance")]
            done = []
            for row in zip(*columns, strict=True):
                own, (index, ts, protected, other, distance) = row[: len(keys)], row[len(keys) :]
                if now is None or now[: len(keys) + 1] != [*own, index]:
                    if now is not None:
                        done.append(settle(now, stayed))
                    if own != scene:
                        scene, stayed = own, set()
                    now = [*own, index, ts, protected, None, None]
                if now[-2] is None and other is not None and other in stayed:
                    now[-2:] = other, distance
            if done:
                yield batch_of(done, kinds)
        if now is not None:
            yield batch_of([settle(now, stayed)], kinds)

    def settle(frame: list, stayed: set) -> tuple:
        kept = frame[-3] or frame[-2] is None
        if kept:
            stayed.add(frame[len(keys)])
        return (*frame[:-3], kept, *frame[-2:])

    def batch_of(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    ordered = conflicts.repartition(*keys).sortWithinPartitions(*keys, "ts_ms", "image_index", "other_ts", "other")
    return ordered.mapInArrow(run, schema)


def frame_outcomes(frames: DataFrame, keys: list[str], limits: SceneLimits = DEFAULTS.scene, **dedup) -> DataFrame:
    """Every frame as kept, dropped for quality, or dropped as a near-duplicate of another frame."""
    dropped = quality_drop(frames, keys, limits)
    with_status = frames.join(dropped, [*keys, "image_index"])
    survivors = with_status.where("status <> 'low_quality_dropped'")
    dedup_rows = drop_near_duplicates(survivors, keys, limits, **dedup)
    return with_status.join(dedup_rows, [*keys, "image_index"], "left").select(
        *keys,
        "image_index",
        F.when(F.col("status") == "low_quality_dropped", "quality_dropped")
        .when(F.col("kept"), "kept")
        .otherwise("duplicate")
        .alias("outcome"),
        "guard", "matched_index", "distance",
    )


def extraction_report(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Totals per key and the cross-check that they add up."""
    return outcomes.groupBy(*keys).agg(
        F.count("*").alias("frames_planned"),
        F.count_if(F.col("outcome") == "kept").alias("frames_kept"),
        F.count_if(F.col("outcome") == "quality_dropped").alias("dropped_quality"),
        F.count_if(F.col("outcome") == "duplicate").alias("dropped_duplicate"),
        F.count("guard").alias("guarded"),
    ).withColumn(
        "adds_up", F.col("frames_kept") + F.col("dropped_quality") + F.col("dropped_duplicate") == F.col("frames_planned")
    )
