"""Moving scene boundaries to where the palette really changes, over palette sample tables.

Samples carry (video_id, scene_index, ts_ms, saturation, colorfulness, histogram)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.config import DEFAULTS, PaletteLimits
from talkloom.operators import sequence as seq
from talkloom.session import materialise

SCENE = ["video_id", "scene_index"]


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def histogram_distance(a: Column, b: Column) -> Column:
    """Bhattacharyya distance of two histograms."""
    shared = array_sum(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)))
    mass = array_sum(a) * array_sum(b)
    scale = F.when(mass > 0, 1 / F.sqrt(mass)).otherwise(1.0)
    return F.sqrt(F.greatest(F.lit(0.0), 1 - shared * scale))


def median_of(values: Column) -> Column:
    ordered, n = F.array_sort(values), F.size(values)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def _mean_histogram(histograms: Column) -> Column:
    total = F.aggregate(
        F.slice(histograms, 2, F.size(histograms)),
        F.get(histograms, 0),
        lambda acc, h: F.zip_with(acc, h, lambda x, y: x + y),
    )
    mass = array_sum(total)
    return F.when(mass > 0, F.transform(total, lambda v: v / mass)).otherwise(total)


def window_profiles(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Profile of each sample window: count, median saturation and colourfulness, mean histogram, and the
    median distance of its samples from that mean."""
    gathered = windows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct("sample_ms", "saturation", "colorfulness", "histogram"))).alias("s"),
    )
    field = lambda name: F.transform("s", lambda x: x[name])
    return (
        gathered.withColumn("profile", _mean_histogram(field("histogram")))
        .withColumn("saturation", median_of(field("saturation")))
        .withColumn("colorfulness", median_of(field("colorfulness")))
        .withColumn(
            "spread", median_of(F.transform("s", lambda x: histogram_distance(x["histogram"], F.col("profile"))))
        )
        .drop("s")
    )


def _normalised(value: Column, threshold: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value / threshold))


def boundary_candidates(samples: DataFrame, scenes: DataFrame, limits: PaletteLimits = DEFAULTS.palette) -> DataFrame:
    """Every sample strictly inside a scene as a candidate for the cut to the next scene, with the reason
    it is rejected (NULL when it is acceptable), its confidence and distances.

    Samples meet candidates on (scene, one-second bucket), so a long scene spreads over many tasks; the
    guards run before any window is built."""
    ms = lambda s: int(round(s * 1000))
    stable, least = ms(limits.stable_window_seconds), limits.min_window_samples
    bounds = scenes.select(*SCENE, "start_ms", "end_ms")
    long_enough = (F.col("end_ms") - F.col("start_ms")) >= ms(limits.min_scene_duration_seconds)
    usable = samples.join(bounds.where(long_enough), SCENE)
    counts = usable.groupBy(*SCENE).agg(F.count("*").alias("samples"))

    first_second = usable.where((F.col("ts_ms") >= F.col("start_ms")) & (F.col("ts_ms") <= F.col("start_ms") + stable))
    heads = window_profiles(first_second.withColumn("sample_ms", F.col("ts_ms")), SCENE).select(
        "video_id", (F.col("scene_index") - 1).alias("scene_index"), F.col("n").alias("next_n"), F.col("profile").alias("next_profile")
    )
    following = bounds.select("video_id", (F.col("scene_index") - 1).alias("scene_index"), F.lit(True).alias("has_next"))
    next_counts = counts.select("video_id", (F.col("scene_index") - 1).alias("scene_index"), F.col("samples").alias("next_samples"))

    boundaries = (
        bounds.join(following, SCENE)
        .join(counts, SCENE, "left")
        .join(next_counts, SCENE, "left")
        .join(heads, SCENE, "left")
        .withColumn(
            "boundary_reason",
            F.when(F.coalesce("samples", F.lit(0)) < 2 * least, "insufficient_previous_samples")
            .when(F.coalesce("next_samples", F.lit(0)) < least, "insufficient_next_samples")
            .when(F.coalesce("next_n", F.lit(0)) < least, "insufficient_next_profile"),
        )
    )
    refused = boundaries.where("boundary_reason IS NOT NULL").select(
        *SCENE, F.lit(None).cast("long").alias("ts_ms"), F.col("boundary_reason").alias("reason"),
        *[F.lit(None).cast("double").alias(c) for c in ("confidence", "distance", "next_distance")],
    )

    inside = samples.select(*SCENE, "ts_ms").join(boundaries.where("boundary_reason IS NULL"), SCENE).where(
        (F.col("ts_ms") > F.col("start_ms")) & (F.col("ts_ms") < F.col("end_ms"))
    )
    since, until = F.col("ts_ms") - F.col("start_ms"), F.col("end_ms") - F.col("ts_ms")
    guarded = inside.withColumn(
        "guard",
        F.when(until > ms(limits.max_boundary_shift_seconds), "outside_boundary_shift_window")
        .when(F.least(since, until) < ms(limits.edge_guard_seconds), "edge_guard")
        .when(F.least(since, until) < ms(limits.min_segment_seconds), "min_segment"),
    )
    nothing = [F.lit(None).cast("double").alias(c) for c in ("confidence", "distance", "next_distance")]
    early = guarded.where("guard IS NOT NULL").select(*SCENE, "ts_ms", F.col("guard").alias("reason"), *nothing)

    open_candidates = guarded.where("guard IS NULL").select(*SCENE, "ts_ms", "next_profile")
    bucket = lambda c: F.floor(c / stable).cast("long")
    spread = open_candidates.withColumn(
        "b", F.explode(F.sequence(bucket(F.col("ts_ms") - stable), bucket(F.col("ts_ms") + 2 * stable)))
    )
    at = F.col("sample_ms") - F.col("ts_ms")
    zones = F.array_compact(
        F.array(
            F.when((at >= -stable) & (at < 0), "left"),
            F.when((at >= 0) & (at <= stable), "right"),
            F.when((at >= stable) & (at <= 2 * stable), "post"),
        )
    )
    near = samples.select(
        *SCENE, F.col("ts_ms").alias("sample_ms"), "saturation", "colorfulness", "histogram", bucket(F.col("ts_ms")).alias("b")
    )
    windows = spread.select(*SCENE, "ts_ms", "b").join(near, [*SCENE, "b"]).withColumn("zone", F.explode(zones))
    profiles = window_profiles(windows, [*SCENE, "ts_ms", "zone"])
    row = F.struct("n", "profile", "saturation", "colorfulness", "spread")
    by_candidate = profiles.groupBy(*SCENE, "ts_ms").agg(
        *[F.max_by(row, F.when(F.col("zone") == z, F.lit(1))).alias(z) for z in ("left", "right", "post")],
        *[F.max(F.when(F.col("zone") == z, F.col("n"))).alias(f"{z}_n") for z in ("left", "right", "post")],
    )
    joined = open_candidates.join(by_candidate, [*SCENE, "ts_ms"], "left")
    distance = histogram_distance(F.col("left.profile"), F.col("right.profile"))
    next_distance = histogram_distance(F.col("right.profile"), F.col("next_profile"))
    post_distance = histogram_distance(F.col("right.profile"), F.col("post.profile"))
    limit = limits.min_histogram_distance
    stability = F.greatest(
        F.lit(0.0),
        F.least(1 - _normalised(F.col("left.spread"), limit), 1 - _normalised(F.col("right.spread"), limit)),
    )
    confidence = (
        0.65 * _normalised(F.col("distance"), limit)
        + 0.20 * stability
        + 0.15
        * F.greatest(
            _normalised(F.abs(F.col("left.saturation") - F.col("right.saturation")), limits.min_saturation_delta),
            _normalised(F.abs(F.col("left.colorfulness") - F.col("right.colorfulness")), limits.min_colorfulness_delta),
        )
    )
    few = (F.coalesce("left_n", F.lit(0)) < least) | (F.coalesce("right_n", F.lit(0)) < least)
    judged = (
        joined.withColumn("distance", distance)
        .withColumn("next_distance", next_distance)
        .withColumn("confidence", confidence)
        .withColumn(
            "reason",
            F.when(few, "insufficient_window_samples")
            .when(F.col("distance") < limit, "low_histogram_distance")
            .when(F.col("next_distance") >= limit, "right_profile_not_next_scene")
            .when(F.col("confidence") < limits.min_confidence, "low_confidence")
            .when((F.coalesce("post_n", F.lit(0)) >= least) & (post_distance >= limit), "unstable_post_right_window"),
        )
    )
    columns = [*SCENE, "ts_ms", "reason", "confidence", "distance", "next_distance"]
    return refused.unionByName(early).unionByName(judged.select(*columns))


def best_adjustments(candidates: DataFrame) -> DataFrame:
    """The acceptable candidate of highest confidence per boundary, the earliest on a tie."""
    best = F.max(F.struct("confidence", (-F.col("ts_ms")).alias("t"), "distance"))
    return candidates.where("reason IS NULL").groupBy(*SCENE).agg(best.alias("b")).select(
        *SCENE, (-F.col("b.t")).alias("ts_ms"), F.col("b.confidence").alias("confidence"), F.col("b.distance").alias("distance")
    )


def rejection_histogram(candidates: DataFrame) -> DataFrame:
    return candidates.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("candidates"))


def _checked_cuts(scenes: DataFrame, adjustments: DataFrame, fps: int) -> DataFrame:
    """The cut in frames after each adjusted scene, and the reason why it can't be taken: a cut lies inside the two scenes
    that it parts."""
    cut = adjustments.select(*SCENE, F.bround(F.col("ts_ms") * fps / 1000).cast("long").alias("cut"))
    own = scenes.select(*SCENE, F.col("start_frame").alias("from_frame"))
    following = scenes.select("video_id", (F.col("scene_index") - 1).alias("scene_index"), F.col("end_frame").alias("to_frame"))
    placed = cut.join(own, SCENE, "left").join(following, SCENE, "left")
    inside = F.coalesce((F.col("cut") > F.col("from_frame")) & (F.col("cut") < F.col("to_frame")), F.lit(False))
    return placed.select(*SCENE, "cut", F.when(~inside, "invalid_adjusted_boundary").alias("reason"))


def refine_boundaries(scenes: DataFrame, adjustments: DataFrame, fps: int = 25) -> tuple[DataFrame, DataFrame]:
    """Scenes with moved boundaries in order of their frames (video_id, position, scene_index, start_frame, end_frame, moved), and
    what was refused: (video_id, scene_index, reason). Cuts outside the scenes that they part are not taken; scenes that
    two taken cuts leave without a frame go. ``scene_index`` stays that of the source, ``position`` is numbered anew."""
    checked = materialise(_checked_cuts(scenes, adjustments, fps))
    taken = checked.where("reason IS NULL").select(*SCENE, "cut")
    as_end, as_start = taken.withColumnRenamed("cut", "new_end"), taken.select("video_id", (F.col("scene_index") + 1).alias("scene_index"), F.col("cut").alias("new_start"))
    moved = materialise(
        scenes.select(*SCENE, "start_frame", "end_frame").join(as_end, SCENE, "left").join(as_start, SCENE, "left").select(
            *SCENE,
            F.coalesce("new_start", "start_frame").alias("start_frame"),
            F.coalesce("new_end", "end_frame").alias("end_frame"),
            (F.col("new_end").isNotNull() | F.col("new_start").isNotNull()).alias("moved"),
        )
    )
    empty = moved.where("end_frame <= start_frame").select(*SCENE, F.lit("invalid_final_boundary").alias("reason"))
    refused = checked.where("reason IS NOT NULL").select(*SCENE, "reason").unionByName(empty)
    kept = seq.dense_position(moved.where("end_frame > start_frame"), ["video_id"], "start_frame", "position", ties=["end_frame", "scene_index"])
    return kept.select("video_id", "position", "scene_index", "start_frame", "end_frame", "moved"), refused


def apply_adjustments(scenes: DataFrame, adjustments: DataFrame, fps: int = 25) -> DataFrame:
    """Scenes with moved boundaries; the cut after scene i becomes the start of scene i + 1, inverted scenes go."""
    moved = adjustments.select(*SCENE, F.bround(F.col("ts_ms") * fps / 1000).cast("long").alias("cut"))
    as_end = moved.withColumnRenamed("cut", "new_end")
    as_start = moved.select("video_id", (F.col("scene_index") + 1).alias("scene_index"), F.col("cut").alias("new_start"))
    return (
        scenes.select(*SCENE, "start_frame", "end_frame")
        .join(as_end, SCENE, "left")
        .join(as_start, SCENE, "left")
        .select(
            *SCENE,
            F.coalesce("new_start", "start_frame").alias("start_frame"),
            F.coalesce("new_end", "end_frame").alias("end_frame"),
            (F.col("new_end").isNotNull() | F.col("new_start").isNotNull()).alias("moved"),
        )
        .where("end_frame > start_frame")
    )
