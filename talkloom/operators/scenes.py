"""Scene tiling, scene checks, frame plans and probe selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.config import DEFAULTS, SceneLimits
from talkloom.functions import times as tm
from talkloom.operators import sequence as seq

VIDEO = ["video_id"]


def fallback_boundaries(videos: DataFrame, fps: int = 25, limits: SceneLimits = DEFAULTS.scene) -> DataFrame:
    """Fixed-length tiling in frames of (video_id, duration_ms), the last tile clipped."""
    final = F.greatest(F.lit(1), F.bround(F.col("duration_ms") * fps / 1000)).cast("long")
    step = max(1, limits.fallback_scene_seconds * fps)
    return (
        videos.withColumn("final", final)
        .withColumn("start_frame", F.explode(F.sequence(F.lit(0).cast("long"), F.col("final") - 1, F.lit(step).cast("long"))))
        .select("video_id", "start_frame", F.least(F.col("start_frame") + step, F.col("final")).alias("end_frame"))
    )


def scenes_from_boundaries(boundaries: DataFrame, fps: int = 25) -> DataFrame:
    """Boundaries as numbered scenes; empty ones keep their ordinal but give no scene."""
    numbered = seq.dense_position(boundaries, VIDEO, "start_frame", "scene_index", ties=["end_frame"])
    start_ms = F.bround(F.col("start_frame") * 1000 / fps).cast("long")
    end_ms = F.bround(F.col("end_frame") * 1000 / fps).cast("long")
    return numbered.where("end_frame > start_frame").select(
        "video_id",
        "scene_index",
        tm.ordinal_id(F.col("video_id"), "scene", F.col("scene_index")).alias("scene_id"),
        "start_frame", "end_frame",
        start_ms.alias("start_ms"),
        end_ms.alias("end_ms"),
        (end_ms - start_ms).alias("duration_ms"),
    )


def scene_violations(scenes: DataFrame) -> DataFrame:
    """Scenes breaking the rules: wrong identifier, no length, gap or overlap with the one before."""
    paired = seq.neighbour_window(
        scenes, VIDEO, "scene_index",
        lambda w: {"prev_end": F.lag("end_frame").over(w), "prev_index": F.lag("scene_index").over(w)}, ahead=0, dense=False,
    )
    codes = F.array_compact(
        F.array(
            F.when(F.col("scene_id") != tm.ordinal_id(F.col("video_id"), "scene", F.col("scene_index")), "wrong_scene_id"),
            F.when(F.col("start_frame") >= F.col("end_frame"), "empty_scene"),
            F.when(F.col("prev_end") != F.col("start_frame"), "coverage_gap_or_overlap"),
            F.when(F.coalesce(F.col("prev_index"), F.lit(-1)) + 1 != F.col("scene_index"), "ordinal_hole"),
        )
    )
    return paired.select("video_id", "scene_index", F.explode(codes).alias("code"))


def scene_statistics(scenes: DataFrame) -> DataFrame:
    return scenes.groupBy("video_id").agg(
        F.count("*").alias("scenes_count"),
        F.min("duration_ms").alias("min_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.bround(F.avg("duration_ms"), 3).alias("avg_ms"),
    )


def scene_report(detected: DataFrame, scenes: DataFrame, adjustments: DataFrame, videos: DataFrame) -> DataFrame:
    """Per video: scenes detected and final, whether the fallback tiling was used, shifted boundaries, gaps."""
    found = detected.groupBy("video_id").agg(F.count("*").alias("detected_scenes"))
    shifted = adjustments.groupBy("video_id").agg(F.count("*").alias("boundary_adjustments"))
    gaps = scene_violations(scenes).where("code = 'coverage_gap_or_overlap'").groupBy("video_id").agg(F.count("*").alias("coverage_warnings"))
    joined = videos.select("video_id")
    for part in (found, scene_statistics(scenes), shifted, gaps):
        joined = joined.join(part, "video_id", "left")
    counts = ["detected_scenes", "scenes_count", "boundary_adjustments", "coverage_warnings"]
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts}).withColumn(
        "fallback_used", F.col("detected_scenes") == 0
    )


def report_drift(reports: DataFrame, config: dict[str, object]) -> DataFrame:
    """Report fields that disagree with the current configuration, one row each (NULL-safe)."""
    pairs = F.array_compact(
        F.array(*[F.when(~F.col(k).eqNullSafe(F.lit(v)), F.lit(k)) for k, v in config.items()])
    )
    return reports.select("video_id", F.explode(pairs).alias("field"))


def _bounds(limits: SceneLimits) -> tuple[Column, Column]:
    start, end = F.col("start_ms"), F.col("end_ms")
    inset = F.lit(limits.edge_inset_ms)
    room = end - start > 2 * limits.edge_inset_ms
    low = F.when(room, start + inset).otherwise(start)
    high = F.when(room, end - inset).otherwise(F.greatest(end - 1, start))
    return low, F.greatest(high, low)


def frame_plan(scenes: DataFrame, limits: SceneLimits = DEFAULTS.scene) -> DataFrame:
    """Where to take frames in each scene: at most ``max_frames_per_scene`` slots, so everything
    downstream that looks at the frames of one scene looks at a handful of rows."""
    seconds = F.col("duration_ms") / 1000
    wanted = F.greatest(F.lit(limits.images_per_scene), F.ceil(seconds / limits.extra_sample_every_seconds))
    count = (
        F.when(seconds <= 4, F.least(F.lit(1), F.lit(limits.max_frames_per_scene)))
        .when(seconds <= 8, F.least(F.lit(2), F.lit(limits.max_frames_per_scene)))
        .otherwise(F.greatest(F.lit(1), F.least(F.lit(limits.max_frames_per_scene), wanted)))
        .cast("int")
    )
    fractions = (
        F.when(F.col("n") <= 1, F.array(F.lit(0.5)))
        .when(F.col("n") == 2, F.array(F.lit(0.33), F.lit(0.67)))
        .when(F.col("n") == 3, F.array(F.lit(0.15), F.lit(0.5), F.lit(0.85)))
        .otherwise(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i + 0.5) / F.col("n")))
    )
    low, high = _bounds(limits)
    at = F.transform(
        "fractions",
        lambda f: F.bround(tm.clamp(F.col("start_ms") + F.col("duration_ms") * f, low, high)).cast("long"),
    )
    planned = (
        scenes.withColumn("n", count)
        .withColumn("fractions", fractions)
        .withColumn("at", at)
        .select("*", F.posexplode(F.array_distinct("at")).alias("i", "planned_ms"))
    )
    slot = F.array_position("at", F.col("planned_ms")) - 1
    key_slots = F.least(F.col("n"), F.lit(limits.images_per_scene))
    return planned.select(
        "video_id", "scene_id", "scene_index", "start_ms", "end_ms",
        (F.col("i") + 1).cast("long").alias("image_index"),
        "planned_ms",
        F.when(slot < key_slots, "keyframe").otherwise("sample").alias("frame_role"),
    )


def probe_grid(plan: DataFrame, limits: SceneLimits = DEFAULTS.scene) -> DataFrame:
    """Requested probe times around every planned frame: clamped, unique, sorted."""
    low, high = _bounds(limits)
    offsets = F.array(*[F.lit(o) for o in range(-limits.probe_window_ms, limits.probe_window_ms + 1, limits.probe_step_ms)])
    requested = F.transform(offsets, lambda o: tm.clamp(F.col("planned_ms") + o, low, high).cast("long"))
    planned = F.array(tm.clamp(F.col("planned_ms"), low, high).cast("long"))
    return plan.withColumn("requested", F.array_sort(F.array_union(requested, planned)))


def nearest_requested(probes: DataFrame) -> DataFrame:
    """For each probe the nearest requested time, the earlier one on a tie."""
    best = F.array_min(F.transform("requested", lambda t: F.struct(F.abs(t - F.col("ts_ms")).alias("d"), t.alias("t"))))
    return probes.withColumn("requested_ms", best["t"])


def select_probe(probes: DataFrame, keys: list[str], limits: SceneLimits = DEFAULTS.scene) -> DataFrame:
    """Keep the probe nearest to the plan while its score is close enough to the best one's."""
    probe = F.struct("probe", "ts_ms", "score")
    chosen = probes.groupBy(*keys).agg(
        F.min_by(probe, F.struct(F.abs(F.col("ts_ms") - F.col("planned_ms")), "probe")).alias("planned"),
        F.max_by(probe, F.struct(F.col("score"), (-F.col("probe")).alias("p"))).alias("best"),
        F.count("*").alias("probes"),
    )
    keep = F.col("planned.score") >= F.col("best.score") * limits.planned_score_ratio
    selected = F.when(keep, F.col("planned")).otherwise(F.col("best"))
    same = selected["probe"] == F.col("planned.probe")
    return chosen.select(
        *keys,
        "probes",
        selected["probe"].alias("selected_probe"),
        selected["ts_ms"].alias("ts_ms"),
        selected["score"].alias("score"),
        F.when(same, "planned_nearest_kept").otherwise("replaced_by_higher_quality_probe").alias("decision"),
    )


def bootstrap_sample(scenes: DataFrame, limit: int = DEFAULTS.bootstrap_scene_limit) -> DataFrame:
    """Scenes a presenter profile is drawn from: the first three of the first half, then evenly spaced ones.

    The wanted indexes follow from the scene count alone, so only an equi-join on them is needed."""
    counts = scenes.groupBy("video_id").agg(F.max("scene_index").alias("last"))
    half = F.greatest(F.lit(1), F.floor((F.col("last") + 1) / 2)).cast("int")
    early = F.least(F.lit(3), F.lit(limit), F.col("half"))
    left = F.lit(limit) - F.col("early")
    free = F.col("half") - F.col("early")
    step = (F.col("free") - 1) / F.greatest(F.col("left") - 1, F.lit(1))
    spaced = F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("left") - 1, F.lit(0))),
        lambda i: (F.col("early") + F.bround(i * step)).cast("int"),
    )
    rest = (
        F.when((F.col("left") <= 0) | (F.col("free") <= 0), F.array().cast("array<int>"))
        .when(F.col("left") >= F.col("free"), F.sequence(F.col("early"), F.col("half") - 1))
        .otherwise(spaced)
    )
    wanted = (
        counts.withColumn("half", half)
        .withColumn("early", early)
        .withColumn("left", left)
        .withColumn("free", free)
        .withColumn("picked", F.slice(F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), F.col("early") - 1), rest))), 1, limit))
        .select("video_id", F.explode(F.col("picked").cast("array<bigint>")).alias("scene_index"))
    )
    return wanted.join(scenes, ["video_id", "scene_index"])


def middle_frame(frames: DataFrame) -> DataFrame:
    """The middle frame of each scene (a scene holds at most the planned handful of frames)."""
    ordered = F.array_sort(F.collect_list(F.struct("ts_ms", "path")))
    return frames.groupBy("video_id", "scene_id").agg(ordered.alias("f")).select(
        "video_id", "scene_id", F.get("f", F.floor(F.size("f") / 2).cast("int"))["path"].alias("path")
    )
