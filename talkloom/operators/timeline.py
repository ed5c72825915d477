"""Merging speech and scenes into one timeline, speaker turns, and transcript context of scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom import fixed_values as fx
from talkloom.config import DEFAULTS
from talkloom.functions import text as tx
from talkloom.functions import times as tm
from talkloom.operators.intervals import midpoint_join, overlap_join

VIDEO = ["video_id"]


def joined_text(order: str, text: str) -> Column:
    """Token texts in order as one squashed text (aggregate)."""
    pieces = F.array_sort(F.collect_list(F.struct(order, text)))
    return tx.squash(F.array_join(F.transform(pieces, lambda p: p[text]), ""))


def source_ref(kind: str, video_id: Column, start_ms: Column, end_ms: Column, modality: str | None = None) -> Column:
    """A grounding reference: where in which video a row comes from."""
    return F.struct(
        F.lit(kind).alias("type"),
        tm.timestamp_url(video_id, start_ms).alias("url"),
        start_ms.alias("start_ms"),
        end_ms.alias("end_ms"),
        F.lit(modality).cast("string").alias("modality"),
    )


def segments_in_scenes(segments: DataFrame, scenes: DataFrame) -> DataFrame:
    """Pairs of segment and scene that overlap in time."""
    s = segments.select("video_id", "seg", "segment_id", F.col("start_ms").alias("seg_start"), F.col("end_ms").alias("seg_end"))
    c = scenes.select("video_id", "scene_index", "scene_id", F.col("start_ms").alias("scene_start"), F.col("end_ms").alias("scene_end"))
    return overlap_join(s, c, VIDEO, ("seg_start", "seg_end"), ("scene_start", "scene_end"))


def mark_last_scene(scenes: DataFrame) -> DataFrame:
    last = scenes.groupBy("video_id").agg(F.max("scene_index").alias("last_index"))
    return scenes.join(last, "video_id").withColumn("is_last", F.col("scene_index") == F.col("last_index")).drop("last_index")


def tokens_in_scenes(tokens: DataFrame, scenes: DataFrame) -> DataFrame:
    """Every token with the scene that holds its midpoint."""
    c = mark_last_scene(scenes).select(
        "video_id", "scene_index", "scene_id", "is_last", F.col("start_ms").alias("scene_start"), F.col("end_ms").alias("scene_end")
    )
    return midpoint_join(tokens, c, VIDEO, ("start_ms", "end_ms"), ("scene_start", "scene_end"), "is_last")


def tokens_in_segments(tokens: DataFrame, segments: DataFrame) -> DataFrame:
    """Tokens with the segment whose position range holds them, through an equi-join on exploded positions."""
    spread = segments.select("video_id", "seg", "segment_id", F.explode(F.sequence("start_pos", "end_pos")).alias("pos"))
    return tokens.join(spread, ["video_id", "pos"])


def invalid_token_ranges(segments: DataFrame, tokens: DataFrame) -> DataFrame:
    """Segments whose token range is upside down or names tokens that do not exist."""
    ends = tokens.select("video_id", "pos")
    start_ok = segments.select("video_id", "seg", F.col("start_pos").alias("pos")).join(ends, ["video_id", "pos"], "left_anti")
    end_ok = segments.select("video_id", "seg", F.col("end_pos").alias("pos")).join(ends, ["video_id", "pos"], "left_anti")
    return (
        segments.where("start_pos > end_pos").select("video_id", "seg", F.lit("inverted_range").alias("code"))
        .unionByName(start_ok.select("video_id", "seg", F.lit("unknown_start").alias("code")))
        .unionByName(end_ok.select("video_id", "seg", F.lit("unknown_end").alias("code")))
    )


def speech_turns(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Turns within each piece of speech: runs of one (speaker, role), blank tokens staying with the run before.

    ``keys`` name the piece (a scene or a segment), whose tokens the turn list belongs to anyway."""
    w = Window.partitionBy(*keys).orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    identity = F.struct(F.coalesce("speaker", F.lit("")).alias("s"), F.coalesce("speaker_role", F.lit("")).alias("r"))
    carried = F.last(F.when(~tx.is_blank("text"), identity), ignorenulls=True).over(so_far)
    numbered = (
        tokens.withColumn("identity", F.coalesce(carried, identity))
        .withColumn("starts", (~F.col("identity").eqNullSafe(F.lag("identity").over(w))).cast("long"))
        .withColumn("turn_index", F.sum("starts").over(so_far) - 1)
    )
    aggregates = [
        F.min_by("start_ms", "pos").alias("start_ms"),
        F.max_by("end_ms", "pos").alias("end_ms"),
        F.min("pos").alias("start_pos"),
        F.count("*").alias("tokens"),
        F.nullif(F.first("identity")["s"], F.lit("")).alias("speaker"),
        F.nullif(F.first("identity")["r"], F.lit("")).alias("speaker_role"),
        joined_text("pos", "text").alias("text"),
    ]
    if "segment_id" in tokens.columns:
        ids = F.array_sort(F.collect_set(F.struct("seg", "segment_id")))
        aggregates.append(F.transform(ids, lambda x: x["segment_id"]).alias("speech_segment_ids"))
    return numbered.groupBy(*keys, "turn_index").agg(*aggregates)


def turn_label(role: Column, speaker: Column) -> Column:
    named = speaker.isNotNull() & (speaker != "")
    return (
        F.when(role == fx.HOST, F.when(named, F.concat(F.lit(fx.HOST_LABEL + " ("), speaker, F.lit(")"))).otherwise(fx.HOST_LABEL))
        .when(
            role == fx.QUESTIONER,
            F.when(named, F.concat(F.lit(fx.QUESTIONER_LABEL + " ("), speaker, F.lit(")"))).otherwise(fx.QUESTIONER_LABEL),
        )
        .otherwise(F.coalesce(F.nullif(speaker, F.lit("")), F.lit(fx.UNKNOWN_VOICE_LABEL)))
    )


def scene_events(scenes: DataFrame, visual_events: DataFrame, segments: DataFrame, tokens: DataFrame) -> DataFrame:
    """One timeline event per scene: the speech clipped to it, the segments it took tokens from, the visual
    fields without repeats, and references to video, each audio piece and the visuals."""
    in_scene = tokens_in_scenes(tokens_in_segments(tokens, segments), scenes)
    pieces = in_scene.groupBy("video_id", "scene_id", "seg", "segment_id").agg(
        F.min_by("start_ms", "pos").alias("piece_start"),
        F.max_by("end_ms", "pos").alias("piece_end"),
        F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("words"),
    )
    speech = pieces.groupBy("video_id", "scene_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("seg", "segment_id", source_ref("audio", F.col("video_id"), F.col("piece_start"), F.col("piece_end"), "audio").alias("ref"), "words")
            )
        ).alias("p")
    )
    words = F.flatten(F.transform("p", lambda x: x["words"]))
    video_ref = source_ref("youtube", F.col("video_id"), F.col("start_ms"), F.col("end_ms"))
    visual_ref = source_ref("visual", F.col("video_id"), F.col("start_ms"), F.col("end_ms"), "visual")
    no_pieces = F.col("p").isNull()
    refs = F.when(no_pieces, F.array(video_ref, visual_ref)).otherwise(
        F.concat(F.array(video_ref), F.transform("p", lambda x: x["ref"]), F.array(visual_ref))
    )
    return (
        scenes.join(visual_events.drop("video_id"), "scene_id")
        .join(speech, ["video_id", "scene_id"], "left")
        .select(
            "video_id",
            tm.span_id(F.col("video_id"), "e", F.col("start_ms"), F.col("end_ms")).alias("event_id"),
            "scene_id", "scene_index", "start_ms", "end_ms",
            F.when(no_pieces, "").otherwise(tx.squash(F.array_join(F.transform(words, lambda x: x["text"]), ""))).alias("speech_text"),
            F.coalesce(F.transform("p", lambda x: x["segment_id"]), F.array().cast("array<string>")).alias("speech_segment_ids"),
            "visual_summary",
            tx.unique_in_order("on_screen_text").alias("on_screen_text"),
            tx.unique_in_order("items").alias("items"),
            tx.unique_in_order("style_topics").alias("topics"),
            "presenter_context",
            refs.alias("source_refs"),
        )
    )


def audio_events(segments: DataFrame) -> DataFrame:
    """Timeline without visuals: one event per segment, the visual fields empty."""
    empty = F.array().cast("array<string>")
    return segments.select(
        "video_id",
        tm.span_id(F.col("video_id"), "e", F.col("start_ms"), F.col("end_ms")).alias("event_id"),
        F.col("segment_id").alias("scene_id"),
        F.col("seg").alias("scene_index"),
        "start_ms", "end_ms",
        F.col("text").alias("speech_text"),
        F.array("segment_id").alias("speech_segment_ids"),
        F.lit("").alias("visual_summary"),
        empty.alias("on_screen_text"), empty.alias("items"), empty.alias("topics"),
        F.struct(
            F.lit(False).alias("is_recurring"), F.lit("none").alias("relevance"), F.lit("").alias("baseline_summary"),
            empty.alias("scene_deltas"), F.lit("").alias("narrative_brief"), F.lit("low").alias("confidence"),
        ).alias("presenter_context"),
        F.array(source_ref("youtube", F.col("video_id"), F.col("start_ms"), F.col("end_ms"), "audio")).alias("source_refs"),
    )


def missing_visual_events(scenes: DataFrame, visual_events: DataFrame) -> DataFrame:
    return scenes.join(visual_events.select("scene_id"), "scene_id", "left_anti").select("video_id", "scene_id")


def media_durations(audio: DataFrame, video: DataFrame, limit_seconds: float = DEFAULTS.duration_mismatch_seconds) -> DataFrame:
    """Audio against video and metadata length (seconds), the difference to four decimals, and the verdict."""
    joined = audio.join(video, "video_id", "full_outer")
    gap = F.bround(F.abs(F.col("audio_seconds") - F.col("video_seconds")), 4)
    verdict = (
        F.when(F.col("audio_seconds").isNull() | F.col("video_seconds").isNull(), "duration_missing")
        .when(F.least("audio_seconds", "video_seconds", "metadata_seconds") < 0, "duration_invalid")
        .when(gap > limit_seconds, "duration_mismatch")
    )
    return joined.select("video_id", "audio_seconds", "video_seconds", "metadata_seconds", gap.alias("gap_seconds"), verdict.alias("error"))


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows found on one side only, counting repeats: the rebuild-and-compare check (empty when equal)."""
    return (
        left.exceptAll(right).withColumn("side", F.lit("left_only"))
        .unionByName(right.select(*left.columns).exceptAll(left).withColumn("side", F.lit("right_only")))
    )


def scene_context(
    scenes: DataFrame,
    segments: DataFrame,
    before_ms: int = DEFAULTS.context_before_ms,
    after_ms: int = DEFAULTS.context_after_ms,
) -> DataFrame:
    """Transcript around each scene: segments in it, before it and after it, as counts and text.

    One join against the widened scene; a segment touching the scene itself is "current" and in no other window."""
    wide = scenes.select(
        "video_id", "scene_index", "scene_id",
        F.col("start_ms").alias("scene_start"), F.col("end_ms").alias("scene_end"),
        F.greatest(F.lit(0), F.col("start_ms") - before_ms).alias("wide_start"),
        (F.col("end_ms") + after_ms).alias("wide_end"),
    )
    s = segments.select("video_id", "seg", "text", F.col("start_ms").alias("seg_start"), F.col("end_ms").alias("seg_end"))
    pairs = overlap_join(wide, s, VIDEO, ("wide_start", "wide_end"), ("seg_start", "seg_end"))
    current = (F.col("seg_start") < F.col("scene_end")) & (F.col("seg_end") > F.col("scene_start"))
    zone = (
        F.when(current, "current")
        .when((F.col("seg_start") < F.col("scene_start")) & (F.col("seg_end") > F.col("wide_start")), "previous")
        .when((F.col("seg_start") < F.col("wide_end")) & (F.col("seg_end") > F.col("scene_end")), "next")
    )
    spoken = F.when(F.trim("text") != "", F.struct("seg", "text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(spoken)), lambda x: x["text"]), "\n")
    return (
        pairs.withColumn("zone", zone)
        .where("zone IS NOT NULL")
        .groupBy("video_id", "scene_index", "scene_id", "zone")
        .agg(F.count("*").alias("segment_count"), text.alias("text"))
        .withColumn("word_count", tx.word_count("text"))
    )


def effective_profile(profiles: DataFrame) -> DataFrame:
    """A low-confidence presenter profile disables recurrence."""
    off = F.col("has_primary_presenter") & (F.col("confidence") == "low")
    return profiles.select(
        "video_id",
        (F.col("has_primary_presenter") & ~off).alias("has_primary_presenter"),
        "confidence",
        F.when(off, "").otherwise(F.col("baseline_summary")).alias("baseline_summary"),
        F.when(off, F.array().cast("array<string>")).otherwise(F.col("recurring_visual_markers")).alias("recurring_visual_markers"),
        F.when(off, F.concat(F.lit("Recurrence disabled because bootstrap confidence is low. Original notes: "), "notes"))
        .otherwise(F.col("notes")).alias("notes"),
    )
