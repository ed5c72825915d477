"""Registered queries over the merged timeline and its context windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.operators import timeline as tl
from talkloom.operators import transcript as tr
from talkloom.plans import inputs
from talkloom.plans import oracle_inputs as oi
from talkloom.plans.scenes import SCENES, fallback_scenes
from talkloom.session import materialise

BASE = oi.with_ctes(oi.TOKENS, oi.SPEAKERS, oi.SEGMENTS, SCENES).rstrip() + " "


def timeline_overlap(spark, sf_dir):
    pairs = tl.segments_in_scenes(inputs.turn_segments(spark, sf_dir), fallback_scenes(spark, sf_dir))
    return pairs.select("video_id", "segment_id", "scene_id")


TIMELINE_OVERLAP = BASE + "SELECT s.video_id, s.segment_id, c.scene_id FROM seg s JOIN scn c ON c.video_id = s.video_id AND s.end_ms > c.start_ms AND s.start_ms < c.end_ms"

LAST = ", lst AS (SELECT *, scene_index = max(scene_index) OVER (PARTITION BY video_id) AS is_last FROM scn)"
MIDPOINT = (
    "c.video_id = t.video_id AND t.start_ms + t.end_ms >= 2 * c.start_ms AND (t.start_ms + t.end_ms < 2 * c.end_ms OR (c.is_last AND t.start_ms + t.end_ms = 2 * c.end_ms))"
)


def token_midpoint_scene(spark, sf_dir):
    toks = inputs.tokens(spark, sf_dir)
    return tl.tokens_in_scenes(toks, fallback_scenes(spark, sf_dir)).select("video_id", "pos", "scene_index")


TOKEN_MIDPOINT_SCENE = BASE + LAST + f" SELECT t.video_id, t.pos, c.scene_index FROM tok t JOIN lst c ON {MIDPOINT}"


def _roled(spark, sf_dir):
    toks = materialise(inputs.tokens(spark, sf_dir))
    return materialise(tr.attach_roles(toks, tr.speaker_profiles(toks)))


def speaker_turns(spark, sf_dir):
    """Speaker turns within every scene."""
    toks = _roled(spark, sf_dir)
    in_scene = tl.tokens_in_scenes(toks, fallback_scenes(spark, sf_dir))
    turns = tl.speech_turns(in_scene, ["video_id", "scene_id"])
    label = tl.turn_label(F.col("speaker_role"), F.col("speaker"))
    return turns.select("video_id", "scene_id", "turn_index", "start_ms", "end_ms", "start_pos", "tokens", "speaker", "speaker_role", "text", label.alias("label"))


SPEAKER_TURNS = BASE + LAST + f""",
ts AS (SELECT t.*, c.scene_id, p.role FROM tok t JOIN lst c ON {MIDPOINT} JOIN prof p ON p.video_id = t.video_id AND p.speaker = t.speaker),
fl AS (SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY scene_id ORDER BY pos) THEN 1 ELSE 0 END AS f FROM ts),
gr AS (SELECT *, CAST(sum(f) OVER (PARTITION BY scene_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS turn_index FROM fl)
SELECT video_id, scene_id, turn_index, arg_min(start_ms, pos) AS start_ms, arg_max(end_ms, pos) AS end_ms, min(pos) AS start_pos, count(*) AS tokens, any_value(speaker) AS speaker, any_value(role) AS speaker_role,
  trim(regexp_replace(string_agg(text, '' ORDER BY pos), '\\s+', ' ', 'g')) AS text,
  CASE any_value(role) WHEN 'host' THEN 'Ведущий (' || any_value(speaker) || ')' ELSE 'Закадровый вопрос (' || any_value(speaker) || ')' END AS label
FROM gr GROUP BY video_id, scene_id, turn_index"""


def _scene_visuals(spark, sf_dir, scenes):
    """Scene i of conversation c shows document (7c + i) mod N; N comes from the table itself."""
    docs = inputs.visual_events(spark, sf_dir).drop("video_id", "scene_id")
    total = inputs.table(spark, sf_dir, "documents").agg(F.count("*")).scalar()
    placed = scenes.select(
        "video_id", "scene_id", ((7 * F.col("video_id") + F.col("scene_index")) % total).alias("doc_id")
    )
    return placed.join(docs, "doc_id").drop("doc_id")


SCENE_VISUALS = ", svs AS (SELECT s.video_id AS vid, s.scene_id AS sid, v.* EXCLUDE (video_id, scene_id) FROM scn s JOIN vev v ON v.doc_id = (7 * s.video_id + s.scene_index) % (SELECT count(*) FROM documents))"


def timeline_events(spark, sf_dir):
    scenes = materialise(fallback_scenes(spark, sf_dir))
    toks = materialise(inputs.tokens(spark, sf_dir))
    segs = inputs.turn_segments(spark, sf_dir, toks)
    events = tl.scene_events(scenes, _scene_visuals(spark, sf_dir, scenes), segs, toks)
    refs = F.array_join(F.transform("source_refs", lambda r: F.concat_ws("@", r["type"], r["url"], r["start_ms"], r["end_ms"])), "|")
    return events.select(
        "video_id", "event_id", "scene_id", "start_ms", "end_ms", "speech_text", F.array_join("speech_segment_ids", ",").alias("speech_segment_ids"),
        "visual_summary", F.array_join("items", ",").alias("items"), F.array_join("topics", ",").alias("topics"), F.array_join("on_screen_text", ",").alias("on_screen_text"), refs.alias("refs"),
    )


def _dedup_strip(expr: str) -> str:
    """Stripped, non-empty, first occurrence kept; in SQL."""
    return (
        f"list_filter(list_transform({expr}, lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), "
        f"lambda s, i: s <> '' AND list_position(list_transform({expr}, lambda q: regexp_replace(q, '^\\s+|\\s+$', '', 'g')), s) = i)"
    )


HALF = "({m} // 1000 + CASE WHEN {m} % 1000 > 500 OR ({m} % 1000 = 500 AND ({m} // 1000) % 2 = 1) THEN 1 ELSE 0 END)"
URL = "'https://www.youtube.com/watch?v=' || {v} || '&t=' || ({m} // 1000) || 's'"
TIMELINE_EVENTS = oi.with_ctes(oi.TOKENS, oi.SPEAKERS, oi.SEGMENTS, SCENES, oi.VISUAL).rstrip() + LAST + SCENE_VISUALS + f""",
tsg AS (SELECT t.*, c.scene_id, s.segment_id, s.seg FROM tok t JOIN lst c ON {MIDPOINT} JOIN seg s ON s.video_id = t.video_id AND s.seg = t.turn),
pcs AS (SELECT video_id, scene_id, seg, segment_id, arg_min(start_ms, pos) AS ps, arg_max(end_ms, pos) AS pe, string_agg(text, '' ORDER BY pos) AS pt FROM tsg GROUP BY 1, 2, 3, 4),
sp AS (SELECT scene_id, trim(regexp_replace(string_agg(pt, '' ORDER BY seg), '\\s+', ' ', 'g')) AS speech_text, string_agg(segment_id, ',' ORDER BY seg) AS ids,
   string_agg('audio@' || {URL.format(v='video_id', m='ps')} || '@' || ps || '@' || pe, '|' ORDER BY seg) AS refs FROM pcs GROUP BY 1)
SELECT c.video_id, printf('%d_e_%06d_%06d', c.video_id, {HALF.format(m='c.start_ms')}, {HALF.format(m='c.end_ms')}) AS event_id, c.scene_id, c.start_ms, c.end_ms, coalesce(sp.speech_text, '') AS speech_text,
  coalesce(sp.ids, '') AS speech_segment_ids, v.visual_summary, array_to_string({_dedup_strip('v.items')}, ',') AS items, array_to_string({_dedup_strip('v.style_topics')}, ',') AS topics,
  array_to_string({_dedup_strip('v.on_screen_text')}, ',') AS on_screen_text,
  concat_ws('|', 'youtube@' || {URL.format(v='c.video_id', m='c.start_ms')} || '@' || c.start_ms || '@' || c.end_ms, sp.refs, 'visual@' || {URL.format(v='c.video_id', m='c.start_ms')} || '@' || c.start_ms || '@' || c.end_ms) AS refs
FROM lst c JOIN svs v ON v.sid = c.scene_id LEFT JOIN sp ON sp.scene_id = c.scene_id"""


def audio_timeline(spark, sf_dir):
    return tl.audio_events(inputs.turn_segments(spark, sf_dir)).select(
        "video_id", "event_id", "scene_id", "start_ms", "end_ms", "speech_text", F.col("source_refs")[0]["url"].alias("url")
    )


AUDIO_TIMELINE = BASE + f"""SELECT video_id, printf('%d_e_%06d_%06d', video_id, {HALF.format(m='start_ms')}, {HALF.format(m='end_ms')}) AS event_id, segment_id AS scene_id,
  start_ms, end_ms, text AS speech_text, {URL.format(v='video_id', m='start_ms')} AS url FROM seg"""


def timeline_gaps(spark, sf_dir):
    """Missing visual events (every eleventh is withheld) and segments with broken token ranges."""
    scenes = fallback_scenes(spark, sf_dir)
    visuals = scenes.where("scene_index % 11 <> 5").select("scene_id")
    missing = tl.missing_visual_events(scenes, visuals).select("video_id", F.col("scene_id").alias("object"), F.lit("missing_visual_event").alias("code"))
    segs = inputs.turn_segments(spark, sf_dir).withColumn("end_pos", F.when(F.col("seg") == 3, F.col("end_pos") + 100000).otherwise(F.col("end_pos"))).withColumn(
        "start_pos", F.when(F.col("seg") == 1, F.col("end_pos") + 1).otherwise(F.col("start_pos")))
    broken = tl.invalid_token_ranges(segs, inputs.tokens(spark, sf_dir))
    return missing.unionByName(broken.select("video_id", F.col("seg").cast("string").alias("object"), "code"))


TIMELINE_GAPS = BASE + """, bs AS (SELECT video_id, seg, CASE WHEN seg = 3 THEN end_pos + 100000 ELSE end_pos END AS e, CASE WHEN seg = 1 THEN end_pos + 1 ELSE start_pos END AS s FROM seg)
SELECT video_id, scene_id AS object, 'missing_visual_event' AS code FROM scn WHERE scene_index % 11 = 5
UNION ALL SELECT video_id, CAST(seg AS VARCHAR), 'inverted_range' FROM bs WHERE s > e
UNION ALL SELECT video_id, CAST(seg AS VARCHAR), 'unknown_start' FROM bs WHERE NOT EXISTS (SELECT 1 FROM tok t WHERE t.video_id = bs.video_id AND t.pos = bs.s)
UNION ALL SELECT video_id, CAST(seg AS VARCHAR), 'unknown_end' FROM bs WHERE NOT EXISTS (SELECT 1 FROM tok t WHERE t.video_id = bs.video_id AND t.pos = bs.e)"""


def media_durations(spark, sf_dir):
    ends = inputs.video_ends(inputs.tokens(spark, sf_dir))
    audio = ends.where("video_id % 13 <> 7").select("video_id", (F.col("duration_ms") / 1000).alias("audio_seconds"))
    video = ends.select(
        "video_id", ((F.col("duration_ms") + 250 * (F.col("video_id") % 8)) / 1000).alias("video_seconds"), (F.col("duration_ms") / 1000).alias("metadata_seconds")
    )
    return tl.media_durations(audio, video)


MEDIA_DURATIONS = BASE + """, d AS (SELECT video_id, CASE WHEN video_id % 13 <> 7 THEN duration_ms / 1000 END AS a, (duration_ms + 250 * (video_id % 8)) / 1000 AS v, duration_ms / 1000 AS m FROM vid)
SELECT video_id, a AS audio_seconds, v AS video_seconds, m AS metadata_seconds, round_even(abs(a - v), 4) AS gap_seconds,
  CASE WHEN a IS NULL THEN 'duration_missing' WHEN round_even(abs(a - v), 4) > 1.0 THEN 'duration_mismatch' END AS error FROM d"""


def timeline_rebuild_check(spark, sf_dir):
    """The audio timeline rebuilt and compared with a stored one in which every tenth event was altered."""
    events = materialise(audio_timeline(spark, sf_dir))
    altered = events.withColumn("end_ms", F.col("end_ms") + F.when(F.col("start_ms") % 4000 == 0, 1).otherwise(0))
    return tl.same_rows(events, altered).select("video_id", "event_id", "end_ms", "side")


TIMELINE_REBUILD_CHECK = BASE + f""", ev AS (SELECT video_id, printf('%d_e_%06d_%06d', video_id, {HALF.format(m='start_ms')}, {HALF.format(m='end_ms')}) AS event_id, start_ms, end_ms FROM seg WHERE start_ms % 4000 = 0)
SELECT video_id, event_id, end_ms, 'left_only' AS side FROM ev UNION ALL SELECT video_id, event_id, end_ms + 1, 'right_only' FROM ev"""


def scene_context_windows(spark, sf_dir):
    return tl.scene_context(fallback_scenes(spark, sf_dir), inputs.turn_segments(spark, sf_dir)).select(
        "scene_id", "zone", "segment_count", "word_count", "text"
    )


SCENE_CONTEXT = BASE + r""",
zn AS (SELECT c.scene_id, s.seg, s.text, CASE WHEN s.start_ms < c.end_ms AND s.end_ms > c.start_ms THEN 'current' WHEN s.start_ms < c.start_ms AND s.end_ms > greatest(0, c.start_ms - 5000) THEN 'previous'
   WHEN s.start_ms < c.end_ms + 2000 AND s.end_ms > c.end_ms THEN 'next' END AS zone FROM scn c JOIN seg s USING (video_id))
SELECT scene_id, zone, count(*) AS segment_count, CAST(len(regexp_extract_all(string_agg(text, chr(10) ORDER BY seg), '\S+')) AS BIGINT) AS word_count, string_agg(text, chr(10) ORDER BY seg) AS text
FROM zn WHERE zone IS NOT NULL GROUP BY 1, 2"""


def effective_profiles(spark, sf_dir):
    """A presenter profile per source; low confidence turns recurrence off."""
    docs = inputs.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))
    profiles = docs.select(
        F.col("source").alias("video_id"), (F.col("n") > 1).alias("has_primary_presenter"),
        F.when(F.col("longest") % 3 == 0, "low").otherwise("high").alias("confidence"),
        F.concat(F.lit("suit, "), "source").alias("baseline_summary"), F.array("source").alias("recurring_visual_markers"), F.lit("seen often").alias("notes"),
    )
    return tl.effective_profile(profiles).select("video_id", "has_primary_presenter", "confidence", "baseline_summary", F.array_join("recurring_visual_markers", ",").alias("markers"), "notes")


EFFECTIVE_PROFILES = """
WITH d AS (SELECT source, count(*) > 1 AS p, CASE WHEN max(n_chars) % 3 = 0 THEN 'low' ELSE 'high' END AS c FROM documents GROUP BY 1)
SELECT source AS video_id, p AND c <> 'low' AS has_primary_presenter, c AS confidence, CASE WHEN p AND c = 'low' THEN '' ELSE 'suit, ' || source END AS baseline_summary,
  CASE WHEN p AND c = 'low' THEN '' ELSE source END AS markers, CASE WHEN p AND c = 'low' THEN 'Recurrence disabled because bootstrap confidence is low. Original notes: seen often' ELSE 'seen often' END AS notes FROM d"""


QUERIES = {
    "timeline_overlap": (timeline_overlap, TIMELINE_OVERLAP),
    "token_midpoint_scene": (token_midpoint_scene, TOKEN_MIDPOINT_SCENE),
    "speaker_turns": (speaker_turns, SPEAKER_TURNS),
    "timeline_events": (timeline_events, TIMELINE_EVENTS),
    "audio_timeline": (audio_timeline, AUDIO_TIMELINE),
    "timeline_gaps": (timeline_gaps, TIMELINE_GAPS),
    "media_durations": (media_durations, MEDIA_DURATIONS),
    "timeline_rebuild_check": (timeline_rebuild_check, TIMELINE_REBUILD_CHECK),
    "scene_context_windows": (scene_context_windows, SCENE_CONTEXT),
    "effective_profiles": (effective_profiles, EFFECTIVE_PROFILES),
}
