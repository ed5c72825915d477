"""Registered queries over chunk plans and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.config import ChunkLimits
from talkloom.operators import chunks as ch
from talkloom.operators import timeline as tl
from talkloom.plans import inputs
from talkloom.plans import oracle_inputs as oi
from talkloom.plans.scenes import SCENES, fallback_scenes
from talkloom.plans.timeline import HALF, _scene_visuals
from talkloom.plans.visual import RULES, _is_presentation, _is_technical, _ordered_unique
from talkloom.session import materialise

SMALL = ChunkLimits(window_segments=3, max_segments=3, max_words=150)
BASE = oi.with_ctes(oi.TOKENS, oi.SPEAKERS, oi.SEGMENTS, """
lead_seg AS (SELECT *, lead(speaker_role) OVER w AS nr, lead(start_ms) OVER w AS ns FROM seg WINDOW w AS (PARTITION BY video_id ORDER BY seg)),
sq AS (SELECT *, coalesce(speaker_role = 'offscreen_questioner' AND nr = 'host' AND greatest(0, ns - end_ms) <= 12000, false) AS asks FROM lead_seg),
sn AS (SELECT video_id, max(seg) + 1 AS n FROM seg GROUP BY 1)""").rstrip() + " "
BASE_R = BASE.replace("WITH ", "WITH RECURSIVE ", 1)


def _segs(spark, sf_dir):
    return materialise(inputs.turn_segments(spark, sf_dir))


def qa_pairs(spark, sf_dir):
    return ch.mark_questions(_segs(spark, sf_dir)).where("asks_next").select("video_id", "seg", "segment_id", "speaker")


QA_PAIRS = BASE + "SELECT video_id, seg, segment_id, speaker FROM sq WHERE asks"


def planner_windows(spark, sf_dir):
    return ch.planner_windows(_segs(spark, sf_dir), SMALL)


PLANNER_WINDOWS = BASE_R + """,
ww AS (
  SELECT video_id, n, 1 AS w, CAST(0 AS BIGINT) AS s FROM sn
  UNION ALL SELECT w.video_id, w.n, w.w + 1, CASE WHEN q.asks THEN w.s + 2 ELSE w.s + 3 END FROM ww w JOIN sq q ON q.video_id = w.video_id AND q.seg = w.s + 2 WHERE w.s + 3 < w.n),
we AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY video_id ORDER BY w), n) - 1 AS e FROM ww)
SELECT video_id, CAST(w AS BIGINT) AS window_index, s AS first_seg, e AS last_seg, greatest(0, s - 3) AS context_first, least(n - 1, e + 3) AS context_last FROM we"""


def plan_proposed(spark, sf_dir):
    return ch.propose_plan(_segs(spark, sf_dir), SMALL).select("video_id", "chunk_index", F.array_join("speech_segment_ids", ",").alias("ids"), "title", F.array_join("topics", ",").alias("topics"))


CLIP = "CASE WHEN length({x}) <= {n} THEN {x} WHEN NOT contains(rtrim(substring({x}, 1, {n})), ' ') THEN rtrim(substring({x}, 1, {n})) ELSE coalesce(nullif(rtrim(regexp_replace(rtrim(substring({x}, 1, {n})), ' [^ ]*$', '')), ''), rtrim(substring({x}, 1, {n}))) END"
PACK = BASE_R + """,
fit AS (SELECT a.video_id, a.seg AS i, max(b.seg) + 1 AS j FROM (SELECT a.video_id, a.seg, b.seg AS bs, sum(b.words) OVER (PARTITION BY a.video_id, a.seg ORDER BY b.seg) AS cw FROM sq a JOIN sq b ON b.video_id = a.video_id AND b.seg BETWEEN a.seg AND a.seg + 2) a
    JOIN sq b ON b.video_id = a.video_id AND b.seg = a.bs WHERE a.cw <= 150 OR a.bs = a.seg GROUP BY 1, 2),
nx AS (SELECT f.video_id, f.i, CASE WHEN f.j < s.n AND q.asks AND f.j - 1 > f.i THEN f.j - 1 ELSE f.j END AS j FROM fit f JOIN sn s USING (video_id) JOIN sq q ON q.video_id = f.video_id AND q.seg = f.j - 1),
pk AS (SELECT video_id, CAST(1 AS BIGINT) AS chunk_index, i, j FROM nx WHERE i = 0 UNION ALL SELECT n.video_id, p.chunk_index + 1, n.i, n.j FROM pk p JOIN nx n ON n.video_id = p.video_id AND n.i = p.j)
"""
PLAN_PROPOSED = PACK.rstrip() + f""",
pt AS (SELECT p.video_id, p.chunk_index, string_agg(s.segment_id, ',' ORDER BY s.seg) AS ids, arg_min(s.text, s.seg) AS t, list(s.speaker_role ORDER BY s.seg) AS r FROM pk p JOIN seg s ON s.video_id = p.video_id AND s.seg >= p.i AND s.seg < p.j GROUP BY 1, 2)
SELECT video_id, chunk_index, ids, {CLIP.format(x='t', n=80)} AS title, array_to_string({_ordered_unique('r')}, ',') AS topics FROM pt"""


def planner_payloads(spark, sf_dir):
    """Segments with the events they overlap, as the planner is shown them."""
    rows = ch.segment_payloads(_segs(spark, sf_dir), _events(spark, sf_dir), RULES)
    return rows.select("video_id", "segment_id", F.array_join("event_ids", ",").alias("event_ids"))


PLANNER_PAYLOADS = oi.with_ctes(oi.TOKENS, oi.SPEAKERS, oi.SEGMENTS, SCENES) + """
SELECT s.video_id, s.segment_id, coalesce(string_agg(c.scene_id, ',' ORDER BY c.start_ms), '') AS event_ids FROM seg s
LEFT JOIN scn c ON c.video_id = s.video_id AND s.end_ms > c.start_ms AND s.start_ms < c.end_ms GROUP BY 1, 2"""


def _test_plan(segments):
    """Plan items of two segments each, with planted faults of every kind; written as planner responses of three items."""
    k = F.floor(F.col("seg") / 2)
    two = segments.groupBy("video_id", k.alias("k")).agg(F.array_sort(F.collect_list(F.struct("seg", "segment_id", "text"))).alias("s"))
    ids = F.transform("s", lambda x: x["segment_id"])
    m = (F.col("video_id") + F.col("k")) % 11
    ids = (
        F.when(m == 1, F.array().cast("array<string>")).when(m == 2, F.concat(ids, F.array(F.get(ids, 0)))).when(m == 3, F.concat(ids, F.array(F.lit("nowhere"))))
        .when(m == 4, F.reverse(ids)).otherwise(ids)
    )
    title = F.when(m == 5, "").when(m == 6, F.concat(F.lit("  Long   title "), F.get("s", 0)["text"])).otherwise(F.concat(F.lit("Part "), "k"))
    topics = F.when(m == 7, F.array().cast("array<string>")).when(m == 8, F.array(*[F.lit(t) for t in "A b C d e f g h".split()])).otherwise(F.array(F.lit("Fit "), F.lit("fit"), F.lit("Cloth")))
    row = F.struct("k", ids.alias("speech_segment_ids"), title.alias("title"), F.when(m == 9, "").otherwise("pair").alias("boundary_reason"), topics.alias("topics"),
                   F.when(m == 10, F.concat(F.lit("note "), F.get("s", 0)["text"])).otherwise("").alias("notes"))
    chunks = two.groupBy("video_id", F.floor(F.col("k") / 3).alias("window_index")).agg(F.array_sort(F.collect_list(row)).alias("chunks"))
    body = F.to_json(F.struct(F.transform("chunks", lambda c: c.dropFields("k")).alias("chunks")))
    return chunks.select("video_id", "window_index", body.alias("body"))


def plan_items(spark, sf_dir):
    return ch.plan_items(_test_plan(_segs(spark, sf_dir))).select(
        "video_id", "chunk_index", F.array_join("speech_segment_ids", ",").alias("ids"), "title", "boundary_reason", F.array_join("topics", ",").alias("topics"), "notes"
    )


ITEMS = BASE + f""",
tw AS (SELECT video_id, seg // 2 AS k, list(segment_id ORDER BY seg) AS ids, arg_min(text, seg) AS t0, (video_id + seg // 2) % 11 AS m FROM seg GROUP BY 1, 2, 5),
it0 AS (SELECT video_id, k + 1 AS chunk_index, CASE m WHEN 1 THEN CAST([] AS VARCHAR[]) WHEN 2 THEN list_append(ids, ids[1]) WHEN 3 THEN list_append(ids, 'nowhere') WHEN 4 THEN list_reverse(ids) ELSE ids END AS ids,
   CASE m WHEN 5 THEN '' WHEN 6 THEN 'Long title ' || t0 ELSE 'Part ' || k END AS title0, CASE WHEN m = 9 THEN '' ELSE 'pair' END AS boundary_reason,
   CASE m WHEN 7 THEN CAST([] AS VARCHAR[]) WHEN 8 THEN ['a','b','c','d','e','f','g','h'] ELSE ['fit', 'cloth'] END AS topics, CASE WHEN m = 10 THEN 'note ' || t0 ELSE '' END AS notes0 FROM tw),
it AS (SELECT video_id, chunk_index, ids, {CLIP.format(x='title0', n=80)} AS title, boundary_reason, topics, {CLIP.format(x='notes0', n=240)} AS notes FROM it0)
"""
PLAN_ITEMS = ITEMS + "SELECT video_id, chunk_index, array_to_string(ids, ',') AS ids, title, boundary_reason, array_to_string(topics, ',') AS topics, notes FROM it"


def plan_validation_errors(spark, sf_dir):
    segments = _segs(spark, sf_dir)
    items = materialise(ch.plan_items(_test_plan(segments)))
    return ch.plan_errors(items, segments, ChunkLimits(max_segments=2, max_words=150))


FACTS = """,
ix AS (SELECT video_id, chunk_index, i, ids[i] AS segment_id FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM it)),
ij AS (SELECT x.*, s.seg, s.words, s.speaker_role, s.start_ms, s.end_ms FROM ix x LEFT JOIN seg s ON s.video_id = x.video_id AND s.segment_id = x.segment_id),
fa AS (SELECT video_id, chunk_index, count(*) AS n, count(DISTINCT segment_id) AS d, count(*) FILTER (seg IS NULL) AS u, min(seg - i) = max(seg - i) AS c, sum(words) AS w FROM ij GROUP BY 1, 2),
en AS (SELECT video_id, chunk_index, count(*) AS n, coalesce(sum(words), 0) AS w, arg_max({'seg': seg, 'id': segment_id, 'r': speaker_role, 'e': end_ms}, i) AS l, arg_min({'seg': seg, 'id': segment_id, 'r': speaker_role, 's': start_ms}, i) AS f FROM ij GROUP BY 1, 2),
qb AS (SELECT a.video_id, a.chunk_index AS left_index, b.chunk_index AS right_index, a.l.id AS q, b.f.id AS a, greatest(0, b.f.s - a.l.e) AS gap, a.n + b.n AS mn, a.w + b.w AS mw FROM en a JOIN en b ON b.video_id = a.video_id
   AND b.chunk_index = (SELECT min(z.chunk_index) FROM en z WHERE z.video_id = a.video_id AND z.chunk_index > a.chunk_index)
   WHERE b.f.seg = a.l.seg + 1 AND a.l.r = 'offscreen_questioner' AND b.f.r = 'host' AND greatest(0, b.f.s - a.l.e) <= 12000)
"""
PLAN_VALIDATION_ERRORS = ITEMS.rstrip() + FACTS.rstrip() + """,
fi AS (SELECT it.*, coalesce(fa.n, 0) AS n, fa.d, fa.u, fa.c, fa.w, coalesce(fa.n, 0) > 0 AND fa.u = 0 AS ok FROM it LEFT JOIN fa USING (video_id, chunk_index)),
se AS (SELECT x.video_id, x.segment_id, count(*) AS k FROM ix x JOIN fi USING (video_id, chunk_index) WHERE fi.ok GROUP BY 1, 2),
er AS (
 SELECT video_id, chunk_index, NULL AS segment_id, 'no_segment_ids' AS code, 'segment_ids' AS error_class, 'speech_segment_ids' AS field FROM fi WHERE n = 0
 UNION ALL SELECT video_id, chunk_index, NULL, 'duplicated_segment_ids', 'segment_ids', 'speech_segment_ids' FROM fi WHERE n > 0 AND d < n
 UNION ALL SELECT video_id, chunk_index, NULL, 'unknown_segment_ids', 'invalid_plan', 'speech_segment_ids' FROM fi WHERE n > 0 AND u > 0
 UNION ALL SELECT video_id, chunk_index, NULL, 'not_contiguous', 'invalid_plan', 'speech_segment_ids' FROM fi WHERE ok AND NOT c
 UNION ALL SELECT video_id, chunk_index, NULL, 'too_many_segments', 'chunk_limits', 'chunk_plan' FROM fi WHERE ok AND n > 2
 UNION ALL SELECT video_id, chunk_index, NULL, 'too_many_words', 'chunk_limits', 'chunk_plan' FROM fi WHERE ok AND w > 150
 UNION ALL SELECT video_id, chunk_index, NULL, 'empty_title', 'metadata', 'title' FROM fi WHERE ok AND trim(title) = ''
 UNION ALL SELECT video_id, chunk_index, NULL, 'empty_boundary_reason', 'metadata', 'boundary_reason' FROM fi WHERE ok AND boundary_reason = ''
 UNION ALL SELECT video_id, chunk_index, NULL, 'no_topics', 'metadata', 'topics' FROM fi WHERE ok AND len(topics) = 0
 UNION ALL SELECT video_id, chunk_index, NULL, 'too_many_topics', 'metadata', 'topics' FROM fi WHERE ok AND len(topics) > 6
 UNION ALL SELECT s.video_id, NULL, s.segment_id, 'segment_missing', 'coverage', 'coverage' FROM seg s WHERE NOT EXISTS (SELECT 1 FROM se WHERE se.video_id = s.video_id AND se.segment_id = s.segment_id)
 UNION ALL SELECT video_id, NULL, segment_id, 'segment_repeated', 'coverage', 'coverage' FROM se WHERE k > 1
 UNION ALL SELECT video_id, left_index, NULL, 'question_answer_split', 'question_answer_split', 'chunk_plan' FROM qb WHERE mn <= 2 AND mw <= 150)
SELECT video_id, CAST(chunk_index AS BIGINT) AS chunk_index, segment_id, code, error_class, field FROM er"""


def _single_plan(segments):
    """One item per segment: every question is split from its answer."""
    return segments.select(
        "video_id", (F.col("seg") + 1).alias("chunk_index"), F.array("segment_id").alias("speech_segment_ids"),
        F.concat(F.lit("Part "), "seg").alias("title"), F.lit("one by one").alias("boundary_reason"), F.array("speaker", F.lit("all")).alias("topics"), F.lit("").alias("notes"),
    )


ONE_ITEMS = BASE_R + """,
it AS (SELECT video_id, seg + 1 AS chunk_index, [segment_id] AS ids, 'Part ' || seg AS title, 'one by one' AS boundary_reason, [speaker, 'all'] AS topics, '' AS notes FROM seg)
"""


def qa_split_warnings(spark, sf_dir):
    segments = _segs(spark, sf_dir)
    return ch.qa_boundaries(_single_plan(segments), segments, ChunkLimits(max_words=120)).withColumn("limit_violations", F.array_join("limit_violations", ", "))


QA_SPLIT_WARNINGS = ONE_ITEMS.rstrip() + FACTS + """
SELECT video_id, left_index, right_index, q AS question_segment_id, a AS answer_segment_id, gap AS gap_ms, mn AS merged_segments, CAST(mw AS BIGINT) AS merged_words,
  CASE WHEN mw > 120 THEN 'max_words ' || CAST(mw AS BIGINT) || '>120' ELSE '' END AS limit_violations, mw <= 120 AS mergeable FROM qb"""


def qa_merge(spark, sf_dir):
    """Merging the split pairs, then noting the splits that limits keep apart."""
    segments = _segs(spark, sf_dir)
    limits = ChunkLimits(max_words=120)
    merged = materialise(ch.merge_qa_splits(_single_plan(segments), segments, limits))
    noted = ch.annotate_qa_warnings(merged, ch.qa_boundaries(merged, segments, limits), limits)
    return noted.select("video_id", "chunk_index", F.array_join("speech_segment_ids", ",").alias("ids"), "title", "boundary_reason", F.array_join("topics", ",").alias("topics"), "notes", F.col("merged_from").cast("long").alias("merged_from"))


QA_MERGE = BASE_R + f""",
mg AS (
  SELECT video_id, seg, CAST(1 AS BIGINT) AS g, words AS w, 1 AS c FROM sq WHERE seg = 0
  UNION ALL SELECT n.video_id, n.seg, CASE WHEN p.asks AND m.w + n.words <= 120 AND m.c + 1 <= 8 THEN m.g ELSE m.g + 1 END, CASE WHEN p.asks AND m.w + n.words <= 120 AND m.c + 1 <= 8 THEN m.w + n.words ELSE n.words END,
     CASE WHEN p.asks AND m.w + n.words <= 120 AND m.c + 1 <= 8 THEN m.c + 1 ELSE 1 END
  FROM mg m JOIN sq p ON p.video_id = m.video_id AND p.seg = m.seg JOIN sq n ON n.video_id = m.video_id AND n.seg = m.seg + 1),
mi AS (SELECT m.video_id, m.g, list(s.segment_id ORDER BY s.seg) AS ids, 'Part ' || min(s.seg) AS title, list(s.speaker ORDER BY s.seg) AS sp, count(*) AS k, min(s.seg) AS fs, max(s.seg) AS ls, sum(s.words) AS w FROM mg m JOIN seg s USING (video_id, seg) GROUP BY 1, 2),
mt AS (SELECT *, CASE WHEN k = 1 THEN '' ELSE '{ch.fx.MERGED_BOUNDARY_NOTE}one by one; one by one' || chr(10) || chr(10) || '{ch.fx.MERGED_NOTE}' END AS n0, list_filter(list_concat([sp[1], 'all'], list_concat(sp, ['all'])), lambda x: true) AS tp FROM mi),
bw AS (SELECT a.video_id, a.g AS li, b.g AS ri, 'QA split preserved because merging the question and answer chunks would exceed limits: ' || concat_ws(', ', CASE WHEN a.k + b.k > 8 THEN 'max_speech_segments_per_chunk ' || (a.k + b.k) || '>8' END, CASE WHEN a.w + b.w > 120 THEN 'max_words ' || CAST(a.w + b.w AS BIGINT) || '>120' END) AS note
  FROM mt a JOIN mt b ON b.video_id = a.video_id AND b.g = a.g + 1 JOIN sq q ON q.video_id = a.video_id AND q.seg = a.ls WHERE q.asks AND (a.k + b.k > 8 OR a.w + b.w > 120)),
sd AS (SELECT video_id, g, string_agg(note, chr(10) || chr(10) ORDER BY li) AS nn FROM (SELECT video_id, g, note, min(li) AS li FROM (SELECT video_id, li AS g, li, note FROM bw UNION ALL SELECT video_id, ri, li, note FROM bw) GROUP BY 1, 2, 3) GROUP BY 1, 2),
fn AS (SELECT m.*, concat_ws(chr(10) || chr(10), nullif({CLIP.format(x='n0', n=240)}, ''), s.nn) AS nt FROM mt m LEFT JOIN sd s ON s.video_id = m.video_id AND s.g = m.g)
SELECT video_id, g AS chunk_index, array_to_string(ids, ',') AS ids, title, CASE WHEN k = 1 THEN 'one by one' ELSE '{ch.fx.MERGED_BOUNDARY_REASON}' END AS boundary_reason,
  array_to_string({_ordered_unique('tp')}, ',') AS topics, {CLIP.format(x='nt', n=240)} AS notes, k AS merged_from FROM fn"""


def _events(spark, sf_dir):
    scenes = materialise(fallback_scenes(spark, sf_dir))
    return scenes.select("video_id", "scene_id", "start_ms", "end_ms").join(_scene_visuals(spark, sf_dir, scenes).drop("video_id"), "scene_id").select(
        "video_id", F.col("scene_id").alias("event_id"), "start_ms", "end_ms", "visual_summary", "items", F.col("style_topics").alias("topics"), "on_screen_text", "presenter_context"
    )


def chunk_event_attach(spark, sf_dir):
    """Plan spans against events with holes punched into the timeline, so that some chunks only have neighbours."""
    segments = _segs(spark, sf_dir)
    events = fallback_scenes(spark, sf_dir).where("scene_index % 3 = 0").select("video_id", F.col("scene_id").alias("event_id"), "start_ms", "end_ms")
    spans = materialise(ch.chunk_spans(_single_plan(segments), segments))
    attached = ch.attach_events(spans, events)
    none = ch.missing_evidence(spans, attached).select("video_id", "chunk_index", F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("long").alias("distance_ms"))
    return attached.select("video_id", "chunk_index", "event_id", "distance_ms").unionByName(none)


CHUNK_EVENT_ATTACH = oi.with_ctes(oi.TOKENS, oi.SPEAKERS, oi.SEGMENTS, SCENES).rstrip() + """,
pr AS (SELECT s.video_id, s.seg + 1 AS chunk_index, c.scene_id AS event_id, c.end_ms > s.start_ms AND c.start_ms < s.end_ms AS o, CAST(greatest(0, s.start_ms - c.end_ms, c.start_ms - s.end_ms) AS BIGINT) AS d FROM seg s JOIN scn c ON c.video_id = s.video_id AND c.scene_index % 3 = 0),
kp AS (SELECT *, bool_or(o) OVER (PARTITION BY video_id, chunk_index) AS any_o FROM pr)
SELECT video_id, chunk_index, event_id, CASE WHEN o THEN 0 ELSE d END AS distance_ms FROM kp WHERE o OR (NOT any_o AND d <= 5000)
UNION ALL SELECT s.video_id, s.seg + 1, NULL, NULL FROM seg s WHERE NOT EXISTS (SELECT 1 FROM kp k WHERE k.video_id = s.video_id AND k.chunk_index = s.seg + 1 AND (k.o OR (NOT k.any_o AND k.d <= 5000)))"""


def _chunks(spark, sf_dir):
    segments = _segs(spark, sf_dir)
    plan = materialise(ch.propose_plan(segments, SMALL))
    return ch.materialise_chunks(plan, segments, _events(spark, sf_dir), SMALL, RULES)


def chunks(spark, sf_dir):
    refs = F.array_join(F.transform("source_refs", lambda r: F.concat_ws("@", r["type"], r["start_ms"], r["end_ms"])), "|")
    return _chunks(spark, sf_dir).select(
        "video_id", "chunk_index", "chunk_id", F.array_join("speech_segment_ids", ",").alias("ids"), "chunk_title", "start_ms", "end_ms", "speech_text", "dialogue_text", "presenter_brief",
        "visual_text", "combined_text", *[F.array_join(c, "|").alias(c) for c in ("on_screen_text", "topics", "entities", "modality", "speaker_roles", "timeline_event_ids")], refs.alias("refs"),
    )


def _noise(x: str) -> str:
    key = oi.label_key(x)
    return f"({key} <> '' AND ({_is_technical(key)} OR {_is_presentation(key)}))"


def _safe_list(field: str) -> str:
    return f"list_filter(list_transform({field}, lambda s: {oi.squash('s')}), lambda s: s <> '' AND NOT {_noise('s')})"


CHUNKS_CTE = PACK.replace(oi.SEGMENTS.strip(), oi.SEGMENTS.strip() + "," + SCENES.strip() + "," + oi.VISUAL.strip()).rstrip() + f""",
sf0 AS MATERIALIZED (SELECT doc_id, {oi.squash('visual_summary')} AS sm, {_safe_list('on_screen_text')} AS sc0, {_safe_list('items')} AS it0, {_safe_list('style_topics')} AS tp0, relevance, narrative_brief FROM vev),
sf1 AS MATERIALIZED (SELECT doc_id, CASE WHEN {_noise('sm')} THEN '' ELSE sm END AS sm, {_ordered_unique('sc0')} AS sc, {_ordered_unique('it0')} AS itm, {_ordered_unique('tp0')} AS tp,
   CASE WHEN relevance IN ('brief', 'primary_example') THEN narrative_brief ELSE '' END AS br FROM sf0),
sfe AS (SELECT c.video_id, c.scene_id AS event_id, v.* EXCLUDE (doc_id) FROM scn c JOIN sf1 v ON v.doc_id = (7 * c.video_id + c.scene_index) % (SELECT count(*) FROM documents)),
spn AS (SELECT p.video_id, p.chunk_index, min(s.start_ms) AS start_ms, max(s.end_ms) AS end_ms, string_agg(s.segment_id, ',' ORDER BY s.seg) AS ids, arg_min(s.text, s.seg) AS t0, string_agg(s.text, ' ' ORDER BY s.seg) AS speech_text, list(s.speaker_role ORDER BY s.seg) AS rl
  FROM pk p JOIN seg s ON s.video_id = p.video_id AND s.seg >= p.i AND s.seg < p.j GROUP BY 1, 2),
rn0 AS (SELECT p.video_id, p.chunk_index, s.seg, s.text, s.speaker, s.speaker_role, count(DISTINCT s.speaker) OVER (PARTITION BY p.video_id, p.chunk_index, s.speaker_role) AS ns,
   CASE WHEN s.speaker IS DISTINCT FROM lag(s.speaker) OVER (PARTITION BY p.video_id, p.chunk_index ORDER BY s.seg) THEN 1 ELSE 0 END AS f FROM pk p JOIN seg s ON s.video_id = p.video_id AND s.seg >= p.i AND s.seg < p.j),
rn1 AS (SELECT *, sum(f) OVER (PARTITION BY video_id, chunk_index ORDER BY seg ROWS UNBOUNDED PRECEDING) AS r FROM rn0),
rn2 AS (SELECT video_id, chunk_index, r, CASE any_value(speaker_role) WHEN 'host' THEN 'Ведущий' ELSE 'Закадровый вопрос' END || CASE WHEN any_value(ns) > 1 THEN ' (' || any_value(speaker) || ')' ELSE '' END || ': ' || string_agg(text, ' ' ORDER BY seg) AS line, string_agg(text, ' ' ORDER BY seg) AS lt FROM rn1 GROUP BY 1, 2, 3),
dlg AS (SELECT video_id, chunk_index, string_agg(line, chr(10) ORDER BY r) AS dialogue_text FROM rn2 WHERE lt <> '' GROUP BY 1, 2),
evc AS (SELECT s.video_id, s.chunk_index, list(e.event_id ORDER BY c.start_ms) AS eids, array_to_string(list_filter(list(e.sm ORDER BY c.start_ms), lambda x: x <> ''), ' ') AS sms, flatten(list(e.sc ORDER BY c.start_ms)) AS scs, flatten(list(e.itm ORDER BY c.start_ms)) AS its,
   flatten(list(e.tp ORDER BY c.start_ms)) AS tps, flatten(list(list_concat(e.itm, e.tp) ORDER BY c.start_ms)) AS both_, list_filter(list(e.br ORDER BY c.start_ms), lambda x: x <> '') AS brs, string_agg('visual@' || c.start_ms || '@' || c.end_ms, '|' ORDER BY c.start_ms) AS refs
  FROM spn s JOIN scn c ON c.video_id = s.video_id AND c.end_ms > s.start_ms AND c.start_ms < s.end_ms JOIN sfe e ON e.event_id = c.scene_id GROUP BY 1, 2),
ck0 AS (SELECT s.*, d.dialogue_text, e.* EXCLUDE (video_id, chunk_index), concat_ws(chr(10) || chr(10), nullif(e.sms, ''), nullif(array_to_string(e.scs, chr(10)), ''), nullif(array_to_string(e.both_, '; '), '')) AS rv,
   array_to_string({_ordered_unique('brs')}, ' ') AS pb0, list_concat({_ordered_unique('s.rl')}, tps) AS tq FROM spn s JOIN evc e ON e.video_id = s.video_id AND e.chunk_index = s.chunk_index LEFT JOIN dlg d ON d.video_id = s.video_id AND d.chunk_index = s.chunk_index),
ck AS (SELECT *, CASE WHEN {_noise('pb0')} THEN '' ELSE pb0 END AS presenter_brief, CASE WHEN {_noise('rv')} THEN '' ELSE {oi.squash('rv')} END AS visual_text, {_ordered_unique('tq')} AS topics, {_ordered_unique('its')} AS entities, {_ordered_unique('scs')} AS on_screen_text FROM ck0),
cks AS (SELECT *, printf('%d_c_%06d_%06d', video_id, {HALF.format(m='start_ms')}, {HALF.format(m='end_ms')}) AS chunk_id, concat_ws(chr(10) || chr(10), nullif(coalesce(dialogue_text, speech_text), ''), nullif(presenter_brief, ''), nullif(visual_text, '')) AS combined_text FROM ck)
"""
CHUNKS = CHUNKS_CTE + f"""SELECT video_id, chunk_index, chunk_id, ids, {CLIP.format(x='t0', n=80)} AS chunk_title, start_ms, end_ms, speech_text, dialogue_text, presenter_brief, visual_text, combined_text,
  array_to_string(on_screen_text, '|') AS on_screen_text, array_to_string(topics, '|') AS topics, array_to_string(entities, '|') AS entities,
  concat_ws('|', CASE WHEN speech_text <> '' THEN 'audio' END, CASE WHEN rv <> '' OR len(on_screen_text) > 0 THEN 'visual' END) AS modality, array_to_string({_ordered_unique('rl')}, '|') AS speaker_roles,
  array_to_string(eids, '|') AS timeline_event_ids, 'youtube@' || start_ms || '@' || end_ms || '|' || refs AS refs FROM cks"""


def chunk_redundancy(spark, sf_dir):
    return ch.redundancy_metrics(ch.redundancy(_chunks(spark, sf_dir)), ["video_id"])


CHUNK_REDUNDANCY = CHUNKS_CTE.rstrip() + f""",
rw AS (SELECT video_id, regexp_extract_all({oi.fold('combined_text')}, '[\\p{{L}}\\p{{N}}_]+') AS a, regexp_extract_all({oi.fold("concat_ws(chr(10) || chr(10), visual_text, array_to_string(topics, chr(10)), array_to_string(entities, chr(10)))")}, '[\\p{{L}}\\p{{N}}_]+') AS b FROM cks),
rc AS (SELECT video_id, len(a) AS w, len(list_filter(a, lambda x: list_contains(b, x))) AS r FROM rw WHERE len(a) > 0)
SELECT video_id, CAST(sum(w) AS BIGINT) AS words_total, CAST(sum(r) AS BIGINT) AS repeated_total, CAST(round_even(sum(r) / greatest(sum(w), 1) * 10000, 0) AS BIGINT) AS ratio_bps, count(*) FILTER (r > 0) AS chunks_with_redundancy,
  max(CAST(round_even(r / w * 10000, 0) AS BIGINT)) AS max_chunk_bps FROM rc GROUP BY 1"""


def chunk_contamination(spark, sf_dir):
    """Chunks built without the corpus's own marker rules, then checked with them."""
    segments = _segs(spark, sf_dir)
    plan = materialise(ch.propose_plan(segments, SMALL))
    built = ch.materialise_chunks(plan, segments, _events(spark, sf_dir), SMALL)
    return ch.contamination(built, RULES).groupBy("video_id", "field").agg(F.count("*").alias("markers"), F.count_distinct("chunk_id").alias("chunks"))


def chunk_rebuild_check(spark, sf_dir):
    """Stored chunks against a rebuild: the stored copy lost every chunk that starts a video."""
    built = materialise(chunks(spark, sf_dir))
    return tl.same_rows(built, built.where("chunk_index <> 1")).select("video_id", "chunk_id", "side")


CHUNK_REBUILD_CHECK = CHUNKS_CTE + "SELECT video_id, chunk_id, 'left_only' AS side FROM cks WHERE chunk_index = 1"


QUERIES = {
    "qa_pairs": (qa_pairs, QA_PAIRS),
    "planner_windows": (planner_windows, PLANNER_WINDOWS),
    "plan_proposed": (plan_proposed, PLAN_PROPOSED),
    "planner_payloads": (planner_payloads, PLANNER_PAYLOADS),
    "plan_items": (plan_items, PLAN_ITEMS),
    "plan_validation_errors": (plan_validation_errors, PLAN_VALIDATION_ERRORS),
    "qa_split_warnings": (qa_split_warnings, QA_SPLIT_WARNINGS),
    "qa_merge": (qa_merge, QA_MERGE),
    "chunk_event_attach": (chunk_event_attach, CHUNK_EVENT_ATTACH),
    "chunks": (chunks, CHUNKS),
    "chunk_redundancy": (chunk_redundancy, CHUNK_REDUNDANCY),
    "chunk_contamination": (chunk_contamination, None),
    "chunk_rebuild_check": (chunk_rebuild_check, CHUNK_REBUILD_CHECK),
}
