"""Registered queries over token streams: speakers, units, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.operators import transcript as tr
from talkloom.plans import inputs
from talkloom.plans import oracle_inputs as oi
from talkloom.session import materialise

BASE = oi.with_ctes(oi.TOKENS, oi.SPEAKERS).rstrip() + " "


def speaker_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.speaker_profiles(inputs.tokens(spark, sf_dir)).select(
        "video_id", "speaker", "role", "tokens_count", "words_count", "speech_ms", "first_start_ms", "last_end_ms"
    )


SPEAKER_PROFILES = BASE + (
    "SELECT video_id, speaker, role, tokens_count, words_count, speech_ms, first_start_ms, last_end_ms FROM prof"
)


def speaker_summary(spark, sf_dir):
    return tr.speaker_summary(inputs.tokens(spark, sf_dir))


SPEAKER_SUMMARY = BASE + (
    "SELECT video_id, count(DISTINCT speaker) AS detected_speakers, count(*) FILTER (speaker IS NULL) AS unassigned_tokens_count, "
    "count(*) AS tokens_count FROM tok GROUP BY video_id"
)


def token_roles(spark, sf_dir):
    toks = inputs.tokens(spark, sf_dir)
    return tr.attach_roles(toks, tr.speaker_profiles(toks)).select("video_id", "pos", "text", "start_ms", "end_ms", "speaker", "speaker_role")


TOKEN_ROLES = BASE + (
    "SELECT t.video_id, t.pos, t.text, t.start_ms, t.end_ms, t.speaker, p.role AS speaker_role FROM tok t "
    "LEFT JOIN prof p ON p.video_id = t.video_id AND p.speaker = t.speaker"
)


def provider_tokens(spark, sf_dir):
    """Provider-shaped arrays built from the turns, normalised back to token rows."""
    piece = lambda x, i: F.struct(
        F.when(i % 3 == 0, x).otherwise("").alias("text"),
        F.when(i % 3 == 1, x).alias("token"),
        F.when(i % 5 != 4, x).alias("value"),
        F.when(i % 2 == 0, (i * 400).cast("long")).alias("start_ms"),
        (i * 0.4).cast("double").alias("start"),
        (i * 400 + 250).cast("long").alias("end_ms"),
        F.lit(None).cast("double").alias("end"),
        F.lit(None).cast("string").alias("speaker"),
        (i % 2).cast("string").alias("speaker_id"),
        F.lit(None).cast("string").alias("language"),
        F.lit("en").alias("lang"),
    )
    raw = inputs.table(spark, sf_dir, "conversations").select(
        F.concat_ws("_", "conv_id", "turn").alias("video_id"),
        F.transform(F.regexp_extract_all("text", F.lit(r"\s*\S+"), F.lit(0)), piece).alias("tokens"),
    )
    return tr.normalise_tokens(raw).groupBy("video_id", "speaker", "language").agg(
        F.count("*").alias("tokens"), F.sum("token_index").alias("index_sum"), F.sum("start_ms").alias("start_sum"),
        F.sum("end_ms").alias("end_sum"), F.sum(F.length("text")).cast("long").alias("chars"),
    )


PROVIDER_TOKENS = r"""
WITH p AS (SELECT conv_id || '_' || turn AS video_id, regexp_extract_all(text, '\s*\S+') AS pieces FROM conversations),
r AS (SELECT video_id, i - 1 AS i, pieces[i] AS text FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS i FROM p))
SELECT video_id, CAST(i % 2 AS VARCHAR) AS speaker, 'en' AS language, count(*) AS tokens, CAST(sum(i) AS BIGINT) AS index_sum,
  CAST(sum(i * 400) AS BIGINT) AS start_sum, CAST(sum(i * 400 + 250) AS BIGINT) AS end_sum, CAST(sum(length(text)) AS BIGINT) AS chars
FROM r WHERE i % 3 IN (0, 1) OR i % 5 <> 4 GROUP BY ALL"""


def token_stream_violations(spark, sf_dir):
    """The streams against an audio length cut short for every fourth video, and two missing videos."""
    toks = inputs.tokens(spark, sf_dir)
    cut = F.when(F.col("video_id") % 4 == 0, F.col("duration_ms") - 20_000).otherwise(F.col("duration_ms"))
    durations = inputs.video_ends(toks).select("video_id", cut.alias("audio_ms"))
    missing = durations.where(F.col("video_id") % 5 == 0).select((F.col("video_id") + 1_000_000).alias("video_id"), "audio_ms")
    odd = toks.withColumn("end_ms", F.when(F.col("pos") % 211 == 0, F.col("start_ms") - 1).otherwise(F.col("end_ms"))).withColumn(
        "start_ms", F.when(F.col("pos") % 307 == 1, F.lit(0).cast("long")).otherwise(F.col("start_ms"))
    )
    return tr.token_stream_violations(odd, durations.unionByName(missing))


TOKEN_STREAM_VIOLATIONS = BASE + r""",
odd AS (SELECT video_id, pos, CASE WHEN pos % 307 = 1 THEN 0 ELSE start_ms END AS start_ms,
  CASE WHEN pos % 211 = 0 THEN start_ms - 1 ELSE end_ms END AS end_ms FROM tok),
prev AS (SELECT *, lag(start_ms) OVER (PARTITION BY video_id ORDER BY pos) AS p FROM odd),
ends AS (SELECT video_id, max(end_ms) - CASE WHEN video_id % 4 = 0 THEN 20000 ELSE 0 END AS audio_ms FROM tok GROUP BY video_id),
last AS (SELECT video_id, max(pos) AS pos, arg_max(end_ms, pos) AS last_end FROM odd GROUP BY video_id)
SELECT video_id, pos, 'start_after_end' AS code FROM prev WHERE start_ms > end_ms
UNION ALL SELECT video_id, pos, 'start_goes_back' FROM prev WHERE start_ms < p
UNION ALL SELECT e.video_id, l.pos, 'ends_after_audio' FROM ends e JOIN last l USING (video_id) WHERE l.last_end > e.audio_ms + 10000
UNION ALL SELECT video_id + 1000000, CAST(-1 AS BIGINT), 'empty_stream' FROM ends WHERE video_id % 5 = 0"""


def token_table_faults(spark, sf_dir):
    """Stored tokens with a fault of each kind planted by position, against those derived anew."""
    expected = _tokens_with_roles(spark, sf_dir).select("video_id", "pos", "text", "start_ms", "end_ms", "language", "speaker", "speaker_role")
    p = F.col("pos")
    faulty = expected.where(p % 101 != 5).withColumns(
        {
            "text": F.when(p % 101 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "start_ms": F.col("start_ms") + F.when(p % 103 == 9, 1).otherwise(0),
            "end_ms": F.col("end_ms") - F.when(p % 105 == 10, 1).otherwise(0), "language": F.when(p % 107 != 11, F.col("language")),
            "speaker": F.when(p % 109 == 13, "zz").otherwise(F.col("speaker")), "speaker_role": F.when(p % 113 != 17, F.col("speaker_role")),
        }
    )
    extra = expected.where(p % 127 == 19).withColumn("pos", p + 1_000_000)
    twice = expected.where((p % 131 == 23) & (p % 101 != 5))
    return tr.token_table_differences(faulty.unionByName(extra).unionByName(twice), expected)


TOKEN_TABLE_FAULTS = BASE + """,
e AS (SELECT t.video_id, t.pos FROM tok t),
c AS (SELECT *, (pos % 101 <> 5)::INT AS k, (pos % 131 = 23 AND pos % 101 <> 5) AS twice FROM e)
SELECT video_id, pos, 'token_missing' AS code FROM c WHERE k = 0
UNION ALL SELECT video_id, pos + 1000000, 'token_unexpected' FROM c WHERE pos % 127 = 19
UNION ALL SELECT video_id, pos, 'text_differs' FROM c WHERE k = 1 AND pos % 101 = 7
UNION ALL SELECT video_id, pos, 'start_ms_differs' FROM c WHERE k = 1 AND pos % 103 = 9
UNION ALL SELECT video_id, pos, 'end_ms_differs' FROM c WHERE k = 1 AND pos % 105 = 10
UNION ALL SELECT video_id, pos, 'language_differs' FROM c WHERE k = 1 AND pos % 107 = 11
UNION ALL SELECT video_id, pos, 'speaker_differs' FROM c WHERE k = 1 AND pos % 109 = 13
UNION ALL SELECT video_id, pos, 'speaker_role_differs' FROM c WHERE k = 1 AND pos % 113 = 17
UNION ALL SELECT video_id, pos, 'token_repeated' FROM c WHERE twice"""


FEATURES_SQL = oi.with_ctes(oi.TOKENS, oi.SPEAKERS, r"""
feat0 AS (
  SELECT t.*, p.role AS speaker_role,
    lead(pos) OVER w AS next_pos, lead(start_ms) OVER w AS next_start, lead(t.speaker) OVER w AS next_speaker,
    lead(text) OVER w AS next_token,
    coalesce(lead(text, 1) OVER w, '') || coalesce(lead(text, 2) OVER w, '') || coalesce(lead(text, 3) OVER w, '') || coalesce(lead(text, 4) OVER w, '')
      || coalesce(lead(text, 5) OVER w, '') || coalesce(lead(text, 6) OVER w, '') || coalesce(lead(text, 7) OVER w, '') || coalesce(lead(text, 8) OVER w, '') AS next_text,
    right(regexp_replace(text, '[\"''»”)\]}\s]+$', ''), 1) AS tc
  FROM tok t JOIN prof p ON p.video_id = t.video_id AND p.speaker = t.speaker
  WINDOW w AS (PARTITION BY t.video_id ORDER BY pos)),
feat AS (
  SELECT *,
    CASE WHEN next_pos IS NULL THEN 'end' WHEN speaker <> next_speaker THEN 'speaker_change'
      WHEN next_start - end_ms >= 900 THEN 'pause' WHEN tc IN ('.', '!', '?', '…') THEN 'sentence_end' END AS hard_reason,
    coalesce(tc IN (';', ':'), false) AS is_clause,
    CASE WHEN next_pos IS NULL OR tc IN ('.', '!', '?', '…') THEN true WHEN tc IN (',', ';', ':') THEN false
      WHEN NOT regexp_matches(next_token, '^\s') THEN false WHEN regexp_matches(next_text, '^\s*\p{Ll}') THEN false
      ELSE lower(trim(regexp_extract(next_text, '[A-Za-zА-Яа-яЁё-]+'), '-')) NOT IN
        ('а','но','и','или','либо','потому','поэтому','соответственно','также','то','пожалуйста') END AS is_safe,
    CASE WHEN pos = 0 OR regexp_matches(text, '^\s') THEN 1 ELSE 0 END AS sw
  FROM feat0)""")


def unit_boundaries(spark, sf_dir):
    """Every token whose right-hand boundary ends a unit outright, or could."""
    toks = materialise(inputs.tokens(spark, sf_dir))
    with_roles = tr.attach_roles(toks, tr.speaker_profiles(toks))
    return (
        tr.boundary_features(with_roles)
        .where(F.col("hard_reason").isNotNull() | F.col("is_clause") | F.col("is_safe"))
        .select("video_id", "pos", "hard_reason", "is_clause", "is_safe", "starts_word")
    )


UNIT_BOUNDARIES = FEATURES_SQL + (
    "SELECT video_id, pos, hard_reason, is_clause, is_safe, sw = 1 AS starts_word FROM feat "
    "WHERE hard_reason IS NOT NULL OR is_clause OR is_safe"
)


def _tokens_with_roles(spark, sf_dir):
    toks = materialise(inputs.tokens(spark, sf_dir))
    return tr.attach_roles(toks, materialise(tr.speaker_profiles(toks)))


def _units(spark, sf_dir):
    return tr.transcript_units(_tokens_with_roles(spark, sf_dir))


def transcript_units(spark, sf_dir):
    return _units(spark, sf_dir).select(
        "video_id", "unit_index", "start_pos", "end_pos", "start_ms", "end_ms", "text", "word_count", "speaker",
        "speaker_role", "boundary_reason", "can_end", "must_end",
    )


def transcript_units_blocks(spark, sf_dir):
    """The same units with blocks of 64 tokens, so that most units' conversations lie over many blocks."""
    units = tr.transcript_units(_tokens_with_roles(spark, sf_dir), block=64, reach=16)
    return units.select(
        "video_id", "unit_index", "start_pos", "end_pos", "start_ms", "end_ms", "text", "word_count", "speaker",
        "speaker_role", "boundary_reason", "can_end", "must_end",
    )


UNITS_CTE = FEATURES_SQL.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + r""",
walk AS (
  SELECT video_id, pos, 1 AS u, start_ms AS us, 1 AS wc, hard_reason,
    hard_reason IS NOT NULL OR (is_clause AND (end_ms - start_ms >= 8000 OR 1 >= 24)) OR (is_safe AND (end_ms - start_ms >= 12000 OR 1 >= 40)) AS cut,
    is_clause, end_ms
  FROM feat WHERE pos = 0
  UNION ALL
  SELECT f.video_id, f.pos, CASE WHEN w.cut THEN w.u + 1 ELSE w.u END,
    CASE WHEN w.cut THEN f.start_ms ELSE w.us END,
    CASE WHEN w.cut THEN 1 ELSE w.wc + f.sw END, f.hard_reason,
    f.hard_reason IS NOT NULL
      OR (f.is_clause AND (f.end_ms - CASE WHEN w.cut THEN f.start_ms ELSE w.us END >= 8000 OR CASE WHEN w.cut THEN 1 ELSE w.wc + f.sw END >= 24))
      OR (f.is_safe AND (f.end_ms - CASE WHEN w.cut THEN f.start_ms ELSE w.us END >= 12000 OR CASE WHEN w.cut THEN 1 ELSE w.wc + f.sw END >= 40)),
    f.is_clause, f.end_ms
  FROM walk w JOIN feat f ON f.video_id = w.video_id AND f.pos = w.pos + 1),
units AS (
  SELECT k.video_id, k.u AS unit_index, min(k.pos) AS start_pos, max(k.pos) AS end_pos, min(f.start_ms) AS start_ms, max(f.end_ms) AS end_ms,
    trim(regexp_replace(string_agg(f.text, '' ORDER BY k.pos), '\s+', ' ', 'g')) AS text, CAST(arg_max(k.wc, k.pos) AS BIGINT) AS word_count,
    any_value(f.speaker) AS speaker, any_value(f.speaker_role) AS speaker_role,
    arg_max(CASE WHEN k.hard_reason IS NOT NULL THEN k.hard_reason WHEN k.is_clause THEN 'strong_clause'
      WHEN k.end_ms - k.us >= 12000 THEN 'soft_max_seconds' ELSE 'soft_max_words' END, k.pos) AS boundary_reason,
    arg_max(f.is_safe, k.pos) AS last_safe, arg_min(f.sw, k.pos) AS fsw
  FROM walk k JOIN feat f ON f.video_id = k.video_id AND f.pos = k.pos GROUP BY k.video_id, k.u)
"""

TRANSCRIPT_UNITS = UNITS_CTE + (
    "SELECT video_id, CAST(unit_index AS BIGINT) AS unit_index, start_pos, end_pos, start_ms, end_ms, text, word_count, speaker, speaker_role, "
    "boundary_reason, boundary_reason IN ('end', 'speaker_change') OR last_safe AS can_end, "
    "boundary_reason IN ('end', 'speaker_change') AS must_end FROM units"
)


def unit_reasons(spark, sf_dir):
    return tr.unit_reason_histogram(_units(spark, sf_dir))


UNIT_REASONS = UNITS_CTE + (
    "SELECT boundary_reason, count(*) AS units, count(*) FILTER (boundary_reason IN ('end', 'speaker_change') OR last_safe) AS can_end_units, "
    "count(*) FILTER (boundary_reason IN ('end', 'speaker_change')) AS must_end_units FROM units GROUP BY 1"
)


def unit_payloads(spark, sf_dir):
    return tr.unit_payloads(_units(spark, sf_dir))


def segments_proposed(spark, sf_dir):
    return tr.propose_segments(_units(spark, sf_dir))


SEGWALK_CTE = UNITS_CTE.rstrip() + r""",
un AS (SELECT *, boundary_reason IN ('end', 'speaker_change') OR last_safe AS can_end, boundary_reason IN ('end', 'speaker_change') AS must_end FROM units),
sumw AS (SELECT *, sum(word_count - 1 + fsw) OVER (PARTITION BY video_id ORDER BY unit_index) AS cw FROM un),
lim AS (
  SELECT a.video_id, a.unit_index AS i,
    min(b.unit_index) FILTER (b.unit_index > a.unit_index AND (b.end_ms - a.start_ms > 60000 OR b.cw - a.cw + a.word_count > 150)) AS over_at,
    min(b.unit_index) FILTER (b.must_end) AS must_at
  FROM sumw a JOIN sumw b ON b.video_id = a.video_id AND b.unit_index BETWEEN a.unit_index AND a.unit_index + 160 GROUP BY 1, 2),
nxt AS (
  SELECT l.video_id, l.i, CASE WHEN l.over_at IS NOT NULL AND (l.must_at IS NULL OR l.over_at <= l.must_at)
      THEN coalesce((SELECT max(c.unit_index) + 1 FROM un c WHERE c.video_id = l.video_id AND c.can_end AND c.unit_index BETWEEN l.i AND l.over_at - 1), l.over_at)
      ELSE l.must_at + 1 END AS j FROM lim l),
segwalk AS (
  SELECT video_id, 1 AS segment_index, i, j FROM nxt WHERE i = 1
  UNION ALL SELECT n.video_id, s.segment_index + 1, n.i, n.j FROM segwalk s JOIN nxt n ON n.video_id = s.video_id AND n.i = s.j)
"""
SEGMENTS_PROPOSED = SEGWALK_CTE + (
    "SELECT video_id, CAST(segment_index AS BIGINT) AS segment_index, CAST(i AS BIGINT) AS unit_start_index, "
    "CAST(j - 1 AS BIGINT) AS unit_end_index FROM segwalk"
)


def _test_ranges(units: DataFrame) -> DataFrame:
    """Ranges of twelve units with planted faults: shifted starts and ends beyond the last unit."""
    k = F.floor((F.col("unit_index") - 1) / 12)
    return units.groupBy("video_id", (k + 1).alias("segment_index")).agg(
        F.min("unit_index").alias("a"), F.max("unit_index").alias("b")
    ).select(
        "video_id",
        "segment_index",
        (F.col("a") + (F.col("segment_index") % 9 == 0).cast("long")).alias("unit_start_index"),
        (F.col("b") + F.when((F.col("video_id") % 5 == 0) & (F.col("b") % 12 != 0), 3).otherwise(0)).alias("unit_end_index"),
    )


def segment_range_errors(spark, sf_dir):
    units = materialise(_units(spark, sf_dir))
    return tr.segment_range_errors(_test_ranges(units), units)


UN_CTE = UNITS_CTE.rstrip() + """,
un AS (SELECT *, boundary_reason IN ('end', 'speaker_change') OR last_safe AS can_end, boundary_reason IN ('end', 'speaker_change') AS must_end FROM units)
"""
RANGES_CTE = UN_CTE.rstrip() + r""",
rng AS (SELECT video_id, segment_index, a + CASE WHEN segment_index % 9 = 0 THEN 1 ELSE 0 END AS s,
    b + CASE WHEN video_id % 5 = 0 AND b % 12 <> 0 THEN 3 ELSE 0 END AS e
  FROM (SELECT video_id, (unit_index - 1) // 12 + 1 AS segment_index, min(unit_index) AS a, max(unit_index) AS b FROM un GROUP BY 1, 2)),
cnt AS (SELECT video_id, max(unit_index) AS n FROM un GROUP BY 1),
con AS (SELECT r.video_id, r.segment_index, min(u.start_ms) AS start_ms, max(u.end_ms) AS end_ms,
    sum(u.word_count - CASE WHEN u.unit_index = r.s OR u.fsw = 1 THEN 0 ELSE 1 END) AS words,
    sum(len(regexp_extract_all(u.text, '[.!?…]+'))) AS sentences, count(DISTINCT u.speaker) AS speakers,
    bool_or(u.must_end AND u.unit_index < r.e) AS crosses, bool_or(u.can_end) FILTER (u.unit_index = r.e) AS safe_end
  FROM rng r JOIN cnt c ON c.video_id = r.video_id AND r.e <= c.n
  JOIN un u ON u.video_id = r.video_id AND u.unit_index BETWEEN r.s AND r.e GROUP BY 1, 2),
chk AS (SELECT r.*, c.n, k.start_ms, k.end_ms, k.words, k.sentences, k.speakers, k.crosses, k.safe_end, k.start_ms IS NOT NULL AS ok,
    lag(r.e) OVER (PARTITION BY r.video_id ORDER BY r.segment_index) AS pe
  FROM rng r JOIN cnt c USING (video_id) LEFT JOIN con k ON k.video_id = r.video_id AND k.segment_index = r.segment_index),
err AS (
  SELECT video_id, segment_index, 'non_contiguous_ranges' AS code FROM chk WHERE s <> coalesce(pe, 0) + 1
  UNION ALL SELECT video_id, segment_index, 'unit_range_invalid' FROM chk WHERE NOT ok
  UNION ALL SELECT video_id, segment_index, 'duration_exceeded' FROM chk WHERE ok AND end_ms - start_ms > 60250
  UNION ALL SELECT video_id, segment_index, 'duration_too_short' FROM chk WHERE ok AND speakers = 0 AND end_ms - start_ms < 4750
  UNION ALL SELECT video_id, segment_index, 'words_exceeded' FROM chk WHERE ok AND words > 150
  UNION ALL SELECT video_id, segment_index, 'too_dense' FROM chk WHERE ok AND end_ms - start_ms > 40000 AND words >= 90 AND sentences >= 4
  UNION ALL SELECT video_id, segment_index, 'mixed_speakers' FROM chk WHERE ok AND speakers > 1
  UNION ALL SELECT video_id, segment_index, 'crossed_must_boundary' FROM chk WHERE ok AND crosses
  UNION ALL SELECT video_id, segment_index, 'unsafe_unit_boundary' FROM chk WHERE ok AND e < n AND NOT safe_end
  UNION ALL SELECT video_id, 0, 'incomplete_coverage' FROM (SELECT video_id, arg_max(e, segment_index) AS reached, any_value(n) AS n FROM chk GROUP BY 1) WHERE reached <> n)
"""
SEGMENT_RANGE_ERRORS = RANGES_CTE + "SELECT video_id, CAST(segment_index AS BIGINT) AS segment_index, code FROM err"


def segment_error_causes(spark, sf_dir):
    return tr.error_causes(segment_range_errors(spark, sf_dir))


SEGMENT_ERROR_CAUSES = RANGES_CTE + (
    "SELECT CASE WHEN code IN ('duration_exceeded', 'duration_too_short', 'words_exceeded') THEN 'limits' "
    "WHEN code IN ('too_dense', 'unsafe_unit_boundary') THEN 'semantic_boundary' "
    "WHEN code IN ('mixed_speakers', 'crossed_must_boundary') THEN 'speakers' ELSE 'shape' END AS cause, code, count(*) AS errors FROM err GROUP BY 1, 2"
)


def _segments(spark, sf_dir):
    units = materialise(_units(spark, sf_dir))
    return units, tr.build_segments(tr.propose_segments(units), units)


def speech_segments(spark, sf_dir):
    _, segments = _segments(spark, sf_dir)
    return segments.select(
        "video_id", "seg", "segment_id", "start_ms", "end_ms", "start_pos", "end_pos", "tokens_count", "words", "text",
        "speaker", "speaker_role", "timestamp_url",
    )


def half_even(ms: str) -> str:
    return f"({ms} // 1000 + CASE WHEN {ms} % 1000 > 500 OR ({ms} % 1000 = 500 AND ({ms} // 1000) % 2 = 1) THEN 1 ELSE 0 END)"


SPEECH_SEGMENTS = SEGWALK_CTE.rstrip() + rf""",
built AS (SELECT w.video_id, CAST(w.segment_index - 1 AS BIGINT) AS seg, min(u.start_ms) AS start_ms, max(u.end_ms) AS end_ms, min(u.start_pos) AS start_pos,
    max(u.end_pos) AS end_pos, CAST(sum(u.word_count - CASE WHEN u.unit_index = w.i OR u.fsw = 1 THEN 0 ELSE 1 END) AS BIGINT) AS words,
    any_value(u.speaker) AS speaker, any_value(u.speaker_role) AS speaker_role
  FROM segwalk w JOIN un u ON u.video_id = w.video_id AND u.unit_index BETWEEN w.i AND w.j - 1 GROUP BY 1, 2),
txt AS (SELECT b.video_id, b.seg, trim(regexp_replace(string_agg(t.text, '' ORDER BY t.pos), '\s+', ' ', 'g')) AS text
  FROM built b JOIN tok t ON t.video_id = b.video_id AND t.pos BETWEEN b.start_pos AND b.end_pos GROUP BY 1, 2)
SELECT video_id, seg, printf('%d_s_%06d_%06d', video_id, {half_even('start_ms')}, {half_even('end_ms')}) AS segment_id, start_ms, end_ms, start_pos, end_pos,
  end_pos - start_pos + 1 AS tokens_count, words, text, speaker, speaker_role,
  'https://www.youtube.com/watch?v=' || video_id || '&t=' || (start_ms // 1000) || 's' AS timestamp_url
FROM built JOIN txt USING (video_id, seg)"""


def segment_validation(spark, sf_dir):
    """Every check on the segments this library builds itself; sound segments give no rows but
    the counted ones, so the number of checked segments is reported next to the violations."""
    tokens = _tokens_with_roles(spark, sf_dir)
    units = materialise(tr.transcript_units(tokens))
    ranges = materialise(tr.propose_segments(units))
    segments = materialise(tr.build_segments(ranges, units))
    broken = tr.segment_violations(segments, units, tokens).groupBy("code").agg(F.count("*").alias("rows"))
    shape = (
        tr.segment_range_errors(ranges, units)
        .where(F.col("code").isin("non_contiguous_ranges", "unit_range_invalid", "incomplete_coverage", "crossed_must_boundary", "mixed_speakers"))
        .groupBy("code").agg(F.count("*").alias("rows"))
    )
    mapped = tr.segment_unit_ranges(segments, units).agg(F.lit("segments_on_unit_edges").alias("code"), F.count("*").alias("rows"))
    return broken.unionByName(shape).unionByName(mapped)


SEGMENT_VALIDATION = SEGWALK_CTE.rstrip() + """,
ids AS (SELECT w.video_id, w.segment_index, min(u.start_ms) AS s, max(u.end_ms) AS e, arg_max(u.can_end, u.unit_index) AS can_end, arg_max(u.must_end, u.unit_index) AS m
  FROM segwalk w JOIN un u ON u.video_id = w.video_id AND u.unit_index BETWEEN w.i AND w.j - 1 GROUP BY 1, 2)
SELECT 'segments_on_unit_edges' AS code, count(*) AS rows FROM ids
UNION ALL SELECT 'ends_at_unsafe_boundary', count(*) FROM ids WHERE NOT can_end HAVING count(*) > 0
UNION ALL SELECT 'duplicate_segment_id', count(*) FROM (SELECT video_id, """ + half_even("s") + " AS a, " + half_even("e") + """ AS b FROM ids GROUP BY 1, 2, 3 HAVING count(*) > 1) HAVING count(*) > 0"""


def segment_table_faults(spark, sf_dir):
    """Turns as segments and as units, with faults planted in the segments by their numbers."""
    tokens = _tokens_with_roles(spark, sf_dir)
    turns = materialise(inputs.turn_segments(spark, sf_dir, tokens))
    k = (F.col("video_id") * 31 + F.col("seg")) % 11
    h = F.col("video_id") + F.col("seg")
    units = turns.select("video_id", "start_pos", "end_pos", (h % 5 != 0).alias("can_end"), (h % 4 == 0).alias("must_end"))
    segments = turns.select(
        "video_id", "seg", F.when(k == 9, "twice").otherwise(F.col("segment_id")).alias("segment_id"),
        (F.col("start_ms") + F.when(k == 2, 1).when(k == 5, 10**6).otherwise(0)).alias("start_ms"), "end_ms",
        (F.col("start_pos") - F.when(k == 7, 2).otherwise(0)).alias("start_pos"), (F.col("end_pos") + F.when(k == 3, 1).when(k == 8, 10**6).otherwise(0)).alias("end_pos"),
        F.when(k == 6, 151).otherwise(F.col("words")).alias("words"), F.when(k == 4, "zz").when(k == 10, "").otherwise(F.col("speaker")).alias("speaker"), "speaker_role",
        F.when(k == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"),
    )
    found = tr.segment_table_violations(materialise(segments), materialise(units), tokens, merged=False)
    return found.groupBy("video_id", "seg", "code").agg(F.count("*").alias("n"))


SEGMENT_TABLE_FAULTS = oi.with_ctes(oi.TOKENS, oi.SPEAKERS, oi.SEGMENTS).rstrip() + """,
k AS (SELECT *, (video_id * 31 + seg) % 11 AS k, (video_id + seg) % 5 <> 0 AS can_end, (video_id + seg) % 4 = 0 AS must_end FROM seg),
s AS (SELECT video_id, seg, CASE WHEN k = 9 THEN 'twice' ELSE segment_id END AS id, start_ms + CASE k WHEN 2 THEN 1 WHEN 5 THEN 1000000 ELSE 0 END AS s, end_ms AS e, start_pos - CASE k WHEN 7 THEN 2 ELSE 0 END AS a,
    end_pos + CASE k WHEN 3 THEN 1 WHEN 8 THEN 1000000 ELSE 0 END AS b, CASE k WHEN 6 THEN 151 ELSE words END AS w, CASE k WHEN 4 THEN 'zz' WHEN 10 THEN '' ELSE speaker END AS who, speaker_role AS role, CASE k WHEN 1 THEN text || 'x' ELSE text END AS t FROM k),
n AS (SELECT *, lag(s) OVER v AS ps, lag(b) OVER v AS pb, (SELECT max(pos) FROM tok WHERE tok.video_id = s.video_id) AS last FROM s WINDOW v AS (PARTITION BY video_id ORDER BY seg)),
g AS (SELECT n.video_id, n.seg, trim(regexp_replace(string_agg(x.text, '' ORDER BY pos), '\\s+', ' ', 'g')) AS said, min(x.speaker) FILTER (trim(x.text) <> '') AS lo, max(x.speaker) FILTER (trim(x.text) <> '') AS hi
  FROM n JOIN tok x ON x.video_id = n.video_id AND x.pos BETWEEN n.a AND n.b GROUP BY 1, 2),
j AS (SELECT n.*, g.said, CASE WHEN g.lo = g.hi THEN g.lo END AS one, CASE WHEN g.lo = g.hi THEN p.role END AS one_role, f.start_ms AS fs, trim(f.text) = '' AS fb, l.end_ms AS le, trim(x.text) = '' AS xb, u.can_end, o.seg AS own
  FROM n LEFT JOIN g USING (video_id, seg) LEFT JOIN prof p ON p.video_id = n.video_id AND p.speaker = g.lo LEFT JOIN tok f ON f.video_id = n.video_id AND f.pos = n.a LEFT JOIN tok l ON l.video_id = n.video_id AND l.pos = n.b
  LEFT JOIN tok x ON x.video_id = n.video_id AND x.pos = n.b + 1 LEFT JOIN k u ON u.video_id = n.video_id AND u.end_pos = n.b LEFT JOIN k o ON o.video_id = n.video_id AND o.start_pos = n.a),
c AS (
  SELECT video_id, seg, unnest(list_filter([CASE WHEN pb + 1 <> a THEN 'token_gap_or_overlap' END, CASE WHEN own IS NULL THEN 'starts_inside_unit' END, CASE WHEN can_end IS NULL THEN 'ends_inside_unit' END,
    CASE WHEN NOT can_end AND b < last THEN 'ends_at_unsafe_boundary' END, CASE WHEN e < s THEN 'inverted_times' END, CASE WHEN s < ps THEN 'starts_before_previous' END, CASE WHEN e - s > 60250 THEN 'duration_exceeded' END,
    CASE WHEN coalesce(who, '') = '' AND e - s < 4750 THEN 'duration_too_short' END, CASE WHEN w > 150 THEN 'words_exceeded' END, CASE WHEN fs IS NULL THEN 'unknown_start' END, CASE WHEN le IS NULL THEN 'unknown_end' END,
    CASE WHEN a > b THEN 'inverted_range' END, CASE WHEN fb THEN 'leading_blank' END, CASE WHEN xb THEN 'followed_by_blank' END, CASE WHEN s <> fs OR e <> le THEN 'times_disagree' END, CASE WHEN t IS DISTINCT FROM coalesce(said, '') THEN 'text_disagrees' END,
    CASE WHEN nullif(who, '') IS DISTINCT FROM one OR nullif(role, '') IS DISTINCT FROM one_role THEN 'speaker_disagrees' END], lambda y: y IS NOT NULL)) AS code FROM j
  UNION ALL SELECT n.video_id, n.seg, 'must_end_inside' FROM n WHERE EXISTS (SELECT 1 FROM k u WHERE u.video_id = n.video_id AND u.must_end AND u.end_pos >= n.a AND u.end_pos < n.b)
  UNION ALL SELECT video_id, -1, 'stream_not_covered' FROM n GROUP BY 1 HAVING max(b) <> max(last)
  UNION ALL SELECT video_id, min(seg), 'duplicate_segment_id' FROM n GROUP BY video_id, id HAVING count(*) > 1)
SELECT video_id, seg, code, count(*) AS n FROM c GROUP BY ALL"""


def segment_boundary_issues(spark, sf_dir):
    _, segments = _segments(spark, sf_dir)
    return tr.segment_boundary_issues(materialise(segments))


BOUNDARY_ISSUES = SPEECH_SEGMENTS[: SPEECH_SEGMENTS.rindex("SELECT video_id, seg, printf")].rstrip() + r""",
pr AS (SELECT b.*, t.text, lag(t.text) OVER w AS pt, lag(b.speaker) OVER w AS ps FROM built b JOIN txt t USING (video_id, seg) WINDOW w AS (PARTITION BY b.video_id ORDER BY b.seg)),
pq AS (SELECT *, right(regexp_replace(pt, '["''»”)\]}\s]+$', ''), 1) AS tc, pt IS NOT NULL AND speaker = ps AS pair FROM pr)
SELECT video_id, seg, 'too_dense' AS code FROM pq WHERE end_ms - start_ms > 40000 AND len(regexp_extract_all(text, '\S+')) >= 90 AND len(regexp_extract_all(text, '[.!?…]+')) >= 4
UNION ALL SELECT video_id, seg, 'ends_on_non_terminal' FROM pq WHERE pair AND tc IN (',', ';', ':')
UNION ALL SELECT video_id, seg, 'starts_lower_case' FROM pq WHERE pair AND regexp_matches(text, '^\s*\p{Ll}') AND tc NOT IN ('.', '!', '?', '…')
UNION ALL SELECT video_id, seg, 'starts_with_continuation' FROM pq WHERE pair AND tc NOT IN ('.', '!', '?', '…') AND
  lower(trim(regexp_extract(text, '[A-Za-zА-Яа-яЁё-]+'), '-')) IN ('а','но','и','или','либо','потому','поэтому','соответственно','также','то','пожалуйста')"""


def segments_merged_short(spark, sf_dir):
    """Units taken as segments, so that short neighbours of one speaker exist."""
    units = _units(spark, sf_dir).select(
        "video_id", (F.col("unit_index") - 1).alias("seg"), "start_ms", "end_ms", "start_pos", "end_pos",
        F.col("word_count").alias("words"), "speaker", "speaker_role", F.col("first_starts_word").alias("starts_word"), "text",
    )
    return tr.merge_short_segments(materialise(units)).select(
        "video_id", "seg", "start_ms", "end_ms", "start_pos", "end_pos", "words", "merged_from", "speaker", "text"
    )


SEGMENTS_MERGED_SHORT = UNITS_CTE.rstrip() + r""",
mw AS (
  SELECT video_id, unit_index AS i, 0 AS g, start_ms AS s, end_ms AS e, word_count AS w, speaker AS sp FROM units WHERE unit_index = 1
  UNION ALL
  SELECT u.video_id, u.unit_index, CASE WHEN m.ok THEN m.g ELSE m.g + 1 END, CASE WHEN m.ok THEN m.s ELSE u.start_ms END, u.end_ms,
    CASE WHEN m.ok THEN m.w + u.word_count - (1 - u.fsw) ELSE u.word_count END, u.speaker
  FROM (SELECT m.*, n.unit_index AS ni, (m.sp = n.speaker AND (m.e - m.s < 5000 OR n.end_ms - n.start_ms < 5000)
          AND n.end_ms - m.s <= 60250 AND m.w + n.word_count - (1 - n.fsw) <= 150) AS ok
        FROM mw m JOIN units n ON n.video_id = m.video_id AND n.unit_index = m.i + 1) m
  JOIN units u ON u.video_id = m.video_id AND u.unit_index = m.ni)
SELECT m.video_id, CAST(m.g AS BIGINT) AS seg, min(u.start_ms) AS start_ms, max(u.end_ms) AS end_ms, min(u.start_pos) AS start_pos, max(u.end_pos) AS end_pos,
  CAST(arg_max(m.w, m.i) AS BIGINT) AS words, count(*) AS merged_from, any_value(u.speaker) AS speaker,
  trim(regexp_replace(string_agg(CASE WHEN u.fsw = 1 THEN ' ' ELSE '' END || u.text, '' ORDER BY m.i), '\s+', ' ', 'g')) AS text
FROM mw m JOIN units u ON u.video_id = m.video_id AND u.unit_index = m.i GROUP BY m.video_id, m.g"""


def segment_language_mode(spark, sf_dir):
    """Most frequent token language and speaker of every turn."""
    toks = inputs.tokens(spark, sf_dir)
    lang = tr.mode_by(toks, ["video_id", "turn"], "language", "pos")
    who = tr.mode_by(toks, ["video_id", "turn"], "speaker", "pos")
    return lang.join(who, ["video_id", "turn"])


SEGMENT_LANGUAGE_MODE = oi.with_ctes(oi.TOKENS) + (
    "SELECT a.video_id, a.turn, a.language, b.speaker FROM "
    "(SELECT video_id, turn, arg_max(language, n * 1000000 - seen) AS language FROM (SELECT video_id, turn, language, count(*) AS n, min(pos) AS seen FROM tok GROUP BY 1, 2, 3) GROUP BY 1, 2) a "
    "JOIN (SELECT DISTINCT video_id, turn, speaker FROM tok) b USING (video_id, turn)"
)


def duration_distribution(spark, sf_dir):
    segs = inputs.turn_segments(spark, sf_dir)
    spoken = tr.distribution(segs, ["speaker_role"], (F.col("end_ms") - F.col("start_ms"))).withColumnRenamed("speaker_role", "grp")
    docs = tr.distribution(inputs.table(spark, sf_dir, "documents"), ["lang"], F.col("n_chars")).withColumnRenamed("lang", "grp")
    return spoken.unionByName(docs)


DURATION_DISTRIBUTION = oi.with_ctes(oi.TOKENS, oi.SPEAKERS, oi.SEGMENTS) + (
    "SELECT speaker_role AS grp, min(end_ms - start_ms) AS min_value, max(end_ms - start_ms) AS max_value, round_even(avg(end_ms - start_ms), 3) AS avg_value FROM seg GROUP BY 1 "
    "UNION ALL SELECT lang, min(n_chars), max(n_chars), round_even(avg(n_chars), 3) FROM documents GROUP BY 1"
)


QUERIES = {
    "speaker_profiles": (speaker_profiles, SPEAKER_PROFILES),
    "speaker_summary": (speaker_summary, SPEAKER_SUMMARY),
    "token_role_join": (token_roles, TOKEN_ROLES),
    "provider_tokens": (provider_tokens, PROVIDER_TOKENS),
    "token_stream_violations": (token_stream_violations, TOKEN_STREAM_VIOLATIONS),
    "token_table_faults": (token_table_faults, TOKEN_TABLE_FAULTS),
    "unit_boundaries": (unit_boundaries, UNIT_BOUNDARIES),
    "transcript_units": (transcript_units, TRANSCRIPT_UNITS),
    "transcript_units_blocks": (transcript_units_blocks, TRANSCRIPT_UNITS),
    "unit_reason_histogram": (unit_reasons, UNIT_REASONS),
    "unit_payloads": (unit_payloads, None),
    "segments_proposed": (segments_proposed, SEGMENTS_PROPOSED),
    "segment_range_errors": (segment_range_errors, SEGMENT_RANGE_ERRORS),
    "segment_error_causes": (segment_error_causes, SEGMENT_ERROR_CAUSES),
    "speech_segments": (speech_segments, SPEECH_SEGMENTS),
    "segment_table_faults": (segment_table_faults, SEGMENT_TABLE_FAULTS),
    "segment_validation": (segment_validation, SEGMENT_VALIDATION),
    "segment_boundary_issues": (segment_boundary_issues, BOUNDARY_ISSUES),
    "segments_merged_short": (segments_merged_short, SEGMENTS_MERGED_SHORT),
    "segment_language_mode": (segment_language_mode, SEGMENT_LANGUAGE_MODE),
    "duration_distribution": (duration_distribution, DURATION_DISTRIBUTION),
}
