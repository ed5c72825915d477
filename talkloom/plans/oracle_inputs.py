"""The derived tables of ``inputs`` as common table expressions in the oracle's SQL."""

TOKENS = r"""
turn_pieces AS (
  SELECT conv_id AS video_id, turn, role AS speaker, text AS turn_text, regexp_extract_all(text, '\s*\S+') AS pieces
  FROM conversations),
turn_offsets AS (
  SELECT *, coalesce(sum(len(pieces)) OVER (PARTITION BY video_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM turn_pieces),
token_rows AS (
  SELECT video_id, turn, speaker, CAST(off + i - 1 AS BIGINT) AS pos, i - 1 AS i, pieces[i] AS text
  FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS i FROM turn_offsets)),
tok AS (
  SELECT video_id, turn, speaker, pos, text,
    CAST(400 * pos + 1500 * turn + 1000 * (pos // 37) AS BIGINT) AS start_ms,
    CAST(400 * pos + 1500 * turn + 1000 * (pos // 37) + 300 + 20 * (length(text) % 5) AS BIGINT) AS end_ms,
    CASE WHEN i % 7 = 0 THEN 'xx' ELSE 'yy' END AS language
  FROM token_rows)"""

SPEAKERS = r"""
spk_join AS (
  SELECT video_id, speaker, string_agg(text, '' ORDER BY pos) AS joined, count(*) AS tokens_count,
    CAST(sum(greatest(0, end_ms - start_ms)) AS BIGINT) AS speech_ms, min(start_ms) AS first_start_ms,
    max(end_ms) AS last_end_ms, min(pos) AS first_pos
  FROM tok GROUP BY video_id, speaker),
spk AS (
  SELECT *, CAST(len(regexp_extract_all(joined, '\S+')) AS BIGINT) AS words_count FROM spk_join),
prof AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY video_id ORDER BY speech_ms DESC, words_count DESC, first_pos) = 1
    THEN 'host' ELSE 'offscreen_questioner' END AS role FROM spk)"""

SEGMENTS = r"""
seg AS (
  SELECT t.video_id, t.turn AS seg, 's' || t.video_id || '_' || t.turn AS segment_id, min(t.start_ms) AS start_ms,
    max(t.end_ms) AS end_ms, min(t.pos) AS start_pos, max(t.pos) AS end_pos, count(*) AS words,
    any_value(t.speaker) AS speaker, any_value(p.role) AS speaker_role,
    any_value(trim(regexp_replace(c.turn_text, '\s+', ' ', 'g'))) AS text
  FROM tok t JOIN prof p ON p.video_id = t.video_id AND p.speaker = t.speaker
  JOIN turn_pieces c ON c.video_id = t.video_id AND c.turn = t.turn
  GROUP BY t.video_id, t.turn)"""

CLAIMS = r"""
claims AS (
  SELECT source AS video_id, doc_id AS claim_pos, 'claim_' || doc_id AS claim_id, source || '_c_' || (doc_id % 7) AS chunk_id,
    (['rule','recommendation','warning','definition','example','exception'])[(length(lang) + ascii(lang)) % 6 + 1] AS claim_type,
    lang AS subject, text AS claim, text AS rationale, CAST([] AS VARCHAR[]) AS conditions,
    [lang] AS applies_to, CAST([] AS VARCHAR[]) AS avoid, [source] AS prefer,
    list_filter(string_split(text, chr(10)), lambda x: x <> '') AS evidence, [lang, source] AS topics,
    CASE WHEN n_chars > 2000 THEN 'high' WHEN n_chars > 500 THEN 'medium' ELSE 'low' END AS confidence,
    (doc_id % 50) * 1000 AS start_ms
  FROM documents)"""


def with_ctes(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(p.strip() for p in parts) + "\n"


def fold(expr: str) -> str:
    """Case folding as in functions.text.fold_case."""
    return f"replace(translate(lower({expr}), 'ς', 'σ'), 'ß', 'ss')"


def squash(expr: str) -> str:
    return rf"trim(regexp_replace(coalesce({expr}, ''), '\s+', ' ', 'g'))"


def label_key(expr: str) -> str:
    inner = f"replace({fold(f'coalesce({expr}, chr(32))')}, 'ё', 'е')"
    dashless = f"regexp_replace({inner}, '[-‐‑‒–—]+', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({dashless}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def any_pattern(key: str, patterns: list[str]) -> str:
    """A pattern test on a padded label key, where word boundaries are blanks."""
    body = "|".join(p.replace(r"\b", " ").replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\s+", " ") for p in patterns)
    return f"regexp_matches(' ' || {key} || ' ', '{body}')"


def quote_list(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


VISUAL = r"""
vev AS (SELECT *, lines[1] AS visual_summary, lines AS observations, lines[2:] AS interpretations, words[1:5] AS items,
    [lang, source, coalesce(words[6], '')] AS style_topics, words[3:5] AS on_screen_text, words[7:8] AS presentation_context, coalesce(lines[-1], '') AS notes,
    doc_id % 3 = 0 AS is_recurring, (['none','background','brief','primary_example'])[doc_id % 4 + 1] AS relevance,
    CASE WHEN doc_id % 3 = 0 THEN 'baseline ' || (doc_id % 5) ELSE '' END AS baseline_summary, lines[3:] AS scene_deltas, coalesce(words[2], '') AS narrative_brief
  FROM (SELECT doc_id, lang, source, source AS video_id, source || '_scene_' || doc_id AS scene_id,
      list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '') AS lines,
      list_filter(regexp_split_to_array(text, '[\s.,;:!?]+'), lambda w: w <> '') AS words FROM documents))"""
