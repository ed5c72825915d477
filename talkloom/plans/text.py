"""Registered queries that run the text, time, URL and redaction expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.functions import fields as fl
from talkloom.functions import redact as rd
from talkloom.functions import text as tx
from talkloom.functions import times as tm
from talkloom.plans import inputs
from talkloom.plans import oracle_inputs as oi
from talkloom.plans.chunks import CLIP


def redact_text(spark, sf_dir):
    """Secrets masked in every document; one in ten carries planted ones next to what it already holds."""
    docs = inputs.table(spark, sf_dir, "documents")
    planted = F.when(
        F.col("doc_id") % 10 == 0, F.concat("text", F.lit("\nAuthorization: Bearer abc.def\nSet-Cookie: a=b; c=d\napi_key = 'k123' sk-abcdefghijklmnop1234 token_fingerprint: no"))
    ).otherwise(F.col("text"))
    out = docs.select("doc_id", planted.alias("before")).withColumn("after", rd.redact_text(F.col("before")))
    return out.select("doc_id", F.md5("after").alias("digest"), (F.col("after") != F.col("before")).alias("changed"), F.regexp_count("after", F.lit(r"\[redacted\]")).cast("long").alias("masks"))


_W = r"(^|[^\p{L}\p{N}_])"
REDACT_TEXT = rf"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || chr(10) || 'Authorization: Bearer abc.def' || chr(10) || 'Set-Cookie: a=b; c=d' || chr(10) || 'api_key = ''k123'' sk-abcdefghijklmnop1234 token_fingerprint: no' ELSE text END AS b FROM documents),
r1 AS (SELECT *, regexp_replace(b, '(?i){_W}(authorization\s*[:=]\s*)(bearer\s+)?[^\s,;]+', '\1\2\3[redacted]', 'g') AS a1 FROM d),
r2 AS (SELECT *, regexp_replace(a1, '(?i){_W}((?:set-)?cookie\s*:\s*)[^\r\n]+', '\1\2[redacted]', 'g') AS a2 FROM r1),
r3 AS (SELECT *, regexp_replace(a2, '(?i){_W}((?:api[_-]?key|token|secret|access[_-]?token|refresh[_-]?token|auth[_-]?token)\s*[:=]\s*)[''"]?[^''"\s,;]+', '\1\2[redacted]', 'g') AS a3 FROM r2),
r4 AS (SELECT *, regexp_replace(a3, '{_W}sk-[A-Za-z0-9_-]{{16,}}', '\1[redacted]', 'g') AS a FROM r3)
SELECT doc_id, md5(a) AS digest, a <> b AS changed, CAST(len(regexp_extract_all(a, '\[redacted\]')) AS BIGINT) AS masks FROM r4"""


def redact_fields(spark, sf_dir):
    """Event properties as maps with sensitive and harmless keys."""
    e = inputs.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    m = F.create_map(F.lit("k"), k, F.lit("API-Key"), F.col("event_type"), F.lit("secret_present"), F.lit("yes"), F.lit("note"), F.concat(F.lit("token="), k))
    out = e.select("event_id", rd.redact_map(m).alias("m"))
    return out.select("event_id", *[F.col("m")[c].alias(a) for c, a in (("k", "k"), ("API-Key", "api_key"), ("secret_present", "present"), ("note", "note"))])


REDACT_FIELDS = "SELECT event_id, json_extract_string(props, '$.k') AS k, '[redacted]' AS api_key, 'yes' AS present, 'token=[redacted]' AS note FROM events"


def url_ids(spark, sf_dir):
    """Video identifiers out of page addresses and of video addresses made from them."""
    p = inputs.table(spark, sf_dir, "pages")
    i = F.col("page_id")
    made = (
        F.when(i % 7 == 0, F.concat(F.lit("https://youtu.be/"), i, F.lit("/x"))).when(i % 7 == 1, F.concat(F.lit(" https://www.youtube.com/watch?a=1&v=v"), i))
        .when(i % 7 == 2, F.concat(F.lit("https://m.youtube.com/shorts/s"), i)).when(i % 7 == 3, F.concat(F.lit("https://youtube.com/embed/e"), i, F.lit("?x=1")))
        .when(i % 7 == 4, F.lit("https://www.youtube.com/watch?v=")).when(i % 7 == 5, F.lit("https://youtu.be/")).otherwise(F.col("url"))
    )
    return p.select("page_id", fl.video_id_of_url(made).alias("video_id"), fl.video_id_of_url(F.col("url")).alias("page_video"))


URL_IDS = """SELECT page_id, CASE page_id % 7 WHEN 0 THEN CAST(page_id AS VARCHAR) WHEN 1 THEN 'v' || page_id WHEN 2 THEN 's' || page_id WHEN 3 THEN 'e' || page_id END AS video_id, CAST(NULL AS VARCHAR) AS page_video FROM pages"""


def key_normalise(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(tx.compare_key("text")).alias("compare_key"), F.md5(tx.label_key("text")).alias("label_key"), tx.word_count("text").alias("words"))


KEY_NORMALISE = rf"SELECT doc_id, md5({oi.fold(oi.squash('text'))}) AS compare_key, md5({oi.label_key('text')}) AS label_key, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS words FROM documents"


def clip_text(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents").withColumn("s", tx.squash("text"))
    return docs.select("doc_id", tx.clip_words("s", 80).alias("clip_80"), tx.clip_words("s", 7).alias("clip_7"), tx.clip_ellipsis("text", 160).alias("clip_dots"))


CLIP_TEXT = f"WITH d AS (SELECT doc_id, {oi.squash('text')} AS s FROM documents) SELECT doc_id, {CLIP.format(x='s', n=80)} AS clip_80, {CLIP.format(x='s', n=7)} AS clip_7, CASE WHEN length(s) <= 160 THEN s ELSE rtrim(substring(s, 1, 157)) || '...' END AS clip_dots FROM d"


def text_shapes(spark, sf_dir):
    """Terminal character, sentences, first word and joins of lines of every document."""
    docs = inputs.table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    return docs.select(
        "doc_id", tx.terminal_char("text").alias("terminal"), tx.sentence_count("text").alias("sentences"), tx.first_word("text").alias("first_word"), tx.starts_lower("text").alias("starts_lower"),
        F.md5(F.array_join(tx.unique_in_order(lines), "\n")).alias("unique_lines"), F.md5(tx.join_paragraphs(F.get(lines, 0), F.get(lines, 1), F.get(lines, 2))).alias("paragraphs"),
    )


_L1 = r"list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
TEXT_SHAPES = rf"""
WITH d AS (SELECT doc_id, text, {_L1} AS l, string_split(text, chr(10)) AS raw FROM documents)
SELECT doc_id, nullif(right(regexp_replace(text, '[\"''»”)\]}}\s]+$', ''), 1), '') AS terminal, CAST(len(regexp_extract_all(text, '[.!?…]+')) AS BIGINT) AS sentences, lower(trim(regexp_extract(text, '[A-Za-zА-Яа-яЁё-]+'), '-')) AS first_word,
  regexp_matches(text, '^\s*\p{{Ll}}') AS starts_lower, md5(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), chr(10))) AS unique_lines,
  md5(array_to_string(list_filter(list_transform(raw[1:3], lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''), chr(10) || chr(10))) AS paragraphs FROM d"""


def homoglyph_repair(spark, sf_dir):
    """Latin look-alikes planted into Cyrillic words next to each document's own words."""
    docs = inputs.table(spark, sf_dir, "documents")
    mixed = F.concat(F.lit("кopичнeвый "), F.col("lang"), F.lit(" Пальtо-Kот "), F.col("text"))
    return docs.select("doc_id", tx.repair_homoglyphs(mixed).alias("repaired"), tx.repair_homoglyphs(F.col("text")).eqNullSafe(F.col("text")).alias("untouched"))


HOMOGLYPH_REPAIR = "SELECT doc_id, 'коричневый ' || lang || ' Пальtо-Кот ' || text AS repaired, true AS untouched FROM documents"


def time_labels(spark, sf_dir):
    """Identifiers, addresses and labels of times taken from the event log."""
    e = inputs.table(spark, sf_dir, "events")
    ms = (F.col("event_id") * 737).cast("long")
    return e.select(
        "event_id", tm.span_id(F.col("user_id"), "s", ms, ms + 500).alias("span_id"), tm.ordinal_id(F.col("user_id"), "claim", F.col("event_id")).alias("ordinal_id"),
        tm.timestamp_url(F.col("user_id"), ms - 2000).alias("url"), tm.minute_label(ms / 1000).alias("minute"), tm.range_label(ms / 1000, F.when(F.col("event_id") % 5 != 0, ms / 1000 + 61)).alias("range"),
        tm.clamp(ms, F.lit(1000), F.lit(5_000_000)).alias("clamped"), tm.to_ms(ms / 1000).alias("back"), tm.frame_rate(F.concat(F.col("event_id"), F.lit("/"), F.col("event_id") % 3)).alias("fps"),
    )


def _half(ms: str) -> str:
    return f"({ms} // 1000 + CASE WHEN {ms} % 1000 > 500 OR ({ms} % 1000 = 500 AND ({ms} // 1000) % 2 = 1) THEN 1 ELSE 0 END)"


TIME_LABELS = f"""
WITH e AS (SELECT *, event_id * 737 AS ms, event_id * 737 // 1000 AS s FROM events)
SELECT event_id, printf('%d_s_%06d_%06d', user_id, {_half('ms')}, {_half('(ms + 500)')}) AS span_id, printf('%d_claim_%06d', user_id, event_id) AS ordinal_id, 'https://www.youtube.com/watch?v=' || user_id || '&t=' || (greatest(ms - 2000, 0) // 1000) || 's' AS url,
  printf('%d:%02d', s // 60, s % 60) AS minute, CASE WHEN event_id % 5 = 0 THEN 'time unknown' ELSE printf('%d:%02d-%d:%02d', s // 60, s % 60, (ms + 61000) // 1000 // 60, (ms + 61000) // 1000 % 60) END AS range,
  greatest(1000, least(ms, 5000000)) AS clamped, ms AS back, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id AS DOUBLE) / (event_id % 3) END AS fps FROM e"""


def media_probes(spark, sf_dir):
    """Probe documents and video metadata made from orders, read with their defaults."""
    o = inputs.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    probe = F.when(k % 6 == 0, F.lit('{"format": {}}')).otherwise(F.format_string('{"format": {"duration": "%d.5"}}', k))
    title = F.when(k % 4 == 0, "").when(k % 4 == 1, F.lit(None)).otherwise("a title")
    return o.select(
        "o_orderkey", tm.probe_duration(probe).alias("duration"), fl.first_present(title, k).alias("title"),
        fl.first_present(F.when(k % 3 == 0, ""), F.when(k % 5 == 0, "uploader"), F.lit("unknown")).alias("channel"),
    )


MEDIA_PROBES = """SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey + 0.5::DOUBLE END AS duration, CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_orderkey AS VARCHAR) ELSE 'a title' END AS title, CASE WHEN o_orderkey % 5 = 0 THEN 'uploader' ELSE 'unknown' END AS channel FROM orders"""


def previews(spark, sf_dir):
    """Bounded one-line previews of pages, some of which hold embedded data."""
    p = inputs.table(spark, sf_dir, "pages")
    i = F.col("page_id")
    v = F.when(i % 5 == 0, F.concat(F.lit("data:image/png;base64,"), F.md5("html"))).when(i % 5 == 1, F.repeat(F.md5("url"), 8)).when(i % 5 == 2, F.concat(F.lit("x data:image/png;base64,AAAA y secret=abc "), F.lit("z"))).otherwise(F.col("html"))
    return p.select("page_id", rd.preview(v, 120).alias("preview"))


PREVIEWS = r"""
WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 2 THEN 'x data:[omitted base64 data url] y secret=[redacted] z' ELSE trim(regexp_replace(html, '\s+', ' ', 'g')) END AS s FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN '[omitted base64 data url]' WHEN 1 THEN '[omitted base64 content]' ELSE CASE WHEN length(s) <= 120 THEN s ELSE rtrim(substring(s, 1, 117)) || '...' END END AS preview FROM p"""


QUERIES = {
    name: (globals()[name], globals()[name.upper()])
    for name in "redact_text redact_fields url_ids key_normalise clip_text text_shapes homoglyph_repair time_labels media_probes previews".split()
}
