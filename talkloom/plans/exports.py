"""Registered queries over export bundles, manifests, notes and the file readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from talkloom import fixed_values as fx
from talkloom.operators import timeline as tl
from talkloom.operators import transcript as tr
from talkloom.plans import inputs
from talkloom.plans import oracle_inputs as oi
from talkloom.plans.scenes import SCENES, fallback_scenes, frame_features
from talkloom.session import ensure_checkpoint_dir, materialise
from talkloom.sources import notes, readers, schemas, sinks

CL = oi.with_ctes(oi.CLAIMS).rstrip() + " "


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/export-{uuid.uuid4().hex}"


def _claim_table(spark, sf_dir):
    return inputs.claims(spark, sf_dir).drop("start_ms")


def export_bundle(spark, sf_dir):
    """Bundle written as JSON lines per video and read back with the strict reader."""
    folder = _folder(spark)
    toks = inputs.tokens(spark, sf_dir).select(F.col("video_id").cast("string").alias("video_id"), F.col("pos").alias("token_index"), "text", "start_ms", "end_ms", "speaker", "language")
    scenes = fallback_scenes(spark, sf_dir).withColumn("video_id", F.col("video_id").cast("string")).drop("duration_ms")
    written = sinks.write_bundle({"speech_tokens": toks, "scenes": scenes, "style_claims": _claim_table(spark, sf_dir)}, folder, visual_enabled=True)
    out = None
    for path in written:
        name = path.rsplit("/", 1)[1]
        part = readers.read_table(spark, path, name).groupBy("video_id").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "video_id", "rows")
        out = part if out is None else out.unionByName(part)
    return out


EXPORT_BUNDLE = oi.with_ctes(oi.TOKENS, SCENES) + """SELECT 'speech_tokens' AS "table", CAST(video_id AS VARCHAR) AS video_id, count(*) AS rows FROM tok GROUP BY 2 UNION ALL SELECT 'scenes', CAST(video_id AS VARCHAR), count(*) FROM scn GROUP BY 2 UNION ALL SELECT 'style_claims', source, count(*) FROM documents GROUP BY 2"""


def export_manifest(spark, sf_dir):
    m = sinks.manifest(_claim_table(spark, sf_dir), visual_enabled=False)
    return m.select("video_id", "filename", "role", "kb_import", "visual_enabled", F.length("claims_sha256").cast("long").alias("sha_chars"), "claims_count")


_FILES = [t for t in fx.EXPORT_TABLES if t not in fx.VISUAL_EXPORT_TABLES]
EXPORT_MANIFEST = "WITH f AS (SELECT unnest([" + ", ".join(f"'{t}.jsonl'" for t in _FILES) + """]) AS filename)
SELECT source AS video_id, filename, CASE WHEN filename IN ('chunks.jsonl', 'style_claims.jsonl') THEN 'knowledge' ELSE 'audit' END AS role, filename IN ('chunks.jsonl', 'style_claims.jsonl') AS kb_import, false AS visual_enabled,
  CASE WHEN filename = 'style_claims.jsonl' THEN CAST(64 AS BIGINT) END AS sha_chars, CASE WHEN filename = 'style_claims.jsonl' THEN count(*) END AS claims_count FROM documents, f GROUP BY 1, 2"""


def manifest_check(spark, sf_dir):
    """Manifests written with visuals and before an edit, checked against an audio-only export of today."""
    claims = _claim_table(spark, sf_dir)
    stored = sinks.manifest(claims.withColumn("claim", F.when(F.col("claim_pos") % 100 == 3, "older text").otherwise(F.col("claim"))), visual_enabled=True).where("filename <> 'chunk_plan.jsonl'")
    return sinks.manifest_problems(stored, sinks.manifest(claims, visual_enabled=False))


MANIFEST_CHECK = """
WITH v AS (SELECT source AS video_id, bool_or(doc_id % 100 = 3) AS c FROM documents GROUP BY 1)
SELECT video_id, 'chunk_plan.jsonl' AS filename, 'missing' AS problem FROM v UNION ALL SELECT video_id, unnest(['scenes.jsonl', 'frame_refs.jsonl', 'visual_events.jsonl']), 'unexpected' FROM v UNION ALL SELECT video_id, 'style_claims.jsonl', 'claims_changed' FROM v WHERE c"""


def reader_checks(spark, sf_dir):
    """A written table read back strictly and leniently, with lines broken on purpose."""
    folder = _folder(spark)
    docs = inputs.table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    good = F.to_json(F.struct(i.cast("string").alias("video_id"), F.col("lang").alias("title"), F.when(i % 4 == 0, F.lit(1)).alias("extra")))
    docs.select(F.when(i % 10 == 1, "").when(i % 10 == 2, "{broken").when(i % 10 == 3, "[1, 2]").otherwise(good).alias("value")).write.text(folder)
    lenient = readers.read_lenient(spark, folder, schemas.TABLES["video_info"])
    unknown = readers.unknown_fields(spark, folder, schemas.TABLES["video_info"])
    missing = readers.read_lenient(spark, folder + "-nowhere", schemas.TABLES["video_info"])
    rows = lenient.groupBy("title").agg(F.count("*").alias("rows")).select(F.concat(F.lit("read "), "title").alias("what"), "rows")
    return rows.unionByName(unknown.select(F.concat(F.lit("unknown "), "field").alias("what"), F.col("lines").alias("rows"))).unionByName(missing.agg(F.lit("missing file").alias("what"), F.count("*").alias("rows")))


READER_CHECKS = """SELECT 'read ' || lang AS what, count(*) AS rows FROM documents WHERE doc_id % 10 NOT IN (1, 2, 3) GROUP BY 1 UNION ALL SELECT 'unknown extra', count(*) FROM documents WHERE doc_id % 10 NOT IN (1, 2, 3) AND doc_id % 4 = 0 UNION ALL SELECT 'missing file', 0"""


def _note_inputs(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    empty = F.array().cast("array<string>")
    chunks = docs.select(
        F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.concat(F.lit("Doc "), "doc_id").alias("chunk_title"), F.col("source").alias("title"), F.lit("u").alias("url"), F.col("lang").alias("channel"), F.lit("t").alias("timestamp_url"),
        (F.col("doc_id") * 1500).alias("start_ms"), (F.col("doc_id") * 1500 + 250).alias("end_ms"), F.lit("packed").alias("boundary_reason"), F.array("lang", "source").alias("topics"), empty.alias("entities"), F.array(F.lit("audio")).alias("modality"),
        F.array(F.lit("s1"), F.lit("s2")).alias("speech_segment_ids"), F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("host"))).otherwise(empty).alias("speaker_roles"), F.when(F.col("doc_id") % 6 == 0, "brief").otherwise("").alias("presenter_brief"), F.col("text").alias("combined_text"),
    )
    claims = docs.select(
        F.concat(F.lit("c"), F.col("doc_id") - F.col("doc_id") % 4).alias("chunk_id"), F.col("doc_id").alias("claim_pos"), F.col("lang").alias("subject"), F.col("source").alias("claim"), F.when(F.col("doc_id") % 2 == 0, "why").otherwise("").alias("rationale"),
        empty.alias("conditions"), F.array(F.lit("a"), F.lit("b")).alias("prefer"), F.when(F.col("doc_id") % 9 == 0, F.array(F.lit("z"))).otherwise(empty).alias("avoid"),
    )
    return chunks, claims


def render_notes(spark, sf_dir):
    chunks, claims = _note_inputs(spark, sf_dir)
    return notes.chunk_notes(chunks, claims)


NOTES = r"""
WITH cl AS (SELECT 'c' || (doc_id - doc_id % 4) AS chunk_id, doc_id, '- **' || lang || '**: ' || source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '  - Rationale: why' ELSE '' END || chr(10) || '  - Prefer: a, b' || CASE WHEN doc_id % 9 = 0 THEN chr(10) || '  - Avoid: z' ELSE '' END AS t FROM documents),
ct AS (SELECT chunk_id, string_agg(t, chr(10) ORDER BY doc_id) AS t FROM cl GROUP BY 1),
nt AS (SELECT 'chunks/c' || doc_id || '.md' AS path, regexp_replace(concat_ws(chr(10), '# c' || doc_id || chr(10), '- Chunk title: Doc ' || doc_id, '- Video: [' || source || '](u)', '- Channel: ' || lang, '- Timestamp: [YouTube](t)',
   '- Range: ' || CAST(doc_id * 1500 / 1000 AS DOUBLE) || 's -> ' || CAST((doc_id * 1500 + 250) / 1000 AS DOUBLE) || 's', '- Boundary: packed', '- Topics: ' || lang || ', ' || source, '- Entities: ', '- Modality: audio', '- Speech segments: s1, s2',
   CASE WHEN doc_id % 4 = 0 THEN '- Speaker roles: host' END, CASE WHEN doc_id % 6 = 0 THEN '- Presenter: brief' END, text, CASE WHEN ct.t IS NOT NULL THEN chr(10) || '## Style Claims' || chr(10) || chr(10) || ct.t END), '\s+$', '') || chr(10) AS body
  FROM documents LEFT JOIN ct ON ct.chunk_id = 'c' || doc_id)
"""
RENDER_NOTES = NOTES + "SELECT * FROM nt"


def changed_notes(spark, sf_dir):
    """Notes against a stored copy in which some are old and some are gone: only those are to be written."""
    fresh = materialise(render_notes(spark, sf_dir))
    stored = fresh.where("length(path) % 2 = 0 OR path LIKE '%4.md'").withColumn("body", F.when(F.col("path").like("%8.md"), "old").otherwise(F.col("body")))
    return sinks.changed_notes(fresh, stored).select("path", F.md5("body").alias("digest"))


CHANGED_NOTES = NOTES + "SELECT path, md5(body) AS digest FROM nt WHERE NOT (length(path) % 2 = 0 OR path LIKE '%4.md') OR path LIKE '%8.md'"


def note_lines(spark, sf_dir):
    """Index and video notes of every conversation, as ordered lines."""
    toks = materialise(inputs.tokens(spark, sf_dir))
    roled = tr.attach_roles(toks, tr.speaker_profiles(toks))
    segs = materialise(inputs.turn_segments(spark, sf_dir))
    videos = segs.groupBy("video_id").agg((F.max("end_ms") / 1000).alias("duration")).select(
        "video_id", F.concat(F.lit("Talk "), "video_id").alias("title"), F.lit("u").alias("url"), F.lit("ch").alias("channel"), "duration"
    )
    events = tl.audio_events(segs).withColumn("timestamp_url", F.lit("t"))
    spoken = tl.tokens_in_segments(roled, segs).withColumnRenamed("segment_id", "scene_id")
    turns = tl.speech_turns(spoken, ["video_id", "scene_id"])
    frames = frame_features(spark, sf_dir).select(F.concat(F.lit("s"), F.col("scene"), F.lit("_0")).alias("scene_id"), "ts_ms", "path")
    claims = segs.where("seg = 1").select(
        "video_id", F.col("seg").alias("claim_pos"), "start_ms", F.lit("t").alias("timestamp_url"), F.col("speaker").alias("subject"), F.lit("said").alias("claim"), F.lit("").alias("rationale"),
        *[F.array().cast("array<string>").alias(c) for c in ("conditions", "prefer", "avoid")],
    )
    chunks = segs.select("video_id", "start_ms", F.col("segment_id").alias("chunk_id"))
    lines = notes.index_lines(videos, chunks, "Talks").unionByName(notes.video_lines(videos, claims, events, turns, frames))
    return lines.groupBy("path", "section").agg(F.count("*").alias("blocks"), F.sum(F.length("line")).cast("long").alias("chars"))


QUERIES = {
    "export_bundle": (export_bundle, EXPORT_BUNDLE),
    "export_manifest": (export_manifest, EXPORT_MANIFEST),
    "manifest_check": (manifest_check, MANIFEST_CHECK),
    "reader_checks": (reader_checks, READER_CHECKS),
    "render_notes": (render_notes, RENDER_NOTES),
    "changed_notes": (changed_notes, CHANGED_NOTES),
    "note_lines": (note_lines, None),
}
