"""Registered queries over visual events: markers, quarantine, leakage, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom import fixed_values as fx
from talkloom.functions.markers import MarkerRules
from talkloom.operators import visual as vis
from talkloom.plans import inputs
from talkloom.plans import oracle_inputs as oi
from talkloom.session import materialise

KEYS = ["video_id", "scene_id"]
LATIN_TECHNICAL = [r"\b(?:anat|inen|quean)\w*\b", r"\bwith\s+th\w*\b", r"\bla\s+\w+ment\b"]
LATIN_PRESENTATION = [r"\bein\w*\s+(?:die|der)\b", r"\bare\s+\w+ing\b"]
LATIN_COLOURS = ["en", "src1", "src12"]
RULES = MarkerRules(
    technical=tuple(fx.TECHNICAL_PATTERNS + LATIN_TECHNICAL),
    presentation=tuple(fx.PRESENTATION_PATTERNS + LATIN_PRESENTATION),
    colours=tuple(fx.BARE_COLOURS + LATIN_COLOURS),
)


def _is_technical(key: str) -> str:
    return f"({key} IN {oi.quote_list(list(RULES.colours))} OR {oi.any_pattern(key, list(RULES.technical))})"


def _is_presentation(key: str) -> str:
    return oi.any_pattern(key, list(RULES.presentation))


def _fields(fields: dict[str, str]) -> str:
    rows = " UNION ALL ".join(f"SELECT video_id, scene_id, is_recurring, '{f}' AS field, {expr} AS v FROM vev" for f, expr in fields.items())
    return f"vf AS (SELECT video_id, scene_id, is_recurring, field, unnest(v) AS v FROM ({rows})), vk AS (SELECT *, {oi.squash('v')} AS m, {oi.label_key(oi.squash('v'))} AS k FROM vf)"


LEAK = {f: (f if f in vis.LIST_FIELDS else f"[{f}]") for f in vis.LEAKAGE_FIELDS}
VIS = oi.with_ctes(oi.VISUAL, _fields(LEAK), f"th AS (SELECT DISTINCT video_id, scene_id, field, m AS marker FROM vk WHERE k <> '' AND {_is_technical('k')})",
                   f"ph AS (SELECT DISTINCT video_id, scene_id, field, m AS marker FROM vk WHERE k <> '' AND {_is_presentation('k')})").rstrip() + " "


def marker_hits(spark, sf_dir):
    return vis.marker_kinds(inputs.visual_events(spark, sf_dir), KEYS, vis.LEAKAGE_FIELDS, ["technical", "presentation"], RULES)


MARKER_HITS = VIS + "SELECT *, 'technical' AS kind FROM th UNION ALL SELECT *, 'presentation' FROM ph"


def leakage_errors(spark, sf_dir):
    return vis.leakage_errors(inputs.visual_events(spark, sf_dir), KEYS, RULES).groupBy("video_id", "code", "field").agg(
        F.count("*").alias("errors"), F.sum(F.length("preview")).cast("long").alias("preview_chars")
    )


LEAKAGE_ERRORS = VIS + """SELECT video_id, 'technical_visual_label' AS code, field, count(*) AS errors,
  CAST(sum(CASE WHEN length(marker) <= 160 THEN length(marker) ELSE length(rtrim(substring(marker, 1, 157))) + 3 END) AS BIGINT) AS preview_chars FROM th GROUP BY 1, 2, 3"""


def leakage_metrics(spark, sf_dir):
    hits = vis.marker_hits(inputs.visual_events(spark, sf_dir), KEYS, vis.LEAKAGE_FIELDS, "technical", RULES)
    return vis.leakage_metrics(materialise(hits), KEYS, ["video_id"])


def _metrics_sql(source: str, fields: list[str], total: str = "count(DISTINCT scene_id || chr(1) || marker)") -> str:
    per_field = ", ".join(f"count(*) FILTER (field = '{f}') AS {f}_count" for f in fields)
    return (
        f"SELECT video_id, count(DISTINCT scene_id) AS scenes, {total} AS markers_total, count(*) AS structured_errors, "
        f"count(DISTINCT scene_id || chr(1) || field) AS fields_count, {per_field}, count(DISTINCT marker) AS unique_markers FROM {source} GROUP BY 1"
    )


LEAKAGE_METRICS = VIS + _metrics_sql("th", vis.LEAKAGE_FIELDS)


NOISE_FIELDS = [*vis.LEAKAGE_FIELDS, "scene_deltas"]


def presentation_noise_metrics(spark, sf_dir):
    hits = vis.marker_hits(inputs.visual_events(spark, sf_dir), KEYS, [*vis.LEAKAGE_FIELDS, "presenter_context.scene_deltas"], "presentation", RULES)
    return vis.leakage_metrics(materialise(hits), KEYS, ["video_id"], NOISE_FIELDS, markers="per field")


PRESENTATION_NOISE_METRICS = oi.with_ctes(
    oi.VISUAL, _fields(LEAK | {"scene_deltas": "scene_deltas"}), f"ns AS (SELECT DISTINCT video_id, scene_id, field, m AS marker FROM vk WHERE k <> '' AND {_is_presentation('k')})"
) + _metrics_sql("ns", NOISE_FIELDS, "count(*)")  # a marker counts in each field that holds it


CHUNK_NOISE = {
    "visual_text": "[array_to_string(lines, chr(10))]",
    "presenter_brief": "[narrative_brief]",
    "topics": "style_topics",
    "entities": "items",
    "combined_text": "[coalesce(visual_summary, '') || chr(10) || notes]",
}


def chunk_texts(spark, sf_dir):
    """The text fields of chunks, each chunk made of one visual event."""
    return inputs.visual_events(spark, sf_dir).select(
        *KEYS,
        F.array_join("observations", "\n").alias("visual_text"),
        F.col("presenter_context.narrative_brief").alias("presenter_brief"),
        F.col("style_topics").alias("topics"),
        F.col("items").alias("entities"),
        F.concat(F.coalesce("visual_summary", F.lit("")), F.lit("\n"), "notes").alias("combined_text"),
    )


def chunk_noise_metrics(spark, sf_dir):
    """Presentation wording left in the fields of chunks."""
    hits = vis.marker_hits(chunk_texts(spark, sf_dir), KEYS, list(CHUNK_NOISE), "presentation", RULES)
    return vis.leakage_metrics(materialise(hits), KEYS, ["video_id"], list(CHUNK_NOISE), markers="per field").withColumnRenamed("scenes", "chunks")


CHUNK_NOISE_METRICS = oi.with_ctes(
    oi.VISUAL, _fields(CHUNK_NOISE), f"cn AS (SELECT DISTINCT video_id, scene_id, field, m AS marker FROM vk WHERE k <> '' AND {_is_presentation('k')})"
) + _metrics_sql("cn", list(CHUNK_NOISE), "count(*)").replace("AS scenes", "AS chunks")


def _hits_sql(tag: str, fields: dict[str, str], test: str) -> str:
    """Fields, keys and hits under names of their own."""
    named = _fields(fields).replace("vf", f"vf{tag}").replace("vk", f"vk{tag}")
    return f"{named}, h{tag} AS (SELECT DISTINCT video_id, scene_id, field, m AS marker FROM vk{tag} WHERE k <> '' AND {test})"


ALL_HITS = oi.with_ctes(
    oi.VISUAL, _hits_sql("t", LEAK, _is_technical("k")), _hits_sql("p", LEAK | {"scene_deltas": "scene_deltas"}, _is_presentation("k")), _hits_sql("c", CHUNK_NOISE, _is_presentation("k"))
).rstrip()


def _profiles(spark, sf_dir):
    """A presenter profile per source, drawn from the first document of the source."""
    first = inputs.visual_events(spark, sf_dir).groupBy("video_id").agg(F.min_by(F.struct("items", "visual_summary"), "doc_id").alias("d"))
    return first.select(
        "video_id", F.lit(True).alias("has_primary_presenter"), F.lit("high").alias("confidence"),
        F.concat(F.slice("d.items", 1, 3), F.array(F.lit("образ"))).alias("recurring_visual_markers"), F.col("d.visual_summary").alias("baseline_summary"),
    )


def baseline_leakage(spark, sf_dir):
    markers = vis.baseline_markers(_profiles(spark, sf_dir))
    return vis.baseline_leakage(inputs.visual_events(spark, sf_dir), markers, KEYS)


BASELINE = oi.with_ctes(oi.VISUAL, f"""
fd AS (SELECT video_id, arg_min(items, doc_id) AS it, arg_min(visual_summary, doc_id) AS su FROM vev GROUP BY 1),
mk0 AS (SELECT video_id, i AS ord, {oi.squash('it[i]')} AS marker, false AS phrase FROM (SELECT *, unnest([1, 2, 3]) AS i FROM fd) WHERE it[i] IS NOT NULL
  UNION ALL SELECT video_id, 4, 'образ', false FROM fd
  UNION ALL SELECT video_id, 1000 + i, {oi.squash('parts[i]')}, true FROM (SELECT video_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT video_id, regexp_split_to_array(su, '[,;]') AS parts FROM fd))),
mk1 AS (SELECT *, {oi.label_key('marker')} AS k FROM mk0),
mk AS (SELECT video_id, k, arg_min(marker, ord) AS marker FROM mk1 WHERE k <> '' AND k NOT IN {oi.quote_list(fx.GENERIC_BASELINE_MARKERS)} AND NOT starts_with(k, 'общий вид ')
   AND (NOT phrase OR (length(k) >= 14 AND contains(k, ' '))) GROUP BY 1, 2),
ft AS ({' UNION ALL '.join(f"SELECT video_id, scene_id, '{f}' AS field, {oi.label_key(f if f in vis.TEXT_FIELDS else f'array_to_string({f}, chr(32))')} AS k FROM vev WHERE is_recurring" for f in vis.LEAKAGE_FIELDS)}),
bl AS (SELECT t.video_id, t.scene_id, t.field, m.marker FROM ft t JOIN mk m ON m.video_id = t.video_id AND contains(t.k, m.k))""").rstrip() + " "
BASELINE_LEAKAGE = BASELINE + "SELECT * FROM bl"


def baseline_metrics(spark, sf_dir):
    return vis.leakage_metrics(materialise(baseline_leakage(spark, sf_dir)), KEYS, ["video_id"])


BASELINE_METRICS = BASELINE + _metrics_sql("bl", vis.LEAKAGE_FIELDS)

OUT_LISTS = ["observations", "interpretations", "items", "style_topics"]


def label_quarantine(spark, sf_dir):
    clean = vis.quarantine(inputs.visual_events(spark, sf_dir), RULES)
    return clean.select(
        "scene_id", *[F.array_join(c, "|").alias(c) for c in [*OUT_LISTS, "presentation_context"]], "visual_summary", "notes",
        F.array_join("presenter_context.scene_deltas", "|").alias("scene_deltas"), F.col("presenter_context.narrative_brief").alias("narrative_brief"),
        "scrubbed_entries", "model_entries", "sinked",
    )


def _noise(x: str) -> str:
    key = oi.label_key(x)
    return f"({key} <> '' AND ({_is_technical(key)} OR {_is_presentation(key)}))"


def _ordered_unique(expr: str) -> str:
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


def _clean(field: str) -> str:
    return f"list_filter(list_transform({field}, lambda s: {oi.squash('s')}), lambda s: s <> '')"


_LISTS = [*OUT_LISTS, "scene_deltas"]
QUARANTINE = oi.with_ctes(oi.VISUAL, f"""
q1 AS (SELECT scene_id, video_id, {', '.join(f'{_clean(f)} AS {f}' for f in [*_LISTS, 'presentation_context'])}, {', '.join(f'{oi.squash(f)} AS {f}' for f in ['visual_summary', 'notes', 'narrative_brief'])} FROM vev),
q2 AS (SELECT scene_id, video_id, {', '.join(f'{_ordered_unique(f)} AS {f}' for f in _LISTS)}, presentation_context AS pc, visual_summary, notes, narrative_brief FROM q1),
q3 AS (SELECT *, {', '.join(f"list_filter({f}, lambda x: {_noise('x')}{(' OR ' + oi.label_key('x') + chr(61) + chr(39) * 2) if f in ('items', 'style_topics') else ''}) AS r_{f}" for f in _LISTS)},
   {', '.join(f"CASE WHEN {_noise(f)} THEN [{f}] ELSE CAST([] AS VARCHAR[]) END AS r_{f}" for f in ['visual_summary', 'notes', 'narrative_brief'])} FROM q2),
q4 AS (SELECT *, list_concat(list_concat(list_concat(list_concat(r_observations, r_interpretations), list_concat(r_items, r_style_topics)), list_concat(r_visual_summary, r_notes)), list_concat(r_scene_deltas, r_narrative_brief)) AS rem FROM q3),
q5 AS (SELECT *, list_concat(pc, rem) AS ctx FROM q4),
qq AS (SELECT scene_id, video_id, {', '.join(f'list_filter({f}, lambda x: NOT list_contains(r_{f}, x)) AS {f}' for f in _LISTS)}, {_ordered_unique('ctx')} AS presentation_context,
  CASE WHEN len(r_visual_summary) > 0 THEN '' ELSE visual_summary END AS visual_summary, CASE WHEN len(r_notes) > 0 THEN '' ELSE notes END AS notes,
  CASE WHEN len(r_narrative_brief) > 0 THEN '' ELSE narrative_brief END AS narrative_brief, CAST(len(rem) AS BIGINT) AS scrubbed_entries, CAST(len(pc) AS BIGINT) AS model_entries,
  len(list_filter(pc, lambda x: {_noise('x')})) > 0 AS sinked FROM q5)""").rstrip() + " "
LABEL_QUARANTINE = QUARANTINE + "SELECT scene_id, " + ", ".join(f"array_to_string({c}, '|') AS {c}" for c in [*_LISTS, "presentation_context"]) + ", visual_summary, notes, narrative_brief, scrubbed_entries, model_entries, sinked FROM qq"


def safety_metrics(spark, sf_dir):
    raw = inputs.visual_events(spark, sf_dir)
    clean = materialise(vis.quarantine(raw, RULES))
    return vis.safety_metrics(raw, clean, KEYS, ["video_id"], RULES)


SAFETY_METRICS = QUARANTINE.rstrip() + ", " + _fields(LEAK) + f""",
raw AS (SELECT DISTINCT scene_id FROM vk WHERE k <> '' AND {_is_technical('k')})
SELECT q.video_id, count(r.scene_id) AS raw_scenes, count(*) FILTER (q.sinked) AS sinked_scenes, count(*) FILTER (q.scrubbed_entries > 0) AS scrubbed_scenes, CAST(0 AS BIGINT) AS final_scenes,
  CAST(0 AS BIGINT) AS presentation_final_scenes, CAST(sum(len(q.presentation_context)) AS BIGINT) AS context_entries, CAST(sum(q.model_entries) AS BIGINT) AS context_model_entries, CAST(sum(q.scrubbed_entries) AS BIGINT) AS context_scrubbed_entries
FROM qq q LEFT JOIN raw r USING (scene_id) GROUP BY 1"""


def retention_audit(spark, sf_dir):
    raw = inputs.visual_events(spark, sf_dir)
    return vis.retention(raw, vis.quarantine(raw, RULES), KEYS)


RETENTION_AUDIT = QUARANTINE.rstrip() + ", rt AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS field, CAST(sum(len(list_filter(v.{f}, lambda x: trim(x) <> ''))) AS BIGINT) AS entries_before, CAST(sum(len(q.{f})) AS BIGINT) AS entries_after FROM vev v JOIN qq q USING (scene_id)" for f in OUT_LISTS
) + ") SELECT *, round_even(entries_after / entries_before, 4) AS kept_share FROM rt"


def relevance_counts(spark, sf_dir):
    return vis.relevance_counts(inputs.visual_events(spark, sf_dir), ["video_id"])


RELEVANCE_COUNTS = oi.with_ctes(oi.VISUAL) + (
    "SELECT video_id, count(*) FILTER (relevance = 'background') AS background_events, count(*) FILTER (relevance = 'brief') AS brief_events, "
    "count(*) FILTER (relevance = 'primary_example') AS primary_example_events FROM vev GROUP BY 1"
)


def visual_payloads(spark, sf_dir):
    """Events written as JSON payloads and built back from them, with fields missing here and there."""
    events = inputs.visual_events(spark, sf_dir)
    payload = F.to_json(
        F.struct(
            "items", "observations", F.concat("style_topics", "style_topics").alias("style_topics"),
            F.when(F.col("doc_id") % 4 != 0, F.col("notes")).alias("notes"), F.when(F.col("doc_id") % 5 == 0, "high").alias("confidence"), "presenter_context",
        )
    )
    built = vis.visual_events_from_payloads(events.select("scene_id", payload.alias("payload")))
    return built.select(
        "scene_id", F.array_join("items", "|").alias("items"), F.size("observations").cast("long").alias("observations"), F.array_join("style_topics", "|").alias("style_topics"),
        "notes", "confidence", F.col("presenter_context.relevance").alias("relevance"), F.size("on_screen_text").cast("long").alias("on_screen"),
    )


def _stripped(field: str) -> str:
    return f"list_filter(list_transform({field}, lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


VISUAL_PAYLOADS = oi.with_ctes(oi.VISUAL, f"""
v1 AS (SELECT scene_id, doc_id, {_stripped('items')} AS items, {_stripped('observations')} AS obs, {_stripped('style_topics')} AS st, notes, relevance FROM vev)""").rstrip() + f"""
SELECT scene_id, array_to_string({_ordered_unique('items')}, '|') AS items, CAST(len(list_distinct(obs)) AS BIGINT) AS observations, array_to_string({_ordered_unique('st')}, '|') AS style_topics,
  CASE WHEN doc_id % 4 <> 0 THEN notes ELSE '' END AS notes, CASE WHEN doc_id % 5 = 0 THEN 'high' ELSE 'medium' END AS confidence, relevance, CAST(0 AS BIGINT) AS on_screen FROM v1"""


QUERIES = {
    "marker_hits": (marker_hits, MARKER_HITS),
    "visual_leakage_errors": (leakage_errors, LEAKAGE_ERRORS),
    "leakage_metrics": (leakage_metrics, LEAKAGE_METRICS),
    "presentation_noise_metrics": (presentation_noise_metrics, PRESENTATION_NOISE_METRICS),
    "chunk_noise_metrics": (chunk_noise_metrics, CHUNK_NOISE_METRICS),
    "baseline_leakage": (baseline_leakage, BASELINE_LEAKAGE),
    "baseline_leakage_metrics": (baseline_metrics, BASELINE_METRICS),
    "label_quarantine": (label_quarantine, LABEL_QUARANTINE),
    "visual_safety_metrics": (safety_metrics, SAFETY_METRICS),
    "retention_audit": (retention_audit, RETENTION_AUDIT),
    "relevance_counts": (relevance_counts, RELEVANCE_COUNTS),
    "visual_payloads": (visual_payloads, VISUAL_PAYLOADS),
}
