"""Registered queries over whole fleets of jobs: quality reports, dashboards, audits, job state."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom import fixed_values as fx
from talkloom.operators import audit as au
from talkloom.operators import quality as qa
from talkloom.operators import visual as vis
from talkloom.plans import inputs
from talkloom.plans import oracle_inputs as oi
from talkloom.plans.scenes import SCENES, fallback_scenes
from talkloom.plans.visual import ALL_HITS, CHUNK_NOISE, KEYS, RULES, VIS, chunk_texts
from talkloom.session import materialise

KIND = {"signup": "run_started", "view": "stage_started", "click": "stage_completed", "error": "stage_failed", "purchase": "provider_request_failed"}


def log(spark, sf_dir):
    """The event table as a pipeline log: jobs are users, seventeen stages, status codes from the properties."""
    e = inputs.table(spark, sf_dir, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KIND.items() for x in kv]), F.col("event_type"))
    names = F.array(*[F.lit(n) for n in fx.STAGE_NAMES])
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("job_id"), kind.alias("event"),
        F.when(kind == "run_started", F.lit(None)).otherwise(F.element_at(names, (F.col("event_id") % 17 + 1).cast("int"))).alias("stage"),
        F.when(kind == "provider_request_failed", k).alias("status_code"),
        F.when(F.col("event_type").isin("error", "purchase") & (k % 4 != 0), F.concat(F.lit("code_"), k % 6)).alias("error_code"),
    )


NAMES = "[" + ", ".join(f"'{n}'" for n in fx.STAGE_NAMES) + "]"
LOG = f"""
log AS (SELECT event_id, event_id AS seq, ts, user_id AS job_id, CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in KIND.items())} END AS event, CASE WHEN event_type <> 'signup' THEN ({NAMES})[event_id % 17 + 1] END AS stage,
   CASE WHEN event_type = 'purchase' THEN k END AS status_code, CASE WHEN event_type IN ('error', 'purchase') AND k % 4 <> 0 THEN 'code_' || (k % 6) END AS error_code
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""
L = oi.with_ctes(LOG).rstrip() + " "
SHARE = "round_even(n / sum(n) OVER (PARTITION BY counter), 4) AS share"


def event_counters(spark, sf_dir):
    return au.event_counters(log(spark, sf_dir))


EVENT_COUNTERS = L + f""", m AS (SELECT * FROM log WHERE event IN ('stage_failed', 'provider_request_failed')),
c AS (SELECT 'event' AS counter, event AS value, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'stage', coalesce(stage, '-'), count(*) FROM m GROUP BY 2 UNION ALL SELECT 'job_id', CAST(job_id AS VARCHAR), count(*) FROM m GROUP BY 2
  UNION ALL SELECT 'error_code', error_code, count(*) FROM m WHERE error_code IS NOT NULL GROUP BY 2)
SELECT counter, value, n, {SHARE} FROM c"""


def provider_failures(spark, sf_dir):
    return au.failures_by_status(au.provider_failures(log(spark, sf_dir)))


PROVIDER_FAILURES = L + f", c AS (SELECT 'status_code' AS counter, CAST(status_code AS VARCHAR) AS value, count(*) AS n FROM log WHERE event = 'provider_request_failed' GROUP BY 2) SELECT counter, value, n, {SHARE} FROM c"


def success_with_error(spark, sf_dir):
    """Completed subprocesses: clicks count as such, every value above 20 with a leaked error code."""
    e = inputs.table(spark, sf_dir, "events").where("event_type IN ('click', 'view')")
    rows = e.select("event_id", F.col("user_id").alias("job_id"), F.lit("02_download_audio").alias("stage"), F.lit("subprocess_completed").alias("event"), F.when(F.col("event_type") == "click", 0).otherwise(1).alias("return_code"), F.when(F.col("value") > 20, "leak").alias("error_code"))
    return au.success_with_error(rows)


SUCCESS_WITH_ERROR = "SELECT event_id, user_id AS job_id, '02_download_audio' AS stage, 'leak' AS error_code FROM events WHERE event_type = 'click' AND value > 20"


def status_counters(spark, sf_dir):
    jobs = inputs.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"))
    stages = inputs.table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("status"))
    return au.status_counters(jobs, stages)


STATUS_COUNTERS = f"WITH c AS (SELECT 'job_status' AS counter, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'stage_status', l_linestatus, count(*) FROM lineitem GROUP BY 2) SELECT counter, value, n, {SHARE} FROM c"


def _facts(spark, sf_dir):
    """One wide row of facts per source, from documents, their visual markers and their labels."""
    docs = inputs.table(spark, sf_dir, "documents").withColumnRenamed("source", "job_id")
    events = inputs.visual_events(spark, sf_dir).withColumnRenamed("video_id", "job_id")
    base = docs.groupBy("job_id").agg(F.count("*").alias("events"), F.max("doc_id").alias("m"), F.sum("n_chars").alias("chars"))
    hits = vis.marker_kinds(events, ["job_id", "scene_id"], vis.LEAKAGE_FIELDS, ["technical", "presentation"], RULES).select("job_id", "scene_id", "kind").distinct()
    marked = hits.groupBy("job_id").agg(F.count_if(F.col("kind") == "technical").alias("technical_scenes"), F.count_if(F.col("kind") == "presentation").alias("noise_scenes"))
    out = base.join(marked, "job_id", "left").join(qa.presenter_facts(events), "job_id", "left")
    zero = [c for c in out.columns if c.endswith("_scenes") or c in ("recurring", "baselines")]
    m = F.col("m")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in zero}).withColumns(
        {"duration_gap": (m % 4) / 2, "scenes": m % 3, "detected_speakers": m % 5, "chunk_coverage": (m % 6) / 2, "chunks": F.col("events"), "claims": m % 2 * 10, "unclaimed": F.when(m % 7 > 3, F.col("events")).otherwise(0),
         "profile_confidence": F.when(m % 2 == 0, "high").otherwise("low"), "has_presenter": m % 3 != 1, "leakage_scenes": m % 4, "noisy_chunks": m % 2, "briefs": m % 3}
    )


def quality_warnings(spark, sf_dir):
    return qa.report_warnings(_facts(spark, sf_dir)).withColumn("ordinal", F.col("ordinal").cast("long"))


def _warning_sql() -> str:
    rules = [
        ("(m % 4) / 2 > 1.0", "'metadata duration differs from proxy video duration by more than 1.0s'"),
        ("m % 3 = 1", "'scene detection produced a single scene'"),
        ("m % 5 = 0", "'speaker diarization is enabled but no speaker labels were detected'"),
        ("(m % 6) / 2 > 2.0", "'chunks cover the video more than 2x; overlap or duplicated content may be too high'"),
        ("m % 2 = 0", "'style claims are empty despite non-empty chunks'"),
        ("m % 7 > 3", "'more than half of chunks have no extracted style claims'"),
        ("m % 3 <> 1 AND m % 2 = 0 AND rec = 0", "'presenter profile detected a recurring presenter, but no visual events are marked recurring'"),
        ("m % 3 <> 1 AND bas > 3", "'presenter baseline drifts across visual events; recurring presenter context may be unstable'"),
        ("m % 3 <> 1 AND m % 4 > 0", "'presenter baseline appears in scene-specific visual fields in ' || (m % 4) || '/' || n || ' visual events'"),
        ("m % 3 <> 1 AND m % 2 = 0 AND m % 3 = 0", "'presenter_brief is empty for all chunks despite high-confidence recurring presenter'"),
        ("ts > 0", "'technical presentation labels remain in scene-specific visual fields in ' || ts || '/' || n || ' visual events'"),
        ("ns > 0", "'presentation-style visual wording remains in scene-specific visual fields in ' || ns || '/' || n || ' visual events'"),
        ("m % 2 > 0", "'presentation-style visual wording reached KB chunk fields in ' || (m % 2) || '/' || n || ' chunks'"),
    ]
    return " UNION ALL ".join(f"SELECT job_id, {i} AS o, {text} AS warning FROM fc WHERE {cond}" for i, (cond, text) in enumerate(rules))


WARN = VIS.rstrip() + f""",
fc AS (SELECT d.source AS job_id, count(*) AS n, max(d.doc_id) AS m, (SELECT count(DISTINCT scene_id) FROM th WHERE th.video_id = d.source) AS ts, (SELECT count(DISTINCT scene_id) FROM ph WHERE ph.video_id = d.source) AS ns,
   count(*) FILTER (d.doc_id % 3 = 0) AS rec, count(DISTINCT d.doc_id % 5) FILTER (d.doc_id % 3 = 0) AS bas FROM documents d GROUP BY 1),
w0 AS ({_warning_sql()}), wn AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY o) - 1 AS ordinal, warning FROM w0)
"""
QUALITY_WARNINGS = WARN + "SELECT job_id, ordinal, warning FROM wn"


def warning_ratios(spark, sf_dir):
    return au.warning_ratios(qa.report_warnings(_facts(spark, sf_dir)))


WARNING_RATIOS = WARN.rstrip() + r""", wr AS (SELECT regexp_replace(warning, '\b\d+/\d+\b', '{affected}/{total}', 'g') AS template, round_even(CAST(nullif(regexp_extract(warning, '\b(\d+)/(\d+)\b', 1), '') AS DOUBLE) / CAST(nullif(regexp_extract(warning, '\b(\d+)/(\d+)\b', 2), '') AS DOUBLE), 4) AS r FROM wn)
SELECT template, count(*) AS warnings, count(r) AS with_ratio, max(r) AS max_ratio, round_even(avg(r), 4) AS avg_ratio FROM wr GROUP BY 1"""


def quality_report(spark, sf_dir):
    """Counts, ends, coverage and mismatches per conversation, in long form."""
    toks = materialise(inputs.tokens(spark, sf_dir))
    job = lambda df: df.withColumnRenamed("video_id", "job_id")
    segs, scenes = inputs.turn_segments(spark, sf_dir), fallback_scenes(spark, sf_dir)
    speakers = toks.select("video_id", "speaker").distinct()
    counts = qa.stage_counts({"speech_tokens": job(toks), "speech_segments": job(segs), "scenes": job(scenes), "speakers": job(speakers)})
    ends = job(toks.groupBy("video_id").agg(F.max("end_ms").alias("video_ms"))).withColumns(
        {"audio_ms": F.col("video_ms") + 40 * (F.col("job_id") % 7), "metadata_ms": F.col("video_ms") - 55 * (F.col("job_id") % 3), "transcript_ms": F.col("video_ms") - 7}
    )
    seg_cov = qa.coverage(job(segs).withColumn("pos", F.col("seg")), ends, "segments")
    scene_cov = qa.coverage(job(scenes).withColumn("pos", F.col("scene_index")), ends, "timeline")
    wide = seg_cov.join(scene_cov, "job_id").join(qa.mismatches(ends), "job_id")
    names = [c for c in wide.columns if c != "job_id"]
    long = wide.select("job_id", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("e")).select("job_id", "e.metric", "e.value")
    return long.unionByName(counts.withColumn("value", F.col("value").cast("double")))


QUALITY_REPORT = oi.with_ctes(oi.TOKENS, oi.SPEAKERS, oi.SEGMENTS, SCENES).rstrip() + """,
sc AS (SELECT video_id, sum(end_ms - start_ms) AS c, arg_max(end_ms, seg) AS e FROM seg GROUP BY 1), tc AS (SELECT video_id, sum(end_ms - start_ms) AS c, max(end_ms) AS e FROM scn GROUP BY 1),
al AS (SELECT v.video_id AS job_id, duration_ms AS d, sc.c AS sc, sc.e AS se, tc.c AS tc, tc.e AS te FROM vid v JOIN sc USING (video_id) JOIN tc USING (video_id))
SELECT job_id, 'segments_end_ms' AS metric, CAST(se AS DOUBLE) AS value FROM al UNION ALL SELECT job_id, 'segments_vs_video', round_even(sc / greatest(d, 1000), 4) FROM al
UNION ALL SELECT job_id, 'timeline_end_ms', te FROM al UNION ALL SELECT job_id, 'timeline_vs_video', round_even(tc / greatest(d, 1000), 4) FROM al
UNION ALL SELECT job_id, 'audio_vs_video', round_even(40 * (job_id % 7) / 1000, 4) FROM al UNION ALL SELECT job_id, 'metadata_vs_video', round_even(55 * (job_id % 3) / 1000, 4) FROM al UNION ALL SELECT job_id, 'transcript_vs_video', 0.007 FROM al
UNION ALL SELECT video_id, 'speech_tokens', count(*) FROM tok GROUP BY 1 UNION ALL SELECT video_id, 'speech_segments', count(*) FROM seg GROUP BY 1 UNION ALL SELECT video_id, 'scenes', count(*) FROM scn GROUP BY 1 UNION ALL SELECT video_id, 'speakers', count(DISTINCT speaker) FROM tok GROUP BY 1"""


def report_identity(spark, sf_dir):
    """Stored counts against recounted ones, and reports stored under a foreign video."""
    counted = qa.stage_counts({"documents": inputs.table(spark, sf_dir, "documents").withColumnRenamed("source", "job_id")})
    stored = counted.withColumn("value", F.col("value") + (F.col("value") % 3 == 0).cast("long"))
    wrong = qa.count_mismatches(stored, counted).select("job_id", "metric", "stored", "counted")
    jobs = counted.select("job_id", F.col("job_id").alias("video_id"))
    reports = counted.select("job_id", F.when(F.col("value") % 2 == 0, F.lit("src0")).otherwise(F.col("job_id")).alias("video_id"))
    foreign = qa.report_problems(reports, jobs).select("job_id", F.lit("video_id").alias("metric"), F.lit(0).cast("long").alias("stored"), F.lit(0).cast("long").alias("counted"))
    return wrong.unionByName(foreign)


REPORT_IDENTITY = """
WITH c AS (SELECT source AS job_id, count(*) AS n FROM documents GROUP BY 1)
SELECT job_id, 'documents' AS metric, n + 1 AS stored, n AS counted FROM c WHERE n % 3 = 0 UNION ALL SELECT job_id, 'video_id', 0, 0 FROM c WHERE n % 2 = 0 AND job_id <> 'src0'"""


def report_stage_metrics(spark, sf_dir):
    warnings = qa.report_warnings(_facts(spark, sf_dir))
    metrics = inputs.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("job_id"), F.concat(F.lit("lang_"), "lang").alias("metric")).agg(F.count("*").alias("value"))
    merged = qa.stage_metrics(warnings, metrics)
    return merged.select("job_id", F.explode("metrics").alias("metric", "value"))


REPORT_STAGE_METRICS = WARN + """SELECT source AS job_id, 'lang_' || lang AS metric, count(*) AS value FROM documents GROUP BY 1, 2 UNION ALL SELECT d.job_id, 'warnings_count', (SELECT count(*) FROM wn WHERE wn.job_id = d.job_id) FROM (SELECT DISTINCT source AS job_id FROM documents) d"""


def unclaimed_chunks(spark, sf_dir):
    chunks = inputs.claims(spark, sf_dir).select(F.col("video_id").alias("job_id"), "chunk_id").distinct()
    claims = inputs.claims(spark, sf_dir).where("claim_pos % 10 > 6").select(F.col("video_id").alias("job_id"), "chunk_id")
    return qa.unclaimed_chunks(chunks, claims)


UNCLAIMED_CHUNKS = oi.with_ctes(oi.CLAIMS) + "SELECT DISTINCT video_id AS job_id, chunk_id FROM claims WHERE chunk_id NOT IN (SELECT chunk_id FROM claims WHERE claim_pos % 10 > 6)"


def top_topics(spark, sf_dir):
    """The thirty most frequent topics over four tables."""
    claims = inputs.claims(spark, sf_dir).select(F.explode("topics").alias("topic"))
    visual = inputs.visual_events(spark, sf_dir).select(F.explode("style_topics").alias("topic"))
    items = inputs.visual_events(spark, sf_dir).select(F.explode("items").alias("topic"))
    kinds = inputs.table(spark, sf_dir, "events").select(F.col("event_type").alias("topic"))
    return qa.top_counts(claims.unionByName(visual).unionByName(items).unionByName(kinds), "topic", 30)


TOP_TOPICS = oi.with_ctes(oi.VISUAL) + """SELECT topic, count(*) AS count FROM (SELECT unnest([lang, source]) AS topic FROM documents UNION ALL SELECT unnest(style_topics) FROM vev UNION ALL SELECT unnest(items) FROM vev UNION ALL SELECT event_type FROM events) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30"""


def dashboard_histograms(spark, sf_dir):
    claims = inputs.claims(spark, sf_dir)
    return (
        qa.histogram(claims, "claim_type", F.col("claim_type")).unionByName(qa.histogram(claims, "confidence", F.col("confidence")))
        .unionByName(qa.histogram(inputs.table(spark, sf_dir, "lineitem"), "stage_status", F.when(F.col("l_linestatus") == "O", "").otherwise(F.col("l_linestatus"))))
        .unionByName(qa.histogram(log(spark, sf_dir), "event", F.col("event")))
    )


DASHBOARD_HISTOGRAMS = oi.with_ctes(oi.CLAIMS, LOG) + """SELECT 'claim_type' AS section, claim_type AS value, count(*) AS count FROM claims GROUP BY 2 UNION ALL SELECT 'confidence', confidence, count(*) FROM claims GROUP BY 2
UNION ALL SELECT 'stage_status', CASE WHEN l_linestatus = 'O' THEN 'unknown' ELSE l_linestatus END, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'event', event, count(*) FROM log GROUP BY 2"""


def job_listing(spark, sf_dir):
    """Orders are known jobs; line items of unknown orders are what a lost directory would show."""
    o = inputs.table(spark, sf_dir, "orders").where("o_orderkey % 9 <> 0")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").cast("string").alias("created_at"))
    li = inputs.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.max("l_shipdate").cast("string").alias("mtime"), F.count("*").alias("n"))
    found = li.select("job_id", "mtime", F.when(F.col("n") > 5, "failed").alias("failure_status"), (F.col("n") > 2).alias("has_report"))
    reports = li.where("n > 2").select("job_id", F.col("n").alias("warnings_count"))
    return qa.job_listing(jobs, found, reports)


JOB_LISTING = """
WITH li AS (SELECT l_orderkey AS job_id, max(l_shipdate) AS m, count(*) AS n FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, CAST(o_orderdate AS VARCHAR) AS created_at, false AS synthesised FROM orders WHERE o_orderkey % 9 <> 0
  UNION ALL SELECT job_id, CASE WHEN n > 5 THEN 'failed' WHEN n > 2 THEN 'completed' ELSE 'unknown' END, CAST(m AS VARCHAR), true FROM li WHERE job_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 0))
SELECT j.*, coalesce(CASE WHEN n > 2 THEN n END, 0) AS warnings_count FROM j LEFT JOIN li USING (job_id)"""


def stage_rows(spark, sf_dir):
    li = inputs.table(spark, sf_dir, "lineitem")
    rows = li.select(
        F.col("l_orderkey").alias("job_id"), F.concat(F.lit("stage_"), "l_linenumber").alias("stage_name"), F.col("l_linenumber").alias("ordinal"), F.col("l_linestatus").alias("status"),
        F.format_string('{"quantity": "%d"}', F.col("l_quantity").cast("int")).alias("metrics"), F.format_string('["a%d", "b"]', "l_linenumber").alias("output_files"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started_at"), F.date_format(F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("l_quantity") - 10), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("finished_at"),
    )
    return qa.stage_rows(rows).groupBy("stage_name", "status").agg(F.count("*").alias("rows"), F.sum(F.col("metrics")["quantity"].cast("long")).alias("quantity"), F.sum(F.size("output_files")).cast("long").alias("files"), F.sum(F.col("duration_seconds")).cast("long").alias("seconds"))


STAGE_ROWS = "SELECT 'stage_' || l_linenumber AS stage_name, l_linestatus AS status, count(*) AS rows, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS quantity, 2 * count(*) AS files, CAST(sum(greatest(0, CAST(l_quantity AS INT) - 10)) AS BIGINT) AS seconds FROM lineitem GROUP BY 1, 2"


def _artifacts(spark, sf_dir):
    keys = F.array(*[F.lit(k) for k in fx.ARTIFACT_KEYS])
    li = inputs.table(spark, sf_dir, "lineitem")
    key = F.element_at(keys, ((F.col("l_partkey") + F.col("l_linenumber")) % len(fx.ARTIFACT_KEYS) + 1).cast("int"))
    return li.groupBy(F.col("l_orderkey").alias("job_id"), key.alias("key")).agg(F.sum(F.col("l_quantity")).cast("long").alias("size_bytes"), F.max("l_shipdate").cast("timestamp").alias("mtime"))


ART = "WITH art AS (SELECT l_orderkey AS job_id, ([" + ", ".join(f"'{k}'" for k in fx.ARTIFACT_KEYS) + f"])[(l_partkey + l_linenumber) % {len(fx.ARTIFACT_KEYS)} + 1] AS key, CAST(sum(l_quantity) AS BIGINT) AS size_bytes, max(l_shipdate) AS mtime FROM lineitem GROUP BY 1, 2)"


def artifact_statuses(spark, sf_dir):
    jobs = inputs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"))
    return qa.artifact_status(jobs, _artifacts(spark, sf_dir)).groupBy("key").agg(F.count("*").alias("jobs"), F.count_if("exists").alias("present"), F.sum("size_bytes").alias("size_bytes"))


ARTIFACT_STATUSES = ART + ", k AS (SELECT unnest([" + ", ".join(f"'{k}'" for k in fx.ARTIFACT_KEYS) + "]) AS key) SELECT k.key, (SELECT count(*) FROM orders) AS jobs, count(art.job_id) AS present, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM k LEFT JOIN art ON art.key = k.key AND art.job_id IN (SELECT o_orderkey FROM orders) GROUP BY 1"


def job_documents(spark, sf_dir):
    """Orders with their stage list as one document each."""
    jobs = inputs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"))
    stages = inputs.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_returnflag").alias("flag"))
    docs = qa.job_documents(jobs, {"stages": stages})
    return docs.select("job_id", "status", F.array_join(F.transform("stages", lambda s: F.concat(s["ordinal"].cast("string"), s["flag"])), ",").alias("stages"))


JOB_DOCUMENTS = "SELECT o_orderkey AS job_id, o_orderstatus AS status, string_agg(l_linenumber || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS stages FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"


def issue_locations(spark, sf_dir):
    events = inputs.visual_events(spark, sf_dir).withColumnRenamed("video_id", "job_id").withColumns({"start_ms": F.col("doc_id") * 1000, "end_ms": F.col("doc_id") * 1000 + 90_000})
    found = qa.marker_locations(events, "visual_event", "scene_id", vis.LEAKAGE_FIELDS, "technical_visual_label", RULES)
    noise = qa.marker_locations(events, "visual_event", "scene_id", vis.LEAKAGE_FIELDS, "visual_presentation_noise", RULES)
    return found.unionByName(noise)


LOC = VIS.rstrip() + """,
lc AS (SELECT video_id AS job_id, 'visual_event' AS kind, scene_id AS object_id, field, marker, i || ':' || scene_id || ':' || field || ':' || left(sha1(marker), 10) AS location_id, i AS issue, CAST(split_part(scene_id, '_scene_', 2) AS BIGINT) AS d
  FROM (SELECT *, 'technical_visual_label' AS i FROM th UNION ALL SELECT *, 'visual_presentation_noise' FROM ph))
"""
ISSUE_LOCATIONS = LOC + "SELECT job_id, kind, object_id, field, marker, location_id, printf('%d:%02d-%d:%02d', d // 60, d % 60, (d + 90) // 60, (d + 90) % 60) AS range FROM lc"


def issue_summaries(spark, sf_dir):
    located = issue_locations(spark, sf_dir).withColumn("issue", F.split_part("location_id", F.lit(":"), F.lit(1)))
    sources = inputs.table(spark, sf_dir, "documents").select(F.col("source").alias("job_id")).distinct()
    issues = F.array(*[F.lit(i) for i in ("technical_visual_label", "visual_presentation_noise", "chunk_presentation_noise")])
    return qa.issue_summaries(sources.select("job_id", F.explode(issues).alias("issue")), located)


ISSUE_SUMMARIES = LOC.rstrip() + """,
pf AS (SELECT job_id, issue, field, count(*) AS n FROM lc GROUP BY 1, 2, 3), rf AS (SELECT *, row_number() OVER (PARTITION BY job_id, issue ORDER BY n DESC, field) AS r FROM pf),
sm AS (SELECT job_id, issue, CAST(sum(n) AS BIGINT) AS locations, sum(n) || ' locations; ' || string_agg(field || ': ' || n, ', ' ORDER BY r) FILTER (r <= 4) AS summary FROM rf GROUP BY 1, 2)
SELECT s.job_id, i.issue, coalesce(locations, 0) AS locations, coalesce(summary, 'No concrete locations found in current artifacts') AS summary FROM (SELECT DISTINCT source AS job_id FROM documents) s
CROSS JOIN (SELECT unnest(['technical_visual_label', 'visual_presentation_noise', 'chunk_presentation_noise']) AS issue) i LEFT JOIN sm ON sm.job_id = s.job_id AND sm.issue = i.issue"""


def partial_report(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("artifact"), (F.col("value") < 95).alias("readable"), (F.col("event_id") * 10).alias("start_ms"), (F.col("event_id") * 10 + 7).alias("end_ms"))
    return qa.partial_reports(rows, ["view", "click", "error", "captions"])


PARTIAL_REPORT = """
WITH r AS (SELECT user_id AS job_id, event_type AS artifact, count(*) AS n, bool_and(value < 95) AS p, max(event_id) * 10 + 7 - min(event_id) * 10 AS s FROM events GROUP BY 1, 2)
SELECT j.job_id, a.artifact, n IS NOT NULL AS available, coalesce(p, false) AS parseable, coalesce(n, 0) AS rows, s AS span_ms FROM (SELECT DISTINCT user_id AS job_id FROM events) j CROSS JOIN (SELECT unnest(['view', 'click', 'error', 'captions']) AS artifact) a LEFT JOIN r ON r.job_id = j.job_id AND r.artifact = a.artifact"""


def derived_stale(spark, sf_dir):
    claims = inputs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 60 DAYS")).alias("claims_mtime"))
    return qa.stale_artifacts(_artifacts(spark, sf_dir), claims).select("job_id", "key")


DERIVED_STALE = ART + " SELECT job_id, key FROM art JOIN orders ON o_orderkey = job_id WHERE mtime < o_orderdate + INTERVAL 60 DAYS"


def failure_status(spark, sf_dir):
    events = log(spark, sf_dir)
    status = qa.failure_status(events.where("event = 'stage_failed'"), events.where("event = 'stage_completed'"))
    advice = spark.createDataFrame([(f"code_{i}", [f"retry STAGE of JOB_ID, hint {i}"]) for i in range(4)], "error_code string, actions array<string>")
    return qa.with_advice(status, advice).select("job_id", "stage", "seq", "status", "resolved_by", F.get("actions", 0).alias("action"))


FAILURE_STATUS = L + """, s AS (SELECT job_id, stage, max(seq) AS m FROM log WHERE event = 'stage_completed' GROUP BY 1, 2)
SELECT f.job_id, f.stage, f.seq, CASE WHEN m > f.seq THEN 'resolved' ELSE 'failed' END AS status, CASE WHEN m > f.seq THEN m END AS resolved_by,
  CASE WHEN error_code IN ('code_0', 'code_1', 'code_2', 'code_3') THEN 'retry ' || f.stage || ' of ' || f.job_id || ', hint ' || right(error_code, 1) END AS action FROM log f LEFT JOIN s USING (job_id, stage) WHERE event = 'stage_failed'"""


def drift_union(spark, sf_dir):
    """Report, export and failure drift of all orders in one table."""
    o = inputs.table(spark, sf_dir, "orders")
    k = F.col("job_id")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), F.concat(F.lit("v"), "o_orderkey").alias("video_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"))
    li = inputs.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last"), F.min("l_shipdate").alias("first"))
    reports = li.select(
        "job_id", (k + (k % 40 == 0).cast("long")).alias("report_job_id"), F.concat(F.lit("v"), k).alias("report_video_id"), F.when(k % 30 == 0, "failed").alias("report_status"),
        F.lit(1).alias("warnings_count"), (F.col("n") + (k % 7 == 0).cast("long")).alias("claims_count"), F.col("last").alias("report_mtime"),
    )
    stages = li.select("job_id", F.when(k % 3 == 0, F.col("first")).otherwise(F.col("last")).alias("stage_finished_at"), (k % 2).alias("stage_warnings"))
    claims = li.select("job_id", F.col("n").alias("effective_claims"), F.when(k % 11 == 0, F.col("last") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("first")).alias("claims_mtime"))
    exports = li.select("job_id", F.col("last").alias("claims_mtime"), F.when(k % 5 == 0, F.col("first")).otherwise(F.col("last")).alias("export_mtime"), F.when(k % 6 == 0, "refresh").otherwise("current").alias("surface"), F.col("n").alias("effective_rows"), (F.col("n") - 1).alias("exported_rows"))
    return au.report_drift(reports, jobs, stages, claims).unionByName(au.export_drift(exports)).select("job_id", "kind")


DRIFT = """
WITH l AS (SELECT l_orderkey AS k, count(*) AS n, max(l_shipdate) AS la, min(l_shipdate) AS fi FROM lineitem GROUP BY 1), j AS (SELECT l.*, o_orderstatus = 'F' AS done FROM l JOIN orders ON o_orderkey = k),
dr AS (SELECT k AS job_id, 'quality_report_newer_than_db_stage' AS kind FROM j WHERE k % 3 = 0 AND la > fi UNION ALL SELECT k, 'quality_warning_count_mismatch' FROM j WHERE k % 2 <> 1 UNION ALL SELECT k, 'quality_report_job_id_mismatch' FROM j WHERE k % 40 = 0
 UNION ALL SELECT k, 'quality_report_video_id_mismatch' FROM j WHERE false UNION ALL SELECT k, 'quality_style_claims_count_mismatch' FROM j WHERE k % 7 = 0 UNION ALL SELECT k, 'quality_report_older_than_effective_claims' FROM j WHERE k % 11 = 0
 UNION ALL SELECT k, 'quality_report_status_mismatch' FROM j WHERE k % 30 = 0 UNION ALL SELECT k, 'claims_newer_than_export' FROM l WHERE k % 5 = 0 AND la > fi UNION ALL SELECT k, 'export_differs_from_effective_claims' FROM l WHERE k % 6 = 0)
"""
DRIFT_UNION = DRIFT + "SELECT * FROM dr"


def audit_summary(spark, sf_dir):
    return au.audit_summary(drift_union(spark, sf_dir))


AUDIT_SUMMARY = DRIFT.rstrip() + """, p AS (SELECT kind, job_id, count(*) AS n FROM dr GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY job_id) AS r, sum(n) OVER (PARTITION BY kind) AS f FROM p)
SELECT kind, CAST(f AS BIGINT) AS findings, job_id, n FROM r WHERE r <= 10"""


def notes_missing_extra(spark, sf_dir):
    li = inputs.table(spark, sf_dir, "lineitem")
    cid = F.format_string("%d_c_%06d_%06d", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_linenumber") + 1)
    chunks = li.where("l_linenumber <= 5").select(F.col("l_orderkey").alias("job_id"), cid.alias("chunk_id"))
    notes = li.where("l_partkey % 10 <> 0").select(F.col("l_orderkey").alias("job_id"), F.when(F.col("l_linenumber") == 7, F.concat(F.lit("own_"), cid, F.lit(".md"))).otherwise(F.concat(cid, F.lit(".md"))).alias("note"))
    drift = au.note_drift(chunks, notes)
    stale = au.stale_notes(chunks, notes).withColumn("kind", F.lit("stale_owned"))
    return drift.unionByName(stale.select("job_id", "note", "kind"))


NOTES_MISSING_EXTRA = """
WITH b AS (SELECT l_orderkey AS job_id, l_linenumber AS n, l_partkey AS p, printf('%d_c_%06d_%06d', l_orderkey, l_linenumber, l_linenumber + 1) AS c FROM lineitem), w AS (SELECT job_id, c || '.md' AS note FROM b WHERE n <= 5), t AS (SELECT job_id, CASE WHEN n = 7 THEN 'own_' || c || '.md' ELSE c || '.md' END AS note, n FROM b WHERE p % 10 <> 0),
m AS (SELECT w.*, 'missing' AS kind FROM w ANTI JOIN t ON t.job_id = w.job_id AND t.note = w.note), e AS (SELECT t.job_id, t.note, 'extra' AS kind, n FROM t ANTI JOIN w ON t.job_id = w.job_id AND t.note = w.note)
SELECT * FROM m UNION ALL SELECT job_id, note, kind FROM e UNION ALL SELECT job_id, note, 'stale_owned' FROM e WHERE n <> 7"""


def notes_drift(spark, sf_dir):
    """Notes of jobs against their claims: some jobs have no claims, some video notes are older, some chunk notes differ."""
    li = inputs.table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    cid = F.format_string("%d_c_%06d_%06d", k, F.col("l_linenumber"), F.col("l_linenumber") + 1)
    chunks = li.where("l_linenumber <= 5").select(k.alias("job_id"), cid.alias("chunk_id"))
    notes = li.where("l_partkey % 10 <> 0").select(k.alias("job_id"), F.concat(cid, F.lit(".md")).alias("note"))
    at = F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    jobs = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderkey") % 7 != 0, at).alias("claims_mtime"),
        F.when(F.col("o_orderkey") % 5 != 0, F.when(F.col("o_orderkey") % 3 == 0, at - F.expr("INTERVAL 1 SECOND")).otherwise(at)).alias("video_note_mtime"),
    )
    return au.notes_drift(jobs, chunks, notes)


NOTES_DRIFT = """
WITH b AS (SELECT l_orderkey AS job_id, l_linenumber AS n, l_partkey % 10 <> 0 AS note FROM lineitem),
t AS (SELECT *, bool_or(note) OVER (PARTITION BY job_id, n) AS there FROM b),
d AS (SELECT job_id, count(*) FILTER (n <= 5 AND NOT there) AS missing, count(*) FILTER (n > 5 AND note) AS extra FROM t GROUP BY 1)
SELECT o_orderkey AS job_id, 'obsidian_video_note_older_than_effective_claims' AS kind, CAST(NULL AS BIGINT) AS missing, CAST(NULL AS BIGINT) AS extra FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0
UNION ALL SELECT job_id, 'obsidian_chunk_note_set_mismatch', missing, extra FROM d JOIN orders ON o_orderkey = job_id WHERE o_orderkey % 7 <> 0 AND (missing > 0 OR extra > 0)"""


def failure_reports(spark, sf_dir):
    jobs = inputs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"))
    failures = inputs.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.when(F.col("l_partkey") % 2 == 0, "resolved").when(F.col("l_partkey") % 3 == 0, "failed").alias("report_status"))
    return au.failure_reports(failures, jobs).groupBy("class", "job_status").agg(F.count("*").alias("reports"))


FAILURE_REPORTS = """SELECT CASE WHEN o_orderstatus = 'F' AND l_partkey % 2 <> 0 THEN 'stale' ELSE 'history' END AS class, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'failed' END AS job_status, count(*) AS reports
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2"""


def _files(spark, sf_dir):
    li = inputs.table(spark, sf_dir, "lineitem")
    names = F.array(*[F.lit(n) for n in fx.STAGE_NAMES])
    return li.select(
        F.col("l_orderkey").alias("job_id"), F.element_at(names, (F.col("l_suppkey") % 17 + 1).cast("int")).alias("stage"), F.when(F.col("l_linenumber") % 2 == 0, "output").otherwise("input").alias("kind"),
        F.concat(F.lit("f"), "l_linenumber").alias("path"), (F.col("l_quantity") > 5).alias("exists"), F.col("l_shipdate").alias("mtime"),
    )


FILES = f"""WITH f AS (SELECT l_orderkey AS job_id, ({NAMES})[l_suppkey % 17 + 1] AS stage, CASE WHEN l_linenumber % 2 = 0 THEN 'output' ELSE 'input' END AS kind, 'f' || l_linenumber AS path, l_quantity > 5 AS ex, l_shipdate AS m FROM lineitem),
g AS (SELECT job_id, stage, max(m) FILTER (kind = 'input' AND ex) AS ni, min(m) FILTER (kind = 'output' AND ex) AS oo, count(*) FILTER (kind = 'output' AND NOT ex) AS mo, count(*) FILTER (kind = 'input' AND NOT ex) AS mi FROM f GROUP BY 1, 2),
h AS (SELECT *, coalesce(oo IS NOT NULL AND (ni IS NULL OR oo >= ni), false) AS cur FROM g) """


def stage_freshness(spark, sf_dir):
    files = _files(spark, sf_dir)
    fresh = au.stage_freshness(files)
    stale = au.stale_outputs(files, fresh).groupBy("job_id", "stage").agg(F.count("*").alias("stale_outputs"))
    return fresh.join(stale, ["job_id", "stage"], "left").select("job_id", "stage", "missing_outputs", "missing_inputs", "outputs_current", F.array_join("reasons", "; ").alias("reasons"), "stale_outputs")


STAGE_FRESHNESS = FILES + """
SELECT h.job_id, h.stage, mo AS missing_outputs, mi AS missing_inputs, cur AS outputs_current, concat_ws('; ', CASE WHEN mo > 0 THEN 'missing output files: ' || mo END, CASE WHEN NOT cur THEN 'outputs_are_current returned false' END, CASE WHEN mo = 0 AND cur THEN 'outputs are valid and current' END) AS reasons,
  nullif((SELECT count(*) FROM f WHERE f.job_id = h.job_id AND f.stage = h.stage AND kind = 'output' AND ex AND m < ni), 0) AS stale_outputs FROM h"""


def job_complete(spark, sf_dir):
    """Completeness of every order; its final outputs are taken from its artifact list."""
    jobs = inputs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"))
    finals = F.array(*[F.lit(k) for k in fx.FINAL_OUTPUT_KEYS])
    art = inputs.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.element_at(finals, ((F.col("l_linenumber") - 1) % 6 + 1).cast("int")).alias("key"), (F.col("l_quantity") > 1).alias("exists"))
    return au.job_complete(jobs, art, au.stage_freshness(_files(spark, sf_dir)))


JOB_COMPLETE = FILES + """, fo AS (SELECT l_orderkey AS job_id, count(DISTINCT (l_linenumber - 1) % 6) AS n FROM lineitem WHERE l_quantity > 1 GROUP BY 1),
fr AS (SELECT job_id, bool_and(cur) AS c FROM h WHERE stage NOT IN ('03_download_video_proxy', '08_detect_scenes', '09_extract_keyframes', '10_describe_visuals') GROUP BY 1)
SELECT o_orderkey AS job_id, coalesce(n, 0) AS final_outputs, coalesce(c, false) AS all_current, coalesce(n, 0) = 6 AND coalesce(c, false) AS complete FROM orders LEFT JOIN fo ON fo.job_id = o_orderkey LEFT JOIN fr ON fr.job_id = o_orderkey"""


def stage_state_fold(spark, sf_dir):
    events = log(spark, sf_dir)
    jobs = events.select("job_id").distinct()
    return au.ensure_stages(jobs, au.stage_state(events)).select("job_id", "stage", "status", "attempt", F.unix_micros("started_at").alias("started_us"), F.unix_micros("finished_at").alias("finished_us"), "last_seq")


STATE = L + f""", st AS (SELECT *, CASE event WHEN 'stage_started' THEN 'running' WHEN 'stage_completed' THEN 'completed' WHEN 'stage_failed' THEN 'failed' END AS s FROM log),
ag AS (SELECT job_id, stage, arg_max(s, seq) AS status, count(*) FILTER (s = 'running') AS attempt, max(ts) FILTER (s = 'running') AS sa, CASE WHEN arg_max(s, seq) <> 'running' THEN arg_max(ts, seq) END AS fa, max(seq) AS last_seq FROM st WHERE s IS NOT NULL GROUP BY 1, 2)
"""
STAGE_STATE_FOLD = STATE + f"""SELECT j.job_id, n.stage, coalesce(status, 'pending') AS status, coalesce(attempt, 0) AS attempt, epoch_us(sa) AS started_us, epoch_us(fa) AS finished_us, last_seq
FROM (SELECT DISTINCT job_id FROM log) j CROSS JOIN (SELECT unnest({NAMES}) AS stage) n LEFT JOIN ag ON ag.job_id = j.job_id AND ag.stage = n.stage"""


def job_state(spark, sf_dir):
    return au.job_state(log(spark, sf_dir))


JOB_STATE = L + """SELECT job_id, coalesce(arg_max(CASE WHEN event = 'run_started' THEN 'running' WHEN event = 'stage_failed' THEN 'failed' END, CASE WHEN event IN ('run_started', 'stage_failed') THEN seq END), 'pending') AS status,
  arg_max(stage, CASE WHEN event = 'stage_started' THEN seq END) AS current_stage FROM log GROUP BY 1"""


def log_tail(spark, sf_dir):
    return au.tail(log(spark, sf_dir), 20).select("job_id", "event_id", "event")


LOG_TAIL = L + "SELECT job_id, event_id, event FROM log QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) <= 20"


def delete_jobs(spark, sf_dir):
    """Delete requests for orders and odd identifiers; what is deleted, refused and left."""
    o = inputs.table(spark, sf_dir, "orders")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("status"))
    stages = inputs.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber")
    c = F.col("o_custkey")
    asks = o.where("o_custkey % 5 = 0").select(F.when(c % 3 == 0, F.concat(F.lit("bad id "), "o_orderkey")).when(c % 7 == 0, F.concat(F.lit("ghost_"), "o_orderkey")).otherwise(F.concat(F.lit(" "), "o_orderkey")).alias("job_id"))
    verdict, kept, deleted = au.delete_jobs(asks, jobs, {"jobs": jobs, "stages": stages})
    out = verdict.groupBy(F.col("verdict").alias("what")).agg(F.count("*").alias("rows"))
    for name, df in kept.items():
        out = out.unionByName(df.agg(F.lit(f"left in {name}").alias("what"), F.count("*").alias("rows")))
    return out.unionByName(deleted.groupBy(F.concat(F.lit("deleted from "), "table").alias("what")).agg(F.sum("rows").alias("rows")))


DELETE_JOBS = """
WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 3 = 0 THEN 'malformed job_id' WHEN o_custkey % 7 = 0 THEN 'job not found' WHEN o_orderstatus = 'O' THEN 'job is running' ELSE 'delete' END AS v FROM orders WHERE o_custkey % 5 = 0), d AS (SELECT k FROM r WHERE v = 'delete')
SELECT v AS what, count(*) AS rows FROM r GROUP BY 1 UNION ALL SELECT 'left in jobs', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT k FROM d) UNION ALL SELECT 'left in stages', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM d)
UNION ALL SELECT 'deleted from jobs', count(*) FROM d UNION ALL SELECT 'deleted from stages', count(*) FROM lineitem WHERE l_orderkey IN (SELECT k FROM d)"""


def marker_counters(spark, sf_dir):
    """Top markers over all visual events and chunks, with their shares: technical labels, presentation wording, the same in chunks."""
    events = inputs.visual_events(spark, sf_dir)
    visual = vis.marker_kinds(events, KEYS, [*vis.LEAKAGE_FIELDS, "presenter_context.scene_deltas"], ["technical", "presentation"], RULES)
    visual = visual.where("kind = 'presentation' OR field <> 'scene_deltas'").withColumn("counter", F.concat("kind", F.lit("_visual")))
    chunks = vis.marker_hits(chunk_texts(spark, sf_dir), KEYS, list(CHUNK_NOISE), "presentation", RULES).withColumn("counter", F.lit("presentation_chunks"))
    hits = visual.select("counter", "marker").unionByName(chunks.select("counter", "marker"))
    return au.counter_payload(materialise(hits.groupBy("counter", F.col("marker").alias("value")).agg(F.count("*").alias("n"))))


MARKER_COUNTERS = ALL_HITS + f""",
c AS (SELECT 'technical_visual' AS counter, marker AS value, count(*) AS n FROM ht GROUP BY 2
  UNION ALL SELECT 'presentation_visual', marker, count(*) FROM hp GROUP BY 2 UNION ALL SELECT 'presentation_chunks', marker, count(*) FROM hc GROUP BY 2)
SELECT counter, value, n, {SHARE} FROM c"""

QUERIES = {
    name: (globals()[name], globals().get(name.upper()))
    for name in (
        "event_counters provider_failures success_with_error status_counters quality_warnings warning_ratios quality_report report_identity report_stage_metrics "
        "unclaimed_chunks top_topics dashboard_histograms job_listing stage_rows artifact_statuses job_documents issue_locations issue_summaries partial_report "
        "derived_stale failure_status drift_union audit_summary notes_missing_extra notes_drift failure_reports stage_freshness job_complete stage_state_fold job_state log_tail "
        "delete_jobs marker_counters"
    ).split()
}
