"""Registered streaming queries, over the event and label files read as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom import fixed_values as fx
from talkloom.plans import fleet, inputs
from talkloom.plans import oracle_inputs as oi
from talkloom.plans.requests import _claims
from talkloom.session import materialise
from talkloom.streaming import live

EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _log(spark, sf_dir):
    raw = live.file_stream(spark, sf_dir, "events.parquet", EVENTS_SCHEMA)
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in fleet.KIND.items() for x in kv]), F.col("event_type"))
    names = F.array(*[F.lit(n) for n in fx.STAGE_NAMES])
    stage = F.when(kind == "run_started", F.lit(None)).otherwise(F.element_at(names, (F.col("event_id") % 17 + 1).cast("int")))
    return raw.select("event_id", F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("job_id"), kind.alias("event"), stage.alias("stage"))


def stream_event_windows(spark, sf_dir):
    return live.event_windows(_log(spark, sf_dir)).select(F.unix_micros("window_start").alias("window_us"), "event", "n")


STREAM_EVENT_WINDOWS = fleet.L + "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_us, event, count(*) AS n FROM log WHERE event IN ('stage_failed', 'provider_request_failed') GROUP BY 1, 2"


def stream_dedup(spark, sf_dir):
    """The log delivered twice, kept once."""
    return live.unique_events(_log(spark, sf_dir).union(_log(spark, sf_dir))).select("event_id", "job_id", "event")


STREAM_DEDUP = fleet.L + "SELECT event_id, job_id, event FROM log"


def stream_sessions(spark, sf_dir):
    return live.run_sessions(_log(spark, sf_dir)).select("job_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")


STREAM_SESSIONS = fleet.L + """, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS b FROM log WINDOW w AS (PARTITION BY job_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY job_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT job_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTES) AS end_us, count(*) AS n FROM s GROUP BY job_id, k"""


def stream_stage_state(spark, sf_dir):
    return live.live_stage_state(_log(spark, sf_dir)).select("job_id", "stage", "status", "attempt", "last_seq")


STREAM_STAGE_STATE = fleet.STATE + "SELECT job_id, stage, status, attempt, last_seq FROM ag"


def stream_overlay(spark, sf_dir):
    """Updates and deletes arriving as a stream of labels, folded into the effective claims of their jobs batch by batch."""
    claims = materialise(_claims(spark, sf_dir).withColumn("job_id", F.concat(F.lit("job"), F.col("claim_pos") % 97)))
    labels = live.file_stream(spark, sf_dir, "labels.parquet", "doc_id BIGINT, quality INT, toxic INT")
    actions = F.array_compact(F.array(F.when(F.col("quality") == 0, "update"), F.when(F.col("toxic") == 1, "delete")))
    asked = labels.select(F.concat(F.lit("claim_"), "doc_id").alias("claim_id"), "doc_id", F.explode(actions).alias("action"))
    edits = asked.join(claims.select("job_id", "claim_id", "claim"), "claim_id").select(
        "job_id", (F.col("doc_id") * 2 + (F.col("action") == "delete").cast("long")).alias("edit_seq"), "claim_id", "action",
        F.col("claim").withField("claim", F.concat(F.lit("edited: "), F.col("claim.claim"))).alias("claim"), F.lit(None).cast("string").alias("insert_after"),
    )
    return live.live_overlay(claims, edits).current().select("claim_id", F.col("claim.claim").alias("claim"), "edited")


STREAM_OVERLAY = oi.with_ctes(oi.CLAIMS) + """SELECT claim_id, CASE WHEN quality = 0 AND trim(rationale) <> '' THEN 'edited: ' || claim ELSE claim END AS claim, coalesce(quality = 0 AND trim(rationale) <> '', false) AS edited
FROM claims LEFT JOIN labels ON doc_id = claim_pos WHERE coalesce(toxic, 0) <> 1"""


def stream_unfinished(spark, sf_dir):
    """Stage starts that no end follows within twelve hours; the log is closed by a row of a later time."""
    log = _log(spark, sf_dir)
    kind = F.when(F.col("event") == "stage_started", "start").when(F.col("event").isin("stage_completed", "stage_failed"), "end")
    rows = log.select(kind.alias("kind"), "event_id", "job_id", "stage", "ts").where("kind IS NOT NULL")
    last = inputs.table(spark, sf_dir, "events").agg((F.max("ts").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    none = F.lit(None)
    tick = last.select(F.lit("tick").alias("kind"), none.cast("long").alias("event_id"), none.cast("long").alias("job_id"), none.cast("string").alias("stage"), "ts")
    return live.unfinished_stages(rows, 12 * 3600 * 10**6, [tick]).select("event_id", "job_id", "stage")


STREAM_UNFINISHED = fleet.L + """SELECT event_id, job_id, stage FROM log s WHERE event = 'stage_started'
AND NOT EXISTS (SELECT 1 FROM log e WHERE e.job_id = s.job_id AND e.stage = s.stage AND e.event IN ('stage_completed', 'stage_failed') AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 12 HOURS)"""


QUERIES = {
    name: (globals()[name], globals()[name.upper()])
    for name in "stream_event_windows stream_dedup stream_sessions stream_stage_state stream_overlay stream_unfinished".split()
}
