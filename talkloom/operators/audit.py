"""Fleet audit: counters, drift between tables, freshness, and the state of jobs and stages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom import fixed_values as fx
from talkloom.functions import times as tm
from talkloom.operators import sequence as seq

STAGE = ["job_id", "stage"]


def counter_payload(counts: DataFrame) -> DataFrame:
    """Counters (counter, value, n) with each value's share of its counter, four decimals."""
    totals = counts.groupBy("counter").agg(F.sum("n").alias("total"))
    return counts.join(totals, "counter").select("counter", "value", "n", F.bround(F.col("n") / F.col("total"), 4).alias("share"))


def event_counters(events: DataFrame) -> DataFrame:
    """Monitored events counted by event, stage, job and error code in one pass; a missing stage or job is "-"."""
    dash = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("-"))
    entries = F.array(
        F.struct(F.lit("event").alias("counter"), F.col("event").alias("value")),
        F.struct(F.lit("stage").alias("counter"), dash("stage").alias("value")),
        F.struct(F.lit("job_id").alias("counter"), dash("job_id").alias("value")),
        F.struct(F.lit("error_code").alias("counter"), F.nullif(F.col("error_code"), F.lit("")).alias("value")),
    )
    rows = events.where(F.col("event").isin(fx.MONITORED_EVENTS)).select(F.explode(entries).alias("e")).select("e.*").where("value IS NOT NULL")
    return counter_payload(rows.groupBy("counter", "value").agg(F.count("*").alias("n")))


def status_counters(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    rows = jobs.select(F.lit("job_status").alias("counter"), F.col("status").alias("value")).unionByName(
        stages.select(F.lit("stage_status").alias("counter"), F.col("status").alias("value"))
    )
    return counter_payload(rows.groupBy("counter", "value").agg(F.count("*").alias("n")))


def provider_failures(events: DataFrame) -> DataFrame:
    return events.where("event = 'provider_request_failed'").select("event_id", "job_id", "stage", "status_code", "error_code")


def failures_by_status(failures: DataFrame) -> DataFrame:
    value = F.coalesce(F.col("status_code").cast("string"), F.lit("-"))
    return counter_payload(failures.groupBy(F.lit("status_code").alias("counter"), value.alias("value")).agg(F.count("*").alias("n")))


def success_with_error(events: DataFrame) -> DataFrame:
    """Subprocesses that report success and carry an error code all the same."""
    return events.where("event = 'subprocess_completed' AND return_code = 0 AND error_code IS NOT NULL").select("event_id", "job_id", "stage", "error_code")


def warning_ratios(warnings: DataFrame) -> DataFrame:
    """Warnings by template: how many, and the mean and largest a/b ratio in them."""
    rows = warnings.select(tm.warning_template(F.col("warning")).alias("template"), tm.affected_ratio(F.col("warning")).alias("ratio"))
    return rows.groupBy("template").agg(
        F.count("*").alias("warnings"), F.count("ratio").alias("with_ratio"), F.max("ratio").alias("max_ratio"), F.bround(F.avg("ratio"), 4).alias("avg_ratio")
    )


def drift_rows(joined: DataFrame, rules: dict[str, Column], details: dict[str, Column]) -> DataFrame:
    """One row per job and rule that holds, with the details as a map; NULL rules do not hold."""
    kinds = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), kind) for kind, cond in rules.items()]))
    entries = [x for name, value in details.items() for x in (F.lit(name), value.cast("string"))]
    return joined.select("job_id", F.explode(kinds).alias("kind"), F.create_map(*entries).alias("details"))


def report_drift(reports: DataFrame, jobs: DataFrame, stages: DataFrame, claims: DataFrame) -> DataFrame:
    """Where quality reports disagree with the job, its report stage, or the effective claims.

    reports: (job_id, report_job_id, report_video_id, report_status, warnings_count, claims_count, report_mtime);
    stages: (job_id, stage_finished_at, stage_warnings); claims: (job_id, effective_claims, claims_mtime)."""
    r = reports.join(jobs, "job_id").join(stages, "job_id", "left").join(claims, "job_id", "left")
    c = F.col
    effective = F.coalesce(c("effective_claims"), F.lit(0))
    return drift_rows(
        r,
        {
            "quality_report_newer_than_db_stage": c("report_mtime") > c("stage_finished_at"),
            "quality_warning_count_mismatch": c("stage_warnings") != c("warnings_count"),
            "quality_report_job_id_mismatch": ~c("report_job_id").eqNullSafe(c("job_id")),
            "quality_report_video_id_mismatch": ~c("report_video_id").eqNullSafe(c("video_id")),
            "quality_style_claims_count_mismatch": ~c("claims_count").eqNullSafe(effective),
            "quality_report_older_than_effective_claims": c("report_mtime") < c("claims_mtime"),
            "quality_report_status_mismatch": c("report_status") != c("status"),
        },
        {"report_claims": c("claims_count"), "effective_claims": effective, "job_status": c("status")},
    )


def export_drift(exports: DataFrame) -> DataFrame:
    """Exports that are older than the claims or differ from them; ``exports`` has the surface verdict per job."""
    return drift_rows(
        exports,
        {
            "claims_newer_than_export": F.col("claims_mtime") > F.col("export_mtime"),
            "export_differs_from_effective_claims": F.col("surface") == "refresh",
        },
        {"effective_claims_count": F.col("effective_rows"), "export_claims_count": F.col("exported_rows")},
    )


def note_drift(chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """Chunk notes that should exist and do not, and the other way round: (job_id, note, kind)."""
    wanted = chunks.select("job_id", F.concat("chunk_id", F.lit(".md")).alias("note"))
    there = notes.select("job_id", "note")
    return (
        wanted.join(there, ["job_id", "note"], "left_anti").withColumn("kind", F.lit("missing"))
        .unionByName(there.join(wanted, ["job_id", "note"], "left_anti").withColumn("kind", F.lit("extra")))
    )


def notes_drift(jobs: DataFrame, chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """Drift of the notes of jobs that have claims, as (job_id, kind, missing, extra): a video note older than the claims, and
    chunk notes that do not match the chunks, with how many are missing and extra (``note_drift`` names them).

    ``jobs`` has (job_id, claims_mtime, video_note_mtime), null where there is no such file."""
    with_claims = jobs.where("claims_mtime IS NOT NULL")
    none = [F.lit(None).cast("long").alias(c) for c in ("missing", "extra")]
    older = with_claims.where("video_note_mtime < claims_mtime").select("job_id", F.lit("obsidian_video_note_older_than_effective_claims").alias("kind"), *none)
    counted = note_drift(chunks, notes).groupBy("job_id").agg(F.count_if(F.col("kind") == "missing").alias("missing"), F.count_if(F.col("kind") == "extra").alias("extra"))
    differ = counted.join(with_claims.select("job_id"), "job_id").select("job_id", F.lit("obsidian_chunk_note_set_mismatch").alias("kind"), "missing", "extra")
    return older.unionByName(differ)


def stale_notes(chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """Extra notes whose name shows that the export owns them; others are left alone."""
    extra = note_drift(chunks, notes).where("kind = 'extra'")
    owned = F.concat(F.col("job_id").cast("string"), F.lit("_c_"))
    rest = F.substr("note", F.length(owned) + 1)
    return extra.where(F.startswith("note", owned) & rest.rlike(r"^\d{6}_\d{6}\.md$")).select("job_id", "note")


def failure_reports(failures: DataFrame, jobs: DataFrame) -> DataFrame:
    """Failure reports of completed jobs nobody resolved are stale; the others are history."""
    joined = failures.join(jobs.select("job_id", F.col("status").alias("job_status")), "job_id")
    stale = (F.col("job_status") == "completed") & ~F.col("report_status").eqNullSafe(F.lit("resolved"))
    return joined.withColumn("class", F.when(stale, "stale").otherwise("history"))


def stage_freshness(files: DataFrame) -> DataFrame:
    """Per job and stage: whether its outputs are at least as new as its inputs, and why not.

    ``files`` has (job_id, stage, kind input|output, path, exists, mtime)."""
    there = F.col("exists")
    is_in, is_out = F.col("kind") == "input", F.col("kind") == "output"
    rows = files.groupBy(*STAGE).agg(
        F.max(F.when(is_in & there, F.col("mtime"))).alias("newest_input"),
        F.min(F.when(is_out & there, F.col("mtime"))).alias("oldest_output"),
        F.count_if(is_out & ~there).alias("missing_outputs"),
        F.count_if(is_in & ~there).alias("missing_inputs"),
    )
    current = F.col("oldest_output").isNotNull() & (F.col("newest_input").isNull() | (F.col("oldest_output") >= F.col("newest_input")))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("missing_outputs") > 0, F.concat(F.lit("missing output files: "), F.col("missing_outputs").cast("string"))),
            F.when(~F.col("outputs_current"), "outputs_are_current returned false"),
            F.when((F.col("missing_outputs") == 0) & F.col("outputs_current"), "outputs are valid and current"),
        )
    )
    return rows.withColumn("outputs_current", F.coalesce(current, F.lit(False))).withColumn("reasons", reasons)


def stale_outputs(files: DataFrame, freshness: DataFrame) -> DataFrame:
    """Output files older than the newest input of their stage."""
    bound = freshness.select(*STAGE, "newest_input")
    return files.where("kind = 'output' AND exists").join(bound, STAGE).where(F.col("mtime") < F.col("newest_input")).select(*STAGE, "path")


def job_complete(jobs: DataFrame, artifacts: DataFrame, freshness: DataFrame, visual_enabled: bool = False) -> DataFrame:
    """A job is complete when its final outputs exist and every enabled stage is current."""
    final = artifacts.where(F.col("key").isin(fx.FINAL_OUTPUT_KEYS) & F.col("exists")).groupBy("job_id").agg(F.count_distinct("key").alias("finals"))
    enabled = freshness if visual_enabled else freshness.where(~F.col("stage").isin(fx.VISUAL_STAGES))
    fresh = enabled.groupBy("job_id").agg(F.min("outputs_current").alias("all_current"))
    return jobs.select("job_id").join(final, "job_id", "left").join(fresh, "job_id", "left").select(
        "job_id",
        F.coalesce("finals", F.lit(0)).cast("long").alias("final_outputs"),
        F.coalesce("all_current", F.lit(False)).alias("all_current"),
        ((F.coalesce("finals", F.lit(0)) == len(fx.FINAL_OUTPUT_KEYS)) & F.coalesce("all_current", F.lit(False))).alias("complete"),
    )


def stage_state(events: DataFrame) -> DataFrame:
    """State of every stage out of the event log: last status, attempts, times. Combined map-side, so a job
    with any number of events costs one row per partition and stage."""
    status = (
        F.when(F.col("event") == "stage_started", "running")
        .when(F.col("event") == "stage_completed", "completed")
        .when(F.col("event") == "stage_skipped", "skipped")
        .when(F.col("event") == "stage_failed", "failed")
    )
    rows = events.withColumn("status", status).where("status IS NOT NULL")
    done = F.col("status") != "running"
    return rows.groupBy(*STAGE).agg(
        F.max_by("status", "seq").alias("status"),
        F.count_if(F.col("status") == "running").alias("attempt"),
        F.max(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"),
        F.max_by(F.when(done, F.col("ts")), "seq").alias("finished_at"),
        F.max("seq").alias("last_seq"),
    )


def job_state(events: DataFrame) -> DataFrame:
    """Job status out of run and job events: the last one decides."""
    status = (
        F.when(F.col("event").isin("job_started", "job_resumed", "run_started"), "running")
        .when(F.col("event").isin("job_completed", "run_completed"), "completed")
        .when(F.col("event").isin("job_failed", "run_failed", "stage_failed"), "failed")
        .when(F.col("event").isin("job_stopped", "run_stopped"), "stopped")
    )
    rows = events.withColumn("status", status)
    return rows.groupBy("job_id").agg(
        F.coalesce(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))), F.lit("pending")).alias("status"),
        F.max_by("stage", F.when(F.col("event") == "stage_started", F.col("seq"))).alias("current_stage"),
    )


def ensure_stages(jobs: DataFrame, state: DataFrame) -> DataFrame:
    """All stages of every job, pending where the log says nothing."""
    stages = F.array(*[F.struct(F.lit(i + 1).alias("ordinal"), F.lit(n).alias("stage")) for i, n in enumerate(fx.STAGE_NAMES)])
    wanted = jobs.select("job_id", F.explode(stages).alias("s")).select("job_id", "s.ordinal", "s.stage")
    return wanted.join(state, STAGE, "left").withColumns(
        {"status": F.coalesce("status", F.lit("pending")), "attempt": F.coalesce("attempt", F.lit(0)).cast("long")}
    )


def delete_jobs(requests: DataFrame, jobs: DataFrame, tables: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Remove jobs from every table: (verdict per request, remaining tables, deleted row counts).

    Refused are malformed identifiers, running jobs and jobs nobody knows."""
    known = jobs.select(F.col("job_id").cast("string").alias("job_id"), "status")
    r = requests.select(F.trim("job_id").alias("job_id")).join(known, "job_id", "left")
    verdict = r.select(
        "job_id",
        F.when(F.col("job_id") == "", "job_id is required")
        .when(F.col("job_id").isin(".", "..", "__bootstrap__"), "unsupported job_id")
        .when(~F.col("job_id").rlike("^[A-Za-z0-9_-]+$"), "malformed job_id")
        .when(F.col("status").isNull(), "job not found")
        .when(F.col("status") == "running", "job is running")
        .otherwise("delete").alias("verdict"),
    )
    gone = verdict.where("verdict = 'delete'").select("job_id").distinct()
    as_text = lambda df: df.withColumn("job_id", F.col("job_id").cast("string"))
    kept = {n: as_text(df).join(gone, "job_id", "left_anti") for n, df in tables.items()}
    counts = [
        as_text(df).join(gone, "job_id", "left_semi").groupBy("job_id").agg(F.count("*").alias("rows")).withColumn("table", F.lit(n)) for n, df in tables.items()
    ]
    return verdict, kept, reduce(lambda a, b: a.unionByName(b), counts)


def audit_summary(rows: DataFrame, sample: int = 10) -> DataFrame:
    """Number of findings per kind and a sample of them in job order."""
    counts = rows.groupBy("kind").agg(F.count("*").alias("findings"))
    per_job = rows.groupBy("kind", "job_id").agg(F.count("*").alias("n"))
    shown = seq.first_n(per_job, ["kind"], ["job_id"], sample, spread="job_id")
    return shown.join(counts, "kind").select("kind", "findings", "job_id", "n")


def tail(events: DataFrame, n: int, by: Sequence[str] = ("job_id",)) -> DataFrame:
    """The last n log rows per job."""
    return seq.first_n(events, list(by), [F.desc("ts"), F.desc("seq")], n, spread="seq")
