"""Quality report and dashboard summaries over all jobs at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom import fixed_values as fx
from talkloom.functions import times as tm
from talkloom.functions.fields import short_hash
from talkloom.functions.markers import DEFAULT_RULES, MarkerRules
from talkloom.operators import sequence as seq
from talkloom.operators.visual import marker_hits

JOB = ["job_id"]


def stage_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per job and table in long form; every table is reduced map-side before the union."""
    out = None
    for name, df in tables.items():
        part = df.groupBy("job_id").agg(F.count("*").alias("value")).select("job_id", F.lit(name).alias("metric"), "value")
        out = part if out is None else out.unionByName(part)
    return out


def count_mismatches(stored: DataFrame, counted: DataFrame) -> DataFrame:
    """Stored counts that the tables do not bear out, missing ones counting as zero."""
    expected = counted.select("job_id", "metric", F.col("value").alias("counted"))
    return stored.join(expected, ["job_id", "metric"], "full_outer").where(
        F.coalesce("value", F.lit(0)) != F.coalesce("counted", F.lit(0))
    ).select("job_id", "metric", F.coalesce("value", F.lit(0)).alias("stored"), F.coalesce("counted", F.lit(0)).alias("counted"))


def coverage(spans: DataFrame, durations: DataFrame, name: str) -> DataFrame:
    """End of the last row, and the covered share of the video (four decimals; videos count at least one second)."""
    per_job = spans.groupBy("job_id").agg(
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered"), F.max_by("end_ms", "pos").alias("last_end")
    )
    share = F.bround(F.col("covered") / F.greatest(F.col("video_ms"), F.lit(1000)), 4)
    return durations.join(per_job, "job_id", "left").select(
        "job_id", F.coalesce("last_end", F.lit(0)).cast("long").alias(f"{name}_end_ms"), F.coalesce(share, F.lit(0.0)).alias(f"{name}_vs_video")
    )


def mismatches(durations: DataFrame) -> DataFrame:
    gap = lambda a: F.bround(F.abs(F.col(a) - F.col("video_ms")) / 1000, 4)
    return durations.select(
        "job_id", gap("audio_ms").alias("audio_vs_video"), gap("metadata_ms").alias("metadata_vs_video"), gap("transcript_ms").alias("transcript_vs_video")
    )


def unclaimed_chunks(chunks: DataFrame, claims: DataFrame) -> DataFrame:
    """Chunks without any claim."""
    return chunks.join(claims.select("job_id", "chunk_id"), ["job_id", "chunk_id"], "left_anti")


def report_warnings(facts: DataFrame) -> DataFrame:
    """Warning texts per job in their fixed order, one row each.

    ``facts`` is one wide row per job: duration_gap, scenes, detected_speakers, chunk_coverage, claims,
    chunks, unclaimed, events, recurring, baselines, profile_confidence, has_presenter, leakage_scenes,
    technical_scenes, noise_scenes, noisy_chunks, briefs."""
    c = F.col
    of_events = F.concat(F.lit("/"), c("events").cast("string"), F.lit(" visual events"))
    high = c("has_presenter") & (c("profile_confidence") == "high")
    warnings = F.array_compact(
        F.array(
            F.when(c("duration_gap") > 1.0, "metadata duration differs from proxy video duration by more than 1.0s"),
            F.when(c("scenes") == 1, "scene detection produced a single scene"),
            F.when(c("detected_speakers") == 0, "speaker diarization is enabled but no speaker labels were detected"),
            F.when(c("chunk_coverage") > 2.0, "chunks cover the video more than 2x; overlap or duplicated content may be too high"),
            F.when(c("claims") == 0, "style claims are empty despite non-empty chunks"),
            F.when((c("chunks") > 0) & (c("unclaimed") / c("chunks") > 0.5), "more than half of chunks have no extracted style claims"),
            F.when(high & (c("recurring") == 0), "presenter profile detected a recurring presenter, but no visual events are marked recurring"),
            F.when(c("has_presenter") & (c("baselines") > 3), "presenter baseline drifts across visual events; recurring presenter context may be unstable"),
            F.when(
                c("has_presenter") & (c("leakage_scenes") > 0),
                F.concat(F.lit("presenter baseline appears in scene-specific visual fields in "), c("leakage_scenes").cast("string"), of_events),
            ),
            F.when(high & (c("briefs") == 0), "presenter_brief is empty for all chunks despite high-confidence recurring presenter"),
            F.when(
                c("technical_scenes") > 0,
                F.concat(F.lit("technical presentation labels remain in scene-specific visual fields in "), c("technical_scenes").cast("string"), of_events),
            ),
            F.when(
                c("noise_scenes") > 0,
                F.concat(F.lit("presentation-style visual wording remains in scene-specific visual fields in "), c("noise_scenes").cast("string"), of_events),
            ),
            F.when(
                c("noisy_chunks") > 0,
                F.concat(F.lit("presentation-style visual wording reached KB chunk fields in "), c("noisy_chunks").cast("string"), F.lit("/"), c("chunks").cast("string"), F.lit(" chunks")),
            ),
        )
    )
    return facts.select("job_id", F.posexplode(warnings).alias("ordinal", "warning"))


def presenter_facts(events: DataFrame) -> DataFrame:
    """Recurring events and distinct baselines per job."""
    recurring = events.where("presenter_context.is_recurring")
    summary = F.nullif(F.trim("presenter_context.baseline_summary"), F.lit(""))
    baselines = recurring.select("job_id", summary.alias("b")).where("b IS NOT NULL").distinct().groupBy("job_id").agg(F.count("*").alias("baselines"))
    return recurring.groupBy("job_id").agg(F.count("*").alias("recurring")).join(baselines, "job_id", "left").withColumn(
        "baselines", F.coalesce("baselines", F.lit(0)).cast("long")
    )


def report_problems(reports: DataFrame, jobs: DataFrame) -> DataFrame:
    """Reports that belong to another job or video than the one they are stored for."""
    joined = reports.join(jobs.select("job_id", F.col("video_id").alias("job_video_id")), "job_id", "left")
    return joined.where(~F.col("job_video_id").eqNullSafe(F.col("video_id"))).select("job_id", "video_id", "job_video_id")


def stage_metrics(warnings: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metric map of the report stage: the warning count next to the report's own metrics (long form in)."""
    own = metrics.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("m"))
    counted = warnings.groupBy("job_id").agg(F.count("*").alias("n"))
    merged = F.map_concat(F.create_map(F.lit("warnings_count"), F.coalesce("n", F.lit(0)).cast("long")), F.col("m"))
    return own.join(counted, "job_id", "left").select("job_id", merged.alias("metrics"))


# --- dashboard ----------------------------------------------------------------------------------


def top_counts(df: DataFrame, value: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The n most frequent values (per key), ties in value order. Without a key this is a distributed top-n."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("count"))
    if not by:
        return counts.orderBy(F.desc("count"), value).limit(n)
    return seq.first_n(counts, list(by), [F.desc("count"), value], n, spread=value)


def histogram(df: DataFrame, section: str, value: Column) -> DataFrame:
    """Counts of a value, empty ones as "unknown"."""
    shown = F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("unknown"))
    return df.groupBy(shown.alias("value")).agg(F.count("*").alias("count")).select(F.lit(section).alias("section"), "value", "count")


def job_listing(jobs: DataFrame, found: DataFrame, reports: DataFrame) -> DataFrame:
    """Known jobs and jobs only their artifacts tell of, with report counts; newest first when ordered by created_at."""
    lost = found.join(jobs.select("job_id"), "job_id", "left_anti").select(
        "job_id",
        F.coalesce("failure_status", F.when(F.col("has_report"), "completed").otherwise("unknown")).alias("status"),
        F.col("mtime").alias("created_at"),
        F.lit(True).alias("synthesised"),
    )
    known = jobs.select("job_id", "status", "created_at", F.lit(False).alias("synthesised"))
    return known.unionByName(lost).join(reports, "job_id", "left").withColumn("warnings_count", F.coalesce("warnings_count", F.lit(0)).cast("long"))


def stage_rows(stages: DataFrame) -> DataFrame:
    """Stage rows with decoded JSON columns and their duration."""
    return stages.select(
        "job_id", "stage_name", "ordinal", "status",
        F.from_json("metrics", "map<string,string>").alias("metrics"),
        F.from_json("output_files", "array<string>").alias("output_files"),
        tm.iso_seconds_between(F.col("started_at"), F.col("finished_at")).alias("duration_seconds"),
    )


def artifact_status(jobs: DataFrame, manifest: DataFrame, keys: Sequence[str] = tuple(fx.ARTIFACT_KEYS)) -> DataFrame:
    """Every expected artifact of every job: whether it exists, its size and time."""
    expected = jobs.select("job_id", F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))
    return expected.join(manifest.select("job_id", "key", "size_bytes", "mtime"), ["job_id", "key"], "left").withColumn("exists", F.col("mtime").isNotNull())


def job_documents(jobs: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """One document per job with its bounded detail lists (stages, artifacts)."""
    out = jobs
    for name, df in parts.items():
        fields = [c for c in df.columns if c != "job_id"]
        rows = df.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(rows, "job_id", "left")
    return out


def marker_locations(df: DataFrame, kind: str, object_id: str, fields: Sequence[str], issue: str, rules: MarkerRules = DEFAULT_RULES) -> DataFrame:
    """Where a marker sits: one row per (object, field, marker), with a stable identifier and a time label."""
    keys = ["job_id", object_id, "start_ms", "end_ms"]
    rows = marker_hits(df, keys, fields, "presentation" if issue.endswith("presentation_noise") else "technical", rules)
    label = tm.range_label(F.floor(F.col("start_ms") / 1000), F.floor(F.col("end_ms") / 1000))
    return rows.select(
        "job_id",
        F.lit(kind).alias("kind"),
        F.col(object_id).alias("object_id"),
        "field", "marker",
        F.concat_ws(":", F.lit(issue), F.col(object_id), "field", short_hash(F.col("marker"))).alias("location_id"),
        label.alias("range"),
    )


def issue_summaries(warnings: DataFrame, locations: DataFrame) -> DataFrame:
    """Each warning with the number of places found and its four most frequent fields.

    Places are counted per field before anything is gathered."""
    per_field = locations.groupBy("job_id", "issue", "field").agg(F.count("*").alias("n"))
    gathered = per_field.groupBy("job_id", "issue").agg(
        F.sum("n").alias("locations"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("r"), "field", "n"))).alias("f")
    )
    shown = F.array_join(F.transform(F.slice("f", 1, 4), lambda x: F.concat(x["field"], F.lit(": "), x["n"])), ", ")
    return warnings.join(gathered, ["job_id", "issue"], "left").select(
        "job_id", "issue", F.coalesce("locations", F.lit(0)).cast("long").alias("locations"),
        F.coalesce(F.concat(F.col("locations"), F.lit(" locations; "), shown), F.lit("No concrete locations found in current artifacts")).alias("summary"),
    )


def partial_reports(rows: DataFrame, expected: Sequence[str]) -> DataFrame:
    """What a failed job left behind: per artifact whether it is there and readable, its rows and time span.

    ``rows`` has (job_id, artifact, readable, start_ms, end_ms)."""
    stats = rows.groupBy("job_id", "artifact").agg(
        F.count("*").alias("rows"),
        F.min("readable").alias("parseable"),
        (F.max("end_ms") - F.min("start_ms")).alias("span_ms"),
    )
    wanted = rows.select("job_id").distinct().select("job_id", F.explode(F.array(*[F.lit(e) for e in expected])).alias("artifact"))
    return wanted.join(stats, ["job_id", "artifact"], "left").select(
        "job_id", "artifact", F.col("rows").isNotNull().alias("available"), F.coalesce("parseable", F.lit(False)).alias("parseable"),
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "span_ms",
    )


def stale_artifacts(artifacts: DataFrame, claims_time: DataFrame) -> DataFrame:
    """Artifacts older than the effective claims of their job."""
    return artifacts.join(claims_time, "job_id").where(F.col("mtime") < F.col("claims_mtime")).select("job_id", "key", "mtime", "claims_mtime")


def failure_status(failures: DataFrame, successes: DataFrame) -> DataFrame:
    """Failures with whether a later success of the same stage resolved them, and when."""
    later = successes.groupBy("job_id", "stage").agg(F.max("seq").alias("last_success"))
    joined = failures.join(later, ["job_id", "stage"], "left")
    resolved = F.coalesce(F.col("last_success") > F.col("seq"), F.lit(False))
    return joined.select("job_id", "stage", "seq", "error_code", F.when(resolved, "resolved").otherwise("failed").alias("status"), F.when(resolved, F.col("last_success")).alias("resolved_by"))


def with_advice(failures: DataFrame, advice: DataFrame) -> DataFrame:
    """Failures with the advice for their code, the job and stage filled in. The advice table is a fixed list of codes."""
    rows = failures.join(advice, "error_code", "left")
    fill = lambda a: F.replace(F.replace(a, F.lit("JOB_ID"), F.col("job_id").cast("string")), F.lit("STAGE"), F.col("stage").cast("string"))
    return rows.withColumn("actions", F.transform("actions", fill))
