"""Model request and response tables: caches, batches, attempts, usage, provider calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions.fields import json_int


def canonical_map(m: Column) -> Column:
    """A map as JSON with sorted keys, so equal maps give equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def with_request_digest(items: DataFrame, metadata: str = "metadata") -> DataFrame:
    return items.withColumn("request_sha", F.sha2(canonical_map(F.col(metadata)), 256))


def changed_keys(a: Column, b: Column, limit: int = 12) -> Column:
    """Keys under which two metadata maps differ, sorted, the first few of them (a report of causes)."""
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    return F.slice(F.filter(keys, lambda k: ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k))), 1, limit)


def split_by_cache(requests: DataFrame, cache: DataFrame, max_retries: str = "3", schema_version: str = "3") -> DataFrame:
    """Each request as a hit, or a miss with its cause and the metadata keys that changed.

    ``cache`` has (custom_id, metadata, valid); a hit needs equal metadata and a payload that still validates."""
    stored = with_request_digest(cache).select(
        "custom_id", F.col("metadata").alias("cached"), F.col("request_sha").alias("cached_sha"), "valid", F.lit(True).alias("found")
    )
    joined = with_request_digest(requests).join(stored, "custom_id", "left")
    legacy = (
        F.when(F.col("cached").isNull(), "missing request metadata")
        .when(~F.try_element_at("cached", F.lit("schema_version")).eqNullSafe(F.lit(schema_version)), "schema_version")
        .when(~F.try_element_at("cached", F.lit("max_retries")).eqNullSafe(F.lit(max_retries)), "max_retries")
    )
    status = (
        F.when(F.col("found").isNull(), "not_cached")
        .when(legacy.isNotNull(), "legacy_cache")
        .when(F.col("cached_sha") != F.col("request_sha"), "metadata_mismatch")
        .when(~F.col("valid"), "invalid_payload")
        .otherwise("hit")
    )
    return joined.select(
        "custom_id",
        status.alias("status"),
        F.when(F.col("found"), legacy).alias("legacy_reason"),
        F.when(F.col("cached").isNotNull(), changed_keys(F.col("metadata"), F.col("cached"))).alias("changed_keys"),
    )


def batch_rows(requests: DataFrame, url: str) -> DataFrame:
    """Batch lines: one JSON document per request."""
    line = F.struct("custom_id", F.lit("POST").alias("method"), F.lit(url).alias("url"), "body")
    return requests.select("custom_id", F.to_json(line).alias("line"))


def last_response(lines: DataFrame) -> DataFrame:
    """The last line per request wins."""
    row = F.struct("status_code", "body", "error")
    return lines.groupBy("custom_id").agg(F.max_by(row, "line_no").alias("r"), F.count("*").alias("lines")).select("custom_id", "r.*", "lines")


def join_responses(requests: DataFrame, lines: DataFrame) -> DataFrame:
    joined = requests.select("custom_id").join(last_response(lines), "custom_id", "left")
    status = (
        F.when(F.col("lines").isNull(), "missing")
        .when(F.col("error").isNotNull(), "provider_error")
        .when(~F.col("status_code").eqNullSafe(F.lit(200)), "bad_status")
        .when(F.get_json_object("body", "$").isNull(), "no_body")
        .otherwise("ok")
    )
    return joined.withColumn("status", status)


def output_text(responses: DataFrame) -> DataFrame:
    """First output text of a nested response and whether it parses: error code NULL when it does."""
    schema = "output array<struct<type:string,content:array<struct<type:string,text:string>>>>"
    messages = F.filter(F.from_json("body", schema)["output"], lambda o: o["type"] == "message")
    contents = F.flatten(F.transform(messages, lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    texts = F.filter(contents, lambda c: (c["type"] == "output_text") & (F.coalesce(c["text"], F.lit("")) != ""))
    text = F.get(texts, 0)["text"]
    return responses.withColumn("text", text).withColumn(
        "error_code",
        F.when(F.col("text").isNull(), "output_missing").when(F.get_json_object("text", "$").isNull(), "json_parse_failed"),
    )


def first_valid_attempt(attempts: DataFrame, max_retries: int) -> DataFrame:
    """First attempt without errors within the allowed number, else the item failed."""
    within = F.col("attempt") <= max_retries
    return attempts.groupBy("custom_id").agg(
        F.min(F.when(within & (F.col("errors") == 0), F.col("attempt"))).alias("accepted_attempt"),
        F.max(F.when(within, F.col("attempt"))).alias("attempts"),
    ).withColumn("failed", F.col("accepted_attempt").isNull())


def attempt_totals(outcomes: DataFrame) -> DataFrame:
    used = F.coalesce("accepted_attempt", "attempts")
    return outcomes.agg(
        F.count("*").alias("items"), F.sum(used).alias("attempts"), F.max(used).alias("max_attempts"), F.count_if("failed").alias("failed_items")
    )


def usage(calls: DataFrame) -> DataFrame:
    """Token usage of (provider, payload) rows in one shape; a missing total is the sum of the parts."""
    p = F.col("payload")
    first = lambda *paths: json_int(p, *paths)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    prompt = first("$.usage_metadata.prompt_token_count", "$.usageMetadata.promptTokenCount")
    cached = first("$.usage_metadata.cached_content_token_count", "$.usageMetadata.cachedContentTokenCount")
    tool = first("$.usage_metadata.tool_use_prompt_token_count", "$.usageMetadata.toolUsePromptTokenCount")
    answer = zero(first("$.usage_metadata.candidates_token_count", "$.usageMetadata.candidatesTokenCount"))
    thought = zero(first("$.usage_metadata.thoughts_token_count", "$.usageMetadata.thoughtsTokenCount"))
    total = first("$.usage_metadata.total_token_count", "$.usageMetadata.totalTokenCount")
    pieced = F.startswith(F.lower(F.coalesce("model", F.lit(""))), F.lit("gemini-2.5-flash"))
    given = F.when(pieced, F.coalesce(prompt, zero(cached) + zero(tool))).otherwise(zero(prompt))
    responses_api = F.col("provider") == "openai"
    return calls.withColumns(
        {
            "input_tokens": F.when(responses_api, zero(first("$.usage.input_tokens"))).otherwise(given),
            "cached_input_tokens": F.when(responses_api, zero(first("$.usage.input_tokens_details.cached_tokens"))).otherwise(0).cast("long"),
            "output_tokens": F.when(responses_api, zero(first("$.usage.output_tokens"))).otherwise(answer),
            "reasoning_tokens": F.when(responses_api, zero(first("$.usage.output_tokens_details.reasoning_tokens"))).otherwise(thought),
            "total_tokens": F.when(responses_api, zero(first("$.usage.total_tokens"))).otherwise(F.coalesce(total, given + answer + thought)),
        }
    )


def usage_totals(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    names = ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_tokens", "total_tokens"]
    return rows.groupBy(*by).agg(F.count("*").alias("calls"), *[F.sum(n).cast("long").alias(n) for n in names])


def retry_reason(status_code: Column, error_class: Column) -> Column:
    name = F.lower(F.coalesce(error_class, F.lit("")))
    return (
        F.when(status_code == 429, "rate_limit")
        .when(status_code >= 500, "server_error")
        .when(F.contains(name, F.lit("timeout")), "timeout")
        .when(F.contains(name, F.lit("connection")), "connection")
        .otherwise("retryable_error")
    )


def admit(requested: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requested videos no job exists for yet, each once."""
    return requested.select("video_id").distinct().join(jobs.select("video_id"), "video_id", "left_anti")


def provider_calls(events: DataFrame) -> DataFrame:
    """Started and finished provider events paired by (request_id, attempt): duration, status, outcome."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    started = events.where("event = 'provider_request_started'").groupBy("request_id", "attempt").agg(F.min("ts").alias("started_at"), F.min("operation").alias("operation"))
    done = events.where("event IN ('provider_request_completed', 'provider_request_failed')").groupBy("request_id", "attempt").agg(
        F.min("ts").alias("finished_at"), F.min_by("event", "ts").alias("event"), F.min_by("status_code", "ts").alias("status_code")
    )
    outcome = F.when(F.col("event").isNull(), "open").when(F.col("event") == "provider_request_failed", "failed").otherwise("completed")
    return started.join(done, ["request_id", "attempt"], "left").select(
        "request_id", "attempt", "operation", outcome.alias("outcome"), "status_code",
        (F.unix_micros("finished_at") - F.unix_micros("started_at")).alias("duration_us"),
    )


def provider_rollup(calls: DataFrame) -> DataFrame:
    return calls.groupBy("operation").agg(
        F.count("*").alias("calls"),
        *[F.count_if(F.col("outcome") == o).alias(f"{o}_calls") for o in ("completed", "failed", "open")],
        F.sum("duration_us").alias("duration_us"),
    )
