"""Registered queries over request and response tables and the edit overlay."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.operators import overlay as ov
from talkloom.operators import requests as rq
from talkloom.operators.hashtree import fingerprint
from talkloom.plans import inputs
from talkloom.plans import oracle_inputs as oi
from talkloom.session import materialise


def request_cache_split(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    i = F.col("doc_id")

    def meta(version, model, text):
        return F.create_map(F.lit("schema_version"), version, F.lit("max_retries"), F.lit("3"), F.lit("model"), model, F.lit("input_sha"), F.sha2(text, 256))

    requests = docs.select(i.cast("string").alias("custom_id"), meta(F.lit("3"), F.lit("m1"), F.col("text")).alias("metadata"))
    cache = docs.where("doc_id % 3 <> 0").select(
        i.cast("string").alias("custom_id"),
        F.when(i % 17 != 0, meta(F.when(i % 13 == 0, "2").otherwise("3"), F.when(i % 5 == 0, "m0").otherwise("m1"), F.when(i % 7 == 0, F.lit("old")).otherwise(F.col("text")))).alias("metadata"),
        (i % 11 != 0).alias("valid"),
    )
    return rq.split_by_cache(requests, cache).withColumn("changed_keys", F.array_join("changed_keys", ","))


REQUEST_CACHE_SPLIT = """
WITH d AS (SELECT doc_id AS i, doc_id % 3 <> 0 AS c, doc_id % 17 = 0 AS nm, doc_id % 13 = 0 AS ov, doc_id % 5 = 0 AS om, doc_id % 7 = 0 AND text <> 'old' AS oi, doc_id % 11 = 0 AS bad FROM documents)
SELECT CAST(i AS VARCHAR) AS custom_id, CASE WHEN NOT c THEN 'not_cached' WHEN nm OR ov THEN 'legacy_cache' WHEN om OR oi THEN 'metadata_mismatch' WHEN bad THEN 'invalid_payload' ELSE 'hit' END AS status,
  CASE WHEN c AND nm THEN 'missing request metadata' WHEN c AND ov THEN 'schema_version' END AS legacy_reason,
  CASE WHEN c AND NOT nm THEN concat_ws(',', CASE WHEN oi THEN 'input_sha' END, CASE WHEN om THEN 'model' END, CASE WHEN ov THEN 'schema_version' END) END AS changed_keys FROM d"""


def batch_requests(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("custom_id"), "text")
    rows = rq.batch_rows(docs.select("custom_id", F.struct("text").alias("body")), "/v1/responses")
    parsed = F.from_json("line", "custom_id string, method string, url string, body struct<text:string>")
    return rows.select(parsed["custom_id"].alias("custom_id"), parsed["method"].alias("method"), parsed["url"].alias("url"), F.length(parsed["body"]["text"]).cast("long").alias("chars"))


BATCH_REQUESTS = "SELECT CAST(doc_id AS VARCHAR) AS custom_id, 'POST' AS method, '/v1/responses' AS url, CAST(length(text) AS BIGINT) AS chars FROM documents"


def _lines(spark, sf_dir):
    """Batch output lines: one to three per document, with bad statuses, errors and missing bodies."""
    i = F.col("doc_id")
    docs = inputs.table(spark, sf_dir, "documents").where("doc_id % 8 <> 3").withColumn("n", F.explode(F.sequence(F.lit(1), (i % 3 + 1).cast("int"))))
    nested = F.to_json(F.struct(F.array(F.struct(F.lit("reasoning").alias("type"), F.lit(None).cast("array<struct<type:string,text:string>>").alias("content")),
        F.struct(F.lit("message").alias("type"), F.array(F.struct(F.lit("output_text").alias("type"), F.when(i % 9 == 0, "").when(i % 10 == 0, "{broken").otherwise(F.concat(F.lit('{"n": '), "n", F.lit("}"))).alias("text"))).alias("content"))).alias("output")))
    return docs.select(
        i.cast("string").alias("custom_id"), (i * 10 + F.col("n")).alias("line_no"), F.when((i + F.col("n")) % 6 == 0, 500).otherwise(200).alias("status_code"),
        F.when((i + F.col("n")) % 7 == 0, F.lit(None)).otherwise(nested).alias("body"), F.when((i + F.col("n")) % 11 == 0, "expired").alias("error"),
    )


def response_join(spark, sf_dir):
    requests = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("custom_id"))
    return rq.join_responses(requests, _lines(spark, sf_dir)).select("custom_id", "status", "lines")


RESPONSE_JOIN = """
WITH d AS (SELECT doc_id AS i, doc_id % 3 + 1 AS n, doc_id % 8 = 3 AS none FROM documents)
SELECT CAST(i AS VARCHAR) AS custom_id, CASE WHEN none THEN 'missing' WHEN (i + n) % 11 = 0 THEN 'provider_error' WHEN (i + n) % 6 = 0 THEN 'bad_status' WHEN (i + n) % 7 = 0 THEN 'no_body' ELSE 'ok' END AS status,
  CASE WHEN NOT none THEN n END AS lines FROM d"""


def response_text_parse(spark, sf_dir):
    ok = rq.join_responses(inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("custom_id")), _lines(spark, sf_dir)).where("status = 'ok'")
    return rq.output_text(ok).select("custom_id", "text", "error_code")


RESPONSE_TEXT_PARSE = """
WITH d AS (SELECT doc_id AS i, doc_id % 3 + 1 AS n FROM documents WHERE doc_id % 8 <> 3)
SELECT CAST(i AS VARCHAR) AS custom_id, CASE WHEN i % 9 = 0 THEN NULL WHEN i % 10 = 0 THEN '{broken' ELSE '{"n": ' || n || '}' END AS text, CASE WHEN i % 9 = 0 THEN 'output_missing' WHEN i % 10 = 0 THEN 'json_parse_failed' END AS error_code
FROM d WHERE (i + n) % 11 <> 0 AND (i + n) % 6 <> 0 AND (i + n) % 7 <> 0"""


def _attempts(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("u"), "user_id").alias("custom_id"), (F.col("event_id") % 5 + 1).alias("attempt"), F.when(F.col("event_type") == "purchase", (F.col("user_id") % 7)).otherwise(1).alias("errors"))


def first_valid_attempt(spark, sf_dir):
    return rq.first_valid_attempt(_attempts(spark, sf_dir), 3)


ATT = """WITH a AS (SELECT 'u' || user_id AS custom_id, event_id % 5 + 1 AS attempt, CASE WHEN event_type = 'purchase' THEN user_id % 7 ELSE 1 END AS errors FROM events),
o AS (SELECT custom_id, min(attempt) FILTER (attempt <= 3 AND errors = 0) AS accepted_attempt, max(attempt) FILTER (attempt <= 3) AS attempts FROM a GROUP BY 1) """
FIRST_VALID_ATTEMPT = ATT + "SELECT *, accepted_attempt IS NULL AS failed FROM o"


def attempt_totals(spark, sf_dir):
    return rq.attempt_totals(first_valid_attempt(spark, sf_dir))


ATTEMPT_TOTALS = ATT + "SELECT count(*) AS items, CAST(sum(coalesce(accepted_attempt, attempts)) AS BIGINT) AS attempts, max(coalesce(accepted_attempt, attempts)) AS max_attempts, count(*) FILTER (accepted_attempt IS NULL) AS failed_items FROM o"


def usage_totals(spark, sf_dir):
    """Usage payloads in the shapes of three providers, made from the numbers in the event log."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = inputs.table(spark, sf_dir, "events").withColumn("k", k)
    openai = F.format_string('{"usage": {"input_tokens": %d, "input_tokens_details": {"cached_tokens": %d}, "output_tokens": "%d", "total_tokens": %d}}', F.col("k"), F.col("k") % 5, F.col("k") * 2, F.col("k") * 3)
    snake = F.format_string('{"usage_metadata": {"cached_content_token_count": %d, "tool_use_prompt_token_count": 4, "candidates_token_count": %d, "thoughts_token_count": 2}}', F.col("k"), F.col("k"))
    camel = F.format_string('{"usageMetadata": {"promptTokenCount": %d, "candidatesTokenCount": %d, "totalTokenCount": %d}}', F.col("k"), F.col("k"), F.col("k") * 5)
    m = F.col("event_id") % 3
    calls = e.select("event_type", F.when(m == 0, "openai").otherwise("gemini").alias("provider"), F.when(m == 1, "gemini-2.5-flash").otherwise("gemini-3-flash").alias("model"), F.when(m == 0, openai).when(m == 1, snake).otherwise(camel).alias("payload"))
    return rq.usage_totals(rq.usage(calls), ["event_type", "provider", "model"])


USAGE_TOTALS = r"""
WITH e AS (SELECT event_type, event_id % 3 AS m, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_type, CASE WHEN m = 0 THEN 'openai' ELSE 'gemini' END AS provider, CASE WHEN m = 1 THEN 'gemini-2.5-flash' ELSE 'gemini-3-flash' END AS model, count(*) AS calls,
  CAST(sum(CASE WHEN m = 1 THEN k + 4 ELSE k END) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN m = 0 THEN k % 5 ELSE 0 END) AS BIGINT) AS cached_input_tokens,
  CAST(sum(CASE WHEN m = 0 THEN k * 2 ELSE k END) AS BIGINT) AS output_tokens, CAST(sum(CASE WHEN m = 1 THEN 2 ELSE 0 END) AS BIGINT) AS reasoning_tokens, CAST(sum(CASE m WHEN 0 THEN k * 3 WHEN 1 THEN k + 4 + k + 2 ELSE k * 5 END) AS BIGINT) AS total_tokens
FROM e GROUP BY event_type, m"""


def retry_reasons(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    code = F.when(k < 20, 429).when(k < 40, 503).when(k < 60, 404)
    name = F.when(k % 3 == 0, "ReadTimeout").when(k % 3 == 1, "APIConnectionError").otherwise("ValueError")
    return e.groupBy(rq.retry_reason(code, name).alias("reason")).agg(F.count("*").alias("retries"))


RETRY_REASONS = """
WITH e AS (SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT CASE WHEN k < 20 THEN 'rate_limit' WHEN k < 40 THEN 'server_error' WHEN k % 3 = 0 THEN 'timeout' WHEN k % 3 = 1 THEN 'connection' ELSE 'retryable_error' END AS reason, count(*) AS retries FROM e GROUP BY 1"""


def provider_call_rollup(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "provider_request_started").when(F.col("event_type") == "click", "provider_request_completed").when(F.col("event_type") == "error", "provider_request_failed")
    rows = e.withColumn("event", kind).where("event IS NOT NULL").select(
        "event", "ts", F.col("user_id").alias("request_id"), (F.col("event_id") % 40).alias("attempt"), F.concat(F.lit("op"), F.col("user_id") % 4).alias("operation"), F.get_json_object("props", "$.k").cast("int").alias("status_code"),
    )
    return rq.provider_rollup(rq.provider_calls(rows))


PROVIDER_CALL_ROLLUP = """
WITH r AS (SELECT event_type, ts, user_id AS q, event_id % 40 AS a FROM events WHERE event_type IN ('view', 'click', 'error')),
s AS (SELECT q, a, min(ts) AS st FROM r WHERE event_type = 'view' GROUP BY 1, 2), f AS (SELECT q, a, min(ts) AS ft, arg_min(event_type, ts) AS ev FROM r WHERE event_type <> 'view' GROUP BY 1, 2)
SELECT 'op' || (q % 4) AS operation, count(*) AS calls, count(*) FILTER (ev = 'click') AS completed_calls, count(*) FILTER (ev = 'error') AS failed_calls, count(*) FILTER (ev IS NULL) AS open_calls, CAST(sum(epoch_us(ft) - epoch_us(st)) AS BIGINT) AS duration_us
FROM s LEFT JOIN f USING (q, a) GROUP BY 1"""


def work_admission(spark, sf_dir):
    jobs = inputs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"))
    requested = inputs.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber") * 7).alias("video_id"))
    return rq.admit(requested, jobs)


WORK_ADMISSION = "SELECT DISTINCT l_orderkey + l_linenumber * 7 AS video_id FROM lineitem WHERE l_orderkey + l_linenumber * 7 NOT IN (SELECT o_orderkey FROM orders)"


# --- edit overlay -------------------------------------------------------------------------------

CLAIM_FIELDS = ["claim_id", "claim_type", "subject", "claim", "rationale", "conditions", "applies_to", "avoid", "prefer", "evidence", "topics", "confidence"]


def _claims(spark, sf_dir):
    return inputs.claims(spark, sf_dir).select(F.lit("all").alias("job_id"), "claim_pos", "claim_id", F.struct(*CLAIM_FIELDS).alias("claim"))


def _edits(spark, sf_dir):
    """Edits from the label table (updates, deletes, late updates) and added claims, some chained."""
    claims = _claims(spark, sf_dir)
    labelled = inputs.table(spark, sf_dir, "labels").join(claims, F.col("doc_id") == F.col("claim_pos"))
    i = F.col("doc_id")
    new_text = F.concat(F.lit("edited: "), F.col("claim.claim"))
    changed = F.col("claim").withField("claim", new_text).withField("claim_type", F.when(i % 9 == 0, "opinion").otherwise("warning"))
    none = F.lit(None).cast("string")
    update = labelled.where("quality = 0").select("job_id", (i * 2).alias("edit_seq"), "claim_id", F.lit("update").alias("action"), changed.alias("claim"), none.alias("insert_after"))
    delete = labelled.where("toxic = 1").select("job_id", (i * 2 + 1).alias("edit_seq"), "claim_id", F.lit("delete").alias("action"), F.lit(None).cast(claims.schema["claim"].dataType).alias("claim"), none.alias("insert_after"))
    late = labelled.where("toxic = 1 AND doc_id % 2 = 0").select("job_id", (i * 2 + 5_000_000).alias("edit_seq"), "claim_id", F.lit("update").alias("action"), changed.alias("claim"), none.alias("insert_after"))
    p = F.col("claim_pos")
    m = p % 50
    base = claims.where(m.isin(3, 4, 5, 6))
    new_id = F.concat(F.lit("new_"), p)
    anchor = F.when(m == 3, F.concat(F.lit("claim_"), p - 1)).when(m == 6, "nowhere").otherwise(F.concat(F.lit("new_"), p - 1))
    add = base.select("job_id", (p + 10_000_000).alias("edit_seq"), new_id.alias("claim_id"), F.lit("add").alias("action"), F.col("claim").withField("claim_id", new_id).alias("claim"), anchor.alias("insert_after"))
    again = base.where(m == 3).select("job_id", (p + 20_000_000).alias("edit_seq"), F.concat(F.lit("new_x"), p).alias("claim_id"), F.lit("add").alias("action"), F.col("claim").withField("claim_id", F.concat(F.lit("new_x"), p)).alias("claim"), F.concat(F.lit("claim_"), p - 1).alias("insert_after"))
    every = update.unionByName(delete).unionByName(late).unionByName(add).unionByName(again)
    return every.withColumn("changed_fields", F.when(F.col("action") == "update", F.array(F.lit("claim"), F.lit("claim_type"))).when(F.col("action") == "delete", F.array(F.lit("deleted"))).otherwise(F.array(F.lit("added"))))


def effective_claims(spark, sf_dir):
    folded = ov.fold_edits(materialise(_claims(spark, sf_dir)), materialise(_edits(spark, sf_dir)))
    return folded.select("claim_id", F.col("claim.claim").alias("claim"), F.col("claim.claim_type").alias("claim_type"), F.array_join("order_key", "/").alias("order_key"), "edited")


EFF = oi.with_ctes(oi.CLAIMS).rstrip() + """,
lb AS (SELECT c.*, l.quality, l.toxic FROM claims c LEFT JOIN labels l ON l.doc_id = c.claim_pos),
eff AS (SELECT claim_id, CASE WHEN quality = 0 AND claim_pos % 9 <> 0 AND trim(rationale) <> '' THEN 'edited: ' || claim ELSE claim END AS claim,
    CASE WHEN quality = 0 AND claim_pos % 9 <> 0 AND trim(rationale) <> '' THEN 'warning' ELSE claim_type END AS claim_type, claim_pos || '/0' AS order_key,
    coalesce(quality = 0 AND claim_pos % 9 <> 0 AND trim(rationale) <> '', false) AS edited FROM lb WHERE coalesce(toxic, 0) <> 1),
ok AS (SELECT c.claim_pos AS p, c.claim, c.claim_type, c.claim_pos % 50 AS m FROM claims c WHERE c.claim_pos % 50 IN (3, 4, 5, 6) AND trim(c.claim) <> '' AND trim(c.rationale) <> ''),
live AS (SELECT claim_pos AS p FROM lb WHERE coalesce(toxic, 0) <> 1),
k3 AS (SELECT p, CASE WHEN p - 1 IN (SELECT p FROM live) THEN [p - 1, -(p + 10000000)] ELSE [1125899906842624 + p + 10000000] END AS k FROM ok WHERE m = 3),
k4 AS (SELECT o.p, CASE WHEN k3.k IS NOT NULL THEN list_append(k3.k, -(o.p + 10000000)) ELSE [1125899906842624 + o.p + 10000000] END AS k FROM ok o LEFT JOIN k3 ON k3.p = o.p - 1 WHERE m = 4),
k5 AS (SELECT o.p, CASE WHEN k4.k IS NOT NULL THEN list_append(k4.k, -(o.p + 10000000)) ELSE [1125899906842624 + o.p + 10000000] END AS k FROM ok o LEFT JOIN k4 ON k4.p = o.p - 1 WHERE m = 5),
kx AS (SELECT p, 'new_' || p AS id, k FROM k3 UNION ALL SELECT p, 'new_' || p, k FROM k4 UNION ALL SELECT p, 'new_' || p, k FROM k5 UNION ALL SELECT p, 'new_' || p, [1125899906842624 + p + 10000000] FROM ok WHERE m = 6
  UNION ALL SELECT p, 'new_x' || p, CASE WHEN p - 1 IN (SELECT p FROM live) THEN [p - 1, -(p + 20000000)] ELSE [1125899906842624 + p + 20000000] END FROM ok WHERE m = 3),
kr AS (SELECT p, id, k[1] AS root, row_number() OVER (PARTITION BY k[1] ORDER BY k) - CAST(k[1] > 1125899906842624 AS INT) AS place FROM kx)
"""
EFFECTIVE_CLAIMS = EFF + "SELECT * FROM eff UNION ALL SELECT kr.id, ok.claim, ok.claim_type, kr.root || '/' || kr.place, true FROM kr JOIN ok USING (p)"


def edit_history(spark, sf_dir):
    return ov.edit_history(_edits(spark, sf_dir)).select("claim_id", "edits_count", "latest_seq", "latest_action", F.array_join("changed_fields", ",").alias("changed_fields"))


EDIT_HISTORY = oi.with_ctes(oi.CLAIMS).rstrip() + """,
ed AS (SELECT 'claim_' || doc_id AS claim_id, doc_id * 2 AS s, 'update' AS a FROM labels WHERE quality = 0 UNION ALL SELECT 'claim_' || doc_id, doc_id * 2 + 1, 'delete' FROM labels WHERE toxic = 1 UNION ALL SELECT 'claim_' || doc_id, doc_id * 2 + 5000000, 'update' FROM labels WHERE toxic = 1 AND doc_id % 2 = 0
  UNION ALL SELECT 'new_' || claim_pos, claim_pos + 10000000, 'add' FROM claims WHERE claim_pos % 50 IN (3, 4, 5, 6) UNION ALL SELECT 'new_x' || claim_pos, claim_pos + 20000000, 'add' FROM claims WHERE claim_pos % 50 = 3)
SELECT claim_id, count(*) AS edits_count, max(s) AS latest_seq, arg_max(a, s) AS latest_action, CASE arg_max(a, s) WHEN 'update' THEN 'claim,claim_type' WHEN 'delete' THEN 'deleted' ELSE 'added' END AS changed_fields FROM ed GROUP BY 1"""


def _validated(spark, sf_dir):
    claims = inputs.claims(spark, sf_dir).select(F.concat(F.lit("j"), F.col("claim_pos") % 10).alias("job_id"), "claim_id", "claim_pos", F.struct(*CLAIM_FIELDS).alias("claim"))
    jobs = claims.select("job_id").distinct().withColumn("status", F.when(F.col("job_id") == "j3", "running").otherwise("completed"))
    i = F.col("claim_pos")
    key = F.when(i % 7 == 0, "video_id").when(i % 7 == 1, "claim_type").when(i % 7 == 2, "confidence").when(i % 7 == 3, "rationale").when(i % 7 == 4, "topics").when(i % 7 == 5, "subject").otherwise("claim")
    value = F.when(i % 7 == 1, F.when(i % 2 == 0, "myth").otherwise("rule")).when(i % 7 == 2, F.when(i % 2 == 0, "sure").otherwise("low")).when(i % 7 == 3, F.when(i % 2 == 0, "   ").otherwise(" new   reason ")).when(i % 7 == 5, F.col("claim.subject")).otherwise("fresh  text")
    asks = claims.select("job_id", F.when(i % 50 == 49, F.concat(F.lit("no_"), "claim_id")).otherwise(F.col("claim_id")).alias("claim_id"), F.create_map(key, F.array(value, value)).alias("updates"))
    return ov.validate_updates(asks, claims, jobs)


def edit_rejects(spark, sf_dir):
    return _validated(spark, sf_dir).where("error IS NOT NULL").select("job_id", "claim_id", "error")


VAL = oi.with_ctes(oi.CLAIMS).rstrip() + """,
v AS (SELECT *, claim_pos AS i, 'j' || (claim_pos % 10) AS job_id, CASE WHEN claim_pos % 50 = 49 THEN 'no_' || claim_id ELSE claim_id END AS cid FROM claims),
e AS (SELECT *, CASE WHEN job_id = 'j3' THEN 'job_not_completed' WHEN i % 50 = 49 THEN 'claim_not_found' WHEN i % 7 = 0 THEN 'unsupported_claim_fields' WHEN i % 7 = 1 AND i % 2 = 0 THEN 'bad_claim_type' WHEN i % 7 = 2 AND i % 2 = 0 THEN 'bad_claim_confidence'
   WHEN i % 7 = 3 AND i % 2 = 0 OR (i % 7 <> 3 AND rationale = '') OR (i % 7 <> 6 AND claim = '') THEN 'empty_claim_field' END AS error FROM v)
"""
EDIT_REJECTS = VAL + "SELECT job_id, cid AS claim_id, error FROM e WHERE error IS NOT NULL"


def edit_field_diff(spark, sf_dir):
    return ov.field_changes(_validated(spark, sf_dir)).select("job_id", "claim_id", "field", "before", "after")


DIFF = VAL.rstrip() + """,
df AS (SELECT job_id, cid AS claim_id, 'claim_type' AS field, claim_type AS before, 'rule' AS after FROM e WHERE error IS NULL AND i % 7 = 1 AND claim_type <> 'rule'
 UNION ALL SELECT job_id, cid, 'confidence', confidence, 'low' FROM e WHERE error IS NULL AND i % 7 = 2 AND confidence <> 'low'
 UNION ALL SELECT job_id, cid, 'rationale', rationale, 'new reason' FROM e WHERE error IS NULL AND i % 7 = 3
 UNION ALL SELECT job_id, cid, 'topics', array_to_string(topics, chr(10)), 'fresh text' FROM e WHERE error IS NULL AND i % 7 = 4
 UNION ALL SELECT job_id, cid, 'claim', claim, 'fresh text' FROM e WHERE error IS NULL AND i % 7 = 6)
"""
EDIT_FIELD_DIFF = DIFF + "SELECT * FROM df"


def edit_records(spark, sf_dir):
    rows = ov.edit_records(_validated(spark, sf_dir), F.lit("2024-01-01T00:00:00Z"))
    return rows.select("job_id", "claim_id", "action", F.array_join("changed_fields", ",").alias("changed_fields"), F.length("edit_id").cast("long").alias("id_chars"))


EDIT_RECORDS = DIFF + "SELECT job_id, claim_id, 'update' AS action, field AS changed_fields, CAST(28 AS BIGINT) AS id_chars FROM df"


def overlay_blocked(spark, sf_dir):
    """Jobs of the event log (users) against edits that exist for labelled documents of the same number."""
    jobs = inputs.table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id")).distinct()
    edits = inputs.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("job_id"))
    free, blocked = ov.blocked_jobs(jobs, edits)
    source = ov.effective_source(jobs, edits)
    flags = free.withColumn("decision", F.lit("run")).unionByName(blocked.withColumn("decision", F.lit("blocked_by_overlay")))
    return flags.join(source, "job_id")


OVERLAY_BLOCKED = """
SELECT DISTINCT user_id AS job_id, CASE WHEN user_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'blocked_by_overlay' ELSE 'run' END AS decision,
  CASE WHEN user_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'style_claims_current' ELSE 'style_claims' END AS claims_source FROM events"""


def human_reviews(spark, sf_dir):
    jobs = inputs.table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id")).distinct()
    e = inputs.table(spark, sf_dir, "events").where("event_type = 'signup' AND user_id % 3 <> 0")
    reviews = e.select(F.col("user_id").alias("job_id"), (F.col("event_id") % 2 == 0).alias("human_reviewed"), F.col("event_id").cast("string").alias("reviewed_at"), F.lit("dashboard").alias("reviewed_by"), F.col("event_id").alias("updated_at"))
    return ov.review_summary(jobs, reviews)


HUMAN_REVIEWS = """
WITH r AS (SELECT user_id AS job_id, max(event_id) AS m FROM events WHERE event_type = 'signup' AND user_id % 3 <> 0 GROUP BY 1)
SELECT j.job_id, coalesce(m % 2 = 0, false) AS human_reviewed, CAST(m AS VARCHAR) AS reviewed_at, CASE WHEN m IS NOT NULL THEN 'dashboard' END AS reviewed_by, m AS review_updated_at FROM (SELECT DISTINCT user_id AS job_id FROM events) j LEFT JOIN r USING (job_id)"""


def _both_sides(spark, sf_dir):
    """Effective claims per source, and an export that misses toxic ones and altered one source."""
    base = inputs.table(spark, sf_dir, "documents").select(F.col("source").alias("job_id"), F.col("doc_id").alias("pos"), "text")
    toxic = inputs.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("pos"))
    exported = base.join(toxic, "pos", "left_anti").where("job_id <> 'src4'").withColumn("text", F.when(F.col("job_id") == "src7", F.upper("text")).otherwise(F.col("text")))
    return base, exported


def _surfaces(spark, sf_dir):
    return ov.surface_drift(*_both_sides(spark, sf_dir), "pos", F.col("text"))


def surface_drift(spark, sf_dir):
    return _surfaces(spark, sf_dir)


SURF = """
WITH b AS (SELECT source AS job_id, d.doc_id, text, coalesce(l.toxic, 0) = 1 AS tox FROM documents d LEFT JOIN labels l USING (doc_id)),
s AS (SELECT job_id, count(*) AS effective_rows, CASE WHEN job_id <> 'src4' THEN nullif(count(*) FILTER (NOT tox), 0) END AS exported_rows, bool_or(tox) AS t, bool_or(upper(text) <> text) AS u FROM b GROUP BY 1),
d AS (SELECT job_id, effective_rows, exported_rows, CASE WHEN exported_rows IS NULL THEN 'missing' WHEN t OR (job_id = 'src7' AND u) THEN 'refresh' ELSE 'current' END AS surface FROM s)
"""
SURFACE_DRIFT = SURF + "SELECT * FROM d"


def surface_drift_blocks(spark, sf_dir):
    return ov.drift_blocks(*_both_sides(spark, sf_dir), "pos", F.col("text"), leaf=64, fan=4)


SURFACE_DRIFT_BLOCKS = """
WITH b AS (SELECT source AS job_id, d.doc_id AS p, d.doc_id // 64 AS n, text, coalesce(l.toxic, 0) = 1 AS tox FROM documents d LEFT JOIN labels l USING (doc_id)),
s AS (SELECT job_id, n, count(*) AS effective_rows, nullif(count(*) FILTER (NOT tox AND job_id <> 'src4'), 0) AS exported_rows, list(p || text ORDER BY p) AS a,
    list(p || CASE WHEN job_id = 'src7' THEN upper(text) ELSE text END ORDER BY p) FILTER (NOT tox AND job_id <> 'src4') AS c FROM b GROUP BY ALL)
SELECT job_id, n * 64 AS from_pos, n * 64 + 63 AS to_pos, effective_rows, exported_rows FROM s WHERE a IS DISTINCT FROM c"""


def surface_fingerprints(spark, sf_dir):
    return fingerprint(_both_sides(spark, sf_dir)[0], ["job_id"], "pos", F.col("text"), leaf=64, fan=4)


SURFACE_FINGERPRINTS = (
    """
WITH l0 AS (SELECT *, max(n) OVER (PARTITION BY job_id) AS last FROM
    (SELECT source AS job_id, doc_id // 64 AS n, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS h, count(*) AS c FROM documents GROUP BY ALL))"""
    + "".join(
        f""",
l{k + 1} AS (SELECT job_id, n // 4 AS n, sha256(string_agg(h, '' ORDER BY n)) AS h, CAST(sum(c) AS BIGINT) AS c, last // 4 AS last FROM l{k} WHERE last > 0 GROUP BY job_id, n // 4, last // 4)"""
        for k in range(10)
    )
    + " UNION ALL ".join(f"\nSELECT job_id, h AS fingerprint, c AS rows FROM l{k} WHERE last = 0" for k in range(11))
)


def refresh_results(spark, sf_dir):
    """Refresh flags of the sources' surfaces; what each one has follows from its number of rows and last document."""
    base, exported = _both_sides(spark, sf_dir)
    drift = ov.surface_drift(base, exported, "pos", F.col("text"))
    n, last = F.col("n"), F.col("last")
    facts = base.groupBy("job_id").agg(F.count("*").alias("n"), F.max("pos").alias("last")).join(drift, "job_id")
    surfaces = facts.select(
        "job_id", (F.col("surface") != "missing").alias("has_export"), (last % 7 != 0).alias("has_manifest"), (F.col("surface") == "refresh").alias("rows_differ"),
        (~F.col("effective_rows").eqNullSafe(F.col("exported_rows"))).alias("manifest_differs"), (n % 5 != 0).alias("has_notes"), (n % 3 == 0).alias("notes_changed"),
        (F.greatest(F.col("effective_rows") - F.coalesce("exported_rows", F.lit(0)), F.lit(0))).alias("stale_notes"),
        F.when(last % 6 == 0, last).alias("lock_pid"), (n % 4 == 0).alias("report_differs"), (last % 4 == 1).alias("report_older"),
    )
    return ov.refresh_results(surfaces).withColumn("stale", F.array_join("stale", ","))


def fleet_refresh_counts(spark, sf_dir):
    jobs = inputs.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("job_id")).agg(F.max("doc_id").alias("m")).select("job_id", F.when(F.col("m") % 4 == 0, "failed").otherwise("completed").alias("status"))
    return ov.refresh_summary(jobs, _surfaces(spark, sf_dir))


FLEET_REFRESH_COUNTS = SURF.rstrip() + """,
j AS (SELECT source AS job_id, max(doc_id) % 4 <> 0 AS done FROM documents GROUP BY 1)
SELECT count(*) AS jobs_seen, count(*) FILTER (NOT done) AS jobs_skipped, count(*) FILTER (done AND surface = 'refresh') AS jobs_refreshed, count(*) FILTER (done AND surface = 'current') AS jobs_current, count(*) FILTER (done AND surface = 'missing') AS jobs_without_export FROM j JOIN d USING (job_id)"""


REFRESH_RESULTS = SURF.rstrip() + """,
f AS (SELECT source AS job_id, count(*) AS n, max(doc_id) AS last FROM documents GROUP BY 1),
x AS (SELECT *, surface <> 'missing' AS e, last % 7 <> 0 AS m, n % 5 <> 0 AS o, last % 6 = 0 AS k, n % 4 = 0 OR last % 4 = 1 AS due, effective_rows - coalesce(exported_rows, 0) AS s FROM f JOIN d USING (job_id)),
r AS (SELECT job_id, NOT e AS jsonl_skipped, e AND m AND surface = 'refresh' AS jsonl_refreshed, e AND m AND effective_rows IS DISTINCT FROM exported_rows AS manifest_refreshed,
  CASE WHEN e AND NOT m THEN 'missing JSONL manifest' END AS jsonl_error, NOT o AS obsidian_skipped, o AND (n % 3 = 0 OR s > 0) AS obsidian_refreshed, CASE WHEN o THEN s ELSE 0 END AS stale_obsidian_notes_removed,
  NOT k AND NOT due AS quality_report_skipped, NOT k AND due AS quality_report_refreshed, CASE WHEN k THEN 'ValueError: job is locked by running pipeline process pid=' || last END AS quality_report_error FROM x)
SELECT *, jsonl_error IS NOT NULL OR quality_report_error IS NOT NULL AS has_errors,
  concat_ws(',', CASE WHEN jsonl_error IS NOT NULL THEN 'exports/jsonl' END, CASE WHEN quality_report_error IS NOT NULL THEN 'reports/quality_report.json' END) AS stale FROM r"""


QUERIES = {
    "request_cache_split": (request_cache_split, REQUEST_CACHE_SPLIT),
    "batch_requests": (batch_requests, BATCH_REQUESTS),
    "response_join": (response_join, RESPONSE_JOIN),
    "response_text_parse": (response_text_parse, RESPONSE_TEXT_PARSE),
    "first_valid_attempt": (first_valid_attempt, FIRST_VALID_ATTEMPT),
    "attempt_totals": (attempt_totals, ATTEMPT_TOTALS),
    "usage_totals": (usage_totals, USAGE_TOTALS),
    "retry_reasons": (retry_reasons, RETRY_REASONS),
    "provider_call_rollup": (provider_call_rollup, PROVIDER_CALL_ROLLUP),
    "work_admission": (work_admission, WORK_ADMISSION),
    "effective_claims": (effective_claims, EFFECTIVE_CLAIMS),
    "edit_history": (edit_history, EDIT_HISTORY),
    "edit_rejects": (edit_rejects, EDIT_REJECTS),
    "edit_field_diff": (edit_field_diff, EDIT_FIELD_DIFF),
    "edit_records": (edit_records, EDIT_RECORDS),
    "overlay_blocked": (overlay_blocked, OVERLAY_BLOCKED),
    "human_reviews": (human_reviews, HUMAN_REVIEWS),
    "surface_drift": (surface_drift, SURFACE_DRIFT),
    "surface_drift_blocks": (surface_drift_blocks, SURFACE_DRIFT_BLOCKS),
    "surface_fingerprints": (surface_fingerprints, SURFACE_FINGERPRINTS),
    "refresh_results": (refresh_results, REFRESH_RESULTS),
    "fleet_refresh_counts": (fleet_refresh_counts, FLEET_REFRESH_COUNTS),
}
