"""Registered queries over claims, from extraction responses to the curated table."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.operators import claims as cl
from talkloom.operators.scenes import report_drift
from talkloom.plans import inputs
from talkloom.plans import oracle_inputs as oi
from talkloom.plans.visual import _ordered_unique
from talkloom.session import materialise

CARRY = ["video_id", "claim_id", "chunk_id", "claim_type", "subject", "claim", "rationale", "start_ms"]
CL = oi.with_ctes(oi.CLAIMS).rstrip() + " "


def _planted():
    """Claims as a provider might return them: one per document, with faults at fixed intervals."""
    i = F.col("doc_id")
    sock = F.when(i % 82 == 41, "слитки и носки").when(i % 41 == 0, "слитки").otherwise(F.col("text"))
    return F.struct(
        F.when(i % 23 == 0, "opinion").otherwise("rule").alias("claim_type"),
        F.when(i % 17 == 0, " Source   Refs ").otherwise(F.col("lang")).alias("subject"),
        F.col("text").alias("claim"),
        F.when(i % 29 == 0, "  ").otherwise(sock).alias("rationale"),
        F.array().cast("array<string>").alias("conditions"),
        F.array("lang").alias("applies_to"), F.array().cast("array<string>").alias("avoid"), F.array(F.lit("wool")).alias("prefer"),
        F.when(i % 37 == 0, F.array(F.lit("see chunk_id here"), F.lit("x_chunk_id is fine"))).otherwise(F.array("text")).alias("evidence"),
        F.when(i % 31 == 0, F.array(F.lit("Source"), F.lit("metadata"), F.lit("fit"))).otherwise(F.array("lang", "source")).alias("topics"),
        F.when(i % 19 == 0, "sure").when(i % 3 == 0, "").otherwise("high").alias("confidence"),
    )


def _chunk():
    """Sixteen documents in turn make three chunks, of five, five and six."""
    return 3 * F.floor(F.col("doc_id") / 16) + F.least(F.floor(F.col("doc_id") % 16 / 5), F.lit(2))


CHUNK_SQL = "3 * (doc_id // 16) + least(doc_id % 16 // 5, 2)"


def _responses(spark, sf_dir):
    """Five documents to a response, six to every third; some bodies are broken."""
    docs = inputs.table(spark, sf_dir, "documents")
    rows = docs.select(_chunk().alias("k"), "doc_id", _planted().alias("c"))
    bodies = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("doc_id", "c"))).alias("cs"))
    good = F.to_json(F.struct(F.transform("cs", lambda x: x["c"]).alias("claims")))
    return bodies.select(
        F.concat(F.lit("c"), "k").alias("custom_id"), F.concat(F.lit("v"), F.col("k") % 4).alias("video_id"), (F.col("k") % 4 + 1).cast("long").alias("attempt"),
        F.when(F.col("k") % 13 == 5, "not json").when(F.col("k") % 13 == 6, '{"claim": []}').otherwise(good).alias("body"),
    )


ERRORS = f"WITH dk AS (SELECT *, {CHUNK_SQL} AS k FROM documents)," + r"""
sz AS (SELECT k, count(*) AS n FROM dk GROUP BY 1),
ok AS (SELECT d.*, 'c' || d.k AS custom_id, row_number() OVER (PARTITION BY d.k ORDER BY doc_id) AS claim_index, trim(regexp_replace(text, '\s+', ' ', 'g')) AS ct,
   CASE WHEN doc_id % 29 = 0 THEN '' WHEN doc_id % 82 = 41 THEN 'слитки и носки' WHEN doc_id % 41 = 0 THEN 'слитки' ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END AS ra,
   CASE WHEN doc_id % 37 = 0 THEN 'see chunk_id here' ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END AS ev FROM dk d JOIN sz USING (k) WHERE sz.n <= 5 AND d.k % 13 NOT IN (5, 6)),
mk AS (SELECT unnest(['chunk_id','event_id','fingerprint','grounding','metadata','provenance','raw','schema','source_ref','source_refs','timeline_event_ids','timestamp_url','video_id']) AS m),
fl AS (SELECT custom_id, claim_index, k, 'claim' AS field, ct AS v FROM ok UNION ALL SELECT custom_id, claim_index, k, 'rationale', ra FROM ok UNION ALL SELECT custom_id, claim_index, k, 'evidence', ev FROM ok WHERE ev <> ''
   UNION ALL SELECT custom_id, claim_index, k, 'evidence', 'x_chunk_id is fine' FROM ok WHERE doc_id % 37 = 0
   UNION ALL SELECT custom_id, claim_index, k, 'subject', CASE WHEN doc_id % 17 = 0 THEN 'Source Refs' ELSE lang END FROM ok
   UNION ALL SELECT custom_id, claim_index, k, 'topics', unnest(CASE WHEN doc_id % 31 = 0 THEN ['Source', 'metadata', 'fit'] ELSE [lang, source] END) FROM ok),
lk AS (SELECT f.*, CASE WHEN contains(lower(v), 'v' || (k % 4) || '_') THEN 'v' || (k % 4) || '_' ELSE (SELECT min(m) FROM mk WHERE regexp_matches(lower(f.v), '(^|[^a-z0-9_])' || m || '([^a-z0-9_]|$)')) END AS marker FROM fl f),
er AS (
 SELECT custom_id, claim_index, 'invalid_enum' AS code, 'claim_type' AS field, CAST(NULL AS VARCHAR) AS marker FROM ok WHERE doc_id % 23 = 0
 UNION ALL SELECT custom_id, claim_index, 'invalid_enum', 'confidence', NULL FROM ok WHERE doc_id % 19 = 0
 UNION ALL SELECT custom_id, claim_index, 'empty_required_field', 'required_fields', NULL FROM ok WHERE doc_id % 29 = 0 OR ct = '' OR ra = '' OR ev = ''
 UNION ALL SELECT custom_id, claim_index, 'service_claim', 'subject', NULL FROM ok WHERE doc_id % 17 = 0
 UNION ALL SELECT custom_id, claim_index, 'metadata_leak', 'topics', NULL FROM ok WHERE doc_id % 31 = 0
 UNION ALL SELECT custom_id, claim_index, 'metadata_leak', field, marker FROM lk WHERE marker IS NOT NULL
 UNION ALL SELECT custom_id, claim_index, 'domain_term', 'rationale', NULL FROM ok WHERE ra = 'слитки')
"""


def claim_validation_errors(spark, sf_dir):
    raw = materialise(cl.raw_claims(cl.parse_responses(_responses(spark, sf_dir))))
    return cl.claim_errors(raw, ["custom_id", "claim_index"])


CLAIM_VALIDATION_ERRORS = ERRORS + "SELECT * FROM er"


def response_outcomes(spark, sf_dir):
    parsed = cl.parse_responses(materialise(_responses(spark, sf_dir)))
    errors = cl.claim_errors(materialise(cl.raw_claims(parsed)), ["custom_id", "claim_index"])
    return cl.response_outcomes(parsed, errors)


OUTCOMES = ERRORS.rstrip() + """,
wo AS (SELECT custom_id, count(*) AS errors, min(CASE code WHEN 'service_claim' THEN '0service_claim' WHEN 'domain_term' THEN '1domain_term' WHEN 'metadata_leak' THEN '2metadata_leak' WHEN 'empty_required_field' THEN '3empty_required_field' ELSE '4invalid_enum' END) AS worst FROM er GROUP BY 1),
oc AS (SELECT 'c' || k AS custom_id, 'v' || (k % 4) AS video_id, CAST(k % 4 + 1 AS BIGINT) AS attempt, CASE WHEN k % 13 IN (5, 6) THEN 0 ELSE n END AS claims_count, coalesce(wo.errors, 0) AS errors,
  CASE WHEN k % 13 IN (5, 6) THEN 'invalid_payload' WHEN n > 5 THEN 'count_exceeded' ELSE substring(worst, 2) END AS error_code FROM sz LEFT JOIN wo ON wo.custom_id = 'c' || k)
"""
RESPONSE_OUTCOMES = OUTCOMES + "SELECT * FROM oc"


def attempt_log(spark, sf_dir):
    return cl.attempt_log(response_outcomes(spark, sf_dir))


ATTEMPT_LOG = OUTCOMES + "SELECT custom_id, attempt, error_code, errors, attempt < 3 AS will_retry FROM oc WHERE error_code IS NOT NULL"


def _chunk_rows(spark, sf_dir):
    """A chunk for each response: its documents are its events, with one more that exists nowhere."""
    rows = inputs.table(spark, sf_dir, "documents").select(_chunk().alias("k"), "doc_id", "text")
    chunks = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("d"))
    first, last, texts = F.array_min("d.doc_id"), F.array_max("d.doc_id"), F.array_join("d.text", "\n")
    return chunks.select(
        F.concat(F.lit("c"), "k").alias("chunk_id"), (first * 100).alias("start_ms"), (last * 100 + 90).alias("end_ms"),
        F.concat(F.transform("d.doc_id", lambda i: F.concat(F.lit("e"), i)), F.array(F.concat(F.lit("x"), first % 12))).alias("timeline_event_ids"),
        F.split(texts, " ").alias("topics"), texts.alias("combined_text"),
    )


def claims_materialised(spark, sf_dir):
    """Claims of the error-free responses, with what they inherit from their chunks."""
    parsed = cl.parse_responses(materialise(_responses(spark, sf_dir)))
    raw = materialise(cl.raw_claims(parsed))
    outcomes = cl.response_outcomes(parsed, cl.claim_errors(raw, ["custom_id", "claim_index"]))
    valid = raw.join(outcomes.where("error_code IS NULL").select("custom_id"), "custom_id", "left_semi").withColumn("chunk_id", F.col("custom_id"))
    return cl.build_claims(valid.withColumn("topics", F.when(F.col("claim_index") == 2, F.array().cast("array<string>")).otherwise(F.col("topics"))), _chunk_rows(spark, sf_dir)).select(
        "claim_id", "chunk_id", "subject", "rationale", "confidence", F.array_join("topics", "|").alias("topics"), "start_ms", "end_ms", F.array_join("timeline_event_ids", ",").alias("events")
    )


CLAIMS_MATERIALISED = OUTCOMES.rstrip() + r"""
SELECT printf('%s_pending_claim_%02d', o.custom_id, o.claim_index) AS claim_id, o.custom_id AS chunk_id, o.lang AS subject, o.ra AS rationale, CASE WHEN o.doc_id % 3 = 0 THEN 'medium' ELSE 'high' END AS confidence,
  array_to_string(CASE WHEN claim_index = 2 THEN string_split(h.texts, ' ')[1:8] ELSE [o.lang, o.source] END, '|') AS topics, h.low * 100 AS start_ms, h.high * 100 + 90 AS end_ms,
  h.events || ',x' || (h.low % 12) AS events
FROM ok o JOIN oc ON oc.custom_id = o.custom_id AND oc.error_code IS NULL JOIN (SELECT k, min(doc_id) AS low, max(doc_id) AS high, string_agg(text, chr(10) ORDER BY doc_id) AS texts, string_agg('e' || doc_id, ',' ORDER BY doc_id) AS events FROM dk GROUP BY 1) h ON h.k = o.k"""


def chunk_event_integrity(spark, sf_dir):
    events = inputs.table(spark, sf_dir, "documents").select(F.concat(F.lit("e"), "doc_id").alias("event_id"), F.lit("").alias("visual_summary"))
    chunks = _chunk_rows(spark, sf_dir)
    unknown = cl.unknown_event_references(chunks, events).groupBy("chunk_id").agg(F.count("*").alias("unknown_events"))
    return cl.extraction_payloads(chunks, events).select("chunk_id", "events_count").join(unknown, "chunk_id", "left")


CHUNK_EVENT_INTEGRITY = f"SELECT 'c' || ({CHUNK_SQL}) AS chunk_id, count(*) AS events_count, CAST(1 AS BIGINT) AS unknown_events FROM documents GROUP BY 1"


def claim_cleanup(spark, sf_dir):
    """Cleaning over claims with planted look-alike letters, mis-heard terms, prefixes and too many topics."""
    i = F.col("claim_pos")
    dirty = (
        inputs.claims(spark, sf_dir)
        .withColumn("subject", F.when(i % 5 == 0, "кopичнeвый  kоcтюм").otherwise(F.col("subject")))
        .withColumn("rationale", F.when(i % 4 == 0, "СЛАГСЫ и Тенсил").when(i % 4 == 1, "носки слитки  Слитков").when(i % 4 == 2, "слитки без пары").otherwise("plain text"))
        .withColumn("evidence", F.array(F.concat(F.lit("В кадре: сумка "), i), F.concat(F.lit("ведущий говорится, что номер "), i % 3), F.lit("номер 1")))
        .withColumn("topics", F.when(i % 7 == 0, F.transform(F.sequence(F.lit(1), F.lit(10)), lambda n: F.concat(F.lit("t"), n))).otherwise(F.col("topics")))
    )
    clean = cl.clean_claims(dirty)
    return clean.select(
        "claim_id", "subject", F.length("claim").cast("long").alias("claim_chars"), "rationale", F.array_join("evidence", "|").alias("evidence"), F.array_join("topics", "|").alias("topics"),
        "homoglyph_fields", "domain_fields", "prefixes_removed", "topics_cut", "changed",
    )


CLAIM_CLEANUP = CL + r"""
SELECT claim_id, CASE WHEN claim_pos % 5 = 0 THEN 'коричневый костюм' ELSE subject END AS subject, CAST(length(trim(regexp_replace(claim, '\s+', ' ', 'g'))) AS BIGINT) AS claim_chars,
  CASE claim_pos % 4 WHEN 0 THEN 'СЛАКСЫ и Тенсел' WHEN 1 THEN 'носки следки Следки' WHEN 2 THEN 'слитки без пары' ELSE 'plain text' END AS rationale,
  'сумка ' || claim_pos || '|номер ' || (claim_pos % 3) || CASE WHEN claim_pos % 3 <> 1 THEN '|номер 1' ELSE '' END AS evidence,
  CASE WHEN claim_pos % 7 = 0 THEN 't1|t2|t3|t4|t5|t6|t7|t8' ELSE subject || '|' || video_id END AS topics,
  CAST(CASE WHEN claim_pos % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS homoglyph_fields, CAST(CASE WHEN claim_pos % 4 < 2 THEN 1 ELSE 0 END AS BIGINT) AS domain_fields, CAST(2 AS BIGINT) AS prefixes_removed, claim_pos % 7 = 0 AS topics_cut, true AS changed
FROM claims"""


def _with_provenance(claims):
    """Each claim rests on one event, and refers to its source by video and chunk."""
    return claims.withColumns(
        {"timeline_event_ids": F.array(F.concat(F.lit("e"), "claim_pos")), "source_refs": F.array(F.to_json(F.struct("chunk_id", F.col("video_id").alias("video_id"))))}
    )


def claims_dedup_merge(spark, sf_dir):
    """Copies of a text within a language become one claim, with the lists and provenance of all copies."""
    merged = cl.merge_duplicates(_with_provenance(inputs.claims(spark, sf_dir)), ["subject"], "claim_pos", CARRY)
    return merged.select("claim_id", "claim_type", "subject", "merged_from", F.array_join("timeline_event_ids", "|").alias("events"), F.md5(F.array_join("source_refs", "|")).alias("refs"), *[F.array_join(f, "|").alias(f) for f in ("applies_to", "prefer", "topics")], F.size("evidence").cast("long").alias("evidence"))


DEDUP = CL.rstrip() + r""",
ck AS (SELECT *, replace(lower(trim(regexp_replace(claim, '\s+', ' ', 'g'))), 'ß', 'ss') AS ckey FROM claims),
gp AS (SELECT subject, claim_type, ckey, arg_min(claim_id, claim_pos) AS claim_id, count(*) AS merged_from, string_agg('e' || claim_pos, '|' ORDER BY claim_pos) AS events, list('{"chunk_id":"' || chunk_id || '","video_id":"' || video_id || '"}' ORDER BY claim_pos) AS refs, list(video_id ORDER BY claim_pos) AS vs, flatten(list(list_filter(list_transform(evidence, lambda e: regexp_replace(e, '^\s+|\s+$', '', 'g')), lambda e: e <> '') ORDER BY claim_pos)) AS evs FROM ck GROUP BY 1, 2, 3)
"""
CLAIMS_DEDUP_MERGE = DEDUP + f"SELECT claim_id, claim_type, subject, merged_from, events, md5(array_to_string({_ordered_unique('refs')}, '|')) AS refs, subject AS applies_to, array_to_string({_ordered_unique('vs')}, '|') AS prefer, subject || '|' || array_to_string({_ordered_unique('vs')}, '|') AS topics, CAST(len(list_distinct(evs)) AS BIGINT) AS evidence FROM gp"


def claims_renumbered(spark, sf_dir):
    merged = cl.merge_duplicates(inputs.claims(spark, sf_dir), ["video_id"], "claim_pos", CARRY)
    return cl.renumber(materialise(merged)).select("video_id", "claim_id", "chunk_id", "start_ms", "merged_from")


RENUM = CL.rstrip() + r""",
rk AS (SELECT *, replace(lower(trim(regexp_replace(claim, '\s+', ' ', 'g'))), 'ß', 'ss') AS ckey FROM claims),
rg AS (SELECT video_id, claim_type, subject, ckey, arg_min(chunk_id, claim_pos) AS chunk_id, arg_min(start_ms, claim_pos) AS start_ms, arg_min(claim, claim_pos) AS claim, count(*) AS merged_from FROM rk GROUP BY 1, 2, 3, 4)
"""
CLAIMS_RENUMBERED = RENUM + "SELECT video_id, printf('%s_claim_%06d', video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, chunk_id, claim COLLATE C)) AS claim_id, chunk_id, start_ms, merged_from FROM rg"
CLAIMS_RENUMBERED = CLAIMS_RENUMBERED.replace(" COLLATE C", "")


def claim_violations(spark, sf_dir):
    """The final checks over a table that was numbered but never cleaned; every ninth chunk is unknown."""
    merged = cl.merge_duplicates(inputs.claims(spark, sf_dir), ["video_id"], "claim_pos", CARRY)
    numbered = materialise(cl.renumber(materialise(merged)).withColumn("rationale", F.when(F.col("start_ms") == 7000, "").when(F.col("start_ms") == 9000, "слитки").otherwise(F.col("rationale"))))
    chunk_ids = numbered.where("start_ms % 9000 <> 0").select("chunk_id").distinct()
    return cl.claim_violations(numbered, chunk_ids).groupBy("code").agg(F.count("*").alias("claims"))


def claims_cross_job(spark, sf_dir):
    return cl.across_videos(inputs.claims(spark, sf_dir), "claim_pos").select("claim_id", "claim_type", "subject", "copies", "videos", F.array_join("video_ids", ",").alias("video_ids"))


CLAIMS_CROSS_JOB = DEDUP + "SELECT claim_id, claim_type, subject, merged_from AS copies, CAST(len(list_distinct(vs)) AS BIGINT) AS videos, array_to_string(list_sort(list_distinct(vs)), ',') AS video_ids FROM gp"


def _decisions(claims):
    """Decisions out of the claims themselves: exact copies merge into the lowest one; every tenth is faulty."""
    key = F.sha2(F.concat_ws("|", "subject", "claim"), 256)
    first = claims.groupBy(key.alias("k")).agg(F.min("claim_pos").alias("target"))
    i = F.col("claim_pos")
    rows = claims.where("claim_pos % 25 <> 24").withColumn("k", key).join(first, "k")
    copy = F.col("target") != i
    into = F.when(copy, F.concat(F.lit("claim_"), "target")).when(i % 20 == 3, F.col("claim_id")).when(i % 20 == 5, "claim_0").otherwise("")
    keep = F.when(i % 20 == 9, False).otherwise(~copy & (i % 20 != 3))
    base = rows.select(
        F.lit("all").alias("video_id"), (i * 2).alias("pos"), "claim_id", keep.alias("keep"), into.alias("merged_into"), F.when(i % 10 == 7, "unsure").when(i % 6 == 0, "low").otherwise(F.col("confidence")).alias("confidence_revised"),
        (i % 14 == 0).alias("split_candidate"), F.when(i % 15 == 0, "shorter").otherwise("").alias("rewrite_suggestion"), F.when(i % 16 == 0, "for all").otherwise("").alias("applies_to_note"),
    )
    again = base.where("pos % 60 = 0").withColumn("pos", F.col("pos") + 1)
    foreign = base.where("pos % 90 = 0").withColumn("claim_id", F.concat(F.lit("ghost_"), "claim_id"))
    return base.unionByName(again).unionByName(foreign)


DEC = CL.rstrip() + r""",
tg AS (SELECT subject, claim, min(claim_pos) AS target FROM claims GROUP BY 1, 2),
d0 AS (SELECT c.claim_pos AS i, c.claim_id, t.target, c.confidence FROM claims c JOIN tg t ON t.subject = c.subject AND t.claim = c.claim WHERE c.claim_pos % 25 <> 24),
d1 AS (SELECT i * 2 AS pos, i, claim_id, CASE WHEN i % 20 = 9 THEN false ELSE target = i AND i % 20 <> 3 END AS keep, CASE WHEN target <> i THEN 'claim_' || target WHEN i % 20 = 3 THEN claim_id WHEN i % 20 = 5 THEN 'claim_0' ELSE '' END AS mi,
   CASE WHEN i % 10 = 7 THEN 'unsure' WHEN i % 6 = 0 THEN 'low' ELSE confidence END AS cr FROM d0),
da AS (SELECT pos, i, claim_id, keep, mi, cr, true AS first FROM d1 UNION ALL SELECT pos + 1, i, claim_id, keep, mi, cr, false FROM d1 WHERE pos % 60 = 0 UNION ALL SELECT pos, i, 'ghost_' || claim_id, keep, mi, cr, true FROM d1 WHERE pos % 90 = 0),
de AS (SELECT *, mi = claim_id AS sm, keep AND mi <> '' AND mi <> claim_id AS km, CASE WHEN mi = claim_id OR (keep AND mi <> '') THEN '' ELSE mi END AS tgt FROM da),
errs AS (
 SELECT claim_id, pos, 'unknown claim_id' AS reason FROM de WHERE starts_with(claim_id, 'ghost_') UNION ALL SELECT claim_id, pos, 'merged_into points to itself' FROM de WHERE sm
 UNION ALL SELECT claim_id, pos, 'kept decision includes merged_into' FROM de WHERE km UNION ALL SELECT claim_id, pos, 'dropped decision has empty merged_into' FROM de WHERE NOT keep AND tgt = ''
 UNION ALL SELECT claim_id, pos, 'invalid confidence_revised' FROM de WHERE cr = 'unsure' UNION ALL SELECT claim_id, pos, 'duplicate decision' FROM de WHERE NOT first),
fd AS (SELECT d.*, c.claim_type, c.confidence, CASE WHEN cr = 'unsure' THEN coalesce(c.confidence, 'medium') ELSE cr END AS lev FROM de d LEFT JOIN claims c ON c.claim_id = d.claim_id WHERE first),
mg AS (SELECT f.claim_id, f.pos, f.tgt, CASE WHEN t.claim_type IS NULL THEN 'merged_into unknown claim_id' WHEN t.claim_type <> f.claim_type THEN 'merged_into claim_type mismatch' WHEN NOT coalesce(k.keep, true) THEN 'merged_into target is not kept' END AS reason
  FROM fd f LEFT JOIN claims t ON t.claim_id = f.tgt LEFT JOIN fd k ON k.claim_id = f.tgt WHERE NOT f.keep AND f.tgt <> '' AND f.claim_type IS NOT NULL)
"""


def _curation(spark, sf_dir):
    claims = materialise(_with_provenance(inputs.claims(spark, sf_dir)).withColumn("source", F.col("video_id")).withColumn("video_id", F.lit("all")))
    decisions = materialise(_decisions(claims))
    first, errors = cl.normalise_decisions(decisions, claims)
    first = materialise(first)
    return claims, first, errors, cl.judge_merges(first, claims)


def curation_errors(spark, sf_dir):
    _, _, errors, merges = _curation(spark, sf_dir)
    return errors.select("claim_id", "pos", "reason").unionByName(merges.where("reason IS NOT NULL").select("claim_id", "pos", "reason"))


CURATION_ERRORS = DEC + "SELECT * FROM errs UNION ALL SELECT claim_id, pos, reason FROM mg WHERE reason IS NOT NULL"


def curation_apply(spark, sf_dir):
    claims, first, _, merges = _curation(spark, sf_dir)
    return cl.apply_curation(claims, first, merges, ["video_id", "claim_id", "claim_type", "subject", "start_ms"]).select(
        "claim_id", "claim_type", "confidence_before", "confidence", "absorbed", F.array_join("timeline_event_ids", "|").alias("events"), F.array_join("prefer", "|").alias("prefer"), F.size("evidence").cast("long").alias("evidence")
    )


CURATION_APPLY = DEC.rstrip() + r""",
vm AS (SELECT claim_id, tgt, pos FROM mg WHERE reason IS NULL),
al AS (SELECT c.claim_id AS g, c.claim_pos, c.video_id, c.evidence, -1 AS o FROM claims c WHERE c.claim_id NOT IN (SELECT claim_id FROM vm) UNION ALL SELECT v.tgt, c.claim_pos, c.video_id, c.evidence, v.pos FROM vm v JOIN claims c USING (claim_id)),
ul AS (SELECT g, string_agg('e' || claim_pos, '|' ORDER BY o) AS events, list(video_id ORDER BY o) AS vs, flatten(list(list_filter(list_transform(evidence, lambda e: regexp_replace(e, '^\s+|\s+$', '', 'g')), lambda e: e <> '') ORDER BY o)) AS evs, count(*) - 1 AS absorbed FROM al GROUP BY 1)
""" + f"SELECT c.claim_id, c.claim_type, c.confidence AS confidence_before, coalesce(f.lev, c.confidence) AS confidence, u.absorbed, u.events, array_to_string({_ordered_unique('u.vs')}, '|') AS prefer, CAST(len(list_distinct(u.evs)) AS BIGINT) AS evidence FROM claims c JOIN ul u ON u.g = c.claim_id LEFT JOIN fd f ON f.claim_id = c.claim_id WHERE c.claim_id NOT IN (SELECT claim_id FROM vm)"


def curation_metrics(spark, sf_dir):
    claims, first, errors, merges = _curation(spark, sf_dir)
    return cl.curation_metrics(claims, first, errors, materialise(merges))


CURATION_METRICS = DEC.rstrip() + r""",
vm AS (SELECT claim_id FROM mg WHERE reason IS NULL),
jn AS (SELECT c.*, f.lev, f.i, v.claim_id IS NULL AS stays FROM claims c LEFT JOIN fd f ON f.claim_id = c.claim_id LEFT JOIN vm v ON v.claim_id = c.claim_id)
SELECT 'all' AS video_id, count(*) AS claims_before, count(*) FILTER (stays) AS claims_after, count(*) FILTER (NOT stays) AS merged, count(*) FILTER (stays AND lev <> confidence) AS confidence_changed,
  count(*) FILTER (stays AND i % 14 = 0) AS split_candidates, count(*) FILTER (stays AND i % 15 = 0) AS rewrites, count(*) FILTER (stays AND i % 16 = 0) AS applies_to_notes, count(*) FILTER (lev IS NULL) AS missing_decisions,
  (SELECT count(*) FROM errs) + (SELECT count(*) FROM mg WHERE reason IS NOT NULL) AS invalid_decisions FROM jn"""


def curation_payloads(spark, sf_dir):
    rows = cl.curation_payloads(inputs.claims(spark, sf_dir))
    back = F.from_json("payload", "claim_id string, confidence string, evidence array<string>")
    return rows.select("video_id", "claim_id", back["confidence"].alias("confidence"), F.size(back["evidence"]).cast("long").alias("evidence"))


CURATION_PAYLOADS = CL + "SELECT video_id, claim_id, confidence, CAST(len(evidence) AS BIGINT) AS evidence FROM claims"


def applies_to_counts(spark, sf_dir):
    return cl.applies_to_counts(inputs.claims(spark, sf_dir))


APPLIES_TO_COUNTS = CL + "SELECT subject AS applies_to, count(*) AS claims FROM claims GROUP BY 1"


def summary_config_drift(spark, sf_dir):
    """Stored extraction summaries, one per source, against the configuration in force."""
    docs = inputs.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("video_id")).agg(F.max("doc_id").alias("m"))
    stored = docs.select("video_id", F.when(F.col("m") % 2 == 0, 3).otherwise(2).alias("schema_version"), F.when(F.col("m") % 3 == 0, F.lit(None)).otherwise("medium").alias("reasoning_effort"), F.lit(5).alias("max_claims_per_chunk"))
    return report_drift(stored, {"schema_version": 3, "reasoning_effort": "medium", "max_claims_per_chunk": 5})


SUMMARY_CONFIG_DRIFT = """
WITH d AS (SELECT source AS video_id, max(doc_id) AS m FROM documents GROUP BY 1)
SELECT video_id, 'schema_version' AS field FROM d WHERE m % 2 <> 0 UNION ALL SELECT video_id, 'reasoning_effort' FROM d WHERE m % 3 = 0"""


QUERIES = {
    "claim_validation_errors": (claim_validation_errors, CLAIM_VALIDATION_ERRORS),
    "claim_response_outcomes": (response_outcomes, RESPONSE_OUTCOMES),
    "claim_attempt_log": (attempt_log, ATTEMPT_LOG),
    "claims_materialised": (claims_materialised, CLAIMS_MATERIALISED),
    "chunk_event_integrity": (chunk_event_integrity, CHUNK_EVENT_INTEGRITY),
    "claim_cleanup": (claim_cleanup, CLAIM_CLEANUP),
    "claims_dedup_merge": (claims_dedup_merge, CLAIMS_DEDUP_MERGE),
    "claims_renumbered": (claims_renumbered, CLAIMS_RENUMBERED),
    "claim_violations": (claim_violations, None),
    "claims_cross_job": (claims_cross_job, CLAIMS_CROSS_JOB),
    "curation_errors": (curation_errors, CURATION_ERRORS),
    "curation_apply": (curation_apply, CURATION_APPLY),
    "curation_metrics": (curation_metrics, CURATION_METRICS),
    "curation_payloads": (curation_payloads, CURATION_PAYLOADS),
    "applies_to_counts": (applies_to_counts, APPLIES_TO_COUNTS),
    "summary_config_drift": (summary_config_drift, SUMMARY_CONFIG_DRIFT),
}
