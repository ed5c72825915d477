"""Claims: parsing and validating extraction responses, cleaning, merging duplicates, curation.

Duplicate groups may be huge (one text copied a million times). Scalars are taken with map-side
min_by; list fields are united value by value (group, field, value -> first position), so a hot group
shrinks before the shuffle and is never gathered row by row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom import fixed_values as fx
from talkloom.config import DEFAULTS, ClaimLimits
from talkloom.functions import text as tx
from talkloom.functions import times as tm
from talkloom.operators import sequence as seq

CLAIM_SCHEMA = (
    "struct<claim_type:string,subject:string,claim:string,rationale:string,conditions:array<string>,applies_to:array<string>,"
    "avoid:array<string>,prefer:array<string>,evidence:array<string>,topics:array<string>,confidence:string>"
)
LIST_FIELDS = fx.CLAIM_LIST_FIELDS
TEXT_FIELDS = fx.CLAIM_TEXT_FIELDS
#: Where a claim comes from: events, and references as JSON texts with sorted keys. United like lists where claims have them.
PROVENANCE = ["timeline_event_ids", "source_refs"]
ALL_FIELDS = [*TEXT_FIELDS, *LIST_FIELDS]


def parse_responses(responses: DataFrame) -> DataFrame:
    """Adds the parsed claim array; NULL where the body is no object or has no claims array."""
    return responses.withColumn("claims", F.from_json("body", f"claims array<{CLAIM_SCHEMA}>")["claims"])


def raw_claims(parsed: DataFrame, limits: ClaimLimits = DEFAULTS.claim) -> DataFrame:
    """Claims of the responses that have an acceptable number of them, cleaned field by field."""
    c = F.col("c")
    rows = parsed.where(F.size("claims") <= limits.max_per_chunk).select(
        *[x for x in parsed.columns if x not in ("claims", "body")], F.posexplode("claims").alias("i", "c")
    )
    return rows.select(
        *[x for x in rows.columns if x not in ("i", "c")],
        (F.col("i") + 1).cast("long").alias("claim_index"),
        tx.squash(c["claim_type"]).alias("claim_type"),
        *[tx.squash(c[f]).alias(f) for f in TEXT_FIELDS],
        *[tx.clean_list(c[f]).alias(f) for f in LIST_FIELDS],
        F.coalesce(F.nullif(tx.squash(c["confidence"]), F.lit("")), F.lit("medium")).alias("confidence"),
    )


def technical_marker(text: Column, video_id: Column) -> Column:
    """First technical marker in a text: the video prefix, then phrases, then names in alphabetical order."""
    return _marker_in(tx.fold_case(text), video_id)


def _marker_in(low: Column, video_id: Column) -> Column:
    """The same in a text that is case-folded already; only texts that hold a name at all are searched for it as a word."""
    prefix = F.concat(tx.fold_case(video_id), F.lit("_"))
    out = F.when(F.contains(low, prefix), F.concat(video_id, F.lit("_")))
    for phrase in fx.TECHNICAL_CLAIM_PHRASES:
        out = out.when(F.contains(low, F.lit(phrase)), phrase)
    markers = fx.TECHNICAL_CLAIM_MARKERS
    names = "|".join(sorted(markers, key=len, reverse=True))
    shortest = [m for m in markers if not any(n != m and n in m for n in markers)]
    held = reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in shortest])
    found = F.array_sort(F.regexp_extract_all(low, F.lit(f"(?<![a-z0-9_])({names})(?![a-z0-9_])"), F.lit(1)))
    return out.when(held, F.get(found, 0))


def mostly_service_topics(topics: Column) -> Column:
    keys = F.filter(F.transform(topics, tx.compare_key), lambda k: k != "")
    service = F.size(F.filter(keys, lambda k: k.isin(fx.SERVICE_TOPICS)))
    return (F.size(keys) > 0) & (service >= F.greatest(F.lit(1), F.floor((F.size(keys) + 1) / 2)))


def _long_fields(claims: DataFrame, keys: Sequence[str]) -> DataFrame:
    entries = [F.struct(F.lit(f).alias("field"), F.array(f).alias("values")) for f in TEXT_FIELDS]
    entries += [F.struct(F.lit(f).alias("field"), F.col(f).alias("values")) for f in LIST_FIELDS]
    everything = F.concat_ws(" ", *TEXT_FIELDS, *LIST_FIELDS)
    return (
        claims.withColumn("__sock_context", tx.has_sock_context(everything))
        .select(*keys, "video_id", "__sock_context", F.explode(F.array(*entries)).alias("e"))
        .select(*keys, "video_id", "__sock_context", "e.field", F.explode("e.values").alias("value"))
    )


def claim_errors(claims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Validation errors of raw claims: (keys, code, field, marker)."""
    none = F.lit(None).cast("string")
    entry = lambda cond, code, field: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field")))
    empty = reduce(lambda a, b: a | b, [F.col(f) == "" for f in TEXT_FIELDS]) | (F.size("evidence") == 0)
    direct = F.array_compact(
        F.array(
            entry(~F.col("claim_type").isin(fx.CLAIM_TYPES), "invalid_enum", "claim_type"),
            entry(~F.col("confidence").isin(fx.CONFIDENCE_LEVELS), "invalid_enum", "confidence"),
            entry(empty, "empty_required_field", "required_fields"),
            entry(tx.compare_key("subject").isin(fx.SERVICE_SUBJECTS), "service_claim", "subject"),
            entry(mostly_service_topics(F.col("topics")), "metadata_leak", "topics"),
        )
    )
    per_claim = claims.select(*keys, F.explode(direct).alias("e")).select(*keys, "e.code", "e.field", none.alias("marker"))
    values = _long_fields(claims, keys).withColumn("marker", technical_marker(F.col("value"), F.col("video_id")))
    leaks = values.where("marker IS NOT NULL").select(*keys, F.lit("metadata_leak").alias("code"), "field", "marker")
    terms = values.where(tx.has_sock_term("value") & ~F.col("__sock_context")).select(
        *keys, F.lit("domain_term").alias("code"), "field", none.alias("marker")
    )
    return per_claim.unionByName(leaks).unionByName(terms)


ERROR_PRIORITY = ["service_claim", "domain_term", "metadata_leak", "empty_required_field", "invalid_enum"]


def response_outcomes(parsed: DataFrame, errors: DataFrame, limits: ClaimLimits = DEFAULTS.claim) -> DataFrame:
    """Per response: how many claims and errors, and the error code that stands for the whole response."""
    rank = reduce(
        lambda acc, p: acc.when(F.col("code") == p[1], p[0]), list(enumerate(ERROR_PRIORITY))[1:], F.when(F.col("code") == ERROR_PRIORITY[0], 0)
    )
    worst = errors.groupBy("custom_id").agg(F.min_by("code", rank).alias("worst"), F.count("*").alias("errors"))
    shape = (
        F.when(F.col("claims").isNull(), "invalid_payload").when(F.size("claims") > limits.max_per_chunk, "count_exceeded")
    )
    return parsed.join(worst, "custom_id", "left").select(
        *[c for c in parsed.columns if c not in ("claims", "body")],
        F.coalesce(F.size("claims"), F.lit(0)).cast("long").alias("claims_count"),
        F.coalesce("errors", F.lit(0)).cast("long").alias("errors"),
        F.coalesce(shape, F.col("worst")).alias("error_code"),
    )


def attempt_log(outcomes: DataFrame, limits: ClaimLimits = DEFAULTS.claim) -> DataFrame:
    """One row per failed attempt, saying whether another one follows."""
    return outcomes.where("error_code IS NOT NULL").select(
        "custom_id", "attempt", "error_code", "errors", (F.col("attempt") < limits.max_retries).alias("will_retry")
    )


def build_claims(valid: DataFrame, chunks: DataFrame, limits: ClaimLimits = DEFAULTS.claim) -> DataFrame:
    """Claims with what they inherit from their chunk; topics fall back to the chunk's first ones."""
    inherit = chunks.select("chunk_id", "start_ms", "end_ms", "timeline_event_ids", F.col("topics").alias("chunk_topics"))
    topics = F.when(F.size("topics") > 0, F.col("topics")).otherwise(F.slice("chunk_topics", 1, limits.max_topics))
    return valid.join(inherit, "chunk_id").withColumn("topics", topics).withColumn(
        "claim_id", F.format_string("%s_pending_claim_%02d", "chunk_id", "claim_index")
    ).drop("chunk_topics")


def unknown_event_references(chunks: DataFrame, events: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.explode("timeline_event_ids").alias("event_id")).join(events.select("event_id"), "event_id", "left_anti")


def extraction_payloads(chunks: DataFrame, events: DataFrame) -> DataFrame:
    """Chunk and its events, in the order the chunk names them, as one JSON request body."""
    ids = chunks.select("chunk_id", F.posexplode("timeline_event_ids").alias("i", "event_id"))
    rows = ids.join(events, "event_id").groupBy("chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("i", "event_id", "visual_summary"))).alias("events")
    )
    return chunks.join(rows, "chunk_id", "left").select(
        "chunk_id",
        F.size("events").cast("long").alias("events_count"),
        F.to_json(F.struct("chunk_id", "combined_text", "topics", "events")).alias("body"),
    )


# --- cleaning -----------------------------------------------------------------------------------


def clean_claims(claims: DataFrame, limits: ClaimLimits = DEFAULTS.claim) -> DataFrame:
    """Deterministic repairs: whitespace, look-alike letters, domain terms, evidence prefixes, topic count.

    Adds homoglyph_fields, domain_fields, prefixes_removed, topics_cut and changed."""
    context = F.concat_ws(" ", *TEXT_FIELDS, *LIST_FIELDS)
    step = claims.withColumn("__context", context)

    def repair(value: Column) -> Column:
        plain = tx.squash(value)
        letters = tx.repair_homoglyphs(plain)
        terms = tx.replace_domain_terms(letters, F.col("__context"))
        return F.struct(terms.alias("v"), (letters != plain).alias("h"), (terms != letters).alias("d"))

    for f in TEXT_FIELDS:
        step = step.withColumn(f"__{f}", repair(F.col(f)))
    step = step.withColumn("__stripped", F.transform("evidence", tx.strip_evidence_prefix))
    for f in LIST_FIELDS:
        step = step.withColumn(f"__{f}", F.transform("__stripped" if f == "evidence" else f, repair))
    flag = lambda name: sum(
        [
            *[(F.col(f"__{f}.{name}") & (F.col(f"__{f}.v") != F.col(f))).cast("long") for f in TEXT_FIELDS],
            *[F.size(F.filter(f"__{f}", lambda x: x[name])).cast("long") for f in LIST_FIELDS],
        ]
    )
    lists = {f: tx.unique_in_order(F.transform(f"__{f}", lambda x: x["v"])) for f in LIST_FIELDS}
    cut = F.size(lists["topics"]) > limits.max_topics
    out = step.withColumns(
        {f"__new_{f}": F.col(f"__{f}.v") for f in TEXT_FIELDS}
        | {f"__new_{f}": c for f, c in lists.items() if f != "topics"}
        | {
            "__new_topics": F.slice(lists["topics"], 1, limits.max_topics),
            "topics_cut": cut,
            "homoglyph_fields": flag("h"),
            "domain_fields": flag("d"),
            "prefixes_removed": F.size(
                F.filter(F.zip_with("evidence", "__stripped", lambda a, b: a != b), lambda x: x)
            ).cast("long"),
        }
    )
    changed = reduce(lambda a, b: a | b, [~F.col(f"__new_{f}").eqNullSafe(F.col(f)) for f in ALL_FIELDS])
    out = out.withColumn("changed", changed).withColumns({f: F.col(f"__new_{f}") for f in ALL_FIELDS})
    return out.drop(*[c for c in out.columns if c.startswith("__")])


# --- merging ------------------------------------------------------------------------------------


def claim_key(*scope: str) -> Column:
    """Digest of what makes two claims the same: scope, type, subject and text."""
    parts = [F.col(s).cast("string") for s in scope] + [F.col("claim_type"), tx.compare_key("subject"), tx.compare_key("claim")]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def unite_lists(rows: DataFrame, group: str, order: str, fields: Sequence[str]) -> DataFrame:
    """Ordered union of list fields per group: values in the order they first appear.

    Rows travel as (group, field, value, first position), combined map-side."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("values")) for f in fields])
    values = (
        rows.select(group, order, F.explode(entries).alias("e"))
        .select(group, order, "e.field", F.posexplode("e.values").alias("i", "value"))
        .withColumn("value", tx.strip("value"))
        .where("value <> ''")
        .groupBy(group, "field", "value")
        .agg(F.min(F.struct(order, "i")).alias("seen"))
    )
    gathered = values.groupBy(group).agg(
        *[
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("seen", "value")))), lambda x: x["value"]
            ).alias(f)
            for f in fields
        ]
    )
    return gathered


def united_fields(claims: DataFrame) -> list[str]:
    return [*LIST_FIELDS, *[f for f in PROVENANCE if f in claims.columns]]


def merge_duplicates(claims: DataFrame, scope: Sequence[str], order: str, carry: Sequence[str]) -> DataFrame:
    """One claim per key: the first one's scalars, the lists and provenance of all in order, and how many there were."""
    fields = united_fields(claims)
    keyed = claims.withColumn("__key", claim_key(*scope))
    scalars = keyed.groupBy("__key").agg(
        F.min_by(F.struct(*carry), order).alias("first"), F.count("*").alias("merged_from"), F.min(order).alias("first_order")
    )
    lists = unite_lists(keyed, "__key", order, fields)
    empty = F.array().cast("array<string>")
    return scalars.join(lists, "__key", "left").select(
        *[F.col(f"first.{c}").alias(c) for c in carry],
        *[F.coalesce(f, empty).alias(f) for f in fields],
        "merged_from", "first_order",
    )


def renumber(claims: DataFrame, video: str = "video_id") -> DataFrame:
    """Claims in (start, chunk, text) order with running identifiers, counted range by range of that order."""
    placed = seq.ranked_position(claims, [video], ["start_ms", "chunk_id", "claim"], "position")
    return placed.withColumn("claim_id", tm.ordinal_id(F.col(video), "claim", F.col("position") + 1))


def across_videos(claims: DataFrame, order: str) -> DataFrame:
    """Claims merged over all videos, keeping which videos they come from.

    Videos per claim are made distinct before they are gathered."""
    keyed = claims.withColumn("__key", claim_key())
    videos = keyed.select("__key", "video_id").distinct().groupBy("__key").agg(
        F.count("*").alias("videos"), F.array_sort(F.collect_list("video_id")).alias("video_ids")
    )
    scalars = keyed.groupBy("__key").agg(
        F.min_by(F.struct("claim_id", "claim_type", "subject", "claim"), order).alias("first"), F.count("*").alias("copies")
    )
    return scalars.join(videos, "__key").select("first.*", "copies", "videos", "video_ids")


# --- curation -----------------------------------------------------------------------------------


def normalise_decisions(decisions: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Curation decisions with faults repaired, and the faults: (video_id, claim_id, pos, reason)."""
    known = claims.select("video_id", "claim_id", F.col("confidence").alias("__confidence"))
    d = decisions.join(known, ["video_id", "claim_id"], "left")
    merged = tx.squash("merged_into")
    self_merge = merged == F.col("claim_id")
    kept_merge = F.col("keep") & (merged != "") & ~self_merge
    target = F.when(self_merge | kept_merge, "").otherwise(merged)
    level = tx.squash("confidence_revised")
    bad_level = ~level.isin(fx.CONFIDENCE_LEVELS)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("__confidence").isNull(), "unknown claim_id"),
            F.when(self_merge, "merged_into points to itself"),
            F.when(kept_merge, "kept decision includes merged_into"),
            F.when(~F.col("keep") & (target == ""), "dropped decision has empty merged_into"),
            F.when(bad_level, "invalid confidence_revised"),
        )
    )
    rows = d.withColumns(
        {
            "__reasons": reasons,
            "__target": target,
            "__level": F.when(bad_level, F.coalesce("__confidence", F.lit("medium"))).otherwise(level),
        }
    )
    errors = rows.select("video_id", "claim_id", "pos", F.explode("__reasons").alias("reason"))
    row = F.struct(
        "pos", F.col("keep"), F.col("__target").alias("merged_into"), F.col("__level").alias("confidence_revised"),
        F.col("__confidence").isNotNull().alias("known"),
        *[c for c in ("split_candidate", "rewrite_suggestion", "applies_to_note") if c in decisions.columns],
    )
    first = rows.groupBy("video_id", "claim_id").agg(F.min_by(row, "pos").alias("r")).select("video_id", "claim_id", "r.*")
    repeated = rows.join(first.select("video_id", "claim_id", F.col("pos").alias("__first")), ["video_id", "claim_id"]).where("pos > __first")
    errors = errors.unionByName(repeated.select("video_id", "claim_id", "pos", F.lit("duplicate decision").alias("reason")))
    return first, errors


def judge_merges(first: DataFrame, claims: DataFrame) -> DataFrame:
    """Requested merges with the reason they are refused (NULL when valid)."""
    types = claims.select("video_id", "claim_id", F.col("claim_type").alias("source_type"))
    targets = claims.select("video_id", F.col("claim_id").alias("merged_into"), F.col("claim_type").alias("target_type"))
    kept = first.select("video_id", F.col("claim_id").alias("merged_into"), F.col("keep").alias("target_keep"))
    wanted = first.where("NOT keep AND merged_into <> ''").join(types, ["video_id", "claim_id"])
    reason = (
        F.when(F.col("target_type").isNull(), "merged_into unknown claim_id")
        .when(F.col("target_type") != F.col("source_type"), "merged_into claim_type mismatch")
        .when(F.coalesce(~F.col("target_keep"), F.lit(False)), "merged_into target is not kept")
    )
    return (
        wanted.join(targets, ["video_id", "merged_into"], "left")
        .join(kept, ["video_id", "merged_into"], "left")
        .select("video_id", "claim_id", "pos", "merged_into", reason.alias("reason"))
    )


def apply_curation(claims: DataFrame, first: DataFrame, merges: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Claims after curation: merged ones absorbed by their target in decision order, confidence revised."""
    valid = merges.where("reason IS NULL").select("video_id", "claim_id", F.col("merged_into").alias("__target"), F.col("pos").alias("__at"))
    rows = claims.join(valid, ["video_id", "claim_id"], "left").withColumns(
        {
            "__group": F.concat_ws("\u0001", F.col("video_id").cast("string"), F.coalesce("__target", "claim_id")),
            "__order": F.when(F.col("__target").isNull(), F.lit(-1).cast("long")).otherwise(F.col("__at").cast("long")),
        }
    )
    fields = united_fields(claims)
    lists = unite_lists(rows, "__group", "__order", fields)
    absorbed = valid.groupBy("video_id", F.col("__target").alias("claim_id")).agg(F.count("*").alias("absorbed"))
    empty = F.array().cast("array<string>")
    levels = first.select("video_id", "claim_id", F.col("confidence_revised").alias("__revised"))
    return (
        rows.where("__target IS NULL")
        .select("__group", *carry, F.col("confidence").alias("confidence_before"))
        .join(lists, "__group", "left")
        .join(absorbed, ["video_id", "claim_id"], "left")
        .join(levels, ["video_id", "claim_id"], "left")
        .select(
            *carry,
            *[F.coalesce(f, empty).alias(f) for f in fields],
            "confidence_before",
            F.coalesce("__revised", "confidence_before").alias("confidence"),
            F.coalesce("absorbed", F.lit(0)).cast("long").alias("absorbed"),
        )
    )


def curation_metrics(claims: DataFrame, first: DataFrame, errors: DataFrame, merges: DataFrame, by: str = "video_id") -> DataFrame:
    """Counts of what curation did, per video."""
    decided = first.where("known").select("video_id", "claim_id", "confidence_revised", "split_candidate", "rewrite_suggestion", "applies_to_note")
    gone = merges.where("reason IS NULL").select("video_id", "claim_id", F.lit(True).alias("gone"))
    joined = claims.join(decided, ["video_id", "claim_id"], "left").join(gone, ["video_id", "claim_id"], "left")
    stays = F.col("gone").isNull()
    per_claim = joined.groupBy(by).agg(
        F.count("*").alias("claims_before"),
        F.count_if(stays).alias("claims_after"),
        F.count_if(~stays).alias("merged"),
        F.count_if(stays & (F.col("confidence_revised") != F.col("confidence"))).alias("confidence_changed"),
        F.count_if(stays & F.coalesce("split_candidate", F.lit(False))).alias("split_candidates"),
        F.count_if(stays & (F.coalesce("rewrite_suggestion", F.lit("")) != "")).alias("rewrites"),
        F.count_if(stays & (F.coalesce("applies_to_note", F.lit("")) != "")).alias("applies_to_notes"),
        F.count_if(F.col("confidence_revised").isNull()).alias("missing_decisions"),
    )
    bad = errors.select(by).unionAll(merges.where("reason IS NOT NULL").select(by)).groupBy(by).agg(F.count("*").alias("invalid_decisions"))
    return per_claim.join(bad, by, "left").withColumn("invalid_decisions", F.coalesce("invalid_decisions", F.lit(0)).cast("long"))


def curation_payloads(claims: DataFrame) -> DataFrame:
    fields = ["claim_id", "subject", "claim_type", "claim", "rationale", *LIST_FIELDS, "confidence"]
    return claims.select("video_id", "claim_id", F.to_json(F.struct(*fields)).alias("payload"))


# --- final checks --------------------------------------------------------------------------------


def claim_violations(claims: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """Rules a final claim table must meet: numbering, known chunk, required fields, clean content, unique keys."""
    required = reduce(lambda a, b: a | b, [F.trim(f) == "" for f in TEXT_FIELDS]) | (F.size("evidence") == 0)
    # a text that several fields of a claim hold is judged once; evidence is apart, as it has a rule of its own
    empty = F.array().cast("array<string>")
    texts = F.array_distinct(F.concat(F.array(*TEXT_FIELDS), *[F.coalesce(f, empty) for f in LIST_FIELDS if f != "evidence"]))
    kinds = F.array(F.struct(F.lit(False).alias("is_evidence"), texts.alias("values")), F.struct(F.lit(True).alias("is_evidence"), F.col("evidence").alias("values")))
    values = claims.select("video_id", "claim_id", F.explode(kinds).alias("e")).select("video_id", "claim_id", "e.is_evidence", F.explode("e.values").alias("value"))
    unnormalised = tx.has_unnormalised_term("value") | tx.has_sock_term("value")
    prefixed = F.col("is_evidence") & (tx.strip_evidence_prefix("value") != F.col("value"))
    # whole texts are folded and searched in plain projections, where a common part is worked out once
    folded = values.withColumn("low", tx.fold_case("value"))
    judged = folded.select(
        "video_id", "claim_id",
        _marker_in(F.col("low"), F.col("video_id")).isNotNull().alias("marked"), unnormalised.alias("unnormalised"), prefixed.alias("prefixed"),
    )
    codes = F.array_compact(
        F.array(F.when(F.col("marked"), "technical_marker"), F.when(F.col("unnormalised"), "unnormalised_term"), F.when(F.col("prefixed"), "evidence_prefix"))
    )
    content = judged.select("video_id", "claim_id", F.explode(codes).alias("code")).distinct()
    own = F.array_compact(
        F.array(
            F.when(F.col("claim_id") != tm.ordinal_id(F.col("video_id"), "claim", F.col("position") + 1), "wrong_claim_id"),
            F.when(required, "empty_required_field"),
            F.when(tx.compare_key("subject").isin(fx.SERVICE_SUBJECTS), "service_subject"),
            F.when(mostly_service_topics(F.col("topics")), "service_topics"),
        )
    )
    per_claim = claims.select("video_id", "claim_id", F.explode(own).alias("code"))
    orphan = claims.join(chunk_ids, "chunk_id", "left_anti").select("video_id", "claim_id", F.lit("unknown_chunk").alias("code"))
    repeated = (
        claims.withColumn("__key", claim_key("video_id")).groupBy("video_id", "__key")
        .agg(F.count("*").alias("n"), F.min("claim_id").alias("claim_id")).where("n > 1")
        .select("video_id", "claim_id", F.lit("duplicate_key").alias("code"))
    )
    return content.unionByName(per_claim).unionByName(orphan).unionByName(repeated)


def applies_to_counts(claims: DataFrame) -> DataFrame:
    return claims.select(F.explode("applies_to").alias("applies_to")).groupBy("applies_to").agg(F.count("*").alias("claims"))
