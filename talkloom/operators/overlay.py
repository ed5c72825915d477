"""Human edits as an append-only overlay on the claim table.

Claims and edits are matched by (job, claim) keys only; even the order of inserted claims comes out of
joins (list ranking by pointer doubling), so one job may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom import fixed_values as fx
from talkloom.functions import text as tx
from talkloom.functions.fields import short_hash
from talkloom.operators import sequence as seq
from talkloom.operators.hashtree import FAN, LEAF, differing_leaves, fingerprint
from talkloom.session import materialise

KEY = ["job_id", "claim_id"]
APPENDED = 1 << 50


def claim_is_valid(c: Column) -> Column:
    required = [F.coalesce(F.trim(c[f]), F.lit("")) != "" for f in fx.CLAIM_TEXT_FIELDS]
    ok = c["claim_type"].isin(fx.CLAIM_TYPES) & c["confidence"].isin(fx.CONFIDENCE_LEVELS)
    for r in required:
        ok = ok & r
    return F.coalesce(ok, F.lit(False))


def fold_edits(claims: DataFrame, edits: DataFrame) -> DataFrame:
    """The effective claims: (job_id, claim_id, claim, order_key, edited).

    ``claims`` has (job_id, claim_pos, claim_id, claim struct); ``edits`` has (job_id, edit_seq, claim_id,
    action, claim struct, insert_after). A delete is final; an update needs a claim to update; an invalid
    claim changes nothing; a new claim goes after its anchor if that is in the list at the time, else last.
    ``order_key`` is (root, place): the rows of a job sort by it. A root is a claim that was not inserted after another,
    by position or, if added last, by APPENDED and its number; place counts the claims inserted below it, in list order."""
    known = claims.select(*KEY, F.lit(True).alias("original"))
    deleted = edits.where("action = 'delete'").groupBy(*KEY).agg(F.min("edit_seq").alias("deleted_at"))
    usable = (
        edits.where(F.col("action").isin("add", "update") & claim_is_valid(F.col("claim")) & (F.col("claim.claim_id") == F.col("claim_id")))
        .join(deleted, KEY, "left")
        .where("deleted_at IS NULL OR edit_seq < deleted_at")
        .join(known, KEY, "left")
    )
    born = usable.where("action = 'add' AND original IS NULL").groupBy(*KEY).agg(
        F.min("edit_seq").alias("added_at"), F.min_by("insert_after", "edit_seq").alias("insert_after")
    )
    counted = usable.join(born.select(*KEY, "added_at"), KEY, "left").where("original OR edit_seq >= added_at")
    latest = counted.groupBy(*KEY).agg(F.max_by("claim", "edit_seq").alias("edited_claim"))

    start = claims.select(*KEY, F.col("claim_pos").cast("long").alias("root"), F.lit(-1).cast("long").alias("added_at")).join(deleted, KEY, "left")
    members = start.drop("root").unionByName(born.select(*KEY, "added_at").join(deleted, KEY, "left"))
    anchors = members.select(
        "job_id", F.col("claim_id").alias("insert_after"), F.col("added_at").alias("anchor_added"), F.col("deleted_at").alias("anchor_deleted"), F.lit(True).alias("anchor_known")
    )
    placed = born.join(anchors, ["job_id", "insert_after"], "left").withColumn(
        "anchored",
        F.coalesce(
            F.col("anchor_known") & (F.col("anchor_added") < F.col("added_at")) & (F.col("anchor_deleted").isNull() | (F.col("anchor_deleted") > F.col("added_at"))),
            F.lit(False),
        ),
    )
    placed = materialise(placed.select(*KEY, "added_at", "insert_after", "anchored"))
    roots = start.select(*KEY, "root").unionByName(placed.where("NOT anchored").select(*KEY, (F.lit(APPENDED) + F.col("added_at")).alias("root")))
    trees = preorder(placed.where("anchored").select("job_id", F.col("claim_id").alias("node"), F.col("insert_after").alias("parent"), "added_at"), ["job_id"], "added_at")
    trees = trees.select("job_id", F.col("node").alias("claim_id"), F.col("top").alias("top_id"), "place")
    tops = roots.select("job_id", F.col("claim_id").alias("top_id"), "root")
    inserted = trees.where("place > 0").join(tops, ["job_id", "top_id"]).select(*KEY, "root", "place")
    ordered = roots.withColumn("place", F.lit(0).cast("long")).unionByName(inserted)

    return (
        ordered.join(deleted, KEY, "left_anti")
        .join(claims.select(*KEY, "claim"), KEY, "left")
        .join(latest, KEY, "left")
        .select(*KEY, F.coalesce("edited_claim", "claim").alias("claim"), F.array("root", "place").alias("order_key"), F.col("edited_claim").isNotNull().alias("edited"))
    )


def preorder(children: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """The forest of ``children`` (keys, node, parent, ``newest``) in list order: (keys, node, top, place).

    A node stands after its parent, before what was inserted after that parent earlier, with all below it. ``top`` is the
    root of its tree, which has place 0 and may be a parent that is no node itself; places count on from there.

    List ranking of Euler tours: each node is entered and left, each step knows the next, and pointer doubling sums the
    entries from every step to the end of its tree in a number of rounds that grows with the logarithm of the longest
    tour. Each step is the next of one other at most, so no round has a hot key; siblings are chained by a window over
    blocks of siblings."""
    kids = materialise(children.select(*keys, "node", "parent", newest))
    ranked = seq.dense_position(kids.withColumn("__back", -F.col(newest)), [*keys, "parent"], "__back", "__place", ties=["node"])
    chained = seq.neighbour_window(ranked, [*keys, "parent"], "__place", lambda w: {"__next": F.lead("node").over(w)}, back=0)
    chained = materialise(chained.select(*keys, "node", "parent", "__place", "__next"))
    first = chained.where("__place = 0").select(*keys, F.col("parent").alias("node"), F.col("node").alias("child"))
    own = chained.select(*keys, "node", "parent", F.col("__next").alias("sibling"))
    none = F.lit(None).cast(own.schema["node"].dataType)
    tops = first.select(*keys, "node").join(own, [*keys, "node"], "left_anti").withColumns({"parent": none, "sibling": none})
    nodes = own.unionByName(tops).join(first, [*keys, "node"], "left")
    step = lambda node, entering: F.when(node.isNotNull(), F.struct(node.alias("node"), F.lit(entering).alias("entering")))
    enter = F.coalesce(step(F.col("child"), True), step(F.col("node"), False))
    leave = F.coalesce(step(F.col("sibling"), True), step(F.col("parent"), False))
    both = F.array(
        F.struct(F.lit(True).alias("entering"), enter.alias("next"), F.lit(1).cast("long").alias("entered")),
        F.struct(F.lit(False).alias("entering"), leave.alias("next"), F.lit(0).cast("long").alias("entered")),
    )
    # a step that has reached the end knows the root of its tree: the node that it last left
    steps = nodes.select(*keys, "node", F.explode(both).alias("s")).select(
        *keys, "node", "s.entering", "s.next", "s.entered", F.when(F.col("s.next").isNull(), F.col("node")).alias("top")
    )
    state = materialise(steps)
    while not (going := state.where("next IS NOT NULL")).isEmpty():
        ahead = state.select(
            *keys, F.col("node").alias("n_node"), F.col("entering").alias("n_entering"), F.col("next").alias("n_next"), F.col("entered").alias("n_entered"), F.col("top").alias("n_top")
        )
        jumped = going.withColumns({"n_node": F.col("next.node"), "n_entering": F.col("next.entering")}).join(ahead, [*keys, "n_node", "n_entering"])
        onward = jumped.select(*keys, "node", "entering", F.col("n_next").alias("next"), (F.col("entered") + F.col("n_entered")).alias("entered"), F.col("n_top").alias("top"))
        state = materialise(state.where("next IS NULL").unionByName(onward))
    entries = state.where("entering").select(*keys, "node", "top", "entered")
    whole = entries.where("node = top").select(*keys, "top", F.col("entered").alias("__all"))
    return entries.join(whole, [*keys, "top"]).select(*keys, "node", "top", (F.col("__all") - F.col("entered")).alias("place"))


def edit_history(edits: DataFrame) -> DataFrame:
    """Per claim: how many edits, and the latest one."""
    return edits.groupBy(*KEY).agg(
        F.count("*").alias("edits_count"),
        F.max("edit_seq").alias("latest_seq"),
        F.max_by("action", "edit_seq").alias("latest_action"),
        F.max_by("changed_fields", "edit_seq").alias("changed_fields"),
    )


def overlay_jobs(edits: DataFrame) -> DataFrame:
    return edits.select("job_id").distinct()


def effective_source(jobs: DataFrame, edits: DataFrame) -> DataFrame:
    """Which claim table counts for each job: the edited one where edits exist."""
    return jobs.join(overlay_jobs(edits).withColumn("has_overlay", F.lit(True)), "job_id", "left").withColumn(
        "claims_source", F.when(F.col("has_overlay"), "style_claims_current").otherwise("style_claims")
    ).drop("has_overlay")


def blocked_jobs(requested: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs that may be extracted again, and those an overlay protects."""
    overlay = overlay_jobs(edits)
    return requested.join(overlay, "job_id", "left_anti"), requested.join(overlay, "job_id", "left_semi")


def validate_updates(requests: DataFrame, effective: DataFrame, jobs: DataFrame) -> DataFrame:
    """Update requests (job_id, claim_id, updates map<field, array<text>>) applied, with the error if refused.

    Texts come as one-element arrays. Adds ``previous`` and ``updated`` claim structs and ``error``."""
    joined = requests.join(effective.select(*KEY, F.col("claim").alias("previous")), KEY, "left").join(
        jobs.select("job_id", F.col("status").alias("job_status")), "job_id", "left"
    )
    has = lambda f: F.array_contains(F.map_keys("updates"), f)
    value = lambda f: F.try_element_at("updates", F.lit(f))

    def new(f: str) -> Column:
        fresh = tx.clean_list(value(f)) if f in fx.CLAIM_LIST_FIELDS else tx.squash(F.get(value(f), 0))
        return F.when(has(f), fresh).otherwise(F.col(f"previous.{f}")).alias(f)

    updated = F.struct(F.col("previous.claim_id").alias("claim_id"), *[new(f) for f in fx.CLAIM_EDITABLE_FIELDS])
    unknown = F.size(F.array_except(F.map_keys("updates"), F.array(*[F.lit(f) for f in fx.CLAIM_EDITABLE_FIELDS]))) > 0
    u = F.col("updated")
    empty = None
    for f in fx.CLAIM_TEXT_FIELDS:
        empty = (u[f] == "") if empty is None else empty | (u[f] == "")
    error = (
        F.when(F.col("job_status").isNull(), "job_not_found")
        .when(F.col("job_status") != "completed", "job_not_completed")
        .when(F.col("previous").isNull(), "claim_not_found")
        .when(unknown, "unsupported_claim_fields")
        .when(~u["claim_type"].isin(fx.CLAIM_TYPES), "bad_claim_type")
        .when(~u["confidence"].isin(fx.CONFIDENCE_LEVELS), "bad_claim_confidence")
        .when(empty, "empty_claim_field")
    )
    return joined.withColumn("updated", updated).withColumn("error", error)


def field_changes(validated: DataFrame) -> DataFrame:
    """Fields that really change: one row each with the text before and after."""
    as_text = lambda side, f: F.array_join(F.col(f"{side}.{f}"), "\n") if f in fx.CLAIM_LIST_FIELDS else F.col(f"{side}.{f}")
    entries = F.array(
        *[F.struct(F.lit(f).alias("field"), as_text("previous", f).alias("before"), as_text("updated", f).alias("after")) for f in fx.CLAIM_EDITABLE_FIELDS]
    )
    rows = validated.where("error IS NULL").select(*KEY, F.explode(entries).alias("e")).select(*KEY, "e.*")
    return rows.where(~F.col("before").eqNullSafe(F.col("after")))


def edit_records(validated: DataFrame, edited_at: Column) -> DataFrame:
    """Edit log rows of the accepted requests that change something; the identifier is a short content hash."""
    changes = field_changes(validated).groupBy(*KEY).agg(F.array_sort(F.collect_list("field")).alias("changed_fields"))
    content = F.to_json(F.struct(F.col("claim_id"), edited_at.alias("edited_at"), F.col("job_id"), F.col("updated").alias("updated_claim")))
    return validated.where("error IS NULL").join(changes, KEY).select(
        *KEY, F.concat(F.lit("manual_claim_edit_"), short_hash(content)).alias("edit_id"), F.lit("update").alias("action"), "changed_fields", "updated"
    )


def review_summary(jobs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Latest human review per job; without one the job is not reviewed."""
    row = F.struct("human_reviewed", "reviewed_at", "reviewed_by")
    latest = reviews.groupBy("job_id").agg(F.max_by(row, "updated_at").alias("r"), F.max("updated_at").alias("updated_at"))
    return jobs.join(latest, "job_id", "left").select(
        *jobs.columns, F.coalesce("r.human_reviewed", F.lit(False)).alias("human_reviewed"), "r.reviewed_at", "r.reviewed_by", F.col("updated_at").alias("review_updated_at")
    )


def surface_drift(effective: DataFrame, exported: DataFrame, pos: str, row: Column) -> DataFrame:
    """Jobs whose exported table differs from the effective one, by ordered fingerprint and row count."""
    a = fingerprint(effective, ["job_id"], pos, row).select("job_id", F.col("fingerprint").alias("f_effective"), F.col("rows").alias("effective_rows"))
    b = fingerprint(exported, ["job_id"], pos, row).select("job_id", F.col("fingerprint").alias("f_exported"), F.col("rows").alias("exported_rows"))
    return a.join(b, "job_id", "full_outer").select(
        "job_id", "effective_rows", "exported_rows",
        F.when(F.col("f_exported").isNull(), "missing").when(F.col("f_effective").eqNullSafe(F.col("f_exported")), "current").otherwise("refresh").alias("surface"),
    )


def drift_blocks(effective: DataFrame, exported: DataFrame, pos: str, row: Column, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """Where an export differs from the effective table: job_id, from_pos, to_pos, and the rows of each side there."""
    found = differing_leaves(effective, exported, ["job_id"], pos, row, leaf, fan)
    return found.select("job_id", "from_pos", "to_pos", F.col("left_rows").alias("effective_rows"), F.col("right_rows").alias("exported_rows"))


def refresh_results(surfaces: DataFrame) -> DataFrame:
    """What a refresh of the existing claim surfaces of each job does, as flags, and what stays stale.

    ``surfaces``: job_id, has_export, has_manifest, rows_differ, manifest_differs, has_notes, notes_changed, stale_notes
    (notes to remove), lock_pid (of a process that runs the job, else null), report_differs, report_older (than the
    claims or its stage's end). Nothing is written for a surface that a job doesn't have, and a manifest is not invented."""
    jsonl = F.col("has_export") & F.col("has_manifest")
    free, due = F.col("lock_pid").isNull(), F.col("report_differs") | F.col("report_older")
    locked = F.concat(F.lit("ValueError: job is locked by running pipeline process pid="), F.col("lock_pid"))
    flags = surfaces.select(
        "job_id",
        (~F.col("has_export")).alias("jsonl_skipped"),
        (jsonl & F.col("rows_differ")).alias("jsonl_refreshed"),
        (jsonl & F.col("manifest_differs")).alias("manifest_refreshed"),
        F.when(F.col("has_export") & ~F.col("has_manifest"), "missing JSONL manifest").alias("jsonl_error"),
        (~F.col("has_notes")).alias("obsidian_skipped"),
        (F.col("has_notes") & (F.col("notes_changed") | (F.col("stale_notes") > 0))).alias("obsidian_refreshed"),
        F.when(F.col("has_notes"), F.col("stale_notes")).otherwise(0).cast("long").alias("stale_obsidian_notes_removed"),
        (free & ~due).alias("quality_report_skipped"),
        (free & due).alias("quality_report_refreshed"),
        F.when(~free, locked).alias("quality_report_error"),
    )
    stale = F.array_compact(F.array(F.when(F.col("jsonl_error").isNotNull(), "exports/jsonl"), F.when(F.col("quality_report_error").isNotNull(), "reports/quality_report.json")))
    return flags.withColumns({"has_errors": F.size(stale) > 0, "stale": stale})


def refresh_summary(jobs: DataFrame, drift: DataFrame) -> DataFrame:
    """Counters of a fleet refresh: jobs seen, skipped for not being completed, refreshed, up to date."""
    j = jobs.join(drift.select("job_id", "surface"), "job_id", "left")
    done = F.col("status") == "completed"
    return j.agg(
        F.count("*").alias("jobs_seen"),
        F.count_if(~done).alias("jobs_skipped"),
        F.count_if(done & (F.col("surface") == "refresh")).alias("jobs_refreshed"),
        F.count_if(done & (F.col("surface") == "current")).alias("jobs_current"),
        F.count_if(done & (F.col("surface").isNull() | (F.col("surface") == "missing"))).alias("jobs_without_export"),
    )
