"""Planning, validating and materialising retrieval chunks out of segments and timeline events.

Segments carry (video_id, seg, segment_id, start_ms, end_ms, words, text, speaker, speaker_role) with
``seg`` dense from 0; plan items carry (video_id, chunk_index, speech_segment_ids, title,
boundary_reason, topics, notes) with ``chunk_index`` from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom import fixed_values as fx
from talkloom.config import DEFAULTS, ChunkLimits
from talkloom.functions import markers as mk
from talkloom.functions import text as tx
from talkloom.functions import times as tm
from talkloom.functions.markers import DEFAULT_RULES, MarkerRules
from talkloom.operators import sequence as seq
from talkloom.operators.intervals import overlap_join
from talkloom.operators.timeline import source_ref
from talkloom.operators.visual import marker_hits

VIDEO = ["video_id"]
ITEM = ["video_id", "chunk_index"]


# --- questions and answers -------------------------------------------------------------------


def mark_questions(segments: DataFrame, limits: ChunkLimits = DEFAULTS.chunk) -> DataFrame:
    """Adds ``asks_next``: an off-screen question answered by the host in the next segment, soon enough."""
    ahead = seq.neighbour_window(
        segments, VIDEO, "seg",
        lambda w: {"__next_role": F.lead("speaker_role").over(w), "__next_start": F.lead("start_ms").over(w)}, back=0,
    )
    gap = F.greatest(F.lit(0), F.col("__next_start") - F.col("end_ms"))
    asks = (F.col("speaker_role") == fx.QUESTIONER) & (F.col("__next_role") == fx.HOST) & (gap <= limits.qa_gap_ms)
    return ahead.withColumn("asks_next", F.coalesce(asks, F.lit(False))).drop("__next_role", "__next_start")


def _next_window(limits: ChunkLimits):
    size = limits.window_segments

    def next_start(cols: dict[str, list], i: int, n: int) -> int:
        j = i + size
        if j >= n:
            return -1
        if not cols["asks_next"][j - 1]:
            return j
        return j - 1 if j - i > 1 else min(j + 1, n)

    return next_start


def planner_windows(segments: DataFrame, limits: ChunkLimits = DEFAULTS.chunk, *, block: int = seq.GREEDY_BLOCK) -> DataFrame:
    """Consecutive windows of segments that never end between a question and its answer, with context on both sides."""
    marked = mark_questions(segments.select("video_id", "seg", "speaker_role", "start_ms", "end_ms"), limits)
    grouped = seq.bounded_greedy(
        marked, VIDEO, "seg", ["asks_next"], _next_window(limits), reach=limits.window_segments + 2, block=block
    )
    counts = segments.groupBy("video_id").agg(F.max("seg").alias("last"))
    windows = grouped.groupBy("video_id", "group").agg(F.min("seg").alias("first_seg"), F.max("seg").alias("last_seg"))
    k = limits.context_segments
    return windows.join(counts, "video_id").select(
        "video_id",
        (F.col("group") + 1).alias("window_index"),
        "first_seg", "last_seg",
        F.greatest(F.lit(0), F.col("first_seg") - k).cast("long").alias("context_first"),
        F.least(F.col("last"), F.col("last_seg") + k).alias("context_last"),
    )


def segment_payloads(segments: DataFrame, events: DataFrame, rules: MarkerRules = DEFAULT_RULES) -> DataFrame:
    """Segments as planner rows, with the timeline events they overlap as hints."""
    e = events.select(
        "video_id", "event_id", F.col("start_ms").alias("ev_start"), F.col("end_ms").alias("ev_end"),
        tx.join_paragraphs(
            mk.safe_text(F.col("visual_summary"), rules),
            F.array_join(mk.safe_list(F.col("items"), rules), "; "),
            F.array_join(mk.safe_list(F.col("topics"), rules), "; "),
            F.array_join(mk.safe_list(F.col("on_screen_text"), rules), "; "),
        ).alias("evidence"),
    )
    s = segments.select("video_id", "seg", "start_ms", "end_ms")
    pairs = overlap_join(s, e, VIDEO, ("start_ms", "end_ms"), ("ev_start", "ev_end"))
    hints = pairs.groupBy("video_id", "seg").agg(
        F.array_sort(F.collect_list(F.struct("ev_start", "ev_end", "event_id", "evidence"))).alias("hints")
    )
    payload = F.to_json(
        F.struct(
            "segment_id", tm.to_seconds(F.col("start_ms")).alias("start"), tm.to_seconds(F.col("end_ms")).alias("end"), "speaker_role", "text", "hints"
        )
    )
    return segments.join(hints, ["video_id", "seg"], "left").select(
        "video_id", "seg", "segment_id",
        F.coalesce(F.transform("hints", lambda h: h["event_id"]), F.array().cast("array<string>")).alias("event_ids"),
        payload.alias("payload"),
    )


# --- plans -----------------------------------------------------------------------------------


def _next_chunk(limits: ChunkLimits):
    max_segments, max_words = limits.max_segments, limits.max_words

    def next_start(cols: dict[str, list], i: int, n: int) -> int:
        words, asks = cols["words"], cols["asks_next"]
        total, j = words[i], i + 1
        while j < n and j - i < max_segments and total + words[j] <= max_words:
            total += words[j]
            j += 1
        if j >= n:
            return -1
        return j - 1 if asks[j - 1] and j - 1 > i else j

    return next_start


def propose_plan(segments: DataFrame, limits: ChunkLimits = DEFAULTS.chunk, *, block: int = seq.GREEDY_BLOCK) -> DataFrame:
    """Deterministic plan: consecutive segments packed up to the limits, a question kept with its answer."""
    marked = mark_questions(segments.select("video_id", "seg", "speaker_role", "start_ms", "end_ms", "words"), limits)
    grouped = seq.bounded_greedy(
        marked, VIDEO, "seg", ["words", "asks_next"], _next_chunk(limits), reach=limits.max_segments + 1, block=block
    )
    row = F.struct("seg", "segment_id", "text", "speaker_role")
    items = segments.join(grouped, ["video_id", "seg"]).groupBy("video_id", "group").agg(
        F.array_sort(F.collect_list(row)).alias("s"), F.sum("words").alias("words")
    )
    return items.select(
        "video_id",
        (F.col("group") + 1).alias("chunk_index"),
        F.transform("s", lambda x: x["segment_id"]).alias("speech_segment_ids"),
        tx.clip_words(tx.squash(F.get("s", 0)["text"]), limits.title_chars).alias("title"),
        F.lit("packed to limits").alias("boundary_reason"),
        tx.unique_in_order(F.transform("s", lambda x: x["speaker_role"])).alias("topics"),
        F.lit("").alias("notes"),
    )


def plan_items(responses: DataFrame, limits: ChunkLimits = DEFAULTS.chunk) -> DataFrame:
    """Plan items out of planner responses (video_id, window_index, body), one response per planner window:
    squashed, clipped, topics lower-case and unique, numbered through the windows of a video."""
    schema = "chunks array<struct<speech_segment_ids:array<string>,title:string,boundary_reason:string,topics:array<string>,notes:string>>"
    rows = responses.select("video_id", "window_index", F.posexplode(F.from_json("body", schema)["chunks"]).alias("i", "c"))
    numbered = seq.dense_position(rows.withColumn("window_index", F.col("window_index").cast("long")), VIDEO, "window_index", "k", ties=["i"])
    return numbered.select(
        "video_id",
        (F.col("k") + 1).alias("chunk_index"),
        F.coalesce(F.col("c.speech_segment_ids"), F.array().cast("array<string>")).alias("speech_segment_ids"),
        tx.clip_words(tx.squash("c.title"), limits.title_chars).alias("title"),
        tx.clip_words(tx.squash("c.boundary_reason"), limits.boundary_reason_chars).alias("boundary_reason"),
        tx.unique_in_order(F.transform(F.coalesce("c.topics", F.array().cast("array<string>")), lambda t: F.lower(tx.squash(t)))).alias("topics"),
        tx.clip_words(tx.squash("c.notes"), limits.notes_chars).alias("notes"),
    )


def _item_segments(items: DataFrame, segments: DataFrame) -> DataFrame:
    ids = items.select(*ITEM, F.posexplode("speech_segment_ids").alias("i", "segment_id"))
    known = segments.select("video_id", "segment_id", "seg", "words", "speaker_role", "start_ms", "end_ms")
    return ids.join(known, ["video_id", "segment_id"], "left")


def item_facts(items: DataFrame, segments: DataFrame) -> DataFrame:
    """Per plan item: how its segment ids sit in the segment list, and its word total."""
    step = F.col("seg") - F.col("i")
    return _item_segments(items, segments).groupBy(*ITEM).agg(
        F.count("*").alias("ids"),
        F.count_distinct("segment_id").alias("distinct_ids"),
        F.count_if(F.col("seg").isNull()).alias("unknown_ids"),
        F.min("seg").alias("first_seg"),
        F.max("seg").alias("last_seg"),
        (F.min(step) == F.max(step)).alias("contiguous"),
        F.coalesce(F.sum("words"), F.lit(0)).alias("words"),
    )


ERROR_CLASSES = {
    "segment_ids": ["no_segment_ids", "duplicated_segment_ids"],
    "chunk_limits": ["too_many_segments", "too_many_words"],
    "metadata": [
        "empty_title", "long_title", "empty_boundary_reason", "long_boundary_reason", "no_topics", "too_many_topics",
        "long_topics", "duplicated_topics", "long_notes",
    ],
    "coverage": ["segment_missing", "segment_repeated"],
    "question_answer_split": ["question_answer_split"],
}


def error_class(code: Column) -> Column:
    """Class of a plan error; what fits no class makes the plan as a whole invalid."""
    out = None
    for name, codes in ERROR_CLASSES.items():
        out = F.when(code.isin(codes), name) if out is None else out.when(code.isin(codes), name)
    return out.otherwise("invalid_plan")


def error_field(code: Column) -> Column:
    return (
        F.when(code.isin("no_segment_ids", "duplicated_segment_ids", "unknown_segment_ids", "not_contiguous"), "speech_segment_ids")
        .when(F.contains(code, F.lit("title")), "title")
        .when(F.contains(code, F.lit("boundary_reason")), "boundary_reason")
        .when(F.contains(code, F.lit("topics")), "topics")
        .when(F.contains(code, F.lit("notes")), "notes")
        .when(code.isin("segment_missing", "segment_repeated"), "coverage")
        .otherwise("chunk_plan")
    )


def plan_errors(items: DataFrame, segments: DataFrame, limits: ChunkLimits = DEFAULTS.chunk) -> DataFrame:
    """All errors of a plan: (video_id, chunk_index, segment_id, code, error_class, field)."""
    facts = items.join(item_facts(items, segments), ITEM, "left")
    numbered = seq.neighbour_window(
        facts, VIDEO, "chunk_index", lambda w: {"prev_index": F.lag("chunk_index").over(w)}, ahead=0, dense=False
    )
    no_ids = F.coalesce("ids", F.lit(0)) == 0
    known = ~no_ids & (F.col("unknown_ids") == 0)
    topics = F.col("topics")
    codes = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("prev_index"), F.lit(0)) + 1 != F.col("chunk_index"), "chunk_index_mismatch"),
            F.when(no_ids, "no_segment_ids"),
            F.when(~no_ids & (F.col("distinct_ids") < F.col("ids")), "duplicated_segment_ids"),
            F.when(~no_ids & (F.col("unknown_ids") > 0), "unknown_segment_ids"),
            F.when(known & ~F.col("contiguous"), "not_contiguous"),
            F.when(known & (F.col("ids") > limits.max_segments), "too_many_segments"),
            F.when(known & (F.col("words") > limits.max_words), "too_many_words"),
            F.when(known & (F.trim("title") == ""), "empty_title"),
            F.when(known & (F.length("title") > limits.title_chars), "long_title"),
            F.when(known & (F.trim("boundary_reason") == ""), "empty_boundary_reason"),
            F.when(known & (F.length("boundary_reason") > limits.boundary_reason_chars), "long_boundary_reason"),
            F.when(known & (F.size(topics) == 0), "no_topics"),
            F.when(known & (F.size(topics) > limits.max_topics), "too_many_topics"),
            F.when(known & F.exists(topics, lambda t: F.length(t) > limits.topic_chars), "long_topics"),
            F.when(known & (F.size(F.array_distinct(topics)) < F.size(topics)), "duplicated_topics"),
            F.when(known & (F.length("notes") > limits.notes_chars), "long_notes"),
        )
    )
    none = F.lit(None).cast("string")
    per_item = numbered.select(*ITEM, none.alias("segment_id"), F.explode(codes).alias("code"))
    seen = (
        _item_segments(items, segments)
        .join(facts.where(known).select(*ITEM), ITEM, "left_semi")
        .groupBy("video_id", "segment_id")
        .agg(F.count("*").alias("n"))
    )
    no_item = F.lit(None).cast("long")
    missing = segments.join(seen, ["video_id", "segment_id"], "left_anti").select(
        "video_id", no_item.alias("chunk_index"), "segment_id", F.lit("segment_missing").alias("code")
    )
    repeated = seen.where("n > 1").select(
        "video_id", no_item.alias("chunk_index"), "segment_id", F.lit("segment_repeated").alias("code")
    )
    split = qa_boundaries(items, segments, limits).where("mergeable").select(
        "video_id", F.col("left_index").alias("chunk_index"), none.alias("segment_id"), F.lit("question_answer_split").alias("code")
    )
    every = per_item.unionByName(missing).unionByName(repeated).unionByName(split)
    return every.withColumn("error_class", error_class(F.col("code"))).withColumn("field", error_field(F.col("code")))


# --- question and answer split across items ----------------------------------------------------


def qa_boundaries(items: DataFrame, segments: DataFrame, limits: ChunkLimits = DEFAULTS.chunk) -> DataFrame:
    """Neighbouring items that part a question from its answer, and what merging them would come to."""
    ends = _item_segments(items, segments).groupBy(*ITEM).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("words"), F.lit(0)).alias("words"),
        F.max_by(F.struct("seg", "segment_id", "speaker_role", "end_ms"), "i").alias("last"),
        F.min_by(F.struct("seg", "segment_id", "speaker_role", "start_ms"), "i").alias("first"),
    )
    pairs = seq.neighbour_window(
        ends, VIDEO, "chunk_index",
        lambda w: {
            "right_index": F.lead("chunk_index").over(w), "right_n": F.lead("n").over(w),
            "right_words": F.lead("words").over(w), "right": F.lead("first").over(w),
        },
        back=0,
        dense=False,
    )
    gap = F.greatest(F.lit(0), F.col("right.start_ms") - F.col("last.end_ms"))
    split = (
        (F.col("right.seg") == F.col("last.seg") + 1)
        & (F.col("last.speaker_role") == fx.QUESTIONER)
        & (F.col("right.speaker_role") == fx.HOST)
        & (gap <= limits.qa_gap_ms)
    )
    merged_n, merged_words = F.col("n") + F.col("right_n"), F.col("words") + F.col("right_words")
    violations = F.array_compact(
        F.array(
            F.when(merged_n > limits.max_segments, F.concat(F.lit("max_speech_segments_per_chunk "), merged_n, F.lit(f">{limits.max_segments}"))),
            F.when(merged_words > limits.max_words, F.concat(F.lit("max_words "), merged_words, F.lit(f">{limits.max_words}"))),
        )
    )
    return pairs.where(split).select(
        "video_id",
        F.col("chunk_index").alias("left_index"),
        "right_index",
        F.col("last.segment_id").alias("question_segment_id"),
        F.col("right.segment_id").alias("answer_segment_id"),
        gap.alias("gap_ms"),
        merged_n.alias("merged_segments"),
        merged_words.alias("merged_words"),
        violations.alias("limit_violations"),
        (F.size(violations) == 0).alias("mergeable"),
    )


def _next_merge(limits: ChunkLimits):
    max_segments, max_words = limits.max_segments, limits.max_words

    def next_start(cols: dict[str, list], i: int, n: int) -> int:
        count, words, split = cols["ids"], cols["words"], cols["splits_next"]
        total, size = words[i], count[i]
        for j in range(i + 1, n):
            total, size = total + words[j], size + count[j]
            if not split[j - 1] or size > max_segments or total > max_words:
                return j
        return -1

    return next_start


def merge_qa_splits(items: DataFrame, segments: DataFrame, limits: ChunkLimits = DEFAULTS.chunk, *, block: int = seq.GREEDY_BLOCK) -> DataFrame:
    """Left fold over items that joins neighbours parting a question from its answer while limits hold.

    A merged item holds at most ``max_segments`` segments, so its fold is over a short array."""
    facts = item_facts(items, segments).select(*ITEM, "ids", "words")
    splits = qa_boundaries(items, segments, limits).select("video_id", F.col("left_index").alias("chunk_index"), F.lit(True).alias("splits_next"))
    rows = (
        facts.join(splits, ITEM, "left")
        .withColumn("splits_next", F.coalesce("splits_next", F.lit(False)))
        .withColumn("k", F.col("chunk_index") - 1)
    )
    grouped = seq.bounded_greedy(rows, VIDEO, "k", ["ids", "words", "splits_next"], _next_merge(limits), reach=limits.max_segments + 2, block=block)
    fields = ["speech_segment_ids", "title", "boundary_reason", "topics", "notes"]
    gathered = (
        items.withColumn("k", F.col("chunk_index") - 1)
        .join(grouped, ["video_id", "k"])
        .groupBy("video_id", "group")
        .agg(F.array_sort(F.collect_list(F.struct("k", *fields))).alias("parts"))
    )

    def as_item(x: Column) -> Column:
        return F.struct(*[x[f].alias(f) for f in fields])

    def fuse(left: Column, right: Column) -> Column:
        reasons = F.concat(F.lit(fx.MERGED_BOUNDARY_NOTE), left["boundary_reason"], F.lit("; "), right["boundary_reason"])
        notes = tx.join_paragraphs(left["notes"], right["notes"], reasons, F.lit(fx.MERGED_NOTE))
        return F.struct(
            F.concat(left["speech_segment_ids"], right["speech_segment_ids"]).alias("speech_segment_ids"),
            tx.clip_words(F.when(left["title"] != "", left["title"]).otherwise(right["title"]), limits.title_chars).alias("title"),
            tx.clip_words(F.lit(fx.MERGED_BOUNDARY_REASON), limits.boundary_reason_chars).alias("boundary_reason"),
            tx.unique_in_order(F.concat(left["topics"], right["topics"])).alias("topics"),
            tx.clip_words(notes, limits.notes_chars).alias("notes"),
        )

    folded = F.aggregate(
        F.slice("parts", 2, F.size("parts")), as_item(F.get("parts", 0)), lambda acc, x: fuse(acc, as_item(x))
    )
    return gathered.select("video_id", (F.col("group") + 1).alias("chunk_index"), folded.alias("f"), F.size("parts").alias("merged_from")).select(
        *ITEM, *[F.col(f"f.{f}").alias(f) for f in fields], "merged_from"
    )


def annotate_qa_warnings(items: DataFrame, boundaries: DataFrame, limits: ChunkLimits = DEFAULTS.chunk) -> DataFrame:
    """Add a note to both items of a split that limits do not allow to merge."""
    note = F.concat(F.lit(fx.QA_SPLIT_NOTE), F.array_join("limit_violations", ", "))
    blocked = boundaries.where("NOT mergeable").select("video_id", "left_index", "right_index", note.alias("note"))
    sides = blocked.select("video_id", F.col("left_index").alias("chunk_index"), "left_index", "note").unionByName(
        blocked.select("video_id", F.col("right_index").alias("chunk_index"), "left_index", "note")
    )
    per_item = sides.groupBy(*ITEM).agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("left_index", "note"))), lambda x: x["note"])).alias("added")
    )
    paragraphs = F.array_join(F.filter(F.concat(F.array(tx.strip("notes")), "added"), lambda s: s != ""), "\n\n")
    return items.join(per_item, ITEM, "left").withColumn(
        "notes", F.when(F.col("added").isNotNull(), tx.clip_words(paragraphs, limits.notes_chars)).otherwise(F.col("notes"))
    ).drop("added")


# --- chunk rows --------------------------------------------------------------------------------


def chunk_spans(items: DataFrame, segments: DataFrame) -> DataFrame:
    return _item_segments(items, segments).groupBy(*ITEM).agg(
        F.min_by("start_ms", "i").alias("start_ms"), F.max_by("end_ms", "i").alias("end_ms")
    )


def attach_events(spans: DataFrame, events: DataFrame, limits: ChunkLimits = DEFAULTS.chunk) -> DataFrame:
    """Events of each chunk: those overlapping it or, for a chunk with none, all within the attach distance."""
    e = events.select("video_id", "event_id", F.col("start_ms").alias("ev_start"), F.col("end_ms").alias("ev_end"))
    touching = overlap_join(spans, e, VIDEO, ("start_ms", "end_ms"), ("ev_start", "ev_end")).withColumn("distance_ms", F.lit(0).cast("long"))
    lonely = spans.join(touching, ITEM, "left_anti")
    reach = limits.attach_ms + 1
    wide = lonely.withColumns({"near_start": F.col("start_ms") - reach, "near_end": F.col("end_ms") + reach})
    distance = F.greatest(F.lit(0), F.col("start_ms") - F.col("ev_end"), F.col("ev_start") - F.col("end_ms"))
    near = (
        overlap_join(wide, e, VIDEO, ("near_start", "near_end"), ("ev_start", "ev_end"))
        .withColumn("distance_ms", distance)
        .where(F.col("distance_ms") <= limits.attach_ms)
        .drop("near_start", "near_end")
    )
    return touching.unionByName(near)


def missing_evidence(spans: DataFrame, attached: DataFrame) -> DataFrame:
    return spans.join(attached, ITEM, "left_anti").select(*ITEM)


def dialogue_text(parts: Column) -> Column:
    """Lines "Label: text" for runs of one (role, speaker) over an ordered array of a chunk's segments.

    The speaker is named only where several speakers of the chunk share the role."""
    named = lambda s: s["speaker_role"].isNotNull() & (F.coalesce(s["speaker"], F.lit("")) != "")

    def label(s: Column) -> Column:
        same_role = F.filter(parts, lambda o: named(o) & (o["speaker_role"] == s["speaker_role"]))
        several = F.size(F.array_distinct(F.transform(same_role, lambda o: o["speaker"]))) > 1
        host = F.when(several & named(s), F.concat(F.lit(fx.HOST_LABEL + " ("), s["speaker"], F.lit(")"))).otherwise(fx.HOST_LABEL)
        asker = F.when(several & named(s), F.concat(F.lit(fx.QUESTIONER_LABEL + " ("), s["speaker"], F.lit(")"))).otherwise(fx.QUESTIONER_LABEL)
        unknown = F.coalesce(F.nullif(s["speaker"], F.lit("")), F.lit(fx.UNKNOWN_VOICE_LABEL))
        return F.when(s["speaker_role"] == fx.HOST, host).when(s["speaker_role"] == fx.QUESTIONER, asker).otherwise(unknown)

    labelled = F.transform(
        parts,
        lambda s: F.struct(
            F.concat_ws("\u0001", F.coalesce(s["speaker_role"], F.lit("")), F.coalesce(s["speaker"], F.lit(""))).alias("who"),
            label(s).alias("label"),
            F.coalesce(s["text"], F.lit("")).alias("text"),
        ),
    )
    runs = F.aggregate(
        labelled,
        F.array().cast("array<struct<who:string,label:string,text:string>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["who"] == s["who"]),
            F.concat(
                F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        s["who"].alias("who"),
                        s["label"].alias("label"),
                        F.trim(F.concat_ws(" ", F.get(acc, F.size(acc) - 1)["text"], F.nullif(s["text"], F.lit("")))).alias("text"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_join(
        F.transform(F.filter(runs, lambda r: F.trim(r["text"]) != ""), lambda r: F.concat(r["label"], F.lit(": "), F.trim(r["text"]))), "\n"
    )


def materialise_chunks(
    items: DataFrame,
    segments: DataFrame,
    events: DataFrame,
    limits: ChunkLimits = DEFAULTS.chunk,
    rules: MarkerRules = DEFAULT_RULES,
    visual: bool = True,
) -> DataFrame:
    """Chunk rows of a valid plan: speech, dialogue, cleaned visual text, topics, entities, references."""
    parts = items.select(*ITEM, F.posexplode("speech_segment_ids").alias("i", "segment_id")).join(
        segments.select("video_id", "segment_id", "start_ms", "end_ms", "text", "speaker", "speaker_role"), ["video_id", "segment_id"]
    )
    spoken = parts.groupBy(*ITEM).agg(
        F.array_sort(F.collect_list(F.struct("i", "start_ms", "end_ms", "text", "speaker", "speaker_role"))).alias("parts")
    ).withColumns({"start_ms": F.get("parts", 0)["start_ms"], "end_ms": F.element_at("parts", -1)["end_ms"]})
    attached = attach_events(spoken.select(*ITEM, "start_ms", "end_ms"), events, limits).select(*ITEM, "event_id", "ev_start", "ev_end")
    briefs = F.col("presenter_context.relevance").isin("brief", "primary_example") & (F.coalesce("presenter_context.narrative_brief", F.lit("")) != "")
    safe = events.select(
        "video_id", "event_id",
        mk.safe_text(F.col("visual_summary"), rules).alias("summary"),
        mk.safe_list(F.col("on_screen_text"), rules).alias("screen"),
        mk.safe_list(F.col("items"), rules).alias("things"),
        mk.safe_list(F.col("topics"), rules).alias("subjects"),
        F.when(briefs, F.col("presenter_context.narrative_brief")).otherwise("").alias("brief"),
    )
    gathered = attached.join(safe, ["video_id", "event_id"]).groupBy(*ITEM).agg(
        F.array_sort(F.collect_list(F.struct("ev_start", "ev_end", "event_id", "summary", "screen", "things", "subjects", "brief"))).alias("ev")
    )
    each = lambda name: F.transform("ev", lambda e: e[name])
    every = lambda name: F.flatten(each(name))
    raw_visual = tx.join_paragraphs(
        F.array_join(F.filter(each("summary"), lambda s: s != ""), " "),
        F.array_join(every("screen"), "\n"),
        F.array_join(F.flatten(F.transform("ev", lambda e: F.concat(e["things"], e["subjects"]))), "; "),
    )
    speech = F.trim(F.array_join(F.filter(F.transform("parts", lambda p: p["text"]), lambda t: t != ""), " "))
    ref = source_ref("youtube", F.col("video_id"), F.col("start_ms"), F.col("end_ms"), "audio")
    event_refs = F.transform("ev", lambda e: source_ref("visual", F.col("video_id"), e["ev_start"], e["ev_end"], "visual"))
    base = (
        items.join(spoken, ITEM)
        .join(gathered, ITEM)
        .withColumn("raw_visual", raw_visual)
        .withColumn("speech_text", speech)
        .withColumn("dialogue_text", dialogue_text(F.col("parts")))
        .withColumn("on_screen_text", F.array_distinct(every("screen")))
        .withColumn("presenter_brief", mk.safe_text(F.array_join(tx.unique_in_order(each("brief")), " "), rules))
        .withColumn("visual_text", mk.safe_text(F.col("raw_visual"), rules))
    )
    has_visual = (F.col("raw_visual") != "") | (F.size("on_screen_text") > 0)
    lead = F.when(F.col("dialogue_text") != "", F.col("dialogue_text")).otherwise(F.col("speech_text"))
    return base.select(
        *ITEM,
        tm.span_id(F.col("video_id"), "c", F.col("start_ms"), F.col("end_ms")).alias("chunk_id"),
        "speech_segment_ids",
        F.col("title").alias("chunk_title"),
        "boundary_reason", "start_ms", "end_ms",
        tm.timestamp_url(F.col("video_id"), F.col("start_ms")).alias("timestamp_url"),
        "speech_text", "dialogue_text", "presenter_brief", "visual_text",
        tx.join_paragraphs(lead, F.col("presenter_brief"), F.col("visual_text")).alias("combined_text"),
        "on_screen_text",
        mk.safe_list(F.concat("topics", every("subjects")), rules).alias("topics"),
        F.array_distinct(every("things")).alias("entities"),
        F.array_compact(F.array(F.when(F.col("speech_text") != "", "audio"), F.when(has_visual, "visual"))).alias("modality"),
        tx.unique_in_order(F.transform("parts", lambda p: p["speaker_role"])).alias("speaker_roles"),
        each("event_id").alias("timeline_event_ids"),
        F.array_distinct(F.concat(F.array(ref), event_refs) if visual else F.array(ref)).alias("source_refs"),
    )


def contamination(chunks: DataFrame, rules: MarkerRules = DEFAULT_RULES) -> DataFrame:
    """Markers left in the visual parts of chunks: (video_id, chunk_id, field, marker)."""
    own_part = chunks.drop("combined_text").withColumn("combined_text", tx.join_paragraphs(F.col("presenter_brief"), F.col("visual_text")))
    return marker_hits(own_part, ["video_id", "chunk_id"], ["visual_text", "presenter_brief", "topics", "entities", "combined_text"], "noise", rules)


def redundancy(chunks: DataFrame) -> DataFrame:
    """Per chunk: words of the combined text, and how many of them the visual parts repeat."""
    words = lambda c: F.regexp_extract_all(tx.fold_case(c), F.lit(f"({tx.WORD}+)"), F.lit(1))
    source = tx.join_paragraphs(F.col("visual_text"), F.array_join("topics", "\n"), F.array_join("entities", "\n"))
    rows = chunks.select("video_id", "chunk_id", words(F.col("combined_text")).alias("all_words"), F.array_distinct(words(source)).alias("visual_words"))
    return rows.where(F.size("all_words") > 0).select(
        "video_id", "chunk_id",
        F.size("all_words").cast("long").alias("words"),
        F.size(F.filter("all_words", lambda w: F.array_contains("visual_words", w))).cast("long").alias("repeated"),
    )


def redundancy_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    share = F.bround(F.col("repeated") / F.col("words") * 10000).cast("long")
    return rows.groupBy(*by).agg(
        F.sum("words").alias("words_total"),
        F.sum("repeated").alias("repeated_total"),
        F.bround(F.sum("repeated") / F.greatest(F.sum("words"), F.lit(1)) * 10000).cast("long").alias("ratio_bps"),
        F.count_if(F.col("repeated") > 0).alias("chunks_with_redundancy"),
        F.max(share).alias("max_chunk_bps"),
    )
