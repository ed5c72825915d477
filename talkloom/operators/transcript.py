"""Tokens, speaker roles, transcript units and speech segments.

Token tables carry (video_id, pos, text, start_ms, end_ms, speaker[, speaker_role, language]) with
``pos`` dense from 0 in each video.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom import fixed_values as fx
from talkloom.config import DEFAULTS, SegmentLimits
from talkloom.functions import text as tx
from talkloom.functions import times as tm
from talkloom.functions.fields import alternative_ms, first_present
from talkloom.operators import sequence as seq
from talkloom.operators.intervals import overlap_join
from talkloom.session import materialise

VIDEO = ["video_id"]
#: Token positions of a bucket in which spans of positions meet.
POSITION_BUCKET = 256


# --- provider tokens and speakers -----------------------------------------------------------


def normalise_tokens(raw: DataFrame) -> DataFrame:
    """Provider token arrays as rows: first non-empty of the alternative text fields, the array
    index kept as token_index, empty tokens dropped, times in milliseconds."""
    t = F.col("t")
    rows = raw.select("video_id", F.posexplode("tokens").alias("token_index", "t"))
    return (
        rows.select(
            "video_id",
            F.col("token_index").cast("long").alias("token_index"),
            first_present(t["text"], t["token"], t["value"]).alias("text"),
            alternative_ms([t["start_ms"]], [t["start"]]).alias("start_ms"),
            alternative_ms([t["end_ms"]], [t["end"]]).alias("end_ms"),
            F.coalesce(t["speaker"], t["speaker_id"]).alias("speaker"),
            F.coalesce(t["language"], t["lang"]).alias("language"),
        )
        .where(F.col("text").isNotNull())
    )


def speaker_profiles(tokens: DataFrame) -> DataFrame:
    """Per speaker: tokens, words of the joined text, speech time, first and last moment, role.

    Words that run across two tokens of one speaker count once, so each block of a video is summed on
    its own and only the block edges are compared afterwards: a hot video never sits in one task.
    """
    spoken = tokens.where(F.coalesce(F.col("speaker"), F.lit("")) != "").select(
        "video_id",
        "speaker",
        "pos",
        "start_ms",
        "end_ms",
        tx.word_count("text").alias("words"),
        (~tx.leads_with_space("text")).alias("open_start"),
        (~F.col("text").rlike(r"(?U)\s$")).alias("open_end"),
        F.when(tx.is_blank("text"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("ms"),
        seq.block_of("pos", seq.WINDOW_BLOCK).alias("block"),
    )
    in_block = Window.partitionBy("video_id", "speaker", "block").orderBy("pos")
    glued = (F.col("open_start") & F.coalesce(F.lag("open_end").over(in_block), F.lit(False))).cast("long")
    blocks = spoken.withColumn("glued", glued).groupBy("video_id", "speaker", "block").agg(
        F.count("*").alias("tokens"),
        (F.sum("words") - F.sum("glued")).alias("words"),
        F.sum("ms").alias("ms"),
        F.min("start_ms").alias("first_start_ms"),
        F.max("end_ms").alias("last_end_ms"),
        F.min("pos").alias("first_pos"),
        F.min_by("open_start", "pos").alias("open_start"),
        F.max_by("open_end", "pos").alias("open_end"),
    )
    across = Window.partitionBy("video_id", "speaker").orderBy("block")
    edge = (F.col("open_start") & F.coalesce(F.lag("open_end").over(across), F.lit(False))).cast("long")
    profiles = blocks.withColumn("edge", edge).groupBy("video_id", "speaker").agg(
        F.sum("tokens").alias("tokens_count"),
        (F.sum("words") - F.sum("edge")).alias("words_count"),
        F.sum("ms").cast("long").alias("speech_ms"),
        F.min("first_start_ms").alias("first_start_ms"),
        F.max("last_end_ms").alias("last_end_ms"),
        F.min("first_pos").alias("first_pos"),
    )
    return assign_roles(profiles)


def assign_roles(profiles: DataFrame) -> DataFrame:
    """The speaker with most speech (then most words, then first heard) is the host."""
    by_speech = Window.partitionBy("video_id").orderBy(F.desc("speech_ms"), F.desc("words_count"), "first_pos")
    is_host = F.row_number().over(by_speech) == 1
    return profiles.withColumn("role", F.when(is_host, fx.HOST).otherwise(fx.QUESTIONER))


def attach_roles(tokens: DataFrame, profiles: DataFrame) -> DataFrame:
    roles = profiles.select("video_id", "speaker", F.col("role").alias("speaker_role"))
    return tokens.drop("speaker_role").join(roles, ["video_id", "speaker"], "left")


def speaker_summary(tokens: DataFrame) -> DataFrame:
    """Detected speakers and tokens without a speaker, per video."""
    named = F.nullif(F.col("speaker"), F.lit(""))
    per_speaker = tokens.groupBy("video_id", named.alias("speaker")).agg(F.count("*").alias("n"))
    return per_speaker.groupBy("video_id").agg(
        F.count("speaker").alias("detected_speakers"),
        F.sum(F.when(F.col("speaker").isNull(), F.col("n")).otherwise(0)).alias("unassigned_tokens_count"),
        F.sum("n").alias("tokens_count"),
    )


def token_stream_violations(tokens: DataFrame, durations: DataFrame, slack_ms: int = 10_000) -> DataFrame:
    """Rows breaking the stream rules: start after end, starts going back, end beyond the audio,
    and videos without any token. ``durations`` has (video_id, audio_ms)."""
    with_prev = seq.neighbour_window(
        tokens.select("video_id", "pos", "start_ms", "end_ms"),
        VIDEO,
        "pos",
        lambda w: {"prev_start": F.lag("start_ms").over(w)},
        ahead=0,
        dense=False,
    )
    codes = F.array_compact(
        F.array(
            F.when(F.col("start_ms") > F.col("end_ms"), "start_after_end"),
            F.when(F.col("start_ms") < F.col("prev_start"), "start_goes_back"),
        )
    )
    per_token = with_prev.where(F.size(codes) > 0).select("video_id", "pos", F.explode(codes).alias("code"))
    last = tokens.groupBy("video_id").agg(F.max_by("end_ms", "pos").alias("last_end"), F.max("pos").alias("pos"))
    beyond = (
        durations.join(last, "video_id", "left")
        .withColumn(
            "code",
            F.when(F.col("pos").isNull(), "empty_stream").when(
                F.col("last_end") > F.col("audio_ms") + slack_ms, "ends_after_audio"
            ),
        )
        .where(F.col("code").isNotNull())
        .select("video_id", F.coalesce("pos", F.lit(-1)).cast("long").alias("pos"), "code")
    )
    return per_token.unionByName(beyond)


def token_table_differences(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Where a stored token table differs from the tokens derived anew, as (video_id, pos, code): tokens that are missing or
    unexpected, and a code for each field that differs. Tokens meet by video and position; a position that the stored
    table has several times is checked each time and reported as repeated."""
    fields = ["text", "start_ms", "end_ms", "language", "speaker", "speaker_role"]
    key = ["video_id", "pos"]
    ours = stored.select(*key, F.struct(*fields).alias("stored"))
    both = ours.join(expected.select(*key, F.struct(*fields).alias("expected")), key, "full_outer")
    there = F.col("stored").isNotNull() & F.col("expected").isNotNull()
    codes = F.array_compact(
        F.array(
            F.when(F.col("stored").isNull(), "token_missing"),
            F.when(F.col("expected").isNull(), "token_unexpected"),
            *[F.when(there & ~F.col(f"stored.{f}").eqNullSafe(F.col(f"expected.{f}")), f"{f}_differs") for f in fields],
        )
    )
    repeated = stored.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.lit("token_repeated").alias("code"))
    return both.select(*key, F.explode(codes).alias("code")).unionByName(repeated)


# --- transcript units ------------------------------------------------------------------------


def boundary_features(tokens: DataFrame, limits: SegmentLimits = DEFAULTS.segment, whole: bool = False) -> DataFrame:
    """Content tokens with what their right-hand boundary looks like.

    ``whole`` says that every video is short enough to lie in one partition, where one sort serves all windows.

    c: dense content position; glued_text: the token with a blank before it where a blank token was
    dropped; starts_word; hard_reason (end, speaker_change, pause, sentence_end or NULL); is_clause;
    is_safe: a unit may end here without cutting a sentence.
    """
    if "language" not in tokens.columns:
        tokens = tokens.withColumn("language", F.lit(None).cast("string"))
    if "speaker_role" not in tokens.columns:
        tokens = tokens.withColumn("speaker_role", F.lit(None).cast("string"))
    marked = tokens.where(~tx.is_blank("text")).withColumns(
        {"end_char": tx.terminal_char("text"), "opens": tx.leads_with_space("text"), "lower": tx.starts_lower("text")}
    )
    k = limits.lookahead_tokens

    def columns(w):
        """Neighbours as few rows, each read once: a window function for every field of every neighbour is what costs."""
        first = F.struct("pos", "text", "start_ms", "speaker", "speaker_role", "opens", "lower")
        further = {f"__next_{i}": F.lead(F.struct("pos", "text"), i).over(w) for i in range(2, k + 1)}
        return {"prev_pos": F.lag("pos").over(w), "__next_1": F.lead(first).over(w), **further}

    if whole:
        order = Window.partitionBy(*VIDEO).orderBy("pos")
        near = marked.withColumns({"c": F.row_number().over(order).cast("long") - 1, **columns(order)})
    else:
        near = seq.neighbour_window(seq.dense_position(marked, VIDEO, "pos", "c"), VIDEO, "c", columns, back=1, ahead=k)

    def following(i):
        apart = F.col(f"__next_{i}.pos") - F.col(f"__next_{max(i - 1, 1)}.pos") > 1
        return F.coalesce(F.concat(F.when(apart, " ").otherwise(""), F.col(f"__next_{i}.text")), F.lit(""))

    next_text = F.concat(*[following(i) for i in range(1, k + 1)])
    after_blank = F.col("pos") - F.col("prev_pos") > 1
    ahead = near.withColumns(
        {
            "next_pos": F.col("__next_1.pos"), "next_start_ms": F.col("__next_1.start_ms"), "next_speaker": F.col("__next_1.speaker"),
            "next_role": F.col("__next_1.speaker_role"), "next_opens": F.col("__next_1.opens"), "next_lower": F.col("__next_1.lower"),
            "glued_text": F.concat(F.when(F.coalesce(after_blank, F.lit(False)), " ").otherwise(""), F.col("text")),
        }
    )
    end_char = F.col("end_char")
    next_starts_word = F.col("next_opens") | (F.col("next_pos") - F.col("pos") > 1)
    both = (F.coalesce("speaker", F.lit("")) != "") & (F.coalesce("next_speaker", F.lit("")) != "")
    hard = (
        F.when(F.col("next_pos").isNull(), "end")
        .when(both & (F.col("speaker") != F.col("next_speaker")), "speaker_change")
        .when(F.greatest(F.lit(0), F.col("next_start_ms") - F.col("end_ms")) >= limits.pause_break_ms, "pause")
        .when(end_char.isin(fx.SENTENCE_END_CHARS), "sentence_end")
    )
    safe = (
        F.when(F.col("next_pos").isNull() | end_char.isin(fx.SENTENCE_END_CHARS), True)
        .when(end_char.isin(fx.NON_TERMINAL_END_CHARS), False)
        .when(~next_starts_word | F.col("next_lower"), False)
        .otherwise(~tx.first_word(next_text).isin(fx.CONTINUATION_WORDS))
    )
    starts_word = (
        F.col("prev_pos").isNull() | F.col("opens") | (F.col("pos") - F.col("prev_pos") > 1)
    )
    return ahead.select(
        "video_id", "pos", "c", "glued_text", "start_ms", "end_ms", "speaker", "speaker_role", "language",
        "next_pos",
        starts_word.alias("starts_word"),
        hard.alias("hard_reason"),
        F.coalesce(end_char.isin(fx.CLAUSE_END_CHARS), F.lit(False)).alias("is_clause"),
        F.coalesce(safe, F.lit(True)).alias("is_safe"),
        (
            ~(F.col("speaker").eqNullSafe(F.col("next_speaker")) & F.col("speaker_role").eqNullSafe(F.col("next_role")))
        ).alias("identity_ends"),
    )


def transcript_atoms(tokens: DataFrame, limits: SegmentLimits = DEFAULTS.segment, *, block: int = seq.WINDOW_BLOCK) -> DataFrame:
    """The smallest pieces a unit is made of: token runs between two places where a unit could end or
    the speaker identity changes. Pre-aggregating to atoms keeps the greedy step narrow.

    Videos shorter than a block are sorted once, whole, for all steps; longer ones go by blocks."""
    longer = materialise(tokens.groupBy(*VIDEO).agg(F.max("pos").alias("last")).where(F.col("last") >= block).select(*VIDEO))
    if longer.isEmpty():
        return _atoms(tokens, limits, True)
    same = lambda how: tokens.join(longer.withColumnRenamed("video_id", "__long"), F.col("video_id").eqNullSafe(F.col("__long")), how)
    return _atoms(same("left_anti"), limits, True).unionByName(_atoms(same("left_semi"), limits, False))


def _atoms(tokens: DataFrame, limits: SegmentLimits, whole: bool) -> DataFrame:
    features = boundary_features(tokens, limits, whole)
    features = features if whole else materialise(features)
    ends_atom = (
        F.col("hard_reason").isNotNull() | F.col("is_clause") | F.col("is_safe") | F.coalesce("identity_ends", F.lit(True))
    )
    marked = features.withColumn("ends_atom", ends_atom.cast("long"))
    sums = {"words_so_far": F.col("starts_word").cast("long"), "atoms_so_far": F.col("ends_atom")}
    if whole:
        so_far = Window.partitionBy(*VIDEO).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        counted = marked.withColumns({n: F.sum(v).over(so_far) for n, v in sums.items()})
    else:
        counted = seq.running(marked, VIDEO, "c", sums=sums)
    last = F.struct("c", "hard_reason", "is_clause", "is_safe", "end_ms", "next_pos", "words_so_far", "pos")
    return (
        counted.withColumn("atom", F.col("atoms_so_far") - F.col("ends_atom"))
        .groupBy("video_id", "atom")
        .agg(
            F.min("pos").alias("start_pos"),
            F.min("c").alias("first_c"),
            F.min_by("start_ms", "c").alias("start_ms"),
            F.min("words_so_far").alias("words_before"),
            F.max(last).alias("last"),
            F.count("*").alias("content_tokens"),
            F.min_by("starts_word", "c").alias("first_starts_word"),
            F.min_by(F.struct("speaker", "speaker_role"), "c").alias("identity"),
            F.min_by("language", "c").alias("language"),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("c", "glued_text"))), lambda x: x["glued_text"]), ""
            ).alias("text"),
        )
        .select(
            "video_id", "atom", "start_pos", "first_c", "start_ms", "words_before", "content_tokens",
            "first_starts_word", "language", "text",
            F.col("identity.speaker").alias("speaker"),
            F.col("identity.speaker_role").alias("speaker_role"),
            F.col("last.hard_reason").alias("hard_reason"),
            F.col("last.is_clause").alias("is_clause"),
            F.col("last.is_safe").alias("is_safe"),
            F.col("last.end_ms").alias("end_ms"),
            F.col("last.next_pos").alias("next_pos"),
            F.col("last.pos").alias("last_pos"),
            F.col("last.words_so_far").alias("words_after"),
        )
    )


def _next_unit(limits: SegmentLimits):
    clause_ms, clause_words = limits.unit_clause_min_ms, limits.unit_clause_min_words
    max_ms, max_words = limits.unit_max_ms, limits.unit_max_words

    def next_start(cols: dict[str, list], i: int, n: int) -> int:
        start, before = cols["start_ms"][i], cols["words_before"][i]
        hard, clause, safe = cols["hard"], cols["is_clause"], cols["is_safe"]
        end, after = cols["end_ms"], cols["words_after"]
        for j in range(i, n):
            if hard[j]:
                return j + 1
            if clause[j] or safe[j]:
                ms, words = end[j] - start, after[j] - before + 1
                if clause[j] and (ms >= clause_ms or words >= clause_words):
                    return j + 1
                if safe[j] and (ms >= max_ms or words >= max_words):
                    return j + 1
        return -1

    return next_start


def transcript_units(
    tokens: DataFrame, limits: SegmentLimits = DEFAULTS.segment, *, block: int = seq.GREEDY_BLOCK, reach: int = 4096
) -> DataFrame:
    """Transcript units: greedy runs of tokens with a boundary reason, mode speaker and language.

    Trailing blank tokens belong to the unit on their left (end_pos reaches to the next content token).
    """
    atoms = materialise(transcript_atoms(tokens, limits).withColumn("hard", F.col("hard_reason").isNotNull()))
    grouped = seq.bounded_greedy(
        atoms,
        VIDEO,
        "atom",
        ["start_ms", "end_ms", "words_before", "words_after", "hard", "is_clause", "is_safe"],
        _next_unit(limits),
        reach=reach,
        block=block,
        stored=True,
    )
    totals = tokens.groupBy("video_id").agg(F.max("pos").alias("video_last_pos"), F.max_by("end_ms", "pos").alias("video_end_ms"))
    first = F.struct("first_c", "start_pos", "start_ms", "words_before", "first_starts_word")
    last = F.struct(
        "first_c", "hard_reason", "is_clause", "is_safe", "end_ms", "next_pos", "last_pos", "words_after"
    )
    by_identity = (
        atoms.join(grouped, ["video_id", "atom"])
        .groupBy("video_id", "group", "speaker", "speaker_role")
        .agg(
            F.sum("content_tokens").alias("n"),
            F.min("first_c").alias("seen"),
            F.min(first).alias("first"),
            F.max(last).alias("last"),
            F.collect_list(F.struct("first_c", "text")).alias("pieces"),
            F.min_by("language", "first_c").alias("language"),
        )
    )
    named = F.when(F.coalesce("speaker", F.lit("")) != "", F.struct(F.col("n"), (-F.col("seen")).alias("s")))
    units = by_identity.groupBy("video_id", "group").agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.max_by(F.struct("speaker", "speaker_role"), named).alias("identity"),
        F.count_if(F.coalesce("speaker", F.lit("")) != "").alias("identities"),
        F.array_join(
            F.transform(F.array_sort(F.flatten(F.collect_list("pieces"))), lambda p: p["text"]), ""
        ).alias("joined"),
        F.min_by("language", "seen").alias("language"),
    )
    words = F.col("last.words_after") - F.col("first.words_before") + 1
    ms = F.col("last.end_ms") - F.col("first.start_ms")
    reason = (
        F.when(F.col("last.hard_reason").isNotNull(), F.col("last.hard_reason"))
        .when(F.col("last.is_clause"), "strong_clause")
        .when(ms >= limits.unit_max_ms, "soft_max_seconds")
        .otherwise("soft_max_words")
    )
    must = reason.isin("end", "speaker_change")
    return units.join(totals, "video_id").select(
        "video_id",
        (F.col("group") + 1).alias("unit_index"),
        F.col("first.start_pos").alias("start_pos"),
        F.coalesce(F.col("last.next_pos") - 1, F.col("video_last_pos")).alias("end_pos"),
        F.col("first.start_ms").alias("start_ms"),
        F.when(F.col("last.next_pos").isNull(), F.col("video_end_ms")).otherwise(F.col("last.end_ms")).alias("end_ms"),
        tx.squash("joined").alias("text"),
        words.alias("word_count"),
        F.when(F.col("identities") > 0, F.col("identity.speaker")).alias("speaker"),
        F.when(F.col("identities") > 0, F.col("identity.speaker_role")).alias("speaker_role"),
        F.col("identities").alias("speakers_seen"),
        "language",
        F.col("first.first_starts_word").alias("first_starts_word"),
        reason.alias("boundary_reason"),
        (must | F.col("last.is_safe")).alias("can_end"),
        must.alias("must_end"),
    )


def unit_reason_histogram(units: DataFrame) -> DataFrame:
    return units.groupBy("boundary_reason").agg(
        F.count("*").alias("units"),
        F.count_if("can_end").alias("can_end_units"),
        F.count_if("must_end").alias("must_end_units"),
    )


def unit_payloads(units: DataFrame) -> DataFrame:
    """Units as the JSON rows a segment proposer is given."""
    seconds = lambda c: tm.to_seconds(F.col(c))
    payload = F.struct(
        F.col("unit_index"),
        seconds("start_ms").alias("start"),
        seconds("end_ms").alias("end"),
        tm.to_seconds(F.col("end_ms") - F.col("start_ms")).alias("duration"),
        "word_count", "speaker", "speaker_role", "boundary_reason",
        F.col("can_end").alias("can_end_segment"),
        F.col("must_end").alias("must_end_segment"),
        "text",
    )
    return units.select("video_id", "unit_index", F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))


# --- speech segments -------------------------------------------------------------------------


def _next_segment(limits: SegmentLimits):
    max_ms, max_words = int(limits.max_seconds * 1000), limits.max_words

    def next_start(cols: dict[str, list], i: int, n: int) -> int:
        start, end, words = cols["start_ms"], cols["end_ms"], cols["word_count"]
        can, must, joined = cols["can_end"], cols["must_end"], cols["first_starts_word"]
        total, cut = 0, -1
        for j in range(i, n):
            total += words[j] - (0 if j == i or joined[j] else 1)
            if j > i and (end[j] - start[i] > max_ms or total > max_words):
                return cut if cut > 0 else j
            if must[j]:
                return j + 1
            if can[j]:
                cut = j + 1
        return -1

    return next_start


def propose_segments(
    units: DataFrame, limits: SegmentLimits = DEFAULTS.segment, *, block: int = seq.GREEDY_BLOCK
) -> DataFrame:
    """Deterministic segment ranges: extend over units until one must end or a limit would break, then
    cut after the last unit allowed to end. Returns (video_id, segment_index, unit_start_index, unit_end_index)."""
    grouped = seq.bounded_greedy(
        units.withColumn("u", F.col("unit_index") - 1),
        VIDEO,
        "u",
        ["start_ms", "end_ms", "word_count", "can_end", "must_end", "first_starts_word"],
        _next_segment(limits),
        reach=limits.max_words + 2,
        block=block,
    )
    return grouped.groupBy("video_id", "group").agg(
        (F.min("u") + 1).alias("unit_start_index"), (F.max("u") + 1).alias("unit_end_index")
    ).select("video_id", (F.col("group") + 1).alias("segment_index"), "unit_start_index", "unit_end_index")


def range_contents(ranges: DataFrame, units: DataFrame) -> DataFrame:
    """What each unit range holds: times, words, sentences, speakers, crossed must-ends, end flags.

    Ranges are cut to the units that exist, exploded to unit indexes and equi-joined, so a long range
    spreads over the cluster; the sums are combined map-side."""
    counts = units.groupBy("video_id").agg(F.max("unit_index").alias("units_count"))
    known = ranges.join(counts, "video_id", "left").withColumn("units_count", F.coalesce("units_count", F.lit(0)))
    valid = (
        (F.col("unit_start_index") >= 1)
        & (F.col("unit_end_index") >= F.col("unit_start_index"))
        & (F.col("unit_end_index") <= F.col("units_count"))
    )
    spread = known.where(valid).withColumn(
        "unit_index", F.explode(F.sequence("unit_start_index", "unit_end_index"))
    )
    is_first = F.col("unit_index") == F.col("unit_start_index")
    is_last = F.col("unit_index") == F.col("unit_end_index")
    words = F.col("word_count") - F.when(is_first | F.col("first_starts_word"), 0).otherwise(1)
    contents = (
        spread.join(units, ["video_id", "unit_index"])
        .groupBy("video_id", "segment_index")
        .agg(
            F.min("start_ms").alias("start_ms"),
            F.max("end_ms").alias("end_ms"),
            F.min("start_pos").alias("start_pos"),
            F.max("end_pos").alias("end_pos"),
            F.sum(words).alias("words"),
            F.sum(tx.sentence_count("text")).alias("sentences"),
            F.count_distinct(F.when(F.col("speaker").isNotNull(), F.struct("speaker", "speaker_role"))).alias("unit_speakers"),
            F.max("speakers_seen").alias("max_unit_speakers"),
            F.max(F.col("must_end") & ~is_last).alias("crosses_must"),
            F.max(F.when(is_last, F.col("can_end"))).alias("ends_safely"),
            F.max_by("boundary_reason", "unit_index").alias("end_reason"),
            F.min_by("speaker", "unit_index").alias("speaker"),
            F.min_by("speaker_role", "unit_index").alias("speaker_role"),
        )
    )
    return known.withColumn("range_ok", valid).join(contents, ["video_id", "segment_index"], "left")


def segment_range_errors(ranges: DataFrame, units: DataFrame, limits: SegmentLimits = DEFAULTS.segment) -> DataFrame:
    """All errors of proposed ranges, one row per (video_id, segment_index, code)."""
    contents = range_contents(ranges, units)
    chained = seq.neighbour_window(
        contents, VIDEO, "segment_index", lambda w: {"prev_end": F.lag("unit_end_index").over(w)}, ahead=0, dense=False
    )
    ms = F.col("end_ms") - F.col("start_ms")
    tolerance = int(limits.tolerance_seconds * 1000)
    speakers = F.greatest("unit_speakers", "max_unit_speakers")
    ok = F.col("range_ok")
    codes = F.array_compact(
        F.array(
            F.when(F.col("unit_start_index").isNull() | F.col("unit_end_index").isNull(), "invalid_segment"),
            F.when(F.col("unit_start_index") != F.coalesce(F.col("prev_end"), F.lit(0)) + 1, "non_contiguous_ranges"),
            F.when(~ok, "unit_range_invalid"),
            F.when(ok & (ms > int(limits.max_seconds * 1000) + tolerance), "duration_exceeded"),
            F.when(ok & (speakers == 0) & (ms < int(limits.min_seconds * 1000) - tolerance), "duration_too_short"),
            F.when(ok & (F.col("words") > limits.max_words), "words_exceeded"),
            F.when(
                ok
                & (ms > int(limits.dense_seconds * 1000))
                & (F.col("words") >= limits.dense_words)
                & (F.col("sentences") >= limits.dense_sentences),
                "too_dense",
            ),
            F.when(ok & (speakers > 1), "mixed_speakers"),
            F.when(ok & F.col("crosses_must"), "crossed_must_boundary"),
            F.when(ok & (F.col("unit_end_index") < F.col("units_count")) & ~F.col("ends_safely"), "unsafe_unit_boundary"),
        )
    )
    per_range = chained.select("video_id", "segment_index", F.explode(codes).alias("code"))
    covered = ranges.groupBy("video_id").agg(F.max_by("unit_end_index", "segment_index").alias("reached"))
    counts = units.groupBy("video_id").agg(F.max("unit_index").alias("units_count"))
    uncovered = (
        counts.join(covered, "video_id", "left")
        .where(F.coalesce("reached", F.lit(0)) != F.col("units_count"))
        .select("video_id", F.lit(0).cast("long").alias("segment_index"), F.lit("incomplete_coverage").alias("code"))
    )
    return per_range.unionByName(uncovered)


def error_causes(errors: DataFrame) -> DataFrame:
    """Error codes rolled up to the causes a retry is planned by."""
    cause = (
        F.when(F.col("code").isin("duration_exceeded", "duration_too_short", "words_exceeded"), "limits")
        .when(F.col("code").isin("too_dense", "unsafe_unit_boundary"), "semantic_boundary")
        .when(F.col("code").isin("mixed_speakers", "crossed_must_boundary"), "speakers")
        .otherwise("shape")
    )
    return errors.groupBy(cause.alias("cause"), "code").agg(F.count("*").alias("errors"))


def build_segments(ranges: DataFrame, units: DataFrame) -> DataFrame:
    """Segment rows of valid unit ranges: text, times, token span, mode language, identifiers."""
    spread = ranges.withColumn("unit_index", F.explode(F.sequence("unit_start_index", "unit_end_index")))
    joined = spread.join(units, ["video_id", "unit_index"])
    word_loss = F.when((F.col("unit_index") == F.col("unit_start_index")) | F.col("first_starts_word"), 0).otherwise(1)
    piece = F.struct(
        "unit_index", F.concat(F.when(F.col("first_starts_word"), " ").otherwise(""), F.col("text")).alias("text")
    )
    return joined.groupBy("video_id", "segment_index").agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.min("start_pos").alias("start_pos"),
        F.max("end_pos").alias("end_pos"),
        F.sum(F.col("word_count") - word_loss).alias("words"),
        tx.squash(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), "")).alias("text"),
        F.min_by("speaker", "unit_index").alias("speaker"),
        F.min_by("speaker_role", "unit_index").alias("speaker_role"),
        F.min_by("language", "unit_index").alias("language"),
    ).select(
        "video_id",
        (F.col("segment_index") - 1).alias("seg"),
        tm.span_id(F.col("video_id"), "s", F.col("start_ms"), F.col("end_ms")).alias("segment_id"),
        "start_ms", "end_ms", "start_pos", "end_pos",
        (F.col("end_pos") - F.col("start_pos") + 1).alias("tokens_count"),
        "words", "text", "speaker", "speaker_role", "language",
        tm.timestamp_url(F.col("video_id"), F.col("start_ms")).alias("timestamp_url"),
    )


def segment_unit_ranges(segments: DataFrame, units: DataFrame) -> DataFrame:
    """Unit indexes each segment starts and ends at, by token position (two equi-joins)."""
    starts = units.select("video_id", "start_pos", F.col("unit_index").alias("unit_start_index"))
    ends = units.select("video_id", "end_pos", F.col("unit_index").alias("unit_end_index"))
    return segments.join(starts, ["video_id", "start_pos"]).join(ends, ["video_id", "end_pos"]).select(
        "video_id", "seg", "unit_start_index", "unit_end_index"
    )


def segment_boundary_issues(segments: DataFrame) -> DataFrame:
    """Weak boundaries between neighbouring segments of one speaker, and segments that are too dense."""
    paired = seq.neighbour_window(
        segments.select("video_id", "seg", "text", "speaker", "start_ms", "end_ms"),
        VIDEO,
        "seg",
        lambda w: {"prev_text": F.lag("text").over(w), "prev_speaker": F.lag("speaker").over(w)},
        ahead=0,
    )
    changed = F.coalesce(F.col("speaker") != F.col("prev_speaker"), F.lit(False))
    end_char = tx.terminal_char("prev_text")
    after_sentence = F.coalesce(end_char.isin(fx.SENTENCE_END_CHARS), F.lit(False))
    pair = F.col("prev_text").isNotNull() & ~changed
    limits = DEFAULTS.segment
    dense = (
        (F.col("end_ms") - F.col("start_ms") > int(limits.dense_seconds * 1000))
        & (tx.word_count("text") >= limits.dense_words)
        & (tx.sentence_count("text") >= limits.dense_sentences)
    )
    codes = F.array_compact(
        F.array(
            F.when(dense, "too_dense"),
            F.when(pair & end_char.isin(fx.NON_TERMINAL_END_CHARS), "ends_on_non_terminal"),
            F.when(pair & tx.starts_lower("text") & ~after_sentence, "starts_lower_case"),
            F.when(pair & tx.first_word("text").isin(fx.CONTINUATION_WORDS) & ~after_sentence, "starts_with_continuation"),
        )
    )
    return paired.select("video_id", "seg", F.explode(codes).alias("code"))


def _next_merged(limits: SegmentLimits):
    min_ms = int(limits.min_seconds * 1000)
    max_ms = int((limits.max_seconds + limits.tolerance_seconds) * 1000)
    max_words = limits.max_words

    def next_start(cols: dict[str, list], i: int, n: int) -> int:
        start, end, words = cols["start_ms"], cols["end_ms"], cols["words"]
        who, role, first, last, joined = (
            cols["speaker"], cols["speaker_role"], cols["start_pos"], cols["end_pos"], cols["starts_word"],
        )
        total = words[i]
        for j in range(i + 1, n):
            short = end[j - 1] - start[i] < min_ms or end[j] - start[j] < min_ms
            grown = total + words[j] - (0 if joined[j] else 1)
            fits = end[j] - start[i] <= max_ms and grown <= max_words
            same = bool(who[i]) and who[i] == who[j] and role[i] == role[j] and last[j - 1] + 1 == first[j]
            if not (short and fits and same):
                return j
            total = grown
        return -1

    return next_start


def merge_short_segments(
    segments: DataFrame, limits: SegmentLimits = DEFAULTS.segment, *, block: int = seq.GREEDY_BLOCK
) -> DataFrame:
    """Left fold that joins adjacent same-speaker segments while one side is too short and limits hold."""
    fields = ["start_ms", "end_ms", "words", "speaker", "speaker_role", "start_pos", "end_pos", "starts_word"]
    flagged = segments if "starts_word" in segments.columns else segments.withColumn("starts_word", F.lit(True))
    grouped = seq.bounded_greedy(
        flagged, VIDEO, "seg", fields, _next_merged(limits), reach=limits.max_words + 2, block=block
    )
    loss = F.when((F.col("seg") == F.col("first_seg")) | F.col("starts_word"), 0).otherwise(1)
    first = grouped.groupBy("video_id", "group").agg(F.min("seg").alias("first_seg"))
    piece = F.struct("seg", F.concat(F.when(F.col("starts_word"), " ").otherwise(""), F.col("text")).alias("text"))
    return (
        flagged.join(grouped, ["video_id", "seg"])
        .join(first, ["video_id", "group"])
        .groupBy("video_id", F.col("group").alias("seg"))
        .agg(
            F.min("start_ms").alias("start_ms"),
            F.max("end_ms").alias("end_ms"),
            F.min("start_pos").alias("start_pos"),
            F.max("end_pos").alias("end_pos"),
            F.sum(F.col("words") - loss).alias("words"),
            F.count("*").alias("merged_from"),
            F.min_by("speaker", "start_ms").alias("speaker"),
            F.min_by("speaker_role", "start_ms").alias("speaker_role"),
            tx.squash(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), "")).alias("text"),
        )
        .withColumn("segment_id", tm.span_id(F.col("video_id"), "s", F.col("start_ms"), F.col("end_ms")))
    )


def segment_violations(segments: DataFrame, units: DataFrame, tokens: DataFrame) -> DataFrame:
    """Full check of a segment table: no gap or overlap in token positions, whole stream covered, starts
    and ends on unit edges, ends where a segment may end, identifiers unique."""
    paired = seq.neighbour_window(
        segments.select("video_id", "seg", "start_pos", "end_pos", "segment_id"),
        VIDEO,
        "seg",
        lambda w: {"prev_end": F.lag("end_pos").over(w)},
        ahead=0,
        dense=False,
    )
    starts = units.select("video_id", "start_pos", F.lit(True).alias("starts_unit"))
    ends = units.select("video_id", "end_pos", F.col("can_end"))
    last = tokens.groupBy("video_id").agg(F.max("pos").alias("last_pos"))
    checked = (
        paired.join(starts, ["video_id", "start_pos"], "left")
        .join(ends, ["video_id", "end_pos"], "left")
        .join(last, "video_id", "left")
    )
    codes = F.array_compact(
        F.array(
            F.when(F.col("prev_end").isNotNull() & (F.col("prev_end") + 1 != F.col("start_pos")), "token_gap_or_overlap"),
            F.when(F.col("starts_unit").isNull(), "starts_inside_unit"),
            F.when(F.col("can_end").isNull(), "ends_inside_unit"),
            F.when(~F.col("can_end") & (F.col("end_pos") < F.col("last_pos")), "ends_at_unsafe_boundary"),
        )
    )
    per_segment = checked.select("video_id", "seg", F.explode(codes).alias("code"))
    reached = segments.groupBy("video_id").agg(F.max("end_pos").alias("reached"))
    short = (
        last.join(reached, "video_id", "left")
        .where(F.coalesce("reached", F.lit(-1)) != F.col("last_pos"))
        .select("video_id", F.lit(-1).cast("long").alias("seg"), F.lit("stream_not_covered").alias("code"))
    )
    twice = (
        segments.groupBy("video_id", "segment_id")
        .agg(F.count("*").alias("n"), F.min("seg").alias("seg"))
        .where("n > 1")
        .select("video_id", "seg", F.lit("duplicate_segment_id").alias("code"))
    )
    return per_segment.unionByName(short).unionByName(twice)


def segment_table_violations(segments: DataFrame, units: DataFrame, tokens: DataFrame, limits: SegmentLimits = DEFAULTS.segment, *, merged: bool = True) -> DataFrame:
    """All that must hold of a stored segment table, as (video_id, seg, code): ``segment_violations``, and agreement with
    the tokens that a segment names (times, text, speaker, no blank at its start or after its end), times in order, limits,
    no unit inside it after which a segment must end, and, with ``merged``, that merging short neighbours changes nothing."""
    min_ms, max_ms = int(limits.min_seconds * 1000), int((limits.max_seconds + limits.tolerance_seconds) * 1000)
    tolerance = int(limits.tolerance_seconds * 1000)
    paired = seq.neighbour_window(
        segments.select("video_id", "seg", "start_ms", "end_ms", "start_pos", "end_pos", "words", "speaker", "speaker_role", "text"),
        VIDEO, "seg", lambda w: {"prev_start": F.lag("start_ms").over(w)}, ahead=0, dense=False,
    )

    def token_at(at: Column, name: str) -> DataFrame:
        fields = F.struct(F.col("start_ms"), F.col("end_ms"), tx.is_blank("text").alias("blank"))
        return tokens.select("video_id", at.alias(f"at_{name}"), fields.alias(name))

    placed = paired.withColumns({"at_first": F.col("start_pos"), "at_last": F.col("end_pos"), "at_next": F.col("end_pos")})
    for name, at in (("first", F.col("pos")), ("last", F.col("pos")), ("next", F.col("pos") - 1)):
        placed = placed.join(token_at(at, name), ["video_id", f"at_{name}"], "left")
    # beyond the stream there is nothing to meet: a span that ends far behind it would fill buckets without tokens
    ends = tokens.groupBy("video_id").agg((F.max("pos") + 1).alias("beyond"))
    known = segments.where("start_pos <= end_pos").join(ends, "video_id")
    spans = known.select("video_id", "seg", F.greatest("start_pos", F.lit(0)).alias("a"), F.least(F.col("end_pos") + 1, "beyond").alias("b")).where("a < b")
    points = tokens.select("video_id", "pos", (F.col("pos") + 1).alias("after"), "text", "speaker", "speaker_role")
    inside = overlap_join(points, spans, VIDEO, ("pos", "after"), ("a", "b"), width=POSITION_BUCKET)
    who = F.when(~tx.is_blank("text"), F.struct(F.coalesce("speaker", F.lit("")).alias("s"), F.coalesce("speaker_role", F.lit("")).alias("r")))
    said = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    held = inside.groupBy("video_id", "seg").agg(tx.squash(F.array_join(said, "")).alias("said"), F.min(who).alias("low"), F.max(who).alias("high"))
    musts = units.where("must_end").select("video_id", F.col("end_pos").alias("must_pos"), (F.col("end_pos") + 1).alias("must_after"))
    must_ends = musts.groupBy("video_id").agg(F.min("must_pos").alias("low_must"), F.max("must_after").alias("high_must"))
    before_end = segments.join(must_ends, "video_id").select(
        "video_id", "seg", F.greatest("start_pos", "low_must").alias("a"), F.least("end_pos", "high_must").alias("last_b")
    ).where("a < last_b")
    crossed = overlap_join(musts, before_end, VIDEO, ("must_pos", "must_after"), ("a", "last_b"), width=POSITION_BUCKET).select("video_id", "seg", F.lit("must_end_inside").alias("code")).distinct()
    one = F.col("low").eqNullSafe(F.col("high"))
    speaker, role = (F.when(one, F.nullif(F.col(f"low.{k}"), F.lit(""))) for k in ("s", "r"))
    duration = F.col("end_ms") - F.col("start_ms")
    unnamed = F.coalesce("speaker", F.lit("")) == ""
    joined = placed.join(held, ["video_id", "seg"], "left")
    codes = F.array_compact(
        F.array(
            F.when(duration < 0, "inverted_times"),
            F.when(F.col("start_ms") < F.col("prev_start"), "starts_before_previous"),
            F.when(duration > max_ms, "duration_exceeded"),
            F.when(unnamed & (duration < min_ms - tolerance), "duration_too_short"),
            F.when(F.col("words") > limits.max_words, "words_exceeded"),
            F.when(F.col("first").isNull(), "unknown_start"),
            F.when(F.col("last").isNull(), "unknown_end"),
            F.when(F.col("start_pos") > F.col("end_pos"), "inverted_range"),
            F.when(F.col("first.blank"), "leading_blank"),
            F.when(F.col("next.blank"), "followed_by_blank"),
            F.when((F.col("start_ms") != F.col("first.start_ms")) | (F.col("end_ms") != F.col("last.end_ms")), "times_disagree"),
            F.when(~F.col("text").eqNullSafe(F.coalesce("said", F.lit(""))), "text_disagrees"),
            F.when(~(F.nullif("speaker", F.lit("")).eqNullSafe(speaker) & F.nullif("speaker_role", F.lit("")).eqNullSafe(role)), "speaker_disagrees"),
        )
    )
    found = segment_violations(segments, units, tokens).unionByName(joined.select("video_id", "seg", F.explode(codes).alias("code"))).unionByName(crossed)
    if not merged:
        return found
    numbered = seq.dense_position(segments, VIDEO, "seg", "__seg").withColumn("seg", F.col("__seg")).drop("__seg")
    again = merge_short_segments(numbered, limits).where("merged_from > 1").join(numbered.select("video_id", "start_pos", F.col("seg").alias("first_seg")), ["video_id", "start_pos"])
    return found.unionByName(again.select("video_id", F.col("first_seg").alias("seg"), F.lit("not_merged").alias("code")))


def mode_by(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Most frequent non-empty value per key, the first seen winning ties; counts are combined map-side."""
    counts = (
        df.where(F.coalesce(F.col(value).cast("string"), F.lit("")) != "")
        .groupBy(*keys, value)
        .agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    )
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("n"), (-F.col("seen")).alias("s"))).alias(value))


def distribution(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """min, max and mean (three decimals) of a number per key."""
    return df.groupBy(*keys).agg(
        F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.bround(F.avg(value), 3).alias("avg_value")
    )
