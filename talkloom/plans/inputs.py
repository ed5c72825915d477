"""Canonical tables derived from the given parquet tables, lazily and over all of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.functions import times as tm
from talkloom.operators import sequence as seq
from talkloom.operators import transcript as tr
from talkloom.session import materialise


TEXT_TABLES = {"conversations", "documents", "embeddings", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, as it lies. The session setting ``spark.talkloom.spread`` (unset unless the caller wants it) deals text
    tables out to so many partitions, for files of one unsplittable row group; results never depend on it."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = int(spark.conf.get("spark.talkloom.spread", "0"))
    return df.repartition(spread) if spread and name in TEXT_TABLES else df


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as token streams: every word with the blanks before it, on a made clock.

    Token positions run through a conversation; the offset of each turn is a running sum of token
    counts, so the only row-wide shuffle is the one over turns."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("video_id"),
        "turn",
        F.col("role").alias("speaker"),
        F.regexp_extract_all("text", F.lit(r"\s*\S+"), F.lit(0)).alias("pieces"),
    )
    placed = seq.running(turns, ["video_id"], "turn", sums={"so_far": F.size("pieces").cast("long")})
    rows = placed.select(
        "video_id", "turn", "speaker", (F.col("so_far") - F.size("pieces")).alias("offset"), F.posexplode("pieces").alias("i", "text")
    )
    pos = F.col("offset") + F.col("i")
    start = 400 * pos + 1500 * F.col("turn") + 1000 * F.floor(pos / 37)
    return rows.select(
        "video_id",
        pos.cast("long").alias("pos"),
        "text",
        start.cast("long").alias("start_ms"),
        (start + 300 + 20 * (F.length("text") % 5)).cast("long").alias("end_ms"),
        "speaker",
        "turn",
        F.when(F.col("i") % 7 == 0, "xx").otherwise("yy").alias("language"),
    )


def turn_segments(spark: SparkSession, sf_dir: str, toks: DataFrame | None = None) -> DataFrame:
    """One speech segment per turn, with the speaker roles of the conversation; ``toks`` are its stored tokens, if there are any."""
    toks = materialise(tokens(spark, sf_dir)) if toks is None else toks
    spans = toks.groupBy("video_id", "turn").agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.min("pos").alias("start_pos"),
        F.max("pos").alias("end_pos"),
        F.count("*").alias("words"),
    )
    text = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("video_id"), "turn", F.col("role").alias("speaker"), "text"
    )
    roles = tr.speaker_profiles(toks).select("video_id", "speaker", F.col("role").alias("speaker_role"))
    return (
        spans.join(text, ["video_id", "turn"])
        .join(roles, ["video_id", "speaker"])
        .select(
            "video_id",
            F.col("turn").alias("seg"),
            F.concat(F.lit("s"), F.col("video_id"), F.lit("_"), F.col("turn")).alias("segment_id"),
            "start_ms", "end_ms", "start_pos", "end_pos", "words", "speaker", "speaker_role",
            F.trim(F.regexp_replace("text", r"(?U)\s+", " ")).alias("text"),
        )
    )


def video_ends(toks: DataFrame) -> DataFrame:
    return toks.groupBy("video_id").agg(F.max("end_ms").alias("duration_ms"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim per document; lines are evidence, language and source are topics."""
    docs = table(spark, sf_dir, "documents")
    kinds = F.array(*[F.lit(k) for k in ["rule", "recommendation", "warning", "definition", "example", "exception"]])
    lines = F.split("text", "\n")
    empty = F.array().cast("array<string>")
    return docs.select(
        F.col("source").alias("video_id"),
        F.col("doc_id").alias("claim_pos"),
        F.concat(F.lit("claim_"), F.col("doc_id")).alias("claim_id"),
        F.concat("source", F.lit("_c_"), F.col("doc_id") % 7).alias("chunk_id"),
        F.element_at(kinds, (F.length("lang") + F.ascii("lang")).cast("int") % 6 + 1).alias("claim_type"),
        F.col("lang").alias("subject"),
        F.col("text").alias("claim"),
        F.col("text").alias("rationale"),
        empty.alias("conditions"),
        F.array("lang").alias("applies_to"),
        empty.alias("avoid"),
        F.array("source").alias("prefer"),
        F.filter(lines, lambda s: s != "").alias("evidence"),
        F.array("lang", "source").alias("topics"),
        F.when(F.col("n_chars") > 2000, "high").when(F.col("n_chars") > 500, "medium").otherwise("low").alias("confidence"),
        ((F.col("doc_id") % 50) * 1000).alias("start_ms"),
    )


def visual_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One visual event per document: lines as observations, first words as items."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumns(
        {
            # words beyond the eighth are never asked for; a first piece may be empty, and the tenth is the rest of the text
            "words": F.filter(F.slice(F.split("text", r"[\s.,;:!?]+", 10), 1, 9), lambda w: w != ""),
            "lines": F.filter(F.split("text", "\n"), lambda s: F.trim(s) != ""),
        }
    )
    words, lines = F.col("words"), F.col("lines")
    relevance = F.element_at(F.array(*[F.lit(r) for r in ["none", "background", "brief", "primary_example"]]), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs.select(
        F.col("source").alias("video_id"),
        F.concat("source", F.lit("_scene_"), F.col("doc_id")).alias("scene_id"),
        F.col("doc_id"),
        F.get(lines, 0).alias("visual_summary"),
        lines.alias("observations"),
        F.slice(lines, 2, F.size(lines)).alias("interpretations"),
        F.slice(words, 1, 5).alias("items"),
        F.array("lang", "source", F.coalesce(F.get(words, 5), F.lit(""))).alias("style_topics"),
        F.slice(words, 3, 3).alias("on_screen_text"),
        F.slice(words, 7, 2).alias("presentation_context"),
        F.coalesce(F.get(lines, F.size(lines) - 1), F.lit("")).alias("notes"),
        F.struct(
            (F.col("doc_id") % 3 == 0).alias("is_recurring"),
            relevance.alias("relevance"),
            F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("baseline "), F.col("doc_id") % 5)).otherwise("").alias("baseline_summary"),
            F.slice(lines, 3, F.size(lines)).alias("scene_deltas"),
            F.coalesce(F.get(words, 1), F.lit("")).alias("narrative_brief"),
        ).alias("presenter_context"),
    )
