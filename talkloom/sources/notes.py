"""Markdown notes out of chunks, claims and timeline events.

Chunk notes are bounded and come as one text per row. Index and video notes list everything of a video;
they come as ordered lines (path, section, ordinal, line), so a huge video never becomes one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.operators.timeline import turn_label


def _line(text: str, *values: Column) -> Column:
    """A line out of a pattern with {} places."""
    parts = text.split("{}")
    out = [F.lit(parts[0])]
    for value, rest in zip(values, parts[1:]):
        out += [F.coalesce(value.cast("string"), F.lit("")), F.lit(rest)]
    return F.concat(*out)


def _listed(values: Column) -> Column:
    return F.array_join(values, ", ")


def _claim_lines(c: Column, lead: Column, with_rationale: bool) -> Column:
    extras = [("Rationale", c["rationale"])] if with_rationale else []
    extras += [(label, _listed(c[f])) for label, f in (("Conditions", "conditions"), ("Prefer", "prefer"), ("Avoid", "avoid"))]
    return F.array_join(F.array_compact(F.array(lead, *[F.when(v != "", _line(f"  - {label}: {{}}", v)) for label, v in extras])), "\n")


def _seconds(ms: Column) -> Column:
    return (ms / 1000).cast("string")


def chunk_notes(chunks: DataFrame, claims: DataFrame) -> DataFrame:
    """One note per chunk: (path, body). Claims are those of the chunk, in order."""
    c = F.col("c")
    lead = _line("- **{}**: {}", c["subject"], c["claim"])
    fields = ["claim_pos", "subject", "claim", "rationale", "conditions", "prefer", "avoid"]
    rendered = claims.select("chunk_id", F.struct(*fields).alias("c")).select("chunk_id", "c.claim_pos", _claim_lines(c, lead, True).alias("text"))
    per_chunk = rendered.groupBy("chunk_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_pos", "text"))), lambda x: x["text"]), "\n").alias("claim_text")
    )
    k = F.col
    lines = F.array_compact(
        F.array(
            _line("# {}\n", k("chunk_id")),
            _line("- Chunk title: {}", k("chunk_title")),
            _line("- Video: [{}]({})", k("title"), k("url")),
            _line("- Channel: {}", k("channel")),
            _line("- Timestamp: [YouTube]({})", k("timestamp_url")),
            _line("- Range: {}s -> {}s", _seconds(k("start_ms")), _seconds(k("end_ms"))),
            _line("- Boundary: {}", k("boundary_reason")),
            _line("- Topics: {}", _listed(k("topics"))),
            _line("- Entities: {}", _listed(k("entities"))),
            _line("- Modality: {}", _listed(k("modality"))),
            _line("- Speech segments: {}", _listed(k("speech_segment_ids"))),
            F.when(F.size("speaker_roles") > 0, _line("- Speaker roles: {}", _listed(k("speaker_roles")))),
            F.when(k("presenter_brief") != "", _line("- Presenter: {}", k("presenter_brief"))),
            k("combined_text"),
            F.when(k("claim_text").isNotNull(), _line("\n## Style Claims\n\n{}", k("claim_text"))),
        )
    )
    body = F.concat(F.regexp_replace(F.array_join(lines, "\n"), r"\s+$", ""), F.lit("\n"))
    return chunks.join(per_chunk, "chunk_id", "left").select(F.concat(F.lit("chunks/"), "chunk_id", F.lit(".md")).alias("path"), body.alias("body"))


def index_lines(videos: DataFrame, chunks: DataFrame, title: str) -> DataFrame:
    """Index notes as lines: a head per video, then a link per chunk."""
    path = F.concat(F.lit("index/"), F.col("video_id").cast("string"), F.lit(".md"))
    counts = chunks.groupBy("video_id").agg(F.count("*").alias("n"))
    head = F.array(
        F.lit(f"# {title}"), F.lit(""), _line("- Video: [{}]({})", F.col("title"), F.col("url")), _line("- Channel: {}", F.col("channel")),
        _line("- Job ID: `{}`", F.col("video_id")), _line("- Chunks: {}", F.coalesce("n", F.lit(0))), F.lit(""), F.lit("## Chunks"), F.lit(""),
    )
    top = videos.join(counts, "video_id", "left").select(path.alias("path"), F.lit(0).alias("section"), F.posexplode(head).alias("ordinal", "line"))
    links = chunks.select(path.alias("path"), F.lit(1).alias("section"), F.col("start_ms").alias("ordinal"), _line("- [[chunks/{}|{}]]", F.col("chunk_id"), F.col("chunk_id")).alias("line"))
    return top.select("path", "section", F.col("ordinal").cast("long").alias("ordinal"), "line").unionByName(links)


def video_lines(videos: DataFrame, claims: DataFrame, events: DataFrame, turns: DataFrame, frames: DataFrame) -> DataFrame:
    """Video notes as blocks of lines: head, claims, then the timeline event by event with turns and frames."""
    path = F.concat(F.lit("videos/"), F.col("video_id").cast("string"), F.lit(".md"))
    k = F.col
    head = F.concat_ws(
        "\n", _line("# {}\n", k("title")), _line("- Channel: {}", k("channel")), _line("- URL: {}", k("url")), _line("- Video ID: `{}`", k("video_id")), _line("- Duration: {}s", k("duration")), F.lit("")
    )
    top = videos.select(path.alias("path"), F.lit(0).alias("section"), F.lit(0).cast("long").alias("ordinal"), head.alias("line"))
    c = F.col("c")
    lead = _line("- [{}s]({}) **{}**: {}", _seconds(c["start_ms"]), c["timestamp_url"], c["subject"], c["claim"])
    fields = ["start_ms", "timestamp_url", "subject", "claim", "rationale", "conditions", "prefer", "avoid"]
    claim_rows = claims.select("video_id", "claim_pos", F.struct(*fields).alias("c")).select(
        path.alias("path"), F.lit(1).alias("section"), F.col("claim_pos").cast("long").alias("ordinal"), _claim_lines(c, lead, False).alias("line")
    )
    spoken = turns.groupBy("scene_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("turn_index", _line("{}: {}", turn_label(k("speaker_role"), k("speaker")), k("text")).alias("t")))), lambda x: x["t"]
            ),
            "\n",
        ).alias("turns")
    )
    links = frame_links(frames)
    brief = F.coalesce("presenter_context.narrative_brief", F.lit(""))

    def heading(of: DataFrame, section: int, ordinal: int, text: str) -> DataFrame:
        return of.select(path.alias("path"), F.lit(section).alias("section"), F.lit(ordinal).cast("long").alias("ordinal"), F.lit(text).alias("line"))

    with_claims = claims.select("video_id").distinct()
    headings = heading(with_claims, 1, -1, "## Style Claims\n").unionByName(heading(with_claims, 2, -2, "")).unionByName(heading(videos, 2, -1, "## Timeline\n"))
    body = F.array_join(
        F.array_compact(
            F.array(
                _line("### {}s -> {}s\n", _seconds(k("start_ms")), _seconds(k("end_ms"))),
                _line("- Timestamp: [YouTube]({})", k("timestamp_url")),
                _line("- Topics: {}", _listed(k("topics"))),
                _line("- Items: {}", _listed(k("items"))),
                F.when(brief != "", _line("- Presenter: {}", brief)),
                F.coalesce("turns", "speech_text"),
                _line("\n{}\n", k("visual_summary")),
                F.when(F.size("on_screen_text") > 0, _line("On-screen text:\n{}", F.array_join(F.transform("on_screen_text", lambda t: F.concat(F.lit("- "), t)), "\n"))),
                F.lit(""),
                F.when(k("frame_links").isNotNull(), _line("Frames:\n{}", F.array_join(F.transform("frame_links", lambda p: F.concat(F.lit("![]("), p, F.lit(")"))), "\n"))),
                F.lit(""),
            )
        ),
        "\n",
    )
    event_rows = events.join(spoken, "scene_id", "left").join(links, "scene_id", "left").select(
        path.alias("path"), F.lit(2).alias("section"), k("start_ms").alias("ordinal"), body.alias("line")
    )
    return top.unionByName(headings).unionByName(claim_rows).unionByName(event_rows)


def frame_links(frames: DataFrame) -> DataFrame:
    """Frame links per scene in time order (a scene has a handful of frames)."""
    ordered = F.array_sort(F.collect_list(F.struct("ts_ms", "path")))
    return frames.groupBy("scene_id").agg(F.transform(ordered, lambda f: F.concat(F.lit("../../../"), f["path"])).alias("frame_links"))


def write_lines_as_text(lines: DataFrame, folder: str) -> None:
    """Note lines as text files per path, in order. A note of very many lines spans several files, whose names keep the order."""
    (
        lines.repartitionByRange("path", "section", "ordinal").sortWithinPartitions("path", "section", "ordinal")
        .select(F.col("line").alias("value"), "path").write.mode("overwrite").partitionBy("path").text(folder)
    )
