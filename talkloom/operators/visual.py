"""Cleaning of visual events and the metrics about markers left in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom import fixed_values as fx
from talkloom.functions import markers as mk
from talkloom.functions import text as tx
from talkloom.functions.markers import DEFAULT_RULES, MarkerRules
from talkloom.functions.redact import preview
from talkloom.session import materialise

TEXT_FIELDS = ["visual_summary", "notes"]
LIST_FIELDS = ["observations", "interpretations", "items", "style_topics"]
#: Signs of a marker of one word by which it is looked up inside words.
GRAM = 3
LEAKAGE_FIELDS = ["visual_summary", "observations", "interpretations", "items", "style_topics", "notes"]


def as_list(df: DataFrame, field: str) -> Column:
    """A field as an array of texts, whether it holds one text or several."""
    if "." in field:
        return F.coalesce(F.col(field), F.array().cast("array<string>"))
    kind = df.schema[field].dataType.simpleString()
    return F.col(field) if kind.startswith("array") else F.array(F.col(field))


def field_values(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Long form (keys, field, values) of the named fields, in one pass over the rows."""
    entries = F.array(
        *[F.struct(F.lit(f.split(".")[-1]).alias("field"), as_list(df, f).alias("values")) for f in fields]
    )
    return df.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.field", "e.values")


def marker_hits(df: DataFrame, keys: Sequence[str], fields: Sequence[str], kind: str, rules: MarkerRules = DEFAULT_RULES) -> DataFrame:
    """One row per (row, field, marker); ``kind`` is technical, presentation or noise."""
    return marker_kinds(df, keys, fields, [kind], rules).drop("kind")


def marker_kinds(df: DataFrame, keys: Sequence[str], fields: Sequence[str], kinds: Sequence[str], rules: MarkerRules = DEFAULT_RULES) -> DataFrame:
    """``marker_hits`` of several kinds, with the kind. A text that several fields of a row hold is judged once.

    Outer explodes: from an inner one Spark infers a filter that works the exploded expression out once more."""
    tests = {"technical": mk.technical_key, "presentation": mk.presentation_key, "noise": mk.noise_key}

    def squashed(field: str) -> Column:
        return F.array_distinct(F.transform(F.coalesce(as_list(df, field), F.array().cast("array<string>")), tx.squash))

    entries = F.array(*[F.struct(F.lit(f.split(".")[-1]).alias("field"), squashed(f).alias("texts")) for f in fields])
    read = df.select(*keys, entries.alias("__entries"))
    pairs = F.transform(F.array_distinct(F.flatten("__entries.texts")), lambda t: F.struct(t.alias("text"), tx.label_key(t).alias("key")))
    read = read.withColumn("__pairs", pairs)

    def hits(kind: str) -> Column:
        return mk.texts(F.filter("__pairs", lambda p: tests[kind](p["key"], rules)))

    found = F.array(*[F.struct(F.lit(kind).alias("kind"), hits(kind).alias("hits")) for kind in kinds])
    by_kind = read.select(*keys, "__entries", F.explode(found).alias("__kind")).where(F.size("__kind.hits") > 0)
    by_field = by_kind.select(*keys, "__kind", F.explode_outer("__entries").alias("__entry"))
    kept = F.array_intersect("__entry.texts", "__kind.hits")
    return by_field.select(*keys, F.col("__entry.field").alias("field"), F.explode_outer(kept).alias("marker"), F.col("__kind.kind").alias("kind")).where("marker IS NOT NULL")


def leakage_errors(events: DataFrame, keys: Sequence[str], rules: MarkerRules = DEFAULT_RULES) -> DataFrame:
    """Structured errors for technical labels in scene-specific fields."""
    return marker_hits(events, keys, LEAKAGE_FIELDS, "technical", rules).select(
        *keys,
        F.lit("technical_visual_label").alias("code"),
        "field", "marker",
        preview(F.col("marker"), 160).alias("preview"),
    )


def quarantine(events: DataFrame, rules: MarkerRules = DEFAULT_RULES) -> DataFrame:
    """Move noisy list items and whole noisy texts out of the scene fields into ``presentation_context``.

    Adds scrubbed_entries (how many were moved), model_entries (how many the context held before) and
    sinked (whether those already carried markers)."""
    labels = {"items", "style_topics"}

    def noisy(field: str, key: Column) -> Column:
        return mk.noise_key(key, rules) | (key == "") if field in labels else mk.noise_key(key, rules)

    def judged(field: str, values: Column) -> Column:
        return F.transform(values, lambda p: F.struct(p["text"].alias("text"), noisy(field, p["key"]).alias("noisy")))

    def unique_pairs(values: Column) -> Column:
        return F.array_distinct(F.filter(mk.keyed(values), lambda p: p["text"] != ""))

    deltas, brief = F.col("presenter_context.scene_deltas"), F.col("presenter_context.narrative_brief")
    pairs = {f: unique_pairs(F.col(f)) for f in LIST_FIELDS} | {"deltas": unique_pairs(deltas)}
    lone = {f: mk.keyed(F.array(F.col(f))) for f in TEXT_FIELDS} | {"brief": mk.keyed(F.array(brief))}
    context = F.filter(mk.keyed(F.col("presentation_context")), lambda p: p["text"] != "")
    step = events.withColumns({f"__{f}": judged(f, c) for f, c in (pairs | lone).items()} | {"__context": context})
    order = [*LIST_FIELDS, *TEXT_FIELDS, "deltas", "brief"]
    step = step.withColumns({f"__out_{f}": F.filter(f"__{f}", lambda p: p["noisy"]) for f in order})
    step = step.withColumn("__removed", mk.texts(F.concat(*[f"__out_{f}" for f in order])))
    kept = {f: mk.texts(F.filter(f"__{f}", lambda p: ~p["noisy"])) for f in LIST_FIELDS}

    def text_or_nothing(field: str) -> Column:
        return F.when(F.size(f"__out_{field}") > 0, "").otherwise(F.get(f"__{field}", 0)["text"])

    texts = {f: text_or_nothing(f) for f in TEXT_FIELDS}
    presenter = (
        F.col("presenter_context")
        .withField("scene_deltas", mk.texts(F.filter("__deltas", lambda p: ~p["noisy"])))
        .withField("narrative_brief", text_or_nothing("brief"))
    )
    out = step.withColumns(
        kept
        | texts
        | {
            "presenter_context": presenter,
            "model_entries": F.size("__context").cast("long"),
            "sinked": F.exists("__context", lambda p: mk.noise_key(p["key"], rules)),
            "scrubbed_entries": F.size("__removed").cast("long"),
            "presentation_context": tx.unique_in_order(F.concat(mk.texts(F.col("__context")), "__removed")),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def safety_metrics(raw: DataFrame, clean: DataFrame, keys: Sequence[str], by: Sequence[str], rules: MarkerRules = DEFAULT_RULES) -> DataFrame:
    """Counts before and after the quarantine, summed over scenes."""
    raw_hits = marker_hits(raw, keys, LEAKAGE_FIELDS, "technical", rules).select(*keys).distinct().withColumn("raw_hit", F.lit(1))
    left = marker_kinds(clean, keys, [*LEAKAGE_FIELDS, "presenter_context.scene_deltas"], ["technical", "presentation"], rules)
    final = F.max(F.when((F.col("kind") == "technical") & (F.col("field") != "scene_deltas"), 1))
    left_hits = left.groupBy(*keys).agg(final.alias("final_hit"), F.max(F.when(F.col("kind") == "presentation", 1)).alias("noise_hit"))
    joined = clean.select(*keys, "scrubbed_entries", "model_entries", "sinked", F.size("presentation_context").alias("entries"))
    for part in (raw_hits, left_hits):
        joined = joined.join(part, list(keys), "left")
    return joined.groupBy(*by).agg(
        F.count("raw_hit").alias("raw_scenes"),
        F.count_if("sinked").alias("sinked_scenes"),
        F.count_if(F.col("scrubbed_entries") > 0).alias("scrubbed_scenes"),
        F.count("final_hit").alias("final_scenes"),
        F.count("noise_hit").alias("presentation_final_scenes"),
        F.sum("entries").cast("long").alias("context_entries"),
        F.sum("model_entries").alias("context_model_entries"),
        F.sum("scrubbed_entries").alias("context_scrubbed_entries"),
    )


def visual_events_from_payloads(payloads: DataFrame) -> DataFrame:
    """Visual events out of JSON payloads, with the defaults of missing fields and repeats removed."""
    schema = (
        "presentation_context array<string>, visual_summary string, observations array<string>, interpretations array<string>, "
        "on_screen_text array<string>, items array<string>, style_topics array<string>, confidence string, notes string, "
        "presenter_context struct<is_recurring:boolean, relevance:string, baseline_summary:string, scene_deltas:array<string>, narrative_brief:string>"
    )
    p = F.col("p")
    lists = ["presentation_context", "observations", "interpretations", "on_screen_text", "items", "style_topics"]
    return payloads.withColumn("p", F.from_json("payload", schema)).select(
        *[c for c in payloads.columns if c != "payload"],
        *[tx.unique_in_order(p[c]).alias(c) for c in lists],
        F.coalesce(p["visual_summary"], F.lit("")).alias("visual_summary"),
        F.coalesce(p["notes"], F.lit("")).alias("notes"),
        F.coalesce(F.nullif(p["confidence"], F.lit("")), F.lit("medium")).alias("confidence"),
        p["presenter_context"].alias("presenter_context"),
    )


def baseline_markers(profiles: DataFrame) -> DataFrame:
    """Markers of a recurring presenter per video: (video_id, marker_key, marker, ordinal).

    Recurring markers come first, then the parts of the summary that are long enough to be a phrase;
    generic ones are left out and the first marker with a key wins."""
    recurring = F.transform("recurring_visual_markers", lambda m, i: F.struct(i.alias("ordinal"), tx.squash(m).alias("marker"), F.lit(False).alias("phrase")))
    parts = F.transform(
        F.split("baseline_summary", "[,;]"), lambda m, i: F.struct((i + 1000).alias("ordinal"), tx.squash(m).alias("marker"), F.lit(True).alias("phrase"))
    )
    rows = (
        profiles.where("has_primary_presenter")
        .select("video_id", F.explode(F.concat(recurring, parts)).alias("m"))
        .select("video_id", "m.ordinal", "m.marker", "m.phrase", tx.label_key(F.col("m.marker")).alias("marker_key"))
    )
    long_enough = (F.length("marker_key") >= fx.BASELINE_PHRASE_MIN_CHARS) & (tx.word_count("marker_key") >= fx.BASELINE_PHRASE_MIN_WORDS)
    generic = F.col("marker_key").isin(fx.GENERIC_BASELINE_MARKERS) | F.startswith(F.col("marker_key"), F.lit(fx.GENERIC_BASELINE_PREFIX))
    usable = rows.where((F.col("marker_key") != "") & ~generic & (~F.col("phrase") | long_enough))
    return usable.groupBy("video_id", "marker_key").agg(
        F.min_by("marker", "ordinal").alias("marker"), F.min("ordinal").alias("ordinal")
    )


def _anchors(markers: DataFrame) -> DataFrame:
    """Markers with the piece of a text's word that must be there for the marker to be: made of its longest word, which is a
    whole word of the text, or the start of one if the marker ends with it, the end of one if it begins with it; of a marker
    of one word its first signs may stand anywhere in a word."""
    words = F.split("marker_key", " ")
    longest = F.array_max(F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("back"), w.alias("word"))))
    at, word = -F.col("longest.back"), F.col("longest.word")
    piece = (
        F.when(F.col("n_words") == 1, F.concat(F.lit("in "), F.substring(word, 1, GRAM)))
        .when(at == 0, F.concat(F.lit("end "), word))
        .when(at == F.col("n_words") - 1, F.concat(F.lit("start "), word))
        .otherwise(F.concat(F.lit("is "), word))
    )
    return markers.withColumns({"n_words": F.size(words), "longest": longest}).withColumn("piece", piece).drop("n_words", "longest")


def _pieces(word: Column) -> Column:
    """All pieces of a word that a marker may be anchored to."""
    n = F.length(word)

    def inside(size: int) -> Column:
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("in "), F.substring(word, i, F.lit(size))))

    ends = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("end "), F.substring(word, i, n)))
    starts = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("start "), F.substring(word, F.lit(1), i)))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("is "), word)), ends, starts, *[inside(size) for size in range(1, GRAM + 1)]))


def baseline_leakage(events: DataFrame, markers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Baseline markers repeated in scene fields of recurring presenters: (keys, field, marker).

    Markers are substrings of a field's key text, which is words and single blanks. They meet the vocabulary of their video
    through an index of word pieces, the words found lead to the texts that hold them, and those alone are searched. So a
    video may have any number of markers and events, and no list of either is gathered."""
    recurring = events.where("presenter_context.is_recurring")
    texts = F.array(*[F.struct(F.lit(f).alias("field"), tx.label_key(F.array_join(as_list(events, f), " ")).alias("key")) for f in LEAKAGE_FIELDS])
    named = F.struct(*keys).alias("row")
    rows = materialise(recurring.select("video_id", named, F.explode(texts).alias("t")).select("video_id", "row", "t.*", F.monotonically_increasing_id().alias("text_id")))
    words = rows.select("video_id", "text_id", F.explode(F.array_distinct(F.split("key", " "))).alias("word")).where("word <> ''")
    pieces = words.select("video_id", "word").distinct().select("video_id", "word", F.explode(_pieces(F.col("word"))).alias("piece"))
    met = pieces.join(_anchors(markers), ["video_id", "piece"]).select("video_id", "word", "marker_key", "marker").distinct()
    asked = words.join(met, ["video_id", "word"]).select("text_id", "marker_key", "marker").distinct()
    found = rows.join(asked, "text_id").where(F.contains("key", "marker_key"))
    return found.select("row.*", "field", "marker")


def leakage_metrics(
    hits: DataFrame, keys: Sequence[str], by: Sequence[str], fields: Sequence[str] = LEAKAGE_FIELDS, *, markers: str = "per row"
) -> DataFrame:
    """Roll-up of marker hits: rows hit, markers, fields hit, distinct markers, hits per field.

    ``markers`` says whether markers_total counts a marker once "per row" (technical labels) or once "per field" of a
    row (presentation noise).

    Distinct counts run on pre-aggregated keys, so a marker found everywhere does not pile up in one task."""
    per_row = hits.groupBy(*keys, "marker").agg(F.count("*").alias("n"))
    rows = per_row.groupBy(*keys).agg(F.count("*").alias("markers"), F.sum("n").alias("errors"))
    totals = rows.groupBy(*by).agg(
        F.count("*").alias("scenes"), F.sum("errors" if markers == "per field" else "markers").alias("markers_total"), F.sum("errors").alias("structured_errors")
    )
    per_field = hits.groupBy(*keys, "field").agg(F.count("*").alias("n")).groupBy(*by).agg(
        F.count("*").alias("fields_count"),
        *[F.sum(F.when(F.col("field") == f, F.col("n")).otherwise(0)).alias(f"{f}_count") for f in fields],
    )
    unique = hits.select(*by, "marker").distinct().groupBy(*by).agg(F.count("*").alias("unique_markers"))
    out = totals.join(per_field, list(by)).join(unique, list(by))
    return out


def relevance_counts(events: DataFrame, by: Sequence[str]) -> DataFrame:
    return events.groupBy(*by).agg(
        *[F.count_if(F.col("presenter_context.relevance") == r).alias(f"{r}_events") for r in ("background", "brief", "primary_example")]
    )


def retention(before: DataFrame, after: DataFrame, keys: Sequence[str], fields: Sequence[str] = LIST_FIELDS) -> DataFrame:
    """Evidence kept by the cleaning: entries per field before and after, and the share that stayed."""
    count = lambda df, name: field_values(df, keys, fields).groupBy("field").agg(
        F.sum(F.size(F.filter("values", lambda v: F.trim(v) != ""))).cast("long").alias(name)
    )
    joined = count(before, "entries_before").join(count(after, "entries_after"), "field", "full_outer")
    return joined.withColumn("kept_share", F.bround(F.try_divide(F.col("entries_after"), F.col("entries_before")), 4))
