"""Time, identifier and number expressions. Integer milliseconds are the stored truth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_ms(seconds: Column) -> Column:
    return F.bround(seconds * 1000).cast("long")


def to_seconds(ms: Column) -> Column:
    return F.bround(ms.cast("double") / 1000.0, 3)


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(value, high))


def whole_seconds(ms: Column) -> Column:
    """Milliseconds to the nearest second, ties to the even second, in integer arithmetic."""
    quotient, rest = F.floor(ms / 1000), F.pmod(ms, F.lit(1000))
    up = (rest > 500) | ((rest == 500) & (F.pmod(quotient, F.lit(2)) == 1))
    return (quotient + up.cast("long")).cast("long")


def span_id(prefix: Column, kind: str, start_ms: Column, end_ms: Column) -> Column:
    """Identifier of a time span: {prefix}_{kind}_{start}_{end} in zero-padded whole seconds."""
    return F.format_string(f"%s_{kind}_%06d_%06d", prefix.cast("string"), whole_seconds(start_ms), whole_seconds(end_ms))


def ordinal_id(prefix: Column, kind: str, ordinal: Column) -> Column:
    return F.format_string(f"%s_{kind}_%06d", prefix.cast("string"), ordinal.cast("long"))


def timestamp_url(video_id: Column, start_ms: Column) -> Column:
    return F.concat(
        F.lit("https://www.youtube.com/watch?v="),
        video_id.cast("string"),
        F.lit("&t="),
        F.floor(F.greatest(start_ms, F.lit(0)) / 1000).cast("string"),
        F.lit("s"),
    )


def minute_label(seconds: Column) -> Column:
    total = F.greatest(F.lit(0), seconds.cast("long"))
    return F.format_string("%d:%02d", F.floor(total / 60), F.pmod(total, F.lit(60)))


def range_label(start: Column, end: Column) -> Column:
    both = start.isNotNull() & end.isNotNull()
    return F.when(both, F.concat(minute_label(start), F.lit("-"), minute_label(end))).otherwise("time unknown")


def iso_seconds_between(start: Column, finish: Column) -> Column:
    """Seconds between two ISO timestamps, never negative; NULL when either cannot be parsed."""
    micros = F.unix_micros(F.try_to_timestamp(finish)) - F.unix_micros(F.try_to_timestamp(start))
    return F.greatest(F.lit(0.0), micros / 1e6)


def frame_rate(ratio: Column) -> Column:
    """Frames per second from an "n/d" text."""
    top = F.split_part(ratio, F.lit("/"), F.lit(1)).try_cast("double")
    bottom = F.split_part(ratio, F.lit("/"), F.lit(2)).try_cast("double")
    return F.when(F.contains(ratio, F.lit("/")), F.try_divide(top, bottom)).otherwise(top)


def probe_duration(payload: Column) -> Column:
    """Media duration from a probe document, in seconds."""
    return F.get_json_object(payload, "$.format.duration").try_cast("double")


def affected_ratio(text: Column) -> Column:
    """The first a/b in a warning as a ratio with four decimals; NULL without one or for b = 0."""
    a = F.nullif(F.regexp_extract(text, r"\b(\d+)/(\d+)\b", 1), F.lit("")).cast("double")
    b = F.nullif(F.regexp_extract(text, r"\b(\d+)/(\d+)\b", 2), F.lit("")).cast("double")
    return F.bround(F.try_divide(a, b), 4)


def warning_template(text: Column) -> Column:
    return F.regexp_replace(text, r"\b\d+/\d+\b", "{affected}/{total}")
