"""Reading values out of JSON and URLs, and fingerprints of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def video_id_of_url(url: Column) -> Column:
    """Video identifier of a short, watch, shorts or embed URL; NULL for anything else."""
    u = F.trim(url)
    host = F.lower(F.try_parse_url(u, F.lit("AUTHORITY")))
    path = F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit(""))
    short = F.split(F.regexp_replace(path, "^/+", ""), "/")[0]
    watch = F.try_parse_url(u, F.lit("QUERY"), F.lit("v"))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    long_host = F.endswith(host, F.lit("youtube.com"))
    nested = (F.startswith(path, F.lit("/shorts/")) | F.startswith(path, F.lit("/embed/"))) & (F.size(parts) >= 2)
    found = (
        F.when(host.isin("youtu.be", "www.youtu.be"), short)
        .when(long_host & (path == "/watch"), watch)
        .when(long_host & nested, F.get(parts, 1))
    )
    return F.nullif(found, F.lit(""))


def first_present(*values: Column) -> Column:
    """First non-empty of several alternatives, an empty text counting as missing."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values])


def alternative_ms(ms_values: list[Column], second_values: list[Column]) -> Column:
    """A time given either in milliseconds or in seconds, under several field names."""
    as_ms = [F.bround(v.cast("double")).cast("long") for v in ms_values]
    as_seconds = [F.bround(v.cast("double") * 1000).cast("long") for v in second_values]
    return F.coalesce(*as_ms, *as_seconds)


def fingerprint(*columns: str) -> Column:
    """SHA-256 of a row as canonical JSON: named columns in sorted order, NULLs kept."""
    ordered = F.struct(*[F.col(c) for c in sorted(columns)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def short_hash(text: Column) -> Column:
    return F.left(F.sha1(text), F.lit(10))


def json_int(payload: Column, *paths: str) -> Column:
    """First of several JSON paths that holds an integer."""
    return F.coalesce(*[F.get_json_object(payload, p).try_cast("double").cast("long") for p in paths])
