"""Removal of secrets from free text, maps and previews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkloom import fixed_values as fx
from talkloom.functions.text import squash, text_or_empty


def redact_text(c: Column) -> Column:
    """Mask bearer headers, cookies, key assignments and bare keys; the label in front is kept."""
    first, second, third = fx.SENSITIVE_TEXT_PATTERNS
    labelled = F.regexp_replace(c, "(?iU)" + first, "$1$2" + fx.REDACTED)
    labelled = F.regexp_replace(labelled, "(?iU)" + second, "$1" + fx.REDACTED)
    labelled = F.regexp_replace(labelled, "(?iU)" + third, "$1" + fx.REDACTED)
    return reduce(lambda acc, p: F.regexp_replace(acc, "(?U)" + p, fx.REDACTED), fx.SECRET_KEY_PATTERNS, labelled)


def is_sensitive_key(key: Column) -> Column:
    k = F.replace(F.lower(key), F.lit("-"), F.lit("_"))
    safe = reduce(lambda a, b: a | b, [F.endswith(k, F.lit(s)) for s in fx.SAFE_KEY_SUFFIXES])
    parts = reduce(lambda a, b: a | b, [F.contains(k, F.lit(p)) for p in fx.SENSITIVE_KEY_PARTS])
    return ~safe & (k.isin(fx.SENSITIVE_KEYS) | parts)


def redact_map(m: Column) -> Column:
    """Mask values under sensitive keys, and secrets inside every other value."""
    return F.transform_values(
        m, lambda k, v: F.when(is_sensitive_key(k), F.lit(fx.REDACTED)).otherwise(redact_text(v))
    )


def preview(c: Column, n: int = 500) -> Column:
    """Bounded, redacted, one-line preview of a value; embedded base64 is left out."""
    text = text_or_empty(c)
    data_url = text.rlike(r"^\s*data:[^,]{0,75};base64,")
    bare = squash(text).rlike(r"^[A-Za-z0-9+/=_-]{200,}$")
    inline = F.regexp_replace(text, r"(?i)data:[^;,\s]+;base64,[A-Za-z0-9+/=_-]+", "data:[omitted base64 data url]")
    line = squash(redact_text(inline))
    clipped = F.when(F.length(line) <= n, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, n - 3)), F.lit("...")))
    return F.when(data_url, "[omitted base64 data url]").when(bare, "[omitted base64 content]").otherwise(clipped)
