"""Detection of technical labels and presentation wording in visual text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkloom import fixed_values as fx
from talkloom.functions.text import label_key, squash


@dataclass(frozen=True)
class MarkerRules:
    """The patterns in force; the defaults are the published ones, tests and other corpora bring their own."""

    technical: tuple[str, ...] = tuple(fx.TECHNICAL_PATTERNS)
    presentation: tuple[str, ...] = tuple(fx.PRESENTATION_PATTERNS)
    colours: tuple[str, ...] = tuple(fx.BARE_COLOURS)


DEFAULT_RULES = MarkerRules()


def _over_key(pattern: str) -> str:
    """A word pattern rewritten for label keys. Keys hold words and single blanks only, so a word character is
    any non-blank and a boundary is a blank: plain classes, much cheaper than Unicode-aware ones."""
    body = pattern.removeprefix(r"\b").replace(r"\b", "(?= )")
    return body.replace(r"\w", "[^ ]").replace(r"\s+", " ")


def _any_pattern(key: Column, patterns: tuple[str, ...]) -> Column:
    """One alternation per text, tried only where a word starts."""
    padded = F.concat(F.lit(" "), key, F.lit(" "))
    return padded.rlike(" (?:" + "|".join(_over_key(p) for p in patterns) + ")")


def technical_key(key: Column, rules: MarkerRules = DEFAULT_RULES) -> Column:
    return (key != "") & (key.isin(list(rules.colours)) | _any_pattern(key, rules.technical))


def presentation_key(key: Column, rules: MarkerRules = DEFAULT_RULES) -> Column:
    return (key != "") & _any_pattern(key, rules.presentation)


def noise_key(key: Column, rules: MarkerRules = DEFAULT_RULES) -> Column:
    return (key != "") & (key.isin(list(rules.colours)) | _any_pattern(key, rules.technical + rules.presentation))


def is_noise(text: Column, rules: MarkerRules = DEFAULT_RULES) -> Column:
    return noise_key(label_key(text), rules)


def keyed(values: Column) -> Column:
    """Squashed texts with their label keys: the key is worked out once per text, however many tests follow."""
    arr = F.coalesce(values, F.array().cast("array<string>"))
    return F.transform(arr, lambda v: F.struct(squash(v).alias("text"), label_key(v).alias("key")))


def texts(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: p["text"])


def _hits(values: Column, test) -> Column:
    return F.array_distinct(texts(F.filter(keyed(values), lambda p: test(p["key"]))))


def technical_markers(values: Column, rules: MarkerRules = DEFAULT_RULES) -> Column:
    return _hits(values, lambda k: technical_key(k, rules))


def presentation_markers(values: Column, rules: MarkerRules = DEFAULT_RULES) -> Column:
    return _hits(values, lambda k: presentation_key(k, rules))


def noise_markers(values: Column, rules: MarkerRules = DEFAULT_RULES) -> Column:
    """Technical hits first, then presentation hits not already listed."""
    return F.array_union(technical_markers(values, rules), presentation_markers(values, rules))


def drop_key(key: Column, rules: MarkerRules = DEFAULT_RULES) -> Column:
    """An item or topic label that is empty, a bare colour or technical has no place in the knowledge base."""
    return (key == "") | key.isin(list(rules.colours)) | _any_pattern(key, rules.technical)


def safe_text(value: Column, rules: MarkerRules = DEFAULT_RULES) -> Column:
    """The squashed text, or the empty string when it carries any marker."""
    text = squash(value)
    return F.when(is_noise(text, rules), F.lit("")).otherwise(text)


def safe_list(values: Column, rules: MarkerRules = DEFAULT_RULES) -> Column:
    return F.array_distinct(texts(F.filter(keyed(values), lambda p: (p["text"] != "") & ~noise_key(p["key"], rules))))
