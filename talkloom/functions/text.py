"""String expressions: whitespace, comparison keys, clipping, punctuation, joins.

Everything is a Column built from JVM functions, so it stays inside generated code.
Java's \\w, \\s and \\b are ASCII-only unless (?U) is set; letters are matched with explicit classes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkloom import fixed_values as fx

SPACE = r"(?U)\s+"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
#: Forms of the letters of the fixed terms (с, т, т) whose capital is the usual one.
OLD_LETTERS = ["\u1c83", "\u1c84", "\u1c85"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def strip(c: Column | str) -> Column:
    """Remove leading and trailing whitespace of any kind (not only blanks).

    Of a plain column, only texts with such an edge are searched."""
    stripped = F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")
    if not isinstance(c, str):
        return stripped
    return F.when(F.concat(F.left(_col(c), F.lit(1)), F.right(_col(c), F.lit(1))).rlike(r"(?U)\s"), stripped).otherwise(_col(c))


def squash(c: Column | str) -> Column:
    """Collapse whitespace runs to one blank and trim; NULL becomes the empty string."""
    return F.trim(F.regexp_replace(text_or_empty(c), SPACE, " "))


def fold_case(c: Column | str) -> Column:
    """Case folding: lower case plus the two letters lower() leaves alone."""
    return F.replace(F.replace(F.lower(_col(c)), F.lit("ς"), F.lit("σ")), F.lit("ß"), F.lit("ss"))


def compare_key(c: Column | str) -> Column:
    """Key under which two texts count as the same."""
    return fold_case(squash(c))


def label_key(c: Column | str) -> Column:
    """Key of a visual label: folded, ё as е; dashes, punctuation and blanks between words are one blank."""
    folded = F.replace(fold_case(text_or_empty(c)), F.lit("ё"), F.lit("е"))
    return F.trim(F.regexp_replace(folded, NOT_WORD + "+", " "))


def unique_in_order(values: Column | str) -> Column:
    """Stripped, non-empty, first occurrence kept."""
    arr = F.coalesce(_col(values), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(arr, strip), lambda s: s.isNotNull() & (s != "")))


def clean_list(values: Column | str) -> Column:
    arr = F.coalesce(_col(values), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(arr, squash), lambda s: s != ""))


def join_paragraphs(*parts: Column) -> Column:
    """Join the non-empty parts with a blank line."""
    stripped = F.transform(F.array(*[text_or_empty(p) for p in parts]), strip)
    return F.array_join(F.filter(stripped, lambda s: s != ""), "\n\n")


def join_array(values: Column, sep: str) -> Column:
    return F.array_join(F.filter(values, lambda s: s.isNotNull() & (s != "")), sep)


def word_count(c: Column | str) -> Column:
    """Number of runs of non-blank characters."""
    return F.regexp_count(text_or_empty(c), F.lit(r"(?U)\S+")).cast("long")


def clip_words(c: Column | str, n: int) -> Column:
    """Clip to n characters, preferably at the last blank."""
    value = _col(c)
    head = F.rtrim(F.substring(value, 1, n))
    at_word = F.rtrim(F.regexp_replace(head, " [^ ]*$", ""))
    clipped = F.when(F.contains(head, F.lit(" ")), F.coalesce(F.nullif(at_word, F.lit("")), head)).otherwise(head)
    return F.when(F.length(value) <= n, value).otherwise(clipped)


def clip_ellipsis(c: Column | str, n: int) -> Column:
    value = squash(c)
    return F.when(F.length(value) <= n, value).otherwise(F.concat(F.rtrim(F.substring(value, 1, n - 3)), F.lit("...")))


def _char_class(chars: Iterable[str]) -> str:
    return "[" + "".join(re.escape(ch) for ch in chars) + r"\s]+$"


def terminal_char(c: Column | str) -> Column:
    """Last character once closing quotes, brackets and blanks are ignored; NULL when nothing is left."""
    rest = F.regexp_replace(text_or_empty(c), "(?U)" + _char_class(fx.TRAILING_WRAPPER_CHARS), "")
    return F.nullif(F.right(rest, F.lit(1)), F.lit(""))


def sentence_count(c: Column | str) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit("[.!?…]+")).cast("long")


def starts_lower(c: Column | str) -> Column:
    return text_or_empty(c).rlike(r"(?U)^\s*\p{Ll}")


def first_word(c: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_extract(text_or_empty(c), "[A-Za-zА-Яа-яЁё-]+", 0), F.lit("-")))


def is_blank(c: Column | str) -> Column:
    return ~text_or_empty(c).rlike(r"(?U)\S")


def leads_with_space(c: Column | str) -> Column:
    return text_or_empty(c).rlike(r"(?U)^\s")


def repair_homoglyphs(c: Column | str) -> Column:
    """In words that mix Cyrillic with look-alike Latin letters, turn the Latin ones Cyrillic."""
    value = _col(c)
    word = r"[\p{L}\p{N}_-]"
    look_alike = f"[{fx.HOMOGLYPH_LATIN}]"
    cyrillic = "[А-Яа-яЁё]"
    pieces = F.regexp_extract_all(value, F.lit(f"({word}+|[^\\p{{L}}\\p{{N}}_-]+)"), F.lit(0))
    repaired = F.array_join(
        F.transform(
            pieces,
            lambda w: F.when(
                w.rlike(cyrillic) & w.rlike(look_alike), F.translate(w, fx.HOMOGLYPH_LATIN, fx.HOMOGLYPH_CYRILLIC)
            ).otherwise(w),
        ),
        "",
    )
    return F.when(value.rlike(cyrillic) & value.rlike(look_alike), repaired).otherwise(value)


def _replace_keeping_case(value: Column, stem: str, endings: str, replacement: str) -> Column:
    """Replace a term; an upper-case term gives an upper-case result, a capitalised one a capitalised result."""
    upper = F.regexp_replace(value, rf"(?U)\b{stem.upper()}{endings.upper()}\b", replacement.upper())
    title = F.regexp_replace(
        upper,
        rf"(?U)\b{stem[0].upper()}(?iu:{stem[1:]}{endings})\b",
        replacement[0].upper() + replacement[1:],
    )
    return F.regexp_replace(title, rf"(?iU)\b{stem}{endings}\b", replacement)


def has_sock_context(c: Column | str) -> Column:
    return text_or_empty(c).rlike("(?iU)" + fx.SOCK_CONTEXT_PATTERN)


def _may_hold(c: Column | str, *words: str) -> Column:
    """Whether one of some Cyrillic words may be in the text in any case: a cheap test before a pattern that ignores case.
    Such patterns also take the old letter forms that lower case leaves alone; texts with any of those are searched."""
    low = F.lower(text_or_empty(c))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in [*words, *OLD_LETTERS]])


def has_sock_term(c: Column | str) -> Column:
    return _may_hold(c, fx.SOCK_TERM_STEM) & text_or_empty(c).rlike(rf"(?iU)\b{fx.SOCK_TERM_STEM}{fx.SOCK_TERM_ENDINGS}\b")


def has_unnormalised_term(c: Column | str) -> Column:
    alternatives = "|".join(term for term, _ in fx.DOMAIN_TERMS)
    return _may_hold(c, *[term for term, _ in fx.DOMAIN_TERMS]) & text_or_empty(c).rlike(rf"(?iU)\b(?:{alternatives})\b")


def replace_domain_terms(c: Column | str, context: Column) -> Column:
    """Fixed term repairs, plus the sock term where its context words are present.

    A cheap test runs first: most texts hold no such term and skip the replacement chain."""
    value = _col(c)
    fixed = value
    for term, replacement in fx.DOMAIN_TERMS:
        fixed = _replace_keeping_case(fixed, term, "", replacement)
    fixed = F.when(has_unnormalised_term(value), fixed).otherwise(value)
    socks = _replace_keeping_case(fixed, fx.SOCK_TERM_STEM, fx.SOCK_TERM_ENDINGS, fx.SOCK_TERM_REPLACEMENT)
    return F.when(has_sock_term(value) & has_sock_context(context), socks).otherwise(fixed)


def strip_evidence_prefix(c: Column | str) -> Column:
    once = strip(F.regexp_replace(text_or_empty(c), "(?iU)" + fx.EVIDENCE_PREFIX_PATTERN, ""))
    return strip(F.regexp_replace(once, "(?iU)" + fx.EVIDENCE_SAYS_PATTERN, ""))
