"""Secret scans: fixed patterns, and sliding-window Shannon entropy for what has no pattern.

Each character class has an alphabet, a window and a bound in bits a character. Candidates are the longest runs of the
alphabet of a window or more. A window slides over them; one count goes up and one down at each step, and the sum of
c log c over the counts follows by the difference of two table entries. Windows at or over the bound that touch form a
span. Candidates that an allow-list knows (words, numbers, placeholders, digests of nothing) add no spans, nor do spans
inside one that a pattern has found."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN_REST = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
BASE_KINDS = ("assign", "access", "hex")


class CharacterClass(NamedTuple):
    kind: str
    alphabet: str
    window: int
    bits: float


#: Random strings have some 3.5 (hex) and 4.3 bits in such windows, prose under 3.8; the alphabets are regex classes.
CLASSES = (CharacterClass("entropy_hex", "0-9A-Fa-f", 20, 3.05), CharacterClass("entropy_base64", "A-Za-z0-9+/_=-", 24, 4.05))
#: Candidates that match one of these as a whole.
ALLOWED = (
    "[0-9]+",
    "[A-Z]?[a-z]+(?:(?:[-_/][A-Z]?|[A-Z])[a-z]+)*",  # words, also joined by signs or capitals
    "[A-Z]+(?:[-_][A-Z]+)*",
    "d41d8cd98f00b204e9800998ecf8427e",  # MD5, SHA-1 and SHA-256 of nothing
    "da39a3ee5e6b4b0d3255bfef95601890afd80709",
    "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
)
#: Candidates that hold one of these, in lower case.
PLACEHOLDERS = ("example", "placeholder", "0123456789", "abcdefghij")

_ASSIGN = re.compile(f"({'|'.join(KEYWORDS)}){ASSIGN_REST}", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile(f"[0-9a-f]{{{HEX_LEAST},}}")  # whole runs, like those of + that are long enough
_RUNS = tuple(re.compile(f"(?<![{c.alphabet}])[{c.alphabet}]{{{c.window},}}") for c in CLASSES)
_ALLOWED = re.compile("|".join(f"(?:{a})" for a in ALLOWED))
_UNIT = 1 << 32

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def _terms(window: int) -> list[int]:
    """c log2 c for counts up to a window, in fixed point, so that sums of any length stay exact."""
    return [round(c * math.log2(c) * _UNIT) if c else 0 for c in range(window + 1)]


_TERMS = {c.window: _terms(c.window) for c in CLASSES}


def entropy_spans(text: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Where windows of at least `bits` a character lie, those that overlap or touch as one."""
    terms = _TERMS.get(window) or _terms(window)
    most = math.floor((math.log2(window) - bits) * window * _UNIT)  # entropy = log2(window) - sum / window
    counts: dict[str, int] = {}
    total, spans = 0, []
    for k, sign in enumerate(text):
        c = counts.get(sign, 0)
        counts[sign] = c + 1
        total += terms[c + 1] - terms[c]
        if k >= window - 1:
            start = k - window + 1
            if total <= most:
                if spans and start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], k + 1)
                else:
                    spans.append((start, k + 1))
            c = counts[text[start]]
            counts[text[start]] = c - 1
            total += terms[c - 1] - terms[c]
    return spans


def allowed(candidate: str) -> bool:
    lowered = candidate.lower()
    return bool(_ALLOWED.fullmatch(candidate)) or any(p in lowered for p in PLACEHOLDERS)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Whole matches of the patterns, by kind and start; matches too short are dropped with what they cover."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a text in code points, by start, then kind in the order of BASE_KINDS and CLASSES."""
    base = base_spans(text)
    found = list(base)
    for kind, runs in zip(CLASSES, _RUNS, strict=True):
        for run in runs.finditer(text):
            if allowed(run[0]):
                continue
            for start, end in entropy_spans(run[0], kind.window, kind.bits):
                start, end = start + run.start(), end + run.start()
                if not any(s <= start and end <= e for _, s, e in base):
                    found.append((kind.kind, start, end))
    order = {k: n for n, k in enumerate((*BASE_KINDS, *(c.kind for c in CLASSES)))}
    return sorted(found, key=lambda x: (x[1], order[x[0]]))


def secret_spans(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive) for every row of `docs`.

    Null and empty texts have no spans. Repeated rows and rows without an id are each scanned; texts are scanned whole,
    in time proportional to their length. An empty table gives an empty result; other columns, whatever their names, are
    ignored."""
    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_spans(t.as_py() or "")] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(one))], ["doc_id", "spans"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(docs[id_column].alias("id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, spans {SPANS}")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined) for every row of `docs`."""
    found = secret_spans(docs)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
