"""Helpers shared by the training-data operators: tables, text expressions, and byte-level token hashing for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than blank and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Bytes of text that a worker hashes at once; a longer text is taken alone, piece by piece.
SEGMENT_BYTES = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII signs divide words too.
SIGNS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 3)  # P, with P - 1 = 2 mod 4
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20_240_517)).integers(1, 2**64, 256, dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text with A to Z in lower case; none for null or blank texts."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_MULTIPLIER), -1, 2**64))
        for name, base in (("up", _MULTIPLIER), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def _hash_segment(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts laid end to end, and where each text's words begin."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = gaps[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts], after[cuts - 1] = True, True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after)
    up, down = _power_tables(n)
    sums = np.cumsum(_BYTE_VALUES[_LOWER[data]] * up[:n])
    hashes = (sums[ends] - np.where(starts > 0, sums[np.maximum(starts, 1) - 1], np.uint64(0))) * down[starts]
    return mix64(hashes), np.searchsorted(starts, offsets)


def _hash_long(data: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, by pieces cut at blanks (a single longer word grows its piece)."""
    parts, start = [], 0
    while start < len(data):
        end = min(len(data), start + SEGMENT_BYTES)
        if end < len(data):
            blanks = np.flatnonzero(gaps[data[start:end]])
            while not len(blanks) and end < len(data):
                at, end = end, min(len(data), end + SEGMENT_BYTES)
                blanks = np.flatnonzero(gaps[data[at:end]]) + (at - start)
            if len(blanks) and end < len(data):
                end = start + int(blanks[-1]) + 1
        parts.append(_hash_segment(data[start:end], np.array([0, end - start]), gaps)[0])
        start = end
    return np.concatenate(parts)


def word_hashes(texts: pa.Array, gaps: np.ndarray = _SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, word offsets) of consecutive rows of a string array, in segments of bounded bytes.

    Words are runs of bytes outside `gaps`, lower-cased in A to Z; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.zeros(len(texts) + 1, np.int64)
    lengths = np.array(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    np.cumsum(lengths, out=offsets[1:])
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    places = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, kind)
    body = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SEGMENT_BYTES, "right")) - 1)
        piece = data[int(places[first]) : int(places[last])]
        if last == first + 1 and len(piece) > SEGMENT_BYTES:
            hashes = _hash_long(piece, gaps)
            yield first, hashes, np.array([0, len(hashes)])
        else:
            yield first, *_hash_segment(piece, (places[first : last + 1] - places[first]).astype(np.int64), gaps)
        first = last
