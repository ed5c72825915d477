"""Interval joins over integer time, bucketed so that the equi-join key is (key, time bucket)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_WIDTH_MS = 60_000
_BUCKET = "__bucket"


def _buckets(start: Column, end: Column, width: int) -> Column:
    first = F.floor(start / width).cast("long")
    last = F.floor(F.greatest(start, end - 1) / width).cast("long")
    return F.sequence(first, last)


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    *,
    width: int = DEFAULT_WIDTH_MS,
) -> DataFrame:
    """Pairs whose spans overlap strictly (l.end > r.start and l.start < r.end).

    A pair meets in every bucket both spans touch; it is kept only in the first of them, so no
    distinct is needed. Column names other than ``on`` must differ between the two sides.
    """
    (ls, le), (rs, re_) = left_span, right_span
    lhs = left.withColumn(_BUCKET, F.explode(_buckets(F.col(ls), F.col(le), width)))
    rhs = right.withColumn(_BUCKET, F.explode(_buckets(F.col(rs), F.col(re_), width)))
    first_common = F.greatest(F.floor(F.col(ls) / width), F.floor(F.col(rs) / width))
    return (
        lhs.join(rhs, [*on, _BUCKET])
        .where((F.col(le) > F.col(rs)) & (F.col(ls) < F.col(re_)) & (F.col(_BUCKET) == first_common))
        .drop(_BUCKET)
    )


def midpoint_join(
    points: DataFrame,
    spans: DataFrame,
    on: Sequence[str],
    point_span: tuple[str, str],
    span: tuple[str, str],
    is_last: str,
    *,
    width: int = DEFAULT_WIDTH_MS,
) -> DataFrame:
    """Each row of ``points`` with the span holding its midpoint: half-open, the last span closed.

    Twice the midpoint is compared with twice the bound, so everything stays an integer."""
    twice = F.col(point_span[0]) + F.col(point_span[1])
    lhs = points.withColumn(_BUCKET, F.floor(twice / (2 * width)).cast("long"))
    start, end = F.col(span[0]), F.col(span[1])
    rhs = spans.withColumn(
        _BUCKET,
        F.explode(F.sequence(F.floor(start / width).cast("long"), F.floor(F.greatest(start, end) / width).cast("long"))),
    )
    inside = (twice >= 2 * start) & ((twice < 2 * end) | (F.col(is_last) & (twice == 2 * end)))
    return lhs.join(rhs, [*on, _BUCKET]).where(inside).drop(_BUCKET)
