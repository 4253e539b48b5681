"""Joins on time: interval overlap, point in interval, nearest before and after.

Spark plans a bare range predicate as a nested loop. Every join here is an
equi-join on ``(meeting, time bucket)`` with the range predicate as a residual,
so it shuffles by key and a long meeting spreads over its buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.plans.scan import running

#: Seconds per time bucket.
BUCKET_SECONDS = 30.0


def bucket_of(time: Column, seconds: float = BUCKET_SECONDS) -> Column:
    return F.floor(time / F.lit(seconds)).cast("long")


def buckets_of(start: Column, end: Column, seconds: float = BUCKET_SECONDS) -> Column:
    """Every bucket an interval touches; a reversed interval touches its start only."""
    return F.sequence(bucket_of(start, seconds), bucket_of(F.greatest(start, end), seconds))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_range: tuple[str, str],
    right_range: tuple[str, str],
    seconds: float = BUCKET_SECONDS,
) -> DataFrame:
    """Pairs of intervals sharing more than a point, each pair once.

    Both sides are repeated per bucket they touch; a pair is kept only in the
    later of the two first buckets, so no de-duplication is needed.
    """
    ls, le = left_range
    rs, re = right_range
    a = left.withColumn("_bucket", F.explode(buckets_of(F.col(ls), F.col(le), seconds)))
    b = right.withColumn("_bucket", F.explode(buckets_of(F.col(rs), F.col(re), seconds)))
    joined = a.join(b, [*keys, "_bucket"])
    return joined.where(
        (F.least(F.col(le), F.col(re)) - F.greatest(F.col(ls), F.col(rs)) > 0)
        & (
            F.col("_bucket")
            == F.greatest(bucket_of(F.col(ls), seconds), bucket_of(F.col(rs), seconds))
        )
    ).drop("_bucket")


def point_join(
    points: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    time: str,
    span_range: tuple[str, str],
    seconds: float = BUCKET_SECONDS,
    closed: bool = False,
) -> DataFrame:
    """Points joined to the spans with ``start <= t < end`` (``<= end`` if closed)."""
    start, end = span_range
    a = points.withColumn("_bucket", bucket_of(F.col(time), seconds))
    b = spans.withColumn("_bucket", F.explode(buckets_of(F.col(start), F.col(end), seconds)))
    inside = (F.col(time) >= F.col(start)) & (
        (F.col(time) <= F.col(end)) if closed else (F.col(time) < F.col(end))
    )
    return a.join(b, [*keys, "_bucket"]).where(inside).drop("_bucket")


def as_of(
    points: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    time: str,
    event_time: str,
    values: Mapping[str, tuple[str, Column]],
    forward: bool = False,
    seconds: float = BUCKET_SECONDS,
) -> DataFrame:
    """For every distinct ``(keys, time)`` point: a scan over the events up to it.

    Events at exactly the point's time count. ``forward=True`` scans the events
    at or after the point instead. Points are reduced to distinct times first,
    so many points at one instant cost one row; join the answer back on
    ``(keys, time)``.
    """
    sign = -1.0 if forward else 1.0
    probe = points.select(*keys, F.col(time).alias("_time")).distinct()
    probe = probe.withColumn("_kind", F.lit(1))
    seen = events.select(
        *keys,
        F.col(event_time).alias("_time"),
        F.lit(0).alias("_kind"),
        *[expression.alias(f"_v_{name}") for name, (_, expression) in values.items()],
    )
    both = seen.unionByName(probe, allowMissingColumns=True)
    scanned = running(
        both,
        keys,
        bucket_of(F.col("_time") * F.lit(sign), seconds),
        [F.col("_time") * F.lit(sign), F.col("_kind")],
        {name: (kind, F.col(f"_v_{name}")) for name, (kind, _) in values.items()},
    )
    return scanned.where("_kind = 1").select(*keys, F.col("_time").alias(time), *values)
