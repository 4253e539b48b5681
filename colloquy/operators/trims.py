"""Kept ranges: which turns a trimmed meeting shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a range this close to the whole recording counts as untrimmed.
TRIM_TOLERANCE = 0.05


def _with_range(turns: DataFrame, meetings: DataFrame) -> DataFrame:
    ranges = meetings.select("meeting_id", "kept_start", "kept_end")
    return turns.join(ranges, "meeting_id")


def kept(start: Column, end: Column, kept_start: Column, kept_end: Column) -> Column:
    return kept_start.isNull() | ((end > kept_start) & (start < kept_end))


def kept_turns(turns: DataFrame, meetings: DataFrame) -> DataFrame:
    """Turns overlapping the kept range; without a range, all of them."""
    inside = kept(F.col("start"), F.col("end"), F.col("kept_start"), F.col("kept_end"))
    return _with_range(turns, meetings).where(inside).drop("kept_start", "kept_end")


def trimmed_before_after(turns: DataFrame, meetings: DataFrame) -> DataFrame:
    """Per meeting: turns hidden before and after the kept range."""
    before = F.col("end") <= F.col("kept_start")
    after = F.col("start") >= F.col("kept_end")
    return (
        _with_range(turns, meetings)
        .groupBy("meeting_id")
        .agg(
            F.count(F.when(before, 1)).alias("hidden_before"),
            F.count(F.when(after, 1)).alias("hidden_after"),
        )
    )


def normalize_kept_range(requests: DataFrame) -> DataFrame:
    """Requested ranges put in order; empty ones are refused, full ones become null.

    Adds ``accepted`` and the stored ``kept_start`` / ``kept_end``.
    """
    low, high = F.least("range_start", "range_end"), F.greatest("range_start", "range_end")
    accepted = high > low
    everything = (low <= 0) & (high >= F.col("duration"))
    store = accepted & ~everything
    return requests.withColumns(
        {
            "accepted": accepted,
            "kept_start": F.when(store, low),
            "kept_end": F.when(store, high),
        }
    )


def clamp_trim(requests: DataFrame, minimum: float = 0.0) -> DataFrame:
    """Requested ranges clamped to the recording, and whether that trims anything."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.col(c), F.col("duration")))
    start, end = clamp("range_start"), clamp("range_end")
    trims = (start > TRIM_TOLERANCE) | (end < F.col("duration") - TRIM_TOLERANCE)
    return requests.withColumns(
        {
            "clamped_start": start,
            "clamped_end": end,
            "is_trimmed": trims,
            "is_usable": end - start > minimum,
        }
    )
