"""Joining recognised words to speaker segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.plans.intervals import as_of, buckets_of, point_join
from colloquy.schema import UNKNOWN_SPEAKER
from colloquy.session import settle

MEETING = ("meeting_id",)


def _segment_columns(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    return segments.select(
        *keys,
        F.col("start").alias("_seg_start"),
        F.col("end").alias("_seg_end"),
        F.col("seg_idx").alias("_seg_idx"),
        F.col("speaker_id").alias("_seg_speaker"),
    )


def _preference(distance: Column) -> Column:
    """Least distance first, then the earliest segment."""
    return F.struct(
        distance.alias("d"), F.col("_seg_start").alias("s"), F.col("_seg_idx").alias("i")
    )


def overlap_speaker(
    words: DataFrame, segments: DataFrame, keys: Sequence[str] = MEETING
) -> DataFrame:
    """All words with the speaker of the segment they overlap most, null for none.

    An overlap must be longer than zero, so a word without length never has one.
    Words and segments meet in the time buckets they touch. A pair seen in
    several buckets is harmless to the argmax.
    """
    payload = [c for c in words.columns if c not in (*keys, "word_idx")]
    left = words.withColumn("_bucket", F.explode(buckets_of(F.col("start"), F.col("end"))))
    right = _segment_columns(segments, keys).withColumn(
        "_bucket", F.explode(buckets_of(F.col("_seg_start"), F.col("_seg_end")))
    )
    same = F.lit(True)
    for key in (*keys, "_bucket"):
        same = same & (F.col(f"w.{key}") == F.col(f"s.{key}"))
    shared = F.least(F.col("w.end"), F.col("_seg_end")) - F.greatest(
        F.col("w.start"), F.col("_seg_start")
    )
    pairs = (
        left.alias("w")
        .join(right.alias("s"), same & (shared > 0), "left")
        .select("w.*", "_seg_start", "_seg_idx", "_seg_speaker", shared.alias("_shared"))
    )
    # The other columns depend on the word, so they can be keys as well.
    return pairs.groupBy(*keys, "word_idx", *payload).agg(
        F.min_by(
            "_seg_speaker", F.when(F.col("_seg_idx").isNotNull(), _preference(-F.col("_shared")))
        ).alias("speaker_id"),
    )


def nearest_speaker(
    words: DataFrame, segments: DataFrame, keys: Sequence[str] = MEETING
) -> DataFrame:
    """Words with the speaker of the segment nearest to their midpoint.

    The nearest one either holds the midpoint, or is the last to end before it,
    or the first to start after it; each is one as-of lookup per distinct
    midpoint. Words of a key without segments get null.
    """
    mids = words.withColumn("_mid", (F.col("start") + F.col("end")) / 2)
    events = _segment_columns(segments, keys)
    entry = F.struct(
        F.col("_seg_end").alias("e"),
        (-F.col("_seg_start")).alias("s"),
        (-F.col("_seg_idx")).alias("i"),
        F.col("_seg_speaker").alias("who"),
    )
    earlier = as_of(mids, events, keys, "_mid", "_seg_end", {"_left": ("max", entry)})
    entry = F.struct(
        F.col("_seg_start").alias("s"),
        F.col("_seg_idx").alias("i"),
        F.col("_seg_speaker").alias("who"),
    )
    later = as_of(
        mids, events, keys, "_mid", "_seg_start", {"_right": ("min", entry)}, forward=True
    )
    points = mids.select(*keys, "_mid").distinct()
    inside = (
        point_join(points, events, keys, "_mid", ("_seg_start", "_seg_end"), closed=True)
        .groupBy(*keys, "_mid")
        .agg(F.min_by("_seg_speaker", _preference(F.lit(0.0))).alias("_within"))
    )
    at = [*keys, "_mid"]
    to_left = F.col("_mid") - F.col("_left.e")
    to_right = F.col("_right.s") - F.col("_mid")
    nearest = (
        earlier.join(later, at)
        .join(inside, at, "left")
        .select(
            *at,
            F.coalesce(
                F.col("_within"),
                F.when(to_right.isNull() | (to_left <= to_right), F.col("_left.who")),
                F.col("_right.who"),
            ).alias("speaker_id"),
        )
    )
    return mids.drop("speaker_id").join(nearest, at, "left").drop("_mid")


def align_words(
    words: DataFrame, segments: DataFrame, keys: Sequence[str] = MEETING
) -> DataFrame:
    """Every word with a speaker: most overlap, else nearest, else ``unknown``.

    The overlap result feeds three branches, so it is written once.
    """
    first = settle(overlap_speaker(words, segments, keys), "overlap")
    gaps = nearest_speaker(first.where("speaker_id IS NULL"), segments, keys)
    return first.where("speaker_id IS NOT NULL").unionByName(
        gaps.withColumn("speaker_id", F.coalesce("speaker_id", F.lit(UNKNOWN_SPEAKER)))
    )


def clean_words(words: DataFrame, texts: DataFrame) -> DataFrame:
    """Words trimmed, empty ones dropped; a text without words is one untimed word."""
    kept = words.withColumn("word", F.trim("word")).where("word <> ''")
    bare = (
        texts.join(kept.select("meeting_id").distinct(), "meeting_id", "left_anti")
        .withColumn("word", F.trim("text"))
        .where("word <> ''")
        .select(
            "meeting_id",
            F.lit(0).cast("long").alias("word_idx"),
            "word",
            F.lit(0.0).alias("start"),
            F.lit(0.0).alias("end"),
        )
    )
    return kept.select(*bare.columns).unionByName(bare)


def shift_timeline(turns: DataFrame, offset: str) -> DataFrame:
    """Adds a column of seconds to turn times and to the nested word times."""
    by = F.col(offset)
    return turns.withColumns(
        {
            "start": F.col("start") + by,
            "end": F.col("end") + by,
            "words": F.transform(
                "words",
                lambda w: F.struct(
                    w["word"].alias("word"),
                    (w["start"] + by).alias("start"),
                    (w["end"] + by).alias("end"),
                ),
            ),
        }
    )


def active_word(probes: DataFrame, words: DataFrame) -> DataFrame:
    """The last word under each playback position; words last at least 10 ms."""
    reach = words.select(
        "meeting_id",
        "word_idx",
        "start",
        F.greatest(F.col("end"), F.col("start") + 0.01).alias("_until"),
    )
    hits = point_join(probes, reach, ["meeting_id"], "t", ("start", "_until"))
    return hits.groupBy("meeting_id", "probe_id", "t").agg(F.max("word_idx").alias("word_idx"))


def active_turn(probes: DataFrame, turns: DataFrame) -> DataFrame:
    """The first turn under each playback position."""
    spans = turns.select("meeting_id", "turn_idx", "turn_id", "start", "end")
    hits = point_join(probes, spans, ["meeting_id"], "t", ("start", "end"))
    return hits.groupBy("meeting_id", "probe_id", "t").agg(
        F.min_by("turn_id", "turn_idx").alias("turn_id")
    )


def speaker_at(probes: DataFrame, spans: DataFrame, colours: int = 8) -> DataFrame:
    """The first span in order ending at or after each time, if it has begun by then."""
    entry = F.struct(
        F.col("turn_idx").alias("i"), F.col("start").alias("s"), F.col("roster_pos").alias("p"),
        F.col("speaker_id").alias("who"),
    )
    found = as_of(
        probes, spans, ["meeting_id"], "t", "end", {"_span": ("min", entry)}, forward=True
    )
    started = F.col("t") >= F.col("_span.s")
    return probes.join(found, ["meeting_id", "t"], "left").select(
        "meeting_id",
        "probe_id",
        "t",
        F.when(started, F.col("_span.who")).alias("speaker_id"),
        F.when(started, F.pmod(F.col("_span.p"), F.lit(colours))).cast("long").alias("colour"),
    )
