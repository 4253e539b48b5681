"""Speech regions, cut points, slices and recognition windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators import blocks
from colloquy.plans.intervals import BUCKET_SECONDS, bucket_of
from colloquy.plans.scan import ordinal, running

# Fixed values, in seconds.
REGION_PADDING = 0.4
SLICE_SECONDS = 75.0
MINIMUM_SLICE = 60.0
MAXIMUM_SLICES = 8
MASK_FRAME = 0.1
WINDOW_SECONDS = 120.0
OVERLAP_SECONDS = 15.0
QUIET_WINDOW = 0.3
QUIET_REACH = 15.0
# Fixed value: every 16th sample of a window is looked at.
QUIET_STEP = 16


def speech_regions(segments: DataFrame, padding: float = REGION_PADDING) -> DataFrame:
    """Padded segments merged where they overlap or touch."""
    padded = segments.select(
        "meeting_id",
        F.greatest(F.lit(0.0), F.col("start") - padding).alias("start"),
        (F.col("end") + padding).alias("end"),
        "seg_idx",
    )
    place = bucket_of(F.col("start"))
    order = [F.col("start"), F.col("seg_idx")]
    seen = running(
        padded, ["meeting_id"], place, order, {"_reach": ("max", F.col("end"))}, inclusive=False
    )
    # A region is named by the start of the segment that opens it, so the island
    # number needs no second counting pass before the aggregation.
    opens = F.when(
        F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), F.col("start")
    )
    named = running(seen, ["meeting_id"], place, order, {"_island": ("max", opens)})
    regions = named.groupBy("meeting_id", F.col("_island").alias("start")).agg(
        F.max("end").alias("end")
    )
    return ordinal(regions, ["meeting_id"], place, [F.col("start")], "region_idx")


def region_gaps(regions: DataFrame) -> DataFrame:
    """Silences between consecutive regions: middle and width."""
    following = regions.select(
        "meeting_id", (F.col("region_idx") - 1).alias("region_idx"), F.col("start").alias("_next")
    )
    return (
        regions.join(following, ["meeting_id", "region_idx"])
        .where(F.col("_next") - F.col("end") > 0)
        .select(
            "meeting_id",
            F.col("region_idx").alias("gap_idx"),
            ((F.col("end") + F.col("_next")) / 2).alias("midpoint"),
            (F.col("_next") - F.col("end")).alias("width"),
        )
    )


def cut_points(
    gaps: DataFrame,
    meetings: DataFrame,
    slice_seconds: float = SLICE_SECONDS,
    minimum: float = MINIMUM_SLICE,
    maximum_slices: int = MAXIMUM_SLICES,
) -> DataFrame:
    """Where to slice a recording: the gap best placed for each even division.

    At most ``maximum_slices - 1`` candidates per meeting are then walked in
    order, keeping slices a minimum length apart.
    """
    n = F.least(
        F.lit(maximum_slices),
        F.greatest(F.lit(1), F.floor(F.col("duration") / slice_seconds).cast("int")),
    )
    targets = (
        meetings.select("meeting_id", "duration", n.alias("slices"))
        .where((F.col("slices") > 1) & (F.col("duration") > minimum * F.col("slices")))
    )
    offered = gaps.join(targets, "meeting_id").withColumn(
        "i", F.explode(F.sequence(F.lit(1), F.col("slices") - 1))
    )
    target = F.col("duration") * F.col("i") / F.col("slices")
    best = offered.groupBy("meeting_id", "duration", "i").agg(
        F.min_by(
            "midpoint",
            F.struct((F.abs(F.col("midpoint") - target) - F.col("width")).alias("c"), "gap_idx"),
        ).alias("cut")
    )
    candidates = best.groupBy("meeting_id", "duration").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "cut"))), lambda x: x["cut"]).alias(
            "offered"
        )
    )
    kept = F.aggregate(
        "offered",
        F.array().cast("array<double>"),
        lambda cuts, cut: F.when(
            (F.size(cuts) > 0) & (cut - F.element_at(cuts, -1) < minimum), cuts
        )
        .when(
            (cut > minimum) & (F.col("duration") - cut > minimum), F.concat(cuts, F.array(cut))
        )
        .otherwise(cuts),
    )
    return candidates.select("meeting_id", F.posexplode(kept).alias("cut_idx", "cut"))


def quietest_near(
    cuts: DataFrame,
    samples: DataFrame,
    rate: float,
    reach_seconds: float = QUIET_REACH,
    window_seconds: float = QUIET_WINDOW,
) -> DataFrame:
    """Each cut moved to the quietest window within reach, the first on ties.

    ``cuts(meeting_id, cut_idx, cut)``, ``samples`` are one channel's blocks.
    """
    return blocks.quietest_near(cuts, samples, rate, reach_seconds, window_seconds, QUIET_STEP)


def slice_bounds(cuts: DataFrame, meetings: DataFrame) -> DataFrame:
    """Slices between consecutive cuts, from 0 to the duration (at most eight each)."""
    edges = cuts.groupBy("meeting_id").agg(F.array_sort(F.collect_list("cut")).alias("_cuts"))
    marks = F.concat(
        F.array(F.lit(0.0)),
        F.coalesce("_cuts", F.array().cast("array<double>")),
        F.array("duration"),
    )
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(marks) - 1),
        lambda i: F.struct(
            (i - 1).alias("slice_idx"),
            F.element_at(marks, i).alias("start"),
            F.element_at(marks, i + 1).alias("end"),
        ),
    )
    return (
        meetings.select("meeting_id", "duration")
        .join(edges, "meeting_id", "left")
        .select("meeting_id", F.inline(pieces))
    )


def slice_rebase(words: DataFrame, slices: DataFrame) -> DataFrame:
    """Slice-local word times turned into times of the whole recording."""
    offsets = slices.select("meeting_id", "slice_idx", F.col("start").alias("_offset"))
    return (
        words.join(offsets, ["meeting_id", "slice_idx"])
        .withColumns(
            {"start": F.col("start") + F.col("_offset"), "end": F.col("end") + F.col("_offset")}
        )
        .drop("_offset")
    )


def overlap_window_stitch(
    tokens: DataFrame,
    window_seconds: float = WINDOW_SECONDS,
    overlap_seconds: float = OVERLAP_SECONDS,
) -> DataFrame:
    """Tokens of overlapping windows, each kept by the window that heard most around it.

    ``tokens(meeting_id, window_idx, …, start)`` with absolute times. A window
    keeps what lies between the middles of its overlaps; the first and the last
    one are open to the outside.
    """
    last = tokens.groupBy("meeting_id").agg(F.max("window_idx").alias("_last"))
    begin = F.col("window_idx") * (window_seconds - overlap_seconds)
    low = begin + overlap_seconds / 2
    high = begin + window_seconds - overlap_seconds / 2
    return (
        tokens.join(last, "meeting_id")
        .where((F.col("window_idx") == 0) | (F.col("start") >= low))
        .where((F.col("window_idx") == F.col("_last")) | (F.col("start") < high))
        .drop("_last")
    )


def vad_mask(regions: DataFrame, meetings: DataFrame, frame: float = MASK_FRAME) -> DataFrame:
    """Speech flag per 0.1 s frame of every meeting; all true where no region exists.

    The spine and the regions are cut by time bucket and meet on ``(meeting,
    bucket)``; frames are made after that. Buckets are hidden in a length until
    they are exploded, so neither side may be taken for a small one and sent.
    """
    per_bucket = round(BUCKET_SECONDS / frame)
    count = F.ceil(F.col("duration") / F.lit(frame)).cast("long")
    any_region = regions.select("meeting_id").distinct().withColumn("_known", F.lit(True))
    lengths = meetings.select("meeting_id", count.alias("_n")).where("_n > 0").join(any_region, "meeting_id", "left")
    begin, until = F.col("_bucket") * per_bucket, (F.col("_bucket") + 1) * per_bucket - 1
    spine = lengths.withColumn(
        "_bucket",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / per_bucket))),
    )
    first = F.greatest(F.lit(0).cast("long"), F.floor(F.col("start") / F.lit(frame)).cast("long"))
    last = F.ceil(F.col("end") / F.lit(frame)).cast("long")
    spoken = (
        regions.select("meeting_id", first.alias("_first"), last.alias("_last"))
        .where("_first <= _last")
        .withColumn(
            "_bucket",
            F.explode(
                F.sequence(F.floor(F.col("_first") / per_bucket), F.floor(F.col("_last") / per_bucket))
            ),
        )
        .groupBy("meeting_id", "_bucket", F.greatest("_first", begin).alias("a"))
        .agg(F.max(F.least("_last", until)).alias("b"))
        .groupBy("meeting_id", "_bucket")
        .agg(F.collect_list(F.struct("a", "b")).alias("_ranges"))  # one a frame at most
    )
    at = F.explode(F.sequence(begin, F.least(until, F.col("_n") - 1))).alias("frame")
    inside = F.exists("_ranges", lambda r: F.col("frame").between(r["a"], r["b"]))
    return (
        spine.join(spoken.hint("merge"), ["meeting_id", "_bucket"], "left")
        .select("meeting_id", "_known", "_ranges", at)
        .select("meeting_id", "frame", (F.coalesce(inside, F.lit(False)) | F.col("_known").isNull()).alias("speech"))
    )
