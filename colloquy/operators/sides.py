"""Two-channel recordings: loudness, side attribution, bleed, folding, waveforms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.vectors import decibels
from colloquy.operators import blocks
from colloquy.operators.align import align_words
from colloquy.schema import MICROPHONE, SYSTEM_AUDIO
from colloquy.session import settle

# Frame length and the level below which a channel is silent.
FRAME_SECONDS = 0.02
SILENCE_FLOOR = 0.005
# Limits of the bleed estimate (decibels, frames, shares).
MAXIMUM_LAG = 10
MINIMUM_FRAMES = 5
AUDIBLE_RANGE = 20.0
SILENCE_DECIBELS = -120.0
MINIMUM_DECIBELS = -60.0
INLIER_BAND = 6.0
MINIMUM_EVIDENCE = 0.5
TOLERANCE = 3.0
# The meter falls to this share per tick; buckets of a waveform.
METER_DECAY = 0.6
WAVEFORM_BUCKETS = 2000


def present_sides(samples: DataFrame, declared: DataFrame) -> DataFrame:
    """Channels that count as sources: loud enough, two of them, declared separate."""
    return blocks.present_sides(samples, declared, SILENCE_FLOOR)


def measured_sides(packed: DataFrame) -> DataFrame:
    """Which sides of a meeting have frames, from packed frames."""
    return packed.groupBy("meeting_id").agg(
        F.max(F.col("microphone_last").isNotNull()).alias("_has_mic"),
        F.max(F.col("system_last").isNotNull()).alias("_has_sys"),
    )


def word_side_energy(words: DataFrame, packed: DataFrame, frame_seconds: float = FRAME_SECONDS) -> DataFrame:
    """Mean frame energy of each word on both sides, 0 outside the frames."""
    return blocks.word_side_energy(words, packed, frame_seconds)


def attribute_side(words: DataFrame, packed: DataFrame, frame_seconds: float = FRAME_SECONDS) -> DataFrame:
    """Words with the louder side; ties and silence go to the microphone.

    A meeting with one measured side has that side, one with none has null.
    """
    loud = word_side_energy(words, packed, frame_seconds).join(measured_sides(packed), "meeting_id", "left")
    return loud.withColumn(
        "side",
        F.when(
            F.col("_has_mic") & F.col("_has_sys"),
            F.when(
                F.col("system_energy") > F.col("microphone_energy"), F.lit(SYSTEM_AUDIO)
            ).otherwise(F.lit(MICROPHONE)),
        )
        .when(F.col("_has_mic"), F.lit(MICROPHONE))
        .when(F.col("_has_sys"), F.lit(SYSTEM_AUDIO)),
    ).drop("_has_mic", "_has_sys")


def align_two_sided(
    words: DataFrame,
    segments: DataFrame,
    packed: DataFrame,
    frame_seconds: float = FRAME_SECONDS,
) -> DataFrame:
    """Words aligned against the segments of their own side only.

    Meetings without two measured sides are aligned against all their segments.
    Both kinds go through one alignment: the side, or none, is part of its key.
    """
    two = measured_sides(packed).where("_has_mic AND _has_sys").select("meeting_id", F.lit(True).alias("_two"))
    sided = attribute_side(words, packed, frame_seconds).drop("microphone_energy", "system_energy")
    side = F.when(F.col("_two"), F.col("side")).otherwise(F.lit(""))
    keyed = sided.join(two, "meeting_id", "left").withColumn("side", side).drop("_two")
    spoken = segments.join(two, "meeting_id", "left").withColumn("side", side).drop("_two")
    aligned = align_words(keyed, spoken, ("meeting_id", "side"))
    return aligned.withColumn("side", F.when(F.col("side") != "", F.col("side")))


def qualified_id(side: Column, speaker_id: Column) -> Column:
    """Cluster ids are only unique within a side, so they carry its prefix."""
    prefix = F.when(side == MICROPHONE, "mic").when(side == SYSTEM_AUDIO, "sys")
    return F.when(side.isNotNull(), F.concat(prefix, F.lit(":"), speaker_id)).otherwise(speaker_id)


# -- bleed from one channel into the other ----------------------------------


def lagged_pairs(packed: DataFrame) -> DataFrame:
    """Microphone frames against system frames ``lag`` frames earlier."""
    return blocks.lagged_pairs(packed, MAXIMUM_LAG)


def bleed_coupling(packed: DataFrame) -> DataFrame:
    """How the system channel is heard in the microphone, one row per coupled meeting.

    Per lag, the offset is the level difference at rank ``count div 10`` over
    audible frames and the evidence the share of frames within 6 dB of it.
    """
    found = settle(
        blocks.ranked_lags(
            packed, 10, SILENCE_DECIBELS, AUDIBLE_RANGE, INLIER_BAND, MINIMUM_FRAMES, MAXIMUM_LAG
        ),
        "lags",
    )
    evidence = (
        found.where((F.col("lag") >= 0) & (F.col("n") >= MINIMUM_FRAMES) & (F.col("offset") > MINIMUM_DECIBELS))
        .withColumn("evidence", F.col("near") / F.col("n"))
        .where(F.col("evidence") > MINIMUM_EVIDENCE)
    )
    best = evidence.groupBy("meeting_id").agg(
        F.max_by(
            F.struct("lag", "offset", "evidence"),
            F.struct(F.col("evidence"), (-F.col("lag")).alias("l")),
        ).alias("b")
    )
    noise = found.where("lag < 0").select("meeting_id", F.col("offset").alias("noise_db"))
    return best.join(noise, "meeting_id").select(
        "meeting_id",
        F.col("b.lag").cast("long").alias("lag"),
        F.col("b.offset").alias("offset_db"),
        F.pow(F.lit(10.0), F.col("b.offset") / 10).alias("gain"),
        F.col("b.evidence").alias("evidence"),
        "noise_db",
    )


def gate_frames(frames: DataFrame, coupling: DataFrame) -> DataFrame:
    """Microphone frames marked where the other channel or noise explains them."""
    microphone = frames.where(F.col("side") == MICROPHONE).join(coupling, "meeting_id")
    system = frames.where(F.col("side") == SYSTEM_AUDIO).select(
        "meeting_id",
        F.col("frame").alias("_source"),
        decibels(F.col("energy")).alias("_sys_db"),
    )
    limit = F.greatest(F.col("_sys_db") + F.col("offset_db"), F.col("noise_db"))
    silenced = decibels(F.col("energy")) <= limit + 10 * math.log10(TOLERANCE)
    return (
        microphone.withColumn("_source", F.col("frame") - F.col("lag"))
        .join(system, ["meeting_id", "_source"], "left")
        .select("meeting_id", "frame", "energy", F.coalesce(silenced, F.lit(False)).alias("gated"))
    )


# -- samples -------------------------------------------------------------


def waveform_resample(peaks: DataFrame, bars: int) -> DataFrame:
    """Peaks regrouped into exactly ``bars`` bars, each at least one bucket wide.

    A bucket knows the bars it falls into, so the peaks are never joined back.
    """
    lengths = peaks.groupBy("meeting_id").agg((F.max("bucket") + 1).alias("_n"))
    # Bar i covers [i*n div bars, max(that + 1, (i+1)*n div bars)).
    b, n = F.col("bucket"), F.col("_n")
    low = F.floor((b * bars) / n).cast("long")
    high = F.floor(((b + 1) * bars) / n).cast("long")
    spread = peaks.join(lengths, "meeting_id").withColumn(
        "bar", F.explode(F.sequence(low, F.least(high, F.lit(bars - 1).cast("long"))))
    )
    begin = F.floor(F.col("bar") * n / bars).cast("long")
    end = F.greatest(begin + 1, F.floor((F.col("bar") + 1) * n / bars).cast("long"))
    return (
        spread.where((b >= begin) & (b < end))
        .groupBy("meeting_id", "bar")
        .agg(F.max("peak").alias("peak"))
    )


def meter_decay(
    levels: DataFrame, keys: list[str], position: str, level: str, chunk: int = 65_536
) -> DataFrame:
    """Meter that jumps up and falls by a fixed share per tick.

    In logarithms the meter is the running maximum of the levels, each raised
    by what has fallen since. It is taken inside chunks; every chunk hands the
    level at its end, fallen further, to all later ones.
    """
    fall = math.log(METER_DECAY)
    place = F.floor(F.col(position) / chunk).cast("long")
    within = F.col(position) - F.col("_chunk") * chunk
    raised = F.ln(F.when(F.col(level) > 0, F.col(level))) - within * fall
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    chunked = levels.withColumn("_chunk", place)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        chunked.groupBy(*keys, "_chunk")
        .agg(F.max(raised).alias("_raised"))
        .withColumn("_carried", F.max(F.col("_raised") - F.col("_chunk") * chunk * fall).over(before))
        .select(*keys, "_chunk", (F.col("_carried") + F.col("_chunk") * chunk * fall).alias("_carried"))
    )
    best = F.greatest("_best", "_carried")
    return (
        chunked.withColumn("_best", F.max(raised).over(inside))
        .join(carried, [*keys, "_chunk"], "left")
        .select(*levels.columns, F.coalesce(F.exp(best + within * fall), F.lit(0.0)).alias("meter"))
    )
