"""Transcript tables derived from the given driver tables.

The driver tables hold no transcripts, so words, segments, frames, samples,
profiles and a library are derived with integer formulas that SQL can repeat.
Times are built in whole milliseconds and divided once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators.blocks import pack_frames, pack_samples
from colloquy.plans.scan import ordinal, position_chunk, running
from colloquy.schema import LANGUAGES, MICROPHONE, SYSTEM_AUDIO
from colloquy.session import settle

_LANGUAGE_NAMES = [row[0] for row in LANGUAGES]


def seconds(ms: Column) -> Column:
    return ms.cast("double") / F.lit(1000.0)


def pick(index: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


_written: dict[tuple[str, str, str], DataFrame] = {}


class DriverTables:
    """Lazily derived transcript tables over one data folder.

    The three tables that need an ordered scan are written once per application
    and folder; all others are projections and joins over them.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _written:
            _written[key] = settle(build(), name)
        return _written[key]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- conversations ---------------------------------------------------

    @cached_property
    def spoken(self) -> DataFrame:
        """One row per conversation turn with its words and the index of the first."""
        return self._once("spoken", self._spoken)

    def _spoken(self) -> DataFrame:
        rows = (
            self.read("conversations")
            .select(
                F.col("conv_id").cast("string").alias("meeting_id"),
                "conv_id",
                "turn",
                "role",
                F.filter(F.split("text", r"\s+", -1), lambda w: w != "").alias("spoken"),
            )
            .withColumn("n_words", F.size("spoken").cast("long"))
        )
        return running(
            rows,
            ["meeting_id"],
            position_chunk("turn", 4096),
            [F.col("turn")],
            {"first_word": ("sum", F.col("n_words"))},
            inclusive=False,
        )

    @staticmethod
    def _start_ms(index: Column, turn: Column) -> Column:
        pause = F.floor(index / 200).cast("long") * 1700
        return index * 400 + pause + turn * 100 + F.floor(turn / 3).cast("long") * 2000

    @cached_property
    def words(self) -> DataFrame:
        exploded = self.spoken.select(
            "meeting_id",
            "conv_id",
            "turn",
            "role",
            "first_word",
            F.posexplode("spoken").alias("pos", "word"),
        )
        index = F.col("first_word") + F.col("pos")
        return exploded.select(
            "meeting_id",
            index.alias("word_idx"),
            "word",
            seconds(self._start_ms(index, F.col("turn"))).alias("start"),
            seconds(self._start_ms(index, F.col("turn")) + 350).alias("end"),
            "turn",
            "role",
            "conv_id",
        )

    @cached_property
    def segments(self) -> DataFrame:
        """One speaker segment per turn, shifted so that some words fall in gaps."""
        conv, turn = F.col("conv_id"), F.col("turn")
        first = self._start_ms(F.col("first_word"), turn)
        last = self._start_ms(F.col("first_word") + F.col("n_words") - 1, turn) + 350
        return (
            self.spoken.where("n_words > 0")
            .where((conv % 13 != 0) & ((conv + turn) % 11 != 0))
            .select(
                "meeting_id",
                turn.alias("seg_idx"),
                self._side(F.col("role")).alias("side"),
                F.col("role").alias("speaker_id"),
                seconds(first - 400 + (conv * 7 + turn * 131) % 600).alias("start"),
                seconds(last + 400 - (conv * 5 + turn * 211) % 600).alias("end"),
                ((conv * 37 + turn * 11) % 500).alias("vec_id"),
                "conv_id",
            )
        )

    @staticmethod
    def _side(role: Column) -> Column:
        return F.when(role == "user", MICROPHONE).otherwise(SYSTEM_AUDIO)

    @cached_property
    def voiced_segments(self) -> DataFrame:
        vectors = self.read("embeddings").select("vec_id", "embedding")
        return self.segments.join(vectors, "vec_id", "left")

    @cached_property
    def turns(self) -> DataFrame:
        """One row per conversation turn; every ninth was edited and lost its timings."""
        turn, first = F.col("turn"), F.col("first_word")
        timed = F.transform(
            "spoken",
            lambda w, i: F.struct(
                w.alias("word"),
                seconds(self._start_ms(first + i, turn)).alias("start"),
                seconds(self._start_ms(first + i, turn) + 350).alias("end"),
            ),
        )
        edited = (F.col("conv_id") * 2 + turn) % 9 == 0
        last = self._start_ms(first + F.col("n_words") - 1, turn) + 350
        return self.spoken.where("n_words > 0").select(
            "meeting_id",
            turn.alias("turn_idx"),
            F.concat("meeting_id", F.lit("-"), turn.cast("string")).alias("turn_id"),
            F.col("role").alias("speaker_id"),
            seconds(self._start_ms(first, turn)).alias("start"),
            seconds(last).alias("end"),
            tx.joined_text(F.col("spoken")).alias("text"),
            F.when(~edited, timed).alias("words"),
            edited.alias("is_edited"),
            "conv_id",
        )

    @cached_property
    def meetings(self) -> DataFrame:
        """One row per conversation with the properties a stored meeting carries."""
        conv = F.col("conv_id")
        last = self._start_ms(F.col("first_word") + F.col("n_words") - 1, F.col("turn")) + 350
        length = self.spoken.groupBy("meeting_id", "conv_id").agg(
            (F.max(last) + 1000).alias("ms")
        )
        kept = conv % 3 == 0
        return length.select(
            "meeting_id",
            "conv_id",
            F.lit(1).alias("schema_version"),
            F.concat(F.lit("Meeting "), conv.cast("string")).alias("title"),
            F.concat(
                F.lit("/audio/"), F.floor(conv * 2 / 3).cast("long").cast("string"), F.lit(".m4a")
            ).alias("audio_path"),
            seconds(F.col("ms")).alias("duration"),
            F.timestamp_seconds(F.lit(1_704_067_200) + conv * 3607).alias("imported_at"),
            pick(conv % 10, _LANGUAGE_NAMES).alias("language"),
            F.when(conv % 13 == 0, F.lit("diarization")).alias("degraded"),
            F.when(kept, seconds(F.floor(F.col("ms") / 4))).alias("kept_start"),
            F.when(kept, seconds(F.floor(F.col("ms") * 3 / 4))).alias("kept_end"),
            F.when(conv % 5 == 0, F.lit(True)).alias("fast"),
            F.when(conv % 4 != 0, F.lit("whisper-large-v3")).alias("model"),
            F.when(conv % 2 == 0, pick((conv + 3) % 10, _LANGUAGE_NAMES)).alias("target"),
        )

    @cached_property
    def speakers(self) -> DataFrame:
        """A roster per conversation; the third role is missing from every fifth."""
        length = F.col("end") - F.col("start")
        roles = self.turns.groupBy("meeting_id", "conv_id", F.col("speaker_id")).agg(
            F.round(F.sum(length), 3).alias("total_duration")
        )
        position = F.when(F.col("speaker_id") == "user", 0).when(
            F.col("speaker_id") == "assistant", 1
        ).otherwise(2)
        return (
            roles.withColumn("roster_pos", position)
            .where((F.col("roster_pos") < 2) | (F.col("conv_id") % 5 != 0))
            .select(
                "meeting_id",
                "roster_pos",
                "speaker_id",
                F.when(F.col("roster_pos") == 0, F.lit("Anna & Co"))
                .otherwise(F.concat(F.lit("Speaker "), (F.col("roster_pos") + 1).cast("string")))
                .alias("name"),
                (F.col("roster_pos") == 0).alias("is_named"),
                "total_duration",
                F.when(F.col("conv_id") % 4 != 0, self._side(F.col("speaker_id"))).alias("side"),
                ((F.col("conv_id") * 3 + F.col("roster_pos")) % 500).alias("vec_id"),
                "conv_id",
            )
        )

    @cached_property
    def translations(self) -> DataFrame:
        """Lines for three turns in four, in the meeting's target language."""
        lines = self.turns.where((F.col("conv_id") * 3 + F.col("turn_idx")) % 4 != 0)
        return lines.join(
            self.meetings.where("target IS NOT NULL").select("meeting_id", "target"), "meeting_id"
        ).select(
            "meeting_id",
            "target",
            "turn_id",
            F.replace(F.replace("text", F.lit("e"), F.lit("")), F.lit("n"), F.lit("nn")).alias(
                "text"
            ),
        )

    # -- events ----------------------------------------------------------

    @cached_property
    def ticks(self) -> DataFrame:
        """Events numbered per user by time: the base of frames and samples."""
        return self._once("ticks", self._ticks)

    def _ticks(self) -> DataFrame:
        events = self.read("events").select("user_id", "event_id", "ts", "event_type", "value")
        hour = F.floor(F.unix_timestamp(F.col("ts")) / 3600).cast("long")
        return ordinal(events, ["user_id"], hour, [F.col("ts"), F.col("event_id")], "idx").select(
            F.col("user_id").cast("string").alias("meeting_id"),
            "user_id",
            "idx",
            "event_id",
            "event_type",
            "value",
            "ts",
        )

    @cached_property
    def frames(self) -> DataFrame:
        """Energies of two channels: the microphone hears the other one late and faint."""
        return self._once("frames", self._frames)

    def _frames(self) -> DataFrame:
        user, frame = F.col("user_id"), F.col("frame")
        system = self.ticks.select(
            "meeting_id",
            "user_id",
            F.col("idx").alias("frame"),
            (F.col("value") * F.col("value") * F.lit(1e-6)).alias("energy"),
        )
        late = system.select(
            "meeting_id",
            (frame + user % 3).alias("frame"),
            F.col("energy").alias("heard"),
        )
        own = (((frame * 37) % 11 + 1) * ((frame * 37) % 11 + 1)).cast("double")
        microphone = system.join(late, ["meeting_id", "frame"], "left").select(
            "meeting_id",
            "user_id",
            "frame",
            F.when(user % 7 == 0, own * F.lit(1e-3))
            .when((frame % 9 == 0) & (user % 5 != 0), F.lit(0.01))
            .otherwise(
                F.greatest(F.lit(1e-8), F.coalesce(F.col("heard"), F.lit(0.0)) * F.lit(5e-5))
            )
            .alias("energy"),
        )
        return (
            system.withColumn("side", F.lit(SYSTEM_AUDIO))
            .unionByName(microphone.withColumn("side", F.lit(MICROPHONE)))
            .select("meeting_id", "side", "frame", "energy", "user_id")
        )

    @cached_property
    def samples(self) -> DataFrame:
        """Two channels of signed values; the second is silent for every fourth user."""
        signed = F.col("value") * F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(-1.0) * 1e-3
        other = F.col("value") * (F.col("event_id") % 7 - 3).cast("double") * 1e-3
        other = F.when(F.col("user_id") % 4 == 0, F.lit(0.0)).otherwise(other)
        return self.ticks.select(
            "meeting_id",
            "user_id",
            "idx",
            F.posexplode(F.array(signed, other)).alias("channel", "value"),
        )

    @cached_property
    def sample_blocks(self) -> DataFrame:
        """The samples as they are stored: packed blocks."""
        return self._once("sample-blocks", lambda: pack_samples(self.samples))

    @cached_property
    def frame_blocks(self) -> DataFrame:
        return self._once("frame-blocks", lambda: pack_frames(self.frames))

    # -- embeddings and documents ----------------------------------------

    @cached_property
    def observations(self) -> DataFrame:
        return self.read("embeddings").select(
            "vec_id",
            "label",
            "embedding",
            (F.lit(1) + F.col("vec_id") % 7).cast("double").alias("duration"),
        )

    @cached_property
    def profiles(self) -> DataFrame:
        """One enrolled person per label: the first vector of that label."""
        return (
            self.observations.groupBy("label")
            .agg(
                F.min("vec_id").alias("vec_id"),
                F.min_by("embedding", "vec_id").alias("embedding"),
            )
            .select(
                F.col("label").alias("profile_pos"),
                F.concat(F.lit("p"), F.col("label").cast("string")).alias("profile_id"),
                F.concat(F.lit("Person "), F.col("label").cast("string")).alias("name"),
                "embedding",
                (F.lit(1) + F.col("label") % 4).cast("long").alias("sample_count"),
                F.timestamp_seconds(
                    F.lit(1_704_067_200) + F.col("label").cast("long") * 86_400
                ).alias("updated_at"),
                F.when(F.col("label") % 3 == 0, F.concat(F.lit("note "), F.col("label").cast("string")))
                .alias("note"),
            )
        )

    @cached_property
    def library(self) -> DataFrame:
        """One stored meeting per document, filed by source and language."""
        doc = F.col("doc_id")
        return self.read("documents").select(
            doc.cast("string").alias("meeting_id"),
            "doc_id",
            F.substring("text", 1, 40).alias("title"),
            F.array("source", "lang").alias("folder"),
            F.timestamp_seconds(
                F.lit(1_704_067_200) + (doc * 7919) % 1_000_003
            ).alias("imported_at"),
            F.col("n_chars").cast("long").alias("bytes"),
            "lang",
            "source",
            "text",
        )
