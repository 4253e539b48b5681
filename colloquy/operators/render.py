"""Subtitle cues and text documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators.speakers import roster_names
from colloquy.operators.translate import text_for_rendering, untranslated_count
from colloquy.operators.trims import kept_turns
from colloquy.plans.scan import position_chunk, running
from colloquy.schema import languages

# Longest cue on screen, and the shortest.
CUE_SECONDS = 6.0
CUE_MINIMUM = 0.05

#: Blocks of a document that are put together before its parts are.
PART_BLOCKS = 10_000


def _cue_starts(words: Column, first_budget: Column) -> Column:
    """Indices at which a new cue begins: too many characters, or too long on screen."""
    start = F.struct(
        F.array().cast("array<int>").alias("starts"),
        F.lit(0.0).alias("since"),
        F.lit(0).alias("chars"),
        F.lit(0).alias("i"),
    )

    def step(acc: Column, w: Column) -> Column:
        size = F.length(w["word"])
        gap = F.when((acc["chars"] == 0) | tx.is_tight(w["word"]), 0).otherwise(1)
        grown = F.when(size == 0, acc["chars"]).otherwise(acc["chars"] + gap + size)
        budget = F.when(F.size(acc["starts"]) <= 1, first_budget).otherwise(
            F.lit(tx.CUE_CHARACTERS)
        )
        opens = (acc["i"] == 0) | (grown > budget) | (w["end"] - acc["since"] > CUE_SECONDS)
        return F.struct(
            F.when(opens, F.concat(acc["starts"], F.array(acc["i"])))
            .otherwise(acc["starts"])
            .alias("starts"),
            F.when(opens, w["start"]).otherwise(acc["since"]).alias("since"),
            F.when(opens, size).otherwise(grown).alias("chars"),
            (acc["i"] + 1).alias("i"),
        )

    return F.aggregate(words, start, step)["starts"]


def _source_cues(room_for_name: bool) -> Column:
    """Cues of a turn with columns start, end, text, words and speaker_name."""
    words, speaker = F.col("words"), F.col("speaker_name")
    budget = F.lit(tx.CUE_CHARACTERS)
    if room_for_name:
        budget = budget - F.length(tx.attribution(speaker))

    def pieces(begins: Column) -> Column:
        def piece(at: Column, i: Column) -> Column:
            until = F.coalesce(F.get(begins, i + 1), F.size(words))
            return tx.let(
                F.slice(words, at + 1, until - at),
                lambda part: F.struct(
                    part[0]["start"].alias("start"),
                    F.element_at(part, -1)["end"].alias("end"),
                    tx.joined_text(tx.word_texts(part)).alias("text"),
                ),
            )

        return F.transform(begins, piece)

    whole = F.array(F.struct(F.col("start"), F.col("end"), F.col("text")))
    cut = F.when(F.size(words) > 0, tx.let(_cue_starts(words, budget), pieces)).otherwise(whole)
    return F.transform(
        cut,
        lambda p, i: F.struct(
            p["start"].alias("start"),
            F.greatest(p["end"], p["start"] + CUE_MINIMUM).alias("end"),
            F.when(i == 0, speaker).alias("speaker"),
            p["text"].alias("text"),
        ),
    )


def _running_sum(values: Column) -> Column:
    """Running totals of an array of numbers, current one included."""
    walked = F.aggregate(
        values,
        F.struct(F.lit(0.0).alias("at"), F.array().cast("array<double>").alias("out")),
        lambda acc, v: F.struct(
            (acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"] + v)).alias("out")
        ),
    )
    return walked["out"]


def redistribute(cues: Column, translated: Column) -> Column:
    """A translated text spread over the cues of its original.

    A word goes to the cue whose share of the source characters covers the words
    before it: the number of cues whose reach ends at or before them. Cues left
    empty are folded into the next one with words.
    """

    def single(c: Column, words: Column) -> Column:
        return F.array(
            F.struct(
                c[0]["start"].alias("start"),
                F.element_at(c, -1)["end"].alias("end"),
                c[0]["speaker"].alias("speaker"),
                F.when(F.size(words) == 0, c[0]["text"])
                .otherwise(F.array_join(words, " "))
                .alias("text"),
            )
        )

    def grouped(c: Column, placed: Column) -> Column:
        """``placed``: words with their cue, in order."""

        def gather(used: Column) -> Column:
            def one(cue: Column, k: Column) -> Column:
                opens = F.when(k == 0, F.lit(0)).otherwise(F.get(used, k - 1) + 1)
                closes = F.when(k == F.size(used) - 1, F.size(c) - 1).otherwise(cue)
                mine = F.filter(placed, lambda w: w["cue"] == cue)
                return F.struct(
                    F.get(c, opens)["start"].alias("start"),
                    F.get(c, closes)["end"].alias("end"),
                    F.get(c, opens)["speaker"].alias("speaker"),
                    F.array_join(F.transform(mine, lambda w: w["word"]), " ").alias("text"),
                )

            return F.transform(used, one)

        return tx.let(F.array_distinct(F.transform(placed, lambda w: w["cue"])), gather)

    def spread(c: Column, words: Column) -> Column:
        lengths = F.transform(words, lambda w: (F.length(w) + 1).cast("double"))
        chars = F.transform(c, lambda cue: F.length(cue["text"]).cast("double"))

        def place(upto: Column, shares: Column) -> Column:
            reach = F.transform(
                F.slice(shares, F.lit(1), F.size(c) - 1),
                lambda s: F.when(
                    F.element_at(shares, -1) > 0,
                    s / F.element_at(shares, -1) * F.element_at(upto, -1),
                ).otherwise(F.element_at(upto, -1)),
            )
            return tx.let(
                reach,
                lambda ends: F.transform(
                    words,
                    lambda w, j: F.struct(
                        w.alias("word"),
                        F.size(
                            F.filter(
                                ends, lambda r: r <= F.get(upto, j) - (F.length(w) + 1)
                            )
                        ).alias("cue"),
                    ),
                ),
            )

        return tx.let(
            _running_sum(lengths),
            lambda upto: tx.let(
                _running_sum(chars),
                lambda shares: tx.let(place(upto, shares), lambda placed: grouped(c, placed)),
            ),
        )

    return F.when(translated.isNull(), cues).otherwise(
        tx.let(
            cues,
            lambda c: tx.let(
                tx.text_words(translated),
                lambda words: F.when(
                    (F.size(c) > 1) & (F.size(words) > 0), spread(c, words)
                ).otherwise(single(c, words)),
            ),
        )
    )


def turn_cues(
    turns: DataFrame,
    speakers: DataFrame,
    translations: DataFrame | None = None,
    room_for_name: bool = False,
) -> DataFrame:
    """Turns with their array of cues; translated where lines are given.

    ``room_for_name`` shortens the first cue of a turn by the speaker's name, as
    in formats that write the name on the line.
    """
    cut = roster_names(turns, speakers).withColumn("cues", _source_cues(room_for_name))
    if translations is not None:
        cut = text_for_rendering(cut, translations).withColumn(
            "cues", redistribute(F.col("cues"), F.col("translated_text"))
        )
    return cut.select("meeting_id", "turn_idx", "turn_id", "cues")


def cue_rows(cut: DataFrame) -> DataFrame:
    """One row per cue, numbered from 1 within its meeting.

    The number is a running sum over turns plus the place in the turn.
    """
    counted = running(
        cut,
        ["meeting_id"],
        position_chunk("turn_idx"),
        [F.col("turn_idx")],
        {"_before": ("sum", F.size("cues").cast("long"))},
        inclusive=False,
    )
    return counted.select(
        "meeting_id", "turn_idx", "turn_id", "_before", F.posexplode("cues").alias("_pos", "c")
    ).select(
        "meeting_id",
        "turn_idx",
        "turn_id",
        F.col("_pos").cast("long").alias("cue_idx"),
        (F.col("_before") + F.col("_pos") + 1).alias("number"),
        "c.start",
        "c.end",
        "c.speaker",
        "c.text",
    )


def documents(blocks: DataFrame, part_blocks: int = PART_BLOCKS) -> DataFrame:
    """Numbered text blocks gathered into one document for each meeting.

    ``blocks(meeting_id, block, text)``. Rows: ``(meeting_id, text)``. Long
    documents come together in two steps, so only the last one, a row that
    holds the document anyway, is one task's work.
    """

    def put_together(df: DataFrame, keys: list[str], order: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(order, "text")))
        return df.groupBy(*keys).agg(ordered.alias("_b")).select(
            *keys, F.array_join(F.transform("_b", lambda b: b["text"]), "").alias("text")
        )

    parts = blocks.withColumn("_part", F.floor(F.col("block") / part_blocks).cast("long"))
    return put_together(put_together(parts, ["meeting_id", "_part"], "block"), ["meeting_id"], "_part")


def _times(separator: str) -> Column:
    return F.concat(
        tx.timecode_subtitle(F.col("start"), separator),
        F.lit(" --> "),
        tx.timecode_subtitle(F.col("end"), separator),
    )


def vtt_blocks(cues: DataFrame, meetings: DataFrame) -> DataFrame:
    """A header block per meeting and one block per cue; wrapped before escaping."""
    body = tx.escape_markup(tx.wrap_lines(F.col("text")))
    voice = F.when(
        F.col("speaker").isNotNull(),
        F.concat(F.lit("<v "), tx.escape_markup(F.col("speaker")), F.lit(">")),
    ).otherwise(F.lit(""))
    lines = F.concat(
        F.lit("\n"), F.col("number").cast("string"), F.lit("\n"), _times("."), F.lit("\n"),
        voice, body, F.lit("\n"),
    )
    header = meetings.select(
        "meeting_id", F.lit(0).cast("long").alias("block"), F.lit("WEBVTT\n").alias("text")
    )
    return header.unionByName(
        cues.select("meeting_id", F.col("number").alias("block"), lines.alias("text"))
    )


def srt_blocks(cues: DataFrame) -> DataFrame:
    """One block per cue, the name written on the line."""
    lines = F.concat(
        F.when(F.col("number") > 1, F.lit("\n")).otherwise(F.lit("")),
        F.col("number").cast("string"), F.lit("\n"), _times(","), F.lit("\n"),
        tx.display_text(F.col("speaker"), F.col("text")), F.lit("\n"),
    )
    return cues.select("meeting_id", F.col("number").alias("block"), lines.alias("text"))


def markdown_blocks(
    turns: DataFrame,
    meetings: DataFrame,
    speakers: DataFrame,
    translations: DataFrame | None = None,
) -> DataFrame:
    """A head per meeting and one block per kept turn.

    Dates are written ``yyyy-MM-dd HH:mm``. With translations, the head says so
    and counts the lines that have none.
    """
    spoken = kept_turns(turns, meetings)
    names = F.broadcast(
        languages(meetings.sparkSession).select("language", "display_name")
    )
    head_rows = meetings.join(names, "language", "left")
    note = F.lit("")
    if translations is not None:
        targets = names.select(
            F.col("language").alias("target"), F.col("display_name").alias("_target_name")
        )
        head_rows = head_rows.join(F.broadcast(targets), "target", "left").join(
            untranslated_count(turns, meetings, translations), "meeting_id", "left"
        )
        one = F.col("untranslated") == 1
        missing = F.when(
            F.col("untranslated") > 0,
            F.concat(
                F.lit("\n*"), F.col("untranslated").cast("string"),
                F.when(one, " line has").otherwise(" lines have"), F.lit(" no translation and "),
                F.when(one, "is").otherwise("are"), F.lit(" shown in "), F.col("display_name"),
                F.lit(".*\n"),
            ),
        ).otherwise(F.lit(""))
        note = F.when(
            F.col("target").isNotNull(),
            F.concat(
                F.lit("\n*Translated from "), F.col("display_name"), F.lit(" to "),
                F.col("_target_name"), F.lit(" on device. The recording is in "),
                F.col("display_name"), F.lit(".*\n"), missing,
            ),
        ).otherwise(F.lit(""))
    trim_note = F.when(
        F.col("kept_start").isNotNull(),
        F.concat(
            F.lit("\n*Trimmed to "), tx.timecode_short(F.col("kept_start")), F.lit("–"),
            tx.timecode_short(F.col("kept_end")),
            F.lit("; the rest of the recording is not included.*\n"),
        ),
    ).otherwise(F.lit(""))
    degraded = F.when(
        F.col("degraded") == "diarization",
        F.lit(
            "\n> Speaker identification did not produce a result for this "
            "recording, so every line is attributed to a single unknown speaker.\n"
        ),
    ).otherwise(F.lit(""))
    head = head_rows.select(
        "meeting_id",
        F.lit(-1).cast("long").alias("turn_idx"),
        F.concat(
            F.lit("# "), F.col("title"), F.lit("\n\n*"), tx.timecode_short(F.col("duration")),
            F.lit(" · transcribed "), F.date_format("imported_at", "yyyy-MM-dd HH:mm"),
            F.lit("*\n"), trim_note, degraded, note, F.lit("\n"),
        ).alias("text"),
    )
    named = roster_names(spoken, speakers)
    shown = F.col("text")
    if translations is not None:
        named = text_for_rendering(named, translations)
        shown = F.col("shown_text")
    body = named.select(
        "meeting_id",
        "turn_idx",
        F.concat(
            F.lit("**"), tx.plain_attribution(F.col("start"), F.col("speaker_name")),
            F.lit("** "), shown, F.lit("\n\n"),
        ).alias("text"),
    )
    return head.unionByName(body).withColumn("block", F.col("turn_idx") + 1).drop("turn_idx")


def gap_filled_track(cues: DataFrame, meetings: DataFrame, offset: str, length: str) -> DataFrame:
    """Cues on the clock of a copied recording, with empty rows in between and at the end.

    ``meetings`` names the shift and the length of the copy. Rows: ``(meeting_id,
    from, to, text)``.
    """
    clock = meetings.select(
        "meeting_id", F.col(offset).alias("_offset"), F.col(length).alias("_length")
    )
    placed = (
        cues.join(clock, "meeting_id")
        .select(
            "meeting_id",
            "number",
            "_length",
            F.greatest(F.lit(0.0), F.col("start") - F.col("_offset")).alias("from"),
            F.least(F.col("_length"), F.col("end") - F.col("_offset")).alias("to"),
            tx.display_text(F.col("speaker"), F.col("text")).alias("text"),
        )
        .where(F.col("to") > F.col("from"))
    )
    seen = running(
        placed,
        ["meeting_id"],
        position_chunk("number"),
        [F.col("number")],
        {"_clock": ("last", F.col("to"))},
        inclusive=False,
    ).withColumn("_clock", F.coalesce("_clock", F.lit(0.0)))
    gap = F.when(
        F.col("from") > F.col("_clock"),
        F.array(
            F.struct(F.col("_clock").alias("from"), F.col("from").alias("to"), F.lit("").alias("text"))
        ),
    ).otherwise(F.array().cast("array<struct<from:double,to:double,text:string>>"))
    rows = seen.select(
        "meeting_id", F.inline(F.concat(gap, F.array(F.struct("from", "to", "text"))))
    )
    ends = placed.groupBy("meeting_id").agg(F.max_by("to", "number").alias("_clock"))
    tail = (
        clock.join(ends, "meeting_id", "left")
        .withColumn("_clock", F.coalesce("_clock", F.lit(0.0)))
        .where(F.col("_clock") < F.col("_length"))
        .select(
            "meeting_id",
            F.col("_clock").alias("from"),
            F.col("_length").alias("to"),
            F.lit("").alias("text"),
        )
    )
    return rows.unionByName(tail)
