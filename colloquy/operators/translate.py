"""Missing translations, language pairs, and filling in lines with a user's function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import trimmed
from colloquy.operators.trims import kept_turns
from colloquy.schema import language_pairs


def text_for_rendering(turns: DataFrame, translations: DataFrame) -> DataFrame:
    """Adds ``translated_text`` (null where missing) and ``shown_text``."""
    lines = translations.select(
        "meeting_id", "turn_id", F.col("text").alias("translated_text")
    )
    return turns.join(lines, ["meeting_id", "turn_id"], "left").withColumn(
        "shown_text", F.coalesce("translated_text", "text")
    )


def untranslated_turns(
    turns: DataFrame, meetings: DataFrame, translations: DataFrame, blank_too: bool = False
) -> DataFrame:
    """Kept turns of meetings with a target language that have no line in it.

    Blank turns have nothing to translate; the note in a document counts them.
    """
    wanted = meetings.where("target IS NOT NULL")
    open_turns = kept_turns(turns, wanted)
    if not blank_too:
        open_turns = open_turns.where(trimmed(F.col("text")) != "")
    targets = wanted.select("meeting_id", "target", "language")
    return open_turns.join(targets, "meeting_id").join(
        translations.select("meeting_id", "turn_id", "target"),
        ["meeting_id", "turn_id", "target"],
        "left_anti",
    )


def untranslated_count(
    turns: DataFrame, meetings: DataFrame, translations: DataFrame
) -> DataFrame:
    missing = untranslated_turns(turns, meetings, translations, blank_too=True)
    return missing.groupBy("meeting_id").agg(F.count("*").alias("untranslated"))


def translation_targets(meetings: DataFrame) -> DataFrame:
    """Every language a meeting could be translated into, refused pairs flagged."""
    pairs = language_pairs(meetings.sparkSession).withColumnRenamed("source", "language")
    return meetings.select("meeting_id", "language").join(F.broadcast(pairs), "language")


def apply_lines(translations: DataFrame, lines: DataFrame, meetings: DataFrame) -> DataFrame:
    """New lines put over old ones by turn; lines for a target no longer wanted are ignored.

    ``lines(meeting_id, target, turn_id, text, seq)``; the last line of a turn wins.
    """
    current = lines.join(
        meetings.select("meeting_id", "target"), ["meeting_id", "target"], "left_semi"
    )
    latest = current.groupBy("meeting_id", "target", "turn_id").agg(
        F.max_by("text", "seq").alias("text")
    )
    kept = translations.join(
        latest.select("meeting_id", "target", "turn_id"),
        ["meeting_id", "target", "turn_id"],
        "left_anti",
    )
    return kept.select("meeting_id", "target", "turn_id", "text").unionByName(latest)


def translate_with(
    open_turns: DataFrame, translate: Callable[[str, str, pd.Series], pd.Series]
) -> DataFrame:
    """Lines from a user's function ``translate(source, target, texts) -> texts``.

    Pairs known to be refused are left out beforehand, as are blank answers. The
    function sees Arrow batches; ids stay with their texts by row.
    """
    pairs = (
        language_pairs(open_turns.sparkSession)
        .where("available")
        .select(F.col("source").alias("language"), "target")
    )
    possible = open_turns.join(F.broadcast(pairs), ["language", "target"], "left_semi").select(
        "meeting_id", "turn_id", "language", "target", "text"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (source, target), group in batch.groupby(["language", "target"]):
                answer = translate(source, target, group["text"])
                yield group[["meeting_id", "target", "turn_id"]].assign(text=list(answer))

    lines = possible.mapInPandas(
        run, "meeting_id string, target string, turn_id string, text string"
    )
    return lines.where(F.col("text").isNotNull() & (trimmed(F.col("text")) != ""))
