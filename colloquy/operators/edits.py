"""Edits of stored transcripts as table transforms.

Edits arrive as ``edits(meeting_id, seq, op, turn_id, speaker_id, arg, num)``.
Each transform here applies one kind of edit to whole tables at once; the
ordered replay of a mixed log is in :mod:`colloquy.operators.replay`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as tx


def of_kind(edits: DataFrame, op: str) -> DataFrame:
    return edits.where(F.col("op") == op)


def _last(edits: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    return edits.groupBy(*keys).agg(F.max_by(value, F.col("seq")).alias(name))


def rename_meetings(meetings: DataFrame, edits: DataFrame) -> DataFrame:
    """Last non-blank title wins."""
    wanted = of_kind(edits, "rename_meeting").withColumn("arg", tx.trimmed(F.col("arg")))
    titles = _last(wanted.where("arg <> ''"), ["meeting_id"], F.col("arg"), "_title")
    return (
        meetings.join(titles, "meeting_id", "left")
        .withColumn("title", F.coalesce("_title", "title"))
        .drop("_title")
    )


def rename_speakers(speakers: DataFrame, edits: DataFrame) -> DataFrame:
    """Last non-blank name wins; the speaker counts as named, a suggestion goes."""
    wanted = of_kind(edits, "rename_speaker").withColumn("arg", tx.trimmed(F.col("arg")))
    names = _last(wanted.where("arg <> ''"), ["meeting_id", "speaker_id"], F.col("arg"), "_name")
    renamed = F.col("_name").isNotNull()
    changes = {
        "name": F.coalesce("_name", "name"),
        "is_named": F.col("is_named") | renamed,
    }
    if "suggestion" in speakers.columns:
        changes["suggestion"] = F.when(~renamed, F.col("suggestion"))
    return (
        speakers.join(names, ["meeting_id", "speaker_id"], "left")
        .withColumns(changes)
        .drop("_name")
    )


def reassign_turns(turns: DataFrame, edits: DataFrame, speakers: DataFrame) -> DataFrame:
    """Turns given to another speaker, if that speaker is on the roster."""
    wanted = of_kind(edits, "reassign").drop("speaker_id").withColumnRenamed("arg", "speaker_id")
    allowed = wanted.join(
        speakers.select("meeting_id", "speaker_id"), ["meeting_id", "speaker_id"], "left_semi"
    )
    final = _last(allowed, ["meeting_id", "turn_id"], F.col("speaker_id"), "_speaker")
    return (
        turns.join(final, ["meeting_id", "turn_id"], "left")
        .withColumn("speaker_id", F.coalesce("_speaker", "speaker_id"))
        .drop("_speaker")
    )


def remove_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Turns (or translation lines) without the removed ones; rosters stay."""
    gone = of_kind(edits, "remove").select("meeting_id", "turn_id").distinct()
    return rows.join(gone, ["meeting_id", "turn_id"], "left_anti")


def edit_texts(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """New texts; an unchanged text is no edit, a changed one loses its timings.

    A text changed and changed back is edited all the same.
    """
    wanted = of_kind(edits, "edit_text").select(
        "meeting_id", "turn_id", "seq", tx.trimmed(F.col("arg")).alias("_arg")
    )
    old = turns.select("meeting_id", "turn_id", "text")
    final = (
        wanted.join(old, ["meeting_id", "turn_id"])
        .groupBy("meeting_id", "turn_id")
        .agg(
            F.max_by("_arg", "seq").alias("_text"),
            F.bool_or(F.col("_arg") != F.col("text")).alias("_touched"),
        )
    )
    touched = F.coalesce("_touched", F.lit(False))
    return (
        turns.join(final, ["meeting_id", "turn_id"], "left")
        .withColumns(
            {
                "words": F.when(~touched, F.col("words")),
                "is_edited": F.col("is_edited") | touched,
                "text": F.coalesce("_text", "text"),
            }
        )
        .drop("_text", "_touched")
    )


def split_index_at_time(words: Column, time: Column) -> Column:
    """Index of the first word still running at a time; the second half starts there."""
    later = F.filter(
        F.transform(words, lambda w, i: F.struct(w["end"].alias("end"), i.alias("i"))),
        lambda w: time < w["end"],
    )
    return F.get(later, F.lit(0))["i"]


def split_turns(turns: DataFrame, splits: DataFrame) -> DataFrame:
    """Turns cut before word ``k``; the first half keeps the id.

    ``splits(meeting_id, turn_id, seq, k)`` with one split per turn. Cuts outside
    the turn, and turns without timings, are left alone. Adds ``part``.
    """
    joined = turns.join(splits, ["meeting_id", "turn_id"], "left")
    k, words = F.col("k"), F.col("words")
    cuts = F.coalesce((k > 0) & (k < F.size(words)), F.lit(False))

    def half(part: Column, number: int, identity: Column) -> Column:
        return F.struct(
            F.lit(number).alias("part"),
            identity.alias("turn_id"),
            F.get(part, F.lit(0))["start"].alias("start"),
            F.element_at(part, -1)["end"].alias("end"),
            tx.joined_text(tx.word_texts(part)).alias("text"),
            part.alias("words"),
            F.lit(False).alias("is_edited"),
        )

    whole = F.struct(
        F.lit(0).alias("part"), "turn_id", "start", "end", "text", "words", "is_edited"
    )
    head = F.slice(words, F.lit(1), F.greatest(k, F.lit(1)))
    tail = F.slice(words, F.greatest(k, F.lit(0)) + 1, F.size(words))
    new_id = F.concat("turn_id", F.lit("/"), F.col("seq").cast("string"))
    pieces = F.when(
        cuts, F.array(half(head, 0, F.col("turn_id")), half(tail, 1, new_id))
    ).otherwise(F.array(whole))
    rest = [c for c in turns.columns if c not in ("turn_id", "start", "end", "text", "words", "is_edited")]
    return joined.select(*rest, F.inline(pieces)).select(*turns.columns, "part")


def merged_text(first: Column, second: Column) -> Column:
    """Text of two untimed turns put together."""
    return (
        F.when(first == "", second)
        .when(second == "", first)
        .otherwise(F.concat(first, tx.spacing(second), second))
    )


def merge_neighbours(turns: DataFrame, merges: DataFrame) -> DataFrame:
    """Turns joined with the one after them; the earlier one's id and speaker stay.

    ``merges(meeting_id, turn_idx)`` names the earlier turn of each pair; pairs
    do not overlap. ``turn_idx`` must be dense.
    """
    first = merges.join(
        turns.select("meeting_id", (F.col("turn_idx") - 1).alias("turn_idx")),
        ["meeting_id", "turn_idx"],
        "left_semi",
    ).select("meeting_id", "turn_idx")
    second = first.select("meeting_id", (F.col("turn_idx") + 1).alias("turn_idx"))
    later = turns.join(second, ["meeting_id", "turn_idx"], "left_semi").select(
        "meeting_id",
        (F.col("turn_idx") - 1).alias("turn_idx"),
        *[F.col(c).alias(f"_{c}") for c in ("turn_id", "start", "end", "text", "words", "is_edited")],
    )
    kept = turns.join(second, ["meeting_id", "turn_idx"], "left_anti")
    joined = kept.join(later, ["meeting_id", "turn_idx"], "left")
    both = F.col("_turn_id").isNotNull()
    words = F.when(
        F.col("words").isNotNull() & F.col("_words").isNotNull(), F.concat("words", "_words")
    )
    text = F.when(words.isNotNull(), tx.joined_text(tx.word_texts(words))).otherwise(
        merged_text(F.col("text"), F.col("_text"))
    )
    changed = {
        "start": F.least("start", "_start"),
        "end": F.greatest("end", "_end"),
        "text": text,
        "words": words,
        "is_edited": F.col("is_edited") | F.col("_is_edited"),
    }
    return joined.select(
        *[
            F.when(both, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
            for c in turns.columns
        ]
    )


def attach_audio(meetings: DataFrame, edits: DataFrame) -> DataFrame:
    """Points meetings at recordings; a finite positive length replaces the duration."""
    wanted = of_kind(edits, "attach_audio")
    usable = F.col("num").isNotNull() & ~F.isnan("num") & (F.col("num") > 0) & (
        F.col("num") < float("inf")
    )
    last = wanted.groupBy("meeting_id").agg(
        F.max_by("arg", "seq").alias("_path"),
        F.max_by("num", F.when(usable, F.col("seq"))).alias("_length"),
    )
    return (
        meetings.join(last, "meeting_id", "left")
        .withColumns(
            {
                "audio_path": F.coalesce("_path", "audio_path"),
                "duration": F.coalesce("_length", "duration"),
            }
        )
        .drop("_path", "_length")
    )


def drop_translations(translations: DataFrame, touched: DataFrame) -> DataFrame:
    """Lines whose turn was not rewritten; ``touched(meeting_id, turn_id)``."""
    return translations.join(
        touched.select("meeting_id", "turn_id").distinct(), ["meeting_id", "turn_id"], "left_anti"
    )


def rerun_replace(meetings: DataFrame, reruns: DataFrame) -> DataFrame:
    """Meetings after a new transcription: title, folder and trim stay, the rest is new.

    ``reruns`` has the new language, model, duration, degraded, fast flag.
    """
    fresh = ["language", "model", "duration", "degraded", "fast"]
    new = reruns.select(
        "meeting_id", F.lit(True).alias("_again"), *[F.col(c).alias(f"_{c}") for c in fresh]
    )
    again = F.col("_again").isNotNull()
    out = [
        F.when(again, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c)
        for c in meetings.columns
        if c != "target"
    ]
    if "target" in meetings.columns:
        out.append(F.when(~again, F.col("target")).alias("target"))
    return meetings.join(new, "meeting_id", "left").select(*out)


def rerun_rows(rows: DataFrame, reruns: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Turn or speaker rows with those of transcribed-again meetings replaced."""
    return rows.join(reruns.select("meeting_id"), "meeting_id", "left_anti").unionByName(new_rows)


# -- folders ---------------------------------------------------------------


def _starts_with(path: Column, prefix: list[str]) -> Column:
    head = F.slice(path, 1, len(prefix)) if prefix else F.array().cast("array<string>")
    return (F.size(path) >= len(prefix)) & (head == _literal(prefix))


def _literal(path: list[str]) -> Column:
    return F.array(*[F.lit(p) for p in path]).cast("array<string>")


def move_folder(library: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    """Every path under ``old`` moved to ``new``; a move into itself is refused."""
    if new[: len(old)] == old:
        return library
    tail = F.slice("folder", F.lit(len(old) + 1), F.size("folder"))
    return library.withColumn(
        "folder",
        F.when(_starts_with(F.col("folder"), old), F.concat(_literal(new), tail)).otherwise(
            F.col("folder")
        ),
    )


def delete_folder(library: DataFrame, folder: list[str]) -> DataFrame:
    """The folder's contents move up one level."""
    tail = F.slice("folder", F.lit(len(folder) + 1), F.size("folder"))
    return library.withColumn(
        "folder",
        F.when(
            _starts_with(F.col("folder"), folder), F.concat(_literal(folder[:-1]), tail)
        ).otherwise(F.col("folder")),
    )
