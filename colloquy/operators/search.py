"""Finding text in transcripts and replacing it without losing word timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators.turns import word_ranges


def _length(query: str) -> int:
    return len(tx.fold_literal(query.strip()))


def find_matches(turns: DataFrame, query: str) -> DataFrame:
    """Every occurrence of the query in turn texts, as character offset and length."""
    return turns.select(
        "meeting_id", "turn_id", F.explode(tx.match_offsets(F.col("text"), query)).alias("offset")
    ).withColumn("length", F.lit(_length(query)))


def _enclosing(ranges: Column, low: Column, length: Column) -> Column:
    """First word range that holds the match completely, else null."""
    return F.get(
        F.filter(ranges, lambda r: (r["lo"] <= low) & (low + length <= r["hi"])), F.lit(0)
    )


def match_in_word(turns: DataFrame, query: str) -> DataFrame:
    """Matches with the index of the one word that holds each, null if none does."""
    size = F.lit(_length(query))
    return (
        turns.select(
            "meeting_id",
            "turn_id",
            word_ranges(F.col("words")).alias("_ranges"),
            tx.match_offsets(F.col("text"), query).alias("_found"),
        )
        .select("meeting_id", "turn_id", "_ranges", F.explode("_found").alias("offset"))
        .select(
            "meeting_id",
            "turn_id",
            "offset",
            size.alias("length"),
            _enclosing(F.col("_ranges"), F.col("offset"), size)["idx"].alias("word_idx"),
        )
    )


def replacement_cost(turns: DataFrame, query: str) -> DataFrame:
    """Per meeting: matches whose replacement keeps and loses word timings."""
    return (
        match_in_word(turns, query)
        .groupBy("meeting_id")
        .agg(
            F.count("word_idx").alias("keeps_timings"),
            (F.count("*") - F.count("word_idx")).alias("drops_timings"),
        )
    )


def valid_match(turns: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches that still fit the text of their turn."""
    texts = turns.select("meeting_id", "turn_id", F.length("text").alias("_n"))
    return (
        matches.join(texts, ["meeting_id", "turn_id"])
        .where((F.col("offset") >= 0) & (F.col("offset") + F.col("length") <= F.col("_n")))
        .drop("_n")
    )


def _overwrite(text: Column, at: Column, length: Column, with_: str) -> Column:
    head = F.substring(text, F.lit(1), at)
    tail = F.substring(text, at + length + 1, F.length(text))
    return F.concat(head, F.lit(with_), tail)


def _overlaps_itself(query: str) -> bool:
    wanted = tx.fold_literal(query.strip())
    return any(wanted.startswith(wanted[i:]) for i in range(1, len(wanted)))


def _rewritten_text(text: Column, offsets: Column, size: Column, replacement: str) -> Column:
    """A text with the matches at ascending offsets replaced, last to first."""
    return F.aggregate(
        F.reverse(offsets),
        text,
        lambda acc, at: F.when(
            at + size <= F.length(acc), _overwrite(acc, at, size, replacement)
        ).otherwise(acc),
    )


def replace_all(turns: DataFrame, query: str, replacement: str) -> DataFrame:
    """Turns with every match replaced, last to first, and what that cost.

    Matches are found once on the original text. One inside a single word
    rewrites that word and keeps the timings; any other edits the text and drops
    them for the turn. Adds ``kept`` and ``dropped`` counts.

    Where all matches of a turn lie inside words and cannot overlap, the words
    are rewritten one by one; only other timed turns need the fold over matches
    with changing word ranges.
    """
    size = F.lit(_length(query))

    def result(text: Column, words: Column, edited: Column, kept: Column, dropped: Column):
        return F.struct(
            text.alias("text"),
            words.alias("words"),
            edited.alias("is_edited"),
            kept.cast("int").alias("kept"),
            dropped.cast("int").alias("dropped"),
        )

    zero = F.lit(0)
    same = result(F.col("text"), F.col("words"), F.col("is_edited"), zero, zero)

    def rewritten(words: Column, word: Column, at: Column) -> Column:
        changed = F.transform(
            words,
            lambda w, i: F.struct(
                F.when(i == word["idx"], _overwrite(w["word"], at - word["lo"], size, replacement))
                .otherwise(w["word"])
                .alias("word"),
                w["start"].alias("start"),
                w["end"].alias("end"),
            ),
        )
        return F.filter(changed, lambda w: w["word"] != "")

    def with_word(acc: Column, at: Column, word: Column) -> Column:
        fits = at + size <= F.length(acc["text"])
        in_word = fits & word.isNotNull()
        across = fits & word.isNull()
        return tx.let(
            F.when(in_word, rewritten(acc["words"], word, at)),
            lambda words: result(
                F.when(in_word, tx.joined_text(tx.word_texts(words)))
                .when(across, _overwrite(acc["text"], at, size, replacement))
                .otherwise(acc["text"]),
                F.when(in_word, words).when(~across, acc["words"]),
                acc["is_edited"] | across,
                acc["kept"] + in_word.cast("int"),
                acc["dropped"] + across.cast("int"),
            ),
        )

    def step(acc: Column, at: Column) -> Column:
        return tx.let(
            _enclosing(word_ranges(acc["words"]), at, size),
            lambda word: with_word(acc, at, word),
        )

    def word_by_word() -> Column:
        changed = F.transform(
            "words",
            lambda w: F.struct(
                _rewritten_text(
                    w["word"], tx.match_offsets(w["word"], query), size, replacement
                ).alias("word"),
                w["start"].alias("start"),
                w["end"].alias("end"),
            ),
        )
        return tx.let(
            F.filter(changed, lambda w: w["word"] != ""),
            lambda words: result(
                tx.joined_text(tx.word_texts(words)),
                words,
                F.col("is_edited"),
                F.size("_at"),
                zero,
            ),
        )

    none = F.lit(None).cast(turns.schema["words"].dataType)
    in_text = result(
        _rewritten_text(F.col("text"), F.col("_at"), size, replacement),
        none,
        F.lit(True),
        zero,
        F.size("_at"),
    )
    inside = F.aggregate(
        F.transform("words", lambda w: F.size(tx.match_offsets(w["word"], query))),
        zero,
        lambda acc, n: acc + n,
    )
    local = (inside == F.size("_at")) if not _overlaps_itself(query) else F.lit(False)
    untimed_is_plain = F.lit(not _overlaps_itself(query))
    found = turns.withColumn("_at", tx.match_offsets(F.col("text"), query))
    done = found.withColumn(
        "_r",
        F.when(F.size("_at") == 0, same)
        .when(F.col("words").isNull() & untimed_is_plain, in_text)
        .when(F.col("words").isNotNull() & local, word_by_word())
        .otherwise(F.aggregate(F.reverse("_at"), same, step)),
    )
    changed = ("text", "words", "is_edited")
    return done.select(
        *[F.col(f"_r.{c}").alias(c) if c in changed else F.col(c) for c in turns.columns],
        F.col("_r.kept").alias("kept"),
        F.col("_r.dropped").alias("dropped"),
    )


def library_filter(
    meetings: DataFrame, speakers: DataFrame, turns: DataFrame, query: str
) -> DataFrame:
    """Meetings whose title, a speaker's name or a turn holds the query, newest first.

    Case is ignored, accents are not. A blank query keeps everything.
    """
    wanted = query.strip().lower()
    if wanted:
        holds = lambda column: F.lower(column).contains(wanted)
        hits = (
            meetings.where(holds("title"))
            .select("meeting_id")
            .unionByName(speakers.where(holds("name")).select("meeting_id"))
            .unionByName(turns.where(holds("text")).select("meeting_id"))
            .distinct()
        )
        meetings = meetings.join(hits, "meeting_id", "left_semi")
    return meetings.orderBy(F.desc("imported_at"), "meeting_id")
