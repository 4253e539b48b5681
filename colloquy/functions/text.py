"""Text columns: joining words, folding, searching, wrapping, time codes, names."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# No space goes before a word beginning with one of these.
TIGHT_CHARACTERS = [".", ",", "!", "?", ":", ";", ")", "]", "}", "%", "…", "”", "’"]
# A sentence ends in one of these.
SENTENCE_ENDS = [".", "?", "!"]
# Subtitle line width and lines per cue.
LINE_WIDTH = 42
LINES_PER_CUE = 2
CUE_CHARACTERS = LINE_WIDTH * LINES_PER_CUE
# Longest file name in UTF-8 bytes, and the name for an empty title.
NAME_BYTES = 200
NAME_FALLBACK = "Untitled"


def _fold_pairs() -> tuple[str, str]:
    """Lower-case Latin letters whose decomposition is one ASCII letter plus marks."""
    accented, plain = [], []
    for code in range(0xE0, 0x234):
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if (
            letter == letter.lower()
            and len(parts) > 1
            and parts[0].isascii()
            and parts[0].isalpha()
            and all(unicodedata.combining(mark) for mark in parts[1:])
        ):
            accented.append(letter)
            plain.append(parts[0])
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _fold_pairs()


def fold(text: Column) -> Column:
    """Case and accents removed, length kept, so offsets in the result stay valid."""
    return F.translate(F.lower(F.translate(text, "İ", "I")), _ACCENTED, _PLAIN)


def fold_literal(query: str) -> str:
    return query.replace("İ", "I").lower().translate(str.maketrans(_ACCENTED, _PLAIN))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def is_tight(word: Column) -> Column:
    return F.substring(word, 1, 1).isin(TIGHT_CHARACTERS)


def spacing(word: Column) -> Column:
    return F.when(is_tight(word), F.lit("")).otherwise(F.lit(" "))


def joined_text(words: Column) -> Column:
    """An array of strings as running text; empty words add nothing."""
    spoken = F.filter(words, lambda w: w != "")
    return F.array_join(
        F.transform(
            spoken, lambda w, i: F.when(i == 0, w).otherwise(F.concat(spacing(w), w))
        ),
        "",
    )


def word_texts(words: Column) -> Column:
    return F.transform(words, lambda w: w["word"])


def trimmed(text: Column) -> Column:
    """White space and line breaks removed at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def ends_sentence(word: Column) -> Column:
    return F.substring(word, -1, 1).isin(SENTENCE_ENDS)


def _java_pattern(literal: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in literal)


def match_offsets(text: Column, query: str) -> Column:
    """Zero-based offsets of all occurrences, overlapping ones too; blank finds none.

    The text is cut before every occurrence by a zero-width look-ahead, which
    is one pass over it; the lengths of the pieces add up to the offsets.
    """
    wanted = fold_literal(query.strip())
    if not wanted:
        return F.array().cast("array<int>")
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")
    )

    def walk(folded: Column) -> Column:
        # Every piece but the first begins with an occurrence, which an
        # overlapping one may have cut short.
        walked = F.aggregate(
            F.split(folded, f"(?={_java_pattern(wanted)})", -1),
            start,
            lambda acc, piece: F.struct(
                (acc["at"] + F.length(piece)).alias("at"),
                F.when(
                    (acc["at"] > 0) | folded.startswith(wanted),
                    F.concat(acc["found"], F.array(acc["at"])),
                )
                .otherwise(acc["found"])
                .alias("found"),
            ),
        )
        return walked["found"]

    return let(fold(text), walk)


def text_words(text: Column) -> Column:
    return F.filter(F.split(text, " ", -1), lambda w: w != "")


def wrap_lines(text: Column) -> Column:
    """Greedy first line, everything else on the second."""
    flat = F.array_join(text_words(text), " ")
    return F.when(F.length(flat) <= LINE_WIDTH, flat).otherwise(
        F.regexp_replace(
            flat,
            rf"(?s)^(.{{1,{LINE_WIDTH}}}|[^ ]{{{LINE_WIDTH + 1},}}) (.*)$",
            "$1\n$2",
        )
    )


def attribution(speaker: Column) -> Column:
    return F.concat(speaker, F.lit(": "))


def display_text(speaker: Column, text: Column) -> Column:
    return wrap_lines(
        F.when(speaker.isNotNull(), F.concat(attribution(speaker), text)).otherwise(text)
    )


def escape_markup(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    text = F.replace(text, F.lit("<"), F.lit("&lt;"))
    return F.replace(text, F.lit(">"), F.lit("&gt;"))


def _whole(value: Column) -> Column:
    return F.floor(value).cast("long")


def timecode_short(seconds: Column) -> Column:
    total = _whole(seconds)
    hours, minutes, secs = _whole(total / 3600), _whole(total % 3600 / 60), total % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, secs)).otherwise(
        F.format_string("%d:%02d", minutes, secs)
    )


def timecode_padded(seconds: Column) -> Column:
    total = _whole(seconds)
    return F.format_string(
        "%02d:%02d:%02d", _whole(total / 3600), _whole(total % 3600 / 60), total % 60
    )


def timecode_subtitle(seconds: Column, separator: str) -> Column:
    ms = F.greatest(F.lit(0).cast("long"), F.round(seconds * 1000).cast("long"))
    total = _whole(ms / 1000)
    return F.format_string(
        "%02d:%02d:%02d" + separator + "%03d",
        _whole(total / 3600),
        _whole(total % 3600 / 60),
        total % 60,
        ms % 1000,
    )


def plain_attribution(start: Column, speaker: Column) -> Column:
    return F.concat(F.lit("["), timecode_padded(start), F.lit("] "), speaker, F.lit(":"))


def plain_line(start: Column, speaker: Column, text: Column) -> Column:
    return F.concat(plain_attribution(start, speaker), F.lit(" "), text)


def sanitize_name(title: Column, fallback: str = NAME_FALLBACK) -> Column:
    """A title as a file name: no control characters, separators or leading dots."""
    name = F.regexp_replace(title, r"[\p{Cc}\p{Cf}]", "")
    name = trimmed(F.translate(name, "/:", "--"))
    name = F.regexp_replace(name, r"^[.\s]+", "")
    return let(
        let(name, lambda n: trimmed(_within_bytes(n))),
        lambda cut: F.when(cut == "", F.lit(fallback)).otherwise(cut),
    )


def _within_bytes(name: Column) -> Column:
    """The longest prefix within the byte limit.

    At most NAME_BYTES characters can fit, so only that many prefixes are weighed.
    """
    lengths = F.sequence(F.lit(NAME_BYTES), F.lit(1), F.lit(-1))
    fitting = F.filter(
        lengths, lambda n: F.octet_length(F.substring(name, F.lit(1), n)) <= NAME_BYTES
    )
    return F.when(F.octet_length(name) <= NAME_BYTES, name).otherwise(
        F.substring(name, F.lit(1), F.get(fitting, F.lit(0)))
    )
