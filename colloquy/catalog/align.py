"""Queries: aligning words, sides, turns and look-ups in time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.catalog.base_sql import floored
from colloquy.catalog.registry import DIGITS, query
from colloquy.functions.vectors import decibels
from colloquy.operators import align, sides
from colloquy.operators import turns as turn_ops
from colloquy.operators.library import meeting_stats
from colloquy.plans.intervals import bucket_of
from colloquy.plans.scan import ordinal

# Seconds per frame of the derived frames; an event stands for one second.
EVENT_FRAME = 1.0

BEST_OVERLAP = """
best AS (
  SELECT w.meeting_id, w.word_idx, s.speaker_id
  FROM words w JOIN segments s ON w.meeting_id = s.meeting_id
   AND least(w."end", s."end") - greatest(w.start, s.start) > 0
  QUALIFY row_number() OVER (PARTITION BY w.meeting_id, w.word_idx
    ORDER BY least(w."end", s."end") - greatest(w.start, s.start) DESC, s.start, s.seg_idx) = 1
),
nearest AS (
  SELECT w.meeting_id, w.word_idx, s.speaker_id
  FROM words w JOIN segments s ON w.meeting_id = s.meeting_id
  WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.meeting_id = w.meeting_id AND b.word_idx = w.word_idx)
  QUALIFY row_number() OVER (PARTITION BY w.meeting_id, w.word_idx
    ORDER BY greatest(s.start - (w.start + w."end") / 2, (w.start + w."end") / 2 - s."end", 0),
             s.start, s.seg_idx) = 1
),
aligned AS (
  SELECT w.meeting_id, w.word_idx, w.word, w.start, w."end", w.stops, w.tight,
         coalesce(b.speaker_id, n.speaker_id, 'unknown') AS speaker_id
  FROM words w
  LEFT JOIN best b ON b.meeting_id = w.meeting_id AND b.word_idx = w.word_idx
  LEFT JOIN nearest n ON n.meeting_id = w.meeting_id AND n.word_idx = w.word_idx
)"""

RUNS = BEST_OVERLAP + """,
flagged AS (
  SELECT *, CASE WHEN p_speaker IS NULL OR p_speaker <> speaker_id OR start - p_end > 1.5
            THEN 1 ELSE 0 END AS hard
  FROM (SELECT *, lag(speaker_id) OVER w AS p_speaker, lag("end") OVER w AS p_end,
               lag(stops) OVER w AS p_stops
        FROM aligned WINDOW w AS (PARTITION BY meeting_id ORDER BY word_idx))
)"""

FOLDED = RUNS + """,
folded AS (
  SELECT meeting_id, word_idx, start AS turn_start, word_idx AS turn_first
  FROM flagged WHERE word_idx = 0
  UNION ALL
  SELECT f.meeting_id, f.word_idx,
         CASE WHEN f.hard = 1 OR (f.p_stops AND f.start - p.turn_start > 30)
              THEN f.start ELSE p.turn_start END,
         CASE WHEN f.hard = 1 OR (f.p_stops AND f.start - p.turn_start > 30)
              THEN f.word_idx ELSE p.turn_first END
  FROM folded p JOIN flagged f ON f.meeting_id = p.meeting_id AND f.word_idx = p.word_idx + 1
),
built AS (
  SELECT a.meeting_id, f.turn_first, min(a.speaker_id) AS speaker_id,
         min_by(a.start, a.word_idx) AS start, max_by(a."end", a.word_idx) AS "end",
         string_agg(CASE WHEN a.word_idx = f.turn_first OR a.tight THEN a.word
                    ELSE ' ' || a.word END, '' ORDER BY a.word_idx) AS text,
         count(*) AS n_words, sum(a."end" - a.start) AS word_seconds
  FROM aligned a JOIN folded f ON a.meeting_id = f.meeting_id AND a.word_idx = f.word_idx
  GROUP BY a.meeting_id, f.turn_first
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY turn_first) - 1 AS turn_idx
  FROM built
)"""

PROBES = """
probes AS (
  SELECT meeting_id, conv_id, turn_idx AS probe_id,
         (turn_idx * 17351 + conv_id * 733) % 400000 / CAST(1000 AS DOUBLE) AS t
  FROM turns
)"""


def words_only(t):
    return t.words.select("meeting_id", "word_idx", "word", "start", "end")


def aligned(t):
    return align.align_words(words_only(t), t.segments)


def probes(t):
    ms = (F.col("turn_idx") * 17351 + F.col("conv_id") * 733) % 400_000
    return t.turns.select(
        "meeting_id",
        "conv_id",
        F.col("turn_idx").alias("probe_id"),
        (ms.cast("double") / F.lit(1000.0)).alias("t"),
    )


@query(
    "align_words_overlap",
    "SELECT meeting_id, word_idx, speaker_id FROM best",
    BEST_OVERLAP,
)
def _(t):
    found = align.overlap_speaker(words_only(t), t.segments)
    return found.where("speaker_id IS NOT NULL").select("meeting_id", "word_idx", "speaker_id")


@query(
    "align_words_nearest",
    "SELECT meeting_id, word_idx, speaker_id FROM nearest",
    BEST_OVERLAP,
)
def _(t):
    gaps = align.overlap_speaker(words_only(t), t.segments).where("speaker_id IS NULL")
    near = align.nearest_speaker(gaps, t.segments)
    return near.where("speaker_id IS NOT NULL").select("meeting_id", "word_idx", "speaker_id")


@query(
    "align_words",
    "SELECT meeting_id, word_idx, word, start, \"end\", speaker_id FROM aligned",
    BEST_OVERLAP,
)
def _(t):
    return aligned(t).select("meeting_id", "word_idx", "word", "start", "end", "speaker_id")


@query(
    "turn_runs",
    """SELECT meeting_id, word_idx, CAST(sum(hard) OVER (PARTITION BY meeting_id ORDER BY word_idx)
         - 1 AS BIGINT) AS run_idx FROM flagged""",
    RUNS,
)
def _(t):
    return turn_ops.turn_runs(aligned(t)).select("meeting_id", "word_idx", "run_idx")


@query(
    "turns",
    """SELECT meeting_id, CAST(turn_idx AS BIGINT) AS turn_idx, speaker_id, start, "end", text,
              n_words FROM numbered""",
    FOLDED,
)
def _(t):
    return turn_ops.turns_from_words(aligned(t)).select(
        "meeting_id",
        "turn_idx",
        "speaker_id",
        "start",
        "end",
        "text",
        F.size("words").cast("long").alias("n_words"),
    )


@query(
    "meeting_stats",
    """SELECT b.meeting_id, CAST(sum(n_words) AS BIGINT) AS n_words,
              round(sum(word_seconds), 6) AS word_seconds,
              round(sum(b."end" - b.start), 6) AS turn_seconds,
              round(sum(b."end" - b.start) / m.duration, 6) AS covered,
              count(DISTINCT speaker_id) AS n_speakers, count(*) AS n_turns
       FROM numbered b JOIN meetings m ON b.meeting_id = m.meeting_id
       GROUP BY b.meeting_id, m.duration""",
    FOLDED,
)
def _(t):
    stats = meeting_stats(turn_ops.turns_from_words(aligned(t)), t.meetings)
    return stats.select(
        "meeting_id",
        "n_words",
        F.round("word_seconds", DIGITS).alias("word_seconds"),
        F.round("turn_seconds", DIGITS).alias("turn_seconds"),
        F.round("covered", DIGITS).alias("covered"),
        "n_speakers",
        "n_turns",
    )


@query(
    "turn_order",
    """SELECT meeting_id, turn_id, row_number() OVER (PARTITION BY meeting_id ORDER BY start,
         turn_idx) AS place FROM turns""",
)
def _(t):
    placed = ordinal(
        t.turns.select("meeting_id", "turn_id", "turn_idx", "start"),
        ["meeting_id"],
        bucket_of(F.col("start")),
        [F.col("start"), F.col("turn_idx")],
        "place",
    )
    return placed.select("meeting_id", "turn_id", (F.col("place") + 1).alias("place"))


ENERGY = f"""
word_energy AS (
  SELECT w.meeting_id, w.word_idx, w.word, w.start, w."end",
         coalesce(avg(f.energy) FILTER (f.side = 'microphone'), 0) AS mic,
         coalesce(avg(f.energy) FILTER (f.side = 'systemAudio'), 0) AS sys
  FROM words w LEFT JOIN frames f ON w.meeting_id = f.meeting_id
   AND f.frame BETWEEN greatest(0, {floored('w.start')}) AND {floored('w."end"')}
  GROUP BY ALL
),
measured AS (SELECT meeting_id, count(DISTINCT side) AS n FROM frames GROUP BY 1),
sided AS (
  SELECT e.*, CASE WHEN m.n = 2 THEN CASE WHEN sys > mic THEN 'systemAudio' ELSE 'microphone' END
              END AS side
  FROM word_energy e LEFT JOIN measured m ON e.meeting_id = m.meeting_id
)"""


@query(
    "word_side_energy",
    """SELECT meeting_id, word_idx,
              round(10 * log10(greatest(mic, CAST(1e-12 AS DOUBLE))), 6) AS microphone_db,
              round(10 * log10(greatest(sys, CAST(1e-12 AS DOUBLE))), 6) AS system_db
       FROM word_energy""",
    ENERGY,
)
def _(t):
    return sides.word_side_energy(words_only(t), t.frame_blocks, EVENT_FRAME).select(
        "meeting_id",
        "word_idx",
        F.round(decibels(F.col("microphone_energy")), DIGITS).alias("microphone_db"),
        F.round(decibels(F.col("system_energy")), DIGITS).alias("system_db"),
    )


@query("attribute_side", "SELECT meeting_id, word_idx, side FROM sided", ENERGY)
def _(t):
    return sides.attribute_side(words_only(t), t.frame_blocks, EVENT_FRAME).select(
        "meeting_id", "word_idx", "side"
    )


TWO_SIDED = ENERGY + """,
ranked AS (
  SELECT w.meeting_id, w.word_idx, s.speaker_id,
         row_number() OVER (PARTITION BY w.meeting_id, w.word_idx ORDER BY
           CASE WHEN least(w."end", s."end") - greatest(w.start, s.start) > 0 THEN 0 ELSE 1 END,
           CASE WHEN least(w."end", s."end") - greatest(w.start, s.start) > 0
                THEN greatest(w.start, s.start) - least(w."end", s."end")
                ELSE greatest(s.start - (w.start + w."end") / 2,
                              (w.start + w."end") / 2 - s."end", 0) END,
           s.start, s.seg_idx) AS rn
  FROM sided w JOIN segments s ON w.meeting_id = s.meeting_id
   AND (w.side IS NULL OR s.side = w.side)
)"""


@query(
    "align_two_sided",
    """SELECT w.meeting_id, w.word_idx, w.side, coalesce(r.speaker_id, 'unknown') AS speaker_id
       FROM sided w LEFT JOIN ranked r
         ON r.meeting_id = w.meeting_id AND r.word_idx = w.word_idx AND r.rn = 1""",
    TWO_SIDED,
)
def _(t):
    return sides.align_two_sided(words_only(t), t.segments, t.frame_blocks, EVENT_FRAME).select(
        "meeting_id", "word_idx", "side", "speaker_id"
    )


@query(
    "active_word_at",
    """SELECT p.meeting_id, p.probe_id, p.t, max(w.word_idx) AS word_idx
       FROM probes p JOIN words w ON p.meeting_id = w.meeting_id
        AND p.t >= w.start AND p.t < greatest(w."end", w.start + CAST(0.01 AS DOUBLE))
       GROUP BY ALL""",
    PROBES,
)
def _(t):
    return align.active_word(probes(t), words_only(t))


@query(
    "active_turn_at",
    """SELECT p.meeting_id, p.probe_id, p.t, min_by(u.turn_id, u.turn_idx) AS turn_id
       FROM probes p JOIN turns u ON p.meeting_id = u.meeting_id
        AND p.t >= u.start AND p.t < u."end" GROUP BY ALL""",
    PROBES,
)
def _(t):
    return align.active_turn(probes(t), t.turns)


@query(
    "speaker_at_bucket",
    """SELECT p.meeting_id, p.probe_id, p.t,
              CASE WHEN p.t >= s.start THEN s.speaker_id END AS speaker_id,
              CASE WHEN p.t >= s.start THEN s.roster_pos % 8 END AS colour
       FROM probes p LEFT JOIN spans s ON p.meeting_id = s.meeting_id AND s.turn_idx = (
         SELECT min(u.turn_idx) FROM spans u WHERE u.meeting_id = p.meeting_id AND u."end" >= p.t)""",
    PROBES + """,
spans AS (
  SELECT t.meeting_id, t.turn_idx, t.speaker_id, t.start, t."end",
         CAST(s.roster_pos AS BIGINT) AS roster_pos
  FROM turns t LEFT JOIN speakers s ON t.meeting_id = s.meeting_id AND t.speaker_id = s.speaker_id
)""",
)
def _(t):
    places = t.speakers.select("meeting_id", "speaker_id", "roster_pos")
    spans = t.turns.join(places, ["meeting_id", "speaker_id"], "left")
    return align.speaker_at(probes(t), spans)


@query(
    "union_sides",
    """SELECT meeting_id, CASE side WHEN 'microphone' THEN 'mic:' ELSE 'sys:' END || speaker_id
         AS speaker_id, side, start, "end" FROM segments""",
)
def _(t):
    each = [t.segments.where(F.col("side") == s) for s in (sides.MICROPHONE, sides.SYSTEM_AUDIO)]
    return each[0].unionByName(each[1]).select(
        "meeting_id",
        sides.qualified_id(F.col("side"), F.col("speaker_id")).alias("speaker_id"),
        "side",
        "start",
        "end",
    )


@query(
    "qualify_speaker_ids",
    """SELECT meeting_id, roster_pos, CASE side WHEN 'microphone' THEN 'mic:' || speaker_id
         WHEN 'systemAudio' THEN 'sys:' || speaker_id ELSE speaker_id END AS qualified
       FROM speakers""",
)
def _(t):
    return t.speakers.select(
        "meeting_id",
        "roster_pos",
        sides.qualified_id(F.col("side"), F.col("speaker_id")).alias("qualified"),
    )


@query(
    "preview_turns",
    """SELECT meeting_id, side, turn_id FROM (
         SELECT meeting_id, turn_id, CASE WHEN speaker_id = 'user' THEN 'microphone'
                ELSE 'systemAudio' END AS side, turn_idx FROM turns)
       QUALIFY row_number() OVER (PARTITION BY meeting_id, side ORDER BY turn_idx) <= 3""",
)
def _(t):
    side = F.when(F.col("speaker_id") == "user", sides.MICROPHONE).otherwise(sides.SYSTEM_AUDIO)
    place = F.row_number().over(Window.partitionBy("meeting_id", "side").orderBy("turn_idx"))
    return (
        t.turns.select("meeting_id", "turn_id", "turn_idx", side.alias("side"))
        .withColumn("place", place)
        .where("place <= 3")
        .select("meeting_id", "side", "turn_id")
    )


@query(
    "clean_words",
    """SELECT meeting_id, word_idx, trim(word) AS word FROM padded WHERE trim(word) <> ''
         AND conv_id % 6 <> 0
       UNION ALL
       SELECT meeting_id, 0, trim(text) FROM texts WHERE conv_id % 6 = 0 AND trim(text) <> ''""",
    """
padded AS (
  SELECT meeting_id, conv_id, word_idx, CASE WHEN word_idx % 5 = 0 THEN ' ' ELSE '' END ||
         CASE WHEN word_idx % 7 = 0 THEN '' ELSE word END || ' ' AS word FROM words
),
texts AS (SELECT meeting_id, conv_id, text FROM turns WHERE turn_idx = 0)""",
)
def _(t):
    messy = F.concat(
        F.when(F.col("word_idx") % 5 == 0, " ").otherwise(""),
        F.when(F.col("word_idx") % 7 == 0, "").otherwise(F.col("word")),
        F.lit(" "),
    )
    words = t.words.where("conv_id % 6 <> 0").withColumn("word", messy)
    texts = t.turns.where("turn_idx = 0").select("meeting_id", "text")
    return align.clean_words(words, texts).select("meeting_id", "word_idx", "word")


@query(
    "shift_timeline",
    """SELECT t.meeting_id, t.turn_id, round(t.start + m.off, 6) AS start,
              round(t."end" + m.off, 6) AS "end",
              round(w.s + m.off * w.n, 6) AS word_starts
       FROM turns t
       JOIN (SELECT meeting_id, conv_id % 5 * CAST(2.5 AS DOUBLE) AS off FROM meetings) m
         ON t.meeting_id = m.meeting_id
       LEFT JOIN (SELECT turn_id, sum(start) AS s, count(*) AS n FROM timed_words GROUP BY 1) w
         ON t.turn_id = w.turn_id""",
)
def _(t):
    offsets = t.meetings.select(
        "meeting_id", (F.col("conv_id") % 5 * F.lit(2.5)).alias("offset")
    )
    moved = align.shift_timeline(t.turns.join(offsets, "meeting_id"), "offset")
    total = F.aggregate("words", F.lit(0.0), lambda acc, w: acc + w["start"])
    return moved.select(
        "meeting_id",
        "turn_id",
        F.round("start", DIGITS).alias("start"),
        F.round("end", DIGITS).alias("end"),
        F.round(total, DIGITS).alias("word_starts"),
    )


RANGES = """
ranges AS (
  SELECT meeting_id, turn_id, word, pos, start, tight,
         upto - len(word) AS lo, upto AS hi
  FROM (SELECT *, CAST(sum(len(word) + CASE WHEN pos = 0 OR tight THEN 0 ELSE 1 END)
                  OVER (PARTITION BY turn_id ORDER BY pos) AS BIGINT) AS upto FROM timed_words)
)"""


@query(
    "word_char_ranges",
    "SELECT meeting_id, turn_id, pos AS idx, word, lo, hi FROM ranges",
    RANGES,
)
def _(t):
    return turn_ops.word_char_ranges(t.turns).select(
        "meeting_id",
        "turn_id",
        F.col("idx").cast("long").alias("idx"),
        "word",
        F.col("lo").cast("long").alias("lo"),
        F.col("hi").cast("long").alias("hi"),
    )


@query(
    "word_tokens",
    """SELECT meeting_id, turn_id, min(pos) AS token_id,
              string_agg(word, '' ORDER BY pos) AS text, min_by(start, pos) AS start,
              min(pos) AS word_lo, max(pos) + 1 AS word_hi, min(lo) AS text_lo, max(hi) AS text_hi
       FROM (SELECT *, sum(CASE WHEN pos = 0 OR NOT tight THEN 1 ELSE 0 END)
                    OVER (PARTITION BY turn_id ORDER BY pos) AS token FROM ranges)
       GROUP BY meeting_id, turn_id, token""",
    RANGES,
)
def _(t):
    tokens = turn_ops.word_tokens(t.turns)
    return tokens.select(
        "meeting_id",
        "turn_id",
        "text",
        "start",
        *[
            F.col(c).cast("long").alias(c)
            for c in ("token_id", "word_lo", "word_hi", "text_lo", "text_hi")
        ],
    )


@query(
    "pieces_to_words",
    """SELECT meeting_id, word, start, "end" FROM words""",
)
def _(t):
    # Each word as a beginning piece and the rest, with a mark before every turn.
    word, index = F.col("word"), F.col("word_idx")
    middle = (F.col("start") + F.col("end")) / 2
    parts = F.array(
        F.struct(
            (index * 3).alias("piece_idx"),
            F.lit("<turn>").alias("piece"),
            F.col("start"),
            F.col("start").alias("end"),
        ),
        F.struct(
            (index * 3 + 1).alias("piece_idx"),
            F.concat(F.lit("▁"), F.substring(word, 1, 3)).alias("piece"),
            F.col("start"),
            F.when(F.length(word) > 3, middle).otherwise(F.col("end")).alias("end"),
        ),
        F.struct(
            (index * 3 + 2).alias("piece_idx"),
            F.substring(word, F.lit(4), F.length(word)).alias("piece"),
            middle.alias("start"),
            F.col("end"),
        ),
    )
    used = F.filter(parts, lambda p: p["piece"] != "")
    pieces = t.words.select("meeting_id", F.inline(used))
    return turn_ops.pieces_to_words(pieces).select("meeting_id", "word", "start", "end")


@query(
    "joined_text",
    "SELECT meeting_id, turn_id, text, len(text) AS n_chars FROM turns",
)
def _(t):
    return t.turns.select(
        "meeting_id", "turn_id", "text", F.length("text").cast("long").alias("n_chars")
    )

