"""Queries: searching, trimming, editing and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog.base_sql import TIGHT
from colloquy.catalog.registry import DIGITS, query
from colloquy.functions import text as tx
from colloquy.operators import edits, search, trims
from colloquy.operators.edits import move_folder
from colloquy.operators.models import known_language
from colloquy.operators.replay import final_speakers, replay_turn_edits, speaker_fates, touched_turns
from colloquy.operators.speakers import roster_names
from colloquy.plans.scan import position_chunk, running
from colloquy.schema import DEFAULT_LANGUAGE
from colloquy.session import settle

QUERY = "An"
REPLACEMENT = "X"


def folded(query: str) -> str:
    return tx.fold_literal(query)


def any_accent(query: str) -> str:
    """A pattern matching the query in any case and with any accents."""
    plain = folded(query)
    return "(?i)" + "".join(
        "[" + c + "".join(a for a, b in zip(tx._ACCENTED, tx._PLAIN) if b == c) + "]"
        for c in plain
    )


# -- kept ranges -------------------------------------------------------------


@query("kept_turns", "SELECT meeting_id, turn_id FROM kept")
def _(t):
    return trims.kept_turns(t.turns, t.meetings).select("meeting_id", "turn_id")


@query(
    "trimmed_before_after",
    """SELECT t.meeting_id, count(*) FILTER (t."end" <= m.kept_start) AS hidden_before,
              count(*) FILTER (t.start >= m.kept_end) AS hidden_after
       FROM turns t JOIN meetings m ON t.meeting_id = m.meeting_id GROUP BY 1""",
)
def _(t):
    return trims.trimmed_before_after(t.turns, t.meetings)


REQUESTS = """
requests AS (
  SELECT meeting_id, duration, duration * (conv_id % 7 - 1) / 4 AS range_start,
         duration * (conv_id % 5) / 4 AS range_end FROM meetings
)"""


def requests(t):
    conv, duration = F.col("conv_id"), F.col("duration")
    return t.meetings.select(
        "meeting_id",
        "duration",
        (duration * (conv % 7 - 1) / 4).alias("range_start"),
        (duration * (conv % 5) / 4).alias("range_end"),
    )


@query(
    "normalize_kept_range",
    """SELECT meeting_id, hi > lo AS accepted,
              round(CASE WHEN hi > lo AND NOT (lo <= 0 AND hi >= duration) THEN lo END, 6) AS kept_start,
              round(CASE WHEN hi > lo AND NOT (lo <= 0 AND hi >= duration) THEN hi END, 6) AS kept_end
       FROM (SELECT *, least(range_start, range_end) AS lo, greatest(range_start, range_end) AS hi
             FROM requests)""",
    REQUESTS,
)
def _(t):
    return trims.normalize_kept_range(requests(t)).select(
        "meeting_id",
        "accepted",
        F.round("kept_start", DIGITS).alias("kept_start"),
        F.round("kept_end", DIGITS).alias("kept_end"),
    )


@query(
    "clamp_trim",
    """SELECT meeting_id, round(s, 6) AS clamped_start, round(e, 6) AS clamped_end,
              s > 0.05::DOUBLE OR e < duration - 0.05::DOUBLE AS is_trimmed,
              e - s > 1 AS is_usable
       FROM (SELECT *, greatest(0, least(range_start, duration)) AS s,
                    greatest(0, least(range_end, duration)) AS e FROM requests)""",
    REQUESTS,
)
def _(t):
    return trims.clamp_trim(requests(t), minimum=1.0).select(
        "meeting_id",
        F.round("clamped_start", DIGITS).alias("clamped_start"),
        F.round("clamped_end", DIGITS).alias("clamped_end"),
        "is_trimmed",
        "is_usable",
    )


# -- search --------------------------------------------------------------------

FOUND = f"""
found AS (
  SELECT meeting_id, turn_id, is_edited, unnest(list_filter(range(len(f)),
           lambda i: substr(f, i + 1, {len(QUERY)}) = '{folded(QUERY)}')) AS off
  FROM (SELECT *, strip_accents(lower(text)) AS f FROM turns)
),
ranges AS (
  SELECT meeting_id, turn_id, word, pos, upto - len(word) AS lo, upto AS hi
  FROM (SELECT *, CAST(sum(len(word) + CASE WHEN pos = 0 OR tight THEN 0 ELSE 1 END)
                  OVER (PARTITION BY turn_id ORDER BY pos) AS BIGINT) AS upto FROM timed_words)
),
placed AS (
  SELECT f.meeting_id, f.turn_id, f.off, min(r.pos) AS word_idx
  FROM found f LEFT JOIN ranges r ON f.turn_id = r.turn_id
   AND r.lo <= f.off AND f.off + {len(QUERY)} <= r.hi
  GROUP BY ALL
)"""


@query(
    "find_matches",
    f"SELECT meeting_id, turn_id, off AS \"offset\", CAST({len(QUERY)} AS BIGINT) AS length FROM found",
    FOUND,
)
def _(t):
    return search.find_matches(t.turns, QUERY).select(
        "meeting_id",
        "turn_id",
        F.col("offset").cast("long").alias("offset"),
        F.col("length").cast("long").alias("length"),
    )


@query(
    "match_in_word",
    'SELECT meeting_id, turn_id, off AS "offset", word_idx FROM placed',
    FOUND,
)
def _(t):
    return search.match_in_word(t.turns, QUERY).select(
        "meeting_id",
        "turn_id",
        F.col("offset").cast("long").alias("offset"),
        F.col("word_idx").cast("long").alias("word_idx"),
    )


@query(
    "replacement_cost",
    """SELECT meeting_id, count(word_idx) AS keeps_timings,
              count(*) - count(word_idx) AS drops_timings FROM placed GROUP BY 1""",
    FOUND,
)
def _(t):
    return search.replacement_cost(t.turns, QUERY)


@query(
    "ordered_lookup_range",
    """SELECT p.meeting_id, p.turn_id, p.off AS "offset" FROM found p
       JOIN turns t ON p.turn_id = t.turn_id WHERE p.off + 40 <= len(t.text)""",
    FOUND,
)
def _(t):
    # Ranges of forty characters from each match: some run past the text.
    wide = search.find_matches(t.turns, QUERY).withColumn("length", F.lit(40))
    return search.valid_match(t.turns, wide).select(
        "meeting_id", "turn_id", F.col("offset").cast("long").alias("offset")
    )


REPLACED = f"""
new_words AS (
  SELECT turn_id, pos, regexp_replace(word, '{any_accent(QUERY)}', '{REPLACEMENT}', 'g') AS word,
         len(regexp_extract_all(word, '{any_accent(QUERY)}')) AS n
  FROM timed_words
),
timed_after AS (
  SELECT turn_id, CAST(sum(n) AS BIGINT) AS kept, string_agg(CASE WHEN pos = 0
           OR left(word, 1) IN ({TIGHT}) THEN word ELSE ' ' || word END, '' ORDER BY pos) AS text
  FROM new_words GROUP BY 1
)"""


@query(
    "replace_all",
    f"""SELECT t.meeting_id, t.turn_id, t.is_edited,
               CASE WHEN t.is_edited THEN regexp_replace(t.text, '{any_accent(QUERY)}', '{REPLACEMENT}', 'g')
                    ELSE a.text END AS text,
               CASE WHEN t.is_edited THEN 0 ELSE a.kept END AS kept,
               CASE WHEN t.is_edited THEN len(regexp_extract_all(t.text, '{any_accent(QUERY)}'))
                    ELSE 0 END AS dropped
        FROM turns t LEFT JOIN timed_after a ON t.turn_id = a.turn_id""",
    REPLACED,
)
def _(t):
    return search.replace_all(t.turns, QUERY, REPLACEMENT).select(
        "meeting_id",
        "turn_id",
        "is_edited",
        "text",
        F.col("kept").cast("long").alias("kept"),
        F.col("dropped").cast("long").alias("dropped"),
    )


@query(
    "replace_match",
    """SELECT t.meeting_id, t.turn_id, t.is_edited OR instr(t.text, 'e a') > 0 AS is_edited,
              replace(t.text, 'e a', 'e&a') AS text,
              CAST(0 AS BIGINT) AS kept,
              CAST((len(t.text) - len(replace(t.text, 'e a', ''))) // 3 AS BIGINT) AS dropped
       FROM (SELECT *, strip_accents(lower(text)) AS f FROM turns) t
       WHERE len(f) - len(replace(f, 'e a', '')) = len(t.text) - len(replace(t.text, 'e a', ''))""",
)
def _(t):
    # A query across words: the turn falls back to text. Only turns where every
    # match is spelled without accents or capitals are compared.
    done = search.replace_all(t.turns, "e a", "e&a")
    plain = F.length(F.replace("text", F.lit("e a"), F.lit("")))
    matches = F.size(tx.match_offsets(F.col("text"), "e a"))
    wanted = t.turns.where(matches * 3 == F.length("text") - plain).select("turn_id")
    return done.join(wanted, "turn_id", "left_semi").select(
        "meeting_id",
        "turn_id",
        "is_edited",
        "text",
        F.col("kept").cast("long").alias("kept"),
        F.col("dropped").cast("long").alias("dropped"),
    )


@query(
    "library_filter",
    """SELECT meeting_id, title FROM meetings m WHERE contains(lower(title), '7')
         OR meeting_id IN (SELECT meeting_id FROM speakers WHERE contains(lower(name), '7'))
         OR meeting_id IN (SELECT meeting_id FROM turns WHERE contains(lower(text), '7'))""",
)
def _(t):
    return search.library_filter(t.meetings, t.speakers, t.turns, " 7").select(
        "meeting_id", "title"
    )


# -- edits -----------------------------------------------------------------------

EDITS = """
edits AS (
  SELECT meeting_id, conv_id * 10 + k AS seq, 'rename_meeting' AS op, NULL AS turn_id,
         NULL AS speaker_id, CASE WHEN k = 2 AND conv_id % 3 = 0 THEN '  ' ELSE ' Title ' || k || ' ' END AS arg,
         CAST(NULL AS DOUBLE) AS num FROM meetings, range(3) r(k) WHERE conv_id % 2 = 0
  UNION ALL
  SELECT meeting_id, turn_idx, 'rename_speaker', NULL, speaker_id,
         CASE WHEN turn_idx % 4 = 3 THEN ' ' ELSE 'Name ' || turn_idx END, NULL
  FROM turns WHERE turn_idx % 2 = 1
  UNION ALL
  SELECT meeting_id, turn_idx, 'reassign', turn_id, NULL,
         CASE WHEN turn_idx % 2 = 0 THEN 'system' ELSE 'assistant' END, NULL
  FROM turns WHERE (conv_id + turn_idx) % 4 = 0
  UNION ALL
  SELECT meeting_id, turn_idx, 'remove', turn_id, NULL, NULL, NULL
  FROM turns WHERE (conv_id * 5 + turn_idx) % 7 = 0
  UNION ALL
  SELECT meeting_id, turn_idx * 2 + k, 'edit_text', turn_id, NULL,
         CASE WHEN turn_idx % 3 = 0 THEN ' ' || text || ' '
              ELSE 'Edited ' || k || ' ' || text || '#' END, NULL
  FROM turns, range(2) r(k) WHERE (conv_id + turn_idx * 3) % 5 = 0
  UNION ALL
  SELECT meeting_id, conv_id, 'attach_audio', NULL, NULL, '/new/' || conv_id || '.m4a',
         CASE WHEN conv_id % 4 = 0 THEN -1 ELSE conv_id + CAST(0.5 AS DOUBLE) END
  FROM meetings WHERE conv_id % 3 = 1
)"""

_EDIT_COLUMNS = ["meeting_id", "seq", "op", "turn_id", "speaker_id", "arg", "num"]


def edit_log(t):
    """Edits derived from the turns: several of each kind, some of them invalid."""
    null = F.lit(None).cast("string")
    conv, turn = F.col("conv_id"), F.col("turn_idx")

    def rows(df, seq, op, turn_id=null, speaker_id=null, arg=null, num=F.lit(None)):
        return df.select(
            "meeting_id",
            seq.cast("long").alias("seq"),
            F.lit(op).alias("op"),
            turn_id.alias("turn_id"),
            speaker_id.alias("speaker_id"),
            arg.alias("arg"),
            num.cast("double").alias("num"),
        )

    thrice = t.meetings.where(conv % 2 == 0).withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    twice = t.turns.where((conv + turn * 3) % 5 == 0).withColumn(
        "k", F.explode(F.array(F.lit(0), F.lit(1)))
    )
    k = F.col("k").cast("string")
    parts = [
        rows(
            thrice,
            conv * 10 + F.col("k"),
            "rename_meeting",
            arg=F.when((F.col("k") == 2) & (conv % 3 == 0), "  ").otherwise(
                F.concat(F.lit(" Title "), k, F.lit(" "))
            ),
        ),
        rows(
            t.turns.where(turn % 2 == 1),
            turn,
            "rename_speaker",
            speaker_id=F.col("speaker_id"),
            arg=F.when(turn % 4 == 3, " ").otherwise(F.concat(F.lit("Name "), turn.cast("string"))),
        ),
        rows(
            t.turns.where((conv + turn) % 4 == 0),
            turn,
            "reassign",
            F.col("turn_id"),
            arg=F.when(turn % 2 == 0, "system").otherwise("assistant"),
        ),
        rows(t.turns.where((conv * 5 + turn) % 7 == 0), turn, "remove", F.col("turn_id")),
        rows(
            twice,
            turn * 2 + F.col("k"),
            "edit_text",
            F.col("turn_id"),
            arg=F.when(turn % 3 == 0, F.concat(F.lit(" "), F.col("text"), F.lit(" "))).otherwise(
                F.concat(F.lit("Edited "), k, F.lit(" "), F.col("text"), F.lit("#"))
            ),
        ),
        rows(
            t.meetings.where(conv % 3 == 1),
            conv,
            "attach_audio",
            arg=F.concat(F.lit("/new/"), conv.cast("string"), F.lit(".m4a")),
            num=F.when(conv % 4 == 0, F.lit(-1.0)).otherwise(conv + F.lit(0.5)),
        ),
    ]
    log = parts[0]
    for part in parts[1:]:
        log = log.unionByName(part)
    return log


@query(
    "edit_rename_meeting",
    """SELECT m.meeting_id, coalesce(e.title, m.title) AS title FROM meetings m LEFT JOIN (
         SELECT meeting_id, max_by(trim(arg), seq) AS title FROM edits
         WHERE op = 'rename_meeting' AND trim(arg) <> '' GROUP BY 1) e ON m.meeting_id = e.meeting_id""",
    EDITS,
)
def _(t):
    return edits.rename_meetings(t.meetings, edit_log(t)).select("meeting_id", "title")


@query(
    "edit_rename_speaker",
    """SELECT s.meeting_id, s.speaker_id, coalesce(e.name, s.name) AS name,
              s.is_named OR e.name IS NOT NULL AS is_named
       FROM speakers s LEFT JOIN (
         SELECT meeting_id, speaker_id, max_by(trim(arg), seq) AS name FROM edits
         WHERE op = 'rename_speaker' AND trim(arg) <> '' GROUP BY ALL) e
       ON s.meeting_id = e.meeting_id AND s.speaker_id = e.speaker_id""",
    EDITS,
)
def _(t):
    return edits.rename_speakers(t.speakers, edit_log(t)).select(
        "meeting_id", "speaker_id", "name", "is_named"
    )


@query(
    "edit_reassign",
    """SELECT t.meeting_id, t.turn_id, coalesce(e.arg, t.speaker_id) AS speaker_id
       FROM turns t LEFT JOIN edits e ON e.op = 'reassign' AND t.turn_id = e.turn_id
        AND EXISTS (SELECT 1 FROM speakers s WHERE s.meeting_id = e.meeting_id
                    AND s.speaker_id = e.arg)""",
    EDITS,
)
def _(t):
    return edits.reassign_turns(t.turns, edit_log(t), t.speakers).select(
        "meeting_id", "turn_id", "speaker_id"
    )


@query(
    "edit_remove_turn",
    """SELECT meeting_id, turn_id FROM turns WHERE turn_id NOT IN (
         SELECT turn_id FROM edits WHERE op = 'remove')""",
    EDITS,
)
def _(t):
    return edits.remove_turns(t.turns, edit_log(t)).select("meeting_id", "turn_id")


@query(
    "edit_text",
    """SELECT t.meeting_id, t.turn_id, coalesce(e.text, t.text) AS text,
              t.is_edited OR coalesce(e.touched <> 0, false) AS is_edited,
              NOT (t.is_edited OR coalesce(e.touched <> 0, false)) AS has_words
       FROM turns t LEFT JOIN (
         SELECT e.turn_id, max_by(trim(e.arg), e.seq) AS text,
                count(*) FILTER (trim(e.arg) <> t.text) AS touched
         FROM edits e JOIN turns t ON e.turn_id = t.turn_id
         WHERE e.op = 'edit_text' GROUP BY 1) e ON t.turn_id = e.turn_id""",
    EDITS,
)
def _(t):
    return edits.edit_texts(t.turns, edit_log(t)).select(
        "meeting_id", "turn_id", "text", "is_edited", F.col("words").isNotNull().alias("has_words")
    )


@query(
    "edit_attach_audio",
    """SELECT m.meeting_id, coalesce(e.arg, m.audio_path) AS audio_path,
              CASE WHEN e.num > 0 THEN e.num ELSE m.duration END AS duration
       FROM meetings m LEFT JOIN edits e ON e.op = 'attach_audio' AND m.meeting_id = e.meeting_id""",
    EDITS,
)
def _(t):
    return edits.attach_audio(t.meetings, edit_log(t)).select(
        "meeting_id", "audio_path", "duration"
    )


@query(
    "drop_translations",
    """SELECT meeting_id, turn_id, text FROM translations WHERE turn_id NOT IN (
         SELECT turn_id FROM edits WHERE op = 'remove'
         UNION ALL
         SELECT e.turn_id FROM edits e JOIN turns t ON t.turn_id = e.turn_id
         WHERE e.op = 'edit_text' AND trim(e.arg, E' \\t\\n\\r') <> t.text)""",
    EDITS,
)
def _(t):
    touched = touched_turns(t.turns, t.speakers, edit_log(t))
    return edits.drop_translations(t.translations, touched).select("meeting_id", "turn_id", "text")


SPLIT = f"""
splits AS (
  SELECT turn_id, turn_idx % 40 AS k, 1000 + turn_idx AS seq FROM turns WHERE conv_id % 2 = 1
),
halves AS (
  SELECT w.meeting_id, w.turn_id, w.pos, w.word, w.start, w."end",
         CASE WHEN s.k > 0 AND s.k < t.n_words AND w.pos >= s.k THEN 1 ELSE 0 END AS part, s.seq, s.k
  FROM timed_words w JOIN turns t ON w.turn_id = t.turn_id
  LEFT JOIN splits s ON w.turn_id = s.turn_id
),
split_turns AS (
  SELECT meeting_id, CASE WHEN part = 1 THEN turn_id || '/' || seq ELSE turn_id END AS turn_id,
         part, min_by(start, pos) AS start, max_by("end", pos) AS "end",
         string_agg(CASE WHEN pos = CASE WHEN part = 1 THEN k ELSE 0 END
             OR left(word, 1) IN ({TIGHT}) THEN word ELSE ' ' || word END, '' ORDER BY pos) AS text
  FROM halves GROUP BY meeting_id, turn_id, part, seq, k
  UNION ALL
  SELECT meeting_id, turn_id, 0, start, "end", text FROM turns WHERE is_edited
)"""


def splits(t):
    turn = F.col("turn_idx")
    return t.turns.where("conv_id % 2 = 1").select(
        "meeting_id", "turn_id", (turn + 1000).alias("seq"), (turn % 40).cast("int").alias("k")
    )


@query(
    "edit_split_turn",
    'SELECT meeting_id, turn_id, part, start, "end", text FROM split_turns',
    SPLIT,
)
def _(t):
    return edits.split_turns(t.turns, splits(t)).select(
        "meeting_id", "turn_id", "part", "start", "end", "text"
    )


@query(
    "edit_split_at_time",
    """SELECT meeting_id, turn_id, min(pos) AS k FROM (
         SELECT w.*, (t.start + t."end") / 2 AS middle FROM timed_words w JOIN turns t ON w.turn_id = t.turn_id)
       WHERE middle < "end" GROUP BY ALL HAVING min(pos) > 0""",
)
def _(t):
    middle = (F.col("start") + F.col("end")) / 2
    k = edits.split_index_at_time(F.col("words"), middle)
    found = t.turns.where("words IS NOT NULL").select(
        "meeting_id", "turn_id", k.cast("long").alias("k")
    )
    return found.where("k > 0")


MERGED = """
merged AS (
  SELECT a.meeting_id, a.turn_id, a.speaker_id, least(a.start, b.start) AS start,
         greatest(a."end", b."end") AS "end",
         a.text || CASE WHEN left(b.text, 1) IN (""" + TIGHT + """) THEN '' ELSE ' ' END || b.text AS text,
         a.is_edited OR b.is_edited AS is_edited, NOT (a.is_edited OR b.is_edited) AS has_words
  FROM turns a JOIN turns b ON a.meeting_id = b.meeting_id AND b.turn_idx = a.turn_idx + 1
  WHERE a.turn_idx % 3 = 0
  UNION ALL
  SELECT meeting_id, turn_id, speaker_id, start, "end", text, is_edited, NOT is_edited FROM turns t
  WHERE turn_idx % 3 <> 1 AND NOT (turn_idx % 3 = 0 AND EXISTS (
    SELECT 1 FROM turns n WHERE n.meeting_id = t.meeting_id AND n.turn_idx = t.turn_idx + 1))
)"""


def merged(t):
    pairs = t.turns.where("turn_idx % 3 = 0").select("meeting_id", "turn_idx")
    return edits.merge_neighbours(t.turns, pairs).select(
        "meeting_id",
        "turn_id",
        "speaker_id",
        "start",
        "end",
        "text",
        "is_edited",
        F.col("words").isNotNull().alias("has_words"),
    )


@query("edit_merge_turns", "SELECT * FROM merged", MERGED)
def _(t):
    return merged(t)


@query(
    "neighbour_merge",
    """SELECT meeting_id, count(*) AS turns_left, sum(len(text))::BIGINT AS chars FROM merged
       GROUP BY 1""",
    MERGED,
)
def _(t):
    return merged(t).groupBy("meeting_id").agg(
        F.count("*").alias("turns_left"), F.sum(F.length("text")).alias("chars")
    )


@query(
    "tight_spacing_merge_text",
    """SELECT a.meeting_id, a.turn_id,
              CASE WHEN a.turn_idx % 4 = 0 THEN coalesce(b.text, '')
                   WHEN coalesce(b.text, '') = '' THEN a.text
                   ELSE a.text || CASE WHEN left(b.text, 1) IN (""" + TIGHT + """) THEN '' ELSE ' ' END
                        || b.text END AS text
       FROM turns a LEFT JOIN turns b ON a.meeting_id = b.meeting_id
        AND b.turn_idx = a.turn_idx + 1""",
)
def _(t):
    following = t.turns.select(
        "meeting_id", (F.col("turn_idx") - 1).alias("turn_idx"), F.col("text").alias("after")
    )
    first = F.when(F.col("turn_idx") % 4 == 0, "").otherwise(F.col("text"))
    return t.turns.join(following, ["meeting_id", "turn_idx"], "left").select(
        "meeting_id",
        "turn_id",
        edits.merged_text(first, F.coalesce("after", F.lit(""))).alias("text"),
    )


def replay_log(t):
    """A mixed log in which later edits depend on earlier ones."""
    turn, conv = F.col("turn_idx"), F.col("conv_id")
    kind = (conv + turn) % 8
    named = (
        F.when(kind == 0, "split")
        .when(kind == 1, "merge_next")
        .when(kind == 2, "edit_text")
        .when(kind == 3, "remove")
        .when(kind == 4, "merge_previous")
        .when(kind == 5, "reassign")
    )
    on_turns = t.turns.withColumn("op", named).where("op IS NOT NULL").select(
        "meeting_id",
        (turn * 7919 % 101 * 1000 + turn).alias("seq"),
        "op",
        "turn_id",
        F.lit(None).cast("string").alias("speaker_id"),
        F.when(kind == 2, F.concat(F.lit("Edited "), F.col("turn_id")))
        .when(kind == 5, "assistant")
        .alias("arg"),
        F.when(kind == 0, F.lit(3.0)).alias("num"),
    )
    on_speakers = t.meetings.where(conv % 4 == 0).select(
        "meeting_id",
        F.lit(50_000).cast("long").alias("seq"),
        F.lit("merge_speakers").alias("op"),
        F.lit(None).cast("string").alias("turn_id"),
        F.lit("user").alias("speaker_id"),
        F.lit("assistant").alias("arg"),
        F.lit(None).cast("double").alias("num"),
    )
    return on_turns.unionByName(on_speakers)


#: One edit after another on the list of a meeting's turns.
REPLAYED = f"""
replay_log AS (
  SELECT meeting_id, seq, op, turn_id, row_number() OVER (PARTITION BY meeting_id ORDER BY seq) AS nth
  FROM (SELECT meeting_id, turn_id, turn_idx * 7919 % 101 * 1000 + turn_idx AS seq,
               CASE (conv_id + turn_idx) % 8 WHEN 0 THEN 'split' WHEN 1 THEN 'merge_next' WHEN 2 THEN 'edit_text'
                 WHEN 3 THEN 'remove' WHEN 4 THEN 'merge_previous' WHEN 5 THEN 'reassign' END AS op FROM turns)
  WHERE op <> 'reassign' OR op = 'reassign'
    AND meeting_id IN (SELECT meeting_id FROM speakers WHERE speaker_id = 'assistant')
),
steps AS (
  SELECT meeting_id, CAST(0 AS BIGINT) AS nth, CAST([] AS VARCHAR[]) AS touched,
         list({{'turn_id': turn_id, 'speaker_id': speaker_id, 'start': start, 'end': "end", 'text': text,
               'words': w, 'is_edited': is_edited}} ORDER BY turn_idx) AS r
  FROM turns LEFT JOIN (
    SELECT turn_id, list({{'word': word, 'start': start, 'end': "end"}} ORDER BY pos) AS w
    FROM timed_words GROUP BY 1) USING (turn_id)
  GROUP BY 1
  UNION ALL
  SELECT meeting_id, nth,
         CASE WHEN hit THEN list_distinct(touched || list_transform(old, lambda x: x.turn_id)) ELSE touched END,
         CASE WHEN hit OR op = 'reassign' THEN r[1:low - 1] || CASE op
           WHEN 'remove' THEN []
           WHEN 'reassign' THEN [struct_update(a, speaker_id := 'assistant')]
           WHEN 'edit_text' THEN [struct_update(a, text := edited, words := NULL, is_edited := true)]
           WHEN 'split' THEN list_transform(
             [{{'id': a.turn_id, 'p': a.words[1:3]}}, {{'id': a.turn_id || '/' || seq, 'p': a.words[4:len(a.words)]}}],
             lambda h: struct_update(a, turn_id := h.id, start := h.p[1].start, "end" := h.p[len(h.p)].end,
               text := array_to_string(list_transform(h.p, lambda w, i: CASE WHEN i = 1 OR left(w.word, 1) IN ({TIGHT})
                 THEN w.word ELSE ' ' || w.word END), ''), words := h.p, is_edited := false))
           ELSE [struct_update(a, start := least(a.start, b.start), "end" := greatest(a.end, b.end),
               text := a.text || CASE WHEN left(b.text, 1) IN ({TIGHT}) THEN '' ELSE ' ' END || b.text,
               words := CASE WHEN a.words IS NOT NULL AND b.words IS NOT NULL THEN a.words || b.words END,
               is_edited := a.is_edited OR b.is_edited)] END || r[low + len(old):len(r)]
         ELSE r END
  FROM (
    SELECT *, r[low] AS a, r[low + 1] AS b, r[low:low + CASE WHEN op LIKE 'merge%' THEN 1 ELSE 0 END] AS old,
           'Edited ' || turn_id AS edited,
           coalesce(low > 0, false) AND CASE op WHEN 'remove' THEN true WHEN 'reassign' THEN false
             WHEN 'edit_text' THEN r[low].text <> 'Edited ' || turn_id
             WHEN 'split' THEN coalesce(len(r[low].words) > 3, false)
             ELSE low < len(r) END AS hit
    FROM (
      SELECT s.meeting_id, l.nth, s.touched, s.r, l.seq, l.turn_id,
             CASE WHEN found_at > 0 OR l.op <> 'reassign' THEN l.op ELSE 'none' END AS op,
             CASE WHEN l.op = 'merge_previous' THEN found_at - 1 ELSE found_at END AS low
      FROM steps s JOIN replay_log l ON s.meeting_id = l.meeting_id AND l.nth = s.nth + 1,
           LATERAL (SELECT coalesce(list_position(list_transform(s.r, lambda x: x.turn_id), l.turn_id), 0) AS found_at)))
),
final AS (
  SELECT meeting_id, max_by(r, nth) AS r, max_by(touched, nth) AS touched FROM steps GROUP BY 1
),
absorbed AS (
  SELECT meeting_id FROM speakers WHERE conv_id % 4 = 0 AND speaker_id IN ('user', 'assistant')
  GROUP BY 1 HAVING count(*) = 2
)"""


@query(
    "replay_edit_log",
    """SELECT meeting_id, 'turn' AS kind, place, t.turn_id AS turn_id,
              CASE WHEN t.speaker_id = 'user' AND meeting_id IN (FROM absorbed) THEN 'assistant'
                   ELSE t.speaker_id END AS speaker_id,
              t.start AS start, t."end" AS "end", t.text AS text, t.is_edited AS is_edited
       FROM (SELECT meeting_id, unnest(r) AS t, unnest(range(1, len(r) + 1)) AS place FROM final)
       UNION ALL
       SELECT meeting_id, 'touched', NULL, unnest(touched), NULL, NULL, NULL, NULL, NULL FROM final""",
    REPLAYED,
)
def _(t):
    rows = settle(replay_turn_edits(t.turns, t.speakers, replay_log(t)), "replayed")
    is_turn = F.col("kind") == "turn"
    order = [F.col("island"), F.col("pos")]
    placed = running(
        rows,
        ["meeting_id"],
        position_chunk("island", 65_536),
        order,
        {"place": ("sum", F.when(is_turn, 1).otherwise(0).cast("long"))},
    )
    return placed.select(
        "meeting_id", "kind", F.when(is_turn, F.col("place")).alias("place"), "turn_id", "speaker_id",
        "start", "end", "text", "is_edited",
    )


@query(
    "edit_merge_speakers",
    """SELECT meeting_id, turn_id, CASE WHEN speaker_id = 'user' AND conv_id % 4 = 0
         AND meeting_id IN (SELECT meeting_id FROM speakers WHERE speaker_id = 'assistant')
         AND meeting_id IN (SELECT meeting_id FROM speakers WHERE speaker_id = 'user')
         THEN 'assistant' ELSE speaker_id END AS speaker_id FROM turns""",
)
def _(t):
    final = final_speakers(speaker_fates(t.speakers, replay_log(t)))
    return t.turns.join(final, ["meeting_id", "speaker_id"], "left").select(
        "meeting_id",
        "turn_id",
        F.coalesce("final_speaker", "speaker_id").alias("speaker_id"),
    )


@query(
    "rerun_replace",
    """SELECT meeting_id, title, CASE WHEN conv_id % 6 = 0 THEN 'english' ELSE language END AS language,
              CASE WHEN conv_id % 6 = 0 THEN 'apple-speech' ELSE model END AS model,
              CASE WHEN conv_id % 6 = 0 THEN duration + 1 ELSE duration END AS duration,
              kept_start, CASE WHEN conv_id % 6 <> 0 THEN target END AS target FROM meetings""",
)
def _(t):
    again = t.meetings.where("conv_id % 6 = 0").select(
        "meeting_id",
        F.lit("english").alias("language"),
        F.lit("apple-speech").alias("model"),
        (F.col("duration") + 1).alias("duration"),
        F.lit(None).cast("string").alias("degraded"),
        F.lit(None).cast("boolean").alias("fast"),
    )
    return edits.rerun_replace(t.meetings, again).select(
        "meeting_id", "title", "language", "model", "duration", "kept_start", "target"
    )


@query(
    "move_folder",
    """SELECT meeting_id, CASE WHEN source = 'src1' THEN 'archive/old/' || lang ELSE folder END AS folder
       FROM library""",
)
def _(t):
    moved = move_folder(t.library, ["src1"], ["archive", "old"])
    # Moving a folder into itself changes nothing.
    moved = move_folder(moved, ["archive"], ["archive", "old"])
    return moved.select("meeting_id", F.array_join("folder", "/").alias("folder"))


@query(
    "delete_folder",
    """SELECT meeting_id, CASE WHEN source = 'src2' THEN lang ELSE folder END AS folder FROM library""",
)
def _(t):
    moved = edits.delete_folder(t.library, ["src2"])
    return moved.select("meeting_id", F.array_join("folder", "/").alias("folder"))


# -- scalar columns -----------------------------------------------------------------


@query(
    "timecode_short_padded",
    """SELECT meeting_id, turn_id,
         CASE WHEN s >= 3600 THEN format('{}:{:02d}:{:02d}', s // 3600, s % 3600 // 60, s % 60)
              ELSE format('{}:{:02d}', s // 60, s % 60) END AS short,
         format('{:02d}:{:02d}:{:02d}', s // 3600, s % 3600 // 60, s % 60) AS padded
       FROM (SELECT *, CAST(floor(start * 60) AS BIGINT) AS s FROM turns)""",
)
def _(t):
    late = F.col("start") * 60
    return t.turns.select(
        "meeting_id",
        "turn_id",
        tx.timecode_short(late).alias("short"),
        tx.timecode_padded(late).alias("padded"),
    )


@query(
    "timecode_subtitle",
    """SELECT meeting_id, turn_id, format('{:02d}:{:02d}:{:02d}.{:03d}', ms // 3600000,
              ms % 3600000 // 60000, ms % 60000 // 1000, ms % 1000) AS code
       FROM (SELECT *, greatest(0, CAST(round((start * 60 - 1) * 1000) AS BIGINT)) AS ms FROM turns)""",
)
def _(t):
    return t.turns.select(
        "meeting_id",
        "turn_id",
        tx.timecode_subtitle(F.col("start") * 60 - 1, ".").alias("code"),
    )


def wrapped_sql(text: str) -> str:
    flat = f"array_to_string(list_filter(string_split({text}, ' '), lambda x: x <> ''), ' ')"
    return (
        f"(CASE WHEN len({flat}) <= 42 THEN {flat} ELSE regexp_replace({flat}, "
        f"'(?s)^(.{{1,42}}|[^ ]{{43,}}) (.*)$', E'\\\\1\\n\\\\2') END)"
    )


@query("wrap_lines", f"SELECT meeting_id, turn_id, {wrapped_sql('text')} AS wrapped FROM turns")
def _(t):
    return t.turns.select("meeting_id", "turn_id", tx.wrap_lines(F.col("text")).alias("wrapped"))


@query(
    "display_text",
    f"""SELECT meeting_id, turn_id, {wrapped_sql("speaker_name || ': ' || text")} AS shown FROM named""",
)
def _(t):
    named = roster_names(t.turns, t.speakers)
    return named.select(
        "meeting_id",
        "turn_id",
        tx.display_text(F.col("speaker_name"), F.col("text")).alias("shown"),
    )


@query(
    "plain_line",
    """SELECT meeting_id, turn_id, '[' || format('{:02d}:{:02d}:{:02d}', s // 3600, s % 3600 // 60, s % 60)
         || '] ' || speaker_name || ': ' || text AS line
       FROM (SELECT *, CAST(floor(start) AS BIGINT) AS s FROM named)""",
)
def _(t):
    named = roster_names(t.turns, t.speakers)
    line = tx.plain_line(F.col("start"), F.col("speaker_name"), F.col("text"))
    return named.select("meeting_id", "turn_id", line.alias("line"))


@query(
    "sanitize_name",
    r"""SELECT meeting_id, CASE WHEN n = '' THEN 'Untitled' ELSE n END AS name FROM (
          SELECT meeting_id, trim(array_to_string(list_filter(string_split(substr(raw, 1, 200), ''),
                   lambda c, i: strlen(substr(raw, 1, i)) <= 200), '')) AS n
          FROM (SELECT meeting_id, regexp_replace(trim(translate(regexp_replace(
                  CASE WHEN doc_id % 5 = 0 THEN '..' WHEN doc_id % 5 = 1 THEN 'a/b:' ELSE '' END
                  || CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END,
                  '[\p{Cc}\p{Cf}]', '', 'g'), '/:', '--'), E' \t\n\r'), '^[.\s]+', '') AS raw
                FROM library))""",
)
def _(t):
    lead = F.when(F.col("doc_id") % 5 == 0, "..").when(F.col("doc_id") % 5 == 1, "a/b:").otherwise("")
    body = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text"))
    return t.library.select("meeting_id", tx.sanitize_name(F.concat(lead, body)).alias("name"))


@query(
    "lenient_language",
    f"""SELECT m.meeting_id, coalesce(l.language, '{DEFAULT_LANGUAGE}') AS language FROM (
          SELECT meeting_id, CASE WHEN conv_id % 7 = 0 THEN 'auto' ELSE language END AS raw
          FROM meetings) m LEFT JOIN languages l ON m.raw = l.language""",
)
def _(t):
    raw = t.meetings.withColumn(
        "language", F.when(F.col("conv_id") % 7 == 0, "auto").otherwise(F.col("language"))
    )
    return known_language(raw).select("meeting_id", "language")
