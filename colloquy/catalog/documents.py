"""Queries: translations, cues, rendered documents, imports and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog.registry import DIGITS, query
from colloquy.catalog.text import wrapped_sql
from colloquy.functions import text as tx
from colloquy.operators import render, translate
from colloquy.operators.trims import kept_turns
from colloquy.schema import languages
from colloquy.session import new_path
from colloquy.sources import documents as docs

# -- translations --------------------------------------------------------------

OPEN = """
open_turns AS (
  SELECT k.meeting_id, k.turn_id, k.text, m.language, m.target FROM kept k
  JOIN meetings m ON k.meeting_id = m.meeting_id
  WHERE m.target IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM translations x WHERE x.turn_id = k.turn_id)
)"""


@query("untranslated_turns", "SELECT meeting_id, turn_id, target FROM open_turns", OPEN)
def _(t):
    return translate.untranslated_turns(t.turns, t.meetings, t.translations).select(
        "meeting_id", "turn_id", "target"
    )


@query("except_translated", "SELECT count(*) AS open_lines, target FROM open_turns GROUP BY 2", OPEN)
def _(t):
    missing = translate.untranslated_turns(t.turns, t.meetings, t.translations)
    return missing.groupBy("target").agg(F.count("*").alias("open_lines"))


@query(
    "untranslated_count",
    "SELECT meeting_id, count(*) AS untranslated FROM open_turns GROUP BY 1",
    OPEN,
)
def _(t):
    return translate.untranslated_count(t.turns, t.meetings, t.translations)


@query(
    "render_text_choice",
    """SELECT t.meeting_id, t.turn_id, coalesce(x.text, t.text) AS shown_text FROM turns t
       LEFT JOIN translations x ON x.turn_id = t.turn_id""",
)
def _(t):
    return translate.text_for_rendering(t.turns, t.translations).select(
        "meeting_id", "turn_id", "shown_text"
    )


@query(
    "translation_pairs",
    """SELECT m.meeting_id, m.language, l.language AS target, CAST(l.ord AS INTEGER) AS target_ord,
              NOT EXISTS (SELECT 1 FROM refused r WHERE r.source = m.language AND r.target = l.language)
              AS available
       FROM meetings m JOIN languages l ON l.language <> m.language""",
)
def _(t):
    return translate.translation_targets(t.meetings).select(
        "meeting_id", "language", "target", "target_ord", "available"
    )


@query(
    "apply_lines",
    """SELECT meeting_id, turn_id, text FROM translations x WHERE NOT EXISTS (
         SELECT 1 FROM fresh f WHERE f.turn_id = x.turn_id AND f.target = x.target)
       UNION ALL
       SELECT f.meeting_id, f.turn_id, max_by(f.text, f.seq) FROM fresh f
       JOIN meetings m ON f.meeting_id = m.meeting_id AND f.target = m.target GROUP BY 1, 2""",
    """
fresh AS (
  SELECT t.meeting_id, t.turn_id, k AS seq, 'line ' || k || ' ' || t.turn_id AS text,
         CASE WHEN t.turn_idx % 5 = 0 THEN 'klingon' ELSE m.target END AS target
  FROM turns t JOIN meetings m ON t.meeting_id = m.meeting_id, range(2) r(k)
  WHERE (t.conv_id + t.turn_idx) % 3 = 0
)""",
)
def _(t):
    target = F.when(F.col("turn_idx") % 5 == 0, "klingon").otherwise(F.col("target"))
    fresh = (
        t.turns.where((F.col("conv_id") + F.col("turn_idx")) % 3 == 0)
        .join(t.meetings.select("meeting_id", "target"), "meeting_id")
        .withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1))))
        .select(
            "meeting_id",
            target.alias("target"),
            "turn_id",
            F.concat(F.lit("line "), F.col("seq").cast("string"), F.lit(" "), "turn_id").alias("text"),
            "seq",
        )
    )
    return translate.apply_lines(t.translations, fresh, t.meetings).select(
        "meeting_id", "turn_id", "text"
    )


def shout(source, target, texts):
    """A stand-in for a translator: names the direction, leaves out every text with a q."""
    return texts.where(~texts.str.contains("q"), "").map(
        lambda s: f"{source}>{target}: {s}" if s else ""
    )


@query(
    "translate_with",
    """SELECT o.meeting_id, o.turn_id, o.target, o.language || '>' || o.target || ': ' || o.text AS text
       FROM open_turns o WHERE NOT contains(o.text, 'q') AND NOT EXISTS (
         SELECT 1 FROM refused r WHERE r.source = o.language AND r.target = o.target)""",
    OPEN,
)
def _(t):
    missing = translate.untranslated_turns(t.turns, t.meetings, t.translations)
    return translate.translate_with(missing, shout).select(
        "meeting_id", "turn_id", "target", "text"
    )


# -- cues ------------------------------------------------------------------------


def cues_sql(room: bool) -> str:
    """Cues of the kept turns by walking the words one at a time."""
    budget = "84 - len(speaker_name) - 2" if room else "84"
    return f"""
walk_words AS (
  SELECT w.meeting_id, w.turn_id, w.turn, w.pos, w.word, w.tight, w.start, w."end", n.speaker_name
  FROM timed_words w JOIN named n ON w.turn_id = n.turn_id
  WHERE w.turn_id IN (SELECT turn_id FROM kept)
),
walked AS (
  SELECT turn_id, pos, CAST(0 AS BIGINT) AS cue, start AS since, CAST(len(word) AS BIGINT) AS chars
  FROM walk_words WHERE pos = 0
  UNION ALL
  SELECT turn_id, pos, CASE WHEN breaks THEN cue + 1 ELSE cue END,
         CASE WHEN breaks THEN start ELSE since END,
         CAST(CASE WHEN breaks THEN len(word) ELSE grown END AS BIGINT)
  FROM (SELECT w.*, p.cue, p.since, p.chars + len(w.word) + CASE WHEN w.tight THEN 0 ELSE 1 END AS grown,
               p.chars + len(w.word) + CASE WHEN w.tight THEN 0 ELSE 1 END
                 > CASE WHEN p.cue = 0 THEN {budget} ELSE 84 END
               OR w."end" - p.since > 6 AS breaks
        FROM walked p JOIN walk_words w ON w.turn_id = p.turn_id AND w.pos = p.pos + 1)
),
cue_text AS (
  SELECT w.meeting_id, w.turn AS turn_idx, w.turn_id, c.cue AS cue_idx, min_by(w.start, w.pos) AS start,
         max_by(w."end", w.pos) AS last, any_value(w.speaker_name) AS speaker_name,
         string_agg(CASE WHEN w.tight THEN '' ELSE ' ' END || w.word, '' ORDER BY w.pos) AS raw
  FROM walk_words w JOIN walked c ON w.turn_id = c.turn_id AND w.pos = c.pos GROUP BY ALL
),
cues AS (
  SELECT meeting_id, turn_idx, turn_id, cue_idx, start,
         greatest(last, start + CAST(0.05 AS DOUBLE)) AS "end",
         CASE WHEN cue_idx = 0 THEN speaker_name END AS speaker,
         CASE WHEN left(raw, 1) = ' ' THEN substr(raw, 2) ELSE raw END AS text
  FROM cue_text
  UNION ALL
  SELECT n.meeting_id, n.turn_idx, n.turn_id, 0, n.start,
         greatest(n."end", n.start + CAST(0.05 AS DOUBLE)), n.speaker_name, n.text
  FROM named n JOIN kept k ON k.turn_id = n.turn_id WHERE n.is_edited
)"""


SPREAD = """,
shares AS (
  SELECT *, count(*) OVER (PARTITION BY turn_id) AS n,
         sum(len(text)) OVER (PARTITION BY turn_id ORDER BY cue_idx) AS upto,
         sum(len(text)) OVER (PARTITION BY turn_id) AS whole
  FROM cues
),
lines AS (
  SELECT turn_id, text, list_filter(string_split(text, ' '), lambda x: x <> '') AS parts FROM translations
),
line_words AS (
  SELECT turn_id, word, j, coalesce(sum(len(word) + 1) OVER (PARTITION BY turn_id ORDER BY j
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS consumed,
         sum(len(word) + 1) OVER (PARTITION BY turn_id) AS total
  FROM (SELECT turn_id, unnest(parts) AS word, unnest(range(len(parts))) AS j FROM lines)
),
word_cue AS (
  SELECT w.turn_id, w.j, any_value(w.word) AS word,
         count(*) FILTER (s.cue_idx < s.n - 1
           AND CAST(s.upto AS DOUBLE) / s.whole * w.total <= w.consumed) AS cue_idx
  FROM line_words w JOIN shares s ON w.turn_id = s.turn_id GROUP BY w.turn_id, w.j
),
filled AS (
  SELECT turn_id, cue_idx, string_agg(word, ' ' ORDER BY j) AS text,
         coalesce(lag(cue_idx) OVER (PARTITION BY turn_id ORDER BY cue_idx) + 1, 0) AS opens,
         row_number() OVER (PARTITION BY turn_id ORDER BY cue_idx DESC) = 1 AS is_last
  FROM word_cue GROUP BY turn_id, cue_idx
),
spread AS (
  SELECT c.meeting_id, c.turn_idx, f.turn_id, f.cue_idx, o.start,
         CASE WHEN f.is_last THEN z."end" ELSE c."end" END AS "end", o.speaker, f.text
  FROM filled f JOIN shares c ON c.turn_id = f.turn_id AND c.cue_idx = f.cue_idx
  JOIN shares o ON o.turn_id = f.turn_id AND o.cue_idx = f.opens
  JOIN shares z ON z.turn_id = f.turn_id AND z.cue_idx = z.n - 1
  UNION ALL
  SELECT meeting_id, turn_idx, turn_id, cue_idx, start, "end", speaker, text FROM cues
  WHERE turn_id NOT IN (SELECT turn_id FROM lines)
)"""


def kept(t):
    return kept_turns(t.turns, t.meetings)


def cue_table(t, translated: bool, room: bool):
    lines = t.translations if translated else None
    return render.cue_rows(render.turn_cues(kept(t), t.speakers, lines, room))


@query(
    "cues",
    'SELECT meeting_id, turn_id, cue_idx, start, "end", speaker, text FROM cues',
    cues_sql(False),
)
def _(t):
    return cue_table(t, False, False).select(
        "meeting_id", "turn_id", "cue_idx", "start", "end", "speaker", "text"
    )


@query(
    "numbered_cues",
    """SELECT meeting_id, turn_id, cue_idx, row_number() OVER (PARTITION BY meeting_id
         ORDER BY turn_idx, cue_idx) AS number, text FROM cues""",
    cues_sql(True),
)
def _(t):
    return cue_table(t, False, True).select("meeting_id", "turn_id", "cue_idx", "number", "text")


@query(
    "redistribute_translation",
    """SELECT meeting_id, turn_id, start, "end", speaker, text,
              row_number() OVER (PARTITION BY turn_id ORDER BY cue_idx) - 1 AS cue_idx FROM spread""",
    cues_sql(False) + SPREAD,
)
def _(t):
    return cue_table(t, True, False).select(
        "meeting_id", "turn_id", "start", "end", "speaker", "text", "cue_idx"
    )


def clock_sql(column: str, separator: str) -> str:
    ms = f"CAST(round({column} * 1000) AS BIGINT)"
    return (
        f"format('{{:02d}}:{{:02d}}:{{:02d}}{separator}{{:03d}}', {ms} // 3600000, "
        f"{ms} % 3600000 // 60000, {ms} % 60000 // 1000, {ms} % 1000)"
    )


def escaped(text: str) -> str:
    return f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def vtt_sql(source: str) -> str:
    return f"""SELECT m.meeting_id, E'WEBVTT\\n' || coalesce(string_agg(
         E'\\n' || number || E'\\n' || {clock_sql('c.start', '.')} || ' --> ' || {clock_sql('c."end"', '.')}
         || E'\\n' || CASE WHEN speaker IS NULL THEN '' ELSE '<v ' || {escaped('speaker')} || '>' END
         || {escaped(wrapped_sql('c.text'))} || E'\\n', '' ORDER BY number), '') AS text
       FROM meetings m LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY meeting_id
         ORDER BY turn_idx, cue_idx) AS number FROM {source}) c ON m.meeting_id = c.meeting_id
       GROUP BY m.meeting_id"""


@query("render_vtt", vtt_sql("cues"), cues_sql(False))
def _(t):
    return render.documents(render.vtt_blocks(cue_table(t, False, False), t.meetings))


@query("render_vtt_translated", vtt_sql("spread"), cues_sql(False) + SPREAD)
def _(t):
    return render.documents(render.vtt_blocks(cue_table(t, True, False), t.meetings))


SRT = f"""SELECT meeting_id, string_agg(
         CASE WHEN number > 1 THEN E'\\n' ELSE '' END || number || E'\\n' || {clock_sql('start', ',')}
         || ' --> ' || {clock_sql('"end"', ',')} || E'\\n' || {wrapped_sql(
             "(CASE WHEN speaker IS NULL THEN text ELSE speaker || ': ' || text END)")}
         || E'\\n', '' ORDER BY number) AS text
       FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY turn_idx, cue_idx) AS number
             FROM cues) GROUP BY meeting_id"""


@query("render_srt", SRT, cues_sql(True))
def _(t):
    return render.documents(render.srt_blocks(cue_table(t, False, True)))


def short_sql(column: str) -> str:
    s = f"CAST(floor({column}) AS BIGINT)"
    return (
        f"CASE WHEN {s} >= 3600 THEN format('{{}}:{{:02d}}:{{:02d}}', {s} // 3600, {s} % 3600 // 60, "
        f"{s} % 60) ELSE format('{{}}:{{:02d}}', {s} // 60, {s} % 60) END"
    )


def markdown_sql(translated: bool) -> str:
    shown = "coalesce(x.text, n.text)" if translated else "n.text"
    note = (
        """CASE WHEN target IS NULL THEN '' ELSE E'\\n*Translated from ' || display_name || ' to '
           || (SELECT display_name FROM languages t WHERE t.language = target)
           || ' on device. The recording is in ' || display_name || E'.*\\n'
           || CASE WHEN missing > 0 THEN E'\\n*' || missing || CASE WHEN missing = 1 THEN ' line has'
              ELSE ' lines have' END || ' no translation and ' || CASE WHEN missing = 1 THEN 'is'
              ELSE 'are' END || ' shown in ' || display_name || E'.*\\n' ELSE '' END END"""
        if translated
        else "''"
    )
    return f"""SELECT m.meeting_id,
         '# ' || title || E'\\n\\n*' || {short_sql('duration')} || ' · transcribed '
         || strftime(imported_at, '%Y-%m-%d %H:%M') || E'*\\n'
         || CASE WHEN kept_start IS NULL THEN '' ELSE E'\\n*Trimmed to ' || {short_sql('kept_start')}
            || '–' || {short_sql('kept_end')} || E'; the rest of the recording is not included.*\\n' END
         || CASE WHEN degraded IS NULL THEN '' ELSE E'\\n> Speaker identification did not produce a '
            || 'result for this recording, so every line is attributed to a single unknown speaker.'
            || E'\\n' END || {note} || E'\\n' || coalesce(body, '') AS text
       FROM (SELECT m.*, l.display_name, (SELECT count(*) FROM open_turns o
               WHERE o.meeting_id = m.meeting_id) AS missing
             FROM meetings m JOIN languages l ON l.language = m.language) m
       LEFT JOIN (
         SELECT n.meeting_id, string_agg('**[' || format('{{:02d}}:{{:02d}}:{{:02d}}', s // 3600,
             s % 3600 // 60, s % 60) || '] ' || n.speaker_name || ':** ' || {shown} || E'\\n\\n', ''
             ORDER BY n.turn_idx) AS body
         FROM (SELECT *, CAST(floor(start) AS BIGINT) AS s FROM named) n
         JOIN kept k ON k.turn_id = n.turn_id LEFT JOIN translations x ON x.turn_id = n.turn_id
         GROUP BY 1) b ON b.meeting_id = m.meeting_id"""


@query("render_markdown", markdown_sql(False), OPEN)
def _(t):
    return render.documents(render.markdown_blocks(t.turns, t.meetings, t.speakers))


@query("render_markdown_translated", markdown_sql(True), OPEN)
def _(t):
    blocks = render.markdown_blocks(t.turns, t.meetings, t.speakers, t.translations)
    return render.documents(blocks)


@query(
    "gap_filled_track",
    """SELECT meeting_id, round(clock, 6) AS "from", round(f, 6) AS "to", '' AS text FROM seen WHERE f > clock
       UNION ALL
       SELECT meeting_id, round(f, 6), round(u, 6), text FROM seen
       UNION ALL
       SELECT m.meeting_id, round(coalesce(e.u, 0), 6), round(m.duration - 5, 6), ''
       FROM meetings m LEFT JOIN (SELECT meeting_id, max_by(u, number) AS u FROM placed GROUP BY 1) e
         ON e.meeting_id = m.meeting_id WHERE coalesce(e.u, 0) < m.duration - 5""",
    cues_sql(True)
    + f""",
placed AS (
  SELECT * FROM (
    SELECT c.meeting_id, c.number, greatest(0, c.start - 3) AS f, least(m.duration - 5, c."end" - 3) AS u,
           {wrapped_sql("(CASE WHEN c.speaker IS NULL THEN c.text ELSE c.speaker || ': ' || c.text END)")}
             AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY turn_idx, cue_idx) AS number
          FROM cues) c JOIN meetings m ON m.meeting_id = c.meeting_id) WHERE u > f
),
seen AS (
  SELECT *, coalesce(lag(u) OVER (PARTITION BY meeting_id ORDER BY number), 0) AS clock FROM placed
)""",
)
def _(t):
    clock = t.meetings.select(
        "meeting_id", F.lit(3.0).alias("shift"), (F.col("duration") - 5).alias("length")
    )
    track = render.gap_filled_track(cue_table(t, False, True), clock, "shift", "length")
    return track.select(
        "meeting_id",
        F.round("from", DIGITS).alias("from"),
        F.round("to", DIGITS).alias("to"),
        "text",
    )


@query(
    "row_generators",
    """SELECT c.meeting_id, c.turn_id, c.n_cues, coalesce(f.n_matches, 0) AS n_matches FROM (
         SELECT meeting_id, turn_id, count(*) AS n_cues FROM cues GROUP BY ALL) c
       LEFT JOIN (SELECT turn_id, CAST(len(list_filter(range(len(text)), lambda i:
                    substr(strip_accents(lower(text)), i + 1, 2) = 'en')) AS BIGINT) AS n_matches
                  FROM turns) f ON f.turn_id = c.turn_id""",
    cues_sql(False),
)
def _(t):
    cut = render.turn_cues(kept(t), t.speakers)
    texts = t.turns.select("turn_id", "text")
    return cut.join(texts, "turn_id").select(
        "meeting_id",
        "turn_id",
        F.size("cues").cast("long").alias("n_cues"),
        F.size(tx.match_offsets(F.col("text"), "en")).cast("long").alias("n_matches"),
    )


@query(
    "column_library",
    f"""SELECT turn_id, len(text) AS n_chars, strip_accents(lower(text)) AS folded,
              {wrapped_sql("text")} AS wrapped FROM turns""",
)
def _(t):
    return t.turns.select(
        "turn_id",
        F.length(tx.joined_text(tx.text_words(F.col("text")))).cast("long").alias("n_chars"),
        tx.fold(F.col("text")).alias("folded"),
        tx.wrap_lines(F.col("text")).alias("wrapped"),
    )


# -- exports and imports ------------------------------------------------------------


def opt(key: str, value: str, before: str = ",") -> str:
    return f"coalesce('{before}\"{key}\":' || {value}, '')"


JSON_SQL = f"""SELECT m.meeting_id,
    '{{' || {opt('degraded', 'to_json(m.degraded)::VARCHAR', '')}
    || CASE WHEN m.degraded IS NULL THEN '' ELSE ',' END
    || '"duration":' || m.duration || {opt('fastTranscribed', "CASE WHEN m.fast THEN 'true' END")}
    || ',"importedAt":"' || strftime(m.imported_at, '%Y-%m-%dT%H:%M:%SZ') || '","language":"' || m.language
    || '"' || {opt('model', 'to_json(m.model)::VARCHAR')}
    || ',"speakers":[' || coalesce(r.speakers, '') || '],"title":' || to_json(m.title)::VARCHAR
    || ',"transcript":[' || coalesce(b.body, '') || ']'
    || CASE WHEN m.target IS NULL THEN '' ELSE ',"translation":{{"from":"' || m.language || '","to":"'
       || m.target || '","translatedAt":"' || strftime(m.imported_at, '%Y-%m-%dT%H:%M:%SZ') || '"}}' END
    || CASE WHEN m.kept_start IS NULL THEN '' ELSE ',"trimmedTo":{{"end":' || m.kept_end || ',"start":'
       || m.kept_start || '}}' END || '}}' AS text
  FROM meetings m
  LEFT JOIN (SELECT meeting_id, string_agg('{{"id":"' || speaker_id || '","name":' || to_json(name)::VARCHAR
               || ',"named":' || is_named::VARCHAR || {opt('side', "to_json(side)::VARCHAR")}
               || ',"totalDuration":' || total_duration || '}}', ',' ORDER BY roster_pos) AS speakers
             FROM speakers GROUP BY 1) r ON r.meeting_id = m.meeting_id
  LEFT JOIN (SELECT n.meeting_id, string_agg('{{"end":' || n."end" || ',"isEdited":' || n.is_edited::VARCHAR
               || ',"speaker":' || to_json(n.speaker_name)::VARCHAR || ',"speakerId":"' || n.speaker_id
               || '","start":' || n.start || ',"text":' || to_json(n.text)::VARCHAR
               || {opt('translatedText', 'to_json(x.text)::VARCHAR')} || coalesce(',"words":[' || w.words || ']', '')
               || '}}', ',' ORDER BY n.turn_idx) AS body
             FROM named n JOIN kept k ON k.turn_id = n.turn_id
             LEFT JOIN translations x ON x.turn_id = n.turn_id
             LEFT JOIN (SELECT turn_id, string_agg('{{"end":' || "end" || ',"start":' || start || ',"word":'
                          || to_json(word)::VARCHAR || '}}', ',' ORDER BY pos) AS words
                        FROM timed_words GROUP BY 1) w ON w.turn_id = n.turn_id
             GROUP BY 1) b ON b.meeting_id = m.meeting_id"""


def exported(t):
    return render.documents(docs.json_blocks(t.turns, t.meetings, t.speakers, t.translations))


@query("sink_json_export", JSON_SQL)
def _(t):
    return exported(t)


@query(
    "sink_text_export",
    f"""SELECT d.meeting_id, stem || CASE WHEN n > 1 THEN ' ' || n ELSE '' END || '.vtt' AS file_name, text
       FROM ({vtt_sql("spread")}) d JOIN (
         SELECT m.meeting_id, m.title || coalesce(' (' || l.display_name || ')', '') AS stem,
                row_number() OVER (PARTITION BY lower(m.title || coalesce(' (' || l.display_name || ')', ''))
                                   ORDER BY imported_at, m.meeting_id) AS n
         FROM meetings m LEFT JOIN languages l ON l.language = m.target) s ON s.meeting_id = d.meeting_id""",
    cues_sql(False) + SPREAD,
)
def _(t):
    path = new_path(t.spark, "text-export")
    blocks = render.vtt_blocks(cue_table(t, True, False), t.meetings)
    written = docs.write_documents(blocks, docs.document_names(t.meetings, "vtt", True), path)
    found = t.spark.read.text(path, wholetext=True).select(
        F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("file_name"), F.col("value").alias("text")
    )
    return written.select("meeting_id", "file_name").join(found, "file_name")


def as_files(t):
    """Exports of all meetings as files."""
    return exported(t).select(F.col("meeting_id").alias("source"), F.col("text").alias("content"))


@query(
    "import_export_json",
    """SELECT n.meeting_id, row_number() OVER (PARTITION BY n.meeting_id ORDER BY n.turn_idx) - 1 AS turn_idx,
              n.speaker_id, n.start, n."end", n.text, n.is_edited, x.text AS translated_text,
              CASE WHEN NOT n.is_edited THEN n.n_words END AS n_words
       FROM named n JOIN kept k ON k.turn_id = n.turn_id LEFT JOIN translations x ON x.turn_id = n.turn_id""",
)
def _(t):
    return docs.export_turns(docs.route_import(as_files(t))).select(
        "meeting_id",
        "turn_idx",
        "speaker_id",
        "start",
        "end",
        "text",
        "is_edited",
        "translated_text",
        F.size("words").cast("long").alias("n_words"),
    )


SPAN_ROWS = """
raw AS (
  SELECT meeting_id, turn_idx AS pos, CASE WHEN turn_idx % 4 = 1 THEN "end" ELSE start END AS a,
         CASE WHEN turn_idx % 4 = 1 THEN start ELSE "end" END AS b,
         CASE WHEN turn_idx % 5 = 2 THEN ' ' ELSE speaker_id || ' ' END AS speaker,
         CASE WHEN turn_idx % 6 = 3 OR conv_id % 8 = 0 THEN '  ' ELSE ' ' || text || ' ' END AS text
  FROM turns
),
usable AS (
  SELECT meeting_id, pos, least(a, b) AS start, greatest(a, b) AS "end",
         CASE WHEN trim(speaker) = '' THEN 'unknown' ELSE trim(speaker) END AS speaker_id, trim(text) AS text
  FROM raw WHERE trim(text) <> ''
)"""


def span_files(t):
    """Foreign span files with the faults such files have, one per meeting."""
    turn = F.col("turn_idx")
    odd = turn % 4 == 1
    span = F.struct(
        F.when((turn % 6 == 3) | (F.col("conv_id") % 8 == 0), "  ")
        .otherwise(F.concat(F.lit(" "), "text", F.lit(" ")))
        .alias("text"),
        F.when(odd, F.col("end")).otherwise(F.col("start")).alias("start"),
        F.when(odd, F.col("start")).otherwise(F.col("end")).alias("end"),
        F.when(turn % 5 == 2, " ").otherwise(F.concat("speaker_id", F.lit(" "))).alias("speaker"),
    )
    return (
        t.turns.groupBy("meeting_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn_idx", span.alias("s")))).alias("_s"))
        .select(
            F.col("meeting_id").alias("source"),
            F.to_json(F.struct(F.transform("_s", lambda x: x["s"]).alias("texts"))).alias("content"),
        )
    )


@query(
    "import_span_json",
    """SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY start, pos) - 1 AS span_idx,
              speaker_id, start, "end", text FROM usable""",
    SPAN_ROWS,
)
def _(t):
    return docs.span_turns(docs.route_import(span_files(t)))


@query(
    "route_import_format",
    """SELECT 'e' || meeting_id AS source, CASE WHEN EXISTS (SELECT 1 FROM kept k
              WHERE k.meeting_id = m.meeting_id) THEN 'export' END AS kind,
              CASE WHEN NOT EXISTS (SELECT 1 FROM kept k WHERE k.meeting_id = m.meeting_id)
              THEN 'noSpeech' END AS reason FROM meetings m
       UNION ALL
       SELECT 's' || meeting_id, CASE WHEN EXISTS (SELECT 1 FROM usable u WHERE u.meeting_id = m.meeting_id)
              THEN 'spans' END, CASE WHEN NOT EXISTS (SELECT 1 FROM usable u
              WHERE u.meeting_id = m.meeting_id) THEN 'noSpeech' END FROM meetings m
       UNION ALL
       SELECT 'd' || doc_id, NULL, CASE WHEN doc_id % 4 = 0 THEN 'unreadable' ELSE 'unrecognizedFormat' END
       FROM documents""",
    SPAN_ROWS,
)
def _(t):
    other = t.read("documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source"),
        F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("content"),
    )
    files = (
        as_files(t)
        .withColumn("source", F.concat(F.lit("e"), "source"))
        .unionByName(span_files(t).withColumn("source", F.concat(F.lit("s"), "source")))
        .unionByName(other)
    )
    return docs.route_import(files).select("source", "kind", "reason")
