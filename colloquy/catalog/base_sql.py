"""SQL for the derived tables of :mod:`colloquy.sources.adapters`."""

from __future__ import annotations

from colloquy.functions.text import TIGHT_CHARACTERS
from colloquy.schema import LANGUAGES, MODELS, REFUSED_PAIRS, SECOND_CHOICE

TIGHT = ", ".join(f"'{c}'" for c in TIGHT_CHARACTERS)


def start_ms(index: str, turn: str = "turn") -> str:
    return f"({index} * 400 + ({index} // 200) * 1700 + {turn} * 100 + ({turn} // 3) * 2000)"


def floored(value: str) -> str:
    return f"CAST(floor({value}) AS BIGINT)"


_LANGUAGE_ROWS = ", ".join(
    f"({i}, '{a}', '{b}', '{c}', '{d}', '{e}')" for i, (a, b, c, d, e) in enumerate(LANGUAGES)
)
_REFUSED = ", ".join(f"('{a}', '{b}')" for a, b in REFUSED_PAIRS)
_MODEL_ROWS = ", ".join(f"('{m}', CAST({r} AS DOUBLE), {d})" for m, r, d in MODELS)
_SECOND = " ".join(f"WHEN '{d}' THEN '{m}'" for d, m in SECOND_CHOICE.items())

BASE = f"""
WITH RECURSIVE languages(ord, language, display_name, code, home_region, default_model) AS (
  VALUES {_LANGUAGE_ROWS}
),
refused(source, target) AS (VALUES {_REFUSED}),
models(model, minutes_per_hour, is_download) AS (VALUES {_MODEL_ROWS}),
choices AS (
  SELECT language, 0 AS choice_pos, default_model AS model FROM languages
  UNION ALL
  SELECT language, 1, CASE default_model {_SECOND} END FROM languages
  WHERE CASE default_model {_SECOND} END IS NOT NULL
),
support AS (
  SELECT m.model, l.language, m.minutes_per_hour, m.is_download,
         m.model = 'whisper-large-v3'
         OR (m.model = 'apple-speech' AND l.default_model = 'apple-speech')
         OR (m.model IN ('kb-whisper-small', 'kb-whisper-large', 'pianissimo-sv')
             AND l.language = 'swedish') AS supported
  FROM models m, languages l
),
spoken AS (
  SELECT *, CAST(coalesce(sum(n_words) OVER (PARTITION BY conv_id ORDER BY turn
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_word
  FROM (SELECT CAST(conv_id AS VARCHAR) AS meeting_id, conv_id, turn, role, spoken,
               CAST(len(spoken) AS BIGINT) AS n_words
        FROM (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS spoken
              FROM conversations))
),
words AS (
  SELECT meeting_id, conv_id, turn, role, pos, word, first_word + pos AS word_idx,
         {start_ms('(first_word + pos)')} / CAST(1000 AS DOUBLE) AS start,
         ({start_ms('(first_word + pos)')} + 350) / CAST(1000 AS DOUBLE) AS "end",
         word = '' OR left(word, 1) IN ({TIGHT}) AS tight,
         right(word, 1) IN ('.', '?', '!') AS stops
  FROM (SELECT *, unnest(spoken) AS word,
               CAST(unnest(range(len(spoken))) AS BIGINT) AS pos FROM spoken)
),
segments AS (
  SELECT meeting_id, conv_id, turn AS seg_idx, role AS speaker_id,
         CASE WHEN role = 'user' THEN 'microphone' ELSE 'systemAudio' END AS side,
         ({start_ms('first_word')} - 400 + (conv_id * 7 + turn * 131) % 600)
           / CAST(1000 AS DOUBLE) AS start,
         ({start_ms('(first_word + n_words - 1)')} + 350 + 400 - (conv_id * 5 + turn * 211) % 600)
           / CAST(1000 AS DOUBLE) AS "end",
         (conv_id * 37 + turn * 11) % 500 AS vec_id
  FROM spoken
  WHERE n_words > 0 AND conv_id % 13 <> 0 AND (conv_id + turn) % 11 <> 0
),
turns AS (
  SELECT s.meeting_id, s.conv_id, s.turn AS turn_idx, s.meeting_id || '-' || s.turn AS turn_id,
         s.role AS speaker_id,
         {start_ms('s.first_word', 's.turn')} / CAST(1000 AS DOUBLE) AS start,
         ({start_ms('(s.first_word + s.n_words - 1)', 's.turn')} + 350)
           / CAST(1000 AS DOUBLE) AS "end",
         w.text, (s.conv_id * 2 + s.turn) % 9 = 0 AS is_edited, s.n_words
  FROM spoken s JOIN (
    SELECT meeting_id, turn,
           string_agg(CASE WHEN pos = 0 OR tight THEN word ELSE ' ' || word END, '' ORDER BY pos)
             AS text
    FROM words GROUP BY ALL) w ON s.meeting_id = w.meeting_id AND s.turn = w.turn
),
timed_words AS (
  SELECT w.*, t.turn_id FROM words w
  JOIN turns t ON w.meeting_id = t.meeting_id AND w.turn = t.turn_idx
  WHERE NOT t.is_edited
),
meetings AS (
  SELECT meeting_id, conv_id, 1 AS schema_version, 'Meeting ' || conv_id AS title,
         '/audio/' || (conv_id * 2 // 3) || '.m4a' AS audio_path,
         ms / CAST(1000 AS DOUBLE) AS duration,
         make_timestamp((1704067200 + conv_id * 3607) * 1000000) AS imported_at,
         (SELECT language FROM languages WHERE ord = conv_id % 10) AS language,
         CASE WHEN conv_id % 13 = 0 THEN 'diarization' END AS degraded,
         CASE WHEN conv_id % 3 = 0 THEN (ms // 4) / CAST(1000 AS DOUBLE) END AS kept_start,
         CASE WHEN conv_id % 3 = 0 THEN (ms * 3 // 4) / CAST(1000 AS DOUBLE) END AS kept_end,
         CASE WHEN conv_id % 5 = 0 THEN true END AS fast,
         CASE WHEN conv_id % 4 <> 0 THEN 'whisper-large-v3' END AS model,
         CASE WHEN conv_id % 2 = 0
              THEN (SELECT language FROM languages WHERE ord = (conv_id + 3) % 10) END AS target
  FROM (SELECT meeting_id, conv_id,
               max({start_ms('(first_word + n_words - 1)')} + 350) + 1000 AS ms
        FROM spoken GROUP BY ALL)
),
speakers AS (
  SELECT *, CASE WHEN roster_pos = 0 THEN 'Anna & Co' ELSE 'Speaker ' || (roster_pos + 1) END AS name,
         roster_pos = 0 AS is_named,
         CASE WHEN conv_id % 4 <> 0 THEN CASE WHEN speaker_id = 'user' THEN 'microphone'
              ELSE 'systemAudio' END END AS side,
         (conv_id * 3 + roster_pos) % 500 AS vec_id
  FROM (SELECT meeting_id, conv_id, speaker_id, round(sum("end" - start), 3) AS total_duration,
               CASE speaker_id WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS roster_pos
        FROM turns GROUP BY ALL)
  WHERE roster_pos < 2 OR conv_id % 5 <> 0
),
translations AS (
  SELECT t.meeting_id, m.target, t.turn_id,
         replace(replace(t.text, 'e', ''), 'n', 'nn') AS text
  FROM turns t JOIN meetings m ON t.meeting_id = m.meeting_id
  WHERE (t.conv_id * 3 + t.turn_idx) % 4 <> 0 AND m.target IS NOT NULL
),
kept AS (
  SELECT t.* FROM turns t JOIN meetings m ON t.meeting_id = m.meeting_id
  WHERE m.kept_start IS NULL OR (t."end" > m.kept_start AND t.start < m.kept_end)
),
named AS (
  SELECT t.*, coalesce(s.name, t.speaker_id) AS speaker_name
  FROM turns t LEFT JOIN speakers s
    ON t.meeting_id = s.meeting_id AND t.speaker_id = s.speaker_id
),
ticks AS (
  SELECT CAST(user_id AS VARCHAR) AS meeting_id, user_id, event_id, event_type, value, ts,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx
  FROM events
),
sys_frames AS (
  SELECT meeting_id, user_id, idx AS frame, value * value * CAST(1e-6 AS DOUBLE) AS energy
  FROM ticks
),
frames AS (
  SELECT meeting_id, 'systemAudio' AS side, frame, energy, user_id FROM sys_frames
  UNION ALL
  SELECT s.meeting_id, 'microphone', s.frame,
         CASE WHEN s.user_id % 7 = 0
              THEN ((s.frame * 37) % 11 + 1) * ((s.frame * 37) % 11 + 1) * CAST(1e-3 AS DOUBLE)
              WHEN s.frame % 9 = 0 AND s.user_id % 5 <> 0 THEN CAST(0.01 AS DOUBLE)
              ELSE greatest(CAST(1e-8 AS DOUBLE), coalesce(h.energy, 0) * CAST(5e-5 AS DOUBLE)) END,
         s.user_id
  FROM sys_frames s LEFT JOIN sys_frames h
    ON s.meeting_id = h.meeting_id AND h.frame + h.user_id % 3 = s.frame
),
samples AS (
  SELECT meeting_id, user_id, idx, 0 AS channel,
         value * (CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) * CAST(1e-3 AS DOUBLE) AS value
  FROM ticks
  UNION ALL
  SELECT meeting_id, user_id, idx, 1,
         CASE WHEN user_id % 4 = 0 THEN CAST(0 AS DOUBLE)
              ELSE value * (event_id % 7 - 3) * CAST(1e-3 AS DOUBLE) END
  FROM ticks
),
observations AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS embedding,
         CAST(1 + vec_id % 7 AS DOUBLE) AS duration
  FROM embeddings
),
profiles AS (
  SELECT label AS profile_pos, 'p' || label AS profile_id, 'Person ' || label AS name, embedding,
         CAST(1 + label % 4 AS BIGINT) AS sample_count,
         make_timestamp((1704067200 + CAST(label AS BIGINT) * 86400) * 1000000) AS updated_at,
         CASE WHEN label % 3 = 0 THEN 'note ' || label END AS note
  FROM observations
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1
),
library AS (
  SELECT CAST(doc_id AS VARCHAR) AS meeting_id, doc_id, substr(text, 1, 40) AS title,
         source, lang, source || '/' || lang AS folder, text,
         make_timestamp((1704067200 + (doc_id * 7919) % 1000003) * 1000000) AS imported_at,
         CAST(n_chars AS BIGINT) AS bytes
  FROM documents
)"""
