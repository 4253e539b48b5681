"""Queries: streams over the events, run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog.documents import OPEN, shout
from colloquy.catalog.registry import DIGITS, query
from colloquy.catalog.voices import PLACES, _numbers
from colloquy.schema import MICROPHONE, SYSTEM_AUDIO
from colloquy.session import new_path
from colloquy.sources.files import put_files, remove_files
from colloquy.streaming import live, runs


#: Ticks that may be missing in a stream whose files hold them in any order.
ANY_ORDER = 1 << 40


def stream(t, table: str):
    schema = t.read(table).schema
    # A pattern finds the table as one file and as a folder of files.
    rows = (
        t.spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 64)
        .parquet(f"{t.folder}/[{table[0]}]{table[1:]}.parquet")
    )
    # A watermark needs a timestamp with a time zone.
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def as_stream(t, df, name: str, batches: int = 3):
    """A derived table as a stream of a few batches, each of so many files that all cores write them."""
    path = new_path(t.spark, name)
    files = -(-t.spark.sparkContext.defaultParallelism // batches)
    df.repartition(batches * files).write.parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def channel_events(t):
    """Even events are microphone frames, odd ones system frames; some never come."""
    event = F.col("event_id")
    frame = F.floor(event / 2).cast("long")
    side = F.when(event % 2 == 0, MICROPHONE).otherwise(SYSTEM_AUDIO)
    lost = ((event % 2 == 1) & (frame % 10 == 3)) | ((event % 2 == 0) & (frame % 10 == 7))
    return (
        stream(t, "events")
        .where(~lost)
        .select(
            (frame % 50).cast("string").alias("recording_id"), side.alias("side"), frame.alias("frame"),
            "ts", "value",
        )
    )


CHANNELS = """
channel AS (
  SELECT CAST(event_id // 2 % 50 AS VARCHAR) AS recording_id, event_id // 2 AS frame, ts, value,
         CASE WHEN event_id % 2 = 0 THEN 'microphone' ELSE 'systemAudio' END AS side FROM events
  WHERE NOT ((event_id % 2 = 1 AND event_id // 2 % 10 = 3) OR (event_id % 2 = 0 AND event_id // 2 % 10 = 7))
)"""


@query(
    "stream_align_sides",
    """SELECT m.recording_id, m.frame, m.value AS microphone, s.value AS system FROM channel m
       JOIN channel s ON m.frame = s.frame AND m.side = 'microphone' AND s.side = 'systemAudio'
        AND s.ts BETWEEN m.ts - INTERVAL 1 HOUR AND m.ts + INTERVAL 1 HOUR""",
    CHANNELS,
)
def _(t):
    mic = channel_events(t).where(F.col("side") == MICROPHONE)
    sys = channel_events(t).where(F.col("side") == SYSTEM_AUDIO)
    joined = live.align_sides(mic, sys, "60 days", "1 hour")
    return runs.run_to_table(joined, "append", "aligned-sides").drop("batch")


@query(
    "stream_align_sides_padded",
    """SELECT recording_id, frame, coalesce(max(value) FILTER (side = 'microphone'), 0) AS microphone,
              coalesce(max(value) FILTER (side = 'systemAudio'), 0) AS system
       FROM channel GROUP BY ALL""",
    CHANNELS,
)
def _(t):
    # Frames of a second stand for those of 20 milliseconds.
    framed = channel_events(t).withColumn("started", F.timestamp_seconds(F.lit(1_704_067_200)))
    padded = live.align_sides_padded(framed, 1.0, "1 minute", "60 days")
    rows = runs.run_to_table(padded, "update", "padded-sides")
    return rows.groupBy("recording_id", "frame").agg(
        F.max_by("microphone", "batch").alias("microphone"), F.max_by("system", "batch").alias("system")
    )


@query(
    "stream_peak_meter",
    """SELECT recording_id, side, time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
              max(abs(value)) AS peak FROM channel GROUP BY ALL""",
    CHANNELS,
)
def _(t):
    meter = live.peak_meter(channel_events(t), "1 hour", "60 days")
    rows = runs.run_to_table(meter, "update", "peaks")
    return rows.groupBy("recording_id", "side", "window_start").agg(F.max("peak").alias("peak"))


@query(
    "stream_sessions",
    """SELECT recording_id, speaker_id, min(ts) AS started, count(*) AS n_words FROM (
         SELECT *, sum(opens) OVER (PARTITION BY recording_id, speaker_id ORDER BY ts, event_id) AS s
         FROM (SELECT CAST(user_id AS VARCHAR) AS recording_id, event_type AS speaker_id, ts, event_id,
                      CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)
                           < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events))
       GROUP BY recording_id, speaker_id, s""",
)
def _(t):
    # Hours stand for the pauses of a second and a half; a far-off row closes the last session.
    spoken = stream(t, "events").select(
        F.col("user_id").cast("string").alias("recording_id"),
        F.col("event_type").alias("speaker_id"),
        "ts",
    )
    sessions = live.live_sessions(spoken, "6 hours", "60 days")
    rows = runs.run_to_table(sessions, "complete", "sessions")
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), "batch").select(
        "recording_id", "speaker_id", "started", "n_words"
    )


@query(
    "stream_turns",
    """SELECT meeting_id AS recording_id, min(word_idx) AS first_word, min(role) AS speaker_id,
              min_by(start, word_idx) AS started, max_by("end", word_idx) AS closed, count(*) AS n_words
       FROM (SELECT *, sum(opens) OVER (PARTITION BY meeting_id ORDER BY word_idx) AS run FROM spoken_words)
       GROUP BY meeting_id, run""",
    """
spoken_words AS (
  SELECT meeting_id, word_idx, role, start, "end",
         CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w <> role
                OR start - lag("end") OVER w > CAST(1.5 AS DOUBLE) THEN 1 ELSE 0 END AS opens
  FROM words WINDOW w AS (PARTITION BY meeting_id ORDER BY word_idx)
)""",
)
def _(t):
    words = t.words.select(
        F.col("meeting_id").alias("recording_id"), "word_idx", F.col("role").alias("speaker_id"), "start", "end",
        F.lit(False).alias("ended"), F.timestamp_micros((F.col("end") * 1_000_000).cast("long")).alias("ts"),
    )
    ends = words.groupBy("recording_id").agg(
        (F.max("word_idx") + 1).alias("word_idx"), F.lit(True).alias("ended"), F.max("ts").alias("ts")
    )
    # Files hold words from everywhere, and ends that come before their words.
    spoken = as_stream(t, words.unionByName(ends, allowMissingColumns=True), "spoken-words")
    return runs.run_to_table(live.live_turns(spoken, delay="60 days"), "append", "turns").drop("batch")


@query(
    "stream_meter_decay",
    """SELECT meeting_id AS recording_id, idx AS tick, round(meter, 6) AS meter FROM metered""",
    """
metered AS (
  SELECT meeting_id, idx, value AS meter FROM ticks WHERE idx = 0
  UNION ALL
  SELECT t.meeting_id, t.idx, greatest(t.value, CAST(0.6 AS DOUBLE) * m.meter)
  FROM metered m JOIN ticks t ON t.meeting_id = m.meeting_id AND t.idx = m.idx + 1
)""",
)
def _(t):
    ticks = t.ticks.select(
        F.col("meeting_id").alias("recording_id"),
        F.col("idx").alias("tick"),
        F.col("value").alias("peak"),
    )
    # Three files, each with ticks from everywhere: most come before their turn.
    meter = live.meter_decay(as_stream(t, ticks, "ticks"), late=ANY_ORDER)
    return runs.run_to_table(meter, "append", "meter").select(
        "recording_id", "tick", F.round("meter", DIGITS).alias("meter")
    )


#: The recordings here are too short for the window that is the default.
BLEED_WINDOW = 40


@query(
    "stream_bleed_watch",
    """SELECT recording_id, min(tick) AS tick
       FROM (SELECT recording_id, end_tick AS tick, list_sort(list(d)) AS d
             FROM heard GROUP BY recording_id, end_tick, lag HAVING count(*) >= 5)
       WHERE d[len(d) // 10 + 1] > -60
         AND len(list_filter(d, lambda x: abs(x - d[len(d) // 10 + 1]) <= 6)) > 0.5 * len(d)
       GROUP BY recording_id""",
    f"""
level AS (
  SELECT meeting_id AS recording_id, frame AS tick,
         row_number() OVER (PARTITION BY meeting_id ORDER BY frame) AS k,
         10 * log10(greatest(max(energy) FILTER (side = 'microphone'), 1e-12)) AS mic,
         10 * log10(greatest(max(energy) FILTER (side = 'systemAudio'), 1e-12)) AS sys
  FROM frames GROUP BY meeting_id, frame
),
ends AS (
  SELECT recording_id, tick AS end_tick, k AS e, max(sys) OVER (PARTITION BY recording_id ORDER BY k
         ROWS BETWEEN {BLEED_WINDOW} - 1 PRECEDING AND CURRENT ROW) AS top
  FROM level
),
heard AS (
  SELECT w.recording_id, end_tick, lag, m.mic - s.sys AS d
  FROM ends w, (SELECT unnest(range(11)) AS lag) l, level s, level m
  WHERE e >= {BLEED_WINDOW} AND top > -110
    AND s.recording_id = w.recording_id AND s.k > e - {BLEED_WINDOW} AND s.k + lag <= e AND s.sys > top - 20
    AND m.recording_id = s.recording_id AND m.k = s.k + lag
)""",
)
def _(t):
    wide = t.frames.groupBy(F.col("meeting_id").alias("recording_id"), F.col("frame").alias("tick")).agg(
        F.max(F.when(F.col("side") == MICROPHONE, F.col("energy"))).alias("microphone"),
        F.max(F.when(F.col("side") == SYSTEM_AUDIO, F.col("energy"))).alias("system"),
    )
    found = live.bleed_watch(as_stream(t, wide, "frame-ticks"), size=BLEED_WINDOW, late=ANY_ORDER)
    return runs.run_to_table(found, "append", "bleed").drop("batch")


@query(
    "stream_silence_alarm",
    """SELECT CAST(user_id AS VARCHAR) AS recording_id, epoch_us(start) + span AS alarm_at
       FROM (SELECT e.user_id, start, 3 * 86400000000 AS span,
                    count(*) FILTER (e.user_id % 2 = 1
                      AND epoch_us(ts) <= epoch_us(start) + 3 * 86400000000) AS heard
             FROM events e JOIN (SELECT user_id, min(ts) AS start FROM events GROUP BY 1) f
               ON e.user_id = f.user_id GROUP BY e.user_id, start)
       WHERE heard = 0
         AND epoch_us(start) + span < (SELECT epoch_us(max(ts)) - 1000000 FROM events)""",
)
def _(t):
    # Days stand for seconds; every second user's system channel is silent.
    ticks = stream(t, "events").select(
        F.col("user_id").cast("string").alias("recording_id"),
        "ts",
        F.when(F.col("user_id") % 2 == 1, F.col("value")).otherwise(0.0).alias("system"),
    )
    alarm = live.silence_alarm(ticks, 3 * 86_400.0, forget=40 * 86_400.0)
    return runs.run_to_table(alarm, "append", "alarms").drop("batch")


@query(
    "stream_enroll",
    "SELECT 'person ' || label AS person, count(*) AS sample_count, "
    + ", ".join(f"round(avg(embedding[{i + 1}]), 6) AS x{i}" for i in PLACES)
    + " FROM observations GROUP BY label",
)
def _(t):
    said = stream(t, "embeddings").select(
        F.concat(F.lit(" Person "), F.col("label").cast("string")).alias("name"),
        F.col("vec_id").alias("obs_id"),
        "embedding",
    )
    rows = runs.run_to_table(live.enrol(said), "update", "voices")
    now = rows.groupBy("person").agg(
        F.max_by(F.struct("sample_count", "embedding"), "batch").alias("v")
    )
    return now.select("person", "v.*").select("person", "sample_count", *_numbers("embedding"))


@query(
    "stream_ingest_library",
    """SELECT meeting_id, title FROM meetings WHERE conv_id // 20 % 3 = 0
       UNION ALL
       SELECT meeting_id, title || ' v2' FROM meetings WHERE conv_id // 20 % 3 = 1 AND conv_id % 2 = 0""",
)
def _(t):
    folder, table = new_path(t.spark, "incoming"), new_path(t.spark, "ingested")

    def put(meetings, version: str) -> None:
        """Files of up to twenty meetings, written anew under the same names."""
        stored = F.struct(
            F.col("meeting_id").alias("id"),
            F.lit(1).alias("schemaVersion"),
            F.concat("title", F.lit(version)).alias("title"),
            "duration",
            "language",
        )
        named = meetings.groupBy(F.floor(F.col("conv_id") / 20).cast("string").alias("name")).agg(
            F.array_join(F.array_sort(F.collect_list(F.to_json(stored))), "\n").alias("text")
        )
        put_files(named.select(F.concat("name", F.lit(".json")).alias("name"), "text"), folder)

    third = F.floor(F.col("conv_id") / 20) % 3
    put(t.meetings, "")
    runs.ingest_library(t.spark, folder, table)
    # A third of the files changes in place and loses half its meetings, a third goes.
    put(t.meetings.where((third == 1) & (F.col("conv_id") % 2 == 0)), " v2")
    gone = t.meetings.where(third == 2).select(
        F.concat(F.floor(F.col("conv_id") / 20).cast("string"), F.lit(".json")).alias("name")
    )
    remove_files(gone.distinct(), folder)
    runs.ingest_library(t.spark, folder, table)
    return runs.current_library(t.spark, table).select("meeting_id", "title")


@query(
    "stream_fill_translations",
    """SELECT meeting_id, turn_id, text FROM translations
       UNION ALL
       SELECT o.meeting_id, o.turn_id, o.language || '>' || o.target || ': ' || o.text
       FROM open_turns o WHERE NOT contains(o.text, 'q') AND NOT EXISTS (
         SELECT 1 FROM refused r WHERE r.source = o.language AND r.target = o.target)""",
    OPEN,
)
def _(t):
    turns = t.turns.select("meeting_id", "turn_idx", "turn_id", "start", "end", "text")
    arriving = as_stream(t, turns, "arriving-turns")
    filled = runs.fill_translations(arriving, t.meetings, t.translations, shout)
    return filled.select("meeting_id", "turn_id", "text")
