"""Queries: frames, bleed, waveforms, slices and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog.registry import DIGITS, query
from colloquy.functions.vectors import decibels
from colloquy.operators import blocks, sides, slices
from colloquy.operators.models import seek_time

PER_FRAME = 8
SAMPLE_RATE = 1.0


@query(
    "envelope_frames",
    f"""SELECT meeting_id, CASE channel WHEN 0 THEN 'microphone' ELSE 'systemAudio' END AS side,
               idx // {PER_FRAME} AS frame, round(avg(value * value), 6) AS energy
        FROM samples GROUP BY ALL""",
)
def _(t):
    return blocks.envelope_frames(t.sample_blocks, PER_FRAME).select(
        "meeting_id", "side", "frame", F.round("energy", DIGITS).alias("energy")
    )


@query(
    "present_sides",
    """SELECT meeting_id, CASE channel WHEN 0 THEN 'microphone' ELSE 'systemAudio' END AS side,
              round(max(abs(value)), 6) AS peak
       FROM samples WHERE user_id % 3 <> 0 GROUP BY meeting_id, channel
       HAVING max(abs(value)) > CAST(0.005 AS DOUBLE)""",
)
def _(t):
    declared = t.ticks.groupBy("meeting_id").agg(
        F.max(F.col("user_id") % 3 != 0).alias("separate_sources")
    )
    return sides.present_sides(t.sample_blocks, declared).select(
        "meeting_id", "side", F.round("peak", DIGITS).alias("peak")
    )


PAIRS = """
lens AS (SELECT meeting_id, count(*) AS n FROM sys_frames GROUP BY 1),
db AS (
  SELECT f.meeting_id, side, frame, n, 10 * log10(greatest(energy, CAST(1e-12 AS DOUBLE))) AS level
  FROM frames f JOIN lens l ON f.meeting_id = l.meeting_id
),
pairs AS (
  SELECT s.meeting_id, s.n, lag, s.frame AS sys_frame, s.level AS sys_db, m.level AS mic_db
  FROM (SELECT *, unnest(range(11)) AS lag FROM db WHERE side = 'systemAudio') s
  JOIN db m ON m.side = 'microphone' AND m.meeting_id = s.meeting_id AND m.frame = s.frame + s.lag
)"""

COUPLED = PAIRS + """,
heard AS (
  SELECT p.meeting_id, p.lag, mic_db - sys_db AS d FROM pairs p
  JOIN (SELECT meeting_id, max(level) AS loudest FROM db WHERE side = 'systemAudio' GROUP BY 1) l
    ON p.meeting_id = l.meeting_id
  WHERE n > 15 AND loudest > -110 AND sys_db > loudest - 20
),
offsets AS (
  SELECT meeting_id, lag, n, d AS off FROM (
    SELECT *, row_number() OVER (PARTITION BY meeting_id, lag ORDER BY d) - 1 AS rk,
           count(*) OVER (PARTITION BY meeting_id, lag) AS n FROM heard)
  WHERE rk = n // 10 AND n >= 5 AND d > -60
),
evidence AS (
  SELECT h.meeting_id, h.lag, o.off,
         avg(CASE WHEN abs(h.d - o.off) <= 6 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS evidence
  FROM heard h JOIN offsets o ON h.meeting_id = o.meeting_id AND h.lag = o.lag
  GROUP BY ALL HAVING evidence > 0.5
),
coupling AS (
  SELECT e.meeting_id, e.lag, e.off, e.evidence, z.noise FROM evidence e
  JOIN (SELECT meeting_id, level AS noise FROM (
          SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY level) - 1 AS rk
          FROM db WHERE side = 'microphone') WHERE rk = n // 10) z ON z.meeting_id = e.meeting_id
  QUALIFY row_number() OVER (PARTITION BY e.meeting_id ORDER BY evidence DESC, lag) = 1
)"""


@query(
    "lagged_frame_pairs",
    """SELECT meeting_id, CAST(lag AS BIGINT) AS lag, count(*) AS pairs,
              round(avg(mic_db - sys_db), 6) AS mean_difference FROM pairs GROUP BY ALL""",
    PAIRS,
)
def _(t):
    return (
        sides.lagged_pairs(t.frame_blocks)
        .groupBy("meeting_id", F.col("lag").cast("long").alias("lag"))
        .agg(
            F.count("*").alias("pairs"),
            F.round(F.avg(F.col("mic_db") - F.col("sys_db")), DIGITS).alias("mean_difference"),
        )
    )


@query(
    "bleed_coupling",
    """SELECT meeting_id, lag, round(off, 6) AS offset_db, round(evidence, 6) AS evidence,
              round(noise, 6) AS noise_db FROM coupling""",
    COUPLED,
)
def _(t):
    return sides.bleed_coupling(t.frame_blocks).select(
        "meeting_id",
        "lag",
        F.round("offset_db", DIGITS).alias("offset_db"),
        F.round("evidence", DIGITS).alias("evidence"),
        F.round("noise_db", DIGITS).alias("noise_db"),
    )


GATES = COUPLED + """,
gates AS (
  SELECT m.meeting_id, m.frame, coalesce(m.level <= greatest(s.level + c.off, c.noise)
           + 10 * log10(CAST(3 AS DOUBLE)), false) AS gated
  FROM db m JOIN coupling c ON m.meeting_id = c.meeting_id
  LEFT JOIN db s ON s.side = 'systemAudio' AND s.meeting_id = m.meeting_id AND s.frame = m.frame - c.lag
  WHERE m.side = 'microphone'
)"""


def gates(t):
    return sides.gate_frames(t.frames, sides.bleed_coupling(t.frame_blocks))


@query("gate_frames", "SELECT meeting_id, frame, gated FROM gates", GATES)
def _(t):
    return gates(t).select("meeting_id", "frame", "gated")


@query(
    "silence_frames",
    """SELECT s.meeting_id, s.idx, round(CASE WHEN g.gated THEN 0 ELSE s.value END, 6) AS value
       FROM samples s LEFT JOIN gates g ON s.meeting_id = g.meeting_id AND s.idx // 8 = g.frame
       WHERE s.channel = 0""",
    GATES,
)
def _(t):
    first = t.sample_blocks.where("channel = 0")
    return blocks.unpack_samples(blocks.silence_frames(first, gates(t), PER_FRAME)).select(
        "meeting_id", "idx", F.round("value", DIGITS).alias("value")
    )


@query(
    "channel_fold",
    """SELECT f.meeting_id, f.idx, round(total * CASE WHEN s > 0 THEN c / s ELSE 1 END, 12) AS value
       FROM folded f JOIN (SELECT meeting_id, max(peak) AS c, max(abs(total)) AS s FROM folded
                           GROUP BY 1) g ON f.meeting_id = g.meeting_id""",
    """
folded AS (
  SELECT meeting_id, idx, sum(value) AS total, max(abs(value)) AS peak FROM samples GROUP BY ALL
)""",
)
def _(t):
    # Halves of the input's own decimals are ties at six digits.
    return blocks.unpack_samples(blocks.channel_fold(t.sample_blocks)).select(
        "meeting_id", "idx", F.round("value", 12).alias("value")
    )


WAVE = """
wave AS (
  SELECT meeting_id, bucket, peak / max(peak) OVER (PARTITION BY meeting_id) AS peak FROM (
    SELECT s.meeting_id, idx // per AS bucket, max(abs(value)) AS peak
    FROM samples s JOIN (SELECT meeting_id, greatest(1, count(*) // 20) AS per FROM samples
                         WHERE channel = 0 GROUP BY 1) p ON s.meeting_id = p.meeting_id
    WHERE channel = 0 GROUP BY ALL)
)"""


@query("waveform_peaks", "SELECT meeting_id, bucket, round(peak, 6) AS peak FROM wave", WAVE)
def _(t):
    return blocks.waveform_peaks(t.sample_blocks, buckets=20).select(
        "meeting_id", "bucket", F.round("peak", DIGITS).alias("peak")
    )


@query(
    "waveform_resample",
    """SELECT b.meeting_id, b.bar, round(max(w.peak), 6) AS peak
       FROM (SELECT meeting_id, n, CAST(unnest(range(7)) AS BIGINT) AS bar FROM (
               SELECT meeting_id, count(*) AS n FROM wave GROUP BY 1)) b
       JOIN wave w ON w.meeting_id = b.meeting_id AND w.bucket >= b.bar * n // 7
        AND w.bucket < greatest(b.bar * n // 7 + 1, (b.bar + 1) * n // 7)
       GROUP BY ALL""",
    WAVE,
)
def _(t):
    peaks = blocks.waveform_peaks(t.sample_blocks, buckets=20)
    return sides.waveform_resample(peaks, 7).select(
        "meeting_id", "bar", F.round("peak", DIGITS).alias("peak")
    )


METER = """
metered AS (
  SELECT meeting_id, user_id, idx, value AS level, value AS meter FROM ticks WHERE idx = 0
  UNION ALL
  SELECT t.meeting_id, t.user_id, t.idx, t.value, greatest(t.value, CAST(0.6 AS DOUBLE) * m.meter)
  FROM metered m JOIN ticks t ON t.meeting_id = m.meeting_id AND t.idx = m.idx + 1
)"""


@query("meter_decay", "SELECT meeting_id, idx, round(meter, 6) AS meter FROM metered", METER)
def _(t):
    return sides.meter_decay(t.ticks, ["meeting_id"], "idx", "value").select(
        "meeting_id", "idx", F.round("meter", DIGITS).alias("meter")
    )


REGIONS = """
padded AS (
  SELECT meeting_id, greatest(0, start - CAST(0.4 AS DOUBLE)) AS start,
         "end" + CAST(0.4 AS DOUBLE) AS "end", seg_idx FROM segments
),
islands AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END)
           OVER (PARTITION BY meeting_id ORDER BY start, seg_idx) AS island
  FROM (SELECT *, max("end") OVER (PARTITION BY meeting_id ORDER BY start, seg_idx
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM padded)
),
regions AS (
  SELECT meeting_id, min(start) AS start, max("end") AS "end",
         row_number() OVER (PARTITION BY meeting_id ORDER BY min(start)) - 1 AS region_idx
  FROM islands GROUP BY meeting_id, island
),
gaps AS (
  SELECT meeting_id, region_idx AS gap_idx, ("end" + nxt) / 2 AS midpoint, nxt - "end" AS width
  FROM (SELECT *, lead(start) OVER (PARTITION BY meeting_id ORDER BY region_idx) AS nxt FROM regions)
  WHERE nxt - "end" > 0
)"""


def regions(t):
    return slices.speech_regions(t.segments)


@query(
    "speech_regions",
    """SELECT meeting_id, region_idx, round(start, 6) AS start, round("end", 6) AS "end" FROM regions""",
    REGIONS,
)
def _(t):
    return regions(t).select(
        "meeting_id",
        "region_idx",
        F.round("start", DIGITS).alias("start"),
        F.round("end", DIGITS).alias("end"),
    )


@query(
    "region_gaps",
    """SELECT meeting_id, gap_idx, round(midpoint, 6) AS midpoint, round(width, 6) AS width FROM gaps""",
    REGIONS,
)
def _(t):
    return slices.region_gaps(regions(t)).select(
        "meeting_id",
        "gap_idx",
        F.round("midpoint", DIGITS).alias("midpoint"),
        F.round("width", DIGITS).alias("width"),
    )


CUTS = REGIONS + """,
targets AS (
  SELECT meeting_id, duration, n, CAST(unnest(range(1, n)) AS BIGINT) AS i FROM (
    SELECT meeting_id, duration, least(8, greatest(1, CAST(floor(duration / 45) AS BIGINT))) AS n
    FROM meetings) WHERE n > 1 AND duration > 20 * n
),
offered AS (
  SELECT t.meeting_id, t.duration, t.i, g.midpoint AS cut FROM targets t
  JOIN gaps g ON g.meeting_id = t.meeting_id
  QUALIFY row_number() OVER (PARTITION BY t.meeting_id, t.i
    ORDER BY abs(g.midpoint - t.duration * t.i / t.n) - g.width, g.gap_idx) = 1
),
walk AS (
  SELECT meeting_id, duration, CAST(0 AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS kept,
         CAST(NULL AS DOUBLE) AS last FROM (SELECT DISTINCT meeting_id, duration FROM offered)
  UNION ALL
  SELECT o.meeting_id, o.duration, o.i,
         CASE WHEN (w.last IS NULL OR o.cut - w.last >= 20) AND o.cut > 20 AND o.duration - o.cut > 20
              THEN o.cut END,
         CASE WHEN (w.last IS NULL OR o.cut - w.last >= 20) AND o.cut > 20 AND o.duration - o.cut > 20
              THEN o.cut ELSE w.last END
  FROM walk w JOIN offered o ON o.meeting_id = w.meeting_id AND o.i = w.i + 1
),
cuts AS (
  SELECT meeting_id, kept AS cut,
         row_number() OVER (PARTITION BY meeting_id ORDER BY i) - 1 AS cut_idx
  FROM walk WHERE kept IS NOT NULL
)"""


def cuts(t):
    return slices.cut_points(
        slices.region_gaps(regions(t)), t.meetings, slice_seconds=45.0, minimum=20.0
    )


@query("cut_points", "SELECT meeting_id, cut_idx, round(cut, 6) AS cut FROM cuts", CUTS)
def _(t):
    return cuts(t).select(
        "meeting_id", F.col("cut_idx").cast("long").alias("cut_idx"), F.round("cut", DIGITS).alias("cut")
    )


def event_cuts(t):
    """Two cuts in the middle of every user's samples."""
    return t.ticks.groupBy("meeting_id").agg(F.count("*").alias("n")).select(
        "meeting_id",
        F.posexplode(F.array(F.col("n") / 3, F.col("n") * 2 / 3)).alias("cut_idx", "cut"),
    )


@query(
    "quietest_near",
    """SELECT c.meeting_id, c.cut_idx, round(coalesce(b.begin_at + 10, c.cut), 6) AS cut
       FROM event_cuts c LEFT JOIN best b ON b.meeting_id = c.meeting_id AND b.cut_idx = c.cut_idx""",
    """
event_cuts AS (
  SELECT meeting_id, n, k AS cut_idx, n * (k + 1) / CAST(3 AS DOUBLE) AS cut
  FROM (SELECT meeting_id, count(*) AS n FROM ticks GROUP BY 1), range(2) r(k)
),
starts AS (
  SELECT meeting_id, cut_idx, unnest(range(lo, hi, 6)) AS begin_at FROM (
    SELECT *, greatest(0, CAST(floor(cut) AS BIGINT) - 15) AS lo,
           least(n - 20, CAST(floor(cut) AS BIGINT) + 15) AS hi FROM event_cuts) WHERE lo < hi
),
peaks AS (
  SELECT s.meeting_id, s.cut_idx, s.begin_at, max(abs(x.value)) AS peak
  FROM starts s JOIN samples x ON x.meeting_id = s.meeting_id AND x.channel = 0
   AND (x.idx = s.begin_at OR x.idx = s.begin_at + 16) GROUP BY ALL
),
best AS (
  SELECT * FROM peaks
  QUALIFY row_number() OVER (PARTITION BY meeting_id, cut_idx ORDER BY peak, begin_at) = 1
)""",
)
def _(t):
    first = t.sample_blocks.where("channel = 0")
    moved = slices.quietest_near(event_cuts(t), first, SAMPLE_RATE, 15.0, 20.0)
    return moved.select(
        "meeting_id", F.col("cut_idx").cast("long").alias("cut_idx"), F.round("cut", DIGITS).alias("cut")
    )


@query(
    "slice_rebase",
    """SELECT meeting_id, word_idx, start, "end" FROM words""",
)
def _(t):
    # Slices of a hundred seconds; every word is moved to its slice's clock and back.
    length = 100.0
    fixed = t.meetings.where("duration > 100").select(
        "meeting_id",
        F.explode(
            F.sequence(F.lit(1).cast("long"), F.floor(F.col("duration") / length).cast("long"))
        ).alias("k"),
    )
    bounds = slices.slice_bounds(
        fixed.select("meeting_id", (F.col("k") * length).alias("cut")), t.meetings
    )
    at = F.floor(F.col("start") / length).cast("int")
    local = t.words.select(
        "meeting_id",
        "word_idx",
        at.alias("slice_idx"),
        (F.col("start") - at * length).alias("start"),
        (F.col("end") - at * length).alias("end"),
    )
    back = slices.slice_rebase(local, bounds)
    return back.select(
        "meeting_id", "word_idx", F.round("start", 3).alias("start"), F.round("end", 3).alias("end")
    )


@query(
    "overlap_window_stitch",
    """SELECT meeting_id, word_idx, word FROM words""",
)
def _(t):
    # Every window of 20 s with 5 s overlap hears all words that start in it;
    # stitched together, each word is there exactly once.
    window, step = 20.0, 15.0
    last = t.words.groupBy("meeting_id").agg(F.max("start").alias("_end"))
    count = F.greatest(F.lit(0), F.ceil((F.col("_end") - window) / step)).cast("long")
    start = F.col("start")
    low = F.greatest(F.lit(0), F.ceil((start - window) / step)).cast("long")
    high = F.floor(start / step).cast("long")
    heard = t.words.join(last.select("meeting_id", count.alias("_n")), "meeting_id").select(
        "meeting_id",
        "word_idx",
        "word",
        "start",
        F.explode(F.sequence(F.least(low, "_n"), F.least(high, "_n"))).alias("window_idx"),
    )
    return slices.overlap_window_stitch(heard, window, 5.0).select("meeting_id", "word_idx", "word")


@query(
    "vad_mask",
    """SELECT m.meeting_id, CAST(m.frame AS BIGINT) AS frame,
              NOT EXISTS (SELECT 1 FROM regions r WHERE r.meeting_id = m.meeting_id)
              OR coalesce(bool_or(m.frame BETWEEN
                   greatest(0, CAST(floor(r.start / CAST(0.1 AS DOUBLE)) AS BIGINT))
                   AND CAST(ceil(r."end" / CAST(0.1 AS DOUBLE)) AS BIGINT)), false) AS speech
       FROM (SELECT meeting_id, unnest(range(CAST(ceil(duration / CAST(0.1 AS DOUBLE)) AS BIGINT)))
               AS frame FROM meetings) m
       LEFT JOIN regions r ON r.meeting_id = m.meeting_id GROUP BY m.meeting_id, m.frame""",
    REGIONS,
)
def _(t):
    return slices.vad_mask(regions(t), t.meetings)


@query(
    "decibels",
    """SELECT meeting_id, side, frame,
              round(10 * log10(greatest(energy, CAST(1e-12 AS DOUBLE))), 6) AS level FROM frames""",
)
def _(t):
    return t.frames.select(
        "meeting_id", "side", "frame", F.round(decibels(F.col("energy")), DIGITS).alias("level")
    )


@query(
    "seek_time",
    """SELECT meeting_id, word_idx, round(ceil(start * 44100) / CAST(44100 AS DOUBLE), 9) AS seek FROM words""",
)
def _(t):
    return t.words.select(
        "meeting_id", "word_idx", F.round(seek_time(F.col("start")), 9).alias("seek")
    )
