"""Queries: rosters, centroids, enrolled people and suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog.registry import DIGITS, query
from colloquy.functions.vectors import cosine_distance
from colloquy.operators import speakers as sp
from colloquy.operators.models import friendly_app_name

#: All places of the driver's vectors.
PLACES = range(64)


def _numbers(vector: str):
    """The vector positions as columns, rounded."""
    return [
        F.round(F.get(vector, F.lit(i)).cast("double"), DIGITS).alias(f"x{i}") for i in PLACES
    ]


def _numbers_sql(vector: str) -> str:
    return ", ".join(f"round({vector}[{i + 1}], 6) AS x{i}" for i in PLACES)


def _mean_sql(keys: str, weighted: str) -> str:
    """Weighted means at all places, from rows ``(keys, embedding, w)``."""
    parts = ", ".join(
        f"round(sum(embedding[{i + 1}] * w) / sum(w), 6) AS x{i}" for i in PLACES
    )
    return f"SELECT {keys}, {parts} FROM {weighted} WHERE w > 0 GROUP BY {keys}"


HEARD = """
heard AS (
  SELECT s.*, CAST(e.embedding AS DOUBLE[]) AS embedding, s."end" - s.start AS w
  FROM segments s JOIN embeddings e ON s.vec_id = e.vec_id
  WHERE EXISTS (SELECT 1 FROM some_turns t WHERE t.meeting_id = s.meeting_id
                AND t.speaker_id = s.speaker_id)
),
facts AS (
  SELECT meeting_id, speaker_id, min(start) AS first, sum("end" - start) AS total_duration,
         max(side) AS side FROM heard GROUP BY ALL
),"""
SOME_TURNS = """
some_turns AS (
  SELECT meeting_id, CASE WHEN turn_idx % 6 = 5 THEN 'unknown' ELSE speaker_id END AS speaker_id
  FROM turns WHERE turn_idx > 0
),"""


def some_turns(t):
    """Turns without each first one, some of them by nobody known."""
    speaker = F.when(F.col("turn_idx") % 6 == 5, "unknown").otherwise(F.col("speaker_id"))
    return t.turns.where("turn_idx > 0").select("meeting_id", speaker.alias("speaker_id"))


@query(
    "heard_clusters",
    "SELECT meeting_id, speaker_id, seg_idx FROM heard",
    (SOME_TURNS + HEARD).rstrip(","),
)
def _(t):
    return sp.heard_clusters(t.voiced_segments, some_turns(t)).select(
        "meeting_id", "speaker_id", "seg_idx"
    )


@query(
    "speaker_roster",
    f"""SELECT f.meeting_id, CAST(f.pos AS BIGINT) AS roster_pos, f.speaker_id,
               'Speaker ' || (f.pos + 1) AS name, f.side,
               round(f.total_duration, 6) AS total_duration, {", ".join(f"c.x{i}" for i in PLACES)}
        FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY first, side) - 1 AS pos
              FROM facts) f LEFT JOIN centroids c USING (meeting_id, speaker_id)
        UNION ALL
        SELECT meeting_id, (SELECT count(*) FROM facts f WHERE f.meeting_id = u.meeting_id),
               'unknown', 'Unknown speaker', NULL, 0, {", ".join(["NULL"] * len(PLACES))}
        FROM (SELECT DISTINCT meeting_id FROM some_turns WHERE speaker_id = 'unknown') u""",
    SOME_TURNS + HEARD + f"centroids AS ({_mean_sql('meeting_id, speaker_id', 'heard')})",
)
def _(t):
    return sp.speaker_roster(t.voiced_segments, some_turns(t)).select(
        "meeting_id",
        "roster_pos",
        "speaker_id",
        "name",
        "side",
        F.round("total_duration", DIGITS).alias("total_duration"),
        *_numbers("embedding"),
    )


@query(
    "weighted_centroid",
    _mean_sql("label", "(SELECT *, CASE WHEN vec_id % 11 = 0 THEN 0 ELSE duration END AS w "
              "FROM observations WHERE vec_id % 13 <> 5)"),
)
def _(t):
    # Some rows have no weight, some no vector.
    rows = t.observations.withColumns(
        {
            "w": F.when(F.col("vec_id") % 11 == 0, 0.0).otherwise(F.col("duration")),
            "v": F.when(F.col("vec_id") % 13 == 5, F.array().cast("array<float>")).otherwise(
                F.col("embedding")
            ),
        }
    )
    return sp.weighted_centroid(rows, ["label"], "v", "w", "vec_id").select(
        "label", *_numbers("embedding")
    )


@query(
    "vector_mean",
    "SELECT " + ", ".join(f"round(avg(embedding[{i + 1}]), 6) AS x{i}" for i in PLACES)
    + ", vec_id % 3 AS part FROM observations GROUP BY ALL",
)
def _(t):
    rows = t.observations.withColumns({"part": F.col("vec_id") % 3, "w": F.lit(1.0)})
    return sp.weighted_centroid(rows, ["part"], "embedding", "w", "vec_id").select(
        "part", *_numbers("embedding")
    )


def voices(t):
    """Rosters with a voice per speaker."""
    return t.speakers.join(t.read("embeddings").select("vec_id", "embedding"), "vec_id")


VOICES = """
voices AS (
  SELECT s.*, CAST(e.embedding AS DOUBLE[]) AS embedding FROM speakers s
  JOIN embeddings e ON s.vec_id = e.vec_id
)"""


@query(
    "merge_clusters",
    f"""SELECT k.meeting_id, k.speaker_id,
               round(k.total_duration + coalesce(a.total_duration, 0), 6) AS total_duration,
               CASE WHEN a.speaker_id IS NULL OR k.side IS NOT DISTINCT FROM a.side THEN k.side END AS side,
               {", ".join(f'''round(CASE WHEN a.speaker_id IS NULL THEN k.embedding[{i + 1}]
                 ELSE (k.embedding[{i + 1}] * k.total_duration + a.embedding[{i + 1}] * a.total_duration)
                      / (k.total_duration + a.total_duration) END, 6) AS x{i}''' for i in PLACES)}
        FROM voices k LEFT JOIN voices a ON a.meeting_id = k.meeting_id
          AND k.speaker_id = 'user' AND a.speaker_id = 'assistant'
        WHERE NOT (k.speaker_id = 'assistant' AND k.meeting_id IN (
          SELECT meeting_id FROM voices WHERE speaker_id = 'user'))""",
    VOICES,
)
def _(t):
    return sp.merge_clusters(voices(t), "assistant", "user").select(
        "meeting_id",
        "speaker_id",
        F.round("total_duration", DIGITS).alias("total_duration"),
        "side",
        *_numbers("embedding"),
    )


@query(
    "enroll_profiles",
    f"""SELECT name, CAST(n AS BIGINT) AS sample_count, {", ".join(f"x{i}" for i in PLACES)} FROM (
          SELECT p.name, p.sample_count + count(o.vec_id) AS n,
                 {", ".join(f'''round((any_value(p.embedding[{i + 1}]) * p.sample_count
                    + coalesce(sum(o.embedding[{i + 1}]), 0)) / (p.sample_count + count(o.vec_id)), 6)
                    AS x{i}''' for i in PLACES)}
          FROM profiles p LEFT JOIN said o ON lower(p.name) = lower(trim(o.name))
          GROUP BY p.name, p.sample_count
          UNION ALL
          SELECT min_by(trim(o.name), o.vec_id), count(*),
                 {", ".join(f"round(avg(o.embedding[{i + 1}]), 6)" for i in PLACES)}
          FROM said o WHERE trim(o.name) <> '' AND lower(trim(o.name)) NOT IN (
            SELECT lower(name) FROM profiles)
          GROUP BY lower(trim(o.name)))""",
    """
said AS (
  SELECT vec_id, embedding, CASE WHEN vec_id % 4 = 0 THEN ' PERSON ' || label || ' '
         WHEN vec_id % 4 = 1 THEN 'Guest ' || vec_id % 6
         WHEN vec_id % 4 = 2 THEN 'guest ' || vec_id % 6 ELSE ' ' END AS name
  FROM observations
)""",
)
def _(t):
    vec, label = F.col("vec_id"), F.col("label").cast("string")
    guest = (vec % 6).cast("string")
    said = t.observations.select(
        vec.alias("obs_id"),
        "embedding",
        F.when(vec % 4 == 0, F.concat(F.lit(" PERSON "), label, F.lit(" ")))
        .when(vec % 4 == 1, F.concat(F.lit("Guest "), guest))
        .when(vec % 4 == 2, F.concat(F.lit("guest "), guest))
        .otherwise(" ")
        .alias("name"),
    )
    return sp.enroll_profiles(t.profiles, said).select("name", "sample_count", *_numbers("embedding"))


@query(
    "merge_profiles",
    f"""SELECT a.profile_id, a.sample_count + CASE WHEN a.r <> 0 THEN 0 ELSE (b.profile_id IS NOT NULL)::BIGINT
                 + (c.profile_id IS NOT NULL)::BIGINT END AS sample_count,
               CASE WHEN a.r <> 0 THEN a.note ELSE coalesce(a.note, b.note, c.note, d.note) END AS note,
               {", ".join(f'''round(CASE WHEN a.r <> 0 OR b.profile_id IS NULL THEN a.embedding[{i + 1}]
                 ELSE (a.embedding[{i + 1}]::DOUBLE * a.sample_count + b.embedding[{i + 1}] + coalesce(
                   CASE WHEN d.profile_id IS NULL THEN c.embedding[{i + 1}] ELSE
                     (c.embedding[{i + 1}]::DOUBLE * c.sample_count + d.embedding[{i + 1}]) / (c.sample_count + 1) END, 0))
                   / (a.sample_count + 1 + (c.profile_id IS NOT NULL)::BIGINT) END, 6) AS x{i}''' for i in PLACES)}
        FROM (SELECT *, profile_pos % 5 AS r FROM profiles) a
        LEFT JOIN profiles b ON b.profile_pos = a.profile_pos + 1
        LEFT JOIN profiles c ON c.profile_pos = a.profile_pos + 2
        LEFT JOIN profiles d ON d.profile_pos = a.profile_pos + 3
        WHERE a.r IN (0, 4)""",
)
def _(t):
    # 3 into 2, 1 into 0, 2 into 0; 4 into 3 comes too late.
    pos = F.col("profile_pos")
    place = pos % 5
    into = F.when(place <= 2, pos - place).otherwise(pos - 1)
    seq = F.when(place == 3, 1).when(place == 1, 2).when(place == 2, 3).otherwise(4)
    merges = t.profiles.where("profile_pos % 5 <> 0").select(
        (seq * 1_000_000 + pos).alias("seq"),
        F.col("profile_id").alias("source_id"),
        F.concat(F.lit("p"), into.cast("string")).alias("target_id"),
    )
    return sp.merge_profiles(t.profiles, merges).select(
        "profile_id", "sample_count", "note", *_numbers("embedding")
    )


ACTIONS = """
actions AS (
  SELECT vec_id AS seq, label, CASE WHEN vec_id % 13 = 5 THEN 'nobody' ELSE 'p' || label END AS profile_id,
         CASE WHEN vec_id % 9 = 7 AND label % 5 = 4 THEN 'delete'
              ELSE ['accept', 'rename', 'note', 'other'][vec_id % 4 + 1] END AS kind,
         CASE WHEN vec_id % 3 = 1 THEN '  ' ELSE ' New ' || vec_id || ' ' END AS text, embedding,
         make_timestamp((1714067200 + CAST(vec_id AS BIGINT) * 60) * 1000000) AS done
  FROM observations
),
changes AS (
  SELECT profile_id, max_by(trim(text), seq) FILTER (WHERE kind = 'rename' AND trim(text) <> '') AS new_name,
         max(seq) FILTER (WHERE kind = 'note') AS noted,
         max_by(done, seq) FILTER (WHERE kind = 'accept' OR kind = 'rename' AND trim(text) <> '') AS new_at,
         bool_or(kind = 'delete') AS gone, count(*) FILTER (WHERE kind = 'accept') AS k
  FROM actions GROUP BY 1
)"""


@query(
    "edit_profiles",
    f"""SELECT p.profile_id, coalesce(new_name, name) AS name,
               CASE WHEN noted IS NULL THEN note ELSE nullif(trim(n.text), '') END AS note,
               CAST(p.sample_count + coalesce(k, 0) AS BIGINT) AS sample_count,
               coalesce(new_at, updated_at) AS updated_at,
               {", ".join(f'''round((p.embedding[{i + 1}] * p.sample_count + coalesce(
                 (SELECT sum(a.embedding[{i + 1}]) FROM actions a
                  WHERE a.profile_id = p.profile_id AND a.kind = 'accept'), 0))
                 / (p.sample_count + coalesce(k, 0)), 6) AS x{i}''' for i in PLACES)}
        FROM profiles p LEFT JOIN changes l ON l.profile_id = p.profile_id
        LEFT JOIN actions n ON n.profile_id = p.profile_id AND n.seq = l.noted
        WHERE NOT coalesce(gone, false)""",
    ACTIONS,
)
def _(t):
    seq, label = F.col("vec_id"), F.col("label")
    kinds = F.array(*[F.lit(k) for k in ("accept", "rename", "note", "other")])
    actions = t.observations.select(
        seq.alias("seq"),
        F.when(seq % 13 == 5, "nobody").otherwise(F.concat(F.lit("p"), label.cast("string"))).alias("profile_id"),
        F.when((seq % 9 == 7) & (label % 5 == 4), "delete")
        .otherwise(F.get(kinds, (seq % 4).cast("int")))
        .alias("kind"),
        F.when(seq % 3 == 1, "  ").otherwise(F.concat(F.lit(" New "), seq.cast("string"), F.lit(" "))).alias("text"),
        "embedding",
        F.timestamp_seconds(F.lit(1_714_067_200) + seq.cast("long") * 60).alias("at"),
    )
    return sp.edit_profiles(t.profiles, actions).select(
        "profile_id", "name", "note", "sample_count", "updated_at", *_numbers("embedding")
    )


@query(
    "suggest_profile",
    """SELECT meeting_id, speaker_id, CASE WHEN d <= 0.45 THEN profile_id END AS profile_id,
              CASE WHEN d <= 0.45 THEN name END AS name,
              round(CASE WHEN d <= 0.45 THEN d END, 6) AS distance
       FROM (SELECT v.meeting_id, v.speaker_id, p.profile_id, p.name, p.profile_pos,
                    list_cosine_distance(v.embedding, p.embedding) AS d
             FROM voices v, profiles p)
       QUALIFY row_number() OVER (PARTITION BY meeting_id, speaker_id ORDER BY d, profile_pos) = 1""",
    VOICES,
)
def _(t):
    return sp.suggest_profile(voices(t), t.profiles).select(
        "meeting_id",
        "speaker_id",
        "profile_id",
        "name",
        F.round("distance", DIGITS).alias("distance"),
    )


@query(
    "cosine_distance",
    """SELECT a.vec_id, round(list_cosine_distance(a.embedding, b.embedding), 6) AS distance
       FROM observations a JOIN observations b ON b.vec_id = a.vec_id + 1""",
)
def _(t):
    after = t.observations.select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")
    )
    pairs = t.observations.join(after, "vec_id")
    distance = cosine_distance(F.col("embedding"), F.col("other"))
    return pairs.select("vec_id", F.round(distance, DIGITS).alias("distance"))


@query(
    "vector_compare",
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding, p.embedding), 6) AS cosine,
              round(list_max(list_transform(list_zip(a.embedding, p.embedding),
                    lambda z: abs(z[1] - z[2]))), 6) AS max_difference
       FROM observations a JOIN profiles p ON a.label = p.profile_pos""",
)
def _(t):
    own = t.profiles.select(F.col("profile_pos").alias("label"), F.col("embedding").alias("b"))
    pairs = t.observations.withColumnRenamed("embedding", "a").join(own, "label")
    return sp.vector_compare(pairs, "a", "b").select(
        "vec_id",
        F.round("cosine", DIGITS).alias("cosine"),
        F.round("max_difference", DIGITS).alias("max_difference"),
    )


@query(
    "roster_name_lookup",
    "SELECT meeting_id, turn_id, speaker_name FROM named",
)
def _(t):
    return sp.roster_names(t.turns, t.speakers).select("meeting_id", "turn_id", "speaker_name")


@query(
    "backfill_roster",
    """SELECT meeting_id, speaker_id, name FROM speakers
       UNION ALL
       SELECT t.meeting_id, t.speaker_id, min_by('the ' || t.speaker_id || ' ' || t.turn_idx, t.turn_idx)
       FROM turns t WHERE NOT EXISTS (SELECT 1 FROM speakers s WHERE s.meeting_id = t.meeting_id
         AND s.speaker_id = t.speaker_id) GROUP BY 1, 2""",
)
def _(t):
    said = F.concat(F.lit("the "), "speaker_id", F.lit(" "), F.col("turn_idx").cast("string"))
    return sp.backfill_roster(t.speakers, t.turns.withColumn("speaker", said)).select(
        "meeting_id", "speaker_id", "name"
    )


@query(
    "roundtrip_is_named",
    """SELECT meeting_id, speaker_id, CASE WHEN conv_id % 3 = 0 THEN is_named ELSE
         NOT (speaker_id = 'unknown' OR regexp_full_match(name, 'Speaker [0-9]+')) END AS is_named
       FROM speakers""",
)
def _(t):
    named = F.when(F.col("conv_id") % 3 == 0, F.col("is_named"))
    return t.speakers.select(
        "meeting_id",
        "speaker_id",
        sp.is_named(named, F.col("speaker_id"), F.col("name")).alias("is_named"),
    )


@query(
    "import_roster",
    """SELECT meeting_id, speaker_id, round(sum("end" - start), 6) AS total_duration,
              max("end") AS last_heard,
              row_number() OVER (PARTITION BY meeting_id ORDER BY min(turn_idx)) - 1 AS roster_pos
       FROM turns GROUP BY meeting_id, speaker_id""",
)
def _(t):
    spans = t.turns.withColumnRenamed("turn_idx", "span_idx")
    return sp.import_roster(spans).select(
        "meeting_id",
        "speaker_id",
        F.round("total_duration", DIGITS).alias("total_duration"),
        "last_heard",
        "roster_pos",
    )


@query(
    "profile_detail",
    """SELECT profile_id, CASE WHEN sample_count = 1 THEN '1 recording'
         ELSE sample_count || ' recordings' END || ' · last heard ' || strftime(updated_at, '%Y-%m-%d')
         AS detail FROM profiles""",
)
def _(t):
    detail = sp.profile_detail(F.col("sample_count"), F.col("updated_at"))
    return t.profiles.select("profile_id", detail.alias("detail"))


@query(
    "friendly_app_name",
    """SELECT event_id, CASE WHEN bundle = 'com.apple.WebKit.GPU' THEN 'Safari'
         WHEN starts_with(bundle, 'com.google.Chrome') THEN 'Google Chrome'
         WHEN starts_with(bundle, 'org.mozilla.firefox') THEN 'Firefox' ELSE event_type END AS app
       FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN 'com.apple.WebKit.GPU'
               WHEN 1 THEN 'com.google.Chrome.helper' WHEN 2 THEN 'org.mozilla.firefox' END AS bundle
             FROM events)""",
)
def _(t):
    at = F.col("event_id") % 4
    bundle = (
        F.when(at == 0, "com.apple.WebKit.GPU")
        .when(at == 1, "com.google.Chrome.helper")
        .when(at == 2, "org.mozilla.firefox")
    )
    return t.read("events").select(
        "event_id", friendly_app_name(bundle, F.col("event_type")).alias("app")
    )
