"""Rosters, voice centroids, enrolled people and profile suggestions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import vectors as vec
from colloquy.functions.text import trimmed
from colloquy.schema import UNKNOWN_SPEAKER
from colloquy.session import settle

# Fixed value: largest cosine distance at which a person is suggested.
SUGGESTION_DISTANCE = 0.45

#: Profiles compared per row of the suggestion join, about: with 256-wide vectors
#: a block is near 0.5 MB. Each block is there once for each salt of the voices.
PROFILE_BLOCK = 512
PROFILE_SALTS = 32

#: People whose directions divide the others, at most.
PIVOTS = 64
#: Width of a ring around a pivot, and what rounding may cost an angle.
RING = np.pi / 18
ANGLE_SLACK = 1e-6


def _mean(vector: Column, weight: Column) -> Column:
    """Weighted mean of equally wide vectors, as an aggregate."""
    return vector_to_array(
        Summarizer.mean(array_to_vector(vector.cast("array<double>")), weight.cast("double"))
    )


def weighted_centroid(
    rows: DataFrame, keys: Sequence[str], vector: str, weight: str, order: str
) -> DataFrame:
    """Weighted mean vector per key; unusable rows and odd widths are left out.

    Unusable is an empty vector or a weight of zero or less. The width is that
    of the first usable row. A key with many rows shuffles one partial vector per
    task.
    """
    usable = rows.where((F.size(vector) > 0) & (F.col(weight) > 0))
    width = usable.groupBy(*keys).agg(F.min_by(F.size(vector), F.col(order)).alias("_width"))
    parts = (
        usable.join(width, list(keys))
        .where(F.size(vector) == F.col("_width"))
    )
    return parts.groupBy(*keys).agg(_mean(F.col(vector), F.col(weight)).alias("embedding"))


def heard_clusters(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """Segments whose speaker has at least one turn."""
    heard = turns.select("meeting_id", "speaker_id").distinct()
    return segments.join(heard, ["meeting_id", "speaker_id"], "left_semi")


def speaker_roster(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """Heard clusters numbered by first appearance, plus ``unknown`` where used."""
    heard = heard_clusters(segments, turns)
    place = F.struct("start", "side", "seg_idx")
    facts = heard.groupBy("meeting_id", "speaker_id").agg(
        F.min(place).alias("_first"),
        F.sum(F.col("end") - F.col("start")).alias("total_duration"),
        F.max_by("side", F.when(F.col("side").isNotNull(), place)).alias("side"),
    )
    numbered = facts.withColumn(
        "roster_pos",
        F.row_number().over(Window.partitionBy("meeting_id").orderBy("_first")) - 1,
    ).drop("_first")
    centroids = weighted_centroid(
        heard.withColumns({"_w": F.col("end") - F.col("start"), "_o": place}),
        ["meeting_id", "speaker_id"],
        "embedding",
        "_w",
        "_o",
    )
    known = numbered.join(centroids, ["meeting_id", "speaker_id"], "left").select(
        "meeting_id",
        F.col("roster_pos").cast("long").alias("roster_pos"),
        "speaker_id",
        F.concat(F.lit("Speaker "), (F.col("roster_pos") + 1).cast("string")).alias("name"),
        "total_duration",
        "side",
        "embedding",
    )
    sizes = numbered.groupBy("meeting_id").agg(F.count("*").alias("_n"))
    unknown = (
        turns.where(F.col("speaker_id") == UNKNOWN_SPEAKER)
        .select("meeting_id")
        .distinct()
        .join(
            facts.where(F.col("speaker_id") == UNKNOWN_SPEAKER).select("meeting_id"),
            "meeting_id",
            "left_anti",
        )
        .join(sizes, "meeting_id", "left")
        .select(
            "meeting_id",
            F.coalesce("_n", F.lit(0)).cast("long").alias("roster_pos"),
            F.lit(UNKNOWN_SPEAKER).alias("speaker_id"),
            F.lit("Unknown speaker").alias("name"),
            F.lit(0.0).alias("total_duration"),
            F.lit(None).cast("string").alias("side"),
            F.array().cast("array<double>").alias("embedding"),
        )
    )
    return known.unionByName(unknown)


def import_roster(spans: DataFrame) -> DataFrame:
    """Speaking time per label, in the order the labels first speak."""
    facts = spans.groupBy("meeting_id", "speaker_id").agg(
        F.min("span_idx").alias("_first"),
        F.sum(F.col("end") - F.col("start")).alias("total_duration"),
        F.max("end").alias("last_heard"),
    )
    order = Window.partitionBy("meeting_id").orderBy("_first")
    return facts.select(
        "meeting_id",
        (F.row_number().over(order) - 1).cast("long").alias("roster_pos"),
        "speaker_id",
        "total_duration",
        "last_heard",
    )


def roster_names(turns: DataFrame, speakers: DataFrame) -> DataFrame:
    """Turns with the display name of their speaker, the id itself where unlisted."""
    names = speakers.select("meeting_id", "speaker_id", F.col("name").alias("_name"))
    return (
        turns.join(names, ["meeting_id", "speaker_id"], "left")
        .withColumn("speaker_name", F.coalesce("_name", "speaker_id"))
        .drop("_name")
    )


def backfill_roster(speakers: DataFrame, turns: DataFrame) -> DataFrame:
    """Roster plus a label for every turn speaker it lacks, in order of appearance."""
    missing = (
        turns.join(
            speakers.select("meeting_id", "speaker_id"), ["meeting_id", "speaker_id"], "left_anti"
        )
        .groupBy("meeting_id", "speaker_id")
        .agg(F.min_by("speaker", "turn_idx").alias("name"), F.min("turn_idx").alias("_first"))
    )
    sizes = speakers.groupBy("meeting_id").agg((F.max("roster_pos") + 1).alias("_n"))
    order = Window.partitionBy("meeting_id").orderBy("_first")
    added = missing.join(sizes, "meeting_id", "left").select(
        "meeting_id",
        (F.coalesce("_n", F.lit(0)) + F.row_number().over(order) - 1).alias("roster_pos"),
        "speaker_id",
        "name",
        F.lit(False).alias("is_named"),
        F.lit(0.0).alias("total_duration"),
    )
    return speakers.select(*added.columns).unionByName(added)


def is_named(named: Column, speaker_id: Column, name: Column) -> Column:
    """Whether a person chose the name; older files do not say, so it is judged."""
    placeholder = (
        (speaker_id == UNKNOWN_SPEAKER)
        | (name == "Unknown speaker")
        | name.rlike(r"^Speaker [0-9]+$")
    )
    return F.coalesce(named, ~placeholder)


def merge_clusters(speakers: DataFrame, source: str, target: str) -> DataFrame:
    """Rosters with the ``source`` cluster absorbed by ``target`` where both exist.

    Durations add, the centroid is their weighted mean, differing sides (null
    included) become null.
    """
    from_side = speakers.where(F.col("speaker_id") == source).select(
        "meeting_id",
        F.col("embedding").alias("_e"),
        F.col("total_duration").alias("_d"),
        F.col("side").alias("_side"),
        F.lit(True).alias("_absorbed"),
    )
    pair = speakers.where(F.col("speaker_id") == target).select("meeting_id")
    joined = speakers.join(from_side.join(pair, "meeting_id", "left_semi"), "meeting_id", "left")
    keeps = F.col("_absorbed").isNotNull() & (F.col("speaker_id") == target)
    same_side = F.col("side").eqNullSafe(F.col("_side"))
    mixed = vec.blend(F.col("embedding"), F.col("total_duration"), F.col("_e"), F.col("_d"))
    # Computed before the durations change: the weights are the old ones.
    weighed = joined.where(
        F.col("_absorbed").isNull() | (F.col("speaker_id") != source)
    ).withColumn(
        "_mixed",
        F.when(keeps, mixed).otherwise(F.transform("embedding", lambda x: x.cast("double"))),
    )
    return weighed.select(
        "meeting_id",
        "roster_pos",
        "speaker_id",
        "name",
        F.when(keeps, F.col("total_duration") + F.col("_d"))
        .otherwise(F.col("total_duration"))
        .alias("total_duration"),
        F.when(keeps & ~same_side, F.lit(None)).otherwise(F.col("side")).alias("side"),
        F.col("_mixed").alias("embedding"),
    )


# -- enrolled people ---------------------------------------------------------


def _reinforced(profiles: DataFrame, absorbed: DataFrame, at: Column) -> DataFrame:
    """Profiles with observations ``(profile_id, vector, seq)`` folded into the mean.

    A profile without a voice takes its first observation as it is. Else only
    vectors as wide as the profile's count: a running mean over k of them is
    ``(mean * n + sum) / (n + k)`` in any order. Every observation, also one
    that does not fit, makes ``at`` the time of the last update.
    """
    stored = profiles.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    if "updated_at" not in stored.columns:
        stored = stored.withColumn("updated_at", F.lit(None).cast("timestamp"))
    voiceless = stored.where(F.size("embedding") <= 0).select("profile_id")
    firsts = (
        absorbed.where(F.size("vector") > 0)
        .join(voiceless, "profile_id")
        .groupBy("profile_id")
        .agg(F.min_by(F.struct("vector", "seq"), "seq").alias("_first"))
    )
    filled = (
        stored.join(firsts, "profile_id", "left")
        .withColumn(
            "embedding",
            F.coalesce(F.transform("_first.vector", lambda x: x.cast("double")), "embedding"),
        )
        .withColumn("_taken", F.col("_first.seq"))
        .drop("_first")
    )
    heard = absorbed.groupBy("profile_id").agg(F.lit(True).alias("_heard"))
    width = filled.select("profile_id", F.size("embedding").alias("_width"), "_taken")
    fitting = absorbed.join(width, "profile_id").where(
        (F.size("vector") == F.col("_width")) & (F.size("vector") > 0)
        & (F.col("_taken").isNull() | (F.col("seq") != F.col("_taken")))
    )
    sums = fitting.groupBy("profile_id").agg(
        _mean(F.col("vector"), F.lit(1.0)).alias("_mean"), F.count("*").alias("_k")
    )
    n, k = F.col("sample_count"), F.col("_k")
    mean = F.zip_with("embedding", "_mean", lambda x, m: (x * n + m * k) / (n + k))
    return (
        filled.join(sums, "profile_id", "left")
        .join(heard, "profile_id", "left")
        .withColumn("embedding", F.when(k.isNotNull(), mean).otherwise(F.col("embedding")))
        .withColumn("sample_count", n + F.coalesce(k, F.lit(0)))
        .withColumn("updated_at", F.when(F.col("_heard"), at).otherwise(F.col("updated_at")))
        .drop("_mean", "_k", "_taken", "_heard")
    )


def enroll_profiles(
    profiles: DataFrame, observations: DataFrame, at: Column | None = None
) -> DataFrame:
    """Confirmed voices folded into the people they name; new names are added.

    Names match without case. The first observation of a new name is its first
    profile, later ones reinforce it. ``at`` is the time of the update, now if
    it is not given.
    """
    at = F.current_timestamp() if at is None else at
    if "updated_at" not in profiles.columns:
        profiles = profiles.withColumn("updated_at", F.lit(None).cast("timestamp"))
    spoken = (
        observations.withColumn("_name", trimmed(F.col("name")))
        .where((F.col("_name") != "") & (F.size("embedding") > 0))
        .withColumn("_key", F.lower("_name"))
    )
    known = profiles.withColumn("_key", F.lower("name"))
    firsts = (
        spoken.join(known.select("_key"), "_key", "left_anti")
        .groupBy("_key")
        .agg(F.min_by(F.struct("_name", "embedding", "obs_id"), "obs_id").alias("_f"))
    )
    added = firsts.select(
        F.concat(F.lit("new-"), F.col("_f.obs_id").cast("string")).alias("profile_id"),
        F.col("_f._name").alias("name"),
        F.transform("_f.embedding", lambda x: x.cast("double")).alias("embedding"),
        F.lit(1).cast("long").alias("sample_count"),
        at.alias("updated_at"),
        "_key",
    )
    everyone = known.select(
        "profile_id",
        "name",
        F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
        "sample_count",
        "updated_at",
        "_key",
    ).unionByName(added)
    started = added.select(
        "_key", F.substring("profile_id", 5, 20).cast("long").alias("_started")
    )
    later = (
        spoken.join(started, "_key", "left")
        .where("_started IS NULL OR obs_id > _started")
        .join(everyone.select("_key", "profile_id"), "_key")
        .select("profile_id", F.col("embedding").alias("vector"), F.col("obs_id").alias("seq"))
    )
    return _reinforced(everyone.drop("_key"), later, at)


def _effective_merges(profiles: DataFrame, merges: DataFrame) -> DataFrame:
    """The merges that take place: both people are there when their turn comes.

    A merge whose target has an earlier merge of its own waits until it is
    known whether that one takes place. The earliest that waits is always
    decided, so this ends; chains without conflicts are decided at once.
    """
    ids = profiles.select("profile_id")
    left = settle(
        merges.select("seq", "source_id", "target_id")
        .where("source_id <> target_id")
        .join(ids.withColumnRenamed("profile_id", "source_id"), "source_id", "left_semi")
        .join(ids.withColumnRenamed("profile_id", "target_id"), "target_id", "left_semi"),
        "merges",
    )
    while True:
        first = left.groupBy("source_id").agg(F.min("seq").alias("seq"))
        mine = left.join(first, ["source_id", "seq"], "left_semi")
        own = mine.select(
            F.col("source_id").alias("_id"), F.col("seq").alias("_gone"), F.col("target_id").alias("_into")
        )
        faced = settle(mine.join(own, F.col("target_id") == F.col("_id"), "left"), "first-merges")
        sure = faced.where("_gone IS NULL OR _gone > seq").select(F.col("source_id").alias("_id"))
        late = faced.where("_gone < seq").join(sure, "_id", "left_semi").select("source_id", "seq")
        if late.isEmpty():
            return faced.select("seq", "source_id", "target_id")
        left = settle(left.join(late, ["source_id", "seq"], "left_anti"), "merges")


def merge_profiles(profiles: DataFrame, merges: DataFrame, at: Column | None = None) -> DataFrame:
    """Profiles absorbed into others in the order of ``seq``.

    ``merges(seq, source_id, target_id)``. What a person is when absorbed, with
    all that was absorbed before, counts as one observation; a note is kept
    where there is none. People who are gone neither absorb nor are absorbed.
    """
    at = F.current_timestamp() if at is None else at
    pending = settle(_effective_merges(profiles, merges), "pending")
    now = profiles
    while not pending.isEmpty():  # from the leaves of the forest of merges to its roots
        inner = pending.select(F.col("target_id").alias("source_id")).distinct()
        waiting = pending.join(inner, "source_id", "left_semi").select("target_id").distinct()
        ready = pending.join(waiting, "target_id", "left_anti")
        absorbed = settle(
            ready.join(
                now.select(
                    F.col("profile_id").alias("source_id"),
                    F.col("embedding").alias("vector"),
                    F.col("note").alias("_source_note"),
                ),
                "source_id",
            ).withColumnRenamed("target_id", "profile_id"),
            "absorbed",
        )
        gone = absorbed.select(F.col("source_id").alias("profile_id"))
        notes = absorbed.groupBy("profile_id").agg(
            F.min_by("_source_note", F.when(F.col("_source_note").isNotNull(), F.col("seq"))).alias("_note")
        )
        now = settle(
            _reinforced(now.join(gone, "profile_id", "left_anti"), absorbed, at)
            .join(notes, "profile_id", "left")
            .withColumn("note", F.coalesce("note", "_note"))
            .drop("_note"),
            "merged",
        )
        pending = settle(pending.join(absorbed.select("source_id"), "source_id", "left_anti"), "pending")
    return now


def edit_profiles(profiles: DataFrame, actions: DataFrame) -> DataFrame:
    """Profiles after a log of ``actions(seq, profile_id, kind, text, embedding, at)``.

    ``accept`` folds the voice of an accepted suggestion into the mean; ``rename``
    takes the name, trimmed, unless it is blank; ``note`` replaces the note, a
    blank one removes it; ``delete`` ends the profile, whatever else the log says
    of it. Names and accepted voices set the time of the last update, notes do
    not: writing about someone is not hearing them. Unknown profiles and kinds
    change nothing. Each profile's last action of a kind is an aggregate, so no
    log is ordered as a whole.
    """
    kind, text, seq = F.col("kind"), trimmed(F.coalesce("text", F.lit(""))), F.col("seq")
    named, noted, accepted = (kind == "rename") & (text != ""), kind == "note", kind == "accept"
    last = actions.groupBy("profile_id").agg(
        F.max_by(text, F.when(named, seq)).alias("_name"),
        F.max_by(F.when(text != "", text), F.when(noted, seq)).alias("_note"),
        F.max(F.when(noted, seq)).isNotNull().alias("_noted"),
        F.max_by("at", F.when(named | accepted, seq)).alias("_at"),
        F.coalesce(F.bool_or(kind == "delete"), F.lit(False)).alias("_gone"),
    )
    if "updated_at" not in profiles.columns:
        profiles = profiles.withColumn("updated_at", F.lit(None).cast("timestamp"))
    kept = (
        profiles.join(last, "profile_id", "left")
        .where(~F.coalesce("_gone", F.lit(False)))
        .withColumns(
            {
                "name": F.coalesce("_name", "name"),
                "note": F.when(F.col("_noted"), F.col("_note")).otherwise(F.col("note")),
            }
        )
        .drop("_name", "_note", "_noted", "_gone")
    )
    voices = actions.where(accepted).select("profile_id", F.col("embedding").alias("vector"), "seq")
    heard = _reinforced(kept, voices, F.col("_at"))
    return heard.withColumn("updated_at", F.coalesce("_at", "updated_at")).drop("_at")


def _angles(pivots: list[list[float]]) -> Callable[[Column], Column]:
    """Angles of a vector to each pivot, null where the widths differ."""
    table = [np.asarray(p) / np.linalg.norm(p) for p in pivots]

    @F.pandas_udf("array<double>")
    def measured(vectors: pd.Series) -> pd.Series:
        out = []
        for v in vectors:
            own = np.asarray([] if v is None else v, dtype=np.float64)
            with np.errstate(all="ignore"):
                own = own / np.linalg.norm(own)
            out.append([np.arccos(np.clip(p @ own, -1, 1)) if len(p) == len(own) else None for p in table])
        return pd.Series(out)

    return measured


def _nearest_pivot(angles: Column) -> Column:
    """(angle, i) of the nearest pivot, null where none has the width."""
    numbered = F.transform(angles, lambda a, i: F.struct(a.alias("angle"), i.alias("i")))
    return F.array_min(F.filter(numbered, lambda x: x["angle"].isNotNull()))


def _reach(distance: Column) -> Column:
    """The angle within which a cosine distance of at most ``distance`` lies."""
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1.0 - distance))
    return F.acos(cosine) + ANGLE_SLACK


def _has_direction(vector: Column) -> Column:
    length = vec.norm(vector)
    return (length > 0) & (length < float("inf"))


def _indexed_people(profiles: DataFrame) -> tuple[DataFrame, list[tuple[int, int, int]], list[list[float]]]:
    """People packed by (pivot, ring, block), the blocks of each (pivot, ring), and the pivots.

    The pivots are at most PIVOTS people, those of the least hashes. A person
    belongs to the nearest pivot and to the ring its angle falls in; one whose
    width no pivot has belongs to pivot -1.
    """
    people = profiles.select(
        F.col("profile_pos").alias("pos"),
        "profile_id",
        "name",
        F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
        vec.norm(F.col("embedding")).alias("norm"),
    ).where(_has_direction(F.col("embedding")))
    count = profiles.count()
    wanted = min(PIVOTS, count // PROFILE_BLOCK)
    if wanted == 0:
        pivots = []
        cells = [(-1, 0, 1)]
        placed = people.withColumns({"_pivot": F.lit(-1), "_ring": F.lit(0)})
    else:
        first = people.orderBy(F.xxhash64("profile_id"), "profile_id").limit(wanted)
        pivots = [r.vector for r in first.select("vector").collect()]
        placed = (
            people.withColumn("_angles", _angles(pivots)(F.col("vector")))
            .withColumn("_near", _nearest_pivot(F.col("_angles")))
            .withColumns(
                {
                    "_pivot": F.coalesce("_near.i", F.lit(-1)),
                    "_ring": F.coalesce(F.floor(F.col("_near.angle") / RING).cast("int"), F.lit(0)),
                }
            )
            .drop("_angles", "_near")
        )
        placed = settle(placed, "people")
        held = placed.groupBy("_pivot", "_ring").agg(F.ceil(F.count("*") / PROFILE_BLOCK).cast("int").alias("n"))
        cells = sorted((r["_pivot"], r["_ring"], r["n"]) for r in held.collect())  # at most 18 rings a pivot
    sizes = placed.sparkSession.createDataFrame(cells, "_pivot int, _ring int, _blocks int")
    packed = (
        placed.join(F.broadcast(sizes), ["_pivot", "_ring"])
        .withColumn("_block", F.pmod(F.xxhash64("profile_id"), F.col("_blocks")).cast("int"))
        .groupBy("_pivot", "_ring", "_block")
        .agg(F.collect_list(F.struct("pos", "profile_id", "name", "vector", "norm")).alias("_people"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(PROFILE_SALTS - 1))))
    )
    return packed, cells, pivots


def _compared(voices: DataFrame, packed: DataFrame, probed: Column) -> DataFrame:
    """Each voice with the best person of the cells ``probed`` and of ``_best`` before."""
    voice = F.col("embedding")

    def measured(person: Column) -> Column:
        scale = F.col("_norm") * person["norm"]
        return F.struct(
            F.when(
                (F.size(person["vector"]) == F.size(voice)) & (scale > 0),
                1.0 - vec.dot(voice, person["vector"]) / scale,
            )
            .otherwise(F.lit(vec.NO_DISTANCE))
            .alias("distance"),
            person["pos"].alias("pos"),
            person["profile_id"].alias("profile_id"),
            person["name"].alias("name"),
        )

    def blocks(cell: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), cell["_blocks"] - 1),
            lambda b: F.struct(cell["_pivot"].alias("_pivot"), cell["_ring"].alias("_ring"), b.alias("_block")),
        )

    faced = (
        voices.withColumn("_probe", F.explode_outer(F.flatten(F.transform(probed, blocks))))
        .select("*", "_probe.*")
        .withColumn("_salt", F.pmod(F.xxhash64("meeting_id", "speaker_id"), F.lit(PROFILE_SALTS)).cast("int"))
        .join(packed, ["_pivot", "_ring", "_block", "_salt"], "left")
    )
    found = F.array_min(F.transform("_people", measured))
    return (
        faced.withColumns(
            {
                "_found": F.least(found, F.col("_best")),
                "_n": F.when(F.col("_people").isNotNull(), F.size("_people")).otherwise(0),
            }
        )
        .groupBy("meeting_id", "speaker_id", "embedding")
        .agg(
            F.any_value("_norm").alias("_norm"),
            F.any_value("_angles").alias("_angles"),
            F.min("_found").alias("_best"),
            (F.any_value("_pairs") + F.sum("_n")).alias("_pairs"),
        )
    )


def _nearest_people(speakers: DataFrame, profiles: DataFrame, limit: float) -> DataFrame:
    """The best person of each voice among those the limit leaves possible, and the pairs compared."""
    packed, cells, pivots = _indexed_people(profiles)
    spark = speakers.sparkSession
    index = spark.createDataFrame([(cells,)], "_cells array<struct<_pivot int, _ring int, _blocks int>>")
    angles = _angles(pivots)(F.col("embedding")) if pivots else F.array().cast("array<double>")
    best = "struct<distance: double, pos: {}, profile_id: {}, name: {}>".format(
        *(profiles.schema[c].dataType.simpleString() for c in ("profile_pos", "profile_id", "name"))
    )
    voices = speakers.select("meeting_id", "speaker_id", "embedding").withColumns(
        {
            "_norm": vec.norm(F.col("embedding")),
            "_angles": angles,
            "_best": F.lit(None).cast(best),
            "_pairs": F.lit(0).cast("long"),
        }
    )

    def within(cell: Column, reach: Column) -> Column:
        angle = F.get(F.col("_angles"), cell["_pivot"])
        return (angle + reach >= cell["_ring"] * RING) & (angle - reach < (cell["_ring"] + 1) * RING)

    home = F.coalesce(_nearest_pivot(F.col("_angles"))["i"], F.lit(-1))

    def asked(rows: DataFrame, others: bool) -> DataFrame:
        bound = F.least(F.lit(float(limit)), F.coalesce(F.col("_best.distance"), F.lit(float(limit))))

        def wanted(cell: Column) -> Column:
            near = within(cell, F.col("_reach"))
            if others:
                return F.col("_direction") & (cell["_pivot"] >= 0) & (cell["_pivot"] != F.col("_home")) & near
            return F.col("_direction") & ((cell["_pivot"] < 0) | ((cell["_pivot"] == F.col("_home")) & near))

        ready = (
            rows.crossJoin(F.broadcast(index))  # one row
            .withColumns({"_direction": _has_direction(F.col("embedding")), "_home": home, "_reach": _reach(bound)})
            .withColumn("_probes", F.filter("_cells", wanted))
            .drop("_cells", "_direction", "_home", "_reach")
        )
        return _compared(ready, packed, F.col("_probes"))

    nearest = asked(voices, others=False)
    return asked(nearest, others=True) if pivots else nearest


def suggest_profile(
    speakers: DataFrame, profiles: DataFrame, limit: float = SUGGESTION_DISTANCE
) -> DataFrame:
    """The nearest enrolled person of each voice within ``limit``, first enrolled on ties.

    A cosine distance is an angle, and angles keep the triangle inequality: a
    person whose angle to a pivot differs from the voice's by more than the angle
    of the limit is too far. So people are kept by nearest pivot and ring around
    it, and a voice meets, by a salted equi-join, the rings of its own pivot
    within reach first, then those of the others within reach of the best it has.
    Up to PROFILE_BLOCK people are one block without pivots. The result is the
    same as of comparing all; ``limit`` is at most 2.
    """
    nearest = _nearest_people(speakers, profiles, limit)
    nearest = nearest.groupBy("meeting_id", "speaker_id").agg(F.min("_best").alias("_best"))
    near = F.col("_best.distance") <= limit
    return nearest.select(
        "meeting_id",
        "speaker_id",
        F.when(near, F.col("_best.profile_id")).alias("profile_id"),
        F.when(near, F.col("_best.name")).alias("name"),
        F.when(near, F.col("_best.distance")).alias("distance"),
    )


def suggestion_work(
    speakers: DataFrame, profiles: DataFrame, limit: float = SUGGESTION_DISTANCE
) -> DataFrame:
    """One row: pairs of a voice and a person that suggestions compare."""
    return _nearest_people(speakers, profiles, limit).agg(
        F.coalesce(F.sum("_pairs"), F.lit(0)).alias("compared")
    )


def profile_detail(sample_count: Column, updated_at: Column) -> Column:
    meetings = F.when(sample_count == 1, F.lit("1 recording")).otherwise(
        F.concat(sample_count.cast("string"), F.lit(" recordings"))
    )
    return F.concat(meetings, F.lit(" · last heard "), F.date_format(updated_at, "yyyy-MM-dd"))


def vector_compare(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Cosine similarity and largest absolute difference of two vector columns."""
    a, b = F.col(left), F.col(right)
    return pairs.withColumns(
        {
            "cosine": F.lit(1.0) - vec.cosine_distance(a, b),
            "max_difference": vec.max_abs_difference(a, b),
        }
    )
