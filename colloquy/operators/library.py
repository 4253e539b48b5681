"""The stored library: newest files, folders, names, audits and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.plans.scan import ordinal, position_chunk, running


def newest_file(files: DataFrame) -> DataFrame:
    """One row per meeting id: latest modification, then the first path scanned."""
    rest = [c for c in files.columns if c != "meeting_id"]
    order = F.struct((-F.unix_micros("modified")).alias("m"), F.col("path").alias("p"))
    return files.groupBy("meeting_id").agg(
        F.min_by(F.struct(*rest), order).alias("_row")
    ).select("meeting_id", "_row.*")


def folder_rollup(library: DataFrame) -> DataFrame:
    """Meetings per folder, those in folders below it included."""
    prefixes = F.transform(
        F.sequence(F.lit(0), F.size("folder")), lambda n: F.slice("folder", F.lit(1), n)
    )
    return (
        library.select(F.explode(prefixes).alias("folder"))
        .groupBy("folder")
        .agg(F.count("*").alias("meetings"))
    )


def folder_bytes(files: DataFrame) -> DataFrame:
    """Bytes under each directory, whole subtrees; ``files(path, length)``."""
    parts = F.split("path", "/", -1)
    depth = F.size(parts) - 1
    folders = F.transform(
        F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    return (
        files.where(depth >= 1)
        .select(F.explode(folders).alias("folder"), "length")
        .groupBy("folder")
        .agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))
    )


def checksum_audit(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files against the digests they should have.

    ``files(path, digest)``, ``manifest(component, path, expected)``. Status is
    ``ok``, ``changed``, ``missing`` or ``unlisted``.
    """
    status = (
        F.when(F.col("expected").isNull(), "unlisted")
        .when(F.col("digest").isNull(), "missing")
        .when(F.col("digest") == F.col("expected"), "ok")
        .otherwise("changed")
    )
    return files.join(manifest, "path", "full_outer").select(
        "path", "component", status.alias("status")
    )


def complete_components(audit: DataFrame) -> DataFrame:
    """Components all of whose files are as they should be."""
    return (
        audit.where("component IS NOT NULL")
        .groupBy("component")
        .agg(F.bool_and(F.col("status") == "ok").alias("complete"))
    )


def unique_names(items: DataFrame, order: list[Column], chunk: Column) -> DataFrame:
    """Names made unique per folder without case: ``name``, ``name 2``, ``name 3`` …

    ``items(item_id, folder, name)``. The first of a name keeps it, and literal
    names like ``name 2`` are never given out, so one pass suffices: the j-th
    repeat takes the j-th number from 2 up that no literal name holds.
    """
    keyed = items.withColumn("_key", F.lower("name"))
    group = ["folder", "_key"]
    ranked = ordinal(keyed, group, chunk, order, "_rank")

    # Numbers already held: "base n" is in use wherever a group of that name exists.
    held = (
        ranked.where("_rank = 0")
        .where(F.col("_key").rlike(r"^.+ ([2-9]|[1-9][0-9]{1,17})$"))
        .select(
            "folder",
            F.regexp_extract("_key", r"^(.+) ([0-9]+)$", 1).alias("_key"),
            F.regexp_extract("_key", r"^(.+) ([0-9]+)$", 2).cast("long").alias("_n"),
        )
    )
    # The j-th repeat skips every held number t_i (i from 0) with t_i - i <= j + 1.
    placed = ordinal(held, group, position_chunk("_n"), [F.col("_n")], "_i")
    skips = (
        placed.withColumn("_x", F.col("_n") - F.col("_i"))
        .groupBy(*group, "_x")
        .agg(F.count("*").alias("_skip"))
        .withColumn("_kind", F.lit(0))
    )
    repeats = ranked.where("_rank > 0").withColumns(
        {"_x": F.col("_rank") + 1, "_kind": F.lit(1), "_skip": F.lit(0).cast("long")}
    )
    numbered = running(
        repeats.unionByName(skips, allowMissingColumns=True),
        group,
        position_chunk("_x"),
        [F.col("_x"), F.col("_kind")],
        {"_skipped": ("sum", F.col("_skip"))},
    ).where("_kind = 1")
    renamed = numbered.withColumn(
        "unique_name",
        F.concat("name", F.lit(" "), (F.col("_rank") + 1 + F.col("_skipped")).cast("string")),
    )
    first = ranked.where("_rank = 0").withColumn("unique_name", F.col("name"))
    columns = [*items.columns, "unique_name"]
    return first.select(*columns).unionByName(renamed.select(*columns))


def natural_key(path: Column) -> Column:
    """Sort key that puts parents first and ``Folder 2`` before ``Folder 10``.

    A number stands as how many digits it has, and these.
    """

    def run(part: Column) -> Column:
        digits = F.regexp_replace(part, r"^0+(?=[0-9])", "")
        length = F.lpad(F.length(digits).cast("string"), 10, "0")
        return F.when(part.rlike(r"^[0-9]"), F.concat(length, digits)).otherwise(part)

    runs = lambda part: F.regexp_extract_all(F.lower(part), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.transform(path, lambda part: F.array_join(F.transform(runs(part), run), ""))


def folder_order(folders: DataFrame) -> DataFrame:
    """Folders in display order."""
    return folders.orderBy(natural_key(F.col("folder")), "folder")


def library_order(meetings: DataFrame) -> DataFrame:
    """Meetings newest first."""
    return meetings.orderBy(F.desc("imported_at"), "meeting_id")


def duplicate_recordings(meetings: DataFrame) -> DataFrame:
    """Meetings made from the same recording as another one."""
    shared = (
        meetings.where("audio_path <> ''")
        .groupBy("audio_path")
        .agg(F.count("*").alias("copies"))
        .where("copies > 1")
    )
    return meetings.join(shared, "audio_path")


def upserted(snapshot: DataFrame, changes: DataFrame, deletes: DataFrame) -> DataFrame:
    """Snapshot with changed meetings replaced or added and deleted ones gone."""
    return (
        snapshot.join(changes.select("meeting_id"), "meeting_id", "left_anti")
        .unionByName(changes)
        .join(deletes.select("meeting_id"), "meeting_id", "left_anti")
    )


def meeting_stats(turns: DataFrame, meetings: DataFrame) -> DataFrame:
    """Words, seconds, coverage, speakers and turns per meeting."""
    spoken = F.aggregate(
        "words", F.lit(0.0), lambda acc, w: acc + (w["end"] - w["start"])
    )
    facts = turns.groupBy("meeting_id").agg(
        F.sum(F.coalesce(F.size("words"), F.lit(0))).cast("long").alias("n_words"),
        F.sum(F.coalesce(spoken, F.lit(0.0))).alias("word_seconds"),
        F.sum(F.col("end") - F.col("start")).alias("turn_seconds"),
        F.count_distinct("speaker_id").alias("n_speakers"),
        F.count("*").alias("n_turns"),
    )
    return facts.join(meetings.select("meeting_id", "duration"), "meeting_id").withColumn(
        "covered", F.col("turn_seconds") / F.col("duration")
    )
