"""Reading and writing transcripts as JSON and text documents."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions import text as tx
from colloquy.operators.library import unique_names
from colloquy.operators.render import documents
from colloquy.operators.speakers import roster_names
from colloquy.operators.translate import text_for_rendering
from colloquy.operators.trims import kept_turns
from colloquy.schema import EXPORT_FILE, SCHEMA_VERSION, SPAN_FILE, UNKNOWN_SPEAKER, languages
from colloquy.session import settle

STORED_MEETING = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("schemaVersion", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("importedAt", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField(
            "utterances",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("speakerId", T.StringType()),
                        T.StructField("start", T.DoubleType()),
                        T.StructField("end", T.DoubleType()),
                        T.StructField("text", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

ISO_DATE = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def scan_library(
    spark: SparkSession, folder: str, glob: str = "*.json"
) -> tuple[DataFrame, DataFrame]:
    """All stored meetings under a folder, and the files that could not be read.

    Hidden files are skipped by the file source. Newer schema versions are left
    alone. Returns ``(meetings, rejects)``.
    """
    schema = T.StructType([*STORED_MEETING.fields, T.StructField("_broken", T.StringType())])
    files = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_broken")
        .json(folder)
        .select(
            "*",
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
    )
    readable = F.col("_broken").isNull() & F.col("id").isNotNull() & (
        F.col("schemaVersion") <= SCHEMA_VERSION
    )
    meetings = (
        files.where(readable)
        .withColumnRenamed("id", "meeting_id")
        .drop("_broken")
    )
    rejects = files.where(~F.coalesce(readable, F.lit(False))).select(
        "path", F.col("_broken").isNotNull().alias("undecodable"), "schemaVersion"
    )
    return meetings, rejects


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``(source, content)``; a transcript file is one row."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").alias("content")
    )


def _usable_spans(spans: Column) -> Column:
    """Spans trimmed, put the right way round and sorted; ones without text left out."""
    cleaned = F.transform(
        spans,
        lambda s, i: F.struct(
            F.least(s["start"], s["end"]).alias("start"),
            i.alias("pos"),
            F.greatest(s["start"], s["end"]).alias("end"),
            F.when(tx.trimmed(s["speaker"]) == "", F.lit(UNKNOWN_SPEAKER))
            .otherwise(tx.trimmed(s["speaker"]))
            .alias("speaker_id"),
            tx.trimmed(s["text"]).alias("text"),
        ),
    )
    return F.array_sort(F.filter(cleaned, lambda s: s["text"] != ""))


def _complete_spans(spans: Column) -> Column:
    return spans.isNotNull() & F.forall(
        spans,
        lambda s: s["text"].isNotNull()
        & s["start"].isNotNull()
        & s["end"].isNotNull()
        & s["speaker"].isNotNull(),
    )


def route_import(files: DataFrame) -> DataFrame:
    """Files ``(source, content)`` told apart by content, the stricter format first.

    Adds ``kind`` (``export``, ``spans`` or null), ``reason`` where refused and
    the parsed ``export`` / ``spans``.
    """
    parsed = files.withColumns(
        {
            "export": F.from_json("content", EXPORT_FILE),
            "_texts": F.from_json("content", SPAN_FILE)["texts"],
        }
    )
    known = F.broadcast(
        languages(files.sparkSession).select(
            F.col("language").alias("_language"), F.lit(True).alias("_known")
        )
    )
    parsed = parsed.join(known, F.col("export.language") == F.col("_language"), "left")
    e = F.col("export")
    is_export = (
        e["title"].isNotNull()
        & e["duration"].isNotNull()
        & e["importedAt"].isNotNull()
        & e["language"].isNotNull()
        & e["speakers"].isNotNull()
        & e["transcript"].isNotNull()
    )
    is_export = F.coalesce(is_export, F.lit(False))
    speaks = F.exists(e["transcript"], lambda t: tx.trimmed(t["text"]) != "")
    is_spans = ~is_export & F.coalesce(_complete_spans(F.col("_texts")), F.lit(False))
    spans = F.when(is_spans, _usable_spans(F.col("_texts")))
    reason = (
        F.when(F.col("content").isNull(), "unreadable")
        .when(is_export & F.col("_known").isNull(), "unrecognizedFormat")
        .when(is_export & ~F.coalesce(speaks, F.lit(False)), "noSpeech")
        .when(is_export, None)
        .when(~is_spans, "unrecognizedFormat")
        .when(F.size("spans") == 0, "noSpeech")
    )
    return (
        parsed.withColumn("spans", spans)
        .withColumn("reason", reason)
        .withColumn(
            "kind",
            F.when(F.col("reason").isNotNull(), None).when(is_export, "export").otherwise("spans"),
        )
        .drop("_texts", "_language", "_known")
    )


def span_turns(routed: DataFrame) -> DataFrame:
    """Turns of span files, one per span, in order of start and file position."""
    return (
        routed.where("kind = 'spans'")
        .select(F.col("source").alias("meeting_id"), F.posexplode("spans").alias("span_idx", "s"))
        .select(
            "meeting_id",
            F.col("span_idx").cast("long").alias("span_idx"),
            "s.speaker_id",
            "s.start",
            "s.end",
            "s.text",
        )
    )


def export_turns(routed: DataFrame) -> DataFrame:
    """Turns of export files; an edited turn has no timings left to import."""
    return (
        routed.where("kind = 'export'")
        .select(
            F.col("source").alias("meeting_id"),
            F.posexplode("export.transcript").alias("turn_idx", "t"),
        )
        .select(
            "meeting_id",
            F.col("turn_idx").cast("long").alias("turn_idx"),
            F.col("t.speakerId").alias("speaker_id"),
            F.col("t.speaker").alias("speaker"),
            "t.start",
            "t.end",
            "t.text",
            F.when(~F.col("t.isEdited"), F.col("t.words")).alias("words"),
            F.col("t.isEdited").alias("is_edited"),
            F.col("t.translatedText").alias("translated_text"),
        )
    )


def export_speakers(routed: DataFrame) -> DataFrame:
    """Rosters of export files as written; ``named`` may be null in older ones."""
    return (
        routed.where("kind = 'export'")
        .select(
            F.col("source").alias("meeting_id"),
            F.posexplode("export.speakers").alias("roster_pos", "s"),
        )
        .select(
            "meeting_id",
            "roster_pos",
            F.col("s.id").alias("speaker_id"),
            F.col("s.name").alias("name"),
            F.col("s.named").alias("named"),
            F.col("s.totalDuration").alias("total_duration"),
            F.col("s.side").alias("side"),
        )
    )


def _json(fields: Column) -> Column:
    return F.to_json(fields, {"ignoreNullFields": "true"})


def json_blocks(
    turns: DataFrame, meetings: DataFrame, speakers: DataFrame, translations: DataFrame
) -> DataFrame:
    """A published JSON document per meeting as a head, one block per turn and a tail.

    Keys are sorted, absent ones left out, voices never written. The texts of a
    meeting's blocks in order are one JSON document.
    """
    roster = speakers.groupBy("meeting_id").agg(
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "roster_pos",
                        F.struct(
                            F.col("speaker_id").alias("id"),
                            "name",
                            F.col("is_named").alias("named"),
                            "side",
                            F.col("total_duration").alias("totalDuration"),
                        ).alias("s"),
                    )
                )
            ),
            lambda r: r["s"],
        ).alias("speakers")
    )
    spoken = kept_turns(turns, meetings)
    bounds = spoken.groupBy("meeting_id").agg(
        F.min("turn_idx").alias("_first"), F.max("turn_idx").alias("_last")
    )
    facts = meetings.join(roster, "meeting_id", "left").join(bounds, "meeting_id", "left")
    head_json = _json(
        F.struct(
            "degraded",
            "duration",
            F.when(F.col("fast"), F.lit(True)).alias("fastTranscribed"),
            F.date_format("imported_at", ISO_DATE).alias("importedAt"),
            "language",
            "model",
            F.coalesce("speakers", F.array().cast(speakers_type(roster))).alias("speakers"),
            "title",
        )
    )
    tail_json = _json(
        F.struct(
            F.when(
                F.col("target").isNotNull(),
                F.struct(
                    F.col("language").alias("from"),
                    F.col("target").alias("to"),
                    F.date_format("imported_at", ISO_DATE).alias("translatedAt"),
                ),
            ).alias("translation"),
            F.when(
                F.col("kept_start").isNotNull(),
                F.struct(F.col("kept_end").alias("end"), F.col("kept_start").alias("start")),
            ).alias("trimmedTo"),
        )
    )
    edges = facts.select(
        "meeting_id",
        F.inline(
            F.array(
                F.struct(
                    F.lit(0).cast("long").alias("block"),
                    F.concat(
                        F.regexp_replace(head_json, r"\}$", ""), F.lit(',"transcript":[')
                    ).alias("text"),
                ),
                F.struct(
                    (F.coalesce("_last", F.lit(0)) + 2).cast("long").alias("block"),
                    F.when(tail_json == "{}", F.lit("]}"))
                    .otherwise(F.concat(F.lit("],"), F.regexp_replace(tail_json, r"^\{", "")))
                    .alias("text"),
                ),
            )
        ),
    )
    rows = text_for_rendering(roster_names(spoken, speakers), translations).join(
        bounds.select("meeting_id", "_first"), "meeting_id"
    )
    turn_json = _json(
        F.struct(
            "end",
            F.col("is_edited").alias("isEdited"),
            F.col("speaker_name").alias("speaker"),
            F.col("speaker_id").alias("speakerId"),
            "start",
            "text",
            F.col("translated_text").alias("translatedText"),
            F.transform(
                "words",
                lambda w: F.struct(
                    w["end"].alias("end"), w["start"].alias("start"), w["word"].alias("word")
                ),
            ).alias("words"),
        )
    )
    body = rows.select(
        "meeting_id",
        (F.col("turn_idx") + 1).alias("block"),
        F.concat(
            F.when(F.col("turn_idx") > F.col("_first"), F.lit(",")).otherwise(F.lit("")), turn_json
        ).alias("text"),
    )
    return edges.unionByName(body)


def speakers_type(roster: DataFrame) -> T.DataType:
    return roster.schema["speakers"].dataType


def output_name(title: Column, extension: str, target_name: Column | None = None) -> Column:
    """``title.ext``, with the language of a translated document in brackets."""
    if target_name is None:
        return F.concat(title, F.lit(f".{extension}"))
    return F.concat(
        title,
        F.when(target_name.isNotNull(), F.concat(F.lit(" ("), target_name, F.lit(")"))).otherwise(
            F.lit("")
        ),
        F.lit(f".{extension}"),
    )


def document_names(meetings: DataFrame, extension: str, translated: bool) -> DataFrame:
    """``(meeting_id, file_name)``: the titles, safe as names and each given once.

    Of equal names the meeting imported first keeps its own.
    """
    names = F.broadcast(languages(meetings.sparkSession)).select(
        F.col("language").alias("target"), F.col("display_name").alias("_name")
    )
    named = meetings.join(names, "target", "left") if translated else meetings.withColumn(
        "_name", F.lit(None).cast("string")
    )
    stem = output_name(tx.sanitize_name(F.col("title")), extension, F.col("_name"))
    stems = named.select(
        F.col("meeting_id").alias("item_id"),
        F.lit("").alias("folder"),
        F.regexp_replace(stem, r"\.[^.]*\z", "").alias("name"),
        "imported_at",
    )
    day = F.to_date("imported_at")
    given = unique_names(stems, [F.col("imported_at"), F.col("item_id")], F.unix_date(day))
    return given.select(
        F.col("item_id").alias("meeting_id"),
        F.concat("unique_name", F.lit(f".{extension}")).alias("file_name"),
    )


def write_documents(blocks: DataFrame, names: DataFrame, path: str) -> DataFrame:
    """Writes each document as one file of its name under ``path``, a folder all executors share.

    ``names(meeting_id, file_name)``. A task writes beside the file and moves it
    when it is whole, so a repeated task leaves the same. Returns what was
    written: ``(meeting_id, file_name, bytes)``.
    """

    def write(batches):
        files, folder = fs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        for batch in batches:
            sizes = []
            for name, text in zip(batch["file_name"].to_pylist(), batch["text"].to_pylist()):
                raw = text.encode()
                beside = f"{folder}/_{uuid.uuid4().hex}"
                with files.open_output_stream(beside) as out:
                    out.write(raw)
                files.move(beside, f"{folder}/{name}")
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays(
                [batch["meeting_id"], batch["file_name"], pa.array(sizes, pa.int64())],
                ["meeting_id", "file_name", "bytes"],
            )

    named = documents(blocks).join(names, "meeting_id").select("meeting_id", "file_name", "text")
    written = named.mapInArrow(write, "meeting_id string, file_name string, bytes long")
    return settle(written, "written")
