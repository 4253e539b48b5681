"""Driving streams to tables: incremental library reads, incremental translation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.library import newest_file
from colloquy.operators.translate import apply_lines, translate_with, untranslated_turns
from colloquy.session import new_path
from colloquy.sources.changes import ChangedFiles
from colloquy.sources.documents import STORED_MEETING

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over what is there now; every emitted row with its ``batch``.

    In update mode a key may come again; its row with the highest batch is the
    current one.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    path = new_path(spark, name)
    schema = stream.withColumn("batch", F.lit(0).cast("long")).schema
    # A stream without any files has no batch; its table is there all the same.
    spark.createDataFrame([], schema).write.parquet(f"{path}/emitted/run=-1")

    def store(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(
            f"{path}/emitted/run={batch}"
        )

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/emitted").drop("run")


def ingest_library(spark: SparkSession, folder: str, table: str, glob: str = "*.json", lines: bool = True) -> None:
    """Reads library files that are new, changed in place or gone into a table of versions.

    A file holds one meeting a line, or a single one where ``lines`` is false.
    Every version of a file leaves a row, also one without a readable meeting:
    it supersedes what the file held before. ``current_library`` is what counts
    now. A batch repeated after a failure overwrites its own rows.
    """
    spark.dataSource.register(ChangedFiles)
    files = (
        spark.readStream.format("changed_files")
        .option("path", folder)
        .option("glob", glob)
        .option("log", f"{table}-log")
        .load()
    )
    text = F.decode("content", "UTF-8")
    documents = F.split(text, "\n") if lines else F.array(text)
    some = F.filter(documents, lambda x: F.trim(x) != "")
    stream = (
        files.select("path", "modified", F.explode_outer(some).alias("_text"))
        .withColumn("_meeting", F.from_json("_text", STORED_MEETING))
        .select("path", "modified", "_meeting.*")
        .withColumnRenamed("id", "meeting_id")
    )

    def store(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table}/batch={batch}")

    query = (
        stream.writeStream.option("checkpointLocation", f"{table}-checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
    query.awaitTermination()


def current_library(spark: SparkSession, table: str) -> DataFrame:
    """The meetings of all files as they are now, from the table of their versions.

    Of a file its last version counts, of a meeting that several files hold the
    newest file.
    """
    versions = spark.read.parquet(table)
    last = versions.groupBy("path").agg(F.max("batch").alias("batch"))
    now = versions.join(last, ["path", "batch"]).where("meeting_id IS NOT NULL").drop("batch")
    return newest_file(now)


def fill_translations(
    turns: DataFrame,
    meetings: DataFrame,
    translations: DataFrame,
    translate: Callable[[str, str, pd.Series], pd.Series],
    name: str = "filled",
) -> DataFrame:
    """Translates turns of a stream batch by batch; what was finished stays on failure.

    ``turns`` is streaming, the other tables are static. Returns all lines.
    """
    spark = turns.sparkSession
    path = new_path(spark, name)

    def store(rows: DataFrame, batch: int) -> None:
        open_turns = untranslated_turns(rows, meetings, translations)
        translate_with(open_turns, translate).withColumn("seq", F.lit(batch)).write.mode(
            "overwrite"
        ).parquet(f"{path}/lines/run={batch}")

    query = (
        turns.writeStream.option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
    query.awaitTermination()
    schema = "meeting_id string, target string, turn_id string, text string, seq int"
    lines = spark.read.schema(schema).parquet(f"{path}/lines")
    return apply_lines(translations, lines, meetings)
