"""File listings, digests and the stored snapshot of the library."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.library import upserted
from colloquy.session import new_path, settle

#: Bytes of a file that are in memory at a time.
PIECE_BYTES = 4 << 20


def _tasks(spark: SparkSession) -> int:
    # A number that is given is kept: names are few bytes, and would be coalesced.
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a tree, empty ones too: path below the folder, length, modified.

    (Spark's file sources leave out empty files.) Executors list the folders of
    one depth at a time. Names that begin with a dot or an underscore are not listed.
    """

    def listing(batches):
        files, root = fs.FileSystem.from_uri(folder)
        root = root.rstrip("/")
        for batch in batches:
            for at in batch["path"].to_pylist():
                found = files.get_file_info(fs.FileSelector(f"{root}/{at}".rstrip("/")))
                found = [f for f in found if not f.base_name.startswith((".", "_"))]
                changed = pa.array([f.mtime_ns // 1000 for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{at}/{f.base_name}".lstrip("/") for f in found], pa.string()),
                        pa.array([f.type == fs.FileType.Directory for f in found], pa.bool_()),
                        pa.array([f.size for f in found], pa.int64()),
                        changed.cast(pa.timestamp("us", "UTC")),
                    ],
                    ["path", "is_folder", "length", "modified"],
                )

    schema = "path string, is_folder boolean, length long, modified timestamp"
    folders, found = spark.createDataFrame([("",)], "path string"), None
    while found is None or not folders.isEmpty():
        level = settle(folders.repartition(_tasks(spark), "path").mapInArrow(listing, schema), "listing")
        found = level if found is None else found.unionByName(level)
        folders = level.where("is_folder").select("path")
    return found.where(~F.col("is_folder")).drop("is_folder")


def digest_files(spark: SparkSession, folder: str, piece: int = PIECE_BYTES) -> DataFrame:
    """SHA-256 and length of every file of a tree: path, digest, length.

    Tasks get names, dealt by hash, and read the files in pieces of ``piece``
    bytes, so no file is ever a row or whole in memory. A digest runs through its
    file from front to back: a file is one task's work, however long.
    """
    listed = list_files(spark, folder).select("path")

    def digest(batches):
        files, root = fs.FileSystem.from_uri(folder)
        root = root.rstrip("/")
        for batch in batches:
            digests, lengths = [], []
            for name in batch["path"].to_pylist():
                state, length = hashlib.sha256(), 0
                with files.open_input_stream(f"{root}/{name}", buffer_size=0) as source:
                    while read := source.read(piece):
                        state.update(read)
                        length += len(read)
                digests.append(state.hexdigest())
                lengths.append(length)
            yield pa.RecordBatch.from_arrays(
                [batch["path"], pa.array(digests, pa.string()), pa.array(lengths, pa.int64())],
                ["path", "digest", "length"],
            )

    return listed.repartition(_tasks(spark), "path").mapInArrow(digest, "path string, digest string, length long")


def put_files(named: DataFrame, folder: str) -> None:
    """Writes each row (name, text) as a file of that name, in place of one that is there.

    A task writes beside the file and moves it when it is whole. A name may have
    folders in it.
    """

    def put(batches):
        files, root = fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            for name, text in zip(batch["name"].to_pylist(), batch["text"].to_pylist()):
                parent = f"{root}/{name}".rpartition("/")[0]
                if parent not in made:
                    files.create_dir(parent, recursive=True)
                    made.add(parent)
                beside = f"{root}/_{uuid.uuid4().hex}"
                with files.open_output_stream(beside) as out:
                    out.write(text.encode())
                files.move(beside, f"{root}/{name}")
            yield batch.select(["name"])

    named.select("name", "text").mapInArrow(put, "name string").write.format("noop").mode("overwrite").save()


def remove_files(names: DataFrame, folder: str) -> None:
    """Removes the files (name) of a folder; one that is not there is no failure."""

    def remove(batches):
        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["name"].to_pylist():
                if files.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                    files.delete_file(f"{root}/{name}")
            yield batch

    names.select("name").mapInArrow(remove, "name string").write.format("noop").mode("overwrite").save()


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("meeting_id"), F.lit(buckets))


def write_snapshot(meetings: DataFrame, path: str, buckets: int = 16) -> None:
    """Stores meetings in bucket folders, so a change rewrites only its bucket.

    Range partitioning splits a bucket over as many tasks as its rows need.
    """
    (
        meetings.withColumn("bucket", _bucket(buckets))
        .repartitionByRange("bucket", "meeting_id")
        .write.partitionBy("bucket")
        .parquet(path)
    )


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("meeting_id IS NOT NULL").drop("bucket")


def upsert_snapshot(
    spark: SparkSession, path: str, changes: DataFrame, deletes: DataFrame, buckets: int = 16
) -> None:
    """Rewrites the buckets that changed meetings fall into; the others stay untouched.

    The rewritten rows are written beside the snapshot first: a file cannot be
    read and overwritten in one job. Each rewritten bucket also gets a row
    without a meeting, so one that lost its last meeting is overwritten too.
    """
    touched = (
        changes.select("meeting_id")
        .unionByName(deletes.select("meeting_id"))
        .select(_bucket(buckets).alias("bucket"))
        .distinct()
    )
    old = spark.read.parquet(path)
    # At most one row per bucket.
    stored = old.join(F.broadcast(touched), "bucket", "left_semi").drop("bucket")
    after = upserted(
        stored.where("meeting_id IS NOT NULL"), changes.select(*stored.columns), deletes
    )
    beside = new_path(spark, "snapshot-next")
    (
        after.withColumn("bucket", _bucket(buckets))
        .unionByName(touched, allowMissingColumns=True)
        .write.parquet(beside)
    )
    (
        spark.read.parquet(beside)
        .repartitionByRange("bucket", "meeting_id")
        .write.partitionBy("bucket")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )
