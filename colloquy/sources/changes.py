"""A streaming source of files as they are now: new ones, ones changed in place, ones gone.

Spark's own file source remembers paths and never reads one again. This one
remembers each path's modification time and size. What changed since the last
listing is written to a log, and an offset is a number of log entries, so a
batch that is repeated after a failure is the same batch.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Readers are loaded in processes that do not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of files that one task reads; a larger file is alone.
PARTITION_BYTES = 64 << 20
#: Bytes of files in one Arrow batch.
BATCH_BYTES = 8 << 20

SCHEMA = "path string, modified timestamp, length long, content binary"


class FilesPartition(InputPartition):
    def __init__(self, files: list[tuple[str, int, int | None]]):
        self.files = files


class ChangedFilesReader(DataSourceStreamReader):
    """Options: ``path``, ``glob`` for file names, ``log`` for a folder of its own.

    All of them may be URIs that Arrow's file systems know. Names that begin
    with a dot or an underscore are not read.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.log = options["path"], options["log"]
        self.glob = options.get("glob", "*")
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.known: dict[str, tuple[int, int]] | None = None
        self.version = 0

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        self._load()
        now = self._listing()
        changed = [[p, m, n] for p, (m, n) in sorted(now.items()) if self.known.get(p) != (m, n)]
        changed += [[p, self.known[p][0], None] for p in sorted(set(self.known) - set(now))]
        if changed:
            self._write(self.version + 1, changed)
            self.known, self.version = now, self.version + 1
        return {"version": self.version}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # Of a file that changed twice the last version is the one there is to read.
        changed: dict[str, tuple[int, int | None]] = {}
        for version in range(start["version"] + 1, end["version"] + 1):
            for path, modified, length in self._read(version):
                changed[path] = (modified, length)
        out: list[InputPartition] = []
        files: list[tuple[str, int, int | None]] = []
        size = 0
        for path, (modified, length) in sorted(changed.items()):
            if files and size + (length or 0) > self.partition_bytes:
                out.append(FilesPartition(files))
                files, size = [], 0
            files.append((path, modified, length))
            size += length or 0
        return [*out, FilesPartition(files)] if files else out

    def read(self, partition: FilesPartition) -> Iterator[pa.RecordBatch]:
        """The files' content; a null one where the file is gone."""
        files, _ = fs.FileSystem.from_uri(self.path)
        rows: list[tuple] = []
        size = 0
        for path, modified, length in partition.files:
            content = None
            if length is not None:
                try:
                    with files.open_input_stream(path) as file:
                        content = file.read()
                except FileNotFoundError:
                    continue  # gone since: the next listing says so
            rows.append((path, modified // 1000, length, content))
            size += length or 0
            if size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def commit(self, end: dict) -> None:
        pass

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        path, modified, length, content = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(path, pa.string()), pa.array(modified, pa.timestamp("us", "UTC")),
                pa.array(length, pa.int64()), pa.array(content, pa.binary()),
            ],
            ["path", "modified", "length", "content"],
        )

    def _listing(self) -> dict[str, tuple[int, int]]:
        files, root = fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        return {
            f.path: (f.mtime_ns, f.size)
            for f in found
            if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and fnmatch(f.base_name, self.glob)
        }

    def _load(self) -> None:
        """What the log knows, replayed once for each start of the stream."""
        if self.known is not None:
            return
        self.known = {}
        files, root = fs.FileSystem.from_uri(self.log)
        files.create_dir(root, recursive=True)
        while files.get_file_info(f"{root}/{self.version + 1}.json").type == fs.FileType.File:
            self.version += 1
            for path, modified, length in self._read(self.version):
                if length is None:
                    self.known.pop(path, None)
                else:
                    self.known[path] = (modified, length)

    def _write(self, version: int, changed: list) -> None:
        files, root = fs.FileSystem.from_uri(self.log)
        beside = f"{root}/_{uuid.uuid4().hex}"
        with files.open_output_stream(beside) as out:
            for entry in changed:
                out.write(json.dumps(entry).encode() + b"\n")
        files.move(beside, f"{root}/{version}.json")

    def _read(self, version: int) -> list:
        files, root = fs.FileSystem.from_uri(self.log)
        with files.open_input_stream(f"{root}/{version}.json") as file:
            return [json.loads(line) for line in file.read().splitlines()]


class ChangedFiles(DataSource):
    """``spark.readStream.format("changed_files")``; a file is one row, again whenever it changes."""

    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChangedFilesReader:
        return ChangedFilesReader(dict(self.options))
