"""The stored library as versions: a change appends rows in proportion to itself.

A store is a folder. ``data`` holds written tables, in folders by bucket of the
meeting; ``versions`` holds one small JSON file for each version, which names the
tables that make it up: a base table for each bucket, and the changes since. A
writer first writes its rows and moves the version's file into place last, so a
writer that dies leaves the store as it was, and readers of an older version
are not disturbed. Reading merges: of a meeting the newest change counts.

Tables that no version names, or only old ones, are not removed here.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of a change besides those of a meeting.
VERSION, GONE = "_version", "_gone"


class VersionConflict(RuntimeError):
    """Someone else wrote the version that was to be written."""


@dataclass(frozen=True)
class Version:
    """What a version's file says.

    ``base`` has the table of each bucket that has one; ``changes`` has, oldest
    first, [table, buckets] with the buckets whose base does not hold the change.
    """

    number: int
    schema: str
    buckets: int
    base: dict[int, str] = field(default_factory=dict)
    changes: list[tuple[str, list[int]]] = field(default_factory=list)

    def columns(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))


def _versions(root: str):
    files, at = fs.FileSystem.from_uri(root)
    return files, f"{at}/versions"


def _version_file(folder: str, number: int) -> str:
    return f"{folder}/{number:012}.json"


def current_number(root: str) -> int:
    """The newest version's number, 0 for none."""
    files, folder = _versions(root)
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    numbers = [int(f.base_name[:12]) for f in found if f.base_name.endswith(".json") and f.base_name[:12].isdigit()]
    return max(numbers, default=0)


def load_version(root: str, number: int | None = None) -> Version:
    """A version's file, the newest one's by default."""
    files, folder = _versions(root)
    number = current_number(root) if number is None else number
    with files.open_input_stream(_version_file(folder, number)) as source:
        said = json.loads(source.read())
    return Version(
        number,
        said["schema"],
        said["buckets"],
        {int(b): path for b, path in said["base"].items()},
        [(path, held) for path, held in said["changes"]],
    )


def publish(root: str, version: Version) -> Version:
    """Moves the version's file into place, the last step of every change."""
    files, folder = _versions(root)
    files.create_dir(folder, recursive=True)
    place = _version_file(folder, version.number)
    if files.get_file_info(place).type != fs.FileType.NotFound:
        raise VersionConflict(f"version {version.number} of {root} is there already")
    said = {"schema": version.schema, "buckets": version.buckets, "base": version.base, "changes": version.changes}
    beside = f"{folder}/_{uuid.uuid4().hex}"
    with files.open_output_stream(beside) as out:
        out.write(json.dumps(said).encode())
    files.move(beside, place)
    return version


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("meeting_id"), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, root: str, buckets: int) -> tuple[str, list[int]]:
    """Writes rows by bucket; the table's path within the store and its buckets."""
    table = f"data/{uuid.uuid4().hex}"
    (
        rows.withColumn("_bucket", _bucket(buckets))
        .repartitionByRange("_bucket", "meeting_id")
        .write.partitionBy("_bucket")
        .parquet(f"{root}/{table}")
    )
    files, at = fs.FileSystem.from_uri(root)
    made = [f.base_name for f in files.get_file_info(fs.FileSelector(f"{at}/{table}"))]
    return table, sorted(int(name.split("=")[1]) for name in made if name.startswith("_bucket="))


def create_store(meetings: DataFrame, root: str, buckets: int = 64) -> Version:
    """The first version: these meetings, ids once each."""
    table, held = _write(meetings, root, buckets)
    return publish(root, Version(1, meetings.schema.json(), buckets, {b: table for b in held}))


def commit(root: str, changes: DataFrame, deletes: DataFrame) -> Version:
    """A version with ``changes`` put in place of meetings of their ids, or added, and ``deletes`` gone.

    Only these rows are written. ``changes`` has the store's columns and an id
    once; an id in both goes; deleting an id that is not there is no failure.
    """
    old = load_version(root)
    new = old.number + 1
    columns = old.columns().fieldNames()
    gone = deletes.select("meeting_id").distinct().withColumn(GONE, F.lit(True))
    kept = changes.select(*columns).join(gone.select("meeting_id"), "meeting_id", "left_anti")
    rows = kept.withColumn(GONE, F.lit(False)).unionByName(gone, allowMissingColumns=True)
    table, held = _write(rows.withColumn(VERSION, F.lit(new).cast("long")), root, old.buckets)
    changed = [*old.changes, (table, held)] if held else old.changes
    return publish(root, replace(old, number=new, changes=changed))


def _paths(root: str, parts: list[tuple[str, int]]) -> list[str]:
    return [f"{root}/{table}/_bucket={b}" for table, b in parts]


def _scan(spark: SparkSession, schema: StructType, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def _merged(spark: SparkSession, root: str, version: Version, chosen: list[int]) -> DataFrame:
    """The meetings of some buckets: one scan of their bases, one of their changes."""
    schema = version.columns()
    asked = set(chosen)
    base = _scan(spark, schema, _paths(root, [(t, b) for b, t in sorted(version.base.items()) if b in asked]))
    late = [(table, b) for table, held in version.changes for b in held if b in asked]
    if not late:
        return base
    marked = StructType(list(schema.fields)).add(GONE, "boolean").add(VERSION, "long")
    changes = _scan(spark, marked, _paths(root, late))
    # An id's changes are one row for each version since its bucket was compacted.
    newest = Window.partitionBy("meeting_id").orderBy(F.desc(VERSION))
    last = changes.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1")
    columns = schema.fieldNames()
    return (
        base.join(changes.select("meeting_id"), "meeting_id", "left_anti")
        .select(*columns)
        .unionByName(last.where(~F.col(GONE)).select(*columns))
    )


def read_store(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The meetings of a version, the newest by default."""
    version = load_version(root, number)
    return _merged(spark, root, version, list(range(version.buckets)))


def compact(spark: SparkSession, root: str, most_changes: int = 8) -> Version:
    """A version of the same meetings where no bucket has more than ``most_changes`` changes to merge.

    Buckets that have more are written anew with their changes folded in; the
    others keep their tables. Without such a bucket the store stays as it is.
    """
    old = load_version(root)
    count = [sum(b in held for _, held in old.changes) for b in range(old.buckets)]
    full = {b for b, n in enumerate(count) if n > most_changes}
    if not full:
        return old
    table, held = _write(_merged(spark, root, old, sorted(full)), root, old.buckets)
    base = {b: t for b, t in old.base.items() if b not in full} | {b: table for b in held}
    rest = [(t, [b for b in bs if b not in full]) for t, bs in old.changes]
    return publish(root, replace(old, number=old.number + 1, base=base, changes=[c for c in rest if c[1]]))
