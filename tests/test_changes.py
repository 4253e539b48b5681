"""Files that change in place, as a stream."""

import json
import os

from colloquy.sources.changes import ChangedFilesReader
from colloquy.streaming import runs


def write(path, *meetings, at=None):
    path.write_text("\n".join(json.dumps({"id": i, "schemaVersion": 1, "title": t}) for i, t in meetings))
    if at is not None:
        os.utime(path, (at, at))


def current(spark, folder, table):
    runs.ingest_library(spark, str(folder), table)
    return {(r.meeting_id, r.title) for r in runs.current_library(spark, table).collect()}


def test_only_the_newest_version_of_a_file_counts(spark, tmp_path):
    folder, table = tmp_path / "library", str(tmp_path / "table")
    (folder / "deep").mkdir(parents=True)
    write(folder / "a.json", ("1", "one"), ("2", "two"))
    write(folder / "deep" / "b.json", ("3", "three"))
    write(folder / "_hidden.json", ("9", "no"))
    write(folder / "c.txt", ("9", "no"))
    assert current(spark, folder, table) == {("1", "one"), ("2", "two"), ("3", "three")}
    # In place, and with an older time than before: it is another version all the same.
    write(folder / "a.json", ("1", "one again"), at=1_000_000_000)
    assert current(spark, folder, table) == {("1", "one again"), ("3", "three")}
    # Nothing new is no batch; a broken file and a file that is gone hold nothing.
    batches = len(os.listdir(table))
    assert current(spark, folder, table) == {("1", "one again"), ("3", "three")} and len(os.listdir(table)) == batches
    (folder / "a.json").write_text("{ no meeting")
    (folder / "deep" / "b.json").unlink()
    assert current(spark, folder, table) == set()
    write(folder / "deep" / "b.json", ("3", "back"))
    assert current(spark, folder, table) == {("3", "back")}


def test_a_meeting_in_two_files_is_that_of_the_newer(spark, tmp_path):
    folder, table = tmp_path / "library", str(tmp_path / "table")
    folder.mkdir()
    write(folder / "a.json", ("1", "old"), at=1_600_000_000)
    write(folder / "b.json", ("1", "new"), at=1_700_000_000)
    assert current(spark, folder, table) == {("1", "new")}
    write(folder / "b.json", ("2", "other"), at=1_700_000_001)
    assert current(spark, folder, table) == {("1", "old"), ("2", "other")}


def test_a_reader_goes_on_where_its_log_ends(tmp_path):
    folder = tmp_path / "library"
    folder.mkdir()
    options = {"path": str(folder), "log": str(tmp_path / "log"), "partitionbytes": "40"}
    for k in range(5):
        (folder / f"{k}.json").write_text("x" * 30)
    first = ChangedFilesReader(options)
    assert first.initialOffset() == {"version": 0} and first.latestOffset() == {"version": 1}
    assert len(first.partitions({"version": 0}, {"version": 1})) == 5  # one file each: two are over the bound
    (folder / "3.json").write_text("longer" * 9)
    (folder / "4.json").unlink()
    again = ChangedFilesReader(options)
    assert again.latestOffset() == {"version": 2} == again.latestOffset()
    changed = again.partitions({"version": 1}, {"version": 2})
    rows = [r for p in changed for b in again.read(p) for r in b.to_pylist()]
    assert [(os.path.basename(r["path"]), r["length"], r["content"]) for r in rows] == [
        ("3.json", 54, b"longer" * 9), ("4.json", None, None)
    ]
    # Repeated from the beginning, each file is read in its last version.
    assert sum(len(p.files) for p in again.partitions({"version": 0}, {"version": 2})) == 5
