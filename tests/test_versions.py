"""A store of versions against a dictionary that the same changes are made to."""

import hashlib
import random
from pathlib import Path

import pytest

from colloquy.operators.library import folder_bytes
from colloquy.session import new_path
from colloquy.sources import files
from colloquy.sources import versions as vs

COLUMNS = "meeting_id string, title string, words array<string>"


def rows(spark, found):
    return spark.createDataFrame([(k, *v) for k, v in found.items()], COLUMNS)


def ids(spark, some):
    return spark.createDataFrame([(k,) for k in some], "meeting_id string")


def held(spark, root, number=None):
    got = vs.read_store(spark, root, number).collect()
    out = {r.meeting_id: (r.title, r.words) for r in got}
    assert len(out) == len(got)
    return out


def tables(root):
    return {p.name for p in Path(root, "data").iterdir()}


def written_rows(spark, root, tables):
    return sum(spark.read.parquet(f"{root}/data/{t}").count() for t in tables)


@pytest.fixture
def store(spark):
    root = new_path(spark, "store")
    first = {f"m{i}": (f"title {i}", ["a", None]) for i in range(40)}
    vs.create_store(rows(spark, first), root, buckets=4)
    return root, first


def test_changes_and_compactions_are_those_of_a_dictionary(spark, store):
    root, now = store
    rng = random.Random(5)
    seen = {1: dict(now)}
    for step in range(5):
        changed = {f"m{rng.randrange(50)}": (None if step == 2 else f"step {step}", []) for _ in range(6)}
        gone = {f"m{rng.randrange(60)}" for _ in range(3)} | {next(iter(changed))}
        now.update(changed)
        now = {k: v for k, v in now.items() if k not in gone}
        before = tables(root)
        version = vs.commit(root, rows(spark, changed), ids(spark, list(gone) * 2))
        # What is written is as large as the change.
        assert written_rows(spark, root, tables(root) - before) == len(set(changed) | gone)
        seen[version.number] = dict(now)
        if step in (2, 4):
            version = vs.compact(spark, root, most_changes=step - 2)
            seen[version.number] = dict(now)
            assert all(sum(b in bs for _, bs in version.changes) <= step - 2 for b in range(4))
        assert held(spark, root) == now
    for number, then in seen.items():  # older versions are still what they were
        assert held(spark, root, number) == then


def test_a_writer_that_dies_leaves_the_store_as_it_was(spark, store, monkeypatch):
    root, first = store
    with monkeypatch.context() as m:
        def dies(*_):
            raise OSError("gone")

        m.setattr(vs, "publish", dies)
        with pytest.raises(OSError):
            vs.commit(root, rows(spark, {"m1": ("new", [])}), ids(spark, ["m2"]))
    assert vs.current_number(root) == 1 and held(spark, root) == first
    Path(root, "versions", "_half").write_text("{")  # a pointer that was not moved
    vs.commit(root, rows(spark, {"m1": ("newer", [])}), ids(spark, []))
    assert held(spark, root) == {**first, "m1": ("newer", [])}


def test_two_writers_of_one_version_conflict(spark, store, monkeypatch):
    root, first = store
    stale = vs.load_version(root)
    vs.commit(root, rows(spark, {"m1": ("one", [])}), ids(spark, []))
    monkeypatch.setattr(vs, "load_version", lambda *_: stale)
    with pytest.raises(vs.VersionConflict):
        vs.commit(root, rows(spark, {"m1": ("two", [])}), ids(spark, []))
    monkeypatch.undo()
    assert held(spark, root)["m1"] == ("one", [])


def test_compaction_leaves_other_buckets_alone(spark, store):
    root, first = store
    for k in range(2):
        vs.commit(root, rows(spark, {"m3": (f"v{k}", [])}), ids(spark, []))
    old = vs.load_version(root)
    touched = old.changes[0][1]
    before = tables(root)
    new = vs.compact(spark, root, most_changes=1)
    assert {b for b in old.base if new.base[b] != old.base[b]} == set(touched) and new.changes == []
    assert written_rows(spark, root, tables(root) - before) < len(first)
    assert held(spark, root) == {**first, "m3": ("v1", [])}
    assert vs.compact(spark, root, most_changes=1).number == new.number


def test_empty_stores_and_empty_changes(spark):
    root = new_path(spark, "store")
    vs.create_store(rows(spark, {}), root, buckets=3)
    assert held(spark, root) == {}
    vs.commit(root, rows(spark, {}), ids(spark, []))
    vs.commit(root, rows(spark, {"x": ("t", [])}), ids(spark, ["nobody"]))
    assert held(spark, root) == {"x": ("t", [])}
    vs.commit(root, rows(spark, {}), ids(spark, ["x"]))
    vs.compact(spark, root, most_changes=0)
    assert held(spark, root) == {} and vs.load_version(root).base == {}


def test_digests_of_files_longer_than_a_piece_and_of_odd_names(spark, tmp_path):
    rng = random.Random(2)
    content = {"a/big file.bin": rng.randbytes(100_000), "a/b/50%25.bin": rng.randbytes(999), "empty": b"", "a/exact": rng.randbytes(2000)}
    for name, data in content.items():
        place = tmp_path / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(data)
    for folder in (str(tmp_path), tmp_path.as_uri(), f"{tmp_path}/"):
        found = files.digest_files(spark, folder, piece=1000)
        got = {r.path: (r.digest, r.length) for r in found.collect()}
        assert got == {k: (hashlib.sha256(v).hexdigest(), len(v)) for k, v in content.items()}
    listed = files.list_files(spark, str(tmp_path))
    assert {r.folder: (r.bytes, r.files) for r in folder_bytes(listed).collect()} == {"a": (102_999, 3), "a/b": (999, 1)}
