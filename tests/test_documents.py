"""Rendering, names, libraries, people: fixed examples and invariants."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators import library, render, slices, speakers, translate
from colloquy.sources import documents as docs
from colloquy.sources import files

CUE = "array<struct<start:double,`end`:double,speaker:string,text:string>>"


@pytest.mark.parametrize(
    "seconds, want",
    [(0.0, "00:00:00.000"), (4.12, "00:00:04.120"), (3725.5, "01:02:05.500"), (6.9999, "00:00:07.000")],
)
def test_subtitle_clock(spark, seconds, want):
    df = spark.range(1).select(tx.timecode_subtitle(F.lit(seconds), ".").alias("c"))
    assert df.first().c == want


@pytest.mark.parametrize("start, want", [(754.0, "[00:12:34] Anna:"), (4353.0, "[01:12:33] Anna:")])
def test_attribution(spark, start, want):
    df = spark.range(1).select(tx.plain_attribution(F.lit(start), F.lit("Anna")).alias("c"))
    assert df.first().c == want


def test_wrapping_keeps_every_word(spark):
    rng = random.Random(1)
    texts = [" ".join("x" * rng.choice([1, 4, 12, 50]) for _ in range(rng.randint(1, 25))) for _ in range(80)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", tx.wrap_lines(F.col("t")).alias("w")).collect():
        lines = r.w.split("\n")
        assert " ".join(lines) == r.t and len(lines) <= 2
        if len(r.t) > 42 and len(lines) == 2:
            head, tail = lines
            assert len(head) <= 42 or " " not in head
            assert len(head) + 1 + len(tail.split(" ")[0]) > 42


def test_redistribution_keeps_text_and_times(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        n = rng.randint(1, 6)
        cues = [(float(k), k + 0.9, "Anna" if k == 0 else None, "y" * rng.choice([0, 1, 5, 40])) for k in range(n)]
        rows.append((i, cues, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 14)))))
    df = spark.createDataFrame(rows, f"i long, cues {CUE}, t string")
    for r in df.select("i", "cues", "t", render.redistribute(F.col("cues"), F.col("t")).alias("r")).collect():
        if r.t:
            assert " ".join(c.text for c in r.r) == r.t
        starts, ends = {c.start for c in r.cues}, {c.end for c in r.cues}
        assert all(c.start in starts and c.end in ends for c in r.r)
        assert r.r[0].start == r.cues[0].start and r.r[-1].end == r.cues[-1].end
        assert all(a.end <= b.start for a, b in itertools.pairwise(r.r))


def test_parts_add_up_to_the_document(spark):
    rows = [("m", i, f"line {i}\n") for i in range(25)] + [("n", 0, "short")]
    df = spark.createDataFrame(rows, "meeting_id string, block long, text string")
    found = dict(render.documents(df, part_blocks=4).collect())
    assert found == {"m": "".join(r[2] for r in rows[:25]), "n": "short"}


def test_written_documents(spark, tmp_path):
    rows = [("m", 0, "WEBVTT\n"), ("m", 1, "\n1\nhej\n"), ("n", 0, "other")]
    df = spark.createDataFrame(rows, "meeting_id string, block long, text string")
    facts = [("m", "A/B", "swedish", "2024-01-02"), ("n", "a/b", "swedish", "2024-01-01"), ("o", "x", None, "2024-01-01")]
    meetings = spark.createDataFrame(facts, "meeting_id string, title string, target string, day string").selectExpr(
        "*", "cast(day as timestamp) as imported_at"
    )
    path = tmp_path / "out"
    names = docs.document_names(meetings, "vtt", True)
    written = docs.write_documents(df, names, f"file://{path}").collect()
    assert {p.name: p.read_text() for p in path.iterdir()} == {
        "a-b (Swedish).vtt": "other", "A-B (Swedish) 2.vtt": "WEBVTT\n\n1\nhej\n"
    }
    assert sorted(r["bytes"] for r in written) == [5, 14]


def test_merges_one_after_the_other(spark):
    people = [("a", [1.0, 0.0], 1, None), ("b", [0.0, 1.0], 1, None), ("c", [0.0, 1.0], 1, "n"), ("d", [], 1, None), ("e", [2.0], 3, None)]
    profiles = spark.createDataFrame(people, "profile_id string, embedding array<double>, sample_count long, note string")

    def merged(*pairs):
        rows = [(k, s, t) for k, (s, t) in enumerate(pairs)]
        merges = spark.createDataFrame(rows, "seq long, source_id string, target_id string")
        return {r["profile_id"]: r for r in speakers.merge_profiles(profiles, merges).collect()}

    def by_hand(*pairs):
        state = {p: [list(v), n, note] for p, v, n, note in people}
        for s, t in pairs:
            if s != t and s in state and t in state:
                v, _, note = state.pop(s)
                mean, n, own = state[t]
                if v and len(v) == len(mean):
                    state[t][:2] = [(m * n + x) / (n + 1) for m, x in zip(mean, v)], n + 1
                elif not mean:
                    state[t][0] = v
                state[t][2] = note if own is None else own
        return state

    for pairs in [
        [("a", "b"), ("b", "c")], [("b", "c"), ("a", "b")], [("a", "b"), ("b", "c"), ("a", "d"), ("c", "d"), ("e", "d")],
        [("c", "a"), ("c", "b"), ("b", "a"), ("e", "a"), ("x", "a"), ("a", "a")], [("a", "b"), ("b", "a"), ("c", "a")],
    ]:
        got, want = merged(*pairs), by_hand(*pairs)
        assert {p: [r["embedding"], r["sample_count"], r["note"]] for p, r in got.items()} == want
        assert all((r["updated_at"] is not None) == any(t == p and s in "abcde" and s != t for s, t in pairs) for p, r in got.items()) or len(pairs) > 2


def test_span_file_is_repaired(spark, tmp_path):
    spans = [
        {"text": " b ", "start": 5.2, "end": 3.76, "speaker": "Talare 2"},
        {"text": "a", "start": 0.18, "end": 3.18, "speaker": "  "},
        {"text": "  ", "start": 0.0, "end": 1.0, "speaker": "x"},
    ]
    (tmp_path / "ok.json").write_text(json.dumps({"texts": spans}))
    (tmp_path / "silent.json").write_text(json.dumps({"texts": spans[2:]}))
    (tmp_path / "bad.json").write_text("{")
    routed = docs.route_import(docs.read_texts(spark, str(tmp_path))).cache()
    reasons = {r.source.rsplit("/", 1)[1]: (r.kind, r.reason) for r in routed.collect()}
    assert reasons == {
        "ok.json": ("spans", None),
        "silent.json": (None, "noSpeech"),
        "bad.json": (None, "unrecognizedFormat"),
    }
    got = docs.span_turns(routed).orderBy("span_idx").collect()
    assert [(r.speaker_id, r.start, r.end, r.text) for r in got] == [
        ("unknown", 0.18, 3.18, "a"), ("Talare 2", 3.76, 5.2, "b")
    ]


def test_library_scan_skips_what_it_cannot_read(spark, tmp_path):
    for name, body in {
        "a/one.json": json.dumps({"id": "1", "schemaVersion": 1, "title": "One"}, indent=2),
        "a/b/two.json": json.dumps({"id": "2", "schemaVersion": 2, "title": "Two"}),
        "bad.json": "{oops",
        ".hidden.json": json.dumps({"id": "3", "schemaVersion": 1}),
        "note.txt": "x",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    meetings, rejects = docs.scan_library(spark, str(tmp_path))
    assert [r.title for r in meetings.collect()] == ["One"]
    assert sorted(r.path.rsplit("/", 1)[1] for r in rejects.collect()) == ["bad.json", "two.json"]


def test_listing_and_digests(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x").write_bytes(b"abc")
    assert [r.length for r in files.list_files(spark, str(tmp_path)).collect()] == [3]
    digest = files.digest_files(spark, str(tmp_path)).first().digest
    assert digest.startswith("ba7816bf")


def test_snapshot_bucket_can_become_empty(spark, tmp_path):
    path = str(tmp_path / "snap")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "meeting_id string, v int")
    files.write_snapshot(rows, path)
    files.upsert_snapshot(spark, path, rows.where("false"), rows.select("meeting_id").where("meeting_id = 'a'"))
    files.upsert_snapshot(
        spark, path, spark.createDataFrame([("b", 5), ("c", 6)], rows.schema), rows.select("meeting_id").where("false")
    )
    assert sorted(tuple(r) for r in files.read_snapshot(spark, path).collect()) == [("b", 5), ("c", 6)]


@pytest.mark.parametrize(
    "title, want",
    [("a/b:c", "a-b-c"), ("...hidden", "hidden"), ("  ", "Untitled"), ("\u0000x\n", "x"), (". . a", "a"),
     ("å" * 150, "å" * 100), ("a" * 199 + "å", "a" * 199)],
)
def test_names_for_files(spark, title, want):
    df = spark.createDataFrame([(title,)], "t string")
    assert df.select(tx.sanitize_name(F.col("t")).alias("n")).first().n == want


def test_names_become_unique(spark):
    rng = random.Random(3)
    names = ["a", "A", "a 2", "a 3", "a 2 2", "a 12", "b"]
    rows = [(i, rng.choice(["f", "g"]), rng.choice(names)) for i in range(120)]
    df = spark.createDataFrame(rows, "item_id long, folder string, name string")
    got = library.unique_names(df, [F.col("item_id")], F.floor(F.col("item_id") / 7).cast("long")).collect()
    assert len(got) == len(rows)
    taken = [(r.folder, r.unique_name.lower()) for r in got]
    assert len(set(taken)) == len(taken)
    for r in got:
        assert r.unique_name == r.name or r.unique_name.rsplit(" ", 1)[0] == r.name


def test_suggestions_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(4)
    vector = lambda: [rng.gauss(0, 1) for _ in range(4)]
    people = [(i, f"p{i}", f"n{i}", vector()) for i in range(23)]
    voices = [("m", f"s{i}", vector()) for i in range(30)] + [("m", "none", []), ("m", "odd", [1.0])]
    df = spark.createDataFrame(voices, "meeting_id string, speaker_id string, embedding array<float>")
    pf = spark.createDataFrame(people, "profile_pos int, profile_id string, name string, embedding array<float>")
    whole = {r.speaker_id: r.profile_id for r in speakers.suggest_profile(df, pf).collect()}
    monkeypatch.setattr(speakers, "PROFILE_BLOCK", 5)
    split = {r.speaker_id: r.profile_id for r in speakers.suggest_profile(df, pf).collect()}
    assert whole == split and len(split) == len(voices)
    assert split["none"] is None and split["odd"] is None and any(split.values())


def test_profiles_are_edited_in_the_order_of_the_log(spark):
    from datetime import datetime

    day = lambda d: datetime(2024, 1, d)
    people = [("a", "Anna", [1.0, 0.0], 1, day(1), None), ("b", "Bo", [0.0, 1.0], 3, day(1), "old"), ("c", "Cy", [], 1, day(1), None), ("d", "Di", [1.0], 1, day(1), "d")]
    pf = spark.createDataFrame(people, "profile_id string, name string, embedding array<double>, sample_count long, updated_at timestamp, note string")
    log = [
        (1, "a", "rename", " Anna L ", None, day(2)), (2, "a", "note", " lead ", None, day(3)), (3, "a", "rename", "  ", None, day(4)),
        (4, "b", "note", "   ", None, day(5)), (5, "b", "accept", None, [1.0, 0.0], day(6)), (6, "b", "accept", None, [1.0], day(7)),
        (7, "c", "accept", None, [0.5, 0.5], day(8)), (8, "d", "delete", None, None, day(9)), (9, "d", "rename", "Back", None, day(9)),
        (10, "x", "rename", "Nobody", None, day(9)), (11, "a", "sing", "la", None, day(9)), (12, "c", "note", None, None, day(9)),
    ]
    actions = spark.createDataFrame(log, "seq long, profile_id string, kind string, text string, embedding array<double>, at timestamp")
    want = [
        ("a", "Anna L", [1.0, 0.0], 1, day(2), "lead"),
        ("b", "Bo", [0.25, 0.75], 4, day(7), None),
        ("c", "Cy", [0.5, 0.5], 1, day(8), None),
    ]
    got = speakers.edit_profiles(pf, actions).select(*pf.columns).orderBy("profile_id").collect()
    assert [tuple(r) for r in got] == want
    same = speakers.edit_profiles(pf, actions.limit(0)).select(*pf.columns).orderBy("profile_id").collect()
    assert [tuple(r) for r in same] == people


def test_suggestions_by_pivots_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(11)
    hubs = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    near = lambda spread: [x + rng.gauss(0, spread) for x in rng.choice(hubs)]
    people = [(i, f"p{i:03}", f"n{i}", near(0.1)) for i in range(300)]
    people += [(300, "q", "again", people[7][3]), (301, "zero", "z", [0.0] * 16), (302, "none", "z", None)]
    people += [(303, "narrow", "w", [1.0, 2.0]), (304, "big", "b", [float("inf")] * 16)]
    voices = [("m", f"s{i}", near(0.2)) for i in range(80)] + [("m", f"far{i}", [rng.gauss(0, 1) for _ in range(16)]) for i in range(40)]
    voices += [("m", "same", people[7][3]), ("m", "zero", [0.0] * 16), ("m", "none", None), ("m", "two", [1.0, 2.1]), ("m", "one", [1.0])]
    df = spark.createDataFrame(voices, "meeting_id string, speaker_id string, embedding array<double>")
    pf = spark.createDataFrame(people, "profile_pos int, profile_id string, name string, embedding array<double>")

    def best(v):
        if not v or not any(v):
            return None
        found = []
        for pos, pid, _, p in people:
            if p and len(p) == len(v) and any(p) and pid != "big":
                dot = sum(a * b for a, b in zip(v, p))
                found.append((round(1 - dot / (sum(a * a for a in v) ** 0.5 * sum(a * a for a in p) ** 0.5), 9), pos, pid))
        d, _, pid = min(found, default=(9, 0, None))
        return pid if d <= 0.45 else None

    want = {s: best(v) for _, s, v in voices}
    monkeypatch.setattr(speakers, "PROFILE_BLOCK", 10)
    assert {r.speaker_id: r.profile_id for r in speakers.suggest_profile(df, pf).collect()} == want
    assert want["same"] == "p007" and want["two"] == "narrow" and any(v is None for k, v in want.items() if k.startswith("far"))
    compared = speakers.suggestion_work(df, pf).first().compared
    assert 0 < compared < 0.4 * len(people) * len(voices)
    monkeypatch.setattr(speakers, "PROFILE_BLOCK", 1000)
    assert {r.speaker_id: r.profile_id for r in speakers.suggest_profile(df, pf).collect()} == want
    none = speakers.suggest_profile(df, pf.limit(0)).collect()
    assert len(none) == len(voices) and all(r.profile_id is None for r in none)


def test_four_pairs_are_refused(spark):
    from colloquy.schema import language_pairs

    pairs = language_pairs(spark)
    assert pairs.count() == 90 and pairs.where("NOT available").count() == 4


def test_lines_of_a_translator_are_kept_by_row(spark):
    rows = [("m", str(i), "swedish", "english", f"t{i}") for i in range(5)] + [("m", "x", "swedish", "polish", "t")]
    df = spark.createDataFrame(rows, "meeting_id string, turn_id string, language string, target string, text string")
    shout = lambda source, target, texts: texts.map(lambda s: "" if s == "t3" else "EN:" + s)
    got = {r.turn_id: r.text for r in translate.translate_with(df, shout).collect()}
    assert got == {str(i): f"EN:t{i}" for i in (0, 1, 2, 4)}


def test_regions_touching_become_one(spark):
    rows = [("m", i, float(s), float(e)) for i, (s, e) in enumerate([(0, 5), (5.8, 7), (40, 41), (1, 2), (100, 101)])]
    df = spark.createDataFrame(rows, "meeting_id string, seg_idx long, start double, `end` double")
    got = slices.speech_regions(df).orderBy("region_idx").collect()
    assert [(round(r.start, 3), round(r.end, 3)) for r in got] == [(0.0, 7.4), (39.6, 41.4), (99.6, 101.4)]
