"""Word alignment and turns against plain loops, chunk borders included."""

import random
import time

import numpy as np
import pytest

from colloquy.operators import align, blocks, sides, turns

WORD = "meeting_id string, word_idx long, word string, start double, `end` double"
SEGMENT = "meeting_id string, seg_idx long, speaker_id string, start double, `end` double"


def words_of(spark, *words, meeting="m"):
    return spark.createDataFrame(
        [(meeting, i, w, float(s), float(e)) for i, (w, s, e) in enumerate(words)], WORD
    )


def segments_of(spark, *segments, meeting="m"):
    return spark.createDataFrame(
        [(meeting, i, w, float(s), float(e)) for i, (w, s, e) in enumerate(segments)], SEGMENT
    )


def speakers(df):
    return [r.speaker_id for r in df.orderBy("meeting_id", "word_idx").collect()]


def test_two_speakers_make_two_turns(spark):
    words = words_of(
        spark, ("Hej", 0, 0.4), ("allihopa.", 0.4, 1.0), ("Hello", 2, 2.4), ("everyone.", 2.4, 3)
    )
    segments = segments_of(spark, ("A", 0, 1.2), ("B", 1.8, 3.2))
    got = turns.turns_from_words(align.align_words(words, segments)).orderBy("turn_idx").collect()
    assert [(t.speaker_id, t.text) for t in got] == [("A", "Hej allihopa."), ("B", "Hello everyone.")]


@pytest.mark.parametrize(
    "word, segments, want",
    [
        (("x", 0.9, 1.3), [("A", 0, 1), ("B", 1, 2)], "B"),
        (("x", 1.2, 1.4), [("A", 0, 1), ("B", 3, 4)], "A"),
        (("x", 5, 5), [("A", 0, 1), ("B", 4, 6)], "B"),
    ],
)
def test_single_words(spark, word, segments, want):
    aligned = align.align_words(words_of(spark, word), segments_of(spark, *segments))
    assert speakers(aligned) == [want]


def test_no_segments_is_unknown(spark):
    words = words_of(spark, ("Ett", 0, 0.3), ("två", 0.4, 0.8))
    aligned = align.align_words(words, segments_of(spark, ("A", 0, 9), meeting="other"))
    got = turns.turns_from_words(aligned).collect()
    assert [(t.speaker_id, t.text) for t in got] == [("unknown", "Ett två")]


def plain_speaker(word, segments):
    s, e = word
    ranked = sorted(segments, key=lambda g: (g[1], g[3]))
    best, most = None, 0.0
    for who, a, b, _ in ranked:
        shared = min(e, b) - max(s, a)
        if shared > most:
            best, most = who, shared
    if best is None and ranked:
        mid = (s + e) / 2
        gap = lambda g: g[1] - mid if mid < g[1] else (mid - g[2] if mid > g[2] else 0.0)
        best = min(ranked, key=gap)[0]
    return best or "unknown"


def test_random_words_against_a_loop(spark):
    rng = random.Random(7)
    word_rows, segment_rows, want = [], [], {}
    for meeting in ("hot", "b", "empty"):
        segs = []
        for j in range({"hot": 40, "b": 6, "empty": 0}[meeting]):
            a = round(rng.uniform(0, 400), 1)
            segs.append((f"s{j % 4}", a, round(a + rng.choice([0.5, 5, 90]), 1), j))
            segment_rows.append((meeting, j, *segs[-1][:3]))
        for i in range({"hot": 300, "b": 60, "empty": 5}[meeting]):
            a = round(rng.uniform(0, 450), 1)
            b = round(a + rng.choice([0, 0.3, 2, 50]), 1)
            word_rows.append((meeting, i, "w", a, b))
            want[(meeting, i)] = plain_speaker((a, b), segs)
    got = align.align_words(
        spark.createDataFrame(word_rows, WORD), spark.createDataFrame(segment_rows, SEGMENT)
    )
    assert {(r.meeting_id, r.word_idx): r.speaker_id for r in got.collect()} == want


def plain_turns(words):
    """Index of the first word of each word's turn."""
    out, prev, first = [], None, None
    for i, word, s, e, who in words:
        hard = prev is None or who != prev[4] or s - prev[3] > 1.5
        if hard or (s - first[1] > 30 and prev[2][-1] in ".?!"):
            first = (i, s)
        out.append(first[0])
        prev = (i, i, word, e, who)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_long_meetings_are_cut_alike_in_any_chunks(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for meeting, count in (("hot", 700), ("b", 120), ("c", 3)):
        at, who, words = 0.0, "A", []
        for i in range(count):
            if rng.random() < (0.004 if meeting == "hot" else 0.05):
                who = rng.choice("AB")
            at += rng.choice([0.4, 0.5, 1.0, 7.0 if rng.random() < 0.02 else 0.3])
            if rng.random() < 0.02:
                at = max(0.0, at - 20)  # emission order is not time order
            word = rng.choice(["a", "b", "c", "d", "end."])
            words.append((i, word, round(at, 2), round(at + 0.3, 2), who))
        for w, first in zip(words, plain_turns(words)):
            rows.append((meeting, w[0], w[1], w[2], w[3], w[4]))
            want[(meeting, w[0])] = first
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, WORD + ", speaker_id string")
    for chunk in (13, 64, 10_000):
        marked = turns.mark_turns(df, chunk)
        assert {(r.meeting_id, r.word_idx): r.turn_first for r in marked.collect()} == want
    runs = {(r.meeting_id, r.word_idx): r.run_idx for r in turns.turn_runs(df, 13).collect()}
    whole = {(r.meeting_id, r.word_idx): r.run_idx for r in turns.turn_runs(df).collect()}
    assert runs == whole


def test_tokens_fold_punctuation(spark):
    words = [("Hej,", 0.0, 0.3), ("", 0.3, 0.3), (",", 0.3, 0.35), ("du", 0.4, 0.6), (".", 0.6, 0.65)]
    schema = "meeting_id string, turn_id string, words array<struct<word:string,start:double,`end`:double>>"
    df = spark.createDataFrame([("m", "t", words)], schema)
    got = [(r.text, r.start, r.word_lo, r.word_hi) for r in turns.word_tokens(df).collect()]
    assert got == [("Hej,,", 0.0, 0, 3), ("du.", 0.4, 3, 5)]


def test_louder_side_wins(spark):
    frames = [
        ("m", side, f, 0.05 if low <= f < high else 0.0)
        for side, low, high in (("microphone", 0, 250), ("systemAudio", 300, 500))
        for f in range(500)
    ]
    df = spark.createDataFrame(frames, "meeting_id string, side string, frame long, energy double")
    words = words_of(spark, ("here", 1, 1.5), ("there", 7, 7.5), ("again", 2, 2.5), ("off", 50, 51))
    got = sides.attribute_side(words, blocks.pack_frames(df)).orderBy("word_idx").collect()
    assert [r.side for r in got] == ["microphone", "systemAudio", "microphone", "microphone"]


def test_meter_needs_only_its_neighbourhood(spark):
    rng = random.Random(9)
    rows = [("m", i, rng.random() if rng.random() < 0.1 else 0.0) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    got = sides.meter_decay(df, ["k"], "i", "v", chunk=100).orderBy("i").collect()
    level = 0.0
    for r in got:
        level = max(r.v, 0.6 * level)
        assert abs(r.meter - level) < 1e-9


def test_meter_never_forgets(spark):
    df = spark.createDataFrame([("m", i, float(i == 3)) for i in range(400)], "k string, i long, v double")
    for r in sides.meter_decay(df, ["k"], "i", "v", chunk=50).where("i >= 3").collect():
        assert abs(r.meter / 0.6 ** (r.i - 3) - 1) < 1e-9


def test_bleed_of_a_planted_echo(spark):
    rng = random.Random(10)
    speech = [1e-2 * rng.random() ** 3 for _ in range(150)]
    rows = []
    for f in range(150):
        heard = speech[f - 1] * 5e-5 if f else 0.0
        rows.append(("echo", "systemAudio", f, speech[f]))
        rows.append(("echo", "microphone", f, max(1e-8 * 0.001, heard)))
        rows.append(("quiet", "systemAudio", f, 0.0))
        rows.append(("quiet", "microphone", f, speech[f]))
    df = spark.createDataFrame(rows, "meeting_id string, side string, frame long, energy double")
    got = sides.bleed_coupling(blocks.pack_frames(df)).collect()
    assert [r.meeting_id for r in got] == ["echo"]
    assert got[0].lag == 1 and got[0].evidence > 0.9 and -46 < got[0].offset_db < -40


def test_breaks_in_one_pass():
    rng = random.Random(8)
    for size in (0, 1, 2, 90):
        times = np.cumsum([rng.choice([0.5, 9.0, 31.0, -40.0, 0.0]) for _ in range(size)])
        times[rng.sample(range(size), size // 9)] = np.nan
        want = list(range(size))
        for j in range(size - 1, -1, -1):
            later = [i for i in range(j + 1, size) if times[i] - times[j] > 30]
            want[j] = want[later[0]] if later else j
        assert turns._last_breaks(times).tolist() == want
    began = time.monotonic()
    turns._last_breaks(np.arange(65_536) * 0.001)
    turns._last_breaks(np.arange(65_536)[::-1] * 0.001)
    assert time.monotonic() - began < 2
