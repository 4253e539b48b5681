"""Stateful stream operators on small inputs."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from colloquy.catalog.live import stream
from colloquy.catalog.registry import QUERIES
from colloquy.sources.adapters import DriverTables
from colloquy.streaming import live, runs


def echo(n, coupled, rng):
    speech = np.array([1e-2 * rng.random() ** 3 for _ in range(n)])
    heard = np.concatenate([[0.0], speech[:-1]]) * 5e-5
    own = np.array([1e-3 * (rng.randint(1, 12) ** 2) for _ in range(n)])
    return (np.maximum(heard, 1e-11) if coupled else own), speech


def test_window_test_finds_only_a_planted_echo():
    rng = random.Random(1)
    assert live.window_is_coupled(*echo(60, True, rng))
    assert not live.window_is_coupled(*echo(15, True, rng))
    assert not live.window_is_coupled(np.full(60, 1e-3), np.zeros(60))


def test_bleed_is_reported_once_over_several_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    mic, sys = echo(90, True, rng)
    rows += [("echo", i, float(mic[i]), float(sys[i])) for i in range(90)]
    rows += [("silent", i, 1e-3, 0.0) for i in range(90)]
    df = spark.createDataFrame(rows, "recording_id string, tick long, microphone double, system double")
    path = str(tmp_path / "ticks")
    for low in (0, 30, 60):  # one file per stretch, read in order
        df.where((F.col("tick") >= low) & (F.col("tick") < low + 30)).coalesce(1).write.mode(
            "append"
        ).parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = runs.run_to_table(live.bleed_watch(stream, size=40), "append", "bleed-test").collect()
    assert [(r.recording_id, r.tick) for r in got] == [("echo", 39)]


def test_meter_is_the_same_in_any_order_of_files(spark, tmp_path):
    rng = random.Random(4)
    ticks = [("a", i, rng.random() if i % 9 == 0 else 0.0) for i in range(120)]
    order = list(range(4))
    rng.shuffle(order)
    df = spark.createDataFrame(ticks, "recording_id string, tick long, peak double")
    path = str(tmp_path / "ticks")
    for k in order:
        df.where(F.col("tick") % 4 == k).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = runs.run_to_table(live.meter_decay(stream), "append", "meter-test").orderBy("tick").collect()
    level, want = 0.0, []
    for _, i, peak in ticks:
        level = max(peak, 0.6 * level)
        want.append((i, level))
    assert [(r.tick, r.meter) for r in got] == want


def test_a_frame_has_one_row_however_late_its_other_side(spark, tmp_path):
    rows = [("a", "microphone", 1, "2024-01-01 00:00:00", 0.5), ("a", "systemAudio", 1, "2024-01-01 00:00:00", 0.25)]
    df = spark.createDataFrame(rows, "recording_id string, side string, frame long, at string, value double").selectExpr(
        "recording_id", "side", "frame", "cast(at as timestamp) as started", "value"
    )
    path = str(tmp_path / "sides")
    for side in ("microphone", "systemAudio"):
        df.where(F.col("side") == side).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    padded = live.align_sides_padded(stream, 0.02, "1 minute", "1 hour")
    rows = runs.run_to_table(padded, "update", "padded-test")
    last = rows.groupBy("recording_id", "frame").agg(F.max("microphone"), F.max("system")).collect()
    assert [tuple(r) for r in last] == [("a", 1, 0.5, 0.25)]


def test_turns_close_exactly_and_state_ends(spark, tmp_path):
    rng = random.Random(6)
    words, at = [], 0.0
    for k in range(90):
        at += rng.choice([0.1, 0.2, 2.5])
        words.append(("a", k, rng.choice(["x", "x", "x", "y"]), at, at + 0.1, False))
    rows = words + [("a", 90, None, None, None, True), ("gone", 0, "x", 0.0, 1.0, False), ("gone", 2, "y", 9.0, 9.5, False)]
    shape = "recording_id string, word_idx long, speaker_id string, start double, `end` double, ended boolean"
    df = spark.createDataFrame(rows, shape).withColumn("ts", F.timestamp_seconds(F.lit(1_000)))
    path = str(tmp_path / "words")
    for k in (2, 0, 1):
        df.where(F.col("word_idx") % 3 == k).coalesce(1).write.mode("append").parquet(path)
    # Two days later: the recording that never ended is over.
    late = spark.createDataFrame([("late", 1, "x", 0.0, 1.0, False)], shape)
    for day in (2, 3):
        late.withColumn("ts", F.timestamp_seconds(F.lit(1_000 + day * 86_400))).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = runs.run_to_table(live.live_turns(stream), "append", "turns-test").collect()
    want = []
    for _, k, who, start, end, _ in words:
        if want and want[-1][1] == who and start - want[-1][3] <= 1.5:
            want[-1] = (*want[-1][:3], end, want[-1][4] + 1)
        else:
            want.append((k, who, start, end, 1))
    found = sorted((r.first_word, r.speaker_id, r.started, r.closed, r.n_words) for r in got if r.recording_id == "a")
    assert found == want
    gone = sorted((r.first_word, r.speaker_id, r.n_words) for r in got if r.recording_id == "gone")
    assert gone == [(0, "x", 1), (2, "y", 1)]  # without an end, the second without the word before
    assert not [r for r in got if r.recording_id == "late"]  # waits for its first word


class _Value:
    def __init__(self, calls):
        self.calls, self.value = calls, None

    def exists(self):
        self.calls.n += 1
        return self.value is not None

    def get(self):
        self.calls.n += 1
        return self.value

    def update(self, value):
        self.calls.n += 1
        self.value = value

    put = update

    def clear(self):
        self.update(None)


class _Calls:
    """A handle whose calls to the state store are counted."""

    def __init__(self):
        self.n, self.states, self.timers = 0, {}, set()

    def getValueState(self, name, schema):
        return self.states.setdefault(name, _Value(self))

    getListState = getValueState

    def registerTimer(self, at):
        self.n += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.n += 1
        self.timers.remove(at)


def test_a_batch_of_words_reads_and_writes_one_value():
    words = pd.DataFrame(
        {
            "word_idx": range(9), "speaker_id": ["x", None, None, "y", "y", "x", None, "z", "z"],
            "start": [float(k) for k in range(9)], "end": [k + 0.5 for k in range(9)], "ended": False,
            "ts": pd.to_datetime(["2024-01-01"] * 9),
        }
    )
    end = words[8:].assign(word_idx=9, ended=True)
    spoken = [words[5:8], pd.concat([words[3:5], end]), words[1:3], words[:2], words[8:]]
    calls, turns = _Calls(), live._Turns(live.TURN_GAP, live.FORGET_SECONDS)
    turns.init(calls)
    got, counts = [], []
    # The first word comes in the fourth batch, one of the third a second time; no batch brings a later time.
    for batch in spoken:
        before = calls.n
        for out in turns.handleInputRows(("a",), iter([batch]), None):
            got += out.itertuples(index=False, name=None)
        counts.append(calls.n - before)
    # One read, one write, and the timer where it changes.
    assert counts == [3, 2, 2, 2, 3]
    assert not calls.timers and all(s.value is None for s in calls.states.values())
    want = [(0, "x", 0.0, 0.5, 1), (1, None, 1.0, 2.5, 2), (3, "y", 3.0, 4.5, 2), (5, "x", 5.0, 5.5, 1)]
    want += [(6, None, 6.0, 6.5, 1), (7, "z", 7.0, 8.5, 2)]
    assert got == [("a", *row) for row in want]


def test_a_table_in_a_folder_streams_like_one_in_a_file(spark, tmp_path):
    df = spark.range(6).selectExpr("id as vec_id", "array(id * 1f, 2f) as embedding", "cast(id % 2 as int) as label")
    df.repartition(3).write.parquet(str(tmp_path / "folder" / "embeddings.parquet"))
    df.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "file" / "embeddings.parquet")
    df.where("false").write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    enroll = QUERIES["stream_enroll"]
    for at in ("folder", "file"):
        table = DriverTables(spark, str(tmp_path / at))
        rows = runs.run_to_table(stream(table, "embeddings"), "append", "read").collect()
        assert sorted(r.vec_id for r in rows) == list(range(6)), at
    assert enroll(spark, str(tmp_path / "none")).columns[:2] == ["person", "sample_count"]
    no_files = spark.readStream.schema(df.schema).parquet(str(tmp_path / "file")).where("false")
    assert runs.run_to_table(no_files, "append", "nothing").count() == 0


def test_voices_are_means_of_vectors_as_long_as_the_first(spark, tmp_path):
    rng = random.Random(8)
    rows = [(" Ann", k, [rng.random(), rng.random()]) for k in range(2, 40)] + [("ann ", 50, [1.0]), ("Bo", 1, [2.0]), ("bo", 0, [3.0, 4.0])]
    rows += [("Bo", 60, [5.0, 6.0]), ("", 3, [1.0]), (None, 4, [1.0]), ("Cy", 5, None), ("Cy", 6, []), ("Di", 7, [1.0, None])]
    df = spark.createDataFrame(rows, "name string, obs_id long, embedding array<float>")
    path = str(tmp_path / "said")
    for low, high in ((0, 30), (30, 99)):
        df.where(F.col("obs_id").between(low, high - 1)).repartition(2).write.mode("append").parquet(path)
    said = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)
    got = runs.run_to_table(live.enrol(said), "update", "voices-test").groupBy("person").agg(
        F.max_by(F.struct("sample_count", "embedding"), "batch").alias("v")
    )
    voices = {r.person: (r.v.sample_count, r.v.embedding) for r in got.collect()}
    assert set(voices) == {"ann", "bo", "di"}
    assert voices["ann"][0] == 38
    np.testing.assert_allclose(voices["ann"][1], np.mean([np.float32(r[2]) for r in rows[:38]], axis=0), rtol=1e-6)
    assert voices["bo"] == (2, [4.0, 5.0])
    assert voices["di"][0] == 1 and voices["di"][1][0] == 1.0


def test_a_recording_reads_and_writes_its_state_once_a_batch():
    class State:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    class Handle:
        def __init__(self):
            self.states = []

        def getValueState(self, *_):
            self.states.append(State())
            return self.states[-1]

        getListState = getValueState

    handle, meter = Handle(), live._MeterDecay(100)
    meter.init(handle)
    out = []
    for ticks in ([2, 1], [0, 4, None], [3, 1]):
        rows = pd.DataFrame({"recording_id": "a", "tick": ticks, "peak": [0.5 if k == 0 else 0.0 for k in ticks]})
        out += [p for p in meter.handleInputRows(("a",), iter([rows]), None) if len(p)]
    assert len(handle.states) == 1 and handle.states[0].calls == 6
    assert [k for p in out for k in p["tick"]] == [0, 1, 2, 3, 4]
