"""Live recordings as streams: aligning channels, meters, alarms, sessions, enrolment.

Event time is the recording's own clock. Every function takes and returns a
streaming DataFrame, so any source and sink can be put around it.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from colloquy.operators.sides import (
    AUDIBLE_RANGE,
    INLIER_BAND,
    MAXIMUM_LAG,
    METER_DECAY,
    MINIMUM_DECIBELS,
    MINIMUM_EVIDENCE,
    MINIMUM_FRAMES,
    SILENCE_DECIBELS,
)
from colloquy.schema import MICROPHONE, SYSTEM_AUDIO

# Stateful processors are first loaded beside the driver, where files added to
# the application are not on the path: they travel whole instead of by name.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Meter period, ticks in the bleed window, seconds until the alarm, silence
# that ends a live turn.
METER_PERIOD = "80 milliseconds"
BLEED_TICKS = 150
#: Ticks that a stream waits for one that is missing.
LATE_TICKS = 150
ALARM_SECONDS = 4.0
#: Seconds without a row after which a recording is over.
FORGET_SECONDS = 86_400.0
SESSION_GAP = "1500 milliseconds"
TURN_GAP = 1.5


def align_sides(
    microphone: DataFrame, system: DataFrame, delay: str = "10 seconds", within: str = "10 seconds"
) -> DataFrame:
    """Frames both sources have delivered; ``(recording_id, frame, ts, value)`` each."""
    mic = microphone.select(
        "recording_id", "frame", F.col("ts").alias("mic_ts"), F.col("value").alias("microphone")
    ).withWatermark("mic_ts", delay)
    sys = system.select(
        F.col("recording_id").alias("_rec"),
        F.col("frame").alias("_frame"),
        F.col("ts").alias("sys_ts"),
        F.col("value").alias("system"),
    ).withWatermark("sys_ts", delay)
    close = F.expr(
        f"sys_ts >= mic_ts - INTERVAL {within} AND sys_ts <= mic_ts + INTERVAL {within}"
    )
    same = (F.col("recording_id") == F.col("_rec")) & (F.col("frame") == F.col("_frame"))
    return mic.join(sys, same & close).select("recording_id", "frame", "microphone", "system")


def align_sides_padded(
    samples: DataFrame, frame_seconds: float, period: str, delay: str = "10 seconds"
) -> DataFrame:
    """Frames with both channels, a silent one as zero; ``(recording_id, side, frame, started, value)``.

    One aggregation state per frame instead of a join: a side that never comes
    leaves its zero, and the watermark closes the frame. Event time is when a
    frame was recorded, from the recording's start and the frame's number, so
    its sides share a window however far apart they arrive.
    """
    micros = F.unix_micros("started") + F.round(F.col("frame") * (frame_seconds * 1e6)).cast("long")
    samples = samples.withColumn("ts", F.timestamp_micros(micros))
    value = lambda side: F.coalesce(
        F.max(F.when(F.col("side") == side, F.col("value"))), F.lit(0.0)
    )
    return (
        samples.withWatermark("ts", delay)
        .groupBy("recording_id", F.window("ts", period), "frame")
        .agg(value(MICROPHONE).alias("microphone"), value(SYSTEM_AUDIO).alias("system"))
        .drop("window")
    )


def peak_meter(samples: DataFrame, period: str = METER_PERIOD, delay: str = "1 second") -> DataFrame:
    """Loudest value per source and period."""
    return (
        samples.withWatermark("ts", delay)
        .groupBy("recording_id", "side", F.window("ts", period))
        .agg(F.max(F.abs("value")).alias("peak"))
        .select("recording_id", "side", F.col("window.start").alias("window_start"), "peak")
    )


def live_sessions(words: DataFrame, gap: str = SESSION_GAP, delay: str = "10 seconds") -> DataFrame:
    """Turns as they are spoken: a gap closes one. The batch form is the exact one."""
    return (
        words.withWatermark("ts", delay)
        .groupBy("recording_id", "speaker_id", F.session_window("ts", gap))
        .agg(F.count("*").alias("n_words"))
        .select(
            "recording_id",
            "speaker_id",
            F.col("session_window.start").alias("started"),
            F.col("session_window.end").alias("closed"),
            "n_words",
        )
    )


def _in_order(batches: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    """The rows of one key in one micro-batch, in order."""
    return pd.concat(list(batches)).sort_values(by)


class _Ticks:
    """The ticks of one key in order across batches, also where files come in another.

    A tick is due when all before it have come, or when one more than ``late``
    ticks after it has; later ones wait in the state. What comes after its
    place has passed is dropped. State is one value, read and written once a
    batch: the next tick, those that wait, and what the caller keeps in ``kept``.
    """

    def __init__(self, handle: StatefulProcessorHandle, columns: list[str], late: int):
        self.columns, self.late = columns, late
        fields = [T.StructField("next", T.LongType()), *[T.StructField(n, T.BinaryType()) for n in ("ticks", "values", "kept")]]
        self.state = handle.getValueState("ticks", T.StructType(fields))

    def due(self, batches: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ticks that are due, a row of values each, and what was kept."""
        width, state = len(self.columns), self.state.get()
        self.after, held, values, kept = state or (0, b"", b"", b"")
        parts = []
        for b in batches:
            if b["tick"].dtype != np.int64:  # with nulls, which are never due
                b = b[b["tick"].notna()]
            parts.append((b["tick"].to_numpy(dtype=np.int64), b[self.columns].to_numpy(dtype=float)))
        if held:
            parts.insert(0, (np.frombuffer(held, np.int64), np.frombuffer(values).reshape(-1, width)))
        tick = np.concatenate([p[0] for p in parts])
        tick, first = np.unique(tick, return_index=True)  # the first of a tick counts
        rows = np.concatenate([p[1] for p in parts])[first]
        begin = int(np.searchsorted(tick, self.after))
        tick, rows = tick[begin:], rows[begin:]
        n = 0
        if len(tick):
            n = int(np.searchsorted(tick, tick[-1] - self.late))
            after = int(tick[n - 1]) + 1 if n else self.after
            rest = tick[n:]
            n += int(np.argmin(np.r_[rest == after + np.arange(len(rest)), False]))
            self.after = int(tick[n - 1]) + 1 if n else after
        self.waiting = tick[n:], rows[n:]
        return tick[:n], rows[:n], np.frombuffer(kept)

    def keep(self, kept: np.ndarray) -> None:
        tick, rows = self.waiting
        self.state.update((self.after, tick.tobytes(), rows.tobytes(), np.asarray(kept, dtype=float).tobytes()))


class _MeterDecay(StatefulProcessor):
    def __init__(self, late: int):
        self.late = late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ticks = _Ticks(handle, ["peak"], self.late)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ticks, peaks, kept = self.ticks.due(rows)
        level = float(kept[0]) if len(kept) else 0.0
        meters = []
        for peak in peaks[:, 0].tolist():
            level = max(peak, METER_DECAY * level)
            meters.append(level)
        self.ticks.keep([level])
        if meters:
            yield pd.DataFrame({"recording_id": key[0], "tick": ticks, "meter": meters})

    def close(self) -> None:
        pass


def meter_decay(ticks: DataFrame, late: int = LATE_TICKS) -> DataFrame:
    """A falling meter per recording; ``(recording_id, tick, peak)``, ticks numbered from 0."""
    return ticks.groupBy("recording_id").transformWithStateInPandas(
        statefulProcessor=_MeterDecay(late),
        outputStructType="recording_id string, tick long, meter double",
        outputMode="append",
        timeMode="none",
    )


def window_is_coupled(microphone: np.ndarray, system: np.ndarray) -> bool:
    """The bleed test on one short window of energies (see ``sides.bleed_coupling``)."""
    n = len(microphone)
    if n <= MAXIMUM_LAG + MINIMUM_FRAMES:
        return False
    mic = 10 * np.log10(np.maximum(microphone, 1e-12))
    sys = 10 * np.log10(np.maximum(system, 1e-12))
    if sys.max() <= SILENCE_DECIBELS + 10:
        return False
    audible = sys > sys.max() - AUDIBLE_RANGE
    for lag in range(MAXIMUM_LAG + 1):
        d = np.sort((mic[lag:] - sys[: n - lag])[audible[: n - lag]])
        if len(d) < MINIMUM_FRAMES:
            continue
        offset = d[len(d) // 10]
        near = np.mean(np.abs(d - offset) <= INLIER_BAND)
        if offset > MINIMUM_DECIBELS and near > MINIMUM_EVIDENCE:
            return True
    return False


class _BleedWatch(StatefulProcessor):
    def __init__(self, size: int, late: int):
        self.size, self.late = size, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ticks = _Ticks(handle, ["microphone", "system"], self.late)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ticks, new, kept = self.ticks.due(rows)
        if len(kept) == 1:  # it was found
            return
        before = kept.reshape(-1, 2)
        levels = np.r_[before, new]
        for k, tick in enumerate(ticks, len(before) + 1):
            window = levels[max(0, k - self.size) : k]
            if len(window) == self.size and window_is_coupled(window[:, 0], window[:, 1]):
                self.ticks.waiting = ticks[:0], new[:0]
                self.ticks.keep([1.0])
                yield pd.DataFrame({"recording_id": [key[0]], "tick": [int(tick)]})
                return
        self.ticks.keep(levels[-self.size :])

    def close(self) -> None:
        pass


def bleed_watch(ticks: DataFrame, size: int = BLEED_TICKS, late: int = LATE_TICKS) -> DataFrame:
    """Once per recording: the tick at which one channel was first heard in the other."""
    return ticks.groupBy("recording_id").transformWithStateInPandas(
        statefulProcessor=_BleedWatch(size, late),
        outputStructType="recording_id string, tick long",
        outputMode="append",
        timeMode="none",
    )


class _SilenceAlarm(StatefulProcessor):
    def __init__(self, seconds: float, forget: float):
        self.span, self.forget = round(seconds * 1_000_000), round(forget * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        seen = [(n, T.LongType()) for n in ("start", "loud", "last")] + [("done", T.BooleanType())]
        self.state = handle.getValueState("state", T.StructType([T.StructField(n, t) for n, t in seen]))

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(math.ceil(at / 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ticks = _in_order(rows, "ts")
        at = ticks["ts"].to_numpy().astype("datetime64[us]").astype("int64")
        heard = at[ticks["system"].to_numpy() > 0]
        first = int(heard[0]) if len(heard) else None
        if self.state.exists():
            start, loud, last, done = self.state.get()
        else:
            start, loud, last, done = int(at[0]), None, int(at[-1]), False
            self._wake(start + self.span)
        if not done and int(at[0]) < start:  # an earlier row came later
            self.handle.deleteTimer(math.ceil((start + self.span) / 1000))
            start = int(at[0])
            self._wake(start + self.span)
        loud = min((x for x in (loud, first) if x is not None), default=None)
        self.state.update((start, loud, max(last, int(at[-1])), done))
        yield pd.DataFrame({"recording_id": [], "alarm_at": []}).astype(
            {"recording_id": "string", "alarm_at": "int64"}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, loud, last, done = self.state.get()
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        if done and now >= last + self.forget:
            self.state.clear()
        else:
            self.state.update((start, loud, last, True))
            self._wake(max(last, now) + self.forget)
        if not done and (loud is None or loud > start + self.span):
            yield pd.DataFrame({"recording_id": [key[0]], "alarm_at": [start + self.span]})

    def close(self) -> None:
        pass


def silence_alarm(
    ticks: DataFrame, seconds: float = ALARM_SECONDS, delay: str = "1 second", forget: float = FORGET_SECONDS
) -> DataFrame:
    """Recordings whose system channel stayed silent for their first seconds.

    ``(recording_id, ts, system)``; the alarm time is in epoch microseconds. A
    recording's state goes ``forget`` seconds after its last row.
    """
    return (
        ticks.withWatermark("ts", delay)
        .groupBy("recording_id")
        .transformWithStateInPandas(
            statefulProcessor=_SilenceAlarm(seconds, forget),
            outputStructType="recording_id string, alarm_at long",
            outputMode="append",
            timeMode="EventTime",
        )
    )


class _Turns(StatefulProcessor):
    """Words in their order; another speaker's word, a gap or the end closes the turn before.

    State is one value, read and written once a batch: the next word, the end
    and the timer if there are any, the open turn, and the words that wait for
    one before them, as packed columns (speakers as places in a list of names).
    """

    def __init__(self, gap: float, forget: float):
        self.gap, self.forget = gap, round(forget * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        turn = [("first", T.LongType()), ("speaker_id", T.StringType()), ("start", T.DoubleType()), ("end", T.DoubleType()), ("n", T.LongType())]
        place = [("next", T.LongType()), ("last", T.LongType()), ("timer", T.LongType()), ("open", T.BooleanType())]
        held = [("names", T.ArrayType(T.StringType())), *[(n, T.BinaryType()) for n in ("index", "speakers", "starts", "ends")]]
        self.state = handle.getValueState("turns", T.StructType([T.StructField(n, t) for n, t in place + turn + held]))

    def _stored(self, state):
        """(next, last, timer), the open turn, and the waiting words' columns."""
        after, last, timer, is_open, *turn = state[:9]
        names, index, speakers, starts, ends = state[9:]
        held = (
            np.frombuffer(index, np.int64),
            np.array([*names, None], dtype=object)[np.frombuffer(speakers, np.int32)],  # -1: none
            np.frombuffer(starts),
            np.frombuffer(ends),
        )
        return (after, last, timer), tuple(turn) if is_open else None, held

    def _store(self, place, turn, rest) -> None:
        index, speaker, start, end = rest
        codes, names = pd.factorize(speaker)
        packed = (index.tobytes(), codes.astype(np.int32).tobytes(), start.tobytes(), end.tobytes())
        self.state.update((*place, turn is not None, *(turn or (None,) * 5), names.tolist(), *packed))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get()
        place, turn, held = self._stored(state) if state else ((0, -1, -1), None, None)
        after, last, timer = place
        seen, marks, parts = [], [], [] if held is None else [held]
        for b in rows:
            seen.append(int(b["ts"].to_numpy().astype("datetime64[ms]").astype("int64").max()))
            index, ended = b["word_idx"].to_numpy(), b["ended"].to_numpy(dtype=bool)
            marks.append(index[ended])
            mine = ~ended if index.dtype == np.int64 else ~ended & ~b["word_idx"].isna().to_numpy()
            parts.append((
                index[mine].astype(np.int64), b["speaker_id"].to_numpy(dtype=object)[mine],
                b["start"].to_numpy(dtype=float)[mine], b["end"].to_numpy(dtype=float)[mine],
            ))
        marks = np.concatenate(marks)
        last = int(marks.max()) if len(marks) else last
        words = [np.concatenate(c) for c in zip(*parts)]
        index, first = np.unique(words[0], return_index=True)  # the first of a place counts
        begin = int(np.searchsorted(index, after))
        index, first = index[begin:], first[begin:]
        n = int(np.argmin(np.r_[index == after + np.arange(len(index)), False]))
        words = [index, *(c[first] for c in words[1:])]
        closed, turn = self._closed(turn, *(c[:n] for c in words))
        after += n
        if after == last:  # the end has come, and all before it
            closed += [turn] if turn else []
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if state:
                self.state.clear()
        else:
            wake = max(timer, max(seen) + self.forget)
            if timer < 0 or wake > timer:
                if timer >= 0:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(wake)
            self._store((after, last, wake), turn, [c[n:] for c in words])
        if closed:
            yield self._rows(key, closed)

    def _closed(self, turn, index: np.ndarray, speaker: np.ndarray, start: np.ndarray, end: np.ndarray):
        """The turns that the words close, and the one they leave open."""
        if not len(index):
            return [], turn
        opens = np.r_[
            turn is None or turn[1] != speaker[0] or start[0] - turn[3] > self.gap,
            (speaker[1:] != speaker[:-1]) | (start[1:] - end[:-1] > self.gap),
        ]
        first = np.flatnonzero(opens)
        after = np.r_[first[1:], len(index)] if len(first) else first
        lead = int(first[0]) if len(first) else len(index)
        if lead:  # these go on with the open turn
            turn = (turn[0], turn[1], turn[2], float(end[lead - 1]), turn[4] + lead)
        turns = [] if turn is None else [turn]
        turns += [
            (int(index[a]), speaker[a], float(start[a]), float(end[b - 1]), b - a) for a, b in zip(first.tolist(), after.tolist())
        ]
        return turns[:-1], turns[-1]

    @staticmethod
    def _rows(key, turns: list) -> pd.DataFrame:
        first, speaker, started, closed, n = zip(*turns)
        return pd.DataFrame(
            {
                "recording_id": np.array([key[0]] * len(turns), dtype=object),
                "first_word": np.array(first, np.int64),
                "speaker_id": np.array(speaker, dtype=object),
                "started": np.array(started, float),
                "closed": np.array(closed, float),
                "n_words": np.array(n, np.int64),
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.state.get()
        _, turn, held = self._stored(state)
        closed, turn = self._closed(turn, *held)  # also words that waited for one that never came
        self.state.clear()
        closed += [turn] if turn else []
        if closed:
            yield self._rows(key, closed)

    def close(self) -> None:
        pass


def live_turns(
    words: DataFrame, gap: float = TURN_GAP, delay: str = "10 seconds", forget: float = FORGET_SECONDS
) -> DataFrame:
    """Turns as they close: the runs of one speaker's words without a gap, exactly.

    ``(recording_id, word_idx, speaker_id, start, end, ended, ts)``, words
    numbered from 0 and in any order of arrival within ``delay``; a row with
    ``ended`` has the number of words as its index and ends the recording.
    Without it, a recording's open turn closes and its state goes when the
    watermark is ``forget`` seconds past its last row.
    """
    return words.withWatermark("ts", delay).groupBy("recording_id").transformWithStateInPandas(
        statefulProcessor=_Turns(gap, forget),
        outputStructType="recording_id string, first_word long, speaker_id string, started double, closed double, n_words long",
        outputMode="append",
        timeMode="EventTime",
    )


class _Enrol(StatefulProcessor):
    """Adds partial sums to a voice; the first observation says how long its vectors are."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        voice = T.StructType(
            [T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())]
        )
        self.voice = handle.getValueState("voice", voice)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        first = (math.inf, 0)
        for part in rows:
            for total, n, obs in zip(part["total"], part["n"].tolist(), part["first"].tolist()):
                size = len(total)
                totals[size] = totals[size] + total if size in totals else np.array(total, dtype=float)
                counts[size] = counts.get(size, 0) + n
                obs = math.inf if obs is None or obs != obs else obs
                first = min(first, (obs, size)) if first[1] else (obs, size)
        stored = self.voice.get()
        if stored is None:
            mean, n = totals[first[1]] / counts[first[1]], counts[first[1]]
        else:
            mean, n = np.array(stored[0], dtype=float), stored[1]
            if more := counts.get(len(mean)):
                mean, n = (mean * n + totals[len(mean)]) / (n + more), n + more
        self.voice.update((mean.tolist(), int(n)))
        yield pd.DataFrame(
            {"person": [key[0]], "sample_count": [int(n)], "embedding": [mean.tolist()]}
        )

    def close(self) -> None:
        pass


_SUMS = pa.schema(
    [("person", pa.string()), ("first", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.float64()))]
)


def _voice_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partial sum for each person and length of vectors in a batch."""
    for batch in batches:
        vectors = batch["embedding"]
        places = pa.table(
            {"person": batch["person"], "size": vectors.value_lengths(), "at": np.arange(len(batch)), "first": batch["obs_id"]}
        )
        sums = []
        for group in places.group_by(["person", "size"]).aggregate([("at", "list"), ("first", "min")]).to_pylist():
            values = vectors.take(pa.array(group["at_list"])).flatten().to_numpy(zero_copy_only=False)
            total = values.reshape(-1, group["size"]).sum(axis=0).tolist()
            sums.append({"person": group["person"], "first": group["first_min"], "n": len(group["at_list"]), "total": total})
        yield pa.RecordBatch.from_pylist(sums, _SUMS)


def enrol(observations: DataFrame) -> DataFrame:
    """Running mean voice per name as confirmations arrive; ``(name, obs_id, embedding)``.

    What is shuffled are partial sums, so a name may have any number of
    observations in a micro-batch.
    """
    named = (
        observations.withColumn("person", F.lower(F.trim("name")))
        .where((F.col("person") != "") & (F.size("embedding") > 0))
        .select("person", F.col("obs_id").cast("long").alias("obs_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    )
    sums = named.mapInArrow(_voice_sums, "person string, first long, n long, total array<double>")
    return sums.groupBy("person").transformWithStateInPandas(
        statefulProcessor=_Enrol(),
        outputStructType="person string, sample_count long, embedding array<double>",
        outputMode="update",
        timeMode="none",
    )
