"""Folds as stateful stream operators (``transformWithStateInPandas``), with frames put in order by event time.

A key's rows wait in a buffer until the watermark has passed their frame's time, then go through the same step function
as in batch, in frame order. Rows that come later than the watermark are not folded; they come out flagged ``late`` so
they can be counted. The stream must have ``event_ts`` and a watermark; state is in the RocksDB store.

Each call on the state is a message to the engine, so rows are kept in few: a trigger's rows of a key go in runs of up to
``RUN`` rows in order of time, few rows into the newest run while it has room, beside the sorted list of the runs' first times.
A key has one timer, for its earliest waiting row; when it fires, only runs that begin by the watermark are read, and what
is left of one is written back, so a release costs what it releases and a part of a run at most, whatever else waits. The fold's state is kept in parts (of the crowd
of ``stabilise_ids``: each person, and each look of a person's gallery; of slots: each id), and only parts that a
trigger has changed are written. A key that has been idle for ``idle_ms`` of event time after its last row (a match that has
ended) gives up its state; if it comes back, it starts afresh.
"""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..operators import folds, stable_ids
from ..operators.windows import team_memory  # noqa: F401  the batch form that stream_team_memory equals
from ..params import BALL, DEFAULTS, Params

#: Settings a session needs for these operators.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Rows of a run of the buffer, and event time after which an idle key is given up, in milliseconds.
RUN, IDLE_MS = 256, 3_600_000


def with_event_time(df: DataFrame, start: str = "2024-01-01 00:00:00", fps: float = DEFAULTS.fps, delay: str = "2 seconds") -> DataFrame:
    """Adds ``event_ts`` (match start + frame / fps) and its watermark."""
    micros = F.unix_micros(F.to_timestamp(F.lit(start))) + (F.col("frame") / fps * 1_000_000).cast("bigint")
    return df.withColumn("event_ts", F.timestamp_micros(micros)).withWatermark("event_ts", delay)


def crowd_parts(s: stable_ids.Crowd) -> dict[str, bytes]:
    """A crowd as parts: what all share, each person with its average look, each look of a gallery."""
    looks = s.looks
    out = {"": pickle.dumps((s.by_raw, s.next, s.frame, s.boxes, looks.data.shape[1:]))}
    for sid, p in s.people.items():
        own = looks.data[p.row, : int(looks.n[p.row])] if looks.data.size else []
        names = []
        for look in own[1:]:
            raw = look.tobytes()
            names.append(f"{sid}:{hashlib.blake2b(raw, digest_size=12).hexdigest()}")
            out[names[-1]] = raw
        mean = own[0].tobytes() if len(own) else None
        out[str(sid)] = pickle.dumps((sid, p.at, p.seen, p.raw, p.velocity, p.row, p.team, p.votes, p.lock_until, mean, names))
    return out


def crowd_of(parts: dict[str, bytes]) -> stable_ids.Crowd:
    s = stable_ids.Crowd()
    s.by_raw, s.next, s.frame, s.boxes, shape = pickle.loads(parts[""])
    people = sorted((pickle.loads(v) for k, v in parts.items() if k and ":" not in k), key=lambda x: x[0])
    looks = s.looks
    looks.data, looks.square, looks.n = np.zeros((len(people), *shape)), np.zeros((len(people), shape[0])), np.zeros(len(people), np.int64)
    for sid, at, seen, raw, velocity, row, team, votes, lock, mean, names in people:
        s.people[sid] = stable_ids.Person(at, seen, raw, velocity, row, team, votes, lock)
        for k, data in enumerate([mean, *(parts[n] for n in names)] if mean is not None else []):
            look = np.frombuffer(data)
            looks.data[row, k], looks.square[row, k], looks.n[row] = look, look @ look, k + 1
    return s


def slot_parts(s: folds.Slots) -> dict[str, bytes]:
    return {str(i): pickle.dumps((s.slot.get(i), seen)) for i, seen in s.seen.items()}


def slots_of(parts: dict[str, bytes]) -> folds.Slots:
    s = folds.Slots()
    for i, data in parts.items():
        slot, s.seen[int(i)] = pickle.loads(data)
        if slot is not None:
            s.slot[int(i)] = slot
    return s


#: How states are taken apart and put together; others are one part.
PARTS = {stable_ids.Crowd: (crowd_parts, crowd_of), folds.Slots: (slot_parts, slots_of)}
WHOLE = (lambda s: {"": pickle.dumps(s)}, lambda parts: pickle.loads(parts[""]))


def records(piece: pd.DataFrame) -> Iterator[dict]:
    """A dict a row; nulls and NaN are None."""
    columns = []
    for c in piece.columns:
        values, bare = piece[c].tolist(), piece[c].isna()
        columns.append([None if no else v for v, no in zip(values, bare)] if bare.any() else values)
    return (dict(zip(piece.columns, row)) for row in zip(*columns))


class Fold(StatefulProcessor):
    """Buffers rows by time; rows before the watermark go through ``step``, frame by frame."""

    def __init__(self, state: Callable[[], object], step: folds.Step, names: list[str], order: list[str], idle_ms: int = IDLE_MS):
        self.make, self.step, self.names, self.order, self.idle_ms = state, step, names, order, idle_ms
        self.apart, self.together = PARTS.get(state, WHOLE)

    def init(self, handle: StatefulProcessorHandle) -> None:
        blob = StructType([StructField("v", BinaryType())])
        self.handle = handle
        self.parts = handle.getMapState("parts", StructType([StructField("part", StringType())]), blob)
        self.runs = handle.getMapState("runs", StructType([StructField("run", LongType())]), blob)
        self.index = handle.getValueState("index", blob)

    def _out(self, rows: list[dict], late: int = 0) -> pd.DataFrame:
        return pd.DataFrame({c: [r.get(c) for r in rows] for c in self.names} | {"late": [late] * len(rows)})

    def _rank(self, r: dict) -> tuple:
        return tuple((r[c[1:]] is None, -(r[c[1:]] or 0)) if c[0] == "-" else (r[c] is None, r[c] or 0) for c in self.order)

    def _read(self) -> tuple[list[tuple[int, int, int]], int | None, int]:
        """Waiting runs in order (first time, number, rows), the timer's time, the latest row's time."""
        if not self.index.exists():
            return [], None, 0
        timer, last, *flat = np.frombuffer(self.index.get()[0], "<i8").tolist()
        return list(zip(flat[::3], flat[1::3], flat[2::3])), timer, last

    def _save(self, waiting: list[tuple[int, int, int]], old: int | None, timer: int, last: int) -> None:
        if timer != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timer)
        self.index.update((np.array([timer, last, *(x for run in waiting for x in run)], "<i8").tobytes(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        new: list[tuple[int, dict]] = []
        late: list[dict] = []
        for piece in rows:
            for r in records(piece):
                ms = int(r.pop("event_ms"))
                if ms <= mark:
                    late.append({c: r.get(c) for c in self.names})
                else:
                    new.append((ms, r))
        if new:
            new.sort(key=itemgetter(0))
            waiting, timer, last = self._read()
            # a timer of a key without waiting rows is the one that gives the key up
            due = new[0][0] if not waiting else min(new[0][0], timer)
            last = max(last, new[-1][0])
            newest = max(waiting, key=itemgetter(1), default=(0, -1, RUN))
            number = newest[1] + 1
            if newest[2] + len(new) <= RUN:
                number = newest[1]
                waiting.remove(newest)
                new = sorted(pickle.loads(self.runs.getValue((number,))[0]) + new, key=itemgetter(0))
            for k in range(0, len(new), RUN):
                run = new[k : k + RUN]
                self.runs.updateValue((number,), (pickle.dumps(run),))
                waiting.append((run[0][0], number, len(run)))
                number += 1
            self._save(sorted(waiting), timer, due, last)
        if late:
            yield self._out(late, 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting, _, last = self._read()
        if not waiting:
            for state in (self.parts, self.runs, self.index):
                state.clear()
            return
        n = bisect_right(waiting, mark, key=itemgetter(0))
        due: list[tuple[int, dict]] = []
        left = waiting[n:]
        for _, number, _ in waiting[:n]:
            held = pickle.loads(self.runs.getValue((number,))[0])
            cut = bisect_right(held, mark, key=itemgetter(0))
            due += held[:cut]
            if rest := held[cut:]:
                self.runs.updateValue((number,), (pickle.dumps(rest),))
                left.append((rest[0][0], number, len(rest)))
            else:
                self.runs.removeKey((number,))
        yield self._out(self._fold(due))
        left.sort()
        self._save(left, None, max(left[0][0] if left else last + self.idle_ms, mark + 1), last)  # the timer that fired is gone

    def _fold(self, due: list[tuple[int, dict]]) -> list[dict]:
        if not due:
            return []
        old = {k[0]: bytes(v[0]) for k, v in self.parts.iterator()}
        state = self.together(old) if old else self.make()
        out: list[dict] = []
        due.sort(key=lambda x: (x[0], *self._rank(x[1])))
        for _, rows in groupby(due, key=lambda x: x[0]):
            frame = [r for _, r in rows]
            out += self.step(state, frame[0]["frame"], frame)
        new = self.apart(state)
        for k, v in new.items():
            if old.get(k) != v:
                self.parts.updateValue((k,), (v,))
        for k in old.keys() - new.keys():
            self.parts.removeKey((k,))
        return out

    def close(self) -> None:
        pass


def stream_fold(df: DataFrame, keys: list[str], order: list[str], state: Callable[[], object], step: folds.Step, schema: str, idle_ms: int = IDLE_MS) -> DataFrame:
    """``folds.fold`` over a stream with ``event_ts`` and a watermark; one more column ``late`` (1: came too late)."""
    names = [c.split()[0] for c in schema.split(",")]
    # the time goes on as a number, so Spark does not drop late rows before they can be counted
    rows = df.withColumn("event_ms", F.unix_millis("event_ts")).drop("event_ts")
    return rows.groupBy(*keys).transformWithStateInPandas(Fold(state, step, names, order, idle_ms), schema + ", late int", "append", "EventTime")


def stream_smooth_ball(candidates: DataFrame) -> DataFrame:
    """``candidates``: as ``folds.ball_input`` gives them (a row with nulls for a frame without a ball), with event time."""
    return stream_fold(candidates, ["match_id"], ["-conf", "x1", "y1"], folds.Ball, folds.ball_step, folds.BALL_SCHEMA)


def stream_display_slots(people: DataFrame, p: Params = DEFAULTS, limits: dict[int, int] | None = None) -> DataFrame:
    rows = people.filter(F.col("class_id") != BALL).select("match_id", "frame", "class_id", "track_id", "event_ts")
    return stream_fold(rows, ["match_id", "class_id"], ["track_id"], folds.Slots, folds.slot_dispatch(limits or folds.caps(p)), folds.SLOT_SCHEMA)


def stream_stabilise(people: DataFrame, rules=None) -> DataFrame:
    """``people``: all columns that ``stable_ids.stabilise_ids`` reads, with event time."""
    rows = people.filter(F.col("class_id") != BALL)
    return stream_fold(rows, ["match_id", "class_id"], ["-conf", "x1", "y1", "x2", "y2"], stable_ids.Crowd, stable_ids.role_step(rules), stable_ids.SCHEMA)


class Votes:
    """State of one id: its last votes and its lock."""

    def __init__(self) -> None:
        self.last: list[int] = []
        self.lock: int | None = None


def vote_step(p: Params = DEFAULTS) -> folds.Step:
    def step(s: Votes, frame: int, rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            if r["team_id"] is None or r["team_id"] < 0:
                continue
            s.last = [*s.last, r["team_id"]][-p.vote_history :]
            ones = sum(s.last)
            zeros = len(s.last) - ones
            team = -1 if len(s.last) < p.min_votes else 0 if zeros > ones else 1 if ones > zeros else s.last[0]
            if s.lock is None and len(s.last) >= p.min_votes and max(ones, zeros) >= p.lock_share * len(s.last):
                s.lock = team
            out.append({"match_id": r["match_id"], "frame": frame, "track_id": r["track_id"], "memory_team": team if s.lock is None else s.lock, "locked": int(s.lock is not None)})
        return out

    return step


VOTE_SCHEMA = "match_id bigint, frame bigint, track_id bigint, memory_team int, locked int"


def stream_team_memory(people: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    rows = people.select("match_id", "frame", "track_id", "team_id", "event_ts")
    return stream_fold(rows, ["match_id", "track_id"], [], Votes, vote_step(p), VOTE_SCHEMA)


def running_kpis(tracks: DataFrame) -> DataFrame:
    """Additive counters of each match, for update mode."""
    ball = F.col("class_id") == BALL
    return tracks.groupBy("match_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("class_id") == 2).alias("player_rows"), F.count_if(ball & (F.col("ball_interpolated") == 0)).alias("ball_rows"), F.count_if(ball & (F.col("ball_interpolated") == 1)).alias("imputed_ball_rows"), F.count("x_m").alias("placed_rows"))


def replay(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, ``files`` a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
