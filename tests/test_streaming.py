"""Stream = batch on the same input; late rows are flagged, not folded."""

import pickle
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import folds, rows, stable_ids, windows
from touchline.plans import catalog
from touchline.plans.registry import Views
from touchline.streaming import replay
from touchline.streaming import stateful as st


@pytest.fixture(scope="module")
def small(spark, sf):
    for k, v in st.SETTINGS.items():
        spark.conf.set(k, v)
    v = Views(spark, sf)
    t = v.fx_tracks.filter("match_id = 1 AND frame < 160").withColumn("track_id", F.col("display_track_id"))
    return t.localCheckpoint(), v.fx_frames.filter("match_id = 1 AND frame < 160").localCheckpoint()


def played(spark, df, tmp_path, make, parts=3):
    """Writes ``df`` in frame ranges as files, plays them one a trigger, and returns what came out."""
    folder = str(tmp_path / "in")
    last = df.agg(F.max("frame")).first()[0]
    step = last // parts + 1
    for k in range(parts):
        df.filter((F.col("frame") >= k * step) & (F.col("frame") < (k + 1) * step)).coalesce(1).write.mode("append").parquet(folder)
    # one row far ahead moves the watermark past all frames
    end = df.limit(1).withColumn("frame", F.lit(last + 10_000).cast("bigint"))
    end.coalesce(1).write.mode("append").parquet(folder)
    for k in (20_000, 30_000):
        end.withColumn("frame", F.lit(last + k).cast("bigint")).coalesce(1).write.mode("append").parquet(folder)
    stream = make(st.with_event_time(st.replay(spark, folder, df.schema)))
    name = "t" + tmp_path.name.replace("-", "_")
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).filter(F.col("frame") <= last)


def same(a, b, cols):
    key = lambda df: sorted(map(repr, df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.select(*cols).dtypes]).collect()))
    assert key(a) == key(b) and a.count() > 0


def test_ball(spark, small, tmp_path):
    t, f = small
    x = folds.ball_input(t, f)
    cols = ["match_id", "frame", "x1", "y1", "conf", "ball_interpolated"]
    same(played(spark, x, tmp_path, st.stream_smooth_ball), folds.smooth_ball(t, f), cols)


def test_slots_and_memory(spark, small, tmp_path):
    t, _ = small
    one = t.filter("class_id = 2").dropDuplicates(["frame", "track_id"]).select("match_id", "frame", "class_id", "track_id", "team_id").localCheckpoint()
    limits = {2: 5}
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    same(played(spark, one, tmp_path / "a", lambda s: st.stream_display_slots(s, limits=limits)), folds.display_slots(one, limits=limits), ["frame", "track_id", "display_track_id"])
    batch = windows.team_memory(one, "track_id").withColumn("locked", F.col("locked").cast("int"))
    same(played(spark, one, tmp_path / "b", st.stream_team_memory), batch, ["frame", "track_id", "memory_team", "locked"])


def test_late_rows_are_flagged(spark, small, tmp_path):
    t, f = small
    x = folds.ball_input(t, f)
    folder = str(tmp_path / "in")
    for k in (100, 140, 20):  # frame 20 comes long after the watermark has passed it
        x.filter(F.col("frame") == k).limit(1).coalesce(1).write.mode("append").parquet(folder)
    stream = st.stream_smooth_ball(st.with_event_time(st.replay(spark, folder, x.schema), delay="1 millisecond"))
    q = stream.writeStream.format("memory").queryName("late_rows").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["frame"] for r in spark.table("late_rows").filter("late = 1").collect()] == [20]


def test_stateless_filters_and_counters(spark, small, tmp_path):
    t, _ = small
    folder = str(tmp_path / "in")
    t.repartition(3).write.parquet(folder)
    s = st.running_kpis(rows.class_conf_filter(st.replay(spark, folder, t.schema)))
    q = s.writeStream.format("memory").queryName("kpis").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = st.running_kpis(rows.class_conf_filter(t)).collect()
    assert [tuple(r) for r in spark.table("kpis").collect()] == [tuple(r) for r in want]


class Store:
    """State variables in memory, counting what is read and written."""

    def __init__(self, told):
        self.told, self.data = told, {}

    def exists(self):
        return () in self.data

    def get(self):
        return self.getValue(())

    def update(self, v):
        self.updateValue((), v)

    def getValue(self, k):
        self.told["read"] += 1
        return self.data[k]

    def updateValue(self, k, v):
        self.told["bytes"] += len(v[0])
        self.told["written"] += 1
        self.data[k] = v

    def removeKey(self, k):
        del self.data[k]

    def iterator(self):
        return iter(list(self.data.items()))

    def clear(self):
        self.data.clear()


class Engine:
    """Runs a ``Fold`` for one key as the engine does: input, then expired timers, then the watermark moves."""

    def __init__(self, fold):
        self.told, self.timers, self.mark, self.calls, self.fold = Counter(), set(), 0, 0, fold
        self.stores = {}
        fold.init(self)

    def _store(self, name, *_):
        return self.stores.setdefault(name, Store(self.told))

    getMapState = getValueState = _store

    def registerTimer(self, ms):
        assert ms > self.mark
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)

    def getCurrentWatermarkInMs(self):
        return self.mark

    def trigger(self, rows, mark=None):
        import pandas as pd

        out = []
        if rows:
            for df in self.fold.handleInputRows((1,), iter([pd.DataFrame(rows)]), self):
                out += df.to_dict("records")
        for ms in sorted(t for t in self.timers if t <= self.mark):
            self.timers.discard(ms)
            self.calls += 1
            for df in self.fold.handleExpiredTimer((1,), self, None):
                out += df.to_dict("records")
        self.mark = max(self.mark, mark or 0)
        return out


def told_step(state, frame, rows):
    state["n"] = state.get("n", 0) + 1
    return [{"frame": frame, "n": state["n"]} for _ in rows]


def test_release_is_linear_in_what_is_released():
    """50,000 frames wait; each of 50 triggers reads the chunks that it releases, by one timer, in order."""
    e = Engine(st.Fold(dict, told_step, ["frame", "n"], []))
    frames = list(range(50_000))
    random.Random(1).shuffle(frames)
    for k in range(0, 50_000, 10_000):
        assert e.trigger([{"frame": f, "event_ms": 10 + f * 40} for f in frames[k : k + 10_000]]) == []
        assert len(e.timers) == 1
    e.told.clear()
    out, began = [], time.time()
    for k in range(1, 51):
        e.mark = 40_000 * k
        out += e.trigger([])
    e.mark = 10_000_000
    out += e.trigger([])
    assert [r["frame"] for r in out] == list(range(50_000)) and [r["n"] for r in out] == list(range(1, 50_001))
    assert e.calls <= 51 and e.told["read"] < 2 * 2000 + 3 * 51 and time.time() - began < 20


def test_few_calls_on_the_state_for_many_rows():
    """A minute of rows of a key comes in and goes out by a few calls; rows of small triggers share a run."""
    e = Engine(st.Fold(dict, told_step, ["frame", "n"], []))
    e.trigger([{"frame": f, "event_ms": 10 + f * 400} for f in range(150)])
    e.mark = 100_000
    assert [r["frame"] for r in e.trigger([])] == list(range(150)) and e.told["read"] + e.told["written"] <= 8
    for f in range(1000, 1600):
        e.trigger([{"frame": f, "event_ms": f * 400}])
    assert len(e.stores["runs"].data) <= 1 + 600 // st.RUN
    e.mark = 500_000
    assert [r["frame"] for r in e.trigger([])] == list(range(1000, 1251)) and len(e.timers) == 1
    e.mark = 640_000
    assert [r["frame"] for r in e.trigger([])] == list(range(1251, 1600)) and not e.stores["runs"].data


def test_late_rows_and_idle_keys():
    e = Engine(st.Fold(dict, told_step, ["frame", "n"], [], idle_ms=5000))
    e.trigger([{"frame": 0, "event_ms": 100}, {"frame": 1, "event_ms": 2100}], mark=1500)
    assert [(r["frame"], r["late"]) for r in e.trigger([{"frame": 9, "event_ms": 900}], mark=3000)] == [(9, 1), (0, 0)]
    assert [(r["frame"], r["n"]) for r in e.trigger([], mark=6000)] == [(1, 2)] and e.timers == {7100}
    e.trigger([{"frame": 3, "event_ms": 6500}], mark=7000)  # back before it is given up
    assert [(r["frame"], r["n"]) for r in e.trigger([], mark=11_400)] == [(3, 3)] and e.timers == {11_500}
    assert e.trigger([], mark=12_000) == [] and any(s.data for s in e.stores.values())
    assert e.trigger([], mark=12_000) == [] and not e.timers and not any(s.data for s in e.stores.values())
    e.trigger([{"frame": 7, "event_ms": 12_500}], mark=13_000)
    assert [(r["frame"], r["n"]) for r in e.trigger([])] == [(7, 1)]  # afresh


def crowd_rows(frames, seed=0):
    """22 people that walk, some unseen at times, with a look each that changes a little."""
    rnd = np.random.default_rng(seed)
    looks = rnd.normal(size=(22, 16))
    for f in range(frames):
        rows = []
        for k in np.flatnonzero(rnd.random(22) < 0.9):
            look = looks[k] + 0.3 * rnd.normal(size=16)
            x = 80.0 * k + 5 * np.sin(f / 9 + k)
            rows.append({"match_id": 1, "frame": f, "class_id": 2, "conf": float(rnd.random()), "x1": x, "y1": 100.0, "x2": x + 30, "y2": 180.0, "team_id": int(k % 2), "tracker_id": int(k) if rnd.random() < 0.9 else None, "appearance": (look / np.linalg.norm(look)).tolist()})
        yield f, rows


def test_crowd_in_parts_is_the_crowd_and_little_is_written():
    """Equal to the fold in one piece; bytes of state a frame beside those of the whole state."""
    step = stable_ids.role_step()
    whole, want, whole_bytes = stable_ids.Crowd(), [], 0
    e = Engine(st.Fold(stable_ids.Crowd, step, [c.split()[0] for c in stable_ids.SCHEMA.split(", ")], ["-conf", "x1", "y1", "x2", "y2"]))
    got = []
    for f, rows in crowd_rows(120):
        want += step(whole, f, sorted(rows, key=lambda r: (-r["conf"], r["x1"])))
        whole_bytes += len(pickle.dumps(whole))
        e.told["frame rows"] += sum(len(pickle.dumps(r)) for r in rows)
        got += e.trigger([r | {"event_ms": 40 + 40 * f} for r in rows], mark=40 + 40 * f)
    got += e.trigger([])
    key = lambda rows: [(r["frame"], r["track_id"], r["assign_reason"], r["stable_team"], round(r["x1"], 9)) for r in rows]
    assert key(got) == key(want) and all(r["late"] == 0 for r in got)
    parts, buffered = sum(len(v[0]) for v in e.stores["parts"].data.values()), e.told["bytes"]
    print(f"state written a frame: {buffered // 120} bytes with the buffer, whole state {whole_bytes // 120}; held {parts}")
    assert buffered < whole_bytes / 2
    again = st.crowd_of(st.crowd_parts(whole))
    assert st.crowd_parts(again) == st.crowd_parts(whole)


def test_queries_equal_batch(spark, sf):
    same(catalog.QUERIES["r1_stream_smooth_ball"](spark, sf), catalog.QUERIES["t1_smooth_ball"](spark, sf), ["match_id", "frame", "x1", "y1", "conf", "ball_interpolated"])
    same(catalog.QUERIES["r1_stream_display_slots"](spark, sf), catalog.QUERIES["t3_display_slots"](spark, sf), ["match_id", "frame", "class_id", "track_id", "display_track_id", "evicted"])


def test_stream_stabilise(spark, small):
    t, _ = small
    look = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.sin(k * (1 + F.col("display_track_id")) + F.col("frame") / 50))
    norm = F.sqrt(F.aggregate(look, F.lit(0.0), lambda s, x: s + x * x))
    rows = t.withColumn("tracker_id", F.col("display_track_id")).withColumn("appearance", F.transform(look, lambda x: x / norm)).select("match_id", "frame", "class_id", "conf", "x1", "y1", "x2", "y2", "team_id", "tracker_id", "appearance")
    same(replay.played(rows.filter("class_id <> 0"), st.stream_stabilise), stable_ids.stabilise_ids(rows), ["match_id", "frame", "class_id", "x1", "y1", "track_id", "assign_reason", "stable_team"])
