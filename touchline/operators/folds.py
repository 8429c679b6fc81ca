"""Order-dependent operators: folds over frames in order within a key.

``fold`` partitions and sorts once, then hands each key's frames to a pure step function in order, piece by piece
(``maxRecordsPerBatch``), so a task holds one key's state and one frame, never a whole match. The same step functions
run in Structured Streaming (``touchline.streaming``). A single key is not split: its state is sequential.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.boxes import centre
from ..params import BALL, DEFAULTS, KEEPER, PLAYER, REFEREE, Params
from .joins import pairwise_iou

KEY = ["match_id", "frame"]
Step = Callable[[object, int, list[dict]], list[dict]]


#: Types of the columns that a fold gives.
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}


def values_of(column: pa.Array) -> list:
    """A column's values; null and NaN are None, arrays are numpy arrays."""
    if pa.types.is_list(column.type):
        flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        return [flat[a:b] if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), column.is_valid().to_pylist())]
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_floating(column.type):
        lone = column.to_numpy(zero_copy_only=False)
        out = lone.tolist()
        for k in np.flatnonzero(np.isnan(lone)).tolist():  # a null is a NaN here too
            out[k] = None
        return out
    return column.to_pylist()


def frames_of(pieces: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """(frame, rows) in order; a frame that straddles two pieces is put together."""
    held: tuple[int, list[dict]] | None = None
    for piece in pieces:
        names = piece.schema.names
        records = [dict(zip(names, row)) for row in zip(*map(values_of, piece.columns))]
        for frame, rows in groupby(records, key=itemgetter("frame")):
            rows = list(rows)
            if held and held[0] == frame:
                held[1].extend(rows)
                continue
            if held:
                yield held
            held = frame, rows
    if held:
        yield held


def fold(df: DataFrame, keys: list[str], order: list[str], state: Callable[[], object], step: Step, schema: str) -> DataFrame:
    """Rows of ``step(state, frame, rows)`` for each key's frames in order; ``order`` ranks the rows of a frame."""
    types = pa.schema([(name, ARROW[kind]) for name, kind in (c.split() for c in schema.split(","))])

    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type, from_pandas=True) for f in types], schema=types)

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, out = state(), []
        for frame, rows in frames_of(pieces):
            out += step(s, frame, rows)
            if len(out) > 10_000:
                yield table(out)
                out = []
        yield table(out)

    by = [*keys, "frame", *order]
    ordered = df.repartition(*keys).sortWithinPartitions(*[F.col(c[1:]).desc() if c[0] == "-" else F.col(c) for c in by])
    return ordered.groupBy(*keys).applyInArrow(run, schema)


def iou(a: tuple, b: tuple) -> float:
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 1e-6 else 0.0


def xyxy(r: dict) -> tuple[float, float, float, float]:
    return r["x1"], r["y1"], r["x2"], r["y2"]


# ---- T1: ball smoother ------------------------------------------------------------------------------------------


@dataclass
class Ball:
    """State of one match's ball."""

    at: np.ndarray | None = None
    velocity: np.ndarray = field(default_factory=lambda: np.zeros(2))
    size: np.ndarray = field(default_factory=lambda: np.zeros(2))
    area: float = 0.0
    missing: int = 0
    measured: bool = False

    def gate(self) -> float:
        return min(600.0, 90 + 3 * float(np.hypot(*self.velocity)) if self.measured else 300.0)

    def accept(self, at: np.ndarray, size: np.ndarray) -> None:
        size = np.maximum(size, 2.0)
        if self.at is not None:
            seen = (at - self.at) / (self.missing + 1)
            self.velocity, self.measured = 0.5 * seen + 0.5 * self.velocity, True
        area = float(size.prod())
        self.area = area if self.area <= 0 else 0.7 * self.area + 0.3 * area
        self.at, self.size, self.missing = at, size, 0


def ball_step(s: Ball, frame: int, rows: list[dict]) -> list[dict]:
    """One row a frame at most: the accepted ball, or for up to eight missed frames its extrapolation.

    Rows may carry ``off_pitch``: such a ball counts only inside the gate around the prediction.
    """
    seen = [r for r in rows if r["x1"] is not None and r["conf"] is not None and r["conf"] >= 0.12]
    if s.area > 0:
        seen = [r for r in seen if (r["x2"] - r["x1"]) * (r["y2"] - r["y1"]) <= 5 * s.area]
    places = [np.array([(r["x1"] + r["x2"]) / 2, (r["y1"] + r["y2"]) / 2]) for r in seen]
    pick = None
    if seen and s.at is None:
        inside = [k for k, r in enumerate(seen) if not r.get("off_pitch")]
        pick = max(inside, key=lambda k: (seen[k]["conf"], -k), default=None)
    elif seen:
        far = [float(np.hypot(*(p - s.at - s.velocity))) for p in places]
        pick = min(range(len(seen)), key=lambda k: (far[k], k))
        pick = pick if far[pick] <= s.gate() else None
    key = {"match_id": rows[0]["match_id"], "frame": frame}
    if pick is not None:
        r = seen[pick]
        s.accept(places[pick], np.array([r["x2"] - r["x1"], r["y2"] - r["y1"]]))
        return [key | {c: r[c] for c in ("x1", "y1", "x2", "y2", "conf")} | {"ball_interpolated": 0}]
    s.missing += 1
    if s.at is None or s.missing > 10:
        s.__init__()
        return []
    s.measured = False
    if s.missing > 8:
        return []
    s.velocity = 0.85 * s.velocity
    s.at = s.at + s.velocity
    a, b = s.at - s.size / 2, s.at + s.size / 2
    return [key | {"x1": a[0], "y1": a[1], "x2": b[0], "y2": b[1], "conf": 1.0, "ball_interpolated": 1}]


BALL_SCHEMA = "match_id bigint, frame bigint, x1 double, y1 double, x2 double, y2 double, conf double, ball_interpolated int"


def ball_input(tracks: DataFrame, frames: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Every frame of the log with its ball candidates (nulls where it has none)."""
    cols = ["x1", "y1", "x2", "y2", "conf", *[c for c in ("x_m", "y_m") if c in tracks.columns]]
    off = ~(F.col("x_m").between(-p.margin_x, p.pitch_length + p.margin_x) & F.col("y_m").between(-p.margin_y, p.pitch_width + p.margin_y)) if "x_m" in cols else F.lit(False)
    ball = tracks.filter(F.col("class_id") == BALL).select(*KEY, *cols[:5], F.coalesce(off, F.lit(False)).alias("off_pitch"))
    return frames.select(*KEY).distinct().join(ball, KEY, "left")


#: Missed frames after which the smoother has forgotten everything, and the least confidence of a candidate.
FORGETS, LEAST = 11, 0.12


def ball_segments(candidates: DataFrame) -> DataFrame:
    """Adds ``_segment``: a new one begins where candidates come back after so many frames without any that the smoother is fresh."""
    seen = F.col("x1").isNotNull() & (F.col("conf") >= LEAST)
    by_frame = Window.partitionBy("match_id").orderBy("frame")
    n = F.dense_rank().over(by_frame)
    before = F.max(F.when(F.col("_seen"), F.col("_n"))).over(by_frame.rangeBetween(Window.unboundedPreceding, -1))
    numbered = candidates.withColumns({"_n": n, "_seen": F.coalesce(seen, F.lit(False))})
    begins = numbered.withColumn("_begins", F.coalesce(F.col("_seen") & (F.col("_n") - before > FORGETS), F.lit(False)).cast("int"))
    # all rows of a frame count, so its rows stay together
    return begins.withColumn("_segment", F.sum("_begins").over(by_frame.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("_n", "_seen", "_begins")


def smooth_ball(tracks: DataFrame, frames: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The smoothed ball of every match; a match is folded in the segments of ``ball_segments``, apart from one another."""
    return fold(ball_segments(ball_input(tracks, frames, p)), ["match_id", "_segment"], ["-conf", "x1", "y1"], Ball, ball_step, BALL_SCHEMA)


# ---- T3: display slots ------------------------------------------------------------------------------------------


@dataclass
class Slots:
    """Slots of one (match, class): stable id by slot, slot by stable id, last frame of each id."""

    slot: dict[int, int] = field(default_factory=dict)
    seen: dict[int, int] = field(default_factory=dict)


def slot_of(s: Slots, cap: int, frame: int, sid: int) -> tuple[int, int | None]:
    """Slot of an id, and the id that gave it up for this one."""
    if sid < 0 or cap <= 0:
        return sid if sid >= 0 else -1, None
    s.seen[sid], evicted = frame, None
    if sid not in s.slot:
        taken = set(s.slot.values())
        free = next((k for k in range(1, cap + 1) if k not in taken), None)
        if free is None:
            evicted = min(s.slot, key=lambda i: (s.seen[i], s.slot[i]))
            free = s.slot.pop(evicted)
        s.slot[sid] = free
    return s.slot[sid], evicted


def slot_step(cap: int) -> Step:
    """Each row with ``display_track_id`` and whether a slot was taken over (``evicted``)."""

    def step(s: Slots, frame: int, rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            shown, evicted = slot_of(s, cap, frame, r["track_id"])
            out.append({"match_id": r["match_id"], "frame": frame, "class_id": r["class_id"], "track_id": r["track_id"], "display_track_id": shown, "evicted": evicted})
        return out

    return step


def slots_of(s: Slots, cap: int, frame: np.ndarray, sid: np.ndarray, least: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """``slot_of`` for rows in order; evicted -1: none. Stretches whose ids all hold a slot are taken at once."""
    shown, evicted = np.where(sid >= 0, sid, -1), np.full(len(sid), -1)
    a, width = 0, least
    while cap > 0 and a < len(sid):
        b = min(len(sid), a + width)
        ids, back = np.unique(sid[a:b], return_inverse=True)
        held = [-1 if i < 0 else s.slot.get(i) for i in ids.tolist()]
        if None in held:
            for k in range(a, b):
                shown[k], gone = slot_of(s, cap, int(frame[k]), int(sid[k]))
                evicted[k] = -1 if gone is None else gone
            width = least
        else:
            shown[a:b] = np.array(held)[back]
            last = np.empty(len(ids), np.int64)
            last[back] = frame[a:b]  # frames ascend and the last one counts
            s.seen.update((i, f) for i, f in zip(ids.tolist(), last.tolist()) if i >= 0)
            width = min(2 * width, 1 << 14)
        a = b
    return shown, evicted


SLOT_SCHEMA = "match_id bigint, frame bigint, class_id int, track_id bigint, display_track_id bigint, evicted bigint"


def caps(p: Params = DEFAULTS) -> dict[int, int]:
    return {PLAYER: p.max_players, KEEPER: p.max_keepers, REFEREE: p.max_referees}


def slot_dispatch(limits: dict[int, int]) -> Step:
    steps = {c: slot_step(n) for c, n in limits.items()}
    return lambda s, frame, rows: steps.get(rows[0]["class_id"], slot_step(0))(s, frame, rows)


def display_slots(tracks: DataFrame, p: Params = DEFAULTS, limits: dict[int, int] | None = None) -> DataFrame:
    """(match_id, frame, class_id, track_id, display_track_id, evicted): stable ids in slots 1..cap of their class."""
    limits = limits or caps(p)
    kinds = pa.schema([(name, ARROW[kind]) for name, kind in (c.split() for c in SLOT_SCHEMA.split(","))])

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Slots()
        for piece in pieces:
            if piece.num_rows:
                shown, evicted = slots_of(s, limits.get(piece["class_id"][0].as_py(), 0), piece["frame"].to_numpy(), piece["track_id"].to_numpy())
                own = [piece[c] for c in ("match_id", "frame", "class_id", "track_id")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(shown, pa.int64()), pa.array(evicted, pa.int64(), mask=evicted < 0)], schema=kinds)

    whole = ["match_id", "frame", "track_id"]
    rows = tracks.filter(F.col("class_id") != BALL).select(*[F.col(c).cast("bigint").alias(c) for c in whole], F.col("class_id").cast("int").alias("class_id"))
    by = ["match_id", "class_id"]
    return rows.repartition(*by).sortWithinPartitions(*by, "frame", "track_id").groupBy(*by).applyInArrow(run, SLOT_SCHEMA)


# ---- J2: overlaps of players and officials -----------------------------------------------------------------------


def overlap_losers(rows: list[dict], bonus: Callable[[dict], float], p: Params = DEFAULTS) -> set[int]:
    """Places (in ``rows``) that lose: each official in turn against the players still there; an official that loses stops."""
    lost: set[int] = set()
    officials = [(k, r) for k, r in enumerate(rows) if r["class_id"] in (KEEPER, REFEREE)]
    players = [k for k, r in enumerate(rows) if r["class_id"] == PLAYER] if officials else []
    for k, r in officials:
        for q in players:
            if q in lost or iou(xyxy(r), xyxy(rows[q])) < p.overlap_iou:
                continue
            if r["conf"] + bonus(r) >= rows[q]["conf"] + p.official_edge:
                lost.add(q)
            else:
                lost.add(k)
                break
    return lost


def suppress_overlaps(tracks: DataFrame, p: Params = DEFAULTS, bonus_col: str | None = None) -> DataFrame:
    """Of a player and an official that overlap by 0.72 one goes. Only frames with such a pair leave the JVM; rows of a
    frame are taken by confidence, then place. ``bonus_col`` (0 or 1) grants an official its 0.25."""
    official = tracks.filter(F.col("class_id").isin(KEEPER, REFEREE)).withColumn("_o", F.lit(0))
    player = tracks.filter(F.col("class_id") == PLAYER).withColumn("_p", F.lit(0))
    hot = pairwise_iou(official, player, "_o", "_p", least=p.overlap_iou - 1e-9).select(*KEY).distinct()
    rest = tracks.join(hot, KEY, "left_anti")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["conf", "x1", "y1", "x2", "y2"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        rows = pdf[["class_id", "conf", "x1", "y1", "x2", "y2", *([bonus_col] if bonus_col else [])]].to_dict("records")
        lost = overlap_losers(rows, lambda r: p.official_bonus * bool(bonus_col and r[bonus_col]), p)
        return pdf.drop(index=sorted(lost))

    return rest.unionByName(tracks.join(hot, KEY, "left_semi").groupBy(*KEY).applyInPandas(run, tracks.schema))


# ---- T4: the frame cleaner ---------------------------------------------------------------------------------------


@dataclass
class Officials:
    """Remembered officials by stable id: class, box, frame, streak; and the players kept in the last frame."""

    memory: dict[int, tuple[int, tuple, int, int]] = field(default_factory=dict)
    players: dict[int, tuple] = field(default_factory=dict)


CLEAN = ("match_id", "frame", "track_id", "class_id", "conf", "x1", "y1", "x2", "y2", "rescued_from")


def clean_step(p: Params = DEFAULTS, horizon: int = 600) -> Step:
    """Rescue, pitch gate, overlaps, quotas, same side, cap, uniqueness, in this order; then the memory is renewed."""

    def step(s: Officials, frame: int, rows: list[dict]) -> list[dict]:
        rows = list(rows)

        def known(r: dict) -> tuple | None:
            m = s.memory.get(r["track_id"])
            return m if m and m[0] == r["class_id"] and frame - m[2] <= horizon else None

        claimed = {r["track_id"] for r in rows if r["class_id"] in (KEEPER, REFEREE) and r["track_id"] >= 0}
        near = [(sid, cls, at, frame - when) for sid, (cls, at, when, _) in s.memory.items() if 0 < frame - when <= horizon and sid not in claimed]
        for k, r in enumerate(rows if near else []):  # players on a remembered official's place
            if r["class_id"] != PLAYER:
                continue
            best, (x1, y1, x2, y2) = None, xyxy(r)
            for sid, cls, at, gap in near:
                if at[0] < x2 and x1 < at[2] and at[1] < y2 and y1 < at[3] and sid not in claimed and (over := iou((x1, y1, x2, y2), at)) >= 0.20:
                    best = max(best or (-math.inf, 0, 0), (over - 0.01 * gap, -sid, cls))
            if best:
                rows[k] = r | {"rescued_from": r["track_id"], "track_id": -best[1], "class_id": best[2]}
                claimed.add(-best[1])
        placed = lambda r: r["gate_x"] is not None and r["gate_y"] is not None
        out_of = lambda r, mx, my: not (-mx <= r["gate_x"] <= p.pitch_length + mx and -my <= r["gate_y"] <= p.pitch_width + my)
        rows = [r for r in rows if not (placed(r) and out_of(r, p.margin_x, p.margin_y))]
        if lost := overlap_losers(rows, lambda r: p.official_bonus * bool(known(r)), p):
            rows = [r for k, r in enumerate(rows) if k not in lost]

        def official_score(r: dict) -> float:
            m = known(r)
            return r["conf"] + (p.memory_bonus + p.streak_bonus * min(m[3], p.streak_most) if m else 0.0)

        def player_score(r: dict) -> float:
            before = s.players.get(r["track_id"])
            return r["conf"] + (0.25 * iou(xyxy(r), before) if before is not None else 0.0) + 0.15 * (placed(r) and not out_of(r, 0, 0))

        def keep_best(cls: int, most: int, score: Callable[[dict], float]) -> None:
            of = [k for k, r in enumerate(rows) if r["class_id"] == cls]
            if len(of) <= most:  # nobody has to go, so nobody is scored
                return
            drop = set(sorted(of, key=lambda k: -score(rows[k]))[most:])
            rows[:] = [r for k, r in enumerate(rows) if k not in drop]

        keep_best(KEEPER, p.max_keepers, official_score)
        keep_best(REFEREE, p.max_referees, official_score)
        middle = [(r["x1"] + r["x2"]) / 2 for r in rows if r["class_id"] == KEEPER]
        if len(middle) > 1 and max(middle) - min(middle) < p.same_side_share * p.frame_width:
            keep_best(KEEPER, 1, official_score)
        keep_best(PLAYER, p.max_players, player_score)
        seen: set[tuple[int, int]] = set()
        unique = []
        for r in sorted(rows, key=lambda r: -r["conf"]):
            name = r["class_id"], r["track_id"]
            if r["track_id"] < 0 or name not in seen:
                unique.append(r)
                seen.add(name)
        s.players = {r["track_id"]: xyxy(r) for r in unique if r["class_id"] == PLAYER and r["track_id"] >= 0}
        fresh = {}
        for r in unique:
            if r["track_id"] >= 0 and r["class_id"] in (KEEPER, REFEREE):
                m = s.memory.get(r["track_id"])
                again = m and m[0] == r["class_id"] and frame - m[2] <= 2
                fresh[r["track_id"]] = r["class_id"], xyxy(r), frame, min(12, m[3] + 1) if again else 1
        for sid, (cls, at, when, streak) in s.memory.items():
            if sid not in fresh and frame - when <= horizon:
                fresh[sid] = cls, at, when, max(1, streak - 1)
        s.memory = fresh
        return [{c: r.get(c) for c in CLEAN} for r in unique]

    return step


def clean_frames(tracks: DataFrame, p: Params = DEFAULTS, horizon: int = 600) -> DataFrame:
    """People rows after all frame rules. ``gate_x, gate_y``: pitch place by the frame before's homography (may be absent).
    ``rescued_from``: the id that a row had as a player before a remembered official's memory claimed it."""
    gate = [F.col(c).cast("double") if c in tracks.columns else F.lit(None).cast("double").alias(c) for c in ("gate_x", "gate_y")]
    rows = tracks.filter(F.col("class_id") != BALL).select(*KEY, "track_id", "class_id", "conf", "x1", "y1", "x2", "y2", *gate)
    return fold(rows, ["match_id"], ["-conf", "x1", "y1", "x2", "y2", "track_id"], Officials, clean_step(p, horizon), "match_id bigint, frame bigint, track_id bigint, class_id int, conf double, x1 double, y1 double, x2 double, y2 double, rescued_from bigint")


# ---- T5: team colours ---------------------------------------------------------------------------------------------


@dataclass
class Colours:
    """Feature of each id, samples until there are enough, the two centroids."""

    ids: dict[int, np.ndarray] = field(default_factory=dict)
    samples: list[np.ndarray] = field(default_factory=list)
    centres: np.ndarray | None = None


def colour_step(enough: int = 30, keep: float = 0.8, margin: float = 0.08) -> Step:
    def unit(v: np.ndarray) -> np.ndarray:
        n = math.sqrt(v.dot(v))
        return v / n if n > 1e-9 else v

    def step(s: Colours, frame: int, rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            team = -1
            if r["feature"] is not None:
                new = unit(np.asarray(r["feature"], float))
                old = s.ids.get(r["track_id"])
                now = s.ids[r["track_id"]] = new if old is None else unit(keep * old + (1 - keep) * new)
                if s.centres is None:
                    s.samples.append(now)
                    if len(s.samples) >= enough:
                        x = np.stack(s.samples)
                        d = ((x[:, None] - x[None]) ** 2).sum(2)
                        c = x[list(np.unravel_index(d.argmax(), d.shape))]
                        for _ in range(8):
                            side = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
                            c = np.stack([unit(x[side == k].mean(0)) if (side == k).any() else c[k] for k in (0, 1)])
                        s.centres, s.samples = c, []
                if s.centres is not None:
                    far = np.sqrt(((s.centres - now) ** 2).sum(1))
                    lead = abs(far[0] - far[1])
                    if lead >= margin:
                        team = int(far.argmin())
                    if lead >= 2.5 * margin:
                        s.centres[team] = unit(0.98 * s.centres[team] + 0.02 * now)
            out.append({"match_id": r["match_id"], "frame": frame, "track_id": r["track_id"], "team": team})
        return out

    return step


def team_colours(features: DataFrame) -> DataFrame:
    """(match_id, frame, track_id, team) from rows with ``feature`` arrays (null: no feature)."""
    rows = features.select(*KEY, "track_id", "feature")
    return fold(rows, ["match_id"], ["track_id"], Colours, colour_step(), "match_id bigint, frame bigint, track_id bigint, team int")


# ---- T7: homography states ----------------------------------------------------------------------------------------


@dataclass
class Pose:
    h: np.ndarray | None = None
    fails: int = 0
    moved: int = 0


def state_step(reinit: int = 90, most: int = 0) -> Step:
    """ok, propagated (by camera motion), hold, or none with a reset."""

    def step(s: Pose, frame: int, rows: list[dict]) -> list[dict]:
        r = rows[0]
        out = {"match_id": r["match_id"], "frame": frame}
        if r["h"] is not None:
            s.h, s.fails, s.moved = np.asarray(r["h"], float).reshape(3, 3), 0, 0
            return [out | {"h": s.h.ravel().tolist(), "state": "ok"}]
        s.fails += 1
        if s.h is not None and r["m"] is not None and s.moved < most:
            n = s.h @ np.asarray(r["m"], float).reshape(3, 3)
            n = n / n[2, 2] if abs(n[2, 2]) > 1e-12 else n
            if np.isfinite(n).all() and np.linalg.cond(n) < 1e9:
                s.h, s.moved = n, s.moved + 1
                return [out | {"h": n.ravel().tolist(), "state": "propagated"}]
        if s.h is not None and s.fails - s.moved <= reinit:
            return [out | {"h": s.h.ravel().tolist(), "state": "hold"}]
        s.h, s.fails, s.moved = None, 0, 0
        return [out | {"h": None, "state": "none"}]

    return step


#: Solved frames whose failures behind them are folded in one group.
SOLVES = 1000


def homography_states(solves: DataFrame, motion: DataFrame | None = None, reinit: int = 90, most: int = 0) -> DataFrame:
    """(match_id, frame, h, state) of every frame of ``solves`` (h null where the solve failed); ``motion``: m maps a frame to the one before.

    A solved frame is its own answer and leaves nothing of what was before, so only failed frames and the solved ones right
    before them are folded, and a match in groups of ``SOLVES`` solved frames.
    """
    by_frame = Window.partitionBy("match_id").orderBy("frame")
    x = solves.select(*KEY, "h").withColumns({"_solves": F.count("h").over(by_frame), "_next": F.lead(F.col("h").isNull()).over(by_frame)})
    solved = x.filter("h IS NOT NULL").select(*KEY, F.transform("h", lambda v: v.cast("double")).alias("h"), F.lit("ok").alias("state"))
    x = x.filter("h IS NULL OR _next").withColumn("_group", F.floor(F.col("_solves") / SOLVES)).drop("_solves", "_next")
    x = x.join(motion.select(*KEY, "m"), KEY, "left") if motion is not None else x.withColumn("m", F.lit(None).cast("array<double>"))
    told = fold(x, ["match_id", "_group"], [], Pose, state_step(reinit, most), "match_id bigint, frame bigint, h array<double>, state string")
    return solved.unionByName(told.filter("state <> 'ok'"))


# ---- T8: dense homographies between anchors -----------------------------------------------------------------------


def _scaled(h: np.ndarray) -> np.ndarray:
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


def between(h0: np.ndarray, h1: np.ndarray, steps: list[np.ndarray | None]) -> list[np.ndarray | None]:
    """Homographies of the frames between two anchors; ``steps[k]`` maps frame k + 1 to frame k (null: broken)."""
    n = len(steps)
    ahead: list[np.ndarray | None] = [h0] + [None] * n
    back: list[np.ndarray | None] = [None] * n + [h1]
    for k, m in enumerate(steps):
        if m is None or ahead[k] is None:
            break
        ahead[k + 1] = _scaled(ahead[k] @ m)
    for k in range(n - 1, -1, -1):
        m = steps[k]
        if m is None or back[k + 1] is None or abs(np.linalg.det(m)) < 1e-300:
            break
        back[k] = _scaled(back[k + 1] @ np.linalg.inv(m))
    out = []
    for k in range(1, n):
        a, b, t = ahead[k], back[k], k / n
        out.append(_scaled((1 - t) * a + t * b) if a is not None and b is not None else a if a is not None else b)
    return out


def densify_anchors(anchors: DataFrame, motion: DataFrame) -> DataFrame:
    """(match_id, frame, h) from the first to the last anchor. Intervals are independent: one group each."""
    w = Window.partitionBy("match_id").orderBy("frame")
    ends = anchors.filter("h IS NOT NULL").select(*KEY, "h").withColumns({"f1": F.lead("frame").over(w), "h1": F.lead("h").over(w)})
    spans = ends.filter(F.col("f1") - F.col("frame") > 1).withColumnRenamed("frame", "f0").withColumnRenamed("h", "h0").withColumn("frame", F.explode(F.sequence(F.col("f0") + 1, F.col("f1"))))
    steps = spans.join(motion.select(*KEY, "m"), KEY, "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        mat = lambda v: None if v is None else np.asarray(v, float).reshape(3, 3)
        found = between(_scaled(mat(pdf["h0"].iloc[0])), _scaled(mat(pdf["h1"].iloc[0])), [mat(v) for v in pdf["m"]])
        rows = [(pdf["match_id"].iloc[0], f, h.ravel()) for f, h in zip(pdf["frame"], found) if h is not None]
        return pd.DataFrame(rows, columns=["match_id", "frame", "h"])

    own = ends.select(*KEY, F.when(F.abs(F.col("h")[8]) > 1e-12, F.transform("h", lambda v: v / F.col("h")[8])).otherwise(F.col("h")).alias("h"))
    return own.unionByName(steps.groupBy("match_id", "f0").applyInPandas(run, "match_id bigint, frame bigint, h array<double>"))


# ---- T9: automatic repair -----------------------------------------------------------------------------------------


def whole_frames(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in pieces that no frame straddles."""
    tail: list[pa.RecordBatch] = []
    for piece in pieces:
        if not piece.num_rows:
            continue
        frame = piece["frame"].to_numpy(zero_copy_only=False)
        if tail and frame[0] != tail[-1]["frame"][0].as_py():
            yield pa.concat_batches(tail)
            tail = []
        cut = int(np.flatnonzero(frame != frame[-1])[-1]) + 1 if frame[0] != frame[-1] else 0
        if cut:
            yield pa.concat_batches([*tail, piece.slice(0, cut)])
            tail = []
        tail.append(piece.slice(cut))
    if tail:
        yield pa.concat_batches(tail)


def repair_frames(pieces: Iterator[pa.RecordBatch], p: Params) -> Iterator[tuple[pa.RecordBatch, list[str], list[int | None]]]:
    """Each piece of a match with the actions and new ids of its rows. The state is the last place of each clean id."""
    last: dict[int, tuple[int, float, float, int]] = {}
    for piece in whole_frames(pieces):
        frame, cls, team, cx, cy, ids, clean = (values_of(piece[c]) for c in ("frame", "class_id", "team_id", "_cx", "_cy", "_id", "_clean"))
        action, new = ["clean"] * len(frame), list(ids)
        at = 0
        for now, group in groupby(frame):
            rows = range(at, at := at + sum(1 for _ in group))
            here = {ids[k] for k in rows if clean[k]}
            for k in rows:
                if clean[k]:
                    last[ids[k]] = now, cx[k], cy[k], team[k]
            if len(here) == len(rows):
                continue
            for k in rows:
                if clean[k]:
                    continue
                if cls[k] == REFEREE:
                    action[k], new[k] = "referee", p.referee_id
                    continue
                x, y, side = cx[k], cy[k], team[k]
                if side is not None and any(clean[c] and team[c] == side and math.sqrt((x - cx[c]) * (x - cx[c]) + (y - cy[c]) * (y - cy[c])) < p.duplicate_px for c in rows):
                    action[k], new[k] = "duplicate", None
                    continue
                best = None
                for cid, (when, px, py, its) in last.items():
                    if cid not in here and its == side and now - when <= p.restitch_frames:
                        far = math.hypot(px - x, py - y)
                        if far < p.restitch_px and (best is None or (far, cid) < best):
                            best = far, cid
                action[k], new[k] = ("stitch", best[1]) if best else ("drop", None)
                if best:
                    here.add(best[1])
                    last[best[1]] = now, x, y, side
            for cid in [c for c, v in last.items() if now - v[0] > p.restitch_frames]:
                del last[cid]
        yield piece, action, new


def auto_repair(tracks: DataFrame, purity: DataFrame, p: Params = DEFAULTS, id_col: str = "display_track_id", tie: list[str] | None = None) -> DataFrame:
    """People with ``action`` (clean, referee, duplicate, stitch, drop) and ``new_id`` (null where the row goes).

    One pass over each match: rows are shuffled once with whether their id is clean, and keep their other columns as they
    are. A match's ids come as one list, which is small enough for Spark to broadcast by its own size rule.
    """
    tie = tie or ["x1", "y1", "x2", "y2"]
    cx, cy = centre()
    known = purity.filter(F.col(id_col).isNotNull() & F.col("is_clean").isNotNull()).groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct(id_col, "is_clean"))).alias("_ids"))
    people = tracks.filter(F.col("class_id") != BALL).join(known, "match_id").withColumns({"_cx": cx, "_cy": cy, "_id": F.col(id_col).cast("bigint"), "_clean": F.try_element_at("_ids", F.col(id_col))})
    people = people.filter("_clean IS NOT NULL").drop("_ids")
    columns = tracks.columns

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, action, new in repair_frames(pieces, p):
            yield pa.RecordBatch.from_arrays([*(piece[c] for c in columns), pa.array(action, pa.string()), pa.array(new, pa.int64())], [*columns, "action", "new_id"])

    ordered = people.repartition("match_id").sortWithinPartitions("match_id", "frame", F.col("conf").desc(), *tie)
    return ordered.groupBy("match_id").applyInArrow(run, StructType([*tracks.schema.fields]).add("action", "string").add("new_id", "long"))
