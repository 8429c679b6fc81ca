"""T2, T10, T11: stable ids from raw tracker ids, motion, appearance and team, in order of frames within each (match, role).

Tables are followed by ``crowds``, many matches at once; ``stable_step`` does the same for one match, and streams use it.

A frame's detections pass six stages; each takes what the stages before left over: continuity with the frame before,
the raw tracker's own id, a cheapest assignment, a rescue by motion alone, then new ids, or at the cap the reuse of an
old one. ``assign_reason`` says which stage decided. A detection's look meets the looks of one person where place and
time leave that person possible, and of all people (one array) in one product at the cap. The other costs are a few plain
numbers a pair that is near enough, as arrays of two or three numbers cost more than they save.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import BALL, KEEPER, PLAYER, REFEREE
from .folds import KEY, Step, iou, xyxy
from .kernels import assign


@dataclass(frozen=True)
class Rules:
    """Fixed values of the players' instance; keepers and referees shift some of them."""

    relink_frames: int = 120
    memory_frames: int = 90
    relink_px: float = 95.0
    app_weight: float = 0.80
    app_keep: float = 0.8
    most_cost: float = 1.45
    ambiguity: float = 0.08
    most_app: float = 0.90
    unknown_app: float = 0.60
    unknown_gap: int = 12
    unknown_space: float = 0.85
    gallery: int = 36
    gallery_step: float = 0.10
    iou: float = 0.45
    iou_margin: float = 0.03
    veto_app: float = 0.55
    rescue_gap: int = 220
    rescue_margin: float = 0.15
    rescue_ratio: float = 0.70
    lock: int = 12
    reuse_gap: int = 8
    cap: int = 22
    offset: int = 0


PLAYERS = Rules()
ROLES = {
    PLAYER: PLAYERS,
    KEEPER: replace(PLAYERS, memory_frames=110, relink_px=95.0 * 0.85, unknown_app=0.70, unknown_gap=20, iou=0.50, lock=16, cap=2, offset=1000),
    REFEREE: replace(PLAYERS, memory_frames=100, relink_px=95.0 * 0.95, app_weight=0.75, unknown_gap=18, lock=14, cap=2, offset=2000),
}


@dataclass
class Person:
    at: tuple[float, float]
    seen: int
    raw: int
    velocity: tuple[float, float] = (0.0, 0.0)
    row: int = 0  # of its looks
    team: int = -1
    votes: int = 0
    lock_until: int = -1

    def vote(self, team: int) -> None:
        """One vote up to 999 for its team, one off for another; at none the team flips."""
        if team < 0:
            return
        if self.team == team:
            self.votes = min(self.votes + 1, 999)
        else:
            self.votes -= 1
            if self.team < 0 or self.votes <= 0:
                self.team, self.votes = team, 1

    def differs(self, team: int) -> bool:
        return team >= 0 and self.team >= 0 and self.votes >= 3 and team != self.team


class Looks:
    """Each person's average look and gallery (newest last), and their squared lengths, in one array."""

    def __init__(self) -> None:
        self.data, self.square, self.n = np.zeros((0, 0, 0)), np.zeros((0, 0)), np.zeros(0, np.int64)

    def distances(self, look: np.ndarray | None) -> list[float | None]:
        """Of a look to each person: three quarters of the best, one quarter of the mean half distance; None without looks."""
        if look is None or not self.data.size:
            return [None] * len(self.n)
        k = len(self.n)
        d = self._halves(self.data[:k] @ look, self.square[:k], look)
        inside = np.arange(d.shape[1]) < self.n[:, None]
        mean = (d * inside).sum(1) / np.maximum(self.n, 1)
        d[~inside] = np.inf
        out = (0.75 * d.min(1) + 0.25 * mean).tolist()
        for row in np.flatnonzero(self.n == 0).tolist():
            out[row] = None
        return out

    def distance(self, row: int, look: np.ndarray | None, length: float = 0.0) -> tuple[float | None, float]:
        """One of ``distances``, and the least half distance to the person's gallery alone (without the average). ``length``: the look's, squared."""
        n = int(self.n[row])
        if look is None or not n:
            return None, np.inf
        far = self.data[row, :n] @ look
        far *= -2
        far += self.square[row, :n] + length
        gallery = float(np.minimum.reduce(far[1:]))
        least = min(gallery, float(far[0]))
        if least <= 1e-12:
            far[far <= 1e-12] = 0
            least, gallery = (x if x > 1e-12 else 0.0 for x in (least, gallery))
        mean = float(np.add.reduce(np.sqrt(far, out=far))) / (2 * n)
        return 0.75 * math.sqrt(least) / 2 + 0.25 * mean, math.sqrt(gallery) / 2

    @staticmethod
    def _halves(product: np.ndarray, square: np.ndarray, look: np.ndarray) -> np.ndarray:
        far = square + float(look @ look) - 2 * product
        return np.sqrt(np.where(far > 1e-12, far, 0)) / 2

    def add(self) -> int:
        """A row for one more person."""
        self.n = np.append(self.n, 0)
        if len(self.n) > len(self.data):
            more = max(8, len(self.data))
            self.data = np.concatenate([self.data, np.zeros((more, *self.data.shape[1:]))])
            self.square = np.concatenate([self.square, np.zeros((more, self.square.shape[1]))])
        return len(self.n) - 1

    def show(self, row: int, look: np.ndarray | None, r: Rules, near: float | None = None) -> None:
        """``near``: the look's least half distance to the person's gallery, where that is known."""
        if look is None:
            return
        if not self.data.size:
            self.data, self.square = np.zeros((len(self.data), 1 + r.gallery, len(look))), np.zeros((len(self.data), 1 + r.gallery))
        own, square, n = self.data[row], self.square[row], int(self.n[row])
        if not n:
            own[:2], square[:2], self.n[row] = look, look @ look, 2
            return
        if n < 5 or (self._halves(own[1:n] @ look, square[1:n], look).min() if near is None else near) >= r.gallery_step:
            if n > r.gallery:  # the oldest goes
                own[1 : n - 1], square[1 : n - 1] = own[2:n].copy(), square[2:n].copy()
                n -= 1
            own[n], square[n], self.n[row] = look, look @ look, n + 1
        mixed = r.app_keep * own[0] + (1 - r.app_keep) * look
        own[0] = mixed / max(math.sqrt(float(mixed @ mixed)), 1e-6)
        square[0] = own[0] @ own[0]


@dataclass
class Crowd:
    """State of one (match, role): people by id, raw ids' people, the frame before."""

    people: dict[int, Person] = field(default_factory=dict)
    looks: Looks = field(default_factory=Looks)
    by_raw: dict[int, int] = field(default_factory=dict)
    next: int = 1
    frame: int = -(10**9)
    boxes: list[tuple[int, tuple]] = field(default_factory=list)


class Detection:
    def __init__(self, r: dict):
        self.row, self.box = r, xyxy(r)
        self.at = (self.box[0] + self.box[2]) / 2, (self.box[1] + self.box[3]) / 2
        self.raw = -1 if r["tracker_id"] is None else int(r["tracker_id"])
        self.look = None if r["appearance"] is None else np.asarray(r["appearance"], float)
        self.team = -1 if r["team_id"] is None else int(r["team_id"])
        self.id, self.reason = 0, ""
        self.length = 0.0 if self.look is None else float(self.look @ self.look)
        self.met: dict[int, tuple[float | None, float]] = {}

    def unlike(self, p: Person, looks: Looks) -> float | None:
        """How much it differs in look from a person that this frame has not changed yet."""
        if p.row not in self.met:
            self.met[p.row] = looks.distance(p.row, self.look, self.length)
        return self.met[p.row][0]


def away(p: Person, d: Detection, frames: float) -> float:
    """Pixels between a detection and where a person would be ``frames`` frames on."""
    (x, y), (u, v), (a, b) = d.at, p.velocity, p.at
    return math.hypot(x - a - u * frames, y - b - v * frames)


def cost(p: Person, d: Detection, frame: int, r: Rules, looks: Looks) -> float:
    gap = frame - p.seen
    if gap < 0 or gap > r.relink_frames:
        return math.inf
    frames = gap if gap > 1 else 1
    far = away(p, d, frames)
    room = r.relink_px * min(2.6, 1 + 0.18 * frames)
    if far > room:
        return math.inf
    look = d.unlike(p, looks)
    if look is None:
        if gap > r.unknown_gap or far > r.unknown_space * r.relink_px:
            return math.inf
        look = r.unknown_app
    elif look > r.most_app:
        return math.inf
    same = p.raw == d.raw and d.raw >= 0
    locked = 0.0 if same or frame > p.lock_until else 0.35 * (p.lock_until - frame + 1) / max(r.lock, 1)
    return far / max(room, 1e-6) + r.app_weight * look + (-0.20 if same else 0.04) + 0.02 * gap + locked


def lead(costs: list[float]) -> float:
    """How far the second cheapest is behind the cheapest; infinite if there are not two."""
    two = sorted(costs)[:2]
    return two[1] - two[0] if len(two) == 2 and two[1] < math.inf else math.inf


def assign_few(cost: list[list[float]], most: float = 1e6) -> list[tuple[int, int]]:
    """Pairs of ``kernels.assign`` (infinite costs count ``most``), by the same steps on plain numbers: made for a few rows."""
    c = [[x if x < math.inf else most for x in row] for row in cost]
    if len(c) == 1:
        return [(0, c[0].index(min(c[0])))]
    flipped = len(c) > len(c[0])
    if flipped:
        c = [list(row) for row in zip(*c)]
    if len(c) > 8:  # arrays pay from here on
        pairs = [(int(a), int(b)) for a, b in zip(*assign(np.array(c)))]
        return [(b, a) for a, b in pairs] if flipped else pairs
    n, m = len(c), len(c[0])
    u, v, owner = [0.0] * n, [0.0] * (m + 1), [-1] * (m + 1)  # column m is the virtual start
    for row in range(n):
        owner[m] = row
        at, least, came, used = m, [math.inf] * m, [m] * m, [False] * (m + 1)
        while owner[at] >= 0:
            used[at] = True
            k = owner[at]
            costs, uk, nxt, delta = c[k], u[k], -1, math.inf
            for j in range(m):
                if not used[j]:
                    slack = costs[j] - uk - v[j]
                    if slack < least[j]:
                        least[j], came[j] = slack, at
                    if least[j] < delta:
                        nxt, delta = j, least[j]
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                elif j < m:
                    least[j] -= delta
            at = nxt
        while at != m:
            owner[at] = owner[came[at]]
            at = came[at]
        owner[m] = -1
    pairs = sorted((k, j) for j, k in enumerate(owner[:m]) if k >= 0)
    return [(b, a) for a, b in pairs] if flipped else pairs


def stable_step(r: Rules) -> Step:
    def step(s: Crowd, frame: int, rows: list[dict]) -> list[dict]:
        dets = [Detection(x) for x in rows]
        left, used = list(dets), set()

        def take(d: Detection, sid: int, reason: str) -> None:
            p = s.people[sid]
            if p.raw != d.raw:
                s.by_raw.pop(p.raw, None)
            (x, y), (u, v), (a, b), gap = d.at, p.velocity, p.at, max(frame - p.seen, 1)
            p.velocity = 0.7 * u + 0.3 * (x - a) / gap, 0.7 * v + 0.3 * (y - b) / gap
            p.at, p.seen, p.raw, p.lock_until = d.at, frame, d.raw, frame + r.lock
            p.vote(d.team)
            s.looks.show(p.row, d.look, r, d.met[p.row][1] if p.row in d.met else None)
            if d.raw >= 0:
                s.by_raw[d.raw] = sid
            d.id, d.reason = sid, reason
            used.add(sid)
            left.remove(d)

        # 1. the frame before: clear overlap, unless team or look speak against it
        if s.frame == frame - 1:
            found = []
            for k, d in enumerate(left):
                over = sorted(((iou(d.box, b), -sid) for sid, b in s.boxes), reverse=True)
                if not over or over[0][0] < r.iou or (len(over) > 1 and over[0][0] - over[1][0] < r.iou_margin):
                    continue
                p = s.people.get(-over[0][1])
                look = d.unlike(p, s.looks) if p else None
                if p and not p.differs(d.team) and not (look is not None and look > r.veto_app):
                    found.append((-over[0][0], k, -over[0][1], d))
            for _, _, sid, d in sorted(found, key=lambda f: f[:3]):
                if sid not in used:
                    take(d, sid, "continuity")
        # 2. the raw tracker's id while it stays plausible
        for d in list(left):
            sid = s.by_raw.get(d.raw) if d.raw >= 0 else None
            if sid is None or sid in used:
                continue
            p = s.people.get(sid)
            look = d.unlike(p, s.looks) if p else None
            if p is None or p.differs(d.team) or (look is not None and look > r.veto_app) or cost(p, d, frame, r, s.looks) > r.most_cost + 0.25:
                s.by_raw.pop(d.raw)
                continue
            take(d, sid, "raw")
        # 3. a cheapest assignment, accepted where it is cheap and, after a gap, unambiguous
        window = max(r.relink_frames, r.memory_frames)
        free = [i for i, p in s.people.items() if i not in used and frame - p.seen <= window]
        if left and free:
            people = [s.people[i] for i in free]
            c = [[math.inf if p.differs(d.team) else cost(p, d, frame, r, s.looks) for p in people] for d in left]
            todo = []
            for a, b in assign_few(c):
                gap = frame - people[b].seen
                margin = r.ambiguity * (1 + 0.02 * max(gap, 0))
                if c[a][b] <= r.most_cost and (gap <= 2 or (lead(c[a]) >= margin and lead([row[b] for row in c]) >= margin)):
                    todo.append((left[a], free[b]))
            for d, sid in todo:
                take(d, sid, "assign")
        # 4. motion alone
        window = max(window, r.rescue_gap)
        for d in list(left):
            near = []
            for i, p in s.people.items():
                gap = frame - p.seen
                if i in used or not 0 < gap <= window or frame <= p.lock_until or p.differs(d.team):
                    continue
                norm = away(p, d, max(0.0, 1 - gap / 40) * min(gap, 40)) / (r.relink_px * min(3.2, 1 + 0.25 * gap))
                if norm <= 1:
                    near.append((norm, i))
            near.sort()
            if near and (len(near) == 1 or near[1][0] - near[0][0] >= r.rescue_margin or (near[1][0] > 1e-6 and near[0][0] / near[1][0] <= r.rescue_ratio)):
                take(d, near[0][1], "rescue")
        # 5. new people, or at the cap old ones again
        for d in list(left):
            if 0 < r.cap <= len(s.people):
                scores, looks = [], s.looks.distances(d.look)
                for i, p in s.people.items():
                    gap = max(1, frame - p.seen)
                    if i not in used and gap >= r.reuse_gap:
                        look = looks[p.row]
                        far = away(p, d, gap) / (r.relink_px * min(4.5, 1 + 0.35 * gap))
                        scores.append((far + 0.35 * (r.unknown_app if look is None else look) + 0.008 * gap, i))
                pick = min(scores)[1] if scores else min(((p.seen, i) for i, p in s.people.items() if i not in used), default=(0, None))[1]
                if pick is not None:
                    take(d, pick, "reuse")
                    continue
            sid, s.next = s.next, s.next + 1
            s.people[sid] = Person(d.at, frame, d.raw, row=s.looks.add())
            take(d, sid, "new")
        # 6. raw ids of people seen within three windows; the newest wins
        s.by_raw = {}
        for sid, p in sorted(s.people.items(), key=lambda x: x[1].seen):
            if p.raw >= 0 and frame - p.seen <= 3 * r.relink_frames:
                s.by_raw[p.raw] = sid
        s.frame, s.boxes = frame, [(d.id, d.box) for d in dets]
        keep = ("match_id", "class_id", "conf", "x1", "y1", "x2", "y2", "team_id", "tracker_id")
        return [{c: d.row[c] for c in keep} | {"frame": frame, "track_id": r.offset + d.id, "assign_reason": d.reason, "stable_team": s.people[d.id].team} for d in dets]

    return step


SCHEMA = "match_id bigint, frame bigint, class_id int, conf double, x1 double, y1 double, x2 double, y2 double, team_id int, tracker_id bigint, track_id bigint, assign_reason string, stable_team int"


def role_step(rules: dict[int, Rules] | None = None) -> Step:
    steps = {c: stable_step(r) for c, r in (rules or ROLES).items()}
    return lambda s, frame, rows: steps[rows[0]["class_id"]](s, frame, rows)


def stabilise_ids(detections: DataFrame, rules: dict[int, Rules] | None = None) -> DataFrame:
    """People with ``track_id`` (players from 1, keepers from 1001, referees from 2001), ``assign_reason`` and ``stable_team``,
    the team that the id's votes hold after the frame (-1: none yet).

    ``detections``: match_id, frame, class_id, conf, box, and where present tracker_id, team_id, appearance (unit vector).
    """
    from .crowds import follow

    kinds = {"tracker_id": "bigint", "team_id": "int", "appearance": "array<double>"}
    extra = [F.col(c).cast(k).alias(c) if c in detections.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
    rows = detections.filter(F.col("class_id") != BALL).select(*KEY, F.col("class_id").cast("int").alias("class_id"), "conf", "x1", "y1", "x2", "y2", *extra)
    return follow(rows, rules or ROLES)
