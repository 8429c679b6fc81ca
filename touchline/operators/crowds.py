"""``stable_ids.stable_step`` for many matches at once: arrays of matches x people, one step a frame for all of them.

A match's frames stay in order; matches do not touch one another, so those of a group that have a frame in common take it
together. Inside a frame, stages 1 to 3 depend only on the state before it, so all their detections are met at once; rescue
and reuse go by place in the frame, one detection of each match at a time. A person is taken once a frame at most and not
looked at afterwards, so people change when the frame is done. Of a look only people who are possible are met.

A task holds one group's state (at the cap of 22, looks of 64 numbers take 417 KB a match) and one frame. Groups are of about
``PEOPLE`` people's matches, by their hash, or smaller ones where cores would have no work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import ARROW
from .stable_ids import PLAYERS, SCHEMA, Rules, assign_few

#: Room for people in a group of matches, most matches of a group, and room that a group should fill before cores get one each.
PEOPLE, TOGETHER, WORTH = 2816, 1024, 176

REASONS = ["continuity", "raw", "assign", "rescue", "reuse", "new"]
#: A person's plain numbers and what they are before the first detection.
REAL, WHOLE = {"a": 0.0, "b": 0.0, "u": 0.0, "v": 0.0}, {"seen": 0, "raw": -1, "team": -1, "votes": 0, "lock": -1}


def runs(key: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


def place_in_run(key: np.ndarray) -> np.ndarray:
    begin = runs(key)
    return np.arange(len(key)) - np.repeat(begin, np.diff(np.r_[begin, len(key)]))


def two_least(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if c.shape[1] < 2:
        return c[:, 0], np.full(len(c), np.inf)
    two = np.partition(c, 1, axis=1)
    return two[:, 0], two[:, 1]


class Crowds:
    """State of one role in many matches: person ``p`` (id p + 1) of the match in slot ``m``."""

    def __init__(self, rules: Rules):
        self.r, self.slots = rules, {}
        m, p = 8, rules.cap if rules.cap > 0 else 8
        self.of = {c: np.full((m, p), x) for c, x in (REAL | WHOLE).items()}
        self.holds, self.n, self.count, self.frame = np.zeros((m, p), bool), np.zeros((m, p), np.int64), np.zeros(m, np.int64), np.full(m, -(10**9))
        self.box_id, self.box = np.full((m, 4), -1), np.zeros((m, 4, 4))
        self.looks = self.square = None

    def _grow(self, matches: int = 0, people: int = 0) -> None:
        def wider(x: np.ndarray, fill=0) -> np.ndarray:
            more = np.full((max(matches, len(x)), max(people, x.shape[1]), *x.shape[2:]), fill, x.dtype) if fill else np.zeros((max(matches, len(x)), max(people, x.shape[1]), *x.shape[2:]), x.dtype)
            more[: len(x), : x.shape[1]] = x
            return more

        self.of = {c: wider(x, (REAL | WHOLE)[c]) for c, x in self.of.items()}
        self.holds, self.n = wider(self.holds), wider(self.n)
        if self.looks is not None:
            self.looks, self.square = wider(self.looks), wider(self.square)
        if more := max(0, matches - len(self.count)):
            self.count, self.frame = np.r_[self.count, np.zeros(more, np.int64)], np.r_[self.frame, np.full(more, -(10**9))]
            self.box_id, self.box = np.concatenate([self.box_id, np.full((more, self.box_id.shape[1]), -1)]), np.concatenate([self.box, np.zeros((more, *self.box.shape[1:]))])

    def slot(self, match: int) -> int:
        if match not in self.slots:
            self.slots[match] = len(self.slots)
            if len(self.slots) > len(self.count):
                self._grow(matches=2 * len(self.count))
        return self.slots[match]

    def step(self, frame: int, match: np.ndarray, box: np.ndarray, raw: np.ndarray, team: np.ndarray, look: np.ndarray | None, has: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, place in ``REASONS``, stable team) of detections of one frame, in order of match and rank.

        ``look``: (rows, values), where ``has`` is set; None if no row has one.
        """
        r, total = self.r, len(match)
        begin = runs(match)
        slots = np.array([self.slot(m) for m in match[begin].tolist()])
        own = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, total]))  # a detection's match among those of the frame
        at, rank = slots[own], place_in_run(match)
        if look is not None and self.looks is None:
            self.looks = np.zeros((*self.n.shape, 1 + r.gallery, look.shape[1]))
            self.square = np.zeros((*self.n.shape, 1 + r.gallery))
        s = {c: x[slots] for c, x in self.of.items()}
        count, held, shown = self.count[slots], self.holds[slots], self.n[slots]
        people = held.shape[1]
        exists = np.arange(people) < count[:, None]
        used = np.zeros_like(exists)
        x, y = (box[:, 0] + box[:, 2]) / 2, (box[:, 1] + box[:, 3]) / 2
        length = None if look is None else np.einsum("ij,ij->i", look, look)
        app, near = np.full((total, people), np.nan), np.full((total, people), np.nan)  # looks met: distance, least half distance to the gallery
        met = np.zeros((total, people), bool)
        taken, why, left = np.full(total, -1), np.zeros(total, np.int64), np.ones(total, bool)

        def meet(d: np.ndarray, p: np.ndarray) -> np.ndarray:
            """Distances of looks to people; NaN where one has none."""
            if look is None:
                return np.full(len(d), np.nan)
            new = ~met[d, p] & has[d] & (shown[own[d], p] > 0)
            i, j = d[new], p[new]
            met[d, p] = True
            if len(i):
                product = np.empty((len(i), 1 + r.gallery))
                for k, (m, q, e) in enumerate(zip(at[i].tolist(), j.tolist(), i.tolist())):
                    np.dot(self.looks[m, q], look[e], out=product[k])
                n = shown[own[i], j]
                inside = np.arange(1 + r.gallery) < n[:, None]
                far = self.square[at[i], j] + length[i][:, None] - 2 * product
                half = np.sqrt(np.where(inside & (far > 1e-12), far, 0)) / 2
                mean = half.sum(1) / n
                half[~inside] = np.inf
                near[i, j] = half[:, 1:].min(1)
                app[i, j] = 0.75 * half.min(1) + 0.25 * mean
            return app[d, p]

        def differs(d: np.ndarray, p=slice(None)) -> np.ndarray:
            """Of detections and people one to one, or (``p`` left out) each with all."""
            t = team[d] if not isinstance(p, slice) else team[d][:, None]
            theirs = s["team"][own[d], p]
            return (t >= 0) & (theirs >= 0) & (s["votes"][own[d], p] >= 3) & (t != theirs)

        def away(d: np.ndarray, frames: np.ndarray, p=slice(None)) -> np.ndarray:
            o = own[d]
            dx, dy = (x[d], y[d]) if not isinstance(p, slice) else (x[d][:, None], y[d][:, None])
            return np.hypot(dx - s["a"][o, p] - s["u"][o, p] * frames, dy - s["b"][o, p] - s["v"][o, p] * frames)

        def cost(d: np.ndarray, p: np.ndarray) -> np.ndarray:
            o = own[d]
            gap = frame - s["seen"][o, p]
            frames = np.maximum(gap, 1)
            far = away(d, frames, p)
            room = r.relink_px * np.minimum(2.6, 1 + 0.18 * frames)
            out = np.full(len(d), np.inf)
            ok = np.flatnonzero((gap >= 0) & (gap <= r.relink_frames) & (far <= room))
            d, p, o, gap, far, room = d[ok], p[ok], o[ok], gap[ok], far[ok], room[ok]
            unlike = meet(d, p)
            none = np.isnan(unlike)
            fits = np.where(none, (gap <= r.unknown_gap) & (far <= r.unknown_space * r.relink_px), unlike <= r.most_app)
            unlike = np.where(none, r.unknown_app, unlike)
            same = (s["raw"][o, p] == raw[d]) & (raw[d] >= 0)
            until = s["lock"][o, p]
            locked = np.where(same | (frame > until), 0.0, 0.35 * (until - frame + 1) / max(r.lock, 1))
            c = far / np.maximum(room, 1e-6) + r.app_weight * unlike + np.where(same, -0.20, 0.04) + 0.02 * gap + locked
            out[ok] = np.where(fits, c, np.inf)
            return out

        def take(d: np.ndarray, p: np.ndarray, reason: str) -> None:
            taken[d], why[d], left[d] = p, REASONS.index(reason), False
            used[own[d], p] = True

        # 1. the frame before: clear overlap, unless team or look speak against it
        d = np.flatnonzero(self.frame[at] == frame - 1)
        if len(d):
            ids, b = self.box_id[at[d]], self.box[at[d]]
            mine = box[d][:, None, :]
            w = np.maximum(0.0, np.minimum(mine[..., 2], b[..., 2]) - np.maximum(mine[..., 0], b[..., 0]))
            h = np.maximum(0.0, np.minimum(mine[..., 3], b[..., 3]) - np.maximum(mine[..., 1], b[..., 1]))
            union = (mine[..., 2] - mine[..., 0]) * (mine[..., 3] - mine[..., 1]) + (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1]) - w * h
            over = np.where(ids >= 0, np.where(union > 1e-6, w * h / np.where(union > 1e-6, union, 1), 0.0), -np.inf)
            most, second = (-z for z in two_least(-over))
            who = np.where((over == most[:, None]) & (ids >= 0), ids, people).min(1)
            with np.errstate(invalid="ignore"):
                ok = (most >= r.iou) & ~((most - second) < r.iou_margin)
            d, who, most = d[ok], who[ok], most[ok]
            ok = ~differs(d, who)
            d, who, most = d[ok], who[ok], most[ok]
            ok = ~(meet(d, who) > r.veto_app)
            d, who, most = d[ok], who[ok], most[ok]
            order = np.lexsort((d, -most, who, own[d]))
            d, who = d[order], who[order]
            first = runs(own[d] * people + who)
            d, who = d[first], who[first]
            if len(d):
                take(d, who, "continuity")
                old = s["raw"][own[d], who]
                theirs = s["raw"][own[d]]  # raw ids that these people leave or take hold for nobody else any more
                gone = ((theirs == old[:, None]) & (old != raw[d])[:, None]) | (theirs == raw[d][:, None])
                each = runs(own[d])
                held[own[d][each]] &= ~np.logical_or.reduceat(gone, each, axis=0)
        # 2. the raw tracker's id while it stays plausible: only the first detection of a raw id counts
        d = np.flatnonzero(left & (raw >= 0))
        same = held[own[d]] & (s["raw"][own[d]] == raw[d][:, None]) & ~used[own[d]]
        some = same.any(1)
        d, p = d[some], same[some].argmax(1)
        first = np.unique(own[d] * people + p, return_index=True)[1]
        d, p = d[first], p[first]
        ok = ~differs(d, p)
        d, p = d[ok], p[ok]
        c = cost(d, p)
        ok = (c <= r.most_cost + 0.25) & ~(app[d, p] > r.veto_app)
        take(d[ok], p[ok], "raw")
        # 3. a cheapest assignment, accepted where it is cheap and, after a gap, unambiguous
        window = max(r.relink_frames, r.memory_frames)
        gap = frame - s["seen"]
        d = np.flatnonzero(left)
        if len(d):
            frames = np.maximum(gap, 1)
            free = exists & ~used & (gap <= window)
            room = r.relink_px * np.minimum(2.6, 1 + 0.18 * frames)
            open_ = (free & (gap >= 0) & (gap <= r.relink_frames))[own[d]]
            open_ &= away(d, frames[own[d]]) <= room[own[d]]
            open_ &= ~differs(d)
            i, p = np.nonzero(open_)
            c = np.full((len(d), people), np.inf)
            c[i, p] = cost(d[i], p)
            self._assign(c, d, own, free, gap, take)
        # 4. motion alone
        window = max(window, r.rescue_gap)
        d = np.flatnonzero(left)
        if len(d):
            able = exists & ~used & (gap > 0) & (gap <= window) & (frame > s["lock"])
            frames = np.maximum(0.0, 1 - gap / 40) * np.minimum(gap, 40)
            norm = away(d, frames[own[d]]) / (r.relink_px * np.minimum(3.2, 1 + 0.25 * gap))[own[d]]
            norm = np.where(able[own[d]] & (norm <= 1) & ~differs(d), norm, np.inf)
            some = (norm < np.inf).any(1)
            d, norm = d[some], norm[some]
            turn = place_in_run(own[d])
            for k in range(int(turn.max()) + 1 if len(d) else 0):
                e = np.flatnonzero(turn == k)
                here = np.where(used[own[d[e]]], np.inf, norm[e])
                least, then = two_least(here)
                with np.errstate(invalid="ignore"):
                    clear = (then == np.inf) | (then - least >= r.rescue_margin) | ((then > 1e-6) & (least / np.where(then > 1e-6, then, 1) <= r.rescue_ratio))
                ok = (least < np.inf) & clear
                take(d[e[ok]], here[ok].argmin(1), "rescue")
        # 5. new people, or at the cap old ones again
        d = np.flatnonzero(left)
        turn = place_in_run(own[d])
        if len(d) and r.cap > 0:
            since = np.maximum(1, gap)
            base = away(d, since[own[d]]) / (r.relink_px * np.minimum(4.5, 1 + 0.35 * since))[own[d]]
            ready = (exists & (since >= r.reuse_gap))[own[d]]
        for k in range(int(turn.max()) + 1 if len(d) else 0):
            e = np.flatnonzero(turn == k)
            o = own[d[e]]
            fresh = np.ones(len(e), bool)
            if r.cap > 0 and (full := count[o] >= r.cap).any():
                f = e[full]
                fo = own[d[f]]
                # people that this frame has added are used; only those of before it have columns here
                able = ready[f] & ~used[fo][:, :people]
                least = np.where(able, base[f] + 0.008 * since[fo], np.inf)
                scores = np.full_like(least, np.inf)

                def score(g: np.ndarray, p: np.ndarray) -> None:
                    unlike = meet(d[f[g]], p)
                    scores[g, p] = base[f[g], p] + 0.35 * np.where(np.isnan(unlike), r.unknown_app, unlike) + 0.008 * since[fo[g], p]

                g = np.flatnonzero(able.any(1))
                score(g, least[g].argmin(1))  # a look can only add: whoever is dearer without it than this one with it is out
                g, p = np.nonzero(able & (least <= scores.min(1)[:, None] + 1e-9) & (scores == np.inf))
                score(g, p)
                some = able.any(1)
                pick = np.where(some, scores.argmin(1), -1)
                rest = np.flatnonzero(~some)
                if len(rest):
                    oldest = np.where((exists & ~used[:, :people])[fo[rest]], s["seen"][fo[rest]], np.iinfo(np.int64).max)
                    pick[rest] = np.where((exists & ~used[:, :people])[fo[rest]].any(1), oldest.argmin(1), -1)
                take(d[f[pick >= 0]], pick[pick >= 0], "reuse")
                fresh[np.flatnonzero(full)[pick >= 0]] = False
            n = d[e[fresh]]
            if len(n):
                p = count[own[n]]
                count[own[n]] += 1
                if p.max() >= used.shape[1]:
                    wide = 2 * used.shape[1]
                    used = np.concatenate([used, np.zeros((len(used), wide - used.shape[1]), bool)], 1)
                if p.max() >= self.n.shape[1]:
                    self._grow(people=2 * self.n.shape[1])
                take(n, p, "new")
                for c, value in (("a", x[n]), ("b", y[n]), ("seen", frame), ("raw", raw[n])):
                    self.of[c][at[n], p] = value
        self._change(frame, at, taken, x, y, raw, team, look, has, met, near, meet, people)
        self.count[slots] = count
        # 6. raw ids of people seen within three windows; the newest wins
        theirs, seen = self.of["raw"][slots], self.of["seen"][slots]
        alive = (np.arange(theirs.shape[1]) < count[:, None]) & (theirs >= 0) & (frame - seen <= 3 * r.relink_frames)
        newest = seen * theirs.shape[1] + np.arange(theirs.shape[1])
        beaten = (theirs[:, :, None] == theirs[:, None, :]) & (newest[:, None, :] > newest[:, :, None]) & alive[:, None, :]
        self.holds[slots] = alive & ~beaten.any(2)
        if (most := int(rank.max()) + 1) > self.box_id.shape[1]:
            more = 2 * most - self.box_id.shape[1]
            self.box_id = np.concatenate([self.box_id, np.full((len(self.box_id), more), -1)], 1)
            self.box = np.concatenate([self.box, np.zeros((len(self.box), more, 4))], 1)
        self.frame[slots], self.box_id[slots] = frame, -1
        self.box_id[at, rank], self.box[at, rank] = taken, box
        return taken + 1, why, self.of["team"][at, taken]

    def _assign(self, c: np.ndarray, d: np.ndarray, own: np.ndarray, free: np.ndarray, gap: np.ndarray, take) -> None:
        """Stage 3 of detections ``d`` by their costs. Where each row's cheapest column is its own, that is the cheapest
        assignment; only other matches are solved one by one."""
        r, people = self.r, c.shape[1]
        least, then = two_least(c)
        rows = np.flatnonzero(least < np.inf)
        if not len(rows):
            return
        choice = np.full(len(d), -1)
        choice[rows] = c[rows].argmin(1)
        key = own[d[rows]] * people + choice[rows]
        shared = np.bincount(key, minlength=1)[key] > 1
        hard = np.unique(own[d[rows[shared | (then[rows] == least[rows])]]])
        for m in hard.tolist():
            mine, cols = np.flatnonzero(own[d] == m), np.flatnonzero(free[m])
            choice[mine] = -1
            for a, b in assign_few(c[np.ix_(mine, cols)].tolist()):
                choice[mine[a]] = cols[b]
        i, p = np.nonzero(c < np.inf)  # the two cheapest of each column
        key = own[d[i]] * people + p
        order = np.lexsort((c[i, p], key))
        key, sorted_ = key[order], c[i, p][order]
        first = runs(key)
        again = np.minimum(first + 1, len(key) - 1)
        ahead = np.full(int(own.max() + 1) * people, np.inf)
        ahead[key[first]] = np.where((again > first) & (key[again] == key[first]), sorted_[again] - sorted_[first], np.inf)
        a = np.flatnonzero(choice >= 0)
        b, o = choice[a], own[d[a]]
        since = gap[o, b]
        margin = r.ambiguity * (1 + 0.02 * np.maximum(since, 0))
        with np.errstate(invalid="ignore"):
            row_ahead = np.where(then[a] < np.inf, then[a] - least[a], np.inf)
        ok = (c[a, b] <= r.most_cost) & ((since <= 2) | ((row_ahead >= margin) & (ahead[o * people + b] >= margin)))
        take(d[a[ok]], b[ok], "assign")

    def _change(self, frame: int, at, p, x, y, raw, team, look, has, met, near, meet, people: int) -> None:
        """Each detection changes its person."""
        r, of = self.r, self.of
        if look is not None:
            d = np.flatnonzero(has)
            m, q = at[d], p[d]
            n = self.n[m, q]
            full = np.flatnonzero((n >= 5) & (q < people))
            meet(d[full], q[full])
            apart = np.full(len(d), np.inf)
            apart[full] = near[d[full], q[full]]
            start = n == 0
            for k in np.flatnonzero(start).tolist():
                i, j = m[k], q[k]
                self.looks[i, j, :2], self.square[i, j, :2], self.n[i, j] = look[d[k]], look[d[k]] @ look[d[k]], 2
            for k in np.flatnonzero(~start & ((n < 5) | (apart >= r.gallery_step))).tolist():
                i, j, size = m[k], q[k], int(n[k])
                own, square = self.looks[i, j], self.square[i, j]
                if size > r.gallery:  # the oldest goes
                    own[1 : size - 1], square[1 : size - 1] = own[2:size].copy(), square[2:size].copy()
                    size -= 1
                own[size], square[size], self.n[i, j] = look[d[k]], look[d[k]] @ look[d[k]], size + 1
            k = np.flatnonzero(~start)
            m, q = m[k], q[k]
            mixed = r.app_keep * self.looks[m, q, 0] + (1 - r.app_keep) * look[d[k]]
            mixed /= np.maximum(np.sqrt(np.einsum("ij,ij->i", mixed, mixed)), 1e-6)[:, None]
            self.looks[m, q, 0], self.square[m, q, 0] = mixed, np.einsum("ij,ij->i", mixed, mixed)
        gap = np.maximum(frame - of["seen"][at, p], 1)
        of["u"][at, p] = 0.7 * of["u"][at, p] + 0.3 * (x - of["a"][at, p]) / gap
        of["v"][at, p] = 0.7 * of["v"][at, p] + 0.3 * (y - of["b"][at, p]) / gap
        of["a"][at, p], of["b"][at, p], of["seen"][at, p], of["raw"][at, p], of["lock"][at, p] = x, y, frame, raw, frame + r.lock
        theirs, votes = of["team"][at, p], of["votes"][at, p]
        same = theirs == team
        votes = np.where(team < 0, votes, np.where(same, np.minimum(votes + 1, 999), votes - 1))
        flips = (team >= 0) & ~same & ((theirs < 0) | (votes <= 0))
        of["team"][at, p], of["votes"][at, p] = np.where(flips, team, theirs), np.where(flips, 1, votes)


def follow(rows: DataFrame, rules: dict[int, Rules]) -> DataFrame:
    """Rows of ``stable_ids.SCHEMA`` for people (match_id, frame, class_id, conf, box, tracker_id, team_id, appearance)."""
    matches, cores = rows.agg(F.approx_count_distinct("match_id")).first()[0], rows.sparkSession.sparkContext.defaultParallelism

    def groups(r: Rules) -> int:
        room = r.cap if r.cap > 0 else PLAYERS.cap
        return max(1, -(-matches // max(1, min(TOGETHER, PEOPLE // room))), min(cores, matches * room // WORTH))

    of_role = F.coalesce(*[F.when(F.col("class_id") == c, F.lit(groups(r))) for c, r in rules.items()], F.lit(1))
    schema = pa.schema([(name, ARROW[kind]) for name, kind in (c.split() for c in SCHEMA.split(","))])

    def whole(crowd: Crowds, t: pa.Table) -> pa.RecordBatch:
        """Rows of whole frames, in order."""
        t = t.combine_chunks()
        col = lambda c, none: t[c].fill_null(none).to_numpy()
        frame, match = col("frame", 0), col("match_id", np.iinfo(np.int64).min)
        box, raw, team = np.stack([t[c].to_numpy() for c in ("x1", "y1", "x2", "y2")], 1), col("tracker_id", -1), col("team_id", -1).astype(np.int64)
        has, look = t["appearance"].is_valid().to_numpy(), None
        if has.any():
            flat = pa.chunked_array([c.flatten() for c in t["appearance"].chunks]).to_numpy().reshape(int(has.sum()), -1)
            look = np.zeros((len(has), flat.shape[1]))
            look[has] = flat
        at = np.r_[runs(frame), len(frame)].tolist()
        done = [crowd.step(int(frame[a]), match[a:b], box[a:b], raw[a:b], team[a:b], look[a:b] if look is not None else None, has[a:b]) for a, b in zip(at, at[1:])]
        sid, why, stable = map(np.concatenate, zip(*done))
        made = {"track_id": crowd.r.offset + sid, "assign_reason": pa.array(REASONS).take(pa.array(why)), "stable_team": stable, "conf": pa.array(t["conf"].to_numpy(), from_pandas=True)}
        cols = [made[f.name] if f.name in made else t[f.name].combine_chunks() for f in schema]
        return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowd, held = None, []
        for piece in pieces:
            if not piece.num_rows:
                continue
            crowd = crowd or Crowds(rules[piece["class_id"][0].as_py()])
            t = pa.Table.from_batches([*held, piece])
            last = int(runs(t["frame"].to_numpy())[-1])  # the last frame may go on in the next piece
            if last:
                yield whole(crowd, t.slice(0, last))
            held = t.slice(last).to_batches()
        if held:
            yield whole(crowd, pa.Table.from_batches(held))

    by = ["class_id", "_group"]
    grouped = rows.withColumn("_group", F.pmod(F.xxhash64("match_id"), of_role))
    ordered = grouped.repartition(*by).sortWithinPartitions(*by, "frame", "match_id", F.desc("conf"), "x1", "y1", "x2", "y2")
    return ordered.groupBy(*by).applyInArrow(run, SCHEMA)
