"""Micro frames for each branch of the order-dependent operators and numeric jobs."""

import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import homography as hg
from touchline.operators import dedupe, folds, joins, kernels, scoring, stable_ids, windows
from touchline.operators import rows as p
from touchline.sources import tables


def ball(x, conf=0.9, size=10.0, **more):
    return {"match_id": 1, "x1": x - size / 2, "y1": 100 - size / 2, "x2": x + size / 2, "y2": 100 + size / 2, "conf": conf} | more


NO_BALL = {"match_id": 1, "x1": None, "y1": None, "x2": None, "y2": None, "conf": None}


def play(step, state, frames):
    return [step(state, k, f) for k, f in enumerate(frames)]


def test_ball_bridges_eight_is_silent_two_and_resets():
    out = play(folds.ball_step, folds.Ball(), [[ball(100)], [ball(110)], *[[NO_BALL]] * 11, [ball(900)]])
    assert [len(o) for o in out] == [1, 1, *[1] * 8, 0, 0, 0, 1]
    assert all(o[0]["ball_interpolated"] == 1 and o[0]["conf"] == 1.0 for o in out[2:10])
    first = (out[2][0]["x1"] + out[2][0]["x2"]) / 2
    assert first == pytest.approx(110 + 5 * 0.85)  # half of the measured ten pixels, decayed
    assert out[13][0]["ball_interpolated"] == 0


def test_ball_gates():
    s = folds.Ball()
    play(folds.ball_step, s, [[ball(100)], [ball(104)]])
    assert s.gate() == pytest.approx(90 + 3 * 2)
    assert folds.ball_step(s, 2, [ball(400)])[0]["ball_interpolated"] == 1  # too far
    assert not s.measured and s.gate() == 300
    s = folds.Ball()
    play(folds.ball_step, s, [[ball(100)]])
    assert folds.ball_step(s, 1, [ball(101, size=23)])[0]["ball_interpolated"] == 1  # more than five times the area
    assert folds.ball_step(s, 2, [ball(101, conf=0.05)])[0]["ball_interpolated"] == 1  # not confident
    assert folds.ball_step(folds.Ball(), 0, [ball(1, conf=0.3), ball(2, conf=0.8)])[0]["conf"] == 0.8  # first: most confident
    assert folds.ball_step(folds.Ball(), 0, [ball(1, off_pitch=True)]) == []
    s = folds.Ball()
    play(folds.ball_step, s, [[ball(100)]])
    assert folds.ball_step(s, 1, [ball(120, off_pitch=True)])[0]["ball_interpolated"] == 0  # near the prediction


def test_slots_fill_reuse_and_evict():
    step, s = folds.slot_step(2), folds.Slots()
    rows = lambda *ids: [{"match_id": 1, "class_id": 2, "track_id": i} for i in ids]
    got = [[(r["track_id"], r["display_track_id"], r["evicted"]) for r in step(s, f, rows(*ids))] for f, ids in enumerate([(5,), (7,), (5,), (9,), (7, -1)])]
    assert got == [[(5, 1, None)], [(7, 2, None)], [(5, 1, None)], [(9, 2, 7)], [(7, 1, 5), (-1, -1, None)]]
    assert folds.slot_step(0)(folds.Slots(), 0, rows(42))[0]["display_track_id"] == 42


def person(cls, sid, x, conf, w=30.0, y=200.0, **more):
    return {"match_id": 1, "frame": 0, "class_id": cls, "track_id": sid, "conf": conf, "x1": x, "y1": y, "x2": x + w, "y2": y + 60.0, "gate_x": None, "gate_y": None} | more


def test_overlaps():
    rows = [person(3, 1, 100, 0.5), person(2, 2, 101, 0.6), person(2, 3, 500, 0.1)]
    assert folds.overlap_losers(rows, lambda r: 0.0) == {0}
    assert folds.overlap_losers(rows, lambda r: 0.25) == {1}
    assert folds.overlap_losers([person(3, 1, 100, 0.5), person(2, 2, 115, 0.6)], lambda r: 0) == set()


def test_cleaner_rescues_remembers_and_caps():
    step, s = folds.clean_step(), folds.Officials()
    out = play(step, s, [[person(3, 2001, 100, 0.9)], [person(2, 7, 104, 0.8)], [person(2, 8, 800, 0.8)]])
    assert [(r["class_id"], r["track_id"]) for r in out[1]] == [(3, 2001)]  # a player on the referee's place
    assert s.memory[2001][3] == 1  # streak 2 loses one when unseen
    many = [person(3, 10 + k, 200 * k, 0.5 + k / 100) for k in range(4)] + [person(1, 20 + k, 100 * k, 0.5 + k / 10, y=500) for k in range(2)]
    got = step(folds.Officials(), 0, many)
    assert sorted(r["track_id"] for r in got) == [12, 13, 21]  # two referees; keepers on one side: the best
    far = step(folds.Officials(), 0, [person(1, 1, 0, 0.5), person(1, 2, 1500, 0.6)])
    assert len(far) == 2
    crowd = step(folds.Officials(), 0, [person(2, k, 40 * k, 0.5 + k / 100) for k in range(30)])
    assert len(crowd) == 22 and min(r["track_id"] for r in crowd) == 8
    assert len(step(folds.Officials(), 0, [person(2, 1, 0, 0.5), person(2, 1, 300, 0.6), person(2, -1, 500, 0.5), person(2, -1, 700, 0.4)])) == 3
    assert step(folds.Officials(), 0, [person(2, 1, 0, 0.5, gate_x=-500.0, gate_y=100.0)]) == []


def seen(x, raw=-1, look=None, team=-1, y=300.0):
    return {"match_id": 1, "class_id": 2, "conf": 0.9, "x1": x, "y1": y, "x2": x + 30, "y2": y + 60, "tracker_id": raw, "team_id": team, "appearance": look}


def follow(frames, rules=stable_ids.PLAYERS, gaps=None):
    step, s, out = stable_ids.stable_step(rules), stable_ids.Crowd(), []
    for k, f in enumerate(frames):
        out.append([(r["track_id"], r["assign_reason"]) for r in step(s, (gaps or range(len(frames)))[k], f)])
    return out


A, B = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]


def test_stable_ids_by_stage():
    assert follow([[seen(100)], [seen(104)]]) == [[(1, "new")], [(1, "continuity")]]
    assert follow([[seen(100, 5, A)], [seen(140, 5, A)]], gaps=[0, 3])[1] == [(1, "raw")]
    assert follow([[seen(100, 5, A)], [seen(130, 6, A)]], gaps=[0, 3])[1] == [(1, "assign")]
    assert follow([[seen(100, 5)], [seen(220, 6)]], gaps=[0, 40])[1] == [(1, "rescue")]
    assert follow([[seen(100, 5)], [seen(900, 6)]], gaps=[0, 1])[1] == [(2, "new")]
    capped = stable_ids.replace(stable_ids.PLAYERS, cap=1)
    assert follow([[seen(100, 5)], [seen(1500, 6)]], capped, gaps=[0, 20])[1] == [(1, "reuse")]
    assert follow([[seen(100, 5)], [seen(1500, 6)]], capped, gaps=[0, 2])[1] == [(1, "reuse")]  # too recent for a score: the oldest


def test_stable_ids_vetoes():
    three = [[seen(100, 5, A, 0)], [seen(101, 5, A, 0)], [seen(102, 5, A, 0)]]
    assert follow([*three, [seen(103, 5, A, 1)]])[3][0][1] not in ("continuity", "raw", "assign")  # another team
    assert follow([[seen(100, 5, A)], [seen(101, 5, B)]])[1] != [(1, "continuity")]  # another look
    twins = follow([[seen(100), seen(106)], [seen(103)]])
    assert twins[1][0][1] != "continuity"  # two as good: not clear


def test_team_votes_of_a_person():
    one = stable_ids.Person(np.zeros(2), 0, 1)
    for team in (0, 0, 0):
        one.vote(team)
    assert one.differs(1) and not one.differs(0) and not one.differs(-1)
    for _ in range(3):
        one.vote(1)
    assert (one.team, one.votes) == (1, 1)


def test_gallery_and_distance():
    looks = stable_ids.Looks()
    one, other = looks.add(), looks.add()
    for look in (A, A, A, A, A, B):
        looks.show(one, np.array(look), stable_ids.PLAYERS)
    assert looks.n[one] == 1 + 5 and looks.distances(None) == [None, None] and looks.distances(np.array(A))[other] is None
    assert 0 < looks.distances(np.array(A))[one] < looks.distances(np.array([0.0, 0.0, 1.0]))[one]
    rng = np.random.default_rng(2)
    shown = [x / np.linalg.norm(x) for x in rng.normal(size=(60, 3))]
    for look in shown:
        looks.show(other, look, stable_ids.PLAYERS)
    held, probe = looks.data[other, : looks.n[other]], np.array([0.6, 0.8, 0.0])
    d = np.sqrt(((held - probe) ** 2).sum(1)) / 2
    assert looks.n[other] == 1 + stable_ids.PLAYERS.gallery and (held[-1] == shown[-1]).all()
    assert abs(looks.distances(probe)[other] - 0.75 * d.min() - 0.25 * d.mean()) < 1e-9


def test_a_look_meets_only_people_who_are_possible(monkeypatch):
    """One person near, many far: the array of all looks is not touched; pair and array give the same distance."""
    asked = []
    monkeypatch.setattr(stable_ids.Looks, "distances", lambda self, look: asked.append(look) or [None] * len(self.n))
    crowd = [seen(150.0 * k, k, A) for k in range(12)]
    assert [r for _, r in follow([crowd, [seen(4, 0, A)], [seen(130, 99, A)]], gaps=[0, 3, 6])[2]] == ["assign"] and not asked
    monkeypatch.undo()
    rng, looks = np.random.default_rng(4), stable_ids.Looks()
    for row in [looks.add() for _ in range(5)]:
        for _ in range(9 * row):
            looks.show(row, rng.normal(size=6), stable_ids.PLAYERS)
    for probe in [rng.normal(size=6), looks.data[3, 2].copy()]:
        pairs = [looks.distance(row, probe, float(probe @ probe)) for row in range(5)]
        assert pairs[0][0] is None and looks.distances(probe) == [None, *(pytest.approx(d, abs=1e-7) for d, _ in pairs[1:])]
        held = [looks.data[row, 1 : looks.n[row]] for row in range(1, 5)]
        assert [near for _, near in pairs[1:]] == pytest.approx([np.sqrt(((h - probe) ** 2).sum(1)).min() / 2 for h in held], abs=1e-6)


def test_few_rows_are_assigned_as_many():
    rng = np.random.default_rng(5)
    for _ in range(400):
        c = rng.integers(0, 4, rng.integers(1, 12, 2)) + rng.choice([0.0, 0.25], 1)
        c[rng.random(c.shape) < 0.3] = np.inf
        rows, cols = kernels.assign(np.where(np.isfinite(c), c, 1e6))
        assert stable_ids.assign_few(c.tolist()) == list(zip(rows.tolist(), cols.tolist()))


def test_colours_and_poses():
    step, s = folds.colour_step(enough=4), folds.Colours()
    rows = lambda *v: [{"match_id": 1, "track_id": k, "feature": x} for k, x in enumerate(v)]
    first = step(s, 0, rows(A, B))
    second = step(s, 1, rows(A, B))
    third = step(s, 2, rows(A, B, None))
    assert [r["team"] for r in first] == [-1, -1] and second[-1]["team"] in (0, 1)
    assert third[0]["team"] != third[1]["team"] and third[2]["team"] == -1
    eye, move = np.eye(3).ravel().tolist(), [1.0, 0, -1, 0, 1, 0, 0, 0, 1]
    step, s = folds.state_step(reinit=2, most=2), folds.Pose()
    rows = [{"match_id": 1, "h": h, "m": m} for h, m in ((None, None), (eye, None), (None, move), (None, move), (None, move), (None, None), (None, None), (None, None))]
    assert [step(s, k, [r])[0]["state"] for k, r in enumerate(rows)] == ["none", "ok", "propagated", "propagated", "hold", "hold", "none", "none"]


def test_stitching():
    step, s = folds.stitch_step(), folds.Seen()
    row = lambda i, x, clean, team=0: {"_row": f"{i}", "display_track_id": i, "cx": x, "cy": 0.0, "team_id": team, "is_clean": clean}
    step(s, 0, [row(1, 0, True), row(2, 1000, True)])
    got = step(s, 5, [row(50, 100, False), row(51, 120, False), row(52, 100, False, 1)])
    assert [r["stitched"] for r in got] == [1, None, None]
    assert step(s, 60, [row(50, 100, False)])[0]["stitched"] is None  # vanished too long ago


SQUARE = ([(100, 100), (500, 120), (480, 400), (120, 380)], [(0, 0), (12000, 0), (12000, 7000), (0, 7000)])


def test_anchor_of_four_three_and_a_misclick():
    h = kernels.solve_anchor(*map(np.array, SQUARE))
    q = np.c_[np.array(SQUARE[0]), np.ones(4)] @ h.T
    assert np.allclose(q[:, :2] / q[:, 2:], SQUARE[1], atol=1e-3)
    assert kernels.solve_anchor(np.array(SQUARE[0][:3]), np.array(SQUARE[1][:3])) is None
    assert kernels.solve_anchor(np.array(SQUARE[0]), np.array(SQUARE[1][:3])) is None
    inner = np.array([(200, 200), (300, 300), (400, 200), (250, 350)])
    w = np.c_[inner, np.ones(4)] @ h.T
    image, pitch = np.r_[SQUARE[0], inner], np.r_[SQUARE[1], w[:, :2] / w[:, 2:]]
    pitch[5] += 900
    assert np.allclose(kernels.solve_anchor(image, pitch), h, atol=1e-6)


def shift(dx, dy=0.0):
    return np.array([[1, 0, dx], [0, 1, dy], [0, 0, 1.0]])


def test_densify_follows_the_true_chain(spark):
    h0 = kernels.solve_anchor(*map(np.array, SQUARE))
    truth = [h0]
    for _ in range(20):
        truth.append(truth[-1] @ shift(-3, -1))
    norm = [t / t[2, 2] for t in truth]
    got = folds.between(norm[0], norm[20], [shift(-3, -1)] * 20)
    assert len(got) == 19 and all(np.allclose(a, b, atol=1e-6) for a, b in zip(got, norm[1:20]))
    broken = [shift(-3, -1)] * 20
    broken[9] = None
    got = folds.between(norm[0], norm[20], broken)
    assert all(g is not None and np.allclose(g, t, atol=1e-6) for g, t in zip(got, norm[1:20]))
    broken[4] = None
    assert folds.between(norm[0], norm[20], broken)[6] is None
    anchors = spark.createDataFrame([(1, f, norm[f].ravel().tolist()) for f in (0, 20)], "match_id bigint, frame bigint, h array<double>")
    motion = spark.createDataFrame([(1, f, shift(-3, -1).ravel().tolist()) for f in range(1, 21)], "match_id bigint, frame bigint, m array<double>")
    rows = {r["frame"]: np.reshape(r["h"], (3, 3)) for r in folds.densify_anchors(anchors, motion).collect()}
    assert sorted(rows) == list(range(21)) and all(np.allclose(rows[f], norm[f], atol=1e-6) for f in rows)


def test_homography_fit_guards(spark):
    h = kernels.solve_anchor(*map(np.array, SQUARE))
    pts = [(k, float(x), float(y)) for k, (x, y) in enumerate([(100, 100), (500, 120), (480, 400), (120, 380), (300, 250)])]
    rows = []
    for k, x, y in pts:
        w = h @ [x, y, 1]
        rows.append((1, 0, k, x, y, float(w[0] / w[2]), float(w[1] / w[2])))
        if k < 3:
            rows.append((1, 1, k, x, y, float(w[0] / w[2]), float(w[1] / w[2])))
        rows.append((1, 2, k, 300.0, 50.0 * k, 6000.0, 1000.0 * k))
    df = spark.createDataFrame(rows, "match_id bigint, frame bigint, label int, x double, y double, x_cm double, y_cm double")
    got = {r["frame"]: r for r in kernels.fit_homography(df).collect()}
    assert got[0]["ok"] and np.allclose(np.reshape(got[0]["h"], (3, 3)), h, rtol=1e-6)
    assert not got[1]["ok"] and not got[1]["degenerate"] and got[2]["degenerate"] and got[2]["h"] is None


def test_hold_spends_fifteen(spark):
    rows = [(1, 0, [1.0] * 9, False)] + [(1, f, None, True) for f in range(1, 18)] + [(1, 18, None, False), (1, 19, [2.0] * 9, False), (1, 20, None, True)]
    df = spark.createDataFrame(rows, "match_id bigint, frame bigint, h array<double>, degenerate boolean")
    got = {r["frame"]: r["ok"] for r in windows.hold_last_good(df).collect()}
    assert got[15] and not got[16] and not got[18] and got[19] and got[20]


def test_inverse_and_projection(spark):
    h = kernels.solve_anchor(*map(np.array, SQUARE)).ravel().tolist()
    df = spark.createDataFrame([(h, 300.0, 250.0)], "h array<double>, x double, y double").withColumn("inv", hg.inverse(F.col("h")))
    px, py = hg.project(F.col("h"), F.col("x"), F.col("y"))
    bx, by = hg.project(F.col("inv"), px, py)
    r = df.select(bx.alias("a"), by.alias("b"), hg.inverse(F.array(*[F.lit(1.0)] * 9)).alias("s")).first()
    assert (r["a"], r["b"]) == pytest.approx((300, 250)) and r["s"] is None


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (2, 4), (4, 4), (5, 3)):
        for _ in range(20):
            c = rng.integers(-5, 9, (n, m)).astype(float)
            rows, cols = kernels.assign(c)
            best = min(sum(c[i, j] for i, j in zip(range(n), q)) for q in permutations(range(m), n)) if n <= m else min(sum(c[i, j] for j, i in enumerate(q)) for q in permutations(range(n), m))
            assert c[rows, cols].sum() == best and len(set(rows)) == len(rows) == min(n, m)


def test_spline_in_pieces_is_the_spline_of_the_whole_match(spark):
    """Pieces of 70 anchors with margins of 64, irregular gaps and jumps: what one group gives, to 1e-9."""
    rng = np.random.default_rng(4)
    rows = []
    for match, many in ((1, 1500), (2, 71), (3, 3), (4, 1)):
        frames = np.cumsum(rng.choice([1, 2, 5, 17, 29, 400], many, p=[0.4, 0.2, 0.2, 0.1, 0.05, 0.05]))
        rows += [(match, int(f), 0, 0.5, float(x), float(y), float(x) + 10, float(y) + 10, 0) for f, x, y in zip(frames, rng.uniform(0, 1900, many), rng.uniform(0, 1000, many))]
    tracks = spark.createDataFrame(rows, "match_id bigint, frame bigint, class_id int, conf double, x1 double, y1 double, x2 double, y2 double, ball_interpolated int")
    manual = spark.createDataFrame([(1, rows[700][1], 5.0, 6.0), (2, rows[1500][1] - 3, 7.0, 8.0)], "match_id bigint, frame bigint, cx double, cy double")
    got, whole = ({(r["match_id"], r["frame"]): (r["cx"], r["cy"]) for r in kernels.spline_fill(tracks, manual, piece=k).collect()} for k in (70, 10**6))
    at = sorted(f for m, f in whole if m == 1)
    anchors = {r[1]: (r[4] + 5, r[5] + 5) for r in rows if r[0] == 1} | {rows[700][1]: (5.0, 6.0)}
    x, (cx, cy) = np.array(sorted(anchors), float), np.array([anchors[f] for f in sorted(anchors)]).T
    assert np.allclose([whole[1, f] for f in at], np.stack([kernels.spline_values(x, c, np.array(at, float)) for c in (cx, cy)], 1), atol=1e-9)
    assert len(at) > 3000 and sorted(got) == sorted(whole) and np.allclose([got[k] for k in sorted(got)], [whole[k] for k in sorted(got)], rtol=1e-9, atol=1e-9)


def test_spline_is_exact_on_cubics_and_linear_below_four():
    x = np.array([0.0, 1, 4, 5, 9, 12, 20])
    cubic = lambda t: 2 - t + 0.3 * t**2 - 0.01 * t**3
    at = np.linspace(0, 20, 41)
    assert np.allclose(kernels.spline_values(x, cubic(x), at), cubic(at))
    assert np.allclose(kernels.spline_values(x[:4], cubic(x[:4]), at[:8]), cubic(at[:8]))
    assert np.allclose(kernels.spline_values(np.array([0.0, 2, 4]), np.array([0.0, 4, 0]), np.array([1.0, 3])), [2, 2])


def test_gap_sizes(spark):
    rows = [(1, f, 5, 2, 0.9, float(f), 0.0, float(f), 60.0, None if f == 100 else 1.0) for f in (0, 1, 3, 28, 54, 100, 102)]
    df = spark.createDataFrame(rows, "match_id bigint, frame bigint, display_track_id bigint, class_id int, conf double, x1 double, y1 double, x2 double, y2 double, x_m double")
    got = windows.interpolate_gaps(df).filter("track_filled = 1").collect()
    frames = sorted(r["frame"] for r in got)
    assert frames == [2, *range(4, 28), 101]  # 1 and 26 are not gaps to fill
    assert all(r["x1"] == pytest.approx(r["frame"]) and r["conf"] == 0 for r in got) and [r["x_m"] for r in got if r["frame"] == 101] == [None]


def test_contested_boxes(spark):
    gt = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 10.0, 10.0), (1, 0, 2, 3.0, 0.0, 13.0, 10.0), (1, 1, 1, 0.0, 0.0, 10.0, 10.0)], "match_id bigint, frame bigint, gt_id bigint, x1 double, y1 double, x2 double, y2 double")
    pred = spark.createDataFrame([(1, 0, 7, 1.0, 0.0, 11.0, 10.0), (1, 0, 8, 3.0, 0.0, 13.0, 10.0), (1, 1, 9, 0.0, 0.0, 10.0, 10.0)], "match_id bigint, frame bigint, pred_id bigint, x1 double, y1 double, x2 double, y2 double")
    assert sorted((r["frame"], r["gt_id"], r["pred_id"]) for r in joins.match_boxes(pred, gt).collect()) == [(0, 1, 7), (0, 2, 8), (1, 1, 9)]
    s = scoring.mot_score(pred, gt).first()
    assert (s["tp"], s["fp"], s["fn"], s["switches"]) == (3, 0, 0, 1)
    assert scoring.id_score(pred, gt).first()["idtp"] == 2


def test_published_scores_follow_from_their_counts():
    for gt, pred, tp, switches, mota, recall, precision in ((32909, 33815, 32198, 251, 0.9216, 0.9784, 0.9522), (17755, 19673, 17431, 60, 0.8521, 0.9818, 0.8860)):
        fp, fn = pred - tp, gt - tp
        assert (round(1 - (fn + fp + switches) / gt, 4), round(tp / gt, 4), round(tp / pred, 4)) == (mota, recall, precision)
    assert round(2 * 18432 / (32909 + 33815), 4) == 0.5525
    assert round(scoring.switch_rate(251, 20, 2268, 30.002), 3) == 9.961


def test_collisions_leave_one_row_and_early_frames_alone(spark):
    rows = [(1, f, 5, 2, c) for f in (1, 9) for c in (0.5, 0.6)]
    df = spark.createDataFrame(rows, "match_id bigint, frame bigint, display_track_id bigint, class_id int, conf double")
    assert sorted((r["frame"], r["conf"]) for r in dedupe.dedupe_from(df, 5).collect()) == [(1, 0.5), (1, 0.6), (9, 0.6)]
    kept, hit = dedupe.resolve_collisions(df)
    assert kept.count() == 2 and [r["k"] for r in hit.collect()] == [2, 2]


def test_alias_cells_and_ranges(spark):
    cells = ["1 REF", "GK1", "2 P", "25 PT1", "gk 3", "7 gk", "x", "", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    i, k = p.parse_alias_cell(F.col("c"))
    assert [tuple(r) for r in df.select(i, k).collect()] == [(1, "REF"), (1, "GK"), (2, "P"), (25, ""), (3, "GK"), (7, "GK"), (None, None), (None, None), (None, None)]
    ranges = spark.createDataFrame([(c,) for c in ["4270-5750", "4632-", "5128", "", None, " 3 - 9 "]], "c string")
    a, b = p.parse_frame_range(F.col("c"))
    assert [tuple(r) for r in ranges.select(a, b).collect()] == [(4270, 5750), (4632, None), (5128, 5128), (None, None), (None, None), (3, 9)]


def test_suppression_only_touches_crowded_frames(spark):
    rows = [tuple(person(c, s, x, q)[k] for k in ("match_id", "class_id", "track_id", "conf", "x1", "y1", "x2", "y2")) + (f,) for f, c, s, x, q in ((0, 3, 1, 100.0, 0.9), (0, 2, 2, 102.0, 0.5), (1, 3, 1, 100.0, 0.9), (1, 2, 2, 300.0, 0.5))]
    df = spark.createDataFrame(rows, "match_id int, class_id int, track_id int, conf double, x1 double, y1 double, x2 double, y2 double, frame int")
    assert sorted((r["frame"], r["track_id"]) for r in folds.suppress_overlaps(df).collect()) == [(0, 1), (1, 1), (1, 2)]


def test_sources_round_trip(spark, tmp_path):
    import gzip
    import json

    text = "frame;display_track_id;class_id;x1;y1;x2;y2;conf;x_m\n1;5;2;0;0;10;10;0.5;NaN\n2;5;2;1;0;11;10;;7.5\n3;5\n"
    for name, data in (("t.csv", text), ("c.csv", text.replace(";", ","))):
        (tmp_path / name).write_text(data)
    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write(text)
    for name in ("t.csv", "c.csv", "t.csv.gz"):
        df = tables.require_columns(tables.read_tracks(spark, str(tmp_path / name), 4))
        got = {r["frame"]: r for r in df.collect()}
        assert set(got) == {1, 2, 3} and got[1]["x_m"] is None and got[2]["conf"] is None and got[2]["x_m"] == 7.5 and got[3]["x1"] is None and got[1]["match_id"] == 4
    with pytest.raises(ValueError, match="missing columns: x1"):
        tables.require_columns(df.drop("x1"))
    tables.write_tracks(df.withColumn("junk", F.lit(1)), str(tmp_path / "out"))
    assert set(spark.read.parquet(str(tmp_path / "out")).columns) == set(df.columns)
    (tmp_path / "h.json").write_text(json.dumps({"meta": {"fps": 30}, "frames": {"6": [[1, 0, 2], [0, 1, 3], [0, 0, 1]]}}, indent=1))
    h = tables.read_homographies(spark, str(tmp_path / "h.json"), 1)
    assert [tuple(r) for r in h.collect()] == [(1, 6, [1.0, 0, 2, 0, 1, 3, 0, 0, 1])]
    tables.write_homographies(h, str(tmp_path / "hout"))
    again = tables.read_homographies(spark, str(tmp_path / "hout/match_id=1"), 1)
    assert again.collect() == h.collect()
    (tmp_path / "a.json").write_text(json.dumps({"anchors": {"0": {"image_pts": [[1, 2]], "pitch_pts": [[3, 4]], "H": None}}}))
    a = tables.read_anchors(spark, str(tmp_path / "a.json"), 1)
    tables.write_anchors(a, str(tmp_path / "aout"))
    assert tables.read_anchors(spark, str(tmp_path / "aout/match_id=1"), 1).collect() == a.collect()
    tables.write_kpi(df.select("frame"), str(tmp_path / "kpi"))
    assert spark.read.json(str(tmp_path / "kpi/json")).count() == 3


def test_matches_without_predictions_count_as_missed(spark):
    from touchline.operators import scoring

    box = ("0.0D AS x1", "0.0D AS y1", "10.0D AS x2", "10.0D AS y2")
    gt = spark.range(6).selectExpr("id DIV 2 AS match_id", "id % 2 AS frame", "5L AS gt_id", *box)
    pred = spark.range(2, 8).selectExpr("id DIV 2 AS match_id", "id % 2 AS frame", "9L AS pred_id", *box)
    got = {r["match_id"]: (r["gt"], r["pred"], r["idtp"], r["idp"], r["idr"], r["idf1"]) for r in scoring.id_score(pred, gt).collect()}
    assert got == {0: (2, 0, 0, None, 0.0, 0.0), 1: (2, 2, 2, 1.0, 1.0, 1.0), 2: (2, 2, 2, 1.0, 1.0, 1.0), 3: (0, 2, 0, 0.0, None, 0.0)}


def test_segments_of_a_match_give_what_the_whole_gives(spark):
    """Balls after long gaps and failures behind solved frames, folded apart, against one fold a match."""
    rng = np.random.default_rng(11)
    rows, frames = [], []
    for match in range(4):
        seen = np.repeat(rng.random(60) < 0.5, rng.integers(1, 26, 60))
        for f, s in enumerate(seen):
            frames.append((match, int(f * (1 + match % 2))))
            for _ in range(int(rng.integers(0, 3)) if s else int(rng.random() < 0.1)):
                x = float(300 + 5 * f + rng.normal() * 20)
                rows.append((match, int(f * (1 + match % 2)), 0, x, 100.0, x + 12, 112.0, float(rng.random()) if s else 0.11, float(rng.choice([100.0, -900.0])), 50.0))
    t = spark.createDataFrame(rows, "match_id bigint, frame bigint, class_id int, x1 double, y1 double, x2 double, y2 double, conf double, x_m double, y_m double")
    log = spark.createDataFrame(frames, "match_id bigint, frame bigint")
    x = folds.ball_input(t, log)
    key = lambda df: sorted(map(repr, df.collect()))
    whole = folds.fold(x, ["match_id"], ["-conf", "x1", "y1"], folds.Ball, folds.ball_step, folds.BALL_SCHEMA)
    assert key(folds.smooth_ball(t, log)) == key(whole) and folds.ball_segments(x).select("match_id", "_segment").distinct().count() > 12
    h = [(m, f, None if rng.random() < 0.6 else [1.0, 0.0, float(f), 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]) for m in range(3) for f in range(500)]
    solves = spark.createDataFrame(h, "match_id bigint, frame bigint, h array<double>")
    motion = spark.createDataFrame([(m, f, [1.0, 0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0] if rng.random() < 0.9 else None) for m in range(3) for f in range(500)], "match_id bigint, frame bigint, m array<double>")
    schema = "match_id bigint, frame bigint, h array<double>, state string"
    old = folds.SOLVES
    for size, reinit, most in ((old, 5, 6), (7, 3, 2), (1, 90, 0)):
        folds.SOLVES = size
        want = folds.fold(solves.join(motion, ["match_id", "frame"], "left"), ["match_id"], [], folds.Pose, folds.state_step(reinit, most), schema)
        assert key(folds.homography_states(solves, motion, reinit, most)) == key(want)
    folds.SOLVES = old


def test_repair_reads_its_tracks_few_times(spark, sf, capsys):
    """The flow's work must not double with each of its steps: deduped rows once for the purity of ids, once for the repair."""
    from touchline.plans import catalog

    for name, most in (("t9_auto_repair", 2), ("flow_auto_repair", 3)):
        catalog.QUERIES[name](spark, sf).explain()
        assert 0 < capsys.readouterr().out.count("FileScan parquet") <= most


def test_repair_of_frames_that_straddle_pieces():
    import pyarrow as pa

    frames = [1, 1, 2, 2, 2, 3, 5, 5, 6]
    whole = pa.RecordBatch.from_arrays([pa.array(frames), pa.array(range(9))], ["frame", "n"])
    for cuts in ([], [1], [2], [3, 4], [1, 2, 3, 4, 5, 6, 7, 8], [0, 5]):
        ends = [0, *cuts, 9]
        got = list(folds.whole_frames(whole.slice(a, b - a) for a, b in zip(ends, ends[1:])))
        assert [n for piece in got for n in piece["n"].to_pylist()] == list(range(9))
        seen = [set(piece["frame"].to_pylist()) for piece in got]
        assert sum(map(len, seen)) == len(set(frames))


def test_far_officials_are_not_compared(monkeypatch):
    """A player meets only the remembered officials whose boxes touch its own; the one it covers most still claims it."""
    row = lambda i, c, x: {"match_id": 1, "frame": 0, "track_id": i, "class_id": c, "conf": 0.9, "x1": x, "y1": 0.0, "x2": x + 30, "y2": 60.0, "gate_x": None, "gate_y": None}
    state, step = folds.Officials(), folds.clean_step()
    state.memory = {k: (3, (100.0 * k, 0.0, 100.0 * k + 30, 60.0), 0, 1) for k in range(20)}
    calls, iou = [], folds.iou
    monkeypatch.setattr(folds, "iou", lambda a, b: calls.append(1) or iou(a, b))
    out = step(state, 1, [row(50, 2, 405.0), row(51, 2, 2500.0)])
    assert {(r["track_id"], r["class_id"], r["rescued_from"]) for r in out} == {(4, 3, 50), (51, 2, None)} and len(calls) <= 2


def test_values_of_arrow_columns():
    import pyarrow as pa

    assert folds.values_of(pa.array([1, None, 3])) == [1, None, 3] and folds.values_of(pa.array([1.5, None, math.nan])) == [1.5, None, None]
    rows = folds.values_of(pa.array([[9.0], [1.0, None], None, []], pa.list_(pa.float64())).slice(1))
    assert rows[0][0] == 1.0 and math.isnan(rows[0][1]) and rows[1] is None and len(rows[2]) == 0


def test_pass_flow_reads_people_once(spark, sf):
    """Upserts read ball rows several times, but not the rows of people."""
    from touchline.plans import catalog

    plan = catalog.QUERIES["flow_pass_merge"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey") and len([line for line in plan.splitlines() if "Relation" in line and "l_orderkey" in line]) == 1


def test_restitch_hits_are_moved_once(spark):
    rows = spark.createDataFrame([(1, 10, 0, 7, 0.0, 0.0, 10.0, 10.0), (1, 50, 0, 8, 5.0, 0.0, 15.0, 10.0)], "match_id bigint, frame bigint, team_id int, display_track_id bigint, x1 double, y1 double, x2 double, y2 double")
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name) for name in names}
    try:
        spark.conf.set(names[0], "false")
        spark.conf.set(names[1], "-1")
        got = joins.restitch_candidates(rows.filter("frame = 50"), rows.filter("frame = 10"))
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        assert [(r["junk_id"], r["clean_id"], r["gap"], r["dist"]) for r in got.collect()] == [(8, 7, 40, 5.0)]  # over a bucket's end
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_slots_by_stretches_as_row_by_row():
    rng = np.random.default_rng(6)
    for cap, ids in ((3, 5), (12, 12), (12, 14), (0, 4), (22, 60)):
        sid = rng.integers(-1, ids, 3_000)
        sid[1_000:2_000] = rng.integers(0, max(1, cap), 1_000)  # a stretch in which nobody needs a slot
        frame = np.sort(rng.integers(0, 700, len(sid)))
        one, many = folds.Slots(), folds.Slots()
        want = [folds.slot_of(one, cap, f, i) for f, i in zip(frame.tolist(), sid.tolist())]
        cuts = [0, 7, 900, 901, 3_000]
        got = [folds.slots_of(many, cap, frame[a:b], sid[a:b], least=16) for a, b in zip(cuts, cuts[1:])]
        assert np.concatenate([g[0] for g in got]).tolist() == [w[0] for w in want]
        assert np.concatenate([g[1] for g in got]).tolist() == [-1 if w[1] is None else w[1] for w in want]
        assert (one.slot, one.seen) == (many.slot, many.seen)


def test_players_below_the_cap_are_not_scored(monkeypatch):
    """Scores pick who goes; where nobody has to, no box is compared. Rows that a step gets stay as they are."""
    step, asked = folds.clean_step(), []
    monkeypatch.setattr(folds, "iou", lambda a, b: asked.append(a) or 0.0)
    state, rows = folds.Officials(), [person(2, k, 100 * k, 0.5) for k in range(22)]
    assert len(step(state, 0, rows)) == len(step(state, 1, rows)) == 22 and not asked
    step(state, 2, [*rows, person(2, 22, 2300, 0.4)])
    assert asked
    monkeypatch.undo()
    state = folds.Officials()
    step(state, 0, [person(1, 5, 0, 0.9)])
    row = person(2, 9, 1, 0.9)
    before = dict(row)
    assert [(r["track_id"], r["class_id"], r["rescued_from"]) for r in step(state, 1, [row])] == [(5, 1, 9)] and row == before


def test_the_flow_cleans_frames_once(spark, sf, tmp_path):
    """The plan that gives tracks reads written frames: no cleaning fold stands in it twice."""
    from touchline.plans import catalog

    plan = catalog.QUERIES["flow_track_frames"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1  # the slots' fold
