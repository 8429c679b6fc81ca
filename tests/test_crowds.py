"""Many matches followed at once give what each gives alone."""

from itertools import groupby

import numpy as np
import pytest

from touchline.operators import crowds, stable_ids


def people(rng, matches, frames, rate=4, cls=2, looks=True):
    """Rows that reach every stage: shared raw ids, jumps, teams and looks that change or are absent, frames left out."""
    vectors = rng.normal(size=(40, 6))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    rows = []
    for frame in range(frames):
        for match in range(matches):
            for _ in range(rng.poisson(rate) if rng.random() > 0.05 else 0):
                t = int(rng.integers(20))
                x, y = 60.0 * t + frame % 200 + 600 * (rng.random() < 0.1), 200.0 + int(rng.integers(1, 51))
                raw = None if rng.random() < 0.05 else int(rng.integers(40)) if rng.random() < 0.05 else t
                team = [None, -1, 0, 1][rng.integers(4)] if rng.random() < 0.2 else t % 2
                look = vectors[(match + t + frame // 20) % 40].tolist() if looks and rng.random() > 0.05 else None
                rows.append({"match_id": match, "frame": frame, "class_id": cls, "conf": float(rng.random()), "x1": x, "y1": y, "x2": x + 30, "y2": y + 60, "tracker_id": raw, "team_id": team, "appearance": look})
    return rows


def alone(rows, rules):
    out = {}
    for match, of_match in groupby(sorted(rows, key=lambda r: (r["match_id"], r["frame"], -r["conf"])), key=lambda r: r["match_id"]):
        step, s = stable_ids.stable_step(rules), stable_ids.Crowd()
        for frame, of_frame in groupby(of_match, key=lambda r: r["frame"]):
            out |= {(match, frame, r["conf"]): (r["track_id"], r["assign_reason"], r["stable_team"]) for r in step(s, frame, list(of_frame))}
    return out


def together(rows, rules):
    out, crowd = {}, crowds.Crowds(rules)
    some = any(r["appearance"] is not None for r in rows)
    for frame, of_frame in groupby(sorted(rows, key=lambda r: (r["frame"], r["match_id"], -r["conf"])), key=lambda r: r["frame"]):
        f = list(of_frame)
        whole = lambda c: np.array([-1 if r[c] is None else r[c] for r in f])
        look = np.array([r["appearance"] or [0.0] * 6 for r in f]) if some else None
        box = np.array([[r[c] for c in ("x1", "y1", "x2", "y2")] for r in f])
        found = crowd.step(frame, whole("match_id"), box, whole("tracker_id"), whole("team_id"), look, np.array([r["appearance"] is not None for r in f]))
        out |= {(r["match_id"], frame, r["conf"]): (rules.offset + int(i), crowds.REASONS[k], int(t)) for r, i, k, t in zip(f, *found)}
    return out


@pytest.mark.parametrize(
    "made, rules",
    [
        ({"matches": 12, "frames": 120}, stable_ids.PLAYERS), ({"matches": 3, "frames": 60, "rate": 12}, stable_ids.PLAYERS), ({"matches": 5, "frames": 90, "looks": False}, stable_ids.PLAYERS),
        ({"matches": 4, "frames": 150, "rate": 1, "cls": 3}, stable_ids.ROLES[3]), ({"matches": 2, "frames": 60}, stable_ids.replace(stable_ids.PLAYERS, cap=0)), ({"matches": 2, "frames": 60, "rate": 9}, stable_ids.replace(stable_ids.PLAYERS, cap=4)),
    ],
)
def test_matches_together_as_alone(made, rules):
    rows = people(np.random.default_rng(3), **made)
    want = alone(rows, rules)
    assert together(rows, rules) == want and {w[1] for w in want.values()} >= {"continuity", "raw", "assign", "new"}


def test_a_group_takes_a_frame_in_one_step(spark, monkeypatch):
    """The table goes through steps of many matches, whole frames across pieces; the step of one match is not used."""
    rows = [r for cls in (1, 2, 3) for r in people(np.random.default_rng(cls), 9, 40, 1 + cls, cls)]
    want = {c: alone([r for r in rows if r["class_id"] == c], stable_ids.ROLES[c]) for c in (1, 2, 3)}
    monkeypatch.setattr(stable_ids, "stable_step", None)
    schema = "match_id bigint, frame bigint, class_id int, conf double, x1 double, y1 double, x2 double, y2 double, tracker_id bigint, team_id int, appearance array<double>"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = stable_ids.stabilise_ids(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    assert all(want[r["class_id"]][r["match_id"], r["frame"], r["conf"]] == (r["track_id"], r["assign_reason"], r["stable_team"]) for r in got)
    back = {(r["class_id"], r["match_id"], r["frame"], r["conf"]): (r["x1"], r["team_id"], r["tracker_id"]) for r in got}
    assert back == {(r["class_id"], r["match_id"], r["frame"], r["conf"]): (r["x1"], r["team_id"], r["tracker_id"]) for r in rows}
    assert stable_ids.stabilise_ids(df.filter("false")).count() == 0
    lone = spark.createDataFrame([(None, 1, 2, 0.5, 1.0, 1.0, 31.0, 61.0), (None, 2, 2, 0.5, 2.0, 1.0, 32.0, 61.0)], schema[: schema.index(", tracker_id")])
    assert [(r["match_id"], r["track_id"]) for r in stable_ids.stabilise_ids(lone).collect()] == [(None, 1), (None, 1)]
