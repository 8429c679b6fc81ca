"""Every registered query against its SQL in DuckDB; the others for shape and for independence of partitioning."""

import math

import duckdb
import pytest

from touchline import fixtures
from touchline.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in fixtures.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(rows):
    tidy = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(tidy(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql_agrees(spark, sf, duck, name):
    want = duck.sql(catalog.SQL[name])
    got = catalog.QUERIES[name](spark, sf).select(want.columns).collect()
    a, b = plain(got), plain(want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all((p == pytest.approx(q, abs=2e-6) if isinstance(p, float) else p == q) for p, q in zip(x, y))


@pytest.mark.parametrize("name", ["fx_gt", "fx_keypoints", "fx_tracks"])
def test_views_agree(spark, sf, duck, name):
    want = duck.sql("WITH " + fixtures.ctes(name) + f" SELECT * FROM {name}")
    assert plain(fixtures.view(spark, sf, name).select(want.columns).collect()) == plain(want.fetchall())


@pytest.mark.parametrize("name", ["t1_smooth_ball", "t2_stabilise_ids", "t3_display_slots", "t4_clean_frames", "t9_auto_repair", "w4_spline_fill"])
def test_folds_do_not_depend_on_partitions(spark, sf, name):
    def rows(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(map(repr, catalog.QUERIES[name](spark, sf).collect()))

    few, many = rows(1), rows(7)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert few == many and few


def test_anchors_of_all_frames(spark, sf):
    rows = catalog.QUERIES["m2_fit_anchor"](spark, sf).collect()
    assert {(r["match_id"], r["frame"]) for r in rows} == {tuple(r) for r in fixtures.view(spark, sf, "fx_keypoints").select("match_id", "frame").distinct().collect()}
    assert all(abs(r["x_cm"] - 10.0 * (910 - r["frame"] % 30)) < 0.01 and abs(r["y_cm"] - 6375) < 0.01 for r in rows if r["x_cm"] is not None)
    assert any(r["x_cm"] is not None for r in rows)


def test_anchors_in_stacks_are_the_single_fits():
    """Exact, noisy, wrong, degenerate and non-finite pairs; exact ones do not go through every four."""
    import numpy as np

    from touchline.operators import kernels

    rnd = np.random.default_rng(1)
    h = np.array([[10, 0.3, -500], [0.1, 12.5, -375], [1e-4, 2e-5, 1.0]])
    for n in (3, 4, 5, 8):
        image = rnd.random((24, n, 2)) * 1000
        q = np.concatenate([image, np.ones((24, n, 1))], 2) @ h.T
        pitch = q[..., :2] / q[..., 2:]
        pitch[1::4, 0] += 400
        pitch[2::4] += rnd.normal(size=pitch[2::4].shape) * 8
        pitch[3, 1, 0], image[7], image[11, :, 1], image[15, :3], pitch[15, :3] = np.nan, image[7, 0], 5, image[15, 0], pitch[15, 0]
        got, want = kernels.solve_anchors(image, pitch), [kernels.solve_anchor(a, b) for a, b in zip(image, pitch)]
        assert all((a is None) == (b is None) and (a is None or np.array_equal(a, b)) for a, b in zip(got, want))
    vertices = np.array([v[1:] for v in fixtures.VERTICES], float)
    single, kernels.solve_anchor = kernels.solve_anchor, None
    try:
        assert all(h is not None for h in kernels.solve_anchors(np.stack([vertices / 10 + k for k in range(5)]), np.stack([vertices] * 5)))
    finally:
        kernels.solve_anchor = single


def test_team_votes_of_stable_ids(spark, sf):
    """``stable_team`` is what a plain count of each id's labels gives: up to 999 votes, one off for another team."""
    rows = catalog.QUERIES["t10_team_hysteresis"](spark, sf).collect()
    held = {}
    for r in sorted(rows, key=lambda r: (r["match_id"], r["track_id"], r["frame"])):
        team, votes = held.get((r["match_id"], r["track_id"]), (-1, 0))
        if r["team_id"] == team and team >= 0:
            votes = min(votes + 1, 999)
        elif r["team_id"] >= 0:
            votes -= 1
            team, votes = (r["team_id"], 1) if team < 0 or votes <= 0 else (team, votes)
        held[r["match_id"], r["track_id"]] = team, votes
        assert r["stable_team"] == team
    assert len({r["stable_team"] for r in rows}) == 3 and any(r["stable_team"] != r["team_id"] >= 0 for r in rows)


def test_rescued_officials(spark, sf):
    """A rescued row has the class under which its id was last seen, and no other row of its frame has that id."""
    rows = catalog.QUERIES["j18_rescue_official"](spark, sf).collect()
    assert all(r["class_id"] in (1, 3) for r in rows) and any(r["rescued_from"] >= 50 for r in rows)
    assert len({(r["match_id"], r["frame"], r["class_id"], r["track_id"]) for r in rows}) == len(rows)
    tracks = {(r["match_id"], r["display_track_id"], r["class_id"]) for r in fixtures.view(spark, sf, "fx_tracks").select("match_id", "display_track_id", "class_id").collect()}
    assert all((r["match_id"], r["track_id"], r["class_id"]) in tracks for r in rows)


@pytest.mark.parametrize("alpha", [0.5, 0.02])
def test_ema_is_exact(spark, alpha):
    from touchline.operators import windows

    rows = [(1, k % 3, k, None if k % 97 == 5 else float(k * k % 101)) for k in range(900)]
    got = windows.ema(spark.createDataFrame(rows, "match_id bigint, display_track_id bigint, frame bigint, v double").repartition(5), "v", alpha).collect()
    old, want = {}, {}
    for _, t, f, v in rows:
        before = old.get(t)
        old[t] = want[f] = v if before is None or v is None else alpha * v + (1 - alpha) * before
    assert len(got) == 900 and all(r["ema"] == want[r["frame"]] or abs(r["ema"] - want[r["frame"]]) < 1e-9 for r in got)


def test_alias_rules_of_two_matches(spark):
    """A rule with a match holds there only; one without holds everywhere; protected ids of a match stay."""
    from touchline.operators import joins

    tracks = spark.createDataFrame([(m, 10, i, 2, 0.0, 0.0, 2.0, 2.0) for m in (0, 1) for i in (5, 6, 7, 5)], "match_id bigint, frame bigint, display_track_id bigint, class_id int, x1 double, y1 double, x2 double, y2 double")
    rules = spark.createDataFrame([(1, 0, 5, "", 50), (2, 1, 5, "", 51), (3, None, 6, "P", 60), (4, 1, 7, "GK", 70)], "rule_no int, match_id bigint, id bigint, cls string, target bigint").selectExpr("*", "CAST(NULL AS BIGINT) fs", "CAST(NULL AS BIGINT) fe")
    got = sorted((r["match_id"], r["display_track_id"], r["new_id"], r["action"]) for r in joins.apply_alias_rules(tracks, rules).collect())
    assert got == [(0, 5, 50, "single"), (0, 5, 50, "single"), (0, 6, 60, "single"), (0, 7, 7, "none"), (1, 5, 51, "single"), (1, 5, 51, "single"), (1, 6, 60, "single"), (1, 7, 7, "none")]
    kept = joins.apply_alias_rules(tracks, rules, spark.createDataFrame([(1, 6, "")], "match_id bigint, id bigint, cls string")).filter("action = 'protected'")
    assert [(r["match_id"], r["new_id"]) for r in kept.collect()] == [(1, 6)]


def test_rules_meet_the_same_share_of_rows_at_every_size(spark, sf):
    """Matches with segment and alias rules are the tracks' own."""
    for view in ("fx_segment_map", "fx_alias_cells"):
        share = []
        for folder in (sf, sf.replace("0.001", "0.01")):
            tracks, rules = fixtures.view(spark, folder, "fx_tracks"), fixtures.view(spark, folder, view).filter("match_id IS NOT NULL").select("match_id").distinct()
            share.append(tracks.join(rules, "match_id", "left_semi").count() / tracks.count())
        assert share == [1.0, 1.0]


def test_people_meet_many_looks(spark, sf):
    from touchline.plans.fold_queries import with_looks
    from touchline.plans.registry import Views

    v = Views(spark, sf)
    rows = with_looks(v, v.fx_tracks)
    assert rows.count() == v.fx_tracks.count() and rows.filter("look IS NULL").count() == 0
    assert rows.select("look").distinct().count() > 0.5 * v.table("embeddings").count()


def test_ema_in_pieces_is_the_fold(spark):
    """Pieces of any length, nulls, gaps of pieces, null keys and repeated places give what one run gives."""
    import random

    from touchline.operators import windows

    rnd = random.Random(3)
    rows = [(m, t, f, rnd.choice([None, *[rnd.random() * 100] * 9]), f"r{f}") for m in (1, 2) for t in (1, None) for f in sorted(rnd.choices(range(-50, 400), k=300))]
    df = spark.createDataFrame(rows, "match_id bigint, display_track_id bigint, frame bigint, v double, piece string").repartition(5)
    want = {}
    for m in (1, 2):
        for t in (1, None):
            old = None
            for r in sorted((r for r in rows if r[:2] == (m, t)), key=lambda r: (r[2], r[3] is not None, r[3] or 0)):
                old = r[3] if old is None or r[3] is None else 0.3 * r[3] + 0.7 * old
                want.setdefault((m, t, r[2], r[3]), []).append(old)
    for piece in (1, 7, 100, 10_000):
        got = {}
        for r in windows.ema(df, "v", 0.3, piece=piece).collect():
            got.setdefault((r["match_id"], r["display_track_id"], r["frame"], r["v"]), []).append(r["ema"])
        assert got.keys() == want.keys()
        for k, w in want.items():
            assert all(a is b if b is None or a is None else abs(a - b) < 1e-9 for a, b in zip(sorted(got[k], key=lambda x: (x is None, x or 0)), sorted(w, key=lambda x: (x is None, x or 0))))
    with pytest.raises(ValueError, match="columns are taken: ema"):
        windows.ema(df.withColumnRenamed("piece", "ema"), "v", 0.3)


def test_average_ranks_people_once(spark, sf):
    """Both passes of w10_ema read the same columns, so Spark takes one shuffle for both."""
    df = catalog.QUERIES["w10_ema"](spark, sf)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_alias_flow_ranks_people_once(spark, sf):
    """The flow reads the written people; none of its branches goes back to the lines and their ranking."""
    plan = catalog.QUERIES["flow_alias_map"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_extendedprice" not in plan
