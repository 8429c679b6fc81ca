"""Queries of the order-dependent operators and numeric jobs (checked by tests; SQL cannot express them)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import homography as hg
from ..operators import folds, joins, kernels, reports, stable_ids
from ..operators import rows as p
from ..sources.shared import kept
from . import flows
from .registry import query
from .row_queries import TIE, h_array
from .track_queries import one

BOX = "x1 y1 x2 y2"


@query("t1_smooth_ball", "match_id frame ball_interpolated", BOX + " conf")
def _(v):
    return folds.smooth_ball(v.fx_tracks, v.fx_frames)


@query("p10_ball_boundary_gate", "match_id frame ball_interpolated", BOX)
def _(v):
    shifted = v.fx_tracks.withColumn("x_m", F.when(F.col("l_linenumber") == 7, F.col("x_m") * 1.2).otherwise(F.col("x_m")))
    return folds.smooth_ball(shifted, v.fx_frames)


def with_looks(v, t, frames: int = 50, unit: bool = False):
    """Each row with a vector of ``embeddings``, of the whole table: an id has another one every ``frames`` frames.

    ``unit``: of length one; vectors are brought to it before rows meet them.
    """
    e = v.table("embeddings")
    vectors = (e.agg(F.max("vec_id")).first()[0] or 0) + 1
    spot = F.pmod(F.hash("match_id", "display_track_id", F.floor(F.col("frame") / frames)), F.lit(vectors))
    looks = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("look"))
    if unit:
        norm = F.sqrt(F.aggregate("look", F.lit(0.0), lambda s, x: s + x * x))
        looks = looks.withColumn("look", F.zip_with("look", F.array_repeat(norm, F.size("look")), lambda x, n: x / n))
    return t.withColumn("vec_id", spot.cast("bigint")).join(looks, "vec_id", "left").drop("vec_id")


def stable(v):
    t = with_looks(v, v.fx_tracks.withColumn("tracker_id", F.col("display_track_id")), unit=True)
    return stable_ids.stabilise_ids(t.withColumnRenamed("look", "appearance"))


@query("t2_stabilise_ids", "match_id frame class_id track_id", BOX, "assign_reason")
def _(v):
    return stable(v)


@query("a29_assign_reasons", "match_id class_id n", other="assign_reason")
def _(v):
    return reports.action_counts(stable(v), "match_id", "class_id", "assign_reason")


@query("t10_team_hysteresis", "match_id frame track_id team_id stable_team")
def _(v):
    """The team that each stable id's votes hold, beside the label of the row."""
    return stable(v)


@query("t3_display_slots", "match_id frame class_id track_id display_track_id evicted")
def _(v):
    return folds.display_slots(v.fx_tracks.withColumn("track_id", F.col("display_track_id")), limits={2: 12, 1: 1, 3: 2})


@query("d10_slot_evictions", "match_id class_id n")
def _(v):
    shown = folds.display_slots(v.fx_tracks.withColumn("track_id", F.col("display_track_id")), limits={2: 12, 1: 1, 3: 2})
    return reports.action_counts(shown.filter("evicted IS NOT NULL"), "match_id", "class_id")


@query("t4_clean_frames", "match_id frame track_id class_id", BOX + " conf")
def _(v):
    t = v.fx_tracks.withColumns({"track_id": F.col("display_track_id"), "gate_x": F.col("x_m"), "gate_y": F.col("y_m")})
    return folds.clean_frames(t)


@query("j18_rescue_official", "match_id frame track_id class_id rescued_from")
def _(v):
    """Rows that an official's memory claimed, with the id that they had as players. Some officials are seen as players at times."""
    seen_as_player = F.col("class_id").isin(1, 3) & (F.col("l_partkey") % 3 == 0)
    t = v.fx_tracks.withColumns({"track_id": F.when(seen_as_player, 50 + F.col("display_track_id")).otherwise(F.col("display_track_id")), "class_id": F.when(seen_as_player, 2).otherwise(F.col("class_id"))})
    return folds.clean_frames(t).filter("rescued_from IS NOT NULL")


@query("j2_suppress_overlaps", "match_id frame display_track_id class_id l_partkey l_linenumber")
def _(v):
    t = v.fx_tracks
    return folds.suppress_overlaps(t.withColumn("x1", F.when(F.col("class_id") == 3, F.col("x1") + 58).otherwise(F.col("x1"))).withColumn("x2", F.when(F.col("class_id") == 3, F.col("x2") + 58).otherwise(F.col("x2"))))


@query("t5_team_colours", "match_id frame track_id team")
def _(v):
    return folds.team_colours(with_looks(v, one(v).filter("class_id = 2")).withColumnsRenamed({"display_track_id": "track_id", "look": "feature"}))


@query("t7_homography_states", "match_id frame", "h2", "state")
def _(v):
    solved = joins.homography_at(v.fx_frames, h_array(v.fx_homography)).withColumn("h", F.when(F.col("frame") % 40 >= 18, F.col("h")))
    motion = v.fx_frames.select("match_id", "frame", F.when(F.col("frame") % 13 != 0, F.array(*map(F.lit, [1.0, 0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]))).alias("m"))
    return folds.homography_states(solved, motion, reinit=5, most=6).withColumn("h2", F.col("h")[2])


@query("t8_densify_anchors", "match_id frame", "h2")
def _(v):
    h = h_array(v.fx_homography)
    motion = v.fx_frames.select("match_id", "frame", F.when(F.col("frame") % 97 != 0, F.array(*map(F.lit, [1.0, 0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]))).alias("m"))
    return folds.densify_anchors(h.filter("frame % 30 = 1"), motion).withColumn("h2", F.col("h")[2])


def noisy(t):
    """Some rows under short-lived ids of mixed classes, as a tracker's fragments have them."""
    junk = F.col("l_partkey") % 11 == 0
    return t.withColumns({"display_track_id": F.when(junk & (F.col("class_id") != 0), 100 + F.col("l_partkey") % 37).otherwise(F.col("display_track_id")), "class_id": F.when(junk & (F.col("class_id") == 2) & (F.col("l_linenumber") % 2 == 0), 3).otherwise(F.col("class_id"))})


@query("t9_auto_repair", "match_id frame display_track_id class_id new_id l_partkey l_linenumber", other="action")
def _(v):
    t = noisy(v.fx_tracks)
    return folds.auto_repair(t, reports.class_purity(t), tie=TIE[1:])


@query("j14_restitch_candidates", "match_id frame team_id junk_id clean_id gap", "dist")
def _(v):
    # written once: purity, junk and clean rows would each rank all people
    t = kept(noisy(one(v)).select("match_id", "frame", "team_id", "class_id", "display_track_id", *BOX.split()), "restitch-people")
    flag = reports.class_purity(t).select("match_id", "display_track_id", "is_clean")
    t = kept(t.join(flag, ["match_id", "display_track_id"]).select("match_id", "frame", "team_id", "display_track_id", *BOX.split(), "is_clean"), "restitch-flagged")
    return joins.restitch_candidates(t.filter("NOT is_clean"), t.filter("is_clean"))


@query("t12_team_clusters", "match_id row_id team")
def _(v):
    t = with_looks(v, one(v).filter("class_id = 2"))
    return kernels.team_clusters(t.select("match_id", "frame", (F.col("frame") * 20 + F.col("display_track_id")).alias("row_id"), F.when(F.col("l_partkey") % 29 != 0, F.col("look")).alias("feature")), stride=5)


@query("w4_spline_fill", "match_id frame", "cx cy")
def _(v):
    return kernels.spline_fill(v.fx_tracks, v.fx_ball_overrides)


#: Ball paths that a cubic spline must follow exactly, by thousands of frames (the last number keeps clear of halves).
CUBICS = {"cx": (400.0, -1500.0, 1800.0, 300.0001234565), "cy": (-200.0, 900.0, -700.0, 500.0001234565)}


def cubic_sql(name: str, frame: str) -> str:
    a, b, c, d = CUBICS[name]
    u = f"({frame} / 1000.0::DOUBLE)"
    return f"(({a}::DOUBLE * {u} + {b}::DOUBLE) * {u} + {c}::DOUBLE) * {u} + {d}::DOUBLE"


CUBIC_FILL = """a AS (SELECT match_id, frame FROM fx_tracks WHERE class_id = 0 AND ball_interpolated = 0 UNION SELECT match_id, frame FROM fx_ball_overrides),
g AS (SELECT match_id, frame AS f0, lead(frame) OVER (PARTITION BY match_id ORDER BY frame) AS f1, count(*) OVER (PARTITION BY match_id) AS n FROM a),
h AS (SELECT match_id, f0, f1, n, unnest(range(f0 + 1, f1)) AS frame FROM g WHERE f1 - f0 BETWEEN 2 AND 30)"""


@query(
    "w4_spline_on_cubics", "match_id frame", "cx cy", views="fx_tracks fx_ball_overrides", extra=CUBIC_FILL,
    sql="SELECT match_id, frame, " + ", ".join(f"round(CASE WHEN n >= 4 THEN {cubic_sql(c, 'frame')} ELSE {cubic_sql(c, 'f0')} + ({cubic_sql(c, 'f1')} - ({cubic_sql(c, 'f0')})) * (frame - f0) / (f1 - f0) END, 3) AS {c}" for c in CUBICS) + " FROM h",
)
def _(v):
    """The spline over balls that move along cubics: SQL knows every value between the anchors."""
    u = F.col("frame") / F.lit(1000.0)
    at = {name: ((a * u + b) * u + c) * u + d for name, (a, b, c, d) in CUBICS.items()}
    tracks = v.fx_tracks.withColumns({"x1": at["cx"] - 8, "x2": at["cx"] + 8, "y1": at["cy"] - 8, "y2": at["cy"] + 8})
    filled = kernels.spline_fill(tracks, v.fx_ball_overrides.withColumns(at))
    return filled.select("match_id", "frame", *[F.round(c, 3).alias(c) for c in CUBICS])


def fitted(v):
    return kernels.fit_homography(p.keypoint_select(v.fx_keypoints, v.fx_vertices))


@query("m1_fit_homography", "match_id frame n_points", "x_cm y_cm", "ok degenerate", views="fx_keypoints fx_vertices", sql="""
SELECT match_id, frame, count(*) AS n_points, 10.0*(960 - 50 - frame % 30) AS x_cm, 12.5*(540 - 30) AS y_cm, true AS ok, false AS degenerate FROM fx_keypoints WHERE conf > 0.5 GROUP BY ALL HAVING count(*) >= 4""")
def _(v):
    """Where each fit puts the middle of the image; the keypoints come from an exact map."""
    x, y = hg.project(F.col("h"), F.lit(960.0), F.lit(540.0))
    return fitted(v).filter("n_points >= 4").withColumns({"x_cm": F.round(x, 3), "y_cm": F.round(y, 3)})


@query("m2_fit_anchor", "match_id frame", "x_cm y_cm")
def _(v):
    k = p.keypoint_select(v.fx_keypoints, v.fx_vertices)
    a = k.groupBy("match_id", "frame").agg(F.array_sort(F.collect_list(F.struct("label", "x", "y", "x_cm", "y_cm"))).alias("l"))
    a = a.select("match_id", "frame", F.transform("l", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("image_pts"), F.transform("l", lambda q: F.struct(q["x_cm"].cast("double").alias("x"), q["y_cm"].cast("double").alias("y"))).alias("pitch_pts"))
    x, y = hg.project(F.col("h"), F.lit(960.0), F.lit(540.0))
    return kernels.fit_anchor(a).withColumns({"x_cm": F.round(x, 3), "y_cm": F.round(y, 3)})


@query("flow_segment_relabel", "match_id frame display_track_id class_id track_filled", "x1")
def _(v):
    return flows.relabel_segments(v.fx_tracks, v.fx_segment_map, TIE)


@query("flow_pass_merge", "match_id frame display_track_id class_id pass_id", "x1 departure_time", "pass_role pass_phase outcome ball_source")
def _(v):
    pts = v.fx_ball_overrides.groupBy("match_id", "frame").agg(F.max("cx").alias("cx"), F.max("cy").alias("cy"))
    return flows.merge_passes(v.fx_tracks, v.fx_pass_events, pts, ["-conf", "x1", "l_partkey", "l_linenumber"])


@query("flow_auto_repair", "match_id display_track_id n_frames n_rows")
def _(v):
    return flows.repair_ids(noisy(v.fx_tracks), TIE)[1]


@query("flow_alias_map", "match_id frame display_track_id class_id")
def _(v):
    from .track_queries import alias_rules

    # written once: the flow reads people four times, each time with other columns, and would rank them each time
    t = kept(one(v).select("match_id", "frame", "display_track_id", "class_id", "conf", *BOX.split(), "l_partkey", "l_linenumber"), "alias-people")
    return flows.apply_aliases(t, alias_rules(v), None, 50, TIE)


@query("flow_track_frames", "match_id frame track_id display_track_id class_id", BOX + " x_m")
def _(v):
    t = v.fx_tracks.withColumn("tracker_id", F.col("display_track_id"))
    return flows.track_frames(t, h_array(v.fx_homography))
