"""Queries of joins, windows, reports and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import VERTICES
from ..functions import homography as hg
from ..operators import dedupe, joins, reports, scoring, windows
from ..operators import rows as p
from .registry import query
from .row_queries import TIE, h_array, ranked

T = "match_id frame display_track_id class_id l_partkey l_linenumber"
ONE = "t AS (" + ranked("match_id, frame, display_track_id", "class_id <> 0") + ")"
CX, CY = "(x1+x2)/2", "(y1+y2)/2"


def one(v):
    """People, one row of each (match, frame, id)."""
    return dedupe.best_of(v.fx_tracks.filter("class_id <> 0"), ["match_id", "frame", "display_track_id"], TIE)


IOU = """greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0) / ((a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1)
 - greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0))"""


@query("j1_pairwise_iou", "match_id frame a_id b_id", "iou", views="fx_tracks", extra=ONE, sql=f"""
SELECT * FROM (SELECT a.match_id, a.frame, a.display_track_id AS a_id, b.display_track_id AS b_id, {IOU} AS iou FROM t a JOIN t b USING (match_id, frame) WHERE a.class_id = 2 AND b.class_id <> 2) WHERE iou > 0""")
def _(v):
    t = one(v)
    return joins.pairwise_iou(t.filter("class_id = 2"), t.filter("class_id <> 2"), "display_track_id", "display_track_id")


@query("j3_nearest_player", "match_id frame player_id", "dist", views="fx_tracks", sql="""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame ORDER BY dist, player_id) AS rn FROM (
 SELECT p.match_id, p.frame, p.display_track_id AS player_id, sqrt(((p.x1+p.x2)/2-(b.x1+b.x2)/2)**2 + ((p.y1+p.y2)/2-(b.y1+b.y2)/2)**2) AS dist
 FROM fx_tracks p JOIN fx_tracks b USING (match_id, frame) WHERE p.class_id <> 0 AND b.class_id = 0)) WHERE rn = 1""")
def _(v):
    return joins.nearest_player(v.fx_tracks)


DUP = """SELECT * FROM t j WHERE j.class_id <> 2 AND {n} EXISTS (SELECT 1 FROM t c WHERE c.class_id = 2 AND c.match_id = j.match_id AND c.frame = j.frame AND c.team_id = j.team_id
 AND sqrt(((c.x1+c.x2)/2-(j.x1+j.x2)/2)**2 + ((c.y1+c.y2)/2-(j.y1+j.y2)/2)**2) < 90)"""


@query("j4_duplicates_of_clean", T, views="fx_tracks", extra=ONE, sql=DUP.format(n=""))
def _(v):
    t = one(v)
    return joins.duplicates_of_clean(t.filter("class_id <> 2"), t.filter("class_id = 2"))


@query("j4_not_duplicates", T, views="fx_tracks", extra=ONE, sql=DUP.format(n="NOT"))
def _(v):
    t = one(v)
    return joins.duplicates_of_clean(t.filter("class_id <> 2"), t.filter("class_id = 2"), "left_anti")


@query("j5_apply_segment_map", T + " team_id", views="fx_tracks fx_segment_map", sql="""
SELECT * EXCLUDE (canonical_id, team, rn, c) REPLACE (coalesce(canonical_id, display_track_id) AS display_track_id, CASE WHEN canonical_id IS NOT NULL THEN coalesce(team, team_id) ELSE team_id END AS team_id)
FROM (SELECT t.*, canonical_id, team, row_number() OVER (PARTITION BY match_id, frame, l_partkey, l_linenumber, class_id, display_track_id, conf ORDER BY rule_no DESC) AS rn, count(*) OVER () AS c
 FROM fx_tracks t LEFT JOIN (SELECT match_id AS m, * EXCLUDE (match_id) FROM fx_segment_map WHERE canonical_id IS NOT NULL) s ON t.class_id <> 0 AND t.match_id = s.m AND t.display_track_id = tracker_id AND frame BETWEEN frame_start AND frame_end)
WHERE rn = 1 AND coalesce(canonical_id, 1) <> 0""")
def _(v):
    return joins.apply_segment_map(v.fx_tracks, v.fx_segment_map)


def alias_rules(v):
    c, (i, cls), (a, b) = v.fx_alias_cells, p.parse_alias_cell(F.col("cell")), p.parse_frame_range(F.col("frame_range"))
    target = (F.col("target") + F.when(F.col("rule_no") % 25 >= 20, 1).otherwise(0)) % 20  # ids with two rules get two targets
    return c.select("match_id", "rule_no", i.alias("id"), F.when(F.col("rule_no") % 25 >= 20, F.lit("")).otherwise(cls).alias("cls"), target.alias("target"), F.when(F.col("rule_no") % 25 < 20, a).alias("fs"), F.when(F.col("rule_no") % 25 < 20, b).alias("fe"))


ALIAS = ONE + r""",
r AS (SELECT match_id, rule_no, coalesce(TRY_CAST(regexp_extract(cell, '^GK\s*(\d+)', 1) AS BIGINT), TRY_CAST(regexp_extract(cell, '^(\d+)', 1) AS BIGINT)) AS id,
 CASE WHEN rule_no % 25 >= 20 THEN '' WHEN cell LIKE 'GK%' THEN 'GK' WHEN cell LIKE '%REF%' THEN 'REF' WHEN regexp_matches(cell, '^\d+\s*P$') THEN 'P' ELSE '' END AS cls, (target + CASE WHEN rule_no % 25 >= 20 THEN 1 ELSE 0 END) % 20 AS target,
 CASE WHEN rule_no % 25 < 20 THEN TRY_CAST(split_part(frame_range, '-', 1) AS BIGINT) END AS fs, CASE WHEN rule_no % 25 < 20 THEN TRY_CAST(CASE WHEN contains(frame_range, '-') THEN split_part(frame_range, '-', 2) ELSE frame_range END AS BIGINT) END AS fe FROM fx_alias_cells),
w AS (SELECT *, display_track_id IN (4, 9) AS prot, CASE class_id WHEN 1 THEN 'GK' WHEN 2 THEN 'P' ELSE 'REF' END AS letter FROM t WHERE frame >= 50),
c AS (SELECT w.match_id, w.frame, w.display_track_id, r.target, min(rule_no) AS rule_no FROM w JOIN r ON NOT prot AND (r.match_id IS NULL OR r.match_id = w.match_id) AND w.display_track_id = r.id AND (r.cls = '' OR r.cls = letter) AND (fs IS NULL OR frame >= fs - 10) AND (fe IS NULL OR frame <= fe + 10) GROUP BY ALL),
d AS (SELECT c.*, min(CASE WHEN abs(o.frame - w.frame) <= 12 THEN sqrt(((o.x1+o.x2)/2-(w.x1+w.x2)/2)**2 + ((o.y1+o.y2)/2-(w.y1+w.y2)/2)**2) END) AS near,
  min(sqrt(((o.x1+o.x2)/2-(w.x1+w.x2)/2)**2 + ((o.y1+o.y2)/2-(w.y1+w.y2)/2)**2)) AS far
 FROM c JOIN w USING (match_id, frame, display_track_id) LEFT JOIN t o ON o.match_id = c.match_id AND o.display_track_id = c.target AND abs(o.frame - c.frame) <= 50 GROUP BY ALL),
e AS (SELECT *, row_number() OVER (PARTITION BY match_id, frame, display_track_id ORDER BY coalesce(near, far) NULLS LAST, rule_no) AS k, count(*) OVER (PARTITION BY match_id, frame, display_track_id) AS n FROM d),
x AS (SELECT w.*, CASE WHEN prot THEN 'protected' WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'single' ELSE 'split' END AS action, coalesce(e.target, w.display_track_id) AS new_id
 FROM w LEFT JOIN (SELECT * FROM e WHERE k = 1) e USING (match_id, frame, display_track_id))"""


def aliased(v):
    protected = v.spark.sql("SELECT * FROM VALUES (4L, ''), (9L, 'P'), (9L, 'GK'), (9L, 'REF') AS t(id, cls)")
    return joins.apply_alias_rules(one(v), alias_rules(v), protected, 50)


@query("j6_apply_alias_rules", T + " new_id", other="action", views="fx_tracks fx_alias_cells", extra=ALIAS, sql="SELECT * FROM x")
def _(v):
    return aliased(v)


@query("j7_nearest_target", "match_id frame display_track_id new_id", views="fx_tracks fx_alias_cells", extra=ALIAS, sql="SELECT * FROM x WHERE action = 'split'")
def _(v):
    return aliased(v).filter("action = 'split'")


@query("a27_resolution_stats", "display_track_id new_id n", other="action", views="fx_tracks fx_alias_cells", extra=ALIAS, sql="SELECT display_track_id, new_id, action, count(*) AS n FROM x GROUP BY ALL")
def _(v):
    return reports.action_counts(aliased(v), "action", "display_track_id", "new_id")


PASS = """m AS (
 SELECT t.match_id, t.frame, t.class_id, t.display_track_id, t.l_partkey, t.l_linenumber, e.pass_id, 0 AS rk, NULL AS role, 'in_flight' AS phase FROM fx_tracks t JOIN fx_pass_events e ON t.match_id = e.match_id AND class_id = 0 AND frame BETWEEN departure_frame AND arrival_frame
 UNION ALL SELECT t.match_id, t.frame, t.class_id, t.display_track_id, t.l_partkey, t.l_linenumber, e.pass_id, 1, 'passer', 'departure' FROM fx_tracks t JOIN fx_pass_events e ON t.match_id = e.match_id AND frame = departure_frame AND display_track_id = passer_id
 UNION ALL SELECT t.match_id, t.frame, t.class_id, t.display_track_id, t.l_partkey, t.l_linenumber, e.pass_id, 2, 'receiver', 'arrival' FROM fx_tracks t JOIN fx_pass_events e ON t.match_id = e.match_id AND frame = arrival_frame AND display_track_id = receiver_id),
g AS (SELECT match_id, frame, class_id, display_track_id, l_partkey, l_linenumber, arg_max(pass_id, pass_id * 4 + rk) AS pass_id, arg_max(phase, pass_id * 4 + rk) AS pass_phase, arg_max(role, CASE WHEN role IS NOT NULL THEN pass_id * 4 + rk END) AS pass_role FROM m GROUP BY ALL),
tagged AS (SELECT t.*, g.pass_id, g.pass_role, g.pass_phase FROM fx_tracks t LEFT JOIN g USING (match_id, frame, class_id, display_track_id, l_partkey, l_linenumber))"""


@query("j8_tag_passes", T + " pass_id", other="pass_role pass_phase", views="fx_tracks fx_pass_events", extra=PASS, sql="SELECT * FROM tagged")
def _(v):
    return joins.tag_passes(v.fx_tracks, v.fx_pass_events)


@query("j9_denormalise_passes", T + " pass_id", "departure_time arrival_time duration_s", "outcome", views="fx_tracks fx_pass_events", extra=PASS, sql="""
SELECT t.*, round(departure_frame/30.0::DOUBLE,3) AS departure_time, round(arrival_frame/30.0::DOUBLE,3) AS arrival_time, round((arrival_frame-departure_frame)/30.0::DOUBLE,3) AS duration_s, outcome
FROM tagged t LEFT JOIN fx_pass_events e USING (match_id, pass_id)""")
def _(v):
    e = v.fx_pass_events
    return joins.denormalise_passes(joins.tag_passes(v.fx_tracks, e), e)


HALF = "half AS (SELECT match_id, coalesce(median(CASE WHEN class_id = 0 THEN (x2-x1)/2 END), 8.0) AS half_w, coalesce(median(CASE WHEN class_id = 0 THEN (y2-y1)/2 END), 8.0) AS half_h FROM fx_tracks GROUP BY ALL)"
POINTS = "pts AS (SELECT match_id, frame, max(cx) AS cx, max(cy) AS cy FROM fx_ball_overrides GROUP BY ALL)"
BALLS = "b AS (" + ranked("match_id, frame", "class_id = 0", "conf DESC, x1, l_partkey, l_linenumber", rest=True) + ")"


def upserted(v):
    t = dedupe.dedupe_ball(v.fx_tracks, ["-conf", "x1", "l_partkey", "l_linenumber"])
    pts = v.fx_ball_overrides.groupBy("match_id", "frame").agg(F.max("cx").alias("cx"), F.max("cy").alias("cy"))
    return joins.upsert_ball(t.withColumn("ball_source", F.when(F.col("class_id") == 0, "tracker")), pts, reports.ball_half_size(v.fx_tracks))


UPSERT = f"""{HALF}, {POINTS}, {BALLS},
u AS (SELECT match_id, frame, coalesce(b.display_track_id, -1) AS display_track_id, 0 AS class_id, coalesce(conf, 1.0) AS conf, b.l_partkey, b.l_linenumber,
  CASE WHEN cx IS NULL THEN x1 ELSE cx - coalesce(half_w, 8.0) END AS x1, CASE WHEN cy IS NULL THEN y2 ELSE cy + coalesce(half_h, 8.0) END AS y2, CASE WHEN cx IS NULL THEN x_m END AS x_m, CASE WHEN cx IS NULL THEN 'tracker' ELSE 'manual' END AS ball_source
  FROM (SELECT * FROM b WHERE class_id = 0) b FULL JOIN pts USING (match_id, frame) LEFT JOIN half USING (match_id)
 UNION ALL SELECT match_id, frame, display_track_id, class_id, conf, l_partkey, l_linenumber, x1, y2, x_m, NULL FROM b WHERE class_id <> 0)"""


@query("j11_upsert_ball", T, "conf x1 y2 x_m", "ball_source", views="fx_tracks fx_ball_overrides", extra=UPSERT, sql="SELECT * FROM u")
def _(v):
    return upserted(v)


@query("j10_retag_synthesised", "match_id frame class_id pass_id", other="ball_source pass_phase", views="fx_tracks fx_ball_overrides fx_pass_events", extra=UPSERT, sql="""
SELECT u.match_id, u.frame, u.class_id, u.ball_source, min(e.pass_id) AS pass_id, CASE WHEN min(e.pass_id) IS NOT NULL THEN 'in_flight' END AS pass_phase FROM u LEFT JOIN fx_pass_events e ON u.match_id = e.match_id AND frame BETWEEN departure_frame AND arrival_frame
WHERE class_id = 0 GROUP BY ALL""")
def _(v):
    blank = upserted(v).filter("class_id = 0").withColumns({"pass_id": F.lit(None).cast("bigint"), "pass_phase": F.lit(None).cast("string")})
    return joins.retag_synthesised(blank, v.fx_pass_events)


@query("j12_homography_at", "match_id frame", "h2", views="fx_frames fx_homography", sql="SELECT match_id, frame, h2 FROM fx_frames LEFT JOIN fx_homography USING (match_id, frame)")
def _(v):
    return joins.homography_at(v.fx_frames, h_array(v.fx_homography)).withColumn("h2", F.col("h")[2])


@query("j12_covered_range", "match_id first_frame last_frame n_frames", views="fx_homography", sql="SELECT match_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n_frames FROM fx_homography GROUP BY ALL")
def _(v):
    return joins.covered_range(h_array(v.fx_homography))


HOLD = "s AS (SELECT f.match_id, f.frame, CASE WHEN f.frame % 40 < 18 THEN NULL ELSE h2 END AS h2, f.frame % 40 < 18 AND f.frame % 3 <> 0 AS degenerate FROM fx_frames f LEFT JOIN fx_homography USING (match_id, frame))"


@query("j13_hold_last_good", "match_id frame", "h2", "ok", views="fx_frames fx_homography", extra=HOLD, sql="""
SELECT match_id, frame, CASE WHEN good THEN h2 WHEN degenerate AND sum(CAST(degenerate AS INT)) OVER (PARTITION BY match_id, run ORDER BY frame) <= 15 THEN lst END AS h2, (CASE WHEN good THEN h2 WHEN degenerate AND sum(CAST(degenerate AS INT)) OVER (PARTITION BY match_id, run ORDER BY frame) <= 15 THEN lst END) IS NOT NULL AS ok
FROM (SELECT *, h2 IS NOT NULL AND NOT degenerate AS good, sum(CAST(h2 IS NOT NULL AND NOT degenerate AS INT)) OVER w AS run, last_value(CASE WHEN NOT degenerate THEN h2 END IGNORE NULLS) OVER w AS lst FROM s WINDOW w AS (PARTITION BY match_id ORDER BY frame))""")
def _(v):
    f = joins.homography_at(v.fx_frames, h_array(v.fx_homography))
    hide = F.col("frame") % 40 < 18
    f = f.withColumns({"h": F.when(~hide, F.col("h")), "degenerate": hide & (F.col("frame") % 3 != 0)})
    return windows.hold_last_good(f).withColumn("h2", F.col("held_h")[2])


def gt_pred(v):
    return v.fx_pred, v.fx_gt


MATCH = f"mm AS (SELECT b.match_id, b.frame, a.gt_id, b.pred_id, {IOU} AS iou FROM fx_gt a JOIN fx_pred b USING (match_id, frame) WHERE {IOU} >= 0.5)"


@query("j15_match_boxes", "match_id frame gt_id pred_id", "iou", views="fx_gt fx_pred", extra=MATCH, sql="SELECT * FROM mm")
def _(v):
    return joins.match_boxes(*gt_pred(v))


@query("j16_snap_to_vertex", T + " vertex", "vertex_dist", views="fx_tracks fx_vertices", extra="pt AS (SELECT *, row_number() OVER () AS rid FROM fx_tracks WHERE x_m IS NOT NULL)", sql="""
SELECT * FROM (SELECT t.*, v.label AS vertex, sqrt((t.x_m-v.x_cm)**2+(t.y_m-v.y_cm)**2) AS vertex_dist, row_number() OVER (PARTITION BY rid ORDER BY sqrt((t.x_m-v.x_cm)**2+(t.y_m-v.y_cm)**2), v.label) AS rn FROM pt t, fx_vertices v) WHERE rn = 1""")
def _(v):
    return joins.snap_to_vertex(v.fx_tracks.filter("x_m IS NOT NULL").withColumns({"x_cm": F.col("x_m"), "y_cm": F.col("y_m")}), v.fx_vertices)


@query("j17_anchor_points", "match_id frame n", "ix px py", views="fx_keypoints fx_vertices", sql="SELECT match_id, frame, row_number() OVER (PARTITION BY match_id, frame ORDER BY k.label) - 1 AS n, k.x AS ix, v.x_cm AS px, v.y_cm AS py FROM fx_keypoints k JOIN fx_vertices v ON k.label = v.label")
def _(v):
    k = v.fx_keypoints.groupBy("match_id", "frame").agg(F.array_sort(F.collect_list(F.struct("label", "x", "y"))).alias("l"))
    a = k.select("match_id", "frame", F.transform("l", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("image_pts"), F.transform("l", lambda q: q["label"]).alias("vertex_ids"))
    return joins.anchor_points(a, v.fx_vertices).select("match_id", "frame", F.posexplode(F.arrays_zip("image_pts", "pitch_pts")).alias("n", "z")).select("match_id", "frame", "n", F.col("z.image_pts.x").alias("ix"), F.col("z.pitch_pts.x").alias("px"), F.col("z.pitch_pts.y").alias("py"))


# windows
JUMP = f"""sw AS (SELECT *, CASE WHEN pf IS NULL OR frame - pf > 10 THEN 0 WHEN sqrt((cx-pcx)**2+(cy-pcy)**2) > greatest(180, 2.5*greatest(1, (h+ph)/2)) THEN 1 WHEN class_id <> pc THEN 1 ELSE 0 END AS is_split
FROM (SELECT *, lag(frame) OVER w AS pf, lag(cx) OVER w AS pcx, lag(cy) OVER w AS pcy, lag(h) OVER w AS ph, lag(class_id) OVER w AS pc FROM (SELECT *, {CX} AS cx, {CY} AS cy, y2-y1 AS h FROM t) WINDOW w AS (PARTITION BY match_id, display_track_id ORDER BY frame))),
sg AS (SELECT *, sum(is_split) OVER (PARTITION BY match_id, display_track_id ORDER BY frame) AS seg_idx FROM sw)"""


def segmented(v):
    return windows.segment_ids(windows.detect_swaps(one(v)))


@query("w1_detect_swaps", T + " is_split", views="fx_tracks", extra=ONE + "," + JUMP, sql="SELECT * FROM sw")
def _(v):
    return windows.detect_swaps(one(v))


@query("w2_segment_ids", T + " seg_idx", views="fx_tracks", extra=ONE + "," + JUMP, sql="SELECT * FROM sg")
def _(v):
    return segmented(v)


SEG = """SELECT match_id, display_track_id, seg_idx, min(frame) AS f0, max(frame) AS f1, count(*) AS n_frames, mc AS mode_cls, mt AS mode_team, avg((x1+x2)/2) AS cx, avg((y1+y2)/2) AS cy, display_track_id || '_' || CAST(seg_idx AS BIGINT) AS seg_key, (max(frame)-min(frame)+1)/30.0::DOUBLE AS dur_s
FROM sg JOIN (SELECT match_id, display_track_id, seg_idx, arg_min(class_id, (-n, class_id)) AS mc FROM (SELECT match_id, display_track_id, seg_idx, class_id, count(*) AS n FROM sg GROUP BY ALL) GROUP BY ALL) USING (match_id, display_track_id, seg_idx)
 JOIN (SELECT match_id, display_track_id, seg_idx, arg_min(team_id, (-n, team_id)) AS mt FROM (SELECT match_id, display_track_id, seg_idx, team_id, count(*) AS n FROM sg GROUP BY ALL) GROUP BY ALL) USING (match_id, display_track_id, seg_idx) GROUP BY ALL"""
SEG_COLS = ("match_id display_track_id seg_idx f0 f1 n_frames mode_cls mode_team", "cx cy dur_s", "seg_key")


@query("a4_segment_summary", *SEG_COLS, views="fx_tracks", extra=ONE + "," + JUMP, sql=SEG)
def _(v):
    return reports.segment_summary(segmented(v))


@query("a4_segment_summary_nominal", "match_id display_track_id seg_idx f0 f1", views="fx_tracks", extra=ONE + "," + JUMP, sql=f"SELECT * REPLACE (coalesce(lead(f0) OVER (PARTITION BY match_id, display_track_id ORDER BY seg_idx) - 1, f1) AS f1) FROM ({SEG})")
def _(v):
    return reports.segment_summary(segmented(v), bounds="nominal")


@query("s9_segment_template", "match_id tracker_id frame_start frame_end n_detections check_f1 check_f2 check_f3 canonical_id", "duration_s", "auto_role auto_team", views="fx_tracks", extra=ONE + "," + JUMP, sql=f"""
SELECT match_id, display_track_id AS tracker_id, f0 AS frame_start, f1 AS frame_end, n_frames AS n_detections, round(dur_s, 2) AS duration_s, CASE mode_cls WHEN 1 THEN 'keeper' WHEN 2 THEN 'player' ELSE 'referee' END AS auto_role,
 CASE WHEN mode_team >= 0 THEN CAST(mode_team AS VARCHAR) ELSE '' END AS auto_team, f0 AS check_f1, CASE WHEN f1 > f0 THEN CASE WHEN f1 = f0 + 1 THEN f1 ELSE (f0+f1)//2 END END AS check_f2, CASE WHEN f1 > f0 + 1 THEN f1 END AS check_f3, NULL AS canonical_id FROM ({SEG})""")
def _(v):
    from ..sources.tables import read_segment_template, segment_template

    return read_segment_template(segment_template(reports.segment_summary(segmented(v))).toDF("match_id", "Tracker ID", *"Frame_Start|Frame End|n_detections|duration_s|auto_role|auto_team|check_f1|check_f2|check_f3|Canonical ID|Team".split("|")))


FILL = """g AS (SELECT *, lead(frame) OVER w AS nf, lead(x1) OVER w AS nx1, lead(y2) OVER w AS ny2, lead(x_m) OVER w AS nxm FROM t WINDOW w AS (PARTITION BY match_id, display_track_id ORDER BY frame))"""


@query("w3_interpolate_gaps", "match_id frame display_track_id class_id team_id l_partkey track_filled", "x1 y2 x_m conf", views="fx_tracks", extra=ONE + "," + FILL, sql="""
SELECT match_id, frame, display_track_id, class_id, team_id, l_partkey, 0 AS track_filled, x1, y2, x_m, conf FROM t
UNION ALL SELECT match_id, f, display_track_id, class_id, team_id, l_partkey, 1, coalesce(x1+(nx1-x1)*(f-frame)/(nf-frame), x1), coalesce(y2+(ny2-y2)*(f-frame)/(nf-frame), y2), coalesce(x_m+(nxm-x_m)*(f-frame)/(nf-frame), x_m), 0
FROM (SELECT *, unnest(range(frame+1, nf)) AS f FROM g WHERE nf - frame BETWEEN 2 AND 25)""")
def _(v):
    return windows.interpolate_gaps(one(v))


VOTES = ONE + """, k AS (SELECT *, count(*) FILTER (team_id = 0) OVER w AS z, count(*) FILTER (team_id = 1) OVER w AS o, first_value(team_id) OVER w AS fv FROM t WHERE team_id >= 0 WINDOW w AS (PARTITION BY match_id, display_track_id ORDER BY frame ROWS BETWEEN 34 PRECEDING AND CURRENT ROW)),
vt AS (SELECT *, CASE WHEN z + o < 8 THEN -1 WHEN z > o THEN 0 WHEN o > z THEN 1 ELSE fv END AS vote_team FROM k)"""


@query("w5_team_votes", "match_id frame display_track_id team_id vote_team", views="fx_tracks", extra=VOTES, sql="SELECT * FROM vt")
def _(v):
    return windows.team_votes(one(v), "display_track_id")


@query("t6_team_memory", "match_id frame display_track_id memory_team", other="locked", views="fx_tracks", extra=VOTES, sql="""
SELECT *, coalesce(lk, vote_team) AS memory_team, lk IS NOT NULL AS locked FROM (SELECT *, first_value(CASE WHEN z + o >= 8 AND greatest(z, o) >= 0.7 * (z + o) THEN vote_team END IGNORE NULLS) OVER (PARTITION BY match_id, display_track_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS lk FROM vt)""")
def _(v):
    return windows.team_memory(one(v), "display_track_id")


@query("w6_state_transitions", "match_id frame", other="homography_state prev_state", views="fx_frames", sql="SELECT * FROM (SELECT *, lag(homography_state) OVER (PARTITION BY match_id ORDER BY frame) AS prev_state FROM fx_frames) WHERE prev_state <> homography_state")
def _(v):
    return windows.state_transitions(v.fx_frames)


@query("w7_seen_span", "match_id display_track_id first_seen last_seen", views="fx_tracks", sql="SELECT match_id, display_track_id, min(frame) AS first_seen, max(frame) AS last_seen FROM fx_tracks GROUP BY ALL")
def _(v):
    return windows.seen_span(v.fx_tracks)


@query("w8_carry_forward", "match_id frame src_frame display_track_id detector_ran l_partkey l_linenumber", views="fx_tracks fx_frames", extra="""sp AS (SELECT match_id, frame, last_value(CASE WHEN detector_ran = 1 THEN frame END IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY frame) AS src_frame FROM fx_frames)""",
       sql="SELECT s.match_id, s.frame, src_frame, display_track_id, CAST(s.frame = src_frame AS INT) AS detector_ran, l_partkey, l_linenumber FROM sp s JOIN fx_tracks t ON t.match_id = s.match_id AND t.frame = src_frame WHERE s.frame - src_frame <= 2")
def _(v):
    return windows.carry_forward(v.fx_tracks, v.fx_frames)


@query("w9_sample_and_hold", "match_id frame held_kp_used", views="fx_frames", sql="SELECT match_id, frame, last_value(CASE WHEN frame % 5 = 0 THEN kp_used END IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY frame) AS held_kp_used FROM fx_frames")
def _(v):
    return windows.sample_and_hold(v.fx_frames, ["kp_used"], 5)


@query("w10_ema", "match_id frame display_track_id", "ema")
def _(v):
    # both passes of the average then read the same four columns, so people are ranked once
    return windows.ema(one(v).select("match_id", "frame", "display_track_id", "x1"), "x1", 0.5)


# reports
@query("a1_kpi_summary", "match_id processed_frames unique_tracks", "avg_players_per_frame ball_detect_coverage ball_interp_coverage ball_roi_recovery_rate homography_ok_rate homography_available_rate valid_projection_ratio short_track_ratio team_unknown_ratio effective_fps", views="fx_tracks fx_frames", sql="""
SELECT match_id, f.n AS processed_frames, i.u AS unique_tracks, t.p / f.n AS avg_players_per_frame, t.r / f.n AS ball_detect_coverage, t.s / f.n AS ball_interp_coverage, 0 AS ball_roi_recovery_rate, f.ok AS homography_ok_rate, f.ok AS homography_available_rate,
 t.v AS valid_projection_ratio, i.sh AS short_track_ratio, i.un AS team_unknown_ratio, NULL AS effective_fps
FROM (SELECT match_id, count(*) AS n, avg(CAST(homography_ok AS INT)) AS ok FROM fx_frames GROUP BY ALL) f
LEFT JOIN (SELECT match_id, count(*) FILTER (class_id = 2) AS p, count(DISTINCT CASE WHEN class_id = 0 AND ball_interpolated = 0 THEN frame END) AS r, count(DISTINCT CASE WHEN class_id = 0 AND ball_interpolated = 1 THEN frame END) AS s, count(x_m) / count(*) AS v FROM fx_tracks GROUP BY ALL) t USING (match_id)
LEFT JOIN (SELECT match_id, count(*) AS u, avg(CAST(n <= 5 AS INT)) AS sh, avg(CAST(tm < 0 AS INT)) AS un FROM (SELECT match_id, display_track_id, count(*) AS n, max(team_id) AS tm FROM fx_tracks WHERE class_id <> 0 GROUP BY ALL) GROUP BY ALL) i USING (match_id)""")
def _(v):
    return reports.kpi_summary(v.fx_tracks, v.fx_frames)


@query("a2_short_track_ratio", "match_id unique_tracks", "short_track_ratio", views="fx_tracks", sql="SELECT match_id, count(*) AS unique_tracks, avg(CAST(n <= 5 AS INT)) AS short_track_ratio FROM (SELECT match_id, display_track_id, count(*) AS n FROM fx_tracks WHERE class_id <> 0 GROUP BY ALL) GROUP BY ALL")
def _(v):
    return reports.short_track_ratio(v.fx_tracks)


@query("a3_class_purity", "match_id display_track_id n_rows mode_class mode_team", "purity", "is_clean", views="fx_tracks", sql="""
SELECT a.*, b.mode_team, purity >= 0.85 AS is_clean FROM (SELECT match_id, display_track_id, max(n) / sum(n) AS purity, sum(n) AS n_rows, arg_min(class_id, (-n, class_id)) AS mode_class FROM (SELECT match_id, display_track_id, class_id, count(*) AS n FROM fx_tracks WHERE class_id <> 0 GROUP BY ALL) GROUP BY ALL) a
JOIN (SELECT match_id, display_track_id, arg_min(team_id, (-n, team_id)) AS mode_team FROM (SELECT match_id, display_track_id, team_id, count(*) AS n FROM fx_tracks WHERE class_id <> 0 GROUP BY ALL) GROUP BY ALL) b USING (match_id, display_track_id)""")
def _(v):
    return reports.class_purity(v.fx_tracks)


@query("a5_coverage_per_id", "match_id team_id display_track_id n_frames n_rows", views="fx_tracks", sql="SELECT match_id, team_id, display_track_id, count(DISTINCT frame) AS n_frames, count(*) AS n_rows FROM fx_tracks WHERE class_id <> 0 GROUP BY ALL")
def _(v):
    return reports.coverage_per_id(v.fx_tracks, ("team_id", "display_track_id"))


@query("a6_table_profile", "match_id n_rows n_frames n_ids", views="fx_tracks", sql="SELECT match_id, count(*) AS n_rows, count(DISTINCT frame) AS n_frames, count(DISTINCT display_track_id) AS n_ids FROM fx_tracks GROUP BY ALL")
def _(v):
    return reports.table_profile(v.fx_tracks)


@query("a7_pass_stats", "match_id total complete incomplete", "completion_rate mean_duration_s", views="fx_pass_events", sql="SELECT match_id, count(*) AS total, count(*) FILTER (outcome = 'complete') AS complete, count(*) FILTER (outcome = 'incomplete') AS incomplete, count(*) FILTER (outcome = 'complete') / count(*) AS completion_rate, avg(arrival_frame - departure_frame) / 30 AS mean_duration_s FROM fx_pass_events GROUP BY ALL")
def _(v):
    return reports.pass_stats(v.fx_pass_events)


@query("a8_passes_per_passer", "match_id passer_id n", views="fx_pass_events", sql="SELECT match_id, passer_id, count(*) AS n FROM fx_pass_events GROUP BY ALL")
def _(v):
    return reports.pass_counts(v.fx_pass_events, "passer_id")


@query("a8_passes_by_source", "match_id n", other="dep_src", views="fx_pass_events", sql="SELECT match_id, dep_src, count(*) AS n FROM fx_pass_events GROUP BY ALL")
def _(v):
    return reports.pass_counts(v.fx_pass_events, "dep_src")


@query("a9_ball_coverage", "match_id n_frames ball_frames", "coverage", views="fx_tracks fx_frames", sql="SELECT match_id, n AS n_frames, coalesce(b, 0) AS ball_frames, coalesce(b, 0) / n AS coverage FROM (SELECT match_id, count(*) AS n FROM fx_frames GROUP BY ALL) LEFT JOIN (SELECT match_id, count(DISTINCT frame) AS b FROM fx_tracks WHERE class_id = 0 GROUP BY ALL) USING (match_id)")
def _(v):
    return reports.ball_coverage(v.fx_tracks, v.fx_frames)


@query("a10_ball_half_size", "match_id", "half_w half_h", views="fx_tracks", extra=HALF, sql="SELECT * FROM half")
def _(v):
    return reports.ball_half_size(v.fx_tracks)


@query("a11_state_counts", "match_id n", other="homography_state", views="fx_frames", sql="SELECT match_id, homography_state, count(*) AS n FROM (SELECT DISTINCT match_id, frame, homography_state FROM fx_frames) GROUP BY ALL")
def _(v):
    return reports.state_counts(v.fx_frames)


@query("a12_detection_report", "match_id class_id empty_frames", "mean median p10 p90", views="fx_tracks fx_frames", sql="""
SELECT match_id, class_id, avg(c) AS mean, quantile_cont(c, 0.5) AS median, quantile_cont(c, 0.1) AS p10, quantile_cont(c, 0.9) AS p90, count(*) FILTER (c = 0) AS empty_frames
FROM (SELECT f.match_id, k.class_id, coalesce(n, 0) AS c FROM fx_frames f JOIN (SELECT DISTINCT match_id, class_id FROM fx_tracks) k USING (match_id) LEFT JOIN (SELECT match_id, frame, class_id, count(*) AS n FROM fx_tracks GROUP BY ALL) t ON t.match_id = f.match_id AND t.frame = f.frame AND t.class_id = k.class_id) GROUP BY ALL""")
def _(v):
    return reports.detection_report(v.fx_tracks, v.fx_frames)


@query("a13_ball_report", "match_id frames_with_ball frames_with_several frames_real frames_interpolated_only", "off_pitch_share", views="fx_tracks", sql="""
SELECT match_id, count(*) AS frames_with_ball, count(*) FILTER (c > 1) AS frames_with_several, count(*) FILTER (r = 0) AS frames_real, count(*) FILTER (r = 1) AS frames_interpolated_only, sum(o) / sum(pl) AS off_pitch_share
FROM (SELECT match_id, frame, count(*) AS c, min(ball_interpolated) AS r, count(x_m) AS pl, count(*) FILTER (NOT (x_m BETWEEN 0 AND 12000 AND y_m BETWEEN 0 AND 7000)) AS o FROM fx_tracks WHERE class_id = 0 GROUP BY ALL) GROUP BY ALL""")
def _(v):
    return reports.ball_report(v.fx_tracks)


@query("a14_homography_report", "match_id frames_few_kp", "ok_rate state_ok_share median_kp_used people_with_xy", views="fx_tracks fx_frames", sql="""
SELECT * FROM (SELECT match_id, avg(CAST(homography_ok AS INT)) AS ok_rate, avg(CAST(homography_state = 'ok' AS INT)) AS state_ok_share, median(kp_used) AS median_kp_used, count(*) FILTER (kp_used < 4) AS frames_few_kp FROM fx_frames GROUP BY ALL)
LEFT JOIN (SELECT match_id, count(x_m) / count(*) AS people_with_xy FROM fx_tracks WHERE class_id <> 0 GROUP BY ALL) USING (match_id)""")
def _(v):
    return reports.homography_report(v.fx_frames, v.fx_tracks)


@query("a15_identity_report", "match_id class_id unique_ids segments expected_ids", "rows_in_long_ids mean_segment_s median_segment_s p90_segment_s ids_ratio new_ids_per_minute", views="fx_tracks fx_frames", extra="""
pe AS (SELECT match_id, class_id, display_track_id AS id, frame FROM fx_tracks WHERE class_id <> 0),
ru AS (SELECT match_id, class_id, id, sum(cut) OVER (PARTITION BY match_id, class_id, id ORDER BY frame) AS run, frame FROM (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY match_id, class_id, id ORDER BY frame) <= 1 THEN 0 ELSE 1 END AS cut FROM (SELECT DISTINCT * FROM pe))),
sg AS (SELECT match_id, class_id, count(*) AS segments, avg(s) AS mean_segment_s, median(s) AS median_segment_s, quantile_cont(s, 0.9) AS p90_segment_s FROM (SELECT match_id, class_id, id, run, (max(frame)-min(frame)+1)/30.0::DOUBLE AS s FROM ru GROUP BY ALL) GROUP BY ALL),
un AS (SELECT match_id, class_id, count(*) AS unique_ids, sum(CASE WHEN life >= 60 THEN n ELSE 0 END) / sum(n) AS rows_in_long_ids FROM (SELECT match_id, class_id, id, count(*) AS n, (max(frame)-min(frame)+1)/30.0::DOUBLE AS life FROM pe GROUP BY ALL) GROUP BY ALL)""",
       sql="SELECT un.*, segments, mean_segment_s, median_segment_s, p90_segment_s, CASE class_id WHEN 2 THEN 20 WHEN 1 THEN 2 ELSE 1 END AS expected_ids, unique_ids / CASE class_id WHEN 2 THEN 20 WHEN 1 THEN 2 ELSE 1 END AS ids_ratio, unique_ids / m AS new_ids_per_minute FROM un JOIN sg USING (match_id, class_id) JOIN (SELECT match_id, count(*) / 30 / 60 AS m FROM fx_frames GROUP BY ALL) USING (match_id)")
def _(v):
    return reports.identity_report(v.fx_tracks, v.fx_frames)


@query("a16_impossible_jumps", "match_id image_jumps pitch_jumps", "player_minutes image_jumps_per_minute pitch_jumps_per_minute", views="fx_tracks", extra=ONE, sql=f"""
SELECT *, image_jumps / player_minutes AS image_jumps_per_minute, pitch_jumps / player_minutes AS pitch_jumps_per_minute FROM (SELECT match_id, count(*) FILTER (frame - pf = 1 AND sqrt((cx-pcx)**2+(cy-pcy)**2) > y2-y1) AS image_jumps, count(*) FILTER (frame - pf = 1 AND sqrt((x_m-pxm)**2+(y_m-pym)**2) / 100 * 30 > 12) AS pitch_jumps, count(*)/30/60 AS player_minutes
FROM (SELECT *, lag(frame) OVER w AS pf, lag(cx) OVER w AS pcx, lag(cy) OVER w AS pcy, lag(x_m) OVER w AS pxm, lag(y_m) OVER w AS pym FROM (SELECT *, {CX} AS cx, {CY} AS cy FROM t WHERE class_id = 2) WINDOW w AS (PARTITION BY match_id, display_track_id ORDER BY frame)) GROUP BY ALL)""")
def _(v):
    return reports.impossible_jumps(one(v))


@query("a17_duplicate_id_rows", "match_id duplicate_rows", views="fx_tracks", sql="SELECT match_id, sum(c - 1) AS duplicate_rows FROM (SELECT match_id, frame, class_id, display_track_id, count(*) AS c FROM fx_tracks GROUP BY ALL) GROUP BY ALL")
def _(v):
    return reports.duplicate_id_rows(v.fx_tracks)


@query("a18_team_report", "match_id ids_with_label ids_with_flip total_flips", "unknown_share", views="fx_tracks", extra=ONE, sql="""
SELECT match_id, count(*) FILTER (has) AS ids_with_label, count(*) FILTER (f > 0) AS ids_with_flip, sum(f) AS total_flips, any_value(us) AS unknown_share FROM (SELECT match_id, display_track_id, bool_or(team_id >= 0) AS has, coalesce(sum(CAST(team_id <> pt AS INT)), 0) AS f FROM (SELECT *, lag(team_id) OVER (PARTITION BY match_id, display_track_id ORDER BY frame) AS pt FROM t WHERE class_id = 2 AND team_id >= 0) GROUP BY ALL)
JOIN (SELECT match_id, avg(CAST(team_id < 0 AS INT)) AS us FROM t WHERE class_id = 2 GROUP BY ALL) USING (match_id) GROUP BY match_id""")
def _(v):
    return reports.team_report(one(v))


@query("a26_keypoint_diagnostics", "match_id change_no frame n n_good", "min_conf max_conf mean_conf", views="fx_frames fx_keypoints", extra="""ch AS (SELECT match_id, change_no, unnest(range(frame, frame + 6)) AS frame FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frame) AS change_no FROM (SELECT *, lag(homography_state) OVER (PARTITION BY match_id ORDER BY frame) AS ps FROM fx_frames) WHERE ps <> homography_state) WHERE change_no <= 8)""",
       sql="SELECT match_id, change_no, frame, count(*) AS n, min(conf) AS min_conf, max(conf) AS max_conf, avg(conf) AS mean_conf, count(*) FILTER (conf > 0.5) AS n_good FROM fx_keypoints JOIN ch USING (match_id, frame) GROUP BY ALL")
def _(v):
    return reports.keypoint_diagnostics(v.fx_frames, v.fx_keypoints)


@query("a28_segment_map_summary", "match_id canonical_ids dropped_segments unlabelled_segments", views="fx_segment_map", sql="SELECT match_id, count(DISTINCT canonical_id) FILTER (canonical_id > 0) AS canonical_ids, count(*) FILTER (canonical_id = 0) AS dropped_segments, count(*) FILTER (canonical_id IS NULL) AS unlabelled_segments FROM fx_segment_map GROUP BY ALL")
def _(v):
    return reports.segment_map_summary(v.fx_segment_map)


@query("s6_load_pass_events", "match_id pass_id next_id", other="notes", views="fx_pass_events", sql="SELECT match_id, pass_id, '' AS notes, max(pass_id) OVER () + 1 AS next_id FROM fx_pass_events")
def _(v):
    from ..sources.tables import load_pass_events, next_pass_id

    e = load_pass_events(v.fx_pass_events)
    return e.withColumn("next_id", F.lit(next_pass_id(e)))


# scores
@query("a19_mot_score", "match_id gt pred tp fp fn switches", "recall precision mota", views="fx_gt fx_pred", extra=MATCH, sql="""
SELECT *, tp / gt AS recall, tp / pred AS precision, 1 - (fn + fp + switches) / gt AS mota FROM (SELECT match_id, gt, pred, tp, pred - tp AS fp, gt - tp AS fn, switches FROM (SELECT match_id, count(*) AS gt FROM fx_gt GROUP BY ALL) JOIN (SELECT match_id, count(*) AS pred FROM fx_pred GROUP BY ALL) USING (match_id)
JOIN (SELECT match_id, count(*) AS tp, count(*) FILTER (pp <> pred_id) AS switches FROM (SELECT *, lag(pred_id) OVER (PARTITION BY match_id, gt_id ORDER BY frame) AS pp FROM mm) GROUP BY ALL) USING (match_id))""")
def _(v):
    return scoring.mot_score(*gt_pred(v))


#: An id's own player has more of its frames than the next one, the only other that it covers: the best mapping is by equal ids.
@query("a20_id_score", "match_id gt pred idtp", "idp idr idf1", views="fx_gt fx_pred", extra=MATCH, sql="""
SELECT match_id, gt, pred, idtp, idtp / pred AS idp, idtp / gt AS idr, 2 * idtp / (gt + pred) AS idf1 FROM (SELECT match_id, count(*) AS gt FROM fx_gt GROUP BY 1) JOIN (SELECT match_id, count(*) AS pred FROM fx_pred GROUP BY 1) USING (match_id)
JOIN (SELECT match_id, count(*) FILTER (gt_id = pred_id) AS idtp FROM mm GROUP BY 1) USING (match_id)""")
def _(v):
    return scoring.id_score(*gt_pred(v))


@query("a21_id_switches", "match_id frame gt_id from_pred_id to_pred_id", views="fx_gt fx_pred", extra=MATCH, sql="SELECT match_id, frame, gt_id, pp AS from_pred_id, pred_id AS to_pred_id FROM (SELECT *, lag(pred_id) OVER (PARTITION BY match_id, gt_id ORDER BY frame) AS pp FROM mm) WHERE pp <> pred_id")
def _(v):
    return scoring.id_switches(joins.match_boxes(*gt_pred(v)))


@query("a22_merged_pred_ids", "match_id pred_id n_gt n", views="fx_gt fx_pred", extra=MATCH, sql="SELECT match_id, pred_id, count(*) AS n_gt, sum(n) AS n FROM (SELECT match_id, pred_id, gt_id, count(*) AS n FROM mm GROUP BY ALL) GROUP BY ALL HAVING count(*) > 1")
def _(v):
    return scoring.merged_pred_ids(joins.match_boxes(*gt_pred(v)))


@query("a23_per_player_score", "match_id gt_id gt_frames matched_frames frames_with_correct_id mapped_pred_id distinct_pred_ids id_switches", "id_accuracy", views="fx_gt fx_pred", extra=MATCH, sql="""
SELECT *, frames_with_correct_id / gt_frames AS id_accuracy FROM (SELECT match_id, gt_id, count(*) AS gt_frames FROM fx_gt GROUP BY ALL) LEFT JOIN (
  SELECT match_id, gt_id, count(*) AS matched_frames, count(*) FILTER (gt_id = pred_id) AS frames_with_correct_id, max(pred_id) FILTER (gt_id = pred_id) AS mapped_pred_id, count(DISTINCT pred_id) AS distinct_pred_ids, count(*) FILTER (pp <> pred_id) AS id_switches
  FROM (SELECT *, lag(pred_id) OVER (PARTITION BY match_id, gt_id ORDER BY frame) AS pp FROM mm) GROUP BY ALL) USING (match_id, gt_id)""")
def _(v):
    return scoring.per_player_score(*gt_pred(v))


@query("a24_frame_offset_fit", "match_id frame_offset matches", views="fx_gt fx_pred", sql=f"""
SELECT match_id, frame_offset, n AS matches FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY n DESC, abs(frame_offset), frame_offset) AS k FROM (SELECT b.match_id, o AS frame_offset, count(*) AS n FROM fx_gt a, fx_pred b, (SELECT unnest(range(-2, 3)) AS o) WHERE a.match_id = b.match_id AND a.frame = b.frame + o AND {IOU} >= 0.5 GROUP BY ALL)) WHERE k = 1""")
def _(v):
    return scoring.frame_offset_fit(*gt_pred(v), most=2)


@query("a24_height_ratio", "match_id", "box_height_ratio_median", views="fx_gt fx_pred", extra=MATCH, sql="SELECT mm.match_id, median((p.y2-p.y1)/(g.y2-g.y1)) AS box_height_ratio_median FROM mm JOIN fx_pred p USING (match_id, frame, pred_id) JOIN fx_gt g USING (match_id, frame, gt_id) GROUP BY ALL")
def _(v):
    return scoring.height_ratio(*gt_pred(v))


@query("a25_compare_runs", "", "m0 m1 m2 m3", "metric", views="fx_gt fx_pred", sql="""
SELECT metric, max(v) FILTER (match_id = 0) AS m0, max(v) FILTER (match_id = 1) AS m1, max(v) FILTER (match_id = 2) AS m2, max(v) FILTER (match_id = 3) AS m3 FROM (SELECT match_id, 'gt' AS metric, count(*) AS v FROM fx_gt GROUP BY ALL UNION ALL SELECT match_id, 'pred', count(*) FROM fx_pred GROUP BY ALL) GROUP BY ALL""")
def _(v):
    pred, gt = gt_pred(v)
    long = gt.groupBy("match_id").count().withColumn("metric", F.lit("gt")).unionByName(pred.groupBy("match_id").count().withColumn("metric", F.lit("pred")))
    return scoring.compare_runs(long.select(F.concat(F.lit("m"), F.col("match_id")).alias("run"), "metric", F.col("count").cast("double").alias("value")), ["m0", "m1", "m2", "m3"])


# numbers in columns
@query("m3_kp_spread", "match_id frame n", "spread", views="fx_keypoints", sql="""
SELECT match_id, frame, n, CASE WHEN n < 3 THEN 0 ELSE sqrt(greatest((a+b)/2 - sqrt(greatest((a-b)*(a-b)/4 + c*c, 0)), 0)) END AS spread FROM (SELECT match_id, frame, count(*) AS n, var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c FROM fx_keypoints WHERE conf > 0.5 GROUP BY ALL)""")
def _(v):
    return v.fx_keypoints.filter("conf > 0.5").groupBy("match_id", "frame").agg(F.count("*").alias("n"), hg.weak_axis_spread("x", "y").alias("spread"))


@query("m4_template_reprojection", "match_id frame label", "ix iy", views="fx_homography fx_vertices", sql="""
SELECT match_id, frame, label, (a*x_cm+b*y_cm+c)/(g*x_cm+k*y_cm+l) AS ix, (d*x_cm+e*y_cm+f)/(g*x_cm+k*y_cm+l) AS iy FROM (SELECT *, h4*h8-h5*h7 AS a, h2*h7-h1*h8 AS b, h1*h5-h2*h4 AS c, h5*h6-h3*h8 AS d, h0*h8-h2*h6 AS e, h2*h3-h0*h5 AS f, h3*h7-h4*h6 AS g, h1*h6-h0*h7 AS k, h0*h4-h1*h3 AS l FROM fx_homography), fx_vertices""")
def _(v):
    frames = h_array(v.fx_homography).withColumn("inv", hg.inverse(F.col("h")))
    pitch = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(float(b)).alias("x"), F.lit(float(c)).alias("y")) for a, b, c in VERTICES])
    return hg_points(frames.select("match_id", "frame", "inv", F.explode(pitch).alias("q")))


def hg_points(df):
    x, y = hg.project(F.col("inv"), F.col("q.x"), F.col("q.y"))
    return df.select("match_id", "frame", F.col("q.label").alias("label"), x.alias("ix"), y.alias("iy")).filter("ix IS NOT NULL")


@query("m5_blend_h", "match_id frame", "b0 b2 b8", views="fx_homography", sql="SELECT match_id, frame, 0.75*h0 + 0.25*(h0*2/4) AS b0, 0.75*h2 + 0.25*(h2*2/4) AS b2, 1 AS b8 FROM fx_homography")
def _(v):
    h = h_array(v.fx_homography)
    other = F.transform(F.col("h"), lambda x: x * 2)
    other = F.concat(F.slice(other, 1, 8), F.array(F.lit(4.0)))
    b = hg.blend(F.col("h"), other, F.lit(0.25))
    return h.select("match_id", "frame", b[0].alias("b0"), b[2].alias("b2"), b[8].alias("b8"))


@query("t11_appearance_distance", "vec_id", "d", sql="SELECT a.vec_id, sqrt(list_sum(list_transform(range(1, len(a.embedding)+1), lambda i: (CAST(a.embedding[i] AS DOUBLE)-CAST(b.embedding[i] AS DOUBLE))**2)))/2 AS d FROM embeddings a JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) b USING (label)")
def _(v):
    e = v.table("embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("b"))
    return e.join(first, "label").select("vec_id", hg.appearance_distance(F.col("embedding"), F.col("b")).alias("d"))


@query("set_operations", "match_id frame display_track_id", views="fx_tracks", extra=ONE, sql="SELECT match_id, frame, display_track_id FROM t WHERE class_id = 2 AND (match_id, frame) NOT IN (SELECT match_id, frame FROM fx_tracks WHERE class_id = 0) UNION ALL SELECT match_id, frame, display_track_id FROM t WHERE class_id = 3")
def _(v):
    t = one(v)
    return t.filter("class_id = 2").join(v.fx_tracks.filter("class_id = 0"), ["match_id", "frame"], "left_anti").unionByName(t.filter("class_id = 3"))
