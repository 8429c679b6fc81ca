"""Queries of the row operators and of de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedupe as d
from ..operators import rows as p
from .registry import query

T = "match_id frame display_track_id class_id l_partkey l_linenumber"
TIE = ["-conf", "l_partkey", "l_linenumber"]


@query("p1_with_geometry", T, "cx cy foot_x foot_y w h area", views="fx_tracks", sql="SELECT *, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, (x1+x2)/2 AS foot_x, y2 AS foot_y, x2-x1 AS w, y2-y1 AS h, (x2-x1)*(y2-y1) AS area FROM fx_tracks")
def _(v):
    return p.with_geometry(v.fx_tracks)


@query("p2_class_conf_filter", T, "conf", views="fx_tracks", sql="SELECT * FROM fx_tracks WHERE conf >= CASE class_id WHEN 0 THEN 0.10 WHEN 3 THEN 0.22 ELSE 0.24 END")
def _(v):
    return p.class_conf_filter(v.fx_tracks)


@query("p3_tiny_box_filter", T, "x1", views="fx_tracks", sql="SELECT * FROM fx_tracks WHERE (x2-x1)*(y2-y1)/(1920*1080) >= CASE WHEN class_id = 0 THEN 0.00001 ELSE 0.00008 END")
def _(v):
    return p.tiny_box_filter(v.fx_tracks)


@query("p4_pad_boxes", T, "x1 y1 x2 y2", views="fx_tracks", extra="t AS (SELECT *, CASE WHEN class_id = 0 THEN 10.0 ELSE 0.0 END AS g FROM fx_tracks)", sql="SELECT * REPLACE (x1-g AS x1, y1-g AS y1, x2+g AS x2, y2+g AS y2) FROM t")
def _(v):
    return p.pad_boxes(v.fx_tracks)


@query("p5_split_by_role", "match_id n", other="role", views="fx_tracks", sql="SELECT match_id, role, count(*) AS n FROM fx_tracks JOIN (VALUES ('ball',0),('player',2),('official',1),('official',3),('people',1),('people',2),('people',3)) r(role, c) ON class_id = c GROUP BY ALL")
def _(v):
    t = v.fx_tracks
    parts = [p.split_by_role(t, r).groupBy("match_id").agg(F.count("*").alias("n")).withColumn("role", F.lit(r)) for r in p.ROLES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("p6_rescale_boxes", T, "x1 y1 x2 y2", views="fx_tracks", sql="SELECT * REPLACE (x1/1.5+100 AS x1, y1/1.5+50 AS y1, x2/1.5+100 AS x2, y2/1.5+50 AS y2) FROM fx_tracks")
def _(v):
    return p.rescale_boxes(v.fx_tracks, 1.5, 100.0, 50.0)


@query("p7_merge_detections", "match_id frame class_id n", "conf", views="fx_tracks", sql="""
SELECT match_id, frame, class_id, conf, count(*) AS n FROM (SELECT match_id, frame, class_id, conf FROM fx_tracks WHERE class_id <> 0
UNION ALL SELECT match_id, frame, 0, 0 FROM fx_tracks WHERE class_id = 0) GROUP BY ALL""")
def _(v):
    t = v.fx_tracks
    a = t.filter("class_id <> 0").select("match_id", "frame", "class_id", "conf", F.col("display_track_id").alias("tracker_id"))
    merged = p.merge_detections(a, t.filter("class_id = 0").select("match_id", "frame"))
    assert "tracker_id" not in merged.columns
    return merged.groupBy("match_id", "frame", "class_id", "conf").agg(F.count("*").alias("n"))


def h_array(df):
    return df.select("match_id", "frame", F.array(*[f"h{k}" for k in range(9)]).alias("h"))


@query("p8_project_to_pitch", T, "x_m y_m", views="fx_tracks fx_homography", sql="""
SELECT t.* EXCLUDE (x_m, y_m), (h0*cx + h1*t.y2 + h2) / (h6*cx + h7*t.y2 + h8) AS x_m, (h3*cx + h4*t.y2 + h5) / (h6*cx + h7*t.y2 + h8) AS y_m
FROM (SELECT *, (x1+x2)/2 AS cx FROM fx_tracks) t LEFT JOIN fx_homography USING (match_id, frame)""")
def _(v):
    return p.project_to_pitch(v.fx_tracks, h_array(v.fx_homography))


IN = "coalesce(x_m BETWEEN -{a} AND 12000 + {a} AND y_m BETWEEN -{b} AND 7000 + {b}, true)"


@query("p9_on_pitch", T, "x_m y_m", views="fx_tracks", sql="SELECT * FROM fx_tracks WHERE " + IN.format(a=50, b=20))
def _(v):
    return p.on_pitch(v.fx_tracks, 50.0, 20.0)


@query("p11_person_pitch_gate", T, "x_m y_m", views="fx_tracks", sql="SELECT * FROM fx_tracks WHERE class_id = 0 OR " + IN.format(a=8, b=5))
def _(v):
    return p.person_pitch_gate(v.fx_tracks)


@query("p12_demote_keepers", T + " orig_class_id", "x_m", views="fx_tracks", sql="SELECT * REPLACE (CASE WHEN class_id = 1 AND least(abs(x_m), abs(12000 - x_m)) > 1500 AND x_m IS NOT NULL THEN 2 ELSE class_id END AS class_id), class_id AS orig_class_id FROM fx_tracks")
def _(v):
    return p.demote_keepers(v.fx_tracks)


@query("p13_keypoint_select", "match_id frame label x_cm y_cm", "x y conf", views="fx_keypoints fx_vertices", sql="SELECT k.*, x_cm, y_cm FROM fx_keypoints k JOIN fx_vertices v ON k.label = v.label WHERE conf > 0.5")
def _(v):
    return p.keypoint_select(v.fx_keypoints, v.fx_vertices)


@query("p14_vertex_label", "l_orderkey l_linenumber vertex", sql="SELECT l_orderkey, l_linenumber, coalesce(TRY_CAST(CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag ELSE CAST(l_linenumber AS VARCHAR) END AS INT), CASE WHEN l_linenumber = 3 THEN 30 END, -1) AS vertex FROM lineitem")
def _(v):
    li = v.table("lineitem")
    name = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_returnflag")).otherwise(F.col("l_linenumber").cast("string"))
    return li.withColumn("vertex", p.vertex_label(name, F.when(F.col("l_linenumber") == 3, 30)))


@query("p15_frame_window", T, views="fx_tracks", sql="SELECT * FROM fx_tracks WHERE frame BETWEEN 10 AND 5000 AND (frame - 10) % 3 = 0 AND frame < 10 + 3 * 900")
def _(v):
    return p.frame_window(v.fx_tracks, 10, 5000, 3, 900)


@query("p16_frame_to_time", "match_id frame", "t", views="fx_frames", sql="SELECT match_id, frame, round(frame / 30.0::DOUBLE, 3) AS t FROM fx_frames")
def _(v):
    return v.fx_frames.withColumn("t", p.frame_to_time(F.col("frame")))


@query("p17_display_label", T, other="label", views="fx_tracks", sql="""
SELECT *, CASE WHEN class_id = 0 THEN NULL WHEN display_track_id = 19 THEN '#19' WHEN class_id = 3 THEN 'R' || display_track_id WHEN class_id = 1 THEN 'GK' || display_track_id
 WHEN team_id >= 0 THEN 'P' || display_track_id || '-' || team_id ELSE 'P' || display_track_id END AS label FROM fx_tracks""")
def _(v):
    slot = F.when(F.col("display_track_id") == 19, -1).otherwise(F.col("display_track_id"))
    return v.fx_tracks.withColumn("label", p.display_label(F.col("class_id"), slot, F.col("team_id"), F.col("display_track_id")))


@query("p18_role_names", "match_id class_id n", other="role team letter", views="fx_tracks", sql="""
SELECT match_id, class_id, CASE class_id WHEN 0 THEN 'ball' WHEN 1 THEN 'keeper' WHEN 2 THEN 'player' WHEN 3 THEN 'referee' ELSE 'unknown' END AS role,
 CASE WHEN team_id >= 0 THEN CAST(team_id AS VARCHAR) ELSE '' END AS team, CASE class_id WHEN 3 THEN 'REF' WHEN 1 THEN 'GK' ELSE 'P' END AS letter, count(*) AS n FROM fx_tracks GROUP BY ALL""")
def _(v):
    c = F.col("class_id")
    return v.fx_tracks.select("match_id", "class_id", p.role_name(c).alias("role"), p.auto_team(F.col("team_id")).alias("team"), p.default_role(c).alias("letter")).groupBy("match_id", "class_id", "role", "team", "letter").agg(F.count("*").alias("n"))


@query("p19_ball_source", T, other="ball_source", views="fx_tracks fx_ball_overrides", sql="""
SELECT t.*, CASE WHEN class_id <> 0 THEN NULL WHEN o.match_id IS NOT NULL THEN 'manual' WHEN ball_interpolated = 1 THEN 'interp' ELSE 'tracker' END AS ball_source
FROM fx_tracks t LEFT JOIN (SELECT DISTINCT match_id, frame FROM fx_ball_overrides) o USING (match_id, frame)""")
def _(v):
    return p.ball_source(v.fx_tracks, v.fx_ball_overrides)


@query("p20_parse_alias_cell", "rule_no id", other="cls", views="fx_alias_cells", sql="""
SELECT rule_no, coalesce(TRY_CAST(regexp_extract(cell, '^GK\\s*(\\d+)', 1) AS BIGINT), TRY_CAST(regexp_extract(cell, '^(\\d+)', 1) AS BIGINT)) AS id,
 CASE WHEN cell LIKE 'GK%' THEN 'GK' WHEN cell LIKE '%REF%' THEN 'REF' WHEN regexp_matches(cell, '^\\d+\\s*P$') THEN 'P' ELSE '' END AS cls FROM fx_alias_cells""")
def _(v):
    i, c = p.parse_alias_cell(F.col("cell"))
    return v.fx_alias_cells.select("rule_no", i.alias("id"), c.alias("cls"))


@query("p21_parse_frame_range", "rule_no fs fe", views="fx_alias_cells", sql="""
SELECT rule_no, TRY_CAST(split_part(frame_range, '-', 1) AS BIGINT) AS fs, TRY_CAST(CASE WHEN contains(frame_range, '-') THEN split_part(frame_range, '-', 2) ELSE frame_range END AS BIGINT) AS fe FROM fx_alias_cells""")
def _(v):
    a, b = p.parse_frame_range(F.col("frame_range"))
    return v.fx_alias_cells.select("rule_no", a.alias("fs"), b.alias("fe"))


@query("p22_panel_xy", T + " px py", views="fx_tracks", sql="SELECT *, trunc(x_m / 12000 * 400) AS px, trunc((1 - y_m / 7000) * 240) AS py FROM fx_tracks WHERE x_m IS NOT NULL")
def _(v):
    x, y = p.panel_xy(F.col("x_m"), F.col("y_m"))
    return v.fx_tracks.filter("x_m IS NOT NULL").withColumns({"px": x, "py": y})


@query("p23_radar_points", T, "x_m y_m", "bucket", views="fx_tracks", sql="""
SELECT *, CASE WHEN class_id = 0 THEN 'ball' WHEN class_id = 3 THEN 'ref' WHEN team_id = 0 THEN 'team0' WHEN team_id = 1 THEN 'team1' ELSE 'unknown' END AS bucket FROM fx_tracks WHERE frame % 5 = 0 AND x_m IS NOT NULL""")
def _(v):
    return p.radar_points(v.fx_tracks)


@query("p24_check_frames", "match_id id f", views="fx_tracks", sql="""
SELECT DISTINCT match_id, id, unnest([f0, CAST(floor((f0+f1)/2) AS BIGINT), f1]) AS f FROM (SELECT match_id, display_track_id AS id, min(frame) AS f0, max(frame) AS f1 FROM fx_tracks GROUP BY ALL)""")
def _(v):
    g = v.fx_tracks.groupBy("match_id", F.col("display_track_id").alias("id")).agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"))
    return g.select("match_id", "id", F.explode(p.check_frames(F.col("f0"), F.col("f1"))).alias("f"))


def ranked(keys, where="true", order="conf DESC, l_partkey, l_linenumber", n=1, rest=None):
    union = f" UNION ALL BY NAME SELECT * FROM fx_tracks WHERE NOT ({where})" if rest else ""
    return f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM fx_tracks WHERE {where}) WHERE rn <= {n}{union}"


ID = "match_id, frame, display_track_id"


@query("d1_dedupe_tracks", T, "conf", views="fx_tracks", sql=ranked(ID, "class_id <> 0", rest=True))
def _(v):
    return d.dedupe_tracks(v.fx_tracks, order=TIE)


@query("d1_dedupe_tracks_all_rows", T, "conf", views="fx_tracks", sql=ranked(ID))
def _(v):
    return d.dedupe_tracks(v.fx_tracks, scope="all", order=TIE)


@query("d2_collisions", "match_id frame display_track_id k", views="fx_tracks", sql=f"SELECT {ID}, count(*) AS k FROM fx_tracks WHERE class_id <> 0 GROUP BY ALL HAVING count(*) > 1")
def _(v):
    return d.resolve_collisions(v.fx_tracks, order=TIE)[1]


@query("d3_dedupe_from", T, "conf", views="fx_tracks", sql=ranked(ID, "class_id <> 0 AND frame >= 500", rest=True))
def _(v):
    return d.dedupe_from(v.fx_tracks, 500, order=TIE)


@query("d4_dedupe_ball", T, "conf", views="fx_tracks", sql=ranked("match_id, frame", "class_id = 0", "conf DESC, x1, l_partkey, l_linenumber", rest=True))
def _(v):
    return d.dedupe_ball(v.fx_tracks, ["-conf", "x1", "l_partkey", "l_linenumber"])


@query("d5_unique_stable_per_frame", T, "conf", views="fx_tracks", sql=ranked("match_id, frame, class_id, display_track_id", "display_track_id >= 0", rest=True))
def _(v):
    return d.unique_stable_per_frame(v.fx_tracks, "display_track_id", TIE)


@query("d6_official_quota", T, "conf", views="fx_tracks", sql=ranked("match_id, frame, class_id", "class_id IN (1, 3)", n=2, rest=True))
def _(v):
    return d.official_quota(v.fx_tracks, "conf", TIE[1:])


@query("d7_same_side_keeper", T, "conf", views="fx_tracks", sql="""
SELECT * EXCLUDE (sp, rn) FROM (SELECT *, max((x1+x2)/2) OVER w - min((x1+x2)/2) OVER w AS sp, row_number() OVER (PARTITION BY match_id, frame ORDER BY conf DESC, l_partkey, l_linenumber) AS rn
 FROM fx_tracks WHERE class_id = 1 WINDOW w AS (PARTITION BY match_id, frame)) WHERE sp >= 0.45 * 1920 OR rn = 1 UNION ALL BY NAME SELECT * FROM fx_tracks WHERE class_id <> 1""")
def _(v):
    return d.same_side_keeper(v.fx_tracks, "conf", TIE[1:])


@query("d8_player_cap", T, "conf", views="fx_tracks", sql=ranked("match_id, frame", "class_id = 2", n=3, rest=True))
def _(v):
    from dataclasses import replace

    return d.player_cap(v.fx_tracks, "conf", TIE[1:], replace(p.DEFAULTS, max_players=3))


@query("d9_top_n", T, "conf", views="fx_tracks", sql="SELECT * FROM fx_tracks ORDER BY frame DESC, class_id, display_track_id, match_id, l_partkey, l_linenumber LIMIT 10")
def _(v):
    return d.top_n(v.fx_tracks, 10, "-frame", "class_id", "display_track_id", "match_id", "l_partkey", "l_linenumber")
