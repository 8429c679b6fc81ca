"""Queries of the streaming operators: the views replayed, with the SQL of the batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds
from ..operators import rows as p
from ..params import DEFAULTS
from ..streaming import stateful
from ..streaming.replay import played
from .registry import query
from .row_queries import T
from .track_queries import VOTES, one

SLOTS = {2: 12, 1: 1, 3: 2}


@query("r1_stream_team_memory", "match_id frame track_id memory_team locked late", views="fx_tracks", extra=VOTES, sql="""
SELECT match_id, frame, display_track_id AS track_id, coalesce(lk, vote_team) AS memory_team, CAST(lk IS NOT NULL AS INT) AS locked, 0 AS late FROM (
  SELECT *, first_value(CASE WHEN z + o >= 8 AND greatest(z, o) >= 0.7 * (z + o) THEN vote_team END IGNORE NULLS) OVER (PARTITION BY match_id, display_track_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS lk FROM vt)""")
def _(v):
    """T6 over a stream."""
    people = one(v).select("match_id", "frame", F.col("display_track_id").alias("track_id"), "team_id")
    return played(people, stateful.stream_team_memory)


@query("r1_stream_smooth_ball", "match_id frame ball_interpolated late", "x1 y1 x2 y2 conf")
def _(v):
    """T1 over a stream."""
    return played(folds.ball_input(v.fx_tracks, v.fx_frames), stateful.stream_smooth_ball)


@query("r1_stream_display_slots", "match_id frame class_id track_id display_track_id evicted late")
def _(v):
    """T3 over a stream."""
    people = v.fx_tracks.filter("class_id <> 0").select("match_id", "frame", "class_id", F.col("display_track_id").alias("track_id"))
    return played(people, lambda s: stateful.stream_display_slots(s, limits=SLOTS))


@query("r2_running_kpis", "match_id n_rows player_rows ball_rows imputed_ball_rows placed_rows", views="fx_tracks", sql="""
SELECT match_id, count(*) AS n_rows, count(*) FILTER (class_id = 2) AS player_rows, count(*) FILTER (class_id = 0 AND ball_interpolated = 0) AS ball_rows, count(*) FILTER (class_id = 0 AND ball_interpolated = 1) AS imputed_ball_rows, count(x_m) AS placed_rows FROM fx_tracks GROUP BY 1""")
def _(v):
    """Counters of a stream after its last trigger."""
    return played(v.fx_tracks.select("match_id", "frame", "class_id", "ball_interpolated", "x_m"), lambda s: stateful.running_kpis(s.drop("event_ts")), mode="complete")


@query("r3_stream_filters", T, "conf", views="fx_tracks", sql="SELECT * FROM fx_tracks WHERE conf >= CASE class_id WHEN 0 THEN 0.10 WHEN 3 THEN 0.22 ELSE 0.24 END AND (x2-x1)*(y2-y1)/(1920*1080) >= CASE WHEN class_id = 0 THEN 0.00001 ELSE 0.00008 END")
def _(v):
    """Stateless filters of a stream."""
    return played(v.fx_tracks, lambda s: p.tiny_box_filter(p.class_conf_filter(s, DEFAULTS), DEFAULTS).drop("event_ts"))


#: Rows that come after all others, and the milliseconds of a frame as the stream counts them.
STRAGGLER, MS = "frame % 7 = 3", "CAST(FLOOR(FLOOR({} / 30.0 * 1000000) / 1000) AS BIGINT)"


@query("r4_late_rows", "match_id frame late n", views="fx_tracks", sql=f"""
SELECT match_id, frame, CASE WHEN {STRAGGLER} AND {MS.format("frame")} <= (SELECT {MS.format("max(frame)")} - 2000 FROM fx_tracks WHERE class_id = 0 AND NOT ({STRAGGLER})) THEN 1 ELSE 0 END AS late, count(*) AS n
FROM fx_tracks WHERE class_id = 0 GROUP BY ALL""")
def _(v):
    """Which balls came too late to be folded: every row of the stream comes out once, in time or flagged."""
    ball = v.fx_tracks.filter("class_id = 0").select("match_id", "frame", "conf")
    schema = "match_id bigint, frame bigint"
    told = lambda s: stateful.stream_fold(s, ["match_id"], ["-conf"], dict, lambda state, frame, rows: [{"match_id": r["match_id"], "frame": frame} for r in rows], schema)
    return played(ball.filter(f"NOT ({STRAGGLER})"), told, after=ball.filter(STRAGGLER)).groupBy("match_id", "frame", "late").agg(F.count("*").alias("n"))
