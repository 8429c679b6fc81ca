"""Views over the driver's tables that stand in for detections, tracks, passes, maps and scores.

Each is one SQL text that Spark and DuckDB read alike; ``{table}`` marks a table of the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Frames a match: the number of matches grows with the tables.
FRAMES = 3000


def _frame(key: str) -> str:
    return f"CAST(FLOOR({key} / 4) AS BIGINT) % {FRAMES}"


def _place(key: str) -> str:
    return f"{key} % 4 + 4 * CAST(FLOOR({key} / {4 * FRAMES}) AS BIGINT) AS match_id, {_frame(key)} AS frame"


VERTICES = [(1, 0, 0), (2, 0, 7000), (3, 2000, 1500), (4, 2000, 5500), (5, 6000, 0), (6, 6000, 3500), (7, 6000, 7000), (8, 10000, 1500), (9, 10000, 5500), (10, 12000, 0), (11, 12000, 7000), (12, 9000, 3500)]
_V = "(SELECT * FROM (VALUES " + ",".join(map(str, VERTICES)) + ") t(label, x_cm, y_cm))"

VIEWS = {
    "fx_frames": """
SELECT @PLACE(o_orderkey)@,
       CASE WHEN @FRAME(o_orderkey)@ % 17 = 0 THEN 'none' ELSE 'ok' END AS homography_state,
       CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS detector_ran,
       @FRAME(o_orderkey)@ % 17 <> 0 AS homography_ok, CAST(o_orderkey % 9 AS INT) AS kp_used
FROM {orders}""",
    "fx_tracks": """
WITH b AS (
  SELECT @PLACE(l_orderkey)@, CAST(l_suppkey % 20 AS BIGINT) AS tid,
         CASE WHEN l_linenumber = 7 THEN 0 WHEN l_suppkey % 20 = 0 THEN 1 WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN 3 ELSE 2 END AS class_id,
         CASE WHEN l_discount >= 0.10 THEN 600.0 ELSE 0.0 END AS jump, l.*
  FROM {lineitem} l)
SELECT match_id, frame, CASE WHEN class_id = 0 THEN -1 ELSE tid END AS display_track_id, class_id,
       CAST(l_extendedprice / 100000.0 AS DOUBLE) AS conf,
       CAST(60.0 * tid + frame % 200 + jump AS DOUBLE) AS x1, CAST(200.0 + l_quantity AS DOUBLE) AS y1,
       CAST(60.0 * tid + frame % 200 + jump + 30.0 AS DOUBLE) AS x2, CAST(260.0 + l_quantity AS DOUBLE) AS y2,
       CASE WHEN l_tax = 0.0 OR frame % 17 = 0 THEN NULL ELSE CAST(600.0 * tid + 10.0 * (frame % 200) - 200.0 AS DOUBLE) END AS x_m,
       CASE WHEN l_tax = 0.0 OR frame % 17 = 0 THEN NULL ELSE CAST(150.0 * l_quantity - 250.0 AS DOUBLE) END AS y_m,
       CASE WHEN class_id <> 2 OR l_tax >= 0.07 THEN -1 WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN CAST((tid + 1) % 2 AS INT) ELSE CAST(tid % 2 AS INT) END AS team_id,
       CASE WHEN class_id = 0 AND l_linestatus = 'F' THEN 1 ELSE 0 END AS ball_interpolated, l_partkey, l_linenumber
FROM b""",
    "fx_pass_events": """
SELECT event_id AS pass_id, @MATCH(event_id)@, @FRAME(event_id)@ AS departure_frame,
       @FRAME(event_id)@ + 1 + user_id % 12 AS arrival_frame, user_id % 20 AS passer_id, (user_id + 7) % 20 AS receiver_id,
       CASE user_id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'incomplete' ELSE 'unknown' END AS outcome,
       CASE WHEN value < 20 THEN 'interp' ELSE 'tracker' END AS dep_src
FROM {events} WHERE event_type = 'purchase'""",
    "fx_ball_overrides": """
SELECT @PLACE(event_id)@, CAST(value * 10 AS DOUBLE) AS cx, CAST(220.0 + user_id AS DOUBLE) AS cy
FROM {events} WHERE event_type = 'signup'""",
    "fx_segment_map": """
SELECT m.match_id, CAST(k.k % 20 AS BIGINT) AS tracker_id, CAST(FLOOR(k.k / 20) * 200 AS BIGINT) AS frame_start,
       CAST(FLOOR(k.k / 20) * 200 + 149 AS BIGINT) AS frame_end, CASE WHEN k.k % 11 = 0 THEN NULL ELSE CAST((k.k * 7) % 23 AS BIGINT) END AS canonical_id,
       CAST(k.k % 2 AS INT) AS team, k.k AS rule_no
FROM (SELECT DISTINCT @MATCH(o_orderkey)@ FROM {orders}) m
CROSS JOIN (SELECT n_nationkey + 25 * j AS k FROM {nation} CROSS JOIN (SELECT * FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11)) t(j)) t) k""",
    "fx_alias_cells": """
SELECT n_nationkey + 25 * COALESCE(m.match_id, 0) AS rule_no,
       CASE n_nationkey % 4 WHEN 0 THEN CONCAT(CAST(n_nationkey % 20 AS VARCHAR(9)), ' REF') WHEN 1 THEN CONCAT('GK', CAST(n_nationkey % 20 AS VARCHAR(9)))
            WHEN 2 THEN CONCAT(CAST(n_nationkey % 20 AS VARCHAR(9)), ' P') ELSE CONCAT(CAST(n_nationkey % 20 AS VARCHAR(9)), ' PT1') END AS cell,
       CASE n_nationkey % 4 WHEN 0 THEN '100-900' WHEN 1 THEN '500-' WHEN 2 THEN '321' ELSE NULL END AS frame_range, CAST((n_nationkey * 3) % 20 AS BIGINT) AS target, m.match_id
FROM {nation} LEFT JOIN (SELECT DISTINCT @MATCH(o_orderkey)@ FROM {orders}) m ON n_nationkey % 4 = m.match_id % 4 AND n_nationkey % 3 <> 0""",
    "fx_gt": """
SELECT match_id, frame, gt_id, x1, y1, x2, y2 FROM (
  SELECT @PLACE(l_orderkey)@, CAST(l_suppkey % 20 AS BIGINT) AS gt_id,
         CAST(60.0 * (l_suppkey % 20) AS DOUBLE) AS x1, CAST(200.0 AS DOUBLE) AS y1, CAST(60.0 * (l_suppkey % 20) + 30.0 AS DOUBLE) AS x2, CAST(260.0 AS DOUBLE) AS y2,
         ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_suppkey % 20 ORDER BY l_extendedprice, l_partkey, l_linenumber) AS rn
  FROM {lineitem} WHERE l_discount < 0.08) q WHERE rn = 1""",
    "fx_pred": """
SELECT match_id, frame, pred_id, x1, y1, x2, y2 FROM (
  SELECT @PLACE(l_orderkey)@,
         CAST(CASE WHEN l_orderkey % 1000 < 300 THEN (l_suppkey + 1) % 20 ELSE l_suppkey % 20 END AS BIGINT) AS pred_id,
         CAST(60.0 * (l_suppkey % 20) + l_partkey % 5 AS DOUBLE) AS x1, CAST(200.0 AS DOUBLE) AS y1, CAST(60.0 * (l_suppkey % 20) + l_partkey % 5 + 30.0 AS DOUBLE) AS x2, CAST(260.0 AS DOUBLE) AS y2,
         ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_suppkey % 20 ORDER BY l_extendedprice, l_partkey, l_linenumber) AS rn
  FROM {lineitem} WHERE l_discount > 0.01) q WHERE rn = 1""",
    "fx_vertices": _V[1:-1],
    "fx_keypoints": f"""
SELECT f.match_id, f.frame, 0 AS det_id, CAST(0.9 AS DOUBLE) AS det_conf, v.label, CAST(v.x_cm / 10.0 + 50.0 + f.frame % 30 AS DOUBLE) AS x, CAST(v.y_cm / 12.5 + 30.0 AS DOUBLE) AS y,
       CAST(0.3 + ((v.label * 7 + f.frame) % 10) * 0.07 AS DOUBLE) AS conf
FROM (SELECT @PLACE(o_orderkey)@ FROM {{orders}}) f CROSS JOIN {_V} v""",
    "fx_homography": """
SELECT @PLACE(o_orderkey)@,
       CAST(10.0 AS DOUBLE) AS h0, CAST(0.0 AS DOUBLE) AS h1, CAST(-500.0 - 10.0 * (@FRAME(o_orderkey)@ % 30) AS DOUBLE) AS h2,
       CAST(0.0 AS DOUBLE) AS h3, CAST(12.5 AS DOUBLE) AS h4, CAST(-375.0 AS DOUBLE) AS h5, CAST(0.0001 AS DOUBLE) AS h6, CAST(0.0 AS DOUBLE) AS h7, CAST(1.0 AS DOUBLE) AS h8
FROM {orders} WHERE @FRAME(o_orderkey)@ % 17 <> 0""",
}
for _name, _text in VIEWS.items():
    _text = re.sub(r"@PLACE\((\w+)\)@", lambda m: _place(m[1]), _text)
    _text = re.sub(r"@MATCH\((\w+)\)@", lambda m: _place(m[1]).split(",")[0], _text)
    VIEWS[_name] = re.sub(r"@FRAME\((\w+)\)@", lambda m: f"({_frame(m[1])})", _text)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used) if used else spark.sql(text)


def ctes(*names: str) -> str:
    """The views as leading common table expressions of an oracle's SQL."""
    return ",\n".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names)
