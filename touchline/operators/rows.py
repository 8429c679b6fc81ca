"""Row operators: filters, projections and labels (no shuffle unless a join is named)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import area, centre
from ..functions.homography import project
from ..params import BALL, DEFAULTS, KEEPER, PLAYER, REFEREE, Params

KEY = ["match_id", "frame"]


def with_geometry(df: DataFrame) -> DataFrame:
    """Adds cx, cy (centre), foot_x, foot_y (bottom centre), w, h, area."""
    cx, cy = centre()
    return df.withColumns({"cx": cx, "cy": cy, "foot_x": cx, "foot_y": F.col("y2"), "w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1"), "area": area()})


def class_conf_filter(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Rows at or above their class's confidence threshold; other classes go."""
    least = F.when(F.col("class_id") == BALL, p.conf_ball).when(F.col("class_id") == KEEPER, p.conf_keeper).when(F.col("class_id") == PLAYER, p.conf_player).when(F.col("class_id") == REFEREE, p.conf_referee)
    return df.filter(F.col("conf") >= least)


def tiny_box_filter(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Drops boxes whose share of the frame's area is below the least of people or of the ball."""
    least = F.when(F.col("class_id") == BALL, p.min_area_ball).otherwise(p.min_area_people)
    return df.filter(area() / float(p.frame_width * p.frame_height) >= least)


def pad_boxes(df: DataFrame, pixels: float = DEFAULTS.ball_pad_px) -> DataFrame:
    """Ball boxes grow by ``pixels`` on each side."""
    grow = F.when(F.col("class_id") == BALL, F.lit(float(pixels))).otherwise(F.lit(0.0))
    return df.withColumns({"x1": F.col("x1") - grow, "y1": F.col("y1") - grow, "x2": F.col("x2") + grow, "y2": F.col("y2") + grow})


ROLES = {"ball": (BALL,), "player": (PLAYER,), "official": (KEEPER, REFEREE), "people": (KEEPER, PLAYER, REFEREE)}


def split_by_role(df: DataFrame, role: str) -> DataFrame:
    return df.filter(F.col("class_id").isin(*ROLES[role]))


def rescale_boxes(df: DataFrame, scale: float = 1.0, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """Boxes found on an enlarged or cropped frame, in coordinates of the full frame."""
    return df.withColumns({c: F.col(c) / scale + (dx if c[0] == "x" else dy) for c in ("x1", "y1", "x2", "y2")})


def merge_detections(*parts: DataFrame) -> DataFrame:
    """Union by name; missing conf and class become 0; tracker_id stays only if every part has it."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    for c in ("conf", "class_id"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)) if c in out.columns else F.lit(0))
    if not all("tracker_id" in p.columns for p in parts):
        out = out.drop("tracker_id")
    return out


def project_to_pitch(df: DataFrame, homography: DataFrame, x: Column | None = None, y: Column | None = None) -> DataFrame:
    """Adds x_m, y_m of the bottom centre by the frame's homography ``h``; null without one.

    A left equi-join on (match_id, frame); one homography a frame, so no row is multiplied.
    """
    cx, _ = centre()
    px, py = project(F.col("_h"), cx if x is None else x, F.col("y2") if y is None else y)
    joined = df.drop("x_m", "y_m").join(homography.select(*KEY, F.col("h").alias("_h")), KEY, "left")
    return joined.withColumns({"x_m": px, "y_m": py}).drop("_h")


def inside(x: Column, y: Column, margin_x: float, margin_y: float, p: Params = DEFAULTS) -> Column:
    """Whether a point lies in the pitch and its margins; points without a place count as inside."""
    return F.coalesce(x.between(-margin_x, p.pitch_length + margin_x) & y.between(-margin_y, p.pitch_width + margin_y), F.lit(True))


def on_pitch(df: DataFrame, margin_x: float = DEFAULTS.margin_x, margin_y: float = DEFAULTS.margin_y, p: Params = DEFAULTS) -> DataFrame:
    return df.filter(inside(F.col("x_m"), F.col("y_m"), margin_x, margin_y, p))


def person_pitch_gate(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Drops people outside the pitch and its margins; the ball stays."""
    return df.filter((F.col("class_id") == BALL) | inside(F.col("x_m"), F.col("y_m"), p.margin_x, p.margin_y, p))


def demote_keepers(df: DataFrame, zone: float = DEFAULTS.keeper_zone, p: Params = DEFAULTS) -> DataFrame:
    """Keepers farther than ``zone`` from both goal lines become players; ``orig_class_id`` keeps the class."""
    far = F.least(F.abs(F.col("x_m")), F.abs(F.lit(p.pitch_length) - F.col("x_m"))) > zone
    return df.withColumn("orig_class_id", F.col("class_id")).withColumn("class_id", F.when((F.col("class_id") == KEEPER) & far, F.lit(PLAYER)).otherwise(F.col("class_id")))


def keypoint_select(keypoints: DataFrame, vertices: DataFrame, least: float = DEFAULTS.keypoint_conf) -> DataFrame:
    """Keypoints of each frame's most confident pitch object above the threshold, with their pitch points.

    Labels name vertices; a frame none of whose labels is a vertex falls back on the points' order. ``vertices`` is the
    pitch's fixed list (some 32 rows), small enough for Spark to broadcast by its own size rule.
    """
    best = Window.partitionBy(*KEY).orderBy(F.desc("det_conf"), "det_id")
    kept = keypoints.withColumn("_first", F.first("det_id").over(best)).filter((F.col("det_id") == F.col("_first")) & (F.col("conf") > least)).drop("_first")
    named = vertices.select(F.col("label").alias("_l"), F.col("x_cm").alias("_x"), F.col("y_cm").alias("_y"))
    order = Window.partitionBy(*KEY).orderBy("label", "x", "y")
    placed = kept.withColumn("_pos", F.row_number().over(order)).join(named, F.col("label") == F.col("_l"), "left")
    placed = placed.withColumn("_any", F.max(F.col("_l").isNotNull()).over(Window.partitionBy(*KEY)))
    spot = vertices.select(F.row_number().over(Window.orderBy("label")).alias("_p"), F.col("x_cm").alias("_px"), F.col("y_cm").alias("_py"))
    both = placed.join(spot, ~F.col("_any") & (F.col("_pos") == F.col("_p")), "left")
    out = both.withColumns({"x_cm": F.when(F.col("_any"), F.col("_x")).otherwise(F.col("_px")), "y_cm": F.when(F.col("_any"), F.col("_y")).otherwise(F.col("_py"))})
    return out.filter("x_cm IS NOT NULL").drop("_l", "_x", "_y", "_pos", "_any", "_p", "_px", "_py")


def vertex_label(name: Column, class_id: Column) -> Column:
    """A numeric class name, else the class id, else -1."""
    return F.coalesce(name.try_cast("int"), class_id.cast("int"), F.lit(-1))


def frame_window(df: DataFrame, start: int = 0, end: int | None = None, every: int = 1, most: int | None = None) -> DataFrame:
    """Frames start..end, every n-th of them, at most ``most`` of these."""
    keep = (F.col("frame") >= start) & ((F.col("frame") - start) % every == 0)
    if end is not None:
        keep = keep & (F.col("frame") <= end)
    if most is not None:
        keep = keep & (F.col("frame") < start + every * most)
    return df.filter(keep)


def frame_to_time(frame: Column, fps: float = DEFAULTS.fps) -> Column:
    return F.round(frame / fps, 3)


def display_label(class_id: Column, slot: Column, team: Column, track_id: Column) -> Column:
    """``P7-1`` or ``P7`` for players, ``R2``, ``GK1``; ``#id`` for people without a slot; null for the ball."""
    n = slot.cast("string")
    player = F.when(team >= 0, F.concat(F.lit("P"), n, F.lit("-"), team.cast("string"))).otherwise(F.concat(F.lit("P"), n))
    return F.when(class_id == BALL, F.lit(None).cast("string")).when(slot < 0, F.concat(F.lit("#"), track_id.cast("string"))).when(class_id == REFEREE, F.concat(F.lit("R"), n)).when(class_id == KEEPER, F.concat(F.lit("GK"), n)).otherwise(player)


def role_name(class_id: Column) -> Column:
    return F.when(class_id == BALL, "ball").when(class_id == KEEPER, "keeper").when(class_id == PLAYER, "player").when(class_id == REFEREE, "referee").otherwise("unknown")


def auto_team(team: Column) -> Column:
    return F.when(team >= 0, team.cast("string")).otherwise("")


def default_role(class_id: Column) -> Column:
    return F.when(class_id == REFEREE, "REF").when(class_id == KEEPER, "GK").otherwise("P")


def ball_source(tracks: DataFrame, overrides: DataFrame) -> DataFrame:
    """Adds ``ball_source`` to ball rows: manual, tracker or interp; ``missing`` where a ball row has no box."""
    marks = overrides.select(*KEY).distinct().withColumn("_manual", F.lit(True))
    source = F.when(F.col("class_id") != BALL, F.lit(None).cast("string")).when(F.col("_manual"), "manual").when(F.col("x1").isNull(), "missing").when(F.col("ball_interpolated") == 1, "interp").otherwise("tracker")
    return tracks.join(marks, KEY, "left").withColumn("ball_source", source).drop("_manual")


def parse_alias_cell(cell: Column) -> tuple[Column, Column]:
    """(id, class) of a sheet's cell: ``1 REF``, ``GK1``, ``2 P``, ``25 PT1`` (class '')."""
    text = F.upper(F.trim(cell))
    keeper = F.nullif(F.regexp_extract(text, r"^GK\s*(\d+)", 1), F.lit(""))
    number = F.nullif(F.regexp_extract(text, r"^(\d+)", 1), F.lit(""))
    tail = F.trim(F.regexp_replace(text, r"^\d+", ""))
    kind = F.when(keeper.isNotNull(), "GK").when(tail.contains("REF"), "REF").when(tail == "P", "P").when(tail.contains("GK"), "GK").otherwise("")
    return F.coalesce(keeper, number).try_cast("bigint"), F.when(F.coalesce(keeper, number).isNotNull(), kind)


def parse_frame_range(text: Column) -> tuple[Column, Column]:
    """(first, last) of ``a-b``, ``a-`` (open end) and ``f`` (that frame only); blank covers everything (both null)."""
    parts = F.split(F.trim(text), "-")
    first, last = F.trim(parts[0]).try_cast("bigint"), F.trim(F.try_element_at(parts, F.lit(2))).try_cast("bigint")
    return first, F.when(F.size(parts) == 1, first).otherwise(last)


def panel_xy(x: Column, y: Column, width: int = 400, height: int = 240, p: Params = DEFAULTS) -> tuple[Column, Column]:
    """Pitch coordinates as whole pixels of a panel whose y axis points down."""
    return (x / p.pitch_length * width).cast("int"), ((1 - y / p.pitch_width) * height).cast("int")


def radar_points(df: DataFrame, every: int = DEFAULTS.radar_every) -> DataFrame:
    """Rows with a pitch position on every n-th frame, with their ``bucket``."""
    team = F.col("team_id")
    bucket = F.when(F.col("class_id") == BALL, "ball").when(F.col("class_id") == REFEREE, "ref").when(team == 0, "team0").when(team == 1, "team1").otherwise("unknown")
    return df.filter((F.col("frame") % every == 0) & F.col("x_m").isNotNull() & F.col("y_m").isNotNull()).withColumn("bucket", bucket)


def check_frames(f0: Column, f1: Column) -> Column:
    """First, middle and last frame of a segment, distinct and ascending."""
    return F.array_sort(F.array_distinct(F.array(f0, F.floor((f0 + f1) / 2), f1)))
