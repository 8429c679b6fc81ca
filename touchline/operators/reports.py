"""KPIs, pass statistics and tracking-quality reports: partial aggregates, one or two shuffles each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import centre, distance
from ..params import BALL, DEFAULTS, KEEPER, PLAYER, REFEREE, Params
from .windows import TRACK

KEY = ["match_id", "frame"]


def share(part, whole):
    return F.when(whole > 0, part / whole)


def track_lengths(tracks: DataFrame, id_col: str = "display_track_id") -> DataFrame:
    """Rows of each id (people; -1 is one id), per match."""
    return tracks.filter(F.col("class_id") != BALL).groupBy("match_id", id_col).agg(F.count("*").alias("n_rows"))


def short_track_ratio(tracks: DataFrame, most: int = 5, id_col: str = "display_track_id") -> DataFrame:
    n = track_lengths(tracks, id_col)
    return n.groupBy("match_id").agg(F.count("*").alias("unique_tracks"), share(F.count_if(F.col("n_rows") <= most), F.count("*")).alias("short_track_ratio"))


def kpi_summary(tracks: DataFrame, frames: DataFrame, id_col: str = "display_track_id") -> DataFrame:
    """One row a match. ``frames`` is the frame log (one row a processed frame, also those without rows): homography_ok,
    optionally homography_available, roi_recovered, effective_fps."""
    has = lambda c, other: F.col(c) if c in frames.columns else other
    log = frames.groupBy("match_id").agg(
        F.count("*").alias("processed_frames"), F.avg(has("effective_fps", F.lit(None).cast("double"))).alias("effective_fps"),
        F.avg(F.col("homography_ok").cast("double")).alias("homography_ok_rate"), F.avg(has("homography_available", F.col("homography_ok")).cast("double")).alias("homography_available_rate"),
        F.avg(has("roi_recovered", F.lit(0)).cast("double")).alias("ball_roi_recovery_rate"))
    ball = F.col("class_id") == BALL
    rows = tracks.groupBy("match_id").agg(
        F.count_if(F.col("class_id") == PLAYER).alias("_players"), F.count_distinct(F.when(ball & (F.col("ball_interpolated") == 0), F.col("frame"))).alias("_real"),
        F.count_distinct(F.when(ball & (F.col("ball_interpolated") == 1), F.col("frame"))).alias("_interp"), share(F.count("x_m"), F.count("*")).alias("valid_projection_ratio"))
    ids = tracks.filter(~ball).groupBy("match_id", id_col).agg(F.max("team_id").alias("_team"))
    teams = ids.groupBy("match_id").agg(share(F.count_if(F.col("_team") < 0), F.count("*")).alias("team_unknown_ratio"))
    out = log.join(rows, "match_id", "left").join(short_track_ratio(tracks, id_col=id_col), "match_id", "left").join(teams, "match_id", "left")
    n = F.col("processed_frames")
    out = out.withColumns({"avg_players_per_frame": F.coalesce("_players", F.lit(0)) / n, "ball_detect_coverage": F.coalesce("_real", F.lit(0)) / n, "ball_interp_coverage": F.coalesce("_interp", F.lit(0)) / n})
    return out.drop("_players", "_real", "_interp")


def class_purity(tracks: DataFrame, id_col: str = "display_track_id", p: Params = DEFAULTS) -> DataFrame:
    """Share of the commonest class of each id, its mode class and team (lowest of ties), and whether it is clean."""
    people = tracks.filter(F.col("class_id") != BALL)
    # counts of a few (class, team) pairs an id, from one reading of the rows
    each = people.groupBy("match_id", id_col, "class_id", "team_id").agg(F.count("*").alias("n"))
    lists = each.groupBy("match_id", id_col).agg(F.sum("n").alias("n_rows"), F.collect_list(F.struct("class_id", "team_id", "n")).alias("_l"))

    def counts(of: str):
        total = lambda v: F.aggregate(F.filter("_l", lambda x: x[of] == v), F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
        known = F.array_distinct(F.filter(F.transform("_l", lambda x: x[of]), lambda v: v.isNotNull()))
        return F.array_min(F.transform(known, lambda v: F.struct((-total(v)).alias("n"), v.alias("v"))))  # the commonest, the lowest of ties

    out = lists.withColumns({"_class": counts("class_id"), "_team": counts("team_id")})
    out = out.select("match_id", id_col, (-F.col("_class.n") / F.col("n_rows")).alias("purity"), "n_rows", F.col("_class.v").alias("mode_class"), F.col("_team.v").alias("mode_team"))
    return out.withColumn("is_clean", F.col("purity") >= p.purity)


def segment_summary(segmented: DataFrame, id_col: str = "display_track_id", bounds: str = "observed", fps: float = DEFAULTS.fps) -> DataFrame:
    """One row a segment. ``nominal`` bounds end a segment one frame before the next begins."""
    cx, cy = centre()
    keys = ["match_id", id_col, "seg_idx"]
    out = segmented.groupBy(*keys).agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.count("*").alias("n_frames"), F.mode("class_id", True).alias("mode_cls"), F.mode("team_id", True).alias("mode_team"), F.avg(cx).alias("cx"), F.avg(cy).alias("cy"))
    if bounds == "nominal":
        out = out.withColumn("f1", F.coalesce(F.lead("f0").over(Window.partitionBy("match_id", id_col).orderBy("seg_idx")) - 1, F.col("f1")))
    return out.withColumn("seg_key", F.concat_ws("_", F.col(id_col), F.col("seg_idx"))).withColumn("dur_s", (F.col("f1") - F.col("f0") + 1) / fps)


def coverage_per_id(tracks: DataFrame, keys: tuple[str, ...] = ("display_track_id",)) -> DataFrame:
    return tracks.filter(F.col("class_id") != BALL).groupBy("match_id", *keys).agg(F.count_distinct("frame").alias("n_frames"), F.count("*").alias("n_rows"))


def table_profile(tracks: DataFrame, id_col: str = "display_track_id") -> DataFrame:
    return tracks.groupBy("match_id").agg(F.count("*").alias("n_rows"), F.count_distinct("frame").alias("n_frames"), F.count_distinct(id_col).alias("n_ids"))


def pass_stats(events: DataFrame, fps: float = DEFAULTS.fps) -> DataFrame:
    done = F.count_if(F.col("outcome") == "complete")
    return events.groupBy("match_id").agg(F.count("*").alias("total"), done.alias("complete"), F.count_if(F.col("outcome") == "incomplete").alias("incomplete"), share(done, F.count("*")).alias("completion_rate"), F.avg((F.col("arrival_frame") - F.col("departure_frame")) / fps).alias("mean_duration_s"))


def pass_counts(events: DataFrame, by: str) -> DataFrame:
    """Passes by passer (``passer_id``) or by departure source (``dep_src``)."""
    return events.groupBy("match_id", by).agg(F.count("*").alias("n"))


def ball_coverage(tracks: DataFrame, frames: DataFrame) -> DataFrame:
    ball = tracks.filter(F.col("class_id") == BALL).groupBy("match_id").agg(F.count_distinct("frame").alias("ball_frames"))
    all_ = frames.groupBy("match_id").agg(F.count("*").alias("n_frames"))
    return all_.join(ball, "match_id", "left").select("match_id", "n_frames", F.coalesce("ball_frames", F.lit(0)).alias("ball_frames"), (F.coalesce("ball_frames", F.lit(0)) / F.col("n_frames")).alias("coverage"))


def ball_half_size(tracks: DataFrame) -> DataFrame:
    """Median half width and height of ball boxes; 8 where a match has none."""
    ball = F.col("class_id") == BALL
    half = lambda a, b: F.coalesce(F.median(F.when(ball, (F.col(b) - F.col(a)) / 2)), F.lit(8.0))
    return tracks.groupBy("match_id").agg(half("x1", "x2").alias("half_w"), half("y1", "y2").alias("half_h"))


def state_counts(frames: DataFrame, state: str = "homography_state") -> DataFrame:
    return frames.select(*KEY, state).distinct().groupBy("match_id", state).agg(F.count("*").alias("n"))


def detection_report(tracks: DataFrame, frames: DataFrame) -> DataFrame:
    """Detections a frame of each class over all frames, also those without any: mean, median, p10, p90, frames without one.

    Frames with none of a class are counted, not listed: percentiles come from the histogram of counts, whose size is the
    number of different counts, so nothing of the size of frames x classes is built.
    """
    total = frames.groupBy("match_id").agg(F.count("*").alias("n_frames"))
    per = tracks.groupBy(*KEY, "class_id").agg(F.count("*").alias("c")).groupBy("match_id", "class_id", "c").agg(F.count("*").alias("w"))
    some = per.groupBy("match_id", "class_id").agg(F.sum("w").alias("seen"))
    zero = some.join(total, "match_id").select("match_id", "class_id", F.lit(0).cast("bigint").alias("c"), (F.col("n_frames") - F.col("seen")).alias("w"))
    hist = per.unionByName(zero).filter("w > 0")
    q = lambda x: F.expr(f"percentile(c, {x}, w)")
    return hist.groupBy("match_id", "class_id").agg((F.sum(F.col("c") * F.col("w")) / F.sum("w")).alias("mean"), q(0.5).alias("median"), q(0.1).alias("p10"), q(0.9).alias("p90"), F.sum(F.when(F.col("c") == 0, F.col("w")).otherwise(0)).alias("empty_frames"))


def ball_report(tracks: DataFrame, margin: float = 0.0, p: Params = DEFAULTS) -> DataFrame:
    per = tracks.filter(F.col("class_id") == BALL).groupBy(*KEY).agg(F.count("*").alias("c"), F.max("ball_interpolated").alias("i"), F.min("ball_interpolated").alias("r"), F.count("x_m").alias("placed"),
        F.count_if(~(F.col("x_m").between(-margin, p.pitch_length + margin) & F.col("y_m").between(-margin, p.pitch_width + margin))).alias("off"))
    return per.groupBy("match_id").agg(F.count("*").alias("frames_with_ball"), F.count_if(F.col("c") > 1).alias("frames_with_several"), F.count_if(F.col("r") == 0).alias("frames_real"), F.count_if(F.col("r") == 1).alias("frames_interpolated_only"), share(F.sum("off"), F.sum("placed")).alias("off_pitch_share"))


def homography_report(frames: DataFrame, tracks: DataFrame) -> DataFrame:
    f = frames.groupBy("match_id").agg(F.avg(F.col("homography_ok").cast("double")).alias("ok_rate"), F.avg((F.col("homography_state") == "ok").cast("double")).alias("state_ok_share"), F.median("kp_used").alias("median_kp_used"), F.count_if(F.col("kp_used") < 4).alias("frames_few_kp"))
    r = tracks.filter(F.col("class_id") != BALL).groupBy("match_id").agg(share(F.count("x_m"), F.count("*")).alias("people_with_xy"))
    return f.join(r, "match_id", "left")


def identity_report(tracks: DataFrame, frames: DataFrame, id_col: str = "display_track_id", gap: int = 1, long_s: float = 60.0, fps: float = DEFAULTS.fps) -> DataFrame:
    """Per match and class: ids, expected ids (20 players, 2 keepers, 1 referee), new ids a minute, segments (runs without
    a hole longer than ``gap`` frames) and their seconds, and the share of rows in ids that last 60 s."""
    people = tracks.filter(F.col("class_id") != BALL)
    keys = ["match_id", "class_id", id_col]
    w = Window.partitionBy(*keys).orderBy("frame")
    cut = F.when(F.lag("frame").over(w).isNull() | (F.col("frame") - F.lag("frame").over(w) > gap), 1).otherwise(0)
    runs = people.select(*keys, "frame").distinct().withColumn("_cut", cut).withColumn("_run", F.sum("_cut").over(w)).groupBy(*keys, "_run").agg(((F.max("frame") - F.min("frame") + 1) / fps).alias("s"))
    seg = runs.groupBy("match_id", "class_id").agg(F.count("*").alias("segments"), F.avg("s").alias("mean_segment_s"), F.median("s").alias("median_segment_s"), F.expr("percentile(s, 0.9)").alias("p90_segment_s"))
    ids = people.groupBy(*keys).agg(F.count("*").alias("n"), ((F.max("frame") - F.min("frame") + 1) / fps).alias("life"))
    unique = ids.groupBy("match_id", "class_id").agg(F.count("*").alias("unique_ids"), share(F.sum(F.when(F.col("life") >= long_s, F.col("n")).otherwise(0)), F.sum("n")).alias("rows_in_long_ids"))
    minutes = frames.groupBy("match_id").agg((F.count("*") / fps / 60).alias("minutes"))
    expected = F.when(F.col("class_id") == PLAYER, 20).when(F.col("class_id") == KEEPER, 2).when(F.col("class_id") == REFEREE, 1)
    out = unique.join(seg, ["match_id", "class_id"]).join(minutes, "match_id").withColumn("expected_ids", expected)
    return out.withColumns({"ids_ratio": F.col("unique_ids") / F.col("expected_ids"), "new_ids_per_minute": F.col("unique_ids") / F.col("minutes")}).drop("minutes")


def impossible_jumps(tracks: DataFrame, id_col: str = "display_track_id", speed: float = 12.0, body: float = 1.0, p: Params = DEFAULTS) -> DataFrame:
    """Steps between adjacent frames beyond one body height in the image, or 12 m/s on the pitch, a player-minute."""
    w = Window.partitionBy("match_id", id_col).orderBy("frame")
    cx, cy = centre()
    x = tracks.filter(F.col("class_id") == PLAYER).withColumns({"_x": cx, "_y": cy, "_h": F.col("y2") - F.col("y1")})
    x = x.withColumns({f"_l{c}": F.lag(c).over(w) for c in ("frame", "_x", "_y", "x_m", "y_m")})
    near = F.col("frame") - F.col("_lframe") == 1
    image = near & (distance(F.col("_x"), F.col("_y"), F.col("_l_x"), F.col("_l_y")) > body * F.col("_h"))
    pitch = near & (distance(F.col("x_m"), F.col("y_m"), F.col("_lx_m"), F.col("_ly_m")) / p.units_per_metre * p.fps > speed)
    out = x.groupBy("match_id").agg(F.count_if(image).alias("image_jumps"), F.count_if(pitch).alias("pitch_jumps"), (F.count("*") / p.fps / 60).alias("player_minutes"))
    return out.withColumns({"image_jumps_per_minute": F.col("image_jumps") / F.col("player_minutes"), "pitch_jumps_per_minute": F.col("pitch_jumps") / F.col("player_minutes")})


def duplicate_id_rows(tracks: DataFrame, id_col: str = "display_track_id") -> DataFrame:
    return tracks.groupBy(*KEY, "class_id", id_col).agg(F.count("*").alias("c")).groupBy("match_id").agg(F.sum(F.col("c") - 1).alias("duplicate_rows"))


def team_report(tracks: DataFrame, id_col: str = "display_track_id", order: tuple[str, ...] = ("frame",)) -> DataFrame:
    players = tracks.filter(F.col("class_id") == PLAYER)
    w = Window.partitionBy("match_id", id_col).orderBy(*order)
    known = players.filter(F.col("team_id") >= 0).withColumn("_flip", (F.lag("team_id").over(w) != F.col("team_id")).cast("int"))
    ids = known.groupBy("match_id", id_col).agg(F.coalesce(F.sum("_flip"), F.lit(0)).alias("flips"))
    a = ids.groupBy("match_id").agg(F.count("*").alias("ids_with_label"), F.count_if(F.col("flips") > 0).alias("ids_with_flip"), F.sum("flips").alias("total_flips"))
    b = players.groupBy("match_id").agg(F.avg((F.col("team_id") < 0).cast("double")).alias("unknown_share"))
    return b.join(a, "match_id", "left")


def keypoint_diagnostics(frames: DataFrame, keypoints: DataFrame, after: int = 6, first: int = 8, least: float = DEFAULTS.keypoint_conf) -> DataFrame:
    """Keypoint confidence on the six frames from each of a match's first eight state changes on."""
    from .windows import state_transitions

    w = Window.partitionBy("match_id").orderBy("frame")
    changes = state_transitions(frames).withColumn("change_no", F.row_number().over(w)).filter(F.col("change_no") <= first).select("match_id", "change_no", F.explode(F.sequence(F.col("frame"), F.col("frame") + after - 1)).alias("frame"))
    return keypoints.join(changes, KEY).groupBy("match_id", "change_no", "frame").agg(F.count("*").alias("n"), F.min("conf").alias("min_conf"), F.max("conf").alias("max_conf"), F.avg("conf").alias("mean_conf"), F.count_if(F.col("conf") > least).alias("n_good"))


def action_counts(actions: DataFrame, *by: str) -> DataFrame:
    """Counts of actions of a repair or alias job, by action and any further columns."""
    return actions.groupBy(*by).agg(F.count("*").alias("n"))


def segment_map_summary(segments: DataFrame) -> DataFrame:
    return segments.groupBy("match_id").agg(F.count_distinct(F.when(F.col("canonical_id") > 0, F.col("canonical_id"))).alias("canonical_ids"), F.count_if(F.col("canonical_id") == 0).alias("dropped_segments"), F.count_if(F.col("canonical_id").isNull()).alias("unlabelled_segments"))
