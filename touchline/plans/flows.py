"""The post-processing flows: operators in their order, still lazy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedupe, folds, joins, kernels, reports, rows, stable_ids, windows
from ..operators.dedupe import BEST
from ..params import BALL, DEFAULTS, Params
from ..sources.shared import kept


def relabel_segments(tracks: DataFrame, segments: DataFrame, order: list[str] = BEST, p: Params = DEFAULTS) -> DataFrame:
    """Tracks with the ids of a filled segment map: dedupe, relabel, resolve collisions, fill gaps."""
    one = dedupe.dedupe_tracks(tracks, order=order)
    clean, _ = dedupe.resolve_collisions(joins.apply_segment_map(one, segments), order=order)
    return windows.interpolate_gaps(clean, p)


def merge_passes(tracks: DataFrame, events: DataFrame, overrides: DataFrame, order: list[str] = BEST, p: Params = DEFAULTS) -> DataFrame:
    """Tracks with passes: one ball a frame, tags, times, source, manual and spline positions, tags of what was added."""
    ball = F.col("class_id") == BALL
    tag = lambda t, flights: joins.denormalise_passes(joins.tag_passes(t, events, flights=flights), events, p.fps).withColumn("ball_source", F.when(ball, F.when(F.col("ball_interpolated") == 1, "interp").otherwise("tracker")))
    # only ball rows are moved, added and tagged again: they are written once, as each of these steps reads them several times
    balls = kept(tag(dedupe.best_of(tracks.filter(ball), ["match_id", "frame"], order), True), "pass-balls")
    half = reports.ball_half_size(balls)
    manual = joins.upsert_ball(balls, overrides, half, "manual", tracks)
    filled = joins.upsert_ball(manual, kernels.spline_fill(balls, overrides, p), half, "spline", tracks)
    return joins.retag_synthesised(filled, events).unionByName(tag(tracks.filter(~ball), False))


def repair_ids(tracks: DataFrame, order: list[str] = BEST, p: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(repaired tracks with filled gaps, coverage of each id): impure ids are dropped, renamed or stitched."""
    one = dedupe.dedupe_tracks(tracks, order=order)
    fixed = folds.auto_repair(one, reports.class_purity(one, p=p), p, tie=[c.lstrip("-") for c in order if c != "-conf"])
    kept = fixed.filter("new_id IS NOT NULL").withColumn("display_track_id", F.col("new_id")).select(*one.columns)
    kept, _ = dedupe.resolve_collisions(kept.unionByName(tracks.filter(F.col("class_id") == BALL)), order=order)
    out = windows.interpolate_gaps(kept, p)
    return out, reports.coverage_per_id(out)


def apply_aliases(tracks: DataFrame, rules: DataFrame, protected: DataFrame | None, min_frame: int, order: list[str] = BEST, p: Params = DEFAULTS) -> DataFrame:
    """Tracks with ids mapped by alias rules from ``min_frame`` on, then one row of each (frame, id)."""
    late = joins.apply_alias_rules(tracks, rules, protected, min_frame, p=p).withColumn("display_track_id", F.col("new_id")).select(*tracks.columns)
    rest = tracks.filter((F.col("class_id") == BALL) | (F.col("frame") < min_frame))
    return dedupe.dedupe_from(late.unionByName(rest), min_frame, order=order)


def track_frames(detections: DataFrame, homography: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Detections to tracks: thresholds, stable ids, frame rules with the homography of the frame before, display ids,
    projection with the frame's own, keeper demotion last."""
    seen = rows.tiny_box_filter(rows.class_conf_filter(detections, p), p)
    ids = stable_ids.stabilise_ids(seen)
    before = homography.withColumn("frame", F.col("frame") + 1)
    gated = rows.project_to_pitch(ids, before).withColumnsRenamed({"x_m": "gate_x", "y_m": "gate_y"})
    # written once: the slots and the tracks both read it, and each would clean every frame anew
    clean = kept(folds.clean_frames(gated, p), "clean-frames")
    shown = folds.display_slots(clean, p).select("match_id", "frame", "class_id", "track_id", "display_track_id").distinct()
    tracks = clean.join(shown, ["match_id", "frame", "class_id", "track_id"])
    return rows.demote_keepers(rows.project_to_pitch(tracks, homography), p.keeper_zone, p)
