"""Defaults of all operators (fixed values of the tracking pipeline), as one frozen object."""

from __future__ import annotations

from dataclasses import dataclass

BALL, KEEPER, PLAYER, REFEREE = 0, 1, 2, 3


@dataclass(frozen=True)
class Params:
    # detections
    conf_ball: float = 0.10
    conf_keeper: float = 0.24
    conf_player: float = 0.24
    conf_referee: float = 0.22
    frame_width: int = 1920
    frame_height: int = 1080
    min_area_people: float = 8e-5
    min_area_ball: float = 1e-5
    ball_pad_px: float = 10.0
    # pitch, in centimetres
    pitch_length: float = 12000.0
    pitch_width: float = 7000.0
    margin_x: float = 8.0
    margin_y: float = 5.0
    keeper_zone: float = 1500.0
    units_per_metre: float = 100.0
    keypoint_conf: float = 0.5
    # frame rules
    max_players: int = 22
    max_keepers: int = 2
    max_referees: int = 2
    overlap_iou: float = 0.72
    official_bonus: float = 0.25
    official_edge: float = 0.02
    same_side_share: float = 0.45
    memory_bonus: float = 0.35
    streak_bonus: float = 0.07
    streak_most: int = 5
    # time
    fps: float = 30.0
    detect_every: int = 2
    max_stale: int = 2
    radar_every: int = 5
    # identity repair
    swap_body_mult: float = 2.5
    swap_min_px: float = 180.0
    swap_max_gap: int = 10
    fill_max_gap: int = 25
    spline_max_gap: int = 30
    purity: float = 0.85
    duplicate_px: float = 90.0
    restitch_px: float = 220.0
    restitch_frames: int = 45
    referee_id: int = 99
    alias_tolerance: int = 10
    near_frames: int = 12
    far_frames: int = 50
    # teams
    vote_history: int = 35
    min_votes: int = 8
    lock_share: float = 0.70
    # homography
    hold_frames: int = 15
    min_spread_px: float = 12.0
    max_condition: float = 1e8
    anchor_threshold_cm: float = 15.0


DEFAULTS = Params()
