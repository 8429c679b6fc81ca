"""De-duplication, quotas and top lists.

Best-of-group is always ``row_number() = 1`` (or at most n) under a total order, which Spark prunes before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import centre
from ..params import BALL, DEFAULTS, KEEPER, PLAYER, REFEREE, Params

#: Total order of rows that compete for one place: most confident first, then by place and ids.
BEST = ["-conf", "x1", "y1", "x2", "y2", "class_id", "track_id"]


def ordered_by(columns: list[str], df: DataFrame) -> list[Column]:
    return [F.col(c[1:]).desc() if c[0] == "-" else F.col(c).asc() for c in columns if c.lstrip("-") in df.columns]


def best_of(df: DataFrame, keys: list[str], order: list[str] = BEST, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*ordered_by(order, df)))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def dedupe_tracks(df: DataFrame, id_col: str = "display_track_id", scope: str = "people", order: list[str] = BEST) -> DataFrame:
    """The most confident row of each (match, frame, id). ``scope`` ``people`` leaves the ball alone; ``all`` does not."""
    keys = ["match_id", "frame", id_col]
    if scope == "all":
        return best_of(df, keys, order)
    # one reading of ``df``: the ball's rows stand beside those of people and are not ranked out
    side = F.col("class_id") == BALL
    rank = F.row_number().over(Window.partitionBy(*keys, side).orderBy(*ordered_by(order, df)))
    return df.filter("class_id IS NOT NULL").withColumn("_rank", rank).filter(side | (F.col("_rank") <= 1)).drop("_rank")


def resolve_collisions(df: DataFrame, id_col: str = "display_track_id", order: list[str] = BEST) -> tuple[DataFrame, DataFrame]:
    """People without collisions plus everything else, and the list of (match, frame, id, k) that collided."""
    people = df.filter(F.col("class_id") != BALL)
    hit = people.groupBy("match_id", "frame", id_col).agg(F.count("*").alias("k")).filter("k > 1")
    return dedupe_tracks(df, id_col, "people", order), hit


def dedupe_from(df: DataFrame, min_frame: int, id_col: str = "display_track_id", order: list[str] = BEST) -> DataFrame:
    """``resolve_collisions`` for frames from ``min_frame`` on; earlier frames stay as they are."""
    late = F.col("frame") >= min_frame
    return dedupe_tracks(df.filter(late), id_col, "people", order).unionByName(df.filter(~late))


def dedupe_ball(df: DataFrame, order: list[str] = BEST) -> DataFrame:
    """One ball row a frame."""
    ball = F.col("class_id") == BALL
    return best_of(df.filter(ball), ["match_id", "frame"], order).unionByName(df.filter(~ball))


def unique_stable_per_frame(df: DataFrame, id_col: str = "track_id", order: list[str] = BEST) -> DataFrame:
    """One row of each (frame, class, stable id); negative ids are exempt."""
    named = F.col(id_col) >= 0
    return best_of(df.filter(named), ["match_id", "frame", "class_id", id_col], order).unionByName(df.filter(~named))


def official_quota(df: DataFrame, score: str = "score", tie: list[str] = BEST[1:], p: Params = DEFAULTS) -> DataFrame:
    """At most two referees and two keepers a frame, by score."""
    out = df.filter(~F.col("class_id").isin(KEEPER, REFEREE))
    for cls, most in ((KEEPER, p.max_keepers), (REFEREE, p.max_referees)):
        out = out.unionByName(best_of(df.filter(F.col("class_id") == cls), ["match_id", "frame"], [f"-{score}", *tie], most))
    return out


def same_side_keeper(df: DataFrame, score: str = "score", tie: list[str] = BEST[1:], p: Params = DEFAULTS) -> DataFrame:
    """Keepers whose centres lie within 45 % of the frame's width are one keeper: the best stays."""
    keeper = F.col("class_id") == KEEPER
    frame = Window.partitionBy("match_id", "frame")
    cx, _ = centre()
    rank = F.row_number().over(frame.orderBy(*ordered_by([f"-{score}", *tie], df)))
    k = df.filter(keeper).withColumns({"_spread": F.max(cx).over(frame) - F.min(cx).over(frame), "_rank": rank})
    k = k.filter((F.col("_spread") >= p.same_side_share * p.frame_width) | (F.col("_rank") == 1)).drop("_spread", "_rank")
    return df.filter(~keeper).unionByName(k)


def player_cap(df: DataFrame, score: str = "score", tie: list[str] = BEST[1:], p: Params = DEFAULTS) -> DataFrame:
    """At most 22 players a frame, by score."""
    player = F.col("class_id") == PLAYER
    return df.filter(~player).unionByName(best_of(df.filter(player), ["match_id", "frame"], [f"-{score}", *tie], p.max_players))


def top_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows under a total order (``-`` for descending): a report, so a limit."""
    return df.orderBy(*ordered_by(list(order), df)).limit(n)
