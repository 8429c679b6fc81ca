"""Window operators over tracks, votes and frame spines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import centre, distance
from ..params import BALL, DEFAULTS, Params

TRACK = ["match_id", "display_track_id"]


def detect_swaps(df: DataFrame, p: Params = DEFAULTS, keys: list[str] = TRACK, split_class: bool = True) -> DataFrame:
    """Adds ``is_split``: 1 where a track jumps farther than a body allows, or changes class, within the gap limit."""
    w = Window.partitionBy(*keys).orderBy("frame")
    cx, cy = centre()
    h = F.col("y2") - F.col("y1")
    x = df.withColumns({"_cx": cx, "_cy": cy, "_h": h})
    x = x.withColumns({f"_p{c}": F.lag(c).over(w) for c in ("frame", "_cx", "_cy", "_h", "class_id")})
    jump = distance(F.col("_cx"), F.col("_cy"), F.col("_p_cx"), F.col("_p_cy"))
    limit = F.greatest(F.lit(p.swap_min_px), F.lit(p.swap_body_mult) * F.greatest(F.lit(1.0), (F.col("_h") + F.col("_p_h")) / 2))
    changed = F.col("class_id") != F.col("_pclass_id") if split_class else F.lit(False)
    flag = F.when(F.col("_pframe").isNull() | (F.col("frame") - F.col("_pframe") > p.swap_max_gap), 0).when(jump > limit, 1).when(changed, 1).otherwise(0)
    return x.withColumn("is_split", flag).drop("_cx", "_cy", "_h", *[f"_p{c}" for c in ("frame", "_cx", "_cy", "_h", "class_id")])


def segment_ids(df: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """Adds ``seg_idx``: how many splits a track has had so far."""
    return df.withColumn("seg_idx", F.sum("is_split").over(Window.partitionBy(*keys).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)))


def interpolate_gaps(df: DataFrame, p: Params = DEFAULTS, keys: list[str] = TRACK) -> DataFrame:
    """People rows plus linear rows in gaps of up to ``fill_max_gap`` frames; ``track_filled`` marks them.

    Other columns are those of the row before; a coordinate stays at its earlier value where either end is null.
    """
    moving = [c for c in ("x1", "y1", "x2", "y2", "x_m", "y_m", "cx", "cy") if c in df.columns]
    side = F.coalesce(F.col("class_id") == BALL, F.lit(True))  # such rows have no gaps
    w = Window.partitionBy(*keys, side).orderBy("frame")
    ahead = df.withColumns({f"_n{c}": F.lead(c).over(w) for c in ("frame", *moving)})
    gap = F.col("_nframe") - F.col("frame")
    hole = ~side & (gap > 1) & (gap <= p.fill_max_gap)
    # a row and those that fill the gap behind it, so the table is read once
    each = ahead.select("*", F.posexplode(F.when(hole, F.sequence(F.col("frame"), F.col("_nframe") - 1)).otherwise(F.array("frame"))).alias("_k", "_f"))
    own = F.col("_k") == 0
    t = (F.col("_f") - F.col("frame")) / gap
    value = {c: F.coalesce(F.col(c) + (F.col(f"_n{c}") - F.col(c)) * t, F.col(c)) for c in moving}
    value |= {"frame": F.col("_f"), "conf": F.lit(0.0), "detector_ran": F.lit(0)}
    return each.select(*[F.when(own, F.col(c)).otherwise(value[c].cast(df.schema[c].dataType)).alias(c) if c in value else F.col(c) for c in df.columns], F.when(own, 0).otherwise(1).alias("track_filled"))


def team_votes(df: DataFrame, id_col: str = "track_id", p: Params = DEFAULTS) -> DataFrame:
    """Adds ``vote_team``: the majority of the last 35 known votes, -1 below eight; a tie goes to the earliest vote of the window."""
    known = df.filter(F.col("team_id") >= 0)
    order = Window.partitionBy("match_id", id_col).orderBy("frame")
    w = order.rowsBetween(1 - p.vote_history, 0)
    zero = F.count(F.when(F.col("team_id") == 0, 1)).over(w)
    one = F.count(F.when(F.col("team_id") == 1, 1)).over(w)
    team = F.when(zero + one < p.min_votes, -1).when(zero > one, 0).when(one > zero, 1).otherwise(F.first("team_id").over(w))
    return known.withColumn("vote_team", team)


def team_memory(df: DataFrame, id_col: str = "track_id", p: Params = DEFAULTS) -> DataFrame:
    """``team_votes`` with a lock: from the first vote at which the window's majority holds 70 % of at least eight votes
    on, the team stays. Adds ``vote_team``, ``locked``, ``memory_team``."""
    voted = team_votes(df, id_col, p)
    order = Window.partitionBy("match_id", id_col).orderBy("frame")
    w = order.rowsBetween(1 - p.vote_history, 0)
    n = F.count("*").over(w)
    top = F.greatest(F.count(F.when(F.col("team_id") == 0, 1)).over(w), F.count(F.when(F.col("team_id") == 1, 1)).over(w))
    lock = F.when((n >= p.min_votes) & (top >= p.lock_share * n), F.col("vote_team"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    x = voted.withColumn("_lock", lock).withColumn("_first", F.first("_lock", ignorenulls=True).over(upto))
    return x.withColumns({"locked": F.col("_first").isNotNull(), "memory_team": F.coalesce("_first", "vote_team")}).drop("_lock", "_first")


def state_transitions(frames: DataFrame, state: str = "homography_state", keys: tuple[str, ...] = ("match_id",)) -> DataFrame:
    """The frames whose state differs from the one before, with ``prev_state``."""
    w = Window.partitionBy(*keys).orderBy("frame")
    return frames.withColumn("prev_state", F.lag(state).over(w)).filter(F.col("prev_state").isNotNull() & (F.col(state) != F.col("prev_state")))


def seen_span(df: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """First and last frame of each id."""
    return df.groupBy(*keys).agg(F.min("frame").alias("first_seen"), F.max("frame").alias("last_seen"))


def carry_forward(tracks: DataFrame, frames: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Frames on which the detector did not run repeat the last detected frame's tracks, at most ``max_stale`` frames old."""
    w = Window.partitionBy("match_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    spine = frames.withColumn("src_frame", F.last(F.when(F.col("detector_ran") == 1, F.col("frame")), ignorenulls=True).over(w))
    spine = spine.filter(F.col("src_frame").isNotNull() & (F.col("frame") - F.col("src_frame") <= p.max_stale)).select("match_id", "frame", "src_frame", F.when(F.col("frame") == F.col("src_frame"), 1).otherwise(0).alias("detector_ran"))
    rows = tracks.drop("detector_ran").withColumnRenamed("frame", "src_frame")
    return rows.join(spine, ["match_id", "src_frame"])


def sample_and_hold(frames: DataFrame, values: list[str], every: int, keys: tuple[str, ...] = ("match_id",)) -> DataFrame:
    """Values of every n-th frame, held in between (nulls hold the value before)."""
    w = Window.partitionBy(*keys).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumns({f"held_{c}": F.last(F.when(F.col("frame") % every == 0, F.col(c)), ignorenulls=True).over(w) for c in values})


def hold_last_good(frames: DataFrame, h: str = "h", degenerate: str = "degenerate", p: Params = DEFAULTS) -> DataFrame:
    """A degenerate frame takes the last good homography, for at most 15 degenerate frames in a row. Frames with too few
    points (null h, not degenerate) neither use nor spend that budget. Adds held_h, ok."""
    order = Window.partitionBy("match_id").orderBy("frame")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    good = F.col(h).isNotNull() & ~F.col(degenerate)
    x = frames.withColumn("_run", F.sum(good.cast("int")).over(upto)).withColumn("_last", F.last(F.when(good, F.col(h)), ignorenulls=True).over(upto))
    spent = F.sum(F.col(degenerate).cast("int")).over(Window.partitionBy("match_id", "_run").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_spent", spent)
    held = F.when(good, F.col(h)).when(F.col(degenerate) & (F.col("_spent") <= p.hold_frames), F.col("_last"))
    return x.withColumn("held_h", held).withColumn("ok", F.col("held_h").isNotNull()).drop("_run", "_last", "_spent")


#: Units of the first order column (frames) that a task takes of a track at a time.
EMA_PIECE = 10_000


def ema(df: DataFrame, value: str, alpha: float, keys: list[str] = TRACK, order: tuple[str, ...] = ("frame",), piece: int = EMA_PIECE) -> DataFrame:
    """Adds ``ema``: new = alpha x value + (1 - alpha) x old, from a track's first row on; after a null it starts anew.

    A recursion over all rows before, so no window frame expresses it. A row's effect is old -> a x old + b, and so is that
    of any run of rows; after a null the run forgets what was before. Tracks are cut into pieces of ``piece`` units of the
    first order column (a number). Each piece gives its effect, a pass over these few numbers gives each piece the average
    before it, and pieces are then run through apart, so no task holds a whole track. Equal places in the order are ranked
    by value, nulls first. The table may have no column ``ema`` and none that begins with ``_ema_``.
    """
    from pyspark.sql.types import DoubleType, StructType

    if taken := [c for c in df.columns if c == "ema" or c.startswith("_ema_")]:
        raise ValueError(f"columns are taken: {', '.join(taken)}")
    rows = df.withColumns({"_ema_value": F.col(value).cast("double"), "_ema_piece": F.floor(F.col(order[0]) / piece)})
    place = [*keys, "_ema_piece"]
    names = [f"k{i}" for i in range(len(keys))]
    kinds = ", ".join(f"{n} {df.schema[k].dataType.simpleString()}" for n, k in zip(names, keys))

    def numbers(column: pa.Array) -> list[float | None]:
        return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()

    def effects(key: tuple, pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, c): with an average before, what comes out is a x average + b; without one it is c."""
        a, b, c = 1.0, 0.0, None
        for batch in pieces:
            for v in numbers(batch["_ema_value"]):
                if v is None:
                    a, b, c = None, None, None  # whatever was before is forgotten
                else:
                    c = v if c is None else alpha * v + (1 - alpha) * c
                    if a is not None:
                        a, b = (1 - alpha) * a, alpha * v + (1 - alpha) * b
        yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], k.type) for k in key[:-1]), pa.array([key[-1].as_py()], pa.int64()), *(pa.array([x], pa.float64()) for x in (a, b, c))], [*names, "piece", "a", "b", "c"])

    def chain(key: tuple, summary: pa.Table) -> pa.Table:
        summary = summary.sort_by("piece")
        old, before = None, []
        for a, b, c in zip(*(summary[n].to_pylist() for n in "abc")):
            before.append(old)
            old = c if old is None or a is None else a * old + b
        return summary.select([*names, "piece"]).append_column("_ema_before", pa.array(before, pa.float64()))

    columns, schema = df.columns, StructType([*df.schema.fields]).add("ema", DoubleType())

    def run(key: tuple, pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, begun = None, False
        for batch in pieces:
            out = []
            if not begun and batch.num_rows:
                old, begun = batch["_ema_before"][0].as_py(), True
            for v in numbers(batch["_ema_value"]):
                old = v if old is None or v is None else alpha * v + (1 - alpha) * old
                out.append(old)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(out, pa.float64())], [*columns, "ema"])

    by = [*place, *order, "_ema_value"]
    sorted_ = lambda x: x.repartition(*place).sortWithinPartitions(*by)
    effect = sorted_(rows.select(*dict.fromkeys(by))).groupBy(*place).applyInArrow(effects, f"{kinds}, piece bigint, a double, b double, c double")
    entering = effect.groupBy(*names).applyInArrow(chain, f"{kinds}, piece bigint, _ema_before double")
    on = F.lit(True)
    for k, n in zip([*keys, "_ema_piece"], [*names, "piece"]):
        on = on & F.col(f"x.{k}").eqNullSafe(F.col(f"e.{n}"))
    joined = rows.alias("x").join(entering.alias("e"), on, "left").select("x.*", "_ema_before")
    return sorted_(joined).groupBy(*place).applyInArrow(run, schema)
