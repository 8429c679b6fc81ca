"""Joins: overlaps, nearest neighbours, intervals, as-of.

Every join has an equi key that includes ``match_id``; interval rules are exploded over frame buckets where the rule
side may be large, so a hot match still spreads and no nested loop appears.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import box, centre, distance, iou
from ..params import BALL, DEFAULTS, KEEPER, PLAYER, REFEREE, Params

KEY = ["match_id", "frame"]
#: Frames a bucket of interval rules.
BUCKET = 256


def pairwise_iou(a: DataFrame, b: DataFrame, a_id: str, b_id: str, plus: float | None = None, least: float = 0.0) -> DataFrame:
    """(match_id, frame, a_id, b_id, iou) of all pairs of one frame above ``least``."""
    left = a.select(*KEY, F.col(a_id).alias("a_id"), *[c.alias(f"a_{n}") for n, c in zip(("x1", "y1", "x2", "y2"), box())])
    right = b.select(*KEY, F.col(b_id).alias("b_id"), *[c.alias(f"b_{n}") for n, c in zip(("x1", "y1", "x2", "y2"), box())])
    pairs = left.join(right, KEY)
    return pairs.withColumn("iou", iou(box("a_"), box("b_"), plus)).filter(F.col("iou") > least).select(*KEY, "a_id", "b_id", "iou")


def nearest_player(tracks: DataFrame, id_col: str = "display_track_id") -> DataFrame:
    """(match_id, frame, player_id, dist) of the person (referees too) nearest to the ball's centre; ties go to the smaller id."""
    cx, cy = centre()
    ball = tracks.filter(F.col("class_id") == BALL).select(*KEY, cx.alias("bx"), cy.alias("by"))
    people = tracks.filter(F.col("class_id") != BALL).select(*KEY, F.col(id_col).alias("player_id"), cx.alias("px"), cy.alias("py"))
    d = distance(F.col("px"), F.col("py"), F.col("bx"), F.col("by"))
    best = people.join(ball, KEY).withColumn("dist", d).groupBy(*KEY).agg(F.min(F.struct("dist", "player_id")).alias("m"))
    return best.select(*KEY, F.col("m.player_id").alias("player_id"), F.col("m.dist").alias("dist"))


def duplicates_of_clean(junk: DataFrame, clean: DataFrame, how: str = "left_semi", p: Params = DEFAULTS) -> DataFrame:
    """Junk rows with (``left_semi``) or without (``left_anti``) a clean box of the same team within 90 pixels in their frame."""
    cx, cy = centre()
    other = clean.select(*[F.col(c).alias(f"_c_{c}") for c in (*KEY, "team_id")], cx.alias("_c_x"), cy.alias("_c_y"))
    same = (F.col("match_id") == F.col("_c_match_id")) & (F.col("frame") == F.col("_c_frame")) & (F.col("team_id") == F.col("_c_team_id"))
    return junk.join(other, same & (distance(cx, cy, F.col("_c_x"), F.col("_c_y")) < p.duplicate_px), how)


def _bucketed(rules: DataFrame, first: str, last: str, bucket: int = BUCKET) -> DataFrame:
    """Rules once for each frame bucket that they touch (``_bucket``)."""
    return rules.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(first) / bucket), F.floor(F.col(last) / bucket))))


def apply_segment_map(tracks: DataFrame, segments: DataFrame, id_col: str = "display_track_id") -> DataFrame:
    """People of a mapped segment take its canonical id (and team, if given); id 0 drops them, a null id changes nothing.

    ``segments``: match_id, tracker_id, frame_start, frame_end, canonical_id, team, and ``rule_no``: the last rule wins.
    """
    s = _bucketed(segments.filter("canonical_id IS NOT NULL"), "frame_start", "frame_end")
    s = s.groupBy(F.col("match_id").alias("_m"), F.col("tracker_id").alias("_t"), "_bucket").agg(F.collect_list(F.struct("rule_no", "canonical_id", "team", "frame_start", "frame_end")).alias("_rules"))
    people = tracks.filter(F.col("class_id") != BALL).withColumn("_b", F.floor(F.col("frame") / BUCKET))
    hits = people.join(s, (F.col("match_id") == F.col("_m")) & (F.col(id_col) == F.col("_t")) & (F.col("_b") == F.col("_bucket")), "left")
    one = hits.withColumn("_best", F.array_max(F.filter("_rules", lambda r: F.col("frame").between(r["frame_start"], r["frame_end"]))))
    canon = F.col("_best.canonical_id")
    kept = one.filter(F.coalesce(canon != 0, F.lit(True))).withColumns({id_col: F.coalesce(canon, F.col(id_col)), "team_id": F.when(canon.isNotNull(), F.coalesce(F.col("_best.team"), F.col("team_id"))).otherwise(F.col("team_id"))})
    return kept.select(*tracks.columns).unionByName(tracks.filter(F.col("class_id") == BALL))


def alias_candidates(tracks: DataFrame, rules: DataFrame, protected: DataFrame | None = None, min_frame: int = 0, id_col: str = "display_track_id", p: Params = DEFAULTS) -> DataFrame:
    """People from ``min_frame`` on with their ``action`` and ordered ``targets``.

    ``rules``: rule_no, id, cls ('' for any), target, fs, fe (null: open), and match_id (null or absent: every match).
    ``protected``: id, cls and perhaps match_id (canonical ids keep their rows). Actions: protected, none, single, split
    (several targets). A match's rules of an id come as one array, so rows are neither multiplied nor named.
    """
    letter = F.when(F.col("class_id") == KEEPER, "GK").when(F.col("class_id") == PLAYER, "P").when(F.col("class_id") == REFEREE, "REF")
    people = tracks.filter((F.col("class_id") != BALL) & (F.col("frame") >= min_frame)).withColumn("_letter", letter)
    people = _with_lists(people, protected, id_col, "cls", "_p") if protected is not None else people.withColumn("_p", F.array().cast("array<struct<cls:string>>"))
    people = _with_lists(people, rules, id_col, "rule_no cls target fs fe", "_r")
    mine = lambda x: (x["cls"] == "") | (x["cls"] == F.col("_letter"))
    fits = lambda x: mine(x) & (x["fs"].isNull() | (F.col("frame") >= x["fs"] - p.alias_tolerance)) & (x["fe"].isNull() | (F.col("frame") <= x["fe"] + p.alias_tolerance))
    out = people.withColumn("_keep", F.coalesce(F.exists("_p", mine), F.lit(False)))
    targets = F.array_distinct(F.transform(F.array_sort(F.filter("_r", fits)), lambda x: x["target"]))
    out = out.withColumn("targets", F.when(F.col("_keep"), F.slice(targets, 1, 0)).otherwise(targets))
    n = F.size("targets")
    return out.withColumn("action", F.when(F.col("_keep"), "protected").when(n == 0, "none").when(n == 1, "single").otherwise("split")).drop("_keep", "_letter", "_p", "_r")


def _with_lists(df: DataFrame, rules: DataFrame, id_col: str, fields: str, name: str) -> DataFrame:
    """``df`` with the array ``name`` of the rules for its id: those of its match, then those of every match."""
    if "match_id" not in rules.columns:
        rules = rules.withColumn("match_id", F.lit(None).cast("bigint"))
    lists = rules.groupBy("match_id", F.col("id").alias("_id")).agg(F.collect_list(F.struct(*fields.split())).alias("_l"))
    own = lists.filter("match_id IS NOT NULL").select(F.col("match_id").alias("_m"), "_id", F.col("_l").alias("_own"))
    every = lists.filter("match_id IS NULL").select("_id", F.col("_l").alias("_every"))
    out = df.join(own, (F.col("match_id") == F.col("_m")) & (F.col(id_col) == F.col("_id")), "left").drop("_m", "_id")
    out = out.join(every, F.col(id_col) == F.col("_id"), "left").drop("_id")
    nothing = F.slice(F.coalesce("_own", "_every"), 1, 0)
    none = F.array().cast(lists.schema["_l"].dataType)
    return out.withColumn(name, F.coalesce(F.concat(F.coalesce("_own", nothing), F.coalesce("_every", nothing)), none)).drop("_own", "_every")


#: What decides between several targets; rows that agree in it get the same one.
SPOT = ["match_id", "frame", "_x", "_y", "targets"]


def nearest_target(split: DataFrame, positions: DataFrame, id_col: str = "display_track_id", p: Params = DEFAULTS) -> DataFrame:
    """(match_id, frame, _x, _y, targets, target): of several targets the one whose box is nearest in pixels to the centre
    (_x, _y) within 12 frames, else within 50; a target without such boxes cannot win. Frames are bucketed by 50, so the
    join stays an equi-join."""
    cx, cy = centre()
    c = split.select("match_id", "frame", cx.alias("_x"), cy.alias("_y"), "targets").distinct().select(*SPOT, F.posexplode("targets").alias("_ord", "target"))
    c = c.withColumn("_b", F.explode(F.array(*[F.floor(F.col("frame") / p.far_frames) + k for k in (-1, 0, 1)])))
    pos = positions.filter(F.col("class_id") != BALL).select(F.col("match_id").alias("_m"), F.col(id_col).alias("_id"), F.col("frame").alias("_f"), cx.alias("_px"), cy.alias("_py"), F.floor(F.col("frame") / p.far_frames).alias("_pb"))
    hit = c.join(pos, (F.col("match_id") == F.col("_m")) & (F.col("target") == F.col("_id")) & (F.col("_b") == F.col("_pb")) & (F.abs(F.col("frame") - F.col("_f")) <= p.far_frames))
    near = F.abs(F.col("frame") - F.col("_f")) <= p.near_frames
    d = distance(F.col("_x"), F.col("_y"), F.col("_px"), F.col("_py"))
    each = hit.groupBy(*SPOT, "_ord", "target").agg(F.min(F.when(near, d)).alias("_near"), F.min(d).alias("_far"))
    return each.groupBy(*SPOT).agg(F.min(F.struct(F.coalesce("_near", "_far").alias("d"), F.col("_ord"), F.col("target"))).alias("m")).select(*SPOT, F.col("m.target").alias("target"))


def apply_alias_rules(tracks: DataFrame, rules: DataFrame, protected: DataFrame | None = None, min_frame: int = 0, id_col: str = "display_track_id", p: Params = DEFAULTS) -> DataFrame:
    """People with ``new_id`` and ``action``; a split without any near box takes its first target."""
    cx, cy = centre()
    c = alias_candidates(tracks, rules, protected, min_frame, id_col, p).withColumns({"_x": cx, "_y": cy})
    pick = nearest_target(c.filter("action = 'split'"), tracks, id_col, p).withColumnRenamed("target", "_near")
    first = F.when(F.size("targets") > 0, F.try_element_at("targets", F.lit(1)))
    return c.join(pick, SPOT, "left").withColumn("new_id", F.coalesce(F.when(F.col("action") == "split", F.col("_near")), first, F.col(id_col))).select(*tracks.columns, "action", "new_id")


def tag_passes(tracks: DataFrame, events: DataFrame, id_col: str = "display_track_id", flights: bool = True) -> DataFrame:
    """Adds pass_id, pass_role, pass_phase: the ball in flight between departure and arrival, the passer's and receiver's rows.

    Later passes overwrite earlier ones; within a pass receiver beats passer beats flight. A role survives a later flight,
    which sets id and phase only. ``flights`` false: the rows hold no ball, so flights are not looked for.
    """
    mark = lambda role, phase, rank: F.max(F.struct(F.col("pass_id").alias("id"), F.lit(rank).alias("rank"), F.lit(role).cast("string").alias("role"), F.lit(phase).alias("phase")))
    ball = F.col("class_id") == BALL
    # marks depend on the frame, or on frame and id, so they join back on these and rows need no name
    if flights:
        frames = tracks.filter(ball).select(*KEY).distinct()
        out = tracks.join(_inside(frames, events).groupBy(*KEY).agg(mark(None, "in_flight", 0).alias("_flight")), KEY, "left")
    end = lambda frame, who, name, *how: events.groupBy("match_id", F.col(frame).alias("frame"), F.col(who).alias(id_col)).agg(mark(*how).alias(name)).filter(F.col(id_col).isNotNull())
    out = (out if flights else tracks).join(end("departure_frame", "passer_id", "_passer", "passer", "departure", 1), [*KEY, id_col], "left").join(end("arrival_frame", "receiver_id", "_receiver", "receiver", "arrival", 2), [*KEY, id_col], "left")
    out = out.withColumn("_role", F.greatest("_passer", "_receiver")).withColumn("_last", F.greatest(*([F.when(ball, F.col("_flight"))] if flights else []), F.col("_passer"), F.col("_receiver")))
    return out.select(*tracks.columns, F.col("_last.id").alias("pass_id"), F.col("_role.role").alias("pass_role"), F.col("_last.phase").alias("pass_phase"))


def _inside(frames: DataFrame, events: DataFrame) -> DataFrame:
    """(match_id, frame) with each event whose flight holds the frame."""
    e = _bucketed(events.withColumnRenamed("match_id", "_m"), "departure_frame", "arrival_frame")
    on = (F.col("match_id") == F.col("_m")) & (F.col("_b") == F.col("_bucket")) & F.col("frame").between(F.col("departure_frame"), F.col("arrival_frame"))
    return frames.withColumn("_b", F.floor(F.col("frame") / BUCKET)).join(e, on)


def denormalise_passes(tagged: DataFrame, events: DataFrame, fps: float = DEFAULTS.fps) -> DataFrame:
    """Adds departure_time, arrival_time, duration_s, outcome, notes of each row's pass."""
    cols = {"departure_time": F.round(F.col("departure_frame") / fps, 3), "arrival_time": F.round(F.col("arrival_frame") / fps, 3), "duration_s": F.round((F.col("arrival_frame") - F.col("departure_frame")) / fps, 3)}
    e = events.select("match_id", "pass_id", *[v.alias(k) for k, v in cols.items()], "outcome", (F.col("notes") if "notes" in events.columns else F.lit("")).alias("notes"))
    return tagged.join(e, ["match_id", "pass_id"], "left")


def retag_synthesised(tracks: DataFrame, events: DataFrame, fill: bool = False, fps: float = DEFAULTS.fps) -> DataFrame:
    """Ball rows without a pass that lie inside one get its id and phase; times stay null unless ``fill``. The first such
    pass wins, since it leaves nothing for a later one."""
    bare = (F.col("class_id") == BALL) & F.col("pass_id").isNull()
    e = events.withColumnRenamed("pass_id", "_pass")
    first = _inside(tracks.filter(bare).select(*KEY).distinct(), e).groupBy(*KEY).agg(F.min(F.struct("_pass", F.col("departure_frame").alias("_dep"), F.col("arrival_frame").alias("_arr"), F.col("outcome").alias("_out"))).alias("_e"))
    out = tracks.withColumn("_bare", bare).join(first, KEY, "left").withColumn("_e", F.when(F.col("_bare"), F.col("_e"))).drop("_bare")
    out = out.withColumns({"pass_id": F.coalesce("pass_id", "_e._pass"), "pass_phase": F.when(F.col("_e").isNotNull(), "in_flight").otherwise(F.col("pass_phase"))})
    if fill:
        new = {"departure_time": F.round(F.col("_e._dep") / fps, 3), "arrival_time": F.round(F.col("_e._arr") / fps, 3), "duration_s": F.round((F.col("_e._arr") - F.col("_e._dep")) / fps, 3), "outcome": F.col("_e._out")}
        out = out.withColumns({k: F.coalesce(F.col(k), v) for k, v in new.items()})
    return out.select(*tracks.columns)


def upsert_ball(tracks: DataFrame, points: DataFrame, half: DataFrame, source: str = "manual", others: DataFrame | None = None) -> DataFrame:
    """Ball boxes at the points (match_id, frame, cx, cy): existing rows move and lose their pitch place, others are new.

    ``half``: match_id, half_w, half_h. New rows take homography_ok and kp_used from their frame, if the frame has rows
    (the largest, if its rows disagree). ``others``: rows of all frames, where ``tracks`` holds balls only.
    """
    cols = tracks.columns
    ball = F.col("class_id") == BALL
    p = points.join(half, "match_id", "left").select(*KEY, F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), F.coalesce("half_w", F.lit(8.0)).alias("_w"), F.coalesce("half_h", F.lit(8.0)).alias("_h"))
    context = [c for c in ("homography_ok", "kp_used") if c in cols]
    joined = tracks.filter(ball).withColumn("_old", F.lit(True)).join(p, KEY, "full_outer")
    if context:
        joined = joined.join((tracks if others is None else others).groupBy(*KEY).agg(*[F.max(c).alias(f"_{c}") for c in context]), KEY, "left")
    hit, new = F.col("_cx").isNotNull(), F.col("_old").isNull()
    put = {"x1": F.col("_cx") - F.col("_w"), "y1": F.col("_cy") - F.col("_h"), "x2": F.col("_cx") + F.col("_w"), "y2": F.col("_cy") + F.col("_h"), "x_m": F.lit(None), "y_m": F.lit(None), "ball_source": F.lit(source)}
    fresh = {"track_id": F.lit(-1), "display_track_id": F.lit(-1), "class_id": F.lit(BALL), "conf": F.lit(1.0), "team_id": F.lit(-1), "inlier_ratio": F.lit(0.0), "reproj_err": F.lit(0.0), "detector_ran": F.lit(1), "homography_state": F.lit("manual"), "ball_interpolated": F.lit(0), "homography_ok": F.coalesce(F.col("_homography_ok"), F.lit(False)) if "homography_ok" in cols else None, "kp_used": F.coalesce(F.col("_kp_used"), F.lit(0)) if "kp_used" in cols else None}
    out = []
    for c in cols:
        kind = tracks.schema[c].dataType
        value = F.when(hit, put[c].cast(kind)).otherwise(F.col(c)) if c in put else F.col(c)
        out.append((F.when(new, fresh[c].cast(kind)).otherwise(value) if c in fresh else value).alias(c))
    return joined.select(*out).unionByName(tracks.filter(~ball))


def homography_at(frames: DataFrame, homography: DataFrame) -> DataFrame:
    """Frames with their homography ``h`` (null outside)."""
    return frames.join(homography.select(*KEY, "h"), KEY, "left")


def covered_range(homography: DataFrame) -> DataFrame:
    return homography.filter("h IS NOT NULL").groupBy("match_id").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("n_frames"))


def restitch_candidates(junk: DataFrame, clean: DataFrame, id_col: str = "display_track_id", p: Params = DEFAULTS) -> DataFrame:
    """(junk row, clean id, gap, dist): clean ids of the same team last seen at most 45 frames before, within 220 pixels."""
    cx, cy = centre()
    # a junk row stands in one bucket, so its hits are already together and are not moved again to be grouped
    bucket = F.floor(F.col("frame") / p.restitch_frames)
    j = junk.select(*KEY, "team_id", F.col(id_col).alias("junk_id"), cx.alias("_x"), cy.alias("_y"), bucket.alias("_b"))
    c = clean.select("match_id", "team_id", F.col("frame").alias("_f"), F.col(id_col).alias("clean_id"), cx.alias("_cx"), cy.alias("_cy"), F.explode(F.array(bucket, bucket + 1)).alias("_b"))
    hit = j.join(c, ["match_id", "team_id", "_b"]).filter((F.col("_f") <= F.col("frame")) & (F.col("frame") - F.col("_f") <= p.restitch_frames))
    last = hit.groupBy(*KEY, "team_id", "_b", "junk_id", "_x", "_y", "clean_id").agg(F.max(F.struct("_f", "_cx", "_cy")).alias("m"))
    d = distance(F.col("_x"), F.col("_y"), F.col("m._cx"), F.col("m._cy"))
    return last.select(*KEY, "team_id", "junk_id", "clean_id", (F.col("frame") - F.col("m._f")).alias("gap"), d.alias("dist")).filter((F.col("gap") > 0) & (F.col("dist") < p.restitch_px))


def match_boxes(pred: DataFrame, gt: DataFrame, least: float = 0.5) -> DataFrame:
    """(match_id, frame, gt_id, pred_id, iou), one-to-one in each frame, most IoU in all.

    Pairs that are alone for both boxes are settled by windows; only frames with contested boxes run the assignment solver.
    """
    from .kernels import assign_frames

    pairs = pairwise_iou(gt, pred, "gt_id", "pred_id").filter(F.col("iou") >= least).withColumnRenamed("a_id", "gt_id").withColumnRenamed("b_id", "pred_id")
    g, q = Window.partitionBy(*KEY, "gt_id"), Window.partitionBy(*KEY, "pred_id")
    x = pairs.withColumn("_alone", (F.count("*").over(g) == 1) & (F.count("*").over(q) == 1)).withColumn("_clear", F.min("_alone").over(Window.partitionBy(*KEY)))
    return x.filter("_clear").drop("_alone", "_clear").unionByName(assign_frames(x.filter("NOT _clear").drop("_alone", "_clear")))


#: A pitch has some 32 vertices; a longer list is no pitch.
VERTICES = 256


def vertex_array(vertices: DataFrame) -> Column:
    """The pitch's vertices as a literal array of (label, x, y)."""
    rows = vertices.select("label", F.col("x_cm").cast("double"), F.col("y_cm").cast("double")).limit(VERTICES + 1).collect()
    if len(rows) > VERTICES:
        raise ValueError(f"more than {VERTICES} vertices")
    return F.array(*[F.struct(F.lit(r[0]).alias("label"), F.lit(r[1]).alias("x"), F.lit(r[2]).alias("y")) for r in sorted(rows)])


def snap_to_vertex(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """Points (x_cm, y_cm) with the nearest pitch vertex; the vertices stand in the expression, nothing is joined."""
    nearest = F.array_min(F.transform(vertex_array(vertices), lambda a: F.struct(distance(F.col("x_cm"), F.col("y_cm"), a["x"], a["y"]).alias("d"), a["label"].alias("label"))))
    return points.withColumn("_n", nearest).withColumns({"vertex": F.col("_n.label"), "vertex_dist": F.col("_n.d")}).drop("_n")


def anchor_points(anchors: DataFrame, vertices: DataFrame) -> DataFrame:
    """Anchors (match_id, frame, image_pts, vertex_ids 1-based) with pitch_pts in the same order; unknown vertices lose their
    point, anchors without any point are gone."""
    pitch = vertex_array(vertices)
    known = lambda label: F.filter(pitch, lambda v: v["label"] == label)
    pairs = F.transform(F.arrays_zip("image_pts", "vertex_ids"), lambda z: F.struct(z["image_pts"].alias("i"), F.transform(known(z["vertex_ids"]), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))[0].alias("p")))
    out = anchors.select("match_id", "frame", F.filter(pairs, lambda x: x["p"].isNotNull()).alias("_l")).filter(F.size("_l") > 0)
    return out.select("match_id", "frame", F.transform("_l", lambda x: x["i"]).alias("image_pts"), F.transform("_l", lambda x: x["p"]).alias("pitch_pts"))
