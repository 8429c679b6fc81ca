"""Scores against labelled boxes: matching, identity, switches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import box, iou
from .joins import match_boxes
from .kernels import assign

KEY = ["match_id", "frame"]


def id_switches(matches: DataFrame) -> DataFrame:
    """(match_id, frame, gt_id, from_pred_id, to_pred_id): changes of a labelled player's matched id over its matched frames."""
    w = Window.partitionBy("match_id", "gt_id").orderBy("frame")
    return matches.withColumn("from_pred_id", F.lag("pred_id").over(w)).filter("from_pred_id <> pred_id").select(*KEY, "gt_id", "from_pred_id", F.col("pred_id").alias("to_pred_id"))


def switch_rate(switches: int, players: int, frames: int, fps: float) -> float:
    """Switches a player-minute."""
    return switches / (players * frames / fps / 60)


def mot_score(pred: DataFrame, gt: DataFrame, least: float = 0.5) -> DataFrame:
    """gt, pred, tp, fp, fn, switches, recall, precision, mota of each match."""
    m = match_boxes(pred, gt, least)
    w = Window.partitionBy("match_id", "gt_id").orderBy("frame")
    hits = m.withColumn("_p", F.lag("pred_id").over(w)).groupBy("match_id").agg(F.count("*").alias("tp"), F.count_if(F.col("_p") != F.col("pred_id")).alias("switches"))
    out = gt.groupBy("match_id").agg(F.count("*").alias("gt")).join(pred.groupBy("match_id").agg(F.count("*").alias("pred")), "match_id", "full_outer").join(hits, "match_id", "left").fillna(0, ["gt", "pred", "tp", "switches"])
    out = out.withColumns({"fp": F.col("pred") - F.col("tp"), "fn": F.col("gt") - F.col("tp")})
    some = lambda a, b: F.when(F.col(b) > 0, a / F.col(b))
    return out.withColumns({"recall": some(F.col("tp"), "gt"), "precision": some(F.col("tp"), "pred"), "mota": 1 - some(F.col("fn") + F.col("fp") + F.col("switches"), "gt")})


def contingency(matches: DataFrame) -> DataFrame:
    return matches.groupBy("match_id", "gt_id", "pred_id").agg(F.count("*").alias("n"))


def id_mapping(matches: DataFrame) -> DataFrame:
    """(match_id, gt_id, pred_id, n): the one-to-one mapping of ids with the most matched frames; one small table a match."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g, p = np.unique(pdf["gt_id"]), np.unique(pdf["pred_id"])
        n = np.zeros((len(g), len(p)), np.int64)
        n[np.searchsorted(g, pdf["gt_id"]), np.searchsorted(p, pdf["pred_id"])] = pdf["n"]
        rows, cols = assign(-n.astype(float))
        keep = n[rows, cols] > 0
        return pd.DataFrame({"match_id": pdf["match_id"].iloc[0], "gt_id": g[rows[keep]], "pred_id": p[cols[keep]], "n": n[rows[keep], cols[keep]]})

    return contingency(matches).groupBy("match_id").applyInPandas(solve, "match_id bigint, gt_id bigint, pred_id bigint, n bigint")


def id_score(pred: DataFrame, gt: DataFrame, least: float = 0.5) -> DataFrame:
    """gt, pred, idtp, idp, idr, idf1 of each match; one without predictions or without labels counts with zeros."""
    right = id_mapping(match_boxes(pred, gt, least)).groupBy("match_id").agg(F.sum("n").alias("idtp"))
    out = gt.groupBy("match_id").agg(F.count("*").alias("gt")).join(pred.groupBy("match_id").agg(F.count("*").alias("pred")), "match_id", "full_outer").join(right, "match_id", "left").fillna(0, ["gt", "pred", "idtp"])
    t = F.col("idtp")
    some = lambda c: F.when(F.col(c) > 0, t / F.col(c))
    return out.withColumns({"idp": some("pred"), "idr": some("gt"), "idf1": 2 * t / (F.col("gt") + F.col("pred"))})


def merged_pred_ids(matches: DataFrame, least: int = 1) -> DataFrame:
    """Predicted ids that cover two labelled players or more (each at least ``least`` frames), with the players' counts."""
    each = contingency(matches).filter(F.col("n") >= least)
    players = F.array_sort(F.collect_list(F.struct("gt_id", "n")))
    return each.groupBy("match_id", "pred_id").agg(F.count("*").alias("n_gt"), F.sum("n").alias("n"), players.alias("players")).filter("n_gt > 1")


def per_player_score(pred: DataFrame, gt: DataFrame, least: float = 0.5) -> DataFrame:
    """One row a labelled player: frames, matched frames, frames with the mapped id, distinct ids, switches."""
    m = match_boxes(pred, gt, least)
    keys = ["match_id", "gt_id"]
    w = Window.partitionBy(*keys).orderBy("frame")
    hits = m.withColumn("_p", F.lag("pred_id").over(w)).groupBy(*keys).agg(F.count("*").alias("matched_frames"), F.count_distinct("pred_id").alias("distinct_pred_ids"), F.count_if(F.col("_p") != F.col("pred_id")).alias("id_switches"))
    mapped = id_mapping(m).select(*keys, F.col("pred_id").alias("mapped_pred_id"), F.col("n").alias("frames_with_correct_id"))
    out = gt.groupBy(*keys).agg(F.count("*").alias("gt_frames")).join(hits, keys, "left").join(mapped, keys, "left").fillna(0, ["matched_frames", "distinct_pred_ids", "id_switches", "frames_with_correct_id"])
    return out.withColumn("id_accuracy", F.col("frames_with_correct_id") / F.col("gt_frames"))


def frame_offset_fit(pred: DataFrame, gt: DataFrame, most: int = 5, least: float = 0.5) -> DataFrame:
    """The shift of predicted frames (gt = pred + offset, up to ``most``) with the most overlapping pairs; the smaller shift wins ties."""
    b = pred.select("match_id", *[c.alias(f"p_{n}") for n, c in zip(("x1", "y1", "x2", "y2"), box())], "frame", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("frame_offset")).withColumn("frame", F.col("frame") + F.col("frame_offset"))
    hits = gt.join(b, KEY).filter(iou(box(), box("p_")) >= least).groupBy("match_id", "frame_offset").agg(F.count("*").alias("matches"))
    w = Window.partitionBy("match_id").orderBy(F.desc("matches"), F.abs("frame_offset"), "frame_offset")
    return hits.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def height_ratio(pred: DataFrame, gt: DataFrame, least: float = 0.5) -> DataFrame:
    """Median of predicted over labelled box heights of matched pairs."""
    tall = lambda df, i, name: df.select(*KEY, i, (F.col("y2") - F.col("y1")).alias(name))
    m = match_boxes(pred, gt, least).join(tall(pred, "pred_id", "hp"), [*KEY, "pred_id"]).join(tall(gt, "gt_id", "hg"), [*KEY, "gt_id"])
    return m.groupBy("match_id").agg(F.median(F.col("hp") / F.col("hg")).alias("box_height_ratio_median"))


def compare_runs(metrics: DataFrame, runs: list[str]) -> DataFrame:
    """Metrics as rows, runs as columns, from (run, metric, value)."""
    return metrics.groupBy("metric").pivot("run", runs).agg(F.max("value"))


