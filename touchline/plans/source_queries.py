"""Queries of the sources: views written as files of several forms, read again, with the views' SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import sidecars, tables
from ..sources.shared import new_folder
from .registry import query
from .row_queries import h_array

#: Delimiter, order of columns and compression by match_id mod 4.
FORMS = [(",", 1, None), (";", -1, None), ("\t", 1, "gzip"), ("|", -1, "gzip")]
COLUMNS = ["frame", "display_track_id", "class_id", "conf", "x1", "y1", "x2", "y2", "x_m", "y_m", "team_id", "ball_interpolated", "l_partkey"]


@query("s1_read_tracks", "match_id frame display_track_id class_id team_id ball_interpolated l_partkey", "conf x1 y1 x2 y2 x_m y_m", views="fx_tracks", sql="SELECT * FROM fx_tracks")
def _(v):
    """A folder a match, in four forms: every file follows its own header, the match comes from the path."""
    t = v.fx_tracks
    folder = new_folder(v.spark, "tracks")
    for k, (sep, order, codec) in enumerate(FORMS):
        part = t.filter(F.col("match_id") % len(FORMS) == k).select("match_id", *COLUMNS[::order])
        # a match's rows meet before they are written, so it has one file; else each task writes one of every match that it sees
        part.repartition(2 * v.spark.sparkContext.defaultParallelism, "match_id").write.partitionBy("match_id").options(header="true", sep=sep, **({"compression": codec} if codec else {})).csv(f"{folder}/form_{k}")
    return tables.read_tracks(v.spark, f"{folder}/*/*", pattern=r"match_id=(\d+)")


def homographies(v, form: str):
    folder = new_folder(v.spark, "homographies")
    sidecars.write_homographies(h_array(v.fx_homography), folder, 30.0, form)
    return sidecars.read_homographies(v.spark, folder, form=form).select("match_id", "frame", *[F.col("h")[k].alias(f"h{k}") for k in range(9)])


H = " ".join(f"h{k}" for k in range(9))


@query("s7_homography_documents", "match_id frame", H, views="fx_homography", sql="SELECT * FROM fx_homography")
def _(v):
    """A document a match, cut at frames."""
    return homographies(v, "document")


@query("s7_homography_lines", "match_id frame", H, views="fx_homography", sql="SELECT * FROM fx_homography")
def _(v):
    """A line a frame."""
    return homographies(v, "lines")


def anchors(v, form: str):
    h = h_array(v.fx_homography)
    point = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), y.cast("double").alias("y"))
    made = h.select("match_id", "frame", F.array(point(1.5, F.col("frame")), point(-2, F.col("h")[2])).alias("image_pts"), F.array(point(3, F.col("match_id"))).alias("pitch_pts"), F.when(F.col("frame") % 3 > 0, F.col("h")).alias("h"))
    folder = new_folder(v.spark, "anchors")
    sidecars.write_anchors(made, folder, form)
    back = sidecars.read_anchors(v.spark, folder, form=form)
    return back.select("match_id", "frame", F.size("image_pts").alias("n_image"), F.col("image_pts")[0]["y"].alias("y0"), F.col("image_pts")[1]["y"].alias("y1"), F.col("pitch_pts")[0]["y"].alias("py"), F.col("h")[2].alias("h2"))


ANCHORS = "SELECT match_id, frame, 2 AS n_image, CAST(frame AS DOUBLE) AS y0, h2 AS y1, CAST(match_id AS DOUBLE) AS py, CASE WHEN frame % 3 > 0 THEN h2 END AS h2 FROM fx_homography"


@query("s8_anchor_documents", "match_id frame n_image", "y0 y1 py h2", views="fx_homography", sql=ANCHORS)
def _(v):
    return anchors(v, "document")


@query("s8_anchor_lines", "match_id frame n_image", "y0 y1 py h2", views="fx_homography", sql=ANCHORS)
def _(v):
    return anchors(v, "lines")
