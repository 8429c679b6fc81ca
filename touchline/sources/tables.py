"""Sources and sinks. All reading and writing is Spark's, so any store that Spark reaches works."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import layouts
from .sidecars import read_anchors, read_homographies, write_anchors, write_homographies  # noqa: F401

#: Columns of the tracks table, in the order of its files.
TRACKS = {
    "match_id": "bigint", "frame": "bigint", "track_id": "bigint", "display_track_id": "bigint", "class_id": "int", "conf": "double", "x1": "double", "y1": "double", "x2": "double", "y2": "double",
    "x_m": "double", "y_m": "double", "team_id": "int", "homography_ok": "boolean", "kp_used": "int", "inlier_ratio": "double", "reproj_err": "double", "detector_ran": "int", "homography_state": "string", "ball_interpolated": "int",
}
#: Texts that stand for nothing, in every mix of cases: a look-up costs far less than lower-casing each field.
NOTHING = ["", *("".join(mix) for word in ("nan", "none", "null") for mix in product(*((c, c.upper()) for c in word)))]
REQUIRED = ("frame", "display_track_id", "class_id", "x1", "y1", "x2", "y2")


def require_columns(df: DataFrame, needed=REQUIRED) -> DataFrame:
    """``df``, or an error that lists what it lacks; nothing runs."""
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df


def read_tracks(spark: SparkSession, path: str | list[str], match_id: int | None = None, pattern: str | None = None, marks: bool = False) -> DataFrame:
    """Delimited tracks (also gzipped) of one file or of a folder whose files differ in delimiter, column order and columns.

    Every file follows its own header. Known columns get their types, '' and NaN become null, others stay text; a column
    that a file lacks is null there. A line with too few or too many fields is kept as far as it parses. Lines equal to
    their file's header and blank lines are no rows. A file without ``match_id`` takes it from its path (``pattern`` with
    one group), else ``match_id``. ``marks`` adds ``source_file`` and ``bad_line`` (see ``line_report``).
    """
    raw, names = layouts.split_lines(spark, path)

    def typed(c: str):
        text = F.trim(F.col(c))
        text = F.when(text.isin(NOTHING), None).otherwise(text)
        kind = TRACKS.get(c)
        if kind in ("bigint", "int"):
            return text.try_cast("double").try_cast(kind).alias(c)
        return (text.try_cast(kind) if kind and kind != "string" else text).alias(c)

    out = raw.select("source_file", "bad_line", *[typed(c) for c in names])
    given = [F.lit(match_id).cast("bigint")] if match_id is not None else []
    if pattern is not None:
        given.insert(0, F.regexp_extract(F.url_decode("source_file"), pattern, 1).try_cast("bigint"))
    if given:
        own = [F.col("match_id")] if "match_id" in names else []
        out = out.select(F.coalesce(*own, *given).alias("match_id"), *[c for c in out.columns if c != "match_id"])
    return out if marks else out.drop("source_file", "bad_line")


def line_report(marked: DataFrame) -> DataFrame:
    """(source_file, lines, bad_lines) of tracks that were read with ``marks``."""
    return marked.groupBy("source_file").agg(F.count("*").alias("lines"), F.count_if("bad_line").alias("bad_lines"))


def read_table(spark: SparkSession, path: str, needed: tuple[str, ...] = ()) -> DataFrame:
    """Detections or keypoints (model output) as Parquet."""
    return require_columns(spark.read.parquet(path), needed)


def write_tracks(df: DataFrame, path: str, form: str = "parquet") -> None:
    """The tracks' columns in their order, by match; other columns are left out."""
    df.select(*[c for c in TRACKS if c in df.columns]).write.mode("overwrite").partitionBy("match_id").format(form).options(**({"header": "true"} if form == "csv" else {})).save(path)


def write_kpi(df: DataFrame, path: str) -> None:
    """The KPI rows as JSON and as CSV below ``path``."""
    df.write.mode("overwrite").json(f"{path}/json")
    df.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")


def write_clean(tracks: DataFrame, id_map: DataFrame, path: str) -> None:
    """Cleaned tracks (all their columns) and the id map that made them."""
    tracks.write.mode("overwrite").partitionBy("match_id").parquet(f"{path}/tracks")
    id_map.write.mode("overwrite").option("header", "true").csv(f"{path}/id_map")


def id_map(segments: DataFrame) -> DataFrame:
    """Segments with a canonical id as rows of the id map."""
    kept = segments.filter(F.col("canonical_id") > 0)
    return kept.select("match_id", F.concat_ws("_", "raw_tid", "seg_idx").alias("seg_key"), F.col("raw_tid").alias("raw_track_id"), F.col("f0").alias("frame_start"), F.col("f1").alias("frame_end"), F.col("canonical_id").cast("bigint").alias("canonical_id"), "role", "team_id")


def load_pass_events(events: DataFrame) -> DataFrame:
    """Pass events with ``notes``, null notes as ''."""
    return events.withColumn("notes", F.coalesce(F.col("notes").cast("string"), F.lit("")) if "notes" in events.columns else F.lit(""))


def next_pass_id(events: DataFrame) -> int:
    return (events.agg(F.max("pass_id")).first()[0] or 0) + 1


def segment_template(summary: DataFrame) -> DataFrame:
    """Segments for labelling by hand: canonical_id and team are left empty."""
    from ..operators.rows import auto_team, check_frames, role_name

    f = check_frames(F.col("f0"), F.col("f1"))
    at = [F.try_element_at(f, F.lit(k)).alias(f"check_f{k}") for k in (1, 2, 3)]
    return summary.select("match_id", F.col("display_track_id").alias("tracker_id"), F.col("f0").alias("frame_start"), F.col("f1").alias("frame_end"), F.col("n_frames").alias("n_detections"), F.round("dur_s", 2).alias("duration_s"), role_name(F.col("mode_cls")).alias("auto_role"), auto_team(F.col("mode_team")).alias("auto_team"), *at, F.lit("").alias("canonical_id"), F.lit("").alias("team"))


def read_segment_template(df: DataFrame) -> DataFrame:
    """A filled template: headers lower-cased with underscores, canonical_id and team as numbers (null where blank)."""
    out = df.toDF(*[re.sub(r"\s+", "_", c.strip().lower()) for c in df.columns])
    require_columns(out, ("tracker_id", "frame_start", "frame_end", "canonical_id"))
    return out.withColumns({c: F.col(c).try_cast("double").try_cast("bigint") for c in ("canonical_id", "team") if c in out.columns})
