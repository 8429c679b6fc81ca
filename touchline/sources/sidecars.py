"""S7, S8 for a season: homographies and anchors of many matches in one call.

Two forms. ``lines``: a JSON object a frame, in folders by match, which Spark writes and splits as it likes. ``document``:
one JSON object a match, ``{meta, frames: {frame: 3 x 3}}`` or ``{meta, anchors: {frame: {...}}}``. A document is read as
text that ends a record at each frame's closing brackets, so it is cut at frames by Spark's line reader, also across
blocks, and a task holds a frame at a time; only a document with white space between those brackets stays one record.
The match comes from the path, by a pattern with one group, or is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a path names its match.
IN_PATH = r"match(?:_id)?[=_-]?(\d+)"
NUMBERS = r"[^\[\]{},\s]+"


def _match(match_id: int | None, pattern: str) -> Column:
    if match_id is not None:
        return F.lit(match_id).cast("bigint")
    path = F.url_decode("_metadata.file_path")
    found = F.element_at(F.regexp_extract_all(path, F.lit(pattern), F.lit(1)), -1)  # the last one: nearest to the file
    found = F.when(F.regexp_count(path, F.lit(pattern)) > 0, found)
    return F.coalesce(found.try_cast("bigint"), F.raise_error(F.concat(F.lit("no match id in the path "), path)).cast("bigint"))


def _flat(body: Column) -> Column:
    """The numbers of a matrix as text, row by row."""
    return F.transform(F.regexp_extract_all(body, F.lit(NUMBERS), F.lit(0)), lambda x: x.try_cast("double"))


def _nested(h: Column) -> Column:
    return F.when(h.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.slice(h, k * 3 + 1, 3)))


def _points(c: str) -> Column:
    return F.transform(c, lambda q: F.struct(q[0].alias("x"), q[1].alias("y")))


def read_homographies(spark: SparkSession, path: str | list[str], match_id: int | None = None, form: str = "document", pattern: str = IN_PATH) -> DataFrame:
    """(match_id, frame, h) of all sidecars at ``path``; a matrix that has not nine numbers is null."""
    if form == "lines":
        raw = spark.read.schema("match_id bigint, frame bigint, h array<array<double>>").json(path)
        return raw.select("match_id", "frame", F.flatten("h").alias("h"))
    raw = spark.read.option("lineSep", "]]").text(path)
    each = r'"(\d+)"\s*:\s*\[\s*(\[[^"]*)'
    record = F.concat("value", F.lit("]]"))
    entry = F.arrays_zip(F.regexp_extract_all(record, F.lit(each), F.lit(1)).alias("frame"), F.regexp_extract_all(record, F.lit(each), F.lit(2)).alias("body"))
    rows = raw.select(_match(match_id, pattern).alias("match_id"), F.explode(entry).alias("e"))
    h = _flat(F.col("e.body"))
    return rows.select("match_id", F.col("e.frame").cast("bigint").alias("frame"), F.transform(F.array(h), lambda x: F.when(F.size(x) == 9, x))[0].alias("h"))


def write_homographies(df: DataFrame, path: str, fps: float | None = None, form: str = "document") -> None:
    """Sidecars by match. ``lines`` gathers nothing; ``document`` brings a match's frames together in one row."""
    kept = df.filter("h IS NOT NULL")
    if form == "lines":
        kept.select("match_id", "frame", _nested(F.col("h")).alias("h")).write.mode("overwrite").partitionBy("match_id").json(path)
        return
    f = kept.groupBy("match_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("frame").cast("string"), _nested(F.col("h")))))).alias("frames"), F.count("*").alias("n"), F.min("frame").alias("a"), F.max("frame").alias("b"))
    f.select("match_id", F.struct(F.lit(fps).alias("fps"), F.col("n").alias("covered_frames"), F.array("a", "b").alias("range")).alias("meta"), "frames").write.mode("overwrite").partitionBy("match_id").json(path)


ANCHOR = "image_pts array<array<double>>, pitch_pts array<array<double>>, H array<array<double>>"


def read_anchors(spark: SparkSession, path: str | list[str], match_id: int | None = None, form: str = "document", pattern: str = IN_PATH) -> DataFrame:
    """(match_id, frame, image_pts, pitch_pts, h) of all sidecars at ``path``."""
    if form == "lines":
        rows = spark.read.schema(f"match_id bigint, frame bigint, {ANCHOR}").json(path).select("match_id", "frame", F.struct("image_pts", "pitch_pts", "H").alias("a"))
    else:
        raw = spark.read.option("lineSep", "}").text(path)
        # an anchor holds no braces of its own, so a record ends with at most one
        one = r'"(\d+)"\s*:\s*(\{[^{}]*)$'
        rows = raw.filter(F.col("value").rlike(one)).select(_match(match_id, pattern).alias("match_id"), F.regexp_extract("value", one, 1).cast("bigint").alias("frame"), F.from_json(F.concat(F.regexp_extract("value", one, 2), F.lit("}")), ANCHOR).alias("a"))
    return rows.select("match_id", "frame", _points("a.image_pts").alias("image_pts"), _points("a.pitch_pts").alias("pitch_pts"), F.flatten("a.H").alias("h"))


def write_anchors(df: DataFrame, path: str, form: str = "document") -> None:
    points = lambda c: F.transform(c, lambda q: F.array(q["x"], q["y"]))
    one = [points(F.col("image_pts")).alias("image_pts"), points(F.col("pitch_pts")).alias("pitch_pts"), _nested(F.col("h")).alias("H")]
    if form == "lines":
        df.select("match_id", "frame", *one).write.mode("overwrite").partitionBy("match_id").json(path)
        return
    df.groupBy("match_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("frame").cast("string").alias("k"), F.struct(*one).alias("v"))))).alias("anchors")).write.mode("overwrite").partitionBy("match_id").json(path)
