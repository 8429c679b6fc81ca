"""Bounded replay: a table played as a stream, in the order of its frames, until all of it has come out again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULTS
from ..sources.shared import new_folder
from . import stateful

#: Files that a range of frames is written in from ``FEW`` rows a range on; smaller ranges are one file.
FILES, FEW = 8, 10_000
#: A row of this match comes last and moves the watermark past all frames.
MARKER, AHEAD = -1, 10_000_000


def played(df: DataFrame, make: Callable[[DataFrame], DataFrame], ranges: int = 3, after: DataFrame | None = None, mode: str = "append", fps: float = DEFAULTS.fps) -> DataFrame:
    """What ``make(stream)`` has put out when ``df`` (with match_id and frame) has run through it.

    ``df`` is written in ranges of frames, one a trigger, then ``after`` (rows that come too late), then a marker. The
    stream has ``event_ts`` and a watermark; it runs to its end (``availableNow``) with state, input and output in the shared folder.
    """
    spark = df.sparkSession
    folder = new_folder(spark, "replay")
    shape = df.agg(F.max("frame"), F.count("*")).first()
    last, n = shape[0] or 0, shape[1]
    files = FILES if n >= FEW * ranges else 1
    add = lambda rows: rows.repartition(files).write.mode("append").parquet(f"{folder}/in")
    step = last // ranges + 1
    for k in range(ranges):
        add(df.filter((F.col("frame") >= k * step) & (F.col("frame") < (k + 1) * step)))
    # like some row of the table, so that it passes the stream's filters
    marker = df.limit(1).withColumns({"match_id": F.lit(MARKER).cast(df.schema["match_id"].dataType), "frame": F.lit(last + AHEAD).cast(df.schema["frame"].dataType)})
    for rows in [after] if after is not None else []:
        add(rows.select(*df.columns))
    marker.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    old = {k: spark.conf.get(k, None) for k in stateful.SETTINGS}
    for k, v in stateful.SETTINGS.items():
        spark.conf.set(k, v)
    try:
        stream = make(stateful.with_event_time(stateful.replay(spark, f"{folder}/in", df.schema, files), fps=fps))
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        if mode == "append":
            writer = writer.format("parquet").option("path", f"{folder}/out")
        else:  # the whole result of the last trigger stands
            writer = writer.foreachBatch(lambda out, _: out.write.mode("overwrite").parquet(f"{folder}/out"))
        query = writer.start()
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").filter(F.col("match_id") != MARKER)
