"""S1 for whole folders: delimited files that differ in delimiter, column order, columns and compression.

Each file's layout is its own first line. Those lines are found by one pass over the text, as a partial aggregate with one
row a file; the driver gets the distinct layouts' sizes and names, never a header for each file. Lines then meet the layout of
their file: most files of a folder share one, which is a literal, and only files that differ are listed and joined (by
broadcast while the list is small; where all files are alike there is no join). A line is split once, by Spark's own CSV
parser with its file's delimiter, and columns are taken by their names' places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import kept

#: Delimiters in order of preference, and as patterns for splitting.
DELIMITERS = {",": ",", ";": ";", "\t": "\t", "|": "\\|"}


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, source_file, _start): every line that is not blank; ``_start``: where its block begins in the file."""
    raw = spark.read.text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_start")).filter(F.trim("value") != "")


def _delimiter(header: Column) -> Column:
    """The commonest delimiter of a line; of equally common ones the first; a comma if none occurs."""
    counted = [F.struct((F.size(F.split(header, p)) - 1).alias("n"), F.lit(-k).alias("k"), F.lit(d).alias("d")) for k, (d, p) in enumerate(DELIMITERS.items())]
    return F.array_max(F.array(*counted))["d"]


def headers(found: DataFrame) -> DataFrame:
    """(source_file, line, sep, names): a row a file."""
    first = found.filter("_start = 0").withColumn("_at", F.monotonically_increasing_id()).groupBy("source_file").agg(F.min_by("value", "_at").alias("line"))
    clean = F.regexp_replace("line", "^﻿", "")
    split = lambda sep: F.transform(F.split(F.col("_clean"), sep), lambda n: F.btrim(F.btrim(n), F.lit('"')))
    cases = F.lit(None)
    for d, p in DELIMITERS.items():
        cases = F.when(F.col("sep") == d, split(p)).otherwise(cases)
    return first.withColumn("_clean", clean).withColumn("sep", _delimiter(F.col("_clean"))).withColumn("names", cases).drop("_clean")


def _fields(sep: str, n: int) -> Column:
    """A line's fields by Spark's CSV parser, and whether they are not ``n``."""
    schema = ", ".join(f"c{i} string" for i in range(n)) + ", bad string"
    parsed = F.from_csv("value", schema, {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad", "escape": "\"", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    return F.transform(F.array(parsed), lambda s: F.struct(F.array(*[s[f"c{i}"] for i in range(n)]).alias("fields"), s["bad"].isNotNull().alias("bad")))[0]


def split_lines(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, list[str]]:
    """(source_file, bad_line and every column as text), and the columns' names: those of the commonest layout, then others."""
    found = lines(spark, path)
    heads = kept(headers(found), "layouts")
    layouts = heads.groupBy("line", "sep", "names").agg(F.count("*").alias("files"))
    row = layouts.agg(F.count("*").alias("n"), F.max_by(F.struct("line", "sep", "names"), F.struct("files", "line")).alias("most"), F.collect_set(F.struct("sep", F.size("names").alias("n"))).alias("shapes"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("names")).first()
    if not row["n"]:
        return spark.createDataFrame([], "source_file string, bad_line boolean"), []
    most = row["most"]
    names = list(dict.fromkeys([*most["names"], *row["names"]]))
    # places are found once a file, so a line takes its columns by number; a name that the file lacks has place -1
    places = [most["names"].index(c) if c in most["names"] else -1 for c in names]
    common = F.struct(F.lit(most["line"]).alias("line"), F.lit(most["sep"]).alias("sep"), F.lit(len(most["names"])).alias("n"), F.array(*map(F.lit, places)).alias("places"))
    if row["n"] > 1:
        own = F.array(*[(F.array_position("names", F.lit(c)) - 1).cast("int") for c in names])
        others = heads.filter(F.col("line") != most["line"]).select("source_file", F.struct("line", "sep", F.size("names").alias("n"), own.alias("places")).alias("_other"))
        found = found.join(others, "source_file", "left").withColumn("_layout", F.coalesce("_other", common))
    else:
        found = found.withColumn("_layout", common)
    shape = F.lit(None)
    for s in row["shapes"]:
        shape = F.when((F.col("_layout.sep") == s["sep"]) & (F.col("_layout.n") == s["n"]), _fields(s["sep"], s["n"])).otherwise(shape)
    rows = found.filter(F.col("value") != F.col("_layout.line")).withColumn("_row", shape)
    # a null array has no place
    column = lambda k, c: F.get("_row.fields", F.get("_layout.places", F.lit(k))).alias(c)
    clash = [c for c in names if c not in ("source_file", "bad_line")]
    return rows.select("source_file", F.col("_row.bad").alias("bad_line"), *[column(k, c) for k, c in enumerate(names) if c in clash]), clash
