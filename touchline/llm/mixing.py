"""Operator 4: mixing sources to target weights by hash thresholds.

A document's place in its source is a hash of its id. A mix takes whole passes over a source and, of one more pass,
the documents whose hash is below a threshold, so a mix with a smaller budget is part of one with a larger budget.
Thresholds come from histograms, not from sorting: words are summed by source and by the hash's first 12 bits, running
sums find the bucket in which a source's budget ends, and only the rows of that bucket are summed again by the next 12
bits, three times (36 bits). The cut falls on the side of the last bucket that is nearer to the budget.

Scale: sizes are counted once and written (id, source, size, hash); each histogram is summed before it is shuffled,
at most 4,096 rows a source and level, so a source with a third of all rows costs no more than another. Thresholds
join back on the source: broadcast by Spark's size rule or an equi-join that adaptive execution splits.

Defined results: null text has size 0 and is taken as far as its hash says (0 words); null sources are one source,
last in order; sources with no words have target 0; equal ids fall together, so repeated rows are taken together;
an empty table gives no rows. Internal columns start with ``_mix``; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BITS, LEVELS = 12, 3


def words_in(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def place(key: Column) -> Column:
    """36 bits of the id's MD5 digest: the same in every engine, run and partitioning."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, BITS * LEVELS // 4), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): shares by weight, each at most ``most`` times its size, the excess reshared.

    The level at which no source is above its cap is found in one pass over sources in order of cap a weight.
    One row a source comes together here; sources are names of collections, not keys of documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.lit(list(weights))[((F.row_number().over(by_name) - 1) % len(weights)).cast("int")].cast("double")
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    s = s.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # the first source (in this order) whose cap is not below the level: it and all after it are uncapped
    s = s.withColumn("lam", F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), "source", "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("lam") * F.col("w"), F.col("cap"))).alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, passes, below): whole passes, and the hash below which one more copy is taken."""
    found = targets.select("source", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("passes"), "source_size", "target")
    found = found.select("source", "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("left"), F.lit(0).cast("bigint").alias("below"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        rows = sizes.select(F.col("source").alias("src"), "size", F.shiftright("hash", shift).alias("bucket"))
        if level:
            rows = rows.join(found.select(F.col("source").alias("s"), F.shiftright("below", shift + BITS).alias("b")), F.col("src").eqNullSafe(F.col("s")) & (F.shiftright("bucket", BITS) == F.col("b")))
        sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("src").orderBy("bucket"))
        joined = sums.withColumn("upto", upto).join(found.select("source", "left"), F.col("src").eqNullSafe(F.col("source")))
        # the first bucket that passes what is left; a source without one is below the threshold as a whole
        edges = joined.groupBy("src").agg(F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", "n", "upto"))).alias("edge"))
        step = found.join(edges, F.col("src").eqNullSafe(F.col("source")), "left")
        short = F.col("left") - (F.col("edge.upto") - F.col("edge.n"))
        at = F.col("edge.bucket")
        if level == LEVELS - 1:  # take the last bucket if that comes nearer
            at = at + F.when(F.col("edge.n") - short < short, 1).otherwise(0)
        rest = F.lit(1 << BITS * LEVELS).cast("bigint") if level == 0 else F.col("below")
        step = step.select("source", "passes", F.when(F.col("edge").isNull(), F.col("left")).otherwise(short).alias("left"), F.when(F.col("edge").isNull(), rest).otherwise(F.shiftleft(at, shift)).alias("below"))
        found = written(step, f"mix-level{level}")
    return found.select("source", "passes", "below")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """(id, source, size, source_size, target, passes, below, hash, taken) for every row; ``how`` goes to ``source_targets``."""
    sizes = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), place(F.col(id_col)).alias("hash")), "mix-sizes")
    targets = written(source_targets(sizes, **how), "mix-targets")
    cut = thresholds(sizes, targets).withColumnRenamed("source", "s")
    plan = targets.join(cut, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("source", "s")
    copies = F.col("passes") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0)
    out = sizes.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.cast("bigint").alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken"))
    return out


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, all columns kept.

    Thresholds are joined to the rows by source, so the texts are not shuffled where the sources' table is small.
    """
    sizes = written(docs.select(F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), place(F.col(id_col)).alias("hash")), "mix-sizes")
    targets = written(source_targets(sizes, **how), "mix-targets")
    cut = thresholds(sizes, targets).select(F.col("source").alias("_mix_source"), F.col("passes").alias("_mix_passes"), F.col("below").alias("_mix_below"))
    copies = (F.col("_mix_passes") + F.when(place(F.col(id_col)) < F.col("_mix_below"), 1).otherwise(0)).cast("int")
    rows = docs.join(cut, F.col(source_col).eqNullSafe(F.col("_mix_source"))).withColumn("_mix_copies", copies).filter("_mix_copies > 0")
    return rows.withColumn("_mix_copy", F.explode(F.expr("sequence(1, _mix_copies)"))).select(*docs.columns)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 9) AS BIGINT) AS hash FROM documents),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
b AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS cap FROM a),
c AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM b),
l AS (SELECT level AS lam FROM c WHERE cap >= level * w ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT lam FROM l) * w, cap)) AS target FROM c),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
h AS (SELECT source, hash, sum(size) AS n FROM d GROUP BY source, hash),
r AS (SELECT h.source, h.hash, n, sum(n) OVER (PARTITION BY h.source ORDER BY hash) AS upto, target - passes * source_size AS rest
  FROM h JOIN u ON h.source IS NOT DISTINCT FROM u.source),
e AS (SELECT source, min(hash) AS hash FROM r WHERE upto > rest GROUP BY source),
f AS (SELECT e.source, r.hash + CASE WHEN upto - rest < rest - (upto - n) THEN 1 ELSE 0 END AS below FROM e JOIN r ON e.source IS NOT DISTINCT FROM r.source AND e.hash = r.hash)
SELECT d.doc_id, d.size, u.source_size, u.target,
  CAST((passes + CASE WHEN f.below IS NULL OR d.hash < f.below THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source LEFT JOIN f ON d.source IS NOT DISTINCT FROM f.source
"""
