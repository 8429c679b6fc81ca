"""What the training-data operators share: reading tables, the shared folder, ASCII words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters; ``bytes.split()`` splits alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting (as in tests) gets a temporary folder; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it again. Survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


#: Bits of a sieve: 8 MB, whatever the number of keys.
SIEVE = 1 << 26


def sieve(keys: DataFrame, key: str = "key") -> DataFrame:
    """Bitmaps (at most 2,049 of 4 KB) of the keys' hashes; see ``sift``."""
    spot = F.pmod(F.xxhash64(key), F.lit(SIEVE))
    bits = keys.groupBy(F.bitmap_bucket_number(spot).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("_bits"))
    return written(bits, "sieve")


def sift(df: DataFrame, bitmaps: DataFrame, key: str = "key") -> DataFrame:
    """Adds ``_hit``: false only where no key of the sieve equals the row's, so those rows need not be moved to be joined.

    Bitmaps have a fixed size; with more keys than bits most rows hit, and the join that follows does the work alone.
    """
    spot = F.pmod(F.xxhash64(key), F.lit(SIEVE))
    at = F.bitmap_bit_position(spot)
    found = df.join(F.broadcast(bitmaps), F.bitmap_bucket_number(spot) == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.withColumn("_hit", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).select(*df.columns, "_hit")


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave, once nothing that is still to run reads them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
