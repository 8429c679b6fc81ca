"""How a query is registered: a DataFrame, and the SQL body that must give the same rows.

Both sides are brought to the same types: whole numbers as BIGINT, reals rounded, everything else as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PLACES = 7


class Views:
    """``v.fx_tracks`` is that view over the tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixtures.view(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, ints: str = "", reals: str = "", other: str = "", sql: str | None = None, views: str = "", extra: str = ""):
    """Registers ``fn(views)``. ``views`` names the fixtures of the SQL body, ``extra`` further expressions ahead of it."""
    i, r, o = ints.split(), reals.split(), other.split()

    def wrap(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Views(spark, sf_dir))
            return df.select(*[F.col(c).cast("bigint").alias(c) for c in i], *[(F.round(F.col(c).cast("double"), PLACES) + 0.0).alias(c) for c in r], *o)

        QUERIES[name] = run
        if sql is not None:
            parts = [p for p in (fixtures.ctes(*views.split()) if views else "", extra, f"q AS ({sql})") if p]
            cols = [*[f"CAST({c} AS BIGINT) AS {c}" for c in i], *[f"round(CAST({c} AS DOUBLE), {PLACES}) + 0.0 AS {c}" for c in r], *o]
            SQL[name] = "WITH " + ",\n".join(parts) + f"\nSELECT {', '.join(cols)} FROM q"
        return fn

    return wrap
