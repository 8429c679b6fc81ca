"""Operator 12: centroid clustering (k-means in integers) with the Shallot search.

Vectors become whole numbers, so distances, ties and means are exact and runs agree on every machine. Each vector keeps
its nearest centroid, the second-nearest one it met, an upper bound of its distance to the first and a lower bound of
its distance to all others. After centroids have moved, bounds are shifted by how far; where the upper bound stays below
the lower one, or below half the way to the nearest other centroid, nothing is computed. For the rest:

1. the distances to both remembered centroids are computed, and the search starts from the closer one;
2. the other centroids are scanned in order of their distance from that start. A centroid farther from it than the
   vector's distance to the start plus its distance to the second-nearest so far lies outside the ball (triangle
   inequality), as do all after it; each closer second shrinks the ball;
3. survivors are compared by their whole squared distances, then by number.

Bounds are real numbers, widened by more than their rounding, and only spare work; every comparison that decides is
exact. All vectors of a batch take a step of the scan together (numpy).

A round is one pass without a shuffle: centroids (k x dimensions numbers, bounded by parameters) go to the tasks, and
vectors with their bounds are written to the shared folder. Sums are taken by partition and cluster first, so a cluster
that holds most rows costs no more; only k sums come to the driver.

Defined results: vectors that are null, of another length, or hold a null or non-finite component are left out. Repeated
rows and ids count as often as they stand; a null id has the text '' in the hash that chooses the starts. With fewer
vectors than k each is a start; an empty table gives no rows. A component whose whole number exceeds ``LARGEST`` (so that
squared distances could pass 63 bits) raises an error. Ties in distance go to the smaller number, ties in the hash to the
smaller components. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, table, written

K, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
#: Largest whole component: with up to 1,024 dimensions a squared distance stays below 2^63.
LARGEST = (1 << 25) - 1
#: Relative slack of bounds, far more than the rounding of a root and a sum.
SLACK = 1e-12
STATE = "vec_id {kind}, v array<int>, a int, s int, u double, l double"


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): usable vectors with components floor(scale * x)."""
    v = F.col(vector_col)
    # comparisons with an infinite limit are false for NaN only if it is tested for
    good = F.coalesce((F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    floor = lambda x: F.floor(x.cast("double") * scale)
    fits = lambda x: F.when(F.abs(x.cast("double") * scale) <= LARGEST, floor(x).cast("int")).otherwise(F.raise_error(F.lit(f"a component exceeds {LARGEST // scale}")).cast("int"))
    return df.filter(good).select(F.col(id_col).alias("vec_id"), F.transform(v, fits).alias("v"))


def starts(vectors: DataFrame, k: int = K) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``1:<vec_id>``, as rows: k x dimensions numbers."""
    mark = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in vectors.orderBy(mark, "v").limit(k).select("v").collect()], np.int64)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``v`` to ``c`` (one centroid, or one a row)."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


class Search:
    """Centroids with their neighbours in order of distance, and how far each came since the round before."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.c, k = centroids, len(centroids)
        self.between = np.sqrt(np.stack([squared(centroids, c) for c in centroids]).astype(float))
        self.order = np.argsort(self.between + np.where(np.eye(k, dtype=bool), -1.0, 0.0), axis=1, kind="stable")[:, 1:]  # itself first, then left out
        self.sorted = np.take_along_axis(self.between, self.order, 1) * (1 - SLACK)
        self.half = self.sorted[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(squared(centroids, before).astype(float)) * (1 + SLACK)
        self.moved = moved
        self.others = np.array([np.delete(moved, j).max(initial=0.0) for j in range(k)])
        self.searched = 0  # distances that were computed, for tests

    def assign(self, v: np.ndarray, a: np.ndarray, s: np.ndarray, u: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, ...]:
        """New (a, s, u, l) of vectors ``v``; with ``u`` infinite nothing is known of a vector."""
        a, s = a.copy(), s.copy()
        u = (u + self.moved[a]) * (1 + SLACK)
        low = (low - self.others[a]) * np.where(low > self.others[a], 1 - SLACK, 1 + SLACK)
        at = np.flatnonzero(~(u < np.maximum(low, self.half[a])))
        if len(at):  # the exact distance may suffice
            known = at[np.isfinite(u[at])]
            self.searched += len(known)
            u[known] = np.sqrt(squared(v[known], self.c[a[known]]).astype(float)) * (1 + SLACK)
            at = np.flatnonzero(~(u < np.maximum(low, self.half[a])))
        if len(at):
            a[at], s[at], u[at], low[at] = self._scan(v[at], a[at], s[at])
        return a, s, u, low

    def _scan(self, v: np.ndarray, a: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
        k = len(self.c)
        if k == 1:
            return a, s, np.zeros(len(v)), np.full(len(v), np.inf)
        d1, d2 = squared(v, self.c[a]), squared(v, self.c[s])
        self.searched += 2 * len(v)
        swap = (d2 < d1) | ((d2 == d1) & (s < a))
        a, s, d1, d2 = np.where(swap, s, a), np.where(swap, a, s), np.where(swap, d2, d1), np.where(swap, d1, d2)
        start, reach = a.copy(), np.sqrt(d1.astype(float)) * (1 + SLACK)
        live = np.arange(len(v))
        for j in range(k - 1):
            ball = reach[live] + np.sqrt(d2[live].astype(float)) * (1 + SLACK)
            live = live[self.sorted[start[live], j] <= ball]
            if not len(live):
                break
            c = self.order[start[live], j].astype(a.dtype)
            new = (c != a[live]) & (c != s[live])
            i, c = live[new], c[new]
            d = squared(v[i], self.c[c])
            self.searched += len(i)
            first = (d < d1[i]) | ((d == d1[i]) & (c < a[i]))
            second = ~first & ((d < d2[i]) | ((d == d2[i]) & (c < s[i])))
            f, t = i[first], i[second]
            s[f], d2[f] = a[f], d1[f]
            a[f], d1[f] = c[first], d[first]
            s[t], d2[t] = c[second], d[second]
        return a, s, np.sqrt(d1.astype(float)) * (1 + SLACK), np.sqrt(d2.astype(float)) * (1 - SLACK)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    v = batch["v"]
    flat = v.flatten().to_numpy().astype(np.int64)
    return flat.reshape(batch.num_rows, -1), *(batch[c].to_numpy(zero_copy_only=False) for c in ("a", "s", "u", "l"))


def assign(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None = None, distance: bool = False) -> DataFrame:
    """The vectors with their new nearest centroid and bounds; with ``distance`` their squared distance too."""
    kind = state.schema["vec_id"].dataType.simpleString()
    names = ["vec_id", "v", "a", "s", "u", "l"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids, before)
        for batch in batches:
            if not batch.num_rows:
                continue
            v, a, s, u, low = _columns(batch)
            a, s, u, low = search.assign(v, a, s, u, low)
            extra = [pa.array(squared(v, centroids[a]), pa.int64())] if distance else []
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(a, pa.int32()), pa.array(s, pa.int32()), pa.array(u), pa.array(low), *extra], [*names, *(["distance"] if distance else [])])

    return state.mapInArrow(run, STATE.format(kind=kind) + (", distance bigint" if distance else ""))


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact floors of each cluster's means; an empty cluster keeps its centroid. Sums by partition, then of partitions."""
    d = centroids.shape[1]
    part = state.groupBy("a", F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.lit(i)).cast("bigint")).alias(f"c{i}") for i in range(d)])
    whole = part.groupBy("a").agg(F.sum("n").alias("n"), *[F.sum(F.col(f"c{i}").cast("decimal(20,0)")).alias(f"c{i}") for i in range(d)])
    out = centroids.copy()
    for r in whole.collect():  # k rows
        out[r["a"]] = [int(r[f"c{i}"]) // r["n"] for i in range(d)]
    return out


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, a: its cluster, distance) of every usable vector, and the final centroids."""
    whole = written(whole_vectors(df, id_col, vector_col, dimensions, scale), "shallot-vectors")
    centroids = starts(whole, k)
    second = min(1, max(0, len(centroids) - 1))
    state = whole.select("vec_id", "v", F.lit(0).alias("a"), F.lit(second).alias("s"), F.lit(float("inf")).alias("u"), F.lit(0.0).alias("l"))
    if not len(centroids):
        return state.select("vec_id", "v", "a", F.lit(0).cast("bigint").alias("distance")), centroids
    held, before = whole, None
    for _ in range(rounds):
        state = written(assign(state, centroids, before), "shallot-state")
        discard(held)
        held, before = state, centroids
        centroids = means(state, before)
    final = written(assign(state, centroids, before, distance=True).select("vec_id", "v", "a", "distance"), "shallot-clusters")
    discard(held)
    return final, centroids


def op12_shallot(spark, sf_dir: str) -> DataFrame:
    import hashlib

    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    sums = {r["a"]: r["s"] for r in found.groupBy("a").agg(F.sum("distance").alias("s")).collect()}  # k rows
    rows = [(j, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, s in sums.items()]
    clusters = spark.createDataFrame(rows, "a int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(clusters), "a").select("vec_id", F.col("a").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql(rounds: int) -> str:
    """Assignments and means of each round as common table expressions."""
    out = []
    for r in range(rounds + 1):
        out.append(f"""d{r} AS (SELECT v.rid, v.vec_id, v.v, c.cluster, list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM v CROSS JOIN c{r} c),
a{r} AS (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(distance := distance, cluster := cluster)) AS best FROM d{r} GROUP BY rid)""")
        if r < rounds:
            out.append(f"""x{r} AS (SELECT best.cluster AS cluster, i, CAST(floor(sum(v[i])::DOUBLE / count(*)) AS BIGINT) AS near, sum(v[i])::HUGEINT AS total, count(*)::HUGEINT AS n FROM a{r}, range(1, {DIMENSIONS + 1}) t(i) GROUP BY 1, 2),
m{r} AS (SELECT cluster, list(CASE WHEN near * n > total THEN near - 1 WHEN (near + 1) * n <= total THEN near + 1 ELSE near END ORDER BY i) AS c FROM x{r} GROUP BY 1),
c{r + 1} AS (SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m USING (cluster))""")
    return ",\n".join(out)


OP12_SQL = f"""WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS INTEGER) AS cluster, v AS c FROM v QUALIFY cluster < {K}),
{_rounds_sql(ROUNDS)},
s AS (SELECT best.cluster AS cluster, CAST(sum(best.distance) AS BIGINT) AS cluster_inertia FROM a{ROUNDS} GROUP BY 1)
SELECT a.vec_id, a.best.cluster AS cluster, CAST(a.best.distance AS BIGINT) AS distance, s.cluster_inertia, CAST((SELECT sum(cluster_inertia) FROM s) AS BIGINT) AS inertia,
       sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN s ON s.cluster = a.best.cluster JOIN c{ROUNDS} c ON c.cluster = a.best.cluster"""
