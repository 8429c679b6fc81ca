"""Centroid clustering against plain integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import shallot


def brute(rows, k=16, rounds=3, dims=64):
    """rows: (id, components or None) -> {index of the row: (cluster, distance)}, centroids."""
    kept = [(n, i, [math.floor(64 * float(x)) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[1] is None else r[1]}".encode()).hexdigest(), r[2]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, _, v in kept]
        c = [[sum(x) // len(x) for x in zip(*(kept[n][2] for n in range(len(kept)) if at[n] == j))] if j in at else m for j, m in enumerate(c)]
    return {n: nearest(v)[::-1] for n, _, v in kept}, c


def test_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, c = brute(rows)
    got = {r["vec_id"]: r for r in shallot.op12_shallot(spark, sf).collect()}
    assert {rows[n][0]: w for n, w in want.items()} == {i: (r["cluster"], r["distance"]) for i, r in got.items()}
    for r in got.values():
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[r["cluster"]])).encode()).hexdigest()
        assert r["cluster_inertia"] == sum(d for j, d in want.values() if j == r["cluster"]) and r["inertia"] == sum(d for _, d in want.values())


def odd_vectors():
    rnd = np.random.default_rng(3)
    base = [rnd.integers(-3, 4, 5).astype(float).tolist() for _ in range(60)]
    odd = [None, [], [1.0], [1.0, None, 0.0, 0.0, 0.0], [math.nan] + [0.0] * 4, [math.inf] + [0.0] * 4, [-math.inf] + [0.0] * 4, [-0.0] * 5, [0.1, -0.1, 1e-9, -1e-9, 1000.0]]
    return [*enumerate(base), *[(7, base[7])] * 40, (None, base[3]), (None, base[4]), *((100 + k, v) for k, v in enumerate(odd))]


def test_odd_vectors_and_other_columns(spark):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "'x' AS v", "1 AS a", "2 AS l", "3 AS label").repartition(5)
    for k in (1, 2, 6, 500):
        found, c = shallot.cluster(df, k=k, dimensions=5)
        want, centroids = brute(rows, k=k, dims=5)
        assert c.tolist() == centroids
        key = lambda i, v: (i is None, i or 0, *v)
        assert sorted((*key(r["vec_id"], r["v"]), r["a"], r["distance"]) for r in found.collect()) == sorted((*key(rows[n][0], [math.floor(64 * x) for x in rows[n][1]]), *w) for n, w in want.items())
    found, c = shallot.cluster(df.filter("false"), dimensions=5)
    assert found.collect() == [] and len(c) == 0


def test_empty_table_query(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, [0.5])], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert shallot.op12_shallot(spark, str(tmp_path)).collect() == []


def test_too_large_components_raise(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="a component exceeds"):
        shallot.cluster(df, dimensions=2)


def test_bounds_spare_work_and_lose_nothing():
    """Rounds over well-separated and over tied vectors: as a full search, with fewer distances."""
    rnd = np.random.default_rng(0)
    middles = rnd.integers(-1000, 1000, (16, 8))
    for v, spared in ((middles[rnd.integers(0, 16, 4000)] + rnd.integers(-60, 60, (4000, 8)), 0.5), (rnd.integers(-2, 3, (4000, 8)), 1.05)):
        c, before = v[rnd.choice(len(v), 16, replace=False)].astype(np.int64), None
        v = v.astype(np.int64)
        a, s, u, low = np.zeros(len(v), np.int32), np.ones(len(v), np.int32), np.full(len(v), np.inf), np.zeros(len(v))
        searched = 0
        for _ in range(6):
            search = shallot.Search(c, before)
            a, s, u, low = search.assign(v, a, s, u, low)
            d = np.stack([shallot.squared(v, x) for x in c], 1)
            assert (a == d.argmin(1)).all()
            true = np.sqrt(d.astype(float))
            assert (u >= true[np.arange(len(v)), a]).all() and (low <= np.where(np.arange(16) == a[:, None], np.inf, true).min(1)).all()
            searched += search.searched
            before, c = c, np.array([v[a == j].sum(0) // max(1, (a == j).sum()) if (a == j).any() else c[j] for j in range(16)])
        assert searched < spared * 6 * 16 * len(v)


def test_sums_are_taken_by_partition(spark):
    df = spark.range(1000).select(F.lit(0).alias("a"), F.array(F.lit((1 << 31) - 1), (F.col("id") - 500).cast("int")).alias("v"))
    assert shallot.means(df, np.zeros((2, 2), np.int64)).tolist() == [[(1 << 31) - 1, -1], [0, 0]]
