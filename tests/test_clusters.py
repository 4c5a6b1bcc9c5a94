"""Clusters of a size, and k-means with the root of the rows."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import vectors as V


def test_large_clusters_are_split_until_they_fit(spark):
    rng = random.Random(2)
    rows = [(k, 1, [rng.gauss(3 * (k % 4), 0.2), 0.0]) for k in range(90)] + [(100, 2, [0.0, 0.0])] + [(200 + k, 3, [1.0, 1.0]) for k in range(45)]
    rows += [(300 + k, 4, [float(k), 0.0]) for k in range(5)] + [(400, None, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, c long, embedding array<double>")
    got = {r.vec_id: r.cluster for r in V.resized(df, "c", most=20).collect()}
    assert set(got) == {r[0] for r in rows}
    groups: dict = {}
    for k, c in got.items():
        groups.setdefault(c, set()).add(k)
    noise = groups.pop(None)
    assert {100, 400} <= noise
    own = {r[0]: r[1] for r in rows}
    for c, some in groups.items():
        assert c == min(some)
        assert 2 <= len(some) <= 20
        assert len({own[k] for k in some}) == 1
    assert {got[300 + k] for k in range(5)} == {300}
    assert not any(200 <= k < 300 for k in noise)
    assert V.resized(df.limit(0), "c").collect() == []


def test_hot_clusters_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(V, "TASK", 30)
    rng = random.Random(3)
    rows = [(k, 1, [rng.gauss(0, 1), rng.gauss(0, 1)]) for k in range(200)] + [(300 + k, 2, [1.0, 1.0]) for k in range(100)] + [(500, 3, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, c long, embedding array<double>")
    parts = V._dealt_out(df.toDF("id", "c", "v").selectExpr("id", "cast(c as string) as c", "v")).groupBy("c").count().collect()
    assert sum(r["count"] for r in parts) == 301
    assert max(r["count"] for r in parts) <= 30
    got = {r.vec_id: r.cluster for r in V.resized(df, "c", most=10).collect()}
    assert len(got) == 301
    sizes: dict = {}
    for c in got.values():
        sizes[c] = sizes.get(c, 0) + 1
    sizes.pop(None)
    assert max(sizes.values()) <= 10


def test_nearest_centers_take_bounded_memory():
    """20,000 members and 1,000 centers, as a large cluster has: all their differences would be 1.3 GB in eight dimensions."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(20_000, 8)), 1)
    centers = np.concatenate([x[:996], x[:2], -x[5:7]])  # with equal ones, and ties by symmetry
    tracemalloc.start()
    near = V._nearest_center(x, centers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 * 2**20
    some = slice(0, 20_000, 97)
    want = ((x[some, None, :] - centers[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
    assert (near[some] == want).all()


def test_kmeans_has_the_root_of_the_rows(spark):
    rows = [(k, [float(k % 5 * 10), float(k % 2)]) for k in range(100)] + [(200, None), (201, [1.0, None])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r.id: r.cluster for r in V.kmeans(df, "id", F.col("v")).collect()}
    assert got[200] is None and got[201] is None
    assert len(set(got.values()) - {None}) == 10
    assert got[0] == got[10] != got[1]
    assert {r.cluster for r in V.kmeans(df.where("id = 3"), "id", F.col("v")).collect()} == {0}
    assert V.kmeans(df.limit(0), "id", F.col("v")).collect() == []
