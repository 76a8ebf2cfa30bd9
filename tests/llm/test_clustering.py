"""Ns-bounds against rounds that evaluate every distance."""

import hashlib

import numpy as np
import pytest

from wakeline.llm import clustering
from wakeline.llm.clustering import Bounds, cluster_vectors, squared_distances

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int"


def rows_of(x):
    return [(i, [float(c) for c in row], "extra", 1) for i, row in enumerate(x)]


def brute(rows, k, rounds, seed=3, dim=64):
    kept = [(i, np.floor(np.array(e, dtype=np.float32).astype(np.float64) * 1024).astype(np.int64)) for i, e, *_ in rows if e is not None and len(e) == dim and all(c is not None and np.isfinite(c) for c in e)]
    x = np.array([e for _, e in kept])
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, hashlib.sha256(f"{seed}:{kept[r][0]}".encode()).hexdigest(), x[r].tolist()))
    c = x[order[:k]]
    for t in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        a = d.argmin(axis=1)
        if t < rounds:
            c = np.array([x[a == j].sum(axis=0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    return sorted((kept[r][0] if kept[r][0] is not None else -1, int(a[r]), int(d[r, a[r]])) for r in range(len(x))), c


def found(df, **how):
    got = cluster_vectors(df, **how)
    return sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance) for r in got.assigned.collect()), got


@pytest.mark.parametrize("shape", ["blobs", "even", "ties"])
def test_equals_brute_force(spark, shape):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 64))
    if shape == "blobs":
        x = rng.normal(size=(8, 64))[rng.integers(8, size=900)] * 2 + 0.3 * x
    if shape == "ties":
        x = rng.integers(-1, 2, size=(900, 64)) * (np.arange(64) < 3)
    rows = rows_of(x)
    want, c = brute(rows, 8, 10)
    got, result = found(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got == want and (result.centroids == c).all()
    if shape == "blobs":
        assert sum(result.evaluated[1:]) < 0.3 * 8 * 900 * 9  # the bounds decide most


def test_displacement_is_total():
    """A centroid that goes away and comes back loosens its bound by nothing."""
    x = np.array([[0, 0], [100, 0]])
    history = np.array([[[1, 0], [90, 0]], [[60, 0], [40, 0]], [[1, 0], [90, 0]]])
    b = Bounds.first(x, history[0])
    assert b.assign(x, history) == 0 and b.cluster.tolist() == [0, 1]
    assert Bounds.first(x, history[0]).assign(x, history[:2]) > 0


def test_large_integers_are_exact():
    x, c = np.array([[(1 << 27) - 1] * 64, [0] * 64]), np.array([[-(1 << 27)] * 64])
    assert squared_distances(x, c)[:, 0].tolist() == [64 * ((1 << 28) - 1) ** 2, 64 << 54]


def test_odd_rows(spark):
    one = [0.5] * 64
    rows = [(1, one), (1, one), (None, [0.25] * 64), (2, None), (3, []), (4, [0.1] * 63), (5, [None] + [0.1] * 63), (6, [float("nan")] * 64), (7, [float("inf")] * 64), (8, [-0.0001] * 64)]
    rows = [(*r, "x", 1) for r in rows]
    got, result = found(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows, 8, 10)[0] and len(result.centroids) == 4
    got, result = found(spark.createDataFrame([], SCHEMA))
    assert got == [] and not len(result.centroids)


def test_query(spark, tmp_path):
    spark.createDataFrame([(i, [float(i % 7)] * 64) for i in range(50)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = clustering.op12_clustering(spark, str(tmp_path)).collect()
    assert len(out) == 50 and {r.inertia for r in out} == {sum(r.distance for r in out)}
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/empty/embeddings.parquet")
    assert clustering.op12_clustering(spark, f"{tmp_path}/empty").collect() == []
