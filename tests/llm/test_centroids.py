"""Exact clusters against plain whole-number k-means."""

import hashlib
import math

import numpy as np
import pytest

from durata.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=40, rounds=5):
    kept = [(r[0], [math.floor(256 * float(np.float32(c))) for c in r[1]]) for r in rows
            if r[1] is not None and len(r[1]) == 64 and all(c is not None and math.isfinite(c) for c in r[1])]
    sha = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centers = [v for _, v in sorted(kept, key=lambda e: (sha(e[0]), e[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        centers = [[sum(c) // len(members[j]) for c in zip(*members[j], strict=True)] if j in members else c0
                   for j, c0 in enumerate(centers)]
    placed = [(i, *near(v)[::-1]) for i, v in kept]
    per = {}
    for _, j, d in placed:
        per[j] = per.get(j, 0) + d
    total = sum(per.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, j, d, per[j], total, digest[j]) for i, j, d in placed), key=repr)


def vectors(n, seed=0, spread=0.1, middles=5, at=None):
    rng = np.random.default_rng(seed)
    mid = rng.normal(0, 1, (middles, 64))
    return [(i, [float(np.float32(c)) for c in mid[i % middles] + rng.normal(0, spread, 64)], 0) for i in range(n)]


def found(spark, rows, tmp_path, partitions=4):
    where = str(tmp_path / "t")
    spark.createDataFrame(rows, SCHEMA).repartition(partitions).write.parquet(f"{where}/embeddings.parquet")
    got = queries.op13_centroids(spark, where)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_equals_plain_clusters(spark, tmp_path):
    rows = vectors(300)
    rows += [(900 + i, rows[7][1], 1) for i in range(150)]  # many equal vectors
    rows += [(7, rows[8][1], 1), (None, rows[9][1], 1)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [1.0] * 63, 1), (1003, [1.0] * 65, 1), (1004, [float("nan")] + [0.0] * 63, 1),
             (1005, [float("inf")] + [0.0] * 63, 1), (1006, [None] + [0.0] * 63, 1)]
    assert found(spark, rows, tmp_path) == plain(rows)


def test_ties_go_to_the_smaller_number(spark, tmp_path):
    """All vectors equal: 40 equal centroids, all in cluster 0."""
    rows = [(i, [0.25] * 64, 0) for i in range(60)]
    got = found(spark, rows, tmp_path)
    assert got == plain(rows) and {r[1] for r in got} == {0}


@pytest.mark.parametrize("n", [0, 1, 13])
def test_few_vectors(spark, tmp_path, n):
    rows = vectors(n, seed=2)
    assert found(spark, rows, tmp_path, 1) == plain(rows)


def test_far_vector_and_clashing_names(spark):
    rows = [(str(i), [0.5 * i] * 64, i, 1) for i in range(5)] + [("far", [1e30] * 64, 0, 1)]
    df = spark.createDataFrame(rows, "cluster string, x array<double>, distance int, `a.b` int")
    out, centers = centroids.cluster(df, k=2, id_col="cluster", vector_col="x")
    got = {r.vec_id: r for r in out.collect()}
    assert len(got) == 6 and got["far"].cluster is None and got["far"].distance is None and centers.shape == (2, 64)


@pytest.mark.parametrize("scale", [1, 1 << 20])
def test_candidates_hold_the_nearest(scale):
    """Boxes never exclude the nearest centroid, also with values whose sums
    need whole numbers instead of doubles; near neighbours are excluded a lot."""
    rng = np.random.default_rng(4)
    mid = rng.integers(-300, 300, (12, 64)) * scale // 3
    few = []
    for _ in range(50):
        points = mid[rng.integers(12)] + rng.integers(-20, 21, (30, 64)) * scale // 3
        lo, hi = points.min(0), points.max(0)
        some = centroids.candidates(lo, hi, mid)
        near, d = centroids.nearest(points, lo, hi, mid)
        exact = ((points[:, None].astype(object) - mid[None].astype(object)) ** 2).sum(2)
        assert (near == exact.argmin(1)).all() and (d == exact.min(1)).all()
        few.append(len(some))
    assert np.mean(few) < 3


def test_hilbert_neighbours_touch():
    """The curve visits every cell once, one step at a time."""
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
        keys = centroids.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        walk = grid[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
