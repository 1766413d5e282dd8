"""Exact k-means over integer vectors with space-filling-curve zone maps.

Vectors are sorted along a Hilbert curve and written in blocks of up to
``BLOCK`` neighbours with the least and greatest value of every component (the
block's box).  In each round a block is compared with the centroids' bounds
first: a centroid is no candidate if its least distance to the box exceeds
another one's greatest distance, or if it is farther than the centroid of
that least bound at every point of the box (the difference of two squared
distances is linear, so its least value over a box is exact).  The candidates
that stay are compared exactly with every vector of the block.

All distances, sums and means are exact integers.  A round sends the k
centroids to the tasks and gets k rows of sums back, whatever the number of
vectors.

Defined results: vectors of another length, and those with a null or
non-finite component, are left out; a vector with a component whose integer is
beyond +-2^27, whose distances a long could not hold, stays in the result with
null cluster and distance and takes no part; rows that repeat an id are
vectors of their own; a null id hashes as the empty text and sorts by its
components among equal hashes; with fewer vectors than k, each is a centroid;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.llm.shared import written

BLOCK = 256
#: Integer components are kept within this bound, so that squared distances fit a long.
BOUND = 1 << 27
#: Up to this bound all sums of products of ``DIMS`` components are exact in doubles.
EXACT = 1 << 22
#: The curve runs through this many components, those of greatest spread, by so many bits each.
CURVE_DIMS, CURVE_BITS = 15, 4


def integer_vectors(vectors: DataFrame, vector_col: str, id_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, x, far) of the vectors that count; x: floor(scale * component)."""
    v = F.col(f"`{vector_col}`")
    x = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.transform(v, lambda c: c.cast("double")).alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = x.filter(F.col("v").isNotNull() & (F.size("v") == dims) & ~bad)
    x = x.withColumn("far", F.exists("v", lambda c: F.abs(c * scale) >= BOUND))
    return x.select("vec_id", F.when(~F.col("far"), F.transform("v", lambda c: F.floor(c * scale))).alias("x"), "far")


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with non-negative integer
    coordinates below 2 ** bits; one row per point (Skilling's method over
    whole columns)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def _spread(points: DataFrame, dims: int) -> list:
    """Least and greatest value, mean and variance of every component."""
    def work(batches):
        import pyarrow as pa

        for b in batches:
            m = _matrix(b.column(0), dims).astype(np.float64)
            if len(m):
                yield pa.RecordBatch.from_arrays([pa.array([a.tolist()]) for a in (m.min(0), m.max(0), m.sum(0), (m * m).sum(0))]
                                                 + [pa.array([len(m)], pa.int64())], names=["lo", "hi", "s", "ss", "n"])
    parts = points.select("x").mapInArrow(
        work, "lo array<double>, hi array<double>, s array<double>, ss array<double>, n long")
    each = parts.select("n", F.posexplode(F.arrays_zip("lo", "hi", "s", "ss")).alias("dim", "v"))
    return each.groupBy("dim").agg(F.min("v.lo").alias("lo"), F.max("v.hi").alias("hi"), F.sum("v.s").alias("s"),
                                   F.sum("v.ss").alias("ss"), F.sum("n").alias("n")).orderBy("dim").collect()


def zone_map(points: DataFrame, dims: int) -> DataFrame:
    """(n, lo, hi, points, ids): blocks of Hilbert neighbours, packed."""
    spread = _spread(points, dims)
    lo = np.array([r.lo for r in spread] or [0.0] * dims)
    width = np.array([r.hi - r.lo for r in spread] or [0.0] * dims) + 1.0
    variance = np.array([r.ss / r.n - (r.s / r.n) ** 2 for r in spread] or [0.0] * dims)
    axes = np.argsort(-variance, kind="stable")[:CURVE_DIMS]
    cells = 1 << CURVE_BITS

    def keys(batches):
        import pyarrow as pa

        for b in batches:
            m = _matrix(b.column("x"), dims)[:, axes]
            c = np.clip(np.floor((m - lo[axes]) * (cells / width[axes])), 0, cells - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hilbert_keys(c, CURVE_BITS))], names=["vec_id", "x", "key"])

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            m = _matrix(b.column("x"), dims)
            for at in range(0, len(m), BLOCK):
                p = m[at:at + BLOCK]
                row = [[len(p)], [p.min(0).tobytes()], [p.max(0).tobytes()], [p.astype("<i4").tobytes()]]
                types = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                ids = b.column("vec_id").slice(at, BLOCK)
                ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays([ids]))
                yield pa.RecordBatch.from_arrays([*[pa.array(v, t) for v, t in zip(row, types, strict=True)], ids],
                                                 names=["n", "lo", "hi", "points", "ids"])

    id_type = points.schema["vec_id"].dataType.simpleString()
    placed = points.select("vec_id", "x").mapInArrow(keys, f"vec_id {id_type}, x array<long>, key long")
    # equal vectors share a key; where they were read spreads them
    placed = placed.withColumn("read", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange("key", "read").sortWithinPartitions("key", "read").select("vec_id", "x")
    return written(ordered.mapInArrow(pack, f"n int, lo binary, hi binary, points binary, ids array<{id_type}>"), "zone-map")


def candidates(lo: np.ndarray, hi: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a point of the box."""
    below, above = lo - centers, centers - hi
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(1)
    most = (np.maximum(np.abs(lo - centers), np.abs(hi - centers)) ** 2).sum(1)
    best = int(np.argmin(most))
    ok = least <= most[best]
    w = centers - centers[best]
    norms = (centers ** 2).sum(1)
    nearer = norms - norms[best] - 2 * np.maximum(lo * w, hi * w).sum(1)
    return np.flatnonzero(ok & (nearer <= 0))


def nearest(points: np.ndarray, lo: np.ndarray, hi: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the least number among equals) and squared distance
    of every point, exactly."""
    some = candidates(lo, hi, centers)
    c = centers[some]
    exact = max(np.abs(lo).max(), np.abs(hi).max(), np.abs(c).max()) <= EXACT
    kind = np.float64 if exact and points.shape[1] <= 64 else np.int64
    p, c = points.astype(kind), c.astype(kind)
    d = (c * c).sum(1) - 2 * (p @ c.T)
    best = d.argmin(1)
    away = d[np.arange(len(d)), best] + (p * p).sum(1)
    return some[best], away.astype(np.int64)


def _blocks(batches, dims: int):
    for b in batches:
        for lo, hi, points in zip(*[b.column(c).to_pylist() for c in ("lo", "hi", "points")], strict=True):
            yield (np.frombuffer(points, "<i4").astype(np.int64).reshape(-1, dims), np.frombuffer(lo, np.int64),
                   np.frombuffer(hi, np.int64))


def _sums(zones: DataFrame, centers: np.ndarray) -> list:
    """Vectors and component sums of every non-empty cluster: k rows at most."""
    k, dims = centers.shape

    def work(batches):
        import pyarrow as pa

        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for points, lo, hi in _blocks(batches, dims):
            near, _ = nearest(points, lo, hi, centers)
            order = np.argsort(near, kind="stable")
            at = np.flatnonzero(np.diff(near[order], prepend=-1))
            total[near[order][at]] += np.add.reduceat(points[order], at, axis=0)
            count += np.bincount(near, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))],
                                         names=["cluster", "n", "s"])
    parts = zones.select("lo", "hi", "points").mapInArrow(work, "cluster long, n long, s array<long>")
    total = [F.sum(F.col("s")[j].cast("decimal(38,0)")) for j in range(dims)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*total).alias("s")).collect()


def assign(zones: DataFrame, centers: np.ndarray, id_type: str) -> DataFrame:
    """(vec_id, cluster, distance) of every vector of the zone map."""
    def work(batches):
        import pyarrow as pa

        for b in batches:
            ids = b.column("ids").flatten()
            found = [nearest(*block, centers) for block in _blocks([b], centers.shape[1])]
            if found:
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([f[0] for f in found]), pa.int32()),
                                                  pa.array(np.concatenate([f[1] for f in found]))],
                                                 names=["vec_id", "cluster", "distance"])
    return zones.mapInArrow(work, f"vec_id {id_type}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:",
            id_col: str = "vec_id", vector_col: str = "embedding",
            watch: Callable[[int, np.ndarray], None] | None = None) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)
    of every vector that counts, and the k final centroids.

    The first centroids are the k vectors of least sha256 of ``seed`` and
    their id; ``watch`` is called with every round's centroids.
    """
    spark = vectors.sparkSession
    points = integer_vectors(vectors, vector_col, id_col, dims, scale)
    id_type = points.schema["vec_id"].dataType.simpleString()
    near = points.filter("NOT far")
    first = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = near.select(first.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    centers = np.array([r.x for r in start], np.int64).reshape(-1, dims)
    tail = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    far = points.filter("far").select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"),
        ("centroid_sha256", "string"))])
    if not len(centers):
        return far, centers
    zones = zone_map(near, dims)
    for r in range(rounds):
        if watch:
            watch(r, centers)
        centers = centers.copy()
        for row in _sums(zones, centers):
            centers[row.cluster] = [int(s) // row.n for s in row.s]
    placed = written(assign(zones, centers, id_type), "clusters")
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    total = sum(int(r.s) for r in sums)
    facts = [(r.cluster, int(r.s), total, hashlib.sha256(",".join(map(str, centers[r.cluster].tolist())).encode()).hexdigest())
             for r in sums]
    # one row for each of the k clusters
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    columns = [c.strip() for c in tail.split(",")]
    return placed.join(F.broadcast(named), "cluster").select(*columns).unionByName(far), centers
