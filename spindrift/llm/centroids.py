"""Operator 13, centroid clustering: k-means in exact integers, with a table of distances to fixed pivots (LAESA).

Vectors become integers, floor(scale * x). The rows of the pivot table, written once, are a vector and its distances to
a few fixed pivots. In each round the centroids' distances to the same pivots are told once; by the triangle inequality
the difference of two pivot distances is a lower bound of the distance between vector and centroid. A vector's distance
to the centroid of the least bound is told exactly, and of the others only those whose bound doesn't exceed it. Each
task sums up its vectors by centroid, so a round moves one row a task and centroid, and the driver holds k centroids.

Pivots come from the `PIVOT_SAMPLE` vectors of smallest hash, each next one farthest from those chosen; they only steer
how much is skipped, never the result, as bounds are loosened by more than their rounding.

Defined results: vectors of another number of components, null vectors, and those with a component that is null, not
finite or beyond 2^27 / scale in size (whose squared distances pass 64 bits) are left out. A null vec_id hashes like an
empty one; rows that share a vec_id are vectors of their own, told apart by their components where they become
centroids. With fewer vectors than k, all are centroids; without any, the result is empty. A sum of distances beyond
64 bits is null. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

#: Vectors of which the pivots are chosen.
PIVOT_SAMPLE = 256
#: What a bound of float distances is loosened by, in parts of them.
SLACK = 1e-9


def whole_vectors(vectors: DataFrame, scale: int, width: int) -> DataFrame:
    """(vec_id, q) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 2**27 / scale)
    rows = vectors.select("vec_id", x.alias("x")).where((F.size("x") == width) & F.forall("x", fine))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("x", lambda v: F.floor(v * scale).cast("int")).alias("q"))


def seed_hash(vec_id: Column) -> Column:
    return F.sha2(F.concat(F.lit("1:"), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)


def squared(q: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to a point."""
    step = q - point
    return np.einsum("ij,ij->i", step, step)


def choose_pivots(sample: np.ndarray, many: int) -> np.ndarray:
    """`many` rows of the sample, each next one farthest from those before it; fewer if no other is left."""
    chosen, far = [0], squared(sample, sample[0])
    while len(chosen) < many and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squared(sample, sample[chosen[-1]]))
    return sample[chosen]


def to_pivots(q: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(q, p) for p in pivots], axis=1).astype(np.float64))


def nearest(q: np.ndarray, to: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance to it) of each row, ties to the smaller number, and how many distances were told."""
    centre = to_pivots(centroids, pivots)
    bound = np.zeros((len(q), len(centroids)))
    for p in range(len(pivots)):
        a, b = to[:, p, None], centre[None, :, p]
        np.maximum(bound, np.abs(a - b) - SLACK * (a + b), out=bound)
    bound *= bound * (1 - SLACK)
    best = bound.argmin(axis=1)
    first, least, told = best.copy(), np.empty(len(q), np.int64), len(q)
    for c in range(len(centroids)):
        mine = np.flatnonzero(first == c)
        least[mine] = squared(q[mine], centroids[c])
    for c in range(len(centroids)):
        open_ = np.flatnonzero((first != c) & (bound[:, c] <= least))
        d = squared(q[open_], centroids[c])
        told += len(open_)
        wins = (d < least[open_]) | ((d == least[open_]) & (c < best[open_]))
        best[open_[wins]], least[open_[wins]] = c, d[wins]
    return best, least, told


def _matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1)


def pivot_table(kept: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, q, to), stored: `to` are the vector's distances to the pivots."""

    def measure(batches):
        for batch in batches:
            if len(batch):
                to = to_pivots(_matrix(batch.column(1), np.int64), pivots)
                held = pa.ListArray.from_arrays(pa.array(np.arange(len(to) + 1) * len(pivots), pa.int32()), pa.array(to.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), held], ["vec_id", "q", "to"])

    return stored(kept.mapInArrow(measure, "vec_id long, q array<int>, to array<double>"), "pivots")


def moved(rows: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, width = centroids.shape

    def sums(batches):
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if len(batch):
                q = _matrix(batch.column(0), np.int64)
                best, _, _ = nearest(q, _matrix(batch.column(1), np.float64), centroids, pivots)
                np.add.at(total, best, q)
                count += np.bincount(best, minlength=k)
        mine = np.flatnonzero(count)
        held = pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1) * width, pa.int32()), pa.array(total[mine].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(mine.astype(np.int32)), pa.array(count[mine]), held], ["cluster", "n", "s"])

    parts = rows.select("q", "to").mapInArrow(sums, "cluster int, n long, s array<long>")
    whole = [F.sum(F.col("s")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(width)]
    out = [[int(x) for x in c] for c in centroids]
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *whole).collect():  # a row a centroid
        out[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    return np.array(out, np.int64)


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, width: int = 64, pivots: int = 8) -> DataFrame:
    """One row a vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    kept = whole_vectors(vectors, scale, width)
    first = kept.orderBy(seed_hash(F.col("vec_id")), "q").limit(max(k, PIVOT_SAMPLE)).select("q").collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    sample = np.array([r.q for r in first], np.int64)
    fixed, centroids = choose_pivots(sample, pivots), sample[:k]
    rows = pivot_table(kept, fixed)
    for _ in range(rounds):
        centroids = moved(rows, centroids, fixed)

    def settle(batches):
        for batch in batches:
            if len(batch):
                best, least, _ = nearest(_matrix(batch.column(1), np.int64), _matrix(batch.column(2), np.float64), centroids, fixed)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(least)], ["vec_id", "cluster", "distance"])

    out = stored(rows.select("vec_id", "q", "to").mapInArrow(settle, "vec_id long, cluster int, distance long"), "clusters")
    found = {r.cluster: int(r.d) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    fits = lambda n: n if n < 2**63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    about = [(c, fits(found.get(c, 0)), digest(x)) for c, x in enumerate(centroids.tolist())]
    named = spark.createDataFrame(about, "of int, cluster_inertia long, centroid_sha256 string")
    met = out.join(F.broadcast(named), F.col("cluster") == F.col("of"))  # k rows
    return met.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(fits(sum(found.values()))).cast("long").alias("inertia"), "centroid_sha256")


def op13_centroids(spark, sf_dir) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _oracle(k: int = 16, rounds: int = 3) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, min(CAST(d AS HUGEINT) * {k} + cluster) AS m FROM (
    SELECT r, cluster, list_sum(list_transform(range(1, 65), lambda i: (q[i] - c[i]) * (q[i] - c[i])))::HUGEINT AS d
    FROM kept, c{i}) GROUP BY r
)""")
        if i < rounds:
            steps.append(f"""
s{i} AS (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
    SELECT (m % {k})::INT AS cluster, i, sum(q[i])::HUGEINT AS s, count(*)::HUGEINT AS n
    FROM kept JOIN a{i} USING (r), range(1, 65) AS t(i) GROUP BY 1, 2) GROUP BY cluster
), c{i + 1} AS MATERIALIZED (
  SELECT c{i}.cluster, coalesce(s{i}.c, c{i}.c::HUGEINT[]) AS c FROM c{i} LEFT JOIN s{i} USING (cluster)
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x) AND abs(x::DOUBLE) < 2097152, false))) = 64
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), q) - 1)::INT AS cluster, q AS c FROM kept
  QUALIFY cluster < {k}
),{",".join(steps)}
SELECT vec_id, (m % {k})::INT AS cluster, (m // {k})::BIGINT AS distance, (sum(m // {k}) OVER (PARTITION BY m % {k}))::BIGINT AS cluster_inertia,
       (sum(m // {k}) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} USING (r) JOIN c{rounds} ON c{rounds}.cluster = (m % {k})::INT
"""


#: In SQL by brute force: all distances of each round.
ORACLE = _oracle()
