"""Centroid clustering of integer vectors by k-means with Elkan's bounds.

Each vector keeps its centroid, an upper bound of the distance to it and a lower bound of the distance to every centroid. A distance is computed only where
neither the lower bound nor half the distance between two centroids says that it cannot matter. Bounds are floats rounded away from the distance and pruning
is strict, so that a tie is never pruned; what decides between two centroids are exact integers. A round is one pass over the kept vectors into a new table in
the shared folder, and a second one that sums the vectors of each centroid; only the k sums, of which the new centroids are made, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import drop_written, small_batches, written

#: Integer components beyond this are an error: the squared distance of 64 such components still fits a long.
MOST = 1 << 27
STATE = "cluster int, upper float, lower array<float>"


def quantized(vector: Column, dimensions: int, scale: int) -> Column:
    """floor(scale * x) of each component, as integers; null for a vector of another length or with components that are null or not finite."""
    x = vector.cast("array<double>")
    whole = (F.size(x) == dimensions) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    beyond = F.raise_error(F.concat(F.lit(f"a component is beyond {MOST} / {scale}: "), F.array_max(F.transform(x, F.abs)).cast("string")))
    inside = F.forall(x, lambda v: F.abs(v * scale) < MOST)
    return F.when(F.coalesce(whole, F.lit(False)), F.when(inside, F.transform(x, lambda v: F.floor(v * scale).cast("int"))).otherwise(beyond.cast("array<int>")))


def rows_of(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def above(x: np.ndarray) -> np.ndarray:
    """Floats that are not below: two steps up for the roundings of the square root and of the float."""
    return np.nextafter(np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(np.inf)), np.float32(np.inf))


def below(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(-np.inf)), np.float32(-np.inf)), np.float32(0))


class Elkan:
    """The centroids of a round, how far each has moved since the round before, and half the distances between them."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids = centroids.astype(np.int64)
        self.moved = above(np.sqrt(squared(self.centroids, before.astype(np.int64)).astype(np.float64))) if before is not None else np.zeros(len(centroids), np.float32)
        between = np.array([np.sqrt(squared(self.centroids, c).astype(np.float64)) for c in self.centroids])
        self.half = below(between / 2)
        apart = self.half + np.diag(np.full(len(centroids), np.inf, np.float32))
        self.nearest = apart.min(axis=1)

    def bounds(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of vectors that are new: the first centroid, with bounds that say nothing."""
        return np.zeros(n, np.int32), np.full(n, np.inf, np.float32), np.zeros((n, len(self.centroids)), np.float32)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The nearest centroid of each vector, of equal ones that of the smaller number, with bounds that hold for these centroids; and how many distances it took."""
        cluster, lower = cluster.copy(), below(lower.astype(np.float64) - self.moved)
        upper = above(upper.astype(np.float64) + self.moved[cluster])
        rows = np.flatnonzero(upper >= self.nearest[cluster])  # strictly below: no other centroid is as near
        some = (lower[rows] <= upper[rows, None]) & (self.half[cluster[rows]] <= upper[rows, None])
        some[np.arange(len(rows)), cluster[rows]] = False
        rows = rows[some.any(axis=1)]
        now, best, u, low = x[rows], cluster[rows], upper[rows], lower[rows]
        exact = squared(now, self.centroids[best])
        distances = len(rows)
        root = np.sqrt(exact.astype(np.float64))
        u, low[np.arange(len(rows)), best] = above(root), below(root)
        for j, centroid in enumerate(self.centroids):
            ask = np.flatnonzero((best != j) & (low[:, j] <= u) & (self.half[best, j] <= u))
            if not len(ask):
                continue
            d = squared(now[ask], centroid)
            distances += len(ask)
            root = np.sqrt(d.astype(np.float64))
            low[ask, j] = below(root)
            wins = (d < exact[ask]) | ((d == exact[ask]) & (j < best[ask]))
            won = ask[wins]
            best[won], exact[won], u[won] = j, d[wins], above(root[wins])
        cluster[rows], upper[rows], lower[rows] = best, u, low
        return cluster, upper, lower, distances


def _first(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest hash of their ids, of equal hashes those of smaller components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r.v for r in kept.orderBy(order, "v").select("v").limit(k).collect()], np.int64)


def _assigned(state: DataFrame, elkan: Elkan, dimensions: int) -> DataFrame:
    k, fresh = len(elkan.centroids), "cluster" not in state.columns
    own = state.sparkSession.sparkContext.broadcast(elkan)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        elkan = own.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = rows_of(batch.column("v"), dimensions, np.int64)
            known = elkan.bounds(len(x)) if fresh else (batch.column("cluster").to_numpy(), batch.column("upper").to_numpy(), rows_of(batch.column("lower"), k, np.float32))
            cluster, upper, lower, _ = elkan.assign(x, *known)
            ends = pa.array(np.arange(0, k * len(x) + 1, k, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("v"), pa.array(cluster), pa.array(upper), pa.ListArray.from_arrays(ends, pa.array(lower.reshape(-1)))], ["key", "v", "cluster", "upper", "lower"])

    return state.mapInArrow(assign, f"key {state.schema['key'].dataType.simpleString()}, v array<int>, {STATE}")


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of the mean of each centroid's vectors; a centroid without vectors stays. Sums are of long integers, beyond which Spark raises an error."""
    dimensions = centroids.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            x, cluster = rows_of(batch.column("v"), dimensions, np.int64), batch.column("cluster").to_numpy()
            for j in np.unique(cluster):
                sums[j] += x[cluster == j].sum(axis=0)
            n += np.bincount(cluster, minlength=len(n))
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n[held]), pa.array(sums[held].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = state.select("v", "cluster").mapInArrow(add, "cluster int, n long, sums array<long>")
    total = parts.select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = centroids.copy()
    for r in total.collect():
        out[r.cluster, r.i] = r.x // r.n
    return out


def cluster_vectors(df: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, scale: int = 64, dimensions: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id (the key), cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector of `dimensions` finite components.

    Components are floor(scale * x). Centroids begin as the k vectors whose keys have the smallest hashes; `rounds` times all vectors go to the nearest one and each
    centroid becomes the floor of its vectors' mean, then vectors are assigned once more. Rows with another number of components, with null or not finite ones, or
    without a vector, are left out. Repeated rows count as often as they are there; null keys are hashed as the empty text; with fewer vectors than k there are as many
    centroids as vectors, with none the result is empty. Equal centroids and other ties: the smaller number. Components beyond 2 ** 27 are an error. Other columns
    are ignored.
    """
    spark = df.sparkSession
    kept = small_batches(df).select(F.col(key).alias("key"), quantized(F.col(vector), dimensions, scale).alias("v")).where("v is not null")
    centroids, before, state = _first(kept, k, seed), None, kept
    if not len(centroids):
        return spark.createDataFrame([], f"{key} {df.schema[key].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        after = written(_assigned(state, Elkan(centroids, before), dimensions), "assigned")
        if state is not kept:
            drop_written(state)
        state, before, centroids = after, centroids, _means(after, centroids)

    last, final = spark.sparkContext.broadcast(Elkan(centroids, before)), _assigned(state, Elkan(centroids, before), dimensions) if rounds else _assigned(kept, Elkan(centroids), dimensions)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = last.value.centroids
        for batch in batches:
            if batch.num_rows:
                own = batch.column("cluster")
                d = squared(rows_of(batch.column("v"), dimensions, np.int64), known[own.to_numpy()])
                yield pa.RecordBatch.from_arrays([batch.column("key"), own, pa.array(d)], ["key", "cluster", "distance"])

    placed = written(final.select("key", "cluster", "v").mapInArrow(measured, f"key {df.schema[key].dataType.simpleString()}, cluster int, distance long"), "placed")
    if state is not kept:
        drop_written(state)
    sums = {r.cluster: int(r.d) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    named = [(j, d, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, d in sums.items()]
    table = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(table), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same by plain SQL: every distance of every round.
ORACLE = f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v, sha256('1:' || vec_id::VARCHAR) AS h
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = 64
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v FROM (SELECT h, v FROM kept ORDER BY h, v LIMIT 16))
{''.join(f'''
, a{i} AS MATERIALIZED (
  SELECT vec_id, v, min(list_value(d, j)) AS n FROM (
    SELECT vec_id, kept.v, j, list_sum(list_transform(list_zip(kept.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{i} c
  ) GROUP BY vec_id, v
)''' + (f'''
, m{i} AS (SELECT j, i, CAST(floor_s AS BIGINT) AS x FROM (
    SELECT j, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_s FROM (SELECT n[2] AS j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY j, i))
, c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT j, list(x ORDER BY i) AS v FROM m{i} GROUP BY j) m USING (j))
''' if i < 3 else '') for i in range(4))}
SELECT vec_id, n[2]::INTEGER AS cluster, n[1] AS distance, (sum(n[1]) OVER (PARTITION BY n[2]))::BIGINT AS cluster_inertia, (sum(n[1]) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c3.j = n[2]
"""
