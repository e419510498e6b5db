"""Centroid clustering with annulus search, in whole numbers.

Components become floor(scale * x), so distances, sums and means are exact and every run gives the same clusters. The
centroids are sorted by norm. A vector's distance to the centroid of nearest norm bounds its distance to the nearest one,
and by the triangle inequality no centroid outside the annulus of that width around the vector's norm can be as near. The
annulus is found by binary search, and the centroids in it are compared exactly, those at the same distance too: of these
the smaller number wins. Norms are rounded square roots, so the annulus is a little wider than the bound; it never leaves
out a centroid at the boundary.

A round reads the vectors once. Tasks add up their vectors by cluster, so what is shuffled is k rows of sums for each
Arrow batch's task and what comes to the driver is k centroids, whatever the size of a cluster.

Defined results: vectors with a null, NaN or infinite component or another number of components are left out, as are null
vectors; no vector left gives an empty result; fewer than k vectors give as many centroids; vectors that repeat count as
often as they occur; a null vec_id is no first centroid while other vectors are left, and equal hashes go by the vector;
ties of distance go to the smaller cluster; a component beyond 2^26 after scaling is an error, as distances would pass 64
bits; all columns but vec_id and the vector are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch, bounded_batches

K, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
LARGEST = 1 << 26


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x in double precision."""
    number = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    fits = lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) <= LARGEST
    return F.transform(vector, lambda x: F.when(fits(x), number(x)).otherwise(F.raise_error(F.lit("a component is too large")).cast("long")).cast("int"))


def usable(vector: Column, dims: int = DIMS) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False))), F.lit(False))


def kept(vectors: DataFrame, vector: str = "embedding", id_: str = "vec_id", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<int>) of the vectors that can be clustered."""
    v = F.col(f"`{vector}`")
    return vectors.select(F.col(f"`{id_}`").cast("long").alias("vec_id"), F.when(usable(v, dims), whole(v, scale)).alias("x")).where("x IS NOT NULL")


def first_centroids(points: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k points of smallest hash of their ids, in its order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = points.select(key.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The cluster of each row of x, its squared distance, and how many distances were worked out."""
    norms = np.sqrt(np.einsum("ij,ij->i", centroids, centroids).astype(float))
    order = np.argsort(norms, kind="stable")
    norms, sorted_centroids = norms[order], centroids[order]
    own = np.sqrt(np.einsum("ij,ij->i", x, x).astype(float))

    def distance(rows: np.ndarray, place: int) -> np.ndarray:
        d = x[rows] - sorted_centroids[place]
        return np.einsum("ij,ij->i", d, d)

    at = np.searchsorted(norms, own)
    left, right = np.maximum(at - 1, 0), np.minimum(at, len(norms) - 1)
    guess = np.where(np.abs(norms[left] - own) <= np.abs(norms[right] - own), left, right)
    best = np.empty(len(x), np.int64)
    for place in np.unique(guess):
        rows = np.flatnonzero(guess == place)
        best[rows] = distance(rows, place)
    cluster = order[guess].astype(np.int64)
    bound = np.sqrt(best.astype(float))
    slack = 1e-9 * (1.0 + own + bound)  # far above the rounding of square roots
    lo, hi = np.searchsorted(norms, own - bound - slack, "left"), np.searchsorted(norms, own + bound + slack, "right")
    done = len(x)
    for place in range(int(lo.min(initial=len(norms))), int(hi.max(initial=0))):
        rows = np.flatnonzero((lo <= place) & (place < hi) & (guess != place))
        d, number = distance(rows, place), order[place]
        better = (d < best[rows]) | (d == best[rows]) & (number < cluster[rows])
        best[rows[better]], cluster[rows[better]] = d[better], number
        done += len(rows)
    return cluster, best, done


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of each cluster's vectors; an empty one stays."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            cluster, _, _ = nearest(x, centroids)
            counts += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                sums[c] += x[cluster == c].sum(axis=0)
        own = np.flatnonzero(counts)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, dims), pa.int32()), pa.array(np.tile(np.arange(dims), len(own)), pa.int32()), pa.array(sums[own].reshape(-1)), pa.array(np.repeat(counts[own], dims))], names=["cluster", "dim", "s", "n"])

    parts = points.select("x").mapInArrow(run, "cluster int, dim int, s long, n long")
    new = centroids.copy()
    for r in parts.groupBy("cluster", "dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toLocalIterator():
        new[r["cluster"], r["dim"]] = r["s"] // r["n"]
    return new


def assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance)."""
    dims = centroids.shape[1] if centroids.size else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = nearest(_matrix(batch.column(1), dims), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return points.select("vec_id", "x").mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, vector: str = "embedding", id_: str = "vec_id", dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    spark = vectors.sparkSession
    bounded_batches(spark, records=10_000)
    scratch = Scratch(spark, "centroids")
    points = scratch.write(kept(vectors, vector, id_, dims, scale), "points")
    centroids = first_centroids(points, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(points, centroids)
    rows = scratch.write(assigned(points, centroids), "assigned")
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    names = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    known = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    about = sums.join(F.broadcast(known), "cluster").crossJoin(F.broadcast(sums.agg(F.sum("cluster_inertia").alias("inertia"))))  # one row beside k rows
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round_sql(i: int) -> str:
    """Assignment to centroids c{i} as a{i}, then the next centroids."""
    near = f"""a{i} AS (
  SELECT rid, vec_id, x, d AS distance, c AS cluster FROM (
    SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, c) AS rn FROM (
      SELECT p.rid, p.vec_id, p.x, c.c, list_sum(list_transform(list_zip(p.x, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM points p, c{i} c)) WHERE rn = 1
)"""
    if i == ROUNDS:
        return near
    return f"""{near}, m{i} AS (
  SELECT cluster, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY dim) AS v
  FROM (SELECT cluster, dim, sum(xi)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS xi, unnest(range(1, {DIMS + 1})) AS dim FROM a{i}) GROUP BY cluster, dim) GROUP BY cluster
), c{i + 1} AS (
  SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.c
)"""


OP12_SQL = f"""
WITH points AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIMS}
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS c, x AS v FROM points ORDER BY sha256('{SEED}:' || vec_id), x LIMIT {K}
), {", ".join(map(_round_sql, range(ROUNDS + 1)))}
SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c = cluster
"""
