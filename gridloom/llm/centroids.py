"""Centroid clustering by plain Lloyd rounds in whole numbers.

Vectors become whole numbers, floor(scale * x). Each round sends the centroids to all tasks, which take the squared differences to one centroid after another
in numpy and the least of them, the lowest number on a tie. A task gives a row for each cluster that it met: how many, their components' sums and their distances' sum. These
rows alone are shuffled, and merge by cluster; the driver sees a row for each cluster, k * dims numbers. All is exact, so neither partitions nor retries change a result.

Kept are vectors with exactly `dims` components, none null, NaN or infinite; others have no row. Components are held within +-MOST, so that a distance fits a long (at the scale of
64, values of over two million). The first centroids are the vectors whose ids' hashes are least: ties, as of repeated ids, go by the components, and a null id hashes as an empty
one. With fewer than k vectors there are fewer centroids, with none no rows. Repeated rows each count. A cluster that nothing is nearest to keeps its centroid. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._shared import dropped, staged, table

K, DIMS, ROUNDS, SCALE, SEED = 16, 64, 3, 64, 1
#: The greatest component: with it, 64 squared differences sum to less than 2 ** 63.
MOST = 1 << 27


class Clustering(NamedTuple):
    """rows: vec_id, cluster, distance of each vector; centroids, and the distance summed over each cluster."""

    rows: DataFrame
    centroids: np.ndarray
    inertia: list[int]


def whole_numbers(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id, v (the components as 32-bit integers, in bytes) of the vectors that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            fits = lists.is_valid().to_numpy(zero_copy_only=False) & (np.asarray(lists.value_lengths().fill_null(-1)) == dims)
            own = batch.filter(pa.array(fits))
            flat = own.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # a null is NaN
            finite = np.isfinite(flat).all(axis=1)
            v = np.floor(np.clip(flat[finite] * scale, -MOST, MOST)).astype("<i4")
            yield pa.RecordBatch.from_arrays([own.column(0).filter(pa.array(finite)), pa.array([r.tobytes() for r in v], pa.binary())], ["vec_id", "v"])

    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, v binary")


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<i4").reshape(-1, dims).astype(np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the lowest number on a tie, and its squared distance."""
    distances = np.empty((len(centroids), len(vectors)), dtype=np.int64)
    for k, c in enumerate(centroids):
        apart = vectors - c
        np.einsum("ij,ij->i", apart, apart, out=distances[k])
    best = distances.argmin(axis=0)  # the first of equals
    return best, distances[best, np.arange(len(vectors))]


def assigned(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of whole (vec_id, v)."""
    sent, dims = whole.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cluster, distance = nearest(_matrix(frame["v"], dims), sent.value)
            yield pd.DataFrame({"vec_id": frame["vec_id"], "cluster": cluster.astype(np.int32), "distance": distance})

    return whole.mapInPandas(run, f"vec_id {whole.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def summed(whole: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, int, list[int]]]:
    """cluster, vectors, summed distance and summed components of each cluster that isn't empty."""
    sent, (k, dims) = whole.sparkSession.sparkContext.broadcast(centroids), centroids.shape

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, inertia, sums = np.zeros(k, dtype=np.int64), [0] * k, np.zeros((k, dims), dtype=np.int64)
        for frame in frames:
            own = _matrix(frame["v"], dims)
            cluster, distance = nearest(own, sent.value)
            for c in np.unique(cluster):
                of = cluster == c
                count[c] += of.sum()
                inertia[c] += sum(distance[of].tolist())  # may leave 64 bits
                sums[c] += own[of].sum(axis=0)
        met = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": met.astype(np.int32), "n": count[met], "inertia": [str(inertia[c]) for c in met], "sums": [sums[c] for c in met]})

    big = "decimal(38,0)"
    parts = whole.select("v").mapInPandas(run, "cluster int, n long, inertia string, sums array<long>")
    merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("inertia").cast(big)).alias("inertia"), *[F.sum(F.col("sums")[i].cast(big)).alias(f"s{i}") for i in range(dims)])
    return [(r["cluster"], r["n"], int(r["inertia"]), [int(r[f"s{i}"]) for i in range(dims)]) for r in merged.collect()]  # a row for each cluster


def lloyd(vectors: DataFrame, k: int = K, dims: int = DIMS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> Clustering | None:
    """vectors (vec_id, embedding) in k clusters after so many rounds; None where no vector is kept. k * dims numbers are sent to all tasks in each round."""
    spark = vectors.sparkSession
    whole, path = staged(whole_numbers(vectors, dims, scale), "vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = whole.select("v", digest.alias("digest")).orderBy("digest", "v").limit(k).collect()
    if not first:
        dropped(spark, path)
        return None
    centroids = np.stack([np.frombuffer(r["v"], dtype="<i4") for r in first]).astype(np.int64)
    for _ in range(rounds):
        for cluster, n, _, sums in summed(whole, centroids):
            centroids[cluster] = [s // n for s in sums]  # floor, also below zero
    inertia = [0] * len(centroids)
    for cluster, _, own, _ in summed(whole, centroids):
        inertia[cluster] = own
    return Clustering(assigned(whole, centroids), centroids, inertia)


def op12_lloyd_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector's cluster, with its cluster's digest and inertia. A sum of distances that a long can't hold is null."""
    made = lloyd(table(spark, sf_dir, "embeddings"))
    shape = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if made is None:
        return spark.createDataFrame([], shape)
    total, of = sum(made.inertia), F.col("cluster")
    fits = lambda n: F.lit(n if n < 1 << 63 else None).cast("long")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in made.centroids.tolist()]
    by_cluster = lambda values: F.element_at(F.array(*values), of + 1)
    return made.rows.select("vec_id", "cluster", "distance", by_cluster([fits(n) for n in made.inertia]).alias("cluster_inertia"), fits(total).alias("inertia"), by_cluster([F.lit(d) for d in digests]).alias("centroid_sha256"))


def _round_sql(i: int) -> str:
    """SQL of the i-th assignment, and of the centroids that it gives."""
    return f"""
a{i} AS (SELECT vec_id, v, cluster, distance FROM (SELECT kept.vec_id, kept.v, c.cluster, list_sum(list_transform(list_zip(kept.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM kept CROSS JOIN c{i} c)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1),
m{i} AS (SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, {DIMS + 1})) AS i FROM a{i}) GROUP BY cluster, i),
c{i + 1} AS (SELECT c.cluster, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM m{i} GROUP BY cluster) n USING (cluster))"""


ORACLE_SQL = f"""
WITH raw AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
kept AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: CAST(floor({SCALE} * x) AS BIGINT)) AS v FROM raw WHERE len(e) = {DIMS} AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS cluster, v FROM kept ORDER BY sha256('{SEED}:' || vec_id) LIMIT {K}),
{', '.join(_round_sql(i) for i in range(ROUNDS + 1))}
SELECT a.vec_id, CAST(a.cluster AS INT) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (cluster)"""
