"""Centroid clustering by delta Lloyd: k-means in integers that only does again what a round has changed.

A vector counts if it has exactly `dimensions` components, none null or not finite; each component x becomes the integer
floor(scale * x). Vectors with an integer beyond LARGEST either way don't count: their squared distances would pass 64
bits. The first centroids are the k vectors with the least SHA-256 of "seed:id" (then of the least components; null ids
last); with fewer vectors there are fewer. A vector belongs to the nearest centroid, of equally near ones to that with the
smallest number. A centroid moves to the floor of the mean of its vectors, componentwise; one without vectors stays.

State. The vectors are stored with their owner and their distance to it. In a round, a vector whose owner has moved is
compared with all centroids; any other only with those that have moved, since the rest were no nearer before. Vectors that
change owners are summed as signed transfers, out of the old cluster and into the new one, and k sums are added to the
global ones, which with the counts are all that the driver holds (k * (dimensions + 1) integers). The state of a round
is stored before the last one's is deleted: a lost executor costs no more than the round's tasks. A round that moves no
centroid ends the work early, as all further ones would change nothing.

Rows that repeat an id are vectors of their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialise

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 16, 3, 64, 64, 1
#: Components up to which a squared distance of 64 of them stays below 2**62.
LARGEST = 1 << 27

STATE = pa.schema([("id", pa.int64()), ("q", pa.list_(pa.int32())), ("was", pa.int32()), ("owner", pa.int32()), ("distance", pa.int64())])


class Result(NamedTuple):
    vectors: DataFrame  #: id, cluster, distance
    clusters: DataFrame  #: cluster, n, inertia, centroid_sha256: one row for each centroid that has vectors
    centroids: np.ndarray
    inertia: int


def _nearest(q: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances of vectors after the centroids marked in moved have moved; owner -1: none yet."""
    owner, distance = owner.copy(), distance.copy()
    anew = np.flatnonzero((owner < 0) | moved[owner])
    owner[anew], distance[anew] = len(centroids), np.iinfo(np.int64).max
    for k, centroid in enumerate(centroids):
        rows = slice(None) if moved[k] else anew
        d = ((q[rows] - centroid) ** 2).sum(1)
        nearer = (d < distance[rows]) | (d == distance[rows]) & (k < owner[rows])
        owner[rows], distance[rows] = np.where(nearer, k, owner[rows]), np.where(nearer, d, distance[rows])
    return owner, distance


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, moved: np.ndarray) -> Iterator[pa.RecordBatch]:
    """STATE of the rows (id, q, owner, distance)."""
    for batch in batches:
        if len(batch):
            q = batch.column(1).flatten().to_numpy().reshape(len(batch), -1).astype(np.int64)
            was = batch.column(2).to_numpy()
            owner, distance = _nearest(q, was, batch.column(3).to_numpy(), centroids, moved)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(owner.astype(np.int32)), pa.array(distance)], schema=STATE)


def quantised(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, q: the vectors that count, as integers."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(float(LARGEST) / scale))
    return v.filter((F.size("v") == dimensions) & F.forall("v", whole)).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("q"))


def _transfers(state: DataFrame, dimensions: int) -> dict[int, list[int]]:
    """cluster: [difference in vectors, in the sum of each component], of the vectors that have changed owners."""
    moved = state.filter("was <> owner")
    signed = moved.select(F.explode(F.array(F.struct(F.col("owner").alias("cluster"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("cluster"), F.lit(-1).alias("sign")))).alias("e"), "q").filter("e.cluster >= 0")
    sign = F.col("e.sign").cast("long")
    sums: list[Column] = [F.sum(sign), *(F.sum(sign * F.col("q")[i]) for i in range(dimensions))]
    return {r[0]: list(r[1:]) for r in signed.groupBy("e.cluster").agg(*sums).collect()}  # k rows at most


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> Result:
    spark = vectors.sparkSession
    state = materialise(quantised(vectors, dimensions, scale, id_col, vector_col).select("id", "q", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance")), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = state.orderBy(order.asc_nulls_last(), "q").select("q").limit(k).collect()
    centroids = np.array([r[0] for r in first], np.int64).reshape(-1, dimensions)
    count, total = [0] * len(centroids), [[0] * dimensions for _ in centroids]
    moved = np.ones(len(centroids) + 1, bool)
    for step in range(rounds + 1):
        ran = map_arrow(state.select("id", "q", "owner", "distance"), partial(_assign, centroids=centroids, moved=moved), "id long, q array<int>, was int, owner int, distance long")
        before, state = state, materialise(ran, "assignments")
        discard(before)
        if step == rounds:
            break
        for c, (n, *sums) in _transfers(state, dimensions).items():
            count[c] += n
            total[c] = [a + b for a, b in zip(total[c], sums, strict=True)]
        new = np.array([[x // n for x in sums] if n else old for n, sums, old in zip(count, total, centroids.tolist(), strict=True)], np.int64).reshape(-1, dimensions)
        moved = np.append((new != centroids).any(1), False)
        centroids = new
        if not moved.any():
            break
    exact = F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")
    sums = {r[0]: (r[1], int(r[2])) for r in state.groupBy("owner").agg(F.count("*"), exact).collect()}  # k rows at most
    rows = [(c, n, inertia, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, (n, inertia) in sorted(sums.items())]
    clusters = spark.createDataFrame(rows, "cluster int, n long, inertia long, centroid_sha256 string")
    return Result(state.select("id", F.col("owner").alias("cluster"), "distance"), clusters, centroids, sum(r[2] for r in rows))


def report(result: Result) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row for each vector that counts."""
    known = F.broadcast(result.clusters.select("cluster", F.col("inertia").alias("cluster_inertia"), "centroid_sha256"))  # k rows
    joined = result.vectors.join(known, "cluster")
    return joined.select("id", "cluster", "distance", "cluster_inertia", F.lit(result.inertia).cast("long").alias("inertia"), "centroid_sha256")
