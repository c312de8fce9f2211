"""Centroid clustering by scalar lookup tables: squared differences are tabulated for each dimension, value that occurs and
centroid; a distance is a sum of table rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, vectors
from .vector_codes import integers, summed, totals

#: Rows that share their tables: bounds the memory of a task, whatever values occur.
ROWS = 8192


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows to the centroids.

    For each dimension the values that occur in the rows are found, their squared differences to all centroids tabulated,
    and the rows' table lines added up. All is in integers, so the result is exact.
    """
    n, dims = x.shape
    x, centroids = x.astype(np.int64), centroids.astype(np.int64)
    span = int(max(x.max(initial=0), centroids.max(initial=0)) - min(x.min(initial=0), centroids.min(initial=0)))
    kind = np.int32 if dims * span * span < 2 ** 31 else np.int64
    out = np.zeros((n, len(centroids)), kind)
    for d in range(dims):
        values, at = _occurring(x[:, d])
        table = ((values[:, None] - centroids[:, d]) ** 2).astype(kind)
        out += table[at]
    return out


def _occurring(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, and where each row's value is among them; without a sort where they are close together."""
    low = int(v.min())
    span = int(v.max()) - low + 1
    if span > 4 * ROWS:
        return np.unique(v, return_inverse=True)
    there = np.zeros(span, bool)
    there[v - low] = True
    place = np.cumsum(there) - 1
    return np.flatnonzero(there) + low, place[v - low]


def _pass(rows: DataFrame, centroids: np.ndarray, last: bool) -> DataFrame:
    """vec_id, cluster and distance of every row if last, else the sums of each task's rows by cluster (chunk 0)."""
    k, dims = centroids.shape
    kinds = (T.StructType([rows.schema["vec_id"], *T.StructType.fromDDL("cluster int, distance long")]) if last
             else T.StructType.fromDDL("chunk int, counts binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32).reshape(-1, dims)
                far = distances(x, centroids)
                of = far.argmin(1)  # the smaller number of equals
                if last:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of, pa.int32()),
                                                      pa.array(far[np.arange(len(of)), of].astype(np.int64))], names=kinds.names)
                else:
                    total += totals(x, of, k)
        if not last:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=kinds.names)

    return rows.select("vec_id", "vec").mapInArrow(run, kinds)


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, key: str = "vec_id",
            vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance (squared) of every vector of `dims` finite components, and the centroids.

    Components become floor(scale * x). Centroids start as the vectors of the smallest sha256 of `seed:id`, null ids last,
    rows of one id by the bytes of their integers; fewer vectors than k give fewer centroids. Each of the rounds assigns every
    vector to the nearest centroid, the smaller number of equals, and moves each centroid that has any to
    floor(sum / count); then all are assigned once more. Vectors that are null, of another length, or hold null or non-finite
    components are left out; repeated rows count each; an empty table gives none; other columns stay behind. The integers are
    written once and read each round; a task sends one table of sums, whatever the size of a cluster.
    """
    scratch = common.Scratch(df.sparkSession, "clusters")
    rows = scratch.save(integers(df, key, vector, dims, scale, {}, exact=True))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    first = rows.orderBy(order, "vec").select("vec").limit(k).collect()
    if not first:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, dims), np.int64)
    centroids = np.array([np.frombuffer(r.vec, np.int32) for r in first], np.int64)
    for _ in range(rounds):
        total = summed(_pass(rows, centroids, False), (1, len(centroids), dims + 1))[0]
        count = total[:, -1:]
        centroids = np.where(count > 0, total[:, :-1] // np.maximum(count, 1), centroids)
    return scratch.save(_pass(rows, centroids, True)), centroids


def digests(df: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector, by way of cluster."""
    found, centroids = cluster(df)
    # k rows
    sums = {r["cluster"]: int(r.n) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    named = [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
             for i, c in enumerate(centroids.tolist())]
    named = df.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
