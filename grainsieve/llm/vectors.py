"""Vector columns as bytes, and exact top-k search over a pivot-distance index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors that pivots are fitted on: the first of all rows by a hash.
SAMPLE = 4096
#: Rows of a block of the index, and the most blocks; beyond these the blocks grow. Block bounds are kept by tasks.
BLOCK_ROWS, BLOCKS = 8192, 16384
#: Queries that meet a block in one task; more of them are dealt over copies of the block.
QUERIES_A_TASK = 4096
#: Queries whose distances to all block bounds are held at once.
ROUTED = 256
#: Rows of an annulus that are compared in one step of the expansion.
STEP = 512


def matrix(lists: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of float64, padded with zeros to `dims`, and which rows are neither null nor hold null or non-finite values."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    n = len(lists)
    size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls come as NaN
    out = np.zeros((n, dims))
    rows = np.repeat(np.arange(n), size)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    good = ~pc.is_null(lists).to_numpy(zero_copy_only=False) & np.isfinite(out).all(1)
    return out, good


def packed(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize if rows.ndim > 1 else rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def unpacked(column: pd.Series, dims: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, dims)


def dimensions(df: DataFrame, vector: str) -> int:
    return max(1, df.agg(F.max(F.size(vector))).first()[0] or 0)


def fitted(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k centres of the sample by farthest-first seeds and a few rounds of k-means."""
    k = min(k, len(sample))
    picked = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    for _ in range(1, k):
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[picked[-1]]) ** 2).sum(1))
    centres = sample[picked].astype(np.float64)
    for _ in range(rounds):
        of = distances(sample, centres).argmin(1)
        for i in range(k):
            if (of == i).any():
                centres[i] = sample[of == i].mean(0)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances; rounding errors are far below the slack of the searches."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * (x @ centres.T), 0))


def quantised(df: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """key and vec (bytes of floor(scale * x) as float64), norm2; rows without a usable vector are left out. A square norm
    over 2**62 fails the task, as no long could hold the scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, good = matrix(batch.column(1), dims)
            rows = np.floor(scale * np.where(good[:, None], rows, 0))
            norm = (rows * rows).sum(1)
            if norm[good].max(initial=0) > 2.0 ** 62:
                raise ValueError(f"a vector times {scale} has a square norm over 2**62: its scores would not fit a long")
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), packed(rows[good]), pa.array(norm[good])],
                                             names=["vec_id", "vec", "norm2"])

    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("__v")).mapInArrow(
        run, "vec_id long, vec binary, norm2 double")


def products(rows: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products: float64 holds them exactly while norms stay under 2**52, else 64-bit integers do."""
    return rows @ q if exact else (rows.astype(np.int64) @ q.astype(np.int64))


def expand(rows: np.ndarray, ids: np.ndarray, own: np.ndarray, dist: np.ndarray, q: np.ndarray, q_row: int, q_dist: float,
           base: float, k: int, best: list, exact: bool) -> list:
    """Grow the annulus of one pivot around the query's distance until no row outside can be among the k best.

    rows lie by dist. best: (-score, vec_id, row) of the k best so far. A row's squared distance is base - 2 * score,
    so a row beyond the annulus, whose distance is at least |dist - q_dist|, scores at most (base - that ** 2) / 2.
    """
    lo = hi = int(np.searchsorted(dist, q_dist))
    while lo > 0 or hi < len(dist):
        left = q_dist - dist[lo - 1] if lo else np.inf
        right = dist[hi] - q_dist if hi < len(dist) else np.inf
        gap = max(0.0, min(left, right))
        if len(best) == k and (base - gap * gap) / 2 * (1 + 1e-9) + 1e-3 + 1e-9 * base < -best[-1][0]:
            break
        a, b = (max(0, lo - STEP), lo) if left <= right else (hi, min(len(dist), hi + STEP))
        lo, hi = min(lo, a), max(hi, b)
        score = products(rows[a:b], q, exact)
        if len(best) == k:
            some = np.flatnonzero(score >= -best[-1][0])
        elif len(score) > 4 * k:
            some = np.flatnonzero(score >= np.partition(score, len(score) - k - 1)[-k - 1])
        else:
            some = np.arange(len(score))
        best = sorted(best + [(-int(score[i]), int(ids[a + i]), int(own[a + i])) for i in some if own[a + i] != q_row])[:k]
    return best


def top_k(df: DataFrame, queries, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for every row that meets the condition `queries`, its k best other rows by the
    inner product of floor(scale * x), ties to the smaller id.

    The largest inner product is the nearest neighbour once each vector gets one more component that makes all norms
    alike. Every row is keyed by its nearest pivot and its distance; blocks are runs of that order, so an annulus that
    holds many equal vectors is dealt over several blocks. Each query first searches the block around its own key, then
    all blocks that the triangle inequality cannot rule out for the bound found there. All is exact.

    Rows with a null id or a null vector, or with null or non-finite components, take no part; shorter vectors count as
    padded with zeros; repeated rows are rows of their own, and only the query's own row is left out. Fewer rows than k
    give fewer ranks, an empty table none.
    """
    spark = df.sparkSession
    scratch = common.Scratch(spark, "topk")
    dims = dimensions(df, vector)
    rows = scratch.save(quantised(df, key, vector, dims, scale).withColumn("row", F.monotonically_increasing_id()))
    total = rows.agg(F.count("*").alias("n"), F.max("norm2").alias("m")).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not total.n:
        return spark.createDataFrame([], result)
    top, exact = float(total.m), float(total.m) < 2.0 ** 52

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]])

    seen = rows.orderBy(F.xxhash64("row")).limit(SAMPLE).select("vec").toPandas()
    pivots = fitted(lifted(unpacked(seen["vec"], dims)), max(4, min(256, round(math.sqrt(total.n) / 2))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = lifted(unpacked(batch.column(1).to_pylist(), dims))
                d = distances(x, pivots)
                at = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(at, pa.int32()),
                                                  pa.array(d[np.arange(len(d)), at])], names=["vec_id", "vec", "row", "pivot", "dist"])

    keyed = rows.select("vec_id", "vec", "row").mapInArrow(assign, "vec_id long, vec binary, row long, pivot int, dist double")
    blocks = max(1, min(BLOCKS, math.ceil(total.n / BLOCK_ROWS)))
    index = scratch.save(keyed.repartitionByRange(blocks, "pivot", "dist", "row").withColumn("block", F.spark_partition_id()))
    bounds = index.groupBy("block", "pivot").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi")).toPandas()
    b_block, b_pivot = bounds["block"].to_numpy(np.int64), bounds["pivot"].to_numpy(np.int64)
    b_lo, b_hi = bounds["lo"].to_numpy(), bounds["hi"].to_numpy()

    def route(first: bool):
        """Queries and the blocks they must meet: the nearest of their own pivot, or all the others within the bound."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a few queries at once, so that their distances to all block bounds stay small
            for batch in (b.slice(i, ROUTED) for b in batches for i in range(0, b.num_rows, ROUTED)):
                q = unpacked(batch.column(2).to_pylist(), dims)
                d = distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)
                far = np.maximum(np.maximum(b_lo - d[:, b_pivot], d[:, b_pivot] - b_hi), 0)
                nearest = (far + np.where(b_pivot == d.argmin(1)[:, None], 0, 1e30)).argmin(1)
                home = b_block[np.where(far[np.arange(len(q)), nearest] < 1e29, nearest, far.argmin(1))]
                if first:
                    at, to = np.arange(len(q)), home
                else:
                    base = (q * q).sum(1) + top
                    bound = batch.column(3).to_numpy(zero_copy_only=False)  # score of the k-th so far, or -inf
                    most = (base[:, None] - far * far) / 2 * (1 + 1e-9) + 1e-3 + 1e-9 * base[:, None]
                    reach = np.zeros((len(q), blocks_in), bool)
                    at, by = np.nonzero(most >= bound[:, None])
                    reach[at, b_block[by]] = True
                    reach[np.arange(len(q)), home] = False
                    at, to = np.nonzero(reach)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)),
                                                  batch.column(2).take(pa.array(at)), batch.column(3).take(pa.array(at)),
                                                  pa.array(to, pa.int32())], names=["query_id", "q_row", "q", "bound", "block"])
        return run

    blocks_in = int(b_block.max()) + 1

    def search(_, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(asked):
            held = held.sort_values(["pivot", "dist", "row"], ignore_index=True)
            x, ids, own = unpacked(held["vec"], dims), held["vec_id"].to_numpy(), held["row"].to_numpy()
            dist, of = held["dist"].to_numpy(), held["pivot"].to_numpy()
            here, start = np.unique(of, return_index=True)
            stop = np.append(start[1:], len(of))
            qs = unpacked(asked["q"], dims)
            d = distances(np.hstack([qs, np.zeros((len(qs), 1))]), pivots[here])
            for j, (query_id, q_row, bound) in enumerate(zip(asked["query_id"], asked["q_row"], asked["bound"])):
                base = float(qs[j] @ qs[j]) + top
                # the bound of the first block stands in for k rows that are found elsewhere
                best = [(-bound, 1 << 62, -1)] * k if np.isfinite(bound) else []
                for p in np.argsort(np.abs(d[j] - dist[start])):
                    a, b = start[p], stop[p]
                    best = expand(x[a:b], ids[a:b], own[a:b], dist[a:b], qs[j], q_row, d[j, p], base, k, best, exact)
                out += [(query_id, q_row, row, i, -s) for s, i, row in best if row >= 0]
        return pd.DataFrame(out, columns=["query_id", "q_row", "row", "vec_id", "score"]).astype("int64")

    def met(routed: DataFrame) -> DataFrame:
        """Search each block for the queries routed to it; many queries of one block are dealt over copies of it."""
        routed = scratch.save(routed)
        copies = routed.groupBy("block").agg(F.ceil(F.count("*") / QUERIES_A_TASK).cast("int").alias("copies"))
        asked = routed.join(copies, "block").withColumn("copy", F.pmod(F.xxhash64("q_row"), "copies").cast("int")).drop("copies")
        held = index.join(copies, "block").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
        return scratch.save(held.groupBy("block", "copy").cogroup(asked.groupBy("block", "copy")).applyInPandas(
            search, "query_id long, q_row long, row long, vec_id long, score long"))

    routed_schema = "query_id long, q_row long, q binary, bound double, block int"
    asking = rows.where(queries).select(F.col("vec_id").alias("query_id"), F.col("row").alias("q_row"), F.col("vec").alias("q"))
    home = met(asking.withColumn("bound", F.lit(float("-inf"))).mapInArrow(route(True), routed_schema))
    kth = home.groupBy("q_row").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least"))
    bounded = asking.join(kth, "q_row", "left").select(
        "query_id", "q_row", "q", F.when(F.col("n") >= k, F.col("least")).otherwise(float("-inf")).alias("bound"))
    rest = met(bounded.mapInArrow(route(False), routed_schema))
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row")
    return home.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
