"""Near-duplicate vectors by a pivot-permutation index."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, common, vectors

#: Nearest pivots that describe a vector, and how many of them two vectors must share to be compared.
NEAREST, SHARED = 8, 3


def near_duplicates(df: DataFrame, least: float = 0.95, key: str = "vec_id", vector: str = "embedding",
                    nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """key, n_links, component_id, kept: for every row, how many others it is linked to (cosine in double precision
    of `least` or more), the smallest key reachable by links, and whether that is its own.

    Equal vectors are folded first. Each vector is described by its nearest pivots in order; the pivots' inverted lists
    are kept by combinations of `shared` pivots, so that two vectors meet exactly if they share so many. Where they
    meet, shared pivots are counted and every candidate is verified. Pivots are fitted on the first vectors.SAMPLE rows
    by a hash, every row is indexed. A link is missed only if two vectors share fewer pivots (tests measure recall).

    Rows with a null key are left out. Vectors that are null, zero, or hold null or non-finite components link with
    nothing; shorter vectors count as padded with zeros. Repeated keys are one row each, linked like any others.
    """
    spark = df.sparkSession
    scratch = common.Scratch(spark, "vectordedup")
    dims = vectors.dimensions(df, vector)

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, good = vectors.matrix(batch.column(1), dims)
            rows = np.where(good[:, None], rows, 0)
            scale = np.abs(rows).max(1)
            good &= scale > 0
            rows = rows / np.where(good, scale, 1)[:, None] + 0.0  # no overflow in the norm, no negative zero
            rows /= np.where(good, np.sqrt((rows * rows).sum(1)), 1)[:, None]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(good), vectors.packed(rows)], names=["id", "good", "vec"])

    every = scratch.save(df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("__v"))
                         .mapInArrow(unit, "id long, good boolean, vec binary")
                         .select("id", F.when(F.col("good"), F.col("vec")).alias("vec"), F.monotonically_increasing_id().alias("row")))
    # a row's number stands for it, as keys may repeat
    distinct = scratch.save(every.where("vec is not null").groupBy("vec").agg(
        F.min("row").alias("member"), F.min("id").alias("id"), F.count("*").alias("copies")))
    n = distinct.count()
    if n:
        links = scratch.save(_links(scratch, distinct, n, dims, least, nearest, shared))
    else:
        links = spark.createDataFrame([], blocks.LINKS)
    counts = links.where("links is not null").groupBy(F.col("a").alias("member")).agg(F.sum("links").alias("more"))
    reach = common.components(scratch, links.where("b is not null").select("a", "b"))
    folded = scratch.save(
        distinct.join(counts, "member", "left").join(reach.withColumnRenamed("id", "member"), "member", "left")
        .select("vec", "id", (F.coalesce("more", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "member").alias("group")))
    names = folded.groupBy("group").agg(F.min("id").alias("component"))
    folded = folded.drop("id").join(names, "group").drop("group")
    return every.join(folded, "vec", "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))


def _links(scratch: common.Scratch, distinct: DataFrame, n: int, dims: int, least: float, nearest: int, shared: int) -> DataFrame:
    sample = distinct.orderBy(F.xxhash64("vec"), "member").limit(vectors.SAMPLE).select("vec").toPandas()
    pivots = vectors.fitted(vectors.unpacked(sample["vec"], dims), max(64, min(1024, round(math.sqrt(n)))))
    nearest = min(nearest, len(pivots))
    shared = min(shared, nearest)
    combine = np.array(list(itertools.combinations(range(nearest), shared)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                d = vectors.distances(vectors.unpacked(batch.column(0).to_pylist(), dims), pivots)
                order = np.argsort(d, 1, kind="stable")[:, :nearest].astype(np.int32)  # the permutation's head
                held = np.sort(order, 1)[:, combine].astype(np.int64)
                tokens = np.zeros(held.shape[:2], np.int64)
                for j in range(shared):
                    tokens = tokens * len(pivots) + held[:, :, j]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), vectors.packed(order),
                     pa.FixedSizeListArray.from_arrays(pa.array(tokens.ravel()), len(combine)).cast(pa.list_(pa.int64()))],
                    names=["vec", "member", "copies", "pivots", "tokens"])

    described = distinct.select("vec", "member", "copies").mapInArrow(
        describe, "vec binary, member long, copies long, pivots binary, tokens array<long>")
    postings = described.select(F.explode("tokens").alias("token"), "member")
    met = blocks.meet(scratch, postings, described.select("member", "copies", "vec", "pivots"))

    def pairs(own: pd.DataFrame, cut: int) -> tuple[np.ndarray, np.ndarray]:
        x = vectors.unpacked(own["vec"], dims)
        has = np.zeros((len(own), len(pivots)), np.float32)  # the block's inverted lists, one column a pivot
        has[np.arange(len(own))[:, None], vectors.unpacked(own["pivots"], nearest, np.int32)] = 1
        left, right = [], []
        for at in range(0, cut, 512):
            stop = min(cut, at + 512)
            count = has[at:stop] @ has.T
            a, b = np.nonzero(count >= shared)
            good = (b > a + at) if cut == len(own) else (b >= cut)
            a, b = a[good] + at, b[good]
            for i in range(0, len(a), 65536):
                u, v = a[i:i + 65536], b[i:i + 65536]
                close = np.einsum("nd,nd->n", x[u], x[v]) >= least
                left.append(u[close])
                right.append(v[close])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *left]), np.concatenate([none, *right])

    return blocks.linked(met, pairs)
