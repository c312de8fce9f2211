"""Product codes of vectors by Lloyd rounds that compare only what moved.

Every part of every vector keeps its entry and its exact squared distance to it. An entry that an update leaves as it was is
fixed: a part at a fixed entry was no farther from it than from any other fixed one, so only the moved entries are compared
with the stored distance. A part whose entry moved compares all entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, vectors

#: Rows that are compared with a codebook at once.
ROWS = 4096
#: Largest magnitude of an integer component: squared distances up to 1024 components then fit a long.
LIMIT = 1 << 25


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows: float64 products where they are exact, 64-bit integers elsewhere."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    kind = np.float64 if 4 * most * most * max(1, x.shape[1]) < 2 ** 53 else np.int64
    x, entries = x.astype(kind), entries.astype(kind)
    return ((x * x).sum(1)[:, None] + (entries * entries).sum(1) - 2 * (x @ entries.T)).astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the lower of equals, and its squared distance."""
    d = squared(x, entries)
    at = d.argmin(1)
    return at, d[np.arange(len(d)), at]


def renewed(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and distance of each row after some entries moved, from those before."""
    code, dist = code.copy(), dist.copy()
    lost = moved[code]
    if lost.any():
        code[lost], dist[lost] = nearest(x[lost], entries)
    some = np.flatnonzero(moved)
    held = np.flatnonzero(~lost)
    if len(some) and len(held):
        at, d = nearest(x[held], entries[some])
        at = some[at]  # rising, so the lower of equals stays the lower
        better = (d < dist[held]) | ((d == dist[held]) & (at < code[held]))
        code[held[better]], dist[held[better]] = at[better], d[better]
    return code, dist


def integers(df: DataFrame, key: str, vector: str, dims: int, scale: int, keep: dict[str, str], exact: bool = False) -> DataFrame:
    """key, the columns `keep` (new name: column) and vec, the bytes of floor(scale * x) as 32-bit integers.

    Rows whose vector is null or holds null or non-finite components are left out, with `exact` also those of another
    length than `dims`; shorter ones are padded with zeros. Components over LIMIT fail the task, as no long could hold
    their distances.
    """
    kinds = T.StructType([T.StructField("vec_id", df.schema[key].dataType)]
                         + [T.StructField(n, df.schema[c].dataType) for n, c in keep.items()] + [T.StructField("vec", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            if exact:
                fit = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dims
                batch = batch.filter(pa.array(fit))
                lists = batch.column(batch.num_columns - 1)
            rows, good = vectors.matrix(lists, dims)
            batch = batch.filter(pa.array(good))
            rows = np.floor(scale * rows[good])
            if np.abs(rows).max(initial=0) > LIMIT:
                raise ValueError(f"a component times {scale} is over {LIMIT}: squared distances would not fit a long")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors.packed(rows.astype(np.int32))], names=kinds.names)

    return df.select(F.col(key).alias("vec_id"), *[F.col(c).alias(n) for n, c in keep.items()], F.col(vector).alias("vec")).mapInArrow(
        run, kinds)


def totals(x: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """Sum of the rows of each entry, and their number in the last column."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    for j in range(x.shape[1]):
        out[:, j] = np.bincount(of, x[:, j], k)  # exact: ROWS times LIMIT is far below 2 ** 53
    out[:, -1] = np.bincount(of, minlength=k)
    return out


def summed(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of the tables that the tasks left, by chunk: of a size that only the parameters set."""
    out = np.zeros(shape, np.int64)
    for chunk, value in common.folded(parts, lambda a, b: (np.frombuffer(a, np.int64) + np.frombuffer(b, np.int64)).tobytes()):
        out[chunk] = np.frombuffer(value, np.int64).reshape(shape[1:])
    return out


def _pass(state: DataFrame, books: np.ndarray, moved: np.ndarray | None, last: bool) -> DataFrame:
    """The state with new codes and distances; unless last, each task adds rows with the sums of its vectors by entry."""
    parts, k, width = books.shape
    kinds = T.StructType([*[f for f in state.schema if f.name in ("vec_id", "label", "vec")],
                          *T.StructType.fromDDL("codes binary, dists binary, error long, chunk int, counts binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, k, width + 1), np.int64)
        types = None
        for whole in batches:
            types = [whole.schema.field(i).type for i in range(3)]
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                n = batch.num_rows
                x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int32).reshape(n, parts, width)
                codes, dists = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
                if moved is not None:
                    codes[:] = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(n, parts)
                    dists[:] = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.int64).reshape(n, parts)
                for p in range(parts):
                    own = x[:, p]
                    if moved is None:
                        codes[:, p], dists[:, p] = nearest(own, books[p])
                    else:
                        codes[:, p], dists[:, p] = renewed(own, books[p], moved[p], codes[:, p], dists[:, p])
                    if not last:
                        total[p] += totals(own, codes[:, p], k)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], vectors.packed(codes.astype(np.uint16)), vectors.packed(dists), pa.array(dists.sum(1)),
                     pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=kinds.names)
        if types and not last:
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(parts, t) for t in types], *[pa.nulls(parts, t) for t in (pa.binary(), pa.binary(), pa.int64())],
                 pa.array(range(parts), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], names=kinds.names)

    return state.mapInArrow(run, kinds)


def compress(df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, key: str = "vec_id",
             vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, codes (the entry of each part, 16-bit), error (squared distance, summed over the parts) of every
    usable vector, and the codebooks (part, entry, component).

    Components become floor(scale * x); a vector is cut into `parts` equal parts, after padding with zeros to the longest
    vector and a multiple of `parts`. A codebook starts as the parts of the vectors of the smallest ids, null ids last, rows
    of one id by the bytes of their integers; fewer rows than `entries` give fewer entries. Each of the rounds assigns every
    part to the nearest entry, the lower of equals, and moves each used entry to floor(sum / count); then all are assigned
    once more. Vectors that are null or hold null or non-finite components are left out; repeated rows count each;
    an empty table gives none; other columns stay behind. A round reads and writes one table of integers, codes and
    distances in the shared folder; only codebooks and their sums, of a size that the parameters set, pass the driver.
    """
    spark = df.sparkSession
    scratch = common.Scratch(spark, "vectorcodes")
    if entries > 1 << 16:
        raise ValueError("codes have 16 bits")
    width = -(-vectors.dimensions(df, vector) // parts)
    state = scratch.save(integers(df, key, vector, width * parts, scale, {"label": label}))
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), "vec").select("vec").limit(entries).collect()
    if not first:
        return state.select("vec_id", "label", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("long").alias("error")), \
            np.zeros((parts, 0, width), np.int64)
    books = np.array([np.frombuffer(r.vec, np.int32) for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    moved = None
    for _ in range(rounds):
        after = scratch.save(_pass(state, books, moved, False))
        total = summed(after.where("chunk is not null").select("chunk", "counts"), (parts, len(first), width + 1))
        scratch.drop(state)
        state = after.where("chunk is null")
        state._scratch_path = after._scratch_path
        count = total[:, :, -1:]
        new = np.where(count > 0, total[:, :, :-1] // np.maximum(count, 1), books)
        moved = (new != books).any(2)
        books = new
    final = scratch.save(_pass(state, books, moved, True).select("vec_id", "label", "codes", "error"))
    if rounds:
        scratch.drop(state)
    return final, books


def digests(df: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable vector, by way of compress.

    Errors are summed by label before the sums are joined back, so that a frequent label is no group of rows.
    """
    coded, books = compress(df)
    named = coded.withColumn("l", F.coalesce(F.concat(F.lit("+"), F.col("label").cast("string")), F.lit("-")))
    sums = named.groupBy("l").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = common.Scratch(df.sparkSession, "labelsums").save(sums)
    low = F.transform(F.sequence(F.lit(0), F.lit(books.shape[0] - 1)), lambda i: F.lower(F.hex(F.substring("codes", i * 2 + 1, 1))))
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return common.attached(named, sums, ["l"], "vec_id").select(
        "vec_id", F.array_join(low, "").alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
