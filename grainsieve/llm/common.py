"""Shared helpers: scratch tables in the shared folder, vectorised word hashing, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of the vectorised scans takes at a time; bounds the memory of a task.
SLICE_BYTES = 1 << 20
#: Bytes that one vectorised pass works on; its arrays stay in the cache of a core.
PASS_BYTES = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a folder of this machine only where none is set (tests, local mode)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="grainsieve-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


_open: list[list[Scratch]] = []


class Scratch:
    """Tables written once to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        if _open:
            _open[-1].append(self)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/t{self.n}"
        self.n += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table that nothing reads any more."""
        self._delete(df._scratch_path)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def released():
    """Removes, at the end, all scratch tables that operators wrote meanwhile: for a caller that has written their result."""
    _open.append([])
    try:
        yield
    finally:
        for scratch in _open.pop():
            scratch._delete(scratch.base)


def columns(df: DataFrame) -> list[Column]:
    """The table's columns, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of the table is called so, in either case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def folded(partial: DataFrame, fold: Callable[[bytes, bytes], bytes]) -> list:
    """Rows (chunk, counts) of a table of fixed size, cut into chunks: each task's part folded by chunk on the executors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, bytes] = {}
        for batch in batches:
            for chunk, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[chunk] = fold(held[chunk], value) if chunk in held else value
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.binary())],
                                         names=["chunk", "counts"])

    return partial.repartition("chunk").mapInArrow(run, "chunk int, counts binary").collect()


#: Bytes of the keys and rows of a table that is broadcast, at most; the salts that spread the rows of a key beyond that.
BROADCAST_BYTES, SALTS = 8 << 20, 64


def attached(rows: DataFrame, table: DataFrame, on: list[str], spread: str, row_bytes: int = 100) -> DataFrame:
    """Inner join with a table of one row a key, where one key may hold any share of the rows.

    The table is broadcast if its measured size allows; else its rows are copied once for each salt, and the rows of a key
    spread over the salts by the hash of the column `spread`.
    """
    size = table.agg(F.sum(sum((F.octet_length(F.col(c).cast("string")) for c in on), F.lit(row_bytes)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), on)
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*on, "__salt"]).drop("__salt")


# ---- memory of Python workers -----------------------------------------------------------------------------------

#: Seconds after which a cache that no task has used is given up by the next task of its worker.
IDLE_SECONDS = 10.0
_caches: list = []


def remembered(cache):
    """A cache that a worker keeps from task to task, with `clear()` and the time of its last `used`."""
    cache.used = time.monotonic()
    _caches.append(cache)
    return cache


def trim() -> None:
    """Give up idle caches, and return freed memory to the system: workers outlive their tasks."""
    for cache in _caches:
        if time.monotonic() - cache.used > IDLE_SECONDS:
            cache.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


# ---- text buffers -----------------------------------------------------------------------------------------------

def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than texts) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = texts.buffers()
    offs = np.frombuffer(raw[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of about `most` bytes of the column, one row at least; frees memory at the end."""
    trim()
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = buffers(batch.column(batch.schema.get_field_index(column)))[1][1:]
            at = 0
            while at < batch.num_rows:
                base = ends[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
                yield batch.slice(at, upto - at)
                at = upto
    finally:
        trim()


# ---- words ------------------------------------------------------------------------------------------------------

@lru_cache(1)
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Each byte with A-Z taken as a-z; which bytes part words (space and 09-0D)."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] = low[97:123]
    part = np.zeros(256, bool)
    part[[9, 10, 11, 12, 13, 32]] = True
    return low, part


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """Words of a run of texts: hash, start and end byte of each, and `first`: where each text's words begin."""

    __slots__ = ("hashes", "starts", "ends", "first")

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        small, part = _byte_tables()
        found = []
        lo, n = 0, len(data)
        while lo < n:
            hi = min(n, lo + PASS_BYTES)
            if hi < n:
                # a slice ends before a parting byte or a text's start, so that no word is cut
                stop = offs[np.searchsorted(offs, hi, side="right") - 1]
                gaps = np.flatnonzero(part[data[lo:hi]])
                cut = max(int(stop), lo + int(gaps[-1]) if len(gaps) else 0)
                if cut <= lo:
                    nxt = int(offs[np.searchsorted(offs, lo, side="right")])
                    more = hi
                    while more < nxt and not part[data[more]]:
                        more += 1
                    cut = more
                hi = cut
            found.append(self._scan(data[lo:hi], offs, lo, small, part))
            lo = hi
        empty = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.hashes, self.starts, self.ends = (np.concatenate(x) for x in zip(*found)) if found else empty
        self.first = np.searchsorted(self.starts, offs)

    @staticmethod
    def _scan(b: np.ndarray, offs: np.ndarray, lo: int, small: np.ndarray, part: np.ndarray):
        n = len(b)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        apart = part[b]
        edge = np.zeros(n + 1, bool)  # a text begins here
        inner = offs[np.searchsorted(offs, lo):np.searchsorted(offs, lo + n, side="right")] - lo
        edge[inner] = True
        edge[0] = edge[n] = True
        begin = ~apart
        begin[1:] &= apart[:-1] | edge[1:-1]
        end = ~apart
        end[:-1] &= apart[1:] | edge[1:-1]
        s, e = np.flatnonzero(begin), np.flatnonzero(end)
        return run_hashes(small[b], s, e + 1), s + lo, e + 1 + lo


_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_PLACE = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each run; runs rise, don't overlap and are not empty.

    Eight bytes at a time, each eight mixed with its place before they are summed: no polynomial, for which there are
    regular texts that collide whatever its base.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        # as many runs as fit one pass, one at least
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PASS_BYTES, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        near = np.zeros(hi - lo + 8, np.uint8)
        near[:hi - lo] = data[lo:hi]
        eights = np.ndarray((hi - lo,), "<u8", near.data, strides=(1,))  # the eight bytes from each byte on
        size = ends[i:j] - starts[i:j]
        x = eights[starts[i:j] - lo] & _MASKS[np.minimum(size, 8)]
        total = mix(x + _PLACE)
        more = np.flatnonzero(size > 8)
        if len(more):
            count = (size[more] - 1) >> 3
            first = np.cumsum(count) - count
            place = np.arange(first[-1] + count[-1]) - np.repeat(first, count) + 1
            x = eights[np.repeat(starts[i:j][more] - lo, count) + 8 * place] & _MASKS[
                np.minimum(np.repeat(size[more], count) - 8 * place, 8)]
            total[more] += np.add.reduceat(mix(x + mix((place + 1).astype(np.uint64) * _PLACE)), first)
        out[i:j] = mix(total ^ (size.astype(np.uint64) * _PLACE))
        i = j
    return out


def shingles(words: Words, i: int, size: int) -> np.ndarray:
    """Distinct sorted shingle hashes of text i; the whole sequence as one shingle where it is shorter; none without words."""
    w = words.hashes[words.first[i]:words.first[i + 1]]
    if not len(w):
        return w
    return np.unique(rolled(w, min(size, len(w))))


def rolled(w: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words: runs of 1, 2, 4, .. words are mixed together two by two."""
    n = len(w) - size + 1
    out, at, length, runs = None, 0, 1, w
    while True:
        if size & length:
            own = runs[at:at + n]
            out = mix(own) if out is None else mix(out * _PLACE + own)
            at += length
        length *= 2
        if length > size:
            return mix(out + np.uint64(size))
        runs = mix(runs[:-length // 2] * _PLACE + runs[length // 2:])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


# ---- connected components ---------------------------------------------------------------------------------------

def components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over the edges, for each id that has an edge.

    Alternating large-star and small-star steps: each step is a grouped minimum and a join, so no node's neighbours
    are ever gathered; hubs are split by the join. Each round is written to the shared folder. Stops when the edges
    no longer change, after about log(longest path) rounds; raises if they still change after `rounds`.
    """
    spark = scratch.spark
    now = scratch.save(edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    for done in range(rounds + 1):
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not sums.n or before == (sums.n, sums.h):
            break
        if done == rounds:
            raise RuntimeError(f"components still change after {rounds} rounds")
        before = (sums.n, sums.h)
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = scratch.save(small)
        scratch.drop(now)
        now = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(
        F.min("component").alias("component"))


# ---- spans ------------------------------------------------------------------------------------------------------

def span_digests(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """doc_id, the count of each base kind, base_sha256 and spans, of rows with an array `spans` of (kind, start, end)."""
    def written(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    kept = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select("doc_id", *map(count, base), F.sha2(written(kept).cast("binary"), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))
