"""Packing of documents into sequences of a fixed number of tokens, certified by lower bounds.

Documents are tokenised where they are read; only piece lengths travel. Pieces are dealt over partitions of bounded
size, each packed by best-fit decreasing. Dual feasible functions give a lower bound on a partition's bins. A partition
that meets its bound is certified and hands on its emptiest bin alone (what rounding up to whole bins may cost); one
with a gap hands on every bin with free room. What is handed on is dealt anew among the partitions and best-fit
decreasing is rerun, until the bound of all pieces together is met or a round saves no bin.
"""

from __future__ import annotations

import itertools
import json
import logging
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, common

#: Pieces that one task packs, about; the number of partitions follows from it.
PIECES_A_TASK = 1 << 16
_LOG = logging.getLogger(__name__)


# ---- tokens -----------------------------------------------------------------------------------------------------

@lru_cache(2)
def _vocabulary(path: str) -> tuple[dict[bytes, int], tuple[str, ...]]:
    """Token bytes and ids of a tokenizers file of byte-level BPE, and its added tokens.

    The file writes bytes as characters: printable ones as themselves, the others as those from 256 on. Merging by
    ids is merging by the file's order of merges only if the ids rise along it, which is checked.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    if any(a >= b for a, b in zip(made, made[1:])):
        raise ValueError("ids don't rise along the merges of this file")
    added = tuple(t["content"] for t in spec.get("added_tokens", ()))
    return {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in added}, added


@lru_cache(1)
def _cache(path: str) -> bpe.PieceCache:
    return common.remembered(bpe.PieceCache(bpe.Merger(_vocabulary(path)[0])))


@lru_cache(1)
def _library(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


PIECE = T.StructType([T.StructField(n, k) for n, k in (
    ("doc_id", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()),
    ("ids_crc32", T.LongType()))])


def pieces(docs: DataFrame, tokenizer: str, size: int, text: str = "text", end_id: int = 0,
           with_ids: bool = False) -> DataFrame:
    """One row per piece: a document's ids and one end_id, cut only where they are more than `size`.

    All pieces of a cut document are full but the first, which takes the remainder. Null counts as empty: one piece of
    one id. `with_ids` adds the ids themselves (array<int>).
    """
    kinds = T.StructType(list(PIECE) + [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = _vocabulary(tokenizer)[1]
        for batch, ids, firsts, _ in bpe.encoded(batches, "__text", _cache(tokenizer)):
            ids = ids.astype("<u4")
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            rows, kept = [], []
            for i, key in enumerate(keys):
                own = ids[firsts[i]:firsts[i + 1]]
                if added and (value := texts[i].as_py()) and any(a in value for a in added):
                    own = np.array(_library(tokenizer).encode(value, add_special_tokens=False).ids, "<u4")
                own = np.append(own, np.uint32(end_id)).astype("<u4")
                n, start, k = len(own), 0, 0
                while start < n:
                    stop = start + ((n - 1) % size + 1 if not k else size)
                    part = own[start:stop]
                    rows.append((key, k, start, stop - start, zlib.crc32(part.tobytes())))
                    if with_ids:
                        kept.append(part.astype(np.int32))
                    start, k = stop, k + 1
            out = [pa.array(x, pa.int32() if j == 1 else pa.int64()) for j, x in enumerate(zip(*rows))]
            if with_ids:
                at = np.cumsum([0, *map(len, kept)])
                out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(kept))))
            yield pa.RecordBatch.from_arrays(out, names=kinds.names)

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("__text")).mapInArrow(run, kinds)


# ---- bounds and bins --------------------------------------------------------------------------------------------

def lower_bound(count: np.ndarray, size: int) -> int:
    """Bins needed at least for count[x] items of length x, by the best of two families of dual feasible functions.

    f(x) with sums of at most 1 whenever lengths sum to at most `size`: thresholds (lengths over size - t count as a
    whole bin, those under t as nothing, the rest as their share) and roundings ((k + 1) x / size, where not whole,
    rounded down, over k).
    """
    x = np.arange(len(count), dtype=np.int64)
    some = np.flatnonzero(count)
    if not len(some):
        return 0
    best = -(-int((count * x).sum()) // size)
    n, total = np.cumsum(count), np.cumsum(count * x)
    for t in range(1, size // 2 + 1):
        # over size - t: whole; from t to size - t: share
        whole = int(n[-1] - n[min(size - t, len(n) - 1)])
        share = int(total[min(size - t, len(n) - 1)] - total[t - 1])
        best = max(best, whole + -(-share // size))
    for k in range(1, 101):
        y = (k + 1) * x
        f = np.where(y % size == 0, x * k, (y // size) * size)  # times k * size
        best = max(best, -(-int((count * f).sum()) // (k * size)))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the bins' fill: items from the longest on go to the fullest bin with room.

    Open bins lie in one stack per free room; a bit mask of the rooms that have bins finds the tightest at once.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    mask, fill = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        above = mask >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                mask ^= 1 << room
        else:
            b, room = len(fill), size
            fill.append(0)
        bins[i], offsets[i] = b, size - room
        fill[b] = size - room + n
        if left := room - n:
            if not stacks[left]:
                mask |= 1 << left
            stacks[left].append(b)
    return bins, offsets, np.array(fill, np.int64)


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long, open boolean"


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: the place of every piece.

    Empty table: no rows. Null or empty text: a piece of its end id alone. Repeated rows and equal doc_ids are packed
    each for itself. Ties between bins go to the one opened last. Other columns are left behind. The attribute `packing`
    of the result, and the log, tell the bound, the sequences and the rounds.
    """
    scratch = common.Scratch(docs.sparkSession, "packing")
    # the row number is fixed by writing: later rounds must see the same one even if a task is run again
    loose = scratch.save(pieces(docs, tokenizer, size, text).withColumn("row", F.monotonically_increasing_id()))
    counts = loose.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `size` rows
    histogram = np.zeros(size + 1, np.int64)
    for c in counts:
        histogram[c.length] = c.n
    bound = lower_bound(histogram, size)
    settled, used, best, path, rounds = None, 0, None, None, 0

    for turn in itertools.count():  # every round but the last saves a sequence
        n = loose.count()
        if not n:
            break
        parts = max(1, math.ceil(n / PIECES_A_TASK))
        placed = scratch.save(_deal(loose, parts, turn, size))
        rounds += 1
        full, opened = placed.where("not open"), placed.where("open")
        bins = placed.where("offset = 0").agg(F.count_if(~F.col("open")).alias("full"), F.count_if("open").alias("open")).first()
        total = used + bins.full + bins.open
        if best is not None and total >= best:
            break  # this round saved nothing: the packing before it stands
        best, path = total, placed if settled is None else settled.unionByName(placed)
        if total <= bound or parts == 1:
            break
        settled = full if settled is None else settled.unionByName(full)
        used += bins.full
        loose = opened.select(*PIECE.names, "row")
    if path is None:
        path = docs.sparkSession.createDataFrame([], PLACED)
    _LOG.info("%d sequences after %d rounds; no packing has fewer than %d", best or 0, rounds, bound)
    out = path.select(*PIECE.names, "sequence_id", "offset")
    out.packing = {"bound": bound, "sequences": best or 0, "rounds": rounds}
    return out


def _deal(loose: DataFrame, parts: int, turn: int, size: int) -> DataFrame:
    """Pack each of `parts` partitions by itself; rows are dealt by a hash of the row that changes from turn to turn."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)  # the same bins if the task is run again
        # 16 bits for the round, 27 for the partition, 20 for the bin
        bins, offsets, fill = best_fit(pdf["length"].to_numpy(), size)
        pdf["sequence_id"] = (np.int64(turn) << 47) + (np.int64(key[0]) << 20) + bins
        pdf["offset"] = offsets
        free = size - fill
        if len(fill) == lower_bound(np.bincount(pdf["length"], minlength=size + 1), size):
            free[np.arange(len(fill)) != free.argmax()] = 0
        pdf["open"] = (free > 0)[bins]
        return pdf.drop(columns="part")

    part = F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(parts)).cast("int").alias("part")
    return loose.select("*", part).groupBy("part").applyInPandas(run, PLACED)
