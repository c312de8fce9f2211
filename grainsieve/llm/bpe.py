"""Byte-level BPE encoding and decoding of whole text columns."""

from __future__ import annotations

import base64
import heapq
import time
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, pretokens

#: Bytes of the pieces and ids that a worker remembers, and the longest such piece in bytes; the rest are merged anew.
CACHE_BYTES, CACHE_CHARS = 32 << 20, 48


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids, from a rank file (a vocabulary of fixed size)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def merge_pairs(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of lowest rank, leftmost first, until none is known; a heap keeps long pieces fast."""
    if piece in rank:
        return [rank[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins here
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or mid >= n or end[mid] != stop:
            continue  # one of the two has been merged meanwhile
        alive[mid] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := rank.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        if (p := before[i]) >= 0 and (r := rank.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, i, stop))
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i:end[i]]])
        i = end[i]
    return out


class Merger:
    """Pair merging of many short pieces side by side: one row of a matrix each, one merge of each row per step."""

    #: Widths of the matrices; longer pieces are merged by merge_pairs.
    WIDTHS = (8, 16, 32, 64)

    def __init__(self, rank: dict[bytes, int]):
        self.rank = rank
        self.size = max(rank.values()) + 1
        pairs = sorted((rank[t[:i]] * self.size + rank[t[i:]], r) for t, r in rank.items()
                       for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank)
        self.keys = np.array([k for k, _ in pairs] + [1 << 62], np.int64)
        self.ids = np.array([r for _, r in pairs] + [self.size], np.int32)
        self.single = np.array([rank[bytes([i])] for i in range(256)], np.int32)
        self.double = np.full((256, 256), self.size, np.int32)
        for t, r in rank.items():
            if len(t) == 2:
                self.double[t[0], t[1]] = r

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the pairs' merged token, self.size where there is none; -1 stands for no part."""
        key = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) * self.size + right)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ids[at], self.size)

    def _matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        lengths = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        there = np.arange(width) < lengths[:, None]
        parts = np.full((len(pieces), width + 1), -1, np.int32)
        parts[:, :width] = np.where(there, self.single[data], -1)
        best = np.full_like(parts, self.size)  # of the pair that begins here
        best[:, :width - 1] = np.where(there[:, 1:], self.double[data[:, :-1], data[:, 1:]], self.size)
        out: list[list[int]] = [[]] * len(pieces)
        rows, columns = np.arange(len(pieces)), np.arange(width, dtype=np.int32)
        while len(rows):
            at = best.argmin(1)  # the leftmost of the lowest
            here = np.arange(len(rows))
            least = best[here, at]
            go = least < self.size
            if not go.all():
                for r, ids in zip(rows[~go].tolist(), parts[~go].tolist()):
                    out[r] = ids[:ids.index(-1)]
                rows, parts, best, at, least = rows[go], parts[go], best[go], at[go], least[go]
                here = here[:len(rows)]
                if not len(rows):
                    break
            stay = columns <= at[:, None]
            parts[:, :-1] = np.where(stay, parts[:, :-1], parts[:, 1:])
            best[:, :-1] = np.where(stay, best[:, :-1], best[:, 1:])
            parts[here, at] = least
            best[here, at] = self._pair(least, parts[here, at + 1])
            left = np.flatnonzero(at)
            best[left, at[left] - 1] = self._pair(parts[left, at[left] - 1], least[left])
        return out

    def __call__(self, pieces: list[str]) -> list[list[int]]:
        raw = [p.encode("utf-8") for p in pieces]
        out = [[r] if (r := self.rank.get(p)) is not None else None for p in raw]
        low = 0
        for width in self.WIDTHS:
            of = [i for i, p in enumerate(raw) if out[i] is None and low < len(p) <= width]
            for at in range(0, len(of), 1024):
                part = of[at:at + 1024]
                for i, ids in zip(part, self._matrix([raw[i] for i in part], width)):
                    out[i] = ids
            low = width
        return [merge_pairs(p, self.rank) if ids is None else ids for p, ids in zip(raw, out)]


class PieceCache:
    """Ids of pieces. Pieces are found by a hash of their bytes and then compared with the bytes kept, so equal hashes
    of different pieces do no harm; a piece gets a row number, and the ids and bytes of all rows lie in two arrays.

    Hashes lie in rising order beside their rows. What it holds is counted in bytes; it starts anew beyond `most`.
    """

    def __init__(self, ids_of: Callable[[list[str]], list[list[int]]], most: int = CACHE_BYTES):
        self.ids_of, self.most = ids_of, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.n = 0
        self.ids, self.raw = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.uint8)
        self.id_at, self.raw_at = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def held(self) -> int:
        return int(self.raw_at[self.n] + 4 * self.id_at[self.n]) + 28 * self.n

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the hashes, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.rows[at], -1).astype(np.int64)

    def _add(self, pieces: list[str]) -> int:
        """Rows for these pieces; the number of the first."""
        found, raw = self.ids_of(pieces), [p.encode("utf-8") for p in pieces]
        self.ids = _appended(self.ids, self.id_at[self.n], np.array([i for x in found for i in x], np.int32))
        self.raw = _appended(self.raw, self.raw_at[self.n], np.frombuffer(b"".join(raw), np.uint8))
        first = self.n
        self.id_at = _appended(self.id_at, first + 1, self.id_at[first] + np.cumsum([len(x) for x in found]))
        self.raw_at = _appended(self.raw_at, first + 1, self.raw_at[first] + np.cumsum([len(x) for x in raw]))
        self.n += len(pieces)
        return first

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: Callable[[int], str]
               ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces that lie at these bytes, one after the other, and how many each has."""
        if self.held() > self.most or self.raw.nbytes + self.ids.nbytes > 4 * self.most:
            self.clear()
        size = ends - starts
        hashes, first, which = np.unique(common.run_hashes(data, starts, ends), return_index=True, return_inverse=True)
        rows = self._known(hashes)
        new, short = rows < 0, size[first] <= CACHE_CHARS
        keep, once = np.flatnonzero(new & short), np.flatnonzero(new & ~short)
        rows[keep] = self._add([piece(int(i)) for i in first[keep]]) + np.arange(len(keep))
        at = np.searchsorted(self.keys, hashes[keep])
        self.keys, self.rows = np.insert(self.keys, at, hashes[keep]), np.insert(self.rows, at, rows[keep])
        stay = self.n
        # longer pieces, and those whose hash another one has, are given up again at the end
        rows[once] = self._add([piece(int(i)) for i in first[once]]) + np.arange(len(once))
        rows = rows[which]
        odd = self.raw_at[rows + 1] - self.raw_at[rows] != size
        same = np.where(odd, 0, size)
        ends_ = np.cumsum(same)
        reach = np.arange(ends_[-1] if len(ends_) else 0)
        here, there = reach + np.repeat(starts - ends_ + same, same), reach + np.repeat(self.raw_at[rows] - ends_ + same, same)
        if not odd.any() and (data[here] == self.raw[there]).all():
            odd = None
        else:
            odd[np.searchsorted(ends_, np.flatnonzero(data[here] != self.raw[there]), side="right")] = True
            at = np.flatnonzero(odd)
            rows[at] = self._add([piece(int(i)) for i in at]) + np.arange(len(at))
        start, count = self.id_at[rows], self.id_at[rows + 1] - self.id_at[rows]
        total = np.cumsum(count)
        at = np.arange(total[-1] if len(total) else 0) + np.repeat(start - total + count, count)
        self.n = stay
        return self.ids[at], count


def _appended(array: np.ndarray, at: int, more: np.ndarray) -> np.ndarray:
    """The array with `more` written from `at` on, doubled until it fits."""
    while at + len(more) > len(array):
        array = np.concatenate([array, np.zeros_like(array)])
    array[at:at + len(more)] = more
    return array


@lru_cache(1)
def rank_cache(path: str) -> PieceCache:
    """The cache of a Python worker, kept from task to task."""
    return common.remembered(PieceCache(Merger(ranks(path))))


def encoded(batches: Iterator[pa.RecordBatch], text: str, cache: PieceCache, text_bytes: int = common.SLICE_BYTES
            ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, Callable[[], np.ndarray]]]:
    """For runs of rows: the rows, all ids, the first id of each text (one more than texts), then the code point at
    which each id's piece begins, within its text (a function, as few need it)."""
    for batch in common.slices(batches, text, text_bytes):
        data, offs = common.buffers(batch.column(batch.schema.get_field_index(text)))
        joined = data.tobytes().decode("utf-8")
        heads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # the byte at which each code point begins
        firsts = np.searchsorted(heads, offs)
        cut = pretokens.boundaries(joined, firsts[:-1])
        stops = np.append(cut[1:], len(joined))
        cache.used = time.monotonic()
        ids, count = cache.encode(data, heads[cut], heads[stops], lambda i: joined[cut[i]:stops[i]])
        before = np.concatenate([[0], np.cumsum(count)])
        of_text = before[np.searchsorted(cut, firsts)]

        def places() -> np.ndarray:
            return np.repeat(cut - firsts[np.searchsorted(firsts, cut, side="right") - 1], count)

        yield batch, ids, of_text, places


ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
                        T.StructField("offsets", T.ArrayType(T.IntegerType(), False))])


def encode(docs: DataFrame, ranks_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
           offsets: bool = True) -> DataFrame:
    """The columns `keep`, then `ids` (array of token ids) and, if asked, `offsets` (for each id, the code point of the
    text at which its piece begins).

    Null and empty texts give empty arrays; rows are independent, so ties and repeated rows change nothing; other
    columns are left behind, whatever their names. One pass, no shuffle. Every file of ranks must be readable on the
    executors under `ranks_path`.
    """
    kinds = T.StructType([docs.schema[c] for c in keep] + list(ENCODED)[:1 + offsets])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = rank_cache(ranks_path)
        for batch, ids, firsts, places in encoded(batches, "__text", cache):
            out = [batch.column(i) for i in range(len(keep))]
            out.append(pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(ids, pa.int32())))
            if offsets:
                out.append(pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(places(), pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=kinds.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, kinds)


def decode(tokens: DataFrame, ranks_path: str, ids: str = "ids", into: str = "decoded",
           keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, then `into` (binary): the bytes of the ids, gathered from one buffer of all token bytes by
    the tokens' offsets in it. A null or empty array gives no bytes; an id outside the vocabulary fails the task."""
    kinds = T.StructType([tokens.schema[c] for c in keep] + [T.StructField(into, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sorted((r, t) for t, r in ranks(ranks_path).items())
        size = np.zeros(order[-1][0] + 1, np.int64)
        size[[r for r, _ in order]] = [len(t) for _, t in order]
        place = np.cumsum(size) - size
        pool = np.frombuffer(b"".join(t for _, t in order), np.uint8)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                lists = batch.column(len(keep))
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                rows = np.concatenate([[0], np.cumsum(np.nan_to_num(
                    lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
                if len(flat) and (flat.min() < 0 or flat.max() >= len(size) or not size[flat].all()):
                    raise ValueError("an id is outside the vocabulary")
                n = size[flat]
                total = np.concatenate([[0], np.cumsum(n)])
                data = pool[np.arange(total[-1]) - np.repeat(total[:-1], n) + np.repeat(place[flat], n)]
                out = pa.Array.from_buffers(pa.binary(), batch.num_rows, [
                    None, pa.py_buffer(total[rows].astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [out], names=kinds.names)

    return tokens.select(*keep, F.col(ids).alias("__ids")).mapInArrow(run, kinds)


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, by way of encode and decode."""
    tokens = encode(docs, ranks_path, offsets=False).select(
        F.struct("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                 F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256")
                 ).alias("doc_id"), "ids")
    return decode(tokens, ranks_path).select("doc_id.*", F.sha2("decoded", 256).alias("decoded_sha256"))
