"""Jaccard self-join of documents on word n-grams by T-occurrence search."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, common

#: Cells of the table of n-gram counts that orders n-grams from rare to frequent. The table has this size for any input.
CELLS = 1 << 18
#: Most bits of the filter that spares documents without a partner the way over the network.
FILTER_BITS = 1 << 27
#: How far below the threshold the prefix is cut, in hundredths of it: longer prefixes, but more n-grams must agree.
SLACK = 6
#: Share of the required overlap that DivideSkip leaves to the long lists falls with the list length by this factor.
MU = 0.0085


@dataclass(frozen=True)
class Rule:
    """n-grams of `size` words; linked when 100 * intersection >= `percent` * union."""

    size: int = 5
    percent: int = 80

    @property
    def loose(self) -> int:
        return max(1, self.percent - max(1, self.percent * SLACK // 100))

    def prefix(self, n: np.ndarray | int):
        """How many of the rarest n-grams are looked up."""
        return n - -(-self.loose * n // 100) + 1

    def overlap(self, a: int, b):
        """Least intersection of linked sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    @lru_cache(1 << 16)
    def shared(self, n: int) -> int:
        """How many n-grams a set of this size has in common with any linked set within the prefixes of both, at least.

        Beyond the prefix that ends first lie ceil(loose * size) - 1 n-grams of its set, at most those of the larger set,
        and the overlap is at least that of the two sizes. The difference neither rises nor falls with the size of the
        partner, so the least over all sizes that can be linked is taken.
        """
        m = np.arange(-(-self.percent * n // 100), 100 * n // self.percent + 1)
        return max(1, int((self.overlap(n, m) + -(self.loose * np.maximum(n, m)) // 100).min()) + 1)


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - 18)).astype(np.int64) % CELLS


def _member(tokens: np.ndarray) -> int:
    """One number for a set of n-grams; equal sets have equal numbers."""
    with np.errstate(over="ignore"):
        total = common.mix(tokens).sum(dtype=np.uint64) ^ (np.bitwise_xor.reduce(tokens) * np.uint64(0x9E3779B97F4A7C15))
        return int(common.mix(np.array([total + np.uint64(len(tokens))]))[0].view(np.int64))


def _sets(batch: pa.RecordBatch, column: int, size: int) -> Iterator[np.ndarray]:
    words = common.Words(*common.buffers(batch.column(column)))
    for i in range(batch.num_rows):
        yield common.shingles(words, i, size)


# ---- counts and the filter, both of fixed size ------------------------------------------------------------------

CELL_CHUNKS = 64


def counted(docs: DataFrame, size: int) -> np.ndarray:
    """Documents per cell of n-grams, summed over the whole corpus: one array of CELLS numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in common.slices(batches, "__text"):
            for tokens in _sets(batch, 0, size):
                np.add.at(total, _cells(tokens), 1)
        parts = total.reshape(CELL_CHUNKS, -1)
        at = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([parts[i].tobytes() for i in at], pa.binary())],
                                         names=["chunk", "counts"])

    partial = docs.select(F.col("text").alias("__text")).mapInArrow(run, "chunk int, counts binary")
    out = np.zeros((CELL_CHUNKS, CELLS // CELL_CHUNKS), np.int64)
    for chunk, counts in common.folded(partial, lambda a, b: (np.frombuffer(a, np.int64) + np.frombuffer(b, np.int64)).tobytes()):
        out[chunk] = np.frombuffer(counts, np.int64)
    return out.ravel()


def sieve(rows: DataFrame, column: str, n: int) -> np.ndarray:
    """A bit array in which the bit of every value of the column is set; at most FILTER_BITS bits.

    It only spares work: what passes is joined exactly, so a crowded filter costs traffic and no result.
    """
    bits = min(FILTER_BITS, 1 << max(16, math.ceil(math.log2(16 * max(1, n)))))
    piece = 1 << 15  # bits of a chunk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = _bit(batch.column(0).to_numpy(zero_copy_only=False), bits)
            for chunk in np.unique(at // piece).tolist():
                own = held.setdefault(chunk, np.zeros(piece, bool))
                own[at[at // piece == chunk] % piece] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()),
                                          pa.array([np.packbits(v).tobytes() for v in held.values()], pa.binary())],
                                         names=["chunk", "counts"])

    out = np.zeros(bits // 8, np.uint8)
    for chunk, value in common.folded(rows.select(column).mapInArrow(run, "chunk int, counts binary"),
                                lambda a, b: (np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes()):
        out[chunk * piece // 8:(chunk + 1) * piece // 8] = np.frombuffer(value, np.uint8)
    return out


def _bit(values: np.ndarray, bits: int) -> np.ndarray:
    return (common.mix(values.astype(np.int64).view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def passes(filter_: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = _bit(values, len(filter_) * 8)
    return (filter_[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def maybe(filter_: np.ndarray, column: str):
    """Rows whose value may be among those that the filter was made of; only this column goes through Python."""
    return F.pandas_udf(lambda values: pd.Series(passes(filter_, values.to_numpy())), "boolean")(F.col(column))


# ---- the join ---------------------------------------------------------------------------------------------------

def t_occurrence(sets: list[np.ndarray], rule: Rule, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of linked sets: all pairs, or, if cut is less than their number, those of one before and one after it.

    DivideSkip: each set asks for sets of its size or more. Of the inverted lists of its n-grams the longest, fewer than
    the required overlap T, are set aside. The short lists are merged, and whoever occurs often enough there to reach T is
    looked up in the long lists by binary search, until it reaches its overlap or cannot any more.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")  # lists in the order of sizes: the size filter is a slice
    sorted_sizes = sizes[order]
    side = (order < cut) if cut < m else None
    tokens = np.concatenate([sets[i] for i in order])
    by = np.argsort(tokens, kind="stable")  # stable: within a token, by size
    owner = np.repeat(np.arange(m), sorted_sizes)[by]
    same = tokens[by]
    first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
    length = np.diff(np.append(first, len(same)))
    of_token = np.empty(len(tokens), np.int64)
    of_token[by] = np.repeat(np.arange(len(first)), length)
    begin = np.cumsum(sorted_sizes) - sorted_sizes
    left, right = [], []
    for i in range(m - 1):
        n = int(sorted_sizes[i])
        last = int(np.searchsorted(sorted_sizes, 100 * n // rule.percent, side="right"))
        if last <= i + 1:
            continue
        lists = of_token[begin[i]:begin[i] + n]
        lists = lists[length[lists] > 1]
        need = int(rule.overlap(n, n))
        if len(lists) < need:
            continue
        lists = lists[np.argsort(length[lists], kind="stable")]
        aside = min(need - 1, int(need / (MU * math.log2(length[lists[-1]]) + 1)))
        parts = [owner[first[t]:first[t] + length[t]] for t in lists.tolist()]
        # skip to the sets after this one, up to the largest that can be linked
        parts = [p[np.searchsorted(p, i + 1):np.searchsorted(p, last)] for p in parts]
        short, long_ = parts[:len(parts) - aside], parts[len(parts) - aside:]
        merged = np.sort(np.concatenate(short))
        if not len(merged):
            continue
        head = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        found, count = merged[head], np.diff(np.append(head, len(merged)))
        enough = count >= need - aside
        if side is not None:
            enough &= side[found] != side[i]
        found, count = found[enough], count[enough]
        wanted = rule.overlap(n, sorted_sizes[found])
        remaining = len(long_)
        for p in long_:
            if not len(found):
                break
            if len(p):
                at = np.minimum(np.searchsorted(p, found), len(p) - 1)
                count = count + (p[at] == found)
            remaining -= 1
            if remaining % 16 == 0:
                can = count + remaining >= wanted
                found, count, wanted = found[can], count[can], wanted[can]
        hit = found[count >= wanted]
        left.append(np.full(len(hit), i))
        right.append(hit)
    none = np.zeros(0, np.int64)
    return order[np.concatenate([none, *left])], order[np.concatenate([none, *right])]


def join(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id") -> DataFrame:
    """key, n_shingles, n_links, component_id: for every row the size of its set of n-grams, how many other rows it is
    linked to, and the smallest key reachable by links, its own included.

    Words are runs of anything but space and 09-0D, with A-Z in lower case; n-grams are taken as 64-bit hashes. A text
    with fewer words than an n-gram has one, all its words; one without words, or null, has none and no links. Rows with
    a null key are left out; repeated keys are rows of their own; other columns stay behind. The result is exact: no
    list, group or candidate is cut.

    The text is read three times and never shuffled: for the table of counts that orders n-grams, for the rarest
    n-grams of each document, and, for documents with enough n-grams in common with others, for their sets.
    """
    rows, groups = _grouped(docs, rule, key)
    return (rows.select("id", "n", "member").join(groups, "member", "left")
            .select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id")))


def representatives(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id") -> DataFrame:
    """The rows, with their columns, that stay when one of each group of linked rows does: the one with the smallest key.

    Rows without words and rows with a null key are in no group and stay. Of rows that repeat with key and text one
    stays, of rows that share the smallest key the one whose text has the smallest hash.
    """
    rows, groups = _grouped(docs, rule, key)
    scratch = common.Scratch(docs.sparkSession, "representatives")
    named = rows.select("id", "version", "member").join(groups.select("member", "group"), "member").groupBy(
        "group", "id", "version").agg(F.count("*").alias("rows"))
    named = scratch.save(named)
    first = named.groupBy("group").agg(F.min(F.struct("id", "version")).alias("first"))
    id_, version = on = common.fresh(docs, "__id", "__version")
    judged = scratch.save(named.join(first, "group").select(
        F.col("id").alias(id_), F.col("version").alias(version), F.col("rows").alias("many"),
        (F.struct("id", "version") == F.col("first")).alias("stays")))
    marked = docs.withColumns({id_: F.col(key).cast("long"), version: F.xxhash64("text")})
    gone = scratch.save(judged.where("not stays or many > 1"))
    asked = maybe(sieve(gone, version, gone.count()), version)
    # most texts stay where they are; only those that may have to go are joined
    out = marked.where(~asked).unionByName(marked.where(asked).join(gone.select(on), on, "left_anti"))
    again = gone.where("stays").select(on)
    if again.head(1):
        out = out.unionByName(marked.where(asked).join(again, on, "left_semi").dropDuplicates(on))
    return out.select(*common.columns(docs))


def _grouped(docs: DataFrame, rule: Rule, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, n, member, version) and, by member, n_links, group and component_id."""
    scratch = common.Scratch(docs.sparkSession, "ngramjoin")
    docs = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col("text"))
    counts = counted(docs, rule.size)
    usual = counts.sum() / CELLS
    # frequent n-grams stand out of the cells' noise; the class is a power of two of what is above it
    grade = np.floor(np.log2(1 + np.maximum(0, counts - usual - 4 * math.sqrt(usual)))).astype(np.uint8)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            sizes, needs, members, heads = [], [], [], []
            for tokens in _sets(batch, 1, rule.size):
                n = len(tokens)
                sizes.append(n)
                needs.append(rule.shared(n) if n else None)
                members.append(_member(tokens) if n else None)
                if n:
                    p = rule.prefix(n)
                    grades = grade[_cells(tokens)]
                    by = np.argsort(grades, kind="stable")[:p] if grades.any() else slice(0, p)
                    tokens = tokens[by]
                heads.append(common.signed(tokens))
            at = np.cumsum([0, *map(len, heads)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(needs, pa.int32()), pa.array(members, pa.int64()), batch.column(2),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(heads), pa.int64()))],
                names=["id", "n", "need", "member", "version", "head"])

    described = scratch.save(docs.withColumn("version", F.xxhash64("text")).mapInArrow(
        rarest, "id long, n long, need int, member long, version long, head array<long>"))
    folded = scratch.save(described.where("member is not null").groupBy("member").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.max("need").alias("need")))

    # n-grams that two different sets have among their rarest; a set needs rule.shared(n) of them
    postings = described.select("member", F.explode("head").alias("token"))
    frequent = postings.groupBy("token").agg(F.min("member").alias("least"), F.max("member").alias("most")).where(
        "least < most").select("token")
    per = (postings.join(frequent, "token").distinct().groupBy("member").agg(F.collect_list("token").alias("tokens"))
           .join(folded.select("member", "need", "id"), "member"))
    able = scratch.save(per.where(F.size("tokens") >= F.col("need")))

    # rare first: all but the last need - 1 in the order of the number of sets that have them
    some = able.select("member", "need", F.explode("tokens").alias("token"))
    held = some.groupBy("token").agg(F.count("*").alias("df"))
    kept = (some.join(held.where("df > 1"), "token").groupBy("member", "need")
            .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))
            .where(F.size("tokens") >= F.col("need"))
            .select("member", F.explode(F.expr("slice(tokens, 1, size(tokens) - need + 1)")).alias("token"))
            .select("member", "token.token"))
    kept = scratch.save(kept)

    asked = able.select("member", "id").join(kept.select("member").distinct(), "member", "left_semi")
    asked = scratch.save(asked)
    spared = sieve(asked, "id", asked.count())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            batch = batch.filter(pa.array(passes(spared, batch.column(0).to_numpy(zero_copy_only=False))))
            if batch.num_rows:
                found = [s for s in _sets(batch, 1, rule.size)]
                members = [_member(s) if len(s) else None for s in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(members, pa.int64()),
                                                  pa.array([s.tobytes() for s in found], pa.binary())], names=["id", "member", "set"])

    sets = (docs.mapInArrow(whole, "id long, member long, set binary").join(asked, ["member", "id"], "left_semi")
            .dropDuplicates(["member"]).select("member", "set").join(folded.select("member", "copies"), "member"))
    met = blocks.meet(scratch, kept, sets, chunk=1024)

    def pairs(own: pd.DataFrame, cut: int) -> tuple[np.ndarray, np.ndarray]:
        return t_occurrence([np.frombuffer(s, np.uint64) for s in own["set"]], rule, cut)

    links = scratch.save(blocks.linked(met, pairs))
    more = links.where("links is not null").groupBy(F.col("a").alias("member")).agg(F.sum("links").alias("more"))
    reach = common.components(scratch, links.where("b is not null").select("a", "b")).withColumnRenamed("id", "member")
    grouped = scratch.save(folded.join(more, "member", "left").join(reach, "member", "left").select(
        "member", "id", (F.coalesce("more", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "member").alias("group")))
    names = grouped.groupBy("group").agg(F.min("id").alias("component_id"))
    return described, grouped.drop("id").join(names, "group")
