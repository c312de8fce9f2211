"""Blocks in which all pairs that share a token meet once, of bounded size, without sending a member to each token.

Tokens that one member alone has go first. For every other token its smallest member is the hub, and the block of a hub
gathers the members of all tokens that have it. Members that share a token share its hub, so every such pair meets in a
block; a group of look-alikes, which share most of their tokens, meets in a few blocks instead of one for each token. A
pair that shares several hubs counts in the block of the smallest. Large blocks are cut into chunks, and each two chunks
meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Members of a chunk, and rows of small blocks that one task takes together, about.
CHUNK, TASK = 2048, 4096


def meet(scratch: common.Scratch, postings: DataFrame, members: DataFrame, chunk: int = CHUNK, task: int = TASK) -> DataFrame:
    """Rows of `members` (keyed by member) once for each task in which they meet others.

    postings: token, member. Adds bucket, first, second (the task), hub, chunk, hubs (all hubs of the member).
    Members without a shared token have no row.
    """
    hubs = postings.groupBy("token").agg(F.min("member").alias("hub"), F.max("member").alias("most")).where(
        "hub < most").select("token", "hub")
    live = scratch.save(postings.join(hubs, "token").select("member", "hub").distinct())
    sizes = live.groupBy("hub").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    tasks = max(1, -(-live.count() // task))
    info = live.join(sizes, "hub").groupBy("member").agg(F.sort_array(F.collect_list(F.struct("hub", "chunks"))).alias("in"))
    one = F.col("in.chunks") == 1
    return (members.join(info, "member").withColumn("hubs", F.col("in.hub"))
            .withColumn("in", F.explode("in"))
            .withColumn("hub", F.col("in.hub"))
            .withColumn("chunk", F.pmod(F.xxhash64("member", "hub"), F.col("in.chunks")).cast("int"))
            .withColumn("bucket", F.when(one, F.pmod(F.xxhash64("hub"), F.lit(tasks))).otherwise(F.col("hub")))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("in.chunks") - 1)))
            .withColumn("first", F.least("chunk", "other")).withColumn("second", F.greatest("chunk", "other"))
            .drop("in", "other"))


def groups(key: tuple, rows: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, int]]:
    """The blocks of a task: hub, members, and how many of them (from the first) are to meet the rest; all, if equal."""
    _, first, second = key
    for hub, own in rows.groupby("hub", sort=True):
        own = own.sort_values(["chunk", "member"], ignore_index=True)
        if len(own) > 1:
            yield hub, own, len(own) if first == second else int((own["chunk"] == first).sum())


def canonical(hub: int, hubs: pd.Series, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) have this hub as the smallest that they share."""
    low = [{int(h) for h in x if h < hub} for x in hubs]
    if not any(low):
        return np.ones(len(a), bool)
    return np.fromiter((low[i].isdisjoint(low[j]) for i, j in zip(a.tolist(), b.tolist())), bool, len(a))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each linked member to the first of its component: what connects them all, without all their links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


LINKS = "a long, b long, links long"


def linked(met: DataFrame, pairs: Callable[[pd.DataFrame, int], tuple[np.ndarray, np.ndarray]], weight: str = "copies") -> DataFrame:
    """Runs `pairs` in every block. Rows: (a, b, null), edges that connect what is linked, and (a, null, links), the
    number of rows, counted by the members' weights, that a member is linked to by pairs of this block."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for hub, own, cut in groups(key, rows):
            a, b = pairs(own, cut)
            if len(a):
                good = canonical(hub, own["hubs"], a, b)
                a, b = a[good], b[good]
            if not len(a):
                continue
            ids, copies = own["member"].to_numpy(), own[weight].to_numpy(np.int64)
            u, v = forest(len(ids), a, b)
            out.append(pd.DataFrame({"a": ids[u], "b": ids[v], "links": None}))
            count = np.zeros(len(ids), np.int64)
            np.add.at(count, a, copies[b])
            np.add.at(count, b, copies[a])
            at = np.flatnonzero(count)
            out.append(pd.DataFrame({"a": ids[at], "b": None, "links": count[at]}))
        frame = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "links": []})
        return frame.astype({"a": "Int64", "b": "Int64", "links": "Int64"})

    return met.groupBy("bucket", "first", "second").applyInPandas(run, LINKS)
