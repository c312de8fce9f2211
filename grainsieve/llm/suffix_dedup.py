"""Passages that repeat, within or across documents, by sparse suffixes over a whole corpus.

Of all suffixes only those at minimisers are kept: in every run of `least` words the position of the smallest hash of
`head` words, which the run's own words select, so equal passages keep the same suffixes. The kept suffixes are grouped by
a hash of their heads; they are not sorted and not extended word by word. Each kept suffix stands for the windows of
`least` words that selected it, and these are compared by hash: all at once where the words around the heads are all
alike, window by window where they part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .ngram_join import maybe, sieve


@dataclass(frozen=True)
class Passage:
    """Passages of `least` words or more; suffixes are grouped by `head` words."""

    least: int = 50
    head: int = 25

    @property
    def width(self) -> int:
        """Heads in a window."""
        return self.least - self.head + 1


def kept_suffixes(w: np.ndarray, rule: Passage) -> tuple[np.ndarray, ...]:
    """Of a text's word hashes: each kept suffix's head hash, its first window, the suffix's place behind it, the number of
    its windows, and a hash of all words that these windows cover."""
    n = len(w) - rule.least + 1
    if n < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    heads = common.rolled(w, rule.head)
    at = np.empty(n, np.int64)
    for i in range(0, n, 4096):  # the leftmost smallest head of each window
        part = np.lib.stride_tricks.sliding_window_view(heads[i:i + 4096 + rule.width - 1], rule.width)[:n - i]
        at[i:i + len(part)] = part.argmin(1) + np.arange(i, i + len(part))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(first, n))
    # all windows of a suffix, each mixed with its place among them
    each = common.mix(common.rolled(w, rule.least) + common.mix((np.arange(n) - np.repeat(first, count)).astype(np.uint64)))
    off = at[first] - first
    around = common.mix(np.add.reduceat(each, first) + common.mix((off * 4096 + count).astype(np.uint64)))
    return common.signed(heads[at[first]]), first, off, count, common.signed(around)


def _windows(scratch: common.Scratch, docs: DataFrame, rule: Passage) -> DataFrame:
    """doc, version, start, last, source: runs of windows (by their first words) whose words occurred before."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            words = common.Words(*common.buffers(batch.column(2)))
            found = [kept_suffixes(words.hashes[words.first[i]:words.first[i + 1]], rule) for i in range(batch.num_rows)]
            rows = np.repeat(np.arange(batch.num_rows), [len(f[0]) for f in found])
            head, first, _, count, around = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(head, pa.int64()),
                 pa.array(first, pa.int32()), pa.array(count, pa.int32()), pa.array(around, pa.int64())],
                names=["doc", "version", "head", "start", "windows", "around"])

    kept = scratch.save(docs.mapInArrow(keep, "doc long, version long, head long, start int, windows int, around long"))
    paired = kept.groupBy("head").agg(F.count("*").alias("n")).where("n > 1").select("head")
    # repeated rows stay: they have the place of the first and drop out where places are compared
    live = scratch.save(kept.join(paired, "head"))
    place = F.struct("doc", "version", "start")
    sorted_ = scratch.save(live.groupBy("head").agg(
        F.min(place).alias("origin"), F.max(place).alias("other"), (F.min("around") == F.max("around")).alias("alike")
    ).where("origin != other"))

    # all words around the heads agree: every window of the later ones repeats the first
    whole = live.join(sorted_.where("alike").select("head", "origin"), "head").where(place != F.col("origin")).select(
        "doc", "version", "start", (F.col("start") + F.col("windows") - 1).alias("last"), F.col("origin.doc").alias("source"))

    # they part somewhere: window by window, from the texts
    parting = scratch.save(live.join(sorted_.where("not alike").select("head"), "head").groupBy("doc", "version").agg(
        F.sort_array(F.collect_set(F.struct("start", "windows"))).alias("runs")))
    spared = sieve(parting, "version", parting.count())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            words = common.Words(*common.buffers(batch.column(2)))
            rows, hashes, starts = [], [], []
            for i, runs in enumerate(batch.column(3).to_pylist()):
                all_ = common.rolled(words.hashes[words.first[i]:words.first[i + 1]], rule.least)
                at = np.concatenate([np.arange(r["start"], r["start"] + r["windows"]) for r in runs])
                rows.append(np.full(len(at), i))
                starts.append(at)
                hashes.append(common.signed(all_[at]))
            rows = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(hashes), pa.int64()),
                 pa.array(np.concatenate(starts), pa.int32())], names=["doc", "version", "words", "start"])

    some = docs.where(maybe(spared, "version"))
    # merged, so that a shuffle parts the two steps in Python: a task then has one worker
    each = scratch.save(some.join(parting.hint("merge"), ["doc", "version"]).select("doc", "version", "text", "runs").mapInArrow(
        compare, "doc long, version long, words long, start int"))
    again = each.groupBy("words").agg(F.min(place).alias("origin"), F.max(place).alias("other")).where(
        "origin != other").select("words", "origin")
    single = each.join(again, "words").where(place != F.col("origin")).select(
        "doc", "version", "start", F.col("start").alias("last"), F.col("origin.doc").alias("source"))
    return whole.unionByName(single)


def _spans(windows: DataFrame, rule: Passage) -> DataFrame:
    """doc, version, start, stop (words, end exclusive), sources: windows that meet or touch become one span."""
    order = Window.partitionBy("doc", "version").orderBy("start", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("start") > reach + rule.least, F.lit(True)).cast("int")
    span = F.sum("begins").over(order)
    return (windows.withColumn("begins", begins).withColumn("span", span).groupBy("doc", "version", "span").agg(
        F.min("start").alias("start"), (F.max("last") + rule.least).alias("stop"),
        F.sort_array(F.collect_set("source")).alias("sources")).drop("span"))


def _prepared(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))


def repeats(docs: DataFrame, rule: Passage = Passage(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start_word, n_words, source_ids: each span whose every run of `least` words has occurred before, in the order of
    (key, place); source_ids are the documents of the first occurrences.

    Words are runs of anything but space and 09-0D, with A-Z in lower case. The first occurrence of a passage is no
    repeat. Null keys and texts, and texts of fewer words, have no spans. Rows of equal key and text count as one; rows
    of equal key and another text are documents of their own. Other columns stay behind.
    """
    scratch = common.Scratch(docs.sparkSession, "suffixdedup")
    found = _spans(_windows(scratch, _prepared(docs, key, text), rule), rule)
    return found.select(F.col("doc").alias(key), F.col("start").cast("long").alias("start_word"),
                        (F.col("stop") - F.col("start")).cast("long").alias("n_words"), F.col("sources").alias("source_ids"))


def without_repeats(docs: DataFrame, rule: Passage = Passage(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same rows and columns, with the words of every repeated span, and the white space after them, cut from the text.

    Rows without repeats stay as they are, null texts and keys too; rows of equal key and text are cut alike; an empty table
    stays empty; columns may have any names. Only texts with repeats go through Python.
    """
    scratch = common.Scratch(docs.sparkSession, "suffixdedup")
    found = _spans(_windows(scratch, _prepared(docs, key, text), rule), rule)
    cuts = scratch.save(found.groupBy("doc", "version").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts")))

    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for i, own in enumerate(spans.to_pylist()):
            if own:
                raw = out[i].encode("utf-8")
                words = common.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                starts = np.append(words.starts, len(raw))
                parts, done = [], 0
                for s in own:
                    parts.append(raw[done:starts[s["start"]]])
                    done = int(starts[s["stop"]])
                out[i] = b"".join([*parts, raw[done:]]).decode("utf-8")
        return pa.array(out, pa.string())

    *on, cuts_ = common.fresh(docs, "__doc", "__version", "__cuts")
    marked = docs.withColumns({on[0]: F.col(key).cast("long"), on[1]: F.xxhash64(text)})
    asked = maybe(sieve(cuts, "version", cuts.count()), on[1])
    cuts = cuts.withColumnsRenamed({"doc": on[0], "version": on[1], "cuts": cuts_})
    some = marked.where(asked).join(cuts.hint("merge"), on, "left").withColumn(text, F.arrow_udf(cut, "string")(F.col(text), F.col(cuts_)))
    # texts that surely have no repeats stay where they are
    return marked.where(~asked).select(*common.columns(docs)).unionByName(some.select(*common.columns(docs)))
