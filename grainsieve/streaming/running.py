"""Checks on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.evaluate import STATUS, Check, evaluate
from ..plans.summary import label_counts, totals


def running_label_counts(stream: DataFrame, checks: list[Check], **kw) -> DataFrame:
    """Label counts over all records seen so far; write it in ``complete`` or ``update`` mode."""
    return label_counts(evaluate(stream, checks, **kw))


def running_totals(stream: DataFrame, checks: list[Check], **kw) -> DataFrame:
    return totals(evaluate(stream, checks, **kw))


def windowed_quality(df: DataFrame, ts: str, bad: Column, window: str, late: str | None = None,
                     by: tuple[str, ...] = ()) -> DataFrame:
    """Share of bad records per event-time window; on streams, rows later than ``late`` are dropped."""
    if late and df.isStreaming:
        df = df.withWatermark(ts, late)
    g = df.groupBy(F.window(ts, window).alias("w"), *by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("num_bad"))
    return g.select(F.col("w.start").alias("window_start"), *by, "total", "num_bad",
                    (F.col("num_bad") / F.col("total")).alias("bad_ratio"))


def per_batch_results(checks: list[Check], sink: Callable[[DataFrame, int], None], **kw):
    """A ``foreachBatch`` function: verdicts of each micro-batch go to ``sink``."""

    def handle(batch: DataFrame, number: int) -> None:
        sink(evaluate(batch, checks, **kw).withColumn("batch", F.lit(number)), number)

    return handle


def bad_stream(stream: DataFrame, checks: list[Check], **kw) -> DataFrame:
    """The bad records of a stream, verdicts attached."""
    return evaluate(stream, checks, **kw).where(F.col(STATUS))
