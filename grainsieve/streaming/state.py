"""A summary that goes on over a stream: mergeable counts and score moments, one small table for each micro-batch.

Batch n writes the state of batch n - 1 merged with its own tally under its number. A batch that runs again after a
failure reads the same predecessor and writes the same table, so each record counts once, whenever the stream stops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.evaluate import Check, evaluate
from ..plans.summary import tally

KEYS = ("kind", "field_key", "name")


def moments(counted: DataFrame, *by: str) -> DataFrame:
    """A tally whose spread is kept as the sum of squared distances from the mean, which merges."""
    return counted.select(*by, *KEYS, "n", "score_count", "mean", (F.pow("dev", 2) * F.col("score_count")).alias("squares"), "low", "high")


def merged(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """The moments of both parts together. A key has a row of either at most, so what is gathered are two rows."""
    part = F.struct(F.col("score_count").alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("squares", F.lit(0.0)).alias("squares"))

    def add(x, y):
        n = x["n"] + y["n"]
        gap = y["mean"] - x["mean"]
        share = F.coalesce(F.try_divide(y["n"].cast("double"), n.cast("double")), F.lit(0.0))
        return F.struct(n.alias("n"), (x["mean"] + gap * share).alias("mean"),
                        (x["squares"] + y["squares"] + gap * gap * x["n"] * share).alias("squares"))

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    both = a.unionByName(b).groupBy(*by, *KEYS).agg(
        F.sum("n").alias("n"), F.aggregate(F.array_sort(F.collect_list(part)), zero, add).alias("m"), F.min("low").alias("low"), F.max("high").alias("high"))
    some = F.col("m.n") > 0
    return both.select(*by, *KEYS, "n", F.col("m.n").alias("score_count"), F.when(some, F.col("m.mean")).alias("mean"),
                       F.when(some, F.col("m.squares")).alias("squares"), "low", "high")


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _states(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose tables are complete."""
    fs, where = _files(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[6:]) for n in names if n.startswith("batch-") and n[6:].isdigit()
                  and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def running_summary(checks: list[Check], path: str, by: tuple[str, ...] = (), keep: int = 2, **kw) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the tally of all records so far, by the columns ``by``, in the folder ``path``.

    Give every stream a folder of its own beside its checkpoint. Rows of any lateness count, each in its own group. Of
    the tables of earlier batches the last ``keep`` stay. A stream that starts anew, at batch 0, starts its state anew.
    """
    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = moments(tally(evaluate(batch, checks, **kw), *by), *by)
        before = [n for n in _states(spark, path) if n < number] if number else []
        if before:
            now = merged(spark.read.parquet(f"{path}/batch-{before[-1]}"), now, *by)
        # a row for each label and metric of a group
        now.coalesce(1 if not by else 8).write.mode("overwrite").parquet(f"{path}/batch-{number}")
        fs, _ = _files(spark, path)
        for old in _states(spark, path):
            if old > number or old <= number - keep:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch-{old}"), True)

    return handle


def current_tally(spark: SparkSession, path: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The tally after the last complete batch, in the form of ``plans.summary.tally``."""
    numbers = _states(spark, path)
    if not numbers:
        raise FileNotFoundError(f"no state of a running summary in {path}")
    return spark.read.parquet(f"{path}/batch-{numbers[-1]}").select(
        *by, *KEYS, "n", "mean", "score_count", "low", "high", F.sqrt(F.try_divide("squares", "score_count")).alias("dev"))
