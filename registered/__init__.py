"""Queries over the given tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Deal a table of fewer files than there are cores over all cores; told from its files, without a job.

    A small file of one row group is one task. Tables of many files, which every large one is, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores, key) if key else df.repartition(cores)


def load() -> None:
    from . import files, groups, judges, relations, rules, tables  # noqa: F401
