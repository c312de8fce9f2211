"""Intermediate tables in the shared folder: written once, read by several later steps, and safe from lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a folder of this machine only where none is set, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="grainsieve-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


#: If set, Spark removes the shuffle files of a run when it ends, not when the driver's memory happens to be cleaned.
SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """The same rows, from a new table in the shared folder. If tidy, what was shuffled for it leaves the disk once it is there."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(SHUFFLES, None)
    if tidy:
        spark.conf.set(SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if tidy:
            spark.conf.unset(SHUFFLES) if before is None else spark.conf.set(SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
