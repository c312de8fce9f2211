"""Shape of a verdict."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

GOOD = "QUALITY_GOOD"

DETAIL = T.StructType([
    T.StructField("metric", T.StringType()),
    T.StructField("status", T.BooleanType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("label", T.ArrayType(T.StringType())),
    T.StructField("reason", T.ArrayType(T.StringType())),
])


def strings(*values: Column | str) -> Column:
    return F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]).cast("array<string>")


def detail(metric: str, status: Column, label: Column, reason: Column | None = None,
           score: Column | None = None) -> Column:
    """One verdict; ``status`` true means bad, a null label means no label is given."""
    return F.struct(
        F.lit(metric).alias("metric"),
        F.coalesce(status, F.lit(False)).alias("status"),
        (F.lit(None) if score is None else score).cast("double").alias("score"),
        label.cast("array<string>").alias("label"),
        (F.lit(None) if reason is None else reason).cast("array<string>").alias("reason"),
    )
