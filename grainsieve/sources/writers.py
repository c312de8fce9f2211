"""Result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..plans.evaluate import DETAILS, STATUS, Retention, with_result
from ..plans.summary import summary_row


def result_rows(verdicts: DataFrame, raw: bool) -> DataFrame:
    """One struct column per record, either raw columns plus result or an envelope."""
    if raw:
        w = with_result(verdicts)
        return w.select(F.struct(*w.columns).alias("record"))
    rest = [c for c in verdicts.columns if c not in (STATUS, DETAILS)]
    return verdicts.select(F.struct(F.struct(*rest).alias("raw_data"), STATUS, DETAILS).alias("record"))


def labelled_rows(verdicts: DataFrame, kept: Retention) -> DataFrame:
    """(field, label_type, label_name, record): a record once per distinct label and field."""
    shown = verdicts if kept.good else verdicts.where(F.col(STATUS))
    base = shown.select("*", result_rows_column(shown, kept.raw).alias("record"))
    long = base.select("record", F.explode(DETAILS).alias("field", "details"))
    labels = F.array_distinct(F.flatten(F.transform(
        F.filter("details", lambda d: d["label"].isNotNull()), lambda d: d["label"])))
    long = long.select("field", "record", F.explode(labels).alias("label"))
    parts = F.split("label", r"\.", 2)
    return long.select("field", F.get(parts, F.lit(0)).alias("label_type"),
                       F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("label_name"), "record")


def result_rows_column(verdicts: DataFrame, raw: bool):
    rest = [c for c in verdicts.columns if c not in (STATUS, DETAILS)]
    if raw:
        return F.struct(*rest, F.struct(STATUS, DETAILS).alias("result"))
    return F.struct(F.struct(*rest).alias("raw_data"), F.col(STATUS), F.col(DETAILS))


def write_results(verdicts: DataFrame, path: str, kept: Retention, fmt: str = "json", mode: str = "error") -> None:
    """Write results by label, or in one folder when merging, and the summary next to them."""
    if not kept.bad:
        return
    if kept.merge:
        with_result(verdicts).write.mode(mode).format(fmt).save(f"{path}/all_results")
    else:
        labelled_rows(verdicts, kept).write.mode(mode).partitionBy(
            "field", "label_type", "label_name").format(fmt).save(f"{path}/by_label")
    write_summary(verdicts, path, mode)


def write_summary(verdicts: DataFrame, path: str, mode: str = "error", **names) -> None:
    """The summary is one row, hence one file."""
    summary_row(verdicts, output_path=path, **names).coalesce(1).write.mode(mode).json(f"{path}/summary")


def record_type(verdicts: DataFrame, kept: Retention) -> DataType:
    """The type of the records that `write_results` writes by label."""
    return result_rows(verdicts, kept.raw).schema["record"].dataType


def read_results(spark, path: str, bad: bool, raw: bool = False, fmt: str = "json", record: DataType | None = None) -> DataFrame:
    """Records written by label, bad or good ones. Without the type of a record all files are read once more to infer it."""
    status = "record.result.eval_status" if raw else f"record.{STATUS}"
    reader = spark.read.format(fmt)
    if record is not None:
        reader = reader.schema(StructType([StructField("record", record)]))
    found = reader.load(f"{path}/by_label").where(F.col(status) == F.lit(bad))
    # a folder for an empty name reads as null
    return found.withColumn("label_name", F.coalesce(F.col("label_name").cast("string"), F.lit("")))
