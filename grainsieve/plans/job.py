"""A run described by JSON: input, checks, retention, output."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..registry import find
from ..operators import load_all
from .evaluate import Check, Retention, evaluate


#: Files by a path of any file system that Spark reads, tables handed in, and queries.
SOURCES = ("local", "s3", "spark", "sql")


@dataclass(frozen=True)
class JobSpec:
    """The job file's keys: task_name, input_path, output_path, dataset, executor, evaluator."""

    evaluator: tuple[Check, ...]
    task_name: str = ""
    input_path: str = ""
    output_path: str = ""
    format: str = "jsonl"
    read_options: dict = field(default_factory=dict)
    start_index: int = 0
    end_index: int = -1
    order_by: str | None = None
    multi_turn_mode: str | None = None
    partitions: int = 0  # deal the input anew over so many; 0 leaves it as it is read
    kept: Retention = Retention()

    @staticmethod
    def of(spec: str | dict) -> "JobSpec":
        d = json.loads(spec) if isinstance(spec, str) else spec
        data, run = d.get("dataset", {}), d.get("executor", {})
        source = data.get("source", "local")
        if source not in SOURCES:
            raise ValueError(f"unsupported source: {source}")
        fmt = "sql" if source == "sql" else data.get("format", "jsonl")
        options = dict(data.get(f"{fmt}_config", {}))
        options.pop("batch_size", None)
        return JobSpec(
            evaluator=tuple(Check.of(g.get("fields", {}), g.get("evals", [])) for g in d["evaluator"]),
            task_name=d.get("task_name", ""), input_path=d.get("input_path", ""), output_path=d.get("output_path", ""),
            format=fmt, read_options=options, start_index=run.get("start_index", 0), end_index=run.get("end_index", -1),
            order_by=run.get("order_by"), multi_turn_mode=run.get("multi_turn_mode"),
            partitions=run.get("partitions", 0),
            kept=Retention(**run.get("result_save", {})))


def validate(spec: JobSpec, df: DataFrame) -> None:
    """Unknown evaluators and unmapped or missing columns fail before anything runs."""
    load_all()
    for check in spec.evaluator:
        for ev in check.evals:
            e = find(ev.name)
            missing = [r for r in e.required if check.fields and r not in check.fields]
            if missing:
                raise ValueError(f"{ev.name} needs field(s) {missing}")
        for column in check.fields.values():
            df.select(column)


def run_job(spark: SparkSession, spec: JobSpec | dict | str, df: DataFrame | None = None, **judging) -> DataFrame:
    """Read, evaluate and, with an output path, write; returns the verdicts."""
    from ..sources import dialogs, readers, writers

    spec = spec if isinstance(spec, JobSpec) else JobSpec.of(spec)
    if df is None:
        df = readers.read(spark, spec.input_path, spec.format, **spec.read_options)
    if spec.start_index or spec.end_index >= 0:
        if not spec.order_by:
            raise ValueError("a row range needs executor.order_by")
        df = readers.row_range(df, spec.order_by, spec.start_index, spec.end_index)
    if spec.multi_turn_mode == "all":
        df = dialogs.flatten_dialog(df, spec.evaluator[0].fields.get("content"))
    elif spec.multi_turn_mode:
        raise ValueError(f"unsupported multi_turn_mode: {spec.multi_turn_mode}")
    validate(spec, df)
    if spec.partitions:
        df = df.repartition(spec.partitions)
    verdicts = evaluate(df, list(spec.evaluator), spec.kept, **judging)
    if spec.output_path:
        writers.write_results(verdicts, spec.output_path, spec.kept)
    return verdicts
