"""Judge models: prompts out, answers in, answers read as JSON columns."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as ty

from .. import schema
from ..functions import fixed as X
from ..functions import text as T
from ..registry import Judge, RuleConfig
from .prompts import PROMPTS


def unfence(c: Column) -> Column:
    """Cut the marks of a code block around an answer."""
    return F.regexp_replace(c, r"\A(?:```json)?(?:```)?|```\z", "")


def unthink(c: Column) -> Column:
    return T.strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def thoughts(c: Column) -> Column:
    return T.strip(F.regexp_extract(c, r"(?s)\A<think>(.*?)</think>", 1))


def is_object(c: Column) -> Column:
    """A JSON object from end to end."""
    return (F.try_parse_json(c).isNotNull() & F.rlike(c, F.lit(f"\\A[{X.SPACE}]*\\{{"))
            & F.rlike(c, F.lit(f"\\}}[{X.SPACE}]*\\z")))


def only_keys(c: Column, *known: str) -> Column:
    return F.size(F.array_except(F.json_object_keys(c), F.array(*[F.lit(k) for k in known]))) == 0


def value(c: Column, path: str) -> Column:
    return F.get_json_object(c, "$." + path)


def number(c: Column, path: str, default: float = 0.0) -> Column:
    return F.coalesce(value(c, path).try_cast("double"), F.lit(default))


def whole(c: Column, path: str) -> Column:
    """An integer, also when written as 1.0 or "1"."""
    v = value(c, path)
    return F.when(F.rlike(v, F.lit(r"\A[+-]?[0-9]+(\.0+)?\z")), v.try_cast("double").cast("int"))


def items(c: Column, ddl: str, path: str) -> Column:
    """A list of objects; anything else is an empty list."""
    return F.coalesce(F.from_json(value(c, path), f"array<struct<{ddl}>>", {"allowSingleQuotes": "false"}),
                      F.array().cast(f"array<struct<{ddl}>>"))


def failed(name: str, error: str, answer: Column) -> Column:
    return schema.detail(name, F.lit(True), schema.strings(f"QUALITY_BAD.{error}"), schema.strings(answer))


def guarded(name: str, answer: Column, text: Column, valid: Column, good: Column,
            parse_error: str = "ConvertJsonError") -> Column:
    """``good`` where the answer holds what it must, else the error verdict."""
    return (F.when(answer.isNull(), failed(name, "MissingAnswer", F.lit("no answer")))
            .when(~is_object(text), failed(name, parse_error, text))
            .when(~F.coalesce(valid, F.lit(False)), failed(name, "ValidationError", text))
            .otherwise(good))


def prompts(template: str, fields: dict[str, Column]) -> Column:
    """Fill ``{field}`` marks of a template with columns."""
    parts, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(head), T.as_text(fields[name])]
    return F.concat(*parts, F.lit(rest))


def numbered_contexts(contexts: Column) -> Column:
    """The texts of a list, each under its number."""
    return F.array_join(F.transform(contexts, lambda c, i: F.concat(
        F.lit("Context "), (i + 1).cast("string"), F.lit(":\n"), c)), "\n\n")


def _shown(df: DataFrame, name: str) -> Column:
    """A mapped column as prompts show it; lists of texts are numbered."""
    kind = df.select(F.col(name)).schema[0].dataType
    texts = isinstance(kind, ty.ArrayType) and isinstance(kind.elementType, ty.StringType)
    return numbered_contexts(F.col(name)) if texts else F.col(name)


def ask(scorer, tries: int = 3, pause: float = 1.0):
    """Arrow function around a user's scorer: struct(answer, error).

    A batch that fails is tried again after a pause, but not if its content was refused (ValueError and its kinds);
    when tries run out its answers are null and carry the name of the error.
    """

    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, error = None, None
            for attempt in range(tries):
                try:
                    answers, error = list(scorer(batch)), None
                    break
                except Exception as e:  # noqa: BLE001 - the service may fail in any way
                    answers, error = [None] * len(batch), type(e).__name__
                    if isinstance(e, ValueError):
                        break
                    if attempt < tries - 1:
                        time.sleep(pause)
            yield pd.DataFrame({"answer": pd.Series(answers, dtype="object"), "error": pd.Series([error] * len(batch), dtype="object")})

    return F.pandas_udf(call, "struct<answer: string, error: string>")


def attach_responses(df: DataFrame, judged, *, id_col, responses, scorer) -> DataFrame:
    """Add ``__answer<n>`` per judge: one join with stored answers, or calls of the scorer."""
    if responses is not None:
        if not id_col:
            raise ValueError("stored responses are joined by id_col")
        names = {j.name for _, _, j in judged}
        lost = F.lit(None).cast("string")
        wide = (responses.where(F.col("metric").isin(*names)).groupBy(id_col).agg(*[
            F.max(F.when(F.col("metric") == n, F.col("response"))).alias(f"__of_{n}") for n in sorted(names)]))
        df = df.join(wide, id_col, "left")
        answers = {f"__answer{n}": F.struct(F.col(f"__of_{j.name}").alias("answer"), lost.alias("error"))
                   for n, (_, _, j) in enumerate(judged)}
    elif scorer is not None:
        call = ask(scorer)
        answers = {}
        for n, (check, ev, j) in enumerate(judged):
            template = ev.config.option("prompt", PROMPTS.get(j.name, j.prompt))
            fields = {k: _shown(df, v) for k, v in check.fields.items()}
            answers[f"__answer{n}"] = call(prompts(template, fields))
    else:
        raise ValueError("judges need stored responses or a scorer")
    return df.withColumns(answers)


def judge_detail(j: Judge, config: RuleConfig, check, answer: Column, error: Column | None = None) -> Column:
    """The judge's verdict on an answer; where there is an error instead, its name is the label."""
    row = {k: F.col(v) for k, v in check.fields.items()}
    detail = j.score(j.name, answer, row, config.over(j.defaults))
    if error is None:
        return detail
    named = schema.detail(j.name, F.lit(True), schema.strings(F.concat(F.lit("QUALITY_BAD."), error)), schema.strings("no answer"))
    return F.when(error.isNotNull(), named).otherwise(detail)
