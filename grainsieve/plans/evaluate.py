"""From checks to one projection of verdicts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema
from ..operators import load_all
from ..registry import Judge, Rule, RuleConfig, Verdict, find, group
from .features import Features, bind

STATUS, DETAILS = "eval_status", "eval_details"


@dataclass(frozen=True)
class Eval:
    name: str
    config: RuleConfig = field(default_factory=RuleConfig)


@dataclass(frozen=True)
class Check:
    """Evaluators and the columns they look at: evaluator field -> column (or column expression)."""

    fields: dict[str, str] = field(default_factory=dict)
    evals: tuple[Eval, ...] = ()

    @staticmethod
    def of(fields: dict[str, str], evals, **config) -> "Check":
        load_all()
        out = []
        for e in evals:
            if isinstance(e, Eval):
                out.append(e)
            elif isinstance(e, str):
                out.append(Eval(e, RuleConfig.of(config.get(e))))
            else:
                out.append(Eval(e["name"], RuleConfig.of(e.get("config"))))
        return Check(dict(fields), tuple(out))

    @staticmethod
    def group(fields: dict[str, str], name: str, without: tuple[str, ...] = (), **config) -> "Check":
        """All members of a rule group but those named in ``without``; a member whose fields are not mapped is an error."""
        load_all()
        members = [n for n in group(name) if n not in without]
        lost = {n: missing for n in members if fields and (missing := sorted(set(find(n).required) - set(fields)))}
        if lost:
            raise ValueError(f"group {name} needs fields that are not mapped, or its members named in without: {lost}")
        return Check.of(fields, members, **config)

    @property
    def key(self) -> str:
        return ",".join(self.fields.values()) if self.fields else "default"


@dataclass(frozen=True)
class Retention:
    """Which verdicts stay with a record."""

    bad: bool = True
    good: bool = False
    all_labels: bool = False
    raw: bool = False
    merge: bool = False


def _fields(check: Check, required: tuple[str, ...], columns: list[str]) -> dict[str, Column]:
    if not check.fields:
        return {c: F.col(f"`{c}`") for c in columns}
    missing = [r for r in required if r not in check.fields]
    if missing:
        raise ValueError(f"check on {check.key} does not map field(s) {missing}")
    return {k: F.col(v) for k, v in check.fields.items()}


def verdict_columns(df: DataFrame, checks: list[Check]) -> tuple[DataFrame, list[tuple[Check, Eval, Rule, str, Verdict]]]:
    """Add the features and one boolean column per rule; reasons stay expressions on top."""
    load_all()
    source = list(df.columns)
    features: dict[str, Features] = {}
    planned = []
    for check in checks:
        for ev in check.evals:
            r = find(ev.name)
            if isinstance(r, Judge):
                continue
            key = repr(sorted(check.fields.items()))
            if key not in features:
                features[key] = Features(f"__f{len(features)}_", _fields(check, (), source), source)
            _fields(check, r.required, source)
            v = r.build(features[key], ev.config.over(r.defaults))
            planned.append((check, ev, r, f"__bad{len(planned)}", v))
    for f in features.values():
        df = f.add_to(df)
    flags = {}
    for _, _, _, name, v in planned:
        bad = F.coalesce(v.bad, F.lit(False))
        flags[name] = bad if v.applies is None else F.coalesce(v.applies, F.lit(False)) & bad
    return bind(df, flags), planned


def detail_of(r: Rule, flag: str, v: Verdict) -> Column:
    bad = F.col(flag)
    good_label = schema.strings(schema.GOOD if v.good_label is None else v.good_label)
    bad_label = schema.strings(r.bad_label if v.bad_label is None else v.bad_label)
    label = F.when(bad, bad_label)
    label = label.otherwise(good_label) if v.applies is None else label.when(v.applies, good_label)
    reason = None if v.reason is None else F.when(bad, v.reason)
    return schema.detail(r.name, bad, label, reason, v.score)


def keep(details: Column, bad: Column, kept: Retention) -> Column:
    """Verdicts kept of one field group: the failing ones of a bad record, else all on request."""
    if kept.all_labels or kept.merge:
        return details
    passing = F.filter(details, lambda d: ~d["status"])
    none = F.lit(None).cast(f"array<{schema.DETAIL.simpleString()}>")
    return F.when(bad, F.filter(details, lambda d: d["status"])).otherwise(passing if kept.good else none)


def evaluate(df: DataFrame, checks: list[Check], kept: Retention = Retention(), *,
             id_col: str | None = None, responses: DataFrame | None = None,
             scorer=None) -> DataFrame:
    """The input columns with ``eval_status`` and ``eval_details`` (field key -> verdicts).

    Judges take their answers from ``responses(id_col, metric, response)`` or from ``scorer``,
    a function from a pandas Series of prompts to a Series of answers.
    """
    from ..operators.judging import attach_responses, judge_detail

    source = list(df.columns)
    judged = [(c, e, find(e.name)) for c in checks for e in c.evals if isinstance(find_safe(e.name), Judge)]
    if judged:
        df = attach_responses(df, judged, id_col=id_col, responses=responses, scorer=scorer)
    flagged, planned = verdict_columns(df, checks)

    rules: dict[int, list[Column]] = {}
    judges: dict[int, list[Column]] = {}
    for check, ev, r, flag, v in planned:
        rules.setdefault(id(check), []).append(detail_of(r, flag, v))
    for n, (check, ev, j) in enumerate(judged):
        judges.setdefault(id(check), []).append(judge_detail(
            j, ev.config, check, F.col(f"__answer{n}")["answer"], F.col(f"__answer{n}")["error"]))

    # one array column per check and kind, then the retention rule on each of them
    arrays = {}
    for i, check in enumerate(checks):
        for kind, parts in (("r", rules.get(id(check))), ("j", judges.get(id(check)))):
            if parts:
                arrays[f"__{kind}{i}"] = F.array(*parts)
    staged = bind(flagged, arrays)
    bad = {n: F.exists(F.col(n), lambda d: d["status"]) for n in arrays}

    by_key: dict[str, list[Column]] = {}
    for i, check in enumerate(checks):
        for kind in "rj":
            n = f"__{kind}{i}"
            if n in arrays:
                by_key.setdefault(check.key, []).append(keep(F.col(n), bad[n], kept))
    status = F.lit(False)
    for b in bad.values():
        status = status | b
    empty = F.array().cast(f"array<{schema.DETAIL.simpleString()}>")
    entries = []
    for key, parts in by_key.items():
        given = F.lit(False)
        for p in parts:
            given = given | p.isNotNull()
        merged = F.concat(*[F.coalesce(p, empty) for p in parts]) if len(parts) > 1 else F.coalesce(parts[0], empty)
        entries.append(F.when(given, F.struct(F.lit(key).alias("key"), merged.alias("value"))))
    return staged.select(
        *[F.col(f"`{c}`") for c in source],
        status.alias(STATUS),
        F.map_from_entries(F.array_compact(F.array(*entries))).alias(DETAILS))


def find_safe(name: str):
    load_all()
    return find(name)


def flags(df: DataFrame, checks: list[Check], id_cols: list[str]) -> DataFrame:
    """Wide form: one boolean column per rule, no labels or reasons."""
    flagged, planned = verdict_columns(df, checks)
    return flagged.select(*id_cols, *[F.col(f).alias(ev.name) for _, ev, _, f, _ in planned])


def verdicts_of(df: DataFrame, check: Check, id_cols: list[str]) -> DataFrame:
    """Long-lived form for a single rule: ids, status, label, measure."""
    flagged, planned = verdict_columns(df, [check])
    (_, _, r, flag, v), = planned
    d = detail_of(r, flag, v)
    measure = F.lit(None) if v.measure is None else v.measure
    return flagged.select(
        *id_cols, F.col(flag).alias("status"),
        F.array_join(d["label"], "|").alias("label"),
        measure.cast("double").alias("measure"), d["reason"].alias("reason"))


def with_result(verdicts: DataFrame) -> DataFrame:
    """Original columns and one ``result`` struct."""
    rest = [c for c in verdicts.columns if c not in (STATUS, DETAILS)]
    return verdicts.select(*rest, F.struct(STATUS, DETAILS).alias("result"))


def bad_rows(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(F.col(STATUS))


def good_rows(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(~F.col(STATUS))


def merge_partials(parts: list[DataFrame], id_col: str) -> DataFrame:
    """Join verdicts of one record that come from separate plans: OR of status, joined details."""
    whole = None
    for i, p in enumerate(parts):
        one = p.select(id_col, STATUS, DETAILS, F.lit(i).alias("part"))
        whole = one if whole is None else whole.unionByName(one)
    long = whole.select(id_col, STATUS, "part", F.explode_outer(F.map_entries(DETAILS)).alias("e"))
    ordered = F.array_sort(F.collect_list(F.struct("part", F.col("e.value").alias("value"))),
                           lambda a, b: a["part"] - b["part"])  # at most one entry a part
    per_key = long.groupBy(id_col, F.col("e.key").alias("key")).agg(
        F.bool_or(STATUS).alias(STATUS), F.flatten(F.filter(F.transform(ordered, lambda x: x["value"]), lambda v: v.isNotNull())).alias("value"))
    return per_key.groupBy(id_col).agg(
        F.bool_or(STATUS).alias(STATUS),
        F.map_from_entries(F.filter(F.collect_list(F.struct("key", "value")),
                                    lambda x: x["key"].isNotNull())).alias(DETAILS))
