"""Registry of rules and judges, their groups and default settings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession

MULTI_LANGUAGES = ("ar", "ko", "ru", "th", "vi", "cs", "hu", "sr")
ML8 = tuple(f"multi_lan_{x}" for x in MULTI_LANGUAGES)


@dataclass(frozen=True)
class RuleConfig:
    """Settings of one evaluator.  Fields left at None keep the rule's own value."""

    threshold: float | None = None
    pattern: str | None = None
    key_list: tuple[str, ...] | None = None
    refer_path: tuple[str, ...] | None = None
    parameters: dict | None = None

    def over(self, base: "RuleConfig") -> "RuleConfig":
        given = {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}
        return replace(base, **given)

    @staticmethod
    def of(value: "RuleConfig | dict | None") -> "RuleConfig":
        if value is None:
            return RuleConfig()
        if isinstance(value, RuleConfig):
            return value
        known = {f.name for f in fields(RuleConfig)}
        extra = {k: v for k, v in value.items() if k not in known}
        own = {k: tuple(v) if isinstance(v, list) else v for k, v in value.items() if k in known}
        if extra:
            own["parameters"] = {**(own.get("parameters") or {}), **extra}
        return RuleConfig(**own)

    def option(self, name: str, default):
        return (self.parameters or {}).get(name, default)


@dataclass(frozen=True)
class Verdict:
    """What a rule found out, as columns.

    ``applies`` false leaves the record good and unlabelled; ``measure`` is the number compared
    with the threshold; ``bad_label`` and ``good_label`` replace the standard labels.
    """

    bad: Column
    reason: Column | None = None
    applies: Column | None = None
    measure: Column | None = None
    score: Column | None = None
    bad_label: Column | None = None
    good_label: Column | None = None


@dataclass(frozen=True)
class Rule:
    name: str
    metric_type: str
    groups: tuple[str, ...]
    build: Callable[..., Verdict]
    required: tuple[str, ...] = ("content",)
    defaults: RuleConfig = field(default_factory=RuleConfig)

    @property
    def bad_label(self) -> str:
        return f"{self.metric_type}.{self.name}"


@dataclass(frozen=True)
class Judge:
    """A judge model evaluator: a prompt and a way to score the answer."""

    name: str
    score: Callable[..., Column]
    prompt: str = "{content}"
    required: tuple[str, ...] = ("content",)
    defaults: RuleConfig = field(default_factory=RuleConfig)


RULES: dict[str, Rule] = {}
JUDGES: dict[str, Judge] = {}


def rule(name: str, metric_type: str, groups: tuple[str, ...] | list[str] = (),
         required: tuple[str, ...] = ("content",), **defaults):
    """Register a function ``(features, config) -> Verdict`` as a rule."""

    def add(fn):
        RULES[name] = Rule(name, metric_type, tuple(groups), fn, required, RuleConfig.of(defaults))
        return fn

    return add


def judge(name: str, prompt: str = "{content}", required: tuple[str, ...] = ("content",), **defaults):
    """Register a function ``(judge, response, row, config) -> detail column`` as a judge."""

    def add(fn):
        JUDGES[name] = Judge(name, fn, prompt, required, RuleConfig.of(defaults))
        return fn

    return add


def _load() -> None:
    from .operators import load_all
    load_all()


def group(name: str) -> list[str]:
    """Rule names of a group, in registration order."""
    _load()
    members = [r.name for r in RULES.values() if name in r.groups]
    if not members:
        raise KeyError(f"unknown rule group: {name}")
    return members


def find(name: str) -> Rule | Judge:
    if name in RULES:
        return RULES[name]
    if name in JUDGES:
        return JUDGES[name]
    raise KeyError(f"unknown evaluator: {name}")


def catalog(spark: SparkSession) -> DataFrame:
    """One row per registered evaluator."""
    _load()
    rows = [(r.name, "rule", r.metric_type, sorted(r.groups), list(r.required)) for r in RULES.values()]
    rows += [(j.name, "judge", None, [], list(j.required)) for j in JUDGES.values()]
    return spark.createDataFrame(
        rows, "name string, kind string, metric_type string, groups array<string>, required array<string>")
