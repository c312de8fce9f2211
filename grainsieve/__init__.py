"""Data-quality checks for Spark tables: rules as column expressions, verdicts as tables."""

from .plans.evaluate import Check, Eval, Retention, evaluate
from .plans.job import JobSpec, run_job
from .plans.summary import confusion, label_ratios, overall, score_stats, summary_row, totals
from .registry import RuleConfig, Verdict, catalog, group, judge, rule

__all__ = [
    "Check", "Eval", "JobSpec", "Retention", "RuleConfig", "Verdict", "catalog", "confusion",
    "evaluate", "group", "judge", "label_ratios", "overall", "rule", "run_job", "score_stats",
    "summary_row", "totals",
]
