"""Identifiers, metadata pairs and record shapes."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F, types as ty

from ..functions import fixed as X
from ..functions import text as T
from ..registry import ML8, Verdict, rule
from ..schema import strings

EFFECTIVENESS = "QUALITY_BAD_EFFECTIVENESS"


@rule("RuleDoi", EFFECTIVENESS, ("xinghe",), pattern=r"^10\.\d{4,9}/[^A-Z\s]*\n?\z")
def doi(f, cfg):
    return Verdict(~F.rlike(f.content, F.lit(T.java(cfg.pattern))), strings(f.content))


def weighted_digits(number: Column, weight) -> Column:
    """Sum of weight(position) * digit, positions from 0; a closing X counts ten."""
    chars = F.split(number, "")
    values = F.transform(chars, lambda c, i: F.when(F.upper(c) == "X", 10).otherwise(c.cast("int")) * weight(i))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


@rule("RuleIsbn", EFFECTIVENESS, ("xinghe",))
def isbn(f, cfg):
    n = f.column("isbn", 1, lambda f_: F.replace(f_.content, F.lit("-"), F.lit("")))
    ten = F.rlike(n, F.lit(r"\A[0-9]{9}[0-9Xx]\z")) & (weighted_digits(n, lambda i: F.lit(10) - i) % 11 == 0)
    thirteen = F.rlike(n, F.lit(r"\A97[89][0-9]{10}\z")) & (
        weighted_digits(n, lambda i: F.lit(1) + i % 2 * 2) % 10 == 0)
    return Verdict(~F.coalesce(ten | thirteen, F.lit(False)), strings(n))


@F.pandas_udf(ty.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio; rows without a pair are passed over."""
    return pd.Series([
        None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)],
        dtype="float64")


@rule("RuleMetadataSimilarity", EFFECTIVENESS, ("sciencemetabench",), required=("metadata",),
      threshold=0.6, key_list=["standard", "produced"])
def metadata_similarity(f, cfg):
    if not 0 <= cfg.threshold <= 1:
        raise ValueError(f"threshold must lie in [0, 1], not {cfg.threshold}")
    if len(cfg.key_list) < 2:
        raise ValueError("key_list needs two keys")
    left, right = (f.column(f"metadata_{k}", 0, lambda f_, k=k: F.coalesce(f_.field("metadata")[k].cast("string"), F.lit("")))
                   for k in cfg.key_list[:2])
    a, b = F.lower(left), F.lower(right)
    # cheap answers first; only what is left goes through Python
    known = F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).when(a == b, 1.0)
    easy = f.column("pair_known", 2, lambda f_: known)
    hard = f.column("pair_ratio", 3, lambda f_: matching_ratio(
        F.when(easy.isNull(), a), F.when(easy.isNull(), b)))
    ratio = F.coalesce(easy, hard)
    return Verdict(ratio < cfg.threshold, measure=ratio, score=F.round(ratio, 3))


def _shape(name: str):
    keys, message = X.RECORD_SHAPES[name]

    def build(f, cfg):
        if f.has("raw"):
            present = F.json_object_keys(f.text("raw"))
            ok = F.coalesce(F.size(F.array_except(F.array(*[F.lit(k) for k in keys]), present)) == 0, F.lit(False))
        else:
            # a table has the same keys in every row
            ok = F.lit(set(keys) <= set(f.columns))
        return Verdict(~ok, strings(message))

    return build


for _name in X.RECORD_SHAPES:
    rule(_name, EFFECTIVENESS, ML8, required=())(_shape(_name))
