"""Judges whose answers hold a list: contexts, questions or claims of one record, summed up to one verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import text as T
from ..registry import judge
from .judging import failed, guarded, items, unfence, unthink, value
from .judges import S, passing
from .scores import claim_verdict


@judge("LLMRAGContextPrecision", required=("prompt", "content"), threshold=5.0)
def context_precision(name, answer, row, cfg):
    """Average precision of the contexts in their order, on a scale of ten."""
    t = unfence(unthink(answer))
    given = items(t, "verdict int, reason string", "verdicts")
    start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("hits"), F.lit(0.0).alias("p"))

    def step(a, x):
        v = F.when(x["verdict"] == 1, 1).otherwise(0)
        hits, seen = a["hits"] + v, a["seen"] + 1
        return F.struct(seen.alias("seen"), hits.alias("hits"), (a["p"] + hits / seen * v).alias("p"))

    score = F.aggregate(given, start, step, lambda a: F.round(a["p"] / (a["hits"] + 1e-10) * 10, 2))
    return passing(name, answer, t, score, cfg, "CONTEXT_PRECISION")


@judge("LLMRAGAnswerRelevancy", required=("prompt", "content"), threshold=5.0)
def answer_relevancy(name, answer, row, cfg):
    """Mean likeness of the question and those made from the answer; nil if all are noncommittal or there is none."""
    t = unfence(unthink(answer))
    given = items(t, "question string, similarity double, noncommittal int", "questions")
    told = F.exists(given, lambda q: F.coalesce(q["noncommittal"], F.lit(0)) == 0)
    mean = F.aggregate(given, F.lit(0.0), lambda a, q: a + F.coalesce(q["similarity"], F.lit(0.0))) / F.size(given)
    return passing(name, answer, t, F.when(told, mean * 10).otherwise(0.0), cfg, "ANSWER_RELEVANCY")


@judge("LLMFactCheckPublic", required=("prompt", "content"), threshold=0.8)
def fact_check(name, answer, row, cfg):
    """Share of claims answered true; a record without claims is good and has no label."""
    t = unfence(unthink(answer))
    given = items(t, "claim string, answer string, reasoning string", "claims")
    true = F.size(F.filter(given, lambda c: F.lower(T.strip(c["answer"])) == "true"))
    ratio = F.when(F.size(given) > 0, true / F.size(given))
    bad = F.coalesce(ratio < cfg.threshold, F.lit(False))
    label = F.when(bad, S("QUALITY_BAD_FACTUALITY.FACTUALITY_CHECK_FAILED")).when(
        ratio.isNotNull(), S("QUALITY_GOOD.FACTUALITY_CHECK_PASSED"))
    reason = F.when(ratio.isNull(), S("No factual claims found")).otherwise(S(F.concat(
        true.cast("string"), F.lit(" of "), F.size(given).cast("string"), F.lit(" claims hold"))))
    return guarded(name, answer, t, value(t, "claims").isNotNull(), schema.detail(name, bad, label, reason, ratio))


@judge("ArticleFactChecker", required=("content",))
def article_check(name, answer, row, cfg):
    """Verdicts of an article's claims: bad if one is false or cannot be verified."""
    t = unfence(unthink(answer))
    given = items(t, "claim string, verification_result string, reasoning string", "claims")
    verdicts = F.transform(given, lambda c: claim_verdict(c["verification_result"], c["reasoning"]))
    count = {v: F.size(verdicts) - F.size(F.array_remove(verdicts, v)) for v in ("TRUE", "FALSE", "UNVERIFIABLE")}
    score = F.when(F.size(verdicts) > 0, F.round(count["TRUE"] / F.size(verdicts), 4))
    label = F.when(count["FALSE"] > 0, S("QUALITY_BAD_ARTICLE_FACTUAL_ERROR")).when(
        count["UNVERIFIABLE"] > 0, S("QUALITY_BAD_ARTICLE_UNVERIFIED_CLAIMS")).otherwise(S(schema.GOOD))
    reason = S(F.concat(*[x for v in ("TRUE", "FALSE", "UNVERIFIABLE") for x in (F.lit(f"{v}: "), count[v].cast("string"), F.lit(" "))]))
    return guarded(name, answer, t, value(t, "claims").isNotNull(), schema.detail(
        name, (count["FALSE"] + count["UNVERIFIABLE"]) > 0, label, reason, score))


@judge("LLMPerspective", required=("content",), threshold=0.6)
def perspective(name, answer, row, cfg):
    """Scores of attributes: bad if one lies above the threshold; no answer counts as a lost service."""
    t = unfence(unthink(answer))
    over = F.map_keys(F.map_filter(F.from_json(t, "map<string, double>"), lambda k, v: v > cfg.threshold))
    bad = F.coalesce(F.size(over) > 0, F.lit(False))
    detail = schema.detail(name, bad, F.when(bad, S("QUALITY_BAD.PERSPECTIVE")).otherwise(S("QUALITY_GOOD.PERSPECTIVE")), F.array_sort(over))
    return F.when(answer.isNull(), failed(name, "API_LOSS", F.lit("no answer"))).otherwise(guarded(name, answer, t, F.lit(True), detail))
