"""How the answers of judge models become verdicts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import schema
from ..functions import fixed as X
from ..functions import text as T
from ..registry import judge
from .judging import (guarded, is_object, items, number, only_keys, thoughts, unfence, unthink, value, whole)

S = schema.strings


def text_of(c: Column, path: str, default: str = "") -> Column:
    return F.coalesce(value(c, path), F.lit(default))


def dotted(*parts: Column | str) -> Column:
    return F.concat_ws(".", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def threshold_detail(name: str, score: Column, cfg, good: str, bad: str, reason: Column | None = None) -> Column:
    ok = score >= cfg.threshold
    return schema.detail(name, ~ok, F.when(ok, S(good)).otherwise(S(bad)), reason, score)


# --- plain scores --------------------------------------------------------------------------

def score_reason(name, answer, row, cfg):
    t = unfence(answer)
    score = whole(t, "score")
    detail = schema.detail(name, score != 1, F.when(score == 1, S(schema.GOOD)).otherwise(S(f"QUALITY_BAD.{name}")),
                           S(text_of(t, "reason")))
    return guarded(name, answer, t, score.isNotNull() & only_keys(t, "score", "reason"), detail)


for _n in ("LLMTextQualityV2", "LLMTextKaoti", "VLMImageRelevant",
           *[f"LLMTextLanguage{x}" for x in ("Ar", "Cs", "Hu", "Ko", "Ru", "Sr", "Th", "Vi")]):
    judge(_n, prompt="Rate this text. Answer with JSON: score, reason.\n{content}")(score_reason)


def typed(good_label=None, always=False, with_score=False, error="ConvertJsonError", trim=False):
    """Answers with score, type, name and reason."""

    def read(name, answer, row, cfg):
        t = T.strip(unfence(answer)) if trim else unfence(answer)
        score = whole(t, "score")
        label = S(dotted(text_of(t, "type", "Type"), text_of(t, "name", "Name")))
        if not always:
            label = F.when(score == 1, S(good_label or schema.GOOD)).otherwise(label)
        detail = schema.detail(name, score != 1, label, S(text_of(t, "reason")), score if with_score else None)
        return guarded(name, answer, t, score.isNotNull() & only_keys(t, "score", "type", "name", "reason"), detail, error)

    return read


_ASK_TYPED = "Judge this text. Answer with JSON: score, type, name, reason.\n{content}"
for _n in ("LLMTextQualityV4", "LLMTextQualityV5", "LLMTextEquation", "LLMTextTable"):
    judge(_n, prompt=_ASK_TYPED)(typed(with_score=True, error="JSONDecodeError", trim=True))
for _n in ("LLMTextRepeat", "LLMTextUnreadIssue", "LLMTextWordStick", "LLMTextCodeListIssue"):
    judge(_n, prompt=_ASK_TYPED)(typed())
judge("LLMTextChaos", prompt=_ASK_TYPED)(typed(good_label="QUALITY_GOOD.LLMTextChaos"))
judge("LLMDatamanAssessment", prompt=_ASK_TYPED)(typed(always=True))


@judge("LLMTextQualityV3", prompt=_ASK_TYPED)
def multi_label(name, answer, row, cfg):
    t = unfence(answer)
    score = number(t, "score")

    def listed(path: str) -> Column:
        v = value(t, path)
        return F.when(F.startswith(v, F.lit("[")), F.from_json(v, "array<string>")).when(v.isNotNull(), F.array(v)) \
            .otherwise(F.array().cast("array<string>"))

    kinds, names = listed("type"), listed("name")
    pairs = F.transform(F.slice(F.arrays_zip(kinds.alias("t"), names.alias("n")), F.lit(1),
                                F.least(F.size(kinds), F.size(names))), lambda p: dotted(p["t"], p["n"]))
    label = F.when(score == 1, S(schema.GOOD)).when(F.size(pairs) > 0, pairs).otherwise(S(f"QUALITY_BAD.{name}"))
    return guarded(name, answer, t, F.lit(True), schema.detail(name, score != 1, label, S(text_of(t, "reason"))))


def three_h(kind: str):
    def read(name, answer, row, cfg):
        t = unfence(answer)
        score = whole(t, "score")
        label = F.when(score == 1, S(f"QUALITY_GOOD.{kind}")).otherwise(S(f"QUALITY_BAD.NOT_{kind}"))
        return guarded(name, answer, t, score.isNotNull() & only_keys(t, "score", "reason"),
                       schema.detail(name, score != 1, label, S(text_of(t, "reason"))))
    return read


for _k in ("Helpful", "Honest", "Harmless"):
    judge(f"LLMText3H{_k}", prompt=f"Is the answer {_k.lower()}? Answer with JSON: score, reason.\n{{prompt}}\n{{content}}",
          required=("prompt", "content"))(three_h(_k.upper()))


def security(name, answer, row, cfg):
    t = unfence(answer)
    hits = F.map_keys(F.map_filter(F.from_json(t, "map<string,string>"), lambda k, v: v == "pos"))
    return guarded(name, answer, t, F.lit(True), schema.detail(name, F.size(hits) > 0, S(f"Security.{name}"), hits))


for _n in ("LLMSecurityPolitics", "LLMSecurityProhibition"):
    judge(_n, prompt="Mark each topic pos or neg, as JSON.\n{content}")(security)


def classify(name, answer, row, cfg):
    t = unfence(answer)
    kind = value(t, "name")
    return guarded(name, answer, t, kind.isNotNull() & only_keys(t, "name", "reason"),
                   schema.detail(name, F.lit(False), S(dotted(name, kind)), S(text_of(t, "reason"))))


for _n in ("LLMClassifyTopic", "LLMClassifyQR"):
    judge(_n, prompt="Name the class of this record. Answer with JSON: name, reason.\n{content}")(classify)


def meta_rater(name, answer, row, cfg):
    t = unfence(answer)
    score = number(t, "score")
    ok = score >= 3
    reason = F.concat(F.lit("Score: "), text_of(t, "score", "0"), F.lit("/5. "), text_of(t, "reason"))
    return guarded(name, answer, t, F.lit(True), schema.detail(
        name, ~ok, F.when(ok, S(f"{name}.HighQuality")).otherwise(S(f"{name}.LowQuality")), S(reason)))


for _n in ("Cleanliness", "Professionalism", "Readability", "Reasoning"):
    judge(f"LLMMetaRater{_n}", prompt="Rate from 1 to 5. Answer with JSON: score, reason.\n{content}")(meta_rater)


def or_error(name: str, answer: Column, t: Column, valid: Column, good: Column, label: str) -> Column:
    error = schema.detail(name, F.lit(True), S(label), S(F.coalesce(answer, F.lit("no answer"))), F.lit(0.0))
    return F.when(F.coalesce(is_object(t) & valid, F.lit(False)), good).otherwise(error)


@judge("LLMInstructionClarity", threshold=6.0)
def instruction_clarity(name, answer, row, cfg):
    t = T.strip(unfence(T.strip(answer)))
    given = value(t, "score")
    good = threshold_detail(name, number(t, "score"), cfg, "QUALITY_GOOD.INSTRUCTION_CLARITY_PASS",
                            "QUALITY_BAD.INSTRUCTION_CLARITY_FAIL", S(text_of(t, "reason")))
    return or_error(name, answer, t, given.isNull() | given.try_cast("double").isNotNull(), good,
                    "QUALITY_BAD.INSTRUCTION_CLARITY_ERROR")


@judge("LLMTaskDifficulty", min_difficulty=0, max_difficulty=10)
def task_difficulty(name, answer, row, cfg):
    t = T.strip(unfence(T.strip(answer)))
    given, score = value(t, "difficulty_score"), number(t, "difficulty_score")
    low, high = cfg.option("min_difficulty", 0), cfg.option("max_difficulty", 10)
    label = (F.when(score < low, S("QUALITY_BAD.TASK_TOO_EASY")).when(score > high, S("QUALITY_BAD.TASK_TOO_HARD"))
             .otherwise(S(F.concat(F.lit("TASK_DIFFICULTY."), F.upper(text_of(t, "difficulty_level", "Unknown"))))))
    good = schema.detail(name, (score < low) | (score > high), label, S(text_of(t, "reason")), score)
    return or_error(name, answer, t, given.isNull() | given.try_cast("double").isNotNull(), good,
                    "QUALITY_BAD.TASK_DIFFICULTY_ERROR")


# --- retrieval -----------------------------------------------------------------------------

def passing(name, answer, t, score, cfg, what, reason=None):
    return guarded(name, answer, t, F.lit(True), threshold_detail(
        name, score, cfg, f"QUALITY_GOOD.{what}_PASS", f"QUALITY_BAD.{what}_FAIL", reason))


@judge("LLMRAGFaithfulness", required=("prompt", "content"), threshold=5.0)
def faithfulness(name, answer, row, cfg):
    t = unfence(answer)
    given = items(t, "statement string, verdict int, reason string", "statements")
    true = F.size(F.filter(given, lambda s: s["verdict"] == 1))
    reason = F.concat(true.cast("string"), F.lit(" of "), F.size(given).cast("string"), F.lit(" statements faithful"))
    return passing(name, answer, t, number(t, "score"), cfg, "FAITHFULNESS", S(reason))


@judge("LLMRAGContextRecall", required=("prompt", "content"), threshold=5.0)
def context_recall(name, answer, row, cfg):
    t = unfence(answer)
    given = items(t, "statement string, attributed int, reason string", "classifications")
    hits = F.size(F.filter(given, lambda s: s["attributed"] == 1))
    score = F.when(F.size(given) > 0, hits / F.size(given) * 10).otherwise(F.lit(0.0))
    detail = passing(name, answer, t, score, cfg, "CONTEXT_RECALL")
    nothing = schema.detail(name, F.lit(True), S("QUALITY_BAD.CONTEXT_RECALL_NO_REFERENCE"), None, F.lit(0.0))
    reference = T.as_text(row["content"]) if "content" in row else F.lit("")
    return F.when(reference == "", nothing).otherwise(detail)


@judge("LLMRAGContextRelevancy", required=("prompt", "content"), threshold=5.0)
def context_relevancy(name, answer, row, cfg):
    t = unfence(answer)
    return passing(name, answer, t, number(t, "rating") / 2 * 10, cfg, "CONTEXT_RELEVANCY")


@judge("LLMHallucination", required=("content",), threshold=0.5)
def hallucination(name, answer, row, cfg):
    t = unfence(answer)
    given = items(t, "verdict string, reason string", "verdicts")
    no = F.size(F.filter(given, lambda v: F.lower(T.strip(v["verdict"])) == "no"))
    share = F.when(F.size(given) > 0, no / F.size(given)).otherwise(F.lit(0.0))
    bad = share > cfg.threshold
    detail = guarded(name, answer, t, value(t, "verdicts").isNotNull(), schema.detail(
        name, bad, F.when(bad, S("QUALITY_BAD_HALLUCINATION.HALLUCINATION_DETECTED"))
        .otherwise(S("QUALITY_GOOD.NO_HALLUCINATION")), S(F.concat(F.lit("Hallucination score: "), share.cast("string")))),
        "ConvertJsonError")
    if "context" not in row:
        return detail
    return F.when(T.as_text(row["context"]) == "", schema.detail(
        name, F.lit(True), S("QUALITY_BAD.MISSING_CONTEXT"), S("Context is required"))).otherwise(detail)


# --- comparisons ---------------------------------------------------------------------------



def winner(score: Column) -> Column:
    return F.when(score == 1, "TOOL_ONE_BETTER").when(score == 2, "TOOL_TWO_BETTER")


def html_compare(name, answer, row, cfg):
    t = unfence(F.when(F.startswith(answer, F.lit("<think>")), unthink(answer)).otherwise(answer))
    score = whole(t, "score")
    kind = F.coalesce(winner(score), F.when(score == 0, "TOOL_EQUAL"), F.lit(""))
    valid = score.isNotNull() & value(t, "reason").isNotNull() & only_keys(t, "score", "type", "name", "reason")
    return guarded(name, answer, t, valid, schema.detail(
        name, score != 1, S(F.concat(kind, F.lit("."), text_of(t, "name", "Name"))),
        S(F.concat(text_of(t, "reason"), F.lit("\n"), thoughts(answer)))))


for _n in ("LLMHtmlExtractCompare", "LLMHtmlExtractCompareEn"):
    judge(_n, required=("content",))(html_compare)


@judge("LLMHtmlExtractCompareV2")
def html_compare_v2(name, answer, row, cfg):
    pick = F.coalesce(*[F.nullif(F.regexp_extract(answer, p, 1), F.lit("")) for p in (
        "<Judgement>([ABC])</Judgement>", f"判断[：:][{X.SPACE}]*([ABC])", f"答案[：:][{X.SPACE}]*([ABC])")])
    kind = F.when(pick == "A", "TOOL_ONE_BETTER").when(pick == "B", "TOOL_EQUAL").otherwise("TOOL_TWO_BETTER")
    rest = T.strip(F.regexp_replace(answer, "<Judgement>[ABC]</Judgement>", ""))
    error = schema.detail(name, F.lit(True), S("QUALITY_BAD.ValueError"), S(F.coalesce(answer, F.lit("no answer"))))
    return F.when(pick.isNull(), error).otherwise(schema.detail(
        name, pick == "C", S(F.concat(kind, F.lit(".Judgement_"), pick)), S(rest)))


def block_compare(what: str, missing: str):
    def read(name, answer, row, cfg):
        t = unfence(unthink(answer))
        none = F.coalesce(value(t, f"no_{missing}").isin("true", "1"), F.lit(False))
        score = number(t, "score")
        label = F.when(none, f"NO_{missing.upper()}.{what}").otherwise(
            F.concat(F.coalesce(winner(score), F.lit("TOOL_EQUAL")), F.lit(f".{what}")))
        return guarded(name, answer, t, F.lit(True), schema.detail(
            name, ~none & (score != 1), S(label), S(text_of(t, "reason"))))
    return read


for _n, _w, _m in (("LLMCodeCompare", "code", "code"), ("LLMMathCompare", "math", "formula"),
                   ("LLMTableCompare", "table", "table")):
    judge(_n)(block_compare(_w, _m))


# --- lists of errors -----------------------------------------------------------------------

def error_pairs(t: Column) -> Column:
    given = items(t, "error_category string, error_label string", "errors")
    return F.filter(given, lambda e: (F.coalesce(e["error_category"], F.lit("")) != "")
                    & (F.coalesce(e["error_label"], F.lit("")) != ""))


def errors_of(embedded: bool, joined: bool):
    def read(name, answer, row, cfg):
        t = F.regexp_substr(answer, F.lit(r'(?s)\{.*"errors".*\}')) if embedded \
            else F.regexp_replace(answer, "```(?:json)?", "")
        pairs = error_pairs(t)
        if joined:
            label = S(F.concat(F.array_join(F.transform(pairs, lambda e: e["error_category"]), "."), F.lit("."),
                               F.array_join(F.transform(pairs, lambda e: e["error_label"]), ".")))
        else:
            label = F.transform(pairs, lambda e: dotted(e["error_category"], e["error_label"]))
        return schema.detail(name, F.lit(False), label, S(F.coalesce(t, answer)))
    return read


judge("VLMDocumentParsing")(errors_of(False, False))
judge("VLMDocumentParsingOCRTrain")(errors_of(True, False))
judge("LLMMinerURecognizeQuality")(errors_of(True, True))


@judge("VLMLayoutQuality")
def layout_quality(name, answer, row, cfg):
    t = F.regexp_replace(answer, "```(?:json)?", "")
    found = F.transform(items(t, "eval_details string", "errors"), lambda e: e["eval_details"])
    return schema.detail(name, F.lit(False), F.filter(found, lambda x: F.coalesce(x, F.lit("")) != ""), S(t))


# --- resumes and jobs ----------------------------------------------------------------------

@judge("LLMResumeQuality")
def resume_quality(name, answer, row, cfg):
    t = unfence(answer)
    score, kind = whole(t, "score"), text_of(t, "type", "Type")
    good = (kind == "Good") & (score == 1)
    prefix = F.when(kind.isin(*X.RESUME_ISSUES), F.concat(F.lit("RESUME_QUALITY_BAD_"), F.upper(kind))) \
        .otherwise("RESUME_QUALITY_BAD")
    label = F.when(good, S("QUALITY_GOOD.ResumeQualityGood")).otherwise(S(dotted(prefix, text_of(t, "name", "Name"))))
    return guarded(name, answer, t, score.isNotNull() & only_keys(t, "score", "type", "name", "reason"),
                   schema.detail(name, ~good, label, S(text_of(t, "reason"))))


@judge("LLMKeywordMatcher", required=("content", "prompt"), threshold=0.6)
def keyword_matcher(name, answer, row, cfg):
    t = T.strip(unfence(unthink(answer)))
    given = items(t, "keyword string, importance string, match_status string", "keyword_analysis")

    def weight(k: Column) -> Column:
        kind = F.lower(k["importance"])
        return F.when(kind == "required", 2).when(kind == "nice-to-have", 1).otherwise(0)

    total = F.aggregate(given, F.lit(0), lambda a, k: a + weight(k))
    got = F.aggregate(F.filter(given, lambda k: F.lower(k["match_status"]) == "matched"), F.lit(0),
                      lambda a, k: a + weight(k))
    score = F.when(total > 0, got / total).otherwise(F.lit(0.0))
    detail = guarded(name, answer, t, F.lit(True),
                     threshold_detail(name, score, cfg, schema.GOOD, f"QUALITY_BAD.{name}"))
    for need in ("content", "prompt"):
        if need in row:
            detail = F.when(T.as_text(row[need]) == "", schema.detail(
                name, F.lit(True), S(f"QUALITY_BAD.{name}"), S(f"{need} is required"))).otherwise(detail)
    return detail


@judge("LLMLongVideoQa")
def long_video_qa(name, answer, row, cfg):
    return schema.detail(name, F.lit(False), S("text.qa_pairs"), S(answer))


@judge("LLMScout", required=("content", "prompt"), threshold=0.5)
def scout(name, answer, row, cfg):
    t = unfence(unthink(answer))
    t = F.regexp_substr(t, F.lit(r"(?s)\{.*\}"))
    sub = ", ".join(f"{k}: struct<score: double>" for k in X.SCOUT_WEIGHTS)
    ddl = (f"name string, match_score double, financial_status string, scoring_breakdown struct<{sub}>, "
           "financial_evidence struct<confidence: double, conflicting_signals: string>")
    given = F.when(value(t, "strategy_context").isNotNull(), items(t, ddl, "strategy_context.target_companies")) \
        .otherwise(items(t, ddl, "target_companies"))
    kept = F.filter(given, lambda c: (F.coalesce(c["financial_status"], F.lit("unknown")) != "contraction")
                    & (F.when(c["financial_evidence"].isNull(), 0.5)
                       .otherwise(F.coalesce(c["financial_evidence"]["confidence"], F.lit(0.0))) >= 0.5))
    score = F.coalesce(F.array_max(F.transform(kept, company_score)), F.lit(0.0))
    return guarded(name, answer, t, F.lit(True),
                   threshold_detail(name, score, cfg, schema.GOOD, f"QUALITY_BAD.{name}"))


def company_score(c: Column) -> Column:
    """Weighted mean of the sub-scores present; without any the given score, else one half."""
    parts = {k: c["scoring_breakdown"][k]["score"] for k in X.SCOUT_WEIGHTS}
    got = sum((F.coalesce(p * X.SCOUT_WEIGHTS[k], F.lit(0.0)) for k, p in parts.items()), F.lit(0.0))
    weight = sum((F.when(p.isNotNull(), X.SCOUT_WEIGHTS[k]).otherwise(0.0) for k, p in parts.items()), F.lit(0.0))
    mean = F.when(weight > 0, F.round(got / weight, 2))
    return F.when(c["scoring_breakdown"].isNull(), F.coalesce(c["match_score"], F.lit(0.5))) \
        .otherwise(F.coalesce(mean, F.lit(0.5)))


# --- agents --------------------------------------------------------------------------------

def phrase(words: list[str]) -> Column:
    return F.lit("|".join(words))


@judge("AgentFactCheck")
def agent_fact_check(name, answer, row, cfg):
    told = F.upper(F.regexp_extract(answer, f"(?iu)HALLUCINATION_DETECTED:[{X.SPACE}]*(YES|NO)", 1))
    low = F.lower(answer)
    # without a plain word behind it, the marker's own line may still name one, in brackets or bold
    first = F.element_at(F.split(F.upper(T.strip(answer)), "\n"), 1)
    marked = F.startswith(first, F.lit("HALLUCINATION_DETECTED:"))
    bad = (F.when(told != "", told == "YES")
           .when(marked & F.contains(first, F.lit("YES")), True)
           .when(marked & F.contains(first, F.lit("NO")), False)
           .when(F.rlike(low, phrase(X.NO_HALLUCINATION_PHRASES)), False)
           .otherwise(F.rlike(low, phrase(X.HALLUCINATION_PHRASES))))
    empty = T.is_blank(T.as_text(answer))
    error = schema.detail(name, F.lit(True), S("QUALITY_BAD_AGENT_ERROR"), S("Agent returned empty output."))
    return F.when(empty, error).otherwise(schema.detail(
        name, bad, F.when(bad, S("QUALITY_BAD_HALLUCINATION")).otherwise(S(schema.GOOD)), S(answer)))
