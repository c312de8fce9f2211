"""Judges on answers that are spelled out from the documents table.

The answer text is built by the same SQL on both sides; the twin states the verdict from the
columns the answer was made of.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from grainsieve.operators import load_all
from grainsieve.operators.judging import judge_detail
from grainsieve.plans.evaluate import Check
from grainsieve.registry import JUDGES, RuleConfig

from . import query, table

load_all()

# numbers the answers are made of
A, B, C = "(n_chars % 3)", "(n_chars % 7)", "(doc_id % 5)"
BROKEN = "(n_chars % 11 = 0)"
EXTRA = "(n_chars % 13 = 0)"


def obj(**parts: str) -> str:
    """JSON text: values are SQL giving JSON text."""
    return "'{' || " + " || ', ' || ".join(f"'\"{k}\": ' || {v}" for k, v in parts.items()) + " || '}'"


def quoted(sql: str) -> str:
    return f"'\"' || {sql} || '\"'"


def num(sql: str) -> str:
    return f"cast({sql} AS VARCHAR(20))"


LANG, SRC = quoted("lang"), quoted("source")
TAIL = f"CASE WHEN {EXTRA} THEN ', \"more\": 1' ELSE '' END"


def wrapped(body: str, strict: bool) -> str:
    if strict:
        body = body[:-len("'}'")] + TAIL + " || '}'"
    return f"CASE WHEN {BROKEN} THEN 'no json' WHEN n_chars % 2 = 0 THEN '```json' || {body} || '```' ELSE {body} END"


SCORE_REASON = obj(score=num(A), reason=LANG)
TYPED = obj(score=num(A), type=LANG, name=SRC, reason=LANG)


def listing(n: str, item: str, upto: int = 6) -> str:
    """A JSON list of the first n (< upto) items; item is SQL with {i}."""
    parts = [f"CASE WHEN {n} > {i} THEN '{', ' if i else ''}' || {item.format(i=i)} ELSE '' END" for i in range(upto)]
    return "'[' || " + " || ".join(parts) + " || ']'"


def hits(n: str, cond: str, upto: int = 6) -> str:
    return "(" + " + ".join(f"CASE WHEN {n} > {i} AND {cond.format(i=i)} THEN 1 ELSE 0 END" for i in range(upto)) + ")"


YES = "((n_chars + {i}) % 3 = 0)"


def flag(key: str, on: str, off: str) -> str:
    return "'{{\"" + key + "\": ' || CASE WHEN " + YES + f" THEN '{on}' ELSE '{off}' END || '}}}}'"


# name -> (answer body, status, label, score, strict keys, parse error, own error label)
CASES: dict[str, dict] = {}


def case(names, body, status, label, score="NULL", strict=False, error="ConvertJsonError", error_label=None, error_score="NULL"):
    for n in names if isinstance(names, (list, tuple)) else [names]:
        CASES[n] = dict(body=body, status=status, label=label.replace("<N>", n), score=score, strict=strict,
                        error=error_label or f"QUALITY_BAD.{error}", error_score=error_score)


case([n for n, j in JUDGES.items() if j.score.__name__ == "score_reason"], SCORE_REASON,
     f"{A} <> 1", f"CASE WHEN {A} = 1 THEN 'QUALITY_GOOD' ELSE 'QUALITY_BAD.<N>' END", strict=True)
_typed = f"CASE WHEN {A} = 1 THEN 'QUALITY_GOOD' ELSE lang || '.' || source END"
case(["LLMTextQualityV4", "LLMTextQualityV5", "LLMTextEquation", "LLMTextTable"], TYPED, f"{A} <> 1", _typed,
     score=A, strict=True, error="JSONDecodeError")
case(["LLMTextRepeat", "LLMTextUnreadIssue", "LLMTextWordStick", "LLMTextCodeListIssue"], TYPED, f"{A} <> 1", _typed, strict=True)
case("LLMTextChaos", TYPED, f"{A} <> 1", _typed.replace("'QUALITY_GOOD'", "'QUALITY_GOOD.LLMTextChaos'"), strict=True)
case("LLMDatamanAssessment", TYPED, f"{A} <> 1", "lang || '.' || source", strict=True)
case("LLMTextQualityV3", obj(score=num(A), type=f"'[' || {LANG} || ', ' || {SRC} || ']'", name=SRC, reason=LANG),
     f"{A} <> 1", "CASE WHEN " + A + " = 1 THEN 'QUALITY_GOOD' ELSE lang || '.' || source END")
for _k in ("Helpful", "Honest", "Harmless"):
    case(f"LLMText3H{_k}", SCORE_REASON, f"{A} <> 1",
         f"CASE WHEN {A} = 1 THEN 'QUALITY_GOOD.{_k.upper()}' ELSE 'QUALITY_BAD.NOT_{_k.upper()}' END", strict=True)
case(["LLMSecurityPolitics", "LLMSecurityProhibition"],
     obj(one=quoted(f"CASE WHEN {A} = 1 THEN 'pos' ELSE 'neg' END"), two=quoted(f"CASE WHEN {B} = 2 THEN 'pos' ELSE 'neg' END")),
     f"{A} = 1 OR {B} = 2", "'Security.<N>'")
case(["LLMClassifyTopic", "LLMClassifyQR"], obj(name=LANG, reason=SRC), "false", "'<N>.' || lang", strict=True)
case([f"LLMMetaRater{x}" for x in ("Cleanliness", "Professionalism", "Readability", "Reasoning")],
     obj(score=num(C), reason=LANG), f"{C} < 3", f"CASE WHEN {C} >= 3 THEN '<N>.HighQuality' ELSE '<N>.LowQuality' END")
case("LLMInstructionClarity", obj(score=num(f"({B} + 2.5)"), reason=LANG), f"{B} + 2.5 < 6",
     f"CASE WHEN {B} + 2.5 >= 6 THEN 'QUALITY_GOOD.INSTRUCTION_CLARITY_PASS' ELSE 'QUALITY_BAD.INSTRUCTION_CLARITY_FAIL' END",
     score=f"{B} + 2.5", error_label="QUALITY_BAD.INSTRUCTION_CLARITY_ERROR", error_score="0")
case("LLMTaskDifficulty", obj(difficulty_score=num(f"({B} * 2)"), difficulty_level=LANG), f"{B} * 2 > 10",
     f"CASE WHEN {B} * 2 > 10 THEN 'QUALITY_BAD.TASK_TOO_HARD' ELSE 'TASK_DIFFICULTY.' || upper(lang) END",
     score=f"{B} * 2", error_label="QUALITY_BAD.TASK_DIFFICULTY_ERROR", error_score="0")


def passed(score: str, what: str) -> str:
    return f"CASE WHEN {score} >= 5 THEN 'QUALITY_GOOD.{what}_PASS' ELSE 'QUALITY_BAD.{what}_FAIL' END"


case("LLMRAGFaithfulness", obj(score=num(B), statements=listing(C, flag("verdict", "1", "0"))), f"{B} < 5",
     passed(B, "FAITHFULNESS"), score=B)
_recall = f"(CASE WHEN {C} = 0 THEN 0.0 ELSE {hits(C, YES)} / cast({C} AS DOUBLE) * 10 END)"
case("LLMRAGContextRecall", obj(classifications=listing(C, flag("attributed", "1", "0"))), f"{_recall} < 5",
     passed(_recall, "CONTEXT_RECALL"), score=_recall)
case("LLMRAGContextRelevancy", obj(rating=num(A)), f"{A} < 1", passed(f"({A} / 2.0 * 10)", "CONTEXT_RELEVANCY"), score=f"{A} / 2.0 * 10")
_no = f"(CASE WHEN {C} = 0 THEN 0.0 ELSE {hits(C, YES)} / cast({C} AS DOUBLE) END)"
case("LLMHallucination", obj(verdicts=listing(C, flag("verdict", '" No "', '"yes"'))), f"{_no} > 0.5",
     f"CASE WHEN {_no} > 0.5 THEN 'QUALITY_BAD_HALLUCINATION.HALLUCINATION_DETECTED' ELSE 'QUALITY_GOOD.NO_HALLUCINATION' END")
# list answers: contexts in order, made questions, claims
_prec = "round((" + " + ".join(
    f"CASE WHEN {C} > {i} AND {YES.format(i=i)} THEN {hits(str(i + 1), YES)} / {i + 1}.0 ELSE 0.0 END" for i in range(5)
) + f") / ({hits(C, YES)} + 1e-10) * 10, 2)"
case("LLMRAGContextPrecision", obj(verdicts=listing(C, flag("verdict", "1", "0"))), f"NOT ({_prec} >= 5)", passed(_prec, "CONTEXT_PRECISION"), score=_prec)
_made = "'{{\"similarity\": 0.' || cast((n_chars + {i}) % 10 AS VARCHAR(20)) || ', \"noncommittal\": ' || CASE WHEN " + YES + " THEN '1' ELSE '0' END || '}}'"
_like = ("(CASE WHEN " + C + " - " + hits(C, YES) + " = 0 THEN 0.0 ELSE (" + " + ".join(
    f"CASE WHEN {C} > {i} THEN ((n_chars + {i}) % 10) / 10.0 ELSE 0.0 END" for i in range(5)) + f") / greatest({C}, 1) * 10 END)")
case("LLMRAGAnswerRelevancy", obj(questions=listing(C, _made)), f"round({_like}, 6) < 5", passed(f"round({_like}, 6)", "ANSWER_RELEVANCY"), score=_like)
_held = f"({hits(C, YES)} / cast({C} AS DOUBLE))"
case("LLMFactCheckPublic", obj(claims=listing(C, flag("answer", '"True"', '"false"'))), f"{C} > 0 AND {_held} < 0.8",
     f"CASE WHEN {C} = 0 THEN NULL WHEN {_held} < 0.8 THEN 'QUALITY_BAD_FACTUALITY.FACTUALITY_CHECK_FAILED' "
     "ELSE 'QUALITY_GOOD.FACTUALITY_CHECK_PASSED' END", score=f"CASE WHEN {C} > 0 THEN {_held} END")
_claim = ("'{{\"verification_result\": \"' || CASE WHEN " + YES + " THEN 'confirmed' WHEN (n_chars + {i}) % 3 = 1 THEN 'true' ELSE 'refuted' END || "
          "'\", \"reasoning\": \"' || CASE WHEN (n_chars + {i}) % 5 = 0 THEN 'There is insufficient evidence.' ELSE lang END || '\"}}'")
_refuted = hits(C, "((n_chars + {i}) % 3 = 2)")
_unsure = hits(C, "((n_chars + {i}) % 3 < 2 AND (n_chars + {i}) % 5 = 0)")
case("ArticleFactChecker", obj(claims=listing(C, _claim)), f"{_refuted} + {_unsure} > 0",
     f"CASE WHEN {_refuted} > 0 THEN 'QUALITY_BAD_ARTICLE_FACTUAL_ERROR' WHEN {_unsure} > 0 THEN 'QUALITY_BAD_ARTICLE_UNVERIFIED_CLAIMS' ELSE 'QUALITY_GOOD' END",
     score=f"CASE WHEN {C} > 0 THEN round(({C} - {_refuted} - {_unsure}) / cast({C} AS DOUBLE), 4) END")
case("LLMPerspective", obj(TOXICITY=f"'0.' || {num(f'({B} + 3)')}", INSULT=f"'0.' || {num(A)}"), f"{B} > 3 AND {B} < 7 AND {B} + 3 < 10",
     f"CASE WHEN {B} > 3 AND {B} < 7 AND {B} + 3 < 10 THEN 'QUALITY_BAD.PERSPECTIVE' ELSE 'QUALITY_GOOD.PERSPECTIVE' END")
_tool = f"CASE WHEN {A} = 1 THEN 'TOOL_ONE_BETTER' WHEN {A} = 2 THEN 'TOOL_TWO_BETTER' ELSE 'TOOL_EQUAL' END"
case(["LLMHtmlExtractCompare", "LLMHtmlExtractCompareEn"], TYPED, f"{A} <> 1", f"{_tool} || '.' || source", strict=True)
for _n, _w, _m in (("LLMCodeCompare", "code", "code"), ("LLMMathCompare", "math", "formula"), ("LLMTableCompare", "table", "table")):
    case(_n, obj(score=num(A), **{f"no_{_m}": f"CASE WHEN {B} = 3 THEN 'true' ELSE 'false' END"}), f"{B} <> 3 AND {A} <> 1",
         f"CASE WHEN {B} = 3 THEN 'NO_{_m.upper()}.{_w}' ELSE {_tool} || '.{_w}' END")
case("LLMResumeQuality", obj(score=num(A), type=quoted(f"CASE WHEN {A} = 1 THEN 'Good' WHEN {B} = 1 THEN 'Date' ELSE 'Other' END"), name=SRC),
     f"{A} <> 1", f"CASE WHEN {A} = 1 THEN 'QUALITY_GOOD.ResumeQualityGood' WHEN {B} = 1 THEN 'RESUME_QUALITY_BAD_DATE.' || source "
     "ELSE 'RESUME_QUALITY_BAD.' || source END", strict=True)
_item = ("'{{\"importance\": \"' || CASE WHEN {i} = 1 THEN 'Required' WHEN {i} = 2 THEN 'excluded' ELSE 'nice-to-have' END || "
         "'\", \"match_status\": \"' || CASE WHEN " + YES + " THEN 'Matched' ELSE 'missing' END || '\"}}'")
_w = "CASE WHEN {i} = 1 THEN 2 WHEN {i} = 2 THEN 0 ELSE 1 END"
_got = "(" + " + ".join(f"CASE WHEN {C} > {i} AND {YES.format(i=i)} THEN {_w.format(i=i)} ELSE 0 END" for i in range(6)) + ")"
_all = "(" + " + ".join(f"CASE WHEN {C} > {i} THEN {_w.format(i=i)} ELSE 0 END" for i in range(6)) + ")"
_match = f"(CASE WHEN {_all} = 0 THEN 0.0 ELSE {_got} / cast({_all} AS DOUBLE) END)"
case("LLMKeywordMatcher", obj(keyword_analysis=listing(C, _item)), f"{_match} < 0.6",
     f"CASE WHEN {_match} >= 0.6 THEN 'QUALITY_GOOD' ELSE 'QUALITY_BAD.<N>' END", score=_match)
_companies = listing("2", "'{{\"match_score\": ' || cast(((n_chars + {i}) % 10) / 10.0 AS DECIMAL(4,1)) || "
                     "', \"financial_status\": \"' || CASE WHEN " + B + " = {i} THEN 'contraction' ELSE 'stable' END || '\"}}'", 2)
_fit = "(CASE WHEN " + B + " = 0 THEN ((n_chars + 1) % 10) / 10.0 WHEN " + B + " = 1 THEN (n_chars % 10) / 10.0 " \
       "ELSE greatest(n_chars % 10, (n_chars + 1) % 10) / 10.0 END)"
case("LLMScout", obj(target_companies=_companies), f"{_fit} < 0.5",
     f"CASE WHEN {_fit} >= 0.5 THEN 'QUALITY_GOOD' ELSE 'QUALITY_BAD.<N>' END", score=_fit)

# answers that are not JSON objects, or that never fail
PLAIN = {
    "LLMHtmlExtractCompareV2": (
        f"CASE WHEN {A} = 0 THEN 'so <Judgement>A</Judgement>' WHEN {A} = 1 THEN '判断：B' WHEN {B} < 3 THEN '答案: C' ELSE 'none' END",
        f"{A} = 2", f"CASE WHEN {A} = 0 THEN 'TOOL_ONE_BETTER.Judgement_A' WHEN {A} = 1 THEN 'TOOL_EQUAL.Judgement_B' "
        f"WHEN {B} < 3 THEN 'TOOL_TWO_BETTER.Judgement_C' ELSE 'QUALITY_BAD.ValueError' END"),
    "AgentFactCheck": (
        f"CASE WHEN {A} = 0 AND {B} = 5 THEN 'HALLUCINATION_DETECTED: [YES]' WHEN {A} = 0 THEN 'HALLUCINATION_DETECTED: yes' WHEN {A} = 1 THEN 'No hallucination detected here' "
        f"WHEN {B} < 3 THEN 'a hallucination detected' WHEN {B} = 3 THEN ' ' ELSE lang END",
        f"{A} = 0 OR ({A} = 2 AND {B} <= 3)", f"CASE WHEN {A} = 0 OR ({A} = 2 AND {B} < 3) THEN 'QUALITY_BAD_HALLUCINATION' "
        f"WHEN {A} = 2 AND {B} = 3 THEN 'QUALITY_BAD_AGENT_ERROR' ELSE 'QUALITY_GOOD' END"),
    "LLMLongVideoQa": ("text", "false", "'text.qa_pairs'"),
}
_errors = obj(errors=listing(A, "'{{\"error_category\": \"' || lang || '\", \"error_label\": \"e{i}\", \"eval_details\": \"d{i}\"}}'", 3))
_two = f"CASE {A} WHEN 1 THEN lang || '.e0' WHEN 2 THEN lang || '.e0|' || lang || '.e1' ELSE '' END"
PLAIN["VLMDocumentParsing"] = (f"'```json' || {_errors} || '```'", "false", _two)
PLAIN["VLMDocumentParsingOCRTrain"] = (f"'found ' || {_errors} || ' end'", "false", _two)
PLAIN["LLMMinerURecognizeQuality"] = (
    f"'found ' || {_errors}", "false",
    f"CASE {A} WHEN 1 THEN lang || '.e0' WHEN 2 THEN lang || '.' || lang || '.e0.e1' ELSE '.' END")
PLAIN["VLMLayoutQuality"] = (_errors, "false", f"CASE {A} WHEN 1 THEN 'd0' WHEN 2 THEN 'd0|d1' ELSE '' END")


def twin(name: str) -> str:
    if name in PLAIN:
        _, status, label = PLAIN[name]
        return f"SELECT doc_id, {status} AS status, {label} AS label, CAST(NULL AS DOUBLE) AS score FROM documents"
    c = CASES[name]
    extra = f"WHEN {EXTRA} THEN " if c["strict"] else "WHEN false THEN "
    return (f"SELECT doc_id, CASE WHEN {BROKEN} THEN true {extra} true ELSE {c['status']} END AS status, "
            f"CASE WHEN {BROKEN} THEN '{c['error']}' {extra} 'QUALITY_BAD.ValidationError' ELSE {c['label']} END AS label, "
            f"CAST(CASE WHEN {BROKEN} THEN {c['error_score']} {extra} NULL ELSE {c['score']} END AS DOUBLE) AS score FROM documents")


def _register(name: str) -> None:
    body = PLAIN[name][0] if name in PLAIN else wrapped(CASES[name]["body"], CASES[name]["strict"])

    @query("judge_" + re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower(), twin(name))
    def run(spark, sf_dir):
        answers = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", f"{body} AS answer")
        d = judge_detail(JUDGES[name], RuleConfig(), Check({}, ()), F.col("answer")) if "content" not in JUDGES[name].required \
            or name not in ("LLMRAGContextRecall",) else \
            judge_detail(JUDGES[name], RuleConfig(), Check({"content": "text"}, ()), F.col("answer"))
        out = answers.select("doc_id", d.alias("d"))
        return out.select("doc_id", "d.status", F.array_join("d.label", "|").alias("label"), "d.score")


for _n in [*CASES, *PLAIN]:
    _register(_n)
