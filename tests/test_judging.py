"""Prompts of all judges, errors of scorers, and judges on lists in a job file."""

import json

import pytest
from pyspark.sql import functions as F

from grainsieve import Check, Retention, evaluate, run_job
from grainsieve.operators import answer_tables, judging, load_all
from grainsieve.operators.prompts import PROMPTS
from grainsieve.registry import JUDGES

load_all()


@pytest.mark.parametrize("name", sorted(JUDGES))
def test_prompts_ask_for_an_answer_and_use_the_fields(name):
    prompt = PROMPTS.get(name, JUDGES[name].prompt)
    assert prompt != "{content}" and "Answer with" in prompt
    assert all("{" + field + "}" in prompt for field in JUDGES[name].required if field != "score")


def checked(spark, scorer, name="LLMTextQualityV2"):
    df = spark.createDataFrame([(1, "a text", "a question")], "id int, content string, prompt string")
    fields = {f: f for f in JUDGES[name].required}
    row = evaluate(df, [Check.of(fields, [name])], Retention(all_labels=True), scorer=scorer).first()
    return next(iter(row.eval_details.values()))[0]


def test_errors_keep_their_names(spark, monkeypatch):
    monkeypatch.setattr(judging.ask, "__defaults__", (2, 0.01))

    def down(batch):
        raise TimeoutError("no service")

    def refused(batch):
        raise UnicodeError("too long")

    assert checked(spark, down).label == ["QUALITY_BAD.TimeoutError"]
    assert checked(spark, refused).label == ["QUALITY_BAD.UnicodeError"]
    assert checked(spark, lambda batch: ["no json"] * len(batch)).label == ["QUALITY_BAD.ConvertJsonError"]
    assert checked(spark, lambda batch: ['{"score": "x"}'] * len(batch)).label == ["QUALITY_BAD.ValidationError"]
    assert not checked(spark, lambda batch: ['{"score": 1, "reason": "fine"}'] * len(batch)).status


def test_a_failing_batch_is_tried_again_unless_refused(tmp_path):
    calls = []

    def flaky(batch):
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return ["ok"] * len(batch)

    import pandas as pd
    run = judging.ask(flaky, 3, 0.0).func
    assert next(run(iter([pd.Series(["a", "b"])])))["answer"].tolist() == ["ok", "ok"] and len(calls) == 3

    def refused(batch):
        calls.append(1)
        raise ValueError

    calls.clear()
    out = next(judging.ask(refused, 3, 0.0).func(iter([pd.Series(["a"])])))
    assert len(calls) == 1 and out["error"].tolist() == ["ValueError"] and out["answer"].tolist() == [None]


ANSWERS = {
    "LLMRAGContextPrecision": ({"verdicts": [{"verdict": 1}, {"verdict": 0}, {"verdict": 1}]}, False, 8.33),
    "LLMRAGAnswerRelevancy": ({"questions": [{"similarity": 0.9, "noncommittal": 1}]}, True, 0.0),
    "LLMFactCheckPublic": ({"claims": [{"answer": "true"}, {"answer": "false"}]}, True, 0.5),
    "ArticleFactChecker": ({"claims": [{"verification_result": "TRUE", "reasoning": "seen"}]}, False, 1.0),
    "LLMPerspective": ({"TOXICITY": 0.7, "INSULT": 0.1}, True, None),
}


@pytest.mark.parametrize("name", sorted(ANSWERS))
def test_list_judges_run_from_a_job_file(spark, name):
    answer, bad, score = ANSWERS[name]
    df = spark.createDataFrame([(1, "c", "p")], "id int, content string, prompt string")
    responses = spark.createDataFrame([(1, name, json.dumps(answer))], "id int, metric string, response string")
    fields = {f: f for f in JUDGES[name].required}
    out = run_job(spark, {"evaluator": [{"fields": fields, "evals": [{"name": name}]}], "result_save": {}}, df, id_col="id", responses=responses)
    row = out.first()
    assert row.eval_status is bad
    if bad:
        detail = next(iter(row.eval_details.values()))[0]
        assert detail.metric == name and (score is None or detail.score == pytest.approx(score))


def test_unmapped_judge_fields_fail_at_once(spark):
    df = spark.createDataFrame([(1, "c")], "id int, content string")
    with pytest.raises(ValueError, match="prompt"):
        run_job(spark, {"evaluator": [{"fields": {"content": "content"}, "evals": [{"name": "LLMScout"}]}]}, df, scorer=list)


def test_company_lists(spark):
    answer = {"strategy_context": {"target_companies": [
        {"name": "a", "match_score": 0.6},
        {"name": "b", "scoring_breakdown": {"skill_match": {"score": 0.9}, "location_match": {"score": 0.4}}},
        {"name": "c", "financial_status": "contraction", "financial_evidence": {"confidence": 0.9, "source_quotes": ["q" * 60]}},
        {"name": "d", "financial_evidence": {"confidence": 0.2}},
        {"match_score": 0.95, "tier": "Tier 1", "financial_evidence": {"confidence": 0.8, "conflicting_signals": "layoffs"}},
        {"name": "e", "match_score": 0.6}, {"name": "f", "scoring_breakdown": {"skill_match": {"score": 0.3}}}],
        "insufficient_data": [{"name": "g"}], "not_recommended": [{"reason": "x"}]}}
    rows = [(1, "```json\n" + json.dumps(answer) + "\n```", 5), (2, "no", 5), (3, None, 5), (4, "{}", 5)]
    got = answer_tables.company_lists(spark.createDataFrame(rows, "id int, answer string, list int"), "id", "answer")
    assert sorted(tuple(r) for r in got.collect() if r["list"] == "target") == [
        (1, "target", 0, "Unknown", 0.95, "Tier 2", "layoffs"), (1, "target", 1, "b", 0.8, "Tier 1", None),
        (1, "target", 2, "a", 0.6, "Tier 2", None), (1, "target", 3, "e", 0.6, "Tier 2", None),
        (1, "target", 4, "f", 0.3, "Not Recommended", None)]
    assert sorted((r["list"], r.place, r.name, r.note) for r in got.collect() if r["list"] != "target") == [
        ("insufficient", 0, "d", None), ("insufficient", 1, "g", None),
        ("not_recommended", 0, "c", "q" * 50), ("not_recommended", 1, "Unknown", None)]


@pytest.mark.parametrize("answer, want", [
    ("x\nSources:\n- https://a.b/c\n  • d \nhttp://e\nplain\n- \nEvidence: y\n- z", ["https://a.b/c", "d", "http://e"]),
    ("SOURCES:", []), ("- https://a", []), ("", []), (None, []), ("sources: x\n- - q\nnote: r\n- s", ["q", "s"])])
def test_cited_sources(spark, answer, want):
    df = spark.createDataFrame([(answer,)], "a string")
    assert df.select(answer_tables.cited_sources(F.col("a"))).first()[0] == want


@pytest.mark.parametrize("answer, want", [
    ('so {"verification_result": "TRUE", "sources": ["a, b", "c"]}', ["a, b", "c"]),
    ('{"verification_result": "TRUE", "sources": ["a", "b', ["a", "b"]),
    ('{"verification_result": "TRUE", "x": {}, "sources": [ "a" , "" ]', ["a"]), ('{"verification_result": "TRUE"}', None),
    ("nothing", None), (None, None)])
def test_claim_sources(spark, answer, want):
    got = spark.createDataFrame([(answer,)], "a string").select(answer_tables.claim_sources(F.col("a"))).first()[0]
    assert got == want


def test_chinese_texts(spark):
    texts = ["中文简历", "a resume", "", None, " \n", "abcdefghi 中", "abcdefgh 中", "仮名かな𠀀"]
    want = [t is not None and bool(t.strip()) and sum("一" <= c <= "鿿" for c in t) / len("".join(t.split())) > 0.1 for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.c for r in df.select("i", answer_tables.is_chinese(F.col("t")).alias("c")).orderBy("i").collect()] == want


def test_lists_of_texts_are_numbered_in_prompts(spark):
    df = spark.createDataFrame([(1, ["a", "b"], "q"), (2, [], None), (3, None, "q")], "id int, contexts array<string>, question string")
    check = Check.of({"content": "contexts", "prompt": "question"}, [{"name": "LLMLongVideoQa", "config": {"prompt": "{prompt}: {content}"}}])
    v = evaluate(df, [check], Retention(all_labels=True), id_col="id", scorer=lambda prompts: prompts)
    got = {r.id: list(r.eval_details.values())[0][0].reason for r in v.collect()}
    assert got == {1: ["q: Context 1:\na\n\nContext 2:\nb"], 2: [": "], 3: ["q: "]}
