"""Plans, whole groups and answers that once were wrong."""

import json
import random

import pytest
from pyspark.sql import functions as F

from grainsieve import Check, evaluate, label_ratios, score_stats, summary_row, totals
from grainsieve.operators import media, scores, security, sentences
from grainsieve.plans.evaluate import merge_partials, verdicts_of
from grainsieve.sources import readers

SF = "/root/testdata/sf0.001"
RULES = ["RuleColonEnd", "RuleContentShort", "RuleNoPunc", "RuleSentenceNumber"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_filters_on_other_columns_reach_the_scan(docs):
    v = evaluate(docs, [Check.of({"content": "text"}, RULES)])
    assert "EqualTo(lang,en)" in plan(v.where("lang = 'en' AND eval_status"))[1]
    assert v.where("lang = 'en'").count() == docs.where("lang = 'en'").count()


def test_summary_is_one_pass_and_agrees_with_its_parts(docs):
    v = evaluate(docs, [Check.of({"content": "text"}, RULES)])
    row = summary_row(v, "t")
    assert plan(row)[0].count("Relation") == 1 and plan(label_ratios(v))[0].count("Relation") == 1
    got, want = row.first(), totals(v).first()
    assert (got.total, got.num_good, got.num_bad, got.score) == (want.total, want.num_good, want.num_bad, want.score)
    assert got.type_ratio["text"] == {r.label: r.ratio for r in label_ratios(v).collect()}
    empty = summary_row(v.where("false")).first()
    assert (empty.total, empty.score, empty.type_ratio) == (0, 0.0, {})
    assert score_stats(v).collect() == []


def test_a_group_is_whole_or_refused(docs):
    with pytest.raises(ValueError, match="RuleAudioDuration"):
        Check.group({"content": "text"}, "multi_lan_ru")
    others = ("RuleAudioDuration", "RuleAudioSnrQuality", *(f"Rule{x}DataFormat" for x in ("Audio", "Image", "Nlp", "Sft", "Vedio")))
    check = Check.group({"content": "text"}, "multi_lan_ru", without=others, RuleWordStuck={"words": ["the"]})
    assert len(check.evals) == 14


def test_merged_partials_keep_the_order_of_their_parts(docs):
    parts = [evaluate(docs, [Check.of({"content": "text"}, [r])]) for r in RULES]
    for r in merge_partials(parts, "doc_id").where("eval_status").collect():
        names = [d.metric for d in r.eval_details["text"]]
        assert names == [n for n in RULES if n in names]


def test_match_reports(spark):
    def read(report):
        got = scores.match_report(F.col("r"))
        row = spark.createDataFrame([(json.dumps(report),)], "r string").select(*[c.alias(k) for k, c in got.items()]).first()
        return row.missing_required, row.missing_nice, row.negative, row.targeted

    rows = [{"keyword": "a", "importance": "Required", "match_status": "Missing"},
            {"keyword": "b", "importance": "Excluded", "match_status": "Matched"}]
    assert read({"match_details": {}, "keyword_analysis": rows}) == (["a"], [], ["b"], True)
    assert read({"match_details": {"missing": []}, "keyword_analysis": rows}) == ([], [], [], False)
    assert read({"match_details": {"negative_warnings": [{"skill": ""}, {"skill": "z"}, {}]}}) == ([], [], ["z"], True)
    assert read(["x", "y"]) == (["x", "y"], [], [], True)


@pytest.mark.parametrize("answer, bad", [
    ("HALLUCINATION_DETECTED: YES\nbecause", True), ("HALLUCINATION_DETECTED: [YES]", True), ("hallucination_detected: **no**\nyes", False),
    ("**HALLUCINATION_DETECTED:** NO hallucination detected", False), ("It is factually accurate.", False),
    ("A hallucination detected here", True)])
def test_agent_answers(spark, answer, bad):
    df = spark.createDataFrame([(1, "q", "AgentFactCheck", answer)], "id int, content string, metric string, response string")
    v = evaluate(df.select("id", "content"), [Check.of({"content": "content"}, ["AgentFactCheck"])], id_col="id",
                 responses=df.select("id", "metric", "response"))
    assert v.first().eval_status is bad


def test_boxes_of_all_sizes(spark):
    rng = random.Random(3)
    boxes = [(i % 3, i, rng.uniform(0, 900), rng.uniform(0, 900), *(10 ** rng.uniform(0.5, 3.4) for _ in range(2))) for i in range(260)]
    boxes += [(0, 1000, 0.0, 0.0, 1e7, 1e7), (0, 1001, 5.0, 5.0, 1e7, 1e7), (0, 1002, 0.0, 0.0, 1e7, 2e6)]
    df = spark.createDataFrame(boxes, "image int, box int, x double, y double, width double, height double")

    def iou(a, b):
        w = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
        h = min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
        s = max(w, 0) * max(h, 0)
        return s / (a[4] * a[5] + b[4] * b[5] - s)

    want = {(a[1], b[1]) for a in boxes for b in boxes if a[0] == b[0] and a[1] < b[1] and iou(a, b) >= 0.1}
    got = [(r.box_a, r.box_b) for r in scores.box_overlaps(df, "image", "box").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_row_ranges_without_a_single_task(spark):
    rng = random.Random(1)
    keys = [rng.choice([None, *range(40)]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(keys)), "id int, k int").repartition(5)
    ordered = sorted(keys, key=lambda k: (k is not None, k))
    for start, end in ((0, -1), (0, 10), (37, 222), (490, -1), (498, 900), (600, -1), (10, 10)):
        out = readers.row_range(df, "k", start, end)
        assert "Limit" not in plan(out)[0]
        assert sorted((r.k for r in out.collect()), key=lambda k: (k is not None, k)) == ordered[start:end if end >= 0 else None]


def test_redaction(spark):
    text = "mail a.person@site.org, ip 10.1.2.3, card 4111 1111 1111 1111, card 4111 1111 1111 1112"
    df = spark.createDataFrame([(text,), ("",)], "t string")
    out = [r[0] for r in df.select(security.redact(F.col("t"))).collect()]
    assert "person" not in out[0] and "10.***.***.3" in out[0] and "1111 1112" in out[0] and "4111 1111 1111 1111" not in out[0]
    assert out[1] == "" and df.select(security.redact(F.col("t"), ("email",))).first()[0].endswith(text[23:])


def test_differences_are_whole(spark):
    long = "word " * 5000
    df = spark.createDataFrame([(long + "tail", long + "tale"), ("ab", None)], "a string, b string")
    rows = df.select(media.text_difference("a", "b").alias("d")).select("d.*").collect()
    assert rows[0].common.startswith(long) and len(rows[0].common) > 10_000
    assert (rows[1].unique_a, rows[1].unique_b, rows[1].common) == ("ab", "", "")


def test_no_job_starts_while_a_job_is_planned(spark, docs):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    evaluate(docs.orderBy("doc_id"), [Check.of({"content": "text"}, RULES)])
    assert len(tracker.getJobIdsForGroup(None)) == before


def test_abbreviations_are_learnt_and_end_no_sentence(spark):
    text = ("Dr. Smith met Mr. Jones at the house. The house was old. They saw e.g. a cat. It rained. "
            "Later Dr. Brown came. Mr. Green left the house. We ate. You won. "
            "A cat came here, as old as it is; it ate and won. Who rained, who left, who ended, who saw Smith and Jones? ")
    docs = spark.createDataFrame([(i, text + f"Word{chr(97 + i % 26)} ended here.") for i in range(30)] + [(99, None)], "id long, text string")
    learnt = sentences.learn_abbreviations(docs)
    words = [r.word for r in learnt.collect()]
    assert {"dr", "mr", "e.g"} <= set(words) and not {"house", "old", "cat", "here"} & set(words)
    assert {r.word: (r.with_stop, r.without) for r in learnt.collect()}["dr"] == (60, 0)
    known = ("Dr.", "mr", "e.g")
    one = spark.createDataFrame([("Dr. Smith is in. (See e.g. Mr. X.) He left! \u201cWhy?\u201d Nobody knows etc. and so on... Really.",), ("",), (None,)], "t string")
    assert [r[0] for r in one.select(sentences.sentences_of(F.col("t"), known)).collect()] == [
        ["Dr. Smith is in.", "(See e.g. Mr. X.)", "He left!", "\u201cWhy?\u201d", "Nobody knows etc. and so on...", "Really."], [], []]
    rows = spark.createDataFrame([(1, "Dr. Smith 1 2 3."), (2, "Dr. 1.")], "id long, content string")
    share = lambda keys: {r.id: round(r.measure, 4) for r in verdicts_of(rows, Check.of(
        {"content": "content"}, [{"name": "RuleAlphaWords", "config": {"key_list": keys} if keys else {}}]), ["id"]).collect()}
    assert share(None) == {1: round(2 / 7, 4), 2: 0.25}  # Dr . Smith 1 2 3 .
    assert share(["dr"]) == {1: round(2 / 6, 4), 2: round(1 / 3, 4)}  # Dr. Smith 1 2 3 .
