"""Single rules on literal inputs, boundaries included."""

import math
import random

import pytest

from grainsieve import Check, Retention, evaluate
from grainsieve.plans.evaluate import flags, verdicts_of

CASES = [
    ("RuleContentNull", " 　\n", True), ("RuleContentNull", "a", False), ("RuleContentNull", None, True),
    ("RuleContentShort", "a" * 20, True), ("RuleContentShort", "a" * 21, False), ("RuleContentShort", "é" * 11, False),
    ("RuleColonEnd", "what follows:", True), ("RuleColonEnd", "done.", False), ("RuleColonEnd", "", False),
    ("RuleEnterMore", "a" + "\n" * 8 + "b", True), ("RuleEnterMore", "a" + "\n" * 7 + "b", False),
    ("RuleEnterRatioMore", "a\nbc", False), ("RuleEnterRatioMore", "a\nb", True),
    ("RuleSpaceMore", "a" + " " * 500, True), ("RuleSpaceMore", "a" + " " * 499, False),
    ("RuleOnlyUrl", "https://a.example/b?c=d \n", True), ("RuleOnlyUrl", "see https://a.example", False),
    ("RuleHtmlEntity", "&nbsp;", True), ("RuleHtmlEntity", "plain", False),
    ("RuleHtmlTag", "<p>x</p>", True), ("RuleInvisibleChar", "a​b", True),
    ("RuleSpecialCharacter", "a�b", True), ("RuleSpecialCharacter", "<|im_end|>", True),
    ("RuleAbnormalNumber", "a\n\n\n\n12\n\n\n\nb", True), ("RuleCharSplit", "a b c d e f g " * 3, True),
    ("RuleLatexSpecialChar", "$$x!!y$$", True), ("RuleLatexSpecialChar", "$$x!!\ny$$", False),
    ("RuleWordSplit", "a bro-\n", True), ("RuleWordSplit", "bro- ken", False),
    ("RuleHeadWordRu", "x" * 200 + " Интерфакс", True), ("RuleHeadWordRu", "Интерфакс" + "x" * 200, False),
    ("RuleCapitalWords", "LOUD WORDS here", True), ("RuleCapitalWords", "quiet words here", False),
    ("RuleSentenceNumber", "One. Two.", True), ("RuleSentenceNumber", "One. Two. Three.", False),
    ("RuleNoPunc", "w " * 113, True), ("RuleNoPunc", "w " * 112, False),
    ("RuleLineEndWithEllipsis", "a...\nb…\nc", True), ("RuleLineEndWithTerminal", "a.\nb\nc", True),
    ("RuleLineStartWithBulletpoint", "• a\n  • b", True),
    ("RuleLineJavascriptCount", "\n".join(["Enable Java-Script!"] * 4), True),
    ("RuleLoremIpsum", "Lorem, ipsum dolor", True), ("RuleMeanWordLength", "a b c", True),
    ("RuleUniqueWords", "a " * 11, True), ("RuleWordNumber", "w " * 19, True), ("RuleWordNumber", "w " * 20, False),
    ("RuleDocRepeat", "a b c d e f " * 5, True), ("RuleDocRepeat", "a b c d e f g h i j", False),
    ("RuleDocRepeat", "这是一个句子。" * 4, True),
    ("RuleDocFormulaRepeat", "$$" + r"\dots" * 6 + "$$", True), ("RuleDocFormulaRepeat", "no formula", False),
    ("RuleIDCard", "身份证：11010519491231002X", True), ("RuleIDCard", "number 11010519491231002X", False),
    ("RulePIIDetection", "mail jo@example.com now", True), ("RulePIIDetection", "4111 1111 1111 1111", True),
    ("RulePIIDetection", "4111 1111 1111 1112", False), ("RulePIIDetection", "192.168.1.300", False),
    ("RulePIIDetection", "手机13812345678", False), ("RulePIIDetection", "手机 13812345678", True),
    ("RuleDoi", "10.1234/abc", False), ("RuleDoi", "10.1234/ABC", True),
    ("RuleIsbn", "978-0-306-40615-7", False), ("RuleIsbn", "0-8044-2957-X", False), ("RuleIsbn", "9780306406158", True),
    ("RuleIsbn", "abc", True),
    ("RuleResumeMarkdown", "a *** b", True), ("RuleResumeDateFormat", "2020-01 2021.02", True),
    ("RuleResumeNameMissing", "# Jo\nrest", False), ("RuleResumePhoneFormat", "call 23812345678", True),
    ("RuleResumeEmailMissing", "jo@example.com", False), ("RuleResumeEmoji", "hi 😀", True),
]


def test_rules(spark):
    """One plan per rule name, all its literals at once."""
    by_rule = {}
    for i, (name, text, bad) in enumerate(CASES):
        by_rule.setdefault(name, []).append((i, text, bad))
    wrong = []
    names = list(by_rule)
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(CASES)], "i int, text string").coalesce(1)
    for part in (names[k:k + 12] for k in range(0, len(names), 12)):
        got = {r.i: r for r in flags(df, [Check.of({"content": "text"}, part)], ["i"]).collect()}
        wrong += [(n, t) for n in part for i, t, bad in by_rule[n] if got[i][n] != bad]
    assert wrong == []


@pytest.mark.parametrize("words", [("bad", "worse"), tuple(f"w{i}" for i in range(600)) + ("bad",)])
def test_unsafe_words(spark, words):
    df = spark.createDataFrame([(1, "a bad day"), (2, "badly"), (3, "bad")], "i int, text string")
    v = verdicts_of(df, Check.of({"content": "text"}, ["RuleUnsafeWords"], RuleUnsafeWords={"key_list": list(words)}), ["i"])
    assert {r.i: (r.status, r.reason) for r in v.collect()} == {1: (True, ["bad"]), 2: (False, None), 3: (True, ["bad"])}


def test_pii_masks(spark):
    df = spark.createDataFrame([(1, "jo.doe@example.com 13812345678 110105194912310021 10.0.0.1 4111-1111-1111-1111 123-45-6789")], "i int, text string")
    reason = verdicts_of(df, Check.of({"content": "text"}, ["RulePIIDetection"]), ["i"]).collect()[0].reason
    assert reason == [
        "High Risk PII: 中国身份证号(110105********0021), 信用卡号(************1111), 美国社会安全号(123****6789)",
        "Medium Risk PII: 中国手机号(138****5678), 电子邮件(j*****@example.com)", "Low Risk PII: IP地址(10.***.***.1)"]


def test_metadata_similarity(spark):
    df = spark.createDataFrame([(1, ("Deep Learning", "deep learning")), (2, ("", "x")), (3, ("abcd", "abce")), (4, ("abc", "xyz"))],
                               "i int, m struct<standard:string,produced:string>")
    v = verdicts_of(df, Check.of({"metadata": "m"}, ["RuleMetadataSimilarity"]), ["i"])
    assert {r.i: (r.status, r.measure) for r in v.collect()} == {1: (False, 1.0), 2: (True, 0.0), 3: (False, 0.75), 4: (True, 0.0)}


def test_missing_field_fails_at_plan_time(spark):
    df = spark.createDataFrame([(1, "a")], "i int, text string")
    with pytest.raises(ValueError):
        evaluate(df, [Check.of({"prompt": "text"}, ["RuleColonEnd"])])
    with pytest.raises(KeyError):
        evaluate(df, [Check.of({"content": "text"}, ["NoSuchRule"])])


def test_two_groups_keep_their_own_settings(spark):
    df = spark.createDataFrame([(1, "a" * 50)], "i int, text string")
    v = evaluate(df, [Check.of({"content": "text"}, [{"name": "RuleCharNumber", "config": {"threshold": 10}}, "RuleCharNumber"])],
                 Retention(all_labels=True)).collect()[0]
    assert [d.status for d in v.eval_details["text"]] == [False, True]


def cut(s, words):
    """Fewest parts of the cheapest cut into listed words and unlisted signs, by trying every end in turn."""
    cost = {w: math.log((i + 1) * math.log(max(len(words), 2))) for i, w in enumerate(words)}
    best = [(0.0, 0)]
    for i in range(1, len(s) + 1):
        best.append(min((best[j][0] + cost.get(s[j:i], 9e9 * (i - j)), best[j][1] + 1) for j in range(max(0, i - max(map(len, words))), i)))
    return best[-1][1]


@pytest.mark.parametrize("longest", [1, 4, 45, 60])
def test_stuck_words_are_those_that_a_list_cuts(spark, longest):
    rng = random.Random(longest)
    make = lambda n: "".join(rng.choice("agks") for _ in range(n))
    words = list(dict.fromkeys([make(longest), *(make(rng.randint(1, longest)) for _ in range(30))]))
    pieces = [make(rng.randint(40, 70)) for _ in range(60)] + [w for w in words if len(w) > 40] + [words[0] + make(3), "a" * 46, "0123456789" * 5, ""]
    df = spark.createDataFrame(list(enumerate(pieces)) + [(len(pieces), None)], "i int, text string")
    got = verdicts_of(df, Check.of({"content": "text"}, ["RuleWordStuck"], RuleWordStuck={"words": words}), ["i"])
    want = {i: len(p) > 45 and p.isalpha() and cut(p, words) > 1 for i, p in enumerate(pieces)} | {len(pieces): False}
    assert {r.i: r.status for r in got.collect()} == want and sum(want.values()) > 20
    if longest <= 45:
        none = verdicts_of(df, Check.of({"content": "text"}, ["RuleWordStuck"]), ["i"])
        assert sorted(none.collect()) == sorted(got.collect()) and "Python" not in none._jdf.queryExecution().executedPlan().toString()
