"""Words of a table in texts, against the whole-word search of a single text."""

import json
import random

import pytest

from grainsieve.operators import security, word_tables as W
from grainsieve.plans.evaluate import Check, verdicts_of


def inside(text, word):
    at = text.find(word)
    while at >= 0:
        if not text[max(at - 1, 0):at].isalnum() and not text[at + len(word):at + len(word) + 1].isalnum():
            return True
        at = text.find(word, at + 1)
    return False


def brute(texts, words):
    found = {i: sorted({w for w in words if w and inside(t, w)}) for i, t in texts if t}
    return {i: ws for i, ws in found.items() if ws}


def got(spark, texts, words):
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in texts], "key int, text string, word string, k int")
    w = spark.createDataFrame([(x, 1) for x in words], "word string, whole int")
    rows = W.table_words(d, "key", "text", w).collect()
    assert len({r.key for r in rows}) == len(rows)
    return {r.key: r.found for r in rows}


def test_random_texts_and_words(spark):
    rng = random.Random(11)
    signs = "ab1é中 .-\n\\E²𝔸"
    make = lambda low, high: "".join(rng.choice(signs) for _ in range(rng.randint(low, high)))
    texts = [(i, make(0, 60)) for i in range(300)]
    words = [make(1, 6) for _ in range(300)] + [make(8, 14) for _ in range(60)] + [t[5:40] for _, t in texts[:80]]
    want = brute(texts, words)
    assert sum(map(len, want.values())) > 1000
    assert got(spark, texts, words) == want


def test_odd_rows(spark):
    long = "alpha beta " * 20_000
    texts = [(1, None), (2, ""), (3, "..."), (4, "a ## b"), (5, "a##b"), (6, "one two three four five six seven eight nine ten"),
             (7, "@foo, (bar)"), (8, long), (9, "x@foo"), (10, r"a \E b")]
    words = [None, "", "##", "...", "one two three four five six seven eight nine", "two three four five six seven eight nine x",
             "@foo", "(bar)", "bar)", "foo", "beta alpha", "beta", "beta", "gamma", r"\E", "one  two"]
    assert got(spark, texts, words) == brute(texts, [w for w in words if w])
    assert got(spark, texts, []) == {} and got(spark, [], words) == {}


def test_a_long_list_as_a_table(spark, tmp_path, monkeypatch):
    """A million words, none of them collected, give the verdicts that a short list of the same hits gives."""
    words = spark.range(1_000_000).selectExpr("CASE WHEN id = 7 THEN 'very bad' ELSE 'w' || id END AS word")
    docs = spark.createDataFrame([(1, "a very bad day", 3), (2, "a bad day", 4), (3, "w999 w12345 w12345678", 5), (4, None, 6)],
                                 "id int, text string, key int")
    wide = W.with_table_words(docs, "id", "text", words)
    assert wide.columns == ["id", "text", "key", "found"] and wide.count() == 4
    v = verdicts_of(wide, Check.of({"content": "text", "found": "found"}, ["RuleUnsafeWords"], RuleUnsafeWords={"found": True}), ["id"])
    short = verdicts_of(docs, Check.of({"content": "text"}, ["RuleUnsafeWords"],
                                       RuleUnsafeWords={"key_list": ["very bad", "w999", "w12345"]}), ["id"])
    told = lambda t: {r.id: (r.status, r.label, r.reason) for r in t.collect()}
    assert told(v) == told(short) and told(v)[1][2] == ["very bad"]
    with pytest.raises(ValueError):
        W.with_table_words(wide, "id", "text", words)
    path = tmp_path / "words.jsonl"
    path.write_text("\n".join(json.dumps({"word": w}) for w in ("bad", "worse")))
    assert security.read_word_list([str(path)]) == ("bad", "worse")
    monkeypatch.setattr(security, "LIST_SIGNS", 5)
    with pytest.raises(ValueError, match="with_table_words"):
        security.read_word_list([str(path)])
