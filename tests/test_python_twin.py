"""The folding, repetition and word rules against plain Python on whole documents."""

import re
import string
import unicodedata
from collections import Counter

from grainsieve import Check
from grainsieve.functions import fixed as X
from grainsieve.plans.evaluate import verdicts_of

DROP = str.maketrans("", "", string.punctuation + X.CJK_PUNCTUATION)


def fold(text):
    return unicodedata.normalize("NFD", re.sub(r"\s+", " ", text.translate(DROP).lower().strip()))


def repeat_score(text, n=6):
    words = fold(text).split()
    grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
    twice = {g for g, c in Counter(grams).items() if c > 1}
    covered = {j for i, g in enumerate(grams) if g in twice for j in range(i, i + n)}
    total = sum(map(len, words))
    return sum(len(words[j]) for j in covered) / total * 100 if grams and total else 0.0


TWINS = {
    "RuleDocRepeat": repeat_score,
    "RuleWordNumber": lambda t: len(fold(t).split()),
    "RuleUniqueWords": lambda t: len(set(fold(t).split())) / len(fold(t).split()),
    "RuleMeanWordLength": lambda t: sum(map(len, fold(t).split())) / len(fold(t).split()),
    "RuleSentenceNumber": lambda t: len(re.findall(r"\b[^.!?\n]+[.!?]*", t)),
    "RuleCapitalWords": lambda t: sum(w.isupper() for w in re.findall(r"\w+|[^\w\s]+", t)) / len(re.findall(r"\w+|[^\w\s]+", t)),
    "RuleNoPunc": lambda t: max(len(s.split()) for p in t.split("\n") for s in re.split("[–.!?,;•/|…]", p)),
}


def test_twins(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, twin in TWINS.items():
        got = {r.doc_id: r.measure for r in verdicts_of(docs, Check.of({"content": "text"}, [name]), ["doc_id"]).collect()}
        wrong = [i for i, t in texts.items() if abs(got[i] - twin(t)) > 1e-9]
        assert not wrong, (name, wrong[:5])
