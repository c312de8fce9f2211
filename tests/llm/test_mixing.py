"""Mixing sources to target weights against a plain version that sorts."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from grainsieve.llm import common, mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_targets(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, full = sum(sizes.values()) * share / 100, set()
    while True:
        free = [s for s in order if s not in full]
        level = (budget - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in full else level * weight[s] for s in order}
        full |= over


def plain(rows, weights=(5, 2, 1), share=100, most=3, seed=0):
    """(key, size, source size, target, taken) of rows (key, source, text); equal rows in the order given."""
    size = [len(WORD.findall(t or "")) for _, _, t in rows]
    sizes = defaultdict(int)
    for (_, s, _), n in zip(rows, size):
        sizes[s] += n
    target = plain_targets(sizes, weights, share, most)
    by = defaultdict(list)
    for i, (k, s, t) in enumerate(rows):
        by[s].append((hashlib.md5(f"{seed}:{'' if k is None else k}:{t or ''}".encode()).hexdigest()[:15], i))
    out = [None] * len(rows)
    for s, own in by.items():
        times = int(target[s] // sizes[s]) if sizes[s] else 0
        rest, before = max(0.0, target[s] - times * sizes[s]), 0
        for _, i in sorted(own):
            more = before + size[i] <= rest or before <= rest and 2 * (rest - before) >= size[i]
            out[i] = (rows[i][0], size[i], sizes[s], target[s], size[i] * (times + more))
            before += size[i]
    return sorted(out, key=repr)


def ours(df, **options):
    found = mixing.plan(df, **options).collect()
    return sorted(((r.doc_id, r["size"], r.source_size, r.target, r["size"] * r.copies) for r in found), key=repr)


def odd_rows():
    rows = [(i, f"s{i % 7}", " ".join(f"w{i * j % 31}" for j in range(i % 23))) for i in range(400)]
    rows += [(1000 + i, "hot", "one two three four five") for i in range(300)]
    rows += [(2000, "copies", "a b c")] * 150 + [(2001, "copies", "a b c d")]
    rows += [(3000, None, "alone \t and\nfree"), (3001, None, None), (None, "s1", "no key"), (3002, "empty", ""), (3003, "empty", None),
             (3004, "\U0001f600", "last by code point"), (3005, "￮", "before it"), (3006, "", "no name"), (3007, "one", "x " * 5000)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return odd_rows(), spark.createDataFrame(odd_rows(), "doc_id long, source string, text string")


def test_odd_rows_equal_the_plain_version(odd):
    rows, df = odd
    assert ours(df) == plain(rows)


def test_other_parameters_and_another_deal_of_rows(odd):
    rows, df = odd
    want = plain(rows, (1, 9), 40, 2, 5)
    assert ours(df, weights=(1, 9), share=40, most=2, seed=5) == want
    assert ours(df.repartition(5, "text"), weights=(1, 9), share=40, most=2, seed=5) == want


def test_large_tables_of_sources_are_salted_and_ranked_by_ranges(odd, monkeypatch):
    rows, df = odd
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(mixing, "RANKED", 3)
    assert ours(df) == plain(rows)


def test_more_than_all_gives_each_source_its_limit(odd):
    rows, df = odd
    assert {r[4] - 3 * r[1] for r in ours(df, share=1000)} == {0}


def test_mixtures_are_near_their_targets_and_nested(odd):
    _, df = odd
    small = {}
    for share in (20, 60, 100):
        found = mixing.plan(df.where("doc_id != 2000"), share=share).join(
            df.select("doc_id", "source", "text"), "doc_id").collect()
        taken, target, longest, now = Counter(), {}, Counter(), {}
        for r in found:
            taken[r.source] += r["size"] * r.copies
            target[r.source] = r.target
            longest[r.source] = max(longest[r.source], r["size"])
            now[r.doc_id] = r.copies
            assert r.copies <= 3
        assert all(abs(taken[s] - target[s]) <= longest[s] / 2 for s in target)
        assert all(now[k] >= n for k, n in small.items())
        small = now


def test_mixture_repeats_whole_rows_with_clashing_columns(spark, odd):
    rows, df = odd
    wide = df.selectExpr("*", "1 as s", "doc_id as size", "2 as h", "3 as t", "4 as key", "5 as bucket", "6 as rest", "7 as copies",
                         "8 as `row`", "9 as __salt", "10 as target", "11 as times", "12 as many", "13 as cut_h", "14 as `a.b`")
    want = Counter()
    for r in mixing.plan(wide).groupBy("doc_id").sum("copies").collect():
        if r[1]:
            want[r.doc_id] = r[1]
    out = mixing.mixture(wide)
    assert out.columns == wide.columns
    assert Counter(r.doc_id for r in out.collect()) == want
    assert ours(wide) == plain(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.plan(none).collect() == [] and mixing.mixture(none).collect() == []
    blank = spark.createDataFrame([(1, "a", None), (2, None, " ")], none.schema)
    assert ours(blank) == plain([(1, "a", None), (2, None, " ")]) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixing.mixture(blank).collect() == []
