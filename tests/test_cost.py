"""What steps cost, told from calls and plans, and that cheaper forms give the same."""

import pathlib
import random
import re
import string
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainsieve.functions import fixed as X, marks, repeats
from grainsieve.operators import boxes as B, claims as C, security as S, word_tables as W
from grainsieve.plans.evaluate import Check, Retention, evaluate, flags
from grainsieve.sources import writers

from tests.test_boxes import brute as brute_boxes, counted, stack
from tests.test_word_tables import brute, got


def test_pieces_are_hashed_once_for_all_claims_of_a_length(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab𝒳é ", k=rng.randint(0, 90))) for _ in range(4000)] + [None]
    calls, whole = [], C._piece_hashes
    monkeypatch.setattr(C, "_piece_hashes", lambda points, size: calls.append(len(points)) or whole(points, size))
    ask, many, found = C.pieces_of(texts)
    assert len(calls) <= 2 * 91
    ends = many.cumsum()
    for i in rng.sample(range(len(texts)), 300):
        assert C.pieces(texts[i] or "") == (int(ask.view("int64")[i]), found.view("int64")[ends[i] - many[i]:ends[i]].tolist())


def test_claims_lie_on_disk_once(spark, monkeypatch):
    """texts go to disk in one table, pieces go without them, and nothing shuffled stays."""
    rng = random.Random(4)
    rows = [(i % 60, i, "".join(rng.choices(string.ascii_lowercase + "é ", k=rng.randint(12, 140))).strip() + "x") for i in range(12_000)]
    rows += [(a, 12_000 + i, text[1:] if i % 2 else text[:-2]) for i, (a, _, text) in enumerate(rows[:100])]
    size, written, tables, left = sum(len(text.encode()) for _, _, text in rows), C.written, [], []
    dirs = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffled():
        return {f for d in dirs for f in pathlib.Path(d).rglob("shuffle_*.data")}

    def measured(df, name, **how):
        out = written(df, name, **how)
        tables.append(sum(pathlib.Path(f.removeprefix("file:")).stat().st_size for f in out.inputFiles()))
        until = time.monotonic() + 10  # they are removed in the background
        while (new := shuffled() - before) and time.monotonic() < until:
            time.sleep(0.1)
        left.append(len(new))
        return out

    before = shuffled()
    monkeypatch.setattr(C, "written", measured)
    kept = C.distinct_claims(spark.createDataFrame(rows, "a long, n int, claim string"), "a", "n", "claim").collect()
    assert {r.pos for r in kept} == set(range(12_000))
    assert sum(tables) < size and tables[0] > sum(tables[1:]) and not any(left)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"  # as it was


def test_words_with_signs_at_their_ends_need_no_search_in_whole_texts(spark, monkeypatch):
    def never(*args):
        raise AssertionError("texts are searched")

    words = ["est.", "(a b)", "--c", "é...", "d, e;", "f ", " g", "$h$"]
    pool = ["est.", "est", "(a b)", "a b", "--c", "-c", "é...", "é....", "d, e;", "f ", " g", "g", "$h$", "h$", " ", ".", "x"]
    rng = random.Random(5)
    texts = [(i, "".join(rng.choices(pool, k=rng.randint(1, 5)))) for i in range(500)]
    monkeypatch.setattr(W, "written", lambda df, name: df if name == "words" else never())
    assert got(spark, texts, words) == brute(texts, words)


@pytest.mark.parametrize("most", [0, 120, B.IMAGE])
def test_boxes_of_whole_images_and_of_a_grid(spark, monkeypatch, most):
    monkeypatch.setattr(B, "IMAGE", most)
    monkeypatch.setattr(B, "BLOCK", 50)
    rng = random.Random(9)
    rows = stack(rng, 330)
    rows += [(1 + i % 30, 1000 + i, rng.uniform(0, 900), rng.uniform(0, 900), *(10 ** rng.uniform(0.5, 3.4) for _ in range(2)), None)
             for i in range(400)]
    rows += rows[:5] + [rows[-1]] * 3
    assert counted(spark, rows) == brute_boxes(rows)


def test_an_image_may_lie_in_many_batches(spark, monkeypatch):
    monkeypatch.setattr(B, "_large", None)
    rng = random.Random(2)
    rows = [(i % 7 // 3, i, rng.uniform(0, 90), rng.uniform(0, 90), 9.0, 8.0, True) for i in range(200)]
    want = brute_boxes(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert counted(spark, rows) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_runs_that_repeat_are_found_in_all_texts_of_a_batch(monkeypatch):
    def brute_covered(words):
        places = {}
        for i in range(len(words) - 5):
            places.setdefault(tuple(words[i:i + 6]), []).append(i)
        spots = sorted(i for found in places.values() if len(found) > 1 for i in found)
        return sum(sum(map(len, words[p:min([p + 6, *spots[k + 1:k + 2]])])) for k, p in enumerate(spots))

    rng = random.Random(1)
    texts = [[rng.choice(["a", "bé", "𝔸c"]) for _ in range(rng.choice([0, 3, 5, 6, 7, 30, 60]))] for _ in range(500)]
    texts += [None, [], ["x", "y"] * 100, [str(i) for i in range(99)] * 2]
    want = [brute_covered(t or []) for t in texts]
    for size in (1, 50, repeats.WORDS):
        monkeypatch.setattr(repeats, "WORDS", size)
        words = pa.array(texts, pa.list_(pa.string()))
        assert repeats.covered(words).tolist() == want and repeats.covered(words.slice(7, 100)).tolist() == want[7:107]


def test_words_are_not_sliced_in_the_plan(spark):
    d = spark.createDataFrame([(1, "a b c d e f a b c d e f")], "id int, text string")
    plan = flags(d, [Check.of({"content": "text"}, ["RuleDocRepeat"])], ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan and plan.count("translate(") == 1


@pytest.mark.parametrize("raw", [False, True])
def test_results_are_read_without_inferring_their_type(spark, tmp_path, raw):
    d = spark.createDataFrame([(1, "a:", None), (2, "", 5), (None, "fine text", 6)], "id long, text string, n int")
    kept = Retention(all_labels=True, raw=raw)
    v = evaluate(d, [Check.of({"content": "text"}, ["RuleColonEnd", "RuleContentNull"])], kept)
    writers.write_results(v, str(tmp_path / "r"), kept)
    one = "record" if raw else "record.raw_data"
    told = lambda t: sorted(map(tuple, t.select(f"{one}.id", f"{one}.text", "field", "label_type", "label_name").collect()), key=repr)
    known = writers.read_results(spark, str(tmp_path / "r"), True, raw, record=writers.record_type(v, kept))
    assert told(known) == told(writers.read_results(spark, str(tmp_path / "r"), True, raw)) != []
    assert dict(known.dtypes)["record"] == writers.record_type(v, kept).simpleString()


def _texts(rng, pool, n, most):
    return ["".join(rng.choices(pool, k=rng.randint(0, most))) for _ in range(n)] + [None, "", "x" * 3000]


def test_words_and_stretches_are_found_in_the_bytes_of_a_batch(monkeypatch):
    rng = random.Random(4)
    pool = ["a", "bé", "𝔸c", " ", "  ", "　", " ", "\t", "\r\n", "\n", "中", "文字", "…", "•", "–", ".", "/", "\xa0", "\x85", "́", "÷", "�"]
    texts = _texts(rng, pool, 600, 40)
    cjk, blank = X.CJK, X.SPACE
    mixed = f"[{cjk}]|[^{cjk}{blank}]+(?=[{cjk}])|(?<![^{blank}])[^{cjk}{blank}]+(?![^{blank}])"
    words = [re.findall(mixed, t or "") for t in texts]
    counts = [max(len(s.split()) for s in re.split("[\n" + X.SENTENCE_BREAKS + "]", t or "")) for t in texts]
    given = pa.array(texts)
    for size in (1, 70, marks.BYTES):
        monkeypatch.setattr(marks, "BYTES", size)
        assert [w for _, e, d in marks.parts(given) for w in marks.mixed_words(e, d).to_pylist()] == words
        assert marks.most_words(given).tolist() == counts
        assert marks.most_words(given.cast(pa.large_string()).slice(9, 50)).tolist() == counts[9:59]
    # bytes that are no UTF-8, and blanks written too long, are no blanks
    odd = [b"a \xff b", b"\xc0\xa0 c\xe2\x80", b"\xed\xa0\x80", b"\xf8 \xe2 a"]
    assert marks.most_words(pa.array(odd).cast(pa.binary()).view(pa.string())).tolist() == [3, 2, 1, 3]


def test_shares_of_repeated_runs_equal_a_count_by_places():
    rng = random.Random(6)
    texts = _texts(rng, ["a ", "b ", "cé ", "中", "文", "x", " "], 400, 60)
    words = [re.findall("[一-鿿]|[^一-鿿 ]+(?=[一-鿿])|(?<![^ ])[^一-鿿 ]+(?![^ ])", t or "") for t in texts]
    want = []
    for w in words:
        runs = [tuple(w[i:i + 6]) for i in range(len(w) - 5)]
        hit = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(6)}
        want.append(sum(len(w[i]) for i in hit) / sum(map(len, w)) * 100 if len(w) > 5 else 0.0)
    assert repeats.shares(pa.array(texts)).tolist() == want and max(want) > 30


def test_short_stuck_and_odd_texts_are_told_as_by_a_search_of_the_whole(spark):
    rng = random.Random(8)
    pool = ["ab", "Zé", "7", "9", " ", "\n", ".", "-", "/", "www", ".xy", "http://", ".pdf", "x.bat", "_", "q" * 20, "8" * 9, "a" * 46, "–", "　",
            "<p>", "</p>", "<o", "&lt", "&amp;", "＆gt；", "u200e", "? :", "�", "{/U}", "U+260A", "<|x|>", "​", "\xa0", "§"]
    texts = _texts(rng, pool, 1500, 14) + ["ab " * 19 + "c1 " * 9, "ab " * 19 + "c1, d_ é", "7 " * 200000 + "x" * 46, "x" * 46 + " b" * 200000, ".".join(["a"] * 99999)]
    ids = [*enumerate(texts)]
    names = ["RuleContentShortMultiLan", "RuleWordStuck", "RuleSpecialCharacter", "RuleInvisibleChar", "RuleHtmlEntity", "RuleHtmlTag", "RuleNoPunc"]
    got_ = {r[0]: r[1:] for r in flags(spark.createDataFrame(ids, "id int, text string"), [Check.of({"content": "text"}, names)], ["id"]).collect()}

    def brute_stuck(t):
        for p in (r"https?://[^\s]+|www.[a-z!$-_]+", r"\.pdf(?=\n?\Z)", r"\w+\.bat", r"/.*/.*", "[0-7]+"):
            t = re.sub(p, "", t)
        pieces = (p.strip(X.ASCII_PUNCTUATION) for p in re.split(S.STUCK_SPLIT, t) if len(p) > 45)
        return any(len(p) > 45 and not re.fullmatch("[A-Fa-f0-9]{64}", p) and len(re.findall("[A-Za-z]", p)) / len(p) > 0.5 for p in pieces)

    head = f"[&＆](?:{'|'.join(X.HTML_ENTITIES)})"
    for i, t in ids:
        t = t or ""
        n = lambda *ps: sum(len(re.findall(p, t)) for p in ps) >= 0.01 * len(t) and t != ""
        alpha = sum(w.isalpha() for w in re.findall(r"\w+", t))
        longest = max(len(s.split()) for s in re.split("[\n" + X.SENTENCE_BREAKS + "]", t))
        assert got_[i] == (alpha < 20, brute_stuck(t), n(*X.SPECIAL_PATTERNS), n(f"[{X.INVISIBLE}]"), n(head, head + "[;；]"), n("|".join(X.HTML_TAGS)),
                           longest > 112), t[:200]


def test_texts_are_not_searched_for_signs_they_lack(spark):
    """Patterns stand behind a look for their signs, and a stretch is split for the reason of a bad text only."""
    d = spark.createDataFrame([(1, "a b")], "id int, text string")
    plan = lambda n: flags(d, [Check.of({"content": "text"}, [n])], ["id"])._jdf.queryExecution().optimizedPlan().toString()
    for name, searches in (("RuleSpecialCharacter", 5), ("RuleHtmlTag", 1), ("RuleHtmlEntity", 2)):
        text = plan(name)
        assert text.lower().count("contains(") >= searches and "CASE WHEN" in text
    assert "split(" not in plan("RuleNoPunc") and "regexp_extract_all(" not in plan("RuleContentShortMultiLan")
    assert plan("RuleWordStuck").count("Generate") <= 4


def test_patterns_stand_behind_the_signs_of_a_text(spark):
    d = spark.createDataFrame([(1, "a b")], "id int, text string")
    for name in ("RuleEnterMore", "RuleEnterRatioMore", "RuleSpaceMore", "RuleOnlyUrl", "RuleSpecialCharacter", "RuleInvisibleChar", "RuleHtmlEntity",
                 "RuleHtmlTag", "RuleDocRepeat"):
        plan = flags(d, [Check.of({"content": "text"}, [name])], ["id"])._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("text_signs(") == 1 and "CASE WHEN" in plan, name


def test_texts_without_a_sign_are_told_as_by_a_search(spark, monkeypatch):
    """The rules judge alike whatever the signs of a text say, as long as they say no less than the text holds."""
    rng = random.Random(12)
    pool = ["ab", "Zé", "7", " ", "\n", "\n" * 5, "\r\n", ".", "/", "www", "www.ab", "http://", "https://a", ":", "x.bat", "q" * 20, "a" * 46, "·" * 46, "-",
            " " * 250, " " * 499, " " * 500, "<p", ">", "<", "&lt", "&", "＆gt；", "u200e", "? :", "&#247;", "�", "□", "{/U}", "U+260A", "<|x|>", "​", "\xa0"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 6))) for _ in range(3000)] + ["", None, "\n" * 8, " " * 500, "http://a", "b" * 46, "x" * 9 + "a.pdf"]
    rows = [(i, t.encode() if t is not None else None) for i, t in enumerate(texts)]
    rows += [(len(rows) + i, b) for i, b in enumerate([b"\xff", b"a\xe2\x80", b"\xef\xbf", b"\xc0\xa0" * 9, b"&lt\xff&lt;", b"\xff" * 46, b"A,\xff" * 9])]
    d = spark.createDataFrame(rows, "id int, b binary").selectExpr("id", "cast(b as string) AS text")
    names = ["RuleEnterMore", "RuleEnterRatioMore", "RuleSpaceMore", "RuleOnlyUrl", "RuleSpecialCharacter", "RuleInvisibleChar", "RuleHtmlEntity", "RuleHtmlTag",
             "RuleWordStuck", "RuleNoPunc", "RuleDocRepeat"]
    told = lambda: sorted(map(tuple, flags(d, [Check.of({"content": "text"}, names)], ["id"]).collect()))
    with_signs = told()
    from grainsieve.plans import features
    monkeypatch.setitem(features.FEATURES, "signs", (1, lambda f: F.lit(511)))
    assert with_signs == told() and all(any(r[k] for r in with_signs) for k in range(1, 10))
    # a text is held to hold what it does, wherever the parts of a batch end
    given = pa.array([t or "" for t in texts])
    for size in (1, 300, marks.BYTES):
        monkeypatch.setattr(marks, "BYTES", size)
        for t, bits in zip(given.to_pylist(), marks.signs_of(given).tolist(), strict=True):
            assert bits & marks.WIDE or t.isascii()
            for bit, p in ((marks.ENTITY, "[&＆]"), (marks.TAG, "<"), (marks.SPECIAL, "|".join(X.SPECIAL_PATTERNS)), (marks.BREAKS, "\n{8}"), (marks.SPACES, " {500}"),
                           (marks.URL, "https?://"), (marks.STUCK, r"/|www|\.pdf|\.bat|[^\n !(),./:;?|-]{46}")):
                assert bits & bit or not re.search(p, t), (bit, t)
            assert bits & marks.LINES or t.count("\n") * 4 <= len(t)
    assert not any(marks.signs_of(pa.array(["Plain words, and no more of them. Yes?\n", "", "two 2 of them"])))


def test_ascii_texts_are_folded_in_their_bytes(spark):
    rng = random.Random(15)
    pool = ["Ab", "ab", "c", ",", " ", ". ", "É", "é", "é", ";", "≠", "中", "\n", "'", "…", "X"]
    texts = ["".join(rng.choices(pool[:i % 2 * 9 + 7], k=rng.randint(0, 60))) for i in range(800)]
    texts += [f"{t} {rng.choice(pool)} {t.upper()}" for t in texts] + [None, "", "...", "A.B " * 12, "Ʞ " * 20]
    d = spark.createDataFrame([*enumerate(texts)], "id int, text string")
    from grainsieve.plans.evaluate import verdicts_of
    from grainsieve.plans.features import bind
    from grainsieve.functions import text as T
    measured = {r.id: r.measure for r in verdicts_of(d, Check.of({"content": "text"}, ["RuleDocRepeat"]), ["id"]).collect()}
    bare = bind(d, {"bare": T.without_punctuation(F.coalesce("text", F.lit("")))})
    folded = {r.id: r.folded for r in bare.select("id", T.fold(F.col("bare")).alias("folded")).collect()}
    want = repeats.shares(pa.array([folded[i] for i in range(len(texts))])).tolist()
    assert [measured[i] for i in range(len(texts))] == want and sum(0 < w < 100 for w in want) > 50
