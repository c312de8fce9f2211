"""Joins, passages, toxicity and the pipeline against brute force and held-out labels."""

import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from grainsieve.llm import blocks, common, ngram_join, queries, secrets, suffix_dedup, toxicity

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def joined(rows, size, percent):
    """(key, set size, links, smallest key of the component) by comparing all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    holders, links, label = {}, [0] * len(rows), [r[0] for r in rows]
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    edges = []
    for i, s in enumerate(sets):
        seen = {}
        for g in s:
            for j in holders[g]:
                if j > i:
                    seen[j] = seen.get(j, 0) + 1
        for j, n in seen.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                edges.append((i, j))
                links[i] += 1
                links[j] += 1
    moved = True
    while moved:
        moved = False
        for i, j in edges:
            low = min(label[i], label[j])
            moved |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return sorted((r[0], len(sets[i]), links[i], label[i]) for i, r in enumerate(rows))


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(1, 60))
        for _ in range(rng.randint(1, 8)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 - 20, " ".join(text + rng.choices(vocabulary, k=3 * (rng.random() < 0.3)))))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1003, "one"),
             (5, "w1 w2 w3 w4 w5"), (7, "zz " * 200), (8, "y" * 70_000)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, member int, version string")


@pytest.mark.parametrize("size, percent, chunk", [(4, 85, 1024), (5, 80, 4), (2, 60, 1024), (3, 100, 1024)])
def test_join_is_exact(spark, copies, size, percent, chunk, monkeypatch):
    meet = blocks.meet
    monkeypatch.setattr(blocks, "meet", lambda s, p, m, chunk_=chunk, **_: meet(s, p, m, chunk_, 64))
    got = ngram_join.join(frame(spark, copies), ngram_join.Rule(size, percent)).collect()
    assert sorted(map(tuple, got)) == joined(copies, size, percent)


def test_join_query_on_a_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op1_ngram_jaccard_join"](spark, SF).select("doc_id", "n_shingles", "n_links", "component_id").collect()
    assert sorted(map(tuple, got)) == joined(rows, 4, 85)


def test_crowded_filter_loses_nothing(spark, copies, monkeypatch):
    monkeypatch.setattr(ngram_join, "FILTER_BITS", 1 << 16)
    monkeypatch.setattr(ngram_join, "passes", lambda f, v: np.ones(len(v), bool))
    got = ngram_join.join(frame(spark, copies), ngram_join.Rule(4, 85)).collect()
    assert sorted(map(tuple, got)) == joined(copies, 4, 85)


@pytest.mark.parametrize("rule", [ngram_join.Rule(4, 85), ngram_join.Rule(5, 80), ngram_join.Rule(3, 100), ngram_join.Rule(2, 33)])
def test_linked_prefixes_share_what_is_asked(rule):
    cut = lambda n: -(-rule.loose * n // 100) - 1
    for a in range(1, 201):
        for b in range(a, 100 * a // rule.percent + 1):
            least = -(-rule.percent * (a + b) // (100 + rule.percent)) - max(cut(a), cut(b))
            assert 1 <= max(rule.shared(a), rule.shared(b)) <= least


@pytest.mark.parametrize("size, percent, nested", [(4, 85, [(7, 6), (14, 12), (29, 25), (54, 46)]), (5, 80, [(11, 9), (16, 13)])])
def test_nested_sets_are_linked(spark, size, percent, nested):
    rows = []
    for larger, smaller in nested:
        for copy in range(6):  # by the hashes, some of them share only one n-gram of their prefixes
            own = [f"s{larger}x{copy}y{i}" for i in range(larger + size - 1)]
            short = " ".join(own[:smaller + size - 1])
            rows += [(len(rows), " ".join(own)), (len(rows) + 1, short)]
            # what both share is frequent: it comes last in the larger set, whose other n-grams fill its prefix
            rows += [(len(rows) + i, " ".join([short, *(f"r{len(rows)}z{i}w{j}" for j in range(200))])) for i in range(8)]
    got = sorted(map(tuple, ngram_join.join(frame(spark, rows), ngram_join.Rule(size, percent)).collect()))
    want = joined(rows, size, percent)
    assert sum(r[2] for r in want) == 12 * len(nested) and got == want


def thue_morse(n, letters):
    return "".join(letters[i.bit_count() & 1] for i in range(n))


def test_regular_words_are_told_apart(spark):
    one, other = thue_morse(1024, "ab"), thue_morse(1024, "ba")
    rows = [(1, f"x {one} y"), (2, f"x {other} y"), (3, " ".join(one)), (4, " ".join(other)), (5, f"X {one} y")]
    assert [tuple(r) for r in ngram_join.join(frame(spark, rows), ngram_join.Rule(3, 100)).orderBy("doc_id").collect()] == [
        tuple(r) for r in spark.createDataFrame(
            [(k, n, links, c) for k, n, links, c in joined(rows, 3, 100)], "doc_id long, a long, b long, c long").orderBy("doc_id").collect()]
    assert len({h for t in (one, other, one[:9], one[:8]) for h in common.Words(*common.buffers(pa.array([t]))).hashes}) == 4


def test_rolled_hashes_depend_on_every_word_and_its_place():
    w = common.mix(np.arange(1, 200, dtype=np.uint64))
    for size in (1, 2, 3, 7, 25, 50, 199):
        whole = common.rolled(w, size)
        assert len(whole) == 200 - size and all(whole[i] == common.rolled(w[i:i + size], size)[0] for i in range(0, len(whole), 7))
        for at in range(0, size, 5):
            changed = w[:size].copy()
            changed[at] += np.uint64(1)
            assert common.rolled(changed, size)[0] != whole[0]
        if size > 1:
            assert common.rolled(w[:size][::-1], size)[0] != whole[0]


def test_t_occurrence_equals_counting():
    rng = np.random.default_rng(1)
    rule = ngram_join.Rule(4, 70)
    base = [np.sort(rng.choice(400, 40, False)) for _ in range(6)]
    sets = [np.unique(np.concatenate([b[rng.random(40) < 0.93], rng.choice(400, 3)])).astype(np.uint64) for b in base for _ in range(9)]
    want = {(i, j) for i in range(54) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 70 * len(np.union1d(sets[i], sets[j]))}
    for cut in (54, 20):
        a, b = ngram_join.t_occurrence(sets, rule, cut)
        got = {(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist())}
        assert len(got) == len(a) and got == {p for p in want if cut == 54 or (p[0] < cut) != (p[1] < cut)}


def test_join_of_an_empty_table(spark, copies):
    df = frame(spark, copies)
    assert ngram_join.join(df.limit(0)).collect() == []
    assert ngram_join.representatives(df.limit(0)).collect() == []


def test_one_row_of_each_group_stays(spark, copies):
    df = frame(spark, [*copies, (None, "w1 w2 w3 w4 w5 w6"), (None, None)])
    stays = ngram_join.representatives(df, ngram_join.Rule(4, 85))
    assert stays.columns == df.columns
    first = {(k, t) for k, t in copies}
    labels = {}
    for k, _, _, component in joined(copies, 4, 85):
        labels.setdefault(k, set()).add(component)
    want = sorted((k, t or "") for k, t in first if k in labels[k])
    got = [(r.doc_id, r.text or "") for r in stays.collect()]
    assert sorted(g for g in got if g[0] is not None) == want and sum(g[0] is None for g in got) == 2


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(7000, 7001), (7001, 7002), (7002, 7000), (5, 5)]
    df = spark.createDataFrame([(b, a) if i % 2 else (a, b) for i, (a, b) in enumerate(edges)], "a long, b long")
    got = {r.id: r.component for r in common.components(common.Scratch(spark, "test"), df).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1100)}, 7000: 7000, 7001: 7000, 7002: 7000}
    assert common.components(common.Scratch(spark, "test"), df.limit(0)).collect() == []


# ---- passages ---------------------------------------------------------------------------------------------------

def passages(rows, least):
    first, out = {}, []
    for key, text in sorted({r for r in rows if None not in r}, key=lambda r: r[0]):
        w, spans = words(text), []
        for s in range(len(w) - least + 1):
            window = tuple(w[s:s + least])
            if window not in first:
                first[window] = key
            elif spans and s <= spans[-1][1]:
                spans[-1][1] = s + least
                spans[-1][2].add(first[window])
            else:
                spans.append([s, s + least, {first[window]}])
        out += [(key, a, b - a, tuple(sorted(c))) for a, b, c in spans]
    return sorted(out)


@pytest.mark.parametrize("least, head", [(6, 3), (5, 5), (8, 2)])
def test_repeats_and_cuts(spark, least, head):
    rng = random.Random(least)
    vocabulary = [f"w{i}" for i in range(12)]
    shared = [rng.choices(vocabulary, k=rng.randint(4, 25)) for _ in range(6)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choices([*vocabulary, *(f"u{rng.randint(0, 999)}" for _ in range(30))], k=rng.randint(0, 10)) + rng.choice(shared)
        rows.append((1000 - 7 * i, " ".join(text)))
    rows += [(1, None), (None, "a b c"), (2, ""), rows[0], (5, "z " * 40), (9999, "Z " * 7)]
    df, rule = frame(spark, rows), suffix_dedup.Passage(least, head)
    want = passages(rows, least)
    assert sorted((r.doc_id, r.start_word, r.n_words, tuple(r.source_ids)) for r in suffix_dedup.repeats(df, rule).collect()) == want
    out = suffix_dedup.without_repeats(df, rule)
    assert out.columns == df.columns
    for r in out.collect():
        text = rows[r.member][1]
        gone = {j for k, a, n, _ in want if k == r.doc_id for j in range(a, a + n)}
        assert r.text is None if text is None else r.text.split() == [w for j, w in enumerate(text.split()) if j not in gone]
    assert suffix_dedup.repeats(df.limit(0), rule).collect() == []


def test_repeats_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.QUERIES["op6_repeated_passages"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.ORACLES["op6_repeated_passages"]).fetchall())


# ---- toxicity ---------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def insults(spark):
    """Labelled texts in which three words mark label 1."""
    rng = random.Random(9)
    plain = ["".join(rng.choices(["an", "the", "or", "in", "es", "ti", "re", "ha"], k=rng.randint(1, 4))) for _ in range(150)]
    bad = ["idiot", "moron", "pathetic"]
    texts, labels = [], []
    for i in range(600):
        text = rng.choices(plain, k=rng.randint(5, 60))
        toxic = i % 4 == 0
        for _ in range(2 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        texts.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return (spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


@pytest.fixture(scope="module")
def model(insults):
    return toxicity.fit(*insults)


def test_disguises_are_undone(model):
    restore = toxicity.Restorer(model.cost)
    for word, plain in (("id1ot", "idiot"), ("1diot", "idiot"), ("m0r0n", "moron"), ("p4thet!c", "pathetic"), ("iiidiooot", "idiot"),
                        ("i d i o t", "idiot"), ("m.o.r.o.n", "moron"), ("p-a-t-h-e-t-i-c", "pathetic")):
        assert restore(word) == plain
    text = "you m0ron, i d i o t! the&&& a$$$ fine 1diot\nx y 2"
    data = np.frombuffer(text.encode(), np.uint8)
    assert [text[a:b] for a, b in toxicity.disguised(data)] == ["m0ron,", "i d i o t", "1diot"]


def least_costs(restore, word):
    """The readings of least cost, by trying all."""
    best, cost = {}, restore.cost
    for path in itertools.product(*[restore._choices(word, i) for i in range(len(word))]):
        total, a, b, out = 0.0, 0, 0, []
        for symbol, written, own in path:
            total += own
            if symbol >= 0:
                out.append(written)
                if symbol or b:
                    total += cost[a][b][symbol]
                    a, b = b, symbol
        total += cost[a][b][0] if b else 0.0
        word_ = "".join(out)
        best[word_] = min(total, best.get(word_, math.inf))
    low = min(best.values())
    return {w for w, c in best.items() if c <= low + 1e-6}


def test_decoder_equals_trying_all_readings(model):
    restore, rng = toxicity.Restorer(model.cost), random.Random(3)
    for _ in range(300):
        word = "".join(rng.choices("idotmrn1034@$!*- .", k=rng.randint(1, 7)))
        assert restore.decode(word) in least_costs(restore, word), word


def test_all_that_may_be_disguised_is_decoded(model):
    found = lambda text: [text.encode()[a:b].decode() for a, b in toxicity.suspects(np.frombuffer(text.encode(), np.uint8))]
    assert found("the f***k, f***ing @$$hole a$$ is ok 12 3+4\n1 2 3 4\tx, (y) end.") == ["f***k,", "f***ing", "@$$hole", "a$$", "(y)"]
    assert found("k 1 l l! a s s, i d i o t! 1 d 1 0 t") == ["k 1 l l!", "a s s", "i d i o t!", "1 d 1 0 t"]
    assert found("k 1 l l, x") == ["k 1 l l"] and found("u.s.a") == ["u.s.a"] and found("1 2 3") == found("12") == found("") == []
    restore = toxicity.Restorer(model.cost)
    for text, plain in (("1 d 1 0 t", "idiot"), ("m 0 r 0 n", "moron"), ("1d1***0t", "idiot"), ("idiot!!", "idiot!!")):
        data, offs = toxicity.restored([f"the {text} an", "x"], restore)
        assert data.tobytes().decode() == f"the {plain} an\nx\n" and offs.tolist() == [0, len(plain) + 8, len(plain) + 10]
    hidden, = model.scores(["the inan 1 d 1 0 t m 0 r 0 n"], restore)
    assert hidden > 0.5


def test_scores_on_held_out_rows(insults, model):
    docs, labels = insults
    rows = toxicity.judged(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 600 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == r.toxic for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    restore = toxicity.Restorer(model.cost)
    plain, disguise, clean, none, empty = model.scores(
        ["the inan idiot moron", "the inan 1di0t m0r0n", "the inan orti reha", None, ""], restore)
    assert plain > 0.5 and disguise > 0.5 > clean and none == empty < 0.5


def test_held_out_accuracy_on_a_table(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.QUERIES["op4_toxicity"](spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) >= 0.9


def test_a_repeated_key_is_learnt_from_once(spark, insults, monkeypatch):
    docs, labels = insults
    told = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda rows, columns, label, *rest: told.append(len(label)) or train(rows, columns, label, *rest))
    key = labels.where("toxic = 1").where(~toxicity.held_out()).first().doc_id
    copies = docs.where(F.col("doc_id") == key).crossJoin(spark.range(400)).select("doc_id", F.concat("text", F.lit(" "), "id").alias("text"))
    toxicity.fit(docs, labels)
    toxicity.fit(docs.unionByName(copies), labels)
    assert told[0] == told[1] <= 600


def test_toxicity_of_odd_rows(spark, insults, model):
    docs, labels = insults
    odd = spark.createDataFrame([(1, None, 0.1), (1, "", 0.2), (None, "idiot moron " * 20_000, 0.3), (2, "clean", 0.4)],
                                "doc_id long, text string, score double")
    assert len(toxicity.score(odd, model).collect()) == 4
    assert toxicity.judged(odd, labels.limit(0)).where("predicted = 1").count() == 0  # no labels: one constant
    assert toxicity.judged(odd.limit(0), labels).collect() == []
    twice = labels.union(labels).union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    assert toxicity.accepted(docs, twice).columns == docs.columns
    texts = {r.doc_id: r.restored for r in toxicity.restore_texts(odd, model).collect()}
    assert texts[2] == "clean" and texts[1] == ""


NAMES = ("score", "__version", "__id", "__doc", "__cuts", "__text", "text_", "id", "version", "rows", "member", "group", "stays",
         "doc", "start", "cuts", "n", "a.b")


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_of_any_name(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    wide = docs.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in NAMES])
    rows = stage(spark, wide, SF)
    assert rows.columns == wide.columns
    rows = rows.collect()
    assert len(rows) > 100 and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in NAMES)
    plain = {r.doc_id: tuple(r) for r in stage(spark, docs, SF).collect()}
    assert {r.doc_id: tuple(r)[:len(docs.columns)] for r in rows} == plain


def test_unfinished_components_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    with pytest.raises(RuntimeError, match="still change"):
        common.components(common.Scratch(spark, "test"), chain, rounds=2)


# ---- the pipeline -----------------------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch, columns = common.Scratch(spark, "stages"), docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(scratch.save(stage(spark, kept[-1], SF)))
        if name != "packing":
            assert kept[-1].columns == columns
    rows = [{r.doc_id: r.text for r in k.select("doc_id", "text").collect()} for k in kept[:-1]]
    raw, clean, single, cut, masked = rows
    judged = {r.doc_id: r.predicted for r in queries.QUERIES["op4_toxicity"](spark, SF).collect()}
    assert clean == {k: t for k, t in raw.items() if not judged[k]}
    first = {k for k, _, _, component in joined(sorted(clean.items()), 5, 80) if k == component}
    assert single == {k: clean[k] for k in first}
    gone = {}
    for k, a, n, _ in passages(sorted(single.items()), 50):
        gone.setdefault(k, set()).update(range(a, a + n))
    assert {k: t.split() for k, t in cut.items()} == {
        k: [w for j, w in enumerate(t.split()) if j not in gone.get(k, ())] for k, t in single.items()}
    for k, t in cut.items():
        spans = secrets.base_spans(t)
        assert all(t[a:b] not in masked[k] for _, a, b in spans) and (spans or "[SECRET]" in masked[k] or masked[k] == t)
    assert {r.doc_id for r in kept[-1].collect()} == set(masked)
    whole = corpus_pipeline.run(spark, SF)
    assert whole.agg(F.sum("length")).first()[0] == kept[-1].agg(F.sum("length")).first()[0]
