"""Sources, sinks, summaries, judges, streams, media and grouped operators."""

import csv
import io
import json
import random
import struct
import time
import wave
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grainsieve import Check, JobSpec, Retention, catalog, evaluate, group, label_ratios, run_job, totals
from grainsieve.operators import claims as C, duplicates, media, scores as R
from grainsieve.plans import summary
from grainsieve.sources import dialogs, ranges, readers, writers
from grainsieve.streaming import running, state


def test_groups_and_catalog(spark):
    assert len(group("pretrain")) == 22 and len(group("resume")) == 14 and len(group("default")) == 9
    assert len(group("multi_lan_ru")) == 21
    with pytest.raises(KeyError):
        group("nope")
    assert catalog(spark).where("kind = 'rule'").count() >= 80


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,content\n1, "x"\n2,"two\nlines"\n , \n3\n', encoding="utf-8")
    rows = [tuple(r) for r in readers.read_csv(spark, str(p)).collect()]
    assert ("2", "two\nlines") in rows and ("3", "") in rows and len(rows) == 3


def test_json_forms(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a": {"x": 1}, "b": {"x": 2}}')
    (tmp_path / "l.json").write_text('[{"x": 1},\n {"x": 2}]')
    (tmp_path / "t.txt").write_text("one\ntwo\n")
    assert sorted(r.x for r in readers.read(spark, str(tmp_path / "m.json"), "json", record_schema="x int").collect()) == [1, 2]
    assert sorted(r.x for r in readers.read(spark, str(tmp_path / "l.json"), "listjson").collect()) == [1, 2]
    assert [r.content for r in readers.read(spark, str(tmp_path / "t.txt"), "plaintext").collect()] == ["one", "two"]
    with pytest.raises(ValueError):
        readers.read(spark, str(tmp_path / "t.txt"), "csv")


def test_job_writes_and_reads_back(spark, tmp_path):
    src, out = tmp_path / "in.jsonl", tmp_path / "out"
    src.write_text("\n".join(json.dumps({"id": i, "content": t}) for i, t in enumerate(["ends here:", "A long enough good text."])))
    v = run_job(spark, {"input_path": str(src), "output_path": str(out), "dataset": {"format": "jsonl"},
                        "evaluator": [{"fields": {"content": "content"}, "evals": [{"name": "RuleColonEnd"}, {"name": "RuleContentShort"}]}]})
    assert totals(v).collect()[0].asDict() == {"total": 2, "num_good": 1, "num_bad": 1, "score": 50.0}
    assert writers.read_results(spark, str(out), bad=True).select("label_name").distinct().count() == 2
    assert spark.read.json(f"{out}/summary").collect()[0].num_bad == 1
    with pytest.raises(ValueError):
        run_job(spark, JobSpec.of({"input_path": str(src), "executor": {"start_index": 1}, "evaluator": []}))


def test_judge_with_scorer_and_stored_answers(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "odd")], "id long, text string")
    check = [Check.of({"content": "text"}, ["LLMTextQualityV2", "RuleContentShort"])]
    answer = {"good": '{"score": 1, "reason": "r"}', "bad": '```json{"score": 0}```', "odd": "?"}
    want = {1: ["QUALITY_GOOD"], 2: ["QUALITY_BAD.LLMTextQualityV2"], 3: ["QUALITY_BAD.ConvertJsonError"]}

    def score(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: answer[p.rsplit("\n", 1)[1]])

    kept = Retention(all_labels=True)
    stored = spark.createDataFrame([(1, "LLMTextQualityV2", answer["good"]), (2, "LLMTextQualityV2", answer["bad"]),
                                    (3, "LLMTextQualityV2", "?")], "id long, metric string, response string")
    for v in (evaluate(df, check, kept, scorer=score), evaluate(df, check, kept, id_col="id", responses=stored)):
        got = {r.id: next(d.label for d in r.eval_details["text"] if d.metric == "LLMTextQualityV2") for r in v.collect()}
        assert got == want


def test_dialog(spark):
    df = spark.createDataFrame([([("hi", "yo"), ("a", "b")],)], "history array<struct<user:string,bot:string>>")
    assert dialogs.flatten_dialog(df).collect()[0].history == "user: hi\n\nassistant: yo\n\nuser: a\n\nassistant: b"


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    check = [Check.of({"content": "text"}, ["RuleCharNumber", "RuleNoPunc", "RuleDocRepeat"])]
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (running.running_label_counts(stream, check).writeStream.outputMode("complete").format("memory")
         .queryName("run").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.label, r.n) for r in spark.table("run").collect()}
    assert got == {(r.label, r.n) for r in label_ratios(evaluate(docs, check)).collect()} and got


def test_running_summary_equals_the_batch_after_a_restart(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", "text", (F.col("doc_id") * 7 % 5).alias("hour"), F.struct(F.col("text").alias("standard"), F.when(
            F.col("doc_id") % 3 > 0, F.upper("text")).otherwise("").alias("produced")).alias("meta"))
    checks = [Check.of({"content": "text"}, ["RuleCharNumber", "RuleNoPunc", "RuleDocRepeat"]), Check.of({"metadata": "meta"}, ["RuleMetadataSimilarity"])]
    source, path, by = tmp_path / "in", str(tmp_path / "state"), ("hour",)
    parts = docs.randomSplit([1.0] * 6, 3)
    handle = state.running_summary(checks, path, by)

    def stream(done):
        s = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        s.writeStream.foreachBatch(done).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    def broken(batch, number):
        handle(batch, number)
        if number == 4:  # the state is written, the batch is not committed: it runs again
            raise ValueError("stop")

    for p in parts[:4]:
        p.coalesce(1).write.mode("append").parquet(str(source))
    stream(handle)
    for p in parts[4:]:  # hours of earlier batches come again
        p.coalesce(1).write.mode("append").parquet(str(source))
    with pytest.raises(Exception, match="stop"):
        stream(broken)
    stream(handle)
    now, batch = state.current_tally(spark, path, by), summary.tally(evaluate(docs, checks), *by)
    rounded = lambda df: {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(batch.columns).collect()}
    assert rounded(now) == rounded(batch) and now.where("kind = 'score'").count() == 5
    assert len(list((tmp_path / "state").glob("batch-*"))) == 2
    whole = now.groupBy(*state.KEYS).agg(F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("mean", "score_count", "low", "high", "dev")])
    assert summary.summary_of(whole).first().total == docs.count()
    handle(docs, 0)  # anew
    assert rounded(state.current_tally(spark, path, by)) == rounded(batch)
    with pytest.raises(FileNotFoundError):
        state.current_tally(spark, str(tmp_path / "none"))


def test_claims(spark):
    c = spark.createDataFrame([(1, 0, "Water boils."), (1, 1, "water boils"), (1, 2, ""), (1, 3, "The sea is deep"), (1, 4, "Water boils.")],
                              "a long, n int, claim string")
    assert [r.claim for r in C.distinct_claims(c, "a", "n", "claim").orderBy("pos").collect()] == ["Water boils.", "The sea is deep"]


def first_claims(rows):
    """Claims kept when each article's are taken one by one."""
    out, seen = [], {}
    for article, pos, claim in sorted(rows, key=lambda r: (r[1], (r[2] or "").strip().lower())):
        low, kept = (claim or "").strip().lower(), seen.setdefault(article, [])
        if low and not any((low in s or s in low) and (low == s or abs(len(low) - len(s)) < 0.2 * max(len(low), len(s))) for s in kept):
            kept.append(low)
            out.append((article, pos, claim))
    return sorted(out, key=repr)


def test_claims_equal_taking_them_one_by_one(spark):
    rng = random.Random(7)
    rows = []
    for article in [1, 2, 3, None]:
        texts = []
        for pos in range(150):
            base = rng.choice(texts) if texts and rng.random() < 0.7 else "".join(rng.choices("ab cé中", k=rng.randint(0, 90)))
            cut = rng.randint(0, max(1, len(base) // 6))
            base = rng.choice([base[cut:], base[:len(base) - cut], base + base[:cut], "".join(rng.choices("ab", k=cut)) + base, base.upper()])
            texts.append(base)
            rows.append((article, pos, base))
        rows.append((article, 200, None))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "a long, n int, claim string, id int, low int")
    got = sorted(((r.a, r.pos, r.claim) for r in C.distinct_claims(df, "a", "n", "claim").collect()), key=repr)
    assert got == first_claims(rows) and len(got) < 550
    assert C.distinct_claims(df.limit(0), "a", "n", "claim").collect() == []


def test_pieces_of_claims_meet():
    rng = random.Random(8)
    for _ in range(4000):
        whole = "".join(rng.choices("abc", k=rng.randint(6, 130)))
        gap = rng.randint(0, max(0, C.inner(len(whole))[0]))
        start = rng.randint(0, gap)
        part = whole[start:len(whole) - gap + start]
        if gap:
            assert gap < 0.2 * len(whole) and C.pieces(whole)[0] in C.pieces(part)[1]
            assert len(C.pieces(part)[1]) <= 40


def test_signs_of_alike_claims_let_them_meet(spark):
    rng = random.Random(9)
    pairs = [(whole[:-1], whole[1:]) for n in (4, 5, 40, 66_000) for whole in ["=" * (n + 2), "ab" * (n // 2 + 2)]]
    pairs = [(w + "c" * (len(w) // 9), w) for w, _ in pairs if len(w) > 30]
    pairs += [("a" * n, "a" * (n - gap)) for n in range(6, 60) for gap in range(1, C.inner(n)[0] + 1)]
    for n in [rng.randint(6, 130) for _ in range(1500)] + [1500, 65_535, 65_536, 65_600, 80_000] * 2 + [(1 << C.LENGTH) + 9]:
        whole = "".join(rng.choices(rng.choice(["ab", "abcdefgh é中𝒳"]), k=n))
        gap = rng.randint(min(1, C.inner(n)[0]), C.inner(n)[0])
        start = rng.randint(0, gap)
        pairs.append((whole, whole[start:n - gap + start]))
    pairs = [(i, w, p) for i, (w, p) in enumerate(pairs) if 0 < len(w) - len(p) < 0.2 * len(w)]
    df = spark.createDataFrame(pairs, "i int, whole string, part string").repartition(8)
    asks = df.select("i", F.inline(C.claim_signs("whole"))).withColumnRenamed("sign", "a")
    met = asks.join(df.select("i", F.inline(C.claim_signs("part"))), ["i", "piece"]).where(C.may_hold(F.col("a"), F.col("sign")))
    assert {r.i for r in met.select("i").distinct().collect()} == {i for i, _, _ in pairs}
    # and others do not: too short, too far to the right, other letters that follow
    one, two = "0123456789" * 3 + "abcdefghijkl" + "9876543210" * 3, "xyzw" * 6 + "abcdefghijkl" + "wzyx" * 6
    df = spark.createDataFrame([(i, one, p) for i, p in enumerate([one, one[:50], "-" * 14 + one[:50], two])], "i int, whole string, part string")
    asks = df.select("i", F.inline(C.claim_signs("whole"))).withColumnRenamed("sign", "a")
    met = asks.join(df.select("i", F.inline(C.claim_signs("part"))), ["i", "piece"]).where(C.may_hold(F.col("a"), F.col("sign")))
    assert met.count() == 0


def test_a_long_chain_of_claims_is_decided(spark):
    links = [(1, i, i + 1) for i in range(24)] + [(1, i, i + 2) for i in range(0, 20, 3)]
    gone, linked = set(), {}
    for _, a, b in links:
        linked.setdefault(b, []).append(a)
    for b in sorted(linked):
        if any(a not in gone for a in linked[b]):
            gone.add(b)
    df = spark.createDataFrame(links, "art long, id long, other long")
    assert {r.id for r in C.first_of_alike(df).collect()} == gone
    with pytest.raises(RuntimeError, match="undecided"):
        C.first_of_alike(df, rounds=3)


def test_chunks(spark):
    text = spark.createDataFrame([("aaaaaaaaa.bbbbbbbbbbbb",)], "t string")
    rows = text.select(F.inline(R.text_chunks(F.col("t"), 11))).collect()
    assert [r.chunk for r in rows] == ["aaaaaaaaa.", "bbbbbbbbbbb", "b"]


def test_long_texts_are_cut_in_linear_time(spark):
    text = "".join(f"word{i}" + ("." if i % 90 == 0 else " ") for i in range(400_000))  # 4 million characters, some 4000 pieces
    df = spark.createDataFrame([(text,), (None,), ("",), ("é" * 9 + "。" + "\n\n" * 4,)], "t string")
    begun = time.monotonic()
    rows = df.select("t", F.inline(R.text_chunks(F.col("t"), 1000))).where("length(t) > 1000").select("chunk_no", "chunk", "start_pos", "end_pos").collect()
    assert time.monotonic() - begun < 60
    assert "".join(r.chunk for r in rows) == text and [r.chunk_no for r in rows] == list(range(len(rows)))
    assert all(r.chunk == text[r.start_pos:r.end_pos] for r in rows) and all(r.chunk.endswith(".") for r in rows[:-1] if "." in r.chunk[800:])
    small = df.where("t is null or length(t) < 1000").select(F.inline(R.text_chunks(F.col("t"), 10))).collect()
    assert [tuple(r) for r in small] == [(0, "", 0, 0)] * 2 + [(0, "é" * 9 + "。", 0, 10), (1, "\n" * 8, 10, 20)]


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 48))
    vecs = np.vstack([base, base[:10] + rng.normal(scale=0.02, size=(10, 48)), base[:3]])
    codes = [sum(1 << i for i, x in enumerate(v) if x > 0) for v in vecs]
    df = spark.createDataFrame([(i, int(c), [float(x) for x in v]) for i, (c, v) in enumerate(zip(codes, vecs))],
                               "id long, code long, vec array<double>")
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    want = {i for i in range(len(vecs)) for j in range(len(vecs)) if i != j and (codes[i] ^ codes[j]).bit_count() <= 10
            and unit[i] @ unit[j] >= 0.97}
    assert {r.id for r in media.near_duplicates(df, "id", "code", "vec").collect()} == want and len(want) == 23


def test_masks_leave_out_every_set_of_differing_bits():
    rng = np.random.default_rng(1)
    for distance, n in ((0, 10), (3, 500), (10, 500), (10, 10 ** 6), (11, 2000), (20, 1000)):
        masks = duplicates.masks_for(distance, n)
        assert len(masks) <= duplicates.MASKS and len(set(masks)) == len(masks)
        for _ in range(100):
            differ = sum(1 << int(i) for i in rng.choice(64, distance, replace=False))
            assert any(not m & differ for m in masks)
    with pytest.raises(ValueError):
        duplicates.masks_for(64, 1000)


def test_close_codes_are_all_found_and_candidates_stay_in_step(spark):
    rng = np.random.default_rng(2)
    codes = [int(x) for x in rng.integers(-2 ** 63, 2 ** 63, 150)]
    codes += [c ^ sum(1 << int(i) for i in rng.choice(63, int(rng.integers(1, 13)), replace=False)) for c in codes]
    df = spark.createDataFrame([(c,) for c in codes + codes[:5] + [None, None]], "code long")
    for distance in (4, 10):
        want = {(a, b) for a in codes for b in codes if a < b and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= distance}
        assert sorted(map(tuple, duplicates.close_codes(df, distance).collect())) == sorted(want)
    assert duplicates.close_codes(df.limit(0), 10).collect() == []
    counts = [duplicates.candidates(spark.createDataFrame([(int(x),) for x in rng.integers(-2 ** 63, 2 ** 63, n)], "code long"), 10).count()
              for n in (500, 2000)]
    assert counts[1] <= 5 * counts[0] < 500 * 500


def test_partners_of_crowds_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    rows = [(i, int(i % 6), [float(x) for x in base[i % 6] + rng.normal(size=8) * 0.3]) for i in range(120)]  # few codes, many vectors
    rows += [(200 + i, 3, [1.0] * 8) for i in range(20)] + [(300, None, [1.0] * 8), (301, None, [1.0] * 8), (302, 1, None), (303, 1, None),
                                                          (304, 2, [0.0] * 8), (305, 2, [0.0] * 8), (306, 40, [1.0] * 8)]
    df = spark.createDataFrame(rows, "id long, code long, vec array<double>").selectExpr("*", "1 as rep", "2 as a", "3 as key", "4 as n")
    groups = {}
    for i, c, v in rows:
        groups.setdefault((c, None if v is None else tuple(v)), []).append(i)
    want = set()
    for (c, v), own in groups.items():
        near = [min(o) for (d, w), o in groups.items() if (c, v) != (d, w) and None not in (c, v, d, w) and (c ^ d).bit_count() <= 2
                and any(v) and any(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9]
        want |= {(i, len(own), min(near, default=None), len(near), min(own)) for i in own}
    for crowd, block in ((64, 512), (3, 7)):
        monkeypatch.setattr(duplicates, "CROWD", crowd)
        monkeypatch.setattr(duplicates, "BLOCK", block)
        assert set(map(tuple, duplicates.partners(df, "id", "code", "vec", 2, 0.9).collect())) == want
    ratio, = duplicates.duplicate_ratio(duplicates.partners(df, "id", "code", "vec", 2, 0.9)).collect()
    assert ratio.images == len(rows) and ratio.duplicates == sum(w[1] > 1 or w[3] > 0 for w in want)


@pytest.mark.parametrize("tiled", [0, 1 << 22])
def test_partners_in_tiles_equal_those_of_the_join(spark, monkeypatch, tiled):
    """Both ways, over several groups: keys that repeat, keys that are texts, null keys, vectors of other lengths and odd numbers."""
    for name, value in (("TILED", tiled), ("GROUP_LEAST", 20), ("GROUP_MOST", 40), ("STEP", (8, 16))):
        monkeypatch.setattr(duplicates, name, value)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(4, 6))
    rows = [(None if i % 31 == 0 else f"k{i % 97}", int(rng.integers(0, 16)) * (-1) ** i, [float(x) for x in base[i % 4] + rng.normal(size=6) * 0.2]) for i in range(150)]
    rows += [("a", 1, [1.0, 0.0]), ("b", 1, [2.0, 0.0]), ("c", 1, []), ("d", 1, [0.0] * 6), ("e", 1, [None] + [1.0] * 5), ("f", 3, [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "id string, code long, vec array<double>")
    once = {}
    for k, c, v in rows:
        once.setdefault((c, str(v)), [[], c, v])[0].append(k)
    recs = [(min((k for k in ks if k is not None), default=None), len(ks), c, v, ks) for ks, c, v in once.values()]

    def alike(v, w):
        if len(v) != len(w) or None in v or None in w:
            return False
        under = (sum(x * x for x in v) * sum(x * x for x in w)) ** 0.5
        return under != 0 and not sum(x * y for x, y in zip(v, w)) / under < 0.95

    near = {}
    for rep, _, c, v, _ in recs:
        near.setdefault(rep, []).extend(o[0] for o in recs if None not in (rep, o[0]) and rep != o[0]
                                        and ((c ^ o[2]) & (2 ** 64 - 1)).bit_count() <= 2 and alike(v, o[3]))
    want = sorted((str((k, n, min(near[rep], default=None), len(near[rep]), rep)) for rep, n, _, _, ks in recs for k in ks))
    got = sorted(str(tuple(r)) for r in duplicates.partners(df, "id", "code", "vec", 2, 0.95).collect())
    assert got == want and any(near.values())


def test_many_images_meet_without_a_row_for_each_mask(spark):
    """30,000 different codes in 100 crowds: under masks each record was a row for each of 2047 masks, and each crowd met under many."""
    e = spark.range(30_000).selectExpr("id", "xxhash64(id % 100) ^ shiftleft(id div 100, 8) as code", "array(1D, id % 100) as vec")
    begun = time.monotonic()
    found = duplicates.partners(e, "id", "code", "vec", 10, 0.9).agg(F.min("partners"), F.max("partner")).first()
    assert time.monotonic() - begun < 60
    assert found[0] >= 299 and found[1] < 200  # nine bits differ at most within a crowd, of 300 each


def test_pixel_hashes_stand_small_changes(spark):
    rng = np.random.default_rng(4)
    small = rng.integers(0, 256, (8, 8))
    image = np.repeat(np.kron(small, np.ones((20, 25)))[:, :, None], 3, 2).astype(np.uint8)
    noisy = np.clip(image.astype(int) + rng.integers(-6, 7, image.shape), 0, 255).astype(np.uint8)
    half = image[::2, ::2]
    other = np.repeat(np.kron(rng.integers(0, 256, (8, 8)), np.ones((20, 25)))[:, :, None], 3, 2).astype(np.uint8)
    alpha = np.dstack([image, np.full(image.shape[:2], 255, np.uint8)])
    made = [image, noisy, half, other, alpha, image[:, :, :1]]
    schema = "id long, image struct<height: int, width: int, nChannels: int, data: binary>"
    rows = [(i, (x.shape[0], x.shape[1], x.shape[2], bytearray(x.tobytes()))) for i, x in enumerate(made)]
    df = spark.createDataFrame(rows + [(6, None), (7, (0, 0, 3, bytearray()))], schema)
    code = {r.id: r.code for r in df.select("id", duplicates.image_code("image").alias("code")).collect()}
    far = lambda a, b: ((code[a] ^ code[b]) & (2 ** 64 - 1)).bit_count()
    assert far(0, 1) <= 4 and far(0, 2) <= 10 and far(0, 3) > 10 and code[4] == code[0] and far(0, 5) == 0
    assert code[6] is None and code[7] is None
    same = df.where("id < 6").select("id", duplicates.image_code("image").alias("code"), F.array(F.lit(1.0)).alias("vec"))
    assert {r.id for r in duplicates.near_duplicates(same, "id", "code", "vec").collect()} == {0, 1, 2, 4, 5}


def test_csv_over_ranges_equals_whole_files(spark, tmp_path):
    rng = random.Random(9)
    cell = lambda: "".join(rng.choices(["a", "b c", ",", '"', "\n", "\r\n", "é中", "", "x" * 30], k=rng.randint(0, 6)))
    want = []
    for name in ("a.csv", "b.csv"):
        rows = [[str(i), cell(), cell()] for i in range(1500)]
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator="\r\n" if name == "a.csv" else "\n")
            w.writerow(["id", "x,y", "z"])
            w.writerows(rows)
            f.write("\n\n")
        want += rows
    want = sorted(tuple(c.strip() for c in r) for r in want)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        df = readers.read_csv(spark, str(tmp_path))
        lines = ranges._lines(spark, str(tmp_path), '"', False)
        assert lines.select("file", "block").distinct().count() > 20 and lines.where("odd").count() > 100
        assert df.columns == ["id", "x,y", "z"]
        assert sorted(map(tuple, df.collect())) == want
        bare = readers.read_csv(spark, str(tmp_path / "b.csv"), has_header=False, columns=["a", "b", "c"])
        assert bare.columns == ["a", "b", "c"] and bare.count() == 1501
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "t.csv").write_text("a\tb\n'1\n2'\t3\n\t\n'open\tx\ny", encoding="utf-8")
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "t.csv"), dialect="excel-tab", quotechar="'").collect())) == [
        ("1\n2", "3"), ("open\tx\ny", "")]
    (tmp_path / "none.csv").write_text("")
    assert readers.read_csv(spark, str(tmp_path / "none.csv")).collect() == []
    with open(tmp_path / "g.csv", "w", encoding="gbk") as f:
        f.write('a,b\n中,"1\n2"\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "g.csv"), encoding="gbk").collect()] == [("中", "1\n2")]


def test_json_documents_over_ranges_equal_whole_files(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices(["a", '"', "\\", "{", "}", "[", "]", ",", ":", "é中", "\n", " "], k=rng.randint(0, 9)))

    def record(i):
        out = {"id": i, "t": word()}
        if i % 3 == 0:
            out["in"] = {"x": word(), "l": [{"y": word()} for _ in range(rng.randint(0, 3))]}
        return out

    rows = [record(i) for i in range(900)]
    (tmp_path / "l.json").write_text(json.dumps(rows, indent=1, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "m.json").write_text(json.dumps({word() + str(r["id"]): r for r in rows}), encoding="utf-8")
    schema = "id long, t string, in struct<x: string, l: array<struct<y: string>>>"
    want = sorted((r["id"], r["t"], json.dumps(r.get("in"))) for r in rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2048)
    try:
        for name, fmt, given in (("l.json", "listjson", {}), ("m.json", "json", {}), ("m.json", "json", {"record_schema": schema}),
                                 ("l.json", "listjson", {"schema": schema})):
            df = readers.read(spark, str(tmp_path / name), fmt, **given)
            assert sorted((r.id, r.t, json.dumps(r["in"].asDict(True) if r["in"] else None)) for r in df.select("id", "t", F.struct(
                F.col("in.x").alias("x"), F.transform("in.l", lambda y: F.struct(y["y"].alias("y"))).alias("l")).alias("s"), "in").select(
                "id", "t", F.when(F.col("in").isNotNull(), F.col("s")).alias("in")).collect()) == want
        assert ranges._json_pieces(spark, str(tmp_path / "m.json"), False).select("block").distinct().count() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "e.json").write_text(' [ 1, "{}", {"a": {}}, null, {"b": 1}]')
    assert sorted(r.text for r in ranges.json_records(spark, str(tmp_path / "e.json")).collect()) == ['{"a": {}}', '{"b": 1}']


def png(path, width, height, value):
    raw = b"".join(b"\0" + bytes([value]) * 3 * width for _ in range(height))

    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
                     + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_images(spark, tmp_path):
    png(tmp_path / "white.png", 10, 10, 255)
    png(tmp_path / "wide.png", 50, 10, 7)
    v = evaluate(readers.read_images(spark, str(tmp_path)), [Check.of({"image": "image"}, ["RuleImageValid", "RuleImageSizeValid"])])
    got = {r.o.rsplit("/", 1)[1]: {d.metric for d in r.eval_details["image"]} for r in v.select(F.col("image.origin").alias("o"), "eval_details").collect()}
    assert got == {"white.png": {"RuleImageValid"}, "wide.png": {"RuleImageSizeValid"}}


def test_sound(spark):
    def wav(x, rate=16000):
        b = io.BytesIO()
        with wave.open(b, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes((x * 30000).astype("<i2").tobytes())
        return b.getvalue()

    t = np.arange(16000) / 16000
    noise = np.random.default_rng(0).normal(scale=0.2, size=16000).clip(-1, 1)
    rows = [("tone", wav(np.sin(2 * np.pi * 440 * t) * 0.9 + noise * 0.001)), ("noise", wav(noise)), ("long", wav(np.sin(t[0] + np.arange(11 * 8000)), 8000))]
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in rows], "n string, audio binary")
    v = evaluate(df, [Check.of({"audio": "audio"}, ["RuleAudioDuration", "RuleAudioSnrQuality"])]).collect()
    got = {r.n: {d.metric for d in (r.eval_details or {}).get("audio", [])} for r in v}
    assert got["noise"] == {"RuleAudioDuration"} and got["tone"] == set() and "RuleAudioSnrQuality" in got["long"]


def test_entry(spark):
    import __spark_entry__ as e
    qs, sqls = e.queries(), e.oracle_sql()
    assert set(sqls) <= set(qs) and len(qs) > 150
    assert e.entry(spark).columns == ["field_key", "label", "n", "ratio"]
