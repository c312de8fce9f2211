"""Exact search and near-duplicate vectors against brute force."""

import numpy as np
import pytest

from grainsieve.llm import blocks, queries, vector_dedup, vectors

SF = "/root/testdata/sf0.01"


def usable(rows):
    return [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]


def best(rows, k=5):
    rows = [(i, np.floor(256 * np.array(v, float))) for i, v in usable(rows)]
    n = max((len(v) for _, v in rows), default=1)
    x = np.array([np.pad(v, (0, n - len(v))) for _, v in rows]).reshape(-1, n)
    out = []
    for a, (i, _) in enumerate(rows):
        if i % 50 == 0:
            found = sorted((-float(x[b] @ x[a]), rows[b][0], b) for b in range(len(rows)) if b != a)[:k]
            out += [(i, r + 1, f[1], int(-f[0])) for r, f in enumerate(found)]
    return sorted(out)


def linked(rows, least=0.95):
    rows = [r for r in rows if r[0] is not None]
    n = max((len(v) for _, v in rows if v), default=1)
    good = [bool(usable([r])) and any(r[1]) for r in rows]
    x = np.array([np.pad(np.array(v, float), (0, n - len(v))) if g else np.zeros(n) for (_, v), g in zip(rows, good)])
    norm = np.linalg.norm(x, axis=1)
    u = x / np.where(norm > 0, norm, 1)[:, None]
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    label = np.array([i for i, _ in rows])
    for _ in range(len(rows)):
        new = np.array([min(label[a], label[near[a]].min(initial=label[a])) for a in range(len(rows))])
        if (new == label).all():
            break
        label = new
    return sorted((i, int(near[a].sum()), int(label[a]), bool(label[a] == i)) for a, (i, _) in enumerate(rows))


@pytest.fixture(scope="module")
def table(spark):
    return [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i) * 10, None if i % 17 == 0 else [float(x) for x in rng.integers(-3, 3, 6) / 7]) for i in range(150)]
    base = rng.normal(size=(20, 6))
    rows += [(2000 + i, [float(x) for x in base[i % 20] + rng.normal(size=6) * 0.15]) for i in range(150)]
    rows += [(3000 + i, [0.1] * 6) for i in range(30)]
    rows += [(0, [0.1] * 6), (0, [0.1] * 6), (100, [float("nan")] * 6), (None, [0.1] * 6), (50, [0.3, None, 0.2, 0.0, 0.0, 0.0]),
             (150, [0.2] * 3), (151, [-0.0, 0.2]), (152, [0.0, 0.2]), (153, [0.0] * 6), (154, [float("inf")] + [0.0] * 5), (155, [])]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, row int")


def test_top_k_query(spark, table):
    assert sorted(map(tuple, queries.QUERIES["op3_exact_top_k"](spark, SF).collect())) == best(table)


def test_top_k_over_many_blocks(odd, monkeypatch):
    rows, df = odd
    for name, value in (("BLOCK_ROWS", 40), ("QUERIES_A_TASK", 3), ("STEP", 4)):
        monkeypatch.setattr(vectors, name, value)
    assert sorted(map(tuple, vectors.top_k(df, "vec_id % 50 = 0").collect())) == best(rows)


def test_top_k_of_few_rows(odd):
    _, df = odd
    assert vectors.top_k(df.limit(0), "vec_id % 50 = 0").collect() == []
    assert vectors.top_k(df.where("vec_id = 10"), "vec_id % 10 = 0").collect() == []
    assert len(vectors.top_k(df.where("vec_id in (10, 20, 30)"), "vec_id = 10").collect()) == 2


def test_large_components_stay_exact(spark):
    rows = [(i, [float((i * 7919) % 100_003) * 10, float(i * 31 % 97) * 1e3]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = sorted(((sum(a * b for a, b in zip(ints[0], ints[j]))), -j) for j in ints if j)[::-1][:5]
    got = vectors.top_k(df, "vec_id = 0").orderBy("rank").collect()
    assert [(r.score, -r.vec_id) for r in got] == want


def test_near_duplicate_query_recall(spark, table):
    got = sorted(map(tuple, queries.QUERIES["op10_vector_near_duplicates"](spark, SF).collect()))
    want = linked(table)
    assert [g[0] for g in got] == [w[0] for w in want] and all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want)


def test_near_duplicates_recall_on_close_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    rows = [(i, [float(x) for x in base[i % 400] + rng.normal(size=64) * 0.02]) for i in range(1600)]  # cosines about 0.975
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got, want = vector_dedup.near_duplicates(df).collect(), linked(rows)
    assert sum(r.n_links for r in got) >= 0.99 * sum(w[1] for w in want) > 0


@pytest.mark.parametrize("chunk", [2048, 8])
def test_near_duplicates_of_odd_rows(odd, chunk, monkeypatch):
    rows, df = odd
    monkeypatch.setattr(blocks.meet, "__defaults__", (chunk, 16))
    assert sorted(map(tuple, vector_dedup.near_duplicates(df).collect())) == linked(rows)
    assert vector_dedup.near_duplicates(df.limit(0)).collect() == []


def test_scores_beyond_a_long_are_refused(spark):
    df = spark.createDataFrame([(0, [1e18, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="would not fit a long"):
        vectors.top_k(df, "vec_id % 50 = 0", 5).collect()


def test_recall_of_planted_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(12_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 4000, 2):  # pairs of a cosine from 0.95 to 0.99
        away = rng.normal(size=64)
        away -= (away @ x[i]) * x[i]
        c = 0.95 + 0.04 * i / 4000 + 1e-4
        x[i + 1] = c * x[i] + np.sqrt(1 - c * c) * away / np.linalg.norm(away)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    found = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(df).collect()}
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    want = near.sum(1)
    assert want.sum() >= 4000 and all(n <= want[i] for i, (n, _) in found.items())
    assert sum(n for n, _ in found.values()) >= 0.99 * want.sum()
