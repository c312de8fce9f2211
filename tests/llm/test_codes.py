"""Vector codes and centroid clusters against plain Lloyd rounds."""

import hashlib

import numpy as np
import pytest

from grainsieve.llm import clusters, vector_codes


def nearest(x, entries):
    d = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    at = np.array([row.tolist().index(min(row.tolist())) for row in d], int) if len(d) else np.zeros(0, int)
    return at, d[np.arange(len(at)), at]


def lloyd(x, entries, rounds):
    for _ in range(rounds):
        at, _ = nearest(x, entries)
        entries = np.array([[int(c) // int((at == e).sum()) for c in x[at == e].sum(0)] if (at == e).any() else entries[e].tolist()
                            for e in range(len(entries))], np.int64)
    return entries, *nearest(x, entries)


def usable(v, size=None):
    return v is not None and all(c is not None and np.isfinite(c) for c in v) and size in (None, len(v))


def last(key):
    return key is None, key or 0


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i) * 3 % 1000, [float(c) for c in rng.integers(-4, 5, 8) / 16], int(i) % 3 or None) for i in range(300)]
    rows += [(5, [0.25] * 8, 1)] * 40 + [(None, [0.5] * 8, 1), (7, None, 1), (8, [float("nan")] * 8, 2), (9, [float("inf")] + [0.0] * 7, 2),
                                       (10, [0.1, None] + [0.0] * 6, 2), (11, [0.125] * 5, 4), (12, [], 4)]
    schema = "vec_id long, embedding array<double>, label int"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as vec", "2 as codes", "3 as chunk", "4 as counts", "5 as error", "6 as l",
                                                       "7 as cluster", "8 as __salt", "9 as dists")
    return rows, df.repartition(7)


def test_moved_entries_give_what_a_full_scan_gives():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x, old = rng.integers(-3, 4, (60, 2)), rng.integers(-3, 4, (rng.integers(1, 9), 2))
        new, move = old.copy(), rng.random(len(old)) < rng.random()
        new[move] += rng.integers(-1, 2, (int(move.sum()), 2))
        got = vector_codes.renewed(x, new, (new != old).any(1), *vector_codes.nearest(x, old))
        want = nearest(x, new)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_wide_integers_stay_exact():
    x = np.array([[vector_codes.LIMIT, -vector_codes.LIMIT], [3, 1]])
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v)) for v in -x] for u in x]
    assert vector_codes.squared(x, -x).tolist() == want == clusters.distances(x, -x).tolist()


def test_vector_codes(odd):
    rows, df = odd
    kept = sorted([(i, np.pad(np.floor(1024 * np.array(v, float)), (0, 8 - len(v))).astype(np.int64), lab)
                   for i, v, lab in rows if usable(v)], key=lambda r: (*last(r[0]), r[1].astype(np.int32).tobytes()))
    coded, books = vector_codes.compress(df, entries=40)
    codes, error, finals = [], 0, []
    for p in range(4):
        x = np.array([v[2 * p:2 * p + 2] for _, v, _ in kept])
        entries, at, d = lloyd(x, x[:40], 4)
        finals.append(entries)
        codes.append(at)
        error = error + d
    assert books.tolist() == [f.tolist() for f in finals]
    got = sorted(((r.vec_id, r.label, r.error, np.frombuffer(r.codes, np.uint16).tolist()) for r in coded.collect()), key=repr)
    assert got == sorted(((i, lab, int(e), list(map(int, c))) for (i, _, lab), e, c in zip(kept, error, zip(*codes))), key=repr)


def test_code_digests(odd):
    rows, df = odd
    coded, books = vector_codes.compress(df)
    want = {}
    for r in coded.collect():
        want[r.label] = want.get(r.label, 0) + r.error
    labels = {}
    for i, v, lab in rows:
        labels.setdefault(i, set()).add(lab)
    out = vector_codes.digests(df).collect()
    sha = hashlib.sha256(",".join(str(c) for c in books.ravel().tolist()).encode()).hexdigest()
    assert len(out) == sum(usable(v) for _, v, _ in rows)
    assert all(r.label_error in {want[x] for x in labels[r.vec_id]} and r.codebooks_sha256 == sha and len(r.code) == 8 for r in out)


def test_centroid_clusters(odd):
    rows, df = odd
    kept = sorted([(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v, _ in rows if usable(v, 8)],
                  key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1].astype(np.int32).tobytes()))
    x = np.array([v for _, v in kept])
    for k in (13, 40, 1000):
        found, centroids = clusters.cluster(df, k=k, dims=8)
        want, at, d = lloyd(x, x[:k], 5)
        assert centroids.tolist() == want.tolist()
        assert sorted(((r.vec_id, r["cluster"], r.distance) for r in found.collect()), key=repr) == sorted(
            ((i, int(a), int(e)) for (i, _), a, e in zip(kept, at, d)), key=repr)


def test_cluster_digests(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(c) for c in rng.normal(size=64)]) for i in range(100)] + [(100, [0.0] * 63)],
                               "vec_id long, embedding array<double>")
    out = clusters.digests(df).collect()
    found, centroids = clusters.cluster(df)
    assert len(out) == 100 and {r.inertia for r in out} == {sum(r.distance for r in out)}
    for r in out:
        assert r.cluster_inertia == sum(o.distance for o in out if o["cluster"] == r["cluster"])
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()


def test_empty_tables_and_components_too_large(spark):
    schema = "vec_id long, embedding array<double>, label int"
    for rows in ([], [(1, None, 1)]):
        df = spark.createDataFrame(rows, schema)
        assert vector_codes.digests(df).collect() == [] and clusters.digests(df).collect() == []
    df = spark.createDataFrame([(1, [1e9] * 64, 1)], schema)
    for digests in (vector_codes.digests, clusters.digests):
        with pytest.raises(Exception, match="would not fit a long"):
            digests(df).collect()
