"""Byte-level BPE and packing: against the libraries and exact round trips."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from grainsieve.llm import bpe, packing, pretokens, queries

SF = "/root/testdata/sf0.001"
RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_boundaries_are_those_of_the_pattern():
    rng, pattern = random.Random(1), regex.compile(P.PATTERN)
    letters = list("stmdrvel'''  \n\n\t!?.,1é2中  x\x85​٣")
    for _ in range(4000):
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 12))) for _ in range(rng.randint(1, 4))]
        text, firsts = "".join(texts), np.cumsum([0, *map(len, texts)])[:-1]
        cut = pretokens.boundaries(text, firsts).tolist()
        assert [text[a:b] for a, b in zip(cut, [*cut[1:], len(text)])] == [m for t in texts for m in pattern.findall(t)]


def test_merges_are_those_of_the_library(library):
    rng, rank = random.Random(3), bpe.ranks(RANKS)
    merge = bpe.Merger(rank)
    pieces = ["".join(rng.choices("abcdeftheing é中!", k=rng.randint(1, 90))) for _ in range(1500)]
    pieces = list(dict.fromkeys(m for p in pieces for m in regex.findall(P.PATTERN, p))) + ["a" * 5000, "the" * 400]
    for p, ids in zip(pieces, merge(pieces)):
        assert ids == bpe.merge_pairs(p.encode(), rank) == library.encode_ordinary(p)


def test_cache_survives_equal_hashes_and_clearing(monkeypatch, library):
    text = "one two three four five one two"
    data = np.frombuffer(text.encode(), np.uint8)
    cut = pretokens.boundaries(text, np.array([0]))
    stops = np.append(cut[1:], len(text))
    cache = bpe.PieceCache(bpe.Merger(bpe.ranks(RANKS)), most=2)
    for _ in range(3):
        assert cache.encode(data, cut, stops, lambda i: text[cut[i]:stops[i]])[0].tolist() == library.encode_ordinary(text)
    monkeypatch.setattr(bpe.common, "run_hashes", lambda d, s, e: np.zeros(len(s), np.uint64))
    assert cache.encode(data, cut, stops, lambda i: text[cut[i]:stops[i]])[0].tolist() == library.encode_ordinary(text)


def test_round_trip_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op9_bpe_round_trip"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_encode_odd_rows(spark, library):
    texts = [None, "", "a" * 100_000 + " \x85 'll", "x", "x", "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, "ids") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    tokens = bpe.encode(df, RANKS)
    for r in tokens.collect():
        text = texts[r.doc_id] or ""
        assert r.ids == library.encode_ordinary(text) and len(r.offsets) == len(r.ids)
        assert all(0 <= o < len(text) for o in r.offsets) and r.offsets == sorted(r.offsets)
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(tokens, RANKS).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(df.limit(0), RANKS).collect() == []


def check_packing(rows, texts, size):
    tok = Tokenizer.from_file(JSON)
    by, bins = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    assert set(by) == set(texts)
    for key, pieces in by.items():
        ids = [*tok.encode(texts[key] or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(pieces, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == size)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and (len(pieces) == 1 or len(ids) > size)
    for pieces in bins.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return len(bins), -(-sum(r.length for r in rows) // size)


def test_packing_query_and_exchange(spark, monkeypatch):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    used, least = check_packing(queries.QUERIES["op7_pack_sequences"](spark, SF).collect(), texts, 2048)
    assert used <= least + 1
    monkeypatch.setattr(packing, "PIECES_A_TASK", 30)  # many partitions, which must exchange pieces
    used, least = check_packing(queries.QUERIES["op7_pack_sequences"](spark, SF).collect(), texts, 2048)
    assert used <= least + 4


def test_exchange_goes_on_while_it_saves(spark, monkeypatch):
    rng = random.Random(620)
    texts = {i: "a " * rng.randint(20, 40) for i in range(600)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    monkeypatch.setattr(packing, "PIECES_A_TASK", 6)
    saved, deal = [], packing._deal
    monkeypatch.setattr(packing, "_deal", lambda *a: saved.append(a) or deal(*a))
    out = packing.pack(df, JSON, 100)
    used, least = check_packing(out.collect(), texts, 100)
    assert len(saved) > 4  # the fifth round would save sequences too
    assert out.packing["sequences"] == used >= out.packing["bound"] >= least and out.packing["rounds"] == len(saved)


def test_bounds_never_exceed_packings():
    rng = random.Random(2)
    for _ in range(200):
        size = rng.choice([10, 40, 100])
        lengths = np.array([rng.randint(1, size) for _ in range(rng.randint(0, 60))], np.int64)
        bins, offsets, fill = packing.best_fit(lengths, size)
        assert packing.lower_bound(np.bincount(lengths, minlength=size + 1), size) <= len(fill)
        assert all(fill <= size) and fill.sum() == lengths.sum()
    # three items of just over half need three bins, though their sum fits two
    assert packing.lower_bound(np.bincount([6, 6, 6], minlength=11), 10) == 3


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "a <|endoftext|> b", "c"), (4, "word " * 40, "d")],
                               "doc_id long, text string, piece string")
    used, least = check_packing(packing.pack(df, JSON, 8).collect(), {1: None, 2: "", 3: "a <|endoftext|> b", 4: "word " * 40}, 8)
    assert used == least
    assert len(packing.pack(df.union(df), JSON, 8).where("doc_id < 3").collect()) == 4
    assert packing.pack(df.limit(0), JSON, 8).collect() == []
    ids = packing.pieces(df, JSON, 8, with_ids=True).where("doc_id = 4").orderBy("piece").collect()
    assert [i for r in ids for i in r.ids][:-1] == Tokenizer.from_file(JSON).encode("word " * 40).ids
