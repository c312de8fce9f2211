"""Claims that say nearly the same: a containment join by rare pieces, then the choice of the first ones in rounds.

Of two claims of an article the later one goes if one holds the other and their lengths differ by less than a fifth, unless
the earlier one has gone itself. Nothing gathers an article: what meets are claims that share a piece of text. Pieces meet
without texts first, and only claims of which some pair may fit bring their texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as ty

from ..functions import text as T
from ..sources.shared import written

#: Letters of a piece: of short claims, and of those whose inner part has LONG letters or more.
SHORT_PIECE, PIECE, LONG = 4, 12, 24
#: Letters of claims of one length looked at together.
LETTERS = 1 << 18
#: Two claims are alike if their lengths differ by less than this share of the longer one.
SLACK = 0.2
#: Bits that a place in a claim has beside its piece, and those of a claim's length and of what follows in a sign.
PLACE, LENGTH, AFTER = 16, 22, 8


def _piece_hashes(points: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of `size` letters of each row, by doubling; equal runs have equal ones."""

    def both(first, then):
        h = (first * np.uint64(0x9E3779B97F4A7C15) + then) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    n, step, out = max(0, points.shape[1] - size + 1), 1, points
    if not n:
        return np.zeros((len(points), 0), np.uint64)
    while 2 * step <= size:
        out = both(out[:, :-step], out[:, step:])
        step *= 2
    return both(out[:, :n], out[:, size - step:size - step + n]) ^ np.uint64(size)


def _lowest(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` numbers in a row, by doubling."""
    n, step, out = h.shape[1] - width + 1, 1, h
    while 2 * step <= width:
        out = np.minimum(out[:, :-step], out[:, step:])
        step *= 2
    return np.minimum(out[:, :n], out[:, width - step:width - step + n])


def inner(n: int) -> tuple[int, int]:
    """Where the part of a text of n letters lies that every alike text held by it has: at most so many letters go missing
    at either end."""
    gone = max(0, int(np.ceil(SLACK * n)) - 1)
    return gone, n - gone


def _row_pieces(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The piece by which each claim asks for those that it holds, and those by which it is found by the ones that hold it, in order
    and with repeats, each with its place in the last PLACE bits. A row holds the letters of a claim; all are of one length.

    The first is the least piece of the inner part. A claim that lies in a longer one holds that inner part, which is no
    shorter than three fifths of it, so the least piece of it is the least of some window of that length. Of equal pieces the
    first is the least, in the inner part as in the window. A claim is found by the piece it asks by, too.
    """
    n = points.shape[1]
    start, stop = inner(n)
    size = PIECE if stop - start >= LONG else SHORT_PIECE
    hashes = {k: _piece_hashes(points, k) for k in (SHORT_PIECE, PIECE) if k == size or n < 2 * LONG}
    for h in hashes.values():
        h &= ~np.uint64((1 << PLACE) - 1)
        h |= np.minimum(np.arange(h.shape[1]), (1 << PLACE) - 1).astype(np.uint64)
    ask = hashes[size][:, start:max(start, stop - size + 1)].min(axis=1, initial=np.uint64(0) if stop - start < size else ~np.uint64(0))
    least = max(SHORT_PIECE, int(np.ceil(3 * n / 5)))  # letters of the inner part of a claim that holds this one, at least
    longest = int(n / (1 - SLACK)) + 2  # letters of such a claim, at most
    found = [np.zeros((len(points), 0), np.uint64)]
    if least < LONG and n >= SHORT_PIECE:
        found.append(_lowest(hashes[SHORT_PIECE], min(least, n) - SHORT_PIECE + 1))
    if longest >= LONG and n >= PIECE:
        width = max(least, LONG)
        if width <= n:
            found.append(_lowest(hashes[PIECE], width - PIECE + 1))
    return ask, np.sort(np.concatenate(found, axis=1), axis=1)


def _signs(points: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Of each piece of a row one number: the length of the claim, the first and the last place of the piece, what follows its
    first letters (0: not known, 1: the end is near), and whether the claim asks by it. In texts too long for PLACE bits it
    may be anywhere."""
    n = points.shape[1]
    if n >= 1 << PLACE:
        first, last, after = np.zeros_like(first), np.full_like(last, (1 << PLACE) - 1), np.zeros_like(first)
    else:
        at = first.astype(np.int64)[:, None] + np.arange(SHORT_PIECE, 2 * SHORT_PIECE)
        mixed = points[rows[:, None], np.minimum(at, n - 1)] @ (np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, 1 + SHORT_PIECE, dtype=np.uint64))
        after = np.where(at[:, -1] < n, 2 + (mixed >> np.uint64(32)) % np.uint64((1 << AFTER) - 2), np.uint64(1))
        after[first != last] = 0
    out = asked.astype(np.uint64)
    for value, bits in ((after, AFTER), (last, PLACE), (first, PLACE), (np.uint64(min(n, (1 << LENGTH) - 1)), LENGTH)):
        out = out << np.uint64(bits) | value
    return out


def may_hold(whole: Column, part: Column) -> Column:
    """Whether the claim that asks by a piece may hold the one found by it, told from the signs of both."""
    def fields(sign):
        at = 0
        for bits in (LENGTH, PLACE, PLACE, AFTER, 1):
            yield F.shiftright(sign, at).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
            at += bits

    size, first, last, after, asks = fields(whole)
    n, part_first, part_last, part_after, _ = fields(part)
    gap = size - n
    return ((asks == 1) & ((size == (1 << LENGTH) - 1) | (gap > 0) & (gap < F.lit(SLACK) * size)) & (part_first <= last)
            & (n - part_last <= size - first) & ((part_after < 2) | (after == 0) | (after == part_after)))


def signed_pieces_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the piece it asks by, how many it is found by, and the latter and their signs one after another. Texts of
    one length go together, up to LETTERS letters at a time."""
    texts = [t or "" for t in texts]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(lengths) - lengths
    ask, many = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64)
    rows, values, signs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    order, place = np.argsort(lengths, kind="stable"), np.uint64((1 << PLACE) - 1)
    for same in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
        n = int(lengths[same[0]])
        for at in range(0, len(same), step := max(1, LETTERS // max(n, 1))):
            part = same[at:at + step]
            points = letters[starts[part][:, None] + np.arange(n)].astype(np.uint64)
            asked, found = _row_pieces(points)
            ask[part] = asked >> np.uint64(PLACE)
            new, old = np.ones(found.shape, bool), np.ones(found.shape, bool)  # where a run of one piece begins and ends
            new[:, 1:] = old[:, :-1] = found[:, 1:] >> np.uint64(PLACE) != found[:, :-1] >> np.uint64(PLACE)
            many[part] = new.sum(axis=1)
            of = np.repeat(np.arange(len(part)), many[part])
            first = found[new]
            rows.append(part[of])
            values.append(first >> np.uint64(PLACE))
            if len(first):
                signs.append(_signs(points, of, first & place, found[old] & place, values[-1] == ask[part][of]))
    # groups are in order of length: back to the order of the texts, those of a text staying as they are
    back = np.argsort(np.concatenate(rows), kind="stable")
    return ask, many, np.concatenate(values)[back], np.concatenate(signs)[back]


def pieces_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the piece it asks by, how many it is found by, and the latter one after another."""
    return signed_pieces_of(texts)[:3]


def pieces(text: str) -> tuple[int, list[int]]:
    """The piece by which a claim asks, and those by which it is found."""
    ask, _, found = pieces_of([text])
    return int(ask.view(np.int64)[0]), found.view(np.int64).tolist()


def _lists(many: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), values)


@F.arrow_udf(ty.StructType([ty.StructField("ask", ty.LongType()), ty.StructField("found", ty.ArrayType(ty.LongType(), False))]))
def claim_pieces(texts: pa.Array) -> pa.Array:
    ask, many, found = pieces_of(pc.cast(texts, pa.large_string()).to_pylist())
    return pa.StructArray.from_arrays([pa.array(ask.view(np.int64)), _lists(many, pa.array(found.view(np.int64)))], names=["ask", "found"])


@F.arrow_udf(ty.ArrayType(ty.StructType([ty.StructField("piece", ty.LongType()), ty.StructField("sign", ty.LongType())]), False))
def claim_signs(texts: pa.Array) -> pa.Array:
    _, many, found, signs = signed_pieces_of(pc.cast(texts, pa.large_string()).to_pylist())
    return _lists(many, pa.StructArray.from_arrays([pa.array(found.view(np.int64)), pa.array(signs.view(np.int64))], names=["piece", "sign"]))


def that_may_meet(once: DataFrame) -> DataFrame:
    """id: the claims of which some pair of an article may be alike. Rows are a piece, a claim and a sign, no texts."""
    signs = once.select("art", "id", F.inline(claim_signs("low"))).select(F.xxhash64("art", "piece").alias("piece"), "id", "sign")
    one, two = signs.alias("one"), signs.alias("two")
    a, b = F.col("one.sign"), F.col("two.sign")
    same = (F.col("one.piece") == F.col("two.piece")) & (F.col("one.id") != F.col("two.id"))  # with both ids, both sides are shuffled once
    met = one.join(two, same & (may_hold(a, b) | may_hold(b, a)), "left_semi")
    return written(met.select("id").distinct(), "claimsmet", tidy=True)


def alike_claims(once: DataFrame) -> DataFrame:
    """(art, id, other): the ids of claims of one article of which one holds the other, lengths less than a fifth apart; the
    earlier first. once: art, pos, id, low; texts of an article are different, and so are all ids."""
    near = once.join(that_may_meet(once), "id", "left_semi").select(F.struct("art").alias("art"), "pos", "id", "low")
    keyed = written(near.select("*", F.length("low").alias("n"), claim_pieces("low").alias("p")).select(
        "art", "pos", "id", "low", "n", "p.ask", "p.found"), "claimsnear", tidy=True)
    long_ = keyed.select("art", F.col("ask").alias("piece"), F.struct("pos", "low", "id").alias("one"), F.col("n").alias("size"))
    short = keyed.select("art", F.explode("found").alias("piece"), F.struct("pos", "low", "id").alias("two"), "n")
    gap = F.col("size") - F.col("n")
    near = long_.join(short.hint("merge"), ["art", "piece"]).where((gap > 0) & (gap < F.lit(SLACK) * F.col("size")) & F.contains("one.low", "two.low"))
    return near.select("art", F.least("one", "two")["id"].alias("id"), F.greatest("one", "two")["id"].alias("other")).distinct()


def first_of_alike(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(art, id): what goes when claims are taken in order and each drops the later ones linked to it.

    In each round a claim without an earlier undecided one stays, those linked to it go, and the links of both are done;
    this gives just what taking them one by one gives. Rounds are as many as claims hang on each other in a row.
    """
    gone = None
    edges = written(edges, "claimlinks", tidy=True)
    for done in range(rounds + 1):
        if not edges.head(1):
            break
        if done == rounds:
            raise RuntimeError(f"claims are still undecided after {rounds} rounds")
        later = edges.select("art", F.col("other").alias("id")).distinct()
        stay = edges.select("art", "id").distinct().join(later, ["art", "id"], "left_anti")
        drop = written(edges.join(stay, ["art", "id"], "left_semi").select("art", F.col("other").alias("id")).distinct(), "claimsgone", tidy=True)
        gone = drop if gone is None else gone.unionByName(drop)
        # links of what went decide nothing more, nor do those of what stays: all of them led to what went
        left = edges.join(drop, ["art", "id"], "left_anti").join(drop.withColumnRenamed("id", "other"), ["art", "other"], "left_anti")
        edges = written(left.select("art", "id", "other"), "claimlinks", tidy=True)
    return gone if gone is not None else edges.select("art", "id")


def distinct_claims(claims: DataFrame, key: str, order: str, claim: str) -> DataFrame:
    """key, pos, claim: the claims of each article that no earlier claim kept says already, in nearly the same words.

    Claims are compared in lower case without white space around; empty and null ones go; of equal ones the first stays, of
    equal places the one that is lower in order. Null keys are one article. An article of any number of claims is spread
    over the cluster; other columns stay behind.
    """
    low = F.lower(T.strip(T.as_text(F.col("claim"))))
    once = (claims.select(F.col(key).alias("art"), F.col(order).alias("pos"), F.col(claim).alias("claim")).withColumn("low", low)
            .where("low <> ''").groupBy("art", "low").agg(F.min(F.struct("pos", "claim")).alias("first"))
            .select("art", "first.pos", "first.claim", F.monotonically_increasing_id().alias("id")))
    once = written(once, "claims", tidy=True)
    gone = first_of_alike(alike_claims(once.withColumn("low", low)))
    return once.join(gone.select("id"), "id", "left_anti").select(F.col("art").alias(key), "pos", "claim")
