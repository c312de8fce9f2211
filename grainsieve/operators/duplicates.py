"""Near-duplicate images: hashes of the pixels, an exact Hamming join over covering masks, and partners by vectors.

Codes at most `distance` bits apart agree under one mask at least of a family that is made for that distance, so equal masked
codes find all close pairs; codes farther apart agree under none most often. A family with longer masks has more of them and
lets fewer far pairs through, and the number of codes decides which one is taken: candidates grow in step with the table,
not with its square. A code costs a row for each mask, though, and crowds of like codes meet under many of them: up to TILED
records, `partners` compares all codes in tiles, which cost less and emit no pairs.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as ty

from ..registry import Verdict, rule
from ..schema import strings
from ..sources.shared import written
from .scores import cosine

BITS = 64
#: Masks of a family, at most; far codes that a code may meet by chance, for each mask.
MASKS, FAR = 4096, 0.25
#: Records up to which all are compared, in tiles of two groups; rows of a group, from at least to at most; groups, at least, of
#: tables of so many rows; rows of a step of one group and of the other.
TILED, GROUP_LEAST, GROUP_MOST, GROUPS, STEP = 1 << 22, 1024, 32768, 16, (128, 4096)
#: Different vectors of one code beyond which they are compared in blocks, and the rows of a block.
CROWD, BLOCK = 64, 512


# --- hashes of pixels ----------------------------------------------------------------------

SIDE, LOW = 32, 8


@lru_cache(256)
def _shrink(n: int) -> np.ndarray:
    """Weights that average n points into SIDE cells; cells cut points in proportion."""
    edges = np.linspace(0, n, SIDE + 1)
    at = np.arange(n)
    part = np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at)
    return np.maximum(part, 0) * (SIDE / n)


_COSINES = np.cos(np.pi * (2 * np.arange(SIDE) + 1) * np.arange(LOW)[:, None] / (2 * SIDE))


def pixel_hash(pixels: bytes, width: int, height: int, channels: int) -> int:
    """64 bits: which of the lowest 8 x 8 frequencies of the grey image, shrunk to 32 x 32, reach their median, the mean
    brightness left out of it. Pixels lie row by row, as blue, green, red and alpha, or grey alone."""
    x = np.frombuffer(pixels, np.uint8).reshape(height, width, channels).astype(np.float64)
    grey = x[:, :, 0] if channels < 3 else x[:, :, :3] @ [0.114, 0.587, 0.299]
    small = _shrink(height) @ grey @ _shrink(width).T
    # whole numbers of a thousandth, so that rounding errors of flat images decide nothing
    low = np.round(_COSINES @ small @ _COSINES.T, 3).ravel()
    bits = np.packbits(low >= np.median(low[1:]))
    return int(bits.view(">i8")[0])


@F.arrow_udf(ty.LongType())
def image_code(images: pa.Array) -> pa.Array:
    """The hash of each image of Spark's image source; null for null images and those without pixels."""
    out = []
    for i in images.to_pylist():
        good = i is not None and i["data"] and i["width"] > 0 and i["height"] > 0
        out.append(pixel_hash(i["data"], i["width"], i["height"], i["nChannels"]) if good else None)
    return pa.array(out, pa.int64())


# --- the Hamming join ----------------------------------------------------------------------

def radii(distance: int, parts: int) -> list[int]:
    """Distances of the parts of a code, one of which holds if the code is within `distance`."""
    rest = distance - parts + 1
    return [rest // parts + (i < rest % parts) for i in range(parts)] if rest >= 0 else []


@lru_cache(64)
def family(distance: int, parts: int) -> list[int]:
    """Masks under one of which any two codes within `distance` agree.

    Every bit of a part gets a vector over two elements, one longer than the part's distance; each vector is used as often
    as any other. Each vector that is not nil makes a mask of the bits that are not orthogonal to it; the differing bits,
    fewer than its length, never span all, so one mask leaves them all out.
    """
    rng = random.Random(64)
    places = rng.sample(range(BITS), BITS)
    out = []
    for i, r in enumerate(radii(distance, parts)):
        vectors = rng.sample(range(1, 1 << (r + 1)), (1 << (r + 1)) - 1)
        own = {b: vectors[j % len(vectors)] for j, b in enumerate(places[i::parts])}
        out += [sum(1 << b for b, m in own.items() if (m & v).bit_count() & 1) for v in range(1, 1 << (r + 1))]
    return out


def masks_for(distance: int, n: int) -> list[int]:
    """The smallest family under which a code meets at most FAR far codes a mask by chance, among n random codes.

    Longer masks let fewer through, and there are more of them. Where even the largest family lets more through, as beyond
    some 50 million codes at distance 10, it is taken.
    """
    if not 0 <= distance < BITS:
        raise ValueError(f"distance must be between 0 and {BITS - 1}")
    masks = []
    for parts in range(distance + 1, 0, -1):
        if sum((1 << (r + 1)) - 1 for r in radii(distance, parts)) > MASKS:
            break
        masks = family(distance, parts)
        if n / 2 * sum(0.5 ** m.bit_count() for m in masks) <= FAR * len(masks):
            break
    return masks


def candidates(codes: DataFrame, distance: int) -> DataFrame:
    """(a, b), a < b: pairs of different codes of the column `code` that agree under a mask; a pair may come more than once.

    A mask's buckets are counted before any row meets another: only those of two codes or more are joined.
    """
    once = codes.where("code is not null").select("code").distinct()
    masks = masks_for(distance, once.count())
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keyed = once.select("code", F.posexplode(F.array(*map(F.lit, signed))).alias("mask", "bits")).select(
        "code", "mask", F.col("code").bitwiseAND(F.col("bits")).alias("bits"))
    met = keyed.groupBy("mask", "bits").agg(F.min("code").alias("low"), F.max("code").alias("high")).where("low < high")
    some = keyed.join(met.select("mask", "bits"), ["mask", "bits"])
    left = some.withColumnRenamed("code", "a")
    return left.join(some.withColumnRenamed("code", "b"), ["mask", "bits"]).where("a < b").select("a", "b")


def close_codes(codes: DataFrame, distance: int) -> DataFrame:
    """(a, b), a < b: all pairs of different codes at most `distance` bits apart, once each. Null codes are left out."""
    return candidates(codes, distance).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).distinct()


# --- partners ------------------------------------------------------------------------------

def _matched(met: DataFrame, likeness: float) -> DataFrame:
    """(rep, other): both ways, pairs of records whose codes are (a, b) and whose vectors are alike; crowds in blocks, which
    return for each record its lowest partner and their number only."""

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["side"].to_numpy() == 0
        x = np.array(pdf["vec"].tolist(), float)
        norm = np.sqrt((x * x).sum(1))
        unit = x / np.where(norm > 0, norm, 1)[:, None]
        a, b = pdf["rep"].to_numpy()[first], pdf["rep"].to_numpy()[~first]
        alike = (unit[first] @ unit[~first].T >= likeness) & (a[:, None] != b[None])
        alike &= ((norm[first] > 0)[:, None]) & (norm[~first] > 0)
        out = [(a[i], b[alike[i]].min(), int(alike[i].sum())) for i in np.flatnonzero(alike.any(1))]
        if key[0] != key[1]:
            out += [(b[j], a[alike[:, j]].min(), int(alike[:, j].sum())) for j in np.flatnonzero(alike.any(0))]
        return pd.DataFrame(out, columns=["rep", "partner", "partners"])

    kind = met.schema["rep"].dataType.simpleString()
    return met.groupBy("a", "b", "i", "j").applyInPandas(block, f"rep {kind}, partner {kind}, partners long")


def _exact(a: np.ndarray, b: np.ndarray, likeness: float) -> np.ndarray:
    """Whether rows are alike, with the sums in the order of `cosine`; as there, no number is above all numbers."""
    def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        s = np.zeros(len(x))
        for k in range(x.shape[1]):
            s = s + x[:, k] * y[:, k]
        return s

    with np.errstate(all="ignore"):
        under = np.sqrt(dot(a, a) * dot(b, b))
        c = dot(a, b) / under
    return (under != 0) & ((c >= likeness) | np.isnan(c))


def _tile(l: dict, r: dict, distance: int, likeness: float, same: bool):  # noqa: E741
    """(rows, lowest partner, partners) of `l` and of `r`, whose vectors are of one length; of `l` alone if they are the same."""
    units = []
    with np.errstate(all="ignore"):
        for x in (l["vec"], r["vec"]):
            norm = np.sqrt((x * x).sum(1))
            plain = (norm > 1e-70) & (norm < 1e70)
            units.append(np.where(plain, 1 / norm, np.nan)[:, None] * x)
    found = []
    for side in (l, r):
        found.append((np.full(len(side["no"]), np.iinfo(np.int64).max), np.zeros(len(side["no"]), np.int64)))
    for i in range(0, len(l["no"]), STEP[0]):
        for j in range(0, len(r["no"]), STEP[1]):
            rows, cols = slice(i, i + STEP[0]), slice(j, j + STEP[1])
            at, to = np.nonzero(np.bitwise_count(l["code"][rows, None] ^ r["code"][None, cols]) <= distance)
            at, to = at + i, to + j
            differ = l["no"][at] != r["no"][to]
            at, to = at[differ], to[differ]
            if not len(at):
                continue
            if len(at) * 16 > STEP[0] * STEP[1]:
                c = (units[0][rows] @ units[1][cols].T)[at - i, to - j]
            else:
                c = np.einsum("ij,ij->i", units[0][at], units[1][to])
            alike = c >= likeness
            unsure = np.flatnonzero(~(np.abs(c - likeness) > 1e-9))  # within rounding of the threshold, or no number
            alike[unsure] = _exact(l["vec"][at[unsure]], r["vec"][to[unsure]], likeness)
            at, to = at[alike], to[alike]
            for k, own, other in ((0, at, r["no"][to]),) if same else ((0, at, r["no"][to]), (1, to, l["no"][at])):
                np.minimum.at(found[k][0], own, other)
                found[k][1][:] += np.bincount(own, minlength=len(found[k][1]))
    return found


def _tiled(usable: DataFrame, n: int, longest: int, distance: int, likeness: float) -> DataFrame:
    """rep, partner, partners of the records that have any, by comparing each pair of groups of records in a task of its own.

    Records are dealt into groups by a hash. Codes are compared first, vectors of close codes only. A task returns the lowest
    partner and their number for each record, whatever the number of pairs. Keys are numbered in their order, so that tasks
    compare numbers; records of one key are no partners of each other and are counted together.
    """
    reps = written(usable.select("rep").distinct().orderBy("rep").withColumn("no", F.monotonically_increasing_id()), "imagekeys")
    most = max(GROUP_LEAST, GROUP_MOST * 64 // max(64, longest))  # long vectors fill a task with fewer rows
    groups = max(1, -(-n // most), min(GROUPS, n // GROUP_LEAST))
    dealt = usable.join(reps, "rep").select("no", "code", "vec", F.pmod(F.xxhash64("code", "vec"), F.lit(groups)).cast("int").alias("own"))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda other: F.struct(
        F.least("own", other).alias("i"), F.greatest("own", other).alias("j")))
    met = dealt.select("*", F.inline(pairs))

    def tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"no": [], "least": [], "partners": []}, dtype=np.int64)]
        first, second = key
        long = pdf["vec"].map(len).to_numpy()
        for size in np.unique(long[long > 0]):  # vectors of different lengths are not alike, nor are empty ones
            sides = []
            for own in {first: 0, second: 0}:
                p = pdf[(long == size) & (pdf["own"] == own).to_numpy()]
                sides.append({"no": p["no"].to_numpy(), "code": p["code"].to_numpy().astype(np.int64).view(np.uint64),
                              "vec": np.array(p["vec"].tolist(), float).reshape(len(p), size)})
            found = _tile(sides[0], sides[-1], distance, likeness, len(sides) == 1)
            for side, (low, many) in zip(sides, found):
                some = many > 0
                out.append(pd.DataFrame({"no": side["no"][some], "least": low[some], "partners": many[some]}))
        return pd.concat(out)

    # a partition for each tile or so: AQE would put small ones together, and it is their time that counts
    told = met.repartition(groups * (groups + 1) // 2, "i", "j").groupBy("i", "j").applyInPandas(tile, "no long, least long, partners long")
    least = written(told.groupBy("no").agg(F.min("least").alias("least"), F.sum("partners").alias("partners")), "imagepartners")
    named = least.join(reps.select(F.col("no").alias("least"), F.col("rep").alias("partner")), "least")
    return named.join(reps, "no").select("rep", "partner", "partners")


def _joined(usable: DataFrame, distance: int, likeness: float) -> DataFrame:
    """The same by a join of the codes under masks, for tables of more records than all can be compared of.

    Records of one code are compared by expressions while it has few different vectors, and in blocks of rows beyond, which
    emit no pairs.
    """
    sizes = usable.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    pairs = close_codes(usable, distance).unionByName(sizes.where("n > 1").select(F.col("code").alias("a"), F.col("code").alias("b")))
    pairs = written(pairs.join(sizes.select(F.col("code").alias("a"), F.col("n").alias("n_a")), "a").join(
        sizes.select(F.col("code").alias("b"), F.col("n").alias("n_b")), "b"), "closecodes")
    few = F.greatest("n_a", "n_b") <= CROWD
    left, right = usable.toDF("a", "vec_a", "rep"), usable.toDF("b", "vec_b", "other")
    alike = pairs.where(few).join(left, "a").join(right, "b").where(
        (F.col("rep") != F.col("other")) & ((F.col("a") != F.col("b")) | (F.col("rep") < F.col("other")))
        & (cosine(F.col("vec_a"), F.col("vec_b")) >= likeness)).select("rep", "other")
    both = alike.unionByName(alike.select(F.col("other").alias("rep"), F.col("rep").alias("other")))
    found = both.groupBy("rep").agg(F.min("other").alias("partner"), F.count(F.lit(1)).alias("partners"))
    if pairs.where(~few).head(1):
        found = found.unionByName(_crowds(pairs.where(~few), usable, likeness)).groupBy("rep").agg(
            F.min("partner").alias("partner"), F.sum("partners").alias("partners"))
    return found


def partners(df: DataFrame, key: str, code: str, vec: str, distance: int = 10, likeness: float = 0.97) -> DataFrame:
    """key, copies, partner, partners, rep for every record: how many records are identical to it (itself included), the lowest
    key of those that are close in code and alike in vector without being identical, how many different ones there are, and
    the lowest key of the identical ones. partner is null and partners 0 where there is none.

    Identical records are folded first. Up to TILED different ones are compared in tiles, more are joined by their codes. Null
    codes and vectors, and vectors that hold null, have no partners; identical ones are copies all the same. Keys must be
    comparable; other columns stay behind.
    """
    if not 0 <= distance < BITS:
        raise ValueError(f"distance must be between 0 and {BITS - 1}")
    df = df.select(F.col(key).alias("key"), F.col(code).alias("code"), F.col(vec).alias("vec"))
    once = written(df.groupBy("code", "vec").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies")), "images")
    usable = once.where("code is not null and vec is not null and rep is not null").where(~F.exists("vec", F.isnull)).select("code", "vec", "rep")
    n, longest = usable.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    found = _tiled(usable, n, longest, distance, likeness) if n <= TILED else _joined(usable, distance, likeness)
    told = once.join(found, "rep", "left").select(
        F.col("code").alias("c"), F.col("vec").alias("v"), "rep", "copies", "partner", F.coalesce("partners", F.lit(0)).alias("partners"))
    return df.join(told, df["code"].eqNullSafe(F.col("c")) & df["vec"].eqNullSafe(F.col("v"))).select(
        F.col("key").alias(key), "copies", "partner", "partners", "rep")


def _crowds(pairs: DataFrame, usable: DataFrame, likeness: float) -> DataFrame:
    """rep, partner, partners of the records of these pairs of codes, whose rows are dealt into blocks that meet two by two."""
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    crowds = pairs.withColumns({"of_a": blocks("n_a"), "of_b": blocks("n_b")})
    sides = []
    for side, own, other, of, of_other in ((0, "a", "i", "of_a", "of_b"), (1, "b", "j", "of_b", "of_a")):
        member = crowds.join(usable.withColumnRenamed("code", own), own)
        far = "j" if side == 0 else "i"
        sides.append(member.withColumn(other, F.pmod(F.xxhash64("rep"), F.col(of)).cast("int"))
                     .withColumn(far, F.explode(F.sequence(F.lit(0), F.col(of_other) - 1)))
                     .select("a", "b", "i", "j", F.lit(side).alias("side"), "rep", "vec"))
    return _matched(sides[0].unionByName(sides[1]), likeness)


def near_duplicates(df: DataFrame, key: str, code: str, vec: str, distance: int = 10, likeness: float = 0.97) -> DataFrame:
    """Records with a partner whose 64-bit hash differs in at most `distance` bits and whose vector is nearly parallel, and
    identical records; gives the key and the lowest key of the record's identical copies."""
    return partners(df, key, code, vec, distance, likeness).where("copies > 1 or partners > 0").select(key, "rep")


def duplicate_ratio(found: DataFrame, *by: str) -> DataFrame:
    """images, duplicates and duplicate_ratio of a table of `partners`, by the columns `by`; no images give no ratio."""
    return found.groupBy(*by).agg(F.count(F.lit(1)).alias("images"), F.count_if(F.expr("copies > 1 or partners > 0")).alias("duplicates")
                                  ).withColumn("duplicate_ratio", F.try_divide("duplicates", "images"))


@rule("RuleImageRepeat", "QUALITY_BAD_IMG_SIMILARITY", (), required=("copies", "partner", "partners"))
def image_repeat(f, cfg):
    """Of a table with the columns that `partners` gives."""
    copies, many = f.field("copies"), f.field("partners")
    reason = F.concat_ws("; ", F.when(copies > 1, F.concat(F.lit("identical images: "), (copies - 1).cast("string"))), F.when(
        many > 0, F.concat(F.lit("similar images: "), many.cast("string"), F.lit(", first "), f.field("partner").cast("string"))))
    return Verdict((copies > 1) | (many > 0), strings(reason), measure=(copies - 1 + many).cast("double"))
