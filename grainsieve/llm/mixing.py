"""Mixing sources to target weights by hash thresholds: no row is sorted, and no source is gathered anywhere.

Every row has a hash. A source whose target is k times its words and some more is taken k times, and once more where the
hash lies under the source's threshold; thresholds of a smaller budget lie lower, so smaller mixtures are nested in larger
ones. Thresholds come from histograms: words summed by source and hash bucket show the bucket in which the budget ends,
and only the rows of that boundary bucket are split into finer buckets, until it holds one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words of a text.
WORDS = r"[^\x20\x09-\x0D]+"
#: Bits of a hash, and of a bucket: a histogram has 2 ** BITS buckets a source.
HASH_BITS, BITS = 60, 12
#: Sources that are ranked in one task.
RANKED = 100_000

#: Columns and shifts of the digits that buckets are made of: first of the hash, then of the row number that parts equal rows.
_DIGITS = [("h", s) for s in range(HASH_BITS - BITS, -1, -BITS)] + [("t", s) for s in range(63 - BITS, 0, -BITS)] + [("t", 0)]


def _digit(level: int):
    column, shift = _DIGITS[level]
    return F.shiftright(column, shift).bitwiseAND((1 << BITS) - 1).cast("int")


def _hash(key: str, text: str, seed: int):
    """HASH_BITS of the MD5 of seed, key and text."""
    of = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(of.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _named(source: str):
    """A key of the source that is never null."""
    return F.coalesce(F.concat(F.lit("+"), F.col(source).cast("string")), F.lit("-"))


def targets(scratch: common.Scratch, sizes: DataFrame, weights: tuple[int, ...], share: int, most: int) -> DataFrame:
    """`sizes` (s, source, source_size) with `target`: what each source shall give.

    Sources in the order of code points, null last, weigh `weights`, repeating, and share `share` percent of all sizes;
    none gets more than `most` times its own, and what is over is shared anew by weight. Ranks are counted by ranges of
    the sources; each round of sharing is one aggregate.
    """
    order = F.col("source").asc_nulls_last()
    n = sizes.count()
    ranged = scratch.save(sizes.repartitionByRange(max(1, -(-n // RANKED)), order).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # one row a range
    before, starts = 0, []
    for r in counts:
        starts.append((r.part, before))
        before += r.n
    starts = scratch.spark.createDataFrame(starts, "part int, before long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights)).cast("int") + 1)
    weighed = scratch.save(ranged.join(F.broadcast(starts), "part").select(
        "s", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("limit")))
    total, all_weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    # all sources at their limits give most * 100 / share times the budget, so either all are there or some weight is left
    budget = (total or 0) * share / 100
    level, full = budget / all_weights if all_weights else 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > F.col("limit")
        r = weighed.agg(F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, F.col("limit"))).alias("used"),
                        F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if r.n == full or not r.weight:
            break
        full, level = r.n, (budget - (r.used or 0)) / r.weight
    wish = F.lit(level) * F.col("weight")
    return scratch.save(weighed.select(
        "s", "source_size", F.when(wish > F.col("limit"), F.col("limit").cast("double")).otherwise(wish).alias("target")))


def thresholds(scratch: common.Scratch, rows: DataFrame, sources: DataFrame) -> DataFrame:
    """`sources` (s, source_size, target) with `times`, how often every row is taken, and the place (cut_h, cut_t) of the
    row at which the one more ends, with `closed`: whether it is taken too, as that comes nearer to the target. No place
    where nothing more is to be taken.

    rows: s, size, h (hash) and t (row number).
    """
    times = F.floor(F.col("target") / F.col("source_size"))
    planned = sources.withColumn("times", F.when(F.col("source_size") > 0, times).otherwise(0)).withColumn(
        "rest", F.greatest(F.col("target") - F.col("times") * F.col("source_size"), F.lit(0.0)))
    planned = scratch.save(planned)
    open_, ends = rows.where("size > 0"), None
    for level in range(len(_DIGITS)):
        bucket = open_.withColumn("bucket", _digit(level))
        sums = bucket.groupBy("s", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        if level == 0:
            sums = sums.join(planned.where("rest > 0").select("s", "rest"), "s")
        else:
            sums = sums.join(left, "s")  # noqa: F821  of the level before
        upto = F.sum("words").over(Window.partitionBy("s").orderBy("bucket"))  # at most 2 ** BITS rows a source
        edge = scratch.save(sums.withColumn("upto", upto).where(
            (F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest"))).select(
            "s", "bucket", "n", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest")))
        inside = scratch.save(common.attached(bucket, edge, ["s", "bucket"], "t").drop("bucket"))
        done = inside.where("n = 1").select("s", F.col("h").alias("cut_h"), F.col("t").alias("cut_t"),
                                            (2 * F.col("rest") >= F.col("size")).alias("closed"))
        ends = done if ends is None else ends.unionByName(done)
        open_, left = inside.where("n > 1").drop("n", "rest"), edge.select("s", "rest")
        if not inside.where("n > 1").head(1):
            break
    return scratch.save(planned.join(ends, "s", "left").drop("rest"))


def _rows(docs: DataFrame, key: str, source: str, text: str, seed: int) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), _named(source).alias("s"),
                       F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
                       _hash(key, text, seed).alias("h")).withColumn("t", F.monotonically_increasing_id())


def _copies():
    """How often a row joined with the thresholds is taken."""
    at = (F.col("h") == F.col("cut_h")) & (F.col("t") == F.col("cut_t"))
    below = (F.col("h") < F.col("cut_h")) | ((F.col("h") == F.col("cut_h")) & (F.col("t") < F.col("cut_t")))
    return F.col("times") + F.coalesce(below | (F.col("closed") & at), F.lit(False)).cast("long")


def plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: int = 100, most: int = 3, key: str = "doc_id",
         source: str = "source", text: str = "text", seed: int = 0) -> DataFrame:
    """key, size, source_size, target, copies: for every row its words, those of its source, what the source shall give,
    and how often the mixture takes the row: 0 to `most` times.

    A source gives its target up to half of the row at which it ends. The hash is of seed, key and text, so a rerun
    takes the same rows, however the table is dealt; of rows alike in key, text and source it takes the same number. Null
    sources are one source; null texts and texts without words have size 0 and count for nothing; null keys are rows like
    others; an empty table gives none. Other columns stay behind.
    """
    scratch = common.Scratch(docs.sparkSession, "mixing")
    # the text is read once; row numbers are fixed by writing them
    rows = scratch.save(_rows(docs, key, source, text, seed))
    sources = targets(scratch, scratch.save(rows.groupBy("s", "source").agg(F.sum("size").alias("source_size"))), weights, share, most)
    cuts = thresholds(scratch, rows.select("s", "size", "h", "t"), sources)
    return common.attached(rows, cuts, ["s"], "t").select(
        F.col("key").alias(key), "size", "source_size", "target", _copies().alias("copies"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: int = 100, most: int = 3, key: str = "doc_id",
            source: str = "source", text: str = "text", seed: int = 0) -> DataFrame:
    """The rows of the table, with their columns, each as often as `plan` takes it.

    The texts are filtered by their hashes where they lie. Only rows whose hash is the threshold itself are joined: of rows
    alike in key, text and source that a threshold parts, the one whose columns have the smallest hash stands for all.
    """
    scratch = common.Scratch(docs.sparkSession, "mixture")
    rows = scratch.save(_rows(docs, key, source, text, seed))
    sources = targets(scratch, scratch.save(rows.groupBy("s", "source").agg(F.sum("size").alias("source_size"))), weights, share, most)
    cuts = thresholds(scratch, rows.select("s", "size", "h", "t"), sources)
    at_end = scratch.save(common.attached(rows, cuts, ["s"], "t").where("h = cut_h").groupBy("s").agg(F.sum(_copies()).alias("many")))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _named(source).alias("s"),
                      _hash(key, text, seed).alias("h"))
    marked = common.attached(own, cuts, ["s"], "h").withColumn("copies", F.col("times") + F.coalesce(
        F.col("h") < F.col("cut_h"), F.lit(False)).cast("long")).withColumn("end", F.coalesce(F.col("h") == F.col("cut_h"), F.lit(False)))
    inner = marked.where("not end and copies > 0").select("row", "copies")
    ending = marked.where("end").groupBy("s").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).join(at_end, "s").where(
        "many > 0").select("row", F.col("many").alias("copies"))
    return inner.unionByName(ending).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken, the words of each row times its copies, by way of plan."""
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
