"""Overlaps of label boxes, counted without a row for any pair.

Images of up to IMAGE boxes are dealt whole, in order of their left borders, and swept a batch of images at a time. In larger ones equal boxes are folded into one with a number. The different ones meet in cells of a grid, as in `scores.box_overlaps`;
cells with few of them are joined, crowded cells are dealt into blocks that meet two by two, each pair of blocks in a task of
its own, which sweeps over the left borders and returns a count for each box.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..registry import Verdict, rule
from ..schema import strings
from ..sources.shared import written

PARTIAL, FULL = 0.1, 0.9
#: Meetings in a cell beyond which it is dealt into blocks; different boxes of a block; boxes swept over at a time.
MEETINGS, BLOCK, SLICE = 1 << 16, 2048, 128
#: Boxes of an image that is swept whole.
IMAGE = 1 << 13
SIDES = ("x", "y", "width", "height")
CELL = ("grid", "cx", "cy")


def _iou(l: dict, r: dict, low, high) -> tuple:  # noqa: E741
    """Left and top border of the common part, and its share in the union, of columns or of arrays alike."""
    left, top = high(l["x"], r["x"]), high(l["y"], r["y"])
    wide = low(l["x"] + l["width"], r["x"] + r["width"]) - left
    tall = low(l["y"] + l["height"], r["y"] + r["height"]) - top
    shared = high(wide, 0.0 * wide) * high(tall, 0.0 * tall)
    return left, top, shared / (l["width"] * l["height"] + r["width"] * r["height"] - shared)


def _cells(rects: DataFrame, image: str, cell: float) -> DataFrame:
    """A row for each cell of a box's own grid and of the next four coarser ones that it touches."""
    longer = F.greatest("width", "height")
    own = F.greatest(F.lit(0), F.ceil(F.log2(longer / cell))).cast("int")
    rows = rects.withColumn("own", own).withColumn("grid", F.explode(F.sequence(F.col("own"), F.col("own") + 4)))
    step = F.lit(cell) * F.pow(F.lit(2.0), F.col("grid"))
    for name, low, size in (("cx", "x", "width"), ("cy", "y", "height")):
        rows = rows.withColumn(name, F.explode(F.sequence(F.floor(F.col(low) / step), F.floor((F.col(low) + F.col(size)) / step))))
    return rows.select(image, *SIDES, "n", "own", *CELL)


def _few(members: DataFrame, image: str, cell: float) -> DataFrame:
    """Counts of the pairs of cells with few boxes, by a join."""
    key = [image, *CELL]
    l = members.where("own = grid").select(*key, "own", "n", F.struct(*SIDES).alias("l"))  # noqa: E741
    r = members.select(*key, F.col("own").alias("own_r"), F.col("n").alias("n_r"), F.struct(*SIDES).alias("r"))
    met = l.join(r, key).where((F.col("own_r") < F.col("own")) | (F.col("l") < F.col("r")))
    part = lambda side: {s: F.col(f"{side}.{s}") for s in SIDES}
    left, top, iou = _iou(part("l"), part("r"), F.least, F.greatest)
    step = F.lit(cell) * F.pow(F.lit(2.0), F.col("grid"))
    here = (F.floor(left / step) == F.col("cx")) & (F.floor(top / step) == F.col("cy"))
    pairs = met.withColumn("iou", iou).where(here & (F.col("iou") >= PARTIAL))
    both = pairs.select(image, "iou", F.inline(F.array(F.struct(F.col("l").alias("b"), F.col("n_r").alias("others")),
                                                       F.struct(F.col("r").alias("b"), F.col("n").alias("others")))))
    full = F.col("iou") >= FULL
    return both.select(image, "b.*", F.when(full, F.col("others")).otherwise(0).alias("full"),
                       F.when(full, 0).otherwise(F.col("others")).alias("partial"))


def _sweep(l: pd.DataFrame, r: pd.DataFrame, cx: int, cy: int, step: float) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """(full, partial) of each box of `l` and of `r`; both are in order of their left borders.

    A slice of `l` meets only those of `r` whose left borders lie between its own borders, give or take the widest box.
    """
    a = {s: l[s].to_numpy() for s in SIDES}
    b = {s: r[s].to_numpy() for s in SIDES}
    of_l, of_r = np.zeros((2, len(l)), np.int64), np.zeros((2, len(r)), np.int64)
    n_l, n_r, own_r = l["n"].to_numpy(), r["n"].to_numpy(), r["own"].to_numpy()
    level = l["own"].to_numpy()[0]
    widest = b["width"].max()
    for at in range(0, len(l), SLICE):
        part = slice(at, at + SLICE)
        p = {s: v[part, None] for s, v in a.items()}
        # one step of rounding on either side, as sums of borders are rounded
        first = np.searchsorted(b["x"], np.nextafter(p["x"].min() - widest, -np.inf))
        last = np.searchsorted(b["x"], (p["x"] + p["width"]).max(), "right")
        near = slice(first, last)
        q = {s: v[None, near] for s, v in b.items()}
        left, top, iou = _iou(p, q, np.minimum, np.maximum)
        # equal boxes are folded, so one side differs first
        before = np.zeros(iou.shape, bool)
        same = np.ones(iou.shape, bool)
        for s in SIDES:
            before |= same & (p[s] < q[s])
            same &= p[s] == q[s]
        mine = ((own_r[None, near] < level) | before) & (np.floor(left / step) == cx) & (np.floor(top / step) == cy)
        for k, hit in enumerate((mine & (iou >= FULL), mine & (iou >= PARTIAL) & (iou < FULL))):
            of_l[k, part] += hit @ n_r[near]
            of_r[k, near] += n_l[part] @ hit
    return of_l, of_r


def _crowds(members: DataFrame, image: str, cell: float) -> DataFrame:
    """Counts of the pairs of crowded cells, by blocks of their boxes: the ones of the cell's own grid against all."""
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    place = lambda n: F.pmod(F.xxhash64(*SIDES), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    keep = [image, *CELL, *SIDES, "n", "own"]
    l = members.where("own = grid").withColumn("i", place("n_own")).withColumn("j", every("n_all"))  # noqa: E741
    r = members.withColumn("j", place("n_all")).withColumn("i", every("n_own"))
    rows = l.select(*keep, "i", "j", F.lit(0).alias("side")).unionByName(r.select(*keep, "i", "j", F.lit(1).alias("side")))

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["side"] == 0
        l, r = (pdf[w].sort_values("x", kind="stable") for w in (first, ~first))  # noqa: E741
        out = pd.concat([l, r])[[image, *SIDES]]
        counts = np.zeros((2, len(out)), np.int64)
        if len(l) and len(r):
            _, grid, cx, cy, _, _ = key
            counts = np.concatenate(_sweep(l, r, cx, cy, cell * 2.0 ** grid), axis=1)
        out["full"], out["partial"] = counts
        return out[(counts > 0).any(0)]

    kinds = ", ".join(f"`{c}` {members.schema[c].dataType.simpleString()}" for c in (image, *SIDES))
    return rows.groupBy(image, *CELL, "i", "j").applyInPandas(block, f"{kinds}, full long, partial long")


def _swept(images: np.ndarray, b: dict) -> tuple[np.ndarray, np.ndarray]:
    """(full, partial) of each box; boxes are in order of images, and in those of their left borders.

    Each box meets the next one of its image, then the one after that, as long as they begin before its right border.
    """
    full, partial = np.zeros((2, len(images)), np.int64)
    right = b["x"] + b["width"]
    at, step = np.arange(len(images)), 1
    while len(at):
        at = at[:np.searchsorted(at, len(images) - step)]
        at = at[(images[at] == images[at + step]) & (b["x"][at + step] < right[at])]
        _, _, iou = _iou({s: v[at] for s, v in b.items()}, {s: v[at + step] for s, v in b.items()}, np.minimum, np.maximum)
        for counts, hit in ((full, iou >= FULL), (partial, (iou >= PARTIAL) & (iou < FULL))):
            # a box is met at most once a step on either side
            counts[at[hit]] += 1
            counts[at[hit] + step] += 1
        step += 1
    return full, partial


def _small(boxes: DataFrame) -> DataFrame:
    """Counts of the boxes of images that are swept whole; an image is never parted between batches."""
    rows = boxes.withColumn("of", F.xxhash64("image")).repartition("of").sortWithinPartitions("of", "image", "x")
    kinds = ", ".join(f"`{c}` {boxes.schema[c].dataType.simpleString()}" for c in ("image", "box"))

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        full, partial = _swept(batch["of"].to_numpy(), {s: batch[s].to_numpy() for s in SIDES})
        return pa.RecordBatch.from_arrays([batch["image"], batch["box"], pa.array(full), pa.array(partial)], ["image", "box", "full", "partial"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            of = batch["of"].to_numpy()
            if not len(of):
                continue
            if held and of[0] == of[-1] == held[-1]["of"][-1].as_py():
                held.append(batch)
                continue
            # the last image may go on in the next batch
            cut = int(np.searchsorted(of, of[-1]))
            held.append(batch.slice(0, cut))
            yield from map(counted, pa.Table.from_batches(held).combine_chunks().to_batches())
            held = [batch.slice(cut)]
        if held:
            yield from map(counted, pa.Table.from_batches(held).combine_chunks().to_batches())

    return rows.mapInArrow(run, f"{kinds}, full long, partial long")


def _large(boxes: DataFrame, cell: float) -> DataFrame:
    """Counts of the boxes of images of any size, by a grid."""
    rects = written(boxes.groupBy("image", *SIDES).agg(F.count(F.lit(1)).alias("n")), "rects")
    cells = written(_cells(rects, "image", cell), "cells")
    sizes = cells.groupBy("image", *CELL).agg(F.count_if(F.expr("own = grid")).alias("n_own"), F.count(F.lit(1)).alias("n_all"))
    met = cells.join(sizes.where("n_own > 0 and n_all > 1"), ["image", *CELL])
    crowded = F.col("n_own") * F.col("n_all") > MEETINGS
    counts = _few(met.where(~crowded), "image", cell)
    if sizes.where(crowded).head(1):
        counts = counts.unionByName(_crowds(met.where(crowded), "image", cell))
    sides = {s: F.col(s) for s in SIDES}
    _, _, alone = _iou(sides, sides, F.least, F.greatest)
    copies = rects.where("n > 1").withColumn("alone", alone).select(
        "image", *SIDES, F.when(F.col("alone") >= FULL, F.col("n") - 1).otherwise(0).alias("full"),
        F.when((F.col("alone") < FULL) & (F.col("alone") >= PARTIAL), F.col("n") - 1).otherwise(0).alias("partial"))
    total = counts.unionByName(copies).groupBy("image", *SIDES).agg(F.sum("full").alias("full"), F.sum("partial").alias("partial"))
    none = F.lit(0).cast("long")
    return boxes.join(total, ["image", *SIDES], "left").select(
        "image", "box", F.coalesce("full", none).alias("full"), F.coalesce("partial", none).alias("partial"))


def overlap_counts(boxes: DataFrame, image: str, box: str, cell: float = 256.0) -> DataFrame:
    """image, box, full, partial for every row: how many other boxes of its image share 0.9 of the union and more with it, and how
    many from 0.1 to 0.9.

    Rows of a false column `valid`, of no image, with a null or infinite side or without an area overlap nothing; their counts
    are 0. Rows are boxes of their own even where keys or sides repeat. Other columns stay behind. An empty table gives none.
    """
    ok = F.coalesce(F.col("valid"), F.lit(True)) if "valid" in boxes.columns else F.lit(True)
    b = boxes.select(F.col(image).alias("image"), F.col(box).alias("box"), *(F.col(s).cast("double").alias(s) for s in SIDES), ok.alias("ok"))
    finite = lambda s: F.abs(F.col(s)) < float("inf")
    fit = F.col("ok") & F.col("image").isNotNull() & finite("x") & finite("y") & finite("width") & finite("height")
    b = written(b.select("image", "box", *SIDES, F.coalesce(fit & (F.col("width") > 0) & (F.col("height") > 0), F.lit(False)).alias("fit")), "boxes")
    none = F.lit(0).cast("long")
    rest = b.where("not fit").select("image", "box", none.alias("full"), none.alias("partial"))
    fitting = b.where("fit").drop("fit")
    crowded = written(fitting.groupBy("image").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > IMAGE).select("image"), "crowded")
    if crowded.head(1):
        told = _small(fitting.join(crowded, "image", "left_anti")).unionByName(_large(fitting.join(crowded, "image", "left_semi"), cell))
    else:
        told = _small(fitting)
    return told.unionByName(rest).toDF(image, box, "full", "partial")


def attribute() -> Column:
    """Tag of a box of `overlap_counts`, null for boxes by themselves; a full overlap wins."""
    return F.when(F.col("full") > 0, "full_overlap").when(F.col("partial") > 0, "partial_overlap")


def image_counts(counts: DataFrame, image: str) -> DataFrame:
    """image, boxes, full, partial: pairs of each image, out of a table of `overlap_counts`."""
    half = lambda c: (F.sum(c) / 2).cast("long").alias(c)
    return counts.groupBy(image).agg(F.count(F.lit(1)).alias("boxes"), half("full"), half("partial"))


@rule("RuleImageLabelOverlap", "QUALITY_BAD_IMG_LABEL_OVERLAP", (), required=("full", "partial"))
def image_label_overlap(f, cfg):
    """Of a table with the columns that `image_counts` gives."""
    full, partial = f.field("full"), f.field("partial")
    reason = F.concat(F.lit("full overlaps: "), full.cast("string"), F.lit(", partial overlaps: "), partial.cast("string"))
    return Verdict((full > 0) | (partial > 0), strings(reason), measure=(full + partial).cast("double"),
                   bad_label=F.lit("LabelOverlap_Fail.RuleImageLabelOverlap"))
