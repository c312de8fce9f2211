"""Counts of box overlaps against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from grainsieve.operators import boxes as B
from grainsieve.plans.evaluate import Check, verdicts_of

SCHEMA = "image int, box int, x double, y double, width double, height double, valid boolean"


def brute(rows):
    def iou(a, b):
        w = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
        h = min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
        s = max(w, 0) * max(h, 0)
        u = a[4] * a[5] + b[4] * b[5] - s
        return s / u if u else 0

    def fit(r):
        return r[6] is not False and None not in r[:1] + r[2:6] and all(abs(v) < float("inf") for v in r[2:6])

    out = []
    for i, a in enumerate(rows):
        near = [iou(a, b) for j, b in enumerate(rows) if i != j and a[0] == b[0] and fit(a) and fit(b)]
        out.append((a[0], a[1], sum(v >= 0.9 for v in near), sum(0.1 <= v < 0.9 for v in near)))
    return sorted(out, key=repr)


def counted(spark, rows):
    got = B.overlap_counts(spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit(1)).withColumn("full", F.lit(2)), "image", "box")
    return sorted(map(tuple, got.collect()), key=repr)


def stack(rng, n, image=0, key=0):
    return [(image, key + i, rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(40, 250), rng.uniform(90, 250), True) for i in range(n)]


@pytest.mark.parametrize("block", [B.BLOCK, 50])
def test_counts_in_crowds_and_beside_them(spark, monkeypatch, block):
    monkeypatch.setattr(B, "BLOCK", block)
    rng = random.Random(5)
    rows = stack(rng, 330)
    rows += [(i % 3, 1000 + i, rng.uniform(0, 900), rng.uniform(0, 900), *(10 ** rng.uniform(0.5, 3.4) for _ in range(2)), None)
             for i in range(200)]
    rows += rows[:5] + [rows[0]] * 3
    assert counted(spark, rows) == brute(rows)


def test_odd_boxes(spark):
    inf, nan = float("inf"), float("nan")
    good = (1, 1, 0.0, 0.0, 10.0, 10.0, True)
    rows = [good, good, (1, None, -0.0, 0.0, 10.0, 10.0, None), (1, 2, 0.0, 0.0, 10.0, 10.0, False), (None, 3, 0.0, 0.0, 10.0, 10.0, True),
            (1, 4, None, 0.0, 10.0, 10.0, True), (1, 5, 0.0, 0.0, 0.0, 10.0, True), (1, 6, 0.0, 0.0, inf, 10.0, True),
            (1, 7, nan, 0.0, 10.0, 10.0, True), (1, 8, 5.0, 5.0, -3.0, 4.0, True), (2, 1, -700.0, -9.0, 300.0, 30.0, True),
            (2, 2, -690.0, -9.0, 300.0, 30.0, True), (2, 3, -690.0, 9.0, 300.0, 30.0, True), (2, 3, 1e12, 0.0, 1e9, 1e9, True),
            (2, 9, 1e12, 0.0, 1e9, 1e9, True)]
    assert counted(spark, rows) == brute(rows)
    assert counted(spark, []) == []


def test_stacked_boxes_leave_no_pairs(spark):
    """20,000 boxes of one image: 200 million pairs are counted, over many tasks, and the verdict names them."""
    n = 20_000
    df = spark.range(n).select(F.lit(1).alias("image"), F.col("id").alias("box"), (F.col("id") % 200 / 100).alias("x"),
                               (F.floor(F.col("id") / 200) / 100).alias("y"), F.lit(200.0).alias("width"), F.lit(200.0).alias("height"))
    per = B.image_counts(B.overlap_counts(df, "image", "box"), "image")
    v = verdicts_of(per, Check.of({"full": "full", "partial": "partial"}, ["RuleImageLabelOverlap"]), ["image"]).first()
    assert (v.status, v.label, v.measure) == (True, "LabelOverlap_Fail.RuleImageLabelOverlap", n * (n - 1) / 2)
    assert v.reason == [f"full overlaps: {n * (n - 1) // 2}, partial overlaps: 0"]
