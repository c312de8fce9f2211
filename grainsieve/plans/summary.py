"""Corpus summary of verdicts: totals, label ratios, score statistics, confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .evaluate import DETAILS, STATUS


def totals(verdicts: DataFrame) -> DataFrame:
    """total, num_good, num_bad and the share of good records in percent, in one pass."""
    bad = F.count_if(F.col(STATUS))
    n = F.count(F.lit(1))
    return verdicts.agg(n.alias("total"), (n - bad).alias("num_good"), bad.alias("num_bad")).select(
        "total", "num_good", "num_bad",
        F.when(F.col("total") > 0, F.round(F.col("num_good") / F.col("total") * 100, 2))
        .otherwise(0.0).alias("score"))


def _by_field(verdicts: DataFrame, *keep: str) -> DataFrame:
    return verdicts.select(*keep, F.explode(DETAILS).alias("field_key", "details"))


def label_counts(verdicts: DataFrame, *by: str) -> DataFrame:
    """How many records carry each label of each field key; a label counts once per record."""
    labels = F.array_distinct(F.flatten(F.transform(
        F.filter("details", lambda d: d["label"].isNotNull()), lambda d: d["label"])))
    return (_by_field(verdicts, *by)
            .select(*by, "field_key", F.explode(labels).alias("label"))
            .groupBy(*by, "field_key", "label").agg(F.count(F.lit(1)).alias("n")))


def tally(verdicts: DataFrame, *by: str) -> DataFrame:
    """All counts and score moments of a summary in one grouped pass over the verdicts, by the columns ``by``.

    Rows (kind, field_key, name): kind ``record`` (name good or bad), ``label`` and ``score`` (name: the metric), with
    the number of records n and, of scores, their moments. As many rows as there are labels and metrics.
    """
    none = F.lit(None).cast("double")
    entry = lambda kind, key, name, score: F.struct(
        F.lit(kind).alias("kind"), key.alias("field_key"), name.alias("name"), score.alias("score"))
    record = F.array(entry("record", F.lit(""), F.when(F.col(STATUS), "bad").otherwise("good"), none))
    per_field = F.transform(F.map_entries(DETAILS), lambda e: F.concat(
        F.transform(F.array_distinct(F.flatten(F.transform(F.filter(e["value"], lambda d: d["label"].isNotNull()), lambda d: d["label"]))),
                    lambda name: entry("label", e["key"], name, none)),
        F.transform(F.filter(e["value"], lambda d: d["score"].isNotNull() & (d["metric"] != "")),
                    lambda d: entry("score", e["key"], d["metric"], d["score"].cast("double")))))
    rows = verdicts.select(*by, F.inline(F.concat(record, F.coalesce(F.flatten(per_field), F.array().cast(
        "array<struct<kind: string, field_key: string, name: string, score: double>>")))))
    return rows.groupBy(*by, "kind", "field_key", "name").agg(F.count(F.lit(1)).alias("n"), *score_aggregates(F.col("score")))


def label_ratios(verdicts: DataFrame) -> DataFrame:
    """Label counts over the number of records, rounded to six places."""
    # the tally has a row for each label and metric, so the window over all of it stays small
    whole = W.partitionBy(F.lit(1))
    counts = tally(verdicts).withColumn("total", F.sum(F.when(F.col("kind") == "record", F.col("n"))).over(whole))
    return counts.where("kind = 'label'").select(
        "field_key", F.col("name").alias("label"), "n", F.round(F.col("n") / F.col("total"), 6).alias("ratio"))


def score_aggregates(score: Column) -> list[Column]:
    return [F.avg(score).alias("mean"), F.count(score).alias("score_count"), F.min(score).alias("low"),
            F.max(score).alias("high"), F.stddev_pop(score).alias("dev")]


def score_stats(verdicts: DataFrame) -> DataFrame:
    """Mean, count, extremes and spread of the scores of each field key and metric."""
    d = _by_field(verdicts).select("field_key", F.explode("details").alias("d"))
    scored = d.where(F.col("d.score").isNotNull() & (F.col("d.metric") != ""))
    return scored.groupBy("field_key", F.col("d.metric").alias("metric")).agg(
        *score_aggregates(F.col("d.score"))).select(
        "field_key", "metric", F.round("mean", 2).alias("score_average"), "score_count",
        F.round("low", 2).alias("score_min"), F.round("high", 2).alias("score_max"),
        F.when(F.col("score_count") > 1, F.round("dev", 2)).alias("score_std_dev"))


def overall(stats: DataFrame) -> DataFrame:
    """Mean of the rounded metric means of each field key."""
    return stats.groupBy("field_key").agg(
        F.round(F.avg("score_average"), 2).alias("overall_average"),
        F.count(F.lit(1)).alias("metrics"))


def confusion(verdicts: DataFrame, labels: DataFrame, on: str, good_label: Column) -> DataFrame:
    """Verdicts against known labels, good being the positive class."""
    # labels may be as long as the verdicts; Spark chooses the join by their size
    j = verdicts.select(on, F.col(STATUS).alias("bad")).join(labels, on).select("bad", good_label.alias("good"))
    c = j.agg(F.count_if(~F.col("bad") & F.col("good")).alias("tp"),
              F.count_if(~F.col("bad") & ~F.col("good")).alias("fp"),
              F.count_if(F.col("bad") & ~F.col("good")).alias("tn"),
              F.count_if(F.col("bad") & F.col("good")).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision = F.when(tp + fp > 0, tp / (tp + fp))
    recall = F.when(tp + fn > 0, tp / (tp + fn))
    return c.select("tp", "fp", "tn", "fn").withColumns({"accuracy": precision, "recall": recall}).withColumns({
        "f1_arithmetic": (F.col("accuracy") + F.col("recall")) / 2,
        "f1_harmonic": F.when(F.col("accuracy") + F.col("recall") > 0,
                              2 * F.col("accuracy") * F.col("recall") / (F.col("accuracy") + F.col("recall")))})


def summary_row(verdicts: DataFrame, task_name: str = "", input_path: str = "", output_path: str = "") -> DataFrame:
    """The whole summary as one row: totals plus nested label ratios and score statistics, out of one pass."""
    return summary_of(tally(verdicts), task_name, input_path, output_path)


def summary_of(counted: DataFrame, task_name: str = "", input_path: str = "", output_path: str = "") -> DataFrame:
    """The summary row of a tally, of a table of verdicts or of a stream so far."""
    is_kind = lambda k: F.col("kind") == k
    stats = F.struct(F.round("mean", 2).alias("score_average"), "score_count", F.round("low", 2).alias("score_min"),
                     F.round("high", 2).alias("score_max"),
                     F.when(F.col("score_count") > 1, F.round("dev", 2)).alias("score_std_dev"))
    fields = counted.groupBy("field_key").agg(
        F.sum(F.when(is_kind("record"), F.col("n"))).alias("total"),
        F.sum(F.when(is_kind("record") & (F.col("name") == "bad"), F.col("n"))).alias("num_bad"),
        F.collect_list(F.when(is_kind("label"), F.struct("name", "n"))).alias("labels"),
        F.collect_list(F.when(is_kind("score"), F.struct(F.col("name"), stats.alias("stats")))).alias("stats"),
        F.round(F.avg(F.when(is_kind("score"), F.round("mean", 2))), 2).alias("overall_average"))
    # a row for each field key
    one = fields.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("num_bad"), F.lit(0)).alias("num_bad"),
        F.collect_list(F.when(F.size("labels") > 0, F.struct("field_key", "labels"))).alias("ratios"),
        F.collect_list(F.when(F.size("stats") > 0, F.struct("field_key", F.struct(
            F.map_from_entries("stats").alias("stats"), "overall_average").alias("value")))).alias("scores"))
    total = F.col("total")
    ratios = F.map_from_entries(F.transform("ratios", lambda f: F.struct(f["field_key"], F.map_from_entries(F.transform(
        f["labels"], lambda x: F.struct(x["name"], F.round(x["n"] / total, 6)))))))
    good = total - F.col("num_bad")
    return one.select(
        F.lit(task_name).alias("task_name"), F.lit(input_path).alias("input_path"), F.lit(output_path).alias("output_path"),
        F.when(total > 0, F.round(good / total * 100, 2)).otherwise(0.0).alias("score"), good.alias("num_good"), "num_bad", "total",
        ratios.alias("type_ratio"), F.map_from_entries("scores").alias("metrics_score"))
