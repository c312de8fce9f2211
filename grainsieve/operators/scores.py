"""Verdicts that rest on joined or grouped score, claim and box tables."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed as X
from ..functions import text as T
from .judging import value


# --- score gates ---------------------------------------------------------------------------

def score_gate(df: DataFrame, score: Column, threshold: float, good: str, bad: str) -> DataFrame:
    """Bad where a model's score lies below the threshold; no score, no label."""
    status = F.coalesce(score < threshold, F.lit(False))
    return df.withColumns({"status": status, "label": F.when(status, bad).when(score.isNotNull(), good)})


def attribute_gate(scores: DataFrame, key: str, threshold: float = 0.6) -> DataFrame:
    """scores(key, attribute, score): bad if any attribute lies above the threshold."""
    over = F.sort_array(F.collect_set(F.when(F.col("score") > threshold, F.col("attribute"))))
    g = scores.groupBy(key).agg(over.alias("reason"))
    bad = F.size("reason") > 0
    return g.select(key, bad.alias("status"), F.when(bad, "QUALITY_BAD.PERSPECTIVE")
                    .otherwise("QUALITY_GOOD.PERSPECTIVE").alias("label"), "reason")


def mean_score_gate(scores: DataFrame, key: str, threshold: float, good: str, bad: str) -> DataFrame:
    """Bad where the mean of a record's scores lies below the threshold (text against image)."""
    return score_gate(scores.groupBy(key).agg(F.avg("score").alias("score")), F.col("score"), threshold, good, bad)


# --- retrieval -----------------------------------------------------------------------------

def context_precision(verdicts: DataFrame, key: str, order: str, relevant: Column, threshold: float = 5.0) -> DataFrame:
    """Average precision of the ranked contexts of a record, on a scale of ten."""
    v = relevant.cast("int")
    ranked = W.partitionBy(key).orderBy(order)
    step = verdicts.select(key, v.alias("v"), (F.sum(v).over(ranked) / F.row_number().over(ranked) * v).alias("p"))
    s = step.groupBy(key).agg(F.sum("p").alias("p"), F.sum("v").alias("v"))
    score = F.round(F.col("p") / (F.col("v") + 1e-10) * 10, 2)
    return _scaled(s, key, score, threshold, "CONTEXT_PRECISION")


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, t: s + t)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))  # null for a vector of zeros


def answer_relevancy(pairs: DataFrame, key: str, question: str, generated: str, noncommittal: Column,
                     threshold: float = 5.0) -> DataFrame:
    """Mean likeness of a question and those made from its answer, nil if all are noncommittal."""
    s = pairs.groupBy(key).agg(F.avg(cosine(F.col(question), F.col(generated))).alias("mean"),
                               F.bool_and(noncommittal).alias("none"))
    return _scaled(s, key, F.when(F.col("none"), 0.0).otherwise(F.col("mean")) * 10, threshold, "ANSWER_RELEVANCY")


def _scaled(df: DataFrame, key: str, score: Column, threshold: float, what: str) -> DataFrame:
    out = df.select(key, score.alias("score"))
    ok = F.col("score") >= threshold
    return out.select(key, "score", (~ok).alias("status"), F.when(ok, f"QUALITY_GOOD.{what}_PASS")
                      .otherwise(f"QUALITY_BAD.{what}_FAIL").alias("label"))


def consistency_verdict(scores: DataFrame, key: str, score: str, threshold: float = 0.5) -> DataFrame:
    """scores(key, score), one per context: bad if the mean of 1 - score exceeds the threshold."""
    g = scores.groupBy(key).agg(F.avg(1 - F.col(score)).alias("hallucination"))
    bad = F.col("hallucination") > threshold
    return g.select(key, "hallucination", bad.alias("status"), F.when(
        bad, "QUALITY_BAD_HALLUCINATION.HALLUCINATION_DETECTED").otherwise("QUALITY_GOOD.NO_HALLUCINATION").alias("label"))


def search_contexts(results: DataFrame, key: str, order: str, top: int = 2) -> DataFrame:
    """The answer and the first contents with their source, of searches that succeeded.

    results(key, order, success, answer, items array<struct<url, content>>)
    """
    kept = F.filter(F.slice("items", 1, top), lambda r: ~T.is_blank(T.as_text(r["content"])))
    texts = F.transform(kept, lambda r: F.concat(T.strip(r["content"]), F.lit(" [Source: "),
                                                 F.coalesce(r["url"], F.lit("Unknown")), F.lit("]")))
    answer = F.when(F.coalesce(F.col("answer"), F.lit("")) != "", F.array("answer")).otherwise(F.array().cast("array<string>"))
    return (results.where("success").select(key, order, F.posexplode(F.concat(answer, texts)).alias("pos", "context")))


# --- claims --------------------------------------------------------------------------------

def normal_verdict(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in X.VERDICT_SYNONYMS.items() for x in kv])
    return F.coalesce(names[F.upper(T.strip(c))], F.lit("UNVERIFIABLE"))


def claim_verdict(result: Column, reasoning: Column) -> Column:
    """TRUE, FALSE or UNVERIFIABLE; a TRUE argued with hedging words is not verifiable."""
    v = normal_verdict(result)
    hedged = F.rlike(F.coalesce(reasoning, F.lit("")), F.lit("(?iud)" + X.HEDGING))
    return F.when((v == "TRUE") & hedged, "UNVERIFIABLE").otherwise(v)


def read_claim_answer(answer: Column) -> dict[str, Column]:
    """Verdict and reasoning of a model's answer: a flat JSON object, else field by field."""
    flat = F.regexp_substr(answer, F.lit(r'(?s)\{[^{}]*"verification_result"[^{}]*\}'))
    string = r'(?s)"%s"\s*:\s*"((?:[^"\\]|\\.)*+)"?'
    ok = F.try_parse_json(flat).isNotNull()

    def loose(field: str) -> Column:
        found = F.nullif(F.regexp_extract(answer, string % field, 1), F.lit(""))
        return F.replace(F.replace(found, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))

    verdict = F.nullif(F.regexp_extract(
        answer, r'(?i)"verification_result"\s*:\s*"(TRUE|FALSE|UNVERIFIABLE)"', 1), F.lit(""))
    return {
        "verification_result": F.when(ok, value(flat, "verification_result")).otherwise(F.upper(verdict)),
        "reasoning": F.when(ok, value(flat, "reasoning")).otherwise(loose("reasoning")),
        "evidence": F.when(ok, value(flat, "evidence")).otherwise(loose("evidence")),
    }


def article_verdict(claims: DataFrame, key: str, verdict: Column) -> DataFrame:
    """Claims of an article summed up: bad if one is false or cannot be verified."""
    n = lambda v: F.count_if(verdict == v)
    g = claims.groupBy(key).agg(F.count(F.lit(1)).alias("total_claims"), n("TRUE").alias("verified_claims"),
                                n("FALSE").alias("false_claims"), n("UNVERIFIABLE").alias("unverifiable_claims"))
    false, unknown = F.col("false_claims"), F.col("unverifiable_claims")
    return g.withColumns({
        "score": F.round(F.col("verified_claims") / F.col("total_claims"), 4),
        "status": (false + unknown) > 0,
        "label": F.when(false > 0, "QUALITY_BAD_ARTICLE_FACTUAL_ERROR")
        .when(unknown > 0, "QUALITY_BAD_ARTICLE_UNVERIFIED_CLAIMS").otherwise("QUALITY_GOOD")})


def factuality(claims: DataFrame, key: str, answer: str, threshold: float = 0.8) -> DataFrame:
    """Share of claims answered true; records without claims do not appear in the table."""
    g = claims.groupBy(key).agg((F.count_if(F.col(answer) == "true") / F.count(F.lit(1))).alias("ratio"))
    bad = F.col("ratio") < threshold
    return g.select(key, "ratio", bad.alias("status"), F.when(bad, "QUALITY_BAD_FACTUALITY.FACTUALITY_CHECK_FAILED")
                    .otherwise("QUALITY_GOOD.FACTUALITY_CHECK_PASSED").alias("label"))


def claim_types(claims: DataFrame) -> DataFrame:
    """Number of claims and of verifiable ones by type."""
    return claims.groupBy(F.coalesce("claim_type", F.lit("unknown")).alias("claim_type")).agg(
        F.count(F.lit(1)).alias("claims"),
        F.count_if(F.coalesce(F.col("verifiable"), F.lit(True))).alias("verifiable"))


def chunk_ends(text: str, size: int) -> list[int]:
    """Where the pieces of a text end; each search looks at the last fifth of one piece only."""
    n, lead, ends, start = len(text), int(size * 0.8), [], 0
    while start < n or not ends:
        if start + size >= n:
            end = start + size if start else n
        else:
            cut = max(text.rfind(mark, start + lead, start + size) for mark in (".", "\n\n", "。"))
            end = cut + 1 if cut >= 0 else start + size
        ends.append(end)
        start = end
    return ends


def text_chunks(text: Column, size: int) -> Column:
    """array<struct<chunk_no, chunk, start_pos, end_pos>>: pieces of at most ``size`` characters, broken behind a
    sentence or paragraph if one ends in the last fifth. The end of a later last piece is counted on to its full size.

    Time and memory grow with the length of a text: pieces are cut by place, not counted from its first character."""
    def cut(texts: pa.Array) -> pa.Array:
        firsts, chunks, ends = [0], [], []
        for t in pc.cast(texts, pa.large_string()).to_pylist():
            own = chunk_ends(t or "", size)
            chunks += [(t or "")[a:b] for a, b in zip([0, *own], own)]
            ends.append(own)
            firsts.append(len(chunks))
        pieces = pa.StructArray.from_arrays(
            [pa.array([i for own in ends for i in range(len(own))], pa.int32()), pa.array(chunks, pa.string()),
             pa.array([a for own in ends for a in [0, *own[:-1]]], pa.int32()), pa.array([b for own in ends for b in own], pa.int32())],
            names=["chunk_no", "chunk", "start_pos", "end_pos"])
        return pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pieces)

    kind = "array<struct<chunk_no: int, chunk: string, start_pos: int, end_pos: int>>"
    return F.arrow_udf(cut, kind)(F.coalesce(text, F.lit("")))


def paper_references(text: Column) -> dict[str, Column]:
    """Distinct arXiv ids and DOIs named in a text, sorted."""
    ids = F.concat(
        T.find_all(text, T.java(r"\b\d{4}\.\d{4,5}(?:v\d+)?\b")),
        T.find_all(text, T.java(r"\b[a-z\-]+/\d{7}(?:v\d+)?\b")),
        T.find_all(text, "(?iu)" + T.java(r"arXiv:\s*(\d{4}\.\d{4,5}(?:v\d+)?|[a-z\-]+/\d{7}(?:v\d+)?)"), 1))
    dois = T.find_all(text, "(?iu)" + T.java(r"\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"))
    return {"arxiv_ids": F.array_sort(F.array_distinct(ids)), "dois": F.array_sort(F.array_distinct(dois))}


def language_of(probs: Column, text: Column | None = None) -> Column:
    """A language out of class probabilities (map); ``mix`` where none stands out."""
    p = lambda k: F.coalesce(probs[k], F.lit(0.0))
    both = p("zh") + p("en")
    # among equals the first class wins
    best = F.array_max(F.transform(F.map_entries(probs), lambda e, i: F.struct(
        e["value"].alias("p"), (-i).alias("i"), e["key"].alias("k"))))
    lang = (F.when(both > 0.5, F.when(p("zh") > 0.4 * both, "zh").otherwise("en"))
            .when(best["p"] > 0.6, F.when(best["k"] == "hr", "sr").otherwise(best["k"]))
            .when((best["p"] > 0) & best["k"].isin("sr", "hr"), "sr").otherwise("mix"))
    return lang if text is None else F.when(text == "", "empty").otherwise(lang)


def match_report(report: Column) -> dict[str, Column]:
    """Missing, nice-to-have and unwanted keywords of a match report in any of its forms."""
    none = F.array().cast("array<string>")
    plain = F.from_json(report, "array<string>")
    found = value(report, "match_details")
    # an empty object counts as none
    details = F.from_json(F.when(F.size(F.json_object_keys(found)) > 0, found),
                          "missing array<struct<skill string, importance string>>, negative_warnings array<struct<skill string>>")
    rows = F.from_json(value(report, "keyword_analysis"), "array<struct<keyword string, importance string, match_status string>>")
    gap = F.filter(details["missing"], lambda m: F.coalesce(m["skill"], F.lit("")) != "")

    def from_rows(kind: str, status: str) -> Column:
        return F.transform(F.filter(rows, lambda k: (F.lower(k["importance"]) == kind)
                                    & (F.lower(k["match_status"]) == status)), lambda k: k["keyword"])

    def one_of(in_list: Column, in_details: Column, in_rows: Column) -> Column:
        return F.when(F.rlike(report, F.lit(r"\A\s*\[")), in_list).otherwise(
            F.coalesce(F.when(details.isNotNull(), F.coalesce(in_details, none)), in_rows, none))

    required = one_of(plain, F.transform(F.filter(gap, lambda m: m["importance"] == "Required"), lambda m: m["skill"]),
                      from_rows("required", "missing"))
    nice = one_of(none, F.transform(F.filter(gap, lambda m: F.coalesce(m["importance"], F.lit("")) != "Required"),
                                    lambda m: m["skill"]), from_rows("nice-to-have", "missing"))
    warned = F.filter(details["negative_warnings"], lambda m: F.coalesce(m["skill"], F.lit("")) != "")
    unwanted = one_of(none, F.transform(warned, lambda m: m["skill"]),
                      from_rows("excluded", "matched"))
    return {"missing_required": required, "missing_nice": nice, "negative": unwanted,
            "targeted": (F.size(required) + F.size(nice) + F.size(unwanted)) > 0}


# --- boxes ---------------------------------------------------------------------------------

def box_overlaps(boxes: DataFrame, image: str, box: str, cell: float = 256.0) -> DataFrame:
    """Pairs of valid boxes of an image with IoU >= 0.1, tagged full (>= 0.9) or partial.

    Boxes meet in grid cells, so a crowded image is split over many tasks. The cells of a box have the least power of
    two times ``cell`` that is no shorter than its longer side, so a box of any size touches four of them at most. An IoU
    of a tenth needs longer sides within a factor of ten of each other: each box is looked up in its own grid and the next four
    coarser ones. A pair is taken in the cell that holds the corner where its intersection begins.
    """
    ok = F.coalesce(F.col("valid"), F.lit(True)) if "valid" in boxes.columns else F.lit(True)
    b = boxes.where(ok & F.col("x").isNotNull() & F.col("y").isNotNull()
                    & F.col("width").isNotNull() & F.col("height").isNotNull())
    grid = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest("width", "height", F.lit(1e-9)) / cell))).cast("int")
    b = b.select(image, box, "x", "y", "width", "height", grid.alias("own"))

    def placed(rows: DataFrame) -> DataFrame:
        step = F.lit(cell) * F.pow(F.lit(2.0), F.col("grid"))
        rows = rows.withColumn("step", step)
        for name, low, size in (("cx", "x", "width"), ("cy", "y", "height")):
            rows = rows.withColumn(name, F.explode(F.sequence(
                F.floor(F.col(low) / F.col("step")), F.floor((F.col(low) + F.col(size)) / F.col("step")))))
        return rows

    l = placed(b.withColumn("grid", F.col("own"))).alias("l")  # noqa: E741
    r = placed(b.withColumn("grid", F.explode(F.sequence(F.col("own"), F.col("own") + 4)))).alias("r")
    c = lambda s, n: F.col(f"{s}.{n}")
    j = l.join(r, (c("l", image) == c("r", image)) & (c("l", "grid") == c("r", "grid")) & (c("l", "cx") == c("r", "cx"))
               & (c("l", "cy") == c("r", "cy")) & ((c("r", "own") < c("l", "own")) | (c("l", box) < c("r", box))))
    left, top = F.greatest(c("l", "x"), c("r", "x")), F.greatest(c("l", "y"), c("r", "y"))
    right = F.least(c("l", "x") + c("l", "width"), c("r", "x") + c("r", "width"))
    low = F.least(c("l", "y") + c("l", "height"), c("r", "y") + c("r", "height"))
    shared = F.greatest(F.lit(0.0), right - left) * F.greatest(F.lit(0.0), low - top)
    union = c("l", "width") * c("l", "height") + c("r", "width") * c("r", "height") - shared
    step = c("l", "step")
    here = (F.floor(left / step) == c("l", "cx")) & (F.floor(top / step) == c("l", "cy")) & (c("l", box) != c("r", box))
    pairs = j.where(here).select(c("l", image).alias(image), F.least(c("l", box), c("r", box)).alias("box_a"),
                                 F.greatest(c("l", box), c("r", box)).alias("box_b"),
                                 F.when(union != 0, shared / union).otherwise(F.lit(0.0)).alias("iou"))
    return pairs.where("iou >= 0.1").withColumn("overlap", F.when(F.col("iou") >= 0.9, "full").otherwise("partial"))


def box_verdicts(pairs: DataFrame, image: str) -> DataFrame:
    """Overlap counts of each image that has any; such an image is bad."""
    return pairs.groupBy(image).agg(F.count_if(F.col("overlap") == "full").alias("full"),
                                    F.count_if(F.col("overlap") == "partial").alias("partial")).select(
        image, "full", "partial", F.lit(True).alias("status"), F.lit("LabelOverlap_Fail.RuleImageLabelOverlap").alias("label"))


def box_attributes(pairs: DataFrame, image: str) -> DataFrame:
    """Tag of each overlapping box; full overlap wins."""
    each = pairs.select(image, F.explode(F.array("box_a", "box_b")).alias("box"), "overlap")
    return each.groupBy(image, "box").agg(F.when(F.max(F.col("overlap") == "full"), "full_overlap")
                                          .otherwise("partial_overlap").alias("attribute"))
