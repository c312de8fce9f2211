"""Operators on joined and grouped tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainsieve.functions import fixed as X
from grainsieve.operators import boxes as box_table, claims as claim_table, duplicates, media, scores as R, security, word_tables
from grainsieve.plans.evaluate import Check, verdicts_of
from grainsieve.registry import RULES

from . import query, spread, table
from .rules import STUCK_WORDS, WHOLE_SQL, lit


@query("gate_image_quality", "SELECT p_partkey, p_size / 10.0 < 2.5 AS status, CASE WHEN p_size / 10.0 < 2.5 THEN "
       "'QUALITY_BAD_IMG_EFFECTIVENESS.RuleImageQuality' ELSE 'QUALITY_GOOD' END AS label FROM part")
def gate_image_quality(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 10).alias("score"))
    return R.score_gate(p, F.col("score"), 2.5, "QUALITY_GOOD", "QUALITY_BAD_IMG_EFFECTIVENESS.RuleImageQuality").drop("score")


@query("gate_image_artimuse", "SELECT p_partkey, p_retailprice / 200 < 6 AS status, CASE WHEN p_retailprice / 200 < 6 THEN "
       "'Artimuse_Succeeded.BadImage' ELSE 'QUALITY_GOOD' END AS label FROM part")
def gate_artimuse(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 200).alias("score"))
    return R.score_gate(p, F.col("score"), 6.0, "QUALITY_GOOD", "Artimuse_Succeeded.BadImage").drop("score")


@query("gate_image_text_similarity", "SELECT l_orderkey, avg(l_discount) < 0.05 AS status, CASE WHEN avg(l_discount) < 0.05 THEN "
       "'QUALITY_BAD_IMG_RELEVANCE.RuleImageTextSimilarity' ELSE 'QUALITY_GOOD' END AS label FROM "
       "(SELECT l_orderkey, CAST(round(l_discount * 100) AS BIGINT) / 100.0 + 0.001 AS l_discount FROM lineitem) GROUP BY l_orderkey")
def gate_text_similarity(spark, sf):
    s = table(spark, sf, "lineitem").select("l_orderkey", (F.round(F.col("l_discount") * 100).cast("long") / 100 + 0.001).alias("score"))
    return R.mean_score_gate(s, "l_orderkey", 0.05, "QUALITY_GOOD", "QUALITY_BAD_IMG_RELEVANCE.RuleImageTextSimilarity").drop("score")


@query("gate_perspective", "SELECT user_id, bool_or(value / 20 > 0.6) AS status, CASE WHEN bool_or(value / 20 > 0.6) THEN "
       "'QUALITY_BAD.PERSPECTIVE' ELSE 'QUALITY_GOOD.PERSPECTIVE' END AS label, coalesce(array_to_string(list_sort(list(DISTINCT event_type) "
       "FILTER (WHERE value / 20 > 0.6)), ','), '') AS reason FROM events GROUP BY user_id")
def gate_perspective(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("attribute"), (F.col("value") / 20).alias("score"))
    g = R.attribute_gate(e, "user_id")
    return g.withColumn("reason", F.array_join("reason", ","))


@query("rag_context_precision", """
WITH s AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS v, l_linenumber, l_partkey, l_suppkey FROM lineitem),
p AS (SELECT l_orderkey, v, sum(v) OVER w / row_number() OVER w::DOUBLE * v AS p FROM s
      WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
g AS (SELECT l_orderkey, round(sum(p) / (sum(v) + 1e-10) * 10, 2) AS score FROM p GROUP BY l_orderkey)
SELECT l_orderkey, score, NOT (score >= 5) AS status,
  CASE WHEN score >= 5 THEN 'QUALITY_GOOD.CONTEXT_PRECISION_PASS' ELSE 'QUALITY_BAD.CONTEXT_PRECISION_FAIL' END AS label FROM g""")
def rag_context_precision(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("pos", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return R.context_precision(li, "l_orderkey", "pos", F.col("l_returnflag") == "R")


@query("rag_answer_relevancy", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id, list_cosine_similarity(a.v, b.v) AS s, b.label % 2 = 0 AS n
      FROM e a JOIN (SELECT *, unnest([1, 2, 3]) AS k FROM e) b ON a.vec_id = b.vec_id - b.k),
g AS (SELECT vec_id, CASE WHEN bool_and(n) THEN 0.0 ELSE avg(s) END * 10 AS score FROM p GROUP BY vec_id)
SELECT vec_id, round(score, 4) AS score, NOT (score >= 5) AS status,
  CASE WHEN score >= 5 THEN 'QUALITY_GOOD.ANSWER_RELEVANCY_PASS' ELSE 'QUALITY_BAD.ANSWER_RELEVANCY_FAIL' END AS label FROM g""")
def rag_answer_relevancy(spark, sf):
    e = table(spark, sf, "embeddings")
    made = (e.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
            .select((F.col("vec_id") - F.col("k")).alias("vec_id"), F.col("embedding").alias("made"),
                    F.col("label").alias("made_label")))
    pairs = e.select("vec_id", "embedding").join(made, "vec_id")
    out = R.answer_relevancy(pairs, "vec_id", "embedding", "made", F.col("made_label") % 2 == 0)
    return out.withColumn("score", F.round("score", 4))


@query("hallucination_consistency", """
WITH g AS (SELECT user_id, avg(1 - value / 20) AS h FROM events GROUP BY user_id)
SELECT user_id, round(h, 6) AS hallucination, h > 0.5 AS status, CASE WHEN h > 0.5 THEN
 'QUALITY_BAD_HALLUCINATION.HALLUCINATION_DETECTED' ELSE 'QUALITY_GOOD.NO_HALLUCINATION' END AS label FROM g""")
def hallucination_consistency(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.col("value") / 20).alias("score"))
    return R.consistency_verdict(e, "user_id", "score").withColumn("hallucination", F.round("hallucination", 6))


CLAIMS_SQL = """SELECT conv_id, turn, role, CASE WHEN length(text) % 4 = 0 THEN 'confirmed' WHEN length(text) % 4 = 1 THEN ' True '
 WHEN length(text) % 4 = 2 THEN 'refuted' ELSE 'maybe' END AS result, CASE WHEN length(text) % 5 = 0 THEN
 'There is insufficient evidence.' ELSE text END AS reasoning FROM conversations"""
VERDICT_SQL = ("CASE WHEN result IN ('confirmed', ' True ') THEN CASE WHEN regexp_matches(reasoning, "
               + lit("(?i)" + X.HEDGING) + ") THEN 'UNVERIFIABLE' ELSE 'TRUE' END WHEN result = 'refuted' THEN 'FALSE' ELSE 'UNVERIFIABLE' END")


def claims(spark, sf):
    return table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "role", CLAIMS_SQL[CLAIMS_SQL.index("CASE WHEN"):CLAIMS_SQL.index(" AS result")] + " AS result",
        "CASE WHEN length(text) % 5 = 0 THEN 'There is insufficient evidence.' ELSE text END AS reasoning")


@query("claim_article_verdict", f"""
WITH c AS (SELECT conv_id, {VERDICT_SQL} AS v FROM ({CLAIMS_SQL}))
SELECT conv_id, count(*) AS total_claims, count(*) FILTER (WHERE v = 'TRUE') AS verified_claims,
 count(*) FILTER (WHERE v = 'FALSE') AS false_claims, count(*) FILTER (WHERE v = 'UNVERIFIABLE') AS unverifiable_claims,
 round(count(*) FILTER (WHERE v = 'TRUE') / count(*)::DOUBLE, 4) AS score, bool_or(v <> 'TRUE') AS status,
 CASE WHEN bool_or(v = 'FALSE') THEN 'QUALITY_BAD_ARTICLE_FACTUAL_ERROR' WHEN bool_or(v = 'UNVERIFIABLE')
 THEN 'QUALITY_BAD_ARTICLE_UNVERIFIED_CLAIMS' ELSE 'QUALITY_GOOD' END AS label FROM c GROUP BY conv_id""")
def claim_article_verdict(spark, sf):
    return R.article_verdict(claims(spark, sf), "conv_id", R.claim_verdict(F.col("result"), F.col("reasoning")))


_ANSWER = ("CASE WHEN length(text) % 3 = 0 THEN 'so: {\"verification_result\": \"TRUE\", \"reasoning\": \"' || role || '\"}' "
           "WHEN length(text) % 3 = 1 THEN '{\"verification_result\": \"false\", \"reasoning\": \"' || role || ' and' "
           "ELSE 'nothing' END")


@query("claim_answer_parse", "SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN 'TRUE' WHEN length(text) % 3 = 1 THEN 'FALSE' "
       "END AS verification_result, CASE WHEN length(text) % 3 = 0 THEN role WHEN length(text) % 3 = 1 THEN role || ' and' END AS reasoning "
       "FROM conversations")
def claim_answer_parse(spark, sf):
    a = table(spark, sf, "conversations").selectExpr("conv_id", "turn", f"{_ANSWER} AS answer")
    got = R.read_claim_answer(F.col("answer"))
    return a.select("conv_id", "turn", got["verification_result"].alias("verification_result"), got["reasoning"].alias("reasoning"))


@query("claim_factuality", """
WITH g AS (SELECT conv_id, count(*) FILTER (WHERE length(text) % 5 > 0) / count(*)::DOUBLE AS r FROM conversations GROUP BY conv_id)
SELECT conv_id, r AS ratio, r < 0.8 AS status, CASE WHEN r < 0.8 THEN 'QUALITY_BAD_FACTUALITY.FACTUALITY_CHECK_FAILED'
 ELSE 'QUALITY_GOOD.FACTUALITY_CHECK_PASSED' END AS label FROM g""")
def claim_factuality(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.when(F.length("text") % 5 > 0, "true").otherwise("unsure").alias("answer"))
    return R.factuality(c, "conv_id", "answer")


@query("claim_types", "SELECT event_type AS claim_type, count(*) AS claims, count(*) FILTER (WHERE value > 5) AS verifiable FROM events GROUP BY event_type")
def claim_types(spark, sf):
    return R.claim_types(table(spark, sf, "events").select(F.col("event_type").alias("claim_type"), (F.col("value") > 5).alias("verifiable")))


@query("claim_distinct", r"""
WITH RECURSIVE s AS (
  SELECT doc_id, i - 1 AS pos, xs[i] AS claim FROM (SELECT doc_id, string_split_regex(text, '[.!?\n]+') AS xs FROM documents), unnest(range(1, len(xs) + 1)) AS t(i)),
low AS (SELECT doc_id, pos, claim, lower(trim(claim, E' \t\n\r\f\v')) AS low FROM s),
once AS (SELECT doc_id, low, min(pos) AS pos, arg_min(claim, pos) AS claim FROM low WHERE low <> '' GROUP BY doc_id, low),
links AS (SELECT a.doc_id, a.pos AS lo, b.pos AS hi FROM once a JOIN once b ON a.doc_id = b.doc_id AND a.pos < b.pos
  AND abs(length(a.low) - length(b.low)) < 0.2::DOUBLE * greatest(length(a.low), length(b.low)) AND (contains(a.low, b.low) OR contains(b.low, a.low))),
nodes AS (SELECT doc_id, list(struct_pack(hi := hi, los := los) ORDER BY hi) AS xs FROM (SELECT doc_id, hi, list(lo) AS los FROM links GROUP BY ALL) GROUP BY doc_id),
walk AS (
  SELECT doc_id, 0 AS i, []::BIGINT[] AS gone FROM nodes
  UNION ALL
  SELECT w.doc_id, i + 1, CASE WHEN len(list_filter(xs[i + 1].los, lambda l: NOT list_contains(gone, l))) > 0 THEN list_append(gone, xs[i + 1].hi) ELSE gone END
  FROM walk w JOIN nodes n ON n.doc_id = w.doc_id WHERE i < len(xs)),
dropped AS (SELECT doc_id, unnest(gone) AS pos FROM (SELECT doc_id, arg_max(gone, i) AS gone FROM walk GROUP BY doc_id))
SELECT doc_id, CAST(pos AS INTEGER) AS pos, claim FROM once ANTI JOIN dropped USING (doc_id, pos)""")
def claim_distinct(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", r"[.!?\n]+")).alias("pos", "claim"))
    return claim_table.distinct_claims(s, "doc_id", "pos", "claim")


@query("claim_text_chunks", r"""
WITH RECURSIVE c AS (
  SELECT doc_id, text, -1 AS chunk_no, 0 AS start_pos, 0 AS end_pos FROM documents
  UNION ALL
  SELECT doc_id, text, chunk_no + 1, end_pos, CASE
    WHEN end_pos + 1000 >= length(text) THEN CASE WHEN chunk_no < 0 THEN length(text) ELSE end_pos + 1000 END
    WHEN regexp_matches(tail, '(?s)\.|。|\n\n') THEN end_pos + 800 + length(regexp_extract(tail, '(?s)^(.*)(\.|。|\n\n)', 1)) + 1
    ELSE end_pos + 1000 END
  FROM (SELECT *, substr(text, end_pos + 801, 200) AS tail FROM c) WHERE chunk_no < 0 OR end_pos < length(text))
SELECT doc_id, chunk_no, substr(text, start_pos + 1, end_pos - start_pos) AS chunk, start_pos, end_pos FROM c WHERE chunk_no >= 0""")
def claim_text_chunks(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return d.select("doc_id", F.inline(R.text_chunks(F.col("text"), 1000)))


@query("search_contexts", """
WITH r AS (SELECT conv_id, list(struct_pack(turn := turn, text := text, role := role) ORDER BY turn) AS xs FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN [xs[1].role] ELSE []::VARCHAR[] END || list_transform(list_filter(xs[1:2],
 lambda x: trim(x.text) <> ''), lambda x: trim(x.text) || ' [Source: ' || x.role || ']') AS ctx FROM r)
SELECT conv_id, len(ctx) AS contexts, array_to_string(ctx, '|') AS joined FROM s""")
def search_contexts(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("xs"))
    r = c.select("conv_id", F.lit(0).alias("n"), F.lit(True).alias("success"),
                 F.when(F.col("conv_id") % 2 == 0, F.col("xs")[0]["role"]).alias("answer"),
                 F.transform("xs", lambda x: F.struct(x["role"].alias("url"), x["text"].alias("content"))).alias("items"))
    flat = R.search_contexts(r, "conv_id", "n")
    g = flat.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "context"))).alias("x"))
    return g.select("conv_id", F.size("x").cast("long").alias("contexts"), F.array_join(F.col("x.context"), "|").alias("joined"))


@query("paper_references", r"""
WITH t AS (SELECT o_orderkey, 'see ' || CASE WHEN o_orderkey % 3 = 0 THEN 'arXiv:1706.' || lpad(CAST(o_custkey AS VARCHAR), 5, '0')
 WHEN o_orderkey % 3 = 1 THEN 'doi 10.1234/' || o_orderpriority ELSE 'none' END || ' .' AS c FROM orders)
SELECT o_orderkey, array_to_string(list_sort(list_distinct(regexp_extract_all(c, '\b\d{4}\.\d{4,5}\b'))), ',') AS arxiv_ids,
 array_to_string(list_sort(list_distinct(regexp_extract_all(c, '(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b'))), ',') AS dois FROM t""")
def paper_references(spark, sf):
    t = table(spark, sf, "orders").selectExpr("o_orderkey", "'see ' || CASE WHEN o_orderkey % 3 = 0 THEN 'arXiv:1706.' || lpad(cast(o_custkey AS string), 5, '0') "
                                              "WHEN o_orderkey % 3 = 1 THEN 'doi 10.1234/' || o_orderpriority ELSE 'none' END || ' .' AS c")
    got = R.paper_references(F.col("c"))
    return t.select("o_orderkey", *[F.array_join(v, ",").alias(k) for k, v in got.items()])


@query("language_decision", """
SELECT event_id, CASE WHEN z + e > 0.5 THEN CASE WHEN z > 0.4 * (z + e) THEN 'zh' ELSE 'en' END
 WHEN greatest(z, e, h) > 0.6 THEN CASE WHEN h > 0.6 THEN 'sr' END WHEN h > 0 AND h > z AND h > e THEN 'sr' ELSE 'mix' END AS lang
FROM (SELECT event_id, (event_id % 7) / 16.0 AS z, (event_id % 5) / 16.0 AS e, (event_id % 11) / 16.0 AS h FROM events)""")
def language_decision(spark, sf):
    p = F.create_map(F.lit("zh"), F.col("event_id") % 7 / 16, F.lit("en"), F.col("event_id") % 5 / 16, F.lit("hr"), F.col("event_id") % 11 / 16)
    return table(spark, sf, "events").select("event_id", R.language_of(p).alias("lang"))


@query("match_report", """SELECT p_partkey, CASE WHEN p_size % 5 IN (0, 1) THEN p_name ELSE '' END AS missing_required,
 CASE WHEN p_size % 5 = 1 THEN p_brand ELSE '' END AS missing_nice, CASE WHEN p_size % 5 IN (2, 3, 4) THEN p_type ELSE '' END AS negative,
 true AS targeted FROM part""")
def match_report(spark, sf):
    t = table(spark, sf, "part").selectExpr("p_partkey", """CASE p_size % 5
      WHEN 0 THEN '["' || p_name || '"]'
      WHEN 1 THEN '{"match_details": {"missing": [{"skill": "' || p_name || '", "importance": "Required"}, {"skill": "' || p_brand || '"}]}}'
      WHEN 2 THEN '{"match_details": {}, "keyword_analysis": [{"keyword": "' || p_type || '", "importance": "Excluded", "match_status": "Matched"}]}'
      WHEN 3 THEN '{"match_details": {"negative_warnings": [{"skill": ""}, {"skill": "' || p_type || '"}, {}]}}'
      ELSE '{"keyword_analysis": [{"keyword": "' || p_type || '", "importance": "Excluded", "match_status": "Matched"}]}' END AS r""")
    got = R.match_report(F.col("r"))
    return t.select("p_partkey", *[(F.array_join(v, ",") if k != "targeted" else v).alias(k) for k, v in got.items()])


BOX = ("l_suppkey AS image, l_orderkey * 10 + l_linenumber AS box, (l_partkey % 100) * 40.0 AS x, l_quantity * 60.0 AS y, "
       "100.0 + l_linenumber * 10 AS width, 120.0 AS height")
BOX_PAIRS = f"""WITH b AS (SELECT DISTINCT {BOX} FROM lineitem),
i AS (SELECT l.image, l.box AS box_a, r.box AS box_b,
 greatest(0.0, least(l.x + l.width, r.x + r.width) - greatest(l.x, r.x)) * greatest(0.0, least(l.y + l.height, r.y + r.height) - greatest(l.y, r.y)) AS s,
 l.width * l.height + r.width * r.height AS a FROM b l JOIN b r ON l.image = r.image AND l.box < r.box),
p AS (SELECT image, box_a, box_b, s / (a - s) AS iou FROM i WHERE s / (a - s) >= 0.1) """


def boxes(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*BOX.replace("100.0", "100D").replace("40.0", "40D").replace("60.0", "60D")
                                                   .replace("120.0", "120D").split(", ")).distinct()


@query("box_overlap_pairs", BOX_PAIRS + "SELECT image, box_a, box_b, round(iou, 6) AS iou, CASE WHEN iou >= 0.9 THEN 'full' ELSE 'partial' END AS overlap FROM p")
def box_overlap_pairs(spark, sf):
    return R.box_overlaps(boxes(spark, sf), "image", "box").withColumn("iou", F.round("iou", 6))


@query("box_overlap_images", BOX_PAIRS + "SELECT image, count(*) FILTER (WHERE iou >= 0.9) AS \"full\", count(*) FILTER (WHERE iou < 0.9) AS partial, "
       "true AS status, 'LabelOverlap_Fail.RuleImageLabelOverlap' AS label FROM p GROUP BY image")
def box_overlap_images(spark, sf):
    return R.box_verdicts(R.box_overlaps(boxes(spark, sf), "image", "box"), "image")


BOX_COUNTS = f"""WITH b AS (SELECT *, row_number() OVER () AS id FROM (SELECT DISTINCT {BOX} FROM lineitem)),
i AS (SELECT l.id AS a, r.id AS b, l.width * l.height + r.width * r.height AS area,
 greatest(0.0, least(l.x + l.width, r.x + r.width) - greatest(l.x, r.x)) * greatest(0.0, least(l.y + l.height, r.y + r.height) - greatest(l.y, r.y)) AS s
 FROM b l JOIN b r ON l.image = r.image AND l.id <> r.id),
c AS (SELECT any_value(image) AS image, any_value(box) AS box, count(*) FILTER (WHERE s / (area - s) >= 0.9) AS "full",
 count(*) FILTER (WHERE s / (area - s) >= 0.1 AND s / (area - s) < 0.9) AS partial FROM b LEFT JOIN i ON i.a = b.id GROUP BY b.id) """


@query("box_overlap_counts", BOX_COUNTS + "SELECT image, box, \"full\", partial, CASE WHEN \"full\" > 0 THEN 'full_overlap' "
       "WHEN partial > 0 THEN 'partial_overlap' END AS attribute FROM c")
def box_overlap_counts(spark, sf):
    return box_table.overlap_counts(boxes(spark, sf), "image", "box").withColumn("attribute", box_table.attribute())


@query("rule_image_label_overlap", BOX_COUNTS + """SELECT image, f + q > 0 AS status, CAST(f + q AS DOUBLE) AS measure,
 CASE WHEN f + q > 0 THEN 'LabelOverlap_Fail.RuleImageLabelOverlap' ELSE 'QUALITY_GOOD' END AS label,
 CASE WHEN f + q > 0 THEN 'full overlaps: ' || f || ', partial overlaps: ' || q END AS reason FROM
 (SELECT image, CAST(sum("full") / 2 AS BIGINT) AS f, CAST(sum(partial) / 2 AS BIGINT) AS q FROM c GROUP BY image)""")
def rule_image_label_overlap(spark, sf):
    counts = box_table.image_counts(box_table.overlap_counts(boxes(spark, sf), "image", "box"), "image")
    v = verdicts_of(counts, Check.of({"full": "full", "partial": "partial"}, ["RuleImageLabelOverlap"]), ["image"])
    return v.withColumn("reason", F.array_join("reason", "; "))


# --- identifiers, personal data ------------------------------------------------------------

def _bad_label(name):
    return f"CASE WHEN status THEN '{RULES[name].bad_label}' ELSE 'QUALITY_GOOD' END AS label"


DOI = "CASE WHEN o_orderkey % 3 = 0 THEN '10.' || (1000 + o_custkey) || '/' || lower(o_orderpriority) ELSE o_orderpriority END"


@query("rule_doi", f"SELECT o_orderkey, status, {_bad_label('RuleDoi')} FROM (SELECT o_orderkey, NOT regexp_full_match({DOI}, "
       r"'10\.\d{4,9}/[^A-Z\s]*') AS status FROM orders)")
def rule_doi(spark, sf):
    d = table(spark, sf, "orders").selectExpr("o_orderkey", f"{DOI} AS doi")
    return verdicts_of(d, Check.of({"content": "doi"}, ["RuleDoi"]), ["o_orderkey"]).drop("measure", "reason")


ISBN = "CASE WHEN o_orderkey % 2 = 0 THEN '978-' || lpad(CAST(o_orderkey * 7919 AS VARCHAR(20)), 10, '0') ELSE lpad(CAST(o_orderkey * 31 AS VARCHAR(20)), 10, '0') END"
_d = lambda i: f"CAST(substr(n, {i}, 1) AS INT)"


@query("rule_isbn", f"SELECT o_orderkey, status, {_bad_label('RuleIsbn')} FROM (SELECT o_orderkey, CASE WHEN length(n) = 13 THEN ("
       + " + ".join(f"{_d(i + 1)} * {1 if i % 2 == 0 else 3}" for i in range(13)) + ") % 10 <> 0 ELSE ("
       + " + ".join(f"{_d(i + 1)} * {10 - i}" for i in range(10))
       + f") % 11 <> 0 END AS status FROM (SELECT o_orderkey, replace({ISBN}, '-', '') AS n FROM orders))")
def rule_isbn(spark, sf):
    d = table(spark, sf, "orders").selectExpr("o_orderkey", f"{ISBN} AS isbn")
    return verdicts_of(d, Check.of({"content": "isbn"}, ["RuleIsbn"]), ["o_orderkey"]).drop("measure", "reason")


@query("rule_metadata_similarity")
def rule_metadata_similarity(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.struct(F.col("p_name").alias("standard"), F.col("p_type").alias("produced")).alias("meta"))
    return verdicts_of(p, Check.of({"metadata": "meta"}, ["RuleMetadataSimilarity"]), ["p_partkey"]).drop("reason")


@query("rule_metadata_similarity_plain", "SELECT p_partkey, status, " + _bad_label("RuleMetadataSimilarity") + ", CAST(CASE WHEN status THEN 0 ELSE 1 END AS DOUBLE) AS measure "
       "FROM (SELECT p_partkey, p_size % 2 = 0 AS status FROM part)")
def rule_metadata_similarity_plain(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.struct(F.col("p_name").alias("standard"), F.when(
        F.col("p_size") % 2 == 1, F.upper("p_name")).otherwise("").alias("produced")).alias("meta"))
    return verdicts_of(p, Check.of({"metadata": "meta"}, ["RuleMetadataSimilarity"]), ["p_partkey"]).drop("reason")


@query("rule_word_stuck", WHOLE_SQL["RuleWordStuck"])
def rule_word_stuck(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    check = Check.of({"content": "text"}, ["RuleWordStuck"], RuleWordStuck={"words": STUCK_WORDS})
    return verdicts_of(d, check, ["doc_id"]).drop("measure", "reason")


@query("rule_pii_detection")
def rule_pii_detection(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    out = verdicts_of(d, Check.of({"content": "text"}, ["RulePIIDetection"]), ["doc_id"])
    return out.withColumn("reason", F.array_join("reason", "; "))


_MASK = "CASE WHEN length(u) <= 2 THEN repeat('*', length(u)) ELSE left(u, 1) || repeat('*', length(u) - 1) END || substr(v, position('@' IN v))"


@query("pii_email_findings", rf"""
WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}\b')) AS v FROM documents),
u AS (SELECT doc_id, v, left(v, position('@' IN v) - 1) AS u FROM h)
SELECT doc_id, 'medium' AS severity, {_MASK} AS masked, count(*) AS n FROM u GROUP BY ALL""")
def pii_email_findings(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return security.pii_table(d, "doc_id", "text", ("email",)).groupBy("doc_id", "severity", "masked").agg(F.count(F.lit(1)).alias("n"))


@query("pii_findings_by_type")
def pii_findings_by_type(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return security.pii_table(d, "doc_id", "text").groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n"))


# --- words of a table ----------------------------------------------------------------------

LISTED = r"[\p{L}\p{N}]+(?: [\p{L}\p{N}]+)?\.?"
LISTED_SQL = rf"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{LISTED}')) AS word FROM benchmark),
p AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') AS p FROM documents),
t AS (SELECT doc_id, p[i] AS a, coalesce(p[i + 1], '') AS gap, p[i + 2] AS b, coalesce(p[i + 3], '') AS next, p[i + 4] IS NULL AS done
  FROM p, unnest(range(1, len(p) + 1)) AS x(i) WHERE regexp_matches(p[i], '^[\p{{L}}\p{{N}}]')),
s AS (SELECT doc_id, a AS word FROM t
  UNION SELECT doc_id, a || '.' FROM t WHERE gap[1] = '.' AND (length(gap) > 1 OR b IS NULL)
  UNION SELECT doc_id, a || ' ' || b FROM t WHERE gap = ' ' AND b IS NOT NULL
  UNION SELECT doc_id, a || ' ' || b || '.' FROM t WHERE gap = ' ' AND b IS NOT NULL AND next[1] = '.' AND (length(next) > 1 OR done)),
f AS (SELECT doc_id, count(*) AS words, array_to_string(list_sort(list(word)), '|') AS found FROM s SEMI JOIN w USING (word) GROUP BY doc_id)
"""


def _listed(spark, sf):
    return table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(LISTED), 0)).alias("word"))


@query("unsafe_words_of_table", LISTED_SQL + "SELECT doc_id, words, found FROM f")
def unsafe_words_of_table(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    found = word_tables.table_words(d, "doc_id", "text", _listed(spark, sf))
    return found.select("doc_id", F.size("found").cast("long").alias("words"), F.array_join("found", "|").alias("found"))


@query("rule_unsafe_words_of_table", LISTED_SQL + """SELECT doc_id, words IS NOT NULL AS status,
 CASE WHEN words IS NULL THEN 'QUALITY_GOOD' ELSE 'QUALITY_BAD_SECURITY.RuleUnsafeWords' END AS label FROM documents LEFT JOIN f USING (doc_id)""")
def rule_unsafe_words_of_table(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    wide = word_tables.with_table_words(d, "doc_id", "text", _listed(spark, sf))
    check = Check.of({"content": "text", "found": "found"}, ["RuleUnsafeWords"], RuleUnsafeWords={"found": True})
    return verdicts_of(wide, check, ["doc_id"]).select("doc_id", "status", "label")


# --- near duplicates -----------------------------------------------------------------------

def _code(e: str, base: int, span: int = 1) -> str:
    """The signs of all 64 coordinates, or of the sums of `span` coordinates in a row, as the bits of a long, in SQL."""
    total = lambda i: " + ".join(f"{e}[{(i + k) % 64 + base}]" for k in range(span))
    bit = lambda i: f"CAST({2 ** i} AS BIGINT)" if i < 63 else "CAST(-9223372036854775808 AS BIGINT)"
    return "(" + " + ".join(f"(CASE WHEN {total(i)} > 0 THEN {bit(i)} ELSE CAST(0 AS BIGINT) END)" for i in range(64)) + ")"


@query("near_duplicates", f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, {_code('embedding', 1)} AS code FROM embeddings)
SELECT DISTINCT a.vec_id FROM e a JOIN e b ON a.vec_id <> b.vec_id AND bit_count(xor(a.code, b.code)) <= 10
 AND list_cosine_similarity(a.v, b.v) >= 0.97""")
def near_duplicates(spark, sf):
    e = table(spark, sf, "embeddings").selectExpr("vec_id", "embedding", f"{_code('embedding', 0)} AS code")
    return media.near_duplicates(e, "vec_id", "code", "embedding").select("vec_id")


@query("near_duplicates_wide", f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, {_code('CAST(embedding AS DOUBLE[])', 1, 16)} AS code FROM embeddings)
SELECT DISTINCT a.vec_id FROM e a JOIN e b ON a.vec_id <> b.vec_id AND bit_count(xor(a.code, b.code)) <= 11
 AND list_cosine_similarity(a.v, b.v) >= 0.3""")
def near_duplicates_wide(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("e", F.col("embedding").cast("array<double>")).selectExpr("vec_id", "embedding", f"{_code('e', 0, 16)} AS code")
    return media.near_duplicates(e, "vec_id", "code", "embedding", distance=11, likeness=0.3).select("vec_id")


def _wide_codes(spark, sf):
    return table(spark, sf, "embeddings").withColumn("e", F.col("embedding").cast("array<double>")).selectExpr(
        "vec_id", "embedding", "label", f"{_code('e', 0, 16)} AS code")


PARTNERS_SQL = f"""
WITH e AS (SELECT vec_id, label, embedding, CAST(embedding AS DOUBLE[]) AS v, {_code('CAST(embedding AS DOUBLE[])', 1, 16)} AS code FROM embeddings),
once AS (SELECT code, v, min(vec_id) AS rep, count(*) AS copies FROM e GROUP BY code, v),
found AS (SELECT a.rep, min(b.rep) AS partner, count(*) AS partners FROM once a JOIN once b ON a.rep <> b.rep
  AND bit_count(xor(a.code, b.code)) <= 8 AND list_cosine_similarity(a.v, b.v) >= 0.3 GROUP BY a.rep),
told AS (SELECT vec_id, label, copies, partner, coalesce(partners, 0) AS partners, once.rep
  FROM e JOIN once USING (code, v) LEFT JOIN found ON found.rep = once.rep)
"""


@query("image_partners", PARTNERS_SQL + "SELECT vec_id, copies, partner, partners, rep FROM told")
def image_partners(spark, sf):
    return duplicates.partners(_wide_codes(spark, sf), "vec_id", "code", "embedding", 8, 0.3)


@query("image_duplicate_ratio", PARTNERS_SQL + """
SELECT label, count(*) AS images, count(*) FILTER (copies > 1 OR partners > 0) AS duplicates,
  count(*) FILTER (copies > 1 OR partners > 0) / count(*) AS duplicate_ratio FROM told GROUP BY label""")
def image_duplicate_ratio(spark, sf):
    e = _wide_codes(spark, sf)
    found = duplicates.partners(e, "vec_id", "code", "embedding", 8, 0.3)
    return duplicates.duplicate_ratio(found.join(e.select("vec_id", "label"), "vec_id"), "label")


@query("rule_image_repeat", PARTNERS_SQL + """
SELECT vec_id, copies > 1 OR partners > 0 AS bad, CAST(copies - 1 + partners AS DOUBLE) AS score,
  CASE WHEN copies > 1 OR partners > 0 THEN 'QUALITY_BAD_IMG_SIMILARITY.RuleImageRepeat' ELSE 'QUALITY_GOOD' END AS label,
  CASE WHEN copies > 1 AND partners > 0 THEN 'identical images: ' || (copies - 1) || '; similar images: ' || partners || ', first ' || partner
    WHEN partners > 0 THEN 'similar images: ' || partners || ', first ' || partner
    WHEN copies > 1 THEN 'identical images: ' || (copies - 1) END AS reason FROM told""")
def rule_image_repeat(spark, sf):
    found = duplicates.partners(_wide_codes(spark, sf), "vec_id", "code", "embedding", 8, 0.3)
    check = Check.of({c: c for c in ("copies", "partner", "partners")}, ["RuleImageRepeat"])
    return verdicts_of(found, check, ["vec_id"]).select(
        "vec_id", F.col("status").alias("bad"), F.col("measure").alias("score"), "label", F.when(F.col("status"), F.col("reason")[0]).alias("reason"))


@query("text_difference")
def text_difference(spark, sf):
    c = table(spark, sf, "conversations")
    a = c.where("role = 'user'").select("conv_id", F.col("turn").alias("t"), F.col("text").alias("a"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("t"), F.col("text").alias("b"))
    return a.join(b, ["conv_id", "t"]).select("conv_id", "t", media.text_difference("a", "b").alias("d")).select("conv_id", "t", "d.*")
