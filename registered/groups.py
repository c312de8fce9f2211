"""Groups whose members read other things than a text, and lists out of judges' answers, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from grainsieve.operators import answer_tables
from grainsieve.plans.evaluate import Check, flags

from . import query, table
from .relations import DOI, ISBN


def _names(df: DataFrame, key: str) -> DataFrame:
    """The failing members of each record, joined."""
    names = [c for c in df.columns if c != key]
    bad = F.array_join(F.array_compact(F.array(*[F.when(F.col(c), c) for c in names])), "|")
    return df.select(key, bad.alias("failed"), F.lit(len(names)).cast("long").alias("members"))


_SHADE = "CASE p_partkey % 4 WHEN 0 THEN 'FF' WHEN 1 THEN '00' WHEN 2 THEN 'F0' ELSE '7F' END"


@query("group_img", """
SELECT p_partkey, concat_ws('|', CASE WHEN p_partkey % 4 < 2 THEN 'RuleImageValid' END,
  CASE WHEN p_size / (p_partkey % 50 + 1)::DOUBLE > 4 OR p_size / (p_partkey % 50 + 1)::DOUBLE < 0.25 THEN 'RuleImageSizeValid' END,
  CASE WHEN p_size / 10.0 < 5.5 AND p_size % 7 > 0 THEN 'RuleImageQuality' END) AS failed, 3 AS members FROM part""")
def group_img(spark, sf):
    """One shade, as wide as the part is large; every seventh has no score. The fourth channel of RGBA images is not white."""
    images = table(spark, sf, "part").selectExpr(
        "p_partkey", "CASE WHEN p_size % 7 > 0 THEN p_size / 10D END AS score", f"""named_struct('data',
        unhex(repeat(CASE WHEN p_size % 2 = 0 THEN repeat({_SHADE}, 3) || '5A' ELSE repeat({_SHADE}, 3) END, p_size)),
        'width', p_size, 'height', cast(p_partkey % 50 + 1 AS int), 'nChannels', CASE WHEN p_size % 2 = 0 THEN 4 ELSE 3 END) AS image""")
    return _names(flags(images, [Check.group({"image": "image", "score": "score"}, "img")], ["p_partkey"]), "p_partkey")


@query("rule_image_scores", """
SELECT p_partkey, concat_ws('|', CASE WHEN p_size % 7 > 0 AND p_size / 10.0 < 5.5 THEN 'RuleImageQuality' END,
  CASE WHEN p_size % 7 > 0 AND p_size / 10.0 < 0.17 THEN 'RuleImageTextSimilarity' END,
  CASE WHEN p_size % 7 > 0 AND p_size / 10.0 < 4 THEN 'RuleImageArtimuse' END) AS failed, 3 AS members FROM part""")
def rule_image_scores(spark, sf):
    """Rules on the score of an outside model, one with a threshold of the user's; every seventh has no score."""
    p = table(spark, sf, "part").selectExpr("p_partkey", "CASE WHEN p_size % 7 > 0 THEN p_size / 10D END AS score")
    names = ["RuleImageQuality", "RuleImageTextSimilarity", "RuleImageArtimuse"]
    return _names(flags(p, [Check.of({"score": "score"}, names, RuleImageArtimuse={"threshold": 4.0})], ["p_partkey"]), "p_partkey")


_digit = lambda i: f"CAST(substr(n, {i}, 1) AS INT)"
_thirteen = " + ".join(f"{_digit(i + 1)} * {1 if i % 2 == 0 else 3}" for i in range(13))
_ten = " + ".join(f"{_digit(i + 1)} * {10 - i}" for i in range(10))


@query("group_xinghe", rf"""
SELECT o_orderkey, concat_ws('|', CASE WHEN NOT regexp_full_match(c, '10\.\d{{4,9}}/[^A-Z\s]*') THEN 'RuleDoi' END,
  CASE WHEN NOT CASE WHEN regexp_full_match(n, '[0-9]{{13}}') THEN ({_thirteen}) % 10 = 0
    WHEN regexp_full_match(n, '[0-9]{{10}}') THEN ({_ten}) % 11 = 0 ELSE false END THEN 'RuleIsbn' END) AS failed, 2 AS members
FROM (SELECT o_orderkey, c, replace(c, '-', '') AS n FROM (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN {ISBN} ELSE {DOI} END AS c FROM orders))""")
def group_xinghe(spark, sf):
    d = table(spark, sf, "orders").selectExpr("o_orderkey", f"CASE WHEN o_custkey % 2 = 0 THEN {ISBN} ELSE {DOI} END AS c")
    return _names(flags(d, [Check.group({"content": "c"}, "xinghe")], ["o_orderkey"]), "o_orderkey")


@query("group_sciencemetabench", "SELECT p_partkey, CASE WHEN p_size % 3 = 1 THEN 'RuleMetadataSimilarity' ELSE '' END AS failed, 1 AS members FROM part")
def group_sciencemetabench(spark, sf):
    """Titles in other case, missing ones, and titles missing on both sides."""
    d = table(spark, sf, "part").selectExpr("p_partkey", "named_struct('standard', CASE WHEN p_size % 3 < 2 THEN p_name END, "
                                            "'produced', CASE WHEN p_size % 3 = 0 THEN upper(p_name) END) AS meta")
    return _names(flags(d, [Check.group({"metadata": "meta"}, "sciencemetabench")], ["p_partkey"]), "p_partkey")


def _scores_sql(threshold: float) -> str:
    return f"""SELECT user_id, CASE WHEN avg(1 - v / 20.0) FILTER (WHERE v < 16) <= {threshold} THEN '' ELSE 'RuleHallucinationHHEM' END AS failed,
 1 AS members FROM (SELECT user_id, CAST(floor(value) AS BIGINT) AS v FROM events) GROUP BY user_id"""


def _scores(spark, sf, group: str, **settings) -> DataFrame:
    e = table(spark, sf, "events").withColumn("v", F.floor("value"))
    lists = e.groupBy("user_id").agg(F.collect_list(F.when(F.col("v") < 16, F.col("v") / 20)).alias("scores"))
    return _names(flags(lists, [Check.group({"scores": "scores"}, group, **settings)], ["user_id"]), "user_id")


@query("group_hallucination", _scores_sql(0.51))
def group_hallucination(spark, sf):
    return _scores(spark, sf, "hallucination", RuleHallucinationHHEM={"threshold": 0.51})


@query("group_rag", _scores_sql(0.767))
def group_rag(spark, sf):
    return _scores(spark, sf, "rag", RuleHallucinationHHEM={"threshold": 0.767})


# --- lists in answers ----------------------------------------------------------------------

_SKILL = "(o_custkey + {i} * 3) % 10 / 10.0"
_PLACE = "(o_orderkey + {i}) % 10 / 10.0"
_COMPANY = ("'{{\"name\": \"c{i}\", ' || CASE WHEN {i} = 1 THEN '\"scoring_breakdown\": {{\"skill_match\": {{\"score\": ' || cast(" + _SKILL
            + " AS DECIMAL(3,1)) || '}}, \"location_match\": {{\"score\": ' || cast(" + _PLACE + " AS DECIMAL(3,1)) || '}}}}' ELSE '\"match_score\": ' || cast("
            + _SKILL + " AS DECIMAL(3,1)) END || ', \"financial_status\": \"' || CASE WHEN o_orderkey % 5 = {i} THEN 'contraction' ELSE 'stable' END || "
            "'\", \"financial_evidence\": {{\"confidence\": 0.' || ((o_orderkey + {i}) % 7 + 2) || ', \"conflicting_signals\": ' || CASE WHEN "
            "(o_custkey + {i}) % 4 = 0 THEN '\"' || o_orderpriority || '\"' ELSE 'null' END || ', \"source_quotes\": [\"' || o_orderpriority || '\"]}}}}'")
_GIVEN = "CASE WHEN o_orderkey % 3 = 0 THEN '{\"name\": \"given\"}' ELSE '' END"


@query("scout_company_lists", f"""
WITH c AS (SELECT o_orderkey, i, 'c' || i AS name, round(CASE WHEN i = 1 THEN ({_SKILL.format(i='i')} * 4 + {_PLACE.format(i='i')}) / 5 ELSE {_SKILL.format(i='i')} END, 2) AS score,
  CASE WHEN o_orderkey % 5 = i THEN 'not_recommended' WHEN (o_orderkey + i) % 7 + 2 < 5 THEN 'insufficient' ELSE 'target' END AS list,
  o_orderpriority AS p, (o_custkey + i) % 4 = 0 AS torn FROM orders, unnest([0, 1, 2]) AS t(i)
  UNION ALL SELECT o_orderkey, 9, 'given', NULL, 'not_recommended', NULL, false FROM orders WHERE o_orderkey % 3 = 0)
SELECT o_orderkey, list, row_number() OVER (PARTITION BY o_orderkey, list ORDER BY CASE WHEN list = 'target' THEN -score END, i) - 1 AS place, name,
  CAST(CASE WHEN list = 'target' THEN score END AS DOUBLE) AS match_score,
  CASE WHEN list <> 'target' THEN NULL WHEN torn OR i <> 1 THEN 'Tier 2' WHEN score >= 0.75 THEN 'Tier 1' WHEN score >= 0.5 THEN 'Tier 2' ELSE 'Not Recommended' END AS tier,
  CASE WHEN list = 'not_recommended' OR list = 'target' AND torn THEN p END AS note FROM c""")
def scout_company_lists(spark, sf):
    companies = " || ', ' || ".join(_COMPANY.format(i=i) for i in range(3))
    o = table(spark, sf, "orders").selectExpr(
        "o_orderkey", f"'{{\"target_companies\": [' || {companies} || '], \"not_recommended\": [' || {_GIVEN} || ']}}' AS answer")
    return answer_tables.company_lists(o, "o_orderkey", "answer")


@query("agent_sources", """
SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN '' WHEN length(text) % 3 = 1 THEN 'https://' || role || '.org/' || turn ||
  '|' || role ELSE role END AS sources FROM conversations""")
def agent_sources(spark, sf):
    c = table(spark, sf, "conversations").selectExpr("conv_id", "turn", r"""CASE WHEN length(text) % 3 = 0 THEN '- ' || text ELSE
      'HALLUCINATION_DETECTED: NO\nsources: \n' || CASE WHEN length(text) % 3 = 1 THEN ' https://' || role || '.org/' || turn || '\n' ELSE '' END ||
      '• ' || role || ' \nnot a source\nExplanation: as said\n- later' END AS answer""")
    return c.select("conv_id", "turn", F.array_join(answer_tables.cited_sources(F.col("answer")), "|").alias("sources"))


@query("claim_sources", """
SELECT conv_id, turn, CASE WHEN length(text) % 3 < 2 THEN role || '|' || turn WHEN length(text) % 2 = 0 THEN '' END AS sources FROM conversations""")
def claim_sources(spark, sf):
    """Whole answers, answers cut off inside the list, and answers without any."""
    c = table(spark, sf, "conversations").selectExpr("conv_id", "turn", """CASE WHEN length(text) % 3 = 2 AND length(text) % 2 = 0 THEN '"sources": []'
      WHEN length(text) % 3 = 2 THEN 'none' ELSE '{"verification_result": "TRUE", "sources": ["' || role || '", "' || turn
      || CASE WHEN length(text) % 3 = 0 THEN '"]}' ELSE '' END END AS answer""")
    return c.select("conv_id", "turn", F.array_join(answer_tables.claim_sources(F.col("answer")), "|").alias("sources"))


@query("chinese_texts", """
SELECT doc_id, coalesce(length(regexp_replace(text, '[^一-鿿]', '', 'g')) / nullif(length(regexp_replace(text, '\\s|　| ', '', 'g')), 0)::DOUBLE > 0.1, false)
  AS chinese FROM documents""")
def chinese_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", answer_tables.is_chinese(F.col("text")).alias("chinese"))
