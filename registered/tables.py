"""Verdict tables, summaries, dialogs, record shapes and windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from grainsieve.operators import sentences, text_rules  # noqa: F401
from grainsieve.plans import summary as SM
from grainsieve.plans.evaluate import (DETAILS, STATUS, Check, Retention, bad_rows, evaluate, flags, good_rows,
                                       merge_partials)
from grainsieve.registry import Verdict, rule
from grainsieve.schema import strings
from grainsieve.sources import dialogs, readers, shared
from grainsieve.streaming import running, state

from . import query, spread, table
from .rules import DOCUMENTS, rule_sql, text_group, text_members

SMALL = ["RuleColonEnd", "RuleContentShort", "RuleNoPunc", "RuleSentenceNumber", "RuleCharNumber", "RuleStopWord"]


def docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def checked(spark, sf, rules=tuple(SMALL), kept=Retention()):
    return evaluate(docs(spark, sf), [Check.of({"content": "text"}, rules)], kept)


def union_sql(rules) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, status, label FROM ({rule_sql(n, DOCUMENTS)})" for n in rules)


_ALL = f"WITH a AS ({union_sql(SMALL)}), r AS (SELECT doc_id, bool_or(status) AS bad FROM a GROUP BY doc_id) "


@query("verdict_status", _ALL + "SELECT doc_id, bad AS eval_status FROM r")
def verdict_status(spark, sf):
    return checked(spark, sf).select("doc_id", "eval_status")


@query("verdict_bad_rows", _ALL + "SELECT doc_id FROM r WHERE bad")
def verdict_bad_rows(spark, sf):
    return bad_rows(checked(spark, sf)).select("doc_id")


@query("verdict_good_rows", _ALL + "SELECT doc_id FROM r WHERE NOT bad")
def verdict_good_rows(spark, sf):
    return good_rows(checked(spark, sf)).select("doc_id")


def _kept(v):
    d = v.select("doc_id", F.explode("eval_details").alias("field_key", "ds"))
    d = d.select("doc_id", "field_key", F.explode("ds").alias("d"))
    return d.select("doc_id", "field_key", "d.metric", "d.status", F.array_join("d.label", "|").alias("label"))


_KEPT = "SELECT doc_id, 'text' AS field_key, rule AS metric, status, label FROM a JOIN r USING (doc_id) WHERE "


@query("retention_default", _ALL + _KEPT + "bad AND status")
def retention_default(spark, sf):
    return _kept(checked(spark, sf))


@query("retention_good", _ALL + _KEPT + "bad = status")
def retention_good(spark, sf):
    return _kept(checked(spark, sf, kept=Retention(good=True)))


@query("retention_all_labels", _ALL + _KEPT + "true")
def retention_all_labels(spark, sf):
    return _kept(checked(spark, sf, kept=Retention(all_labels=True)))


@query("summary_totals", _ALL + "SELECT count(*) AS total, count(*) FILTER (WHERE NOT bad) AS num_good, count(*) FILTER (WHERE bad) AS num_bad, "
       "round(count(*) FILTER (WHERE NOT bad) / count(*)::DOUBLE * 100, 2) AS score FROM r")
def summary_totals(spark, sf):
    return SM.totals(checked(spark, sf))


@query("summary_label_ratios", _ALL + "SELECT 'text' AS field_key, label, count(DISTINCT doc_id) AS n, "
       "round(count(DISTINCT doc_id) / (SELECT count(*) FROM r)::DOUBLE, 6) AS ratio FROM a JOIN r USING (doc_id) "
       "WHERE bad = status AND label IS NOT NULL GROUP BY label")
def summary_label_ratios(spark, sf):
    return SM.label_ratios(checked(spark, sf, kept=Retention(good=True)))


@query("summary_pretrain_ratios", f"WITH a AS ({union_sql(text_members('pretrain')[0])}) SELECT label, count(*) AS n "
       "FROM a WHERE status GROUP BY label")
def summary_pretrain_ratios(spark, sf):
    return SM.label_counts(evaluate(docs(spark, sf), [text_group("pretrain")])).select("label", "n")


def _scored(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.struct(F.col("p_name").alias("standard"), F.when(
        F.col("p_size") % 2 == 1, F.upper("p_name")).otherwise("").alias("produced")).alias("meta"))
    return evaluate(p, [Check.of({"metadata": "meta"}, ["RuleMetadataSimilarity"])], Retention(all_labels=True))


@query("summary_score_stats", "SELECT 'meta' AS field_key, 'RuleMetadataSimilarity' AS metric, round(avg(s), 2) AS score_average, count(*) AS score_count, "
       "min(s) AS score_min, max(s) AS score_max, round(stddev_pop(s), 2) AS score_std_dev FROM (SELECT (p_size % 2)::DOUBLE AS s FROM part)")
def summary_score_stats(spark, sf):
    return SM.score_stats(_scored(spark, sf))


@query("summary_overall", "SELECT 'meta' AS field_key, round(avg((p_size % 2)::DOUBLE), 2) AS overall_average, 1::BIGINT AS metrics FROM part")
def summary_overall(spark, sf):
    return SM.overall(SM.score_stats(_scored(spark, sf)))


SUMMARY_ROW_SQL = _ALL + """, t AS (SELECT count(*) AS total, count(*) FILTER (WHERE NOT bad) AS num_good, count(*) FILTER (WHERE bad) AS num_bad FROM r),
l AS (SELECT label, round(count(DISTINCT doc_id) / (SELECT total FROM t)::DOUBLE, 6) AS ratio FROM a WHERE status GROUP BY label)
SELECT 'small' AS task_name, round(num_good / total::DOUBLE * 100, 2) AS score, num_good, num_bad, total,
 (SELECT string_agg(label || '=' || printf('%.6f', ratio), ',' ORDER BY label) FROM l) AS type_ratio FROM t"""


@query("summary_row", SUMMARY_ROW_SQL)
def summary_row(spark, sf):
    return _flat(SM.summary_row(checked(spark, sf), "small"))


def _flat(row):
    # maps as text, which SQL can write too
    labels = F.array_sort(F.map_entries(F.col("type_ratio")["text"]))
    return row.select("task_name", "score", "num_good", "num_bad", "total", F.array_join(F.transform(
        labels, lambda e: F.format_string("%s=%.6f", e["key"], e["value"])), ",").alias("type_ratio"))


@query("confusion_matrix", _ALL + """, j AS (SELECT bad, quality = 1 AS good FROM r JOIN labels USING (doc_id)),
c AS (SELECT count(*) FILTER (WHERE NOT bad AND good) AS tp, count(*) FILTER (WHERE NOT bad AND NOT good) AS fp,
 count(*) FILTER (WHERE bad AND NOT good) AS tn, count(*) FILTER (WHERE bad AND good) AS fn FROM j),
m AS (SELECT *, tp / (tp + fp)::DOUBLE AS accuracy, tp / (tp + fn)::DOUBLE AS recall FROM c)
SELECT *, (accuracy + recall) / 2 AS f1_arithmetic, 2 * accuracy * recall / (accuracy + recall) AS f1_harmonic FROM m""")
def confusion_matrix(spark, sf):
    return SM.confusion(checked(spark, sf), table(spark, sf, "labels"), "doc_id", F.col("quality") == 1)


@query("merge_partial_verdicts", _ALL + "SELECT doc_id, bad AS eval_status, count(*) FILTER (WHERE status) AS kept FROM a JOIN r USING (doc_id) GROUP BY ALL")
def merge_partial_verdicts(spark, sf):
    parts = [checked(spark, sf, SMALL[:3]), checked(spark, sf, SMALL[3:])]
    m = merge_partials(parts, "doc_id")
    return m.select("doc_id", "eval_status", F.coalesce(F.size(F.col("eval_details")["text"]), F.lit(0)).cast("long").alias("kept"))


@query("config_override", f"SELECT a.doc_id, a.status AS strict, b.m < 500 AS loose FROM ({rule_sql('RuleCharNumber')}) a JOIN "
       f"(SELECT doc_id, measure AS m FROM ({rule_sql('RuleCharNumber')})) b USING (doc_id)")
def config_override(spark, sf):
    v = evaluate(docs(spark, sf), [Check.of({"content": "text"}, ["RuleCharNumber", {"name": "RuleCharNumber", "config": {"threshold": 500}}])],
                 Retention(all_labels=True))
    d = F.col("eval_details")["text"]
    return v.select("doc_id", d[0]["status"].alias("strict"), d[1]["status"].alias("loose"))


@query("multi_column_checks", "SELECT c_custkey, c_name = '' OR c_mktsegment = '' OR strlen(c_name) <= 18 AS eval_status FROM customer")
def multi_column_checks(spark, sf):
    c = table(spark, sf, "customer")
    v = evaluate(c, [Check.of({"content": "c_name"}, ["RuleContentNull", "RuleContentShort"], RuleContentShort={"threshold": 18}),
                     Check.of({"content": "c_mktsegment"}, ["RuleContentNull"])])
    return v.select("c_custkey", "eval_status")


@rule("CustomShoutRule", "QUALITY_BAD_CUSTOM")
def shout(f, cfg):
    return Verdict(F.upper(f.content) == f.content, strings("all capitals"))


@query("custom_rule", "SELECT o_orderkey, true AS status, 'QUALITY_BAD_CUSTOM.CustomShoutRule' AS label FROM orders WHERE upper(o_orderpriority) = o_orderpriority")
def custom_rule(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    v = bad_rows(evaluate(o, [Check.of({"content": "o_orderpriority"}, ["CustomShoutRule"])]))
    d = F.col("eval_details")["o_orderpriority"][0]
    return v.select("o_orderkey", d["status"].alias("status"), d["label"][0].alias("label"))


# --- sources -------------------------------------------------------------------------------

@query("dialog_flatten", """SELECT conv_id, string_agg('user: ' || CASE WHEN role = 'assistant' THEN '' ELSE text END || chr(10) || chr(10) ||
 'assistant: ' || CASE WHEN role = 'assistant' THEN text ELSE '' END, chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id""")
def dialog_flatten(spark, sf):
    return dialogs.dialogs_from_turns(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query("dialog_flatten_lists", """SELECT conv_id, string_agg('user: ' || CASE WHEN role = 'assistant' THEN '' ELSE text END || chr(10) || chr(10) ||
 'assistant: ' || CASE WHEN role = 'assistant' THEN text ELSE '' END, chr(10) || chr(10) ORDER BY turn) AS messages FROM conversations GROUP BY conv_id""")
def dialog_flatten_lists(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return dialogs.flatten_dialog(c)


@query("source_parquet_columns", "SELECT doc_id, lang FROM documents")
def source_parquet_columns(spark, sf):
    return readers.read(spark, f"{sf}/documents.parquet", "parquet", columns=["doc_id", "lang"])


@query("source_sql", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0")
def source_sql(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("__customer")
    return readers.read(spark, "SELECT c_custkey, c_name FROM __customer WHERE c_acctbal > 0", "sql")


@query("source_row_range", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 400 OFFSET 100")
def source_row_range(spark, sf):
    return readers.row_range(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 500)


@query("source_fingerprint")
def source_fingerprint(spark, sf):
    return readers.fingerprint(table(spark, sf, "documents"))


def _shape_sql(name: str, keys: list[str]) -> str:
    ok = " AND ".join(f"list_contains(json_keys(j), '{k}')" for k in keys)
    return ("SELECT event_id, NOT (" + ok + ") AS status FROM (SELECT event_id, " + SHAPED + " AS j FROM events)")


SHAPED = ("CASE event_type WHEN 'click' THEN '{\"id\": 1, \"audio\": \"a\", \"text\": \"t\"}' WHEN 'view' THEN '{\"id\": 1, \"video\": \"v\", \"text\": \"t\"}' "
          "WHEN 'error' THEN '{\"img_id\": 1, \"image\": \"i\"}' WHEN 'purchase' THEN '{\"track_id\": 1, \"content\": \"c\"}' "
          "ELSE '{\"track_id\": 1, \"type\": \"t\", \"prompt\": \"p\", \"completion\": \"c\"}' END")


def _register_shape(name: str, keys: list[str]) -> None:
    @query("shape_" + name[4:].replace("DataFormat", "").lower(), _shape_sql(name, keys))
    def run(spark, sf):
        e = table(spark, sf, "events").selectExpr("event_id", f"{SHAPED} AS raw")
        return flags(e, [Check.of({"raw": "raw"}, [name])], ["event_id"]).withColumnRenamed(name, "status")


from grainsieve.functions.fixed import RECORD_SHAPES  # noqa: E402

for _n, (_keys, _) in RECORD_SHAPES.items():
    _register_shape(_n, _keys)


# --- windows -------------------------------------------------------------------------------

@query("windowed_quality", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS total,
 count(*) FILTER (WHERE value > 10) AS num_bad, count(*) FILTER (WHERE value > 10) / count(*)::DOUBLE AS bad_ratio FROM events GROUP BY ALL""")
def windowed_quality(spark, sf):
    return running.windowed_quality(table(spark, sf, "events"), "ts", F.col("value") > 10, "1 hour", by=("event_type",))


@query("running_label_counts", f"WITH a AS ({union_sql(SMALL[:2])}) SELECT 'text' AS field_key, label, count(DISTINCT doc_id) AS n FROM a "
       "WHERE status GROUP BY label")
def running_label_counts(spark, sf):
    return _running(spark, sf, "running_label_counts", SMALL[:2]).where("kind = 'label'").select("field_key", F.col("name").alias("label"), "n")


def _running(spark, sf, name, rules):
    """The state of a summary after a stream over the documents."""
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{sf}/documents.parquet*")
    home = f"{shared.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    handle = state.running_summary([Check.of({"content": "text"}, rules)], f"{home}/state")
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True)
    writer.start().awaitTermination()
    return state.current_tally(spark, f"{home}/state")


@query("running_summary", SUMMARY_ROW_SQL)
def running_summary(spark, sf):
    return _flat(SM.summary_of(_running(spark, sf, "running_summary", SMALL), "small"))


@query("running_score_moments", """
SELECT 'score' AS kind, event_type, 'text' AS field_key, 'RuleCharNumber' AS name, count(*) AS n, round(avg(m), 6) AS mean, min(m) AS low, max(m) AS high,
  round(stddev_pop(m), 6) AS dev FROM (SELECT event_type, length(props)::DOUBLE AS m FROM events) GROUP BY event_type""")
def running_score_moments(spark, sf):
    """Scores merged over batches of a stream, by the type of the event: two streams over halves of the table, one after the other."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", F.length("props").cast("double").alias("m"))
    scored = lambda rows: state.moments(SM.tally(rows.select("event_type", F.lit(False).alias(STATUS), F.create_map(F.lit("text"), F.array(F.struct(
        F.lit("RuleCharNumber").alias("metric"), F.lit(False).alias("status"), F.col("m").alias("score"), F.lit(None).cast("array<string>").alias("label"),
        F.lit(None).cast("array<string>").alias("reason")))).alias(DETAILS)), "event_type"), "event_type")
    both = state.merged(scored(e.where("event_id % 3 = 0")), scored(e.where("event_id % 3 <> 0")), "event_type")
    return both.where("kind = 'score'").select("kind", "event_type", "field_key", "name", "n", F.round("mean", 6).alias("mean"), "low", "high",
                                              F.round(F.sqrt(F.col("squares") / F.col("score_count")), 6).alias("dev"))


# --- sentences -----------------------------------------------------------------------------

@query("learned_abbreviations", r"""
WITH w AS (SELECT lower(regexp_extract(p, '^[^\p{L}\p{N}]*(\p{L}+(?:\.\p{L}+)*)(\.?)[^\p{L}\p{N}.]*$', 1)) AS word,
  regexp_extract(p, '^[^\p{L}\p{N}]*(\p{L}+(?:\.\p{L}+)*)(\.?)[^\p{L}\p{N}.]*$', 2) = '.' AS stop FROM (SELECT unnest(string_split_regex(text, '\s+')) AS p FROM documents)),
c AS (SELECT word, count(*) FILTER (stop) AS k, count(*) AS n, length(replace(word, '.', '')) AS l FROM w WHERE word <> '' GROUP BY word),
p AS (SELECT sum(k) / sum(n) AS base FROM c),
s AS (SELECT word, k AS with_stop, n - k AS without, -2 * (k * ln(base) + (n - k) * ln(1 - base) - k * ln(0.99::DOUBLE) - (n - k) * ln(1 - 0.99::DOUBLE))
  * exp(-l) * (length(word) - l + 1) * pow(l::DOUBLE, -(n - k)) AS score FROM c, p WHERE k > 0)
SELECT word, with_stop, without, round(score, 6) AS score FROM s WHERE score >= 0.000001""")
def learned_abbreviations(spark, sf):
    return sentences.learn_abbreviations(docs(spark, sf), least=1e-6, most=1_000_000).withColumn("score", F.round("score", 6))


@query("sentence_counts", r"""
-- each twice, as a match takes the sign behind it
WITH h AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(^|[^\p{L}\p{N}.])(the|and|de|der|la)\.(\s+\S)', '\1\2@@\3', 'gi'), '(^|[^\p{L}\p{N}.])(the|and|de|der|la)\.(\s+\S)', '\1\2@@\3', 'gi') AS t FROM documents),
m AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(t, '([.!?…。！？]+["''”’)\]]*)\s+([^\p{Ll}\s])', E'\\1\n\n\\2', 'g'), '([.!?…。！？]+["''”’)\]]*)\s+([^\p{Ll}\s])', E'\\1\n\n\\2', 'g'), E'\n\n') AS xs FROM h)
SELECT doc_id, len(list_filter(xs, lambda x: trim(x, E' \t\n\r\f\v') <> '')) AS sentences FROM m""")
def sentence_counts(spark, sf):
    known = ("the", "and", "de", "der", "la")
    return docs(spark, sf).select("doc_id", F.size(sentences.sentences_of(F.col("text"), known)).cast("long").alias("sentences"))
