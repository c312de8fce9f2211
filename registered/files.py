"""Tables written as files of each format and read back, results written by label and in one folder, and a judge of the user's own."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from grainsieve import Check, Retention, evaluate, judge, schema
from grainsieve.plans.evaluate import with_result
from grainsieve.sources import readers, shared, writers

from . import query, table
from .tables import _ALL, checked


def _path(spark, name: str) -> str:
    return f"{shared.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "source")


FIELDS = "doc_id long, text string, source string"
SAME = "SELECT doc_id, text, source FROM documents"


@query("source_json_lines", SAME)
def source_json_lines(spark, sf):
    path = _path(spark, "jsonl")
    _documents(spark, sf).write.json(path)
    return readers.read(spark, path, "jsonl", schema=FIELDS)


@query("source_json_lines_gzip", "SELECT doc_id, n_chars FROM documents")
def source_json_lines_gzip(spark, sf):
    """Packed files, columns inferred."""
    path = _path(spark, "jsonlgz")
    table(spark, sf, "documents").write.option("compression", "gzip").json(path)
    return readers.read(spark, path, "jsonl").select("doc_id", "n_chars")


@query("source_plain_text", "SELECT line AS content, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line")
def source_plain_text(spark, sf):
    path = _path(spark, "plain")
    _documents(spark, sf).where("text is not null").select("text").write.text(path)
    return readers.read(spark, path, "plaintext").groupBy("content").agg(F.count(F.lit(1)).alias("n"))


@query("source_plain_text_gzip", "SELECT c_comment AS content FROM (SELECT c_name || ' ' || c_mktsegment AS c_comment FROM customer)")
def source_plain_text_gzip(spark, sf):
    path = _path(spark, "plaingz")
    table(spark, sf, "customer").select(F.concat_ws(" ", "c_name", "c_mktsegment")).write.option("compression", "gzip").text(path)
    return readers.read(spark, path, "plaintext")


@query("source_folder", "SELECT doc_id, n_chars FROM documents")
def source_folder(spark, sf):
    """Files of folders within folders."""
    path = _path(spark, "folders")
    table(spark, sf, "documents").write.partitionBy("lang", "source").json(path)
    return readers.read(spark, path, "jsonl", schema="doc_id long, n_chars long", recursive=True)


@query("source_csv", r"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, regexp_replace(coalesce(text, ''), '^[\s]+|[\s]+$', '', 'g') AS text, source FROM documents""")
def source_csv(spark, sf):
    """Cells with quotes, commas and line breaks, read by ranges."""
    path = _path(spark, "csv")
    _documents(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    return readers.read(spark, path, "csv")


def _document_files(rows: DataFrame, opening: str, closing: str, path: str) -> None:
    """Every partition of the lines `value` as one JSON document, its records parted by commas."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = opening
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                lines = [lead + lines[0], *("," + x for x in lines[1:])]
                lead = ","
            yield pa.RecordBatch.from_pydict({"value": lines}, pa.schema([("value", pa.string())]))
        yield pa.RecordBatch.from_pydict({"value": [closing if lead == "," else opening + closing]}, pa.schema([("value", pa.string())]))

    rows.mapInArrow(run, "value string").write.text(path)


@query("source_json_list", SAME)
def source_json_list(spark, sf):
    path = _path(spark, "jsonlist")
    _document_files(_documents(spark, sf).select(F.to_json(F.struct("doc_id", "text", "source")).alias("value")), "[", "]", path)
    return readers.read(spark, path, "listjson", schema=FIELDS)


@query("source_json_map", "SELECT doc_id, source, text FROM documents")
def source_json_map(spark, sf):
    """Records under their keys, columns inferred."""
    path = _path(spark, "jsonmap")
    rows = _documents(spark, sf).select(F.concat(F.lit('"d'), "doc_id", F.lit('": '), F.to_json(F.struct("doc_id", "text", "source"))).alias("value"))
    _document_files(rows, "{", "}", path)
    return readers.read(spark, path, "json").select("doc_id", "source", "text")


# --- results -------------------------------------------------------------------------------

_BY_LABEL = _ALL + """SELECT doc_id, 'text' AS field, split_part(label, '.', 1) AS label_type, coalesce(nullif(substr(label, length(split_part(label, '.', 1)) + 2), ''), '') AS label_name
 FROM (SELECT DISTINCT doc_id, label FROM a JOIN r USING (doc_id) WHERE """


@query("results_by_label", _BY_LABEL + "bad AND status)")
def results_by_label(spark, sf):
    path, kept, v = _path(spark, "results"), Retention(), checked(spark, sf)
    writers.write_results(v, path, kept)
    return writers.read_results(spark, path, bad=True, record=writers.record_type(v, kept)).select("record.raw_data.doc_id", "field", "label_type", "label_name")


@query("results_by_label_raw", _BY_LABEL + "bad)")
def results_by_label_raw(spark, sf):
    """All labels, records as they came with their result."""
    path, kept = _path(spark, "resultsraw"), Retention(all_labels=True, raw=True)
    v = checked(spark, sf, kept=kept)
    writers.write_results(v, path, kept)
    return writers.read_results(spark, path, bad=True, raw=True, record=writers.record_type(v, kept)).select("record.doc_id", "field", "label_type", "label_name")


@query("results_merged", _ALL + "SELECT doc_id, any_value(bad) AS bad, count(*) AS verdicts FROM a JOIN r USING (doc_id) GROUP BY doc_id")
def results_merged(spark, sf):
    path, kept = _path(spark, "resultsmerged"), Retention(merge=True)
    writers.write_results(checked(spark, sf, kept=kept), path, kept)
    got = spark.read.json(f"{path}/all_results")
    return got.select("doc_id", F.col("result.eval_status").alias("bad"), F.size("result.eval_details.text").cast("long").alias("verdicts"))


@query("verdict_with_result", _ALL + "SELECT doc_id, text, bad FROM r JOIN documents USING (doc_id)")
def verdict_with_result(spark, sf):
    """The columns as they came and one of results."""
    return with_result(checked(spark, sf)).select("doc_id", "text", F.col("result.eval_status").alias("bad"))


# --- a judge of one's own ------------------------------------------------------------------

@judge("CustomToneJudge", "Name the tone of this text.\nAnswer with one word and nothing else.\n\n{content}")
def tone(name, answer, row, cfg):
    bad = F.coalesce(answer != "calm", F.lit(True))
    return schema.detail(name, bad, F.when(bad, schema.strings(F.concat(F.lit("QUALITY_BAD_TONE."), F.coalesce(answer, F.lit("none")))))
                         .otherwise(schema.strings(schema.GOOD)), schema.strings(answer))


@query("custom_judge", """SELECT doc_id, n_chars % 3 > 0 AS status, CASE n_chars % 3 WHEN 0 THEN 'QUALITY_GOOD' WHEN 1 THEN 'QUALITY_BAD_TONE.harsh'
 ELSE 'QUALITY_BAD_TONE.none' END AS label FROM documents""")
def custom_judge(spark, sf):
    """Stored answers; a third of the documents has none."""
    d = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    answers = d.where("n_chars % 3 < 2").select("doc_id", F.lit("CustomToneJudge").alias("metric"), F.when(
        F.col("n_chars") % 3 == 0, "calm").otherwise("harsh").alias("response"))
    v = evaluate(d, [Check.of({"content": "text"}, ["CustomToneJudge"])], Retention(all_labels=True), id_col="doc_id", responses=answers)
    one = F.col("eval_details")["text"][0]
    return v.select("doc_id", one["status"].alias("status"), one["label"][0].alias("label"))
