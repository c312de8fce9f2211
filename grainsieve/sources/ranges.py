"""CSV files with quoted line breaks, and JSON documents of many records, read by many tasks.

Whether a line begins a record depends on how many quote signs stand before it in its file. Each range of a file counts
its own; a prefix sum over the ranges, one row each, tells every range whether it begins inside quotes and how many records
began before. Lines that are whole records never move; only those of records that span lines are brought together.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .shared import shared_dir, written

LINES = "line string, file string, block long, n long, odd boolean, odd_after boolean, even_starts long, odd_starts long"


def _decoded(raw: pa.Array, encoding: str = "utf-8") -> pa.Array:
    if codecs.lookup(encoding).name in ("utf-8", "utf-8-sig"):
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            encoding = "utf-8"
    return pa.array([b.decode(encoding, "replace") for b in raw.to_pylist()], pa.string())


def _ranges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """The rows by file and range (columns 1 and 2), which follow each other in a task, and whether a range begins."""
    held = None
    for whole in batches:
        if not whole.num_rows:
            continue
        files, blocks = whole.column(1), whole.column(2)
        new = np.flatnonzero(np.concatenate([[True], pc.or_(
            pc.not_equal(files[1:], files[:-1]), pc.not_equal(blocks[1:], blocks[:-1])).to_numpy(zero_copy_only=False)]))
        for at, to in zip(new, [*new[1:], whole.num_rows]):
            part = whole.slice(at, to - at)
            own = (part.column(1)[0].as_py(), part.column(2)[0].as_py())
            yield own != held, part
            held = own


def _lines(spark: SparkSession, path: str, quote: str, recursive: bool, encoding: str = "utf-8") -> DataFrame:
    """Every line with its file and range, its number in the range, whether an odd number of quotes stands before and behind
    it within the range, and how many records begin up to it if the range begins outside or inside quotes."""
    text = (spark.read.option("recursiveFileLookup", str(recursive).lower()).option("lineSep", "\n").text(path)
            .select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [0, 0, 0, 0]
        for begins, part in _ranges_of(batches):
            if begins:
                state = [0, 0, 0, 0]
            text_ = _decoded(part.column(0), encoding)
            quotes = pc.count_substring(text_, quote).to_numpy(zero_copy_only=False).astype(np.int64)
            after = state[0] + np.cumsum(quotes)
            odd, n = (after - quotes) % 2 == 1, len(after)
            even_starts, odd_starts = state[2] + np.cumsum(~odd), state[3] + np.cumsum(odd)
            yield pa.RecordBatch.from_arrays(
                [text_, *part.columns[1:], pa.array(state[1] + np.arange(n)), pa.array(odd), pa.array(after % 2 == 1), pa.array(even_starts),
                 pa.array(odd_starts)], names=["line", "file", "block", "n", "odd", "odd_after", "even_starts", "odd_starts"])
            state = [int(after[-1]), state[1] + n, int(even_starts[-1]), int(odd_starts[-1])]

    return text.mapInArrow(run, LINES)


def csv_records(spark: SparkSession, path: str, quote: str = '"', recursive: bool = False, encoding: str = "utf-8") -> DataFrame:
    """file, record (its number in the file, from 1) and text of each record of CSV files.

    Any encoding will do in which line ends and quote signs are the bytes that they are in ASCII.

    Quote signs count wherever they stand, so a lone one inside an unquoted cell opens quotes. A file that ends inside
    quotes has the rest as its last record.
    """
    lines = _lines(spark, path, quote, recursive, encoding)
    # the last line of a range has its counts: a row for each range
    ends = written(lines.groupBy("file", "block").agg(F.max_by(F.struct("odd_after", "even_starts", "odd_starts"), "n").alias("end"))
                   .select("file", "block", "end.*"), "csvranges")
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("odd_after").cast("int")).over(earlier), F.lit(0)) % 2 == 1
    placed = ends.withColumn("inside", inside).withColumn("starts", F.when(F.col("inside"), F.col("odd_starts")).otherwise(F.col("even_starts")))
    ranges = written(placed.select("file", "block", "inside", F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("before")), "csvranges")
    joined = lines.join(ranges, ["file", "block"]).select(
        "file", "block", "n", "line", (F.col("odd") == F.col("inside")).alias("begins"), (F.col("odd_after") == F.col("inside")).alias("ends"),
        (F.col("before") + F.when(F.col("inside"), F.col("odd_starts")).otherwise(F.col("even_starts"))).alias("record"))
    one = joined.where("begins and ends").select("file", "record", F.col("line").alias("text"))
    many = (joined.where("not (begins and ends)").groupBy("file", "record")
            .agg(F.array_sort(F.collect_list(F.struct("block", "n", "line"))).alias("parts"))
            .select("file", "record", F.array_join(F.col("parts.line"), "\n").alias("text")))
    return one.unionByName(many).withColumn("text", F.regexp_replace("text", "\r$", ""))


def read_csv_ranges(spark: SparkSession, path: str, has_header: bool = True, delimiter: str = ",", quote: str = '"',
                    columns: list[str] | None = None, recursive: bool = False, encoding: str = "utf-8") -> DataFrame:
    """The cells of CSV files as strings, one row a record, whatever number of tasks a file is read by."""
    records = csv_records(spark, path, quote, recursive, encoding).where("trim(text) <> ''")
    first = records.groupBy("file").agg(F.min_by("text", "record").alias("text"), F.min("record").alias("record"))  # one row a file
    head = first.orderBy("file").limit(1).collect()
    if not head:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns) if columns else "value string")
    cells = next(csv.reader(io.StringIO(head[0].text.lstrip("\ufeff")), delimiter=delimiter, quotechar=quote))
    names = cells if has_header else columns or [f"column_{i}" for i in range(len(cells))]
    if has_header:
        records = records.join(first.select("file", "record"), ["file", "record"], "left_anti")
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    options = {"sep": delimiter, "quote": quote, "escape": quote, "mode": "PERMISSIVE"}
    parsed = records.select(F.from_csv("text", schema, options).alias("r")).select("r.*")
    return parsed.toDF(*names)


# --- JSON documents ------------------------------------------------------------------------

PIECES = "piece string, file string, block long, n long, odd boolean, odd_after boolean, even_depth long, odd_depth long, even_last long, odd_last long"
_ESCAPED = re.compile(r"\\.", re.S)


def _depths(piece: str) -> tuple[int, int, int]:
    """Quote signs of a piece, and the levels it opens less those it closes outside of strings, if it begins outside of one
    and if it begins inside."""
    parts = _ESCAPED.sub("", piece).split('"')
    gain = [sum(p.count("{") + p.count("[") - p.count("]") for p in parts[i::2]) for i in (0, 1)]
    return len(parts) - 1, gain[0], gain[1]


def _json_pieces(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    """The document cut behind every closing brace. Of each piece, whether an odd number of quote signs stands before and
    behind it within its range, how deep it ends (brace left out) counted from the begin of the range, and how deep it began,
    each if the range begins outside or inside a string."""
    text = (spark.read.option("recursiveFileLookup", str(recursive).lower()).option("lineSep", "}").text(path)
            .select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes = n = 0
        depth = [0, 0]
        for begins, part in _ranges_of(batches):
            if begins:
                quotes = n = 0
                depth = [0, 0]
            pieces, out = _decoded(part.column(0)), []
            for piece in pieces.to_pylist():
                more, outside, inside = _depths(piece)
                odd, start = quotes % 2, tuple(depth)
                quotes += more
                for h in (0, 1):  # the range begins outside, inside
                    depth[h] += inside if (odd + h) % 2 else outside
                end = tuple(depth)
                for h in (0, 1):  # the brace behind the piece closes a level unless it lies in a string
                    depth[h] -= (quotes + h) % 2 == 0
                out.append((n, odd == 1, quotes % 2 == 1, *end, *start))
                n += 1
            columns = [pa.array(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([pieces, *part.columns[1:], *columns], names=[c.split()[0] for c in PIECES.split(", ")])

    return text.mapInArrow(run, PIECES)


def json_records(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """file, block, n and text of each object that is an element of a document's list, or a value of its map, one document a file.

    Depth and quotes are counted in each range for itself, for a begin inside and outside of a string; prefix sums over
    the ranges, one row each, tell which one holds. Objects without objects in them never move; the pieces of the others are
    brought together by the place where they begin. Elements that are no objects are no records; lists among them must hold
    no objects.
    """
    pieces = _json_pieces(spark, path, recursive)
    ends = written(pieces.groupBy("file", "block").agg(F.max_by(F.struct("odd_after", "even_depth", "odd_depth"), "n").alias("end"))
                   .select("file", "block", "end.*"), "jsonranges")
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("odd_after").cast("int")).over(earlier), F.lit(0)) % 2 == 1
    # the brace behind the last piece of a range belongs to it
    gain = F.when(F.col("inside"), F.col("odd_depth")).otherwise(F.col("even_depth")) - (F.col("odd_after") == F.col("inside")).cast("int")
    ranges = written(ends.withColumn("inside", inside).withColumn("gain", gain).select(
        "file", "block", "inside", F.coalesce(F.sum("gain").over(earlier), F.lit(0)).alias("depth")), "jsonranges")
    own = lambda c: F.when(F.col("inside"), F.col("odd_" + c)).otherwise(F.col("even_" + c)) + F.col("depth")
    placed = pieces.join(ranges, ["file", "block"]).select(
        "file", "block", "n", "piece", ((F.col("odd") == F.col("inside")) & (own("last") <= 1)).alias("begins"),
        ((F.col("odd_after") == F.col("inside")) & (own("depth") == 2)).alias("ends"), (own("depth") >= 2).alias("deep"))
    one = placed.where("begins and ends").select("file", "block", "n", F.concat("piece", F.lit("}")).alias("text"))
    parts = written(placed.where("not (begins and ends)"), "jsonpieces")
    place = F.struct("block", "n")
    here = F.max(F.when(F.col("begins"), place)).over(W.partitionBy("file", "block").orderBy("n"))  # rows of one range
    last = parts.groupBy("file", "block").agg(F.max(F.when(F.col("begins"), place)).alias("last"))
    before = last.select("file", "block", F.max("last").over(earlier).alias("before"))
    many = (parts.withColumn("first", here).join(before, ["file", "block"]).withColumn("first", F.coalesce("first", "before"))
            .groupBy("file", "first").agg(F.array_sort(F.collect_list(F.struct("block", "n", "piece"))).alias("parts"), F.bool_or("ends").alias("whole"))
            .where("whole").select("file", "first.block", "first.n", F.concat(F.array_join(F.col("parts.piece"), "}"), F.lit("}")).alias("text")))
    # before the record stand the opening sign of the document, elements that are no objects, and its key
    opened = F.when((F.col("block") == 0) & (F.col("n") == 0), F.regexp_replace("text", r"^[\s\x{FEFF}]*[\[{]", "")).otherwise(F.col("text"))
    lead = r'^(?:[\s,:\[\]]|"(?:[^"\\]|\\.)*+"|[-+.\w]+)*+(?=\{)'
    return one.unionByName(many).withColumn("text", F.regexp_replace(opened, lead, ""))


def read_json_records(spark: SparkSession, path: str, schema: str | None = None, recursive: bool = False) -> DataFrame:
    """The records of JSON documents as rows; without a schema it is inferred from all of them."""
    where = f"{shared_dir(spark)}/jsonrecords-{uuid.uuid4().hex}"
    # line ends stand between the signs of a record only, strings hold them escaped
    json_records(spark, path, recursive).select(F.translate("text", "\r\n", "  ").alias("value")).write.text(where)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(where)
