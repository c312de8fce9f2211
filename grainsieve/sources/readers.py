"""Readers for the supported inputs; every one returns a lazy DataFrame."""

from __future__ import annotations

import codecs

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as T
from .ranges import read_csv_ranges, read_json_records

SUFFIXES = {
    "jsonl": (".jsonl", ".json", ".jsonl.gz", ".json.gz"),
    "json": (".json", ".json.gz"), "listjson": (".json", ".json.gz"),
    "plaintext": (".txt", ".txt.gz"), "csv": (".csv", ".csv.gz", ".tsv"), "parquet": (".parquet",),
}


def check_suffix(path: str, fmt: str) -> None:
    """A file name with the ending of another format is a mistake; folders have no ending."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    known = {s for group in SUFFIXES.values() for s in group}
    if fmt in SUFFIXES and name.endswith(tuple(known)) and not name.endswith(SUFFIXES[fmt]):
        raise ValueError(f"{path} does not look like {fmt}")


def _reader(spark: SparkSession, recursive: bool):
    return spark.read.option("recursiveFileLookup", str(recursive).lower())


def read_jsonl(spark, path, schema=None, recursive=False) -> DataFrame:
    r = _reader(spark, recursive)
    return (r.schema(schema) if schema else r).json(path)


def read_listjson(spark, path, schema=None, recursive=False) -> DataFrame:
    """A list of objects a file, read by ranges of the file; without a schema it is inferred."""
    return read_json_records(spark, path, schema, recursive)


def read_json_map(spark, path, record_schema: str | None = None, recursive=False) -> DataFrame:
    """One JSON object per file whose values are the records, read by ranges; without a schema it is inferred."""
    return read_json_records(spark, path, record_schema, recursive)


def read_plaintext(spark, path, recursive=False) -> DataFrame:
    return _reader(spark, recursive).text(path).withColumnRenamed("value", "content")


def read_csv(spark, path, has_header=True, encoding="utf-8", delimiter=None, quotechar='"',
             dialect="excel", columns: list[str] | None = None, recursive=False, multiline: bool | None = None) -> DataFrame:
    """All cells are stripped strings, missing ones empty; rows without any content are dropped.

    Files are read by ranges, quoted line breaks included, but for those in UTF-16 or 32, which are one task each;
    ``multiline`` leaves the splitting to Spark's own reader: a task for each file if true, lines as records if false.
    """
    sep = delimiter or ("\t" if dialect == "excel-tab" else ",")
    if multiline is None and not codecs.lookup(encoding).name.startswith(("utf-16", "utf-32")):
        return _cells(read_csv_ranges(spark, path, has_header, sep, quotechar, columns, recursive, encoding))
    multiline = multiline is not False
    r = (_reader(spark, recursive).option("header", str(has_header).lower()).option("encoding", encoding)
         .option("sep", sep).option("quote", quotechar).option("escape", quotechar).option("multiLine", str(multiline).lower())
         .option("mode", "PERMISSIVE"))
    df = r.csv(path)
    if not has_header:
        df = df.toDF(*(columns or [f"column_{i}" for i in range(len(df.columns))]))
    return _cells(df)


def _cells(df: DataFrame) -> DataFrame:
    df = df.select(*[T.strip(T.as_text(F.col(f"`{c}`"))).alias(c.strip()) for c in df.columns])
    filled = F.lit(False)
    for c in df.columns:
        filled = filled | (F.col(f"`{c}`") != "")
    return df.where(filled)


def read_parquet(spark, path, columns: list[str] | None = None, recursive=False) -> DataFrame:
    df = _reader(spark, recursive).parquet(path)
    return df.select(*columns) if columns else df


#: Addresses by dialect; databases named otherwise are addressed like the last ones.
JDBC_URLS = {
    "sqlite": "jdbc:sqlite:{database}", "oracle": "jdbc:oracle:thin:@//{at}/{database}",
    "mssql": "jdbc:sqlserver://{at};databaseName={database}", "postgres": "jdbc:postgresql://{at}/{database}",
}


def jdbc_options(query: str, dialect: str = "", database: str = "", username: str = "", password: str = "", host: str = "", port="",
                 driver: str = "", connect_args: str = "", partition_column: str | None = None, lower_bound=None, upper_bound=None,
                 num_partitions: int | None = None) -> dict[str, str]:
    """Options of Spark's JDBC reader for a job's sql_config.

    With a partition column and its bounds, so many tasks read a range each (rows beyond the bounds fall to the first and last); without, one task reads
    all. `driver` is passed on if it is the name of a class.
    """
    if not dialect or not database:
        raise ValueError("a database needs dialect and database")
    kind = dialect.lower()
    if kind != "sqlite" and not (username and host):
        raise ValueError(f"{dialect} needs username and host")
    url = JDBC_URLS.get(kind, "jdbc:" + kind + "://{at}/{database}").format(at=f"{host}:{port}" if port else host, database=database)
    if connect_args:
        url += connect_args if connect_args[0] in "?;" else f"?{connect_args}"
    ranges = {"partitionColumn": partition_column, "lowerBound": lower_bound, "upperBound": upper_bound, "numPartitions": num_partitions}
    given = [k for k, v in ranges.items() if v is not None]
    if given and len(given) < 4:
        raise ValueError(f"reading by ranges needs {sorted(set(ranges) - set(given))} too")
    # Spark takes ranges of tables only
    what = {"dbtable": f"({query}) q", **{k: str(v) for k, v in ranges.items()}} if given else {"query": query}
    known = {"user": username, "password": password, "driver": driver if "." in driver else ""}
    return {"url": url, **what, **{k: v for k, v in known.items() if v}}


def read_sql(spark, query: str, url: str | None = None, **options) -> DataFrame:
    """A query against a database, by its address or by the keys of `jdbc_options`; against registered views if neither is given."""
    if url is not None:
        return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()
    if options:
        return spark.read.format("jdbc").options(**jdbc_options(query, **options)).load()
    return spark.sql(query)


def read_images(spark, path, recursive=True) -> DataFrame:
    return _reader(spark, recursive).format("image").load(path)


def read_binary(spark, path, recursive=True) -> DataFrame:
    return _reader(spark, recursive).format("binaryFile").load(path)


def row_range(df: DataFrame, order_by: str, start: int = 0, end: int = -1, partitions: int | None = None) -> DataFrame:
    """Rows start to end (exclusive, -1 for all) in the order of a key, ties in any fixed order.

    The rows are sorted over ranges of the key; the ranges' row counts, one number each, give every row its place. So
    no task sees more than a range. With spark.checkpoint.dir set the sorted rows are written there, so that a range that is
    computed again keeps its order.
    """
    if start <= 0 and end < 0:
        return df
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]  # parts equal keys, so that these spread too
    ranged = df.repartitionByRange(n, F.col(order_by), *rest).sortWithinPartitions(F.col(order_by), *rest).select(
        "*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().alias("__row"))
    if spark.sparkContext.getCheckpointDir():
        ranged = ranged.checkpoint()
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    before = F.sum("__n").over(W.partitionBy(F.lit(1)).orderBy("__range")) - F.col("__n")
    offsets = counts.select("__range", (before - F.col("__first")).alias("__offset"))  # a row for each range
    place = F.col("__row") + F.col("__offset")
    wanted = (place >= start) & (place < end if end >= 0 else F.lit(True))
    return ranged.join(F.broadcast(offsets), "__range").where(wanted).select(*[f"`{c}`" for c in df.columns])


def fingerprint(df: DataFrame) -> DataFrame:
    """Digest of all rows, free of their order, with the row count and column names."""
    rows = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    n = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(rows.cast("decimal(38,0)")).alias("digest"))
    names = ",".join(df.columns)
    return n.select("rows", F.lit(names).alias("columns"), F.left(F.md5(F.concat_ws(
        "|", F.col("rows").cast("string"), F.coalesce(F.col("digest").cast("string"), F.lit("0")), F.lit(names))), F.lit(8)).alias("fingerprint"))


def read(spark: SparkSession, path: str, fmt: str, **options) -> DataFrame:
    """Read a path in a named format."""
    check_suffix(path, fmt)
    readers = {
        "jsonl": read_jsonl, "json": read_json_map, "listjson": read_listjson, "plaintext": read_plaintext,
        "csv": read_csv, "parquet": read_parquet, "image": read_images,
    }
    if fmt == "sql":
        return read_sql(spark, path, **options)
    if fmt not in readers:
        raise KeyError(f"unknown format: {fmt}")
    return readers[fmt](spark, path, **options)
