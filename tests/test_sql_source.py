"""Queries as the input of a job, and the options that a database gets."""

import pytest

from grainsieve import run_job
from grainsieve.plans.job import JobSpec
from grainsieve.sources.readers import jdbc_options

EVALUATOR = [{"fields": {"content": "body"}, "evals": [{"name": "RuleContentNull"}]}]


def test_a_job_reads_a_query(spark):
    spark.createDataFrame([(1, "a"), (2, ""), (3, "")], "id int, body string").createOrReplaceTempView("job_texts")
    v = run_job(spark, {"input_path": "SELECT * FROM job_texts WHERE id < 3", "dataset": {"source": "sql", "format": "jsonl"},
                        "evaluator": EVALUATOR})
    assert sorted((r.id, r.eval_status) for r in v.collect()) == [(1, False), (2, True)]


def test_job_keys_make_the_address():
    spec = JobSpec.of({"input_path": "SELECT 1", "evaluator": EVALUATOR, "dataset": {"source": "sql", "sql_config": {
        "dialect": "mysql", "driver": "pymysql", "username": "u", "password": "p", "host": "h", "port": "3306", "database": "d",
        "connect_args": "charset=utf8mb4"}}})
    assert spec.format == "sql" and jdbc_options(spec.input_path, **spec.read_options) == {
        "url": "jdbc:mysql://h:3306/d?charset=utf8mb4", "query": "SELECT 1", "user": "u", "password": "p"}


@pytest.mark.parametrize("dialect, url", [("postgresql", "jdbc:postgresql://h/d"), ("postgres", "jdbc:postgresql://h/d"),
                                          ("mssql", "jdbc:sqlserver://h;databaseName=d"), ("Oracle", "jdbc:oracle:thin:@//h/d")])
def test_addresses(dialect, url):
    assert jdbc_options("q", dialect, "d", "u", host="h")["url"] == url


def test_ranges_and_mistakes():
    got = jdbc_options("SELECT * FROM t", "sqlite", "/x.db", driver="org.sqlite.JDBC", partition_column="id", lower_bound=0, upper_bound=9,
                       num_partitions=3)
    assert got == {"url": "jdbc:sqlite:/x.db", "dbtable": "(SELECT * FROM t) q", "partitionColumn": "id", "lowerBound": "0",
                   "upperBound": "9", "numPartitions": "3", "driver": "org.sqlite.JDBC"}
    for wrong in ({}, {"dialect": "mysql"}, {"dialect": "mysql", "database": "d", "username": "u"},
                  {"dialect": "sqlite", "database": "d", "num_partitions": 3}):
        with pytest.raises(ValueError):
            jdbc_options("q", **wrong)
    with pytest.raises(ValueError, match="source"):
        JobSpec.of({"evaluator": EVALUATOR, "dataset": {"source": "elsewhere"}})
