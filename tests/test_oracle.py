"""Every query with an SQL counterpart gives the same rows in the independent engine."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from registry import oracle, spark_queries

SF = "/root/testdata/sf0.01"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
SQL = oracle.oracle_sql()
QUERIES = spark_queries.QUERIES
ONE_ROW = {"review_manifest", "audit_rollup", "judge_means", "accuracy", "macro_prf", "weighted_prf", "binary_prf",
           "rater_agreement", "pearson", "spearman", "train_eval_report"}


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return str(value) if hasattr(value, "isoformat") else value


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False, name=None)), key=repr)


def test_every_counterpart_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, engine, name):
    got = rows_of(QUERIES[name](spark, SF).toPandas())
    expected = rows_of(engine.sql(SQL[name]).df())
    assert got[0] == expected[0]
    assert got[1] == expected[1]
    if name not in ONE_ROW:
        assert len(set(got[1])) > 1


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_counterpart_give_rows(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
