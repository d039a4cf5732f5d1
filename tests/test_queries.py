"""Every registered query with SQL agrees with DuckDB on the small tables."""

import ast
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def shown(frame):
    columns = sorted(frame.columns)
    value = lambda v: None if pd.isna(v) else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return columns, sorted((tuple(value(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, con, name):
    assert shown(QUERIES[name](spark, sf).toPandas()) == shown(con.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQL) if not n.startswith("op") and n != "pipeline"))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(SQL) <= set(QUERIES)


def test_core_does_not_import_the_corpus_operators():
    root = os.path.join(os.path.dirname(entry.__file__), "evispark")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    for node in ast.walk(ast.parse(open(os.path.join(folder, n)).read())):
                        names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or "", *[a.name for a in node.names]] if isinstance(node, ast.ImportFrom) else []
                        assert not any("llm" in name.split(".") for name in names), (n, names)
