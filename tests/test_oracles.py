"""Every query with SQL gives what DuckDB gives over the same tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from sheaf.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]) or pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(float).round(6)
        else:
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)) else str(x))
    return sorted(tuple(str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(name, spark, duck, sf):
    ours, theirs = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLE_SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(name, spark, sf):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry_has_an_answer_for_each_question(spark, sf):
    import __spark_entry__ as entry

    found = entry.entry(spark).toPandas()
    n = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    assert len(found) == n and found["confidence"].between(0, 1).all() and set(entry.oracle_sql()) <= set(entry.queries())
