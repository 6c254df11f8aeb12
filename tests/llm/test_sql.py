"""What of the operators' results SQL can express equals it."""

import duckdb
import pytest

from sheaf.llm.queries import ORACLE_SQL, QUERIES
from tests.test_oracles import TABLES, rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)
