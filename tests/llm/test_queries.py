"""The registered queries: names, and the SQL where there is some."""

import duckdb

from tests.test_oracle import rows
from tidemark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_names():
    assert [int(q[2:].split("_")[0]) for q in QUERIES] == list(range(1, 11))


def test_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    for name, sql in ORACLE_SQL.items():
        assert rows(QUERIES[name](spark, SF).toPandas()) == rows(c.sql(sql).df())
