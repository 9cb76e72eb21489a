"""Queries of the subpackage against their SQL."""

import duckdb
import pytest

from turnlake.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    database = duckdb.connect()
    for table in ("documents", "embeddings"):
        database.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = queries.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    relation = database.sql(queries.oracle_sql()[name])
    order = [relation.columns.index(c) for c in columns]
    plain = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in row) for row in rows), key=repr)
    assert sorted(relation.columns) == columns
    assert plain(map(tuple, found.select(*columns).collect())) == plain(tuple(row[i] for i in order) for row in relation.fetchall())
