import math

import duckdb
import pytest

from turnlake import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("conversations", "documents", "embeddings", "labels", "events")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(rows, names):
    value = lambda x: round(x, 6) if isinstance(x, float) and not math.isnan(x) else x
    return sorted((tuple(value(x) for x in row) for row in rows), key=repr), names


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, database, name):
    found = registry.queries()[name](spark, FOLDER)
    names = sorted(found.columns)
    mine = plain(map(tuple, found.select(*names).collect()), names)
    relation = database.sql(registry.oracle_sql()[name])
    order = [relation.columns.index(c) for c in names]
    theirs = plain((tuple(row[i] for i in order) for row in relation.fetchall()), sorted(relation.columns))
    assert mine == theirs


def test_every_query_runs(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, FOLDER).count() > 0
