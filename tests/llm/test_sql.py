"""The queries of this subpackage that have SQL, against it."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from sparkloom.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no fixture tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for path in Path(FOLDER).iterdir():
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    own, sql = queries.QUERIES[name](spark, FOLDER), db.sql(queries.ORACLE_SQL[name])
    assert sorted(own.columns) == sorted(sql.columns)
    places = [sql.columns.index(c) for c in own.columns]
    key = lambda row: tuple(map(str, row))
    assert sorted(map(tuple, own.collect()), key=key) == sorted((tuple(r[i] for i in places) for r in sql.fetchall()), key=key)
