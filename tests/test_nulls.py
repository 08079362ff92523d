"""Every catalogue query on tables that hold nulls, the first column (the key) included or not, against its SQL."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from sparkloom.functions.shipping import ship
from sparkloom.operators import aggregates, deps, versions
from sparkloom.plans import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no fixture tables")

#: Queries whose SQL reads nulls in another way than the operator's docstring says, or whose input is made from columns that turn null as a whole.
SQL_DIFFERS = {
    "check_depth": "the paths skip null parts in Spark and are null in SQL",
    "classify_paths": "the paths skip null parts in Spark and are null in SQL",
    "flatten_bindings": "manifests leave null fields out",
    "flatten_examples": "null turns come first in Spark's arrays",
    "flatten_kb_refs": "sets leave nulls out",
    "flatten_params": "a null map has no parameters",
    "match_submission": "a null title announces no agent",
    "parse_pr_title": "a null title announces no agent",
    "related_items": "a null vector takes no part; in SQL its score is null",
    "variant_facet": "the manifests are null as a whole",
    "vector_index_search": "a null vector takes no part; in SQL its score is null",
}


@pytest.fixture(scope="module", params=["keys", "no_keys"])
def holed(request, tmp_path_factory):
    """(whether keys are null too, folder, DuckDB with views): in each column one row in nine is null."""
    import duckdb

    top, db = tmp_path_factory.mktemp(request.param), duckdb.connect()
    for path in sorted(Path(FOLDER).iterdir()):
        names = db.sql(f"SELECT * FROM '{path}' LIMIT 0").columns
        first = 0 if request.param == "keys" else 1
        columns = ", ".join(f'CASE WHEN hash({i}, place) % 9 > 0 THEN "{c}" END AS "{c}"' if i >= first else f'"{c}"' for i, c in enumerate(names))
        db.sql(f"COPY (SELECT {columns} FROM (SELECT *, row_number() OVER () AS place FROM '{path}')) TO '{top}/{path.name}' (FORMAT parquet)")
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{top}/{path.name}'")
    return request.param == "keys", str(top), db


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_on_nulls(spark, holed, name):
    null_keys, folder, db = holed
    ship(spark)
    own = queries.QUERIES[name](spark, folder)
    rows = own.collect()
    if null_keys or name in SQL_DIFFERS:  # rows of a null key have no order in SQL, so only the run is tested
        return
    sql = db.sql(queries.ORACLE_SQL[name])
    places = [sql.columns.index(c) for c in own.columns]
    key = lambda row: tuple(map(str, row))
    assert sorted(map(key, rows)) == sorted(key(r[i] for i in places) for r in sql.fetchall())


def test_null_keys_meet(spark):
    bound = spark.createDataFrame([("skill", None), ("skill", "a"), ("skill", "a"), (None, "b")], "kind string, name string")
    present = spark.createDataFrame([("skill", None), ("mcp", "a"), (None, "b")], "kind string, name string")
    found = {(r["kind"], r["name"]): r["status"] for r in deps.reconcile_bundles(bound, present, ["kind", "name"]).collect()}
    assert found == {("skill", None): "ok", ("skill", "a"): "not_bundled", ("mcp", "a"): "unused", (None, "b"): "ok"}
    old = spark.createDataFrame([(None, "x"), (1, None), (2, "y"), (3, "z")], "k int, c string")
    new = spark.createDataFrame([(None, "w"), (1, None), (2, None), (4, "z")], "k int, c string")
    assert {(r["k"], r["change"]) for r in versions.catalog_diff(old, new, "k", "c").collect()} == {(None, "changed"), (2, "changed"), (3, "removed"), (4, "added")}
    plan = deps.import_plan(spark.createDataFrame([(1, None), (1, "a"), (2, None)], "agent_key int, name string"))
    assert {tuple(r) for r in plan.collect()} == {(1, 1, "a", 1), (1, 2, "1", 2), (2, 2, "2", 1)}
    table = spark.createDataFrame([(None, 3.0), ("a", 2.0), ("other", 1.0), ("b", 0.5)], "k string, v double")
    assert {tuple(r) for r in aggregates.top_n_with_other(table, "k", "v", 2).collect()} == {(None, False, 3.0), ("a", False, 2.0), ("other", True, 1.5)}
