"""Paths beyond the broadcast bounds, and quality cutoffs where they act."""

from __future__ import annotations

import os
import random
from pathlib import Path

import pytest
from test_llm import VOCABULARY, brute_components, docs_of, prose

from sparkloom.llm import jaccard, queries, suffixes

FOLDER = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_beyond_its_bounds(spark, monkeypatch, n, percent):
    monkeypatch.setattr(jaccard, "MAX_BROADCAST", 3)
    monkeypatch.setattr(jaccard, "RANGE", 200)
    monkeypatch.setattr(jaccard, "HEAVY_SHARE", 0.1)
    rng = random.Random(percent)
    base, common = prose(60, rng).split(), prose(12, rng)
    texts: list = [None, "", "one two"]
    for k in range(40):
        words = list(base)
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        texts.append(" ".join(words) if k % 2 else f"{common} {prose(rng.randrange(5, 30), rng)}")
    texts += texts[3:9]
    own = {tuple(r) for r in jaccard.components(docs_of(spark, texts).repartition(3), n, percent).collect()}
    assert own == brute_components(texts, n, percent)
    kept = {r["doc_id"] for r in jaccard.keep_one(docs_of(spark, texts).repartition(3), n, percent).collect()}
    assert kept == {i for i, size, component in own if i == component or not size}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no fixture tables")
def test_quality_equals_sql_where_cutoffs_act(spark):
    import duckdb

    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{Path(FOLDER) / name}.parquet'")
    own, sql = queries.QUERIES["op10_quality_rules"](spark, FOLDER), db.sql(queries.ORACLE_SQL["op10_quality_rules"])
    rows = set(map(tuple, own.collect()))
    assert rows == set(sql.select(*own.columns).fetchall())
    failed, kept = own.columns.index("base_failed"), own.columns.index("kept")
    assert sum(not r[failed] and not r[kept] for r in rows) > 20


def test_suffix_width_is_checked(spark):
    with pytest.raises(ValueError, match="271"):
        suffixes.repeats(docs_of(spark, ["a"]), width=271)
    assert suffixes.repeats(docs_of(spark, ["ab" * 400]), width=270).count()
