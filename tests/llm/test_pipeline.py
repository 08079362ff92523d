"""The pipeline over a small folder: each stage's decisions take effect, and clean documents stay."""

from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "bcdfghklmn" for b in ("ab", "el", "im", "or", "un", "ast", "ench", "ild")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = prose(120), prose(60)
    texts = [prose(80) for _ in range(20)] + [base, base + " end", "too short", None, f"{prose(50)} {passage}", f"{passage} {prose(50)}", f"{prose(40)} password=b7db7aa4a5fcc78305 {prose(40)}"]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r.asDict() for r in docs.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(seen["quality_rules"]) == set(range(len(texts))) - {22, 23}
    assert set(seen["near_copies"]) == set(seen["quality_rules"]) - {21}
    assert passage[:-10] in seen["repeated_passages"][24]["text"] and passage[10:-10] not in seen["repeated_passages"][25]["text"]
    assert "b7db7aa4a5fcc78305" not in seen["secret_redaction"][26]["text"]
    assert all(seen["secret_redaction"][i]["text"] == texts[i] for i in range(20))
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in again.collect()} == set(seen["near_copies"])
