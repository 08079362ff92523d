"""What must not grow faster than the input: rounds, stored pairs, rows held by a task."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.operators import deps, groups, index, passages, review, search, vectors
from sparkloom.plans.schemas import CODE_RULES, LICENCE_RULES, SENSITIVE_RULES
from sparkloom.streaming.review import review_files


def spied(monkeypatch, module, name: str = "written") -> list:
    """The tables that module stores from here on."""
    seen, store = [], getattr(module, name)

    def spy(df):
        out = store(df)
        seen.append(out)
        return out

    monkeypatch.setattr(module, name, spy)
    return seen


def test_transitive_plan_stores_no_pairs_of_targets(spark, monkeypatch):
    """what an item needs is found once an item; before, each round stored all pairs of target and item again."""
    monkeypatch.setattr(deps, "LIST", 3, raising=False)
    seen = spied(monkeypatch, deps)
    edges = [(i + 1, i) for i in range(20)]
    bound = [(t, 20 - t % 3) for t in range(40)] + [(t, 15) for t in range(40)]
    own = deps.transitive_plan(spark.createDataFrame(bound, "agent_key long, name long"), spark.createDataFrame(edges, "name long, needs long")).collect()
    assert {tuple(r) for r in own} == {(t, i, i + 1, "ok", i + 1) for t in range(40) for i in range(21 - t % 3)}
    assert len(own) == sum(21 - t % 3 for t in range(40))
    assert not any("target" in df.columns for df in seen)
    assert max(df.count() for df in seen) <= 21 * 21


def test_cycles_behind_each_other_take_few_rounds(spark, monkeypatch):
    """twelve cycles in a row, each with larger names than the one it leads to; before, each took a round of drains and colours of its own."""
    edges = [e for i in range(0, 24, 2) for e in ((i, i + 1), (i + 1, i), (i + 2, i))][:-1]
    seen = spied(monkeypatch, deps)
    own = {tuple(r) for r in deps.cycles(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert own == {(i, i - i % 2) for i in range(24)}
    assert len(seen) <= 120


def peak(work) -> float:
    """MB that work held at once, beside what was held before."""
    tracemalloc.start()
    work()
    top = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return top


def test_best_looks_at_few_of_equal_scores(monkeypatch):
    """scores that all reach the bar became a row each (measured: several hundred MB here)."""
    scores = np.round(np.random.default_rng(3).random((2048, 1024)), 2)
    keys = np.array(list(range(4096, 2048, -1)), object)
    best = vectors._Best(3, list(range(2049, 3073)), np.full(1024, -2.0))
    assert peak(lambda: best.add(np.arange(1024), keys, scores)) < 120
    for q in (0, 7, 1023):
        want = sorted((-s, k) for k, s in zip(keys, scores[:, q], strict=True) if k != 2049 + q)[:3]
        own = best.rows[best.rows["query"] == q]
        assert list(zip(-own["score"], own["key"], strict=True)) == want


def test_sieve_tests_ngrams_in_parts(monkeypatch):
    """F8: all hashes of a batch were copied some eight times at once."""
    h = np.random.default_rng(4).integers(-(2**63), 2**63, 4_000_000)
    words = np.zeros(16, np.uint64)
    for x in h[[5, 1_999_999, 3_999_999]].view(np.uint64):
        for s in (int(x) & 1023, int(x) >> 32 & 1023):
            words[s >> 6] |= np.uint64(1 << (s & 63))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.ListArray.from_arrays(pa.array([0, 0, 2_000_000, 2_000_000, 4_000_000], pa.int32()), pa.array(h))], ["key", "g"])

    class Shared:
        value = words, 1024

    rows = []
    top = peak(lambda: rows.extend(passages._sieved(Shared, pa.int64())(iter([batch]))))
    found = {(r["key"], r["place"], r["h"]) for b in rows for r in b.to_pylist()}
    assert {(2, 5, h[5]), (2, 1_999_999, h[1_999_999]), (4, 1_999_999, h[3_999_999])} <= found
    assert all(h[place + (2_000_000 if key == 4 else 0)] == x for key, place, x in found)
    assert top < 60


def test_reconciling_combines_few_rows_a_task(spark, monkeypatch):
    """one task combined all rows that one file gave it, and held their keys."""
    monkeypatch.setattr(deps, "COMBINED", 500, raising=False)
    seen, union = [], type(spark.range(1)).unionByName
    monkeypatch.setattr(type(spark.range(1)), "unionByName", lambda a, b, *more: seen.extend((a, b)) or union(a, b, *more))
    bound = spark.range(0, 3000, 1, 1).selectExpr("if(id % 3 = 0, 7, id) as name", "id % 2 as agent")
    present = spark.range(0, 4000, 2, 1).selectExpr("id as name", "id % 2 as agent")
    own = {(r["name"], r["agent"]): r["status"] for r in deps.reconcile_bundles(bound, present, ["name", "agent"]).collect()}
    b, p = ({tuple(r) for r in x.collect()} for x in (bound, present))
    assert own == {k: "ok" if k in b & p else "not_bundled" if k in b else "unused" for k in b | p}
    for df in seen:
        sizes = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
        distinct = df.select("name", "agent").distinct().count()
        assert len(sizes) > 1 and max(r["count"] for r in sizes) < distinct


def test_texts_are_fetched_once(spark, monkeypatch):
    """op8: with anchors of many segments, all texts were shuffled once more, to fetch theirs."""
    from sparkloom.llm import suffixes

    calls, fetch = [], suffixes._fetched
    monkeypatch.setattr(suffixes, "MOST_SEGMENTS", 2)
    monkeypatch.setattr(suffixes, "_fetched", lambda *a: calls.append(a) or fetch(*a))
    line = "the line that every document holds, " * 4
    texts = {i: f"{i * 7919} begins {line}{i * 104729} ends" for i in range(12)} | {20: "x" * 150, 21: "y" + "x" * 150, 22: None}
    found = {r["doc_id"]: r for r in suffixes.repeat_report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert len(calls) == 1
    seen = set()
    for i, text in texts.items():
        data = (text or "").encode()
        gone = [False] * len(data)
        for a in range(len(data) - 99):
            if data[a : a + 100] in seen:
                gone[a : a + 100] = [True] * 100
            seen.add(data[a : a + 100])
        assert found[i]["n_removed"] == sum(gone)


def test_index_shuffles_texts_once(spark, tmp_path, monkeypatch):
    """each word's row was shuffled by term and block, and once more by ranges; now all of a block is in one file, and its own documents are stored once."""
    monkeypatch.setattr(index, "BLOCK", 16)
    docs = [(i, " ".join(f"w{(i * j) % 37}" for j in range(i % 9))) for i in range(200)] + [(200, None)]
    index.build_index(spark.createDataFrame(docs, "id long, t string"), "id", "t", str(tmp_path))
    postings = spark.read.parquet(str(tmp_path / "postings"))
    files = postings.select("block", F.input_file_name().alias("file")).groupBy("block").agg(F.count_distinct("file").alias("files")).collect()
    assert len(files) > 8 and all(r["files"] == 1 for r in files)
    listed = postings.filter("term = ''").select(F.explode(F.arrays_zip("key", "len")).alias("d")).select("d.*").collect()
    assert sorted(map(tuple, listed)) == [(i, len((t or "").split())) for i, t in docs]
    assert postings.filter("term <> '' and (key is not null or len is not null)").count() == 0


def company(spark, t: float):
    """Texts of 3 to 45 words: near copies, and lonely ones with a line that all have; their sets of two-word n-grams, and the pairs with a similarity of t."""
    rng = np.random.default_rng(11)
    texts = {}
    for i in range(0, 240, 4):
        words = [f"a{i}w{j}" for j in range(int(rng.integers(3, 46)))]
        texts[i] = words
        for j in range(1, 4):
            copy = list(texts[i + int(rng.integers(0, j))])
            copy[int(rng.integers(0, len(copy)))] = f"c{i}d{j}"
            texts[i + j] = copy + [f"e{j}"] * int(rng.integers(0, 2)) if j < 3 else [f"b{i}w{x}" for x in range(30)] + ["one", "line", "that", "all", "have"]
    sets = {i: set(zip(w, w[1:], strict=False)) for i, w in texts.items()}
    close = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}
    return spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "id long, t string"), sets, close


def test_texts_that_stay_alone_are_not_compared(spark, monkeypatch):
    """all n-grams of all texts were shuffled with their counts; now a text must first show that it isn't alone."""
    for t in (0.6, 0.8):
        df, sets, close = company(spark, t)
        seen = spied(monkeypatch, search, "checkpointed")
        own = {(r["id_a"], r["id_b"]): r["similarity"] for r in search.near_duplicates(df, "id", "t", 2, t).collect()}
        first = {frozenset(s): min(i for i in sets if sets[i] == s) for s in sets.values()}
        want = {(a, b) for a, b in close if sets[a] != sets[b] and first[frozenset(sets[a])] == a and first[frozenset(sets[b])] == b}
        assert own.keys() == want and len(want) > 40
        kept = [{r["id"] for r in x.select("id").collect()} for x in seen if "g" in x.columns]
        assert kept and all({i for pair in want for i in pair} <= k and not any(i % 4 == 3 for i in k) for k in kept)


def test_groups_compare_only_what_has_company(spark, monkeypatch):
    """all n-grams of all texts were counted, joined and sorted; now only those of texts that aren't alone."""
    df, sets, close = company(spark, 0.8)
    seen = spied(monkeypatch, search, "checkpointed")
    own = {r["id"]: r["component"] for r in groups.duplicate_groups(df, "id", "t", n=2, t=0.8).collect()}
    want = {i: i for i in sets}
    for _ in sets:
        for a, b in close:
            want[a] = want[b] = min(want[a], want[b])
    assert own == want
    kept = [{r["id"] for r in x.select("id").collect()} for x in seen if "g" in x.columns]
    assert kept and not any(i % 4 == 3 for k in kept for i in k)


def test_review_reads_files_once(spark):
    """each file was read by every check, seven times; now once, and patterns are tried only on lines that hold what they need."""
    lines = ["write to a.b@c.org and x@y", "at 10.20.30.40 or 1.2.3", "+1 (555) 123-4567 or + 1", "1234567890123456 12345678901234567", 'my token = "abcdefgh1" = token', "x = eval (1) os.system('a') popen requests.get", "see http://a.b and getenv, os.environ"]
    lines += ["MIT License", "Apache License, Version 2.0", "under CC BY-NC 4.0", "GNU General Public License version 3", "License of mit", "", "password=12345678 again 10.20.30.40"]
    texts = ["\n".join(lines[i % 5 :: 2] + lines[: i % 3]) for i in range(12)]
    names = ["skills/a.md", "README.md", "mcps/b.py", "CHANGELOG.md"]
    rows = [(f"hub/r/c/a{i // 4}/{names[i % 4]}", f"a{i // 4}", t) for i, t in enumerate(texts)]
    read = spark.sparkContext.accumulator(0)
    content = F.udf(lambda x: (read.add(1), x)[1], "string")
    plain = spark.createDataFrame(rows, "path string, agent string, content string").withColumn("agent_key", F.concat(F.lit("r/c/"), "agent"))
    found = sorted((r["agent_key"], r["rule"], r["evidence"]) for r in review_files(plain.select("path", content("content").alias("content"))).collect())
    assert read.value == 9
    private = review.scan_sensitive(plain.filter("path like '%skills%' or path like '%README%'"), SENSITIVE_RULES, "agent_key", "content").collect()
    risky = review.scan_code(plain.filter("path like '%skills%' or path like '%mcps%'"), CODE_RULES).collect()
    licences = review.detect_licences(plain.filter("path not like '%CHANGELOG%'"), LICENCE_RULES, "agent_key", "content").collect()
    want = [(r["agent_key"], f"sensitive_{r['rule']}", r["match"]) for r in private]
    want += [("/".join(r["path"].split("/")[1:4]), f"code_{r['rule']}", f"{r['path']}:{r['line_no']}") for r in risky]
    assert found == sorted(want + [(r["agent_key"], f"licence_{r['licence']}", r["licence"]) for r in licences])
    assert len({rule for _, rule, _ in found}) == len(SENSITIVE_RULES) + len(CODE_RULES) + len(LICENCE_RULES)
