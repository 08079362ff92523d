"""Groups, indexes, import order, variants, passages, sketches, hash trees, phrases and layout: small tables, nulls, ties and repeated rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.operators import aggregates, deps, groups, hashtree, index, passages, phrases, prep, search, sketches, vectors
from sparkloom.sources import layout, variants

RNG = random.Random(2)
NAMES = [a + b for a in ("ba", "co", "du", "fel") for b in ("l", "nd", "r", "st", "mm")]


def prose(n: int, rng: random.Random = RNG) -> str:
    return " ".join(rng.choice(NAMES) for _ in range(n))


def words_of(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def roots(links, nodes) -> dict:
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a == b:
            continue
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


# Groups


@pytest.mark.parametrize("kind", ["long", "string"])
def test_connected_components(spark, kind):
    rng = random.Random(kind)
    links = [(i, i + 1) for i in range(25)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    links = [(f"{a:04}", f"{b:04}") if kind == "string" else (a, b) for a, b in links]
    own = dict(map(tuple, groups.connected_components(spark.createDataFrame([*links, *links[:5], (None, links[0][0])], f"a {kind}, b {kind}")).collect()))
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert own == roots(links, nodes)
    assert groups.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_duplicate_groups_lose_no_link(spark):
    rng = random.Random(8)
    base = prose(60, rng).split()
    texts: list = [None, "", "two words", prose(50), " ".join(base)]
    for _ in range(25):  # near copies of near copies
        words = list(rng.choice(texts[4:]).split())
        words[rng.randrange(len(words))] = rng.choice(NAMES)
        texts.append(" ".join(words))
    texts += [texts[3], texts[3].upper(), texts[4], *(prose(40, rng) for _ in range(10))]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(order[i], t) for i, t in enumerate(texts)] + [(order[4], texts[4])]
    own = {r["id"]: tuple(r)[1:] for r in groups.duplicate_groups(spark.createDataFrame(rows, "id long, t string"), "id", "t", n=3, t=0.8).collect()}
    sets = {i: frozenset(zip(*(words_of(t)[k:] for k in range(3)), strict=False)) for i, t in rows}
    close = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    component = roots(close, sets)
    size = Counter(component.values())
    first = {s: min(i for i in sets if sets[i] == s) for s in sets.values()}
    assert own == {i: (first[s] if s else i, component[i], size[component[i]]) for i, s in sets.items()}
    assert len(set(component.values())) < len(sets)


def test_equal_sets_keep_their_links(spark):
    a = prose(30)
    rows = [(1, a), (2, a.upper()), (3, a + " more"), (4, a)]
    own = groups.duplicate_groups(spark.createDataFrame(rows, "id long, t string"), "id", "t", n=3, t=0.8).collect()
    assert {tuple(r) for r in own} == {(1, 1, 1, 4), (2, 1, 1, 4), (3, 3, 1, 4), (4, 1, 1, 4)}


# Search


def brute_bm25(docs, queries, k):
    counts = [(i, Counter(words_of(t))) for i, t in docs]
    mean = sum(sum(c.values()) for _, c in counts) / len(counts) or 1.0
    df = Counter(w for _, c in counts for w in c)
    out = set()
    for q, text in queries:
        found = []
        for i, c in counts:
            terms = {w for w in words_of(text) if c[w]}
            score = sum(math.log(1 + (len(counts) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in terms)
            if round(score, 4) > 0:
                found.append((-round(score, 4), i))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])}
    return out


def test_index_gives_what_a_scan_gives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 16)
    rng = random.Random(4)
    rare = [f"rare{i}" for i in range(30)]
    docs = [(i, prose(rng.randrange(1, 120), rng) + " " + " ".join(rng.sample(rare, 2))) for i in range(400)] + [(400, None), (401, ""), (402, "été Ünï 日本"), (3, "bal rare1")]
    queries = [(0, "rare1 rare2 bal"), (1, "absent"), (2, None), (3, prose(20, rng)), (4, "ÉTÉ bal"), (5, "rare7 rare7")]
    index.build_index(spark.createDataFrame(docs, "id long, t string"), "id", "t", str(tmp_path))
    found = index.Index(spark, str(tmp_path))
    asked = spark.createDataFrame(queries, "query long, text string")
    assert {tuple(r) for r in found.search(asked, 5).collect()} == brute_bm25(docs, queries, 5)
    needed, _ = found.needed(found.asked(asked.filter("query in (0, 5)"), "query", "text"), 5)
    whole = found.bounds(found.asked(asked.filter("query in (0, 5)"), "query", "text")).count()
    assert needed.count() < whole
    one = search.keyword_search(spark.createDataFrame(docs, "id long, t string"), "id", "t", ["rare1", "rare2", "bal"], 5).collect()
    assert {(0, n + 1, *tuple(r)) for n, r in enumerate(one)} == {x for x in brute_bm25(docs, queries, 5) if x[0] == 0}
    monkeypatch.setattr(index, "PUSHED", 3)
    assert {tuple(r) for r in found.search(asked, 5).collect()} == brute_bm25(docs, queries, 5)


def vectors_of(spark, rng, n=300, width=6):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(8)]
    rows = [(i, [c + rng.gauss(0, 0.15) for c in centres[i % 8]]) for i in range(n)]
    rows += [(n, [0.0] * width), (n + 1, None), (n + 2, [1.0, None, *[0.0] * (width - 2)]), (n + 3, [float("nan")] * width), *((n + 4 + i, rows[5][1]) for i in range(6))]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def brute_nearest(rows, asked, k):
    good = {i: v for i, v in rows if v and None not in v and all(map(math.isfinite, v)) and any(v)}
    norm = {i: math.sqrt(sum(x * x for x in v)) for i, v in good.items()}
    out = set()
    for q in asked:
        if q in good:
            scores = sorted((-round(sum(a * b for a, b in zip(good[q], v, strict=True)) / norm[q] / norm[i], 6), i) for i, v in good.items() if i != q)
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def test_vector_search_and_index_are_exact(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    rows, df = vectors_of(spark, rng)
    asked = df.filter("vec_id % 9 = 0 or vec_id >= 298")
    want = brute_nearest(rows, [i for i, _ in rows if i % 9 == 0 or i >= 298], 4)
    assert {tuple(r) for r in vectors.nearest(df, asked, 4).collect()} == want
    vectors.build_vector_index(df, str(tmp_path / "a"), clusters=8)
    found = vectors.VectorIndex(spark, str(tmp_path / "a"))
    assert {tuple(r) for r in found.search(asked, 4).collect()} == want
    assert found.touched(asked, 4) < 0.5
    monkeypatch.setattr(vectors, "QUERIES", 7)
    assert {tuple(r) for r in vectors.nearest(df, asked, 4).collect()} == want
    assert {tuple(r) for r in found.search(asked, 4).collect()} == want
    few = df.filter("vec_id < 3")
    vectors.build_vector_index(few, str(tmp_path / "b"), clusters=8)
    assert vectors.VectorIndex(spark, str(tmp_path / "b")).search(few, 4).count() == 6
    vectors.build_vector_index(df.limit(0), str(tmp_path / "c"))
    assert vectors.VectorIndex(spark, str(tmp_path / "c")).search(few, 4).count() == 0
    assert vectors.nearest(df, df.limit(0), 4).count() == 0


# Import order


def brute_order(edges):
    needs = defaultdict(set)
    for a, b in edges:
        needs[a].add(b)
    nodes = {x for e in edges for x in e}
    reach = {}
    for x in nodes:
        seen, todo = set(), list(needs[x])
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += needs[y]
        reach[x] = seen
    looped = {x for x in nodes if x in reach[x]}
    stage = {}

    def stage_of(x):
        if x not in stage:
            stage[x] = 1 + max((stage_of(y) for y in needs[x]), default=0)
        return stage[x]

    out = set()
    for x in nodes:
        if x in looped:
            out.add((x, None, "cycle", min(y for y in reach[x] if x in reach[y])))
        elif reach[x] & looped:
            out.add((x, None, "blocked", None))
        else:
            out.add((x, stage_of(x), "ok", None))
    return out, reach


GRAPHS = {
    "chain": [(i + 1, i) for i in range(12)],
    "loops": [(1, 2), (2, 1), (3, 3), (4, 1), (2, 5), (6, 7), (7, 8), (8, 6), (8, 9), (9, 10), (10, 9), (11, 6), (12, 13)],
    "random": [(a, b) for a, b in ((RNG.randrange(40), RNG.randrange(40)) for _ in range(55))],
    "diamonds": [(3 * i + k, 3 * i + 3 + j) for i in range(5) for k in range(3) for j in range(2)],
    "empty": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_import_order(spark, name):
    edges = GRAPHS[name]
    own = deps.import_order(spark.createDataFrame([*edges, *edges[:3], (None, 1), (2, None)], "agent_key long, name long")).collect()
    want, _ = brute_order(edges)
    assert {tuple(r) for r in own} == want
    assert len(own) == len(want)


def test_transitive_plan(spark):
    edges = GRAPHS["loops"]
    order, reach = brute_order(edges)
    state = {x: (stage, status) for x, stage, status, _ in order}
    bound = [("a", 4), ("a", 4), ("b", 12), ("b", 99), ("c", 11), ("d", None), (None, 1)]
    want = set()
    for target in "abc":
        items = {i for t, i in bound if t == target}
        items |= {y for i in items for y in reach.get(i, ())}
        rows = sorted(((*state.get(i, (1, "ok")), i) for i in items), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
        want |= {(target, i, stage, status, n + 1) for n, (stage, status, i) in enumerate(rows)}
    own = deps.transitive_plan(spark.createDataFrame(bound, "agent_key string, name long"), spark.createDataFrame(edges, "name long, needs long")).collect()
    assert {tuple(r) for r in own} == want


# Variants and layout


def test_variants_keep_undeclared_keys(spark, tmp_path):
    texts = ['{"name":"a","x":5,"deep":{"y":[1,"z"]}}', '{"name":"b","x":"5"}', '{"name":"c","x":5.5,"flag":true}', "[1]", "3", "{", "", None, '{"name":"d","x":null}', "{}"]
    parsed = variants.parse_variants(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, content string"))
    assert {r["id"] for r in parsed.filter("status = 'ok'").collect()} == {0, 1, 2, 8, 9}
    assert parsed.filter("(manifest is null) <> (status = 'corrupt')").count() == 0
    variants.write_variants(parsed.select("id", "manifest"), str(tmp_path))
    stored = spark.read.parquet(str(tmp_path))
    ids = lambda df: {r["id"] for r in df.collect()}
    assert ids(variants.variant_facet(stored, {"$.x": 5})) == {0}
    assert ids(variants.variant_facet(stored, {"$.x": 5}, strict=False)) == {0, 1, 2}
    assert ids(variants.variant_facet(stored, {"$.x": "5"})) == {1}
    assert ids(variants.variant_facet(stored, {"$.x": (5.0, 6.0)})) == {0, 2}
    assert ids(variants.variant_facet(stored, {"$.x": [4, 5], "$.name": "a"})) == {0}
    assert ids(variants.variant_facet(stored, {"$.flag": True})) == {2}
    assert ids(variants.variant_facet(stored, {"$.deep.y[1]": "z"})) == {0}
    keys = {tuple(r) for r in variants.variant_keys(stored).collect()}
    assert {("name", "STRING", 4), ("x", "BIGINT", 1), ("x", "STRING", 1), ("x", "DECIMAL", 1), ("flag", "BOOLEAN", 1), ("deep", "OBJECT", 1)} <= keys


def test_variant_plan_parses_once(spark, tmp_path):
    parsed = variants.parse_variants(spark.createDataFrame([(i, f'{{"a":{i}}}') for i in range(50)], "id long, content string"))
    variants.write_variants(parsed.select("id", "manifest"), str(tmp_path))
    found = variants.variant_facet(spark.read.parquet(str(tmp_path)), {"$.a": (10, 19)}, strict=False)
    plan = found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert found.count() == 10
    assert "parse_json" not in plan
    assert "from_json" not in plan


def test_clustered_files_skip_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    rng = random.Random(1)
    rows = [(rng.randrange(1000), f"{rng.choice('abcdefgh')}{rng.randrange(100)}", None if i % 50 == 0 else rng.random(), i) for i in range(8000)]
    df = spark.createDataFrame(rows, "a int, b string, c double, d int")
    layout.write_clustered(df, str(tmp_path / "z"), ["a", "b", "c"], bloom=["d"], files=32)
    df.repartition(32).write.parquet(str(tmp_path / "plain"))
    back = spark.read.parquet(str(tmp_path / "z"))
    assert back.columns == df.columns
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)

    def met(folder, column, low, high):
        hits = 0
        for file in (tmp_path / folder).glob("*.parquet"):
            meta = pq.ParquetFile(file).metadata
            for g in range(meta.num_row_groups):
                s = meta.row_group(g).column(df.columns.index(column)).statistics
                hits += s.min <= high and s.max >= low
        return hits

    for column, low, high in (("a", 100, 140), ("b", "c1", "c3"), ("c", 0.4, 0.45)):
        assert met("plain", column, low, high) == 32
        assert met("z", column, low, high) <= 20
    layout.write_clustered(df.limit(0), str(tmp_path / "none"), ["a", "b"])
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


# Passages, phrases


def brute_passages(docs, items, n):
    out = set()
    for d, t in docs:
        for i, u in items:
            a, b = words_of(t), words_of(u)
            for p in range(len(a)):
                for q in range(len(b)):
                    if a[p] == b[q] and not (p and q and a[p - 1] == b[q - 1]):
                        k = 0
                        while p + k < len(a) and q + k < len(b) and a[p + k] == b[q + k]:
                            k += 1
                        if k >= n:
                            out.add((d, p, p + k, i, q))
    return out


def test_shared_passages(spark):
    rng = random.Random(9)
    items = [(1, prose(20, rng)), (2, prose(12, rng)), (3, "a a a a a a a a"), (4, None), (5, "too few")]
    docs = [(0, None), (1, items[0][1].upper() + ". " + prose(10, rng) + " " + items[0][1]), (2, "x " + " ".join(items[1][1].split()[2:9])), (3, "a a a a a a"), (4, prose(60, rng)), (5, items[1][1] + " " + items[0][1])]
    own = passages.shared_passages(spark.createDataFrame(docs, "id long, t string"), "id", "t", spark.createDataFrame(items, "item long, t string"), "item", "t", 4)
    assert {tuple(r) for r in own.collect()} == brute_passages(docs, items, 4)
    none = spark.createDataFrame([], "item long, t string")
    assert passages.shared_passages(spark.createDataFrame(docs, "id long, t string"), "id", "t", none, "item", "t", 4).count() == 0


def test_bloom_filter_has_all_and_few_others(spark):
    own = spark.range(5000).select(F.xxhash64("id").alias("h"))
    words, bits = passages.bloom_words(own)
    hit = lambda h: all(int(words[s >> 6]) >> (s & 63) & 1 for s in (h & (bits - 1), (h >> 32) & (bits - 1)))
    assert all(hit(r[0] & (2**64 - 1)) for r in own.collect())
    others = spark.range(5000, 15000).select(F.xxhash64("id").alias("h")).collect()
    assert sum(hit(r[0] & (2**64 - 1)) for r in others) < 500


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=4), min_size=1, max_size=6), st.lists(st.sampled_from("abcd"), max_size=30))
def test_automaton(terms, words):
    terms = sorted(map(list, {tuple(t) for t in terms}))
    automaton = phrases.Automaton(terms)
    number = {w: i for i, w in enumerate(automaton.vocabulary.to_pylist())}
    own = sorted(automaton.hits([number.get(w, -1) for w in words]))
    assert own == sorted((i, p + len(t) - 1) for i, t in enumerate(terms) for p in range(len(words)) if words[p : p + len(t)] == t)


def test_blocked_phrases(spark, monkeypatch):
    docs = [(1, "New York, new\nyork city"), (2, None), (3, "york"), (4, "NEW  YORK CITY hall"), (5, "")]
    terms = [("new york",), ("New-York city",), ("york",), ("city hall",), ("",), (None,), ("new york",)]
    want = {(1, "new york", 2), (1, "new york city", 1), (1, "york", 2), (3, "york", 1), (4, "new york", 1), (4, "new york city", 1), (4, "york", 1), (4, "city hall", 1)}
    df, blocked = spark.createDataFrame(docs, "id long, t string"), spark.createDataFrame(terms, "term string")
    assert {tuple(r) for r in phrases.blocked_phrases(df, "id", "t", blocked).collect()} == want
    monkeypatch.setattr(phrases, "TERMS", 2)
    assert {tuple(r) for r in phrases.blocked_phrases(df, "id", "t", blocked).collect()} == want


# Sketches, hash trees


def test_sketches_unite_without_old_rows(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i % 5, rng.randrange(4000), rng.choice(["x", "y", None]), None if i % 10 == 0 else rng.random()) for i in range(20000)]
    df = spark.createDataFrame(rows, "batch int, n int, s string, f double")
    for b in range(5):
        sketches.store([sketches.sketch_columns(df.filter(F.col("batch") == b).drop("batch"), F.lit(b))], str(tmp_path / "p"))
    own = {r["column"]: r for r in sketches.profile_sketches(spark.read.parquet(str(tmp_path / "p"))).collect()}
    exact = len({r[1] for r in rows})
    assert abs(own["n"]["n_distinct"] - exact) <= 4 * 1.04 / 2 ** (sketches.LG_K / 2) * exact
    assert (own["s"]["n_distinct"], own["s"]["n_nulls"], own["s"]["q2"]) == (2, sum(r[2] is None for r in rows), None)
    values = sorted(r[3] for r in rows if r[3] is not None)
    assert own["f"]["n_nulls"] == 2000
    assert own["f"]["mean"] == pytest.approx(sum(values) / len(values))
    for q, share in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75)):
        assert abs(sum(v <= own["f"][q] for v in values) / len(values) - share) <= 2.3 / sketches.K**0.9 * 3
    for b in range(5):
        sketches.store([sketches.sketch_reuse(df.filter(F.col("batch") == b), F.lit(b), "n", "s")], str(tmp_path / "r"))
    reused = {r["name"]: r["n_agents"] for r in sketches.reuse(spark.read.parquet(str(tmp_path / "r")), 10).collect()}
    agents = {s: len({r[1] for r in rows if r[2] == s}) for s in ("x", "y", None)}
    assert reused == agents


def test_hash_tree_reads_what_differs(spark, tmp_path):
    old = [(i, f"c{i}", i % 3) for i in range(5000)] + [(7001, None, None)]
    new = [r for r in old if r[0] not in (5, 77)] + [(9000, "new", 1), (9001, None, None)]
    new = [(i, "other" if i in (10, 4000, 7001) else c, x) for i, c, x in new]
    for rows, name in ((old, "old"), (new, "new")):
        hashtree.write_state(spark.createDataFrame(rows, "id long, c string, x int"), "id", ["c", "x"], str(tmp_path / name))
    states = hashtree.States(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    assert {tuple(r) for r in states.diff("id").collect()} == {(5, "removed"), (77, "removed"), (9000, "added"), (9001, "added"), (10, "changed"), (4000, "changed"), (7001, "changed")}
    buckets = states.differing()
    assert len(buckets) <= 7
    assert states.looked_at <= 1 + 7 * hashtree.FAN * hashtree.DEPTH
    assert sum(r.count() for r in states.changed_rows(buckets)) <= 20
    same = hashtree.States(spark, str(tmp_path / "old"), str(tmp_path / "old"))
    assert same.diff("id").count() == 0
    assert same.looked_at == 1
    hashtree.write_state(spark.createDataFrame([], "id long, c string, x int"), "id", ["c", "x"], str(tmp_path / "none"))
    assert hashtree.States(spark, str(tmp_path / "none"), str(tmp_path / "new")).diff("id").count() == len(new)


# Nulls in earlier operators


def test_scaling_keeps_rows_without_a_part(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), (None, 1, 5.0), (None, 2, 9.0)], "p string, o int, v double")
    own = {(r["p"], r["o"]): (r["moving_average"], r["min_max"]) for r in aggregates.smooth_and_scale(df, "p", ["o"], "v", 2).collect()}
    assert own == {("a", 1): (1.0, 0.0), ("a", 2): (2.0, 1.0), (None, 1): (5.0, 0.0), (None, 2): (7.0, 1.0)}


def test_top_n_with_null_and_other_keys(spark):
    df = spark.createDataFrame([(None, 9.0), ("x", 5.0), ("other", 4.0), ("z", 1.0)], "k string, v double")
    assert {tuple(r) for r in aggregates.top_n_with_other(df, "k", "v", 2).collect()} == {(None, False, 9.0), ("x", False, 5.0), ("other", True, 5.0)}
    assert {tuple(r) for r in aggregates.top_n_with_other(df, "k", "v", 3).collect()} == {(None, False, 9.0), ("x", False, 5.0), ("other", False, 4.0), ("other", True, 1.0)}


def test_html_quotes_and_character_references(spark):
    pages = [
        (1, """<title>A &amp; B &#233;&#x1F389;</title><h1>x &lt; y</h1><a href='/one?a=1&amp;b=2'>1</a><A class="k" HREF=/two>2</A><a data-href="no" href = "/three">3</a><p>&#8364; &unknown; &#0; &amp;lt;</p>"""),
        (2, None),
        (3, "no tags &#65;"),
    ]
    own = {r["id"]: r for r in prep.html_to_rows(spark.createDataFrame(pages, "id long, html string"), "id", "html", decode=True).collect()}
    assert (own[1]["title"], own[1]["heading"]) == ("A & B é🎉", "x < y")
    assert own[1]["links"][:2] == ["/one?a=1&b=2", "/two"]
    assert own[1]["text"].endswith("€ &unknown; &#0; &lt;")
    assert (own[2]["text"], own[2]["n_links"], own[3]["text"]) == ("", 0, "no tags A")
