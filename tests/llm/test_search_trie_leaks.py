"""Ranked search, the prefix trie and benchmark leaks against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import leaks, lexical, terms, trie

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RNG = random.Random(11)
VOCABULARY = [a + b for a in ("ba", "co", "Du", "fel", "gri", "é", "日本", "7") for b in ("l", "nd", "r", "ST", "9", "ñ")]


def prose(n: int, rng: random.Random = RNG, words: list[str] = VOCABULARY) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


def words_of(text: str | None) -> list[str]:
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def docs_of(spark, texts: list):
    return spark.createDataFrame([(i, t, "en", 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, rank int")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ09_`@[é日 \x00\n-🎉", max_size=30)), max_size=6))
def test_cut(texts):
    words, bounds = terms.cut(pa.array(texts, pa.string()))
    found = [w.decode() for w in words.to_pylist()]
    assert [found[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [words_of(t) for t in texts]


# Ranked search


def brute_search(docs: list[tuple], items: list[tuple], k: int) -> set[tuple]:
    counted = [(d, Counter(words_of(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = set()
    for item, text in dict.fromkeys(items):
        found = []
        for d, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words_of(text)) if c[t])
            if score > 0:
                found.append((-score, d is not None, d))
        out |= {(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(found)[:k])}
    return out


SEARCHED = [None, "", " .. ", "one", "one", prose(30), prose(30), prose(400), prose(4000), "é É", *(prose(12) for _ in range(60))]
ASKED = [(1, "one"), (2, prose(8)), (2, prose(8)), (3, prose(300)), (4, ""), (5, None), (6, "absent"), (7, " ".join(f"w{i}" for i in range(200)) + " one é"), (None, "É one"), (1, "one")]


def test_lexical_search(spark):
    docs = docs_of(spark, SEARCHED).union(spark.createDataFrame([(None, "one co9", "en", 5), (7, SEARCHED[7], "x", 1)], "doc_id long, text string, lang string, rank int"))
    items = spark.createDataFrame([(i, t, 1) for i, t in ASKED], "item_id long, text string, doc_id int")
    own = lexical.search(docs, items, k=10).collect()
    want = brute_search([*enumerate(SEARCHED), (None, "one co9"), (7, SEARCHED[7])], ASKED, 10)
    assert {tuple(r) for r in own} == want
    assert len(own) == len(want)


def test_lexical_search_item_blocks_and_empty_tables(spark, monkeypatch):
    docs, items = docs_of(spark, SEARCHED), spark.createDataFrame(ASKED, "item_id long, text string")
    whole = {tuple(r) for r in lexical.search(docs, items).collect()}
    monkeypatch.setattr(lexical, "ITEM_CHARS", 700)
    assert {tuple(r) for r in lexical.search(docs, items).collect()} == whole
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.limit(0), items).count() == 0


def test_lexical_masks_skip_and_stay_exact():
    rng = random.Random(3)
    rare = [f"w{i}" for i in range(150)]
    texts = [prose(40, rng) + (" " + " ".join(rng.sample(rare, 30)) if i % 200 == 0 else "") for i in range(2000)]
    item = " ".join(rare) + " " + prose(20, rng)
    words, _ = terms.cut(pa.array([item]))
    coded = words.dictionary_encode()
    vocabulary, own = coded.dictionary, np.unique(coded.indices.to_numpy())
    lengths, bounds, ids, counts = lexical._postings(pa.array(texts), vocabulary)
    df = Counter(ids.tolist())
    weights = np.array([math.floor(1000 * math.log((2 * 2000 + 2) / (2 * df[t] + 1))) for t in own.tolist()])
    best, scored = lexical._Best(10), 0
    for a in range(0, 2000, 500):
        part = lexical.Block(pa.array(range(a, a + 500)), lengths[a : a + 500], bounds[a : a + 501] - bounds[a], ids[bounds[a] : bounds[a + 500]], counts[bounds[a] : bounds[a + 500]], 2000, int(lengths.sum()), len(vocabulary))
        scored += part.search(own, weights, best, np.zeros(len(vocabulary), np.int64))
    assert [(i, s) for _, _, i, s in sorted(brute_search(list(enumerate(texts)), [(0, item)], 10))] == [(d, s) for s, d in best.rows]
    assert scored < 1000


# Prefix trie


def brute_trie(rows: list[tuple]) -> set[tuple]:
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, hashlib.sha256(f"{role}\n{len(role)}\n{text}".encode()).hexdigest(), role, text))
    turns = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = int(math.fmod(c, 100))
        rebuilt[c] = turns.get(c - base, [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, x in rebuilt.items():
        for d in range(len(x) + 1):
            nodes[tuple(x[:d])].append(c)
    kids = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, own in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(own) - 1) * len(k[-1][1]) if k else 0
    ends = {k: ",".join(map(str, sorted(c for c in own if len(rebuilt[c]) == len(k)))) for k, own in nodes.items()}
    return {(min(own), len(k), min(nodes[k[:-1]]) if k else None, len(own), kids[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, own in nodes.items()}


TURNS = "conv_id long, turn long, role string, text string, depth int, key string"


def conversations_of(spark, rows: list[tuple]):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)


def assert_trie(spark, rows: list[tuple]) -> None:
    own = trie.prefix_trie(conversations_of(spark, rows)).collect()
    want = brute_trie(rows)
    assert {tuple(r) for r in own} == want
    assert len(own) == len(want)


def test_trie_nulls_ties_repeats(spark):
    rows = [(0, i, "user", f"t{i}") for i in range(4)] + [(None, 0, "user", "lost")]
    rows += [(c, t, RNG.choice(["user", "assistant", None]), RNG.choice(["a", "b", "é日", None, ""])) for c in range(1, 40) for t in (None, 0, 0, 1, 2, 3)[: RNG.randrange(1, 7)]]
    rows += [(c, t, "user", "same") for c in (-250, -5, 105, 106, 107, 300, 301) for t in range(3)]
    rows += rows[:20]
    assert_trie(spark, rows)
    assert trie.prefix_trie(conversations_of(spark, [])).count() == 0


def test_trie_long_chains_and_hot_nodes(spark):
    chain = [(200, i, "user", f"x{i % 7}") for i in range(300)]
    copies = [(c, i, "user", f"y{i}") for c in range(1000, 1200) for i in range(3)]
    branches = [(2000 + c, i, "user", "x" if i < 3 + c else f"z{c}-{i}") for c in range(12) for i in range(20)]
    assert_trie(spark, chain + copies + branches)


def test_trie_one_conversation_over_many_ranges(spark):
    rows = [(100, i, "user", str(i * i % 11)) for i in range(400)] + [(101, i, "user", str(i * i % 11)) for i in range(150)]
    before = trie.prefixes(conversations_of(spark, rows)).collect()
    assert {(r["conv_id"], r["place"]) for r in before} == {(c, i + 1) for c, i, *_ in rows}
    own = {(r["conv_id"], r["place"]): r["key"] for r in before}
    assert all(own[100, i] == own[101, i] for i in range(1, 151))
    assert len(set(own.values())) == 400


@pytest.mark.parametrize("shape", ["chain", "star", "broom", "random"])
def test_subtree_totals(spark, shape):
    rng = random.Random(shape)
    parent = {0: None} | {i: {"chain": i - 1, "star": 0, "broom": i - 1 if i < 40 else 39, "random": rng.randrange(max(0, i - 4), i)}[shape] for i in range(1, 90)}
    value = {i: rng.randrange(100) for i in parent}
    want = dict(value)
    for i in sorted(parent, reverse=True):
        if parent[i] is not None:
            want[parent[i]] += want[i]
    nodes = spark.createDataFrame([(i, p, value[i]) for i, p in parent.items()], "key long, parent long, v long")
    own = trie.subtree_totals(nodes, ["v"]).collect()
    assert dict(map(tuple, own)) == want
    assert len(own) == len(parent)


def test_end_digests_in_runs(monkeypatch):
    rows = [(bytes([k]) * 16, c) for k in range(3) for c in range(k * 40)]
    monkeypatch.setattr(trie, "RUN", 20)
    batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[a : a + 7]], pa.binary()), pa.array([c for _, c in rows[a : a + 7]])], ["key", "conv_id"]) for a in range(0, len(rows), 7)]
    hashed = [x for b in trie._hashed(trie._runs(iter(batches))) for x in zip(*b.to_pydict().values(), strict=True)]
    assert hashed == [(bytes([k]) * 16, hashlib.sha256(",".join(map(str, range(k * 40))).encode()).hexdigest()) for k in (1, 2)]


# Leaks


def brute_leaks(text: str | None, items: list[tuple], window: int) -> tuple:
    w = words_of(text)
    hit, found = set(), set()
    for item, t in items:
        own = words_of(t)
        k = min(window, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add("" if item is None else str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


TESTS = [(1, prose(30)), (10, prose(30)), (2, prose(9)), (3, "Fel l grir"), (4, ""), (5, None), (None, prose(14)), (6, "aa " * 25), (7, "aa " * 25), (1, prose(12))]
TRAINING = [None, "", ", ;", prose(50), prose(20) + " " + TESTS[0][1] + " " + prose(5), TESTS[0][1].upper() + "." + TESTS[0][1], " ".join(TESTS[1][1].split()[3:13]), " ".join(TESTS[1][1].split()[3:12])]
TRAINING += ["aa " * 60, "aa " * 9, TESTS[2][1], "x fel-L-grir y", TESTS[6][1] + "\n" + prose(2000) + TESTS[9][1], "日本 " * 30, *(prose(40) for _ in range(30))]


@pytest.mark.parametrize("blocks", [1, 4])
def test_leaks(spark, monkeypatch, blocks):
    if blocks > 1:
        monkeypatch.setattr(leaks, "TEST_CHARS", 150)
    docs, items = docs_of(spark, [*TRAINING, TRAINING[4]]), spark.createDataFrame([(i, t, 0) for i, t in TESTS], "item_id long, text string, items int")
    own = sorted(map(tuple, leaks.report(docs, items).collect()))
    assert own == [(i, *brute_leaks(t, TESTS, 10)) for i, t in enumerate([*TRAINING, TRAINING[4]])]


def test_decontaminate_keeps_clean_documents_and_columns(spark):
    docs = docs_of(spark, TRAINING).withColumns({"items": F.lit("mine"), "N_WORDS": F.lit(1), "hit_runs": F.lit(None)})
    clean = leaks.decontaminate(docs, spark.createDataFrame(TESTS, "item_id long, text string"))
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [i for i, t in enumerate(TRAINING) if not brute_leaks(t, TESTS, 10)[-1]]
    assert leaks.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).count() == len(TRAINING)
    assert leaks.report(docs.limit(0), spark.createDataFrame(TESTS, "item_id long, text string")).count() == 0


def test_longest_matches(spark):
    docs, items = docs_of(spark, TRAINING).repartition(3), [(i, t) for i, t in TESTS if i != 1] + [TESTS[0]]
    own = {(r[0], r[1]): tuple(r[2:]) for r in leaks.longest_matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for item, text in items:
        w = words_of(text)
        k = min(10, len(w))
        for p in range(len(w) - k + 1):
            for d, t in enumerate(TRAINING):
                x = words_of(t)
                for q in range(len(x)):
                    n = next((n for n in range(min(len(w) - p, len(x) - q)) if w[p + n] != x[q + n]), min(len(w) - p, len(x) - q))
                    if w and n >= k:
                        key = "" if item is None else str(item), p
                        want[key] = min(want.get(key, (0, 0, 0)), (-n, d, q))
    assert own == {key: (-n, d, q) for key, (n, d, q) in want.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 40))
def test_suffix_array(words, depth):
    order = leaks.suffix_array(np.array(words), depth).tolist()
    assert sorted(order) == list(range(len(words)))
    keys = [words[i : i + depth] for i in order]
    assert keys == sorted(keys)
