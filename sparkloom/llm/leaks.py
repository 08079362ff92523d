"""Benchmark decontamination: suffix arrays over shards of the training texts, searched for every suffix of the test texts.

A shard is an Arrow batch of whole documents. Its words become numbers of the test vocabulary. Only stretches of words that follow each other
somewhere in the tests too can hold a match, so these stretches alone get a suffix array (prefix doubling, no deeper than
the longest test text). All test suffixes are then searched at once, word by word: each holds the range of the array that agrees
with it so far, and two binary searches narrow that range by the next word. The range after a window's words has all
occurrences of that window; the last range that isn't empty has the longest verbatim match and its places.

A window is `window` consecutive words of an item; a shorter item, but not an empty one, is one window of all its words. A document
word inside an occurrence of a window is hit. Documents stay in their task, so nothing is shuffled; only the longest matches of
the test suffixes are aggregated over shards. Tests of more than TEST_CHARS code points are taken in blocks, one
after another, each adding its hits to the rows.

Defined results: null and empty texts have no words. Rows that share an item_id count as one item, a null item_id as the empty string.
Each row of the documents has its own result. Other columns are kept by mark(), whose own names must be new, and by decontaminate(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_batches, fresh
from sparkloom.llm.terms import cut, item_blocks, numbered

#: Code points of test texts that one search takes.
TEST_CHARS = 32_000_000


class Tests:
    """A block of test items (item_id, text): their words as numbers from 1, suffix by suffix."""

    def __init__(self, items: list[tuple], window: int) -> None:
        names = ["" if i is None else str(i) for i, _ in items]
        words, bounds = cut(pa.array([t for _, t in items], pa.large_string()))
        coded = words.dictionary_encode()
        self.vocabulary, self.words = coded.dictionary, coded.indices.to_numpy().astype(np.int64) + 1
        self.names = sorted(set(names))
        lengths = np.diff(bounds)
        item = np.repeat(np.arange(len(items)), lengths)
        place = np.arange(len(self.words)) - bounds[:-1][item]
        of = {n: k for k, n in enumerate(self.names)}
        #: Of each suffix that holds a whole window: where it begins, its words, its window's words, its item and its place there.
        size, left = np.minimum(lengths, window)[item], (lengths[item] - place)
        self.at = np.flatnonzero(left >= size)
        self.left, self.size, self.start = left[self.at], size[self.at], place[self.at]
        self.item = np.array([of[n] for n in names], np.int64)[item][self.at]
        self.longest, self.shortest = int(lengths.max(initial=0)), int(size.min(initial=window))
        follows = np.flatnonzero(item[1:] == item[:-1])
        self.pairs = np.unique(self.pair(self.words[follows], self.words[follows + 1]))

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * (len(self.vocabulary) + 1) + b

    def has_pair(self, pairs: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.pairs, pairs)
        return self.pairs[np.minimum(at, len(self.pairs) - 1)] == pairs if len(self.pairs) else np.zeros(len(pairs), bool)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of words in order of their first `depth` words at least; equal ones by place."""
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < depth:
        behind = np.zeros_like(rank)
        behind[: len(rank) - k] = rank[k:] + 1
        key = rank * (len(rank) + 2) + behind
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[False], np.diff(key[order]) > 0])
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == len(rank) - 1:
            break
        k *= 2
    return order


class Shard:
    """The stretches of a batch's texts that could hold matches, and their suffix array."""

    def __init__(self, texts: pa.Array, tests: Tests) -> None:
        ids, bounds = numbered(texts, tests.vocabulary)
        self.counts = np.diff(bounds)
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        known = ids >= 0
        near = np.flatnonzero(known[1:] & known[:-1] & (doc[1:] == doc[:-1]))
        link = np.zeros(len(ids) + 1, bool)  # with the word before
        link[near[tests.has_pair(tests.pair(ids[near] + np.int64(1), ids[near + 1] + np.int64(1)))] + 1] = True
        first = np.flatnonzero(known & ~link[:-1])
        last = np.flatnonzero(known & ~link[1:]) + 1
        long = last - first >= tests.shortest
        first, sizes = first[long], (last - first)[long]
        spots = np.cumsum(sizes + 1) - sizes - 1  # each stretch, then a 0
        self.words = np.zeros(int((sizes + 1).sum()), np.int64)
        inside = np.repeat(spots, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        from_text = np.repeat(first, sizes) + inside - np.repeat(spots, sizes)
        self.words[inside] = ids[from_text] + 1
        self.doc, self.place = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.int64)
        self.doc[inside] = doc[from_text]
        self.place[inside] = from_text - bounds[doc[from_text]]
        self.order = suffix_array(self.words, tests.longest) if len(self.words) else np.zeros(0, np.int64)

    def bound(self, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray, above: bool) -> np.ndarray:
        """In each range, where suffixes begin whose word at this depth is `word` or more (above: more)."""
        low, high = low.copy(), high.copy()
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            found = self.words[np.minimum(self.order[middle] + depth, len(self.words) - 1)]  # the last one is a 0
            less = found <= word[open_] if above else found < word[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        return low

    def search(self, tests: Tests) -> tuple[np.ndarray, ...]:
        """Of each test suffix whose window occurs: its number, the window's range, the longest match, and the range of that."""
        alive = np.arange(len(tests.at)) if len(self.words) else np.zeros(0, np.int64)
        low, high = np.zeros(len(tests.at), np.int64), np.full(len(tests.at), len(self.words), np.int64)
        length, window = np.zeros(len(tests.at), np.int64), np.zeros((2, len(tests.at)), np.int64)
        depth = 0
        while len(alive := alive[tests.left[alive] > depth]):
            word = tests.words[tests.at[alive] + depth]
            a = self.bound(low[alive], high[alive], depth, word, above=False)
            b = self.bound(a, high[alive], depth, word, above=True)
            more = a < b
            alive = alive[more]
            low[alive], high[alive] = a[more], b[more]
            depth += 1
            length[alive] = depth
            full = alive[tests.size[alive] == depth]
            window[:, full] = low[full], high[full]
        hit = np.flatnonzero(length >= tests.size)
        return hit, window[0, hit], window[1, hit], length[hit], low[hit], high[hit]

    def hits(self, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of hit words (document, start, end), and the distinct pairs of document and item."""
        hit, low, high, *_ = self.search(tests)
        size = tests.size[hit]
        key = size * (len(self.words) + 1) + low
        _, one, window = np.unique(key, return_index=True, return_inverse=True)
        # Occurrences: a different window of one length has a range of its own, so there are as many as places.
        ranges = high[one] - low[one]
        spots = self.order[np.repeat(low[one] - np.cumsum(ranges) + ranges, ranges) + np.arange(ranges.sum())]
        cover = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(cover, spots, 1)
        np.add.at(cover, spots + np.repeat(size[one], ranges), -1)
        covered = np.concatenate([[0], (np.cumsum(cover) > 0).view(np.int8), [0]])
        edges = np.flatnonzero(np.diff(covered))
        first, last = edges[0::2], edges[1::2] - 1
        docs, owner = np.divmod(np.unique(self.doc[spots] * max(1, len(one)) + np.repeat(np.arange(len(one)), ranges)), max(1, len(one)))
        by_window = np.argsort(window, kind="stable")
        starts = np.searchsorted(window[by_window], np.arange(len(one) + 1))
        many = np.diff(starts)[owner]
        items = tests.item[hit[by_window[np.repeat(starts[owner] - np.cumsum(many) + many, many) + np.arange(many.sum())]]]
        pairs = np.unique(np.repeat(docs, many) * len(tests.names) + items) if len(items) else np.zeros(0, np.int64)
        return self.doc[first], self.place[first], self.place[last] + 1, pairs // max(1, len(tests.names)), pairs % max(1, len(tests.names))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first place among the suffixes of each range, by a table of least places of ranges of 1, 2, 4, ..."""
        table = [self.order]
        while len(table[-1]) > 1 << (len(table) - 1):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        out, level = np.zeros(len(low), np.int64), np.frexp((high - low).astype(float))[1] - 1
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(table[k][low[own]], table[k][high[own] - (1 << int(k))])
        return out


def _lists(values: np.ndarray, owner: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    """values gathered by owner (ascending) into one list a row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)), pa.array(values, kind))


def _marked(shared, text: str, keep: list[str], names: tuple[str, str, str]):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        for batch in batches:
            shard = Shard(batch.column(batch.schema.get_field_index(text)), tests)
            doc, start, end, with_item, item = shard.hits(tests)
            runs = _lists(np.stack([start, end], 1).ravel(), np.repeat(doc, 2), batch.num_rows, pa.int64())
            of = np.array(tests.names, object)[item] if len(item) else []
            found = [pa.array(shard.counts), runs, _lists(of, with_item, batch.num_rows, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *found], [*keep, *names])

    return mark


def _united(a: Column, b: Column) -> Column:
    """Two ascending lists of runs (start, end, start, end, ...) as one, overlapping and adjacent runs merged."""
    pairs = lambda c: F.transform(F.sequence(F.lit(1), (F.size(c) / 2).cast("int")), lambda i: F.struct(F.get(c, (2 * i - 2).cast("int")).alias("a"), F.get(c, (2 * i - 1).cast("int")).alias("b")))
    every = lambda c: F.when(F.size(c) > 0, pairs(c)).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))
    joined = lambda s, x: F.when(F.element_at(s, -1)["b"] >= x["a"], F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(F.element_at(s, -1)["a"].alias("a"), F.greatest(F.element_at(s, -1)["b"], x["b"]).alias("b"))))).otherwise(F.concat(s, F.array(x)))
    merged = F.aggregate(F.array_sort(F.concat(every(a), every(b))), F.array().cast("array<struct<a:bigint,b:bigint>>"), lambda s, x: F.when(F.size(s) == 0, F.array(x)).otherwise(joined(s, x)))
    return F.flatten(F.transform(merged, lambda r: F.array(r["a"], r["b"])))


def mark(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("n_words", "hit_runs", "items")) -> DataFrame:
    """The columns of docs (or those to keep) with n_words, hit_runs (maximal runs of hit words: start, end, start, end, ...) and items (ids as strings, ascending)."""
    spark = docs.sparkSession
    bounded_batches(spark, rows=4096)
    last = docs.columns if keep is None else keep
    blocks = list(item_blocks(benchmark, "item_id", "text", TEST_CHARS)) or [[]]
    out = docs.select(*dict.fromkeys([*last, text]))
    for i, block in enumerate(blocks):
        kept = [*(last if i == len(blocks) - 1 else out.columns), *(names if i else ())]
        kept = list(dict.fromkeys(kept))
        more = names if i == 0 else tuple(f"{n}__more" for n in names)
        types = {f.name: f.dataType.simpleString() for f in out.schema}
        shape = ", ".join([*(f"`{c}` {types[c]}" for c in kept), f"`{more[0]}` long", f"`{more[1]}` array<long>", f"`{more[2]}` array<string>"])
        out = out.mapInArrow(_marked(spark.sparkContext.broadcast(Tests(block, window)), text, kept, more), shape)
        if i:
            both = {names[1]: _united(F.col(names[1]), F.col(more[1])), names[2]: F.array_sort(F.array_union(names[2], more[2]))}
            out = out.withColumns(both).drop(*more)
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    marked = mark(docs.select("doc_id", "text"), benchmark, window, keep=["doc_id"])
    n_hit = F.aggregate(F.transform("hit_runs", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda s, x: s + x)
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return marked.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.size("hit_runs") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without a hit word, with their columns."""
    names = []
    for n in ("n_words", "hit_runs", "items"):
        names.append(fresh(docs, n))
    return mark(docs, benchmark, window, names=tuple(names)).filter(F.size(names[1]) == 0).select(*docs.columns)


def _longest(shared, kind: pa.DataType):
    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        for batch in batches:
            rows = pa.Table.from_batches([batch]).take(pc.sort_indices(batch.column("doc_id"), null_placement="at_start")).combine_chunks()
            shard = Shard(rows.column("text").combine_chunks(), tests)
            hit, _, _, length, low, high = shard.search(tests)
            if len(hit):
                place = shard.least(low, high)
                ids = rows.column("doc_id").combine_chunks().take(pa.array(shard.doc[place]))
                yield pa.RecordBatch.from_arrays([pa.array(tests.names).take(pa.array(tests.item[hit])), pa.array(tests.start[hit]), pa.array(length), ids.cast(kind), pa.array(shard.place[place])], ["item_id", "item_start", "length", "doc_id", "doc_start"])

    return longest


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """item_id (as a string), item_start, length, doc_id, doc_start: for each suffix of an item of which a window occurs, its longest verbatim match in all documents, counted in words.

    Of equally long ones the smallest (doc_id, doc_start) is given, a null doc_id first.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    bounded_batches(spark, rows=4096)
    kind, found = docs.schema["doc_id"].dataType, None
    for block in item_blocks(benchmark, "item_id", "text", TEST_CHARS):
        tests = spark.sparkContext.broadcast(Tests(block, window))
        shape = f"item_id string, item_start long, length long, doc_id {kind.simpleString()}, doc_start long"
        part = docs.select("doc_id", "text").mapInArrow(_longest(tests, to_arrow_type(kind)), shape)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"item_id string, item_start long, length long, doc_id {kind.simpleString()}, doc_start long")
    best = found.groupBy("item_id", "item_start").agg(F.min(F.struct((-F.col("length")).alias("l"), "doc_id", "doc_start")).alias("b"))
    return best.select("item_id", "item_start", (-F.col("b.l")).alias("length"), "b.doc_id", "b.doc_start")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
t AS (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS t FROM d),
x AS (SELECT r, i, t, lead(t, 1) OVER o AS t1, lead(t, 2) OVER o AS t2, lead(t, 3) OVER o AS t3, lead(t, 4) OVER o AS t4, lead(t, 5) OVER o AS t5, lead(t, 6) OVER o AS t6, lead(t, 7) OVER o AS t7, lead(t, 8) OVER o AS t8, lead(t, 9) OVER o AS t9
  FROM t WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, k, array_to_string([t, t1, t2, t3, t4, t5, t6, t7, t8, t9][1:k], ' ') AS g FROM x, (SELECT DISTINCT k FROM win) WHERE k = 1 OR [t, t1, t2, t3, t4, t5, t6, t7, t8, t9][k] IS NOT NULL),
occ AS (SELECT r, i, g.k, item FROM g JOIN win ON g.k = win.k AND g.g = win.g),
hit AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT DISTINCT r, i, k FROM occ), range(10) AS z(j) WHERE j < k GROUP BY 1),
items AS (SELECT r, count(DISTINCT item) AS n, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS h FROM occ GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
