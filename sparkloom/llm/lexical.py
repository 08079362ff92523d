"""Ranked lexical search by presence masks: the documents of a block are grouped by which of an item's terms they hold.

1. One pass cuts all texts into terms and keeps, a document, its length and the counts of those terms that any item has. The
   corpus figures (documents, terms, document frequencies) are aggregated from these rows, over all documents.
2. Blocks of these rows become one bitmap a term. For an item, the bitmaps of its terms are combined into a mask a
   document, and equal masks are one group. The most that a mask can score is the sum of its terms' largest parts in the
   block. Groups are scored by descending bound until no group left can reach the item's k-th best score so far, which a
   task carries from block to block. Each task gives k documents an item at most; a window takes the k best of these.

The items are a query set: they are broadcast in blocks of ITEM_CHARS code points, and each block meets all documents.

Defined results: null and empty texts have no terms; neither do they count as documents nor are they found. Rows with equal
item_id and text are one item; every row of the documents is a document of its own, also repeated ones (equal scores by ascending
doc_id, null first). Items without terms, and items of which no document has a term, give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import bounded_batches, checkpointed
from sparkloom.llm.terms import cut, item_blocks, numbered

#: Code points of items that one pass takes.
ITEM_CHARS = 8_000_000
#: Documents and postings of a block.
BLOCK_DOCS = 8_192
BLOCK_POSTINGS = 4_000_000
#: Documents that are scored at once, at least.
STEP = 64


def _postings(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms a text, and the terms of the vocabulary with their counts: bounds, numbers, counts."""
    ids, bounds = numbered(texts, vocabulary)
    lengths = np.diff(bounds)
    doc = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    known = ids >= 0
    keys, counts = np.unique(doc[known] * len(vocabulary) + ids[known], return_counts=True)
    at = np.searchsorted(keys, np.arange(len(lengths) + 1) * len(vocabulary))
    return lengths, at, (keys % max(1, len(vocabulary))).astype(np.int32), counts.astype(np.int32)


def _counted(vocabulary: pa.Array):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, at, terms, counts = _postings(batch.column("text"), vocabulary)
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths), *lists], ["doc_id", "n", "terms", "counts"])

    return count


class _Best:
    """The k best (score, doc_id) of one item so far."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, []

    @property
    def bar(self) -> int:
        """A score below this can't enter."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, places: np.ndarray, ids: pa.Array) -> None:
        good = np.flatnonzero(scores >= self.bar)
        if len(good) > self.k:  # the bar that these alone set
            good = good[scores[good] >= np.partition(scores[good], -self.k)[-self.k]]
        found = zip(scores[good].tolist(), ids.take(pa.array(places[good])).to_pylist(), strict=True)
        self.rows = sorted([*self.rows, *found], key=lambda x: (-x[0], x[1] is not None, x[1]))[: self.k]


class Block:
    """Rows of documents, seen by document and as one bitmap a term."""

    def __init__(self, ids: pa.Array, n: np.ndarray, bounds: np.ndarray, terms: np.ndarray, counts: np.ndarray, n_docs: int, n_terms: int, vocabulary: int) -> None:
        self.ids, self.bounds, self.terms = ids, bounds, terms
        if 90 * n_docs * int(n.max(initial=0)) < 2**63:
            m = 10 + 90 * n * n_docs // max(1, n_terms)
        else:
            m = np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)
        doc, counts = np.repeat(np.arange(len(n)), np.diff(bounds)), counts.astype(np.int64)
        #: What each posting adds to a score, but for the term's weight.
        self.parts = 1_000_000_000 * counts // (1000 * counts + 8 * m[doc])
        order = np.argsort(terms, kind="stable")
        self.starts = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        self.holders = doc[order]
        self.largest = np.zeros(vocabulary, np.int64)
        np.maximum.at(self.largest, terms, self.parts)

    def masks(self, terms: np.ndarray) -> np.ndarray:
        """For each document, which of the terms it holds, as rows of 64-bit words."""
        out = np.zeros((len(self.ids), max(1, -(-len(terms) // 64))), np.uint64)
        for j, t in enumerate(terms.tolist()):
            out[self.holders[self.starts[t] : self.starts[t + 1]], j >> 6] |= np.uint64(1 << (j & 63))
        return out

    def groups(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents ordered by descending bound of their mask, where each mask's documents begin, and the bounds."""
        masks = self.masks(terms)
        rows = masks[:, 0] if masks.shape[1] == 1 else masks.view([("", np.uint64)] * masks.shape[1])[:, 0]
        distinct, group = np.unique(rows, return_inverse=True)
        words = distinct.view(np.uint64).reshape(len(distinct), -1)
        bounds = np.zeros(len(distinct), np.int64)
        for j, most in enumerate((weights * self.largest[terms]).tolist()):
            bounds += ((words[:, j >> 6] >> np.uint64(j & 63)) & np.uint64(1)).astype(np.int64) * most
        down = np.argsort(-bounds, kind="stable")
        place = np.empty_like(down)
        place[down] = np.arange(len(down))
        docs = np.argsort(place[group], kind="stable")
        return docs, np.searchsorted(place[group][docs], np.arange(len(down) + 1)), bounds[down]

    def scores(self, docs: np.ndarray, weight_of: np.ndarray) -> np.ndarray:
        """The whole scores of documents that hold a term at least."""
        sizes = np.diff(self.bounds)[docs]
        firsts = np.cumsum(sizes) - sizes
        at = np.repeat(self.bounds[docs] - firsts, sizes) + np.arange(sizes.sum())
        return np.add.reduceat(weight_of[self.terms[at]] * self.parts[at], firsts)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: _Best, scratch: np.ndarray) -> int:
        """Adds this block's documents to the best; gives how many were scored. scratch: zeros, one a term."""
        docs, starts, bounds = self.groups(terms, weights)
        scratch[terms] = weights
        g = scored = 0
        while g < len(bounds) and bounds[g] > 0 and bounds[g] >= best.bar:
            end = min(max(g + 1, int(np.searchsorted(starts, starts[g] + STEP))), len(bounds))
            end = g + int(np.searchsorted(-bounds[g:end], -max(1, best.bar), side="right"))
            chosen = docs[starts[g] : starts[end]]
            best.add(self.scores(chosen, scratch), chosen, self.ids)
            scored, g = scored + len(chosen), end
        scratch[terms] = 0
        return scored


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of BLOCK_DOCS documents or BLOCK_POSTINGS postings."""
    held, docs, postings = [], 0, 0
    for batch in batches:
        held.append(batch)
        docs, postings = docs + batch.num_rows, postings + len(batch.column("terms").flatten())
        if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, docs, postings = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _searched(shared, k: int, n_docs: int, n_terms: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, items = shared.value
        best, scratch, kind = [_Best(k) for _ in items], np.zeros(vocabulary, np.int64), pa.int64()
        for table in _blocks(batches):
            column = lambda name: table.column(name).combine_chunks()  # noqa: E731, B023
            ids, terms = column("doc_id"), column("terms")
            kind = ids.type
            block = Block(ids, column("n").to_numpy(), terms.offsets.to_numpy().astype(np.int64), terms.values.to_numpy(), column("counts").values.to_numpy(), n_docs, n_terms, vocabulary)
            for (own, weights), b in zip(items, best, strict=True):
                block.search(own, weights, b, scratch)
        rows = [(i, score, doc) for i, b in enumerate(best) for score, doc in b.rows]
        if rows:
            item, score, doc = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(score, pa.int64()), pa.array(doc, kind)], ["item", "score", "doc_id"])

    return search


def _ranked(docs: DataFrame, items: list[tuple], k: int, schemas: tuple[str, str]) -> DataFrame:
    """item_id, doc_id, score, rank for one block of items."""
    spark, (doc_type, item_type) = docs.sparkSession, schemas
    words, bounds = cut(pa.array([t for _, t in items], pa.large_string()))
    coded = words.dictionary_encode()
    vocabulary, number = coded.dictionary, coded.indices.to_numpy()
    own = [np.unique(number[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    counted = docs.filter(F.length("text") > 0).mapInArrow(_counted(vocabulary), f"doc_id {doc_type}, n long, terms array<int>, counts array<int>")
    rows = checkpointed(counted.filter("n > 0"))
    n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = dict(rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # terms of the items only
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    found = [np.array([t for t in x.tolist() if t in held and weight[t] > 0], np.int64) for x in own]
    shared = spark.sparkContext.broadcast((len(vocabulary), [(x, weight[x]) for x in found]))
    hits = rows.filter(F.size("terms") > 0).mapInArrow(_searched(shared, k, n_docs, n_terms), f"item int, score long, doc_id {doc_type}")
    place = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], f"item int, item_id {item_type}")
    ranked = hits.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: for each item (item_id, text) the k documents (doc_id, text) of highest score above 0."""
    bounded_batches(docs.sparkSession, rows=4096)
    schemas = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    parts = [_ranked(texts, block, k, schemas) for block in item_blocks(items, "item_id", "text", ITEM_CHARS)]
    empty = docs.sparkSession.createDataFrame([], f"item_id {schemas[1]}, rank int, doc_id {schemas[0]}, score long")
    return reduce(DataFrame.unionByName, parts) if parts else empty


_TERMS = r"list_transform(regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("coalesce(text, '')")} AS w FROM documents),
l AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM l),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, text, unnest({_TERMS.format("coalesce(text, '')")}) AS t FROM benchmark),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t, docs),
m AS (SELECT r, doc_id, 10 + (90 * n * docs) // terms AS m FROM l, s),
x AS (SELECT item_id, text, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0
WINDOW o AS (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST) QUALIFY row_number() OVER o <= 10
"""
