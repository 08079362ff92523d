"""Blocked terms of one or several words, overlapping ones too, by an automaton over words (Aho-Corasick)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import tokens

#: Terms that one pass over the texts takes.
TERMS = 200_000


class Automaton:
    """A trie of terms (lists of words) with failure links; words are numbers."""

    def __init__(self, terms: list[list[str]]) -> None:
        self.vocabulary = pa.array(sorted({w for t in terms for w in t}), pa.string())
        number = {w: i for i, w in enumerate(self.vocabulary.to_pylist())}
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for i, term in enumerate(terms):
            state = 0
            for w in term:
                if number[w] not in self.next[state]:
                    self.next[state][number[w]] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                state = self.next[state][number[w]]
            self.ends[state].append(i)
        self.fail, self.output = [0] * len(self.next), [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:  # by depth, so that shorter suffixes are done
            state = queue.popleft()
            shorter = self.fail[state]
            #: The longest proper suffix that is a term.
            self.output[state] = shorter if self.ends[shorter] else self.output[shorter]
            for w, child in self.next[state].items():
                self.fail[child] = self.step(shorter, w) if state else 0
                queue.append(child)

    def step(self, state: int, word: int) -> int:
        while word not in self.next[state]:
            if not state:
                return 0
            state = self.fail[state]
        return self.next[state][word]

    def hits(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """Term and place of its last word, for every occurrence; -1 is a word of no term."""
        state = 0
        for place, w in enumerate(words):
            state = self.step(state, w) if w >= 0 else 0
            at = state if self.ends[state] else self.output[state]
            while at:
                for term in self.ends[at]:
                    yield term, place
                at = self.output[at]


def _found(shared, kind: pa.DataType):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, automaton = shared.value
        for batch in batches:
            lists = batch.column("w")
            ids = pc.fill_null(pc.index_in(lists.flatten(), value_set=automaton.vocabulary), -1).to_numpy(zero_copy_only=False)
            bounds = np.cumsum([0, *pc.list_value_length(lists).to_pylist()])
            row, term, start = [], [], []
            for i in np.unique(np.searchsorted(bounds, np.flatnonzero(ids >= 0), side="right") - 1).tolist():  # texts with a word of a term
                for t, place in automaton.hits(ids[bounds[i] : bounds[i + 1]].tolist()):
                    row.append(i)
                    term.append(t)
                    start.append(place + 1 - len(terms[t]))
            names = pa.array([" ".join(t) for t in terms], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row, pa.int64())).cast(kind), names.take(pa.array(term, pa.int64())), pa.array(start, pa.int64())], ["key", "term", "start"])

    return find


def term_hits(df: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """key, term (its words, lower-cased, joined by spaces), start (in words) of every occurrence of every term, overlapping ones too.

    Terms are cut into words as texts are, so case, punctuation and line ends between words don't matter; terms without
    a word are ignored. They are taken TERMS at a time, each in one pass that shuffles nothing.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, kind = df.sparkSession, df.schema[key].dataType
    wanted = terms.select(tokens(F.col(term)).alias("w")).filter(F.size("w") > 0).distinct()
    parts = max(1, -(-wanted.count() // TERMS))
    own, out = df.select(F.col(key).alias("key"), tokens(F.col(text)).alias("w")), None
    for p in range(parts):
        part = wanted if parts == 1 else wanted.filter(F.pmod(F.xxhash64("w"), F.lit(parts)) == p)
        rows = sorted(list(r["w"]) for r in part.collect())
        shared = spark.sparkContext.broadcast((rows, Automaton(rows)))
        found = own.mapInArrow(_found(shared, to_arrow_type(kind)), f"key {kind.simpleString()}, term string, start long")
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("key", key)


def blocked_phrases(df: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """key, term, n: how often each blocked term is in each text."""
    return term_hits(df, key, text, terms, term).groupBy(key, "term").agg(F.count("*").alias("n"))
