"""Keyword search, copies, and overlap between texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.storage import bounded_batches, checkpointed
from sparkloom.functions.text import ngrams, normalized, tokens
from sparkloom.operators.deps import small


#: Before whole sets are compared, a text shows an n-gram in so many more than the prefix filter needs; the more it shows, the more of them must be in other texts.
SPARE = 10


def keyword_search(docs: DataFrame, key: str, text: str, query: list[str], k: int, k1: float = 1.2, b: float = 0.75, mode: str = "word") -> DataFrame:
    """key, score of the k best documents by BM25 (score rounded to 4, ties by key). Only the query's terms are counted; lengths need no shuffle."""
    terms = sorted({q.lower() for q in query})
    words = docs.select(key, tokens(F.col(text), mode).alias("w")).select(key, F.size("w").alias("len"), F.filter("w", lambda x: x.isin(terms)).alias("hits"))
    times = lambda t: F.size(F.filter("hits", lambda x: x == t))
    counts = checkpointed(words.select(key, "len", *(times(t).alias(f"t{i}") for i, t in enumerate(terms))))  # a few numbers a document, so that texts are cut once
    stats = counts.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *(F.count(F.when(F.col(f"t{i}") > 0, 1)).alias(f"d{i}") for i in range(len(terms)))).first()  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(F.lit(1 + (stats["n"] - stats[f"d{i}"] + 0.5) / (stats[f"d{i}"] + 0.5)))
        tf = F.col(f"t{i}").cast("double")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.lit(stats["mean"] or 1.0)))
    return counts.select(key, F.round(score, 4).alias("score")).filter("score > 0").orderBy(F.col("score").desc(), key).limit(k)


def exact_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, kept, group_size of every text: the smallest key with the same normalised text. Groups are counted before they are joined back."""
    hashed = df.select(key, F.sha2(normalized(F.col(text)), 256).alias("h"))
    groups = hashed.groupBy("h").agg(F.min(key).alias("kept"), F.count("*").alias("group_size"))
    return hashed.join(groups, "h").select(key, "kept", "group_size")


def _bands(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """h, id, n: the MinHash bands of each set."""
    least = lambda k: F.array_min(F.transform("g", lambda x: F.xxhash64(F.lit(k), x)))
    keys = F.array(*(F.xxhash64(F.lit(b), *(least(b * rows + r) for r in range(rows))) for b in range(bands)))
    return sets.select(F.explode(keys).alias("h"), "id", "n")


def _hashed(w: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """row, hash: the distinct n-grams of each row of word hashes, ascending in a row."""
    words, ends = w.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(np.diff(w.offsets.to_numpy()))
    if len(words) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        h = (h ^ words[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    whole = row[: len(h)] == row[n - 1 :]
    row, h = row[: len(h)][whole], h[whole].view(np.int64)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def _grams(n: int, t: float | None):
    """Rows of words' hashes (id, w); gives id, n, g of those with an n-gram, or, with t, a row (id, n, h) for each of the least size - ceil(t * size) + 1 + size // SPARE hashes."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, h = _hashed(batch.column("w"), n)
            own, first, size = np.unique(row, return_index=True, return_counts=True)
            if t is None:
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(h)), pa.int32()), pa.array(h))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(own)), pa.array(size, pa.int32()), lists], ["id", "n", "g"])
                continue
            least = np.arange(len(h)) - np.repeat(first, size) < np.repeat(size - np.ceil(size * t - 1e-9).astype(np.int64) + 1 + size // SPARE, size)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row[least])), pa.array(np.repeat(size, size)[least], pa.int32()), pa.array(h[least])], ["id", "n", "h"])

    return grams


def ngram_sets(df: DataFrame, key: str, text: str, n: int, mode: str = "word", t: float | None = None) -> DataFrame:
    """id, n (how many), g (the ascending distinct 64-bit hashes of its word n-grams), h1 and h2 (hashes of the set) of every row with an n-gram, stored.

    With t, only rows that may have a similarity of t to another one (equal sets too), and rows of the same key. Either set of such a pair has the first
    1 + size // SPARE n-grams in common, by hash, among its least size - ceil(t * size) + 1 + size // SPARE ones. The smaller set's size is at least t * the other's, so
    more than t * size // SPARE of these are found in sets of a fitting size. These few hashes are all that is shuffled of the texts that stay alone.
    """
    bounded_batches(df.sparkSession, 1024, "4m")  # a row holds all hashes of a text
    kind = df.schema[key].dataType.simpleString()
    hashed = lambda rows: rows.select(F.col(key).alias("id"), F.transform(tokens(F.col(text), mode), lambda w: F.xxhash64(w)).alias("w"))
    if t is not None:
        least = hashed(df).mapInArrow(_grams(n, t), f"id {kind}, n int, h long")
        by_size = Window.partitionBy("h").orderBy("n")
        near = least.select("id", "n", ((F.lag("n").over(by_size) >= F.col("n") * t - 1e-9) | (F.lead("n").over(by_size) * t - 1e-9 <= F.col("n"))).alias("near"))
        shared = near.filter("near").groupBy("id", "n").agg(F.count("*").alias("shared")).filter(F.col("shared") > F.floor(F.col("n") * t / SPARE - 1e-9))
        ids = checkpointed(shared.select(F.col("id").alias(key)).distinct())
        df = df.join(small(ids), key, "left_semi")
    every = checkpointed(hashed(df).mapInArrow(_grams(n, None), f"id {kind}, n int, g array<long>"))
    return every.withColumns({"h1": F.xxhash64("g"), "h2": F.xxhash64(F.lit(1), "g")})


def prefixes(sets: DataFrame, t: float) -> DataFrame:
    """h, id, n, rest: the n-grams by which sets can meet, and how many n-grams that can be shared come after one. Rarest come first; a pair shares one of the first size - ceil(t * size) + 1 of either set.

    N-grams of one set can't be shared, so a set that has fewer than t * size others isn't in a pair.
    """
    rows = sets.select("id", "n", F.explode("g").alias("h"))
    left = rows.withColumn("df", F.count("*").over(Window.partitionBy("h"))).filter("df > 1")
    least = F.ceil(F.col("n") * t - 1e-9)
    ordered, all_of = Window.partitionBy("id").orderBy("df", "h"), Window.partitionBy("id")
    placed = left.withColumns({"r": F.row_number().over(ordered), "left": F.count("*").over(all_of)})
    return placed.filter(F.col("r") <= F.col("left") - least + 1).select("h", "id", "n", (F.col("left") - F.col("r")).alias("rest"))


def fits(t: float, n_a: str, n_b: str, rest_a: str | None = None, rest_b: str | None = None) -> Column:
    """Whether two sets can have a similarity of t by their sizes and by what comes after the first n-gram that they share. (At a later shared one it may be false; a pair that can is let through at the first.)"""
    sizes = F.least(n_a, n_b) >= t * F.greatest(n_a, n_b) - 1e-9
    return sizes if rest_a is None else sizes & (1 + F.least(rest_a, rest_b) >= t / (1 + t) * (F.col(n_a) + F.col(n_b)) - 1e-9)


def near_duplicates(df: DataFrame, key: str, text: str, n: int, t: float, mode: str = "word", approximate: tuple[int, int] | None = None) -> DataFrame:
    """id_a, id_b, similarity: pairs of different n-gram sets with Jaccard similarity of at least t. The smallest key stands for equal sets.

    Exact by the prefix filter; approximate=(bands, rows) takes pairs that agree in a MinHash band instead, which misses some
    pairs near t. Similarities are exact either way. N-grams are compared by 64-bit hashes. groups.duplicate_groups has the
    representative of every row, and groups without all their pairs.
    """
    every = ngram_sets(df, key, text, n, mode, None if approximate else t)
    first = every.groupBy("h1", "h2").agg(F.min("id").alias("id")).select("id")
    sets = checkpointed(every.join(small(first), "id", "left_semi").select("id", "n", "g"))
    head = checkpointed(_bands(sets, *approximate).withColumn("rest", F.col("n")) if approximate else prefixes(sets, t))
    a, b = (head.select("h", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "rest"))) for x in "ab")
    pairs = checkpointed(a.join(b, (a["h"] == b["h"]) & (F.col("id_a") < F.col("id_b")) & fits(t, "n_a", "n_b", "rest_a", "rest_b")).select("id_a", "id_b").distinct())
    own = sets.select("id", "g")
    full = pairs.join(own.select(F.col("id").alias("id_a"), F.col("g").alias("ga")), "id_a").join(own.select(F.col("id").alias("id_b"), F.col("g").alias("gb")), "id_b")
    full = full.select("id_a", "id_b", F.size("ga").alias("na"), F.size("gb").alias("nb"), F.size(F.array_intersect("ga", "gb")).alias("common"))
    similarity = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    return full.select("id_a", "id_b", similarity.alias("similarity")).filter(F.col("similarity") >= t - 1e-12)


def overlap_with_corpus(df: DataFrame, key: str, text: str, corpus: DataFrame, corpus_text: str, n: int, mode: str = "word") -> DataFrame:
    """key, n_shared: texts that share n-word passages with a protected corpus, and how many different ones. The corpus is cut to distinct passages first, which are broadcast up to a checked count."""
    own = df.select(key, F.explode(ngrams(tokens(F.col(text), mode), n)).alias("g")).select(key, F.xxhash64("g").alias("h"))
    theirs = corpus.select(F.explode(ngrams(tokens(F.col(corpus_text), mode), n)).alias("g")).select(F.xxhash64("g").alias("h")).distinct()
    return own.join(small(theirs), "h", "left_semi").groupBy(key).agg(F.count("*").alias("n_shared"))
