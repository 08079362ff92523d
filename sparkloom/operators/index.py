"""A stored inverted index for keyword search, with block-max pruning, for tables of queries.

Documents are dealt to blocks of about BLOCK by their length and a hash. Texts are shuffled once, by block; a task inverts its blocks, so that
all of a block is in one file. A row of `postings` is one term in one block: places in the block with counts, and the (count, length) pairs that no
other pair beats, from which comes the most that the term can add to a score there but for its idf. The row of the term "" lists the block's documents.
A search sums these figures to the most that a block can score for a query, scores each query's best blocks first, and then
only those blocks that can still reach its k-th best score. A block is scored in one task. The result is that of scanning all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.storage import checkpointed
from sparkloom.functions.text import tokens
from sparkloom.operators.deps import small

#: Documents a block, and bytes of text, at most (a longer text is a block by itself).
BLOCK, BLOCK_BYTES = 512, 1 << 24
#: Up to so many distinct terms of queries are pushed down to the scan of the postings, which are sorted by term in each file.
PUSHED = 2_000
#: Scores that a task holds at once.
SCORES = 1 << 21


def _lists(values: np.ndarray | pa.Array, ends: np.ndarray) -> pa.Array:
    """Lists of values that follow each other, by their ends."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values))


def _inverted(docs: pa.Table) -> pa.Table:
    """The postings of one block of documents (block, key, w)."""
    words = docs["w"].combine_chunks()
    length = np.diff(words.offsets.to_numpy()).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    term, n = coded.dictionary, len(length)
    pair, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), length), return_counts=True)
    code, at = pair // n, pair % n
    order = np.lexsort((length[at], -tf, code))
    c, f, le = code[order], tf[order], length[at][order]
    least = np.minimum.accumulate(le - c * (length.max() + 1))  # of the pairs before, in the same term
    top = np.ones(len(c), bool)
    top[1:] = least[1:] < least[:-1]
    count = lambda x: np.cumsum(np.bincount(x, minlength=len(term)))
    tops = pa.StructArray.from_arrays([pa.array(f[top], pa.int32()), pa.array(le[top], pa.int32())], ["tf", "len"])
    none = pa.nulls(len(term), pa.list_(docs["key"].type)), pa.nulls(len(term), pa.list_(pa.int32()))
    names = ["term", "block", "tops", "at", "tf", "key", "len"]
    block = docs["block"][0].as_py()
    rows = pa.Table.from_arrays([term, pa.array([block] * len(term), pa.int64()), _lists(tops, count(c[top])), _lists(at.astype(np.int32), count(code)), _lists(tf.astype(np.int32), count(code)), *none], names)
    empty = [pa.nulls(1, rows[x].type) for x in ("tops", "at", "tf")]
    own = pa.Table.from_arrays([pa.array([""]), pa.array([block], pa.int64()), *empty, _lists(docs["key"].combine_chunks(), np.array([n])), _lists(length.astype(np.int32), np.array([n]))], names)
    return pa.concat_tables([rows, own])


def _impact(tf: Column, length: Column, mean: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def build_index(docs: DataFrame, key: str, text: str, path: str, mode: str = "word", k1: float = 1.2, b: float = 0.75) -> None:
    """Writes path/postings (term, block, tops, at, tf; for the term "" key, len), path/terms (term, df) and path/facts (one row).

    Null and empty texts count as documents of length 0. Rows that share a key are different documents.
    """
    band = F.floor(4 * F.log2(F.octet_length("text") + 1)).cast("int")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text")).withColumns({"row": F.monotonically_increasing_id(), "band": band})
    most = F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("text")) / BLOCK_BYTES)
    parts = checkpointed(rows.groupBy("band").agg(F.ceil(most).cast("long").alias("parts")))  # one row a quarter of a power of two
    block = F.col("band").cast("long") * (1 << 40) + F.pmod(F.xxhash64("row"), F.col("parts"))
    dealt = rows.join(F.broadcast(parts), "band").select(block.alias("block"), "key", "text").repartition("block").sortWithinPartitions("block")
    kind = docs.schema[key].dataType.simpleString()
    shape = f"term string, block long, tops array<struct<tf:int,len:int>>, at array<int>, tf array<int>, key array<{kind}>, len array<int>"
    postings = dealt.select("block", "key", tokens(F.col("text"), mode).alias("w")).groupBy("block").applyInArrow(_inverted, shape)
    postings.sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/postings")
    written = rows.sparkSession.read.parquet(f"{path}/postings")
    lengths = written.filter("term = ''").select(F.size("key").alias("n"), F.aggregate("len", F.lit(0).cast("long"), lambda x, y: x + y).alias("words"))
    facts = lengths.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.nullif(F.sum("words") / F.sum("n"), F.lit(0.0)), F.lit(1.0)).alias("mean"), F.lit(k1).alias("k1"), F.lit(b).alias("b"), F.lit(mode).alias("mode"))
    facts.coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")
    df = written.filter("term <> ''").groupBy("term").agg(F.sum(F.size("at")).alias("df"))
    df.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")


def _best(k: int, mean: float, k1: float, b: float):
    """Scores one block: postings with the queries that ask for them (the documents' row has no query), and the queries that need the block. Gives what can be among a query's k best."""

    def best(postings: pa.Table, needed: pa.Table) -> pa.Table:
        own = postings.filter(pc.equal(postings["term"], ""))
        asked = postings.filter(pc.is_in(postings["query"], needed["query"].combine_chunks())) if own.num_rows else postings.slice(0, 0)
        kind = pa.schema([("query", postings.schema.field("query").type), ("key", postings.schema.field("key").type.value_type), ("score", pa.float64())])
        found = []
        if asked.num_rows:
            key, length = own["key"].combine_chunks().flatten(), own["len"].combine_chunks().flatten().to_numpy()
            base = k1 * (1 - b + b * length / mean)
            asked = asked.take(pc.sort_indices(asked, [("query", "ascending"), ("term", "ascending")]))
            queries = asked["query"].combine_chunks().dictionary_encode()
            code, idf, n = queries.indices.to_numpy(zero_copy_only=False), asked["idf"].to_numpy(), len(length)
            step = max(1, SCORES // n)
            for first in range(0, len(queries.dictionary), step):
                x, y = np.searchsorted(code, [first, first + step])
                at, tf = (asked[c].slice(x, y - x).combine_chunks() for c in ("at", "tf"))
                times = pc.list_value_length(at).to_numpy()
                at, tf = at.flatten().to_numpy(), tf.flatten().to_numpy()
                part = np.repeat(idf[x:y], times) * (tf * (k1 + 1) / (tf + base[at]))
                scores = np.bincount(np.repeat(code[x:y] - first, times) * n + at, weights=part, minlength=n * (code[y - 1] + 1 - first)).reshape(-1, n)
                bar = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.zeros(len(scores))
                q, row = np.nonzero((scores >= bar[:, None] - 1e-3) & (scores > 0))  # scores are ordered by four decimals
                found.append(pa.Table.from_arrays([queries.dictionary.take(pa.array(q + first)), key.take(pa.array(row)), pa.array(scores[q, row])], schema=kind))
        return pa.concat_tables(found) if found else kind.empty_table()

    return best


class Index:
    """A written index. search() answers a table of queries in one plan."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.facts = spark.read.parquet(f"{path}/facts").first()  # one row
        self.postings, self.terms = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms")

    def asked(self, queries: DataFrame, query: str, text: str) -> DataFrame:
        """query, term, idf of the distinct terms of each query that the index has. A query without a name isn't answered."""
        each = queries.filter(F.col(query).isNotNull()).select(F.col(query).alias("query"), F.explode(F.array_distinct(tokens(F.col(text), self.facts["mode"]))).alias("term"))
        idf = F.log(1 + (F.lit(float(self.facts["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return checkpointed(each.distinct().join(self.terms, "term").select("query", "term", idf.alias("idf")))

    def of_terms(self, asked: DataFrame) -> DataFrame:
        """The postings of the terms that are asked for, and the documents of all blocks."""
        distinct = asked.select("term").distinct()
        few = [r[0] for r in distinct.limit(PUSHED + 1).collect()]
        if len(few) <= PUSHED:
            return self.postings.filter(F.col("term").isin(["", *few]))
        none = asked.sparkSession.range(1).select(F.lit("").alias("term"))
        return self.postings.join(small(distinct.unionByName(none)), "term", "left_semi")

    def bounds(self, asked: DataFrame) -> DataFrame:
        """query, block, bound: the most that a document of the block can score. Reads no documents' entries."""
        impact = lambda t: _impact(t["tf"], t["len"], F.lit(self.facts["mean"]), self.facts["k1"], self.facts["b"])
        heads = self.of_terms(asked).select("term", "block", F.array_max(F.transform("tops", impact)).alias("most"))
        return heads.join(small(asked), "term").groupBy("query", "block").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))

    def scored(self, asked: DataFrame, needed: DataFrame, k: int) -> DataFrame:
        """query, key, score: the k best documents of each query in the blocks that it needs. The postings of these blocks are shuffled once, whatever the number of queries."""
        wanted = needed.select(*(F.col(c).alias(c) for c in ("query", "block")))  # columns of its own, which a cogroup needs
        near = self.of_terms(asked).join(small(needed.select("block").distinct()), "block", "left_semi").repartition("block")
        lists = near.join(small(asked), "term", "left").select("block", "term", "query", "idf", "at", "tf", "key", "len")
        shape = f"query {asked.schema['query'].dataType.simpleString()}, key {self.postings.schema['key'].dataType.elementType.simpleString()}, score double"
        every = lists.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_best(k, *(self.facts[c] for c in ("mean", "k1", "b"))), shape)
        best = Window.partitionBy("query").orderBy(F.round("score", 4).desc(), "key")
        return every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query", "key", "score")

    def needed(self, asked: DataFrame, k: int, probes: int = 2) -> tuple[DataFrame, DataFrame]:
        """Of each query, the blocks that can reach its k-th best score (query, block, bound, probed); and the best documents of those probed first."""
        bounds = checkpointed(self.bounds(asked))
        place = Window.partitionBy("query").orderBy(F.col("bound").desc(), "block")
        first = bounds.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= probes).select("query", "block")
        probed = checkpointed(self.scored(asked, first, k))
        bar = probed.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("bar"))
        rest = bounds.join(first.withColumn("probed", F.lit(True)), ["query", "block"], "left").join(bar, "query", "left")
        reach = F.col("bar").isNull() | (F.col("bound") >= F.col("bar") - 1e-4)  # scores are ordered by four decimals
        return checkpointed(rest.filter(F.col("probed") | reach).select("query", "block", "bound", F.coalesce("probed", F.lit(False)).alias("probed"))), probed

    def search(self, queries: DataFrame, k: int, query: str = "query", text: str = "text") -> DataFrame:
        """query, rank, key, score: the k best documents of each query by BM25 (score rounded to 4, ties by key)."""
        asked = self.asked(queries, query, text)
        needed, probed = self.needed(asked, k)
        every = probed.unionByName(self.scored(asked, needed.filter("not probed"), k)).withColumn("score", F.round("score", 4))
        best = Window.partitionBy("query").orderBy(F.col("score").desc(), "key")
        return every.withColumn("rank", F.row_number().over(best)).filter((F.col("rank") <= k) & (F.col("score") > 0)).select(F.col("query").alias(query), "rank", "key", "score")
