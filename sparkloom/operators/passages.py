"""Passages that texts share with a protected corpus, with their places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.storage import bounded_batches, checkpointed
from sparkloom.functions.text import let, tokens
from sparkloom.operators.deps import small

#: N-grams that a task tests at once.
TESTED = 1 << 18
#: Bits of the filter for each different n-gram of the corpus, and the most bits (16 MB); beyond it more n-grams pass that don't match.
BITS, MOST_BITS = 16, 1 << 27


def placed_ngrams(text: Column, n: int, mode: str = "word") -> Column:
    """The 64-bit hashes of all n-grams in order, repeated ones too."""
    none = F.array().cast("array<bigint>")
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, n)))
    return let(tokens(text, mode), lambda w: F.when(F.size(w) >= n, grams(w)).otherwise(none))


def bloom_words(hashes: DataFrame, h: str = "h") -> tuple[np.ndarray, int]:
    """The 64-bit words of a Bloom filter of two bits a hash, and its number of bits. Set bits are united in Spark; the driver gets MOST_BITS / 64 rows at most."""
    count = hashes.count()
    bits = min(MOST_BITS, max(1 << 10, 1 << (BITS * count - 1).bit_length())) if count else 1 << 10
    slots = F.array(F.col(h).bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1)))
    words = hashes.select(F.explode(slots).alias("s")).select((F.col("s") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(s % 64 as int))").alias("bit"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        out[r["word"]] = r["bits"]
    return out.view(np.uint64), bits


def _sieved(shared, kind: pa.DataType):
    """Rows of all hashes of a text; gives key, place, h of those that the filter lets through."""

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = shared.value
        for batch in batches:
            lists = batch.column("g")
            hashes, ends = lists.flatten(), np.cumsum(np.diff(lists.offsets.to_numpy()))
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            for a in range(0, len(hashes), TESTED):
                h = hashes.slice(a, TESTED).to_numpy(zero_copy_only=False).view(np.uint64)
                left = np.arange(len(h))
                for shift in (0, 32):
                    s = (h[left] >> np.uint64(shift)) & np.uint64(bits - 1)
                    left = left[(words[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1) == 1]
                row = np.searchsorted(ends, a + left, side="right")
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)).cast(kind), pa.array(a + left - starts[row]), pa.array(h[left].view(np.int64))], ["key", "place", "h"])

    return sieve


def shared_passages(df: DataFrame, key: str, text: str, corpus: DataFrame, corpus_key: str, corpus_text: str, n: int = 8, mode: str = "word") -> DataFrame:
    """key, start, end, item, item_start: each maximal stretch of n words or more that a text has in common with a corpus text, in words (end exclusive).

    A Bloom filter of the corpus' n-grams is tested before anything is shuffled, so only n-grams that the corpus (nearly
    always) has are joined. Matches on one diagonal, place minus the corpus text's place, that follow each other are one
    stretch. N-grams are compared by 64-bit hashes. Null texts have no words; rows that share a key are taken as one text's.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, kind = df.sparkSession, df.schema[key].dataType
    bounded_batches(spark, 1024, "2m")  # a row holds all hashes of a text
    theirs = checkpointed(corpus.select(F.col(corpus_key).alias("item"), F.posexplode(placed_ngrams(F.col(corpus_text), n, mode)).alias("item_place", "h")))
    shared = spark.sparkContext.broadcast(bloom_words(theirs.select("h").distinct()))
    own = df.select(F.col(key).alias("key"), placed_ngrams(F.col(text), n, mode).alias("g"))
    seeds = own.mapInArrow(_sieved(shared, to_arrow_type(kind)), f"key {kind.simpleString()}, place long, h long")
    met = seeds.join(small(theirs), "h").select("key", "item", "place", (F.col("place") - F.col("item_place")).alias("diagonal")).distinct()
    on = Window.partitionBy("key", "item", "diagonal").orderBy("place")
    runs = met.withColumn("run", F.col("place") - F.row_number().over(on)).groupBy("key", "item", "diagonal", "run").agg(F.min("place").alias("start"), F.max("place").alias("last"))
    return runs.select(F.col("key").alias(key), "start", (F.col("last") + n).alias("end"), "item", (F.col("start") - F.col("diagonal")).alias("item_start"))
