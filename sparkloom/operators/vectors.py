"""Nearest vectors by cosine: all against all in blocks, and a stored index that skips what the triangle inequality rules out.

Vectors are scaled to length 1, so that the nearest by cosine are the nearest by distance. The index assigns each to the
nearest of some centroids, fitted on a bounded sample, and cuts a cluster into rings by distance from its centroid. A query at
distance d from a centroid is at least max(d - high, low - d) away from a ring between low and high. Each query first meets its
own cluster, whose k-th best distance is its bar; then it meets those rings that can hold something within the bar, wherever they are. The
result is exact, whatever the sample.

Null, zero-length and non-finite vectors take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from sparkloom.functions.storage import checkpointed

#: Queries that one pass over the vectors takes.
QUERIES = 4_096
#: Vectors that centroids are fitted on, and the most centroids.
SAMPLE, CENTROIDS = 20_000, 1_024
#: Rings a unit of distance; distances of unit vectors are at most 2.
RINGS = 32
#: Vectors scored at once, and the most scores at once.
ROWS, SCORES = 2_048, 1 << 21


def unit_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, unit (array<double> of length 1)."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(key).alias("key"), v.alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    good = (F.col("norm") > 0) & (F.col("norm") < float("inf"))  # a null makes the norm null, not-a-number is larger than all
    return rows.filter(good).select("key", F.transform("v", lambda x: x / F.col("norm")).alias("unit"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class _Best:
    """The k best (score, key) of many queries; scores by six decimals, ties by key."""

    def __init__(self, k: int, own: list, bars: np.ndarray) -> None:
        self.k, self.own, self.bars = k, pd.Series(own, dtype=object), bars.copy()
        self.rows = pd.DataFrame({"query": np.zeros(0, np.int64), "key": pd.Series([], dtype=object), "score": np.zeros(0)})

    def add(self, queries: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> None:
        """scores: a row a vector, a column a query. Only the k + 1 best of each query, one of which may be its own, are looked at further."""
        row, column = self._front(queries, keys, scores)
        found = pd.DataFrame({"query": queries[column], "key": keys[row], "score": np.round(scores[row, column], 6)})
        found = found[self.own.iloc[found["query"]].to_numpy() != found["key"].to_numpy()]
        if len(found):
            every = pd.concat([self.rows, found]) if len(self.rows) else found
            self.rows = every.sort_values(["query", "score", "key"], ascending=[True, False, True], na_position="first").groupby("query").head(self.k)
            full = self.rows.groupby("query")["score"].agg(["size", "min"])
            full = full[full["size"] == self.k]
            self.bars[full.index] = np.maximum(self.bars[full.index], full["min"])

    def _front(self, queries: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the k + 1 best scores of each column (six decimals, ties by key) that reach its bar."""
        if len(keys) > self.k + 1:
            place = np.empty(len(keys), np.int64)
            place[pd.Series(keys, dtype=object).sort_values(kind="stable", na_position="first").index] = np.arange(len(keys))
            by = np.rint(scores * 1e6).astype(np.int64)
            by *= -len(keys)
            by += place[:, None]
            row = np.argpartition(by, self.k, axis=0)[: self.k + 1]
        else:
            row = np.repeat(np.arange(len(keys))[:, None], len(queries), 1)
        at, column = np.nonzero(np.take_along_axis(scores, row, 0) >= self.bars[queries] - 1e-6)
        return row[at, column], column

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.rows["query"], pa.int64()), pa.array(self.rows["key"].tolist(), kind), pa.array(self.rows["score"], pa.float64())], ["number", "key", "score"])


def _scanned(shared, k: int, kind: pa.DataType):
    """Every vector against every query of a pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, units, bars = shared.value
        best, every = _Best(k, own, bars), np.arange(len(own))
        for batch in batches:
            keys, rows = np.array(batch.column("key").to_pylist(), object), _matrix(batch.column("unit"), units.shape[1])
            step = max(1, min(ROWS, SCORES // max(1, len(own))))
            for a in range(0, len(keys), step):
                best.add(every, keys[a : a + step], rows[a : a + step] @ units.T)
        yield best.batch(kind)

    return scan


def _passes(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """Keys and unit vectors of the queries, QUERIES at a time."""
    parts = max(1, -(-queries.count() // QUERIES))
    for p in range(parts):
        part = queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("key", "unit"), F.lit(parts)) == p)
        if rows := part.collect():
            yield [r["key"] for r in rows], np.array([r["unit"] for r in rows])


def _named(spark: SparkSession, hits: DataFrame, own: list, k: int, kind: str, key: str) -> DataFrame:
    """query, rank, key, score of the k best of each query's hits."""
    names = spark.createDataFrame(list(enumerate(own)), f"number long, query {kind}")
    place = Window.partitionBy("number").orderBy(F.col("score").desc(), "key")
    ranked = hits.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "number").select("query", "rank", F.col("key").alias(key), "score")


def _united(parts: list[DataFrame], spark: SparkSession, kind: str, key: str) -> DataFrame:
    out = parts[0] if parts else spark.createDataFrame([], f"query {kind}, rank int, {key} {kind}, score double")
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query, rank, key, score: the k nearest by cosine of each query but itself, by comparing all (score rounded to 6, ties by key).

    Queries are taken QUERIES at a time; each task keeps its k best of each.
    """
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType
    rows, parts = unit_vectors(vectors, key, vector), []
    for own, units in _passes(unit_vectors(queries, key, vector)):
        shared = spark.sparkContext.broadcast((own, units, np.full(len(own), -2.0)))
        hits = rows.mapInArrow(_scanned(shared, k, to_arrow_type(kind)), f"number long, key {kind.simpleString()}, score double")
        parts.append(_named(spark, hits, own, k, kind.simpleString(), key))
    return _united(parts, spark, kind.simpleString(), key)


def _assigned(shared):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for batch in batches:
            rows = _matrix(batch.column("unit"), centroids.shape[1])
            cluster, distance = _closest(rows, centroids)
            ring = np.floor(distance * RINGS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("unit"), pa.array(cluster.astype(np.int32)), pa.array(ring), pa.array(distance)], ["key", "unit", "cluster", "ring", "distance"])

    return assign


def _distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """From each row to each centroid; centroids needn't be of length 1."""
    squares = (rows * rows).sum(1)[:, None] + (centroids * centroids).sum(1)[None] - 2 * rows @ centroids.T
    return np.sqrt(np.maximum(squares, 0))


def _closest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = _distances(rows, centroids)
    cluster = near.argmin(1)
    return cluster, near[np.arange(len(rows)), cluster]


def build_vector_index(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", clusters: int | None = None) -> None:
    """Writes path/vectors (key, unit, cluster, ring, distance) sorted by ring, path/rings (cluster, ring, low, high, n) and path/centroids.

    Centroids are fitted by k-means on SAMPLE vectors at most, those of least hash; by default there are as many as the root of the number of vectors, up to CENTROIDS.
    """
    spark = vectors.sparkSession
    rows = unit_vectors(vectors, key, vector)
    count = rows.count()
    wanted = clusters or max(1, min(CENTROIDS, math.isqrt(count)))
    sample = rows.orderBy(F.xxhash64("key", "unit")).limit(SAMPLE).select(array_to_vector("unit").alias("features"))
    centers = np.array(KMeans(k=wanted, seed=7, maxIter=15).fit(checkpointed(sample)).clusterCenters()) if count > wanted > 1 else np.zeros((1, len(first["unit"]) if (first := rows.first()) else 1))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cluster int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    shape = f"key {vectors.schema[key].dataType.simpleString()}, unit array<double>, cluster int, ring int, distance double"
    dealt = rows.mapInArrow(_assigned(spark.sparkContext.broadcast(centers)), shape)
    dealt.repartitionByRange("cluster", "ring", "distance", "key").sortWithinPartitions("cluster", "ring", "distance").write.mode("overwrite").parquet(f"{path}/vectors")
    written = spark.read.parquet(f"{path}/vectors")
    rings = written.groupBy("cluster", "ring").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n"))
    rings.coalesce(1).write.mode("overwrite").parquet(f"{path}/rings")


#: Distances are compared with this much to spare.
SPARE = 1e-6


def _ruled_in(near: np.ndarray, low: float, high: float, bars: np.ndarray) -> np.ndarray:
    """The queries, at distances `near` from a centroid, that may have something within their bar between low and high from it."""
    return np.flatnonzero(np.maximum(near - high, low - near) <= bars + SPARE)


def _met(shared, k: int, kind: pa.DataType, first: bool):
    """Rows sorted by ring against the queries that the ring isn't ruled out for. first: own clusters alone, else the others alone."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, units, centroids, bars = shared.value
        near = _distances(units, centroids)
        home = near.argmin(1)
        best = _Best(k, own, 1 - bars * bars / 2)
        for batch in batches:
            cluster, ring = batch.column("cluster").to_numpy(), batch.column("ring").to_numpy()
            distance, rows = batch.column("distance").to_numpy(), _matrix(batch.column("unit"), units.shape[1])
            keys = np.array(batch.column("key").to_pylist(), object)
            cuts = [0, *(np.flatnonzero((np.diff(cluster) != 0) | (np.diff(ring) != 0)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                c = cluster[a]
                bar = np.sqrt(np.maximum(2 - 2 * (best.bars - 1e-6), 0))
                asked = _ruled_in(near[:, c], distance[a:b].min(), distance[a:b].max(), bar)
                asked = asked[(home[asked] == c) == first]
                step = max(1, min(ROWS, SCORES // max(1, len(asked))))
                for i in range(a, b if len(asked) else a, step):
                    best.add(asked, keys[i : min(i + step, b)], rows[i : min(i + step, b)] @ units[asked].T)
        yield best.batch(kind)

    return meet


def _needed(shared):
    """Rings that some query of a pass isn't ruled out of, and for how many."""

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, units, centroids, bars = shared.value
        near = _distances(units, centroids)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("cluster", "low", "high")), strict=True)
            asking = [len(_ruled_in(near[:, c], low, high, bars)) for c, low, high in rows]
            yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("ring"), batch.column("n"), pa.array(asking, pa.int64())], ["cluster", "ring", "n", "asking"])

    return need


class VectorIndex:
    """A written index. search() gives the same rows as nearest()."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.vectors, self.rings = spark, spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/rings")
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cluster").collect()  # CENTROIDS at most
        self.centroids = np.array([r["center"] for r in rows])
        self.kind = self.vectors.schema["key"].dataType

    def _pass(self, rows: DataFrame, own: list, units: np.ndarray, bars: np.ndarray, k: int, first: bool) -> DataFrame:
        shared = self.spark.sparkContext.broadcast((own, units, self.centroids, bars))
        return rows.mapInArrow(_met(shared, k, to_arrow_type(self.kind), first), f"number long, key {self.kind.simpleString()}, score double")

    def _bars(self, own: list, units: np.ndarray, k: int) -> tuple[DataFrame, np.ndarray]:
        """The best of each query's own cluster, and the distance that others must come within."""
        homes = [int(c) for c in np.unique(_closest(units, self.centroids)[0])]
        place = Window.partitionBy("number").orderBy(F.col("score").desc(), "key")
        hits = self._pass(self.vectors.filter(F.col("cluster").isin(homes)), own, units, np.full(len(own), 2.0), k, True)
        hits = checkpointed(hits.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).drop("rank"))
        bars = np.full(len(own), 2.0)
        for number, score in hits.groupBy("number").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") == k).select("number", "s").collect():  # one row a query of the pass
            bars[number] = math.sqrt(max(0.0, 2 - 2 * (score - 1e-6)))
        return hits, bars

    def _rings(self, own: list, units: np.ndarray, bars: np.ndarray) -> DataFrame:
        shared = self.spark.sparkContext.broadcast((own, units, self.centroids, bars))
        return self.rings.select("cluster", "ring", "low", "high", "n").mapInArrow(_needed(shared), "cluster int, ring int, n long, asking long")

    def search(self, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """query, rank, key, score: the k nearest by cosine of each query but itself, exact (score rounded to 6, ties by key)."""
        parts, empty = [], self.rings.isEmpty()
        for own, units in _passes(unit_vectors(queries.limit(0) if empty else queries, key, vector)):
            hits, bars = self._bars(own, units, k)
            needed = self._rings(own, units, bars).filter("asking > 0").select("cluster", "ring")
            rest = self.vectors.join(F.broadcast(needed), ["cluster", "ring"], "left_semi")  # CENTROIDS * 2 * RINGS rows at most
            every = hits.unionByName(self._pass(rest, own, units, bars, k, False))
            parts.append(_named(self.spark, every, own, k, self.kind.simpleString(), key))
        return _united(parts, self.spark, self.kind.simpleString(), key)

    def touched(self, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> float:
        """The share of all pairs of query and vector that a search compares at most."""
        pairs = asked = 0
        for own, units in _passes(unit_vectors(queries, key, vector)):
            _, bars = self._bars(own, units, k)
            pairs += self._rings(own, units, bars).agg(F.coalesce(F.sum(F.col("n") * F.col("asking")), F.lit(0))).first()[0]
            asked += len(own)
        return pairs / max(1, asked * self.vectors.count())
