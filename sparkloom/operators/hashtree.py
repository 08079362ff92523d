"""Comparing two stored catalogue states by trees of fingerprints, reading only what differs.

A state is stored as rows sorted by bucket, a part of the hash of their key, and as a tree: the leaves are fingerprints of
buckets, the nodes above them fingerprints of FAN children each. Two trees are compared from the top; only children
of nodes that differ are looked at, and only rows of buckets that differ are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.versions import catalog_diff

#: Children of a node; leaves are FAN ** DEPTH.
FAN, DEPTH = 16, 4
#: Differing leaves up to this count are pushed down to the scan of the rows as a list.
PUSHED = 5_000


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FAN**DEPTH)).cast("int")


def _fingerprint(a: Column, b: Column) -> list[Column]:
    """The sum modulo 2 ** 64 and the exclusive or of two hashes, so that order doesn't count, and repeated rows do."""
    return [F.bit_xor(a).alias("x"), F.sum(b.cast("decimal(20,0)")).alias("s")]


def write_state(df: DataFrame, key: str, content: list[str], path: str) -> None:
    """Writes path/rows (key, content hash, bucket) sorted by bucket, and path/tree (level, node, x, s, n)."""
    rows = df.select(F.col(key).alias("key"), F.sha2(F.to_json(F.struct(*content)), 256).alias("content")).withColumn("bucket", _bucket(F.col("key")))
    rows.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key").write.mode("overwrite").parquet(f"{path}/rows")
    written = df.sparkSession.read.parquet(f"{path}/rows")
    level = written.groupBy(F.col("bucket").alias("node")).agg(*_fingerprint(F.xxhash64("key", "content"), F.xxhash64("content", "key")), F.count("*").alias("n"))
    tree = level.withColumn("level", F.lit(DEPTH))
    for i in range(DEPTH - 1, -1, -1):
        level = level.groupBy((F.col("node") / FAN).cast("int").alias("node")).agg(*_fingerprint(F.xxhash64("node", "x", "s"), F.xxhash64("x", "s", "node")), F.sum("n").alias("n"))
        tree = tree.unionByName(level.withColumn("level", F.lit(i)))
    tree.repartitionByRange("level", "node").sortWithinPartitions("level", "node").write.mode("overwrite").parquet(f"{path}/tree")


class States:
    """Two written states."""

    def __init__(self, spark: SparkSession, old: str, new: str) -> None:
        self.rows = [spark.read.parquet(f"{p}/rows") for p in (old, new)]
        self.trees = [spark.read.parquet(f"{p}/tree") for p in (old, new)]
        self.looked_at = 0  #: nodes compared by the last call of differing()

    def differing(self) -> list[int]:
        """The buckets that differ: the driver walks down the trees, FAN ** DEPTH leaves at most."""
        nodes, self.looked_at = [0], 0
        for level in range(DEPTH + 1):
            a, b = (t.filter((F.col("level") == level) & F.col("node").isin(nodes)).drop("level") for t in self.trees)
            met = a.alias("a").join(b.alias("b"), "node", "full_outer")
            same = F.col("a.x").eqNullSafe(F.col("b.x")) & F.col("a.s").eqNullSafe(F.col("b.s")) & F.col("a.n").eqNullSafe(F.col("b.n"))
            other = sorted(r[0] for r in met.filter(~same).select("node").collect())
            self.looked_at += len(nodes)
            nodes = [n * FAN + i for n in other for i in range(FAN)] if level < DEPTH else other
            if not nodes:
                return []
        return nodes

    def changed_rows(self, buckets: list[int]) -> list[DataFrame]:
        """The rows of both states in these buckets; a short list is pushed down, and files and row groups without them aren't read."""
        if len(buckets) <= PUSHED:
            return [r.filter(F.col("bucket").isin(buckets)) for r in self.rows]
        wanted = self.rows[0].sparkSession.createDataFrame([(b,) for b in buckets], "bucket int")
        return [r.join(F.broadcast(wanted), "bucket", "left_semi") for r in self.rows]

    def diff(self, key: str) -> DataFrame:
        """key, change {added, removed, changed}, as versions.catalog_diff gives it; keys are unique in a state."""
        old, new = self.changed_rows(self.differing())
        return catalog_diff(old, new, "key", "content").withColumnRenamed("key", key)
