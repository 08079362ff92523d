"""Profiles and reuse counts that grow by batch: each batch is stored as sketches, and sketches are united without the old rows.

Distinct counts are HyperLogLog (its relative standard error is 1.04 / sqrt(2 ** LG_K)) and theta sketches (1 / sqrt(2 ** LG_K),
exact up to 2 ** LG_K values), quantiles are KLL sketches (rank error about 2.3 / K ** 0.9).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, K = 14, 400
NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def sketch_columns(df: DataFrame, batch: Column) -> DataFrame:
    """batch, column, n_rows, n_nulls, low, high (as strings), total, distinct (HLL), ranks (KLL of numbers, else null): one row a column, in one pass."""
    kinds = dict(df.dtypes)
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        number = kinds[c] in NUMBERS
        value = F.col(f"`{c}`")
        measures += [
            F.count(value).alias(f"c{i}"),
            F.min(value).cast("string").alias(f"l{i}"),
            F.max(value).cast("string").alias(f"h{i}"),
            F.hll_sketch_agg(value.cast("string"), LG_K).alias(f"d{i}"),
            *([F.sum(value.cast("double")).alias(f"t{i}"), F.kll_sketch_agg_double(value.cast("double"), K).alias(f"k{i}")] if number else []),
        ]
    row = lambda i, c: F.struct(
        F.lit(c).alias("column"), F.col("rows").alias("n_rows"), (F.col("rows") - F.col(f"c{i}")).alias("n_nulls"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high"),
        (F.col(f"t{i}") if kinds[c] in NUMBERS else F.lit(None).cast("double")).alias("total"), F.col(f"d{i}").alias("distinct"), (F.col(f"k{i}") if kinds[c] in NUMBERS else F.lit(None).cast("binary")).alias("ranks"),
    )
    return df.agg(*measures).select(batch.alias("batch"), F.explode(F.array(*(row(i, c) for i, c in enumerate(df.columns)))).alias("r")).select("batch", "r.*")


def profile_sketches(sketches: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """column, n_rows, n_nulls, n_distinct (estimated), mean, and q1, q2, ... (estimated) over all batches in the table of sketches. Old rows aren't read."""
    united = sketches.groupBy("column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"), F.hll_union_agg("distinct").alias("distinct"), F.sum("total").alias("total"), F.kll_merge_agg_double("ranks").alias("ranks")
    )
    filled = F.col("n_rows") - F.col("n_nulls")
    number = F.col("total").isNotNull() & (filled > 0)
    at = [F.when(number, F.kll_sketch_get_quantile_double("ranks", F.lit(q))).alias(f"q{i}") for i, q in enumerate(quantiles, 1)]
    return united.select("column", "n_rows", "n_nulls", F.hll_sketch_estimate("distinct").alias("n_distinct"), (F.col("total") / F.nullif(filled, F.lit(0))).alias("mean"), *at)


def sketch_reuse(bindings: DataFrame, batch: Column, key: str = "agent_key", name: str = "name") -> DataFrame:
    """batch, name, agents: a theta sketch of the agents that bind each name."""
    return bindings.groupBy(F.col(name).alias("name")).agg(F.theta_sketch_agg(F.col(key), LG_K).alias("agents")).select(batch.alias("batch"), "name", "agents")


def reuse(sketches: DataFrame, k: int) -> DataFrame:
    """The k names that most agents bind over all batches, an agent that comes in several counted once, with n_agents (estimated; exact up to 2 ** LG_K); ties by name."""
    united = sketches.groupBy("name").agg(F.expr(f"theta_union_agg(agents, {LG_K})").alias("agents"))
    return united.select("name", F.expr("theta_sketch_estimate(agents)").cast("long").alias("n_agents")).orderBy(F.col("n_agents").desc(), "name").limit(k)


def store(parts: list[DataFrame], path: str) -> None:
    """Appends batches of sketches to a stored table."""
    reduce(DataFrame.unionByName, parts).write.mode("append").parquet(path)
