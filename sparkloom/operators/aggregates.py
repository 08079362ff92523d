"""Counts, aggregation over joins, profiles, and tables for charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.storage import checkpointed


def catalog_counts(agents: DataFrame, root: str = "root", category: str = "category") -> DataFrame:
    """root, category, level (0 category, 1 root, 3 all), n."""
    return agents.rollup(root, category).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


def dependency_reuse(bindings: DataFrame, k: int, key: str = "agent_key", name: str = "name") -> DataFrame:
    """The k names that most different agents bind, with n_agents; ties by name."""
    return bindings.groupBy(name).agg(F.count_distinct(key).alias("n_agents")).orderBy(F.col("n_agents").desc(), name).limit(k)


def extract_aggregate(fact: DataFrame, dims: list[tuple[DataFrame, str, str]], keys: list[Column], measures: list[Column], mode: str = "plain", sets: list[list[Column]] | None = None) -> DataFrame:
    """Joins fact to dims ((table, fact's column, table's column), in order) and aggregates measures by keys; mode: plain, rollup, cube, or sets, which takes the grouping sets."""
    for table, left, right in dims:
        fact = fact.join(table, F.col(left) == F.col(right))
    if mode == "sets":
        return fact.groupingSets(sets or [keys], *keys).agg(*measures)
    grouped = {"plain": fact.groupBy, "rollup": fact.rollup, "cube": fact.cube}[mode](*keys)
    return grouped.agg(*measures)


def profile_columns(df: DataFrame, approx: bool = False) -> DataFrame:
    """column, n_rows, n_nulls, n_distinct, low, high, mean of each column, in one pass over the table; low and high as strings, mean of numbers only."""
    distinct = F.approx_count_distinct if approx else F.count_distinct
    measures, numeric = [F.count("*").alias("rows")], {"int", "bigint", "double", "float", "smallint", "tinyint"}
    for i, (c, kind) in enumerate(df.dtypes):
        mean = F.avg(c) if kind in numeric else F.lit(None).cast("double")
        measures += [F.count(c).alias(f"c{i}"), distinct(c).alias(f"d{i}"), F.min(c).cast("string").alias(f"l{i}"), F.max(c).cast("string").alias(f"h{i}"), F.first(mean).alias(f"m{i}") if kind not in numeric else mean.alias(f"m{i}")]
    row = lambda i, c: F.struct(F.lit(c).alias("column"), F.col("rows").alias("n_rows"), (F.col("rows") - F.col(f"c{i}")).alias("n_nulls"), F.col(f"d{i}").alias("n_distinct"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high"), F.col(f"m{i}").alias("mean"))
    return df.agg(*measures).select(F.explode(F.array(*(row(i, c) for i, c in enumerate(df.columns)))).alias("r")).select("r.*")


def smooth_and_scale(df: DataFrame, part: str, order: list[str], value: str, n: int) -> DataFrame:
    """Adds moving_average (of the last n rows), min_max and z_score (population) within part; a constant part scales to null. Rows with a null part are a part.

    Rows are dealt by ranges of (part, order), so a large part is many tasks' work; each range gets the n - 1 rows before it.
    """
    rows = checkpointed(df.repartitionByRange(part, *order).withColumn("range_of_rows", F.spark_partition_id()))
    here = Window.partitionBy(part, "range_of_rows")
    last = rows.withColumn("from_end", F.row_number().over(here.orderBy(*(F.col(c).desc() for c in order)))).filter(F.col("from_end") < n)
    ends = last.groupBy(part, "range_of_rows").agg(F.sort_array(F.collect_list(F.struct(*order, value))).alias("rows"))
    ahead = Window.partitionBy(part).orderBy("range_of_rows").rowsBetween(-(n - 1), -1)  # a range has a row at least
    before = ends.withColumn("before", F.flatten(F.collect_list("rows").over(ahead))) if n > 1 else None
    every = rows.withColumn("carried", F.lit(False))
    if before is not None:
        carried = before.select(part, "range_of_rows", F.explode(F.slice("before", F.greatest(F.size("before") - n + 2, F.lit(1)), n)).alias("r"))
        every = every.unionByName(carried.select(part, "range_of_rows", "r.*", F.lit(True).alias("carried")), allowMissingColumns=True)
    near = here.orderBy(*order).rowsBetween(-(n - 1), 0)
    figures = df.groupBy(part).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd"))
    out = every.withColumn("moving_average", F.avg(value).over(near)).filter("not carried").drop("carried", "range_of_rows")
    out = out.join(figures.withColumnRenamed(part, "part_of"), F.col(part).eqNullSafe(F.col("part_of"))).drop("part_of")
    scaled = {"min_max": (F.col(value) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), "z_score": (F.col(value) - F.col("mu")) / F.nullif(F.col("sd"), F.lit(0.0))}
    return out.withColumns(scaled).drop("lo", "hi", "mu", "sd")


def top_n_with_other(df: DataFrame, key: str, value: str, n: int, other: str = "other") -> DataFrame:
    """key (as a string), is_other, total: the n keys of largest sum (ties by key), the rest as one row. A null key can be among the n, and a key that reads like the rest's name stays apart."""
    sums = df.groupBy(key).agg(F.sum(value).alias("total"))
    top = sums.orderBy(F.col("total").desc(), key).limit(n).select(F.struct(key).alias("key_of_top"), F.lit(True).alias("top"))
    named = sums.withColumn("key_of_top", F.struct(key)).join(F.broadcast(top), "key_of_top", "left").withColumn("is_other", F.col("top").isNull())
    return named.groupBy(F.when(F.col("is_other"), other).otherwise(F.col(key).cast("string")).alias(key), "is_other").agg(F.sum("total").alias("total"))


def histogram(df: DataFrame, value: str, low: float, high: float, n: int) -> DataFrame:
    """bin (1 to n, values outside go to the ends), n_rows; empty bins have 0, nulls don't count."""
    spark = df.sparkSession
    bins = F.least(F.greatest(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(n)), F.lit(1)), F.lit(n)).cast("int")
    counts = df.filter(F.col(value).isNotNull()).groupBy(bins.alias("bin")).agg(F.count("*").alias("n_rows"))
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def time_buckets(df: DataFrame, ts: str, key: str, unit: str = "day") -> DataFrame:
    """key, bucket, n_rows for every key and every bucket between the first and the last; empty ones have 0."""
    counts = df.groupBy(key, F.date_trunc(unit, ts).alias("bucket")).agg(F.count("*").alias("n_rows"))
    kind = dict(counts.dtypes)["bucket"]
    span = counts.agg(F.min("bucket").cast("string").alias("a"), F.max("bucket").cast("string").alias("b")).first()  # one row
    ends = [F.lit(x).cast(kind) for x in span]
    grid = counts.select(key).distinct().select(key, F.explode(F.sequence(*ends, F.expr(f"interval 1 {unit}"))).alias("bucket"))
    return grid.join(counts, [key, "bucket"], "left").select(key, "bucket", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def pivot_table(df: DataFrame, rows: list[Column], cols: str, values: list, aggregate: Column) -> DataFrame:
    """A cross-table; values of cols are always given, so no extra pass looks for them."""
    return df.groupBy(*rows).pivot(cols, values).agg(aggregate)
