"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.storage import shared_top

#: Blanks between words: the character class [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def bounded_batches(spark: SparkSession, rows: int = 256, size: str = "8m") -> None:
    """Keeps the Arrow batches that Python workers get small, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a copy in the shared folder that spark.checkpoint.dir names; one of our own only in local mode, if unset."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_top(df.sparkSession))
    out = df.checkpoint(eager=True)
    del df
    # Shuffle files go once nothing refers to their plans; the cleaner learns of that from the driver's garbage collection.
    gc.collect()
    context._jvm.System.gc()
    return out


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, in order; an empty array for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
