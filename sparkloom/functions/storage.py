"""Where intermediate results go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_top(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one in local mode; on a cluster that is an error, because executors wouldn't see it."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="sparkloom-")
    return top.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_top(spark)}/sparkloom-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there, so that it isn't computed again and a lost executor costs nothing."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_top(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: for loops.

    A checkpoint keeps Spark's estimate of its size, and the estimate of a join is the product of its sides'; over the rounds of a loop
    the number of its digits doubles each time, until planning takes all the time. A table that is read has the size of its files.
    """
    path = f"{shared_folder(df.sparkSession)}/round"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int, size: str) -> None:
    """Keeps the Arrow batches that Python workers get small, whatever the length of the rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
