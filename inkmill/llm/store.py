"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkmill.sources.scratch import new_path

#: Bytes of a batch that goes to a Python worker, about; the JVM and the worker each hold one or two a task.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches: long texts would fill ones of 10,000 rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


#: Rows of a file that materialise writes at least, where it knows how many there can be.
FILE_ROWS = 100_000


def materialise(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Writes df once and reads it back: later steps neither recompute it nor depend on executors' disks.

    rows: how many df has at most, or more where a row is much work, for rows of a bounded size. It bounds
    the number of files and of the tasks that write them: tables of a few thousand rows needn't have a file
    a shuffle partition. What reads texts is not bounded so, as these may be long.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, label)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
