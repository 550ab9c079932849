"""Writing results: JSON, text reports, failures, and appending what is new."""

from __future__ import annotations

import functools
import operator
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.sources.files import Folder
from inkmill.sources.scratch import written


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_split(rows: DataFrame, ok: str, path: str, failures: str) -> None:
    """Rows whose status is ok to one place, the others with their status to another: none is dropped. Rows are worked out once."""
    rows = written(rows, "split")
    rows.where(F.col("status") == ok).write.mode("overwrite").parquet(path)
    rows.where(~F.col("status").eqNullSafe(ok)).write.mode("overwrite").parquet(failures)


class Resumable:
    """A table that runs add to, each key once, and of which a broken run leaves nothing.

    A run writes its rows into a folder of its own. They belong to the table once a small file in the folder
    of commits names that folder; the files are numbered, and a number can be taken once only. So a run that
    breaks while it writes, or before its commit, has added nothing and can be made again, and of two runs at
    a time the later one sees that a number is gone and drops what the other has added. Null is a key like others.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], partitions: list[str] | None = None):
        self.spark, self.path, self.schema, self.keys, self.partitions = spark, path, schema, keys, partitions or []
        self.commits = Folder(spark, f"{path}/commits")

    def runs(self) -> list[str]:
        """The committed runs, the first one first."""
        return [self.commits.read(name) for name in self.commits.names()]

    def _rows(self, runs: list[str]) -> DataFrame:
        empty = self.spark.createDataFrame([], self.schema)
        if not runs:
            return empty
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*(f"{self.path}/sink_run={run}" for run in runs)).select(*empty.columns)

    def read(self) -> DataFrame:
        return self._rows(self.runs())

    def pending(self, rows: DataFrame) -> DataFrame:
        """The rows whose keys aren't there yet."""
        return self._without(rows, self.runs())

    def _without(self, rows: DataFrame, runs: list[str]) -> DataFrame:
        done = self._rows(runs).select(*(F.col(k).alias(f"_done_{k}") for k in self.keys))
        same = functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(f"_done_{k}")) for k in self.keys))
        return rows.join(done, same, "left_anti") if runs else rows

    def stage(self, rows: DataFrame, runs: list[str]) -> str:
        """Writes what is new beside these runs, each key once, and returns the run's name. Nothing is committed."""
        run = uuid.uuid4().hex[:12]
        self._without(rows, runs).dropDuplicates(self.keys).write.partitionBy(*self.partitions).parquet(f"{self.path}/sink_run={run}")
        return run

    def commit(self, run: str, after: int) -> bool:
        """Makes a staged run the next one after so many; False if another run has become that."""
        return self.commits.create(f"{after:08d}", run)

    def append(self, rows: DataFrame) -> None:
        while True:
            runs = self.runs()
            run = self.stage(rows, runs)
            if self.commit(run, len(runs)):
                return
            rows = self._rows([run])  # already made; only what the other run has added goes


def report(findings: DataFrame) -> DataFrame:
    """Findings as lines of fixed width, in order."""
    line = F.format_string("  [%3dx] %-34s %s", F.col("count"), F.col("label"), F.col("why"))
    return findings.select("doc_id", "place", line.alias("line"))
