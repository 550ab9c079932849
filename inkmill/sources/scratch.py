"""Intermediate tables, and dealing small inputs out over the cores."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Session setting: in how many partitions the queries deal out the texts they read; unset or 0 where the files have splits enough.
SPREAD = "spark.inkmill.spread"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset and everything runs in one process, as in tests, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="inkmill-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return _LOCAL["dir"]


def new_path(spark: SparkSession, label: str) -> str:
    """A path for a table of that kind; the application's tables are removed when it ends."""
    root = f"{shared_dir(spark)}/inkmill-{spark.sparkContext.applicationId}"
    if root not in _LOCAL:
        _LOCAL[root] = root
        atexit.register(_remove, spark, root)
    return f"{root}/{label}-{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder is scratch space
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, for results that several later steps read."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by key over as many partitions as the session's SPREAD says, for heavy work on rows of few files; else as it is, without a shuffle."""
    parts = int(df.sparkSession.conf.get(SPREAD, "0"))
    return df.repartition(parts, key) if parts > 0 else df
