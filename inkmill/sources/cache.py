"""Pages fetched earlier, by the hash of their url. Nothing here uses a network: what the cache lacks is a failure.

The cache is a resumable sink, so that a run that breaks while storing leaves no part of itself. Its rows are
partitioned by the first digits of the hash: looking up a few urls reads the folders of their digits only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.functions import text as T
from inkmill.sources.sinks import Resumable

#: Fixed value: digits of the hash that make a key.
KEY_DIGITS = 16
PREFIX_DIGITS = 2
_ROWS = "cache_key string, text string, prefix string"


def _keyed(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("cache_key", T.content_id(F.col("url"), KEY_DIGITS))
    return rows.withColumn("prefix", F.left("cache_key", F.lit(PREFIX_DIGITS)))


def _sink(spark: SparkSession, path: str) -> Resumable:
    return Resumable(spark, path, _ROWS, ["cache_key"], ["prefix"])


def store(pages: DataFrame, path: str) -> None:
    """Adds the texts of pages (url, text) whose url isn't in the cache; of several for one url the first by the text itself."""
    rows = _keyed(pages.where("url is not null")).groupBy("cache_key", "prefix").agg(F.min("text").alias("text"))
    _sink(pages.sparkSession, path).append(rows.select("cache_key", "text", "prefix"))


def fetch(urls: DataFrame, path: str) -> DataFrame:
    """urls (url, …) with cache_key, text and status: cached, or failed and why. No row is dropped."""
    held = _sink(urls.sparkSession, path).read()
    found = _keyed(urls.drop("cache_key", "text", "status")).join(held, ["prefix", "cache_key"], "left").drop("prefix")
    status = F.when(F.col("text").isNotNull(), F.lit("cached")).when(F.col("url").isNull(), F.lit("failed: no url")).otherwise(F.lit("failed: not in the cache"))
    return found.withColumn("status", status)
