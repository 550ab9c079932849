"""Author profiles over detector counts, and findings against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkmill.functions import detectors
from inkmill.functions.metrics import rate, rounded

# The least words of a sample, and the room over an author's own rate.
SAMPLE_WORDS, HEADROOM = 25, 1.5


def samples_used(docs: DataFrame, author: str, least: int = SAMPLE_WORDS, words: Column | None = None) -> DataFrame:
    """Every sample with its words and whether it is long enough to be used: none is dropped without a trace."""
    from inkmill.functions.text import prose_scan, word_count

    counted = word_count(prose_scan(F.col("text"))) if words is None else words
    return docs.select("doc_id", F.col(author).alias("author"), counted.alias("words")).withColumn("used", F.col("words") >= least)


def profile(counts: DataFrame) -> DataFrame:
    """author, key, words, n_docs and rate, pooled over the usable samples of counts (author, words, key, count)."""
    pooled = counts.where(F.col("words") >= SAMPLE_WORDS).groupBy("author", "key").agg(F.sum("words").alias("words"), F.count("*").alias("n_docs"), F.sum("count").alias("count"))
    return pooled.select("author", "key", "words", "n_docs", rate(F.col("count"), F.col("words")).alias("rate"))


def scan(counts: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Findings of each document, the largest excess first: counts is (doc_id, author, words, key, count), own a profile.

    The detector table is broadcast: it has a row a detector. An author without a profile is held against the floors.
    """
    rows = counts.where("count > 0").join(F.broadcast(detectors.registry(counts.sparkSession)), "key").withColumn("rate", rate(F.col("count"), F.col("words")))
    if own is None:
        rows = rows.withColumn("own", F.lit(None).cast("double"))
    else:
        rows = rows.join(own.select("author", "key", F.col("rate").alias("own")), ["author", "key"], "left")
    allowed = F.when(~F.col("gated"), F.lit(0.0)).otherwise(F.greatest("floor", F.coalesce(F.col("own") * HEADROOM, F.lit(0.0))))
    rows = rows.withColumn("limit", allowed).where(~F.col("gated") | ((F.col("count") >= F.col("min_count")) & (F.col("rate") > F.col("limit"))))
    one = lambda c: F.format_string("%.1f/1k", rounded(c, 1))
    why = (
        F.when(~F.col("gated"), F.lit("never author voice"))
        .when(F.col("own").isNull(), F.concat(one(F.col("rate")), F.lit(" vs floor "), one(F.col("limit"))))
        .otherwise(F.concat(one(F.col("rate")), F.lit(" vs author "), one(F.col("own"))))
    )
    # rounded from whole hundredths, as a half may fall between two doubles
    half_up = F.round(F.col("own").cast("decimal(20,2)") * F.lit(HEADROOM).cast("decimal(4,2)"), 2).cast("double")
    rows = rows.withColumn("allowed", F.when(~F.col("gated"), F.lit(0.0)).otherwise(F.greatest("floor", F.coalesce(half_up, F.lit(0.0)))))
    order = Window.partitionBy("doc_id").orderBy(F.desc(rounded(F.col("rate") - F.col("allowed"), 2)), "pos")
    return rows.select("doc_id", "author", "key", "label", "count", "rate", "allowed", why.alias("why"), F.row_number().over(order).cast("long").alias("place"))


def verdicts(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Whether each document has findings, the exit status of a scan."""
    return docs.select("doc_id").join(findings.groupBy("doc_id").agg(F.count("*").alias("n_findings")), "doc_id", "left").select(
        "doc_id", F.coalesce("n_findings", F.lit(0)).alias("n_findings"), (F.coalesce("n_findings", F.lit(0)) > 0).alias("has_findings")
    )
