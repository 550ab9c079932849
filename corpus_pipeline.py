"""The corpus pipeline: toxicity, exact and near duplicates, benchmark contamination, packing.

Every stage works on all rows the one before kept; all but the last return the columns of
documents. Toxic documents go; of equal texts and of each component of near-equal texts
the smallest id stays; documents that hold a benchmark item go; the rest is packed.

Null text counts as empty: such a document is a copy of other empty ones and else stays, to
be packed as one end id. Of equal rows of one id one stays; rows of one id with differing
texts are documents of their own, but stay together in the near-duplicate stage if one does.
Rows without id are never taken for the first of a group; if one of them is toxic or holds an
item, all go, as rows of one id do. Very long texts are worked
on whole. Ties go to the smallest id. Empty tables give empty ones; without labels of both
kinds nothing is toxic. Columns that documents has beside its own go through all stages but
the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkmill.llm import decontamination, exact_dedup, ngram_join, packing, toxicity
from inkmill.llm.store import materialise, small_batches


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labelled documents outside fold 1, as the operator's query does."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_repeats(docs)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", keep_civil),
    ("exact_dedup", keep_first_copies),
    ("ngram_join", keep_one_of_near),
    ("decontamination", keep_uncontaminated),
    ("packing", pack),
]

#: The toxicity and packing stages can't be written in SQL; the tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
