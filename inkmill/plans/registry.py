"""Every registered query and its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkmill.plans import judged, outside, prose

QUERIES = prose.QUERIES | judged.QUERIES | outside.QUERIES
ORACLES = prose.ORACLES | judged.ORACLES | outside.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, seventeen counts, pooled author profiles, and each draft's findings against its author, in order."""
    return prose.scan_vs_author(spark, sf_dir)
