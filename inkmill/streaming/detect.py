"""Detector counts on a stream: they keep no state, so the batch expressions run as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame

from inkmill.functions import detectors


def stream_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """docs: a streaming frame with text. Each micro-batch is counted for itself; no watermark is needed."""
    return detectors.counts(docs, *keep)
