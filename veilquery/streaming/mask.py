"""Masking of a stream of documents: detection and rewriting keep no state, so the batch operators run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilquery.operators import detect, rewrite


def mask_stream(spark: SparkSession, path: str, schema: str, text_col: str = "text") -> DataFrame:
    """A streaming DataFrame over Parquet files that arrive in path, with masked_text."""
    docs = spark.readStream.schema(schema).parquet(path)
    return rewrite.mask(detect.annotate(docs, text_col), text_col).drop("spans", "masked_spans")
