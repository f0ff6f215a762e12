"""The row-local cleaning operators over a Structured Streaming text source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotweave.operators.corpus import clean_lines, foreign_tokens, keep_clean


def stream_lines(spark: SparkSession, directory: str) -> DataFrame:
    return spark.readStream.text(directory).select(F.input_file_name().alias("source"), F.col("value").alias("line"))


def stream_clean(lines: DataFrame, language: str) -> DataFrame:
    """Append-mode: cleaned non-empty lines."""
    return keep_clean(clean_lines(lines, language)).select("source", F.col("clean").alias("line"))


def stream_foreign_counts(lines: DataFrame, language: str) -> DataFrame:
    """Complete- or update-mode: running frequency of foreign tokens."""
    return foreign_tokens(lines, language).groupBy(F.lower("word").alias("token")).agg(F.count("*").alias("n"))
