"""A training-data pipeline over the documents table.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns what it keeps of ``docs``.  All stages
but the last return the columns of documents; the last emits a document once per copy, with the copy's number.

Defined cases, for all stages: rows with a null doc_id are judged by themselves: their lines are never common, they are no
copies of others, hold no known passage, and are mixed like others.  Rows with a null text have no language and go in
the first stage.  Rows alike in all columns stay or go together until the last stage, where they come out as one row with the
copies of all.  Ties go to the smaller doc_id (near copies) or the larger (lines), and in mixing to the order of hashes.
Columns beyond those of documents pass through unchanged, whatever their names, but for ``copy`` in the last stage.  No
rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotweave.llm import decontaminate, language_id, line_dedup, mixing, near_dedup
from glotweave.llm.storage import Scratch, materialise


#: Columns that stages read or write; others are renamed while a stage runs, so that they cannot clash with its own.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`").alias(c if c in COLUMNS else f"__pl_{i}") for i, c in enumerate(docs.columns)])


def _back(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[F.col(c if c in COLUMNS else f"__pl_{i}").alias(c) for i, c in enumerate(docs.columns)])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, or whose language stays ambiguous, go; so do all if none has a known language."""
    judged = language_id.identify(_apart(docs), language_id.fit_documents(docs))
    return _back(judged.filter((F.col("lang_pred") != language_id.UND) & ~F.col("ambiguous")), docs)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one; every document stays, with the text that is left and its length."""
    return _back(line_dedup.dedup_lines(_apart(docs)).withColumn("n_chars", F.char_length("text").cast("long")), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each near-duplicate class stays."""
    return near_dedup.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, or a short item whole, go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights; a document comes once per copy."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("source_mixing", mix_sources),
]

#: SQL can't express the language and near-duplicate stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared scratch folder before the next reads it, and deleted
    when the next has written its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            kept = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
            scratch.drop(docs)
            docs = kept if name == STAGES[-2][0] else scratch.adopt(kept)
    return STAGES[-1][1](spark, docs, sf_dir)
