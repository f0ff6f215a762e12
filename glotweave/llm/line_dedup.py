"""Line dedup: lines that many documents hold are kept in one document only.

Method: explode the normalised lines, hash them, count the distinct documents of each hash, drop the lines of hashes at
or over the threshold, and put what is left together by position.  DataFrame functions only.

Scale: the exploded table has no text, only a 128-bit key, the document and the position.  The distinct count spreads on
(key, document) first and is summed on the map side before keys meet, so a line held by a third of all documents never
lies in one task; the join back on the key is a plain equi-join whose large partitions adaptive execution can split.
The text is shuffled once, and only to meet the few dropped positions (not at all when those fit a broadcast).

Defined cases: a null or empty text is one empty line.  Rows with a null doc_id cannot be named by a decision: their
lines are not counted and never dropped.  Rows that repeat a doc_id count as one document and lose the same lines.
Extra columns are passed through; helper columns carry a ``__ld_`` prefix so that no user column clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotweave.llm.columns import SPACES, wide_hash
from glotweave.llm.storage import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without spaces at both ends and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, UPPER.lower())


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def dropped_positions(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, __ld_row, __ld_drop array<int>): positions of the lines that each row loses; rows that lose none are left out.

    ``__ld_row`` tells apart rows that share a doc_id but not a text.
    """
    keyed = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id",
        F.xxhash64("text").alias("__ld_row"),
        F.posexplode(F.transform(_lines(F.col("text")), line_key)).alias("__ld_at", "__ld_line"),
    )
    lines = keyed.filter(F.char_length("__ld_line") >= min_chars).select(
        "doc_id", "__ld_row", "__ld_at", wide_hash(F.col("__ld_line")).alias("__ld_key")
    )
    # written first: a join that shares the aggregate's exchange could not be split at a hot key
    common = materialise(
        lines.groupBy("__ld_key", "doc_id")
        .agg(F.lit(1).alias("__ld_one"))
        .groupBy("__ld_key")
        .agg(F.count("*").alias("__ld_docs"), F.max("doc_id").alias("__ld_keeper"))
        .filter(F.col("__ld_docs") >= min_docs)
        .select("__ld_key", "__ld_keeper"),
        "line-common",
    )
    return (
        lines.join(common, "__ld_key")
        .filter(F.col("doc_id") != F.col("__ld_keeper"))
        .groupBy("doc_id", "__ld_row")
        .agg(F.collect_set("__ld_at").alias("__ld_drop"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with its text cut to the lines that stay, plus n_lines (before) and n_dropped."""
    names = docs.columns
    drops = dropped_positions(docs, min_chars, min_docs).select(
        F.col("doc_id").alias("__ld_id"), F.col("__ld_row").alias("__ld_fp"), "__ld_drop"
    )
    lines = _lines(F.col("text"))
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("__ld_lines") - 1), F.col("__ld_drop")),
        lambda i: F.element_at(F.col("__ld_lines"), i + 1),
    )
    joined = docs.join(
        drops, (F.col("doc_id") == F.col("__ld_id")) & (F.xxhash64("text") == F.col("__ld_fp")), "left"
    ).select(*names, "__ld_drop", lines.alias("__ld_lines"))
    text = (
        F.when(F.col("__ld_drop").isNull(), F.coalesce(F.col("text"), F.lit("")))
        .when(F.size("__ld_drop") == F.size("__ld_lines"), F.lit(""))
        .otherwise(F.array_join(kept, "\n"))
    )
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in names if c not in ("n_lines", "n_dropped")],
        F.size("__ld_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__ld_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
