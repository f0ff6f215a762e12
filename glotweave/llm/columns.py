"""Column expressions shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
NON_SPACE = "[^\\x20\\x09-\\x0D]"


def words(text: Column) -> Column:
    """Maximal runs of non-space characters, unchanged; null and empty texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has: the places where a word begins."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_RUN))).cast("long")


def wide_hash(*cols: Column) -> Column:
    """128 bits of xxHash64 as a struct (a, b): two passes over the same input that begin from unlike states."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit("second"), *cols).alias("b"))
