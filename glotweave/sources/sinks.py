"""Sinks: text, CSV, TSV and word-vector files; Parquet tables are the native form of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotweave.functions.vectors import as_double

# The words that the coherence test probes, unless others are given.
PROBE_WORDS = (
    "family", "money", "government", "science", "technology", "food", "animal", "sport", "music", "religion", "education", "health", "politics",
    "nature", "business", "war", "peace", "love", "death", "time", "water", "fire", "earth", "air", "light",
)


def write_lines(df: DataFrame, path: str, *order: str) -> None:
    """Column ``line`` as text, sorted by ``order``; part files are in that order."""
    df.orderBy(*order).select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_text_file(df: DataFrame, path: str, *order: str) -> None:
    """Column ``line`` as one file without a final newline, in any store that Spark reaches; parent folders are made.  Streamed
    partition by partition through the driver."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        held, size, first = [], 0, True
        for row in df.orderBy(*order).select("line").toLocalIterator():
            data = (b"" if first else b"\n") + row["line"].encode()
            held.append(data)
            size, first = size + len(data), False
            if size > 1 << 20:
                out.write(bytearray(b"".join(held)))
                held, size = [], 0
        out.write(bytearray(b"".join(held)))
    finally:
        out.close()


def write_probe_words(spark: SparkSession, path: str, words: tuple[str, ...] = PROBE_WORDS) -> None:
    """The words for the coherence test as one file, a word a line."""
    write_text_file(spark.createDataFrame(list(enumerate(words)), "line_no int, line string"), path, "line_no")


def _six_decimals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(idx, word, numbers): each number as C prints it, its exact value rounded half to even.  Java's formats round the shortest decimal that
    names a double half up, which differs where a value lies midway (0.0000005, 0.5 ** 7)."""
    for batch in batches:
        texts = [None if v is None else " ".join(["%.6f" % x for x in v if x is not None]) for v in batch.column("vec").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("idx"), batch.column("word"), pa.array(texts, pa.string())], ["idx", "word", "numbers"])


def vec_lines(vectors: DataFrame) -> DataFrame:
    """(idx, line): a header ``n d`` at idx -1, then the word and its numbers with six decimals."""
    rows = vectors.select(F.col("idx").cast("long").alias("idx"), F.col("word").cast("string").alias("word"), as_double(F.col("vec")).alias("vec"))
    body = rows.mapInArrow(_six_decimals, "idx long, word string, numbers string").select("idx", F.concat_ws(" ", "word", "numbers").alias("line"))
    head = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("d")).select(
        F.lit(-1).cast("long").alias("idx"), F.concat_ws(" ", F.col("n"), F.col("d")).alias("line")
    )
    return head.unionByName(body)


def write_vec(vectors: DataFrame, path: str) -> None:
    write_text_file(vec_lines(vectors), path, "idx")


def write_vectors(vectors: DataFrame, path: str) -> None:
    """The native form, sorted by idx so that cuts by rank prune row groups."""
    vectors.sort("idx").write.mode("overwrite").parquet(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """src and tgt, tab-separated."""
    pairs.orderBy("pair_no").select("src", "tgt").write.mode("overwrite").option("sep", "\t").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """(metric, value) rows as one file of ``metric: value`` lines, sorted by metric."""
    line = F.concat_ws(": ", F.col("metric"), F.coalesce(F.col("value").cast("string"), F.lit("none")))
    write_text_file(metrics.select("metric", line.alias("line")), path, "metric")


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def aligned_space(source: DataFrame, target: DataFrame) -> DataFrame:
    """Both spaces as (lang, idx, word, key, vec): source rows first, keys with the prefixes dv_ and en_."""
    n = source.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("n"))
    src = source.select(F.lit("dv").alias("lang"), "idx", "word", "vec")
    tgt = target.crossJoin(F.broadcast(n)).select(F.lit("en").alias("lang"), (F.col("idx") + F.col("n")).alias("idx"), "word", "vec")
    return src.unionByName(tgt).select("lang", "idx", "word", F.concat("lang", F.lit("_"), "word").alias("key"), "vec")


def seed_words(train: DataFrame, test: DataFrame) -> DataFrame:
    """(value): the distinct target words of both parts, sorted."""
    return train.select(F.col("tgt").alias("value")).union(test.select("tgt")).distinct().orderBy("value")
