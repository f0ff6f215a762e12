"""Mixing sources to target weights by systematic sampling.

Method: a document's expected copies are its source's target over its source's size.  They are prefix-summed within the
source, one random offset per source is added, and the document is emitted once for every integer boundary its step
crosses.  DataFrame functions only.

The prefix sum runs in order of document size: then the words taken from a source differ from its target by about one
document, since every size range gets its share (the boundaries are evenly spread over it).

Scale: a source may hold a third of all rows, so no task sees a source.  Documents fall in bins (source, size class,
hash); a window ranks documents inside a bin, and two small prefix sums place the bins: hash bins within a class (at most
``sub_bins`` rows) and classes within a source (size classes are exact below 1024 and have 64 steps per doubling above, so
about 2,500 rows at most, however many documents there are).  The per-source plan has one row per source.  All of it
works on (doc_id, source, size), written once to the shared scratch folder so that texts are read once.

All counts are exact integers (decimals where products pass 64 bits); reruns agree because order and offsets are MD5 values.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, last in order; null and
repeated doc_ids are ranked row by row (rows alike in id, source and text are interchangeable); no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glotweave.llm.columns import n_words
from glotweave.llm.storage import materialise

MAX_FACTOR = 3


def fingerprint() -> Column:
    return md5_number(15, F.col("doc_id").cast("string"), F.concat(F.lit("s"), "source"), F.concat(F.lit("t"), "text"))


def size_class(size: Column) -> Column:
    """Monotone in size: the size itself below 1024, then 64 classes per doubling."""
    bits = F.length(F.bin(size)) - 1
    within = (size - F.call_function("shiftleft", F.lit(1).cast("long"), bits)) * 64
    return F.when(size < 1024, size).otherwise(1024 + (bits - 10) * 64 + F.call_function("shiftright", within, bits)).cast("long")


def md5_number(digits: int, *parts: Column) -> Column:
    """The first hexadecimal digits of the MD5 of the parts, as a number; null parts count as empty."""
    text = F.concat_ws("\x01", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_factor: int = MAX_FACTOR) -> DataFrame:
    """(source, source_size) -> plus ``target``: shares of the total by weight, none above ``max_factor`` times its size.

    Sort sources by cap per weight and let level i be what is left per weight once all before i are capped.  The level
    rises while the caps are below their shares and falls afterwards, so the level that the uncapped sources share is the
    largest one.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("__mx_ratio", F.col("source").asc_nulls_last())
    before, onward = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))) + 1).cast("int"))
    share = (
        sizes.withColumn("__mx_weight", weight)
        .withColumn("__mx_cap", F.col("source_size") * max_factor)
        .withColumn("__mx_ratio", F.col("__mx_cap") / F.col("__mx_weight"))
        .withColumn("__mx_level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("__mx_cap").over(before), F.lit(0))) / F.sum("__mx_weight").over(onward))
        .withColumn("__mx_free", F.max("__mx_level").over(whole))
    )
    target = F.least(F.col("__mx_cap").cast("double"), F.col("__mx_free") * F.col("__mx_weight"))
    return share.select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_factor: int = MAX_FACTOR, seed: int = 17, sub_bins: int = 256) -> DataFrame:
    """doc_id, source, __mx_fp, size, source_size, target, copies: one row for each row of ``docs``."""
    sized = materialise(
        docs.select("doc_id", "source", fingerprint().alias("__mx_fp"), n_words(F.col("text")).alias("size")),
        "mixing-sizes",
    ).withColumn("__mx_class", size_class(F.col("size"))).withColumn("__mx_sub", F.pmod(F.col("__mx_fp"), F.lit(sub_bins)))
    bins = sized.groupBy("source", "__mx_class", "__mx_sub").agg(F.count("*").alias("__mx_n"))
    classes = sized.groupBy("source", "__mx_class").agg(F.count("*").alias("__mx_n"))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ahead_class = Window.partitionBy("source").orderBy("__mx_class").rowsBetween(Window.unboundedPreceding, -1)
    ahead_sub = Window.partitionBy("source", "__mx_class").orderBy("__mx_sub").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    placed = classes.select("source", "__mx_class", F.coalesce(F.sum("__mx_n").over(ahead_class), zero).alias("__mx_before"))
    within = bins.select("source", "__mx_class", "__mx_sub", F.coalesce(F.sum("__mx_n").over(ahead_sub), zero).alias("__mx_inner"))

    def same(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
        renamed = right.select(*[F.col(k).alias(f"{k}__r") for k in keys], *[c for c in right.columns if c not in keys])
        return left.join(renamed, [F.col(k).eqNullSafe(F.col(f"{k}__r")) for k in keys], "left").drop(*[f"{k}__r" for k in keys])

    order = Window.partitionBy("source", "__mx_class", "__mx_sub").orderBy("size", "__mx_fp", "doc_id")
    ranked = sized.withColumn("__mx_rank", F.row_number().over(order))
    starts = same(within, placed, "source", "__mx_class")
    starts = same(starts, source_targets(sizes, weights, max_factor), "source")
    at = same(ranked, starts, "source", "__mx_class", "__mx_sub").withColumn(
        "__mx_i", (F.col("__mx_before") + F.col("__mx_inner") + F.col("__mx_rank")).cast("decimal(18,0)")
    )
    t, s = F.floor("target").cast("decimal(19,0)"), F.col("source_size").cast("decimal(19,0)")
    share = md5_number(5, F.lit(str(seed)), F.concat(F.lit("s"), "source")) / float(1 << 20)
    offset = F.floor(share * F.col("source_size")).cast("decimal(19,0)")
    at = at.withColumn("__mx_t", t).withColumn("__mx_s", s).withColumn("__mx_u", offset)
    crossed = F.expr("(__mx_i * __mx_t + __mx_u) div __mx_s - ((__mx_i - 1) * __mx_t + __mx_u) div __mx_s")
    return at.select(
        "doc_id", "source", "__mx_fp", "size", "source_size", "target",
        F.when((F.col("source_size") > 0) & (F.col("size") > 0), crossed).otherwise(F.lit(0)).cast("long").alias("copies"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; ``copy`` numbers the repeats from 1.

    Of rows alike in doc_id, source and text one comes out (the first by its other columns), with the copies of all.
    """
    names = [c for c in docs.columns if c != "copy"]
    keys = ["__mx_k_id", "__mx_k_source", "__mx_k_fp"]
    taken = materialise(
        mix_plan(docs, **options)
        .select(F.col("doc_id").alias(keys[0]), F.col("source").alias(keys[1]), F.col("__mx_fp").alias(keys[2]), "copies")
        .groupBy(*keys)
        .agg(F.sum("copies").cast("int").alias("__mx_copies"), F.count("*").alias("__mx_rows"))
        .filter("__mx_copies > 0"),
        "mixing-taken",
    )
    same = F.col("doc_id").eqNullSafe(F.col(keys[0])) & F.col("source").eqNullSafe(F.col(keys[1])) & (fingerprint() == F.col(keys[2]))
    found = docs.join(taken, same)
    if taken.filter("__mx_rows > 1").take(1):  # only alike rows need to be told apart
        alike = Window.partitionBy(*keys).orderBy(*names)
        found = found.withColumn("__mx_nth", F.row_number().over(alike)).filter(F.col("__mx_nth") == 1)
    return found.select(*names, F.explode(F.sequence(F.lit(1), F.col("__mx_copies"))).alias("copy"))
