"""Document fingerprints: canonical exact digests.

A text is canonical after NFKC, case folding, NFKC again (folding can undo it), and runs of white space made one space, none
at the ends.  Its fingerprint is the xxh3 hash of the canonical UTF-8 bytes in lowercase hex, 128 bits wide.  Texts of one fingerprint
are one bucket, and inside every bucket of several texts the canonical bytes themselves are compared.  Should a bucket hold
two different texts, all texts are hashed anew with twice the bits (further bits come from further seeds), until no bucket
does.  So two fingerprints of one call are equal if and only if the canonical texts are equal, whatever the hash does.

Scale: fingerprints are made in one pass over Arrow batches.  Comparison is a grouping by (fingerprint, canonical text) of the
texts whose fingerprint recurs: each task keeps one of equal texts before anything is shuffled, so a group of
copies of any size leaves a task as one row.  Nothing is collected but one row that says whether a bucket is mixed.

``edit_with_next`` puts documents in order by cells of neighbouring ids, so that no window spans the table: the ids'
quantiles are the cells' bounds, ids that many rows share are spread over several cells by the text's hash, and the first
document of each cell is sent along to the cell before it.

Defined cases: a null text is an empty one, and its fingerprint is that of the empty text.  No rows give no rows.  Null ids are
the smallest integer; rows of one id are in the order of their texts' hashes; repeated rows stay.  Other columns pass through
``fingerprint``, but for those named as it names its own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glotweave.llm.batches import PIECE_BYTES, pieces
from glotweave.llm.columns import wide_hash
from glotweave.llm.storage import Scratch, materialise

#: Repeated fingerprints up to this number are broadcast (64 bytes each); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Documents in a cell, and the most cells: beyond them cells grow.
CELL_ROWS, MAX_CELLS = 4096, 100_000
_SMALLEST = -(1 << 63)


def canonical(text: str | None) -> bytes:
    """UTF-8 of the canonical form."""
    text = text or ""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def digest(data: bytes, bits: int = 128) -> str:
    """Hex of ``bits`` bits, a multiple of 4: xxh3-128 by seed 0, then by seeds 1, 2, ..."""
    out = "".join(xxhash.xxh3_128_hexdigest(data, seed) for seed in range(-(-bits // 128)))
    return out[: bits // 4]


def _fingerprints(rows: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """Fingerprints instead of the texts."""
    others = [c for c in rows.columns if c not in columns and c not in {f"{x}_fingerprint" for x in columns}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, columns[0], max_bytes=4 * PIECE_BYTES):
                made = []
                for c in columns:
                    distinct = part.column(c).fill_null("").dictionary_encode()
                    values = pa.array([digest(canonical(t.as_py()), bits) for t in distinct.dictionary], pa.string())
                    made.append(values.take(distinct.indices))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], *made], [f.name for f in schema])

    schema = T.StructType([*[rows.schema[c] for c in others], *[T.StructField(f"{c}_fingerprint", T.StringType()) for c in columns]])
    return rows.select(*[f"`{c}`" for c in [*others, *columns]]).mapInArrow(run, schema)


def _canonicals(rows: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """(fingerprint, canonical) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, columns[0], max_bytes=4 * PIECE_BYTES):
                for c in columns:
                    found = [canonical(t) for t in set(part.column(c).to_pylist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([digest(x, bits) for x in found], pa.string()), pa.array(found, pa.binary())], ["fingerprint", "canonical"]
                    )

    return rows.select(*columns).mapInArrow(run, "fingerprint string, canonical binary")


def _mixed(rows: DataFrame, made: DataFrame, columns: list[str], bits: int, broadcast_rows: int) -> bool:
    """Whether two different canonical texts have one fingerprint."""
    names = F.array(*[f"{c}_fingerprint" for c in columns])
    with Scratch(rows.sparkSession) as scratch:
        repeated = scratch.table(
            made.select(F.explode(names).alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1").select("fingerprint"),
            "fingerprint-repeated",
        )
        few = repeated.count() <= broadcast_rows
        members = _canonicals(rows, columns, bits).join(F.broadcast(repeated) if few else repeated, "fingerprint", "left_semi")
        distinct = members.groupBy("fingerprint", "canonical").agg(F.count("*").alias("n"))
        mixed = distinct.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1")
        return bool(mixed.limit(1).count())


def fingerprint(rows: DataFrame, columns: list[str], bits: int = 128, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with <column>_fingerprint in place of each of the text ``columns``.

    The result lies in a scratch table, which ``storage.scratch_path`` names.  ``rows`` is read twice.
    """
    while True:
        made = materialise(_fingerprints(rows, columns, bits), "fingerprints")
        if not _mixed(rows, made, columns, bits, broadcast_rows):
            return made
        with Scratch(rows.sparkSession) as scratch:
            scratch.adopt(made)
        bits *= 2


def _cell_of(bounds: np.ndarray):
    """Cell of (u, a): between which bounds u lies; a u that is several bounds at once has the cells between them, by a."""

    @F.pandas_udf(T.IntegerType())
    def cell(u, a):
        u = u.to_numpy(np.int64)
        low, high = np.searchsorted(bounds, u, "left"), np.searchsorted(bounds, u, "right")
        part = (a.to_numpy(np.int64).astype(np.float64) / 2.0**64 + 0.5) * (high - low)
        return pd.Series((low + np.minimum(part.astype(np.int64), np.maximum(high - low - 1, 0))).astype(np.int32))

    return cell


def in_order(docs: DataFrame, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, Window]:
    """Documents (doc_id, text) by descending doc_id: with their cell, and the window in which each one's next document follows.

    Rows with ``sent`` are the first documents of the next cell, the last one's next being the first of all.
    """
    spark = docs.sparkSession
    t = wide_hash(F.col("text"))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.select("*", F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(_SMALLEST))).alias("u"), t["a"].alias("a"), t["b"].alias("b"))
    order = Window.partitionBy("cell").orderBy("sent", "u", "a", "b")
    n = docs.count()
    cells = min(MAX_CELLS, max(1, -(-n // cell_rows)))
    shares = [i / cells for i in range(1, cells)]
    bounds = np.empty(0, np.int64)
    if n and shares:
        ids = F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(_SMALLEST)))
        found = docs.select(ids.alias("u")).agg(F.percentile_approx("u", shares, max(10_000, 4 * cells)).alias("b")).first()["b"]
        bounds = np.array(found, dtype=np.int64)
    keyed = keyed.withColumn("cell", _cell_of(bounds)("u", "a"))
    firsts = keyed.groupBy("cell").agg(F.min(F.struct("u", "a", "b")).alias("f")).orderBy("cell").collect()  # one row per cell
    before = [firsts[-1], *firsts[:-1]] if firsts else []
    sent = [(p["cell"], *f["f"]) for p, f in zip(before, firsts)]
    sent = spark.createDataFrame(sent, "to int, u long, a long, b long")
    away = keyed.drop("cell").join(F.broadcast(sent), ["u", "a", "b"]).select("doc_id", "text", "u", "a", "b", F.col("to").alias("cell"), F.lit(True).alias("sent"))
    return keyed.withColumn("sent", F.lit(False)).unionByName(away), order


def edit_with_next(docs: DataFrame, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, Window]:
    """Documents in order with ``edited``, their text with its last third taken from the beginning of the next document."""
    rows, order = in_order(docs, cell_rows)
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    following = F.lead("text").over(order)
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(following, F.lit(1), cut))
    return rows.withColumn("edited", F.when(~F.col("sent"), edited)), order


def compare_edited(docs: DataFrame, bits: int = 128, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A fingerprint is as like another as it is equal: 1 or 0.
    """
    rows, order = edit_with_next(docs, cell_rows)
    texts = rows.select(
        "doc_id", "cell", "sent", "u", "a", "b", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), "text", "edited",
    )
    made = fingerprint(texts, ["text", "edited"], bits)

    def like(other):
        return F.when(F.col("text_fingerprint") == other, 1.0).otherwise(0.0)

    return (
        made.withColumn("next", F.lead("text_fingerprint").over(order)).filter(~F.col("sent"))
        .select(
            "doc_id", "n_chars", "edited_sha256", F.col("text_fingerprint").alias("fingerprint"), F.col("edited_fingerprint"),
            like(F.col("edited_fingerprint")).alias("near_edited"), like(F.col("next")).alias("near_next"),
        )
    )
