"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Method.  Ratings are ordered grades 0 .. K-1.  One score per document, a weighted sum of hashed text features with weights
shared by all grades, is compared with K - 1 ordered thresholds: P(grade >= k) = logistic(score - threshold k).  Weights
and thresholds are fitted together by maximum likelihood; ordered thresholds are the first one plus positive steps.  The
expected grade is the sum of the tail probabilities, and documents are selected by the tail probability of one grade.

Features are the distinct lower-case words of the text, hashed, each worth one over the root of their number, plus a few
shape features (share of repeated words, of symbols, of upper-case and word length, each in buckets).

Scale: fitting takes a bounded sample of rated rows, in an order given by hash: at most ``sample_rows`` of them, and as
many as have ``sample_chars`` characters together (one at least).  Executors turn whole texts into sparse features, and
only those of the sample come to the driver.  Scoring is one narrow pass over whole texts without a shuffle, whatever the
input size; memory follows pieces of 1 MB of text.

Defined cases: a null or empty text has no words, only the shape features of an empty text, and gets a score like any
other.  Ratings of unknown documents, null ratings and null ids are left out; equal ratings of a document count once, different
ones each, and so do the texts of a doc_id that is repeated (alike ones once).  With no usable rating the model scores everything 0 with thresholds 0 (all tail probabilities one
half).  Rows of the scored table are judged one by one, so null or repeated ids pass; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotweave.llm.batches import pieces
from glotweave.llm.wordhash import Words, gram_hashes, window_starts

BITS = 17
SAMPLE_ROWS = 10_000
SAMPLE_CHARS = 64_000_000
_SHAPES = 64
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>!"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_STRIP = np.zeros(256, dtype=bool)
_STRIP[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  #: 2**BITS word weights, then the shape weights
    thresholds: np.ndarray  #: K - 1 ascending cuts


def _bucket(share: np.ndarray) -> np.ndarray:
    """0 for none, then 1 .. 7 by doubling from 1 in 64."""
    with np.errstate(divide="ignore"):
        return np.where(share <= 0, 0, np.clip(np.floor(np.log2(np.maximum(share, 1e-9)) + 7), 1, 7)).astype(np.int64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature number, value) of a batch, sorted by text."""
    raw = Words(texts)
    n_texts = len(raw.first) - 1
    n = np.maximum(raw.counts(), 1)
    lowered = pc.utf8_lower(texts.fill_null(""))
    bare = Words(pc.replace_substring_regex(lowered, r"[!-/:-@\[-`{-~]+", " "))
    owner = np.repeat(np.arange(n_texts), bare.counts())
    number = (bare.hash >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.unique(owner * (1 << BITS) + number)
    owner, number = key >> BITS, key & ((1 << BITS) - 1)
    distinct = np.bincount(owner, minlength=n_texts)
    value = 1.0 / np.sqrt(np.maximum(distinct, 1))[owner]

    starts = np.concatenate([[0], np.cumsum(_SYMBOL[raw.data])])
    uppers = np.concatenate([[0], np.cumsum(_UPPER[raw.data])])
    lengths = np.concatenate([[0], np.cumsum(raw.end - raw.begin)])
    ends = np.append(raw.begin, len(raw.data))[raw.first]
    symbols, upper = np.diff(starts[ends]), np.diff(uppers[ends])
    letters = np.diff(lengths[raw.first])
    at, text = window_starts(raw.first, 3)
    grams = gram_hashes(raw.hash, 3, salt=21)[at]
    order = np.lexsort((grams, text))
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (grams[order][1:] == grams[order][:-1]) & (text[order][1:] == text[order][:-1])
    repeats = np.bincount(text[order], again, n_texts)
    shapes = np.stack(
        [
            _bucket(repeats / n),
            8 + _bucket(symbols / n),
            16 + _bucket(upper / np.maximum(letters, 1)),
            24 + np.clip(letters // n, 0, 15),
            40 + np.clip(np.log2(n).astype(np.int64), 0, 15),
        ],
        axis=1,
    )
    shape_owner = np.repeat(np.arange(n_texts), shapes.shape[1])
    owner = np.concatenate([owner, shape_owner])
    number = np.concatenate([number, (1 << BITS) + shapes.ravel()])
    value = np.concatenate([value, np.full(shapes.size, 0.5)])
    order = np.argsort(owner, kind="stable")
    return owner[order], number[order], value[order]


def _sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            owner, number, _ = features(part.column("text"))
            cuts = np.searchsorted(owner, np.arange(part.num_rows + 1))
            packed = [number[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([part.column("grade"), part.column("pick"), pa.array(packed, pa.binary())], ["grade", "pick", "x"])


def _fit_arrays(rows: list[np.ndarray], grade: np.ndarray, n_grades: int, steps: int = 150, l2: float = 3e-4, rate: float = 0.3) -> Model:
    """Adam over the whole sample; rarer grades weigh more, by the root of how rare they are."""
    dims, last = (1 << BITS) + _SHAPES, n_grades - 1
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    number = np.concatenate(rows)
    words = number < (1 << BITS)
    value = np.where(words, 1.0 / np.sqrt(np.maximum(np.bincount(owner[words], minlength=len(rows)), 1))[owner], 0.5).astype(np.float32)
    shares = np.bincount(grade, minlength=n_grades) / len(grade)
    importance = (1.0 / np.sqrt(np.maximum(shares, 1e-3)))[grade]
    importance /= importance.sum()
    here = np.arange(len(rows))
    #: the weights, then the first threshold and the logarithms of the gaps to the next ones
    state = np.zeros(dims + last)
    mean, square = np.zeros_like(state), np.zeros_like(state)
    for t in range(1, steps + 1):
        gaps = np.exp(state[dims + 1 :])
        cuts = state[dims] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(owner, state[number] * value, len(rows))
        tails = np.ones((len(rows), n_grades + 1))
        tails[:, 1:-1] = 1.0 / (1.0 + np.exp(-np.clip(score[:, None] - cuts[None, :], -30, 30)))
        tails[:, -1] = 0.0
        slopes = tails * (1 - tails)
        pull = importance / np.maximum(tails[here, grade] - tails[here, grade + 1], 1e-9)
        low, high = slopes[here, grade] * pull, slopes[here, grade + 1] * pull
        grad = np.empty_like(state)
        grad[:dims] = np.bincount(number, (high - low)[owner] * value, dims) + l2 * state[:dims]
        by_cut = np.array([low[grade == k + 1].sum() - high[grade == k].sum() for k in range(last)])
        grad[dims:] = np.cumsum(by_cut[::-1])[::-1]
        grad[dims + 1 :] *= gaps
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        state -= rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t) * mean / (np.sqrt(square) + 1e-6)
    return Model(state[:dims].astype(np.float32), state[dims] + np.concatenate([[0.0], np.cumsum(np.exp(state[dims + 1 :]))]))


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """``ratings`` has doc_id and grade (0 .. n_grades - 1)."""
    rated = (
        ratings.select("doc_id", F.col("grade").cast("int").alias("grade"))
        .filter(F.col("doc_id").isNotNull() & F.col("grade").between(0, n_grades - 1))
        .distinct()
    )
    spark = docs.sparkSession
    pick = F.xxhash64("doc_id", F.lit("rating sample"))
    # the ratings first in order, then what they rate
    chosen = rated.withColumn("pick", pick).orderBy("pick", "doc_id", "grade").limit(sample_rows)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("fp"))
    found = (
        texts.withColumn("chars", F.coalesce(F.char_length("text"), F.lit(0))).drop("text").join(F.broadcast(chosen), "doc_id").distinct()
        .orderBy("pick", "doc_id", "grade", "fp").limit(sample_rows).collect()
    )
    room, taken = sample_chars, []
    for r in found:
        room -= r["chars"]
        if room < 0 and taken:
            break
        taken.append((r["doc_id"], r["fp"], r["grade"], r["pick"]))
    keys = spark.createDataFrame(taken, "doc_id long, fp long, grade int, pick long")
    sample = texts.join(F.broadcast(keys), ["doc_id", "fp"]).groupBy("doc_id", "fp", "grade", "pick").agg(F.min("text").alias("text"))
    got = sample.select("grade", "pick", "text").mapInArrow(_sparse_rows, "grade int, pick long, x binary").collect()
    got = sorted((r["pick"], r["grade"], bytes(r["x"])) for r in got)
    if not got:
        return Model(np.zeros((1 << BITS) + _SHAPES, np.float32), np.zeros(n_grades - 1))
    rows = [np.frombuffer(g[2], dtype=np.int32) for g in got]
    return _fit_arrays(rows, np.array([g[1] for g in got]), n_grades)


def _score(model: Model, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                owner, number, value = features(part.column("text"))
                score = np.bincount(owner, model.weights[number] * value, part.num_rows)
                tails = 1.0 / (1.0 + np.exp(-np.clip(score[:, None] - model.thresholds[None, :], -50, 50)))
                tail = tails[:, level - 1]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= 0.5)],
                    ["doc_id", "expected_grade", "tail_prob", "kept"],
                )

    return run


def score(docs: DataFrame, model: Model, level: int) -> DataFrame:
    """doc_id, expected_grade, tail_prob = P(grade >= level), kept (tail_prob of one half or more)."""
    return docs.select("doc_id", "text").mapInArrow(_score(model, level), "doc_id long, expected_grade double, tail_prob double, kept boolean")


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """Three grades from the labels table: 0 toxic, 1 poor, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade")).filter(F.col("grade").isNotNull())
