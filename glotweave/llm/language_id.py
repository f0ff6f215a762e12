"""Language ID by error-correcting output codes.

Method.  Every learned language gets a codeword, a row of a Hadamard matrix without its constant columns: any two rows of
order N differ in N / 2 bits.  One binary classifier per bit, linear over hashed character n-grams, learns to predict that
bit.  A text's bit margins are decoded by loss: each language costs the sum over bits of the logistic loss of the margin
against its bit, weighted by how well the bit was learned; the language with the least cost wins.  ``score`` is its share
of exp(-cost) over all languages, and ``ambiguous`` says that the runner-up comes within ``margin`` of it.

Text becomes lower-case UTF-8 with every ASCII character but letters as one space; features are its byte n-grams of
lengths 2 to 4, hashed into ``dims`` counters, square-rooted and scaled to unit length.

Scale: fitting takes a bounded sample, at most ``sample_rows`` labelled rows spread evenly over the languages (chosen by
hash, so reruns agree); their feature vectors (half precision, ``sample_rows`` x ``dims``) are what comes to the driver,
whatever the size of the corpus.  As every language needs a row, the ``sample_rows`` most frequent values of lang are
learned if there are more.  Fitting ends when the loss has settled.  Prediction is one narrow pass without a shuffle; memory
follows pieces of 1 MB of text and ``ROWS`` rows.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; so is every text if nothing could be
learned.  One learned language is predicted for all texts with letters.  Rows with a null doc_id are predicted but not
learned from (their fold is unknown) and have held_out = false.  Repeated rows are judged one by one and learned from once (rows
alike in doc_id, lang and text); extra columns pass through ``identify``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glotweave.llm.batches import pieces

DIMS = 4096
SAMPLE_ROWS = 4000
MARGIN = 0.2
#: Texts whose feature rows are in memory at once.
ROWS = 256
UND = "und"

_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    codes: np.ndarray  #: (languages, bits) of -1 and 1
    weights: np.ndarray  #: (dims, bits)
    bias: np.ndarray  #: (bits,)
    trust: np.ndarray  #: (bits,)


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1; no column is constant."""
    if n < 2:
        return np.zeros((n, 0), dtype=np.int8)
    h = np.ones((1, 1), dtype=np.int8)
    while len(h) < n + 1:
        h = np.block([[h, h], [h, -h]])
    rows = h[1 : n + 1]
    return rows[:, (rows != rows[0]).any(axis=0)]


def features(texts: pa.Array, dims: int = DIMS) -> np.ndarray:
    """(texts, dims) float32 rows of unit length; texts without letters give zeros or a row of little use."""
    lowered = pc.utf8_lower(texts.fill_null("")).cast(pa.large_binary())
    n = len(lowered)
    if not n:
        return np.zeros((0, dims), dtype=np.float32)
    offsets = np.frombuffer(lowered.buffers()[1], dtype=np.int64)[lowered.offset : lowered.offset + n + 1]
    raw = lowered.buffers()[2]
    data = _CLEAN[np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]]] if raw is not None else np.empty(0, np.uint8)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20) | (owner[1:] != owner[:-1])
    data, owner = data[keep].astype(np.uint32), owner[keep]
    counts = np.zeros(n * dims, dtype=np.float32)
    code = np.zeros(len(data), dtype=np.uint32)
    for k in range(1, 5):
        if len(data) < k:
            break
        code = code[: len(data) - k + 1] * np.uint32(257) + data[k - 1 :]
        if k == 1:
            continue
        own = owner[: len(code)]
        whole = own == owner[k - 1 :]
        slot = ((code * np.uint32(2654435761) + np.uint32(k * 40503)) >> np.uint32(8)) % np.uint32(dims)
        counts += np.bincount(own[whole] * dims + slot[whole], minlength=n * dims).astype(np.float32)
    rows = np.sqrt(counts).reshape(n, dims)
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-9)


def _train_bits(
    x: np.ndarray, signs: np.ndarray, max_steps: int = 2000, settled: float = 1e-3, l2: float = 1e-4
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression of every bit at once by Adam over the whole sample; weights, biases and training accuracies.

    It ends when ten steps together lower the mean loss by less than the share ``settled``.
    """
    n, d = x.shape
    w, b = np.zeros((d, signs.shape[1]), dtype=np.float32), np.zeros(signs.shape[1], dtype=np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    before = np.inf
    for t in range(1, max_steps + 1):
        z = signs * (x @ w + b)
        if t % 10 == 1:
            loss = float(np.logaddexp(0, -z).mean() + l2 / 2 * (w * w).sum() / signs.shape[1])
            if before - loss < settled * loss:
                break
            before = loss
        g = -signs / (1 + np.exp(np.clip(z, -30, 30))) / n
        gw, gb = x.T @ g + l2 * w, g.sum(axis=0)
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = 0.3 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= scale * m / (np.sqrt(v) + 1e-7)
        b -= scale * mb / (np.sqrt(vb) + 1e-7)
    right = ((x @ w + b) * signs > 0).mean(axis=0)
    return w.astype(np.float32), b, right


def _featurise(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, max_rows=ROWS):
                rows = features(part.column("text"), dims).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), pa.array([r.tobytes() for r in rows], pa.binary())], ["lang", "x"]
                )

    return run


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, dims: int = DIMS) -> Model:
    """Learn from text and lang of at most ``sample_rows`` rows; rows with a null text or lang are left out."""
    usable = labelled.select("doc_id", "lang", F.xxhash64("text").alias("fp"), "text").filter(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    seen = {r["lang"]: r["count"] for r in usable.select("doc_id", "lang", "fp").distinct().groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample_rows).collect()}
    if not seen:
        return Model((), codewords(0), np.zeros((dims, 0), np.float32), np.zeros(0), np.zeros(0))
    each = max(1, sample_rows // len(seen))
    # first a share of each language by hash, more than is needed, so that the ranking sees a bounded number of rows: none of a
    # language is missed but with probability exp(-40)
    pick = F.pmod(F.xxhash64("doc_id", "fp", F.lit("language sample")), F.lit(1 << 40))
    bounds = F.create_map(*[F.lit(x) for lang, n in seen.items() for x in (lang, int(min(1.0, (2 * each + 40) / n) * (1 << 40)))])
    order = Window.partitionBy("lang").orderBy("pick", "doc_id", "fp")
    chosen = (
        usable.select("doc_id", "lang", "fp", pick.alias("pick")).filter(F.col("pick") < F.element_at(bounds, F.col("lang"))).distinct()
        .withColumn("n", F.row_number().over(order)).filter(F.col("n") <= each)
        .select(F.col("doc_id").alias("id"), F.col("lang").alias("l"), F.col("fp").alias("f"))
    )
    same = (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("l")) & (F.col("fp") == F.col("f"))
    sample = usable.join(F.broadcast(chosen), same).groupBy("doc_id", "lang", "fp").agg(F.min("text").alias("text")).select("lang", "text")
    got = sorted((r["lang"], bytes(r["x"])) for r in sample.mapInArrow(_featurise(dims), "lang string, x binary").collect())
    langs = tuple(sorted({g[0] for g in got}))
    x = np.stack([np.frombuffer(g[1], dtype=np.float16) for g in got]).astype(np.float32)
    codes = codewords(len(langs))
    y = np.searchsorted(np.array(langs), np.array([g[0] for g in got]))
    if len(langs) < 2:
        return Model(langs, codes, np.zeros((dims, 0), np.float32), np.zeros(0), np.zeros(0))
    w, b, right = _train_bits(x, codes[y].astype(np.float32))
    return Model(langs, codes, w, b, np.maximum(2 * right - 1, 0.05))


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winner, its share and the runner-up's share for each row of bit margins."""
    if len(model.langs) == 1:
        one = np.ones(len(margins))
        return np.zeros(len(margins), dtype=np.int64), one, one * 0
    # the logistic losses of z and -z differ by z, so sums of losses differ as these sums of margins do: no rows x languages x bits
    gain = (margins * model.trust) @ model.codes.T / 2
    share = np.exp(gain - gain.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    order = np.argsort(-share, axis=1, kind="stable")
    rows = np.arange(len(share))
    return order[:, 0], share[rows, order[:, 0]], share[rows, order[:, 1]]


def _predict(model: Model, names: list[str], margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, max_rows=ROWS):
                lettered = np.asarray(part.column("__li_letter"))
                if model.langs:
                    best, top, second = decode(model, features(part.column("text"), len(model.weights)) @ model.weights + model.bias)
                else:
                    best, top, second = np.zeros(part.num_rows, int), np.zeros(part.num_rows), np.zeros(part.num_rows)
                known = lettered & bool(model.langs)
                lang = pa.array([model.langs[i] if k else UND for i, k in zip(best.tolist(), known.tolist())], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], lang, pa.array(np.where(known, np.minimum(top, 1.0), 0.0)), pa.array(~known | (top - second < margin))],
                    [*names, "lang_pred", "score", "ambiguous"],
                )

    return run


def identify(docs: DataFrame, model: Model, margin: float = MARGIN) -> DataFrame:
    """``docs`` plus lang_pred, score (0 to 1) and ambiguous; only the text decides."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    lettered = docs.select(*names, F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("__li_letter"))
    schema = T.StructType(
        [*[docs.schema[c] for c in names], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    )
    return lettered.mapInArrow(_predict(model, names, margin), schema)


def held_out():
    """Column: the row is in the fold that is never learned from (crc32 of the id as text, modulo 4, is 2)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit_documents(docs: DataFrame, **options) -> Model:
    """A model learned from the rows of ``docs`` that are not held out."""
    return fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out()), **options)
