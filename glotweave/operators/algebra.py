"""Dense linear algebra on vector tables: preprocessing, isomorphism, mapping, held-out retrieval.

Rows are multiplied by small matrices on executors; sums of outer products (d x d) are accumulated per partition and added
up, and only those reach the driver, where d is at most a few hundred.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glotweave.functions.vectors import as_double, dot, unit
from glotweave.operators.knn import BROADCAST_BYTES, csls_join, csls_penalty, hubness_skew, knn_join, matrix, unit_rows
from glotweave.scratch import Scratch

METHODS = ("none", "norm_only", "center", "center_whiten", "center_whiten_renorm")


def _lists(m: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(m, dtype=np.float64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1] if m.size else 1, dtype=np.int32)), flat)


def map_vectors(df: DataFrame, function) -> DataFrame:
    """``df`` with ``vec`` replaced by ``function`` of its rows, a batch at a time."""
    df = df.withColumn("vec", as_double(F.col("vec")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                new = _lists(function(matrix(batch.column("vec"))))
                at = batch.schema.get_field_index("vec")
                yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(run, df.schema)


def outer_sums(df: DataFrame, left: str, right: str, normalise: bool = False, function=None) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(n, sum of left, sum of right, left' right) over all rows, of what ``function`` makes of them if one is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = matrix(batch.column("a")), matrix(batch.column("b"))
            if normalise:
                a, b = unit_rows(a), unit_rows(b)
            if function is not None:
                a, b = function(a), function(b)
            a1, b1 = (np.hstack([x, np.ones((len(x), 1))]) for x in (a, b))
            part = a1.T @ b1
            total, n = (part if total is None else total + part), n + len(a)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["n", "s"])

    two = df.select(as_double(F.col(left)).alias("a"), as_double(F.col(right)).alias("b"))
    parts = two.mapInArrow(run, "n long, s array<double>")
    added = parts.select("n", F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()
    if not added:
        raise ValueError("no vectors")
    dims = df.select(F.size(left).alias("a"), F.size(right).alias("b")).first()
    s = np.array([r["x"] for r in added]).reshape(dims["a"] + 1, dims["b"] + 1)
    return added[0]["n"], s[:-1, -1], s[-1, :-1], s[:-1, :-1]


def covariance(df: DataFrame, function=None) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance with n - 1) of ``vec``, or of what ``function`` makes of its rows."""
    n, total, _, gram = outer_sums(df, "vec", "vec", function=function)
    mean = total / n
    return mean, (gram - n * np.outer(mean, mean)) / (n - 1)


def preprocess(df: DataFrame, method: str) -> DataFrame:
    """none, or a prefix of: unit length, centring, ZCA whitening, unit length."""
    return df if method == "none" else map_vectors(df, preprocessing(df, method))


def preprocessing(df: DataFrame, method: str):
    """What ``preprocess`` does to a batch of rows, all its steps in one function, so that a task needs one Python worker and not one a step."""
    if method not in METHODS:
        raise ValueError(f"unknown preprocessing {method!r}; expected one of {METHODS}")
    first = lambda m: unit_rows(m, 1e-8)
    if method == "none":
        return lambda m: m
    if method == "norm_only":
        return first
    mean, cov = covariance(df, first)
    if method == "center":
        return lambda m: first(m) - mean
    u, s, _ = np.linalg.svd(cov)
    white = u @ np.diag(1 / np.sqrt(s + 1e-6)) @ u.T
    last = first if method == "center_whiten_renorm" else (lambda m: m)
    return lambda m: last((first(m) - mean) @ white.T)


def _paired(pairs: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """(pair_no, x, y): vectors of the pairs whose words are known."""
    return pairs.join(source.select(F.col("word").alias("src"), as_double(F.col("vec")).alias("x")), "src").join(
        target.select(F.col("word").alias("tgt"), as_double(F.col("vec")).alias("y")), "tgt"
    )


def _upper(ids: np.ndarray, x: np.ndarray, y: np.ndarray, others: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distances (dx, dy) of the pairs of rows with smaller number left, some rows at a time."""
    for a in range(0, len(ids), 256):
        part = slice(a, a + 256)
        for b in range(0, len(others), 4096):
            beside = slice(b, b + 4096)
            later = ids[part][:, None] < others[None, beside]
            if later.any():
                yield (1 - x[part] @ xs[beside].T)[later], (1 - y[part] @ ys[beside].T)[later]


def _pair_blocks(p: DataFrame, n: int, dims: int, broadcast_bytes: int, block_rows: int, scratch: Scratch):
    """A table, and a function from its batches to the distances of all pairs of rows (pair_no, x, y), each once.

    A table below ``broadcast_bytes`` is sent to executors and meets its own rows; a larger one meets itself block by block.
    """
    rows = lambda v: (np.asarray(v.field("pair_no")), matrix(v.field("x")), matrix(v.field("y")))
    if n * dims * 8 <= broadcast_bytes:
        table = p.orderBy("pair_no").toArrow().combine_chunks()
        held = p.sparkSession.sparkContext.broadcast((np.asarray(table["pair_no"].combine_chunks()), matrix(table["x"]), matrix(table["y"])))

        def against_all(batch: pa.RecordBatch):
            ids, x, y = (np.asarray(batch.column("pair_no")), matrix(batch.column("x")), matrix(batch.column("y")))
            yield from _upper(ids, x, y, *held.value)

        return p.repartition(max(1, min(n // 64, p.sparkSession.sparkContext.defaultParallelism)), "pair_no"), against_all
    many = max(1, -(-n // block_rows))
    blocks = p.groupBy(F.pmod(F.xxhash64("pair_no"), F.lit(many)).cast("int").alias("i")).agg(F.collect_list(F.struct("pair_no", "x", "y")).alias("a"))
    blocks = scratch.table(blocks, "rsa-blocks")
    tiles = blocks.withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(many - 1)))).join(blocks.select(F.col("i").alias("j"), F.col("a").alias("b")), "j")

    def tile(batch: pa.RecordBatch):
        for r in range(batch.num_rows):
            a, b = rows(batch.column("a")[r].values), rows(batch.column("b")[r].values)
            yield from _upper(*a, *b)
            if batch.column("i")[r].as_py() != batch.column("j")[r].as_py():
                yield from _upper(*b, *a)

    return tiles, tile


#: Cells of the distances 0 to 2; distances in one cell count as tied.  The grid begins off any round number, so that equal distances that differ in
#: their last bits share a cell.
RANK_CELLS = 1 << 22
_GRID_START = -0.000_001_234_567


def _cell(d: np.ndarray) -> np.ndarray:
    return np.clip(((d - _GRID_START) * (RANK_CELLS / 2.00001)).astype(np.int64), 0, RANK_CELLS - 1)


def _cell_ranks(counts: np.ndarray) -> np.ndarray:
    """Mean rank of the values of each cell, less the mean of all ranks."""
    ahead = np.cumsum(counts) - counts
    return ahead + (counts + 1) / 2 - (counts.sum() + 1) / 2


def rsa(pairs: DataFrame, source: DataFrame, target: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = 2048) -> DataFrame:
    """rsa_n_pairs, rsa_pearson, rsa_spearman: correlation of the two spaces' pairwise cosine distances over all pairs i < j of seed
    pairs (their number is that of the dictionary squared, so no row is made of them).

    One pass over blocks of pairs adds up moments and counts distances by cells of 5e-7; the counts are the ranks, distances of one
    cell being ties; a second pass over the same blocks adds up the products of ranks.  What tasks return, and what they are sent,
    is at most a number for each of ``RANK_CELLS`` cells.
    """
    spark = pairs.sparkSession
    with Scratch(spark) as scratch:
        p = scratch.table(_paired(pairs, source, target).select("pair_no", unit(F.col("x")).alias("x"), unit(F.col("y")).alias("y")), "rsa-pairs")
        size = p.agg(F.count("*").alias("n"), F.max(F.size("x") + F.size("y")).alias("d")).first()
        table, distances = _pair_blocks(p, size["n"], size["d"] or 0, broadcast_bytes, block_rows, scratch)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(which: str, at: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([which] * len(at)), pa.array(at, pa.int64()), pa.array(values, pa.float64())], ["which", "at", "v"])

            moments, held = np.zeros(6), {which: np.zeros(RANK_CELLS, np.int64) for which in "xy"}
            for batch in batches:
                for d in distances(batch):
                    x, y = d[0] - 1, d[1] - 1  # about their middle, for the digits
                    moments += len(x), x.sum(), y.sum(), x @ x, y @ y, x @ y
                    for counts, v in zip(held.values(), d):
                        np.add.at(counts, _cell(v), 1)
            for which, counts in held.items():
                for first in range(0, RANK_CELLS, 1 << 18):
                    at = np.flatnonzero(counts[first : first + (1 << 18)]) + first
                    if len(at):
                        yield out(which, at, counts[at])
            yield out("m", np.arange(6), moments)

        counted = table.mapInArrow(count, "which string, at long, v double").groupBy("which", "at").agg(F.sum("v").alias("v"))
        found = scratch.table(counted, "rsa-cells").toArrow()
        sums = {}
        for which, cells in (("m", 6), ("x", RANK_CELLS), ("y", RANK_CELLS)):
            some = found.filter(pc.equal(found["which"], which))
            sums[which] = np.zeros(cells)
            sums[which][np.asarray(some["at"])] = np.asarray(some["v"])
        ranks = {w: _cell_ranks(sums[w]) for w in "xy"}
        sent = spark.sparkContext.broadcast((ranks["x"], ranks["y"]))

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rx, ry = sent.value
            total = sum(float(rx[_cell(dx)] @ ry[_cell(dy)]) for batch in batches for dx, dy in distances(batch))
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.float64())], ["v"])

        product = table.mapInArrow(multiply, "v double").agg(F.sum("v").alias("v")).first()["v"]
    m, x, y, xx, yy, xy = sums["m"]
    pearson = _ratio(m * xy - x * y, (m * xx - x * x) * (m * yy - y * y))
    spearman = _ratio(product, float((sums["x"] @ ranks["x"] ** 2) * (sums["y"] @ ranks["y"] ** 2)))
    return spark.createDataFrame([(pearson, spearman, size["n"])], "rsa_pearson double, rsa_spearman double, rsa_n_pairs long")


def _ratio(product: float | None, squares: float) -> float | None:
    return float(product / np.sqrt(squares)) if product is not None and squares > 0 else None


def average_ranks(df: DataFrame, cells: int = 4096, **columns: str) -> DataFrame:
    """``df`` with ranks from 1 of its columns, ``columns`` saying under which names; ties share the mean of their places.

    Values are counted, then ranked within cells of equal width, cells by the counts of those before them: no task sees more
    than a cell.  Null values have no rank.
    """
    bounds = df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)]).first()
    for c, name in columns.items():
        low, high = bounds[f"min_{c}"], bounds[f"max_{c}"]
        cell = F.floor((F.col("__ar_v") - low) / (high - low) * cells) if low is not None and high > low else F.lit(0)
        counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("__ar_v")).agg(F.count("*").alias("__ar_n")).withColumn("__ar_cell", cell)
        before = Window.orderBy("__ar_cell").rowsBetween(Window.unboundedPreceding, -1)
        bases = counts.groupBy("__ar_cell").agg(F.sum("__ar_n").alias("m")).select("__ar_cell", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("__ar_base"))
        ahead = Window.partitionBy("__ar_cell").orderBy("__ar_v").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("__ar_ahead", F.coalesce(F.sum("__ar_n").over(ahead), F.lit(0))).join(bases, "__ar_cell")
        ranks = placed.select("__ar_v", (F.col("__ar_base") + F.col("__ar_ahead") + (F.col("__ar_n") + 1) / 2).alias(name))
        df = df.join(ranks, F.col(c) == F.col("__ar_v"), "left").drop("__ar_v")
    return df


def spectrum(df: DataFrame, n: int = 10_000) -> np.ndarray:
    """Singular values of the first n vectors, uncentred, falling."""
    _, _, _, gram = outer_sums(df.filter(F.col("idx") < n), "vec", "vec")
    return np.sqrt(np.maximum(np.linalg.eigvalsh(gram)[::-1], 0))


def eigenvalue_distance(source: DataFrame, target: DataFrame, n: int = 10_000, k: int = 20) -> tuple[float, int]:
    """Squared distance of the k largest singular values, each scaled to sum 1 over those k; and k."""
    a, b = spectrum(source, n), spectrum(target, n)
    k = min(k, len(a), len(b))
    a, b = a[:k] / a[:k].sum(), b[:k] / b[:k].sum()
    return float(((a - b) ** 2).sum()), k


def grade(metric: str, value: float) -> str:
    """HIGH, MEDIUM or LOW match."""
    high, medium, rising = {"rsa": (0.6, 0.3, True), "eigval": (0.01, 0.1, False), "hubness": (1.0, 3.0, False)}[metric]
    if rising:
        return "HIGH" if value >= high else "MEDIUM" if value >= medium else "LOW"
    return "HIGH" if value < high else "MEDIUM" if value < medium else "LOW"


def isomorphism(pairs: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """(metric, value, label): RSA (from 10 known pairs), spectrum and hubness of two spaces before alignment."""
    rows: list[tuple[str, float, str | None]] = []
    known = pairs.join(source.select(F.col("word").alias("src")), "src", "left_semi").join(target.select(F.col("word").alias("tgt")), "tgt", "left_semi")
    if known.count() >= 10:
        r = rsa(known, source, target).first()
        rows += [("rsa_n_pairs", float(r["rsa_n_pairs"]), None), ("rsa_pearson", round(r["rsa_pearson"], 4), grade("rsa", round(r["rsa_pearson"], 4))), ("rsa_spearman", round(r["rsa_spearman"], 4), None)]
    distance, k = eigenvalue_distance(source, target)
    rows += [("eigval_distance", round(distance, 6), grade("eigval", round(distance, 6))), ("eigval_k", float(k), None)]
    a, b = (round(hubness_skew(s).first()["skew"] or 0.0, 4) for s in (source, target))  # null: all counts alike
    rows += [("src_hubness_skew", a, None), ("tgt_hubness_skew", b, None), ("hubness_difference", abs(a - b), grade("hubness", abs(a - b)))]
    return pairs.sparkSession.createDataFrame(rows, "metric string, value double, label string")


def procrustes(pairs: DataFrame, source: DataFrame, target: DataFrame, mode: str = "orthogonal") -> np.ndarray:
    """W with x W close to y over the seed pairs' unit vectors: orthogonal (SVD of X'Y) or linear (least squares)."""
    if mode not in ("orthogonal", "linear"):
        raise ValueError(f"unknown Procrustes mode {mode!r}; expected 'orthogonal' or 'linear'")
    both = _paired(pairs, source, target)
    _, _, _, cross = outer_sums(both, "x", "y", normalise=True)
    if mode == "orthogonal":
        u, _, vt = np.linalg.svd(cross)
        return u @ vt
    _, _, _, gram = outer_sums(both, "x", "x", normalise=True)
    return np.linalg.pinv(gram) @ cross


def apply_mapping(source: DataFrame, w: np.ndarray) -> DataFrame:
    """All source vectors, made unit length, times W; the target space stays as it is."""
    return map_vectors(source, lambda m: unit_rows(m) @ w)


def mean_pair_cosine(pairs: DataFrame, mapped: DataFrame, target: DataFrame) -> DataFrame:
    both = _paired(pairs, mapped, target)
    return both.agg(F.avg(dot(unit(F.col("x")), unit(F.col("y")))).alias("mean_cosine"))


def held_out(test: DataFrame, mapped: DataFrame, target: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(metric, value): P@k by cosine and by CSLS, mean cosine to the gold word, and the number of pairs judged.

    Pairs with an unknown word are left out; no pair known gives no rows.
    """
    gold = _paired(test, mapped, target)
    queries = gold.select(F.col("pair_no").alias("idx"), F.col("x").alias("vec"))
    answers = test.join(target.select(F.col("word").alias("tgt"), F.col("idx").cast("long").alias("c")), "tgt").select(F.col("pair_no").alias("q"), "c")
    hits = gold.select(F.col("pair_no").cast("long").alias("q"), dot(unit(F.col("x")), unit(F.col("y"))).alias("gold"))
    sums = [F.count("*").cast("double").alias("n_test_pairs"), F.avg("gold").alias("mean_cosine_gold")]
    for name, found in (("cosine", knn_join(queries, target, max(ks))), ("csls", csls_join(queries, target, max(ks)))):
        right = found.join(answers, ["q", "c"]).select("q", F.col("rank").alias(f"{name}_rank"))
        hits = hits.join(right, "q", "left")
        sums += [F.avg(F.when(F.col(f"{name}_rank") <= k, 1.0).otherwise(0.0)).alias(f"{name}_P@{k}") for k in ks]
    wide = hits.agg(*sums)
    names = wide.columns
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in names]))
    return wide.filter("n_test_pairs > 0").select(stacked.alias("m")).select("m.*")


def retrieval_examples(test: DataFrame, mapped: DataFrame, target: DataFrame, n: int = 10, k: int = 5) -> DataFrame:
    """(src, gold, top_cos, top_csls) of the first n test pairs."""
    first = test.orderBy("pair_no").limit(n)
    gold = _paired(first, mapped, target)
    queries = gold.select(F.col("pair_no").alias("idx"), F.col("x").alias("vec"))
    names = target.select(F.col("idx").cast("long").alias("c"), "word")
    out = gold.select(F.col("pair_no").cast("long").alias("q"), "src", F.col("tgt").alias("gold"))
    for name, found in (("top_cos", knn_join(queries, target, k)), ("top_csls", csls_join(queries, target, k, csls_penalty(target)))):
        words = found.join(names, "c").groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("w"))
        out = out.join(words.select("q", F.col("w.word").alias(name)), "q")
    return out.drop("q")
