"""Vector queries take all rows of their tables."""

import numpy as np
import pytest

from glotweave.operators import selflearn
from glotweave.plans.queries import QUERIES

N = 450


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    m = np.random.default_rng(4).normal(size=(N, 6))
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(m)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, np.float32(m).astype(float)


def test_all_pairs_count(spark, table):
    path, m = table
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    at = np.triu_indices(N // 2, 1)
    want = np.corrcoef((1 - u[::2] @ u[::2].T)[at], (1 - u[1::2] @ u[1::2].T)[at])[0, 1]
    r = QUERIES["rsa"](spark, path).first()
    assert r["rsa_n_pairs"] == N // 2 and r["rsa_pearson"] == pytest.approx(want, abs=1e-6)
    from glotweave.operators import algebra
    from glotweave.plans.queries import _identity_pairs, side

    joined = algebra.rsa(_identity_pairs(spark, path), side(spark, path, 0), side(spark, path, 1), broadcast_bytes=0).first()
    assert joined["rsa_pearson"] == pytest.approx(want, abs=1e-9) and joined["rsa_spearman"] == pytest.approx(r["rsa_spearman"], abs=1e-6)
    got = {r["metric"]: r["value"] for r in QUERIES["isomorphism"](spark, path).collect()}
    assert got["rsa_n_pairs"] == N // 2 and got["rsa_pearson"] == pytest.approx(want, abs=1e-4)


def test_all_probes_and_items_count(spark, table):
    path, m = table
    assert QUERIES["coherence"](spark, path).count() == N + 1
    gaps = QUERIES["gap_scan_excluding"](spark, path)
    assert gaps.count() == N // 2 - len(range(0, N // 2, 7))
    items = 11 * 20 * 19 + 5 * 4
    assert QUERIES["analogy_items"](spark, path).distinct().count() == items
    found = QUERIES["analogy_eval"](spark, path).collect()
    assert len(found) == items
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for r in found[:: items // 50]:
        a, b, c = (int(r[x][1:]) for x in "abc")
        score = u @ (u[b] + u[c] - u[a])
        score[[a, b, c]] = -9
        assert r["predicted"] == f"w{score.argmax()}"
    total = QUERIES["analogy_accuracy"](spark, path).filter("category is null").first()
    assert total["n_items"] == total["n_evaluated"] == items


def test_vecmap_takes_all_pairs_and_rounds(spark, table, monkeypatch):
    seen = []

    def spy(source, target, pairs, mode, **options):
        seen.append((pairs.count(), mode, options))
        return source, target

    monkeypatch.setattr(selflearn, "self_learning", spy)
    QUERIES["vecmap"](spark, table[0]).collect()
    assert seen == [(N // 2, "semi", {})]


def test_split_and_purity(spark, table):
    import hashlib

    path, _ = table
    got = {r["pair_no"]: r["part"] for r in QUERIES["seed_split"](spark, path).collect()}
    order = sorted(range(N // 2), key=lambda k: hashlib.md5(f"42|{k}|w{2 * k}|w{2 * k + 1}".encode()).hexdigest())
    cut = int(N // 2 * 0.8)
    assert {k for k, part in got.items() if part == "train"} == set(order[:cut]) and len(got) == N // 2
    r = QUERIES["kmeans_purity"](spark, path).first()
    assert r["n"] == N and r["random_baseline"] == pytest.approx(1 / 3, abs=1e-6) and 1 / 3 <= r["purity"] < 0.6
