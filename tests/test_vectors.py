import numpy as np
import pytest
from pyspark.sql import functions as F

from glotweave.operators import algebra, intrinsic, knn, lexicon
from glotweave.operators.selflearn import self_learning


def space(spark, m, prefix="w", start=0):
    return spark.createDataFrame([(start + i, f"{prefix}{i}", [float(x) for x in v]) for i, v in enumerate(m)], "idx int, word string, vec array<double>")


@pytest.fixture(scope="module")
def m():
    return np.random.default_rng(0).normal(size=(120, 8))


def collect(df):
    return sorted((r["q"], r["rank"], r["c"], round(r["score"], 9)) for r in df.collect())


def test_physical_forms_agree(spark, m):
    s = space(spark, m)
    plain = collect(knn.knn_join_sql(s, s, 5, exclude_self=True))
    assert collect(knn.knn_join(s, s, 5, exclude_self=True)) == plain
    old, knn.BLOCK_ROWS = knn.BLOCK_ROWS, 32
    try:
        assert collect(knn.knn_join(s, s, 5, exclude_self=True, broadcast_bytes=0)) == plain
    finally:
        knn.BLOCK_ROWS = old


def test_ties_go_to_the_smaller_index(spark):
    s = space(spark, np.array([[1, 0], [0, 1], [0, 1], [0, 1]]))
    got = collect(knn.knn_join(s.filter("idx = 0"), s, 2, exclude_self=True))
    assert [g[2] for g in got] == [1, 2]


@pytest.mark.parametrize("same", [0, 90])
def test_pruned_search_by_groups_of_cells(spark, same, monkeypatch):
    """Many groups of cells, and a cell of equal vectors that fills several."""
    m = np.random.default_rng(6).normal(size=(240, 5))
    m[:same] = m[0]
    s = space(spark, m)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 4)
    monkeypatch.setattr(knn, "GROUP_BLOCKS", 5)
    got = collect(knn.knn_join(s, s, 5, exclude_self=True, broadcast_bytes=0))
    assert got == collect(knn.knn_join_sql(s, s, 5, exclude_self=True))


def test_memory_of_a_search_does_not_grow_with_the_index(m):
    """Peak of what one batch of queries holds, for an index four times as large; equal vectors, which all reach the floor, included."""
    import tracemalloc

    def peak(index):
        tracemalloc.start()
        got = list(knn._score(np.arange(500), q, np.arange(len(index)), index, 10, True))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got[0].num_rows == 5000
        return most

    q = knn.unit_rows(np.random.default_rng(1).normal(size=(500, 8)))
    small = knn.unit_rows(np.random.default_rng(2).normal(size=(20_000, 8)))
    assert peak(np.tile(small, (4, 1))) < 1.5 * peak(small)


def test_scores_do_not_depend_on_what_is_beside(spark, m):
    """Copies at any place of an index score alike, so that the smaller index comes first."""
    one = knn.unit_rows(np.random.default_rng(3).normal(size=(1, 64)))
    index = knn.unit_rows(np.random.default_rng(4).normal(size=(9000, 64)))
    at = [1, 7, 4095, 4096, 5003, 8999]
    index[at] = index[7]
    got = next(knn._score(np.array([-1]), index[7:8] + 0.1 * one, np.arange(9000), index, 6, False))
    assert got.column("c").to_pylist() == at and len(set(got.column("score").to_pylist())) == 1


def test_csls_penalty_counts_self_as_zero(spark):
    s = space(spark, np.array([[1.0, 0], [0.6, 0.8], [-1, 0]]))
    got = {r["idx"]: r["r_t"] for r in knn.csls_penalty(s, 2).collect()}
    assert got[0] == pytest.approx((0.6 + 0.0) / 2) and got[2] == pytest.approx((0.0 - 0.6) / 2)


def test_preprocessing(spark, m):
    s = space(spark, m * 3 + 1)
    mean, _ = algebra.covariance(algebra.preprocess(s, "center"))
    assert np.abs(mean).max() < 1e-9
    _, cov = algebra.covariance(algebra.preprocess(s, "center_whiten"))
    assert np.abs(cov - np.eye(8)).max() < 1e-3
    out = algebra.preprocess(s, "center_whiten_renorm").toPandas()["vec"]
    assert np.allclose([np.linalg.norm(v) for v in out], 1, atol=1e-6)
    with pytest.raises(ValueError):
        algebra.preprocess(s, "all")


def test_preprocessing_is_one_python_step(spark, m):
    """A task needs as many Python workers as there are Python steps in a row: one, however many steps the method has."""
    s = space(spark, m)
    for method in ("center", "center_whiten", "center_whiten_renorm"):
        assert algebra.preprocess(s, method)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_distances_come_in_tiles():
    """However many rows are on the other side, 256 x 4,096 distances at most are in memory at once, and all come."""
    ids, rng = np.arange(9000), np.random.default_rng(0)
    x, y = rng.normal(size=(9000, 2)), rng.normal(size=(9000, 3))
    got = list(algebra._upper(ids[:300], x[:300], y[:300], ids, x, y))
    assert max(len(d) for d, _ in got) <= 256 * 4096 and sum(len(d) for d, _ in got) == sum(8999 - i for i in range(300))


def _pairs(spark, n):
    return spark.createDataFrame([(i, f"a{i}", f"b{i}") for i in range(n)], "pair_no int, src string, tgt string")


@pytest.mark.parametrize("mode", ["orthogonal", "linear"])
def test_planted_rotation_is_recovered(spark, m, mode):
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(8, 8)))
    a, b = space(spark, m, "a"), space(spark, m @ q, "b")
    w = algebra.procrustes(_pairs(spark, 100), a, b, mode)
    assert np.abs(w - q).max() < 1e-6
    if mode == "orthogonal":
        assert np.abs(w.T @ w - np.eye(8)).max() < 1e-9
    mapped = algebra.apply_mapping(a, w)
    got = {r["metric"]: r["value"] for r in algebra.held_out(_pairs(spark, 120).filter("pair_no >= 100"), mapped, b).collect()}
    assert got["cosine_P@1"] == 1.0 and got["csls_P@1"] == 1.0 and got["n_test_pairs"] == 20
    examples = algebra.retrieval_examples(_pairs(spark, 120).filter("pair_no >= 100"), mapped, b, 3).collect()
    assert len(examples) == 3 and all(r["top_cos"][0] == r["gold"] for r in examples)


def test_isomorphism_of_rotated_spaces(spark, m):
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(8, 8)))
    got = {r["metric"]: r for r in algebra.isomorphism(_pairs(spark, 40), space(spark, m, "a"), space(spark, m @ q, "b")).collect()}
    assert got["rsa_pearson"]["value"] == 1.0 and got["rsa_pearson"]["label"] == "HIGH"
    assert got["eigval_distance"]["value"] == 0.0 and got["hubness_difference"]["value"] == 0.0


@pytest.mark.parametrize("mode", ["supervised", "semi"])
def test_self_learning_recovers_a_rotation(spark, m, mode):
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(8, 8)))
    noise = np.random.default_rng(2).normal(size=m.shape) * 0.01
    a, b = space(spark, m, "a"), space(spark, m @ q + noise, "b")
    x, y = self_learning(a, b, _pairs(spark, 30), mode, max_rounds=60)
    got = {r["metric"]: r["value"] for r in algebra.held_out(_pairs(spark, 120).filter("pair_no >= 30"), x, y).collect()}
    assert got["cosine_P@1"] > 0.95


@pytest.mark.parametrize("mode", ["supervised", "semi"])
def test_rare_seed_pairs_are_used(spark, m, mode):
    """Seeds that all lie beyond the words among which dictionaries are induced."""
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(8, 8)))
    a, b = space(spark, m, "a"), space(spark, m @ q, "b")
    x, y = self_learning(a, b, _pairs(spark, 120).filter("pair_no >= 80"), mode, cutoff=60)
    got = {r["metric"]: r["value"] for r in algebra.held_out(_pairs(spark, 80), x, y).collect()}
    assert got["cosine_P@1"] > 0.95


def test_purity_of_separated_blobs(spark):
    rng = np.random.default_rng(0)
    m = np.concatenate([rng.normal(size=(6, 3)) * 0.01 + 10 * np.eye(3)[k] for k in range(3)])
    labels = spark.createDataFrame([(f"l{i // 6}", f"w{i}") for i in range(18)] + [("l0", "unknown")], "label string, word string")
    r = intrinsic.purity(intrinsic.categorise(labels, space(spark, m), restarts=3)).first()
    assert r["purity"] == 1.0 and r["n"] == 18 and r["random_baseline"] == pytest.approx(1 / 3)
    assert intrinsic.categorise(labels.limit(1), space(spark, m[:1])) is None


@pytest.mark.parametrize("n", [20, 7, 2])
def test_analogy_counts(spark, n):
    pairs = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(n)] + [("x", ""), ("—", "y")], "a string, b string")
    assert intrinsic.pair_analogies(pairs, "c").count() == n * (n - 1)


def test_analogies_of_parallel_pairs(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(10, 20))
    s = space(spark, np.concatenate([base, base + 0.5 * np.eye(20)[0]]))
    pairs = spark.createDataFrame([(f"w{i}", f"w{i + 10}") for i in range(10)] + [("w0x", "w1x")], "a string, b string")
    rows = {r["category"]: r for r in intrinsic.analogy_accuracy(intrinsic.pair_analogies(pairs, "c"), s).collect()}
    assert rows[None]["n_items"] == 110 and rows[None]["n_skipped"] == 20 and rows["c"]["accuracy"] > 0.8


def test_outlier_and_unknown_words(spark):
    s = space(spark, np.array([[1, 0], [1, 0.1], [0.9, 0], [0, 1]]))
    sets = spark.createDataFrame([(0, ["w0", "w1", "w2", "w3"], "w3"), (1, ["w0", "nope"], "w0")], "set_id int, words array<string>, gold string")
    assert [tuple(r) for r in intrinsic.outliers(sets, s).collect()] == [(0, "w3", "w3", True)]


def test_p_values():
    assert intrinsic.two_sided_p(0.5, 20) == pytest.approx(0.02477, abs=1e-4)
    assert intrinsic.two_sided_p(0.1, 50) == pytest.approx(0.4896, abs=1e-3)
    assert intrinsic.two_sided_p(1.0, 5) == 0.0 and intrinsic.two_sided_p(None, 5) is None


def test_gaps(spark):
    en = spark.createDataFrame([(0, "bank", [1.0, 0.0]), (1, "seed", [0.0, 1.0]), (2, "coral", [-1.0, 0.0]), (3, "late", [1.0, 0.0])], "idx int, word string, vec array<double>")
    dv = space(spark, np.array([[1.0, 0.0], [0.0, 1.0]]), "d")
    seeds = spark.createDataFrame([("seed",)], "value string")
    got = {r["english_word"]: (r["nearest_dhivehi"], r["is_gap"], r["domain"]) for r in lexicon.find_gaps(en, dv, seeds, 0.5, 3).collect()}
    assert got == {"bank": ("d0", False, "finance"), "coral": ("d1", True, "environment")}


def test_loans(spark):
    rows = [
        ("dv", 0, "ފިލްމު", [1.0, 0.0, 0.0]), ("dv", 1, "ބަސް", [0.0, 1.0, 0.0]), ("dv", 2, "މާލެ", [0.0, 0.0, 1.0]),
        ("en", 3, "film", [0.95, 0.05, 0.0]), ("en", 4, "xyzq", [0.05, 0.95, 0.0]), ("en", 5, "male", [0.0, 0.0, 1.0]),
    ]
    s = spark.createDataFrame(rows, "lang string, idx int, word string, vec array<double>")
    entities = spark.createDataFrame([("MAALE",)], "value string")
    got = {r["word"]: (r["category"], r["best_english_match"]) for r in lexicon.classify_loans(s, entities, top_k=1).collect()}
    assert got["ފިލްމު"] == ("loanword", "film") and got["ބަސް"][0] == "native_dhivehi" and got["މާލެ"] == ("named_entity", "")
    hist = {r["category"]: r["percent"] for r in lexicon.category_histogram(lexicon.classify_loans(s, entities)).collect()}
    assert sum(hist.values()) == pytest.approx(100)


def test_average_ranks(spark):
    from glotweave.operators.algebra import average_ranks

    rng = np.random.default_rng(6)
    v = [float(x) for x in rng.choice([-3.0, 0.0, 0.5, 1e9, 2.25, 2.5], 200)] + [None]
    df = spark.createDataFrame([(i, x, 7.0) for i, x in enumerate(v)], "i int, x double, same double")
    for cells in (1, 3, 4096):
        got = {r["i"]: r for r in average_ranks(df, cells, x="rx", same="rs").collect()}
        for i, x in enumerate(v):
            want = None if x is None else sum(y < x for y in v[:-1]) + (sum(y == x for y in v[:-1]) + 1) / 2
            assert got[i]["rx"] == want and got[i]["rs"] == 101.0


def test_unsupervised_mapping_finds_a_rotation(spark):
    """Two rotated copies of one space, in another order, meet without a dictionary."""
    from glotweave.operators.selflearn import self_learning

    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 6))
    m = centres[rng.integers(0, 12, 150)] + 0.4 * rng.normal(size=(150, 6)) * rng.uniform(0.2, 2, 6)
    turn, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    order = rng.permutation(150)
    x = spark.createDataFrame([(i, f"s{i}", [float(y) for y in m[i]]) for i in range(150)], "idx int, word string, vec array<double>")
    z = spark.createDataFrame([(k, f"t{i}", [float(y) for y in (m @ turn)[i]]) for k, i in enumerate(order)], "idx int, word string, vec array<double>")
    a, b = self_learning(x, z, None, "unsupervised", seed=1)
    va = {r["word"]: np.array(r["vec"]) for r in a.collect()}
    vb = {r["word"]: np.array(r["vec"]) for r in b.collect()}
    cos = [va[f"s{i}"] @ vb[f"t{i}"] / np.linalg.norm(va[f"s{i}"]) / np.linalg.norm(vb[f"t{i}"]) for i in range(150)]
    assert np.mean(cos) > 0.95


def test_neighbours_in_small_blocks(spark, monkeypatch):
    from glotweave.operators import knn

    monkeypatch.setattr(knn, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(2)
    s = spark.createDataFrame([(i, f"w{i}", [float(y) for y in rng.integers(-2, 3, 5)]) for i in range(120)], "idx int, word string, vec array<double>")
    tell = lambda df: sorted((r["q"], r["rank"], r["c"]) for r in df.collect())
    assert tell(knn.knn_join(s, s, 4, exclude_self=True, broadcast_bytes=0)) == tell(knn.knn_join(s, s, 4, exclude_self=True))


@pytest.mark.parametrize("penalised", [False, True])
def test_pruned_neighbours_are_exact(spark, penalised):
    """Blobs, opposite, equal and zero vectors, vectors near nothing: the same rows as by every pair, from a part of the pairs."""
    from glotweave.operators import knn

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 4
    m = np.concatenate([centres[rng.integers(0, 12, 900)] + 0.15 * rng.normal(size=(900, 16)), np.zeros((3, 16)), 1e-10 * rng.normal(size=(4, 16)), np.repeat(centres[:2], 8, axis=0), -centres])
    s = spark.createDataFrame([(i, [float(y) for y in v], float(rng.uniform(0, 0.5)) if penalised else 0.0) for i, v in enumerate(m)], "idx long, vec array<double>, penalty double").repartition(5)
    report: dict = {}
    got = knn.knn_join_pruned(s.select("idx", "vec"), s, 6, True, penalised, 24, report)
    want = knn.knn_join(s, s, 6, True, F.col("penalty") if penalised else None)
    tell = lambda rows: sorted((r["q"], r["rank"], round(r["score"], 9)) for r in rows)  # noqa: E731  equal vectors may differ in the last bit, so their order does
    found = got.collect()
    assert tell(found) == tell(want.collect()) and len({(r["q"], r["c"]) for r in found}) == len(found) and all(r["q"] != r["c"] for r in found)
    assert report["pairs"] == len(m) ** 2 and report["compared"] < (0.6 if penalised else 0.35) * report["pairs"]


def test_bounds_of_cells_hold():
    from glotweave.operators import knn

    rng = np.random.default_rng(5)
    m, q, p = (knn._sharp_units(rng.normal(size=(n, 3))) for n in (400, 200, 1))
    near = knn._angles(m, p)[:, 0]
    inside = (near > 0.5) & (near < 0.8)
    bound = knn.most_similar(knn._angles(q, p)[:, 0], near[inside].min(), near[inside].max())
    true = (q @ m[inside].T).max(axis=1)
    assert (bound >= true).all() and np.mean(bound < 0.5) > 0.2


def test_few_candidates_and_many_cells(spark):
    from glotweave.operators import knn

    s = spark.createDataFrame([(i, [float(i % 3), 1.0], 0.0) for i in range(7)], "idx long, vec array<double>, penalty double")
    got = knn.knn_join_pruned(s.select("idx", "vec"), s, 10, True, pivots=5)
    assert sorted((r["q"], r["rank"], r["c"]) for r in got.collect()) == sorted((r["q"], r["rank"], r["c"]) for r in knn.knn_join(s, s, 10, True).collect())


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 30])
def test_rank_correlation_over_all_pairs(spark, broadcast_bytes):
    """Against ranks of the sorted distances, with ties by the dozen; in one piece and by blocks."""
    rng = np.random.default_rng(7)
    a, b = rng.integers(-2, 3, (90, 4)) + 0.5, rng.normal(size=(90, 3))
    b[:40] = a[:40, :3] + 0.1 * b[:40]
    pairs = spark.createDataFrame([(i, f"a{i}", f"b{i}") for i in range(90)], "pair_no int, src string, tgt string")
    got = algebra.rsa(pairs, space(spark, a, "a"), space(spark, b, "b"), broadcast_bytes, block_rows=32).first()
    i, j = np.triu_indices(90, 1)
    u, v = knn.unit_rows(a), knn.unit_rows(b)
    d = [1 - (m[i] * m[j]).sum(axis=1) for m in (u, v)]

    def ranks(x):
        x = np.round(x, 7)
        s = np.sort(x)
        return (np.searchsorted(s, x, "left") + np.searchsorted(s, x, "right") + 1) / 2

    assert got["rsa_n_pairs"] == 90 and got["rsa_pearson"] == pytest.approx(np.corrcoef(*d)[0, 1], abs=1e-9)
    assert got["rsa_spearman"] == pytest.approx(np.corrcoef(*map(ranks, d))[0, 1], abs=1e-6)


def test_rank_correlation_of_nothing(spark):
    pairs = spark.createDataFrame([(0, "a0", "b0")], "pair_no int, src string, tgt string")
    for p in (pairs, pairs.limit(0)):
        got = algebra.rsa(p, space(spark, np.ones((2, 2)), "a"), space(spark, np.ones((2, 2)), "b")).first()
        assert got["rsa_pearson"] is None and got["rsa_spearman"] is None and got["rsa_n_pairs"] == p.count()


def test_kmeans_of_all_restarts_at_once(spark, monkeypatch):
    """Every fit against plain Lloyd steps from the same first centres; the cheapest is returned."""
    rng = np.random.default_rng(11)
    m = np.concatenate([rng.normal(size=(60, 4)) + 6 * rng.normal(size=4) for _ in range(5)] + [np.zeros((6, 4))])
    points = spark.createDataFrame([([float(x) for x in v],) for v in m], "vec array<double>").repartition(3)
    first = []
    draw = intrinsic._first_centres
    monkeypatch.setattr(intrinsic, "_first_centres", lambda *a: first.append(draw(*a)) or first[-1])
    centres, cost = intrinsic.kmeans(points, 5, seed=1, restarts=4)
    costs = []
    for c in first:
        for _ in range(50):
            at = ((m[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.stack([m[at == k].mean(axis=0) if (at == k).any() else c[k] for k in range(5)])
            moved, c = np.sqrt(((new - c) ** 2).sum(axis=1)).max(), new
            if moved <= 1e-4:
                break
        costs.append(((m[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum())
    assert cost == pytest.approx(min(costs)) and len(first) == 4
    assert ((m[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum() == pytest.approx(cost)
