"""Self-learning by blocks on executors against the same in one place, and against plain matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glotweave.operators import selflearn
from glotweave.operators.knn import unit_rows


def space(spark, m, prefix):
    return spark.createDataFrame([(i, f"{prefix}{i}", [float(x) for x in row]) for i, row in enumerate(m)], "idx int, word string, vec array<double>")


def vectors(df):
    return np.array([r["vec"] for r in df.orderBy("idx").collect()])


@pytest.fixture(scope="module")
def two():
    rng = np.random.default_rng(5)
    m = rng.normal(size=(90, 6)) * rng.uniform(0.3, 2, 6)
    turn, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    return m, m[rng.permutation(90)][:75] @ turn + 0.05 * rng.normal(size=(75, 6))


def plain_round(x, z, wx, wz, keep, seed, number):
    """One round's dictionary and mean similarity from whole matrices."""
    a, b = unit_rows(x @ wx), unit_rows(z @ wz)
    sim = a @ b.T
    ra, rb = np.sort(sim, axis=1)[:, -10:].mean(axis=1), np.sort(sim, axis=0)[-10:].mean(axis=0)
    entries = []
    for side, s, r, cosine in (("x", sim, rb, sim.max(axis=1)), ("z", sim.T, ra, sim.max(axis=0))):
        score = 2 * s - r[None, :]
        kept = selflearn.kept_entries(np.arange(len(s)), np.arange(s.shape[1]), keep, (seed, number, int(side == "z")))
        score[~kept] = -np.inf
        for i in range(len(s)):
            j = int(score[i].argmax()) if kept[i].any() else -1
            entries.append(((i, j) if side == "x" else (j, i)) + (side, round(float(cosine[i]), 9)))
    return sorted(entries)


@pytest.mark.parametrize("keep, block_rows", [(1.0, 16), (0.1, 16), (0.02, 40)])
def test_one_round_by_blocks(spark, two, keep, block_rows):
    x, z = two
    rng = np.random.default_rng(1)
    wx, wz = rng.normal(size=(6, 6)), rng.normal(size=(6, 6))
    xs, zs = selflearn._packed(space(spark, x, "s"), 10**6, block_rows, "x"), selflearn._packed(space(spark, z, "t"), 10**6, block_rows, "z")
    got = selflearn.induced(xs, zs, wx, wz, keep, 7, 3).collect()
    want = plain_round(x, z, wx, wz, keep, 7, 3)
    assert sorted((r["x"], r["z"], r["side"], round(r["cosine"], 9)) for r in got if min(r["x"], r["z"]) >= 0) == [w for w in want if min(w[:2]) >= 0]
    assert len(got) == len(want) == 165


def test_blocks_do_not_pass_the_driver(spark, two, tmp_path, monkeypatch):
    """No join of a round broadcasts vectors: those of blocks are by shuffle or from the table of pairs, those of words by shuffle."""
    plans, table = {}, selflearn.Scratch.table

    def spy(self, df, label):
        plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString())
        return table(self, df, label)

    gram = selflearn._gram
    monkeypatch.setattr(selflearn.Scratch, "table", spy)
    monkeypatch.setattr(selflearn, "_gram", lambda both: plans.setdefault("products", both._jdf.queryExecution().executedPlan().toString()) and gram(both))
    pairs = spark.createDataFrame([(i, f"s{i}", f"t{i}") for i in range(30)], "pair_no int, src string, tgt string")
    selflearn.self_learning(space(spark, two[0], "s"), space(spark, two[1], "t"), pairs, "semi", max_rounds=1, block_rows=40)
    assert "BroadcastHashJoin" not in plans["selflearn-tiles"] and "SortMergeJoin" in plans["selflearn-tiles"]
    rows = [line for line in plans["selflearn-entries"].splitlines() if "BroadcastExchange" in line]
    assert len(rows) == 2 and plans["selflearn-entries"].count("selflearn-tiles") >= 2


def test_share_of_kept_entries():
    rows, columns = np.arange(400), np.arange(300)
    got = selflearn.kept_entries(rows, columns, 0.3, (0, 1, 0))
    assert abs(got.mean() - 0.3) < 0.01 and abs(got.mean(axis=0) - 0.3).max() < 0.12
    assert (got[100:200, 50:90] == selflearn.kept_entries(rows[100:200], columns[50:90], 0.3, (0, 1, 0))).all()
    assert 0.35 < (got == selflearn.kept_entries(rows, columns, 0.3, (0, 2, 0))).mean() < 0.65


@pytest.mark.parametrize("mode", ["semi", "unsupervised"])
def test_blocks_give_what_one_place_gives(spark, two, mode):
    x, z = two
    a, b = space(spark, x, "s"), space(spark, z, "t")
    pairs = spark.createDataFrame([(k, f"s{k}", f"t{k}") for k in range(12)], "pair_no int, src string, tgt string") if mode == "semi" else None
    one = selflearn.self_learning(a, b, pairs, mode, max_rounds=4)
    many = selflearn.self_learning(a, b, pairs, mode, max_rounds=4, block_rows=32)
    for p, q in zip(one, many):
        assert np.abs(vectors(p) - vectors(q)).max() < 1e-7
    assert one[0].columns == a.columns


def test_profiles_are_the_square_root():
    m = np.random.default_rng(2).normal(size=(30, 5))
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    want = unit_rows(np.sort((u * s) @ u.T, axis=1))
    assert np.abs(selflearn._profiles(m) - unit_rows(want - want.mean(axis=0))).max() < 1e-9


def test_nothing_is_gathered(spark, two, monkeypatch):
    """Vectors of words never reach the driver: only sums of d x d products and single rows do."""
    from pyspark.sql.classic.dataframe import DataFrame

    x, z = two
    collect, sizes = DataFrame.collect, []

    def watched(self):
        rows = collect(self)
        sizes.append(len(rows))
        return rows

    monkeypatch.setattr(DataFrame, "collect", watched)
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: pytest.fail("a table reaches the driver"))
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: pytest.fail("a table reaches the driver"))
    pairs = spark.createDataFrame([(k, f"s{k}", f"t{k}") for k in range(12)], "pair_no int, src string, tgt string")
    out = selflearn.self_learning(space(spark, x, "s"), space(spark, z, "t"), pairs, "semi", max_rounds=2, block_rows=32)
    assert max(sizes) <= 13 * 13 and out[0].agg(F.count("*").alias("n")).count() == 1


@pytest.mark.parametrize("keep", [1.0, 0.3, 0.02])
@pytest.mark.parametrize("bound", [None, 0.99, -0.5])
def test_search_does_not_depend_on_its_bounds(two, keep, bound):
    """Penalties and best candidates of two rounds, with bounds as guessed, too high or too low, against whole matrices."""
    x, z = two
    rng = np.random.default_rng(2)
    search = selflearn.Search(np.arange(90), np.arange(75))
    for number in (3, 4):
        wx, wz = rng.normal(size=(6, 6)), rng.normal(size=(6, 6))
        a, b = unit_rows(x @ wx), unit_rows(z @ wz)
        if bound is not None:
            search.near, search.good = np.full(90, bound, np.float32), np.full(90, bound, np.float32)
        mean, most = search.penalties(a, b, keep)
        want = np.sort(a @ b.T, axis=1)[:, -10:]
        assert np.abs(mean - want.mean(axis=1)).max() < 1e-12 and np.abs(most - want[:, -1]).max() < 1e-12
        penalty = np.sort(a @ b.T, axis=0)[-10:].mean(axis=0)
        got = search.best(penalty, keep, (7, number, 0))
        entries = plain_round(x, z, wx, wz, keep, 7, number)
        assert got.tolist() == [j for _, j, side, _ in entries if side == "x"]


def test_tied_candidates_go_to_the_smaller_index():
    b = np.repeat(unit_rows(np.random.default_rng(3).normal(size=(20, 4))), 3, axis=0)
    search = selflearn.Search(np.arange(20), np.arange(60))
    search.penalties(b[::3].copy(), b, 1.0)
    assert search.best(np.zeros(60), 1.0, (0, 0, 0)).tolist() == list(range(0, 60, 3))


def test_rounds_of_several_tasks_are_one_stage(spark, two, monkeypatch):
    """Tasks that share the words give what blocks give, and make no more jobs for more rounds."""
    monkeypatch.setattr(selflearn, "PART_ROWS", 24)
    a, b = space(spark, two[0], "s"), space(spark, two[1], "t")
    pairs = spark.createDataFrame([(k, f"s{k}", f"t{k}") for k in range(12)], "pair_no int, src string, tgt string")
    jobs = []
    for rounds in (1, 5):
        spark.sparkContext.setJobGroup(f"rounds-{rounds}", "")
        many = selflearn.self_learning(a, b, pairs, "semi", max_rounds=rounds)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds-{rounds}")))
    spark.sparkContext.setJobGroup("others", "")
    assert jobs[0] == jobs[1]
    blocks = selflearn.self_learning(a, b, pairs, "semi", max_rounds=5, block_rows=32)
    for p, q in zip(many, blocks):
        assert np.abs(vectors(p) - vectors(q)).max() < 1e-7
