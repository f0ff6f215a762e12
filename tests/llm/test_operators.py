"""Each operator against a plain Python version, with the cases its docstring defines."""

import collections
import json
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glotweave.llm import (
    chat_format, decontaminate, language_id, license_scan, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, substring_dedup,
)
from glotweave.llm.components import connected_components
from glotweave.llm.oracle import OP5, OP7
from glotweave.llm.probminhash import signatures
from glotweave.llm.wordhash import Words

WORD = re.compile("[^\x20\x09-\x0d]+")
SPACES = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def sentence(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Documents with copies, near copies, common lines, edge cases; ids are unique."""
    rng = random.Random(5)
    texts = ["\n".join(sentence(rng, rng.randrange(3, 30)) for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    common = "This common line stands in many documents."
    texts += [t + "\n" + common for t in texts[:10]] + [common.upper() + " \t\n" + sentence(rng, 40)]
    base = sentence(rng, 200, 10**6)
    texts += [base, base, base] + [" ".join(w if rng.random() > 0.01 else f"x{rng.randrange(10**6)}" for w in base.split()) for _ in range(25)]
    texts += [None, "", " \n\t ", "a", "one two three", "one  two three", "é " * 30, "\n\n", "w " * 40, sentence(rng, 30_000), "x" * 200_000, "Ünïcödé wörds \x0b here"]
    return [(i * 3 + 1, t, "en", ["a", "b", None][i % 3], 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def more(spark, docs):
    """The same with a null id, a repeated row, and columns whose names could clash."""
    odd = spark.createDataFrame([(None, "null id text here", "en", "a", 0), (None, None, None, None, None), (1, docs.filter("doc_id = 1").first()["text"], "en", "a", 0)], DOCS)
    out = docs.unionByName(odd)
    for c in ("key", "n", "size", "seed", "words", "hash", "id", "unit"):
        out = out.withColumn(c, F.lit("clash"))
    return out


def empty(spark):
    return spark.createDataFrame([], DOCS)


# words and hashes


def test_words_match_the_pattern(rows):
    texts = [r[1] for r in rows]
    found = Words(pa.array(texts, pa.string()).slice(3))
    assert found.counts().tolist() == [len(words(t)) for t in texts[3:]]
    assert all(found.text_of(i).decode() == " ".join(words(t)) for i, t in enumerate(texts[3:]))
    flat = [w for t in texts[3:] for w in words(t)]
    assert len(set(zip(flat, found.hash.tolist()))) == len(set(flat)) == len(set(found.hash.tolist()))
    assert len(Words(pa.array([], pa.string())).hash) == 0


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**62, 200).astype(np.uint64)
    a, b = rng.integers(1, 5, 200).astype(float), rng.integers(0, 5, 200).astype(float)
    ib = np.flatnonzero(b)
    s = signatures(np.concatenate([e, e[ib]]), np.concatenate([a, b[ib]]), np.repeat([0, 1], [200, len(ib)]), 3, 2048)
    truth = sum(1 / np.maximum(a / a[d], b / b[d]).sum() for d in ib)
    assert abs((s[0] == s[1]).mean() - truth) < 4 * (truth * (1 - truth) / 2048) ** 0.5
    assert not s[2].any() and s[0].all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(1, 50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        parent[max(find(u), find(v))] = min(find(u), find(v))
    for local in (0, 10**6):
        got = dict(connected_components(spark.createDataFrame(edges, "u long, v long"), local_edges=local).collect())
        assert got == {x: find(x) for u, v in edges if u != v for x in (u, v)}
        assert connected_components(spark.createDataFrame([], "u long, v long"), local_edges=local).count() == 0


# 1 quality classifier


def test_classifier_orders_grades(spark):
    rng = random.Random(0)
    bad, poor = ["awful", "nasty"], ["###", "$$$"]
    rows = []
    for i in range(600):
        g = i % 3
        ws = sentence(rng, 40).split()
        extra = [rng.choice(bad) for _ in range(4)] if g == 0 else [rng.choice(poor) for _ in range(15)] if g == 1 else []
        ws += extra
        rng.shuffle(ws)
        rows.append((i, " ".join(ws), g))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    train = df.filter("doc_id < 450").select("doc_id", "grade").union(spark.createDataFrame([(9999, 1), (None, 2), (3, None)], "doc_id long, grade int"))
    model = quality_classifier.fit(df, train, 3)
    assert model.thresholds[0] < model.thresholds[1]
    got = quality_classifier.score(df.filter("doc_id >= 450"), model, 2).join(df, "doc_id").collect()
    assert np.mean([r["kept"] == (r["grade"] == 2) for r in got]) > 0.95
    means = [np.mean([r["expected_grade"] for r in got if r["grade"] == g]) for g in range(3)]
    assert means[0] < means[1] < means[2]
    assert all(0 <= r["tail_prob"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got)


def test_classifier_edges(spark, docs):
    none = quality_classifier.fit(docs, spark.createDataFrame([], "doc_id long, grade int"), 3)
    got = quality_classifier.score(more(spark, docs), none, 1)
    assert got.count() == docs.count() + 3 and got.agg(F.max("tail_prob")).first()[0] == 0.5
    assert quality_classifier.score(empty(spark), none, 1).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, quality_classifier.grades_of_labels(labels).collect())) == [(1, 2), (2, 1), (3, 0)]


def test_classifier_samples_whole_texts_once(spark):
    """Repeated rows and ratings, a text of more than 4,096 different words, and the bounds of the sample."""
    rng = random.Random(7)
    texts = {i: ("good " if i % 2 else "bad ") * 5 + sentence(rng, 30) for i in range(60)} | {60: sentence(rng, 9000, 10**7) + " good", 61: None}
    plain = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    ratings = spark.createDataFrame([(i, 1 if i % 2 or i == 60 else 0) for i in texts], "doc_id long, grade int")
    once = quality_classifier.fit(plain, ratings, 2)
    again = quality_classifier.fit(plain.unionByName(plain).repartition(5), ratings.union(ratings), 2)
    assert np.array_equal(once.weights, again.weights) and np.array_equal(once.thresholds, again.thresholds)
    owner, number, _ = quality_classifier.features(pa.array([texts[60]]))
    assert len(number) > 8000 and (once.weights[number[number < 1 << quality_classifier.BITS]] != 0).mean() > 0.95
    few = quality_classifier.fit(plain, ratings, 2, sample_rows=10, sample_chars=500)
    assert 0 < (few.weights != 0).sum() < 200


def test_fit_is_where_the_likelihood_is_largest():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 50, 8)).astype(np.int32) for _ in range(40)]
    grade = rng.integers(0, 3, 40)
    model = quality_classifier._fit_arrays(rows, grade, 3, steps=4000, rate=0.02)
    share = np.bincount(grade) / 40
    weight = (1 / np.sqrt(share))[grade] / (1 / np.sqrt(share))[grade].sum()

    def loss(w, cuts):
        total = 1.5e-4 * (w**2).sum()
        for r, g, k in zip(rows, grade, weight):
            s = w[r].sum() / len(r) ** 0.5
            tail = [1.0, *(1 / (1 + np.exp(-(s - c))) for c in cuts), 0.0]
            total -= k * np.log(tail[g] - tail[g + 1])
        return total

    w, cuts = model.weights[:50].astype(float), model.thresholds
    best = loss(w, cuts)
    for _ in range(60):
        assert loss(w + rng.normal(0, 0.05, 50), cuts + rng.normal(0, 0.05, 2)) > best - 1e-4
    assert cuts[0] < cuts[1]


# 2 license scans


def test_license_scan(spark, docs):
    mit, gpl2, gpl3 = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU General Public License, version 3."
    texts = {1: f"intro\n{mit}\nmore", 2: gpl2, 3: f"{gpl3}\nx\ny\nz\n{mit}", 4: "no such line", 5: "please see the license", 6: "Licensed under CC BY-NC-SA 4.0.", 7: None, 8: "", 9: "released UNDER the mit license"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("license", F.lit("clash"))
    got = sorted((r["doc_id"], r["first_line"], r["license"], r["confirmed"]) for r in license_scan.scan_licenses(df).collect())
    assert got == [(1, 1, "MIT", True), (2, 0, "GPL-2.0", True), (3, 0, "GPL-3.0", True), (3, 4, "MIT", True), (5, 0, None, False), (6, 0, "CC-BY-NC-SA-4.0", True), (9, 0, "MIT", True)]
    assert license_scan.scan_licenses(empty(spark)).count() == 0


def test_every_template_finds_itself():
    scanner = license_scan.Scanner()
    for name, text in license_scan.TEMPLATES + license_scan.SPDX:
        assert [r[2] for r in scanner.report(text)] == [name], text
    assert license_scan.alignment("a b c".split(), "a x c".split()) == (["x"], ["b"])
    text = "".join(str(i % 10) for i in range(5000))
    parts = list(license_scan.windows(text, 100, 700))
    assert all(any(text[i : i + 100] in p for p in parts) for i in range(0, 4900, 7)) and max(map(len, parts)) <= 700


def wrapped(text, width, mark=""):
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            lines.append(line)
            line = ""
        line = f"{line} {w}" if line else w
    return "\n".join(f"{mark}{x}" for x in [*lines, line])


def test_wrapped_notices_and_near_misses(spark):
    """Full texts, wrapped as comments under a copyright line, are one block; texts that differ in a name or clause are not named."""
    scanner = license_scan.Scanner()
    full = [t for t in license_scan.TEMPLATES if len(t[1]) > 150]
    assert {t[0] for t in full} >= {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "ISC", "Zlib"}
    for name, text in full:
        for mark in ("", " * ", "# "):
            body = wrapped(text, 70, mark)
            rows = list(scanner.report(f"{mark}Copyright (c) 2019 A. Author\n{mark}\n{body}\n\ndef f(x):\n    return x"))
            assert [r[2] for r in rows] == [name] and rows[0][0] == 0 and rows[0][1] >= body.count("\n") + 1, (name, mark)
    by = dict(license_scan.TEMPLATES)  # the last wording of each
    misses = [
        by["GPL-3.0"].replace("version 3", "version 4"), by["GPL-2.0"].replace("General", "Affero General"), by["BSD-2-Clause"][: len(by["BSD-2-Clause"]) // 2],
        by["MIT"][:200], "SPDX-License-Identifier: MIT-0", "SPDX-License-Identifier: LicenseRef-x", "Licensed under CC BY 3.0.", "Released under the X License.",
    ]
    for text in misses:
        assert [r[2] for r in scanner.report(text)] == [None], text
    for text, name in (("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), ("/* SPDX-License-Identifier: BSD-3-Clause */", "BSD-3-Clause")):
        assert [r[2] for r in scanner.report(text)] == [name]
    edited = wrapped(by["MIT"].replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHOR"), 60)
    (row,) = scanner.report(edited)
    assert row[2] == "MIT" and row[4] == 4


def test_license_rows_by_brute_force(spark):
    """Lines of prose with one notice in some: named where it stands; null ids, repeated rows and a very long text pass."""
    rng = random.Random(12)
    short = [t for t in license_scan.TEMPLATES if len(t[1]) < 100]
    rows, want = [], []
    for i in range(40):
        lines = [sentence(rng, 12) for _ in range(6)]
        if i % 2:
            at, (name, notice) = rng.randrange(6), rng.choice(short)
            lines[at] = notice
            want.append((i if i != 7 else None, at, at, name))
        rows.append((i if i != 7 else None, "\n".join(lines)))
    rows += [rows[1], (99, sentence(rng, 40_000) + "\n" + short[0][1] + "\n" + sentence(rng, 40_000))]
    want += [want[0], (99, 1, 1, short[0][0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["first_line"], r["last_line"], r["license"]) for r in license_scan.scan_licenses(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_notices_inside_long_lines():
    rng = random.Random(3)
    scanner = license_scan.Scanner()

    def rows(text):
        return [(r[0], r[1], r[2]) for r in scanner.report(text)]

    for name, notice in license_scan.TEMPLATES:
        for n in (10, 40, 300, 1500):
            assert rows(f"{sentence(rng, n)} {notice} {sentence(rng, n)}") == [(0, 0, name)]
        across = rows(sentence(rng, 4000)[: license_scan.MAX_BLOCK_CHARS - 10] + " " + notice + " " + sentence(rng, 1000))
        assert across == [(0, 0, name)]
        text = sentence(rng, 20) + "\n" + notice.replace(" ", "\n") + "\n" + sentence(rng, 20)
        assert [r[2] for r in rows(text)].count(name) >= 1
    mit, isc = "Released under the MIT License.", "Released under the ISC License."
    assert rows(f"{mit} {isc}") == [(0, 0, "MIT"), (0, 0, "ISC")]
    assert rows(f"{sentence(rng, 50)} {mit}\n{isc} {sentence(rng, 50)}") == [(0, 1, "MIT"), (0, 1, "ISC")]
    assert rows(f"{sentence(rng, 50)} Licensed under CC BY-NC-ND 4.0. {sentence(rng, 50)}") == [(0, 0, None)]
    assert rows("This Source Code Form is subject to the terms of\nthe Mozilla Public License, version 2.0.") == [(0, 1, "MPL-2.0")]
    assert rows("Dedicated to the public\ndomain under CC0 1.0 Universal.") == [(0, 1, "CC0-1.0")]


# 3 line dedup


def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def test_line_dedup(spark, docs, rows):
    holders = collections.defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders[line_key(line)].add(i)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(docs).collect()}
    dropped = 0
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(line_key(x)) >= 20 and len(holders[line_key(x)]) >= 3 and max(holders[line_key(x)]) != i)]
        dropped += len(lines) - len(kept)
        assert got[i] == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert dropped > 10
    odd = line_dedup.dedup_lines(more(spark, docs))
    assert odd.count() == docs.count() + 3 and odd.filter("doc_id is null and n_dropped > 0").count() == 0
    assert [r["text"] for r in odd.filter("doc_id = 1").collect()] == [got[1][2]] * 2
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


# 4 substring dedup


def test_substring_dedup(spark, docs, rows):
    low, ws = {}, {i: words(t) for i, t, *_ in rows}
    for i in sorted(ws):
        for j in range(len(ws[i]) - 12):
            low.setdefault(tuple(ws[i][j : j + 13]), i)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.dedup_substrings(docs, shard_bytes=5000).collect()}
    removed = 0
    for i, w in ws.items():
        gone = set()
        for j in range(len(w) - 12):
            if low[tuple(w[j : j + 13])] < i:
                gone.update(range(j, j + 13))
        removed += len(gone)
        assert got[i] == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)), i
    assert removed > 1000
    odd = substring_dedup.dedup_substrings(more(spark, docs))
    assert odd.count() == docs.count() + 3 and odd.filter("doc_id is null and n_removed > 0").count() == 0
    assert substring_dedup.dedup_substrings(empty(spark)).count() == 0


@pytest.mark.parametrize("letters", [0x110000 - 0x800, 0])
@pytest.mark.parametrize("window", [5, 13])
def test_automata_find_every_window_of_smaller_holders(monkeypatch, letters, window):
    monkeypatch.setattr(substring_dedup.Phrases, "_LETTERS", letters)
    monkeypatch.setattr(substring_dedup, "_HITS", 7)
    rng = np.random.default_rng(window)
    for trial in range(30):
        vocab = [2, 4, 100][trial % 3]
        passages = [rng.integers(0, vocab, rng.integers(window, 40)) for _ in range(6)]
        holder = rng.integers(0, 10, 6)
        doc = np.concatenate([x for p in passages for x in (rng.integers(0, vocab, 5), p[rng.integers(0, 4) : len(p) - rng.integers(0, 4)])])
        phrases = substring_dedup.Phrases(np.concatenate(passages), np.concatenate([[0], np.cumsum([len(p) for p in passages])]), holder, window, vocab)
        known = {tuple(p[i : i + window]) for p, h in zip(passages, holder) if h < 5 for i in range(len(p) - window + 1)}
        want = np.zeros(len(doc), dtype=bool)
        for i in range(len(doc) - window + 1):
            if tuple(doc[i : i + window]) in known:
                want[i : i + window] = True
        assert (np.cumsum(phrases.mark(doc, 5)[:-1]) > 0).tolist() == want.tolist()
    assert not substring_dedup.Phrases(np.empty(0, np.int64), np.array([0]), np.empty(0, np.int64), window, 5).mark(doc, 5).any()


def test_removed_positions_come_from_the_automaton(monkeypatch):
    """Without its automaton a shard removes nothing, whatever passages its documents receive."""
    rng = random.Random(1)
    phrase = sentence(rng, 30, 10**6)
    texts = [sentence(rng, 20, 10**6) + " " + phrase, sentence(rng, 5, 10**6) + " " + " ".join(phrase.split()[5:25])]
    kind = pa.list_(pa.struct([("low", pa.int64()), ("passage", pa.string())]))
    batch = pa.record_batch(
        {"doc_id": [8, 9], "text": texts, "__sd_passages": pa.array([[{"low": 3, "passage": phrase}], [{"low": 3, "passage": phrase}]], kind), "__sd_copy": [False, False]}
    )
    locate = substring_dedup._locate(["doc_id", "text"], 13, 1 << 20)
    (out,) = locate(iter([batch]))
    assert out.column("n_removed").to_pylist() == [30, 20] and out.column("text").to_pylist() == [" ".join(texts[0].split()[:20]), " ".join(texts[1].split()[:5])]
    monkeypatch.setattr(substring_dedup.Phrases, "mark", lambda self, number, doc_id: np.zeros(len(number) + 1, dtype=np.int64))
    (out,) = locate(iter([batch]))
    assert out.column("n_removed").to_pylist() == [0, 0] and out.column("text").to_pylist() == texts


# 5 mixing


def water_fill(sizes, weights, factor):
    targets, open_ = {}, dict(zip(sizes, weights))
    left = sum(sizes.values())
    while open_:
        level = left / sum(open_.values())
        full = [s for s in open_ if factor * sizes[s] < level * open_[s]]
        if not full:
            return targets | {s: level * w for s, w in open_.items()}
        for s in full:
            targets[s] = factor * sizes[s]
            left -= targets[s]
            del open_[s]
    return targets


def test_targets(spark):
    rng = random.Random(1)
    for _ in range(4):
        sizes = {f"s{k:02}": rng.choice([0, 5, 50, 1000, 20_000]) for k in range(rng.randrange(1, 9))}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = water_fill(sizes, [k % 3 + 1 for k in range(len(sizes))], 3)
        assert got == pytest.approx(want)


def test_mixing(spark, docs, rows):
    plan = mixing.mix_plan(docs).collect()
    assert plan and sorted(map(tuple, plan)) == sorted(map(tuple, mixing.mix_plan(docs.repartition(7)).collect()))
    by = collections.defaultdict(list)
    for r in plan:
        by[r["source"]].append(r)
        assert 0 <= r["copies"] <= 3 and (r["size"] > 0 or r["copies"] == 0)
    sizes = {s: sum(len(words(t)) for _, t, _, x, _ in rows if x == s) for s in ("a", "b", None)}
    want = water_fill(sizes, [1, 2, 3], 3)
    for s, rs in by.items():
        assert rs[0]["source_size"] == sizes[s] and rs[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["copies"] * r["size"] for r in rs) - want[s]) <= 3 * max(r["size"] for r in rs)
    duck = duckdb.connect()
    duck.register("documents", pa.table({"doc_id": [r[0] for r in rows], "source": [r[3] for r in rows], "text": [r[1] for r in rows]}))
    assert sorted(duck.sql(f"select doc_id, size, source_size, target, taken from ({OP5})").fetchall()) == sorted(
        (r["doc_id"], r["size"], r["source_size"], r["target"], r["copies"] * r["size"]) for r in plan
    )
    copies = collections.Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert copies == collections.Counter({r["doc_id"]: r["copies"] for r in plan if r["copies"]})
    odd = mixing.mix_plan(more(spark, docs))
    assert odd.count() == docs.count() + 3
    assert mixing.mix(more(spark, docs)).count() == odd.agg(F.sum("copies")).first()[0]
    assert mixing.mix_plan(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


def test_mixing_is_close_for_many_documents(spark):
    rng = random.Random(3)
    rows = [(i, sentence(rng, rng.randrange(5, 60)), "en", f"s{i % 5}" if i % 3 else "s0", 0) for i in range(3000)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, DOCS))
    for r in plan.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect():
        assert r["taken"] == pytest.approx(r["target"], rel=0.02)


# 6 language ID

SYLLABLES = {"aa": "ba na ma la ka", "bb": "zer tik pol vun", "cc": "ño sí qué cá", "dd": "ß ü ö ä"}


def language_rows(n=240):
    rng = random.Random(4)
    out = []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 4]
        ws = ["".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(2, 4))) for _ in range(rng.choice([3, 10, 60]))]
        out.append((i, " ".join(ws), lang, "s", 0))
    return out


def test_language_id(spark):
    df = spark.createDataFrame(language_rows(), DOCS)
    model = language_id.fit_documents(df, sample_rows=200)
    same = language_id.fit_documents(df.repartition(5), sample_rows=200)
    assert np.array_equal(model.weights, same.weights)
    got = language_id.identify(df.withColumn("held", language_id.held_out()), model).filter("held").collect()
    assert got and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(None, "bana mala", "aa", "s", 0), (1, None, "aa", "s", 0), (2, "12 34 !", "aa", "s", 0), (2, "", None, None, None), (3, "x" * 100_000, "bb", "s", 0)], DOCS)
    rows = {(r["doc_id"], r["text"]): r for r in language_id.identify(odd.withColumn("score", F.lit("clash")), model).collect()}
    assert rows[(1, None)]["lang_pred"] == rows[(2, "12 34 !")]["lang_pred"] == rows[(2, "")]["lang_pred"] == "und"
    assert rows[(None, "bana mala")]["lang_pred"] == "aa" and len(rows) == 5
    assert language_id.identify(empty(spark), model).count() == 0


def test_language_id_learns_nothing_or_one(spark):
    df = spark.createDataFrame(language_rows(8), DOCS)
    none = language_id.fit(df.filter("lang = 'nope'"))
    assert {r["lang_pred"] for r in language_id.identify(df, none).collect()} == {"und"}
    one = language_id.fit(df.filter("lang = 'aa'"))
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(df, one).collect()} == {("aa", 1.0)}


def test_language_id_learns_repeated_rows_once_and_rare_languages(spark):
    base = spark.createDataFrame(language_rows(40), DOCS)
    hot = spark.createDataFrame([(1000, "bana mala", "aa", "s", 0)], DOCS)
    many = base.unionByName(hot.crossJoin(spark.range(3000)).select(*base.columns))
    one, again = language_id.fit(base.unionByName(hot), sample_rows=100), language_id.fit(many, sample_rows=100)
    assert np.array_equal(one.weights, again.weights)
    rare = spark.createDataFrame([(i, "word " * 5, f"l{i % 300:03}", "s", 0) for i in range(900)], DOCS)
    assert len(language_id.fit(rare, sample_rows=300).langs) == 300
    assert language_id.fit(rare, sample_rows=20).langs == tuple(f"l{i:03}" for i in range(20))


def test_language_id_memory_follows_rows(spark):
    import resource

    model = language_id.fit(spark.createDataFrame(language_rows(40), DOCS))
    batch = pa.record_batch({"text": ["bana mala"] * 20_000, "__li_letter": [True] * 20_000})
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    n = sum(b.num_rows for b in language_id._predict(model, ["text"], 0.2)(iter([batch])))
    assert n == 20_000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 150_000


def test_language_decoding_by_brute_force():
    """The winner is the language whose codeword costs least, by plain sums."""
    rng = np.random.default_rng(2)
    codes = language_id.codewords(6)
    trust = rng.uniform(0.1, 1, codes.shape[1])
    model = language_id.Model(tuple("abcdef"), codes, np.zeros((1, codes.shape[1])), np.zeros(codes.shape[1]), trust)
    margins = rng.normal(0, 2, (50, codes.shape[1]))
    best, top, second = language_id.decode(model, margins)
    for k in range(50):
        costs = [sum(t * math.log(1 + math.exp(-m * c)) for t, m, c in zip(trust, margins[k], code)) for code in codes]
        shares = sorted((math.exp(-c) / sum(math.exp(-x) for x in costs) for c in costs), reverse=True)
        assert best[k] == costs.index(min(costs)) and top[k] == pytest.approx(shares[0]) and second[k] == pytest.approx(shares[1])


@pytest.mark.parametrize("n", [2, 3, 4, 7, 20])
def test_codewords_are_far_apart(n):
    c = language_id.codewords(n).astype(int)
    assert all((c[i] != c[j]).sum() >= (n + 1) // 2 for i in range(n) for j in range(i))
    assert all(len(set(col)) == 2 for col in c.T)


def test_held_out_fold_is_crc32(spark):
    import zlib

    got = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", language_id.held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


# 7 decontamination


def test_masks_find_two_substitutions_anywhere():
    import itertools

    for n, subs in ((13, 2), (12, 1), (11, 1), (10, 1), (9, 0), (8, 0)):
        for gone in itertools.combinations(range(n), subs):
            assert any(not {o + x for x in m} & set(gone) for m in decontaminate.MASKS for o in range(n - m[-1]))


def toks(t):
    return [x for x in re.split("[\x20\x09-\x0d]+", re.sub(r"[^\w\x20\x09-\x0d]+|_", "", (t or "").lower())) if x]


def test_decontamination(spark):
    rng = random.Random(6)
    items = {k: sentence(rng, n, 10**6) for k, n in enumerate([40, 20, 13, 9, 8, 3])}
    long = items[0].split()

    def edited(ws, places):
        return " ".join("zz" if k in places else w for k, w in enumerate(ws))

    texts = {
        1: sentence(rng, 50) + " " + items[0].upper() + "! " + sentence(rng, 20), 2: edited(long[5:18], {3, 9}), 3: edited(long[5:18], {1, 6, 9}), 4: " ".join(long[:12]),
        5: sentence(rng, 100), 6: items[1] + "\n" + items[2], 7: items[3], 8: items[4], 9: items[5], 10: None, 11: "", 12: edited(long, {k for k in range(40) if k % 4 == 0}), 13: sentence(rng, 20_000) + " " + items[1],
    }
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in texts.items()], DOCS)
    bench = spark.createDataFrame([*items.items(), (6, None), (None, items[0]), (7, "")], "item_id long, text string").withColumn("seed", F.lit(1))
    want = set()
    for i, t in texts.items():
        d = toks(t)
        for k, x in items.items():
            b = toks(x)
            w = min(13, len(b))
            allowed = w * 2 // 13 if w >= 10 else 0
            if len(b) >= 8 and any(sum(p == q for p, q in zip(d[s : s + w], b[o : o + w])) >= w - allowed for s in range(len(d) - w + 1) for o in range(len(b) - w + 1)):
                want.add((i, k))
    for limit in (10**6, 0):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench, broadcast_rows=limit).collect()}
        assert got == want
    assert {i for i, _ in want} == {1, 2, 6, 7, 8, 13}
    odd = decontaminate.remove_contaminated(more(spark, df), bench)
    assert {r["doc_id"] for r in odd.collect()} == {None, 3, 4, 5, 9, 10, 11, 12}
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_short_and_unspaced_items(spark):
    rng = random.Random(9)
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(40))
    thai = "".join(chr(0x0E01 + k) for k in range(30))
    items = {1: "Paris", 2: "the red, fox", 3: "a b c d e f g", 4: han, 5: han[:5], 6: thai, 7: "", 8: "!?", 9: sentence(rng, 20)}
    texts = {
        1: "in PARIS, now", 2: "parisian", 3: "x the red fox y", 4: "the fox red", 5: "a b c d e f g", 6: "a b c d e f x g", 7: "前" + han[:20] + "。後", 8: "序" + han[:5] + "末",
        9: han[:4], 10: "ก" + thai + "ข", 11: "red fox", 12: None, 13: items[9], 14: han[20:28] + "口" + han[29:],
    }
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in texts.items()], DOCS)
    bench = spark.createDataFrame([*items.items(), (10, None)], "item_id long, text string")
    want = {(1, 1), (3, 2), (5, 3), (7, 4), (7, 5), (8, 5), (10, 6), (13, 9), (14, 4)}
    for limit in (10**6, 0):
        got = decontaminate.contaminated(df, bench, broadcast_rows=limit, short_items=True).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    duck = duckdb.connect()
    for name, rows in (("documents", texts), ("benchmark", items | {10: None})):
        key = "doc_id" if name == "documents" else "item_id"
        duck.register(name, pa.table({key: pa.array(list(rows), pa.int64()), "text": pa.array(list(rows.values()), pa.string())}))
    assert sorted(duck.sql(f"select doc_id, item_id, n_agree, \"window\" from ({OP7})").fetchall()) == sorted(
        (r["doc_id"], r["item_id"], r["n_agree"], r["window"]) for r in got
    )
    kept = decontaminate.remove_contaminated(df, bench, short_items=True)
    assert {r["doc_id"] for r in kept.collect()} == {2, 4, 6, 9, 11, 12}


# 8 quality rules


def test_quality_rules(spark, docs, rows):
    got = {r["doc_id"]: r for r in quality_rules.ledger(docs).collect()}
    for i, t, *_ in rows:
        w = words(t)
        c = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        covered = {k for j in range(len(w) - 4) if c[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(covered))
        assert (r["failed"] & 1 > 0) == (len(w) < 10) and (r["failed"] & 2 > 0) == (100 * len(covered) > 20 * len(w))
    assert quality_rules.ledger(more(spark, docs)).count() == docs.count() + 3
    assert quality_rules.ledger(empty(spark)).count() == 0


def test_policies_and_ablations(spark):
    book = spark.createDataFrame([(1, 0), (2, 1), (3, 4), (4, 5), (5, 8)], "doc_id long, failed long")
    base, strict = quality_rules.POLICIES["base"], quality_rules.POLICIES["strict"]
    assert [r["doc_id"] for r in quality_rules.apply_policy(book, base).filter("kept").orderBy("doc_id").collect()] == [1, 3, 5]
    got = {r["rule"]: (r["n_failed"], r["n_only"], r["n_kept_without"]) for r in quality_rules.ablations(book, strict).collect()}
    assert got["too_few_words"] == (2, 1, 2) and got["symbols"] == (2, 1, 2) and got["repeated_lines"] == (1, 1, 2)
    assert set(r["rule"] for r in quality_rules.ablations(book, base).collect()) == {"too_few_words", "repeated_words"}


# 9 chat formatting

SCHEMA = {"add": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "integer"}}, "required": ["a"], "additionalProperties": False}}


def turn(conv, no, role, body):
    return (conv, no, role, body if body is None or isinstance(body, str) else json.dumps(body))


def test_chats_link_order_and_validate(spark):
    call = lambda i, args, name="add": {"id": i, "name": name, "arguments": args}
    rows = [
        turn(1, 0, "user", "Ünï \"q\"\n"),
        turn(1, 1, "tool", {"tool_call_id": "x", "content": {"z": 1, "a": [2]}}),  # before its call
        turn(1, 2, "assistant", {"tool_calls": [call("y", {"a": {"$result": "x"}}), call("x", {"a": 1})], "content": "hm"}),
        turn(1, 3, "tool", {"tool_call_id": "y", "content": "three"}),
        turn(1, 4, "tool", {"tool_call_id": "x", "content": "again"}), turn(1, 4, "tool", {"tool_call_id": "lost", "content": 1}),
        turn(2, 0, "assistant", {"tool_calls": [call("p", {"b": "no", "c": 1}), call("q", {"a": {"$result": "r"}}), call("r", {"a": {"$result": "q"}}), call("s", {}, "none")]}),
        turn(3, 0, None, None), turn(3, 0, None, None), turn(3, 1, "assistant", "{not json"), turn(None, 0, "user", "x"), turn(4, None, "user", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat_format.format_chats(df, SCHEMA).collect()}
    assert set(got) == {1, 2, 3}
    one = json.loads(got[1]["chat"])["messages"]
    assert [m.get("tool_call", {}).get("id") or m.get("tool_call_id") or m["content"] for m in one] == ["Ünï \"q\"\n", "hm", "x", "x", "y", "y"]
    assert one[3]["content"] == {"a": [2], "z": 1} and "errors" not in one[4] and got[1]["n_orphans"] == 2
    two = {m["tool_call"]["id"]: m["errors"] for m in json.loads(got[2]["chat"])["messages"]}
    assert "$.a: missing" in two["p"] and "$.b: not integer" in two["p"] and "$.c: not allowed" in two["p"] and "no result" in two["p"]
    assert "circular reference" in two["q"] and "circular reference" in two["r"] and "unknown tool none" in two["s"]
    assert got[3]["chat"] == '{"conv_id":3,"messages":[{"content":null,"role":"unknown"},{"content":"{not json","role":"assistant"}],"part":0}'
    for r in got.values():
        assert r["chat"] == chat_format.canonical(json.loads(r["chat"]))
    assert chat_format.format_chats(df.limit(0), SCHEMA).count() == 0


def test_long_chats_come_in_parts(spark):
    rows = [turn(1, i, "user", f"m{i}") for i in range(25)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.format_chats(df, part_turns=10).orderBy("part").collect()
    assert [m["content"] for r in got for m in json.loads(r["chat"])["messages"]] == [f"m{i}" for i in range(25)] and len(got) == 3


def test_links_across_parts(spark):
    ref = lambda r: {"a": {"$result": r}}
    call = lambda i, args: {"tool_calls": [{"id": i, "name": "add", "arguments": args}]}
    rows = [turn(c, i, "user", f"m{i}") for c in (1, 2) for i in range(60)]
    rows += [
        turn(1, 1, "assistant", call("a", {"a": 1})), turn(1, 2, "tool", {"tool_call_id": "a", "content": 7}), turn(1, 25, "assistant", call("b", ref("a"))),
        turn(1, 26, "tool", {"tool_call_id": "b", "content": 8}), turn(1, 3, "assistant", call("f", ref("b"))), turn(1, 4, "tool", {"tool_call_id": "f", "content": 9}),
        turn(1, 35, "assistant", call("a", {"a": 2})), turn(1, 38, "assistant", call("g", ref("gone"))), turn(1, 39, "tool", {"tool_call_id": "g", "content": 0}),
        turn(1, 45, "assistant", call("x", ref("y"))), turn(1, 46, "tool", {"tool_call_id": "x", "content": 1}),
        turn(1, 55, "assistant", call("y", ref("x"))), turn(1, 56, "tool", {"tool_call_id": "y", "content": 1}),
        turn(3, 5, "user", "hi"), turn(3, 25, "tool", {"tool_call_id": "lost", "content": 1}), turn(4, 0, "tool", {"tool_call_id": "lost", "content": 1}),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def read(size):
        got = chat_format.format_chats(df, SCHEMA, part_turns=size).orderBy("conv_id", "part").collect()
        messages = [m for r in got if r["conv_id"] == 1 for m in json.loads(r["chat"])["messages"]]
        return got, messages

    got, cut = read(10)
    _, whole = read(1000)
    errors = [(m["tool_call"]["id"], m.get("errors", [])) for m in cut if "tool_call" in m]
    assert sorted(errors) == sorted((m["tool_call"]["id"], m.get("errors", [])) for m in whole if "tool_call" in m)
    assert errors == [
        ("a", []), ("b", []), ("f", []), ("a", ["repeated id"]), ("g", ["reference to nothing"]), ("x", ["circular reference"]), ("y", ["circular reference"]),
    ]
    assert [m for m in cut if m.get("errors") != ["circular reference"] and m.get("tool_call_id") not in ("x", "y")] == [
        m for m in whole if m.get("errors") != ["circular reference"] and m.get("tool_call_id") not in ("x", "y")
    ]
    assert [m["content"] for m in cut if m.get("tool_call_id") == "a"] == [7]
    assert sum(r["n_bad_calls"] for r in got) == 4
    assert [(r["conv_id"], r["part"], r["n_messages"], r["n_orphans"]) for r in got if r["conv_id"] > 2] == [(3, 0, 1, 0), (3, 2, 0, 1), (4, 0, 0, 1)]


def test_chats_of_odd_json(spark):
    """Half surrogate pairs, deep nesting, what is not JSON, very long text, and conversations of orphans only."""
    deep = '{"tool_call_id": "a", "content": ' + '{"x":' * 5000 + "1" + "}" * 5000 + "}"
    rows = [
        turn(1, 0, "assistant", '{"tool_calls": [{"id": "\\ud800", "name": "add", "arguments": {"a": 1, "\\udc00": 2}}]}'),
        turn(1, 1, "tool", '{"tool_call_id": "\\ud800", "content": "x\\udfffy"}'),
        turn(2, 0, "tool", deep), turn(2, 1, "assistant", '{"tool_calls": [{"id": "n", "name": "add", "arguments": {"a": NaN}}]}'),
        turn(2, 2, "assistant", '{"tool_calls": [{"id": "n", "name": "add", "arguments": {"a": 1e999}}]}'),
        turn(2, 3, "assistant", {"tool_calls": [{"id": "k", "name": "add", "arguments": '{"a": Infinity}'}]}),
        turn(2, 4, "user", "é" * 500_000), turn(3, 700, "tool", {"tool_call_id": "lost", "content": 1}), turn(3, 701, "tool", {"tool_call_id": "lost", "content": 2}),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["part"]): r for r in chat_format.format_chats(df, SCHEMA).collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 1)}
    assert '"id":"\\ud800"' in got[1, 0]["chat"] and [m["role"] for m in json.loads(got[1, 0]["chat"])["messages"]] == ["assistant", "tool"]
    assert json.loads(got[1, 0]["chat"])["messages"][1]["content"] == "x\udfffy"
    two = json.loads(got[2, 0]["chat"])["messages"]
    assert [m["content"] for m in two if "content" in m] == [rows[2][3], rows[3][3], rows[4][3], "é" * 500_000]
    assert [m["tool_call"]["arguments"] for m in two if "tool_call" in m] == ['{"a": Infinity}'] and got[2, 0]["n_bad_calls"] == 1
    assert (got[3, 1]["n_messages"], got[3, 1]["n_orphans"]) == (0, 2)


# 10 near-duplicates


def classes_by_brute_force(rows):
    sets, first = {}, {}
    for i, t in rows:
        w = words(t)
        if t is not None:
            first.setdefault(t, i)
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            k = len(sets[i] & sets[j])
            if k and 5 * k >= 4 * (len(sets[i]) + len(sets[j]) - k):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    for i, t in rows:
        if t is not None:
            parent[max(find(i), find(first[t]))] = min(find(i), find(first[t]))
    return {i: find(i) for i in ids}


def test_near_classes(spark, docs, rows):
    want = classes_by_brute_force([(i, t) for i, t, *_ in rows])
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    assert got == want
    assert max(collections.Counter(want.values()).values()) >= 20
    kept = sorted(r["doc_id"] for r in near_dedup.keep_one(docs).collect())
    assert kept == sorted(set(want.values()))
    odd = near_dedup.near_classes(more(spark, docs))
    assert odd.count() == docs.count() + 3 and odd.filter("doc_id is null and class_id is not null").count() == 0
    out = near_dedup.keep_one(more(spark, docs))
    assert out.columns == more(spark, docs).columns and out.filter("doc_id is null").count() == 2
    assert near_dedup.near_classes(empty(spark)).count() == 0 and near_dedup.keep_one(empty(spark)).count() == 0


def test_chains_and_edited_copies_lose_no_link(spark, monkeypatch):
    """Edited copies of copies: hubs cannot link them all, tiles have to."""
    monkeypatch.setattr(near_dedup, "TILE", 8)
    rng = random.Random(8)
    base = sentence(rng, 150, 10**6).split()
    rows, pool = [(0, " ".join(base))], [base]
    for i in range(1, 90):
        w = list(rng.choice(pool))
        for _ in range(rng.choice([1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        pool.append(w)
        rows.append((i, " ".join(w)))
    want = classes_by_brute_force(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 1


def test_near_copies_that_repeat_passages_on_one_side(spark):
    rng = random.Random(11)

    def grams(ws):
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}

    rows = []
    for k in range(40):
        base = [f"p{k}q{i}" for i in range(400)]
        copy = base[:-40] + [f"r{k}q{i}" for i in range(40)]
        times = rng.randrange(10, 51)
        copy = copy[:100] + copy[100:220] * times + copy[220:]
        a, b = grams(base), grams(copy)
        assert 0.8 <= len(a & b) / len(a | b) < 0.83
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(80)}


def test_a_stray_in_a_large_bucket_costs_rows_in_proportion(spark):
    """Tiles bring every stray together with every member of another part, without copies in proportion to pairs."""
    from glotweave.llm.storage import Scratch

    def deal(n, strays):
        rows = [(7, 0, i, 0) for i in range(n)] + [(7, 0, n + k, n + k) for k in range(strays)] + [(8, 1, i, 5) for i in range(50)]
        with Scratch(spark) as scratch:
            return near_dedup._dealt(near_dedup._apart(spark.createDataFrame(rows, "band long, place int, id long, part long"), scratch)).collect()

    small, large = len(deal(5000, 1)), len(deal(20_000, 1))
    assert small <= 5001 + 10 and large <= 20_001 + 40
    tiles = collections.defaultdict(lambda: ([], []))
    for r in deal(1200, 600):
        for side, c in zip(tiles[r["ti"], r["tj"]], ("left", "right")):
            if r[c]:
                side.append(r)
    met = {(x["id"], y["id"]) for left, right in tiles.values() for x in left for y in right if x["part"] != y["part"]}
    assert met == {(x, y) for x in range(1200, 1800) for y in range(1800) if x != y}
    assert max(len(a) + len(b) for a, b in tiles.values()) < 3 * near_dedup.TILE


def test_long_numbers_are_linked_and_kept(spark):
    long = "-" + "7" * 5000
    call = json.dumps({"tool_calls": [{"id": "c", "name": "f", "arguments": {"n": 1}}]}).replace('"n": 1', f'"n": {long}')
    rows = [(1, 0, "assistant", call), (1, 1, "tool", f'{{"tool_call_id": "c", "content": [{long}, 1e5]}}')]
    tools = {"f": {"type": "object", "properties": {"n": {"type": "integer"}}}}
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tools).first()
    assert (out["n_calls"], out["n_bad_calls"], out["n_orphans"]) == (1, 0, 0)
    assert f'"content":[{long},100000.0]' in out["chat"] and f'"arguments":{{"n":{long}}}' in out["chat"]


def test_decoding_is_bounded_and_agrees_with_the_losses():
    """Two thousand languages; winners and shares as by the sum of every bit's loss."""
    import tracemalloc

    rng = np.random.default_rng(4)
    codes = language_id.codewords(2000)
    bits = codes.shape[1]
    model = language_id.Model(tuple(f"l{i:04}" for i in range(2000)), codes, np.zeros((1, bits), np.float32), np.zeros(bits), rng.uniform(0.05, 1, bits))
    margins = rng.normal(size=(language_id.ROWS, bits)) * 3
    tracemalloc.start()
    best, top, second = language_id.decode(model, margins)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    for i in range(3):
        cost = (np.logaddexp(0, -margins[i] * codes) * model.trust).sum(axis=1)
        share = np.exp(cost.min() - cost)
        share = np.sort(share / share.sum())[::-1]
        assert cost.argmin() == best[i] and np.allclose([top[i], second[i]], share[:2])


def test_licenses_come_from_compressed_sizes(monkeypatch):
    """Compressors of constant size save nothing: no license is named; and the template that saves most is the first to be confirmed."""
    text = "Intro words.\nLicensed under the Apache License, Version 2.0.\nMore."
    scanner = license_scan.Scanner()
    assert [r[2] for r in scanner.report(text)] == ["Apache-2.0"]
    own = license_scan.words(text)
    ranked = scanner.rank_window(own)
    assert scanner.names[ranked[0][0]] == "Apache-2.0" and ranked[0][1] > 0.4 and ranked == sorted(ranked, key=lambda r: (-r[1], r[0]))

    class Constant:
        def compress(self, raw):
            return b"x" * 20

    scanner.plain, scanner.primed, scanner.primed_words = Constant(), [Constant()] * len(scanner.names), [Constant()] * len(scanner.names)
    assert [r[2] for r in scanner.report(text)] == [None]


def test_all_removed_positions_come_from_the_automaton():
    """Texts that are copies of a smaller document lose nothing without passages, and all of it with them."""
    words_ = " ".join(f"w{i}" for i in range(40))
    passage = pa.array([None, [{"low": 1, "passage": words_}], [{"low": 1, "passage": words_}]], pa.list_(pa.struct([("low", pa.int64()), ("passage", pa.string())])))
    for given, removed in ((passage, [0, 40, 40]), (pa.array([None] * 3, passage.type), [0, 0, 0])):
        part = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([words_] * 3), given], ["doc_id", "text", "__sd_passages"])
        (out,) = substring_dedup._locate(["doc_id", "text"], 13, 1 << 20)(iter([part]))
        assert out.column("n_removed").to_pylist() == removed and out.column("n_words").to_pylist() == [40] * 3
