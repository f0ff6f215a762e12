"""Collocations against a plain Python version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glotweave.llm import collocations

DOCS = "doc_id long, lang string, text string"


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def plain(docs, least, first):
    f, total = defaultdict(Counter), Counter()
    for _, lang, text in docs:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            total[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, n in f.items():
        kept = []
        for p, a in n.items():
            if len(p) < 2 or a < least:
                continue
            cuts = [(2000000 * a // (n[p[:k]] + n[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((p, a, n[p[:k]], n[p[k:]], score))
        inside = defaultdict(int)
        for p, a, *_ in kept:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        rows = [(" ".join(p), a, l, r, s) for p, a, l, r, s in kept if 100 * inside[p] < 80 * a]
        rows.sort(key=lambda r: (-r[4], -r[1], r[0].encode()))
        out += [(lang, i + 1, p, a, l, r, total[lang], s) for i, (p, a, l, r, s) in enumerate(rows[:first])]
    return sorted(out)


def documents():
    rng = random.Random(6)
    words = ["The", "of", "a", "é", "漢", "x-y", " b", "c\x1fd", "#", "#a", "a#", "{}", "new", "york"]
    marks = [" ", " ", " ", " ", " ", "\t", "  ", ". ", ",", " \n", "\x0b", "!?", " ; "]
    out = []
    for i in range(300):
        lang = rng.choice(["en", "en", "fr", None, "und", ""])
        out.append((i, lang, "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(40)))))
    out += [(900 + i, "en", "the new york of a a a a a a") for i in range(40)] + [(1, "en", None), (None, "en", ""), (2, None, " \n "), (3, "fr", "a b " * 20_000)]
    return out + out[:5] * 3


@pytest.mark.parametrize("least, first, filter_bits, shard_bytes", [(30, 2000, 28, 1 << 20), (2, 25, 8, 500), (3, 10_000, 20, 1 << 20)])
def test_mine(spark, least, first, filter_bits, shard_bytes):
    rows = documents()
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    for c in ("phrase", "n", "cell", "size", "a", "rank"):
        docs = docs.withColumn(c, F.lit("clash"))
    out = collocations.mine(docs, least, first, filter_bits, shard_bytes)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, out.collect())) == plain(rows, least, first)


def test_no_rows(spark):
    assert collocations.mine(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.mine(spark.createDataFrame([(1, "en", "a b c")], DOCS)).count() == 0


def test_matches_overlap_and_keep_to_words():
    text = collocations.guarded(b"a a a aa a\nna a\n\n a  b")
    assert collocations.count_matches(["a a", "a a a", "aa a", "a b", "a na"], [text, text]) == [4, 2, 2, 2, 0]


def test_phrases_that_share_a_hash(monkeypatch):
    """With hashes of four bits nearly all phrases collide, and are counted all the same."""
    monkeypatch.setattr(collocations, "gram_hashes", lambda h, k, salt: (h[: len(h) - k + 1] + h[k - 1 :]) & np.uint64(15))
    rows = [r for r in documents() if r[1] == "en" and r[2]]
    part = pa.RecordBatch.from_pydict({"text": [r[2] for r in rows], "lang": ["en"] * len(rows)})
    every = collocations.Frequent(16, 16, np.full(1 << 10, 0xFFFFFFFFFFFFFFFF, np.uint64))
    got = Counter()
    for lang, phrase, n in collocations.count_phrases(part, 16, every):
        got[phrase] += n
    want = Counter(" ".join(w[i : i + k]) for r in rows for w in pieces(r[2]) for k in range(2, 5) for i in range(len(w) - k + 1))
    assert got == want


def test_phrases_of_rare_parts_are_not_compiled():
    """A frequent cell does not suffice where a part's cell is rare; before, such phrases went to the automaton."""
    part = pa.RecordBatch.from_pydict({"text": ["a  b c d", "x\ty z"], "lang": ["en", "fr"]})
    shard = collocations.Shard(part.column("text"), ["en", "fr"])
    bits, cells = 40, []
    for size, at in ((2, [0, 1, 4]), (3, [0, 1, 4]), (4, [0])):
        cells += collocations._cells(shard.grams(size)[0][at], bits).tolist()

    class Known:
        def __call__(self, asked):
            return np.isin(asked, np.array(cells, np.uint64))

    assert sorted(collocations.count_phrases(part, bits, Known())) == [("en", "a b", 1), ("en", "a b c", 1), ("en", "b c", 1), ("fr", "x y", 1)]


def test_scores_beyond_64_bits(spark):
    a, l, r = 10**15, 3 * 10**15, 10**15
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    score = F.expr(f"(cast(2000000 as decimal(7,0)) * {collocations._wide('a')}) div ({collocations._wide('l')} + {collocations._wide('r')})")
    assert row.select(score).first()[0] == 2000000 * a // (l + r)
