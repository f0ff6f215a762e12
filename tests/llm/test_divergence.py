"""The divergence audit against a plain Python version."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glotweave.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, lang string, source string, text string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, min_docs, top):
    by_group, in_docs, groups = defaultdict(Counter), Counter(), defaultdict(set)
    for _, lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = TERM.findall(lower(text))
        by_group[lang, source].update(terms)
        in_docs.update((lang, t) for t in set(terms))
    out = []
    for lang, sources in groups.items():
        kept = {t for (x, t), n in in_docs.items() if x == lang and n >= min_docs}
        counts = {s: {t: by_group[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(counts[s][t] for s in sources) for t in kept}

        def shares(c):
            total = sum(c.values())
            return {t: 1 + 10**9 * (n + 2) // (total + 2 * len(kept)) for t, n in c.items()}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        p, q = {s: shares(counts[s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [("pair", o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources - {s}]
            terms = [("term", t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for rows, most in ((pairs, None), (terms, top)):
                rows.sort(key=lambda r: (-r[2], r[1].encode()))
                out += [(lang, s, *r, k + 1) for k, r in enumerate(rows[:most])]
    return sorted(out)


def documents():
    rng = random.Random(8)
    words = [f"{c}{d}" for c in "abcdefgh" for d in ("x", "É", "Y", "漢", "zz", "-q")]
    out = []
    for i in range(400):
        lang, source = rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s2", "Z", "é", None, "s10"])
        text = " ".join(words[min(len(words) - 1, int(rng.expovariate(0.1)))] for _ in range(rng.randrange(30)))
        out.append((i, lang, source, text))
    out += [(1, "en", "s1", out[0][3])] * 3 + [(None, "en", "silent", None), (2, "en", "silent", " 123 "), (3, "xx", "a", "once"), (4, "xx", "b", None), (5, "xx", "c", "")]
    out += [(6, "alone", "only", "word " * 20)] * 12 + [(7, "en", "long", "ax bx " * 40_000)]
    return out


@pytest.mark.parametrize("min_docs, block_rows", [(10, 100_000), (1, 7)])
def test_audit(spark, min_docs, block_rows):
    rows = documents()
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    for c in ("term", "n", "known", "total", "m", "c"):
        docs = docs.withColumn(c, F.lit("clash"))
    out = divergence.audit(docs, min_docs, 10, block_rows)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, out.collect())) == plain(rows, min_docs, 10)


def test_no_rows_and_large_counts(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    n = 10**18
    row = spark.range(1).select(F.lit(n).alias("n"), F.lit(5 * n).alias("t"), F.lit(3).cast("long").alias("v"))
    assert row.select(divergence.share("n", "t", "v")).first()[0] == 1 + 10**9 * (n + 2) // (5 * n + 6)
    top = spark.range(1).select(F.lit(10**9 + 1).cast("long").alias("p"), F.lit(1).cast("long").alias("q"))
    assert top.select(divergence.difference("p", "q")).first()[0] == 10**18 // (10**9 + 2)


def test_joint_histograms_hold_every_term(spark):
    kept = [("en", s, t, n) for s, t, n in [("a", "x", 2), ("b", "x", 2), ("a", "y", 2), ("b", "y", 2), ("a", "z", 1), ("c", "w", 5)]]
    groups = spark.createDataFrame([("en", s, 4) for s in "abcd"], "lang string, source string, known long")
    got = divergence.joint_histograms(spark.createDataFrame(kept, "lang string, source string, term string, n long"), groups, 2)
    got = {(r["source"], r["item"], r["c"], r["o"]): r["m"] for r in got.collect()}
    assert got["a", "b", 2, 2] == 2 and got["a", "b", 1, 0] == 1 and got["a", "b", 0, 0] == 1 and got["c", "d", 5, 0] == 1
    assert got["a", "c", 2, 0] == 2 and got["a", "c", 0, 5] == 1 and all(sum(m for k, m in got.items() if k[:2] == p) == 4 for p in {k[:2] for k in got})
