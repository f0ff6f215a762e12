"""Canonical digests against a plain Python version."""

import hashlib
import random
import unicodedata

import pytest

from glotweave.llm import fingerprints
from glotweave.llm.queries import QUERIES

DOCS = "doc_id long, text string, cell string, sent string, fingerprint string"


def plain_canonical(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(folded.split())


def plain(rows):
    """What ``compare_edited`` says of (doc_id, text) with unique ids, but for the fingerprints themselves."""
    ordered = sorted(((-(1 << 63) if i is None else i, i, t or "") for i, t in rows), key=lambda r: -r[0])
    out = []
    for k, (_, i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][2]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        same = [float(plain_canonical(t) == plain_canonical(x)) for x in (edited, following)]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *same, plain_canonical(t), plain_canonical(edited)))
    return out


def texts():
    rng = random.Random(3)
    some = [" ".join(rng.choice(["Éa", "ﬁn", "b", "Straße", "STRASSE", "x y", "漢"]) for _ in range(rng.randrange(12))) for _ in range(120)]
    return [*some, *some[:20], *[t.upper() for t in some[:20]], *[t.replace(" ", " \n") for t in some[20:40]], None, "", " ", "a", "A", "a" * 300_000, "ab" * 200, *["copy of all"] * 90]


@pytest.mark.parametrize("bits", [4, 128])
def test_compare_edited(spark, bits):
    rng = random.Random(4)
    all_texts = texts()
    rng.shuffle(all_texts)
    ids = [None, *rng.sample(range(-500, 5000), len(all_texts) - 1)]
    rows = list(zip(ids, all_texts))
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS).repartition(5)
    got = fingerprints.compare_edited(docs, bits=bits, cell_rows=40).collect()
    want = {r[0]: r for r in plain(rows)}
    assert len(got) == len(rows)
    name, text = {}, {}
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) == w[1:5]
        for c, f in ((w[5], r["fingerprint"]), (w[6], r["edited_fingerprint"])):
            assert name.setdefault(c, f) == f and text.setdefault(f, c) == c


def test_ids_that_many_rows_share(spark):
    rows = [(7, f"text {i}") for i in range(300)] + [(None, f"t{i}") for i in range(200)] + [(i, "same") for i in range(50)] + [(9, "twice")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cells = fingerprints.in_order(docs, cell_rows=20)[0].filter("not sent").groupBy("cell").count().collect()
    assert len(cells) > 20 and max(c["count"] for c in cells) < 80
    got = fingerprints.compare_edited(docs, cell_rows=20).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == sorted((i or 0, len(t)) for i, t in rows)
    one = fingerprints.compare_edited(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0


def test_fingerprint_of_any_columns(spark):
    rows = spark.createDataFrame([(1, "A b", None, 5), (2, "a  B ", "Ａ b", 6)], "id long, left string, right string, left_fingerprint long")
    got = {r["id"]: r for r in fingerprints.fingerprint(rows, ["left", "right"]).collect()}
    assert got[1]["left_fingerprint"] == got[2]["left_fingerprint"] == got[2]["right_fingerprint"] == fingerprints.digest(b"a b")
    assert got[1]["right_fingerprint"] == fingerprints.digest(b"") and len(fingerprints.digest(b"x", 256)) == 64
    assert fingerprints.compare_edited(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op11_fingerprints"](spark, sf).collect()}
    assert len(got) == len(docs)
    for w in plain(docs):
        r = got[w[0]]
        assert (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) == w[1:5]
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple(fingerprints.digest(x.encode()) for x in w[5:])
