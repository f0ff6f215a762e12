import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from glotweave.functions import text as X
from glotweave.operators import corpus


def test_blocks_cross_files_and_skip_blanks(spark):
    rows = [(0, 0, "a b"), (0, 1, " "), (0, 2, "c"), (0, 3, "d"), (1, 0, "e"), (1, 1, ""), (1, 2, "f"), (1, 3, "g"), (1, 4, "h")]
    df = spark.createDataFrame(rows, "file_no int, line_no int, line string").repartition(3)
    got = {r["block_id"]: r["tokens"] for r in corpus.merge_blocks(df, 5, "file_no", "line_no").collect()}
    assert got == {0: ["a", "b", "c", "d", "e", "f"], 1: ["g", "h"]}


def test_report(spark):
    rows = [(0, 0, "ok café café"), (0, 1, ""), (0, 2, "naïve 12")]
    df = spark.createDataFrame(rows, "file_no int, line_no int, line string")
    r = corpus.cleaning_report(df, "english").first()
    assert (r["raw_lines"], r["clean_lines"], r["dropped_lines"], r["unique_tokens"]) == (3, 2, 1, 2)
    assert [tuple(x) for x in r["top_tokens"]] == [("café", 2), ("naïve", 1)]
    with pytest.raises(ValueError):
        corpus.clean_lines(df, "klingon")


def test_top_ties_by_first_occurrence(spark):
    df = spark.createDataFrame([(0, "zé"), (1, "aé")], "line_no int, word string")
    assert [r["token"] for r in corpus.top_tokens(corpus.token_counts(df, "word", "line_no")).collect()] == ["zé", "aé"]
    assert [r["token"] for r in corpus.top_tokens(corpus.token_counts(df)).collect()] == ["aé", "zé"]


def test_vocabulary_and_pairs(spark):
    words = spark.createDataFrame([(w,) for w in "a a a b b b c c".split()], "word string")
    vocab = corpus.vocabulary(words, 3)
    assert [tuple(r) for r in vocab.orderBy("idx").collect()] == [(0, "a", 3), (1, "b", 3)]
    pairs = spark.createDataFrame([(0, "a", "b"), (1, "a", "b"), (2, "a", "z"), (3, "y", "z")], "pair_no int, src string, tgt string")
    assert [r["pair_no"] for r in corpus.pairs_in_vocabulary(pairs, vocab, vocab).orderBy("pair_no").collect()] == [0, 1]
    assert {r["pair_no"]: r["side"] for r in corpus.pairs_missing(pairs, vocab, vocab).collect()} == {2: "target", 3: "both"}


@pytest.mark.parametrize("n, train", [(8, 8), (10, 10), (20, 16), (101, 80)])
def test_split_sizes(spark, n, train):
    pairs = spark.range(n).select(F.col("id").alias("pair_no"), F.col("id").cast("string").alias("src"), F.lit("x").alias("tgt"))
    a, b = corpus.split_pairs(pairs)
    assert (a.count(), b.count()) == (train, n - train)
    assert not set(r[0] for r in a.select("pair_no").collect()) & set(r[0] for r in b.select("pair_no").collect())
    order = sorted(range(n), key=lambda i: hashlib.md5(f"42|{i}|{i}|x".encode()).hexdigest())
    for cells in (1, 3, 10_000):
        c, d = corpus.split_pairs(pairs, cell_pairs=cells)
        assert {r["pair_no"]: r["shuffled"] for r in c.union(d).collect()} == {i: k for k, i in enumerate(order)}
        assert sorted(r["shuffled"] for r in c.collect()) == list(range(train))


def test_pairs_of_two_vocabularies(spark):
    source, target = (spark.createDataFrame([(w,) for w in ws], "word string") for ws in ("abc", "xy"))
    pairs = spark.createDataFrame([(0, "a", "x"), (0, "a", "x"), (1, "x", "a"), (2, "b", "q"), (3, "q", "y"), (4, None, "y"), (5, None, None)], "pair_no int, src string, tgt string")
    assert [r["pair_no"] for r in corpus.pairs_in_vocabulary(pairs, source, target).collect()] == [0, 0]
    assert {r["pair_no"]: r["side"] for r in corpus.pairs_missing(pairs, source, target).collect()} == {1: "both", 2: "target", 3: "source", 4: "source", 5: "both"}


def test_cleaning_reads_lines_once_and_takes_all_kinds(spark, tmp_path):
    """Before, lines were read, split and tested once for normal ones and once more for the others."""
    odd = ["plain 1, a\x00b\x7fc", "ﬁsh x² ½", "été — “q”", "ޤަލަމް‌ ޘާ x", "ﷲ アＡ", "ı ẛ̣", "", " 　 ", None, "日本 ގ   z", "K‍ey ﬁ"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "i int, line string")
    df.write.parquet(str(tmp_path / "lines"))
    read = spark.read.parquet(str(tmp_path / "lines"))
    for language in ("english", "thaana"):
        cleaned = corpus.clean_lines(read, language)
        plan = cleaned._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 1
        assert cleaned.columns == ["i", "line", "clean"]
        got = {r["i"]: r["clean"] for r in cleaned.collect()}
        letters = "".join(map(chr, range(0x780, 0x7C0))) if language == "thaana" else "abcdefghijklmnopqrstuvwxyz"
        for i, line in enumerate(odd):
            if line is None:
                assert got[i] is None
                continue
            text = unicodedata.normalize("NFKC", line.replace("‌", "").replace("‍", ""))
            if language == "thaana":
                text = text.translate(str.maketrans(X.THAANA_CLASSICAL, X.THAANA_MODERN))
            else:
                text = text.translate(str.maketrans(*X.QUOTES_DASHES))
                for a, b in X.LIGATURES.items():
                    text = text.replace(a, b)
                text = text.lower()
            assert got[i] == "".join(x for x in text if x in letters or x in X.WS_CHARS).strip(X.WS_CHARS), line
