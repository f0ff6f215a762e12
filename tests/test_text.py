import pytest
from pyspark.sql import functions as F

from glotweave.functions import text as X


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").select("i", f(F.col("s")).alias("r")).collect()
    return [r["r"] for r in sorted(rows)]


CLEAN = [
    ("Café — naïve", "caf   nave"), ("ÆON æon", "on aeon"), ("ﬁsh “Tank”", "fish tank"), ("Ö ö ö", "oe oe"),
    ("it's  2 a.m.\t x", "its   am\t x"), ("1234 --", ""), ("K‌ey x", "key x"), ("‌‍", ""), ("", ""),
]


def test_clean_english(spark):
    assert column(spark, [a for a, _ in CLEAN], X.clean_english) == [b for _, b in CLEAN]


def test_clean_thaana_maps_classical_letters_and_keeps_inner_spaces(spark):
    assert column(spark, [" ޤަލަމް  abc ޘާ ", "plain", None], X.clean_thaana) == ["ގަލަމް   ސާ", "", None]


ROMAN = [
    ("album", "އަލްބަމު", "aalbamu", 0.8), ("bank", "ބޭންކު", "beynku", 0.6), ("car", "ކާރު", "kaaru", 1 - 1 / 3), ("film", "ފިލްމު", "filmu", 1.0), ("cake", "ކޭކު", "keyku", 0.25),
]


def test_romanise_and_phonetic_similarity(spark):
    rows = spark.createDataFrame([(e, t) for e, t, _, _ in ROMAN], "e string, t string")
    got = {r["e"]: (r["r"], r["s"]) for r in rows.select("e", X.romanise(F.col("t")).alias("r")).withColumn("s", X.phonetic_similarity(F.col("r"), F.col("e"))).collect()}
    for english, _, roman, score in ROMAN:
        assert got[english][0] == roman and got[english][1] == pytest.approx(score)


def test_comparison_form(spark):
    assert column(spark, ["beynku", "intanet", "AAbbo", "u", ""], X.comparison_form) == ["beynk", "intanet", "abo", "", ""]
    assert column(spark, [""], lambda c: X.phonetic_similarity(c, c)) == [1.0]


def test_schemes_differ_where_said():
    a, b = X.romanisation(), X.romanisation("full")
    assert len(a) == 49 and {k for k in a if a[k] != b[k]} == set("ޘޙޛޞޟ")
    with pytest.raises(ValueError):
        X.romanisation("other")


def test_scripts(spark):
    texts = ["abc", "ަ", "abc ަ", "", "123"]
    assert column(spark, texts, X.detect_script_thaana) == ["latin", "thaana", "mixed", "mixed", "mixed"]
    assert column(spark, ["abc", "é", "aé", ""], X.detect_script_english) == ["latin", "foreign", "mixed", "mixed"]


def test_contexts_are_clipped(spark):
    df = spark.createDataFrame([("a b c d e",)], "s string").select(X.tokens(F.col("s")).alias("w"))
    got = df.select(F.inline(X.token_contexts(F.col("w"), lambda t: t.isin("b", "d")))).collect()
    assert [tuple(r) for r in got] == [("b", ["a"], ["c", "d", "e"]), ("d", ["a", "b", "c"], ["e"])]


def test_latin_tokens_match_whole(spark):
    assert column(spark, ["abc", "abc,", "abc\n"], X.is_latin_token) == [True, False, False]


def test_transliterate_line(spark):
    assert column(spark, ["ކާރު ABC", "", None], X.transliterate_line) == ["kaaru abc", "", None]
