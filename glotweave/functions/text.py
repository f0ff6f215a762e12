"""Text scalars as Column functions: normalisation, cleaning, script detection, tokens, romanisation, phonetics.

Everything but NFKC is a built-in expression.  ``\\s`` differs between regex engines, so one explicit class of Unicode
white space is used throughout.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's str.split sees it, as a class and as its characters.
WS = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
WS_CHARS = "".join(
    chr(x) for a, b in ((9, 13), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
    for x in range(a, b + 1)
)
ZERO_WIDTH = "‌‍"
#: Texts of these characters are in NFKC already, but for zero-width joiners: none changes alone, and none combines with another.
_NORMAL = "^[\\x00-\\x7F\\u00A1\\u00AB\\u00BB\\u00BF-\\u00FF\\u0780-\\u07B1\\u200C\\u200D\\u2013\\u2014\\u2018\\u2019\\u201C\\u201D]*+\\z"

# Classical Thaana letters and the modern letters that replace them, in pairs.
THAANA_CLASSICAL = "ޤޢޙޛޜޡޣޠޞޝޘ"
THAANA_MODERN = "ގއހޒޒޒގތސށސ"

# English ligatures, quotes and dashes with their spellings.
LIGATURES = {"æ": "ae", "ö": "oe", "œ": "oe", "ﬁ": "fi", "ﬂ": "fl"}
QUOTES_DASHES = ("’‘“”—–", "''\"\"  ")

# Latin spelling of each Thaana letter and vowel sign, in code point order; the last mark is silent.
ROMAN = {
    "ހ": "h", "ށ": "sh", "ނ": "n", "ރ": "r", "ބ": "b", "ޅ": "lh", "ކ": "k", "އ": "a", "ވ": "v", "މ": "m",
    "ފ": "f", "ދ": "dh", "ތ": "th", "ލ": "l", "ގ": "g", "ޏ": "gn", "ސ": "s", "ޑ": "d", "ޒ": "z", "ޓ": "t",
    "ޔ": "y", "ޕ": "p", "ޖ": "j", "ޗ": "ch", "ޘ": "ss", "ޙ": "h", "ޚ": "kh", "ޛ": "z", "ޜ": "z", "ޝ": "sh",
    "ޞ": "s", "ޟ": "d", "ޠ": "t", "ޡ": "z", "ޢ": "a", "ޣ": "gh", "ޤ": "q", "ޥ": "w", "ަ": "a", "ާ": "aa",
    "ި": "i", "ީ": "ee", "ު": "u", "ޫ": "oo", "ެ": "e", "ޭ": "ey", "ޮ": "o", "ޯ": "oa", "ް": "",
}
# Where the full scheme spells a letter differently.
ROMAN_FULL = {"ޘ": "tt", "ޙ": "hh", "ޛ": "th", "ޞ": "ss", "ޟ": "dh"}


def romanisation(scheme: str = "default") -> dict[str, str]:
    """Letter -> Latin spelling; scheme ``default`` or ``full``."""
    if scheme not in ("default", "full"):
        raise ValueError(f"unknown romanisation scheme {scheme!r}; expected 'default' or 'full'")
    return ROMAN | (ROMAN_FULL if scheme == "full" else {})


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column, assume_normal: bool = False) -> Column:
    """Zero-width joiners are removed, then NFKC.  ``assume_normal`` leaves the Python function out of the plan, for texts that
    ``is_normal`` accepts."""
    bare = F.translate(c, ZERO_WIDTH, "")
    return bare if assume_normal else _nfkc(bare)


def is_normal(c: Column) -> Column:
    """Whether all characters are normal already (ASCII, Western European letters, Thaana), but for zero-width joiners; null
    texts are."""
    return F.coalesce(c.rlike(_NORMAL), F.lit(True))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def modern_thaana(c: Column) -> Column:
    return F.translate(c, THAANA_CLASSICAL, THAANA_MODERN)


def _ascii_but(kept: str) -> str:
    """The ASCII characters that are neither ``kept`` nor white space."""
    return "".join(chr(x) for x in range(128) if chr(x) not in kept + WS_CHARS)


def _only(c: Column, kept: str) -> Column:
    """Without characters that are neither of the class ``kept`` nor white space.  A replacement costs far more a character than a test, so
    texts without such characters, as nearly all are when ASCII ones are gone, are left as they are."""
    whole = f"^[{kept}\\x20[{WS[1:-1]}]]*+\\z"
    return F.transform(F.array(c), lambda x: F.when(x.rlike(whole), x).otherwise(F.regexp_replace(x, f"[^{kept}{WS[1:-1]}]+", "")))[0]


_NOT_THAANA, _NOT_LATIN = _ascii_but(""), _ascii_but("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def strip_non_thaana(c: Column) -> Column:
    return _only(F.translate(c, _NOT_THAANA, ""), "\\u0780-\\u07bf")


def plain_english(c: Column) -> Column:
    """Ligatures, curly quotes and dashes spelled out; upper-case ligatures stay as they are."""
    out = F.translate(c, *QUOTES_DASHES)
    for a, b in LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def strip_non_latin(c: Column) -> Column:
    return _only(F.translate(c, _NOT_LATIN, ""), "a-zA-Z")


def clean_thaana(c: Column, assume_normal: bool = False) -> Column:
    """Without the Python function one pass replaces letters and removes joiners and ASCII."""
    if assume_normal:
        return strip(_only(F.translate(c, THAANA_CLASSICAL + ZERO_WIDTH + _NOT_THAANA, THAANA_MODERN), "\\u0780-\\u07bf"))
    return strip(strip_non_thaana(modern_thaana(nfkc(c))))


def clean_english(c: Column, assume_normal: bool = False) -> Column:
    return strip(strip_non_latin(F.lower(plain_english(nfkc(c, assume_normal)))))


def _two_scripts(a: Column, b: Column, name_a: str, name_b: str) -> Column:
    return F.when(a & ~b, name_a).when(b & ~a, name_b).otherwise("mixed")


def detect_script_thaana(c: Column) -> Column:
    """thaana, latin, or mixed (both or neither)."""
    return _two_scripts(c.rlike("[\\u0780-\\u07bf]"), c.rlike("[a-zA-Z]"), "thaana", "latin")


def detect_script_english(c: Column) -> Column:
    """latin, foreign (beyond ASCII), or mixed (both or neither)."""
    return _two_scripts(c.rlike("[a-zA-Z]"), c.rlike("[^\\x00-\\x7F]"), "latin", "foreign")


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+"), lambda t: t != "")


def is_latin_token(t: Column) -> Column:
    return t.rlike("^[a-zA-Z]+\\z")


def is_foreign_token(t: Column) -> Column:
    return t.rlike("[^\\x00-\\x7F]")


def romanise(c: Column, scheme: str = "default") -> Column:
    """Letter by letter; other characters stay."""
    pairs = [F.lit(x) for item in romanisation(scheme).items() for x in item]
    table = F.create_map(*pairs)
    return F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(F.element_at(table, ch), ch)), "")


def transliterate_line(c: Column, scheme: str = "full") -> Column:
    """Thaana tokens romanised, others lower-cased, joined by one space; blank lines stay blank."""
    one = F.transform(tokens(c), lambda t: F.when(t.rlike("[\\u0780-\\u07bf]"), romanise(t, scheme)).otherwise(F.lower(t)))
    return F.array_join(one, " ")


def comparison_form(c: Column) -> Column:
    """Lower case, runs of a character collapsed, one final u, i, e or a removed."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "(.)\\1+", "$1"), "[uiea]\\z", "")


def phonetic_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, on comparison forms; two empty forms give 1."""
    x, y = comparison_form(a), comparison_form(b)
    return 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))


def token_contexts(ws: Column, matches, width: int = 3) -> Column:
    """array<struct<word, left_context, right_context>> of the tokens in ``ws`` that ``matches`` accepts, clipped at the ends.

    ``ws`` should be a column that exists already: it is read once per match.
    """
    at = F.transform(ws, lambda t, i: F.struct(t.alias("word"), i.alias("i")))
    return F.transform(
        F.filter(at, lambda x: matches(x["word"])),
        lambda x: F.struct(
            x["word"].alias("word"),
            F.slice(ws, F.greatest(x["i"] - width, F.lit(0)) + 1, F.least(x["i"], F.lit(width))).alias("left_context"),
            F.slice(ws, x["i"] + 2, F.lit(width)).alias("right_context"),
        ),
    )
