"""Quality rules as a bitmask ledger.

Method: every rule is evaluated once per document; the ledger keeps the measurements and one bit per failed rule.  A
policy is a versioned mask over those bits, so verdicts under any policy, and ablations (what each rule alone removes),
come from bitwise work on the ledger without reading texts again.  DataFrame functions only.

Scale: one narrow pass, no shuffle.  Repeated 5-word windows are found inside a document: only documents whose window hashes
are not all distinct sort them, together with their positions.  Time is n log n in the words of a document.  Ablations
group by the mask (at most 2**rules groups, summed on the map side).

Defined cases: a null or empty text has no words, fails ``too_few_words`` and nothing else; extra columns are ignored by
the ledger; rows are judged one by one, so repeated or null doc_ids are kept as they are; no rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotweave.llm.columns import NON_SPACE, words

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: str  #: SQL over the measurements


RULES = (
    Rule("too_few_words", 0, "n_words < 10"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("repeated_lines", 3, "10 * n_dup_lines > 3 * n_text_lines"),
    Rule("short_words", 4, "word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 15 * n_words"),
)
BASE_MASK = 0b000011


@dataclass(frozen=True)
class Policy:
    """A document is kept if none of the policy's rules failed."""

    name: str
    version: int
    mask: int


POLICIES = {
    "base": Policy("base", 1, BASE_MASK),
    "strict": Policy("strict", 1, sum(1 << r.bit for r in RULES)),
}


def _hashes_of_windows(ws: Column) -> Column:
    n = F.size(ws)
    return F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(*[F.get(ws, i - 1 + k) for k in range(WINDOW)]))
    )


def _covered(windows: Column) -> Column:
    """Words in windows whose hash stands at two positions or more: the sum of min(WINDOW, step to the next such window)."""
    flat = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.sort_array(flat)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    first = docs.select("doc_id", text.alias("__qr_text"), words(F.col("text")).alias("__qr_words")).select(
        "doc_id",
        F.size("__qr_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__qr_words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("__qr_text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("__qr_text", "\n"), lambda x: x.rlike(NON_SPACE)).alias("__qr_lines"),
        F.transform("__qr_words", lambda w: F.xxhash64(w)).alias("__qr_hashes"),
    )
    windows = first.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        F.size("__qr_lines").cast("long").alias("n_text_lines"),
        (F.size("__qr_lines") - F.size(F.array_distinct("__qr_lines"))).cast("long").alias("n_dup_lines"),
        _hashes_of_windows(F.col("__qr_hashes")).alias("__qr_windows"),
    )
    repeats = F.size("__qr_windows") > F.size(F.array_distinct("__qr_windows"))
    pairs = F.when(repeats, _covered(F.col("__qr_windows")))
    ordered = windows.select("*", pairs.alias("__qr_pairs")).drop("__qr_windows")
    at = F.col("__qr_pairs")
    marked = ordered.select(
        "*",
        F.sort_array(
            F.transform(
                F.filter(at, lambda x, k: (x["h"] == F.get(at, k - 1)["h"]) | (x["h"] == F.get(at, k + 1)["h"])),
                lambda x: x["i"],
            )
        ).alias("__qr_at"),
    ).drop("__qr_pairs")
    spots = F.col("__qr_at")
    covered = F.aggregate(
        spots,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n")),
    )["n"]
    return marked.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_text_lines", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements plus ``failed``: bit r is set if rule r failed."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs).withColumn("failed", total.cast("long"))


def apply_policy(book: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with the policy's verdict, and under which policy it was made."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0).withColumn(
        "policy", F.lit(f"{policy.name}-v{policy.version}")
    )


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """rule, n_failed, n_only (documents that only this rule removes), n_kept_without, for each rule of the policy."""
    masks = book.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [r for r in RULES if policy.mask >> r.bit & 1]
    sums = []
    for r in rules:
        hit = F.col("bits").bitwiseAND(F.lit(1 << r.bit)) != 0
        alone = F.col("bits") == (1 << r.bit)
        sums.append(
            F.struct(
                F.lit(r.name).alias("rule"),
                F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
                F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only"),
                F.sum(F.when(alone | (F.col("bits") == 0), F.col("n")).otherwise(0)).alias("n_kept_without"),
            )
        )
    return masks.agg(F.array(*sums).alias("r")).select(F.inline("r"))
