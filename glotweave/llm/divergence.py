"""Source divergence audit by joint count histograms.

Terms are maximal runs of ASCII letters and non-ASCII characters, A-Z lower-cased.  Every language keeps the terms that
stand in at least ``min_docs`` of its documents.  A group is a (lang, source) that occurs.  Where a kept term has
``count`` occurrences in a group (or a whole language), and all kept terms together N, its share is
p = 1 + floor(10^9 (count + 2) / (N + 2 V)), V the number of kept terms of the language.  Two shares differ by
f = floor((p - q)^2 / (p + q)).

* ``pair``: f summed over all kept terms, for each two sources of a language.
* ``term``: f of the kept terms of a group that are more frequent there than in the whole language, the first ``top``.

Method.  f of a term depends on two counts only.  So for each two sources it is tallied how many terms have each combination
of counts, and f is evaluated once for each combination and multiplied by the tally.  Combinations of two positive counts are
tallied in blocks of terms: a task holds all sources' counts of some terms and emits a row for each combination that it has met,
with its number, not one for each term.  Combinations with a zero are implied: as many terms have (c, 0) as the first source has terms of
count c, less those that the second has too; they enter as signed rows from the histograms of single sources.

Scale: occurrences are counted inside tasks, so a frequent term leaves a task as one row per group.  A block is chosen
by the hash of language and term, with about ``block_rows`` counts in each, however large a language is; a term has at most as many counts as its language has sources.  The result has a row for each two sources of a language, which is
what is asked for; f is symmetric, so each two sources are tallied once.

All arithmetic is in integers and decimals: exact up to 10^20 occurrences.

Defined cases: null text, lang and source are ''.  Groups without any kept term take part with counts of 0.  A language that
keeps no term has pairs of value 0 and no term rows.  A language with one source has no pairs.  Ties rank by item in UTF-8 order.
Repeated rows are documents of their own; doc_id is not read.  No rows give no rows.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glotweave.llm.storage import Scratch, materialise
from glotweave.llm.terms import byte_table, count_tokens

BLOCK_ROWS = 100_000
_UPPER, _LOWER = range(0x41, 0x5B), range(0x61, 0x7B)
#: Letters in lower case; every other ASCII character separates.
TERMS = byte_table(lambda b: b + 32 if b in _UPPER else b if b in _LOWER else 0x20)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences, and documents with the term, of every group."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    part = texts.mapInArrow(count_tokens(TERMS, ["lang", "source"], "text", with_docs=True), "lang string, source string, term string, n long, d long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept))."""
    wide = [f"cast({c} as decimal(20,0))" for c in (count, total, kept)]
    return F.expr(f"1 + (cast(1000000000 as decimal(10,0)) * ({wide[0]} + 2)) div ({wide[1]} + 2 * {wide[2]})")


def difference(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so that 64 bits hold it."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _coded(*columns: pa.ChunkedArray) -> tuple[np.ndarray, list[tuple]]:
    """Number of each row's value in the order of the values' UTF-8 bytes, and the values."""
    parts = [c.combine_chunks().dictionary_encode() for c in columns]
    code = np.zeros(len(columns[0]), np.int64)
    for part in parts:
        code = code * len(part.dictionary) + np.asarray(part.indices)
    distinct, number = np.unique(code, return_inverse=True)
    values = []
    for part in reversed(parts):
        names = part.dictionary.to_pylist()
        values.append([names[i] for i in distinct % max(1, len(names))])
        distinct = distinct // max(1, len(names))
    values = list(zip(*reversed(values)))
    order = sorted(range(len(values)), key=lambda i: [v.encode() for v in values[i]])
    place = np.empty(len(values), np.int64)
    place[order] = np.arange(len(values))
    return place[number], [values[i] for i in order]


def _summed(keys: list[np.ndarray], m: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal combinations of ``keys`` once, with the sums of ``m``."""
    if not len(m):
        return keys, m
    order = np.lexsort(keys)
    keys, m = [k[order] for k in keys], m[order]
    new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
    return [k[new] for k in keys], np.add.reduceat(m, new)


def _tally(table: pa.Table) -> pa.Table:
    """Combinations of two positive counts in a block of terms, with how many terms have them."""
    group, groups = _coded(table.column("lang"), table.column("source"))
    term, _ = _coded(table.column("lang"), table.column("term"))
    n = np.asarray(table.column("n"))
    order = np.lexsort((group, term))
    group, term, n = group[order], term[order], n[order]
    stop = np.cumsum(np.bincount(term))[term]
    keys, m = [np.empty(0, np.int64)] * 4, np.empty(0, np.int64)
    # the step-th next source of the same term, for all terms at once
    step = 1
    while len(at := np.flatnonzero(np.arange(len(n)) + step < stop)):
        more = [group[at], group[at + step], n[at], n[at + step]]
        keys, m = _summed([np.concatenate(x) for x in zip(keys, more)], np.concatenate([m, np.ones(len(at), np.int64)]))
        step += 1
    named = [[groups[i] for i in k] for k in keys[:2]]
    columns = [pa.array([g[i] for g in x], pa.string()) for x, i in ((named[0], 0), (named[0], 1), (named[1], 1))]
    return pa.Table.from_arrays([*columns, pa.array(keys[2]), pa.array(keys[3]), pa.array(m)], ["lang", "source", "item", "c", "o", "m"])


def joint_histograms(kept: DataFrame, groups: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(lang, source, item, c, o, m): how many kept terms have c occurrences in source and o in item, source < item.

    ``kept`` has (lang, source, term, n), ``groups`` (lang, source, known) of all groups.
    """
    blocks = max(1, -(-kept.count() // block_rows))
    shape = "lang string, source string, item string, c long, o long, m long"
    dealt = kept.withColumn("block", F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)))
    both = dealt.groupBy("block").applyInArrow(_tally, shape)
    both = both.groupBy("lang", "source", "item", "c", "o").agg(F.sum("m").alias("m"))
    pairs = groups.select("lang", "source", "known").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source < item")
    single = kept.groupBy("lang", "source", F.col("n").alias("c")).agg(F.count("*").alias("m"))
    nothing, m = F.lit(0).cast("long"), F.col("m")
    left = pairs.drop("known").join(single, ["lang", "source"]).select("lang", "source", "item", "c", nothing.alias("o"), "m")
    right = pairs.drop("known").join(single.withColumnRenamed("source", "item"), ["lang", "item"]).select("lang", "source", "item", nothing.alias("c"), F.col("c").alias("o"), "m")
    neither = pairs.select("lang", "source", "item", nothing.alias("c"), nothing.alias("o"), F.col("known").alias("m"))
    minus = [F.struct(F.col("c"), F.col("o"), m.alias("m")), F.struct(F.col("c"), nothing.alias("o"), (-m).alias("m"))]
    minus += [F.struct(nothing.alias("c"), F.col("o"), (-m).alias("m")), F.struct(nothing.alias("c"), nothing.alias("o"), m.alias("m"))]
    signed_both = both.select("lang", "source", "item", F.inline(F.array(*minus)))

    def without(rows: DataFrame) -> DataFrame:
        """The terms of a single source, which do not lack both."""
        return rows.select("lang", "source", "item", F.inline(F.array(F.struct("c", "o", m.alias("m")), F.struct(nothing.alias("c"), nothing.alias("o"), (-m).alias("m")))))

    rows = signed_both.unionByName(without(left)).unionByName(without(right)).unionByName(neither)
    return rows.groupBy("lang", "source", "item", "c", "o").agg(F.sum("m").alias("m")).filter("m > 0")


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """lang, source, part, item, value, rank."""
    with Scratch(docs.sparkSession) as scratch:
        all_counts = scratch.table(term_counts(docs), "audit-counts")
        found = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
        totals = all_counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("d").alias("d")).filter(F.col("d") >= min_docs).drop("d")
        kept = scratch.table(all_counts.select("lang", "source", "term", "n").join(totals, ["lang", "term"]), "audit-kept")
        scratch.drop(all_counts)
        own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        langs = kept.groupBy("lang", "term").agg(F.first("all").alias("all")).groupBy("lang").agg(F.count("*").alias("known"), F.sum("all").alias("lang_total"))
        groups = scratch.table(
            found.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
            .select("lang", "source", *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("total", "known", "lang_total")]),
            "audit-groups",
        )
        tallied = joint_histograms(kept.select("lang", "source", "term", "n"), groups, block_rows)
        sizes = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total"))
        value = tallied.join(groups, ["lang", "source"]).join(sizes, ["lang", "item"])
        value = value.select("lang", "source", "item", "m", share("c", "total", "known").alias("p"), share("o", "item_total", "known").alias("q"))
        value = value.select("lang", "source", "item", (difference("p", "q") * F.col("m")).alias("f"))
        value = value.groupBy("lang", "source", "item").agg(F.sum("f").alias("value"))
        # a language that keeps nothing has pairs all the same
        pairs = groups.select("lang", "source").join(sizes.drop("item_total"), "lang").filter("source < item").join(value, ["lang", "source", "item"], "left")
        pairs = pairs.withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
        both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
        pairs = pairs.select("lang", F.inline(both), "value").select("lang", "source", F.lit("pair").alias("part"), "item", "value")
        best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pairs = pairs.withColumn("rank", F.row_number().over(best))
        terms = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", share("n", "total", "known").alias("p"), share("all", "lang_total", "known").alias("q"))
        terms = terms.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference("p", "q").alias("value"))
        terms = terms.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
        return materialise(pairs.unionByName(terms), "audit")
