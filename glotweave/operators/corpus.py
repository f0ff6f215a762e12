"""Line corpora: cleaning with statistics, foreign tokens, block merging, vocabularies, seed pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glotweave.functions import text as X

CLEANERS = {"english": X.clean_english, "thaana": X.clean_thaana}
MATCHERS = {"english": X.is_foreign_token, "thaana": X.is_latin_token}


def clean_lines(lines: DataFrame, language: str, assume_normal: bool = False) -> DataFrame:
    """``lines`` plus ``clean``; lines that clean to nothing have an empty one.

    Lines are read and split once.  NFKC gets only those that it may change, and nulls for the others.  ``clean`` is made
    by a generator: what is asked of it afterwards is not pushed below it, so it is made once.
    """
    if language not in CLEANERS:
        raise ValueError(f"unknown language {language!r}; expected one of {sorted(CLEANERS)}")
    clean = CLEANERS[language]
    if assume_normal:
        return lines.select("*", F.explode(F.array(clean(F.col("line"), True))).alias("clean"))
    changed = X.nfkc(F.when(~X.is_normal(F.col("line")), F.col("line")))
    ready = lines.withColumn("__line", F.coalesce(changed, F.col("line")))
    # what NFKC made is cleaned as normal text: its joiners are gone, and NFKC makes none
    return ready.select(*lines.columns, F.explode(F.array(clean(F.col("__line"), True))).alias("clean"))


def keep_clean(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter(F.col("clean") != "")


def line_stats(cleaned: DataFrame, *keys: str) -> DataFrame:
    """raw_lines, clean_lines and dropped_lines per key and in total (null keys), in one pass."""
    kept = F.count_if(F.col("clean") != "")
    rolled = cleaned.rollup(*keys) if keys else cleaned.groupBy()
    return rolled.agg(F.count("*").alias("raw_lines"), kept.alias("clean_lines"), (F.count("*") - kept).alias("dropped_lines"))


def foreign_tokens(lines: DataFrame, language: str, width: int = 3) -> DataFrame:
    """The columns of ``lines`` and word, left_context, right_context: tokens of another script in the raw lines."""
    keys = [c for c in lines.columns if c != "line"]
    split = lines.select(*keys, X.tokens(F.col("line")).alias("__tokens"))
    return split.select(*keys, F.inline(X.token_contexts(F.col("__tokens"), MATCHERS[language], width)))


def token_counts(words: DataFrame, word: str = "word", *order: str) -> DataFrame:
    """(token, n): lower-cased tokens with their frequency, and ``first_seen`` if an order is given."""
    aggs = [F.count("*").alias("n")]
    if order:
        aggs.append(F.min(F.struct(*order)).alias("first_seen"))
    return words.groupBy(F.lower(word).alias("token")).agg(*aggs)


def top_tokens(counts: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent; ties by first occurrence if known, else by token."""
    tie = "first_seen" if "first_seen" in counts.columns else "token"
    return counts.orderBy(F.desc("n"), tie).limit(k)


def cleaning_report(lines: DataFrame, language: str, k: int = 20) -> DataFrame:
    """One row: raw_lines, clean_lines, dropped_lines, unique_tokens and top_tokens array<struct<token, n>>."""
    stats = line_stats(clean_lines(lines, language))
    order = [c for c in ("file_no", "line_no") if c in lines.columns]
    counts = token_counts(foreign_tokens(lines, language), "word", *order)
    top = top_tokens(counts, k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), *(["first_seen"] if order else ["token"]))))
    tops = top.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "token", "n"))), lambda x: F.struct(x["token"].alias("token"), x["n"].alias("n"))).alias("top_tokens"))
    unique = counts.agg(F.count("*").alias("unique_tokens"))
    return stats.crossJoin(F.broadcast(unique)).crossJoin(F.broadcast(tops))


def merge_blocks(lines: DataFrame, n: int, major: str, minor: str, chunk: Column | None = None) -> DataFrame:
    """(block_id, tokens): every n consecutive non-blank lines of the whole stream, the last block shorter.

    Lines are in order of (major, minor).  ``chunk`` must rise with that order and cut the stream into pieces a task can
    sort (by default each major value with 100,000 minor ones): lines are ranked within chunks, chunks by the counts of
    those before them, so the one global window holds a row per chunk.
    """
    piece = chunk if chunk is not None else F.struct(F.col(major).alias("a"), F.floor(F.col(minor) / 100_000).alias("b"))
    clean = lines.select(major, minor, piece.alias("chunk"), X.strip(F.col("line")).alias("line")).filter(F.col("line") != "")
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = clean.groupBy("chunk").agg(F.count("*").alias("n")).select("chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = clean.withColumn("at", F.row_number().over(Window.partitionBy("chunk").orderBy(major, minor)) - 1)
    return block_tokens(ranked.join(bases, "chunk").select((F.col("base") + F.col("at")).alias("rn"), "line"), n)


def merge_blocks_within(lines: DataFrame, n: int, key: str, position: str) -> DataFrame:
    """(key, block_id, tokens): as ``merge_blocks`` within each key, for corpora of many bounded documents."""
    clean = lines.select(key, position, X.strip(F.col("line")).alias("line")).filter(F.col("line") != "")
    rn = F.row_number().over(Window.partitionBy(key).orderBy(position)) - 1
    return block_tokens(clean.withColumn("rn", rn), n, key)


def block_tokens(numbered: DataFrame, n: int, *keys: str) -> DataFrame:
    blocks = numbered.groupBy(*keys, F.floor(F.col("rn") / n).alias("block_id")).agg(
        F.sort_array(F.collect_list(F.struct("rn", "line"))).alias("ls")
    )
    return blocks.select(*keys, "block_id", X.tokens(F.array_join(F.col("ls.line"), " ")).alias("tokens"))


def vocabulary(tokens: DataFrame, min_count: int = 3) -> DataFrame:
    """(idx, word, n) of a column ``word``: words seen min_count times or more, by falling frequency, ties by word.

    Words are ranked within cells of equal frequency and equal first three characters, cells by the counts of those before
    them: the one global window holds a row per cell.
    """
    counts = tokens.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count).withColumn("head", F.substring("word", 1, 3))
    before = Window.orderBy(F.desc("n"), "head").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.groupBy("n", "head").agg(F.count("*").alias("size")).select("n", "head", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    within = counts.withColumn("at", F.row_number().over(Window.partitionBy("n", "head").orderBy("word")) - 1)
    return within.join(cells, ["n", "head"]).select((F.col("base") + F.col("at")).cast("int").alias("idx"), "word", "n")


def total_tokens(blocks: DataFrame) -> DataFrame:
    """One row: how many blocks and tokens there are after merging."""
    return blocks.agg(F.count("*").alias("n_blocks"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("n_tokens"))


def _known_sides(pairs: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """(src, tgt, in_src, in_tgt) of the distinct pairs with a known word: the wanted words of both sides meet the vocabularies once.

    A vocabulary that is both sides is read once.
    """
    sides = F.array(F.struct(F.lit("source").alias("side"), F.col("src").alias("word")), F.struct(F.lit("target").alias("side"), F.col("tgt").alias("word")))
    wanted = pairs.select("src", "tgt").distinct().select("src", "tgt", F.inline(sides))
    both = F.explode(F.array(F.lit("source"), F.lit("target"))).alias("side")
    words = source.select("word", both) if source is target else source.select("word", F.lit("source").alias("side")).union(target.select("word", F.lit("target").alias("side")))
    found = wanted.join(words, ["side", "word"], "left_semi")
    return found.groupBy("src", "tgt").agg(*[F.max(F.col("side") == side).alias(name) for side, name in (("source", "in_src"), ("target", "in_tgt"))])


def _with_sides(pairs: DataFrame, sides: DataFrame, how: str) -> DataFrame:
    s = sides.select(F.col("src").alias("__s"), F.col("tgt").alias("__t"), "in_src", "in_tgt")
    return pairs.join(s, F.col("src").eqNullSafe(F.col("__s")) & F.col("tgt").eqNullSafe(F.col("__t")), how)


def pairs_in_vocabulary(pairs: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Pairs (src, tgt) with both words known; duplicates and pair_no stay."""
    return _with_sides(pairs, _known_sides(pairs, source, target).filter("in_src and in_tgt"), "left_semi")


def pairs_missing(pairs: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Pairs with an unknown word, with side = source, target or both."""
    marked = _with_sides(pairs, _known_sides(pairs, source, target), "left")
    s, t = (F.coalesce(F.col(c), F.lit(False)) for c in ("in_src", "in_tgt"))
    side = F.when(~s & ~t, "both").when(~s, "source").when(~t, "target")
    return marked.select(*[f"`{c}`" for c in pairs.columns], side.alias("side")).filter(F.col("side").isNotNull())


def split_pairs(pairs: DataFrame, ratio: float = 0.8, seed: int = 42, cell_pairs: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(train, test) by the order of the MD5 values of "seed|pair_no|src|tgt"; train gets at least 10 rows, so test may be empty.

    Both have the place in that order as ``shuffled``.  Places are counted within cells of equal first digits of the value, of
    about ``cell_pairs`` pairs each, and cells by the counts of those before them.  The same pairs always fall the same way.
    """
    n = pairs.count()
    cut = max(10, int(n * ratio))
    digits = max(0, math.ceil(math.log(max(n, 1) / cell_pairs, 16)))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("pair_no").cast("string"), "src", "tgt"))
    keyed = pairs.withColumn("__key", key).withColumn("__cell", F.substring("__key", 1, digits))
    before = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = keyed.groupBy("__cell").agg(F.count("*").alias("__n")).select("__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    place = F.row_number().over(Window.partitionBy("__cell").orderBy("__key")) - 1
    ranked = keyed.withColumn("__at", place).join(bases, "__cell").withColumn("shuffled", F.col("__base") + F.col("__at"))
    ranked = ranked.drop("__key", "__cell", "__base", "__at")
    return ranked.filter(F.col("shuffled") < cut), ranked.filter(F.col("shuffled") >= cut)


def not_in(words: DataFrame, excluded: DataFrame, column: str = "word") -> DataFrame:
    return words.join(excluded.select(F.col("value").alias(column)).distinct(), column, "left_anti")


def lines_of(df: DataFrame, column: Column, *keys: str) -> DataFrame:
    """(keys, line_no, line) of a text column split at line ends."""
    return df.select(*keys, F.posexplode(F.split(column, "\n")).alias("line_no", "line"))


def first_words(space: DataFrame, n: int = 50) -> DataFrame:
    """(idx, word) of the n most frequent words of a vector table, to look at."""
    return space.filter(F.col("idx") < n).select("idx", "word").orderBy("idx")
