"""Benchmark decontamination by spaced-seed hashing.

Method.  Texts become tokens: lower case, letters and digits only, split at spaces.  A spaced seed is a mask that ignores
some positions of a stretch of tokens; the hashes of the positions it keeps are made at every place of the test items and
of the documents, and joined.  A hit fixes an item and an alignment (document position minus item position), which is
then verified: along it, some ``window`` consecutive tokens must agree in all but ``substitutions`` places (both in
proportion for items of 10 to 12 tokens; items of 8 or 9 tokens must agree in all).  The two masks find every such
stretch: each way of placing 2 substitutions in 13 tokens, or 1 in 10 to 12, leaves one of them whole somewhere.
DataFrame functions only.

Short items.  Items of fewer tokens than the shorter mask (8), and items in scripts without spaces, are searched besides with
``short_items``: both sides are split once more, letters of such scripts one by one.  Items that then have fewer than 8 tokens
are hashed whole at their own length, joined with the documents' stretches of that length and confirmed token by token; the
others go through the seeds and the verification above.  Documents are read for this only if there are such items.

Scale: test items are the small side.  Their seeds are counted first and broadcast up to ``broadcast_rows``; above that the
same join runs as a shuffled equi-join that adaptive execution can split.  In the broadcast form documents are streamed
once without a shuffle, and only hits leave a task.  Hits are written to the shared scratch folder and counted; texts are
read a second time for documents with hits, which are broadcast up to the same number of hits, else joined by a shuffle on
doc_id.  A passage held by a third of all documents costs each of them its own rows only.

Defined cases: null or empty texts have no tokens and no hits; items with fewer tokens than the shorter mask (8) are
reported with ``short_items`` only, if a document holds all their tokens in a row; rows with a null doc_id or item_id are not searched; rows that share a doc_id are one
document, reported if any of its texts holds the item; a document is reported once per item; extra columns are ignored
by ``contaminated`` and passed through by ``remove_contaminated``, which keeps rows with a null doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotweave.llm.columns import SPACE_RUN
from glotweave.llm.storage import Scratch, materialise

#: Positions kept; found by search over all masks of weight 6, complete for 2 substitutions in 13 tokens.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
WINDOW = 13
SUBSTITUTIONS = 2
BROADCAST_ROWS = 2_000_000
#: Letters of scripts that are written without spaces.
UNSPACED = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}\\p{IsTibetan}"


def tokens(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}\\x20\\x09-\\x0D]+", "")
    return F.filter(F.split(bare, SPACE_RUN), lambda w: w != "")


def split_tokens(text: Column) -> Column:
    """``tokens``, with letters of scripts without spaces each a token."""
    return tokens(F.regexp_replace(F.lower(text), f"([{UNSPACED}&&[\\p{{L}}]])", " $1 "))


def _seeds(df: DataFrame, key: str, split=tokens) -> DataFrame:
    """(key, at, seed) for every mask and place."""
    hashed = df.select(key, F.transform(split(F.col("text")), lambda w: F.xxhash64(w)).alias("__dc_h"))
    h, n = F.col("__dc_h"), F.size("__dc_h")
    empty = F.array().cast("array<struct<at:int,seed:bigint>>")
    per_mask = [
        F.when(
            n > mask[-1],
            F.transform(
                F.sequence(F.lit(0), n - 1 - mask[-1]),
                lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(k), *[F.get(h, i + o) for o in mask]).alias("seed")),
            ),
        ).otherwise(empty)
        for k, mask in enumerate(MASKS)
    ]
    return hashed.select(key, F.inline(F.concat(*per_mask)))


def _small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def _best_window(agree: Column, window: Column) -> Column:
    """The most agreements in any ``window`` consecutive places."""
    starts = F.sequence(F.lit(1), F.size(agree) - window + 1)
    sums = F.transform(starts, lambda s: F.aggregate(F.slice(agree, s, window), F.lit(0), lambda a, x: a + x))
    return F.when(F.size(agree) >= window, F.array_max(sums)).otherwise(F.lit(-1))


def contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS, short_items: bool = False) -> DataFrame:
    """doc_id, item_id, n_agree (tokens of the best window that agree) and window, for each verified pair."""
    docs = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    items = benchmark.select("item_id", "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    found = _search(docs, items, broadcast_rows, tokens)
    if not short_items:
        return found
    odd = items.filter((F.size(tokens(F.col("text"))) <= MASKS[0][-1]) | F.col("text").rlike(f"[{UNSPACED}]"))
    sized = odd.select("item_id", "text", F.size(split_tokens(F.col("text"))).alias("n"))
    lengths = sorted(r["n"] for r in sized.select("n").distinct().collect())
    whole = [n for n in lengths if 0 < n <= MASKS[0][-1]]
    more = []
    if whole:
        more.append(_search_whole(docs, sized.filter(F.col("n") <= MASKS[0][-1]), whole, broadcast_rows))
    if len(whole) < len([n for n in lengths if n]):
        more.append(_search(docs, sized.filter(F.col("n") > MASKS[0][-1]).select("item_id", "text"), broadcast_rows, split_tokens))
    for one in more:
        found = found.unionByName(one)
    best = F.max(F.struct("window", "n_agree")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_agree", "best.window") if more else found


def _search_whole(docs: DataFrame, items: DataFrame, lengths: list[int], broadcast_rows: int) -> DataFrame:
    """Documents that hold all ``n`` tokens of an item in a row."""
    items = items.filter("n > 0").select("item_id", "n", split_tokens(F.col("text")).alias("item_tokens")).withColumn("seed", F.xxhash64("n", "item_tokens"))
    t = F.col("t")
    none = F.array().cast("array<struct<seed:bigint,stretch:array<string>>>")

    def of_length(n: int) -> Column:
        def stretch(i: Column) -> Column:
            return F.struct(F.xxhash64(F.lit(n), F.slice(t, i, n)).alias("seed"), F.slice(t, i, n).alias("stretch"))

        return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), stretch)).otherwise(none)

    stretches = docs.select("doc_id", split_tokens(F.col("text")).alias("t")).select("doc_id", F.inline(F.concat(*map(of_length, lengths))))
    n_items = items.count()
    return (
        stretches.join(_small(items, n_items, broadcast_rows), "seed")
        .filter(F.col("stretch") == F.col("item_tokens"))
        .select("doc_id", "item_id", F.col("n").cast("long").alias("n_agree"), F.col("n").cast("long").alias("window"))
        .distinct()
    )


def _search(docs: DataFrame, items: DataFrame, broadcast_rows: int, split) -> DataFrame:
    """Verified pairs by spaced seeds, over the tokens that ``split`` gives."""
    item_seeds = _seeds(items, "item_id", split).select("item_id", F.col("at").alias("item_at"), "seed")
    n_seeds = item_seeds.count()
    with Scratch(docs.sparkSession) as scratch:
        hits = scratch.table(
            _seeds(docs, "doc_id", split)
            .join(_small(item_seeds, n_seeds, broadcast_rows), "seed")
            .select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
            .distinct(),
            "leak-hits",
        )
        n_hits = hits.count()
        by_doc = materialise(hits.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "shift")).alias("hits")), "leak-documents")
    item_tokens = items.select("item_id", split(F.col("text")).alias("item_tokens"))
    aligned = (
        docs.join(_small(by_doc, n_hits, broadcast_rows), "doc_id")
        .select("doc_id", split(F.col("text")).alias("doc_tokens"), "hits")
        .select("doc_id", "doc_tokens", F.inline("hits"))
        .join(_small(item_tokens, n_seeds, broadcast_rows), "item_id")
    )
    first = F.greatest(F.lit(0), -F.col("shift"))
    last = F.least(F.size("item_tokens"), F.size("doc_tokens") - F.col("shift")) - 1
    agree = F.when(
        last >= first,
        F.transform(
            F.sequence(first, last),
            lambda i: F.when(F.get("item_tokens", i) == F.get("doc_tokens", i + F.col("shift")), 1).otherwise(0),
        ),
    ).otherwise(F.array().cast("array<int>"))
    window = F.least(F.size("item_tokens"), F.lit(WINDOW))
    judged = aligned.select("doc_id", "item_id", agree.alias("agree"), window.alias("window")).select(
        "doc_id", "item_id", "window", _best_window(F.col("agree"), F.col("window")).alias("n_agree")
    )
    allowed = F.when(F.col("window") >= 10, F.floor(F.col("window") * SUBSTITUTIONS / WINDOW)).otherwise(0)
    return (
        judged.filter(F.col("n_agree") >= F.col("window") - allowed)
        .groupBy("doc_id", "item_id")
        .agg(F.max("n_agree").cast("long").alias("n_agree"), F.max("window").cast("long").alias("window"))
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """``docs`` without the documents that hold a passage of any item.  Their ids are broadcast up to ``broadcast_rows``."""
    found = contaminated(docs, benchmark, broadcast_rows, **options).select(F.col("doc_id").alias("__dc_id")).distinct()
    bad = materialise(found, "leak-ids")
    return docs.join(_small(bad, bad.count(), broadcast_rows), F.col("doc_id") == F.col("__dc_id"), "left_anti")
