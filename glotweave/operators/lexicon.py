"""Mining an aligned space: lexical gaps and loanwords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotweave.functions.text import phonetic_similarity, romanise
from glotweave.operators.corpus import not_in
from glotweave.operators.knn import knn_join

# Keywords of each semantic domain.
DOMAINS = {
    "technology": ["internet", "computer", "software", "app", "phone", "digital", "wifi", "email", "server", "database", "algorithm", "pixel", "smartphone", "laptop", "tablet", "cloud", "bluetooth"],
    "finance": ["bank", "loan", "credit", "debit", "budget", "inflation", "mortgage", "dividend", "equity", "tax", "currency", "invest"],
    "medicine": ["hospital", "vaccine", "diagnosis", "therapy", "surgery", "antibiotic", "pandemic", "virus", "symptom", "clinic"],
    "politics": ["democracy", "parliament", "constitution", "election", "senator", "coalition", "referendum", "minister", "diplomat", "sanction"],
    "sports": ["football", "cricket", "basketball", "tennis", "marathon", "tournament", "championship", "athlete", "referee", "penalty"],
    "food": ["restaurant", "pizza", "burger", "coffee", "chocolate", "pasta", "sushi", "buffet", "calorie", "protein"],
    "education": ["university", "curriculum", "thesis", "semester", "scholarship", "bachelor", "master", "degree", "exam", "lecture"],
    "environment": ["climate", "pollution", "sustainability", "ecosystem", "biodiversity", "carbon", "recycle", "coral", "tsunami"],
}


def domain_of(word: Column, domains: dict[str, list[str]] | None = None) -> Column:
    """The domain of a word, else ``other``."""
    table = F.create_map(*[F.lit(x) for name, keys in (domains or DOMAINS).items() for k in keys for x in (k, name)])
    return F.coalesce(F.element_at(table, F.lower(word)), F.lit("other"))


def find_gaps(english: DataFrame, dhivehi: DataFrame, seed_words: DataFrame | None = None, threshold: float = 0.35, top_n: int = 10_000, domains: dict[str, list[str]] | None = None) -> DataFrame:
    """(english_word, nearest_dhivehi, cosine_sim, is_gap, domain): English words, by frequency the first ``top_n`` and then
    without seed words, whose nearest word on the other side is below the threshold.  The score is rounded after the test."""
    first = english.filter(F.col("idx") < top_n)
    if seed_words is not None:
        first = not_in(first, seed_words)
    near = knn_join(first, dhivehi, 1)
    names = first.select(F.col("idx").cast("long").alias("q"), F.col("word").alias("english_word"))
    others = dhivehi.select(F.col("idx").cast("long").alias("c"), F.col("word").alias("nearest_dhivehi"))
    return near.join(names, "q").join(others, "c").select(
        "english_word", "nearest_dhivehi", F.round("score", 4).alias("cosine_sim"), (F.col("score") < threshold).alias("is_gap"),
        domain_of(F.col("english_word"), domains).alias("domain"),
    )


def gap_summary(gaps: DataFrame) -> DataFrame:
    """(domain, n_words, n_gaps, gap_rate) per domain, most gaps first, and, with a null domain and last, in total."""
    n = F.count_if("is_gap")
    rows = gaps.rollup("domain").agg(F.count("*").alias("n_words"), n.alias("n_gaps"), (n / F.count("*")).alias("gap_rate"))
    return rows.orderBy(F.col("domain").isNull(), F.desc("n_gaps"), "domain")


def classify_loans(space: DataFrame, entities: DataFrame | None = None, phonetic_threshold: float = 0.65, embed_threshold: float = 0.55, top_k: int = 20, max_words: int = 0, scheme: str = "default") -> DataFrame:
    """(idx, word, romanised, category, best_english_match, phonetic_score, embed_score) of the dv words of an aligned space.

    ``space`` is (lang, idx, word, vec) with idx unique over both languages.  A named entity (the word or its romanisation
    is listed) is not searched.  For the others the 3 * top_k nearest of all words in either language are taken, then the
    first top_k English ones among them; the best by sound wins, ties go to the nearer, and a sound score of 0 never counts.
    """
    dv = space.filter(F.col("lang") == "dv").withColumn("romanised", romanise(F.col("word"), scheme))
    if max_words:
        dv = dv.filter(F.col("idx") < max_words)
    listed = (entities if entities is not None else space.sparkSession.createDataFrame([], "value string")).select(F.lower("value").alias("e")).distinct()
    a, b = listed.select(F.col("e").alias("e1"), F.lit(True).alias("by_sound")), listed.select(F.col("e").alias("e2"), F.lit(True).alias("by_word"))
    marked = dv.join(a, F.lower("romanised") == F.col("e1"), "left").join(b, F.lower("word") == F.col("e2"), "left")
    marked = marked.withColumn("entity", F.coalesce("by_sound", "by_word", F.lit(False))).select("idx", "word", "romanised", "vec", "entity")
    near = knn_join(marked.filter(~F.col("entity")), space, 3 * top_k, exclude_self=True)
    english = space.filter(F.col("lang") == "en").select(F.col("idx").cast("long").alias("c"), F.col("word").alias("english"))
    own = dv.select(F.col("idx").cast("long").alias("q"), "romanised")
    scored = near.join(english, "c").join(own, "q")
    taken = scored.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("rank", "english", "score", "romanised"))), 1, top_k).alias("t"))
    each = taken.select("q", F.inline("t")).withColumn("phon", phonetic_similarity(F.col("romanised"), F.col("english"))).filter("phon > 0")
    best = each.groupBy("q").agg(F.max_by(F.struct("english", "phon", "score"), F.struct("phon", (-F.col("rank")).alias("near"))).alias("b"))
    out = marked.join(best.select(F.col("q").alias("bq"), "b"), F.col("idx") == F.col("bq"), "left")
    is_loan = (F.col("b.phon") >= phonetic_threshold) & (F.col("b.score") >= embed_threshold)
    return out.select(
        "idx", "word", "romanised",
        F.when(F.col("entity"), "named_entity").when(is_loan, "loanword").otherwise("native_dhivehi").alias("category"),
        F.coalesce("b.english", F.lit("")).alias("best_english_match"),
        F.round(F.coalesce("b.phon", F.lit(0.0)), 4).alias("phonetic_score"), F.round(F.coalesce("b.score", F.lit(0.0)), 4).alias("embed_score"),
    )


def category_histogram(loans: DataFrame) -> DataFrame:
    """(category, n, percent), by name of the category."""
    counts = loans.groupBy("category").agg(F.count("*").alias("n"))
    total = loans.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("category", "n", (100 * F.col("n") / F.col("total")).alias("percent")).orderBy("category")
