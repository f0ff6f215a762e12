"""Named queries: each operator over the driver's tables.

Spaces are made from ``embeddings``: even vec_ids are the source side, odd ones the target side, idx is the place within
the side, and words are named after the row.  Strings for the word-level operators come from benchmark and documents.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glotweave.functions import text as X
from glotweave.functions.vectors import as_double, norm, unit
from glotweave.operators import algebra, corpus, intrinsic, knn, lexicon

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.lines_of(table(spark, sf_dir, "documents"), F.col("text"), "doc_id", "source")


def side(spark: SparkSession, sf_dir: str, rest: int) -> DataFrame:
    """(idx, word, vec, label) of the vectors whose id is even (0) or odd (1)."""
    e = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 2 == rest)
    return e.select(((F.col("vec_id") - rest) / 2).cast("int").alias("idx"), F.concat(F.lit("w"), F.col("vec_id")).alias("word"), as_double(F.col("embedding")).alias("vec"), "label")


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("int").alias("idx"), F.concat(F.lit("w"), F.col("vec_id")).alias("word"), as_double(F.col("embedding")).alias("vec"), "label")


def benchmark_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, pos, word): the letters a to z of each token."""
    ws = F.posexplode(X.tokens(F.col("text"))).alias("pos", "raw")
    words = table(spark, sf_dir, "benchmark").select("item_id", ws)
    return words.select("item_id", "pos", F.regexp_replace(F.lower("raw"), "[^a-z]", "").alias("word")).filter("word <> ''")


@query
def clean_english(spark, sf_dir):
    """Every line of every document, cleaned; lines that clean to nothing are dropped."""
    return corpus.keep_clean(corpus.clean_lines(lines(spark, sf_dir), "english")).select("doc_id", "line_no", "clean")


@query
def clean_thaana(spark, sf_dir):
    """Every line with its small letters in modern and its capitals in classical Thaana, cleaned."""
    spelled = thaana_of(F.col("line"), "ABCDEFGHIJK", X.THAANA_CLASSICAL)
    cleaned = corpus.clean_lines(lines(spark, sf_dir).select("doc_id", "line_no", spelled.alias("line")), "thaana")
    return corpus.keep_clean(cleaned).select("doc_id", "line_no", "clean")


@query
def clean_thaana_stats(spark, sf_dir):
    return corpus.line_stats(corpus.clean_lines(lines(spark, sf_dir), "thaana"))


@query
def clean_stats_by_source(spark, sf_dir):
    return corpus.line_stats(corpus.clean_lines(lines(spark, sf_dir), "english"), "source")


@query
def detect_script(spark, sf_dir):
    l = lines(spark, sf_dir).select(X.detect_script_english(F.col("line")).alias("english_view"), X.detect_script_thaana(F.col("line")).alias("thaana_view"))
    return l.groupBy("english_view", "thaana_view").agg(F.count("*").alias("n"))


@query
def foreign_token_contexts(spark, sf_dir):
    return corpus.foreign_tokens(lines(spark, sf_dir).drop("source"), "english").select(
        "doc_id", "line_no", "word", F.array_join("left_context", " ").alias("left_context"), F.array_join("right_context", " ").alias("right_context")
    )


@query
def conversation_token_contexts(spark, sf_dir):
    """Latin tokens with context over the lines of conversations, counted by context."""
    l = corpus.lines_of(table(spark, sf_dir, "conversations"), F.col("text"), "conv_id", "turn")
    found = corpus.foreign_tokens(l, "thaana")
    return found.groupBy(F.size("left_context").alias("n_left"), F.size("right_context").alias("n_right")).agg(F.count("*").alias("n"), F.count_distinct("word").alias("n_words"))


@query
def foreign_tokens_topk(spark, sf_dir):
    found = corpus.foreign_tokens(lines(spark, sf_dir), "english")
    return corpus.top_tokens(corpus.token_counts(found)).select("token", "n")


@query
def latin_token_counts(spark, sf_dir):
    return corpus.token_counts(corpus.foreign_tokens(lines(spark, sf_dir), "thaana"))


@query
def unique_foreign_tokens(spark, sf_dir):
    return corpus.token_counts(corpus.foreign_tokens(lines(spark, sf_dir), "english")).agg(F.count("*").alias("unique_tokens"), F.sum("n").alias("total_tokens"))


@query
def merge_sentences(spark, sf_dir):
    """Blocks of five non-blank lines within each document."""
    blocks = corpus.merge_blocks_within(lines(spark, sf_dir), 5, "doc_id", "line_no")
    return blocks.select("doc_id", "block_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("line"))


@query
def merge_sentences_stream(spark, sf_dir):
    """Blocks of five non-blank lines over all documents as one stream."""
    blocks = corpus.merge_blocks(lines(spark, sf_dir), 5, "doc_id", "line_no", F.floor(F.col("doc_id") / 1000))
    return blocks.select("block_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("line"))


@query
def vocab_min_count(spark, sf_dir):
    cleaned = corpus.keep_clean(corpus.clean_lines(lines(spark, sf_dir), "english"))
    return corpus.vocabulary(cleaned.select(F.explode(X.tokens(F.col("clean"))).alias("word")), 3)


def _vocabularies(spark, sf_dir):
    docs = corpus.keep_clean(corpus.clean_lines(lines(spark, sf_dir), "english")).select(F.explode(X.tokens(F.col("clean"))).alias("word"))
    names = table(spark, sf_dir, "part").select(F.explode(X.tokens(F.lower("p_name"))).alias("word")).distinct()
    return benchmark_tokens(spark, sf_dir).select("word").distinct(), docs.distinct(), names


@query
def vocab_semi(spark, sf_dir):
    """Pairs (benchmark word, word) whose both sides are known to documents."""
    bench, docs, _ = _vocabularies(spark, sf_dir)
    pairs = bench.select(F.col("word").alias("src"), F.reverse("word").alias("tgt"))
    return corpus.pairs_in_vocabulary(pairs, docs, docs)


@query
def vocab_anti(spark, sf_dir):
    bench, docs, names = _vocabularies(spark, sf_dir)
    return corpus.not_in(docs, bench.withColumnRenamed("word", "value").union(names))


@query
def vocab_missing(spark, sf_dir):
    bench, docs, _ = _vocabularies(spark, sf_dir)
    pairs = bench.select(F.col("word").alias("src"), F.reverse("word").alias("tgt"))
    return corpus.pairs_missing(pairs, docs, docs)


@query
def seed_split_sizes(spark, sf_dir):
    pairs = benchmark_tokens(spark, sf_dir).select((F.col("item_id") * 1000 + F.col("pos")).alias("pair_no"), F.col("word").alias("src"), F.col("word").alias("tgt"))
    train, test = corpus.split_pairs(pairs)
    return train.agg(F.count("*").alias("n_train")).crossJoin(test.agg(F.count("*").alias("n_test")))


@query
def seed_split(spark, sf_dir):
    """Which part each pair of consecutive vectors is in."""
    train, test = corpus.split_pairs(_identity_pairs(spark, sf_dir))
    return train.select("pair_no", F.lit("train").alias("part")).union(test.select("pair_no", F.lit("test").alias("part")))


@query
def word_domains(spark, sf_dir):
    """Every vector named after a domain word or after nothing known, and its domain."""
    known = sorted(w for ws in lexicon.DOMAINS.values() for w in ws)
    names = F.array(*[F.lit(w) for w in [*known, "unknown"]])
    word = F.get(names, F.col("idx") % (len(known) + 1))
    word = F.when(F.col("label") % 2 == 0, F.upper(word)).otherwise(word)
    return whole(spark, sf_dir).select("idx", word.alias("word")).select("idx", "word", lexicon.domain_of(F.col("word")).alias("domain"))


@query
def phonetic_pairs(spark, sf_dir):
    """Similarity by sound of consecutive benchmark tokens."""
    w = Window.partitionBy("item_id").orderBy("pos")
    p = benchmark_tokens(spark, sf_dir).withColumn("next", F.lead("word").over(w)).filter("next is not null")
    return p.select("item_id", "pos", "word", "next", F.round(X.phonetic_similarity(F.col("word"), F.col("next")), 6).alias("similarity"))


def thaana_of(word, others="", spelled=""):
    """Stand-in Thaana spellings for Latin words: letter by letter into U+0780 onwards, and ``others`` as ``spelled``."""
    return F.translate(word, "abcdefghijklmnopqrstuvwxyz" + others, "".join(chr(0x780 + i) for i in range(26)) + spelled)


@query
def romanise(spark, sf_dir):
    words = benchmark_tokens(spark, sf_dir).select("word").distinct().withColumn("thaana", thaana_of(F.col("word")))
    return words.select("thaana", X.romanise(F.col("thaana")).alias("romanised"), X.romanise(F.col("thaana"), "full").alias("romanised_full"))


@query
def transliterate_lines(spark, sf_dir):
    """Every second token in Thaana, the line transliterated."""
    ws = X.tokens(F.col("text"))
    mixed = F.array_join(F.transform(ws, lambda t, i: F.when(i % 2 == 0, thaana_of(F.lower(t))).otherwise(t)), " ")
    return table(spark, sf_dir, "benchmark").select("item_id", X.transliterate_line(mixed).alias("line"))


@query
def diagnose_vocab(spark, sf_dir):
    return corpus.first_words(whole(spark, sf_dir))


@query
def norm_only(spark, sf_dir):
    out = whole(spark, sf_dir).select("idx", unit(F.col("vec"), 1e-8).alias("u"), norm(F.col("vec")).alias("n"))
    return out.select("idx", F.round("n", 6).alias("norm"), F.round(F.col("u")[0], 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query
def center(spark, sf_dir):
    """Unit-length vectors less their mean: what is left in the first and last dimension."""
    c = algebra.preprocess(whole(spark, sf_dir).select("idx", "vec"), "center")
    return c.select("idx", F.round(F.col("vec")[0], 6).alias("first"), F.round(F.element_at("vec", -1), 6).alias("last"))


@query
def covariance(spark, sf_dir):
    _, cov = algebra.covariance(whole(spark, sf_dir))
    rows = [(i, j, round(float(cov[i, j]), 8)) for i in range(len(cov)) for j in range(len(cov))]
    return spark.createDataFrame(rows, "i int, j int, cov double")


@query
def zca(spark, sf_dir):
    """Largest distance of the whitened covariance from the identity, and the length of renormalised rows."""
    s = whole(spark, sf_dir)
    _, cov = algebra.covariance(s, algebra.preprocessing(s, "center_whiten"))
    off = float(abs(cov - np.eye(len(cov))).max())
    n = algebra.preprocess(s, "center_whiten_renorm").agg(F.round(F.min(norm(F.col("vec"))), 6).alias("shortest"), F.count("*").alias("n"))
    return n.withColumn("near_identity", F.lit(off < 0.01))


@query
def gap_scan(spark, sf_dir):
    """Target words whose nearest source word is far."""
    gaps = lexicon.find_gaps(side(spark, sf_dir, 1), side(spark, sf_dir, 0))
    return gaps


@query
def gap_by_domain(spark, sf_dir):
    """Gaps by label, and in total."""
    english = side(spark, sf_dir, 1)
    gaps = lexicon.find_gaps(english, side(spark, sf_dir, 0)).drop("domain").join(english.select(F.col("word").alias("english_word"), F.col("label").cast("string").alias("domain")), "english_word")
    return lexicon.gap_summary(gaps).select("domain", "n_words", "n_gaps", F.round("gap_rate", 6).alias("gap_rate"))


@query
def gap_scan_excluding(spark, sf_dir):
    """Target words up to the operator's own limit, without a list of seed words (every seventh)."""
    english = side(spark, sf_dir, 1)
    seeds = english.filter(F.col("idx") % 7 == 0).select(F.col("word").alias("value"))
    return lexicon.find_gaps(english, side(spark, sf_dir, 0), seeds, threshold=0.4)


@query
def loan_scan(spark, sf_dir):
    """The source side spelled in Thaana, the target side in Latin: categories over the joint space."""
    e = whole(spark, sf_dir)
    digits = F.translate(F.col("idx").cast("string"), "0123456789", "bdfklmnrst")
    latin = F.concat(digits, F.when(F.col("label") % 2 == 0, F.lit("a")).otherwise(F.lit("u")))
    dv = e.filter("idx % 2 = 0").select(F.lit("dv").alias("lang"), "idx", F.translate(F.concat(digits, F.lit("a")), "bdfklmnrstau", "ބދފކލމނރސތއު").alias("word"), "vec")
    en = e.filter("idx % 2 = 1").select(F.lit("en").alias("lang"), "idx", latin.alias("word"), "vec")
    entities = dv.filter("idx % 50 = 0").select(F.col("word").alias("value"))
    return lexicon.classify_loans(dv.unionByName(en), entities, phonetic_threshold=0.3, embed_threshold=0.2).select("idx", "romanised", "category", "best_english_match", "phonetic_score", "embed_score")


@query
def loan_categories(spark, sf_dir):
    """Categories of the loanword scan, counted."""
    found = lexicon.category_histogram(loan_scan(spark, sf_dir))
    return found.select("category", "n", F.round("percent", 6).alias("percent"))


@query
def knn_top10(spark, sf_dir):
    s = whole(spark, sf_dir)
    return knn.knn_join(s, s, 10, exclude_self=True).select("q", "c", "rank", F.round("score", 6).alias("score"))


@query
def knn_pruned_top10(spark, sf_dir):
    """The same through pivots and bounds, as for an index too large to be sent."""
    s = whole(spark, sf_dir)
    return knn.knn_join(s, s, 10, exclude_self=True, broadcast_bytes=0).select("q", "c", "rank", F.round("score", 6).alias("score"))


@query
def csls_rt(spark, sf_dir):
    return knn.csls_penalty(side(spark, sf_dir, 1)).select("idx", F.round("r_t", 6).alias("r_t"))


@query
def csls_topk(spark, sf_dir):
    found = knn.csls_join(side(spark, sf_dir, 0), side(spark, sf_dir, 1), 5)
    return found.select("q", "c", "rank", F.round("score", 6).alias("score"))


def _identity_pairs(spark, sf_dir):
    """Pair k: source word k with target word k."""
    return side(spark, sf_dir, 0).select(F.col("idx").alias("pair_no"), "word").withColumnRenamed("word", "src").withColumn("tgt", F.concat(F.lit("w"), F.col("pair_no") * 2 + 1))


@query
def heldout_p_at_k(spark, sf_dir):
    out = algebra.held_out(_identity_pairs(spark, sf_dir), side(spark, sf_dir, 0), side(spark, sf_dir, 1), (1, 5, 10, 50))
    return out.select("metric", F.round("value", 6).alias("value"))


@query
def rsa(spark, sf_dir):
    r = algebra.rsa(_identity_pairs(spark, sf_dir), side(spark, sf_dir, 0), side(spark, sf_dir, 1))
    return r.select("rsa_n_pairs", F.round("rsa_pearson", 6).alias("rsa_pearson"), F.round("rsa_spearman", 6).alias("rsa_spearman"))


@query
def hubness_skew(spark, sf_dir):
    return knn.hubness_skew(whole(spark, sf_dir)).select(F.round("skew", 6).alias("skew"))


@query
def isomorphism(spark, sf_dir):
    return algebra.isomorphism(_identity_pairs(spark, sf_dir), side(spark, sf_dir, 0), side(spark, sf_dir, 1))


@query
def eigval(spark, sf_dir):
    distance, k = algebra.eigenvalue_distance(side(spark, sf_dir, 0), side(spark, sf_dir, 1))
    return spark.createDataFrame([(round(distance, 6), k)], "eigval_distance double, eigval_k int")


@query
def procrustes(spark, sf_dir):
    """Mean cosine of seed pairs after an orthogonal and a linear mapping."""
    pairs, source, target = _identity_pairs(spark, sf_dir), side(spark, sf_dir, 0), side(spark, sf_dir, 1)
    out = None
    for mode in ("orthogonal", "linear"):
        mapped = algebra.apply_mapping(source, algebra.procrustes(pairs, source, target, mode))
        one = algebra.mean_pair_cosine(pairs, mapped, target).select(F.lit(mode).alias("mode"), F.round("mean_cosine", 6).alias("mean_cosine"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def procrustes_invariants(spark, sf_dir):
    """What makes the mappings right: W'W of the orthogonal one (the identity), X'(XW - Y) of the least-squares one (zero)."""
    pairs, source, target = _identity_pairs(spark, sf_dir), side(spark, sf_dir, 0), side(spark, sf_dir, 1)
    w = algebra.procrustes(pairs, source, target, "orthogonal")
    both = algebra._paired(pairs, source, target)
    gram, cross = algebra.outer_sums(both, "x", "x", normalise=True)[3], algebra.outer_sums(both, "x", "y", normalise=True)[3]
    rest = gram @ algebra.procrustes(pairs, source, target, "linear") - cross
    rows = [(mode, i, j, round(float(m[i, j]), 6) + 0.0) for mode, m in (("orthogonal", w.T @ w), ("linear", rest)) for i in range(len(m)) for j in range(len(m))]
    return spark.createDataFrame(rows, "mode string, i int, j int, value double")


@query
def whitened_covariance(spark, sf_dir):
    """The covariance after whitening: the identity."""
    s = whole(spark, sf_dir)
    _, cov = algebra.covariance(s, algebra.preprocessing(s, "center_whiten"))
    rows = [(i, j, round(float(cov[i, j]), 2) + 0.0) for i in range(len(cov)) for j in range(len(cov))]
    return spark.createDataFrame(rows, "i int, j int, cov double")


@query
def spectrum_sums(spark, sf_dir):
    """Sums of the second and fourth powers of each side's singular values."""
    rows = []
    for name, rest in (("source", 0), ("target", 1)):
        values = algebra.spectrum(side(spark, sf_dir, rest))
        rows.append((name, round(float((values**2).sum()), 4), round(float((values**4).sum() / (values**2).sum()), 4)))
    return spark.createDataFrame(rows, "side string, squares double, fourths double")


@query
def vecmap(spark, sf_dir):
    """Self-learning from all seed pairs: the seeds' mean cosine."""
    from glotweave.operators.selflearn import self_learning

    pairs, source, target = _identity_pairs(spark, sf_dir), side(spark, sf_dir, 0), side(spark, sf_dir, 1)
    a, b = self_learning(source, target, pairs, "semi")
    return algebra.mean_pair_cosine(pairs, a, b).select(F.round("mean_cosine", 4).alias("mean_cosine"))


@query
def coherence(spark, sf_dir):
    """All words as probes, and an unknown one."""
    s = whole(spark, sf_dir)
    return intrinsic.coherence(s.select(F.col("word").alias("value")).union(spark.createDataFrame([("unknown",)], "value string")), s)


@query
def coherence_totals(spark, sf_dir):
    """How many probes have a coherence, how many none, and the mean."""
    return intrinsic.coherence_summary(coherence(spark, sf_dir))


@query
def outlier(spark, sf_dir):
    """Sets of five consecutive vectors; the last is named the outlier."""
    s = whole(spark, sf_dir)
    sets = s.groupBy(F.floor(F.col("idx") / 5).alias("set_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]).alias("words"))
    sets = sets.filter(F.size("words") == 5).withColumn("gold", F.element_at("words", 5))
    return intrinsic.outliers(sets, s)


@query
def outlier_accuracy(spark, sf_dir):
    return intrinsic.outlier_accuracy(outlier(spark, sf_dir)).select("n_sets", F.round("accuracy", 6).alias("accuracy"))


def _analogies(spark, sf_dir):
    """All pairs (source word k, target word k), in categories of twenty consecutive ones."""
    pairs = _identity_pairs(spark, sf_dir).withColumn("category", F.floor(F.col("pair_no") / 20).cast("string"))
    return intrinsic.pair_analogies(pairs, F.col("category"), "src", "tgt")


@query
def analogy_items(spark, sf_dir):
    return _analogies(spark, sf_dir)


@query
def analogy_eval(spark, sf_dir):
    return intrinsic.analogy_predictions(_analogies(spark, sf_dir), whole(spark, sf_dir))


@query
def analogy_accuracy(spark, sf_dir):
    return intrinsic.analogy_accuracy(_analogies(spark, sf_dir), whole(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query
def analogy_sections(spark, sf_dir):
    """The same items as a benchmark by sections, one of them without a known question."""
    items = _analogies(spark, sf_dir).withColumnRenamed("category", "section")
    lost = spark.createDataFrame([("lost", "w0", "w1", "w2", "unknown")], "section string, a string, b string, c string, d string")
    found = intrinsic.section_accuracy(items.withColumn("section", F.col("section").cast("string")).unionByName(lost), whole(spark, sf_dir), total=True)
    return found.withColumn("accuracy", F.round("accuracy", 6))


@query
def word_similarity(spark, sf_dir):
    pairs = _identity_pairs(spark, sf_dir).select(F.col("src").alias("word1"), F.col("tgt").alias("word2"), ((F.col("pair_no") * 37) % 101).cast("double").alias("score"))
    unknown = spark.createDataFrame([("w0", "unknown", 1.0)], "word1 string, word2 string, score double")
    r = intrinsic.word_similarity(pairs.union(unknown), whole(spark, sf_dir))
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("pearson_r", "spearman_r", "oov_ratio")])


@query
def kmeans_purity(spark, sf_dir):
    s = whole(spark, sf_dir)
    found = intrinsic.categorise(s.select(F.col("label").cast("string").alias("label"), "word"), s)
    return intrinsic.purity(found).select("n", F.round("random_baseline", 6).alias("random_baseline"), F.round("purity", 6).alias("purity"))


@query
def kmeans_fit(spark, sf_dir):
    """Clusters of all vectors: how many there are, and whether the vectors lie nearer to their cluster's mean than to their label's."""
    s = whole(spark, sf_dir).withColumn("label", F.col("label").cast("string"))
    found = intrinsic.categorise(s.select("label", "word"), s).select("word", F.col("cluster").cast("string").alias("cluster"))
    v = s.join(found, "word").select("word", "label", "cluster", F.posexplode("vec").alias("i", "x"))

    def spread(by: str):
        return F.sum(F.pow(F.col("x") - F.col(f"{by}_mean"), 2))

    for by in ("label", "cluster"):
        v = v.withColumn(f"{by}_mean", F.avg("x").over(Window.partitionBy(by, "i")))
    return v.agg(F.count_distinct("word").alias("n"), F.count_distinct("cluster").alias("clusters"), (spread("cluster") < spread("label")).alias("nearer"))


def _document_model(spark, sf_dir, **settings):
    from glotweave.operators.train import Settings, train

    cleaned = corpus.keep_clean(corpus.clean_lines(lines(spark, sf_dir), "english")).select("doc_id", "line_no", F.col("clean").alias("line"))
    return train(corpus.merge_blocks_within(cleaned, 5, "doc_id", "line_no"), Settings(epochs=3, **settings))


@query
def word2vec(spark, sf_dir):
    """CBOW over the cleaned documents, three epochs: the vocabulary, and whether every word has a vector of finite numbers, not all zero."""
    table = _document_model(spark, sf_dir).words
    return table.select("idx", "word", F.size("vec").alias("dims"), F.coalesce((norm(F.col("vec")) > 0) & F.forall("vec", lambda x: ~F.isnan(x) & (F.abs(x) < 1e6)), F.lit(False)).alias("trained"))


@query
def word2vec_epochs(spark, sf_dir):
    """Skip-gram over the cleaned documents: whether each epoch's loss is below that of the epoch before it, the first's below that
    of an untrained table."""
    model = _document_model(spark, sf_dir, skip_gram=True, dims=32)
    before = [(1 + model.settings.negative) * float(np.log(2)), *model.losses]
    return spark.createDataFrame([(i + 1, bool(y < x)) for i, (x, y) in enumerate(zip(before, model.losses))], "epoch int, lower boolean")


@query
def explore(spark, sf_dir):
    """Every word and an unknown one: known or not, length, nearest word and the tenth."""
    s = whole(spark, sf_dir)
    asked = s.select("word").union(spark.createDataFrame([("unknown",)], "word string"))
    near = F.col("neighbours")
    return knn.explore(s, asked).select("word", "known", F.round("norm", 6).alias("norm"), near[0]["word"].alias("nearest"), F.element_at(near, -1)["word"].alias("tenth"))


@query
def merged_tokens(spark, sf_dir):
    """Blocks and tokens after merging five lines of the documents as one stream."""
    return corpus.total_tokens(corpus.merge_blocks(lines(spark, sf_dir), 5, "doc_id", "line_no", F.floor(F.col("doc_id") / 1000)))


@query
def aligned_space(spark, sf_dir):
    from glotweave.sources.sinks import aligned_space as combine

    return combine(side(spark, sf_dir, 0), side(spark, sf_dir, 1)).select("lang", "idx", "word", "key", F.round(F.col("vec")[0], 6).alias("first"))


@query
def vec_lines(spark, sf_dir):
    """The word-vector text format, header included."""
    from glotweave.sources.sinks import vec_lines as lines_of_vec

    return lines_of_vec(whole(spark, sf_dir))
