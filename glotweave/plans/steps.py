"""The step registry and its dispatcher.

A step is ``d.<name>``, ``e.<name>`` or a shared name; ``all`` runs everything, ``d.all`` and ``e.all`` one language.  Steps
run in the order given and pass data only through the files named in the configuration.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotweave.functions.text import transliterate_line
from glotweave.operators import algebra, corpus, intrinsic, lexicon
from glotweave.operators.selflearn import MODES, self_learning
from glotweave.operators.train import Settings, train
from glotweave.plans.config import Config
from glotweave.sources import readers, sinks

log = logging.getLogger(__name__)
Step = Callable[[SparkSession, Config], "DataFrame | None"]


def _many(paths: str | list[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _preprocess(language: str, raw: str, clean: str) -> Step:
    def run(spark: SparkSession, cfg: Config) -> DataFrame:
        sources, outputs = _many(getattr(cfg, raw)), _many(getattr(cfg, clean))
        if not sources:
            raise ValueError(f"{raw} names no files")
        if len(outputs) not in (1, len(sources)):
            raise ValueError(f"{len(sources)} raw files but {len(outputs)} clean ones: give one output, or one for each")
        groups = [(sources, outputs[0])] if len(outputs) == 1 else [([s], o) for s, o in zip(sources, outputs)]
        stats = None
        for names, output in groups:
            lines = readers.read_lines(spark, names)
            kept = corpus.keep_clean(corpus.clean_lines(lines, language)).select("file_no", "line_no", F.col("clean").alias("line"))
            sinks.write_lines(kept, output, "file_no", "line_no")
            one = corpus.cleaning_report(lines, language).withColumn("output", F.lit(output))
            stats = one if stats is None else stats.unionByName(one)
        return stats

    return run


def _transliterate(spark: SparkSession, cfg: Config) -> DataFrame | None:
    if not cfg.run_transliteration:
        return None
    lines = readers.read_lines(spark, _many(cfg.clean_dhiv))
    out = lines.select("file_no", "line_no", transliterate_line(F.col("line")).alias("line"))
    sinks.write_lines(out, cfg.transliterate_output, "file_no", "line_no")
    return out


def _embed(e: str) -> Step:
    def run(spark: SparkSession, cfg: Config) -> DataFrame:
        get = lambda name: getattr(cfg, name + e)
        kind = cfg.embedding_type_eng if e else cfg.embedding_type_dhiv
        if kind not in ("word2vec", "fasttext"):
            raise ValueError(f"unknown embedding type {kind!r}; expected 'word2vec' or 'fasttext'")
        grams = {} if kind == "word2vec" else {"min_n": 3, "max_n": 6} if e else {"min_n": cfg.min_n, "max_n": cfg.max_n, "buckets": cfg.bucket}
        settings = Settings(dims=get("vector_size"), window=get("window"), min_count=get("min_count"), epochs=get("epochs"), skip_gram=bool(get("sg")), partitions=get("workers"), **grams)
        lines = readers.read_lines(spark, _many(get("embedding_input")))
        blocks = corpus.merge_blocks(lines, get("merge_sentences"), "file_no", "line_no")
        total = corpus.total_tokens(blocks).first()
        log.info("%d blocks of %d tokens", total["n_blocks"], total["n_tokens"])
        model = train(blocks, settings, lambda n, loss: log.info("epoch %d, loss %.5f", n, loss))
        model.save(spark, cfg.trained_output_eng if e else cfg.model_output_dhiv)
        table = model.table(spark)
        sinks.write_vectors(table, cfg.eng_model_output if e else cfg.embedding_output_dhiv)
        if e:
            sinks.write_vec(table, cfg.eng_vec_output)
        return table

    return run


def _test_embed_dhiv(spark: SparkSession, cfg: Config) -> DataFrame | None:
    space = readers.read_vectors(spark, cfg.dhiv_test_embedding)
    items = None
    for category, path in cfg.analogy_tables.items():
        one = intrinsic.pair_analogies(spark.read.schema("a string, b string").csv(path), category)
        items = one if items is None else items.unionByName(one)
    if cfg.inflection_table is not None:
        table = spark.read.option("header", True).csv(cfg.inflection_table)
        one = intrinsic.table_analogies(table, cfg.inflection_base, cfg.inflection_forms)
        items = one if items is None else items.unionByName(one)
    out = intrinsic.analogy_accuracy(items, space).select(F.lit("analogy").alias("task"), "category", "accuracy") if items is not None else None
    if cfg.outlier_sets:
        found = intrinsic.outliers(spark.read.schema("set_id long, words array<string>, gold string").json(cfg.outlier_sets), space)
        one = intrinsic.outlier_accuracy(found).select(F.lit("outlier").alias("task"), F.lit(None).cast("string").alias("category"), "accuracy")
        out = one if out is None else out.unionByName(one)
    if cfg.category_words:
        found = intrinsic.categorise(spark.read.schema("label string, word string").csv(cfg.category_words), space)
        if found is not None:
            one = intrinsic.purity(found).select(F.lit("purity").alias("task"), F.lit(None).cast("string").alias("category"), F.col("purity").alias("accuracy"))
            out = one if out is None else out.unionByName(one)
    return out


def _evaluate(spark: SparkSession, cfg: Config, path: str, kind: str | None, output: str) -> DataFrame:
    for name in ("similarity_file", "analogy_file", "eval_coherence_file"):
        if getattr(cfg, name) is None:
            raise ValueError(f"{name} is needed")
    space = readers.cached_vectors(spark, path) if path.endswith(".vec") else readers.read_vectors(spark, path, kind)
    row = intrinsic.evaluation_row(
        path.rstrip("/").rsplit("/", 1)[-1], space, readers.read_similarity(spark, cfg.similarity_file),
        readers.read_analogies(spark, cfg.analogy_file), readers.read_word_list(spark, cfg.eval_coherence_file), cfg.eval_topn,
    )
    sinks.append_table(row, output)
    sinks.write_csv(intrinsic.section_accuracy(readers.read_analogies(spark, cfg.analogy_file), space), f"{output}_sections")
    return row


def _probes(spark: SparkSession, cfg: Config) -> None:
    if cfg.eval_coherence_file is None:
        raise ValueError("eval_coherence_file is needed")
    sinks.write_probe_words(spark, cfg.eval_coherence_file, tuple(cfg.probe_words) or sinks.PROBE_WORDS)


def _test_embed_eng(spark: SparkSession, cfg: Config) -> DataFrame:
    if cfg.test_mode_eng != "file":
        raise ValueError(f"unknown test mode {cfg.test_mode_eng!r}; expected 'file' (use operators.knn.neighbours to explore)")
    return _evaluate(spark, cfg, cfg.test_input_file_eng, None, cfg.eval_output_trained_e)


def _test_pretrained_eng(spark: SparkSession, cfg: Config) -> DataFrame:
    if cfg.eng_pretrained_model is None:
        raise ValueError("eng_pretrained_model is needed")
    return _evaluate(spark, cfg, cfg.eng_pretrained_model, cfg.eng_pretrained_type, cfg.eval_output_pretrained_e)


def _align(spark: SparkSession, cfg: Config) -> DataFrame:
    methods = ("procrustes", *(f"vecmap_{m}" for m in MODES))
    if cfg.alignment_method not in methods:
        raise ValueError(f"unknown alignment method {cfg.alignment_method!r}; expected one of {methods}")
    if cfg.seed_dictionary is None:
        raise ValueError("seed_dictionary is needed")
    source, target = (algebra.preprocess(readers.read_vectors(spark, p), cfg.embedding_preprocessing) for p in (cfg.source_embedding, cfg.target_embedding))
    pairs = readers.seed_pairs(readers.read_dictionary(spark, cfg.seed_dictionary), cfg.use_transliteration, cfg.dedup_dictionary, cfg.normalise_dictionary)
    known = corpus.pairs_in_vocabulary(pairs, source, target)
    for side, n in corpus.pairs_missing(pairs, source, target).groupBy("side").count().collect():
        log.info("%d seed pairs miss their %s word", n, side)
    train_pairs, test_pairs = corpus.split_pairs(known, cfg.alignment_train_ratio, cfg.alignment_seed)
    prefix = cfg.alignment_output_prefix.removesuffix(".npy")
    for part, name in ((train_pairs, "train"), (test_pairs, "test")):
        sinks.write_pairs(part, f"{prefix}_{name}_pairs")
    metrics = None
    if cfg.measure_isomorphism:
        metrics = algebra.isomorphism(known, source, target).select("metric", "value")
    if cfg.alignment_method == "procrustes":
        mapped = algebra.apply_mapping(source, algebra.procrustes(train_pairs, source, target, cfg.procrustes_mode))
        mapped_target = target
    else:
        mode = cfg.alignment_method.removeprefix("vecmap_")
        mapped, mapped_target = self_learning(source, target, None if mode == "unsupervised" else train_pairs, mode)
    for space, name in ((mapped, "source"), (mapped_target, "target")):
        sinks.write_vectors(space, f"{prefix}_{cfg.alignment_method}_{name}")
    mapped, mapped_target = (spark.read.parquet(f"{prefix}_{cfg.alignment_method}_{name}") for name in ("source", "target"))
    held = algebra.held_out(test_pairs, mapped, mapped_target)
    metrics = held if metrics is None else metrics.unionByName(held)
    trained = algebra.mean_pair_cosine(train_pairs, mapped, mapped_target).select(F.lit("mean_cosine_train").alias("metric"), F.col("mean_cosine").alias("value"))
    metrics = metrics.unionByName(trained)
    sinks.write_csv(metrics, f"{prefix}_{cfg.alignment_method}_eval")
    sinks.write_report(metrics, f"{prefix}_{cfg.alignment_method}_eval.txt")
    if cfg.retrieval_examples:
        examples = algebra.retrieval_examples(test_pairs, mapped, mapped_target, cfg.retrieval_examples)
        examples.write.mode("overwrite").json(f"{prefix}_{cfg.alignment_method}_examples")
    sinks.write_vectors(sinks.aligned_space(mapped, mapped_target), cfg.aligned_space_output)
    sinks.seed_words(train_pairs, test_pairs).coalesce(1).write.mode("overwrite").text(cfg.aligned_space_output.rsplit(".", 1)[0] + "_seed_words")
    return metrics


def _space(spark: SparkSession, cfg: Config, lang: str) -> DataFrame:
    whole = spark.read.parquet(cfg.aligned_space_output).filter(F.col("lang") == lang)
    first = whole.agg(F.min("idx")).first()[0] or 0
    return whole.withColumn("idx", F.col("idx") - first)


def _detect_loans(spark: SparkSession, cfg: Config) -> DataFrame:
    readers.require(spark, cfg.aligned_space_output)
    loans = lexicon.classify_loans(
        spark.read.parquet(cfg.aligned_space_output), readers.read_entity_lists(spark, cfg.ne_lists_dir), cfg.phonetic_threshold, cfg.embed_threshold, cfg.loan_top_k, cfg.max_words
    )
    for r in lexicon.category_histogram(loans).collect():
        log.info("%s: %d (%.1f %%)", r["category"], r["n"], r["percent"])
    out = loans.orderBy("idx").drop("idx")
    sinks.write_csv(out, cfg.loan_output)
    return out


def _find_gaps(spark: SparkSession, cfg: Config) -> DataFrame:
    readers.require(spark, cfg.aligned_space_output)
    seeds = readers.read_seed_words(spark, cfg.aligned_space_output)
    out = lexicon.find_gaps(_space(spark, cfg, "en"), _space(spark, cfg, "dv"), seeds, cfg.gap_threshold, cfg.top_n_english)
    sinks.write_csv(out, cfg.gap_output)
    for r in lexicon.gap_summary(out).collect():
        log.info("%s: %d of %d", r["domain"] or "all", r["n_gaps"], r["n_words"])
    return out


STEPS: dict[str, dict[str, Step]] = {
    "d": {"preprocess": _preprocess("thaana", "raw_dhiv", "clean_dhiv"), "transliterate": _transliterate, "embed": _embed(""), "test_embed": _test_embed_dhiv},
    "e": {"preprocess": _preprocess("english", "raw_eng", "clean_eng"), "embed": _embed("_eng"), "probes": _probes, "test_embed": _test_embed_eng, "test_pretrained": _test_pretrained_eng},
    "": {"align": _align, "detect_loans": _detect_loans, "find_gaps": _find_gaps},
}


def resolve(steps: str | list[str]) -> list[tuple[str, str]]:
    """(language, step) in order; every mistake is reported at once."""
    names = [s.strip() for s in steps.split(",")] if isinstance(steps, str) else list(steps)
    if names == ["all"]:
        return [(lang, step) for lang, own in STEPS.items() for step in own]
    found, wrong = [], []
    for name in names:
        lang, dot, step = name.rpartition(".")
        if dot and not STEPS.get(lang) or dot and lang == "":
            wrong.append(f"{name!r}: unknown language {lang!r}")
        elif dot and step == "all":
            found += [(lang, s) for s in STEPS[lang]]
        elif step in STEPS.get(lang, {}):
            found.append((lang, step))
        elif not dot and any(step in own for own in STEPS.values()):
            wrong.append(f"{name!r}: needs a language, d. or e.")
        else:
            wrong.append(f"{name!r}: unknown step")
    if wrong:
        raise ValueError("; ".join(wrong))
    return found


def run_pipeline(spark: SparkSession, cfg: Config | dict) -> dict[str, DataFrame | None]:
    """Run the configured steps; step name -> its result."""
    cfg = Config.of(cfg) if isinstance(cfg, dict) else cfg
    out = {}
    for lang, step in resolve(cfg.steps):
        name = f"{lang}.{step}" if lang else step
        log.info("step %s", name)
        out[name] = STEPS[lang][step](spark, cfg)
    return out
