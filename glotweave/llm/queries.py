"""One query per operator: the operator, with production parameters, over its whole table, and its digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotweave.llm import (
    chat_format,
    collocations,
    decontaminate,
    divergence,
    fingerprints,
    language_id,
    license_scan,
    line_dedup,
    mixing,
    near_dedup,
    quality_classifier,
    quality_rules,
    substring_dedup,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, quality_classifier.grades_of_labels(table(spark, sf_dir, "labels")), n_grades=3)
    return quality_classifier.score(docs, model, level=2)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit_documents(docs)
    marked = docs.select("doc_id", language_id.held_out().alias("held_out"), "text")
    return language_id.identify(marked, model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_items=True)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(table(spark, sf_dir, "documents"))
    judged = quality_rules.apply_policy(book, quality_rules.POLICIES["strict"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(quality_rules.BASE_MASK)) != 0).alias("base_failed"), "kept", "failed",
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy of ``op8_quality_rules`` removes, alone and with others."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")), quality_rules.POLICIES["strict"])


#: Schemas of the tools that conversations may call.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"), TOOLS)


def turns_with_tools(turns: DataFrame) -> DataFrame:
    """``turns`` with every assistant turn made a search call, from turn 3 on with a second call that uses its result; the
    searches' results come 1,000 turns later, and every conversation that a user opens has a result that nothing called."""
    t, said = F.col("turn").cast("string"), F.col("role") == "assistant"
    search = F.struct(
        F.concat(F.lit("c"), t).alias("id"), F.lit("search").alias("name"),
        F.to_json(F.struct(F.col("text").alias("query"), F.col("turn").alias("limit"))).alias("arguments"),
    )
    use = F.struct(
        F.concat(F.lit("d"), t).alias("id"), F.lit("calculate").alias("name"),
        F.concat(F.lit('{"expression":{"$result":"c'), t, F.lit('"}}')).alias("arguments"),
    )
    calls = F.to_json(F.struct(F.when(F.col("turn") < 3, F.array(search)).otherwise(F.array(use, search)).alias("tool_calls")))
    late, tool = (F.col("turn") + 1000).alias("turn"), F.lit("tool").alias("role")

    def result(name, content):
        return F.to_json(F.struct(name.alias("tool_call_id"), content.alias("content"))).alias("text")

    return (
        turns.select("conv_id", "turn", "role", F.when(said, calls).otherwise(F.col("text")).alias("text"))
        .union(turns.filter(said).select("conv_id", late, tool, result(F.concat(F.lit("c"), t), F.char_length("text"))))
        .union(turns.filter("turn = 0 and role = 'user'").select("conv_id", late, tool, result(F.lit("lost"), F.col("text"))))
    )


def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of ``op9_chat_format`` over conversations with tool calls, made from the whole table."""
    return chat_format.format_chats(turns_with_tools(table(spark, sf_dir, "conversations")), TOOLS)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "rep_id", "class_id")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_license_scan": op2_license_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_language_id": op6_language_id,
    "op7_decontamination": op7_decontamination,
    "op8_quality_rules": op8_quality_rules,
    "quality_ablations": quality_ablations,
    "op9_chat_format": op9_chat_format,
    "chat_tool_calls": chat_tool_calls,
    "op10_near_dedup": op10_near_dedup,
    "op11_fingerprints": op11_fingerprints,
    "op12_collocations": op12_collocations,
    "op13_source_divergence": op13_source_divergence,
}
