"""Named queries of the operators on documents, and the SQL of those SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepath.llm.common import read_table, remainder, stored
from tidepath.llm.contamination import find_benchmark, item_digest
from tidepath.llm.divergence import quality_measures
from tidepath.llm.langid import predict_language
from tidepath.llm.language_model import score_texts
from tidepath.llm.lines import dedup_lines
from tidepath.llm.mixing import mix_sources
from tidepath.llm.oracle import ORACLE  # noqa: F401  registered by the entry
from tidepath.llm.ordered_minhash import near_duplicates
from tidepath.llm.repair import damaged, plan_repairs, repaired_digests
from tidepath.llm.spelling import count_words, spelling_variants
from tidepath.llm.substrings import remove_repeats
from tidepath.llm.tokens import count_tokens
from tidepath.llm.toxicity import score_toxicity
from tidepath.llm.vectors import near_vectors

TOKENIZER = "word_bpe_49k.json"


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    found = predict_language(docs, learn=remainder("doc_id", 5) != 0)
    return found.withColumn("held_out", remainder("doc_id", 5) == 0)


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return count_tokens(docs, public_tokenizers.path(TOKENIZER))


def op3_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(read_table(spark, folder, "documents"), remainder("doc_id", 7) == 2)


def op4_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(read_table(spark, folder, "embeddings"))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(read_table(spark, folder, "documents"))


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that an earlier one has, or has but for one edit.

    Lines of any length are compared so; those of white space alone stay. See
    `dedup_lines` for nulls, repeats and empty tables.
    """
    found = dedup_lines(read_table(spark, folder, "documents"), shortest=1)
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return found.select("doc_id", "n_lines", "n_removed", kept)


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = (read_table(spark, folder, name) for name in ("documents", "labels"))
    found = score_toxicity(docs, labels, learn=remainder("doc_id", 4) != 2)
    return found.withColumn("held_out", remainder("doc_id", 4) == 2)


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read_table(spark, folder, "documents"))


def op9_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_sources(read_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = (read_table(spark, folder, name) for name in ("documents", "benchmark"))
    found = find_benchmark(docs, items)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        item_digest(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents, some damaged on purpose, with the words they stand for.

    Null texts have no words; a null id counts as the empty text in the damage; repeated
    rows count as often as they are there. See `spelling_variants`.
    """
    docs = read_table(spark, folder, "documents")
    return spelling_variants(count_words(docs, damage=31))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, damaged on purpose, with its faults and its cheapest repair.

    A conversation without rows left has zeros, an empty audit and the hash of no text.
    Nulls are one space, a null id is a conversation, ties go by role and digest of the
    text. See `plan_repairs`.
    """
    rows = damaged(read_table(spark, folder, "conversations"))
    plans = stored(plan_repairs(rows), "repair-plans")
    digests = repaired_digests(rows, plans).select(
        F.col("conv_id").alias("repaired"), F.col("sha256").alias("repaired_sha256")
    )
    return plans.join(digests, F.col("conv_id").eqNullSafe(F.col("repaired")), "left").drop("repaired")


def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its counts and the verdict by distance from its language.

    See `quality_measures` for the rules, and for nulls, repeats and empty tables.
    """
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = quality_measures(read_table(spark, folder, "documents"), carry=("doc_id",))
    return found.select("row.doc_id", *measures, "base_failed", "kept")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_token_counts": op2_token_counts,
    "op3_lm_scores": op3_lm_scores,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_source_mix": op9_source_mix,
    "op10_decontamination": op10_decontamination,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_quality_rules": op13_quality_rules,
}
