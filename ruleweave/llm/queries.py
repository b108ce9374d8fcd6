"""Registered queries of the training-data operators, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard_join, language_id, line_dedup, quality_classifier, quality_rules, quotations, substring_dedup, training_order
from .common import table


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(language_id.held_out(F.col("doc_id")), F.lit(False))
    done = language_id.predict(docs, language_id.train(docs.where(~held)))
    return done.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    done = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = training_order.write_shards(table(spark, sf_dir, "documents"))
    return training_order.read_shards(spark, path).drop("tokens")


def op2_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quotations.link(table(spark, sf_dir, "conversations"))
    return done.withColumn("own_sha256", F.sha2("own_text", 256)).drop("own_text")


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_classifier.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), temperature=1.0)
    return done.select("doc_id", "n_grams", F.round("log_weight", 6).alias("log_weight"), "kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    size = lambda c: F.size(c).cast("long")
    return done.select("doc_id", "n_words", size("hit").alias("n_hit"), size("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def queries() -> dict:
    return {f.__name__: f for f in (op1_training_order, op2_distribution_divergence, op3_line_dedup, op4_quotation_linking, op5_importance_resampling, op6_substring_dedup, op7_decontaminate, op8_jaccard_join, op9_language_id, op10_bpe_round_trip)}


def oracle_sql() -> dict[str, str]:
    return {"op1_training_order": training_order.ORACLE, "op3_line_dedup": line_dedup.ORACLE, "op6_substring_dedup": substring_dedup.ORACLE, "op7_decontaminate": decontaminate.ORACLE, "op8_jaccard_join": jaccard_join.ORACLE}
