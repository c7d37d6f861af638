"""The thin queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hard_negatives, html_text, kneser_ney, mixing, ngram_join, phrases, pstable, quality_rules, resampling, sql, suffix_dedup, target_resampling, token_counts
from .common import table


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep=["doc_id"])


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op3_distribution_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.distribution_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_documents(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeats(table(spark, sf_dir, "documents"), out_col="kept_sha256", digest=True)


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), out_col="kept_sha256", digest=True)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = target_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = token_counts.load(public_tokenizers.path("word_bpe_49k.json"))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), source)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_distribution_rules": op3_distribution_rules,
    "op4_kneser_ney": op4_kneser_ney,
    "op5_html_text": op5_html_text,
    "op6_multiprobe_neighbours": op6_multiprobe_neighbours,
    "op7_phrase_automata": op7_phrase_automata,
    "op8_importance_resampling": op8_importance_resampling,
    "op9_source_mix": op9_source_mix,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_target_resampling": op12_target_resampling,
    "op13_token_counts": op13_token_counts,
}
ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL
