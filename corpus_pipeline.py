"""The corpus pipeline: documents to training tokens in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, which are the rows
that the stage before has written. All but the last return the columns of documents.

Common to all stages: null and empty texts are documents of no words; rows without an id stay
rows; an empty table gives an empty result; columns beyond those of documents are carried
whatever their names, as stages compute under names of their own; ties are broken by id and text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge.llm import bpe, mixing, ngram_join, resampling, suffix_dedup
from lapforge.llm.common import staged, table


def _plain(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs under names that clash with none, and the columns that bring its names back."""
    names = docs.columns
    return docs.toDF(*[f"_in{i}" for i in range(len(names))]), [F.col(f"_in{i}").alias(c) for i, c in enumerate(names)]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps; repeated rows fare alike."""
    return resampling.select(docs, table(spark, sf_dir, "labels"))


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every group of linked documents; rows without an id stay.

    Of rows that repeat an id and a text one stays; different texts of one id are one document and all stay.
    """
    least = ngram_join.components(docs.select("doc_id", "text")).where("doc_id = component_id").select(F.col("doc_id").alias("_least")).distinct()
    held, back = _plain(docs)
    at = {c: F.col(f"_in{i}") for i, c in enumerate(docs.columns)}
    linked = held.join(least, at["doc_id"] == F.col("_least"), "left_semi").withColumn("_text", F.xxhash64(at["text"]))
    linked = linked.dropDuplicates([f"_in{docs.columns.index('doc_id')}", "_text"]).drop("_text")
    return linked.unionByName(held.where(at["doc_id"].isNull())).select(*back)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings of earlier ones; n_chars follows the text."""
    held, back = _plain(docs)
    at = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    others = [a for c, a in at.items() if c not in ("doc_id", "text", "n_chars")]
    cut = suffix_dedup.remove_repeats(held, id_col=at["doc_id"], text_col=at["text"], out_col="_kept", carry=tuple(others))
    text = F.make_valid_utf8(F.col("_kept").cast("string"))  # a cut inside a character leaves bytes that are no UTF-8
    cut = cut.withColumn(at["text"], text)
    return cut.withColumn(at["n_chars"], F.length(at["text"]).cast("long")).select(*back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them, to the nearest whole time (at least once if it takes any word).

    A row without an id, or with an id that another row has too, is taken by its own count: it
    is mixed under a number of its own.
    """
    held, back = _plain(docs)
    at = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    twice = held.where(F.col(at["doc_id"]).isNotNull()).groupBy(F.col(at["doc_id"]).alias("_twice")).count().where("count > 1").select("_twice")
    twice = staged(twice, "mix-twice")
    own = F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))
    alone = held.join(twice, F.col(at["doc_id"]) == F.col("_twice"), "left_anti").where(F.col(at["doc_id"]).isNotNull())
    other = held.join(twice, F.col(at["doc_id"]) == F.col("_twice"), "left_semi").unionByName(held.where(F.col(at["doc_id"]).isNull()))
    other = staged(other.withColumn("_row", own), "mix-other")  # staged, so that the numbers stay
    rows = alone.withColumn("_row", F.col(at["doc_id"]).cast("string")).unionByName(other)
    mix = mixing.taken_words(rows, id_col="_row", text_col=at["text"], source_col=at["source"]).where("taken > 0")
    mix = mix.groupBy("_row").agg(F.max(F.round(F.col("taken") / F.col("size"))).alias("_times"))
    times = F.greatest(F.col("_times"), F.lit(1)).cast("int")
    return rows.join(mix, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).select(*back)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the bytes that they decode to."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, outputs=("ids", "n_tokens", "decoded_sha256"), keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", keep_one_of_group),
    ("suffix_array_dedup", cut_repeats),
    ("source_mix", mix_sources),
    ("bpe_encoding", encode),
]
#: SQL cannot express the fitted classifier, the suffix removal or the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
