"""The named queries of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import workspace
from . import oracle
from .ans import decode_token_file, with_starts, write_token_file
from .collocations import collocations
from .counting import count_tokens
from .covertree import near_duplicates
from .languages import identify
from .licences import scan_licences
from .mixing import mix_sources, word_count
from .negatives import hard_negatives
from .packing import pack
from .rules import quality_rules
from .setjoin import Rule, link_components
from .substrings import substring_dedup
from .toxicity import score_toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256", "spans")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "token-file")
    write_token_file(_documents(spark, sf_dir), path)
    decoded = decode_token_file(spark, path)
    # the checksum first: starts then need no shuffle of the ids
    return with_starts(decoded.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), path)


def op4_embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir).select("doc_id", "text"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(_documents(spark, sf_dir).select("doc_id", "text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(_documents(spark, sf_dir), Rule(n=3, percent=90))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "failed_rules",
    )


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "lang", "text")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with noise: every seventh row has the next one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    noisy = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(noisy, F.col("vec_id") % 100 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_documents(spark, sf_dir).select("lang", "text"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_token_file": op3_token_file,
    "op4_embedding_pairs": op4_embedding_pairs,
    "op5_mixing": op5_mixing,
    "op6_token_counts": op6_token_counts,
    "op7_licence_scan": op7_licence_scan,
    "op8_packing": op8_packing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_quality_rules": op10_quality_rules,
    "op11_language_id": op11_language_id,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_collocations": op13_collocations,
}
SQL = oracle.SQL
