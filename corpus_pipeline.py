"""A corpus from documents to packed sequences: five stages, each over all its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of `docs`
except for the last, which returns pieces of token sequences. Columns other than doc_id, text,
source and n_chars pass as they are, whatever they are called. Null and empty texts have no
words: they are not toxic, like nothing, hold no passage, weigh nothing in the mix, and are one
piece of one id. A repeated row is a row; rows without id stay and are compared with none. No
documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallypost.llm.mixing import mix_sources, mixed_rows, word_count
from tallypost.llm.packing import pack
from tallypost.llm.setjoin import Rule, link_components
from tallypost.llm.staging import packed, unpacked, written
from tallypost.llm.substrings import substring_dedup
from tallypost.llm.toxicity import score_toxicity

NEAR = Rule(n=5, percent=80)
_OTHERS = "_others"  # the columns that a stage has no use for


def _counted(docs: DataFrame) -> DataFrame:
    """The number of characters follows a text that has changed."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(packed(docs, "doc_id", "text", into=_OTHERS), labels)
    return unpacked(scored.where("predicted = 0").select("doc_id", "text", _OTHERS), docs, [], into=_OTHERS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of alike documents the one with the smallest id stays; rows without id stay."""
    links = link_components(docs.select("doc_id", "text"), NEAR)
    gone = written(links.where("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds go from the text; the number of characters follows."""
    kept = substring_dedup(packed(docs, "doc_id", "text", into=_OTHERS)).select("doc_id", "text", _OTHERS)
    return _counted(unpacked(kept, docs, [], into=_OTHERS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives its target: documents come once per epoch, one is cut at the budget."""
    sized = packed(docs, "doc_id", "text", "source", into=_OTHERS).withColumn("_size", word_count(F.col("text")))
    mixed = mixed_rows(mix_sources(sized, size_col="_size"), size_col="_size")
    return _counted(unpacked(mixed.select("doc_id", "text", "source", _OTHERS), docs, [], into=_OTHERS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences of at most 1024 ids."""
    return pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("mixing", mixing),
    ("packing", packing),
]
# A trained classifier and a vocabulary take part: tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
