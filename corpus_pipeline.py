"""The corpus pipeline: quality rules, near duplicates, repeated spans, benchmark passages, tokens.

Each stage takes the documents its predecessor kept and returns the columns of documents, the last one tokens. A stage's
result is written as Parquet and read again as the next one's documents.

Defined results: null and empty texts have no words, so the first stage drops them; a null language is judged by script; rows of one id
are one document where texts are compared, and each of them stays or goes with it; a null id is an id of its own, before all
others; of equal or linked texts the one of smallest id stays; other columns of documents, whatever their names, pass
through up to the last stage, which keeps doc_id, lang and source; empty tables give an empty result; very long texts are read whole.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import bpe, decontamination, jaccard, quality, substrings
from tidelake.llm.common import fresh, scratch_path, written
from tidelake.llm.registry import FERTILITY, table, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality.judge(docs, *(vocabulary(name) for name in FERTILITY))
    own = fresh("_kept_id", docs.columns)
    kept = written(judged.where("kept").select(F.col("doc_id").alias(own)).distinct(), "kept")
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one of smallest id."""
    labelled = jaccard.similarity_components(docs)
    own = fresh("_stay_id", docs.columns)
    stay = labelled.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that repeat earlier spans; those with no word left go. Others keep their text as it is."""
    return substrings.without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids and token_offsets of each document."""
    return bpe.encode(docs, vocabulary("byte_bpe_50k.tiktoken"), keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality_rules", quality_rules), ("ngram_jaccard_join", near_duplicates), ("substring_dedup", repeated_spans),
    ("benchmark_decontamination", benchmark_passages), ("byte_level_bpe", tokens)]
#: Byte-pair merges are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
